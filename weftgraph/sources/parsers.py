"""Facts from source files: one row for each type, method, field and reference, by language.

extract() runs over (module, path, root, is_test, content) rows, a file at a time, so any number of files spreads over any
number of tasks; what needs other files (names in the same package, interface dispatch, tests) is left to
``operators.linking``, as joins. Comments and strings are blanked first, braces are matched once, and members are read from
the headers between them. Python goes through its own syntax tree.

A name that is imported has its full name in ``target``; others have null and are looked for later. A Java call has ``chain``: what is
called or read on the named receiver before the last call, as name/arguments or a field's name, ``arity``, the last call's number of
arguments, and ``strict`` if it is a call without a receiver that may be inherited. A method's ``arity`` is null if it takes any number. Null or empty content:
no rows. A file that can't be parsed: one row of kind ``unresolved``. PARSERS maps extensions to readers; register() adds one.
"""

from __future__ import annotations

import ast
import re

from pyspark.sql import DataFrame

FACTS = ("what string, module string, path string, is_test boolean, language string, package string, owner string, name string, kind string, declared string, "
         "visibility string, annotations array<string>, is_static boolean, is_abstract boolean, synthetic boolean, line int, line_end int, target string, member string, caller string, confidence string, "
         "chain array<string>, arity int, strict boolean")
COLUMNS = [c.split()[0] for c in FACTS.split(", ")]

# Type names that are no types of a project.
STANDARD_TYPES = {"String", "Int", "Long", "Double", "Float", "Boolean", "Byte", "Short", "Char", "Unit", "Any", "Nothing", "List", "Set", "Map", "MutableList", "MutableSet", "MutableMap",
                  "Collection", "Iterable", "Sequence", "Array", "Pair", "Triple", "Optional", "T", "R", "K", "V", "E"}
# Call names that mean reflection in Java.
REFLECTION = {"invoke": "java.lang.reflect.Method", "newInstance": "java.lang.reflect.Constructor", "forName": "java.lang.Class", "getMethod": "java.lang.reflect.Method", "getDeclaredMethod": "java.lang.reflect.Method"}
# Predeclared names in Go.
GO_BUILTINS = {"string", "int", "int8", "int16", "int32", "int64", "uint", "uint8", "uint16", "uint32", "uint64", "float32", "float64", "bool", "byte", "rune", "error",
               "len", "cap", "make", "new", "append", "copy", "close", "panic", "recover", "print", "println", "fmt", "log", "time"}
NOT_CALLS = {"if", "for", "while", "switch", "catch", "return", "super", "this", "new", "synchronized", "when", "function", "func", "fun", "constructor", "throw", "assert"}

_QUOTED = re.compile(r'/\*.*?\*/|//[^\n]*|""".*?"""|"(?:\\.|[^"\\\n])*"|\'(?:\\.|[^\'\\\n])*\'|`[^`]*`', re.S)
_NOTE = re.compile(r"@(?!interface\b)([\w.]+)")


def domain_types(declared: str) -> list[str]:
    """The distinct names in a type's text that may be types of a project."""
    return [n for n in dict.fromkeys(re.findall(r"\w+", declared or "")) if n not in STANDARD_TYPES and not n.isdigit()]


class Source:
    """A text with comments and strings blanked, its brace pairs and the depth of every position."""

    def __init__(self, text: str):
        self.text = text
        self.bare = _QUOTED.sub(lambda m: re.sub(r"[^\n]", " ", m.group()), text)
        self.close, self.depth, stack = {}, [], []
        for i, c in enumerate(self.bare):
            if c == "}" and stack:
                self.close[stack.pop()] = i
            self.depth.append(len(stack))
            if c == "{":
                stack.append(i)
        for i in stack:
            self.close[i] = len(text)
        self.round, self.opened, stack = {}, {}, []
        for m in re.finditer(r"[()]", self.bare):
            if m.group() == "(":
                stack.append(m.start())
            elif stack:
                at = stack.pop()
                self.round[at], self.opened[m.start()] = m.start(), at
        self.starts = [0, *(m.end() for m in re.finditer("\n", text))]

    def line(self, at: int) -> int:
        import bisect

        return bisect.bisect_right(self.starts, at)

    def end_of(self, at: int, pair: str = "()") -> int:
        """The position after the bracket that closes the one at ``at``."""
        level = 0
        for i in range(at, len(self.bare)):
            level += (self.bare[i] == pair[0]) - (self.bare[i] == pair[1])
            if not level:
                return i + 1
        return len(self.bare)

    def last_before(self, at: int) -> int:
        """The position of the last character before ``at`` that is no white space; -1 if there is none."""
        at -= 1
        while at >= 0 and self.bare[at].isspace():
            at -= 1
        return at

    def word_ending(self, at: int) -> str:
        """The word whose last character is at ``at``; empty if there is none."""
        start = at
        while start >= 0 and (self.bare[start].isalnum() or self.bare[start] in "_$"):
            start -= 1
        return self.bare[start + 1:at + 1]

    def arguments(self, at: int) -> int:
        """How many arguments the call has whose bracket opens at ``at``."""
        end, level, n = self.round.get(at, at + 1), 0, 1
        for c in self.bare[at + 1:end]:
            level += (c in "([{<") - (c in ")]}>")
            n += c == "," and level <= 0
        # a string is blank here, but an argument
        return n if n > 1 or re.sub(r"/\*.*?\*/|//[^\n]*", "", self.text[at + 1:end], flags=re.S).strip() else 0

    def receiver(self, at: int) -> tuple[str, list[str]] | None:
        """(base, links) before a call whose name begins at ``at``: the base is a name, ``new`` and a name, or empty for a call
        on the type itself. None: an expression that is none of these."""
        links, dot = [], self.last_before(at)
        while True:
            i = self.last_before(dot)
            if i < 0:
                return None
            if self.bare[i] == ")":
                opened = self.opened.get(i)
                i = -1 if opened is None else self.last_before(opened)
                word = self.word_ending(i)
                before = self.last_before(i - len(word) + 1)
                if not word or word in NOT_CALLS:
                    return None
                if self.word_ending(before) == "new":
                    return f"new {word}", links
                links.insert(0, f"{word}/{self.arguments(opened)}")
                if before < 0 or self.bare[before] != ".":
                    return "", links
            else:
                word = self.word_ending(i)
                before = self.last_before(i - len(word) + 1)
                if not word:
                    return None
                if before < 0 or self.bare[before] != ".":
                    return word, links
                links.insert(0, word)
            dot = before

    def notes(self, start: int, end: int) -> tuple[list[str], str]:
        """Annotations from start to end, each by simple name and as written, and what follows them."""
        out, at = [], start
        while True:
            m = re.compile(r"\s*").match(self.bare, at, end)
            note = _NOTE.match(self.bare, m.end(), end)
            if not note:
                return out, self.bare[at:end]
            at = note.end()
            args = re.compile(r"\s*\(").match(self.bare, at, end)
            if args:
                at = min(end, self.end_of(args.end() - 1))
            out += [note.group(1).rsplit(".", 1)[-1], self.text[note.start():at].strip().replace(",", ";")]

    def head_before(self, at: int) -> int:
        """Where the declaration that holds ``at`` begins: after the last ; { or } before it, outside of brackets."""
        level, i = 0, at - 1
        while i >= 0:
            c = self.bare[i]
            level += (c == ")") - (c == "(")
            if level < 0 or (not level and c in ";{}"):
                break
            i -= 1
        return i + 1


def _split(text: str) -> list[str]:
    """Parts between commas outside of brackets."""
    out, level, at = [], 0, 0
    for i, c in enumerate(text):
        level += (c in "([{<") - (c in ")]}>")
        if c == "," and level <= 0:
            out.append(text[at:i])
            at = i + 1
    return [p.strip() for p in [*out, text[at:]] if p.strip()]


def _plain(declared: str) -> str:
    """A type's text without arguments, arrays and marks."""
    while re.search(r"<[^<>]*>", declared):
        declared = re.sub(r"<[^<>]*>", "", declared)
    return re.sub(r"\[.*?\]|\.\.\.|[?*&]", "", declared).strip()


class Facts:
    def __init__(self, language: str, file: dict, package: str, imports: dict[str, str]):
        self.base = {"language": language, "package": package, "module": file["module"], "path": file["path"], "is_test": bool(file["is_test"])}
        self.package, self.imports, self.rows = package, imports, []

    def full(self, name: str) -> str:
        return f"{self.package}.{name}" if self.package else name

    def add(self, what: str, owner: str, name: str, kind: str, line: int, **more) -> None:
        self.rows.append({**self.base, "what": what, "owner": owner, "name": name, "kind": kind, "line": line, **more})

    def ref(self, owner: str, kind: str, name: str, line: int, target: str | None = None, member: str | None = None, caller: str = "", confidence: str = "CONFIRMED") -> None:
        self.add("ref", owner, name, kind, line, target=target or self.imports.get(name), member=member, caller=caller, confidence=confidence)

    def uses(self, owner: str, declared: str, line: int, caller: str = "") -> None:
        """USES of imported names only."""
        for n in domain_types(declared):
            if n in self.imports:
                self.ref(owner, "USES", n, line, caller=caller)


def _java_visibility(words: list[str], default: str = "PACKAGE") -> str:
    return next((w.upper() for w in words if w in ("public", "protected", "private")), default)


def java(file: dict, text: str) -> list[dict]:
    src = Source(text)
    package = re.search(r"^\s*package\s+([\w.]+)\s*;", src.bare, re.M)
    plain = {m.group(2).rsplit(".", 1)[-1]: m.group(2) for m in re.finditer(r"^\s*import\s+(static\s+)?([\w.]+)\s*;", src.bare, re.M) if not m.group(1)}
    out = Facts("java", file, package.group(1) if package else "", plain)
    for m in re.finditer(r"(?<![\w.@])(class|interface|enum|record|@interface)\s+(\w+)([^{;]*)\{", src.bare):
        if src.depth[m.start()]:
            continue
        _java_type(src, out, m)
    return out.rows


def _java_type(src: Source, out: Facts, m: re.Match) -> None:
    kind = {"@interface": "ANNOTATION"}.get(m.group(1), m.group(1).upper())
    own, open_at = out.full(m.group(2)), m.end() - 1
    end = src.close[open_at]
    notes, words = src.notes(src.head_before(m.start()), m.start())
    line, words = src.line(m.start()), words.split()
    out.add("type", own, m.group(2), kind, line, line_end=src.line(end), visibility=_java_visibility(words), annotations=notes, is_abstract="abstract" in words)
    tail = _plain(m.group(3))
    clause = {k: _split(v) for k, v in re.findall(r"\b(extends|implements)\s+(.*?)(?=\bextends\b|\bimplements\b|\bpermits\b|$)", tail, re.S)}
    bases = clause.get("extends", []) + clause.get("implements", [])
    for base in clause.get("extends", [])[:1] if kind != "INTERFACE" else clause.get("extends", []):
        out.ref(own, "EXTENDS", base, line, base if "." in base else None)
    for base in clause.get("implements", []):
        out.ref(own, "IMPLEMENTS", base, line, base if "." in base else None)
    for name, full in out.imports.items():
        out.ref(own, "IMPORTS", name, line, full)
    fields, methods, at = {}, [], open_at + 1
    if kind == "ENUM":
        at = next((i + 1 for i in range(at, end) if src.bare[i] == ";" and src.depth[i] == 1), end)
    i = at
    while i < end:
        c = src.bare[i]
        if c == "{" or c == ";":
            stop = src.close[i] if c == "{" else i
            member_notes, head = src.notes(at, i)
            _java_member(src, out, own, kind, at, i, stop, c == "{", member_notes, head, fields, methods)
            at = i = stop + 1
        elif c == "(":
            i = src.end_of(i)
        else:
            i += 1
    _lombok(out, own, notes, fields, line)
    declared, qualifiers, siblings = {f: t for f, (t, *_) in fields.items()}, {f: q for f, (*_, q) in fields.items()}, {n for n, *_ in methods}
    for name, params, start, stop in methods:
        _java_calls(src, out, own, name, declared | params, qualifiers, siblings, bases, start, stop)


def _java_member(src, out, own, type_kind, at, head_end, stop, block, notes, head, fields, methods):
    m = re.match(r"\s*((?:(?:public|protected|private|static|final|abstract|default|synchronized|native|transient|volatile|strictfp)\s+)*)(?:<[^()=]*?>\s+(?=[\w.<]+\s))?(.*)", head, re.S)
    words, rest = m.group(1).split(), m.group(2).strip()
    line = src.line(at + len(src.bare[at:head_end]) - len(src.bare[at:head_end].lstrip()))
    if re.match(r"(class|interface|enum|record|@interface)\s+\w", rest):
        return
    more = {"visibility": _java_visibility(words, "PUBLIC" if type_kind == "INTERFACE" else "PACKAGE"), "annotations": notes, "is_static": "static" in words}
    sign = re.match(r"([\w.<>\[\],?&\s]*?)\s*\b(\w+)\s*\((.*)\)[^()]*$", rest, re.S) if "(" in rest.split("=")[0] else None
    if sign:
        params = {}
        for p in _split(sign.group(3)):
            p = re.sub(r"@[\w.]+(\s*\([^()]*\))?|\bfinal\b", "", p).strip()
            if " " in p:
                declared, name = p.rsplit(None, 1)
                params[name] = declared.strip()
        name = "<init>" if not sign.group(1).strip() else sign.group(2)
        out.add("method", own, name, "METHOD", line, declared=sign.group(1).strip(), member=f"{name}({','.join(params.values())})", target=out.imports.get(_plain(sign.group(1))),
                arity=None if any(t.endswith("...") for t in params.values()) else len(params), is_abstract="abstract" in words or (type_kind == "INTERFACE" and not block), line_end=src.line(stop), **more)
        if block:
            methods.append((name, params, head_end, stop))
        return
    declared = re.match(r"([\w.]+(?:\s*<.*>)?(?:\[\])*)\s+(\w+(?:\[\])*(?:\s*,\s*\w+)*)\s*(?:=|$)", rest.split("=")[0], re.S)
    if declared:
        for name in re.findall(r"\w+", declared.group(2)):
            qualifier = (re.search(r"@(?:Qualifier|Named)\s*\(\s*\"([^\"]+)\"", ";".join(notes)) or [None, None])[1]
            fields[name] = (declared.group(1), "final" in words, qualifier)
            out.add("field", own, name, "FIELD", line, declared=declared.group(1), member=qualifier, target=out.imports.get(_plain(declared.group(1))), **more)


def _java_calls(src, out, own, method, known, qualifiers, siblings, bases, start, stop):
    known = known | {m.group(2): m.group(1) for m in re.finditer(r"\b([A-Z]\w*)(?:<[^;=()]*>)?\s+(\w+)\s*(?=[=;:])", src.bare[start:stop])}
    simple = own.rsplit(".", 1)[-1]

    def call(declared, target, name, at, chain=(), strict=False, qualifier=None):
        out.ref(own, "CALLS", declared, src.line(at), target, name, method)
        out.rows[-1] |= {"declared": qualifier, "chain": list(chain), "arity": src.arguments(src.bare.index("(", at)), "strict": strict}

    for m in re.compile(r"\b(\w+)\s*\(").finditer(src.bare, start, stop):
        name, at = m.group(1), m.start()
        before = src.last_before(at)
        word = src.word_ending(before)
        if name in REFLECTION:
            out.ref(own, "CALLS", name, src.line(at), REFLECTION[name], name, method, "POSSIBLE")
        elif word == "new":
            out.ref(own, "CALLS", name, src.line(at), None, "<init>", method)
        elif before < 0 or src.bare[before] != ".":
            if name in siblings:
                call(simple, own, name, at)
            elif bases and name not in NOT_CALLS and name[:1].islower() and (not word or word in NOT_CALLS or word in ("else", "do", "case")):
                call(simple, own, name, at, strict=True)
        else:
            base, links = src.receiver(at) or (None, [])
            if base is None:
                continue
            first = base.removeprefix("new ")
            declared = first if base.startswith("new ") else _plain(known.get(first, first if first[:1].isupper() else ""))
            if base in ("", "this"):
                if links or name in siblings or bases:
                    call(simple, own, name, at, links, strict=not links and name not in siblings)
            elif base == "super":
                if bases:
                    call(bases[0], bases[0] if "." in bases[0] else None, name, at, links)
            elif declared:
                call(declared, None, name, at, links, qualifier=None if links else qualifiers.get(base))
            elif bases:
                call(simple, own, name, at, [base, *links])


def _lombok(out: Facts, own: str, notes: list[str], fields: dict, line: int) -> None:
    """Members that annotations on the type stand for; line 0."""
    has = set(notes)

    def made(name, args="", declared=""):
        out.add("method", own, name, "METHOD", 0, declared=declared, member=f"{name}({args})", visibility="PUBLIC", annotations=[], synthetic=True, target=out.imports.get(_plain(declared)), arity=len(_split(args)))

    for f, (declared, final, _) in fields.items():
        cap = f[:1].upper() + f[1:]
        if has & {"Data", "Getter", "Value"}:
            made(f"get{cap}", "", declared)
        if has & {"Data", "Setter"} and not final:
            made(f"set{cap}", declared, "void")
    if has & {"RequiredArgsConstructor", "AllArgsConstructor"}:
        made("<init>", ",".join(d for d, final, _ in fields.values() if final or "AllArgsConstructor" in has))
    if "Builder" in has:
        made("builder")
    if "Data" in has:
        for name in ("equals", "hashCode", "toString"):
            made(name)
    if has & {"Slf4j", "Log", "Log4j", "Log4j2", "CommonsLog"}:
        out.add("field", own, "log", "FIELD", 0, declared="Logger", visibility="PRIVATE", annotations=[], is_static=True, synthetic=True)


def kotlin(file: dict, text: str) -> list[dict]:
    src = Source(text)
    package = re.search(r"^\s*package\s+([\w.]+)", src.bare, re.M)
    imports = {(m.group(2) or m.group(1).rsplit(".", 1)[-1]): m.group(1) for m in re.finditer(r"^\s*import\s+([\w.]+)(?:\s+as\s+(\w+))?\s*$", src.bare, re.M)}
    out = Facts("kotlin", file, package.group(1) if package else "", imports)
    file_type = out.full(re.sub(r"\.\w+$", "", file["path"].rsplit("/", 1)[-1]) + "Kt")
    spans, known, loose = [], {}, False
    for m in re.finditer(r"(?<![\w.:])(?:(companion)\s+)?(class|interface|object)\b[ \t]*(\w+)?", src.bare):
        if not m.group(3) and not m.group(1):
            continue
        head = _kotlin_head(src.bare[src.bare.rfind("\n", 0, m.start()) + 1:m.start()])
        start = _kotlin_notes_start(src, m.start())
        notes, words = src.notes(start, m.start())
        kind = "INTERFACE" if m.group(2) == "interface" else "ENUM" if "enum" in words.split() else "ANNOTATION" if "annotation" in words.split() else "CLASS"
        own, line, at = out.full(m.group(3) or "Companion"), src.line(m.start()), m.end()
        at = _skip(src, at, "<", "<>")
        at = re.compile(r"\s*(?:(?:private|internal|protected|public)?\s*(?:@\w+\s*)*constructor\s*)?").match(src.bare, at).end() if re.compile(r"\s*(?:[\w@]+\s+)*?constructor\s*\(|\s*\(").match(src.bare, at) else at
        params = ""
        if src.bare[at:at + 1] == "(":
            stop = src.end_of(at)
            params, at = src.bare[at + 1:stop - 1], stop
        bases = re.compile(r"\s*:\s*([^{\n]+(?:,\s*\n[^{\n]+)*)").match(src.bare, at)
        if bases:
            at = bases.end()
        body = re.compile(r"\s*\{").match(src.bare, at)
        end = src.close[body.end() - 1] if body else at
        out.add("type", own, own.rsplit(".", 1)[-1], kind, line, line_end=src.line(max(at, end) - 1), visibility=_java_visibility(head + words.split(), "PUBLIC"), annotations=notes, is_abstract="abstract" in words.split())
        for b in _split(bases.group(1) if bases else ""):
            name = _plain(re.sub(r"\(.*", "", b, flags=re.S)).split(" ")[0]
            out.ref(own, "EXTENDS" if kind == "INTERFACE" else "IMPLEMENTS", name, line)
        mine = known.setdefault(own, {})
        for p in _split(params):
            q = re.match(r"(?:@\w+(?:\([^()]*\))?\s*|private\s+|protected\s+|internal\s+|public\s+|override\s+)*(val\s+|var\s+)?(\w+)\s*:\s*([^=]+)", p)
            if q:
                mine[q.group(2)] = q.group(3).strip()
                out.uses(own, q.group(3), line)
                if q.group(1):
                    out.add("field", own, q.group(2), "FIELD", line, declared=q.group(3).strip(), visibility=_java_visibility(p.split(), "PUBLIC"), annotations=[])
        spans.append((body.end() if body else at, end, own, src.depth[body.end()] if body and body.end() < len(src.depth) else -1))

    def owner_of(at):
        inner = [s for s in spans if s[0] <= at < s[1]]
        return max(inner) if inner else (0, len(text), file_type, 0)

    for m in re.finditer(r"\btypealias\s+(\w+)[^=\n]*=\s*([^\n]+)", src.bare):
        loose = True
        out.uses(file_type, m.group(2), src.line(m.start()), m.group(1))
    for m in re.finditer(r"\b(?:val|var)\s+(\w+)\s*(?::\s*([^=\n{]+))?", src.bare):
        _, _, own, depth = owner_of(m.start())
        if src.depth[m.start()] == depth and src.bare[:m.start()].count("(") == src.bare[:m.start()].count(")"):
            loose |= own == file_type
            declared = (m.group(2) or "").strip()
            known.setdefault(own, {})[m.group(1)] = declared
            words = src.bare[src.bare.rfind("\n", 0, m.start()) + 1:m.start()].split()
            out.add("field", own, m.group(1), "FIELD", src.line(m.start()), declared=declared, visibility=_java_visibility(words, "PUBLIC"), annotations=[])
            out.uses(own, declared, src.line(m.start()))
    for m in re.finditer(r"\bfun\s+(?:<[^>]*>\s*)?(?:([\w<>?, ]+)\.)?(\w+)\s*\(", src.bare):
        _, _, own, depth = owner_of(m.start())
        if src.depth[m.start()] != depth:
            continue
        loose |= own == file_type
        stop, line, name = src.end_of(m.end() - 1), src.line(m.start()), m.group(2)
        params = {p.split(":", 1)[0].split()[-1]: re.sub(r"=.*", "", p.split(":", 1)[1]).strip() for p in _split(src.bare[m.end():stop - 1]) if ":" in p and p.split(":", 1)[0].split()}
        words = src.bare[src.bare.rfind("\n", 0, m.start()) + 1:m.start()].split()
        notes, _ = src.notes(_kotlin_notes_start(src, m.start()), m.start())
        result = re.compile(r"\s*(?::\s*([^={\n]+))?\s*(=|\{)?").match(src.bare, stop)
        open_at = result.end() - 1 if result.group(2) == "{" else None
        end = src.close[open_at] if open_at is not None else (src.bare.find("\n", result.end()) if result.group(2) else stop)
        end = len(text) if end < 0 else end
        out.add("method", own, name, "METHOD", line, declared=(result.group(1) or "").strip(), member=f"{name}({','.join(params.values())})", visibility=_java_visibility(words, "PUBLIC"), annotations=notes, is_abstract="abstract" in words, line_end=src.line(max(m.start(), end - 1)))
        for t in ([m.group(1)] if m.group(1) else []) + list(params.values()) + [result.group(1) or ""]:
            out.uses(own, t, line, name)
        _import_calls(src, out, own, name, {**known.get(own, {}), **params}, stop, end)
    if loose:
        out.add("type", file_type, file_type.rsplit(".", 1)[-1], "CLASS", 1, line_end=src.line(len(text)), visibility="PUBLIC", annotations=[], synthetic=True)
    _import_edges(out)
    return out.rows


def _kotlin_head(line: str) -> list[str]:
    return re.sub(r"@\w+(\([^()]*\))?", "", line).split()


def _kotlin_notes_start(src: Source, at: int) -> int:
    """Back over the lines of annotations and the modifiers before a declaration."""
    start = src.bare.rfind("\n", 0, at) + 1
    while start:
        before = src.bare.rfind("\n", 0, start - 1) + 1
        if not src.bare[before:start].strip().startswith("@"):
            break
        start = before
    lead = re.compile(r"[^@\w]*").match(src.bare, start, at).end()
    return lead


def _skip(src: Source, at: int, opener: str, pair: str) -> int:
    m = re.compile(r"\s*").match(src.bare, at)
    return src.end_of(m.end(), pair) if src.bare[m.end():m.end() + 1] == opener else at


def _import_calls(src, out, own, caller, known, start, end):
    """Calls on variables of imported types, and of imported names."""
    for m in re.finditer(r"\b(?:this\s*\.\s*)?(\w+)\s*\??\.\s*(\w+)\s*\(", src.bare[start:end]):
        for n in domain_types(known.get(m.group(1), ""))[:1]:
            if n in out.imports:
                out.ref(own, "CALLS", n, src.line(start + m.start()), caller=caller)
    for m in re.finditer(r"(?<![\w.])([A-Z]\w*)\s*[.(]", src.bare[start:end]):
        if m.group(1) in out.imports:
            out.ref(own, "CALLS", m.group(1), src.line(start + m.start()), caller=caller, confidence="POSSIBLE")


def _import_edges(out: Facts) -> None:
    for own in [r["owner"] for r in out.rows if r["what"] == "type"]:
        for name, full in out.imports.items():
            out.ref(own, "IMPORTS", name, 0, full)


def _folder_package(file: dict) -> str:
    path, root = file["path"], (file.get("root") or "").strip("/")
    inside = path[len(root) + 1:] if root and path.startswith(root + "/") else path
    return ".".join(inside.split("/")[:-1])


def typescript(file: dict, text: str) -> list[dict]:
    src, imports = Source(text), {}
    for m in re.finditer(r"^\s*import\s+(?:type\s+)?([^;'\"]*?)\s*from\s*['\"]([^'\"]+)['\"]", text, re.M):
        for part in re.findall(r"(?:\w+\s+as\s+)?(\w+)(?=\s*(?:[,}]|$))", re.sub(r"\*\s+as\s+", "", m.group(1))):
            imports[part] = m.group(2)
    out = Facts("typescript", file, _folder_package(file), imports)
    for m in re.finditer(r"(?<![\w.])(class|interface|enum)\s+(\w+)([^{;]*)\{", src.bare):
        if src.depth[m.start()]:
            continue
        own, line, open_at = out.full(m.group(2)), src.line(m.start()), m.end() - 1
        end = src.close[open_at]
        notes, words = src.notes(_kotlin_notes_start(src, m.start()), m.start())
        out.add("type", own, m.group(2), m.group(1).upper(), line, line_end=src.line(end), visibility="PUBLIC" if "export" in words.split() else "PACKAGE", annotations=notes, is_abstract="abstract" in words.split())
        for kind, names in re.findall(r"\b(extends|implements)\s+(.*?)(?=\bimplements\b|$)", _plain(m.group(3)), re.S):
            for base in _split(names):
                out.ref(own, kind.upper(), base, line, imports.get(base) or out.full(base))
        known = {}
        for f in re.finditer(r"(?m)^[ \t]*((?:(?:public|private|protected|static|readonly|declare)\s+)*)(\w+)[?!]?\s*:\s*([^=;(){}\n]+)(?=[=;\n])", src.bare[open_at:end]):
            if src.depth[open_at + f.start(2)] == 1:
                known[f.group(2)] = f.group(3).strip()
                out.add("field", own, f.group(2), "FIELD", src.line(open_at + f.start(2)), declared=f.group(3).strip(), visibility=_java_visibility(f.group(1).split(), "PUBLIC"), annotations=[])
                out.uses(own, f.group(3), src.line(open_at + f.start(2)))
        found = []
        for f in re.finditer(r"(?m)^[ \t]*((?:(?:public|private|protected|static|async|abstract|override|readonly|get|set)\s+)*)(\w+)\s*(?:<[^>()]*>)?\(", src.bare[open_at:end]):
            at = open_at + f.end() - 1
            if src.depth[at] != 1 or f.group(2) in NOT_CALLS - {"constructor"}:
                continue
            stop, own_line = src.end_of(at), src.line(open_at + f.start(2))
            params = {}
            for p in _split(src.bare[at + 1:stop - 1]):
                q = re.match(r"(?:@\w+(?:\([^()]*\))?\s*)*((?:public\s+|private\s+|protected\s+|readonly\s+)*)(\w+)\??\s*:\s*([^=]+)", p)
                if q:
                    params[q.group(2)] = q.group(3).strip()
                    if f.group(2) == "constructor":
                        out.uses(own, q.group(3), own_line, "constructor")
                        known[q.group(2)] = q.group(3).strip()
                        if q.group(1):
                            out.add("field", own, q.group(2), "FIELD", own_line, declared=q.group(3).strip(), visibility=_java_visibility(q.group(1).split(), "PUBLIC"), annotations=[])
            body = re.compile(r"\s*(?::\s*[^{;=]+)?\{").match(src.bare, stop, end)
            close = src.close[body.end() - 1] if body else stop
            words = f.group(1).split()
            out.add("method", own, f.group(2), "METHOD", own_line, member=f"{f.group(2)}({','.join(params.values())})", visibility=_java_visibility(words, "PUBLIC"), annotations=[], is_static="static" in words, is_abstract="abstract" in words, line_end=src.line(close))
            found.append((f.group(2), params, stop, close))
        for name, params, start, stop in found:
            _import_calls(src, out, own, name, known | params, start, stop)
    _import_edges(out)
    return out.rows


def go(file: dict, text: str) -> list[dict]:
    src = Source(text)
    package = (re.search(r"^\s*package\s+(\w+)", src.bare, re.M) or [None, "main"])[1]
    imports, paths = {}, re.findall(r"^\s*import\s+(?:(\w+)\s+)?\"([^\"]+)\"", text, re.M)
    for block in re.finditer(r"^\s*import\s*\((.*?)\)", text, re.M | re.S):
        paths += re.findall(r"(?:(\w+)\s+)?\"([^\"]+)\"", block.group(1))
    for alias, path in paths:
        imports[alias or path.rsplit("/", 1)[-1]] = path
    out, bodies, loose = Facts("go", file, package, imports), {}, False

    def full(declared):
        name = _plain(declared)
        head, _, tail = name.partition(".")
        return f"{imports.get(head, head)}.{tail}" if tail else f"{package}.{name}"

    def shown(name):
        return "PUBLIC" if name[:1].isupper() else "PACKAGE"

    for m in re.finditer(r"^type\s+(\w+)(?:\[[^\]]*\])?\s+(struct|interface)\s*\{", src.bare, re.M):
        own, end = f"{package}.{m.group(1)}", src.close[m.end() - 1]
        out.add("type", own, m.group(1), "CLASS" if m.group(2) == "struct" else "INTERFACE", src.line(m.start()), line_end=src.line(end), visibility=shown(m.group(1)), annotations=[])
        if m.group(2) == "interface":
            for f in re.finditer(r"(?m)^\s*(\w+)\s*\(", src.bare[m.end():end]):
                out.add("method", own, f.group(1), "METHOD", src.line(m.end() + f.start(1)), member=f"{f.group(1)}()", visibility=shown(f.group(1)), annotations=[], is_abstract=True)
            continue
        for f in re.finditer(r"(?m)^[ \t]*(\w+(?:[ \t]*,[ \t]*\w+)*)[ \t]+([\w.*\[\]]+)", src.bare[m.end():end]):
            for name in re.findall(r"\w+", f.group(1)):
                bodies.setdefault(own, {})[name] = f.group(2)
                out.add("field", own, name, "FIELD", src.line(m.end() + f.start(1)), declared=f.group(2), visibility=shown(name), annotations=[])
    for m in re.finditer(r"^func\s+(?:\(\s*(?:(\w+)\s+)?([^)]*)\)\s*)?(\w+)\s*(?:\[[^\]]*\])?\(", src.bare, re.M):
        own = f"{package}.{_plain(m.group(2))}" if m.group(2) else f"{package}.{package}"
        loose |= not m.group(2)
        stop, line, name = src.end_of(m.end() - 1), src.line(m.start()), m.group(3)
        params = {p.split()[0]: p.split()[1] for p in _split(src.bare[m.end():stop - 1]) if len(p.split()) > 1}
        body = src.bare.find("{", stop)
        end = src.close.get(body, stop)
        out.add("method", own, name, "METHOD", line, member=f"{name}({','.join(params.values())})", visibility=shown(name), annotations=[], line_end=src.line(end))
        for t in params.values():
            if _plain(t) not in GO_BUILTINS:
                out.ref(own, "USES", _plain(t), line, full(t), caller=name)
        known = {**bodies.get(own, {}), **params}
        for c in re.finditer(r"(?:\b(\w+)\.)?\b(?:(\w+)\.)?(\w+)\s*\(", src.bare[body:end] if body >= 0 else ""):
            holder, inner, called = c.group(1), c.group(2), c.group(3)
            who, at = inner or holder, src.line(body + c.start())
            declared = _plain(known.get(who, "")) if who else ""
            if who in imports and not inner:
                out.ref(own, "CALLS", who, at, f"{imports[who]}.{called}", caller=name)
            elif "." in declared:
                out.ref(own, "CALLS", declared, at, f"{full(declared).rsplit('.', 1)[0]}.{called}", caller=name)
            elif declared and declared not in GO_BUILTINS:
                out.ref(own, "CALLS", declared, at, f"{package}.{declared}#{called}", caller=name, confidence="POSSIBLE")
            elif not who and called not in GO_BUILTINS | NOT_CALLS:
                out.ref(own, "CALLS", called, at, f"{package}.{called}", caller=name, confidence="POSSIBLE")
    if loose:
        out.add("type", f"{package}.{package}", package, "CLASS", 1, line_end=src.line(len(text)), visibility="PUBLIC", annotations=[], synthetic=True)
    _import_edges(out)
    return out.rows


def python(file: dict, text: str) -> list[dict]:
    tree, imports = ast.parse(text), {}
    for n in ast.walk(tree):
        if isinstance(n, ast.Import):
            imports |= {a.asname or a.name.split(".")[0]: a.name for a in n.names}
        elif isinstance(n, ast.ImportFrom):
            imports |= {a.asname or a.name: f"{'.' * n.level}{n.module or ''}.{a.name}" for a in n.names}
    out = Facts("python", file, _folder_package(file), imports)

    def shown(name):
        return "PRIVATE" if name.startswith("_") and not name.endswith("__") else "PUBLIC"

    def function(own, f, known):
        args = [*f.args.posonlyargs, *f.args.args, *f.args.kwonlyargs]
        typed = {a.arg: ast.unparse(a.annotation) for a in args if a.annotation}
        out.add("method", own, f.name, "METHOD", f.lineno, declared=ast.unparse(f.returns) if f.returns else "", member=f"{f.name}({','.join(a.arg for a in args if a.arg not in ('self', 'cls'))})",
                visibility=shown(f.name), annotations=[ast.unparse(d) for d in f.decorator_list], line_end=f.end_lineno)
        for n in ast.walk(f) if known is not None and f.name == "__init__" else ():
            if isinstance(n, ast.Assign) and isinstance(n.value, ast.Name) and n.value.id in typed:
                known.update({t.attr: typed[n.value.id] for t in n.targets if isinstance(t, ast.Attribute)})
        if f.name == "__init__":
            for t in typed.values():
                out.uses(own, t, f.lineno, f.name)
        return typed

    def calls(own, f, known):
        for n in ast.walk(f):
            if not isinstance(n, ast.Call):
                continue
            on = n.func.value if isinstance(n.func, ast.Attribute) else None
            name = on.attr if isinstance(on, ast.Attribute) and isinstance(on.value, ast.Name) and on.value.id == "self" else on.id if isinstance(on, ast.Name) else None
            for t in domain_types(known.get(name, ""))[:1]:
                if t in imports:
                    out.ref(own, "CALLS", t, n.lineno, caller=f.name)
            direct = n.func.id if isinstance(n.func, ast.Name) else name
            if direct in imports and direct not in known:
                out.ref(own, "CALLS", direct, n.lineno, caller=f.name, confidence="POSSIBLE")

    kinds = (ast.FunctionDef, ast.AsyncFunctionDef)
    for c in tree.body:
        if isinstance(c, ast.ClassDef):
            own, known = out.full(c.name), {}
            out.add("type", own, c.name, "CLASS", c.lineno, line_end=c.end_lineno, visibility=shown(c.name), annotations=[ast.unparse(d) for d in c.decorator_list])
            for b in c.bases:
                name = ast.unparse(b)
                out.ref(own, "EXTENDS", name, c.lineno, imports.get(name) or (name if "." in name else out.full(name)))
            typed = [(f, function(own, f, known)) for f in c.body if isinstance(f, kinds)]
            known |= {a.target.id: ast.unparse(a.annotation) for a in c.body if isinstance(a, ast.AnnAssign) and isinstance(a.target, ast.Name)}
            for f, declared in known.items():
                out.add("field", own, f, "FIELD", c.lineno, declared=declared, visibility=shown(f), annotations=[])
            for f, own_types in typed:
                calls(own, f, known | own_types)
    top = [f for f in tree.body if isinstance(f, kinds)]
    if top:
        own = out.full(re.sub(r"\.\w+$", "", file["path"].rsplit("/", 1)[-1]))
        out.add("type", own, own.rsplit(".", 1)[-1], "CLASS", 1, line_end=text.count("\n") + 1, visibility="PUBLIC", annotations=[], synthetic=True)
        for f in top:
            calls(own, f, function(own, f, None))
    _import_edges(out)
    return out.rows


PARSERS = {"java": java, "kt": kotlin, "kts": kotlin, "ts": typescript, "tsx": typescript, "js": typescript, "jsx": typescript, "py": python, "go": go}


def register(extension: str, parse) -> None:
    """parse(file, text) gives rows with columns of FACTS; a later parser for an extension replaces the earlier one."""
    PARSERS[extension] = parse


def extract(files: DataFrame) -> DataFrame:
    """Facts of (module, path, root, is_test, content) rows; content is bytes. Files are dealt over all cores by path, however few splits they come in."""
    import pyarrow as pa

    parsers, kinds = dict(PARSERS), {"string": pa.string(), "boolean": pa.bool_(), "int": pa.int32(), "array<string>": pa.list_(pa.string())}
    shape = pa.schema([(c, kinds[kind]) for c, kind in (x.split() for x in FACTS.split(", "))])

    def run(batches):
        for b in batches:
            rows = []
            for file in b.to_pylist():
                parse = parsers.get(file["path"].rsplit(".", 1)[-1].lower())
                if parse is None or not file["content"]:
                    continue
                try:
                    found = parse(file, bytes(file["content"]).decode("utf-8", "replace"))
                except (SyntaxError, ValueError, RecursionError) as problem:
                    found = [{"what": "unresolved", "module": file["module"], "path": file["path"], "is_test": bool(file["is_test"]), "name": file["path"], "kind": "FILE", "declared": str(problem), "line": 0}]
                rows += [{c: r.get(c) for c in COLUMNS} for r in found]
            yield pa.RecordBatch.from_pylist(rows, schema=shape)

    session = files.sparkSession
    parts = max(4 * session.sparkContext.defaultParallelism, int(session.conf.get("spark.sql.shuffle.partitions")))
    return files.select("module", "path", "root", "is_test", "content").repartition(parts, "module", "path").mapInArrow(run, FACTS)
