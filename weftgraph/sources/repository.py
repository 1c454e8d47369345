"""A source repository as DataFrames: files, ignore rules, modules with their source roots, file hashes.

File contents are read by Spark's binaryFile source, whose listing leaves hidden files out; ignore files, which are hidden,
are listed and read through the Hadoop file system of the path. Rules and build files are configuration of one
repository and handled on the driver; paths are matched by native expressions.
"""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET
from posixpath import normpath

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Source roots with their test flag, extensions counted, names always ignored, build files by precedence.
SOURCE_ROOTS = [("src/main/java", False), ("src/main/kotlin", False), ("src/test/java", True), ("src/test/kotlin", True)]
EXTENSIONS = ["java", "kt"]
ALWAYS_IGNORED = [".git", "node_modules"]
BUILD_FILES = [("pom.xml", "MAVEN"), ("build.gradle.kts", "GRADLE_KOTLIN"), ("build.gradle", "GRADLE_GROOVY")]

MODULES = "name string, path string, build_system string, build_file string"


def read_files(spark: SparkSession, root: str) -> DataFrame:
    """path (relative to root), length, modified and content of every file that is not hidden; content is read only if used."""
    base = spark._jvm.org.apache.hadoop.fs.Path(root)
    fs = base.getFileSystem(spark._jsc.hadoopConfiguration())
    full = fs.makeQualified(base).toUri().getPath().rstrip("/")
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    plain = F.regexp_replace("path", "^[a-zA-Z0-9]+:(//[^/]*)?", "")
    filled = rows.select(F.substring(plain, F.lit(len(full) + 2), F.length("path")).alias("path"), "length", F.col("modificationTime").alias("modified"), "content")
    # the source leaves files without content out
    empty, listed = [], fs.listFiles(base, True)
    while listed.hasNext():
        status = listed.next()
        path = status.getPath().toUri().getPath()[len(full) + 1:]
        if status.getLen() == 0 and not any(x.startswith((".", "_")) for x in path.split("/")):
            empty.append((path, status.getModificationTime()))
    added = spark.createDataFrame(empty, "path string, ms long").select("path", F.lit(0).cast("long").alias("length"), F.timestamp_millis("ms").alias("modified"), F.lit(b"").alias("content"))
    return filled.where("length > 0").unionByName(added)


def read_ignore_rules(spark: SparkSession, root: str) -> list[tuple[str, list[tuple[str, bool, bool]]]]:
    """(folder, rules) of each .gitignore, parents first. Folders that rules above them ignore are not entered."""
    jvm = spark._jvm
    base = jvm.org.apache.hadoop.fs.Path(root)
    fs, out, todo = base.getFileSystem(spark._jsc.hadoopConfiguration()), [], [""]
    while todo:
        at = todo.pop()
        listed = {s.getPath().getName(): s for s in fs.listStatus(jvm.org.apache.hadoop.fs.Path(f"{root}/{at}" if at else root))}
        own = listed.get(".gitignore")
        if own is not None and own.isFile():
            stream = fs.open(own.getPath())
            text = bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode("utf-8", "replace")
            stream.close()
            rules = parse_ignore(text)
            if rules:
                out.append((at, rules))
        folders = [f"{at}/{n}" if at else n for n, s in listed.items() if s.isDirectory()]
        todo += sorted((p for p in folders if not is_ignored(p, True, out)), reverse=True)
    return out


def parse_ignore(text: str) -> list[tuple[str, bool, bool]]:
    """(regular expression, negated, for folders only) of each rule, in order.

    A pattern with a slash inside is matched from its folder on and covers what lies below; one without, against any segment.
    A slash in front alone does not anchor a pattern."""
    out = []
    for line in map(str.strip, text.splitlines()):
        if not line or line.startswith("#"):
            continue
        negated = line.startswith("!")
        line = line[negated:]
        folders_only = line.endswith("/")
        line = line.removesuffix("/").removeprefix("/")
        if line.strip():
            out.append((_pattern(line), negated, folders_only))
    return out


def _pattern(line: str) -> str:
    def glob(segment):
        return "".join({"*": "[^/]*", "?": "[^/]"}.get(c, re.escape(c)) for c in segment)

    if "/" not in line:
        return f"(^|/){glob(line)}(/|$)"
    parts, out = line.split("/"), "^"
    for i, segment in enumerate(parts):
        last = i == len(parts) - 1
        out += ("" if last else "(?:[^/]+/)*") if segment == "**" else glob(segment) + ("(/|$)" if last else "/")
    return out


def is_ignored(path: str, folder: bool, rules) -> bool:
    """Whether the last rule that matches path ignores it; some names always are."""
    if set(path.split("/")) & set(ALWAYS_IGNORED):
        return True
    out = False
    for base, own in rules:
        if base and not path.startswith(base + "/"):
            continue
        inner = path[len(base) + 1:] if base else path
        for pattern, negated, folders_only in own:
            if not (folders_only and not folder and "/" not in inner) and re.search(pattern, inner):
                out = not negated
    return out


def ignored(path: Column, rules) -> Column:
    """is_ignored() of a file path as a native expression."""
    out = F.lit(False)
    for base, own in rules:
        inner = F.substring(path, F.lit(len(base) + 2), F.length(path)) if base else path
        below = F.startswith(path, F.lit(base + "/")) if base else F.lit(True)
        for pattern, negated, folders_only in own:
            hit = below & inner.rlike(pattern)
            if folders_only:
                hit = hit & F.contains(inner, F.lit("/"))
            out = F.when(hit, F.lit(not negated)).otherwise(out)
    return F.arrays_overlap(F.split(path, "/"), F.array(*map(F.lit, ALWAYS_IGNORED))) | out


def modules(files: DataFrame, rules=(), root_name: str = "root", max_modules: int = 10_000) -> DataFrame:
    """name, path ('' for the root), build_system and build_file of each module.

    Maven: modules that pom.xml names, depth first, each with a pom.xml of its own. Gradle: the root and what include lines of
    the settings file quote, ':' read as '/'. Otherwise the root alone. Ignored and missing folders are left out.
    Broken XML names no modules. Empty table: the root alone, build system UNKNOWN."""
    spark = files.sparkSession
    names = [n for n, _ in BUILD_FILES] + ["settings.gradle", "settings.gradle.kts"]
    built = files.where(F.element_at(F.split("path", "/"), -1).isin(names)).select("path", F.col("content").cast("string").alias("text")).collect()
    texts = {r["path"]: r["text"] for r in built}
    system = next((s for n, s in BUILD_FILES if n in texts), "UNKNOWN")
    asked, out = [], []

    def build_file(at):
        name = next((n for n, s in BUILD_FILES if s == system), None)
        path = f"{at}/{name}" if at else name
        return path if path in texts else None

    def add(at):
        out.append((at.rsplit("/", 1)[-1] or root_name, at, system, build_file(at)))

    if system == "MAVEN":
        asked.append("")
        while asked and len(out) < max_modules:
            at = asked.pop()
            if build_file(at) is None:
                continue
            add(at)
            found = [_below(at, c) for c in _declared(texts[build_file(at)])]
            asked += [c for c in reversed(found) if c and not is_ignored(c, True, rules)]
    else:
        add("")
        settings = next((texts[n] for n in ("settings.gradle", "settings.gradle.kts") if n in texts), "") if system != "UNKNOWN" else ""
        lines = [x.strip() for x in settings.splitlines()]
        found = [_below("", (a or b).replace(":", "/").lstrip("/")) for x in lines if x.startswith("include") for a, b in re.findall("\"([^\"]+)\"|'([^']+)'", x)]
        found = [c for c in found if c and not is_ignored(c, True, rules)]
        if found:
            here = files.where(F.lit(False) | F.exists(F.array(*map(F.lit, found)), lambda c: F.startswith("path", F.concat(c, F.lit("/")))))
            there = {r[0] for r in here.select(F.explode(F.filter(F.array(*map(F.lit, found)), lambda c: F.startswith("path", F.concat(c, F.lit("/")))))).distinct().collect()}
            for c in found:
                if c in there:
                    add(c)
    return spark.createDataFrame(out, MODULES)


def _declared(pom: str) -> list[str]:
    try:
        return [(e.text or "").strip() for e in ET.fromstring(pom).iter() if e.tag.rsplit("}", 1)[-1] == "module"]
    except ET.ParseError:
        return []


def _below(at: str, child: str) -> str | None:
    """The normal path of child below at; None if it leaves the repository or is the root."""
    path = normpath(f"{at}/{child}" if at else child)
    return None if path.startswith(("..", "/")) or path == "." else path


def source_files(files: DataFrame, module_rows: DataFrame, rules=()) -> DataFrame:
    """module, source_root, is_test and path of each source file under a module's source roots that is not ignored."""
    roots = module_rows.sparkSession.createDataFrame(SOURCE_ROOTS, "rel string, is_test boolean")
    own = module_rows.crossJoin(F.broadcast(roots)).select(F.col("name").alias("module"), F.concat(F.when(F.col("path") == "", "").otherwise(F.concat("path", F.lit("/"))), "rel").alias("source_root"), "is_test")
    ext = F.regexp_extract("path", "\\.([^./]*)$", 1)
    kept = files.where(ext.isin(EXTENSIONS) & ~ignored(F.col("path"), rules)).select("path")
    # the part before the fixed root makes this an equi-join
    cut = F.regexp_extract("path", f"^((?:.*?/)?(?:{'|'.join(r for r, _ in SOURCE_ROOTS)}))/", 1)
    return kept.withColumn("source_root", cut).where("source_root <> ''").join(own, "source_root").select("module", "source_root", "is_test", "path")


def file_hashes(files: DataFrame, module_rows: DataFrame) -> DataFrame:
    """module, path and SHA-256 of each source file under a module's source roots, ignored ones too."""
    under = source_files(files, module_rows).select("module", "path")
    return files.select("path", "content").join(under, "path").select("module", "path", F.sha2("content", 256).alias("hash"))


def tree_hash(files: DataFrame) -> DataFrame:
    """One row: SHA-256 over the sorted paths, times (ms) and lengths; contents are not read."""
    line = F.concat_ws(":", "path", F.unix_millis("modified"), "length")
    # one short line a file of one repository
    return files.agg(F.sha2(F.array_join(F.array_sort(F.collect_list(line)), "\n"), 256).alias("tree_hash"))
