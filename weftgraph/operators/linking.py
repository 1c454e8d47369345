"""Symbols and edges from the facts of sources.parsers: everything that needs more than one file, as joins.

A name without a full name is looked for in its own package, then (Java) by simple name, the first by full name. Names that
are not found are dropped, but for base types and imports, which unresolved() lists. Facts that parsers repeat give one edge.

Facts are linked against an index, exports(): what all files show to others - types, members with their results, base types. So the
facts of some modules can be linked against the exports of all; the edges of a module depend on nothing else. linked() also says
which names each module looked at: only a change of these can change its edges (affected_names).

A Java call goes to the type that declares the member: the chain of calls before it is followed through result types, a link a
round, and each member is looked for up the hierarchy, the nearest type first, those with the call's number of arguments before others. A call is
confirmed if exactly one type has such a member at the least distance; else it is possible, and so is a call of a member that is nowhere, which counts on the
receiver's own type. A chain whose result type is not of the project ends without an edge.

Each function reads its facts several times: write them to a table first, or every read parses the files again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.functions.ids import owner, simple_name
from weftgraph.plans.scratch import stored

EDGE = ["source_fqn", "target_fqn", "kind", "confidence", "file_path", "module", "line", "caller_member"]
# Annotations of replaced fields, and type names that no test is of.
MOCKS = ["Mock", "MockBean", "SpyBean"]
NOT_TESTED = ["String", "Integer", "Long", "Boolean", "void", "List", "Map", "Set"]
#: What is known without a classpath.
PLATFORM = ("java.", "javax.")


def symbols_of(facts: DataFrame) -> DataFrame:
    """Types, methods (Type#name(parameters)) and fields (Type#name) as rows of the symbols table, without ids."""
    own = F.col("owner")
    name = F.when(F.col("what") == "type", own).when(F.col("what") == "method", F.concat(own, F.lit("#"), F.col("member"))).otherwise(F.concat(own, F.lit("#"), F.col("name")))
    signature = F.when(F.col("what") == "method", F.left(F.sha2("member", 256), F.lit(16)))
    return facts.where("what in ('type', 'method', 'field')").select(
        "module", "kind", "name", name.alias("qualified_name"), F.when(F.col("what") != "type", own).alias("parent_fqn"), F.col("path").alias("file_path"), F.col("line").alias("line_start"),
        F.coalesce("line_end", "line").alias("line_end"), "visibility", F.coalesce("annotations", F.array().cast("array<string>")).alias("annotations"), signature.alias("signature_hash"), F.coalesce("synthetic", F.lit(False)).alias("synthetic"))


EXPORT = ["module", "path", "what", "language", "package", "owner", "name", "kind", "is_test", "annotations", "declared", "target", "arity"]
#: The arity of a field, and of a chain's link that reads one.
FIELD = -1


def exports(facts: DataFrame) -> DataFrame:
    """What a module shows to others: its types, Java members and base types, without their places."""
    shown = facts.where("what = 'type' or what in ('method', 'field') and language = 'java' or what = 'ref' and kind in ('EXTENDS', 'IMPLEMENTS')")
    member = F.col("what").isin("method", "field")
    arity = F.when(F.col("what") == "field", FIELD).otherwise(F.col("arity"))
    values = {"declared": F.when(member, _bare(F.col("declared"))), "annotations": F.when(F.col("what") == "type", F.col("annotations")), "arity": arity}
    return shown.select(*[values.get(c, F.col(c)).alias(c) for c in EXPORT]).distinct()


def _types(index: DataFrame) -> DataFrame:
    """One row a type's full name; of repeated ones the first by module and path."""
    rows = index.where("what = 'type'").groupBy(F.col("owner").alias("fqn")).agg(F.min(F.struct("module", "path", "name", "kind", "is_test", "annotations")).alias("t"))
    return rows.select("fqn", F.col("t.name").alias("simple"), F.col("t.kind").alias("type_kind"), F.col("t.is_test").alias("test_type"), F.col("t.annotations").alias("notes"))


def _located(rows: DataFrame, types: DataFrame, name: str = "name") -> DataFrame:
    """rows with full, the full name that the column name, with target, package and language, stands for; null if it is not found."""
    near = rows.withColumn("near", F.when(F.col("target").isNull(), F.concat_ws(".", F.expr("nullif(package, '')"), name)))
    first = types.groupBy(F.col("simple").alias(name)).agg(F.min("fqn").alias("first"))
    same = types.select(F.col("fqn").alias("near"), F.col("fqn").alias("same"))
    found = near.join(same, "near", "left").join(first, name, "left")
    full = F.coalesce("target", "same", F.when(F.col("language") == "java", F.col("first")), F.when(F.col(name).contains("."), F.col(name)))
    return found.withColumn("full", full).drop("near", "same", "first")


def _with_kinds(rows: DataFrame, types: DataFrame) -> DataFrame:
    """rows with type_kind and test_type of the type that full is, or is a member of."""
    known = types.select(F.col("fqn").alias("own_of"), "type_kind", "test_type")
    return rows.join(known, owner(F.col("full")) == F.col("own_of"), "left").drop("own_of")


def resolved(facts: DataFrame, index: DataFrame | None = None) -> DataFrame:
    """References with their target's full name (null if not found) and, where it is one of the index's types, its kind."""
    types = _types(exports(facts) if index is None else index)
    return _with_kinds(_located(facts.where("what = 'ref'"), types), types)


def ancestors(index: DataFrame, types: DataFrame) -> DataFrame:
    """(type, ancestor, depth) of Java types: itself at depth 0, and up the base types that are of the project."""
    bases = _located(index.where("what = 'ref' and language = 'java'"), types).select(F.col("owner").alias("type"), F.col("full").alias("base"))
    bases = stored(bases.join(types.select(F.col("fqn").alias("base")), "base", "left_semi").where("type <> base").distinct(), "bases")
    out = level = bases.select("type", F.lit(0).alias("depth")).distinct().select("type", F.col("type").alias("ancestor"), "depth")
    depth = 0
    while True:
        depth += 1
        up = level.select("type", F.col("ancestor").alias("at")).join(bases.withColumnRenamed("type", "at"), "at").select("type", F.col("base").alias("ancestor")).distinct()
        level = stored(up.join(out, ["type", "ancestor"], "left_anti").withColumn("depth", F.lit(depth)), "ancestors")
        if level.isEmpty():
            return out
        out = out.unionByName(level)


def _members(index: DataFrame, types: DataFrame) -> DataFrame:
    """(decl, name, has, returns) of Java members: has is the number of arguments, null for any; returns a type of the project or null."""
    rows = index.where("what in ('method', 'field')").select("owner", F.col("name").alias("member"), "arity", "declared", "target", "package", "language")
    got = _located(rows, types, "declared").join(types.select(F.col("fqn").alias("full"), F.lit(True).alias("known")), "full", "left")
    return got.select(F.col("owner").alias("decl"), F.col("member").alias("name"), F.col("arity").alias("has"), F.when(F.col("known"), F.col("full")).alias("returns")).distinct()


def _found(wanted: DataFrame, up: DataFrame, members: DataFrame) -> DataFrame:
    """wanted: at, name, arity. For those that are somewhere up the hierarchy: decl, returns, sure."""
    wanted = wanted.distinct()
    line = wanted.join(up.select(F.col("type").alias("at"), "ancestor", "depth"), "at", "left").withColumn("decl", F.coalesce("ancestor", "at"))
    met = line.join(members, ["decl", "name"]).where(((F.col("arity") == FIELD) == (F.coalesce("has", F.lit(0)) == FIELD)))
    level = F.struct((F.coalesce("has", "arity") != F.col("arity")).alias("other"), F.coalesce("depth", F.lit(0)).alias("depth"))
    per = met.groupBy("at", "name", "arity", level.alias("level")).agg(F.min(F.struct("decl", "returns")).alias("m"), F.countDistinct("decl").alias("decls"), F.countDistinct("returns").alias("results"))
    best = per.groupBy("at", "name", "arity").agg(F.min(F.struct("level", "m", "decls", "results")).alias("b"))
    sure = ~F.col("b.level.other") & (F.col("b.decls") == 1)
    return best.select("at", "name", "arity", F.col("b.m.decl").alias("decl"), F.col("b.m.returns").alias("returns"), sure.alias("sure"), (F.col("b.results") <= 1).alias("one"))


def _declaring(calls: DataFrame, index: DataFrame, types: DataFrame, up: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Java calls with full at the type that declares what is called, and (module, at) of the types that they went through."""
    members = stored(_members(index, types), "members")
    state = stored(calls.withColumn("at", owner(F.col("full"))).withColumn("follows", F.lit(True)), "calls")
    longest = state.agg(F.coalesce(F.max(F.size("chain")), F.lit(0))).first()[0]
    went = state.select("module", "at").distinct()
    for i in range(longest):
        link = F.col("chain")[i]
        name, arity = F.substring_index(link, "/", 1), F.when(link.contains("/"), F.substring_index(link, "/", -1).cast("int")).otherwise(FIELD)
        here = state.where(F.size("chain") > i).withColumn("link", F.struct("at", name.alias("name"), arity.alias("arity")))
        found = _found(here.select("link.*"), up, members).where("returns is not null")
        found = found.select(F.struct("at", "name", "arity").alias("link"), F.col("returns").alias("next"), (F.col("sure") & F.col("one")).alias("right"))
        moved = here.join(found, "link").withColumn("at", F.col("next")).withColumn("follows", F.col("follows") & F.col("right")).drop("link", "next", "right")
        state = stored(state.where(F.size("chain") <= i).unionByName(moved.select(*state.columns)), "calls")
        went = went.unionByName(state.where(F.size("chain") > i).select("module", "at"))
    last = state.withColumn("last", F.struct("at", F.col("member").alias("name"), "arity"))
    found = _found(last.select("last.*"), up, members).select(F.struct("at", "name", "arity").alias("last"), "decl", "sure")
    known = types.select(F.col("fqn").alias("at"), F.lit(True).alias("known"))
    met = last.join(found, "last", "left").join(known, "at", "left").where("decl is not null or not strict")
    good = F.col("follows") & F.coalesce("sure", F.col("known").isNull())
    done = met.withColumn("full", F.coalesce("decl", "at")).withColumn("confidence", F.when(good, F.col("confidence")).otherwise("POSSIBLE"))
    passed = went.distinct().join(up.select(F.col("type").alias("at"), "ancestor"), "at", "left").select("module", F.explode(F.array_compact(F.array("at", "ancestor"))).alias("at")).distinct()
    return done.select(*[c for c in calls.columns if c not in ("type_kind", "test_type")]), passed


def _edge(rows: DataFrame, target, kind, confidence="confidence") -> DataFrame:
    """Rows with owner, path, module, line and caller as edges."""
    lit = [c if isinstance(c, Column) else F.col(c) for c in (target, kind, confidence)]
    values = [F.col("owner"), *lit, F.col("path"), F.col("module"), F.col("line"), F.coalesce("caller", F.lit(""))]
    return rows.select(*[v.alias(n) for v, n in zip(values, EDGE)])


def linked(facts: DataFrame, index: DataFrame | None = None) -> dict[str, DataFrame]:
    """edges; unresolved names; names: (module, name) that the facts' modules looked at. index: the exports of all modules, by default of these."""
    index = exports(facts) if index is None else index
    types = stored(_types(index), "types")
    refs = stored(resolved(facts, index), "refs")
    chained = F.col("chain").isNotNull()
    up = stored(ancestors(index, types), "hierarchy")
    calls, passed = _declaring(refs.where(chained & F.col("full").isNotNull()), index, types, up)
    hit = refs.where(~chained & F.col("full").isNotNull()).unionByName(_with_kinds(calls, types).select(*refs.columns))
    mocked = stored(_mocked(facts, types, up), "mocked")
    dull = F.col("is_test") & (F.col("kind") == "CALLS") & (F.col("language") == "java") & (F.coalesce("member", F.lit("")) != "<init>")
    met = hit.withColumn("simple", F.when(dull, simple_name(owner(F.col("full"))))).join(mocked, ["module", "owner", "simple"], "left_anti")
    hit = stored(met.select(*refs.columns), "hits")
    target = F.when((F.col("language") == "java") & (F.col("kind") == "CALLS"), F.concat_ws("#", "full", "member")).otherwise(F.col("full"))
    parts = [_edge(hit, target, "kind"), _dispatch(hit, index, types), _field_uses(facts, types), _mapper_uses(facts, types), _tests(facts, hit, types, mocked)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    out = out.groupBy("source_fqn", "target_fqn", "kind", "caller_member", "line", "module").agg(F.min("confidence").alias("confidence"), F.min("file_path").alias("file_path")).select(*EDGE)
    return {"edges": out, "unresolved": _lost(refs, facts), "names": _names(facts, refs, passed)}


def link(facts: DataFrame, index: DataFrame | None = None) -> DataFrame:
    """All edges."""
    return linked(facts, index)["edges"]


def _words() -> Column:
    """The words of a method's result and parameters."""
    return F.regexp_extract_all(F.concat_ws(" ", "declared", F.regexp_extract("member", r"\((.*)\)$", 1)), F.lit(r"(\w+)"), 1)


def _names(facts: DataFrame, refs: DataFrame, passed: DataFrame) -> DataFrame:
    """Distinct (module, name): simple names whose meaning the edges of a module rest on."""
    last = lambda c: simple_name(owner(F.col(c)))
    java = facts.where("language = 'java'")
    parts = [refs.select("module", F.explode(F.array_compact(F.array("name", last("name"), last("target"), last("full")))).alias("name")),
             java.where("what = 'field'").select("module", _bare(F.col("declared")).alias("name")),
             java.where("what = 'method'").select("module", F.explode(_words()).alias("name")), passed.select("module", last("at").alias("name"))]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.where("name is not null").distinct()


def affected_names(before: DataFrame, after: DataFrame, index: DataFrame) -> DataFrame:
    """(name) whose meaning changes for others as the exports of some modules turn from before to after; index: those of all modules now.

    These are the simple names of types whose own rows differ, of types that have members or base types of such a name, and of the
    base types of the first, whose implementations differ."""
    row = F.xxhash64(F.to_json(F.struct(*EXPORT), {"ignoreNullFields": "false"}))
    sides = before.withColumn("side", F.lit(1)).unionByName(after.withColumn("side", F.lit(-1)))
    # of equal rows before and after only the hash is compared
    differ = sides.withColumn("row", row).groupBy("row").agg(F.sum("side").alias("n"), F.min(F.struct("what", "owner", "name", "kind", "target")).alias("r")).where("n <> 0").select("r.*")
    last = lambda c: simple_name(F.col(c))
    touched = stored(sides.join(differ.select("owner").distinct(), "owner", "left_semi"), "touched-exports")
    own = touched.select(F.explode(F.array_compact(F.array(last("owner"), F.when(F.col("what") == "type", F.col("name"))))).alias("name")).distinct()
    bases = touched.where("what = 'ref'").select(F.explode(F.array_compact(F.array(last("name"), last("target")))).alias("name"))
    meant = F.when(F.col("what") == "ref", last("name")).otherwise(F.col("declared"))
    leads = index.unionByName(before).where("what <> 'type'").withColumn("meant", meant).join(own.withColumnRenamed("name", "meant"), "meant", "left_semi")
    return own.unionByName(bases).unionByName(leads.select(last("owner").alias("name"))).distinct()


def _dispatch(hit: DataFrame, index: DataFrame, types: DataFrame) -> DataFrame:
    """Calls on an interface also go to the implementation that the field's qualifier names, else to the only one there is."""
    calls = hit.where("kind = 'CALLS' and type_kind = 'INTERFACE' and language = 'java' and member is not null").withColumnRenamed("declared", "qualifier")
    impls = _located(index.where("kind = 'IMPLEMENTS' and language = 'java' and what = 'ref'"), types).where("full is not null").select(F.col("full").alias("of"), F.col("owner").alias("impl")).distinct()
    noted = impls.join(types.select(F.col("fqn").alias("impl"), "notes"), "impl")
    named = F.concat(F.lower(F.substring(simple_name(F.col("impl")), 1, 1)), F.expr("substring(substring_index(impl, '.', -1), 2)"))
    fits = (named == F.col("qualifier")) | F.exists("notes", lambda a: a.contains(F.concat(F.lit('("'), F.col("qualifier"), F.lit('")'))))
    chosen = calls.where("qualifier is not null").join(noted, F.col("full") == F.col("of")).where(fits)
    only = impls.groupBy("of").agg(F.count("*").alias("n"), F.min("impl").alias("impl")).where("n = 1")
    rest = calls.join(only, F.col("full") == F.col("of")).join(chosen.select("owner", "full", "qualifier").distinct(), ["owner", "full", "qualifier"], "left_anti")
    goal = F.concat_ws("#", "impl", "member")
    return _edge(chosen, goal, "kind", F.lit("CONFIRMED")).unionByName(_edge(rest, goal, "kind", F.lit("POSSIBLE")))


def _unique(types: DataFrame) -> DataFrame:
    return types.groupBy("simple").agg(F.count("*").alias("n"), F.min("fqn").alias("fqn"), F.min("test_type").alias("test_type")).where("n = 1").drop("n")


def _bare(declared) -> Column:
    """A declared type's name without arguments, arrays and packages."""
    return simple_name(F.regexp_replace(declared, r"[<\[].*$", ""))


def _field_uses(facts: DataFrame, types: DataFrame) -> DataFrame:
    """Java fields whose type's simple name is that of exactly one type, not their own."""
    fields = facts.where("what = 'field' and language = 'java' and not coalesce(synthetic, false)").withColumn("simple", _bare(F.col("declared")))
    return _edge(fields.drop("caller").withColumn("caller", F.lit("")).join(_unique(types), "simple").where("fqn <> owner"), "fqn", F.lit("USES"), F.lit("POSSIBLE"))


def _mapper_uses(facts: DataFrame, types: DataFrame) -> DataFrame:
    """Parameter and result types of the methods of Java types annotated Mapper."""
    mappers = types.where(F.array_contains("notes", "Mapper")).select(F.col("fqn").alias("owner"))
    methods = facts.where("what = 'method' and language = 'java'").join(mappers, "owner", "left_semi")
    first = types.groupBy("simple").agg(F.min("fqn").alias("fqn"))
    named = methods.withColumn("simple", F.explode(F.array_distinct(_words())))
    return _edge(named.withColumn("caller", F.col("name")).join(first, "simple").where("fqn <> owner"), "fqn", F.lit("USES"), F.lit("CONFIRMED"))


def _mocked(facts: DataFrame, types: DataFrame, up: DataFrame) -> DataFrame:
    """(module, owner, simple): the simple names of types that Java test types replace, by a field's annotation, and of these types' own subtypes."""
    fields = facts.where("what = 'field' and is_test and language = 'java'").where(F.arrays_overlap("annotations", F.array(*[F.lit(m) for m in MOCKS])))
    named = fields.select("module", "owner", _bare(F.col("declared")).alias("simple")).distinct()
    under = up.where("depth = 1").select(F.col("ancestor").alias("fqn"), simple_name(F.col("type")).alias("sub"))
    subs = named.join(types.groupBy("simple").agg(F.min("fqn").alias("fqn")), "simple").join(under, "fqn").select("module", "owner", F.col("sub").alias("simple"))
    return named.unionByName(subs).distinct()


def _tests(facts: DataFrame, hit: DataFrame, types: DataFrame, mocked: DataFrame) -> DataFrame:
    """Java test types to the production types that they import or call (confirmed), else to those they name (possible); not to replaced ones."""
    fields = facts.where("what = 'field' and is_test and language = 'java'").withColumn("simple", _bare(F.col("declared")))
    made = hit.where("is_test and language = 'java' and kind in ('IMPORTS', 'CALLS') and type_kind is not null and not test_type").withColumn("simple", simple_name(owner(F.col("full"))))
    sure = made.join(mocked, ["module", "owner", "simple"], "left_anti").withColumn("line", F.lit(0)).withColumn("caller", F.lit(""))
    sure = sure.withColumn("goal", owner(F.col("full")))
    sure = sure.groupBy("module", "owner", "goal").agg(F.min("path").alias("path"), F.min("line").alias("line"), F.min("caller").alias("caller"), F.min("confidence").alias("confidence"))
    methods = facts.where("what = 'method' and is_test and language = 'java' and not coalesce(synthetic, false)").withColumn("simple", F.explode(_words()))
    said = fields.select("owner", "path", "module", "simple").unionByName(methods.select("owner", "path", "module", "simple")).distinct().where(~F.col("simple").isin(NOT_TESTED))
    maybe = said.join(mocked, ["module", "owner", "simple"], "left_anti").join(_unique(types).where("not test_type"), "simple").join(sure.select("module", "owner").distinct(), ["module", "owner"], "left_anti")
    return _edge(sure, "goal", F.lit("TESTS"), F.lit("CONFIRMED")).unionByName(_edge(maybe.withColumn("line", F.lit(0)).withColumn("caller", F.lit("")), "fqn", F.lit("TESTS"), F.lit("POSSIBLE")))


def unresolved(facts: DataFrame, platform: tuple[str, ...] = PLATFORM, index: DataFrame | None = None) -> DataFrame:
    """module, symbol, file_path, line and reason: files that could not be parsed, and Java base types and imports that are in no file and not of the platform."""
    return _lost(resolved(facts, index), facts, platform)


def _lost(refs: DataFrame, facts: DataFrame, platform: tuple[str, ...] = PLATFORM) -> DataFrame:
    refs = refs.where("language = 'java' and kind in ('EXTENDS', 'IMPLEMENTS', 'IMPORTS') and type_kind is null")
    for p in platform:
        refs = refs.where(~F.coalesce(F.col("full"), F.lit("")).startswith(p))
    lost = refs.select("module", F.coalesce("full", "name").alias("symbol"), F.col("path").alias("file_path"), "line", F.lit("not found").alias("reason"))
    broken = facts.where("what = 'unresolved'").select("module", F.col("name").alias("symbol"), F.col("path").alias("file_path"), "line", F.col("declared").alias("reason"))
    return lost.unionByName(broken).groupBy("module", "symbol", "file_path", "line").agg(F.min("reason").alias("reason")).select("module", "symbol", "file_path", "line", "reason")
