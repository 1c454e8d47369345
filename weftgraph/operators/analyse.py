"""Impact, rules, smells, evaluation, federation, deprecation and document operators over edges and symbols."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.functions import ids
from weftgraph.functions.ids import owner, package, test_like
from weftgraph.operators import counts, traverse
from weftgraph.plans.scratch import stored
from weftgraph.sources.derived import spread

# Annotation names with a meaning, weights and thresholds.
DB_ANNOTATIONS = ("Entity", "Table", "Repository", "Document", "Mapper", "Transactional", "JdbcRepository", "CrudRepository", "JpaRepository")
ENTRY_ANNOTATIONS = ("RestController", "Controller", "SpringBootApplication", "Configuration")
FLOW_ANNOTATIONS = ("RestController", "Controller", "SpringBootApplication", "MessagingGateway", "KafkaListener")
WEIGHTS = {"public-api": 30, "many-callers": 20, "database-interaction": 20, "high-fan-out": 15, "few-tests": 10, "architecture-violation": 10}
MANY_CALLERS, HIGH_FAN_OUT = 3, 5


def overlap(annotations, names):
    return F.coalesce(F.arrays_overlap(annotations, F.array(*[F.lit(n) for n in names])), F.lit(False))


def _dependents(edges: DataFrame) -> tuple:
    """(hops to dependents, their components, tests that hang on types)."""
    tests = traverse.tests_of(edges)
    depending = counts.split(traverse.hops(edges, traverse.DEPENDS, True), tests)
    return depending, counts.components(depending.inner), tests


def impact(edges: DataFrame, symbols: DataFrame, roots: DataFrame, violating: DataFrame | None = None, dependents: tuple | None = None) -> DataFrame:
    """One row per root (column root): the six signals, score, level, and the radius counts. violating: owners (column fqn) that break a rule; dependents: those
    of the edges, where they are made already."""
    roots = stored(roots.select(owner(F.col("root")).alias("root")).distinct(), "impact-roots")
    calls = edges.where("kind = 'CALLS'")
    label = ids.caller_label(F.col("source_fqn"), F.col("caller_member"))
    into = calls.select(owner(F.col("target_fqn")).alias("root"), label.alias("caller"), "confidence", F.col("target_fqn").startswith("java.lang.reflect").alias("reflects")).join(roots, "root", "left_semi")
    possible = (F.col("confidence") == "POSSIBLE") | F.col("reflects")
    callers = into.groupBy("root").agg(F.countDistinct("caller").alias("direct_callers"), F.countDistinct(F.when(~possible, F.col("caller"))).alias("certain_callers"),
                                       F.countDistinct(F.when(possible, F.col("caller"))).alias("possible_callers"), F.countDistinct(F.when(F.instr("caller", "#") > 0, F.col("caller"))).alias("affected_methods"), F.bool_or("reflects").alias("called_by_reflection"))
    out = calls.select(owner(F.col("source_fqn")).alias("root"), F.col("target_fqn").contains("reflect").alias("r")).join(roots, "root", "left_semi").groupBy("root").agg(F.count("*").alias("fan_out"), F.bool_or("r").alias("reflects"))
    types = symbols.where("kind not in ('METHOD', 'FIELD')")
    modules = types.groupBy(F.col("qualified_name").alias("node")).agg(F.max("module").alias("leaf")).where("leaf is not null").withColumn("kind", F.lit("module"))
    calling = counts.split(traverse.hops(edges, traverse.CALLS, True), modules)
    depending, wide, tests = dependents or _dependents(edges)
    up = counts.by_kind(counts.reach_counts(calling, roots, modules, of=counts.components(calling.inner, wide)), transitive_callers="node", affected_modules="module")
    far = counts.by_kind(counts.reach_counts(depending, roots, tests, of=wide), dependents="node", affected_tests="test")
    meta = symbols.groupBy(F.col("qualified_name").alias("root")).agg(F.min(F.struct("visibility", "kind", "annotations")).alias("m"))
    got = roots.join(meta, "root", "left")
    for part in (callers, out, up, far):
        got = got.join(part, "root", "left")
    got = got.withColumn("violates", F.lit(False)) if violating is None else got.join(violating.select(F.col("fqn").alias("root"), F.lit(True).alias("violates")).distinct(), "root", "left")
    named = ("direct_callers", "certain_callers", "possible_callers", "affected_methods", "fan_out", "transitive_callers", "dependents", "affected_tests", "affected_classes", "affected_modules")
    # callers are reached too, so the classes are the root and what it reaches
    got = got.fillna(0, ["transitive_callers"]).fillna(1, ["affected_modules"]).withColumn("affected_classes", F.col("transitive_callers") + 1)
    got = got.fillna(0, list(named)).fillna(False, ["violates", "reflects", "called_by_reflection"])
    applied = {
        "public-api": F.coalesce((F.col("m.visibility") == "PUBLIC") | (F.col("m.kind") == "INTERFACE"), F.lit(False)),
        "many-callers": F.col("direct_callers") >= MANY_CALLERS, "database-interaction": overlap(F.col("m.annotations"), DB_ANNOTATIONS),
        "high-fan-out": F.col("fan_out") >= HIGH_FAN_OUT, "few-tests": F.col("affected_tests") == 0, "architecture-violation": F.col("violates"),
    }
    score = F.least(F.lit(100), sum((F.when(c, WEIGHTS[n]).otherwise(0) for n, c in applied.items()), F.lit(0)))
    signals = F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in applied.items()]))
    return got.select(F.col("root").alias("symbol"), *[F.col(c).cast("long").alias(c) for c in named], (F.col("reflects") | F.col("called_by_reflection")).alias("has_dynamic_dispatch"),
                      F.array_join(signals, ",").alias("signals"), score.cast("int").alias("score")).withColumn("level", ids.impact_level(F.col("score")))


def impact_diff(edges: DataFrame, symbols: DataFrame, roots: DataFrame) -> DataFrame:
    """One row over all changed roots: highest score and level, distinct callers and tests, classes and modules they touch."""
    dependents = depending, wide, tests = _dependents(edges)
    per = impact(edges, symbols, roots, dependents=dependents)
    roots = roots.select(owner(F.col("root")).alias("root")).distinct()
    callers = edges.where("kind = 'CALLS'").select(owner(F.col("target_fqn")).alias("root"), ids.caller_label(F.col("source_fqn"), F.col("caller_member")).alias("c")).join(roots, "root", "left_semi").select("c").distinct()
    classes = callers.select(owner(F.col("c")).alias("n")).union(roots).distinct()
    module_of = symbols.where("kind not in ('METHOD', 'FIELD')").groupBy(F.col("qualified_name").alias("n")).agg(F.max("module").alias("module"))
    top = per.agg(F.coalesce(F.max("score"), F.lit(0)).alias("max_score"))
    tests = counts.reached_leaves(depending, roots, tests, wide).agg(F.countDistinct("leaf").alias("tests"))
    called = callers.agg(F.count("*").alias("callers"), F.count_if(F.instr("c", "#") > 0).alias("methods"))
    touched = classes.join(module_of, "n", "left").agg(F.count("*").alias("classes"), F.greatest(F.countDistinct("module"), F.least(F.lit(1), F.count("*"))).alias("modules"))
    # four tables of one row
    return top.join(tests).join(called).join(touched).withColumn("highest_level", ids.impact_level(F.col("max_score")))


def deprecation_radar(edges: DataFrame, symbols: DataFrame) -> DataFrame:
    """Deprecated symbols with their callers, 3-hop radius, tests and migration effort. symbols may have a javadoc column."""
    doc = F.col("javadoc") if "javadoc" in symbols.columns else F.lit(None).cast("string")
    noted = F.exists("annotations", lambda a: F.trim(a).contains("Deprecated") | F.lower(F.trim(a)).rlike("^@?deprecated$|^@?java\\.lang\\.deprecated|^@?kotlin\\.deprecated"))
    items = symbols.where(noted | F.coalesce(F.lower(doc).contains("@deprecated"), F.lit(False))).select(F.col("qualified_name").alias("fqn"), "kind", "module", owner(F.col("qualified_name")).alias("root"), ids.replacement_hint(F.col("annotations"), doc).alias("replacement_hint"))
    items = stored(items, "deprecated")
    roots = items.select("root").distinct()
    callers = edges.where("kind = 'CALLS'").select(owner(F.col("target_fqn")).alias("root"), "source_fqn").join(roots, "root", "left_semi").groupBy("root").agg(F.countDistinct("source_fqn").alias("direct_callers"))
    radius = counts.by_kind(counts.reach_counts(traverse.hops(edges, traverse.CALLS, True), roots, max_depth=3), blast_radius="node")
    tests = counts.by_kind(counts.reach_counts(traverse.hops(edges, traverse.DEPENDS, True), roots, traverse.tests_of(edges)), affected_tests="test")
    got = items.join(callers, "root", "left").join(radius, "root", "left").join(tests, "root", "left").fillna(0, ["direct_callers", "blast_radius", "affected_tests"])
    got = got.withColumn("effort", ids.migration_effort(F.col("kind"), F.col("direct_callers"), F.col("blast_radius"), F.col("affected_tests"), F.col("replacement_hint").isNotNull()))
    return got.select("fqn", "kind", "module", "replacement_hint", "direct_callers", "blast_radius", "affected_tests", "effort", ids.effort_category(F.col("effort")).alias("category"))


def rule_violations(edges: DataFrame, symbols: DataFrame, rules: list[dict], check_cycles: bool = False) -> DataFrame:
    """Distinct (rule, source, target) with the first line. A rule: name, source and target stereotypes (annotations, pattern), kinds.

    The rules are a list in a file, so they become one predicate over edges joined with both types."""
    types = symbols.where("kind not in ('METHOD', 'FIELD')").groupBy(F.col("qualified_name").alias("fqn")).agg(F.max(F.struct("module", "line_start", "annotations")).alias("t")).select("fqn", F.col("t.annotations").alias("notes"))
    def named(stereotype, fqn):
        names, pattern = stereotype.get("annotations") or (), stereotype.get("pattern")
        if not names and not pattern:
            return F.lit(False)
        return F.col(fqn).rlike(pattern) | ids.simple_name(F.col(fqn)).rlike(f"^(?:{pattern})$") if pattern else F.lit(True)

    own = edges.select(owner(F.col("source_fqn")).alias("source"), owner(F.col("target_fqn")).alias("target"), "kind", "line").where("source <> target")
    # what no rule's kinds and names allow goes before the joins, and a pair goes through them once
    may = [F.col("kind").isin(*(r.get("kinds") or ("CALLS", "USES"))) & named(r["source"], "source") & named(r["target"], "target") for r in rules]
    own = own.where(F.array_contains(F.array(F.lit(False), *may), True)).groupBy("source", "target", "kind").agg(F.min("line").alias("line"))
    met = own.join(types.select(F.col("fqn").alias("source"), F.col("notes").alias("s_notes")), "source").join(types.select(F.col("fqn").alias("target"), F.col("notes").alias("t_notes")), "target")

    def fits(stereotype, notes, fqn):
        names = stereotype.get("annotations") or ()
        return (overlap(F.col(notes), names) if names else F.lit(True)) & named(stereotype, fqn)

    hits = F.array_compact(F.array(*[F.when(F.col("kind").isin(*(r.get("kinds") or ("CALLS", "USES"))) & fits(r["source"], "s_notes", "source") & fits(r["target"], "t_notes", "target"), F.lit(r["name"])) for r in rules]))
    found = met.select(F.explode(hits).alias("rule"), "source", "target", "kind", "line").groupBy("rule", "source", "target").agg(F.min("line").alias("line"))
    if check_cycles or any("cycle" in r["name"].lower() for r in rules):
        cycles = traverse.package_cycles(edges)
        found = found.unionByName(cycles.select(F.lit("no-package-cycles").alias("rule"), F.col("path")[0].alias("source"), F.col("path")[1].alias("target"), F.lit(0).alias("line")))
    return found


def god_fan_out(edges: DataFrame, threshold: int = 20, top: int = 10) -> DataFrame:
    got = edges.where("kind = 'CALLS'").groupBy(F.col("source_fqn").alias("fqn")).agg(F.count("*").alias("calls")).where((F.col("calls") > threshold) & ~test_like(F.col("fqn")))
    return got.orderBy(F.desc("calls"), "fqn").limit(top)


def god_fan_in(edges: DataFrame, threshold: int = 15, top: int = 10) -> DataFrame:
    got = edges.where("kind = 'CALLS'").select(owner(F.col("target_fqn")).alias("fqn"), owner(F.col("source_fqn")).alias("s")).distinct().groupBy("fqn").agg(F.count("*").alias("callers"))
    return got.where((F.col("callers") > threshold) & ~test_like(F.col("fqn"))).orderBy(F.desc("callers"), "fqn").limit(top)


def dead_code(edges: DataFrame, symbols: DataFrame) -> DataFrame:
    into = edges.where(F.col("kind").isin(*traverse.DEPENDS)).select(owner(F.col("target_fqn")).alias("qualified_name")).distinct()
    open_types = symbols.where((F.col("visibility") == "PUBLIC") & F.col("kind").isin("CLASS", "INTERFACE", "ENUM", "RECORD", "ANNOTATION") & ~test_like(F.col("qualified_name")) & ~overlap(F.col("annotations"), ENTRY_ANNOTATIONS))
    return open_types.join(into, "qualified_name", "left_anti").select(F.col("qualified_name").alias("fqn"))


def untested_public(edges: DataFrame, symbols: DataFrame) -> DataFrame:
    tested = edges.where("kind = 'TESTS'").select(owner(F.col("target_fqn")).alias("fqn")).distinct()
    active = edges.select(owner(F.col("source_fqn")).alias("fqn")).distinct()
    types = symbols.where((F.col("visibility") == "PUBLIC") & ~F.col("qualified_name").endswith("Test")).select(F.col("qualified_name").alias("fqn"))
    return types.join(tested, "fqn", "left_anti").join(active, "fqn", "left_semi")


def hotspots(edges: DataFrame, symbols: DataFrame, first: int = 50, top: int = 10, least_score: int = 21) -> DataFrame:
    ranked = edges.where("kind = 'CALLS'").groupBy(owner(F.col("target_fqn")).alias("root")).agg(F.count("*").alias("incoming")).orderBy(F.desc("incoming"), "root").limit(first)
    ranked = stored(ranked, "hotspots")
    scored = impact(edges, symbols, ranked.select("root")).where(F.col("score") >= least_score).select(F.col("symbol").alias("root"), "score", "level", "transitive_callers", "affected_tests")
    return ranked.join(scored, "root").orderBy(F.desc("score"), F.desc("incoming"), "root").limit(top)


def stereotype_counts(symbols: DataFrame) -> DataFrame:
    return symbols.select(package(F.col("qualified_name")).alias("package"), F.explode("annotations").alias("stereotype")).groupBy("package", "stereotype").agg(F.count("*").alias("n"))


def package_weights(edges: DataFrame, symbols: DataFrame) -> DataFrame:
    local = symbols.select(package(F.col("qualified_name")).alias("p")).distinct()
    pairs = traverse.package_pairs(edges.where("kind <> 'TESTS'"))
    return pairs.join(local.withColumnRenamed("p", "src"), "src", "left_semi").join(local.withColumnRenamed("p", "dst"), "dst", "left_semi")


def one_way_packages(edges: DataFrame, least: int = 3) -> DataFrame:
    pairs = traverse.package_pairs(edges)
    back = pairs.select(F.col("src").alias("dst"), F.col("dst").alias("src"))
    return pairs.where(F.col("weight") >= least).join(back, ["src", "dst"], "left_anti")


def base_package(symbols: DataFrame) -> DataFrame:
    """The longest common package prefix of all types, if it has two segments or more (else null)."""
    parts = symbols.select(F.split(package(F.col("qualified_name")), "\\.").alias("p")).where("p is not null").distinct()
    shape = parts.agg(F.min(F.size("p")).alias("n"))
    each = parts.select(F.posexplode("p").alias("i", "s")).groupBy("i").agg(F.countDistinct("s").alias("kinds"), F.min("s").alias("s"))
    run = each.join(F.broadcast(shape)).where("i < n").agg(F.array_sort(F.collect_list(F.struct("i", "s", "kinds"))).alias("all"))
    same = F.aggregate("all", F.struct(F.lit(True).alias("on"), F.array().cast("array<string>").alias("out")), lambda a, x: F.struct((a["on"] & (x["kinds"] == 1)).alias("on"), F.when(a["on"] & (x["kinds"] == 1), F.array_append(a["out"], x["s"])).otherwise(a["out"]).alias("out")), lambda a: a["out"])
    return run.select(F.when(F.size(same) >= 2, F.array_join(same, ".")).alias("base_package"))


def flows(edges: DataFrame, symbols: DataFrame, max_depth: int = 6, per_entry: int = 3, total: int = 15) -> DataFrame:
    """Call paths from entry points, longest first; capped per entry and in all, as a report."""
    types = symbols.select(F.col("qualified_name").alias("fqn")).distinct()
    entry = symbols.where(overlap(F.col("annotations"), FLOW_ANNOTATIONS)).select(F.col("qualified_name").alias("entry")).distinct()
    hop = edges.where("kind in ('CALLS', 'USES')").select(owner(F.col("source_fqn")).alias("at"), owner(F.col("target_fqn")).alias("next"), "kind", "confidence")
    # only entries and what a hop leads to are ever walked from
    from_here = hop.select(F.col("next").alias("at")).unionByName(entry.select(F.col("entry").alias("at"))).distinct()
    hop = hop.join(from_here, "at", "left_semi")
    hop = hop.groupBy("at", "next").agg(F.bool_or(F.col("kind") == "CALLS").alias("call"), F.bool_and(F.col("confidence") == "POSSIBLE").alias("possible"))
    hop = stored(hop.join(types.select(F.col("fqn").alias("next"), F.lit(1).alias("known")), "next", "left"), "flow-hops")
    calling = hop.where("call").select(F.col("at").alias("entry")).distinct()
    entry = entry.join(calling.withColumn("calls", F.lit(True)), "entry", "left")
    walks = entry.select("entry", F.col("calls").isNotNull().alias("only_calls"), F.array("entry").alias("path"), F.lit(None).cast("int").alias("possible_at"), F.lit(False).alias("ended"))
    done = None
    best = Window.partitionBy("entry").orderBy(F.desc_nulls_last("known"), "path")
    for depth in range(1, max_depth):
        step = walks.join(hop, (F.element_at("path", -1) == F.col("at")) & (~F.col("only_calls") | F.col("call")) & ~F.array_contains("path", F.col("next")), "left")
        step = stored(step.select("entry", "only_calls", "path", "possible_at", "next", "known", "possible"), "flow-steps")
        ended = step.where("next is null and size(path) > 1").select("entry", "path", "possible_at")
        done = ended if done is None else done.unionByName(ended)
        step = step.where("next is not null").select("entry", "only_calls", "known", F.array_append("path", F.col("next")).alias("path"), F.coalesce("possible_at", F.when(F.col("possible"), F.lit(depth))).alias("possible_at"))
        walks = stored(step.withColumn("r", F.row_number().over(best)).where(F.col("r") <= 4 * per_entry).select("entry", "only_calls", "path", "possible_at"), "flows")
    done = done.unionByName(walks.select("entry", "path", "possible_at"))
    longest = Window.partitionBy("entry").orderBy(F.desc(F.size("path")), "path")
    kept = done.withColumn("r", F.row_number().over(longest)).where(F.col("r") <= per_entry)
    return kept.select("entry", F.array_join("path", " -> ").alias("participants"), "possible_at").orderBy("entry", "participants").limit(total)


def evaluate(edges: DataFrame, expectations: DataFrame) -> DataFrame:
    """Precision and recall per case. expectations: case_name, source_fqn, target_owner, kind, min_confidence."""
    rank = lambda c: F.when(F.col(c) == "CONFIRMED", 1).otherwise(0)
    wanted = stored(expectations, "expectations")
    best = edges.groupBy("source_fqn", owner(F.col("target_fqn")).alias("target_owner"), "kind").agg(F.max(rank("confidence")).alias("has"))
    hit = wanted.join(best, ["source_fqn", "target_owner", "kind"], "left").withColumn("hit", F.coalesce(F.col("has") >= rank("min_confidence"), F.lit(False)))
    hits = hit.groupBy("case_name").agg(F.count_if("hit").alias("matched"), F.count("*").alias("total"))
    calls = edges.where("kind = 'CALLS'").select("source_fqn", owner(F.col("target_fqn")).alias("target_owner"))
    sources = wanted.select("case_name", "source_fqn").distinct()
    spurious = calls.join(sources, "source_fqn").join(wanted.select("case_name", "source_fqn", "target_owner").distinct(), ["case_name", "source_fqn", "target_owner"], "left_anti").groupBy("case_name").agg(F.count("*").alias("spurious"))
    got = hits.join(spurious, "case_name", "left").fillna(0, ["spurious"])
    return got.select("case_name", "matched", (F.col("total") - F.col("matched")).alias("missed"), "spurious",
                      F.when(F.col("matched") + F.col("spurious") == 0, 1.0).otherwise(F.round(F.col("matched") / (F.col("matched") + F.col("spurious")), 6)).alias("precision"),
                      F.when(F.col("total") == 0, 1.0).otherwise(F.round(F.col("matched") / F.col("total"), 6)).alias("recall"))


def federation_links(endpoints: DataFrame) -> DataFrame:
    """Each client endpoint with its first matching controller of another repo: by service first, then any; order by repo, symbol.

    Clients and controllers never meet as rows. Controllers of a verb, path and key (each stretch of their service's and repo's names; none for any
    service) are kept as the first symbol of the first two repos, of which one is not the client's own; clients ask by distinct keys."""
    e = endpoints.select("*", F.lower("http_method").alias("m"), ids.normal_path(F.col("path")).alias("p"), ids.service_key(F.col("service_name")).alias("s"), ids.service_key(F.col("repo_name")).alias("r"))
    full = F.concat_ws("#", "declaring_fqn", "member_name")
    client = e.where("is_client").select(F.col("repo_name").alias("client_repo"), full.alias("client_fqn"), "http_method", "path", "m", "p", F.col("s").alias("want"))
    control = e.where("not is_client").groupBy("m", "p", "s", "r", F.col("repo_name").alias("target_repo")).agg(F.min(full).alias("target_fqn")).where("target_repo is not null")
    asked = stored(client.select("m", "p", "client_repo", "want").distinct(), "asked")

    def stretches(c):
        starts = F.sequence(F.lit(1), F.length(c))
        return F.when(F.length(c) > 0, F.flatten(F.transform(starts, lambda i: F.transform(F.sequence(F.lit(1), F.length(c) - i + 1), lambda n: F.substring(c, i, n)))))

    none = F.array().cast("array<string>")
    keys = F.array_distinct(F.concat(F.when(F.coalesce("s", "r").isNotNull(), F.array(F.lit(""))).otherwise(none), F.coalesce(stretches(F.col("s")), none), F.coalesce(stretches(F.col("r")), none)))
    named = control.select("m", "p", "target_repo", "target_fqn", F.explode(keys).alias("want")).join(asked.select("want").distinct(), "want", "left_semi")
    found = None
    for tier, rows, by in ((0, named, ["m", "p", "want"]), (1, control, ["m", "p"])):
        of_repo = rows.groupBy(*by, "target_repo").agg(F.min("target_fqn").alias("target_fqn"))
        first = of_repo.withColumn("i", F.row_number().over(Window.partitionBy(*by).orderBy("target_repo"))).where("i <= 2").drop("i")
        met = asked.join(first, by).where("client_repo <> target_repo").select("m", "p", "client_repo", "want", F.struct(F.lit(tier).alias("tier"), "target_repo", "target_fqn").alias("b"))
        found = met if found is None else found.unionByName(met)
    best = found.groupBy("m", "p", "client_repo", "want").agg(F.min("b").alias("b")).withColumnsRenamed({c: f"_{c}" for c in ("m", "p", "client_repo", "want")})
    same = (F.col("m") == F.col("_m")) & (F.col("p") == F.col("_p")) & (F.col("client_repo") == F.col("_client_repo")) & F.col("want").eqNullSafe(F.col("_want"))
    each = client.join(best, same).groupBy("client_repo", "client_fqn", "http_method", "path").agg(F.min("b").alias("b"))
    return each.select("client_repo", "client_fqn", F.col("b.target_repo").alias("target_repo"), F.col("b.target_fqn").alias("target_fqn"), "http_method", "path")


def federation_radius(links: DataFrame, edges: DataFrame) -> DataFrame:
    """Per target: distinct clients and repos, and clients plus the direct callers of each link's client owner. edges has a repo column or one repo."""
    inside = edges.where("kind = 'CALLS'").groupBy(owner(F.col("target_fqn")).alias("own")).agg(F.count("*").alias("n"))
    met = links.withColumn("own", owner(F.col("client_fqn"))).join(inside, "own", "left")
    return met.groupBy("target_fqn", "target_repo").agg(F.countDistinct("client_fqn").alias("clients"), F.countDistinct("client_repo").alias("repos"), (F.countDistinct("client_fqn") + F.coalesce(F.sum("n"), F.lit(0))).alias("affected_callers"))


def rag_documents(edges: DataFrame, symbols: DataFrame, depth: int = 3) -> DataFrame:
    """One text per symbol: what it is, first callers and callees by name, and the 3-hop radius."""
    roots = symbols.select(F.col("qualified_name").alias("root")).distinct()
    calls = edges.where("kind = 'CALLS'").select(owner(F.col("source_fqn")).alias("s"), owner(F.col("target_fqn")).alias("t")).distinct()
    five = lambda c: F.array_join(F.slice(F.array_sort(F.collect_list(c)), 1, 5), ", ")
    low = lambda key, value: calls.withColumn("r", F.row_number().over(Window.partitionBy(key).orderBy(value))).where("r <= 5").groupBy(F.col(key).alias("root")).agg(five(value).alias(value + "s"))
    radius = counts.by_kind(counts.reach_counts(traverse.hops(edges, traverse.CALLS, True), roots, max_depth=depth), radius="node")
    got = symbols.withColumn("root", F.col("qualified_name")).join(low("t", "s"), "root", "left").join(low("s", "t"), "root", "left").join(radius, "root", "left")
    text = F.concat(F.col("kind"), F.lit(" "), F.col("qualified_name"),
                    F.when(F.coalesce("file_path", F.lit("")) != "", F.concat(F.lit(" located in "), "file_path", F.lit(":"), F.col("line_start").cast("string"), F.lit("-"), F.col("line_end").cast("string"))).otherwise(""),
                    F.when(F.size("annotations") > 0, F.concat(F.lit(". Annotations: "), F.array_join("annotations", ", "))).otherwise(""),
                    F.when(F.col("ss").isNotNull(), F.concat(F.lit(". Referenced by: "), "ss")).otherwise(""), F.when(F.col("ts").isNotNull(), F.concat(F.lit(". Invocations: "), "ts")).otherwise(""),
                    F.when(F.col("radius") > 0, F.concat(F.lit(". Transitive impact radius: "), F.col("radius").cast("string"), F.lit(" symbols"))).otherwise(""))
    return got.select(F.col("qualified_name").alias("fqn"), text.alias("summary"))


def hash_embedding(texts: DataFrame, dims: int = 64) -> DataFrame:
    """texts: fqn, text. Adds embedding: signed hashed words (1), their 3-grams (0.5) and name parts (2), at unit length."""
    words = F.filter(F.split(F.lower("text"), "[^a-z0-9_]+"), lambda w: F.length(w) >= 2)
    names = F.filter(F.split(F.lower("fqn"), "[^a-z0-9_]+"), lambda w: w != "")
    grams = F.flatten(F.transform(F.filter(words, lambda w: F.length(w) >= 3), lambda w: F.transform(F.sequence(F.lit(1), F.length(w) - 2), lambda i: F.substring(w, i, F.lit(3)))))
    weigh = lambda a, x: F.transform(a, lambda w: F.struct(w.alias("w"), F.lit(float(x)).alias("x")))
    # made per row, without groups; the sums are of halves, so their order is of no account
    parts = F.transform(F.concat(weigh(words, 1), weigh(grams, .5), weigh(names, 2)), lambda p: F.struct(ids.java_hash(p["w"]).alias("h"), p["x"].alias("x")))
    signed = F.transform(parts, lambda p: F.struct((F.abs(p["h"]) % dims).cast("int").alias("d"), F.when(p["h"] >= 0, p["x"]).otherwise(-p["x"]).alias("x")))
    total = lambda values, f: F.aggregate(values, F.lit(0.0), lambda s, x: s + f(x))
    once = lambda value, f: F.element_at(F.transform(F.array(value), f), 1)  # noqa: E731  a lambda's variable is not computed again where it is used
    sums = once(signed, lambda ps: F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda i: total(ps, lambda p: F.when(p["d"] == i, p["x"]).otherwise(0.0))))
    unit = lambda v, norm: F.transform(v, lambda x: F.when(norm > 0, x / norm).otherwise(0.0).cast("float"))
    vector = once(sums, lambda v: once(F.sqrt(total(v, lambda x: x * x)), lambda norm: unit(v, norm)))
    return spread(texts, "fqn").select("fqn", F.coalesce(vector, F.array_repeat(F.lit(0.0).cast("float"), dims)).alias("embedding"))


def nearest(vectors: DataFrame, query: DataFrame, top: int = 10) -> DataFrame:
    """Cosine top-k of one query vector (a row with column q) against vectors (vec_id, embedding)."""
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    met = vectors.join(F.broadcast(query.limit(1)))
    score = dot(F.col("embedding"), F.col("q")) / F.sqrt(dot(F.col("embedding"), F.col("embedding")) * dot(F.col("q"), F.col("q")))
    return met.select("vec_id", F.round(score, 6).alias("similarity")).orderBy(F.desc("similarity"), "vec_id").limit(top)


#: Sizes of line ranges that the index of symbols tells apart: powers of two up to 2^31.
LEVELS = 32


def line_ranges(symbols: DataFrame) -> DataFrame:
    """Pieces of symbols' line ranges in an index of (file_path, level, bin): part, the least or greatest line that the piece reaches in
    its bin, and the range.

    A range of more than 2^level and at most 2^(level + 1) lines is cut at the borders of the bins of 2^level lines, three at most, so each piece goes on
    to the end of its bin (part 'from') or begins at or before its start (part 'to'). Ranges of one line are 'to' pieces of level 0. Ranges that end before
    they begin are left out."""
    first, last = F.col("line_start").cast("long"), F.col("line_end").cast("long")
    level = F.greatest(F.lit(0), F.ceil(F.log2((last - first + 1).cast("double"))).cast("int") - 1)
    filed = symbols.where("line_end >= line_start").withColumn("level", level)
    filed = filed.withColumn("low", F.expr("shiftright(cast(line_start AS long), level)")).withColumn("high", F.expr("shiftright(cast(line_end AS long), level)"))
    piece = filed.withColumn("bin", F.explode(F.sequence("low", "high")))
    to = (F.col("bin") > F.col("low")) | (F.col("low") == F.col("high"))
    return piece.withColumn("part", F.when(to, "to").otherwise("from")).withColumn("at", F.when(to, F.least(F.col("line_end").cast("long"), F.expr("shiftleft(bin + 1, level) - 1"))).otherwise(F.col("line_start").cast("long")))


def symbol_at_line(symbols: DataFrame, positions: DataFrame, innermost: bool = False) -> DataFrame:
    """positions: file_path, line. The first symbol that spans the line (innermost: the one that starts last, then ends first), else the
    one that starts nearest. By name among equals.

    Positions and ranges never meet as pairs: in a bin of line_ranges() both are sorted by line, and a position takes the best 'from' piece at or
    before it and the best 'to' piece at or after it, one bin a level. Of pieces that reach the same line the best one is kept. For the nearest
    starts a file's starts and positions are sorted together; a position then takes the last start before it and the first one after it."""
    asked = positions.select("file_path", "line").distinct()
    probes = asked.withColumn("level", F.explode(F.array(*[F.lit(i) for i in range(LEVELS)]))).withColumn("bin", F.expr("shiftright(cast(line AS long), level)"))
    order = (-F.col("line_start"), F.col("line_end")) if innermost else (F.col("line_start"),)
    pieces = line_ranges(symbols.select("file_path", "qualified_name", "line_start", "line_end"))
    rank = F.struct(*[o.cast("long").alias(f"o{i}") for i, o in enumerate(order)], F.col("qualified_name").alias("q"))
    best = lambda part: F.min(F.when(F.col("part") == part, rank)).alias(part)
    kept = pieces.groupBy("file_path", "level", "bin", F.col("at").alias("line")).agg(best("from"), best("to"))
    both = kept.unionByName(probes.withColumn("line", F.col("line").cast("long")).withColumn("asked", F.lit(True)), allowMissingColumns=True)
    # two windows that grow from either end: one that shrinks would be computed anew at every row
    bin_of = Window.partitionBy("file_path", "level", "bin")
    up, down = (bin_of.orderBy(o).rangeBetween(Window.unboundedPreceding, 0) for o in (F.asc("line"), F.desc("line")))
    met = both.withColumn("f", F.min("from").over(up)).withColumn("t", F.min("to").over(down)).where("asked")
    met = met.groupBy("file_path", F.col("line").cast(asked.schema["line"].dataType).alias("line")).agg(F.min(F.least("f", "t")).alias("b")).where("b is not null")
    inside = stored(met.select("file_path", "line", F.col("b.q").alias("symbol")), "symbols-inside")
    rest = asked.join(inside, ["file_path", "line"], "left_anti")
    starts = symbols.groupBy("file_path", F.col("line_start").alias("line")).agg(F.min("qualified_name").alias("q")).join(rest.select("file_path").distinct(), "file_path", "left_semi")
    both = starts.withColumn("start", F.struct("line", "q")).select("file_path", "line", "start").unionByName(rest, allowMissingColumns=True)
    up, down = (Window.partitionBy("file_path").orderBy(o).rangeBetween(Window.unboundedPreceding, 0) for o in (F.asc("line"), F.desc("line")))
    near = both.withColumn("low", F.last("start", True).over(up)).withColumn("high", F.last("start", True).over(down)).where("start is null")
    far = lambda c: F.when(F.col(c).isNotNull(), F.struct(F.abs(F.col(f"{c}.line") - F.col("line")).alias("d"), F.col(f"{c}.q").alias("q")))
    best = near.withColumn("b", F.least(far("low"), far("high"))).where("b is not null").select("file_path", "line", F.col("b.q").alias("symbol"))
    return inside.unionByName(best)


# Patterns that read a service name and a path from an annotation's text, and the mappings that name a verb.
SERVICE_PATTERNS = [r"""(?:name|value)\s*=\s*["']([^"']+)["']""", r"""@FeignClient\s*\(\s*["']([^"']+)["']"""]
PATH_PATTERNS = [r"""(?:path|value)\s*=\s*["']([^"']+)["']""", r"""@(?:RequestMapping|GetMapping|PostMapping|PutMapping|DeleteMapping|PatchMapping)\s*\(\s*["']([^"']+)["']"""]
OWN_PATH = r"""path\s*=\s*["']([^"']+)["']"""
VERBS = ["Get", "Post", "Put", "Delete", "Patch"]


def _said(note, patterns):
    return F.coalesce(*[F.nullif(F.regexp_extract(note, p, 1), F.lit("")) for p in patterns])


def _verb(note):
    out = F.when(F.lower(note).contains("getmapping"), "GET")
    for v in VERBS[1:]:
        out = out.when(F.lower(note).contains(f"{v.lower()}mapping"), v.upper())
    return out.when(F.lower(note).contains("requestmapping"), F.coalesce(F.nullif(F.regexp_extract(note, r"method\s*=\s*RequestMethod\.([A-Z]+)", 1), F.lit("")), F.lit("GET")))


def endpoints(symbols: DataFrame) -> DataFrame:
    """HTTP endpoints that annotated types and their methods declare: controllers' and, as clients, those of client interfaces.

    symbols has repo_name. Of a method's annotations the first verb and the last path count; its type's path goes before."""
    notes = F.coalesce("annotations", F.array().cast("array<string>"))
    types = symbols.where("kind not in ('METHOD', 'FIELD')").withColumn("notes", notes)
    client = F.exists("notes", lambda a: a.contains("FeignClient"))
    kept = types.withColumn("is_client", client).where(client | F.exists("notes", lambda a: a.contains("Controller")))
    first = kept.select("repo_name", F.col("qualified_name").alias("declaring_fqn"), "is_client", F.get(F.array_compact(F.transform("notes", lambda a: _said(a, SERVICE_PATTERNS))), F.lit(0)).alias("service"),
                        F.get(F.array_compact(F.transform("notes", lambda a: F.when(a.contains("FeignClient"), _said(a, [OWN_PATH])).otherwise(_said(a, PATH_PATTERNS)))), F.lit(0)).alias("base"))
    methods = symbols.where("kind = 'METHOD'").withColumn("notes", notes).select(F.col("repo_name"), F.col("parent_fqn").alias("declaring_fqn"), F.regexp_extract("qualified_name", r"#([^(]*)", 1).alias("member_name"),
        F.get(F.array_compact(F.transform("notes", _verb)), F.lit(0)).alias("http_method"), F.element_at(F.concat(F.array(F.lit("")), F.array_compact(F.transform("notes", lambda a: _said(a, PATH_PATTERNS)))), -1).alias("sub"))
    met = first.join(methods.where("http_method is not null"), ["repo_name", "declaring_fqn"])
    joined = F.concat(*[F.when(F.trim(F.coalesce(c, F.lit("")), F.lit("/")) == "", "").otherwise(F.concat(F.lit("/"), F.trim(F.col(c), F.lit("/")))) for c in ("base", "sub")])
    return met.select("repo_name", F.coalesce(F.when(F.col("is_client"), F.col("service")), F.col("repo_name")).alias("service_name"), "http_method", F.when(joined == "", "/").otherwise(joined).alias("path"), "declaring_fqn", "member_name", "is_client")


def code_lens(edges: DataFrame, roots: DataFrame, depth: int = 3) -> DataFrame:
    """fqn, direct_callers (CALLS edges into it) and callers (types that reach it in depth calls) of each root."""
    direct = edges.where("kind = 'CALLS'").groupBy(owner(F.col("target_fqn")).alias("root")).agg(F.count("*").alias("direct_callers"))
    far = counts.by_kind(counts.reach_counts(traverse.hops(edges, traverse.CALLS, True), roots.select(owner(F.col("root")).alias("root")), max_depth=depth), callers="node")
    return roots.select("root").distinct().join(direct, "root", "left").join(far, "root", "left").fillna(0, ["direct_callers", "callers"]).withColumnRenamed("root", "fqn")


def couplings(edges: DataFrame, sources: DataFrame, targets: DataFrame, kinds=("CALLS", "USES")) -> DataFrame:
    """Edges from types of sources to types of targets (column fqn each)."""
    own = edges.where(F.col("kind").isin(*kinds)).withColumn("s", owner(F.col("source_fqn"))).withColumn("t", owner(F.col("target_fqn")))
    inside = own.join(sources.select(F.col("fqn").alias("s")), "s", "left_semi").join(targets.select(F.col("fqn").alias("t")), "t", "left_semi")
    return inside.drop("s", "t")


def resolution_quality(edges: DataFrame) -> DataFrame:
    """calls, and how many of them are only possible."""
    return edges.where("kind = 'CALLS'").agg(F.count("*").alias("calls"), F.count_if(F.col("confidence") == "POSSIBLE").alias("possible"))


def capped_callers(edges: DataFrame, fqn: str, limit: int = 50) -> DataFrame:
    """The first callers by name, direct and transitive ones together, with the counts over all."""
    far = traverse.transitive_callers(edges, fqn).select(F.col("node").alias("caller")).withColumn("direct", F.lit(False))
    near = traverse.direct_callers(edges, fqn).select(owner(F.col("source_fqn")).alias("caller")).withColumn("direct", F.lit(True))
    every = far.unionByName(near).groupBy("caller").agg(F.max("direct").alias("direct"))
    counts = every.agg(F.count("*").alias("total"), F.count_if("direct").alias("direct_total"))
    # counts is one row
    return every.orderBy("caller").limit(limit).crossJoin(F.broadcast(counts))
