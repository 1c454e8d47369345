"""Lookups of single symbols, edges and modules, capped listings, and what is computed from a few of them.

Orders are total, so that equal tables give equal listings. Capped listings come as one row: items (the first limit, by name),
total, returned and truncated, and where it matters the direct and transitive counts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.functions.ids import owner
from weftgraph.operators import traverse

MEMBERS = ("METHOD", "FIELD")
#: Precision and recall that an evaluation must reach on average.
GATE = (0.85, 0.90)


def by_fqn(symbols: DataFrame, fqn: str) -> DataFrame:
    return symbols.where(F.col("qualified_name") == fqn)


def by_module(symbols: DataFrame, module: str) -> DataFrame:
    return symbols.where(F.col("module") == module).orderBy("qualified_name")


def by_parent(symbols: DataFrame, fqn: str) -> DataFrame:
    return symbols.where(F.col("parent_fqn") == fqn).orderBy("line_start", "qualified_name")


def all_types(symbols: DataFrame) -> DataFrame:
    return symbols.where(~F.col("kind").isin(*MEMBERS))


def type_to_module(symbols: DataFrame) -> DataFrame:
    """(fqn, module) of types; of repeated names the last module."""
    return all_types(symbols).groupBy(F.col("qualified_name").alias("fqn")).agg(F.max("module").alias("module"))


def count_name_prefix(symbols: DataFrame, prefix: str) -> DataFrame:
    return symbols.where(F.col("name").ilike(prefix + "%")).agg(F.count("*").alias("n"))


def edges_of(edges: DataFrame, source: str | None = None, target: str | None = None, kind: str | None = None) -> DataFrame:
    """Edges with exactly this source, target and kind, as far as they are given."""
    for column, value in (("source_fqn", source), ("target_fqn", target), ("kind", kind)):
        if value is not None:
            edges = edges.where(F.col(column) == value)
    return edges


def caller_rows(edges: DataFrame, fqn: str, incoming: bool = True) -> DataFrame:
    """CALLS edges into (else out of) a name or its members: possible ones first, as the text order of confidence has it."""
    side = F.col("target_fqn" if incoming else "source_fqn")
    hit = edges.where((F.col("kind") == "CALLS") & ((side == fqn) | side.startswith(fqn + "#")))
    return hit.orderBy(F.desc("confidence"), "line", "source_fqn", "target_fqn", "caller_member")


def modules_with_files(states: DataFrame) -> DataFrame:
    return states.select("module").distinct()


def recorded_modules(modules: DataFrame) -> DataFrame:
    return modules.select("name").distinct().orderBy("name")


def file_states(states: DataFrame, module: str) -> DataFrame:
    return states.where(F.col("module") == module).select("path", "hash")


def deleted_modules(known: DataFrame, current: DataFrame) -> DataFrame:
    return known.select("module").distinct().join(current.select("module"), "module", "left_anti")


def unresolved_of(unresolved: DataFrame, module: str | None = None) -> DataFrame:
    rows = unresolved if module is None else unresolved.where(F.col("module") == module)
    return rows.orderBy("id") if "id" in rows.columns else rows.orderBy("module", "file_path", "line", "symbol")


def embedding_of(embeddings: DataFrame, key, column: str = "symbol_fqn") -> DataFrame:
    return embeddings.where(F.col(column) == key)


def violations_of(violations: DataFrame, fqn: str) -> DataFrame:
    return violations.where(owner(F.col("source")) == fqn.split("#")[0])


def _capped(rows: DataFrame, column: str, limit: int, *more) -> DataFrame:
    """One row; rows has distinct values of column."""
    first = rows.orderBy(column).limit(limit).agg(F.array_sort(F.collect_list(column)).alias("items"))
    counts = rows.agg(F.count("*").alias("total"), *more)
    both = first.crossJoin(counts)  # a row each
    return both.select("items", "total", F.size("items").cast("long").alias("returned"), (F.col("total") > limit).alias("truncated"), *[c for c in counts.columns if c != "total"])


def capped_symbols(symbols: DataFrame, prefix: str, limit: int = 50) -> DataFrame:
    return _capped(symbols.where(F.col("name").ilike(prefix + "%")).select("qualified_name").distinct(), "qualified_name", limit)


def capped_neighbours(edges: DataFrame, fqn: str, incoming: bool, limit: int = 50) -> DataFrame:
    """Callers (else callees), direct and transitive ones together."""
    far = traverse.reach(edges, traverse.roots_of(edges, fqn), traverse.CALLS, incoming).select("node", F.lit(0).alias("direct"), F.lit(1).alias("transitive"))
    near = traverse.neighbors(edges, fqn, incoming, traverse.CALLS).select("node", F.lit(1).alias("direct"), F.lit(0).alias("transitive"))
    rows = far.unionByName(near).groupBy("node").agg(F.max("direct").alias("direct"), F.max("transitive").alias("transitive"))
    return _capped(rows, "node", limit, F.coalesce(F.sum("direct"), F.lit(0)).alias("direct_total"), F.coalesce(F.sum("transitive"), F.lit(0)).alias("transitive_total"))


def capped_tests(edges: DataFrame, fqn: str, limit: int = 50) -> DataFrame:
    return _capped(traverse.related_tests(edges, fqn).select(F.col("source_fqn").alias("test")).distinct(), "test", limit)


def config_impact(bindings: DataFrame, roots: DataFrame) -> DataFrame:
    """(root, property_key, target_fqn) of the bindings whose target's name begins with the root, or whose key is the root.

    Targets meet roots by each of the target's prefixes that ends at a dot, a # or the end, so the join is on equality; roots that
    end inside a name are not types and match nothing."""
    parts = F.split(F.col("target_fqn"), "(?<=[.#])|(?=[.#])")
    starts = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), ""))
    keys = F.array_distinct(F.concat(starts, F.array("property_key")))
    met = bindings.withColumn("root", F.explode(keys)).join(roots.select("root").distinct(), "root")
    return met.select("root", "property_key", "target_fqn").distinct()


def attributed(edges: DataFrame, symbols: DataFrame) -> DataFrame:
    """Edges with the module of the symbol that their source is, or is a member of; edges of unknown sources go."""
    return edges.drop("module").withColumn("fqn", owner(F.col("source_fqn"))).join(type_to_module(symbols), "fqn").drop("fqn")


def dead_private_methods(edges: DataFrame, symbols: DataFrame) -> DataFrame:
    """(file_path, methods) of private methods whose type nothing calls; methods sorted, each name once."""
    called = edges.where("kind = 'CALLS'").select(owner(F.col("target_fqn")).alias("own")).distinct()
    private = symbols.where("kind = 'METHOD' and visibility = 'PRIVATE' and coalesce(file_path, '') <> ''").withColumn("own", owner(F.col("qualified_name")))
    return private.join(called, "own", "left_anti").groupBy("file_path").agg(F.array_sort(F.collect_set("name")).alias("methods"))


def migration_plan(edges: DataFrame, symbols: DataFrame, radar: DataFrame) -> DataFrame:
    """(fqn, old_name, new_name, caller, caller_file): which calls of deprecated members to rename, and where.

    radar: deprecation rows with fqn and replacement_hint. Names are what stands after #; equal and empty ones give nothing. A
    caller's file is that of its type, the first by module, line and path."""
    def name(c):
        return F.regexp_replace(F.substring_index(c, "#", -1), r"\(.*$", "")

    items = radar.where("replacement_hint is not null").select("fqn", owner(F.col("fqn")).alias("own"), name(F.col("fqn")).alias("old_name"), name(F.col("replacement_hint")).alias("new_name"))
    items = items.where("old_name <> '' and new_name <> '' and old_name <> new_name")
    calls = edges.where("kind = 'CALLS'").select(owner(F.col("target_fqn")).alias("own"), owner(F.col("source_fqn")).alias("caller")).distinct()
    files = symbols.where("file_path is not null").groupBy(F.col("qualified_name").alias("caller")).agg(F.min(F.struct("module", "line_start", "file_path")).alias("f"))
    met = items.join(calls, "own").join(files, "caller")
    return met.select("fqn", "old_name", "new_name", "caller", F.col("f.file_path").alias("caller_file")).distinct()


def deprecation_totals(radar: DataFrame) -> DataFrame:
    """One row over deprecation rows: how many, their callers and reach, and the mean effort, cut to a whole number in 0..100."""
    mean = F.coalesce(F.floor(F.avg("effort")), F.lit(0))
    return radar.agg(
        F.count("*").alias("symbols"), F.coalesce(F.sum("direct_callers"), F.lit(0)).alias("direct_callers"),
        F.coalesce(F.sum("blast_radius"), F.lit(0)).alias("blast_radius"), F.least(F.lit(100), F.greatest(F.lit(0), mean)).cast("int").alias("debt"))


def derived_visibility(types: DataFrame, methods: DataFrame) -> DataFrame:
    """(fqn, visibility) of types: that of its own methods where they all have the same, else PUBLIC for an interface, else PACKAGE.

    types: fqn, kind. methods: fqn (of the type), visibility, synthetic."""
    per = methods.where("not coalesce(synthetic, false)").groupBy("fqn").agg(F.countDistinct("visibility").alias("n"), F.min("visibility").alias("v"))
    one = F.when(F.col("n") == 1, F.col("v")).when(F.col("kind") == "INTERFACE", "PUBLIC").otherwise("PACKAGE")
    return types.join(per, "fqn", "left").select("fqn", one.alias("visibility"))


def evaluation_summary(cases: DataFrame) -> DataFrame:
    """One row over analyse.evaluate()'s: averages (0 for no case), how many cases are perfect, and whether the gate is passed."""
    perfect = F.count_if((F.col("missed") == 0) & (F.col("spurious") == 0))
    mean = cases.agg(F.count("*").alias("cases"), perfect.alias("perfect"), *[F.round(F.coalesce(F.avg(c), F.lit(0.0)), 6).alias(c) for c in ("precision", "recall")])
    line = F.format_string("cases=%d precision=%.3f recall=%.3f", "cases", "precision", "recall")
    return mean.withColumn("passed", (F.col("precision") >= GATE[0]) & (F.col("recall") >= GATE[1])).withColumn("summary", line)


def cache_hits(wanted: DataFrame, cache: DataFrame) -> DataFrame:
    """(key, classpath) of cache rows that are still good: the same key and the same hash of the build files.

    wanted and cache: key, build_hash; cache: classpath, null or empty where it could not be read (a miss). Hashes are longer than what they are
    made of, so sizes of files say too little: the join is by sorted keys, neither side goes through the driver."""
    good = cache.where("classpath is not null and classpath <> ''").hint("merge")
    return wanted.select("key", "build_hash").join(good, ["key", "build_hash"]).select("key", "classpath").distinct()


def cache_key(path, network):
    """The cache key of a module's path and whether the network may be used."""
    return F.sha2(F.concat_ws("|", path, network.cast("string")), 256)
