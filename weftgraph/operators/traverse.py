"""Traversals of an edge table as iterated joins.

Nodes are owner types (what stands before #). A step joins the frontier with the adjacency, which is persisted by its key, and drops
what was seen by an anti-join; each depth is written below one folder, which is also the set of what was seen. So lineage stays
short and a lost executor repeats one step at most. Whether a frontier is broadcast is left to adaptive execution, which
knows its size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.functions.ids import owner, package
from weftgraph.plans.scratch import counted, new_path, stored, stored_with

CALLS = ("CALLS",)
#: Kinds that make a type depend on another.
DEPENDS = ("CALLS", "USES", "EXTENDS", "IMPLEMENTS")
#: From so many rows seen on, and with a frontier of less than one in FEW of them, a single root's edges to nodes seen are dropped.
MANY, FEW = 100_000, 10
CONFIDENCE_RANK = {"POSSIBLE": 0, "CONFIRMED": 1}


def of_kinds(edges: DataFrame, kinds) -> DataFrame:
    """Edges of these kinds; all of them for None."""
    return edges if kinds is None else edges.where(F.col("kind").isin(*kinds))


def hops(edges: DataFrame, kinds, incoming: bool) -> DataFrame:
    """(at, next) owners: from a node to its sources (incoming) or targets; a pair as often as edges have it."""
    s, t = owner(F.col("source_fqn")), owner(F.col("target_fqn"))
    at, then = (t, s) if incoming else (s, t)
    return of_kinds(edges, kinds).select(at.alias("at"), then.alias("next")).where("at <> next")


def adjacency(edges: DataFrame, kinds, incoming: bool) -> DataFrame:
    """hops(), each once, dealt by at: equal pairs meet there, so one shuffle does both."""
    return hops(edges, kinds, incoming).repartition("at").distinct()


def reach(edges: DataFrame, roots: DataFrame, kinds=CALLS, incoming: bool = True, max_depth: int | None = None,
          adjacent: DataFrame | None = None) -> DataFrame:
    """(root, node, depth) of every node that each root reaches, itself excluded; depth is the least number of hops.

    roots: one column, root. All roots expand together. kinds None: edges of every kind. max_depth under 1: no rows.
    adjacent: an adjacency() that is kept already, so that several traversals share it."""
    spark = edges.sparkSession
    if max_depth is not None and max_depth < 1:
        return spark.createDataFrame([], "root string, node string, depth int")
    adj = adjacent if adjacent is not None else adjacency(edges, kinds, incoming).persist()
    path, depth, pairs = new_path(spark, "reach"), 0, "root string, node string"
    left, since = adj, 0
    start = roots.select(owner(F.col("root")).alias("root")).distinct()
    roots_n = total = more = counted(start.select("root", F.col("root").alias("node")), f"{path}/depth=0")
    while more and (max_depth is None or depth < max_depth):
        level = spark.read.schema(pairs).parquet(f"{path}/depth={depth}")
        if not since and roots_n == 1 and total > MANY and more * FEW < total:
            seen = spark.read.schema(pairs).option("recursiveFileLookup", "true").parquet(path)
            left = adj.join(seen.select(F.col("node").alias("next")), "next", "left_anti").select("at", "next").repartition("at").persist()
            since = depth + 1
        met = level.join(left, F.col("node") == F.col("at")).select("root", F.col("next").alias("node")).distinct()
        known = [f"{path}/depth={d}" for d in range(since, depth + 1)]
        depth += 1
        fresh = met.join(spark.read.schema(pairs).parquet(*known), ["root", "node"], "left_anti") if known else met
        more = counted(fresh, f"{path}/depth={depth}")
        total += more
    if left is not adj:
        left.unpersist()
    if adjacent is None:
        adj.unpersist()
    return spark.read.schema(f"{pairs}, depth int").parquet(path).where("depth > 0")


def roots_of(edges: DataFrame, *fqns: str) -> DataFrame:
    return edges.sparkSession.createDataFrame([(x,) for x in fqns], "root string")


def transitive_callers(edges, fqn, max_depth=None) -> DataFrame:
    return reach(edges, roots_of(edges, fqn), CALLS, True, max_depth).select("node", "depth")


def transitive_callees(edges, fqn, max_depth=None) -> DataFrame:
    return reach(edges, roots_of(edges, fqn), CALLS, False, max_depth).select("node", "depth")


def transitive_dependents(edges, fqn, max_depth=None) -> DataFrame:
    return reach(edges, roots_of(edges, fqn), DEPENDS, True, max_depth).select("node", "depth")


def tests_of(edges: DataFrame) -> DataFrame:
    """(node, kind, leaf): the tests that hang on types, as leaves of counts.reach_counts()."""
    return edges.where("kind = 'TESTS'").select(F.col("target_fqn").alias("node"), F.lit("test").alias("kind"), F.col("source_fqn").alias("leaf"))


def affected_tests(edges: DataFrame, roots: DataFrame, dependents: DataFrame | None = None) -> DataFrame:
    """(root, test): sources of TESTS edges that name the root or a dependent exactly."""
    far = reach(edges, roots, DEPENDS, True) if dependents is None else dependents
    hit = far.select("root", "node").unionByName(roots.select(owner(F.col("root")).alias("root"), owner(F.col("root")).alias("node")))
    tests = edges.where("kind = 'TESTS'").select(F.col("source_fqn").alias("test"), "target_fqn").distinct()
    return hit.join(tests, F.col("node") == F.col("target_fqn")).select("root", "test").distinct()


def related_tests(edges, fqn) -> DataFrame:
    return edges.where((F.col("kind") == "TESTS") & (F.col("target_fqn") == fqn.split("#")[0]))


def _floor(edges, minimum):
    return edges.where("confidence = 'CONFIRMED'") if minimum == "CONFIRMED" else edges


def direct_callers(edges, fqn, min_confidence="POSSIBLE") -> DataFrame:
    """CALLS edges into the owner; order by confidence text descending, then line, is the listing's order."""
    return _floor(edges.where((F.col("kind") == "CALLS") & (owner(F.col("target_fqn")) == fqn.split("#")[0])), min_confidence)


def direct_callees(edges, fqn, min_confidence="POSSIBLE") -> DataFrame:
    return _floor(edges.where((F.col("kind") == "CALLS") & (owner(F.col("source_fqn")) == fqn.split("#")[0])), min_confidence)


def neighbors(edges, fqn, incoming: bool, kinds) -> DataFrame:
    side, other = ("target_fqn", "source_fqn") if incoming else ("source_fqn", "target_fqn")
    return edges.where(F.col("kind").isin(*kinds) & (owner(F.col(side)) == fqn.split("#")[0])).select(owner(F.col(other)).alias("node")).distinct()


def dynamic_dispatch(edges: DataFrame) -> DataFrame:
    """(fqn, has_dynamic_dispatch) of each calling owner: some call's target names reflection."""
    calls = edges.where("kind = 'CALLS'")
    return calls.groupBy(owner(F.col("source_fqn")).alias("fqn")).agg(F.bool_or(F.col("target_fqn").contains("reflect")).alias("has_dynamic_dispatch"))


def package_pairs(edges: DataFrame) -> DataFrame:
    return edges.select(package(F.col("source_fqn")).alias("src"), package(F.col("target_fqn")).alias("dst")).where("src is not null and dst is not null and src <> dst").groupBy("src", "dst").agg(F.count("*").alias("weight"))


def module_dependencies(edges: DataFrame, symbols: DataFrame) -> DataFrame:
    """Distinct (module of the edge, module of the target's owner), where they differ."""
    types = symbols.where("kind not in ('METHOD', 'FIELD')").groupBy(F.col("qualified_name").alias("fqn")).agg(F.max("module").alias("target_module"))
    met = edges.select("module", owner(F.col("target_fqn")).alias("fqn")).distinct().join(types, "fqn")
    return met.where("module <> target_module").select("module", "target_module").distinct()


def strongly_connected(pairs: DataFrame) -> DataFrame:
    """(node, component, size) of components with two nodes or more. pairs: src, dst. component is its least node.

    Colouring, with a row a node: nodes without edges in or out go; the greatest name spreads along the edges, so a node's colour is
    the greatest one that reaches it; the nodes of a colour that reach the one it is named for are a component. They
    go, and the rest starts anew. Runs of nodes with one edge in are passed in doubled steps, so a long ring costs the logarithm
    of its length; rounds grow with the longest path over the other nodes."""
    left = stored(pairs.where("src <> dst").select("src", "dst").distinct(), "scc")
    found = None
    while not (left := _trimmed(left)).isEmpty():
        nodes = left.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
        colours = stored(_spread(left, nodes.withColumn("value", F.col("node"))).withColumnRenamed("value", "colour"), "colours")
        one, two = colours.toDF("src", "s_colour"), colours.toDF("dst", "d_colour")
        inside = left.join(one, "src").join(two, "dst").where("s_colour = d_colour")
        back = stored(inside.select(F.col("dst").alias("src"), F.col("src").alias("dst")), "scc-back")
        marks = colours.select("node", F.when(F.col("node") == F.col("colour"), 1).otherwise(0).alias("value"))
        members = _spread(back, marks).where("value = 1").join(colours, "node").select(F.col("colour").alias("root"), "node")
        members = stored(members, "scc-members")
        found = members if found is None else found.unionByName(members)
        gone = members.select("node")
        left = left.join(gone.toDF("src"), "src", "left_anti").join(gone.toDF("dst"), "dst", "left_anti").select("src", "dst")
        left = stored(left, "scc")
    if found is None:
        return pairs.sparkSession.createDataFrame([], "node string, component string, size long")
    sizes = found.groupBy("root").agg(F.min("node").alias("component"), F.count("*").alias("size")).where("size > 1")
    return found.join(sizes, "root").select("node", "component", "size")


#: Rounds in which nodes without edges go one by one before runs of them go at once.
SINGLE_ROUNDS = 6


def _trimmed(pairs: DataFrame) -> DataFrame:
    """pairs without the nodes that lack an edge in or out, over and over until none goes."""
    every, count, rounds = {"n": F.count(F.lit(1))}, -1, 0
    while count:
        kept = pairs.join(pairs.select(F.col("dst").alias("src")).distinct(), "src", "left_semi")
        kept = kept.join(pairs.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi")
        (pairs, got), rounds = stored_with(kept.select("src", "dst"), "scc", **every), rounds + 1
        if got["n"] and rounds > SINGLE_ROUNDS:
            turned = _without_tails(_without_tails(pairs).select(F.col("dst").alias("src"), F.col("src").alias("dst")))
            pairs, got = stored_with(turned.select(F.col("dst").alias("src"), F.col("src").alias("dst")), "scc", **every)
        if got["n"] == count:
            break
        count = got["n"]
    return pairs


def _without_tails(pairs: DataFrame) -> DataFrame:
    """pairs without the nodes whose run of single edges in begins at a node that has none."""
    nodes = pairs.select(F.explode(F.array("src", "dst")).alias("node")).distinct().withColumn("value", F.lit(0))
    fed = pairs.select(F.col("dst").alias("head")).distinct()
    tails = _runs(pairs, nodes).select("node", F.coalesce("head", F.when(~F.col("ring"), F.col("node"))).alias("head")).where("head is not null").join(fed, "head", "left_anti")
    return pairs.join(tails.select(F.col("node").alias("src")), "src", "left_anti").select("src", "dst")


def _runs(pairs: DataFrame, values: DataFrame) -> DataFrame:
    """(node, head, best, ring): the node that a node's run of single edges in comes from (null: the node has not one edge in, or the run is a ring or comes from
    one) and the greatest value of the run from the node on, its head's left out; of a ring, all values. In doubled steps."""
    into = pairs.groupBy("dst").agg(F.count("*").alias("n"), F.min("src").alias("src")).where("n = 1").select(F.col("dst").alias("node"), F.col("src").alias("head"))
    now = stored(values.join(into, "node", "left").select("node", "head", F.col("value").alias("best")), "runs")
    before = None
    while True:
        ahead = now.select(F.col("node").alias("head"), F.col("head").alias("far"), F.col("best").alias("far_best"))
        met = now.where("head is not null").join(ahead, "head")
        moved = F.col("far").isNotNull()
        then = met.select("node", F.coalesce("far", "head").alias("head"), F.when(moved, F.greatest("best", "far_best")).otherwise(F.col("best")).alias("best"), moved.alias("moved"),
                          (moved & (F.col("far_best") > F.col("best"))).alias("rose"))
        then = then.unionByName(now.where("head is null").select("node", "head", "best", F.lit(False).alias("moved"), F.lit(False).alias("rose")))
        then, state = stored_with(then, "runs", moved=F.count_if("moved"), rose=F.count_if("rose"))
        now = then.select("node", "head", "best")
        # what moves on without end and has no higher value to come is a ring
        if not state["moved"] or (state["moved"] == before and not state["rose"]):
            return then.select("node", F.when(~F.col("moved"), F.col("head")).alias("head"), "best", F.col("moved").alias("ring"))
        before = state["moved"]


def _spread(pairs: DataFrame, values: DataFrame) -> DataFrame:
    """(node, value): the greatest value of the nodes that reach it, itself included. pairs: src, dst; values: node, value, a row a node."""
    runs = stored(_runs(pairs, values), "runs-done")
    ends = runs.where("head is null and not ring").select("node", F.col("best").alias("value"))
    # edges into nodes with several: from the head of the run that they come along, with the run's greatest value
    along = pairs.select("src", F.col("dst").alias("node")).join(ends.select("node"), "node", "left_semi").join(runs.withColumnRenamed("node", "src"), "src")
    fixed = along.where("head is not null or ring").groupBy("node").agg(F.max("best").alias("brought"))
    links = stored(along.where("not ring").select(F.coalesce("head", "src").alias("src"), "node").distinct(), "run-links")
    now = stored(ends.join(fixed, "node", "left").select("node", F.greatest("value", "brought").alias("value")), "spread")
    while True:
        sent = now.join(links.withColumnRenamed("node", "to"), F.col("node") == F.col("src")).select(F.col("to").alias("node"), "value")
        then = now.withColumn("was", F.col("value")).unionByName(sent, allowMissingColumns=True)
        then, state = stored_with(then.groupBy("node").agg(F.max("value").alias("value"), F.max("was").alias("was")), "spread", rose=F.count_if(F.col("value") != F.col("was")))
        now = then.select("node", "value")
        if not state["rose"]:
            break
    at_head = now.select(F.col("node").alias("head"), F.col("value").alias("from_head"))
    rest = runs.where("head is not null or ring").join(at_head, "head", "left").select("node", F.greatest("best", "from_head").alias("value"))
    return now.unionByName(rest)


def simple_cycles(pairs: DataFrame, limit: int = 100) -> DataFrame:
    """(path) of simple cycles, each from its least node, one a set of nodes: the first by length and text, at most limit, as a report.

    Paths grow inside components, all by one hop a round, until none is open or the rounds so far closed limit cycles."""
    inside = strongly_connected(pairs).select("node", "component")
    ends = inside.toDF("src", "c1"), inside.toDF("dst", "c2")
    pairs = pairs.select("src", "dst").distinct().join(ends[0], "src").join(ends[1], "dst").where("c1 = c2").select("src", "dst")
    pairs = stored(pairs, "cycle-pairs")
    paths, found = pairs.where("src < dst").select(F.array("src", "dst").alias("path")), []
    while True:
        step = stored(paths.join(pairs, F.element_at("path", -1) == F.col("src")).where("dst >= path[0]").select("path", "dst"), "cycle-steps")
        closed = step.where("dst = path[0]").groupBy(F.array_sort("path").alias("nodes")).agg(F.min("path").alias("path"))
        found.append(stored(closed.select("path"), "cycles"))
        paths = step.where(~F.array_contains("path", F.col("dst"))).select(F.array_append("path", F.col("dst")).alias("path"))
        if sum(f.count() for f in found) >= limit or paths.isEmpty():
            break
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out.orderBy(F.size("path"), "path").limit(limit)


def package_cycles(edges: DataFrame, min_confidence: str = "POSSIBLE", limit: int = 100) -> DataFrame:
    """(path, length, sample_edges) of package cycles over edges of every kind; a sample is the first edge of a hop by text."""
    edges = _floor(edges, min_confidence)
    cycles = simple_cycles(package_pairs(edges), limit).withColumn("cycle", F.array_join("path", " "))
    hops = cycles.select("cycle", F.posexplode(F.zip_with("path", F.concat(F.slice("path", 2, 1_000_000), F.slice("path", 1, 1)), lambda a, b: F.struct(a.alias("src"), b.alias("dst")))).alias("i", "hop"))
    text = F.concat("source_fqn", F.lit(" -> "), "target_fqn", F.lit(" ["), "kind", F.lit("]"))
    samples = edges.select(package(F.col("source_fqn")).alias("src"), package(F.col("target_fqn")).alias("dst"), text.alias("sample"))
    met = hops.select("cycle", "i", "hop.src", "hop.dst").join(samples, ["src", "dst"]).groupBy("cycle", "i").agg(F.min("sample").alias("sample"))
    per = met.groupBy("cycle").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "sample"))), lambda x: x["sample"]).alias("sample_edges"))
    return cycles.join(per, "cycle").select("path", F.size("path").alias("length"), "sample_edges")
