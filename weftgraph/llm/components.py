"""Connected components by alternating large-star and small-star steps over an edge table.

Every step is a groupBy with a map-side minimum and an equi-join that adaptive execution can split at a
hub, so a component may hold any share of the rows. Nothing is collected but two numbers per round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.llm._common import materialize, release


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """edges: two long columns (a, b), any order, repeats and loops allowed. Returns (node, root): root is
    the smallest node of the component. Nodes without an edge to another node are not listed."""
    now = materialize(
        edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "cc")
    seen = _print(now)
    for _ in range(max_rounds):
        if not seen[0]:
            break
        both = now.select("u", "v").unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = materialize(large, "cc-large")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .unionByName(low.select("u", F.col("m").alias("v"))).distinct())
        then = materialize(small, "cc")
        told = _print(then)
        release(now, large)
        now, done, seen = then, told == seen, told
        if done:
            break
    else:
        raise RuntimeError("connected_components: more rounds than max_rounds")
    stars = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return stars.unionByName(stars.select(F.col("root").alias("node"), "root").distinct())


def _print(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum((F.xxhash64("u", "v") % 1000003).cast("long")), F.sum(F.col("v") % 1000003)).first()
    return tuple(x or 0 for x in row)
