"""Mixing sources to target weights, in DataFrame operations only.

Each document gets a hash-random key. Within a source, keys are range-sorted: a leading part of the key
deals the source to ranges, the ranges' sizes are summed in key order, and a running sum inside each range
goes on from there. The running sum cut at the source's budget gives what the mix takes: whole epochs first,
then documents in key order until the budget is met to the word. A source with a third of all rows is as
many ranges as any other, so no task holds it.

Targets: sources in code point order (null last) weigh 3, 1, 2, repeating; together they share
``share`` times all sizes; none gets over ``max_repeats`` times its own size, and what is over is dealt again by
weight until none is above. That fixed point is min(cap, level x weight) for one level, found over the table of
sources, which has one row a source.

Null text: size 0. Null doc_id: such rows are ordered by text hash. Rows equal in doc_id and text share one
place in the order: the running sum takes them one after another. Empty table: no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.llm._common import ROW, WHITE_CHARS, materialize, rows_of, with_row

#: Hex digits of the key that make a range: 4096 ranges a source.
RANGE_DIGITS = 3


def word_count(text) -> F.Column:
    """Number of [^\\x20\\x09-\\x0D]+ in a string column, null: 0."""
    blank = F.translate(F.coalesce(text, F.lit("")), WHITE_CHARS, " " * len(WHITE_CHARS))
    return F.coalesce(F.regexp_count(blank, F.lit("[^ ]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights=(3, 1, 2), share: float = 1.5, max_repeats: float = 2.0) -> DataFrame:
    """sizes: source, source_size. Adds target (double) and budget (its nearest long)."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("_at") % len(weights) + 1).cast("int"))
    t = sizes.withColumn("_at", F.row_number().over(order) - 1).withColumn("_w", weight)
    t = t.withColumn("_cap", F.col("source_size") * F.lit(float(max_repeats))).withColumn("_level", F.col("_cap") / F.col("_w"))
    before = Window.orderBy("_level", "_at").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    t = t.withColumns({
        "_full": F.coalesce(F.sum("_cap").over(before), F.lit(0.0)),
        "_rest": F.sum("_w").over(every) - F.coalesce(F.sum("_w").over(before), F.lit(0.0)),
        "_all": F.sum("source_size").over(every) * F.lit(float(min(share, max_repeats))),
    })
    # sources below the first whose cap the level does not reach are at their cap
    t = t.withColumn("_own", (F.col("_all") - F.col("_full")) / F.col("_rest"))
    t = t.withColumn("_top", F.min(F.when(F.col("_own") <= F.col("_level"), F.struct("_level", "_at", "_own"))).over(every))
    at_cap = F.col("_top").isNull() | (F.struct("_level", "_at") < F.struct(F.col("_top._level"), F.col("_top._at")))
    t = t.withColumn("target", F.when(at_cap, F.col("_cap")).otherwise(F.col("_top._own") * F.col("_w")))
    return t.select("source", "source_size", "target", F.round("target").cast("long").alias("budget"))


def mix(docs: DataFrame, weights=(3, 1, 2), share: float = 1.5, max_repeats: float = 2.0, seed: str = "mix") -> DataFrame:
    """doc_id, source, size, source_size, target, budget, taken of each row, with its text hash _th."""
    text = F.col("text").cast("string")
    th = F.xxhash64(F.coalesce(text, F.lit("")))
    key = F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("null"), th.cast("string")))))
    sized = materialize(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), word_count(text).alias("size"), key.alias("_key"), th.alias("_th")), "mix-sizes")
    ranged = sized.withColumn("_range", F.substring("_key", 1, RANGE_DIGITS))
    ranges = materialize(ranged.groupBy("source", "_range").agg(F.sum("size").alias("_sum")), "mix-ranges")
    per_source = targets(ranges.groupBy("source").agg(F.sum("_sum").alias("source_size")), weights, share, max_repeats)
    ahead = Window.partitionBy("source").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    placed = ranges.select("source", "_range", F.coalesce(F.sum("_sum").over(ahead), F.lit(0)).alias("_ahead"))
    placed = placed.alias("p").join(per_source.alias("s"), F.col("p.source").eqNullSafe(F.col("s.source"))).select("p.*", "s.source_size", "s.target", "s.budget")
    inside = Window.partitionBy("source", "_range").orderBy("_key", F.col("doc_id").asc_nulls_last(), "_th").rowsBetween(Window.unboundedPreceding, -1)
    run = ranged.withColumn("_inside", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    got = run.alias("r").join(placed.alias("p"), F.col("r.source").eqNullSafe(F.col("p.source")) & (F.col("r._range") == F.col("p._range"))).select("r.*", "p._ahead", "p.source_size", "p.target", "p.budget")
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("budget") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    rest = F.col("budget") - whole * F.col("source_size") - F.col("_ahead") - F.col("_inside")
    taken = whole * F.col("size") + F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), rest))
    return got.select("doc_id", "source", "size", "source_size", "target", "budget", taken.alias("taken"), "_th")


def mix_documents(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs that the mix takes, each as often as it takes them (the one that the cut falls in: whole).

    Documents without words carry none and are not taken."""
    parts = mix(docs, **options).where("taken > 0").select("doc_id", "_th", F.ceil(F.col("taken") / F.col("size")).cast("int").alias("_copies"))
    parts = parts.groupBy(F.col("doc_id").alias("id"), F.col("_th").alias("th")).agg(F.max("_copies").alias("copies"))
    th = F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))
    own = with_row(docs, own_id=F.col("doc_id").cast("long"), own_th=th)
    both = own.join(parts, F.col("own_id").eqNullSafe(F.col("id")) & (F.col("own_th") == F.col("th")))
    return rows_of(both.select(ROW, F.explode(F.sequence(F.lit(1), F.col("copies")))), docs.columns)
