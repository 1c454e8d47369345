"""Importance resampling with hashed n-gram models.

Words (A-Z lower-cased, split at ASCII white space) and word pairs are hashed to two halves of ``buckets``
buckets. Two bag-of-n-grams models are counted: the target's over labelled good documents, the raw
text's over every document. A document's log importance weight is the sum of log(target / raw) over its n-grams.
Sampling without replacement in proportion to the weights is a top-k by log weight plus Gumbel noise, which
is drawn from a hash of the id, so reruns agree.

The target is a bounded, documented sample: the ``target_docs`` labelled documents (quality 1, toxic 0) of least id hash.
All else covers all documents. The k-th largest key is found by histograms that halve down to
a small bin, so no task sorts the table and nothing but bin counts reaches the driver.

Null text: no n-grams, weight 0. Null doc_id: scored and sampled, never a target. Repeated rows have one key and one
verdict; ties at the cut go to the smaller doc_id (null first). No target documents: all weights are 0.
Empty table: no rows. Only doc_id and text are read.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.llm._common import materialize, narrow


class Features:
    """Bucket numbers of a text's words and word pairs."""

    def __init__(self, buckets: int, max_cached: int = 500_000):
        self.half, self.max_cached, self.cache = buckets // 2, max_cached, {}

    def _word(self, w: bytes) -> int:
        import xxhash

        if len(self.cache) > self.max_cached:
            self.cache.clear()
        self.cache[w] = out = xxhash.xxh64_intdigest(w) or 1
        return out

    def __call__(self, text: str):
        import numpy as np

        cache, word = self.cache, self._word
        h = np.array([cache.get(w) or word(w) for w in text.encode("utf-8", "surrogatepass").lower().split()], dtype=np.uint64)
        pair = (h[:-1] * np.uint64(0x9E3779B97F4A7C15)) ^ h[1:]
        pair = (pair ^ pair >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)
        half = np.uint64(self.half)
        return np.concatenate(((h >> np.uint64(20)) % half, half + (pair >> np.uint64(20)) % half)).astype(np.int64)


def models(docs: DataFrame, labels: DataFrame, buckets: int, target_docs: int):
    """Counts (2 x buckets) of the raw text and of the target. One row a bucket reaches the driver."""
    import numpy as np

    good = labels.where("quality = 1 and coalesce(toxic, 0) = 0 and doc_id is not null").select(F.col("doc_id").cast("long").alias("good_id")).distinct()
    good = good.orderBy(F.xxhash64("good_id"), "good_id").limit(target_docs)

    def run(batches):
        import pyarrow as pa

        features, counts = Features(buckets), np.zeros((2, buckets), dtype=np.int64)
        for b in batches:
            for t, is_target in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                own = np.bincount(features(t), minlength=buckets) if len(t) > 20_000 else features(t)
                if len(t) > 20_000:
                    counts[0] += own
                    if is_target:
                        counts[1] += own
                else:
                    np.add.at(counts[0], own, 1)
                    if is_target:
                        np.add.at(counts[1], own, 1)
        at = np.flatnonzero(counts[0])
        yield pa.record_batch([pa.array(at.astype(np.int32)), pa.array(counts[0][at]), pa.array(counts[1][at])], names=["bucket", "raw", "target"])

    marked = narrow(docs, "text").join(F.broadcast(good), F.col("doc_id") == F.col("good_id"), "left").select("text", F.col("good_id").isNotNull().alias("t"))
    out = np.zeros((2, buckets))
    for r in marked.mapInArrow(run, "bucket int, raw long, target long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).collect():
        out[:, r["bucket"]] = r["raw"], r["target"]
    return out


def log_ratio(counts, smoothing: float = 1.0):
    """log(target / raw) of each bucket, each half a distribution of its own."""
    import numpy as np

    if not counts[1].any():
        return np.zeros(counts.shape[1])
    halves = counts.reshape(2, 2, -1) + smoothing
    p = np.log(halves / halves.sum(axis=2, keepdims=True))
    return (p[1] - p[0]).ravel()


def score(docs: DataFrame, ratio) -> DataFrame:
    """doc_id, n_words, log_weight, gumbel_key."""
    buckets = len(ratio)

    def run(batches):
        import pyarrow as pa

        features = Features(buckets)
        for b in batches:
            got = [features(t) for t in b.column(1).to_pylist()]
            yield pa.record_batch([b.column(0), pa.array([(len(x) + 1) // 2 for x in got], pa.int64()), pa.array([float(ratio[x].sum()) for x in got], pa.float64()), b.column(2)], names=["doc_id", "n_words", "log_weight", "h"])

    rows = narrow(docs, "text").withColumn("h", F.xxhash64(F.lit("gumbel"), F.coalesce(F.col("doc_id"), F.xxhash64("text"))))
    uniform = (F.shiftrightunsigned("h", 11).cast("double") + 0.5) / float(1 << 53)
    return rows.mapInArrow(run, "doc_id long, n_words long, log_weight double, h long").select("doc_id", "n_words", "log_weight", (F.col("log_weight") - F.log(-F.log(uniform))).alias("gumbel_key"))


def kth_largest(rows: DataFrame, k: int, bins: int = 4096, small: int = 10_000):
    """(key, doc_id) of the k-th row by gumbel_key descending, doc_id ascending (null first); None if there are fewer."""
    order = [F.col("gumbel_key").desc(), F.col("doc_id").asc_nulls_first()]
    lo, hi, n = rows.agg(F.min("gumbel_key"), F.max("gumbel_key"), F.count("*")).first()
    if k > n:
        return None
    inside = rows
    while n > small and lo < hi:
        width = (hi - lo) / bins
        at = F.least(F.lit(bins - 1), F.floor((F.col("gumbel_key") - lo) / width)).cast("int")
        counts = {r["b"]: r for r in inside.groupBy(at.alias("b")).agg(F.count("*").alias("n"), F.min("gumbel_key").alias("lo"), F.max("gumbel_key").alias("hi")).collect()}
        for b in sorted(counts, reverse=True):
            if k <= counts[b]["n"]:
                break
            k -= counts[b]["n"]
        lo, hi, n = counts[b]["lo"], counts[b]["hi"], counts[b]["n"]
        inside = rows.where(F.col("gumbel_key").between(lo, hi))
    # here are at most small rows, or rows of one key: of these the ids are searched in the same way
    if lo < hi:
        for r in inside.orderBy(*order).limit(small).collect():
            k -= 1
            if not k:
                return r["gumbel_key"], r["doc_id"]
    nulls, first, last, n = inside.agg(F.count_if(F.col("doc_id").isNull()), F.min("doc_id"), F.max("doc_id"), F.count("*")).first()
    if k <= nulls:
        return lo, None
    k -= nulls
    while first < last:
        width = (last - first) // bins + 1
        at = F.floor((F.col("doc_id").cast("decimal(38,0)") - F.lit(first).cast("decimal(38,0)")) / width).cast("int")
        counts = {r["b"]: r for r in inside.where(F.col("doc_id").between(first, last)).groupBy(at.alias("b")).agg(F.count("*").alias("n"), F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).collect()}
        for b in sorted(counts):
            if k <= counts[b]["n"]:
                break
            k -= counts[b]["n"]
        first, last = counts[b]["lo"], counts[b]["hi"]
    return lo, first


def resample(docs: DataFrame, labels: DataFrame, share: float = 0.8, buckets: int = 1 << 16, target_docs: int = 20_000) -> DataFrame:
    """doc_id, n_words, log_weight, gumbel_key, kept of each row; the ceil(share n) rows of largest key are kept."""
    rows = materialize(score(docs, log_ratio(models(docs, labels, buckets, target_docs))), "importance")
    k = math.ceil(share * rows.count())
    cut = kth_largest(rows, k) if k else None
    if cut is None:
        return rows.withColumn("kept", F.lit(k > 0))
    key, last = cut
    tie = F.col("doc_id").isNull() if last is None else F.col("doc_id").isNull() | (F.col("doc_id") <= last)
    return rows.withColumn("kept", (F.col("gumbel_key") > key) | ((F.col("gumbel_key") == key) & tie))
