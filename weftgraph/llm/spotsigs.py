"""SpotSigs fingerprints: chains of content words that follow common-word anchors.

A text's words (lower-cased, punctuation stripped) are common words or content. Anchors are the text's start, every common word and
every word with a hash divisible by ``EVERY``, so lists, codes and other languages have anchors too. Each anchor yields one
signature: itself with the next ``chain`` content words, ``distance`` apart; words past the end count as none. The rule is the
same for every text. The fingerprint is the sorted set of 32-bit signature hashes, written as hex, so equal texts have equal
fingerprints and the likeness of two fingerprints is their Jaccard coefficient. Without words it is empty. Two empty ones
are alike (1), an empty and another are not (0).

near_documents() compares each document's fingerprint to that of its edited text and of the next document. Documents in
descending doc_id order (nulls last, ties by text hash) are dealt to key ranges with known bounds; each range also gets
a copy of the document that opens the next range, so neighbours meet without a global sort in one task.

Null text: empty. Repeated rows: each is returned and has its place in the order. Empty table: no rows.
One document: it is its own next.
"""

from __future__ import annotations

import bisect

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.llm._common import materialize, narrow, partitions

# Common words of English, French, German and Spanish.
ANCHORS = frozenset("""
a an and are as at be by for from has in is it its of on or that the this to was were will with
au aux ce de des du en est et la le les pour que qui sur un une dans par
auf das dem den der des die ein eine im ist mit nicht und von zu für
al como con del el las lo los no para por se su una y
""".split())


#: Of the words by hash, one in so many is an anchor.
EVERY = 8


class Fingerprinter:
    def __init__(self, chain: int = 2, distance: int = 2, max_cached: int = 500_000):
        self.chain, self.distance, self.max_cached, self.cache = chain, distance, max_cached, {}

    def _word(self, w: str) -> int:
        """A word's 62-bit hash, doubled, with 1 added for an anchor; 0 for no word."""
        import xxhash

        bare = w.strip("""!"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~""").lower()
        out = 0 if not bare else (xxhash.xxh64_intdigest(bare.encode("utf-8", "surrogatepass")) >> 2 << 1 | (bare in ANCHORS)) or 2
        if len(self.cache) > self.max_cached:
            self.cache.clear()
        self.cache[w] = out
        return out

    def signatures(self, text: str):
        """Sorted distinct uint32."""
        import numpy as np

        cache, word, tokens = self.cache, self._word, text.split()
        h = np.array([cache.get(w) or word(w) for w in tokens], dtype=np.uint64)
        h = h[h > 0]
        if not len(h):
            return np.zeros(0, dtype=np.uint32)
        common = (h & np.uint64(1)).astype(bool)
        content = h[~common]
        at = np.flatnonzero(common | ((h >> np.uint64(7)) % np.uint64(EVERY) == 0))
        # the first content word after each anchor; the start has the first of all
        first = np.concatenate(([0], np.cumsum(~common)[at]))
        padded = np.concatenate((content, np.zeros((self.chain - 1) * self.distance + 1, np.uint64)))
        rows = [np.concatenate((np.zeros(1, np.uint64), h[at])), *[padded[first + k * self.distance] for k in range(self.chain)]]
        return np.unique(self._mix(np.stack(rows, axis=1)))

    @staticmethod
    def _mix(rows):
        import numpy as np

        x = np.full(len(rows), 0x9E3779B97F4A7C15, dtype=np.uint64)
        for k in range(rows.shape[1]):
            x = (x ^ rows[:, k]) * np.uint64(0xD6E8FEB86659FD93)
            x ^= x >> np.uint64(32)
        return (x >> np.uint64(16)).astype(np.uint32)


def to_text(signatures) -> str:
    return signatures.astype(">u4").tobytes().hex()


def from_text(fingerprint: str):
    import numpy as np

    return np.frombuffer(bytes.fromhex(fingerprint), dtype=">u4").astype(np.uint32)


def likeness(a, b) -> float:
    import numpy as np

    if not len(a) or not len(b):
        return float(len(a) == len(b))
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def edited(text: str, other: str) -> str:
    """text with its last third replaced by the head of other, as many code points at most."""
    n = len(text) // 3
    return text[:len(text) - n] + other[:n]


def near_documents(docs: DataFrame, chain: int = 2, distance: int = 2) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of each row."""
    spark = docs.sparkSession
    rows = narrow(docs, "text").withColumn("th", F.xxhash64("text"))
    keys = materialize(rows.select("doc_id", "th"), "spot-order")
    ranges = max(1, 8 * partitions(spark))
    # the bounds and the opening rows are one row a range
    bounds = sorted({int(x) for x in keys.approxQuantile("doc_id", [i / ranges for i in range(1, ranges)], 0.25 / ranges)}) if keys.where("doc_id is not null").head(1) else []
    own = F.when(F.col("doc_id").isNull(), F.lit(len(bounds) + 1)).otherwise(_range(F.col("doc_id"), bounds))
    order = F.struct(F.when(F.col("doc_id").isNull(), F.lit(1)).otherwise(F.lit(0)), -F.coalesce("doc_id", F.lit(0)), F.col("th"))
    opening = keys.groupBy(own.alias("r")).agg(F.min(order).alias("k")).orderBy("r").collect()
    if not opening:
        return spark.createDataFrame([], OUT)
    # the row that opens a range is also sent to the range before it; the very first to the last
    ghosts = [(opening[i - 1]["r"], bool(x["k"][0]), -x["k"][1], x["k"][2]) for i, x in enumerate(opening)]
    table = spark.createDataFrame(ghosts, "ghost_of int, lone boolean, id long, own_th long")
    opens = (F.col("doc_id").isNull() == F.col("lone")) & (F.coalesce("doc_id", F.lit(0)) == F.col("id")) & (F.col("th") == F.col("own_th"))
    dealt = rows.withColumn("r", own).join(F.broadcast(table), opens, "left")
    sent = dealt.select("doc_id", "text", "th", F.explode(F.when(F.col("ghost_of").isNull(), F.array(F.struct(F.col("r").alias("r"), F.lit(False).alias("ghost"))))
                        .otherwise(F.array(F.struct(F.col("r").alias("r"), F.lit(False).alias("ghost")), F.struct(F.col("ghost_of").alias("r"), F.lit(True).alias("ghost"))))).alias("x"))
    sent = sent.select("doc_id", "text", "th", "x.r", "x.ghost").repartition(partitions(spark), "r")
    sent = sent.sortWithinPartitions("r", "ghost", F.col("doc_id").desc_nulls_last(), "th").select("doc_id", "text", "r", "ghost")

    def run(batches):
        import hashlib

        import pyarrow as pa

        maker, held = Fingerprinter(chain, distance), None

        def row(now, then):
            changed = edited(now[1], then[1])
            own, changed_print = now[4], maker.signatures(changed)
            return (now[0], len(now[1]), hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest(), to_text(own), to_text(changed_print), likeness(own, changed_print), likeness(own, then[4]))

        for b in batches:
            rows = []
            for d, t, r, ghost in zip(*(c.to_pylist() for c in b.columns)):
                now = (d, t, r, ghost, held[4] if held and held[1] == t else maker.signatures(t))
                if held is not None and held[2] == r and not held[3]:
                    rows.append(row(held, now))
                held = now
            cols = list(zip(*rows)) or [()] * 7
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
            yield pa.record_batch([pa.array(c, k) for c, k in zip(cols, kinds)], names=[x.split()[0] for x in OUT.split(", ")])

    return sent.mapInArrow(run, OUT)


OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _range(column, bounds: list[int]):
    """How many bounds are above the column: 0 for the largest ids."""
    if not bounds:
        return F.lit(0)
    steps = F.array(*[F.lit(b).cast("long") for b in bounds])
    return (F.lit(len(bounds)) - F.when(column < bounds[0], F.lit(0)).otherwise(_search(column, steps, len(bounds)))).cast("int")


def _search(column, steps, n: int):
    """How many of the sorted steps are at most column, by binary search; each step's place is computed once."""
    size = 1
    while size * 2 <= n:
        size *= 2

    def step(at, size):
        then = F.when((at + size <= n) & (F.get(steps, at + (size - 1)) <= column), at + size).otherwise(at)
        return F.transform(F.array(then), lambda x: step(x, size // 2))[0] if size > 1 else then

    return step(F.lit(0), size)
