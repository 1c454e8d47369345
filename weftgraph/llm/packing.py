"""Best-fit packing of token sequences by exact-complement hashing.

Documents are encoded whole, get an end id, and only longer ones than a sequence are cut into full pieces (the
first piece takes the remainder). Pieces differ for packing only by their length, so the plan is made on the
histogram of lengths, which has at most ``capacity`` entries at any size of the corpus: from the longest
length down, its gap is filled exactly by single, pair and triple sums found by hashing complements while
counts last; what is left goes by best fit. The plan is a list of patterns (lengths in one sequence) with
how many sequences each makes. Pieces then are numbered within their length - a number per task and length, and a
running sum over the tasks - and look up their place in the plan.

Null text: empty, one piece with the end id. Null doc_id and repeated rows: each row is packed as its own
document. Empty table: no rows. Other columns are ignored.
"""

from __future__ import annotations

import bisect
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.llm._common import materialize, narrow
from weftgraph.llm.encoding import encoder

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, task int, nth long"


def cut_pieces(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of n ids."""
    if n <= capacity:
        return [(0, n)]
    head = n % capacity
    return ([(0, head)] if head else []) + [(s, capacity) for s in range(head, n, capacity)]


def plan(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """(lengths, times) for the given number of pieces of each length; every piece is placed once."""
    left = {n: c for n, c in counts.items() if c > 0}
    has = np.zeros(capacity + 1, dtype=bool)
    has[list(left)] = True
    out: list[tuple[tuple[int, ...], int]] = []
    loose: list[tuple[int, int]] = []

    def take(*lengths) -> int:
        need = Counter(lengths)
        times = min(left.get(x, 0) // k for x, k in need.items())
        if times:
            for x, k in need.items():
                left[x] -= k * times
                if not left[x]:
                    del left[x]
                    has[x] = False
            out.append((lengths, times))
        return times

    for n in sorted(left, reverse=True):
        gap = capacity - n
        while left.get(n):
            if not gap:
                take(n)
            elif not (has[gap] and take(n, gap) or _pair(n, gap, has, take) or _triple(n, gap, has, take)):
                loose.append((n, left.pop(n)))
                has[n] = False
    return out + _best_fit(loose, capacity)


def _two(total, has, most):
    """a >= b, both at hand, a + b = total, a at most most; larger a first."""
    a = np.arange(min(most, total - 1), (total + 1) // 2 - 1, -1)
    return a[has[a] & has[total - a]].tolist()


def _pair(n, gap, has, take) -> bool:
    return any(take(n, a, gap - a) for a in _two(gap, has, n))


def _triple(n, gap, has, take) -> bool:
    return any(take(n, a, b, gap - a - b) for a in range(min(n, gap - 2), (gap + 2) // 3 - 1, -1) if has[a] for b in _two(gap - a, has, a))


def _best_fit(loose: list[tuple[int, int]], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit decreasing over (length, count): bins of one kind stay together with how many there are."""
    gaps: list[int] = []
    bins: dict[int, list[tuple[tuple[int, ...], int]]] = defaultdict(list)

    def put(gap, kind, times):
        if gap not in bins:
            bisect.insort(gaps, gap)
        bins[gap].append((kind, times))

    for n, c in sorted(loose, reverse=True):
        while c:
            at = bisect.bisect_left(gaps, n)
            if at == len(gaps):
                per = capacity // n
                if c >= per:
                    put(capacity - per * n, (n,) * per, c // per)
                    c %= per
                else:
                    put(capacity - c * n, (n,) * c, 1)
                    c = 0
                continue
            gap = gaps[at]
            kind, times = bins[gap].pop()
            if not bins[gap]:
                del bins[gap]
                gaps.pop(at)
            fit = min(gap // n, c)
            used = min(times, c // fit)
            put(gap - fit * n, kind + (n,) * fit, used)
            if times > used:
                put(gap, kind, times - used)
            c -= fit * used
    return [x for kinds in bins.values() for x in kinds]


def places(patterns: list[tuple[tuple[int, ...], int]]) -> list[tuple[int, int, int, int, int]]:
    """(length, from, below, first sequence, offset): pieces numbered from..below-1 of a length go to that offset of the sequences from the first on."""
    nth, first, out = defaultdict(int), 0, []
    for lengths, times in patterns:
        offset = 0
        for n in lengths:
            out.append((n, nth[n], nth[n] + times, first, offset))
            nth[n] += times
            offset += n
        first += times
    return out


def pieces(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    def run(batches):
        import zlib

        import pyarrow as pa
        from pyspark import TaskContext

        own, nth, task = encoder(tokenizer), defaultdict(int), TaskContext.get().partitionId()
        for b in batches:
            rows = []
            for d, ids in zip(b.column(0).to_pylist(), own.encode(b.column(1).to_pylist())):
                ids = np.append(ids, np.uint32(end_id)).astype("<u4")
                for k, (s, n) in enumerate(cut_pieces(len(ids), capacity)):
                    rows.append((d, k, s, n, zlib.crc32(ids[s:s + n].tobytes()), task, nth[n]))
                    nth[n] += 1
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64())
            cols = list(zip(*rows)) or [()] * 7
            yield pa.record_batch([pa.array(c, k) for c, k in zip(cols, kinds)], names=["doc_id", "piece", "start", "length", "ids_crc32", "task", "nth"])

    return narrow(docs, "text").mapInArrow(run, PIECES)


def pack(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of each piece."""
    spark = docs.sparkSession
    cut = materialize(pieces(docs, tokenizer, capacity, end_id), "pieces")
    per_task = materialize(cut.groupBy("length", "task").agg(F.count("*").alias("n")), "piece-counts")
    # one row a length, capacity rows at most
    counts = {r["length"]: r["n"] for r in per_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    ahead = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    bases = per_task.select("length", "task", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("base"))
    numbered = cut.join(bases, ["length", "task"]).withColumn("nth", F.col("nth") + F.col("base"))
    per_length: dict[int, list] = defaultdict(list)
    for n, lo, hi, first, offset in places(plan(counts, capacity)):
        per_length[n].append((lo, hi, first, offset))

    def run(batches):
        import pyarrow as pa

        table = {n: np.array(v, dtype=np.int64) for n, v in per_length.items()}
        for b in batches:
            length, nth = (b.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (3, 5))
            seq, off = np.zeros(len(nth), np.int64), np.zeros(len(nth), np.int64)
            for n in np.unique(length).tolist():
                who, t = np.flatnonzero(length == n), table[n]
                at = np.searchsorted(t[:, 0], nth[who], side="right") - 1
                seq[who], off[who] = t[at, 2] + nth[who] - t[at, 0], t[at, 3]
            yield pa.record_batch([*b.columns[:5], pa.array(seq), pa.array(off)], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return numbered.select("doc_id", "piece", "start", "length", "ids_crc32", "nth").mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
