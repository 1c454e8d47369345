"""SimHash near-duplicates by similarity: sets of word shingles with a Jaccard coefficient of 0.8 or more.

Candidates come from two SimHash words of 64 bits each: the fingerprint of ``simhash`` and one from its shingle hashes mixed once
more. At similarity J the shingle vectors' cosine is c = 2 J / (1 + J), and a bit differs with probability acos(c) / pi: 0.15 at
0.8, that is 9.7 of 64 and 19.4 of 128 bits. Texts are candidates if they differ in at most ``max_distance`` bits of the first
word and ``max_both`` of both, and their numbers of distinct shingles are within one step of 1.26 on a logarithmic scale (which
0.8 implies). With 15 and 28 that finds about 0.95 of the pairs at exactly 0.8 and nearly all from 0.85 on. Candidates are
compared by their shingle sets, as sorted 32-bit hashes; only pairs at ``similarity`` or more are linked.

The search is the generalised pigeonhole of ``simhash``: correlated bits share a part, and a
dynamic program allots each text thresholds t_1..t_m with sum max_distance - m + 1 from estimated candidate numbers and
keys to probe. A text files its part keys under its own length step and the next, and probes its own step, so of each
pair the longer text (or either) meets the other. Keys with over ``block`` filed texts are split by salt, probes going to
each salt; a task holds one such block and a bounded run of probes.

Two passes keep groups of near copies from making all their pairs. In the first each text passes on its ``NEAREST`` candidate of a
block by differing bits, so variants of a text meet that text rather than one another. The pairs of these that hold up give
components. The second passes on every pair of candidates from different components, so the components are those that all candidate pairs
give. Copies and near copies that are alike thus cost work in proportion; texts that are candidates without being alike, and what
is compared at one key, still grow with the square of their number. Probes cost about as much as ``PROBE_COST`` candidates.

Pairs are ruled out by maps of 256 bits before their sets are joined: a text lacks as many shingles of another, at least, as the other's map has
bits that its own has not.

Texts are nodes by their 64-bit hash, so copies share one. Texts without words are alike. Nulls, repeated rows and further
columns: as in ``simhash``. Empty table: no rows.
"""

from __future__ import annotations

from itertools import combinations
from math import comb

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.llm._common import chunks, materialize, narrow, partitions, release
from weftgraph.llm.components import connected_components
from weftgraph.llm.simhash import _bit_statistics, _bits, _sub_part_tables, _value, allocate, group_bits, keep_first, majority, shingle_hashes, SUB_BITS

STEP = 1.26
#: Share of all texts that one length step and its neighbour hold, for the estimates alone.
WINDOW = 0.15
PROBE_COST = 1000
#: Candidates of a text that a block passes on in the first pass; the second passes on all between components.
NEAREST = 1
#: Longs of a text's map of shingles.
MAPS = ["m0", "m1", "m2", "m3"]
FILED = "key long, node long, root long, fp long, fp2 long"
ROWS = "doc_id long, node long, fp long, fp2 long, n long, " + ", ".join(f"{m} long" for m in MAPS) + ", shingles binary"


def two_words(text: str, words_per_shingle: int):
    """Both SimHash words and the distinct shingles, as sorted 32-bit hashes."""
    import numpy as np

    h = shingle_hashes(text, words_per_shingle)
    mixed = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(29)
    second = majority((mixed * np.uint64(0xBF58476D1CE4E5B9)).astype("<u8"))
    return majority(h), second, np.unique(h.astype("<u4"))


def bit_map(shingles):
    """The bits that 32-bit hashes set, as MAPS longs."""
    import numpy as np

    bits = np.zeros(64 * len(MAPS), np.uint8)
    bits[shingles.astype(np.uint64) * np.uint64(len(bits)) >> np.uint64(32)] = 1
    return np.packbits(bits).view("<i8")


def jaccard(x, y) -> float:
    """Of two sorted arrays without repeats; 1 where both are empty."""
    import numpy as np

    if not len(x) or not len(y):
        return float(len(x) == len(y))
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both / (len(x) + len(y) - both)


def similar_documents(docs: DataFrame, words_per_shingle: int = 5, similarity: float = 0.8, max_distance: int = 15, max_both: int = 28,
                      parts: int | None = None, block: int = 4096) -> DataFrame:
    """doc_id, fp, text_hash and component_id (smallest doc_id that links reach) of each row."""
    def run(batches):
        import pyarrow as pa

        kinds = [pa.int64()] * (3 + len(MAPS)) + [pa.binary()]
        for b in batches:
            made = [(f, g, len(x), *bit_map(x).tolist(), x.tobytes()) for f, g, x in (two_words(t, words_per_shingle) for t in b.column(1).to_pylist())]
            cols = list(zip(*made)) or [()] * len(kinds)
            yield pa.record_batch([b.column(0), b.column(2), *[pa.array(c, k) for c, k in zip(cols, kinds)]], names=[x.split()[0] for x in ROWS.split(", ")])

    texts = narrow(docs, "text").withColumn("node", F.xxhash64("text"))
    rows = materialize(texts.mapInArrow(run, ROWS), "similar-rows")
    firsts = [F.first(c).alias(c) for c in ("fp", "fp2", "n", *MAPS)]
    nodes = materialize(rows.groupBy("node").agg(F.min("doc_id").alias("first_id"), *firsts), "similar-nodes")
    search = Search(nodes, max_distance, max_both, parts, block)
    ids = rows.select("doc_id", "node", "fp")
    if search.count < 2:
        return ids.join(nodes.select("node", "first_id"), "node").select("doc_id", "fp", F.col("node").alias("text_hash"), F.col("first_id").alias("component_id"))
    alone = nodes.select("node", F.col("node").alias("root"), "fp", "fp2", "n")
    links = verified(search.candidates(alone, True), nodes, rows, similarity)
    roots = materialize(connected_components(links), "similar-roots")
    grouped = alone.drop("root").join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("root"), "fp", "fp2", "n")
    more = verified(search.candidates(materialize(grouped, "similar-grouped"), False), nodes, rows, similarity)
    if not more.isEmpty():
        links = materialize(links.unionByName(more), "similar-all-links")
        release(roots, more)
        roots = materialize(connected_components(links), "similar-roots")
    release(links)
    named = nodes.join(roots, "node", "left").select("node", "first_id", F.coalesce("root", "node").alias("root"))
    lowest = named.groupBy("root").agg(F.min("first_id").alias("component_id"))
    classes = materialize(named.join(lowest, "root").select("node", "component_id"), "similar-classes")
    return ids.join(classes, "node", "left").select("doc_id", "fp", F.col("node").alias("text_hash"), "component_id")


def verified(pairs: DataFrame, nodes: DataFrame, rows: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) of nodes whose shingle sets are alike. rows: as similar_documents() makes them, several a node."""
    pairs = pairs.distinct()
    for c in "ab":
        pairs = pairs.join(nodes.select(F.col("node").alias(c), *[F.col(x).alias(f"{c}_{x}") for x in ("n", *MAPS)]), c)
    lacks = lambda x, y: sum(F.bit_count(F.col(f"{x}_{m}").bitwiseAND(F.bitwise_not(f"{y}_{m}"))) for m in MAPS)
    common = F.least(F.col("a_n") - lacks("a", "b"), F.col("b_n") - lacks("b", "a"))
    pairs = materialize(pairs.where(common * (1 + similarity) >= similarity * (F.col("a_n") + F.col("b_n")) - 1e-6).select("a", "b"), "similar-pairs")
    own = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(nodes.select("node", "first_id"), "node")
    own = own.select(F.col("node").alias("own"), "first_id")
    same = (F.col("node") == F.col("own")) & F.col("doc_id").eqNullSafe(F.col("first_id"))
    sets = materialize(rows.select("node", "doc_id", "shingles").join(own, same, "left_semi").select("node", "shingles"), "similar-sets")

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for b in batches:
            keep = [jaccard(np.frombuffer(x, "<u4"), np.frombuffer(y, "<u4")) >= similarity for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist())]
            yield b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    met = pairs
    for c in "ab":
        met = met.join(sets.select(F.col("node").alias(c), F.col("shingles").alias(f"{c}_set")), c)
    size = [F.octet_length(f"{c}_set") for c in "ab"]
    met = met.where(F.least(*size) >= similarity * F.greatest(*size) - 1e-9).select("a", "b", "a_set", "b_set")
    out = materialize(met.mapInArrow(run, "a long, b long").distinct(), "similar-links")
    release(pairs, sets)
    return out


def keep_one_of_similar(docs: DataFrame, **options) -> DataFrame:
    """docs with one row of each component, as simhash.keep_one_of_each."""
    return keep_first(docs, similar_documents(docs, **options))


class Search:
    """Finds candidates among nodes (node, fp, fp2, n). count: how many nodes there are."""

    def __init__(self, nodes: DataFrame, max_distance: int, max_both: int, parts: int | None = None, block: int = 4096):
        self.max_distance, self.max_both, self.block = max_distance, max_both, block
        self.count, together = _bit_statistics(nodes)
        if self.count < 2:
            return
        self.groups = group_bits(together, self.count, parts or _best_parts(self.count, max_distance))
        self.subs = [[g[i:i + SUB_BITS] for i in range(0, len(g), SUB_BITS)] for g in self.groups]
        self.near = _sub_part_tables(nodes, self.subs, self.count, max_distance)
        self.full = None

    def candidates(self, nodes: DataFrame, first: bool) -> DataFrame:
        """Pairs (a, b). nodes: node, root, fp, fp2, n; only nodes of different roots meet. first: the nearest pairs a node and
        block are passed on, else all."""
        spread = partitions(nodes.sparkSession)
        cols = nodes.select("node", "root", "fp", "fp2", "n")
        filed = cols.mapInArrow(_index_rows(self.groups), FILED)
        probes = cols.repartition(spread).mapInArrow(_probe_rows(self.groups, self.subs, self.near, self.count, self.max_distance), FILED)
        if self.full is None:
            sizes = filed.groupBy("key").agg(F.ceil(F.count("*") / self.block).cast("int").alias("blocks"))
            self.full = materialize(sizes.where("blocks > 1"), "similar-full")
        own, blocks = [x.split()[0] for x in FILED.split(", ")], F.coalesce("blocks", F.lit(1))
        dealt = filed.join(self.full, "key", "left").select(*own, F.pmod(F.xxhash64("node"), blocks).cast("int").alias("salt"), F.lit(False).alias("probe"))
        asked = probes.join(self.full, "key", "left").select(*own, F.explode(F.sequence(F.lit(0), blocks - 1)).alias("salt"), F.lit(True).alias("probe"))
        met = dealt.unionByName(asked).repartition(spread, "key", "salt").sortWithinPartitions("key", "salt", "probe")
        return met.mapInArrow(_meet(self.max_distance, self.max_both, first), "a long, b long")


def _best_parts(count: int, max_distance: int) -> int:
    """The number of parts of at most 16 bits with the least cost for count texts spread evenly."""
    def cost(m):
        width, spare, total = 64 / m, max_distance - m + 1, 0.0
        for i in range(m):
            t = (spare + m) // m - 1 + (i < (spare + m) % m)
            ball = sum(comb(round(width), d) for d in range(t + 1))
            total += ball * (PROBE_COST + WINDOW * count / 2 ** width)
        return total

    return min(range(4, max(5, min(max_distance + 2, 13))), key=cost)


def length_step(n):
    import numpy as np

    return np.floor(np.log(np.maximum(n, 1)) / np.log(STEP)).astype(np.int64)


def _keys(part: int, step, key):
    return (part << 32) | (step << 20) | key


def _columns(batch):
    import numpy as np

    return [batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("node", "root", "fp", "fp2", "n")]


def _index_rows(groups):
    def run(batches):
        import pyarrow as pa

        for b in batches:
            node, root, fp, fp2, n = _columns(b)
            bits, step = _bits(fp), length_step(n)
            for i, g in enumerate(groups):
                key = _value(bits, g)
                for more in (0, 1):
                    cols = (_keys(i, step + more, key), node, root, fp, fp2)
                    yield pa.record_batch([pa.array(x) for x in cols], names=["key", "node", "root", "fp", "fp2"])

    return run


def _probe_rows(groups, subs, near, count: int, max_distance: int):
    m, spare = len(groups), max_distance - len(groups) + 1

    def run(batches):
        import numpy as np
        import pyarrow as pa

        flips = [[np.array([sum(1 << j for j in c) for c in combinations(range(len(g)), d)], dtype=np.int64) for d in range(max_distance + 1)] for g in groups]
        sizes = [[len(f) for f in own] for own in flips]
        for b in batches:
            node, root, fp, fp2, n = _columns(b)
            bits, step = _bits(fp), length_step(n)
            chosen = allocate(bits, subs, near, WINDOW * count / PROBE_COST, max_distance, sizes, spare)
            for i, g in enumerate(groups):
                key = _value(bits, g)
                for d in range(max_distance + 1):
                    who, width = np.flatnonzero(chosen[:, i] >= d), len(flips[i][d])
                    if not width:
                        continue
                    run_of = max(1, 100_000 // width)
                    for at in range(0, len(who), run_of):
                        w = who[at:at + run_of]
                        keys = _keys(i, step[w][:, None], key[w][:, None] ^ flips[i][d][None, :]).ravel()
                        own = [pa.array(np.repeat(c[w], width)) for c in (node, root, fp, fp2)]
                        yield pa.record_batch([pa.array(keys), *own], names=["key", "node", "root", "fp", "fp2"])

    return run


def _meet(max_distance: int, max_both: int, first: bool, cells: int = 1 << 20):
    """Over rows sorted by key, salt and probe: candidate pairs of what is filed under a key and salt and what probes it."""
    def run(batches):
        import numpy as np
        import pyarrow as pa

        names = ("key", "salt", "node", "root", "fp", "fp2")
        held, filed = None, []
        for b in batches:
            key, salt, *rows = (b.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in names)
            probe = b.column("probe").to_numpy(zero_copy_only=False)
            out = []
            for x, y in chunks(np.stack([key, salt], axis=1)):
                own = (int(key[x]), int(salt[x]))
                if own != held:
                    held, filed = own, []
                cut = x + int(np.searchsorted(probe[x:y], True))
                if cut > x:
                    filed.append([c[x:cut] for c in rows])
                if cut == y or not filed:
                    continue
                filed = [[np.concatenate(c) for c in zip(*filed)]]
                run_of = max(1, cells // len(filed[0][0]))
                for at in range(cut, y, run_of):
                    out.append(_pairs(filed[0], [c[at:min(y, at + run_of)] for c in rows], max_distance, max_both, first))
            if out:
                yield pa.record_batch([pa.array(np.concatenate(c)) for c in zip(*out)], names=["a", "b"])

    return run


def _pairs(filed, probes, max_distance: int, max_both: int, first: bool):
    """(a, b) of the candidates that are passed on. filed, probes: arrays node, root, fp, fp2."""
    import numpy as np

    (node, root, f1, f2), (p_node, p_root, p1, p2) = filed, probes
    if (root == root[0]).all():  # one component is filed: its own texts need not meet it
        p_node, p_root, p1, p2 = (c[p_root != root[0]] for c in probes)
    i, j = np.nonzero(np.bitwise_count((f1[:, None] ^ p1[None, :]).view(np.uint64)) <= max_distance)
    far = np.bitwise_count((f1[i] ^ p1[j]).view(np.uint64)).astype(np.int64) + np.bitwise_count((f2[i] ^ p2[j]).view(np.uint64))
    good = (far <= max_both) & (root[i] != p_root[j])
    i, j, far = i[good], j[good], far[good]
    if not len(j):
        return node[:0], p_node[:0]
    if first:
        order = np.lexsort((p_node[j], node[i], far, j))
        i, j = i[order], j[order]
        start = np.maximum.accumulate(np.where(np.concatenate(([True], j[1:] != j[:-1])), np.arange(len(j)), 0))
        keep = np.arange(len(j)) - start < NEAREST
        i, j = i[keep], j[keep]
    a, b = node[i], p_node[j]
    return np.minimum(a, b), np.maximum(a, b)
