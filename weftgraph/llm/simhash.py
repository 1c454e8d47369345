"""SimHash near-duplicates by the generalised pigeonhole principle.

Words of a text (A-Z lower-cased, split at ASCII white space) form word shingles; bit i of the 64-bit
fingerprint is 1 if bit i is set in more than half of the shingles' XXH64 values (seed 42).

Fingerprints that differ in at most ``max_distance`` bits are linked. The search runs over *distinct*
fingerprints: the 64 bits are dealt to parts so that correlated bits share one, and each fingerprint gets
its own thresholds t_1..t_m (each at least -1) with sum max_distance - m + 1. Two fingerprints within
max_distance then are within t_i on some part i, for either side's thresholds. The thresholds come from a
dynamic program over the estimated number of candidates (histograms over all fingerprints of sub-parts of
at most 11 bits, taken as independent) plus the number of keys to probe. Every fingerprint files its m part
keys, probes the keys of its balls, and pairs are verified bit by bit.

Keys under which many fingerprints meet are not paired: their members, for up to two bits, file the 65 keys
of their radius-1 ball instead. Two fingerprints share such a key exactly if they differ in two bits at most,
and no key has more than 65 members, so the work stays linear. Beyond two bits the members of such a key are
compared block against block, and each pair of blocks passes on a spanning forest only.

Null text: empty. Texts without words have fingerprint zero and are linked like any other. Null doc_id: the
row is linked like any other, but a component's id is the smallest that is not null (null if there is none).
Repeated rows: each is returned. Other columns of the input are ignored. Empty table: no rows.
"""

from __future__ import annotations

from itertools import combinations
from math import comb

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.llm._common import ROW, materialize, narrow, release, rows_of, with_row
from weftgraph.llm.components import connected_components

SUB_BITS = 11


def shingle_hashes(text: str, words_per_shingle: int):
    """XXH64 values (seed 42) of a text's word shingles, repeats included; none for a text without words."""
    import numpy as np
    import xxhash

    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, dtype="<u8")
    joined, k = b" ".join(words), words_per_shingle
    if len(words) <= k:
        return np.array([xxhash.xxh64_intdigest(joined, 42)], dtype="<u8")
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1)).tolist()
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[a:b], 42) for a, b in zip(starts, ends[k - 1:].tolist())], dtype="<u8")


def majority(values) -> int:
    """The bits set in over half of the values, as a signed 64-bit integer."""
    import numpy as np

    n = len(values)
    h = values.view(np.uint8).reshape(n, 8)
    votes = np.zeros(64, dtype=np.int64)
    for at in range(0, n, 4096):
        votes += np.unpackbits(h[at:at + 4096], axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(votes * 2 > n, bitorder="little").view("<i8")[0])


def fingerprint_of(text: str, words_per_shingle: int) -> int:
    """The fingerprint as a signed 64-bit integer."""
    return majority(shingle_hashes(text, words_per_shingle))


def fingerprints(docs: DataFrame, words_per_shingle: int = 5) -> DataFrame:
    """doc_id, fp (long, the 64 bits as a signed number) and text_hash of each row."""
    def run(batches):
        import pyarrow as pa

        for b in batches:
            yield pa.record_batch([b.column(0), pa.array([fingerprint_of(t, words_per_shingle) for t in b.column(1).to_pylist()], pa.int64()), b.column(2)], names=["doc_id", "fp", "text_hash"])

    return narrow(docs, "text").withColumn("text_hash", F.xxhash64("text")).mapInArrow(run, "doc_id long, fp long, text_hash long")


def near_duplicates(docs: DataFrame, words_per_shingle: int = 5, max_distance: int = 3, parts: int | None = None,
                    hot_pairs: int = 1024) -> DataFrame:
    """doc_id, fp, text_hash and component_id (smallest doc_id that links reach) of each row."""
    rows = materialize(fingerprints(docs, words_per_shingle), "fingerprints")
    nodes = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "fingerprint-nodes")
    edges = links(nodes.select("fp"), max_distance, parts, hot_pairs)
    if edges is None:
        return rows.join(nodes, "fp", "left").select("doc_id", "fp", "text_hash", F.col("first_id").alias("component_id"))
    roots = materialize(connected_components(edges), "fingerprint-roots")
    named = nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root"))
    lowest = named.groupBy("root").agg(F.min("first_id").alias("component_id"))
    classes = materialize(named.join(lowest, "root").select("fp", "component_id"), "fingerprint-classes")
    return rows.join(classes, "fp", "left").select("doc_id", "fp", "text_hash", "component_id")


def links(nodes: DataFrame, max_distance: int, parts: int | None = None, hot_pairs: int = 1024) -> DataFrame | None:
    """Pairs (a, b) of the distinct fingerprints in column fp that connect all within max_distance; None if there are under two."""
    count, together = _bit_statistics(nodes)
    if count < 2:
        return None
    m = parts or _best_parts(count, max_distance)
    groups = group_bits(together, count, m)
    subs = [[g[i:i + SUB_BITS] for i in range(0, len(g), SUB_BITS)] for g in groups]
    near = _sub_part_tables(nodes, subs, count, max_distance)
    filed = materialize(_filed(nodes, groups, subs, near, count, max_distance), "filed")
    met = filed.groupBy("part", "key").agg(
        F.sum(F.col("probe").cast("long")).alias("n_probe"), F.sum((~F.col("probe")).cast("long")).alias("n_index"),
        F.min("fp").alias("lo"), F.max("fp").alias("hi"),
    ).where("n_probe > 0 and n_index > 0 and lo < hi").select("part", "key", (F.col("n_probe") * F.col("n_index") > hot_pairs).alias("hot"))
    live = materialize(filed.join(met, ["part", "key"]), "filed-live")
    release(filed)
    light = live.where("not hot")
    a, b = light.where("probe").select("part", "key", F.col("fp").alias("a")), light.where("not probe").select("part", "key", F.col("fp").alias("b"))
    pairs = a.join(b, ["part", "key"]).where((F.col("a") != F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_distance)).select("a", "b")
    hot = live.where("hot")
    dense = _ball_edges(hot.select("fp").distinct(), max_distance) if max_distance <= 2 else _block_edges(hot.select("part", "key", "fp").distinct(), max_distance)
    return pairs.unionByName(dense)


def _bits(fps):
    """A numpy matrix (fingerprints x 64) of 0 and 1."""
    import numpy as np

    return np.unpackbits(np.ascontiguousarray(fps, dtype="<i8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def _bit_statistics(nodes: DataFrame):
    """How many fingerprints there are, and how often bits i and j are set together, over all of them."""
    import numpy as np

    def run(batches):
        import pyarrow as pa

        n, total = 0, np.zeros((64, 64), dtype=np.int64)
        for b in batches:
            x = _bits(b.column(0).to_numpy(zero_copy_only=False)).astype(np.float32)
            n += len(x)
            total += (x.T @ x).astype(np.int64)
        at = np.flatnonzero(total.ravel())
        yield pa.record_batch([pa.array(np.append(at, 4096).astype(np.int32)), pa.array(np.append(total.ravel()[at], n))], names=["at", "n"])

    # the table has one number a row, so a few hundred tasks hold it at any size
    got = nodes.select("fp").coalesce(256).mapInArrow(run, "at int, n long").groupBy("at").agg(F.sum("n").alias("n")).collect()
    flat = np.zeros(4097, dtype=np.float64)
    for r in got:
        flat[r["at"]] = r["n"]
    return int(flat[4096]), flat[:4096].reshape(64, 64)


def _best_parts(count: int, max_distance: int) -> int:
    """The number of parts with the fewest probes and chance candidates for count fingerprints spread evenly."""
    def cost(m):
        width, spare, total = 64 / m, max_distance - m + 1, 0.0
        for i in range(m):
            t = (spare + m) // m - 1 + (i < (spare + m) % m)
            ball = sum(comb(round(width), d) for d in range(t + 1))
            total += ball * (1 + count / 2 ** width)
        return total

    return min(range(1, min(max_distance + 1, 8) + 1), key=cost)


def group_bits(together, count: int, m: int) -> list[list[int]]:
    """Deals 64 bits to m parts of like size; each part grows by the free bit most correlated with it."""
    import numpy as np

    p = np.diag(together) / count
    sd = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    corr = np.abs((together / count - np.outer(p, p)) / np.outer(sd, sd))
    np.fill_diagonal(corr, 0)
    free, out = list(range(64)), []
    for k in range(m):
        size = 64 // m + (k < 64 % m)
        own = [free.pop(int(np.argmax(corr[np.ix_(free, free)].max(axis=1))))]
        while len(own) < size:
            own.append(free.pop(int(np.argmax(corr[np.ix_(free, own)].mean(axis=1)))))
        out.append(sorted(own))
    return out


def _sub_part_tables(nodes: DataFrame, subs, count: int, max_distance: int):
    """For each sub-part, value and distance d: the share of all fingerprints at distance d from the value there."""
    import numpy as np

    flat = [s for part in subs for s in part]

    def run(batches):
        import pyarrow as pa

        total = [np.zeros(1 << len(s), dtype=np.int64) for s in flat]
        for b in batches:
            bits = _bits(b.column(0).to_numpy(zero_copy_only=False))
            for s, into in zip(flat, total):
                into += np.bincount(_value(bits, s), minlength=len(into))
        for k, into in enumerate(total):
            at = np.flatnonzero(into)
            yield pa.record_batch([pa.array(np.full(len(at), k, np.int32)), pa.array(at.astype(np.int32)), pa.array(into[at])], names=["k", "v", "n"])

    got = nodes.select("fp").coalesce(256).mapInArrow(run, "k int, v int, n long").groupBy("k", "v").agg(F.sum("n").alias("n")).collect()
    counts = [np.zeros(1 << len(s)) for s in flat]
    for r in got:
        counts[r["k"]][r["v"]] = r["n"]
    tables, it = [], iter(counts)
    for part in subs:
        own = []
        for _ in part:
            c = next(it)
            values = np.arange(len(c))
            d = np.bitwise_count((values[:, None] ^ values[None, :]).astype(np.uint16))
            own.append(np.stack([(d == e) @ c for e in range(max_distance + 1)], axis=1) / count)
        tables.append(own)
    return tables


def _value(bits, own):
    import numpy as np

    out = np.zeros(len(bits), dtype=np.int64)
    for j, bit in enumerate(own):
        out |= bits[:, bit].astype(np.int64) << j
    return out


def _filed(nodes: DataFrame, groups, subs, near, count: int, max_distance: int) -> DataFrame:
    """Each fingerprint's part keys (probe false), and the keys it probes under its own thresholds (probe true)."""
    m, spare = len(groups), max_distance - len(groups) + 1

    def run(batches):
        import numpy as np
        import pyarrow as pa

        flips = []
        for g in groups:
            flips.append([np.array([sum(1 << j for j in c) for c in combinations(range(len(g)), d)], dtype=np.int64) for d in range(max_distance + 1)])
        for b in batches:
            fps = b.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            bits = _bits(fps)
            keys = [_value(bits, g) for g in groups]
            chosen = allocate(bits, subs, near, count, max_distance, [[len(f) for f in own] for own in flips], spare)
            for i in range(m):
                yield _rows(pa, np, i, keys[i], fps, False)
                for d in range(max_distance + 1):
                    who = np.flatnonzero(chosen[:, i] >= d)
                    step = max(1, 200_000 // max(1, len(flips[i][d])))
                    for at in range(0, len(who), step):
                        w = who[at:at + step]
                        k = (keys[i][w][:, None] ^ flips[i][d][None, :]).ravel()
                        yield _rows(pa, np, i, k, np.repeat(fps[w], len(flips[i][d])), True)

    return nodes.select("fp").mapInArrow(run, "part int, key long, fp long, probe boolean")


def _rows(pa, np, part, keys, fps, probe):
    return pa.record_batch([pa.array(np.full(len(keys), part, np.int32)), pa.array(keys), pa.array(fps), pa.array(np.full(len(keys), probe))], names=["part", "key", "fp", "probe"])


def allocate(bits, subs, near, count: int, max_distance: int, ball_sizes, spare: int):
    """Thresholds (fingerprints x parts) with sum spare, each at least -1, of least estimated cost: a dynamic program over the parts."""
    import numpy as np

    n, m = len(bits), len(subs)
    cost = np.zeros((m, max_distance + 2, n))
    for i in range(m):
        dist = np.zeros((max_distance + 1, n))
        dist[0] = 1
        for own, table in zip(subs[i], near[i]):
            at = table[_value(bits, own)].T
            dist = np.stack([sum(dist[e] * at[d - e] for e in range(d + 1)) for d in range(max_distance + 1)])
        cost[i, 1:] = np.cumsum(dist, axis=0) * count + np.cumsum(ball_sizes[i])[:, None]
    sums = spare + m  # of t_i + 1
    best = np.full((sums + 1, n), np.inf)
    best[0] = 0
    back = np.zeros((m, sums + 1, n), dtype=np.int8)
    for i in range(m):
        then = np.full((sums + 1, n), np.inf)
        for s in range(sums + 1):
            for e in range(min(s, max_distance + 1) + 1):
                c = best[s - e] + cost[i, e]
                better = c < then[s]
                then[s][better] = c[better]
                back[i, s][better] = e
        best = then
    out, left, each = np.zeros((n, m), dtype=np.int64), np.full(n, sums), np.arange(n)
    for i in reversed(range(m)):
        e = back[i, left, each].astype(np.int64)
        out[:, i], left = e - 1, left - e
    return out


def _ball_edges(fps: DataFrame, max_distance: int) -> DataFrame:
    """Links of distinct fingerprints within two bits: both share a key of their radius-1 balls, which has 65 members at most.
    Within one bit: the key itself is one of them."""
    masks = F.array(F.lit(0).cast("long"), *[F.lit(1 << i if i < 63 else -(1 << 63)).cast("long") for i in range(64 if max_distance else 0)])
    balls = fps.select("fp", F.explode(masks).alias("mask")).select("fp", F.col("fp").bitwiseXOR(F.col("mask")).alias("ball"))
    met = balls.groupBy("ball").agg(F.min("fp").alias("a"), F.collect_list("fp").alias("all")).where(F.size("all") > 1)
    if max_distance < 2:
        met = met.where(F.array_contains("all", F.col("ball"))).withColumn("a", F.col("ball"))
    return met.select("a", F.explode("all").alias("b")).where("a <> b")


def _block_edges(members: DataFrame, max_distance: int, block: int = 1024) -> DataFrame:
    """Links within keys that many fingerprints share: blocks of members meet pairwise and pass on a spanning forest."""
    sizes = members.groupBy("part", "key").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    dealt = members.join(sizes, ["part", "key"]).withColumn("own", F.pmod(F.xxhash64("fp", F.lit(7)), F.col("blocks")).cast("int"))
    meet = dealt.select("part", "key", "fp", "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    meet = meet.select("part", "key", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "fp")

    def run(table):
        import numpy as np
        import pyarrow as pa

        fps = np.unique(table.column("fp").to_numpy().astype(np.int64))
        todo, a, b = np.ones(len(fps), dtype=bool), [], []
        while todo.any():
            front = [int(np.argmax(todo))]
            todo[front[0]] = False
            while front:
                x = front.pop()
                left = np.flatnonzero(todo)
                got = left[np.bitwise_count((fps[left] ^ fps[x]).view(np.uint64)) <= max_distance]
                todo[got] = False
                a += [fps[x]] * len(got)
                b += fps[got].tolist()
                front += got.tolist()
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return meet.groupBy("part", "key", "x", "y").applyInArrow(run, "a long, b long")


def keep_one_of_each(docs: DataFrame, words_per_shingle: int = 5, max_distance: int = 3, **options) -> DataFrame:
    """docs with one row of each component: the one with the smallest doc_id. Of rows that repeat that doc_id one stays.

    Rows with null doc_id stay only where their whole component has none; then all of them stay."""
    return keep_first(docs, near_duplicates(docs, words_per_shingle, max_distance, **options))


def keep_first(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """docs with the row of each class that has its component_id as doc_id; classes as of near_duplicates()."""
    stay = classes.where("doc_id <=> component_id").select(F.col("doc_id").alias("id"), F.col("text_hash").alias("hash")).distinct()
    th = F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))
    # of rows that repeat a doc_id the one with the least hash of its columns (maps have none) stays
    order = F.xxhash64(*[F.col(f"`{f.name}`") for f in docs.schema.fields if "map<" not in f.dataType.simpleString()])
    marked = with_row(docs, own_id=F.col("doc_id").cast("long"), own_th=th, lone=F.when(F.col("doc_id").isNull(), F.monotonically_increasing_id()), place=order)
    met = marked.join(stay, F.col("own_id").eqNullSafe(F.col("id")) & (F.col("own_th") == F.col("hash")), "left_semi")
    return rows_of(met.groupBy("own_id", "lone").agg(F.min_by(ROW, "place").alias(ROW)), docs.columns)
