"""All documents whose SpotSigs fingerprints have a Jaccard coefficient of ``threshold`` or more, by set length.

Distinct signature sets are the nodes; copies of a text share one. A global order puts rare signatures first. Two sets
that are alike share one of the first n - ceil(t n) + 1 signatures of each, so only these are filed; signatures of a single
set come first and need no filing. Sets are partitioned by length on a logarithmic scale one step of which is 1 / t wide:
a set meets only sets of its own partition and of the next shorter one. Under a signature and partition a pair is pruned,
without loss, by three bounds on its overlap: the lengths, the places of the signature in both sets, and the number of
differing bits in 256-bit maps of the sets. What is left is compared in full.

Two passes keep groups of near copies from making all their pairs. The first compares each set with the one before it
under each signature, which is linear; the components it finds need no more links inside. The second compares all pairs of
different components. Signatures under which over ``block`` sets are filed are split by salt, probes going to each salt,
so a task holds one block. Pairs that pass all bounds but are not alike still grow with the square of their number.

Null text: empty; empty sets are alike. Repeated rows: each is returned. Null doc_id: takes the component of its
set; a component of null ids only has a null id. Further columns are not read. Empty table: no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.llm._common import chunks, materialize, narrow, partitions
from weftgraph.llm.components import connected_components
from weftgraph.llm.spotsigs import Fingerprinter

#: At most so many signatures have this share of all filed ones; they are broadcast, the others are joined by hash.
HEAVY = 50_000
MAPS = ["b0", "b1", "b2", "b3"]
SLACK = 1e-9


def similar_documents(docs: DataFrame, threshold: float = 0.8, chain: int = 2, distance: int = 2, block: int = 4096) -> DataFrame:
    """doc_id, n_signatures and component_id (smallest doc_id that links reach) of each row."""
    if not 0 < threshold <= 1:
        raise ValueError("threshold: over 0, at most 1")

    schema = "doc_id long, node long, n int, signatures array<int>, " + ", ".join(f"{b} long" for b in MAPS)
    rows = materialize(narrow(docs, "text").mapInArrow(_sets(chain, distance), schema), "spot-sets")
    sets = materialize(rows.groupBy("node").agg(F.min("doc_id").alias("first_id"), *[F.first(c).alias(c) for c in ("n", "signatures", *MAPS)]), "spot-nodes")
    roots = materialize(connected_components(alike(sets, threshold, block)), "spot-roots")
    named = sets.select("node", "first_id").join(roots, "node", "left").select("node", "first_id", F.coalesce("root", "node").alias("root"))
    classes = named.join(named.groupBy("root").agg(F.min("first_id").alias("component_id")), "root").select("node", "component_id")
    return rows.select("doc_id", "node", F.col("n").alias("n_signatures")).join(classes, "node").select("doc_id", "n_signatures", "component_id")


def alike(sets: DataFrame, threshold: float = 0.8, block: int = 4096) -> DataFrame:
    """Pairs (a, b) of nodes that connect all nodes whose sets are alike; each pair is alike itself."""
    spread = partitions(sets.sparkSession)
    filed = materialize(_prefixes(sets, threshold), "spot-filed")
    full = materialize(filed.groupBy("sig", "part").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks")).where("blocks > 1"), "spot-full")
    blocks = F.coalesce("blocks", F.lit(1))

    own = filed.join(full, ["sig", "part"], "left").withColumn("salt", F.pmod(F.xxhash64("node"), blocks).cast("int")).drop("blocks")
    order = own.repartition(spread, "sig", "part", "salt").sortWithinPartitions("sig", "part", "salt", "n", "node")
    first = materialize(_verified(order.mapInArrow(_neighbours(threshold), "a long, b long"), sets, threshold), "spot-first")
    groups = materialize(connected_components(first), "spot-groups")

    named = own.join(groups, "node", "left").withColumn("root", F.coalesce("root", "node"))
    probing = named.drop("salt").withColumn("part", F.explode(F.array(F.col("part"), F.col("part") - 1))).join(full, ["sig", "part"], "left")
    probing = probing.withColumn("salt", F.explode(F.sequence(F.lit(0), blocks - 1))).drop("blocks")
    met = named.withColumn("probe", F.lit(False)).unionByName(probing.withColumn("probe", F.lit(True)))
    met = met.repartition(spread, "sig", "part", "salt").sortWithinPartitions("sig", "part", "salt", "probe")
    second = _verified(met.mapInArrow(_meet(threshold), "a long, b long"), sets, threshold)
    return first.unionByName(second)


def _sets(chain: int, distance: int):
    def run(batches):
        import numpy as np
        import pyarrow as pa
        import xxhash

        maker = Fingerprinter(chain, distance)
        for b in batches:
            made = [maker.signatures(t) for t in b.column(1).to_pylist()]
            nodes = np.array([xxhash.xxh64_intdigest(s.tobytes()) for s in made], dtype=np.uint64).view(np.int64)
            maps = np.zeros((len(made), 256), dtype=np.uint8)
            for i, s in enumerate(made):
                maps[i, s & np.uint32(255)] = 1
            words = np.packbits(maps, axis=1).view(np.int64)
            sets = [s.view(np.int32) for s in made]
            at = np.cumsum([0, *map(len, sets)])
            flat = np.concatenate(sets) if sets else np.zeros(0, dtype=np.int32)
            columns = [b.column(0), pa.array(nodes), pa.array(np.diff(at), pa.int32()), pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(flat))]
            yield pa.record_batch([*columns, *[pa.array(np.ascontiguousarray(words[:, k])) for k in range(4)]], names=["doc_id", "node", "n", "signatures", *MAPS])

    return run


def _prefixes(sets: DataFrame, threshold: float) -> DataFrame:
    """sig, part, node, n, pos and the map of each signature that a set must be filed under."""
    each = sets.select("node", F.explode("signatures").alias("sig"))
    counts = materialize(each.groupBy("sig").agg(F.count("*").alias("f")).where("f > 1"), "spot-counts")
    total = counts.agg(F.sum("f")).first()[0] or 0
    heavy = F.col("f") * HEAVY >= total
    ranked = each.join(F.broadcast(counts.where(heavy)), "sig").unionByName(each.join(counts.where(~heavy), "sig"))
    # one text's own signatures, rare ones first
    lists = ranked.groupBy("node").agg(F.sort_array(F.collect_list(F.struct("f", "sig"))).alias("shared"))
    n, alone = F.col("n"), F.col("n") - F.size("shared")
    first = n - F.ceil(n * threshold - SLACK) + 1 - alone
    step = F.col("n") if threshold == 1 else F.floor(F.log(n.cast("double")) / (-math.log(threshold) * (1 + SLACK)))
    rows = lists.join(sets.drop("signatures", "first_id"), "node").where(first > 0)
    rows = rows.select("node", "n", *MAPS, step.cast("int").alias("part"), alone.alias("alone"), F.posexplode(F.slice("shared", F.lit(1), first.cast("int"))).alias("at", "x"))
    return rows.select("x.sig", "part", "node", "n", (F.col("at") + F.col("alone")).cast("int").alias("pos"), *MAPS)


def _verified(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """The pairs whose sets are alike, by the full Jaccard coefficient."""
    one, two = (sets.select(F.col("node").alias(x), F.col("n").alias(f"n_{x}"), F.col("signatures").alias(f"s_{x}")) for x in "ab")
    met = pairs.distinct().join(one, "a").join(two, "b")
    both = F.size(F.array_intersect("s_a", "s_b"))
    return met.where(both / (F.col("n_a") + F.col("n_b") - both) >= threshold).select("a", "b")


def _columns(batch):
    import numpy as np

    n, pos = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("n", "pos"))
    maps = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in MAPS], axis=-1).view(np.uint64)
    node = batch.column("node").to_numpy(zero_copy_only=False).astype(np.int64)
    key = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("sig", "part", "salt")], axis=1)
    return key, node, n, pos, maps


def may_be_alike(n1, pos1, maps1, n2, pos2, maps2, threshold: float):
    """False where the bounds on the overlap rule a pair out (arrays that broadcast; maps have a last axis of 4)."""
    import numpy as np

    least = threshold / (1 + threshold) * (n1 + n2) - SLACK
    good = (np.minimum(n1, n2) >= threshold * np.maximum(n1, n2) - SLACK) & (np.minimum(n1 - pos1, n2 - pos2) >= least)
    if good.any():
        differ = np.bitwise_count(maps1 ^ maps2).sum(axis=-1, dtype=np.int64)
        good &= (n1 + n2 - differ) >= 2 * least
    return good


def _neighbours(threshold: float):
    def run(batches):
        import numpy as np
        import pyarrow as pa

        last = None
        for b in batches:
            now = _columns(b)
            if not len(now[0]):
                continue
            if last is not None:
                now = tuple(np.concatenate((x, y)) for x, y in zip(last, now))
            last = tuple(x[-1:] for x in now)
            key, node, n, pos, maps = now
            good = (key[1:] == key[:-1]).all(axis=1) & may_be_alike(n[1:], pos[1:], maps[1:], n[:-1], pos[:-1], maps[:-1], threshold)
            yield pa.record_batch([pa.array(node[:-1][good]), pa.array(node[1:][good])], names=["a", "b"])

    return run


def _meet(threshold: float, cells: int = 1 << 18):
    """Over rows sorted by key and probe: what is filed under a key with the longer sets of other components that probe it."""
    def run(batches):
        import numpy as np
        import pyarrow as pa

        held, filed = None, []
        for b in batches:
            key, node, n, pos, maps = _columns(b)
            root = b.column("root").to_numpy(zero_copy_only=False).astype(np.int64)
            probe = b.column("probe").to_numpy(zero_copy_only=False)
            rows = (node, n, pos, maps, root)
            for x, y in chunks(key):
                if held is None or tuple(key[x]) != held:
                    held, filed = tuple(key[x]), []
                cut = x + int(np.searchsorted(probe[x:y], True))
                if cut > x:
                    filed.append(tuple(c[x:cut] for c in rows))
                if cut == y or not filed:
                    continue
                filed = [tuple(np.concatenate(c) for c in zip(*filed))]
                node1, n1, pos1, maps1, root1 = (c[:, None] for c in filed[0])
                run_of = max(1, cells // len(node1))
                for at in range(cut, y, run_of):
                    node2, n2, pos2, maps2, root2 = (c[None, at:min(y, at + run_of)] for c in rows)
                    good = (root1 != root2) & ((n2 > n1) | ((n2 == n1) & (node2 > node1)))
                    if good.any():
                        i, j = np.nonzero(good)
                        keep = may_be_alike(n1[i, 0], pos1[i, 0], maps1[i, 0], n2[0, j], pos2[0, j], maps2[0, j], threshold)
                        if keep.any():
                            yield pa.record_batch([pa.array(node1[i[keep], 0]), pa.array(node2[0, j[keep]])], names=["a", "b"])

    return run
