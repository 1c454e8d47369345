"""How much each of many roots reaches, without a row for each root and node.

Components are condensed to one node each, and roots of one component, which reach the same, are one root. Roots are numbered and stand as
bits of 64-bit words, which pass along the edges a hop a round, joined by bit_or; only bits that a node has not seen go on. Nodes from
which no edge leads on take no part in the rounds: at the end each gathers the words of the nodes before it, once. A node has a row for 64
roots at most, so rows are at most roots times nodes in the worst case of single bits and a 64th of it where roots share what they reach.
Counts are sums over the bits of a word, 64 at once. Everything is a DataFrame function; rounds are the longest distance between components.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.operators import traverse
from weftgraph.plans.scratch import counted, new_path, stored

BITS = 64
#: Up to so many roots before nothing but outer nodes are bits as others are.
FEW = 64
#: Pairs of a chunk of outer nodes, words that a pair carries at most, bytes of a table of long lists in a task.
CHUNK, LIGHT, TABLE = 1_000_000, 16, 256 << 20
WORDS = "at string, block long, bits long"


class Hops(NamedTuple):
    """Distinct pairs (at, next) by what comes after them; outer has leafy: whether leaves hang on next."""

    inner: DataFrame
    outer: DataFrame


def split(adjacent: DataFrame, leaves: DataFrame | None = None) -> Hops:
    """adjacent: (at, next), repeated or not. inner are the pairs from whose next others go on, outer the rest. One join by next serves both
    and makes the pairs distinct; outer pairs, mostly the bulk, are in no component and are not joined in the rounds."""
    spark, path = adjacent.sparkSession, new_path(adjacent.sparkSession, "hops")
    pairs = adjacent.select("at", "next").where("at <> next")
    marks = pairs.select(F.col("at").alias("next"), F.lit(True).alias("inner"), F.lit(False).alias("leafy"))
    if leaves is not None:
        marks = marks.unionByName(leaves.select(F.col("node").alias("next"), F.lit(False).alias("inner"), F.lit(True).alias("leafy")))
    marks = marks.groupBy("next").agg(F.max("inner").alias("inner"), F.max("leafy").alias("leafy"))
    no = F.lit(False)
    marked = pairs.join(marks, "next", "left").select("at", "next", F.coalesce("inner", no).alias("inner"), F.coalesce("leafy", no).alias("leafy")).distinct()
    marked.write.partitionBy("inner").parquet(path)
    kept = spark.read.schema("at string, next string, leafy boolean, inner boolean").parquet(path)
    return Hops(kept.where("inner").select("at", "next"), kept.where("not inner").select("at", "next", "leafy"))


def numbered(roots: DataFrame) -> DataFrame:
    """(root, id): neighbours by name have ids in a row."""
    return stored(roots.select("root").where("root is not null").distinct().orderBy("root").withColumn("id", F.monotonically_increasing_id()), "root-ids")


def _spread(start: DataFrame, pairs: DataFrame, max_depth: int | None) -> DataFrame:
    """start: at, block, bits. (at, block, bits, depth): the words of all nodes that the bits come to, a row a round in which new ones came;
    bits are disjoint."""
    spark, path, depth = start.sparkSession, new_path(start.sparkSession, "words"), 0
    pairs = pairs.repartition("at").persist()
    more = counted(start, f"{path}/depth=0")
    while more and (max_depth is None or depth < max_depth):
        level = spark.read.schema(WORDS).parquet(f"{path}/depth={depth}")
        met = level.join(pairs, "at").groupBy(F.col("next").alias("at"), "block").agg(F.bit_or("bits").alias("bits"))
        seen = spark.read.schema(WORDS).option("recursiveFileLookup", "true").parquet(path).groupBy("at", "block").agg(F.bit_or("bits").alias("had"))
        new = met.join(seen, ["at", "block"], "left").withColumn("bits", F.col("bits").bitwiseAND(F.bitwise_not(F.coalesce("had", F.lit(0))))).where("bits <> 0")
        depth += 1
        more = counted(new.select("at", "block", "bits"), f"{path}/depth={depth}")
    pairs.unpersist()
    return spark.read.schema(f"{WORDS}, depth int").parquet(path)


def _bit_sums(words: DataFrame) -> DataFrame:
    """words: kind, block, bits, weight. (kind, id, n): the weights of the words that have the id's bit."""
    sums = [F.sum(F.shiftrightunsigned("bits", i).bitwiseAND(1) * F.col("weight")).alias(f"b{i}") for i in range(BITS)]
    per = words.groupBy("kind", "block").agg(*sums).select("kind", "block", F.posexplode(F.array(*[f"b{i}" for i in range(BITS)])).alias("bit", "n"))
    return per.where("n > 0").select("kind", (F.col("block") * BITS + F.col("bit")).alias("id"), "n")


def components(adjacent: DataFrame, wider: DataFrame | None = None) -> DataFrame:
    """(node, component, size) of the components of adjacent (at, next). wider: those of a graph that has these pairs and more; each
    component is inside one of them, so only pairs inside them are searched."""
    pairs = adjacent.where("at <> next").toDF("src", "dst")
    if wider is not None:
        one, two = (wider.select(F.col("node").alias(c), F.col("component").alias(f"{c}_c")) for c in ("src", "dst"))
        pairs = pairs.join(one, "src").join(two, "dst").where("src_c = dst_c").select("src", "dst")
    return stored(traverse.strongly_connected(pairs).select("node", "component", "size"), "components")


def _condensed(inner: DataFrame, of: DataFrame) -> tuple:
    """(what names a column's nodes by their components, the pairs between components)."""
    named = lambda rows, c: rows.join(of.select(F.col("node").alias(c), F.col("component").alias("_c")), c, "left").withColumn(c, F.coalesce("_c", c)).drop("_c")
    return named, named(named(inner, "at"), "next").where("at <> next").distinct()


def _at_leaves(words: DataFrame, passing: DataFrame, outer: DataFrame, leaves: DataFrame, named, *more: str) -> DataFrame:
    """(kind, leaf, block, bits), repeated or not: the words that come to a leaf's nodes; passing are those that go on to outer nodes. more: further columns."""
    hung = leaves.select(F.col("node").alias("at"), "kind", "leaf")
    after = outer.where("leafy").join(hung.withColumnRenamed("at", "next"), "next").select("at", "kind", "leaf")
    met = [of_words.join(named(on, "at").distinct(), "at").select("kind", "leaf", "block", "bits", *more) for of_words, on in ((words, hung), (passing, after))]
    return met[0].unionByName(met[1])


def reached_leaves(adjacent: DataFrame | Hops, roots: DataFrame, leaves: DataFrame, of: DataFrame | None = None) -> DataFrame:
    """(kind, leaf), distinct: the leaves of the roots and of what any of them reaches; arguments as in reach_counts(). All roots are one bit, so a node has a row."""
    inner, outer = adjacent if isinstance(adjacent, Hops) else split(adjacent, leaves)
    named, inner = _condensed(inner, components(inner) if of is None else of)
    placed = named(roots.select(F.col("root").alias("at")).where("at is not null").distinct(), "at").distinct()
    words = _spread(placed.select("at", F.lit(0).cast("long").alias("block"), F.lit(1).cast("long").alias("bits")), inner, None)
    return _at_leaves(words, words, outer, leaves, named).select("kind", "leaf").distinct()


def reach_counts(adjacent: DataFrame | Hops, roots: DataFrame, leaves: DataFrame | None = None, max_depth: int | None = None, of: DataFrame | None = None) -> DataFrame:
    """(root, kind, n) for n over 0: kind 'node' counts the other nodes that a root reaches along adjacent (at, next), in max_depth hops at
    most. leaves: (node, kind, leaf), more that hangs on nodes; a kind counts the distinct leaves of the root and what it reaches.
    adjacent may be split() already, with the same leaves. of: components() of its inner pairs, where they are known."""
    inner, outer = adjacent if isinstance(adjacent, Hops) else split(adjacent, leaves)
    roots, one = roots.select("root").where("root is not null").distinct(), F.lit(1).cast("long")
    named, sizes = (lambda rows, c: rows), None
    if max_depth is None:
        of = components(inner) if of is None else of
        named, inner = _condensed(inner, of)
        inner = stored(inner, "inner-pairs")
        sizes = of.select(F.col("component").alias("at"), "size").distinct()
    sized = lambda rows, name: rows.withColumn(name, one) if sizes is None else rows.join(sizes.withColumnRenamed("size", name), "at", "left").withColumn(name, F.coalesce(name, one))
    placed = stored(named(roots.withColumn("at", F.col("root")), "at"), "placed-roots")
    starts, on = placed.select("at").distinct(), inner.select("at").distinct()
    short = max_depth is None or max_depth > 0
    ends = stored(starts.join(on, "at", "left_anti"), "end-roots")
    if not short or ends.count() <= FEW:
        ends, short = ends.where("false"), False
    ids = numbered((starts.join(on, "at", "left_semi") if short else starts).select(F.col("at").alias("root"))).withColumnRenamed("root", "at")
    bit = F.expr(f"shiftleft(1L, cast(id % {BITS} AS int))")
    start = ids.groupBy("at", F.expr(f"id div {BITS}").alias("block")).agg(F.bit_or(bit).alias("bits"))
    words = _spread(start, inner, max_depth)
    passing = words if max_depth is None else words.where(F.col("depth") < max_depth)
    every = sized(words, "weight").select(F.lit("node").alias("kind"), "block", "bits", "weight")
    if leaves is not None:
        met = _at_leaves(words, passing, outer, leaves, named).groupBy("kind", "leaf", "block").agg(F.bit_or("bits").alias("bits"))
        every = every.unionByName(met.select("kind", "block", "bits", one.alias("weight")))
    holders = passing.groupBy("at", "block").agg(F.bit_or("bits").alias("bits")).groupBy("at").agg(F.array_sort(F.collect_list(F.struct("block", "bits"))).alias("words"))
    holders = holders.join(ends.withColumn("end", F.lit(True)), "at", "full").withColumn("holder", F.monotonically_increasing_id())
    holders = stored(holders.select("at", "holder", F.coalesce("end", F.lit(False)).alias("end"), F.col("words.block").cast("array<int>").alias("blocks"), F.col("words.bits").alias("bits")), "holders")
    beyond = stored(_beyond(outer, holders, of if max_depth is None else None), "beyond")
    sums = _bit_sums(every).unionByName(beyond.where("not end").select(F.lit("node").alias("kind"), "id", "n")).groupBy("kind", "id").agg(F.sum("n").alias("n"))
    found = sums.join(ids, "id").select("at", "kind", "n")
    after = beyond.where("end").groupBy(F.col("id").alias("holder")).agg(F.sum("n").alias("out"))
    last = sized(holders.where("end").select("at", "holder").join(after, "holder", "left"), "own")
    found = found.unionByName(last.select("at", F.lit("node").alias("kind"), (F.coalesce("out", F.lit(0)) + F.col("own")).alias("n")))
    if leaves is not None:
        own = _at_leaves(*[ends.select("at", F.lit(0).alias("block"), F.lit(0).alias("bits"))] * 2, outer, leaves, named, "at")
        found = found.unionByName(own.distinct().groupBy("at", "kind").agg(F.count("*").alias("n")))
    found = found.join(placed, "at").withColumn("n", F.when(F.col("kind") == "node", F.col("n") - 1).otherwise(F.col("n")))
    return found.where("n > 0").select("root", "kind", "n")


def _beyond(outer: DataFrame, holders: DataFrame, of: DataFrame | None) -> DataFrame:
    """(end, id, n): how many nodes behind outer pairs each root reaches, a row a chunk of these nodes: of ends by holder, of other roots by id.
    holders: (at, holder, end, blocks, bits); of: (node, component) of the pairs.

    Nodes are dealt in chunks of about CHUNK pairs. Pairs carry the words of a holder that has few of them; longer lists come to each chunk once. So what is
    shuffled grows with the pairs, and with chunks times the long lists; (node, word) rows stand only inside a task."""
    n = outer.count()
    chunks = -(-n // CHUNK) or 1
    light = F.coalesce(F.size("blocks"), F.lit(0)) <= LIGHT
    carried = holders.select("at", "holder", "end", (~light).alias("heavy"), *[F.when(light, F.col(c)).alias(c) for c in ("blocks", "bits")])
    if of is not None:
        member = of.select("node", F.col("component").alias("at"))
        inside = member.join(carried, "at").drop("at").withColumnRenamed("node", "at")
        carried = carried.join(member.select(F.col("node").alias("at")), "at", "left_anti").unionByName(inside)
    pairs = outer.select("at", "next").join(carried, "at").select(F.pmod(F.xxhash64("next"), F.lit(chunks)).alias("chunk"), "next", "holder", "end", "heavy", "blocks", "bits")
    lists = holders.where(~light).select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(chunks - 1).cast("long"))).alias("chunk"), *[F.col(c).alias(f"l_{c}") for c in ("holder", "blocks", "bits")]).toDF("l_chunk", "l_holder", "l_blocks", "l_bits")
    return pairs.groupBy("chunk").cogroup(lists.groupBy("l_chunk")).applyInArrow(_chunk_sums, "end boolean, id long, n long")


def _bit_totals(rows):
    """How many of the rows (n x words, 64 bits each) have each bit: three rows become a sum and a carry until few are left of each weight."""
    import numpy as np

    out, weight = np.zeros((rows.shape[1], BITS), np.int64), 1
    while len(rows):
        carries = [rows[:0]]
        while (m := len(rows) // 3):
            a, b, c = rows[:m], rows[m:2 * m], rows[2 * m:3 * m]
            x = a ^ b
            carries.append((a & b) | (x & c))
            rows = np.concatenate((x ^ c, rows[3 * m:]))
        for row in rows:
            out += weight * np.unpackbits(row.astype("<u8").view(np.uint8), bitorder="little").reshape(-1, BITS).astype(np.int64)
        rows, weight = np.concatenate(carries), 2 * weight
    return out


def _chunk_sums(pairs, lists):
    """_beyond() of a chunk: pairs (next, holder, end, heavy, blocks, bits), lists (l_holder, l_blocks, l_bits) of those that are heavy."""
    import numpy as np
    import pyarrow as pa

    def column(table, name):
        return table.column(name).combine_chunks()

    def flat(table, prefix=""):
        blocks, bits = column(table, f"{prefix}blocks"), column(table, f"{prefix}bits")
        return blocks.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64), blocks.flatten().to_numpy(zero_copy_only=False).astype(np.int64), bits.flatten().to_numpy(zero_copy_only=False).view(np.uint64)

    nodes = column(pairs, "next").dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
    holder, end, heavy = (column(pairs, c).to_numpy(zero_copy_only=False) for c in ("holder", "end", "heavy"))
    count, out = int(nodes.max(initial=-1)) + 1, []
    names, at = np.unique(holder[end], return_inverse=True)
    if len(names):
        n = np.bincount(np.unique(at * count + nodes[end]) // count, minlength=len(names))
        out.append((np.ones(len(names), bool), names, n))
    length, block, bits = flat(pairs)
    of = np.repeat(nodes, length)
    l_holder, (l_length, l_block, l_bits) = column(lists, "l_holder").to_numpy(zero_copy_only=False), flat(lists, "l_")
    words = np.unique(np.concatenate((block, l_block)))
    width, total = len(words), np.zeros((len(words), BITS), np.int64)
    block, l_block = np.searchsorted(words, block), np.searchsorted(words, l_block)
    full = np.zeros(count, bool)
    full[nodes[heavy]] = True

    # nodes with short lists only: their words, each once
    sparse = ~full[of]
    key = of[sparse] * width + block[sparse]
    order = np.argsort(key)
    key, own = key[order], bits[sparse][order]
    if len(key):
        first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        word, own = key[first] % width, np.bitwise_or.reduceat(own, first)
        while len(own):
            rest = own & (own - np.uint64(1))
            np.add.at(total, (word, np.bitwise_count((own ^ rest) - np.uint64(1)).astype(np.int64)), 1)
            word, own = word[rest > 0], rest[rest > 0]

    # nodes with a long list: all words side by side, some nodes at a time
    if full.any():
        l_start = np.concatenate(([0], np.cumsum(l_length)))
        place = np.argsort(l_holder)
        row = place[np.searchsorted(l_holder[place], holder[heavy])]
        some = np.unique(nodes[heavy] * len(l_holder) + row)
        node, row = some // len(l_holder), some % len(l_holder)

        def lists_of(which):
            table = np.zeros((len(which), width), np.uint64)
            i = np.repeat(np.arange(len(which)), l_length[which])
            j = np.arange(len(i)) - np.repeat(np.cumsum(l_length[which]) - l_length[which], l_length[which]) + np.repeat(l_start[which], l_length[which])
            table[i, l_block[j]] = l_bits[j]
            return table

        kept = lists_of(np.arange(len(l_holder))) if 8 * width * len(l_holder) <= TABLE else None
        order = np.argsort(of[~sparse], kind="stable")
        of, block, bits = of[~sparse][order], block[~sparse][order], bits[~sparse][order]
        which = np.flatnonzero(full)
        step = max(1, TABLE // 16 // (8 * width))
        for lo in range(0, len(which), step):
            own = which[lo:lo + step]
            s, e = np.searchsorted(node, [own[0], own[-1] + 1])
            got, need = np.zeros((len(own), width), np.uint64), row[s:e]
            table = kept
            if table is None:
                need, inverse = np.unique(need, return_inverse=True)
                table, need = lists_of(need), inverse
            i = np.searchsorted(own, node[s:e])
            nth = np.arange(e - s) - np.searchsorted(node[s:e], node[s:e])
            for r in range(int(nth.max()) + 1):
                got[i[nth == r]] |= table[need[nth == r]]
            s, e = np.searchsorted(of, [own[0], own[-1] + 1])
            np.bitwise_or.at(got, (np.searchsorted(own, of[s:e]), block[s:e]), bits[s:e])
            total += _bit_totals(got)
    word, bit = np.nonzero(total)
    out.append((np.zeros(len(word), bool), words[word] * BITS + bit, total[word, bit]))
    return pa.table([pa.array(np.concatenate(c), t) for c, t in zip(zip(*out), (pa.bool_(), pa.int64(), pa.int64()))], names=["end", "id", "n"])


def by_kind(found: DataFrame, **names: str) -> DataFrame:
    """reach_counts() as a row a root: a column for each named kind, null where there is none."""
    return found.groupBy("root").agg(*[F.max(F.when(F.col("kind") == kind, F.col("n"))).alias(name) for name, kind in names.items()])
