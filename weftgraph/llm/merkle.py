"""A Merkle manifest of a table: leaves, roots and every document's authentication path.

A document's leaf is the hash of its fields. Leaves of a group (lang) stand in order of doc_id and hash up in pairs, a lone last node
alone; the groups' roots, in order, hash up likewise to one root.

Documents are read once. Their leaves are sorted by range and numbered within their group by a running sum over the tasks. They are
then dealt by aligned block of 2^``height`` places, so a group of any size is many blocks. A first pass over the blocks folds each
to its root with one stack; the blocks' roots are the leaves of the next, 2^height times smaller table, until one is left, and a last
such table is that of the groups' roots. From the top down each table hands its nodes the path above them. The second pass walks a
block's leaves in turn: at each height it holds the sibling of the current leaf's ancestor and a treehash stack that gathers the next
one, two steps a leaf, so a block's memory is its leaves and a logarithm of nodes. It appends the shared upper path, hashes
the path, folds the leaf and compares with the root. Paths are neither stored nor dealt.

doc_id null: first in its group, written ``-``, never tampered with. lang null: a group of its own, first. Equal doc_ids stand in order of
their leaves; equal rows are leaves side by side. A group or table of one leaf: its root is the leaf. Empty table: no rows. Other columns are ignored.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.llm._common import materialize, partitions

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(**changed: Column) -> Column:
    """The hash of a row's fields, each '-' if null, else its UTF-8 length, a colon and its value."""
    def part(name):
        text = changed.get(name, F.col(name)).cast("string")
        return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))

    return F.sha2(F.concat(*[part(n) for n in FIELDS]), 256)


def join(left: str | None, right: str | None) -> str | None:
    """A node over two nodes; None stands for one that has no leaves."""
    return None if left is None else digest(left) if right is None else digest(left, right)


class Treehash:
    """One node of a height, gathered a leaf or a joint at a step; its stack holds a node a height at most."""

    def __init__(self, leaves):
        self.leaves, self.stack, self.at, self.height = leaves, [], 0, -1

    def begin(self, start: int, height: int) -> None:
        self.stack, self.at, self.height, self.end = [], start, height, start + (1 << height)

    @property
    def done(self) -> bool:
        return self.height < 0 or bool(self.stack) and self.stack[0][0] == self.height

    def step(self) -> None:
        if self.done:
            return
        s = self.stack
        if len(s) > 1 and s[-1][0] == s[-2][0]:
            h, right = s.pop()
            s[-1] = (h + 1, join(s[-1][1], right))
        else:
            s.append((0, self.leaves[self.at] if self.at < len(self.leaves) else None))
            self.at += 1

    def node(self) -> str | None:
        while not self.done:
            self.step()
        return self.stack[0][1]


def block_root(leaves: list[str], height: int) -> str:
    """The node of this height over a block's leaves, with one stack."""
    stack: list[tuple[int, str]] = []
    for x in leaves:
        node = (0, x)
        while stack and stack[-1][0] == node[0]:
            node = (node[0] + 1, join(stack.pop()[1], node[1]))
        stack.append(node)
    h, node = stack.pop()
    while h < height or stack:
        while h < (stack[-1][0] if stack else height):
            h, node = h + 1, join(node, None)
        if stack:
            h, node = h + 1, join(stack.pop()[1], node)
    return node


def paths(leaves: list[str], height: int):
    """For each leaf in turn the siblings of its ancestors below this height (None: there is none), lowest first."""
    held, stacks = [], []
    for h in range(height):
        first, ahead = Treehash(leaves), Treehash(leaves)
        first.begin(1 << h, h)
        held.append(first.node())
        ahead.begin(0, h)
        ahead.node()
        stacks.append(ahead)
    for i in range(len(leaves)):
        yield held
        for h in range(height):
            if (i + 1) % (1 << h) == 0:
                held[h] = stacks[h].node()
                start = (i + 1 + (1 << h)) ^ (1 << h)
                stacks[h].begin(start, h)
        for s in stacks:
            s.step()
            s.step()


def fold(leaf: str, place: int, siblings: list[str | None]) -> str:
    for s in siblings:
        leaf = join(leaf, s) if place % 2 == 0 else join(s, leaf)
        place >>= 1
    return leaf


def depth_of(n: int) -> int:
    return max(0, n - 1).bit_length()


def _ranged(rows: DataFrame, group: str, *order) -> DataFrame:
    """rows with pos, their place within the group, and n, the group's rows."""
    spark = rows.sparkSession
    keys = [F.col(group).asc_nulls_first(), *order]
    dealt = rows.repartitionByRange(partitions(spark), *keys).sortWithinPartitions(*keys)
    marked = materialize(dealt.withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id()), "merkle-sorted")
    per = marked.groupBy(group, "_part").agg(F.count("*").alias("_k"), F.min("_at").alias("_first"))
    ahead = Window.partitionBy(group).orderBy("_part")
    # a row a task and group that meet: the tasks have ranges, so tasks and groups together at most
    per = per.withColumn("_base", F.sum("_k").over(ahead) - F.col("_k")).withColumn("n", F.sum("_k").over(Window.partitionBy(group)))
    per = per.select(F.col(group).alias("_g"), F.col("_part").alias("_p"), "_first", "_base", "n")
    met = marked.join(per, F.col(group).eqNullSafe(F.col("_g")) & (F.col("_part") == F.col("_p")))
    return met.withColumn("pos", F.col("_at") - F.col("_first") + F.col("_base")).drop("_g", "_p", "_part", "_at", "_first", "_base")


def _roots(nodes: DataFrame, height: int) -> DataFrame:
    """nodes: g, pos, n, node. A row a block: g, pos, n (blocks of its group), node."""
    def run(table):
        import pyarrow as pa
        import pyarrow.compute as pc

        table = table.take(pc.sort_indices(table, [("pos", "ascending")]))
        n, pos = table.column("n")[0].as_py(), table.column("pos")[0].as_py()
        node = block_root(table.column("node").to_pylist(), min(height, depth_of(n)))
        return pa.table({"g": table.column("g").slice(0, 1), "pos": pa.array([pos >> height]), "n": pa.array([-(-n >> height)]), "node": pa.array([node])})

    return nodes.select("g", "pos", "n", "node").groupBy("g", F.shiftright("pos", height)).applyInArrow(run, "g string, pos long, n long, node string")


def _above(nodes: DataFrame, upper: DataFrame, height: int) -> DataFrame:
    """nodes: g, pos, n, node. upper: g, pos, sides, path of the blocks' roots. g, pos, sides, path of nodes: sides are places to fold with."""
    def run(key, left, right):
        import pyarrow as pa
        import pyarrow.compute as pc

        left = left.take(pc.sort_indices(left, [("pos", "ascending")]))
        places, h = left.column("pos").to_pylist(), min(height, depth_of(left.column("n")[0].as_py()))
        sides, path = right.column("sides")[0].as_py(), right.column("path")[0].as_py()
        own = [list(p) for p in paths(left.column("node").to_pylist(), h)]
        return pa.table({"g": left.column("g"), "pos": left.column("pos"), "sides": pa.array([[p >> k & 1 for k in range(h)] + sides for p in places], pa.list_(pa.int32())),
                         "path": pa.array([p + path for p in own], pa.list_(pa.string()))})

    key = F.shiftright("pos", height)
    return nodes.select("g", "pos", "n", "node").groupBy("g", key).cogroup(upper.groupBy("g", "pos")).applyInArrow(run, "g string, pos long, sides array<int>, path array<string>")


def _levels(nodes: DataFrame, height: int) -> list[DataFrame]:
    """nodes and the tables of block roots above, the last of a row a group."""
    out = [nodes]
    while out[-1].where("n > 1").limit(1).count():
        out.append(materialize(_roots(out[-1], height), "merkle-roots"))
    return out


def manifest(docs: DataFrame, height: int = 12, tampered: Column | None = None) -> DataFrame:
    """doc_id, lang, leaf, subroot, root, proof_sha256, folded_root and verified of each row; the contract's columns and lang.

    tampered: a column over docs that says where n_chars is taken to be one more (default: where 7 divides crc32 of doc_id)."""
    spark = docs.sparkSession
    bad = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0 if tampered is None else tampered
    other = F.when(F.coalesce(bad, F.lit(False)) & F.col("n_chars").isNotNull(), leaf_of(n_chars=F.col("n_chars") + 1))
    leaves = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("g"), leaf_of().alias("node"), other.alias("other"))
    leaves = materialize(leaves.withColumn("_id", F.monotonically_increasing_id()), "merkle-leaves")
    placed = materialize(_ranged(leaves, "g", F.col("doc_id").asc_nulls_first(), "node", "_id").drop("_id"), "merkle-placed")
    levels = _levels(placed, height)
    # the groups' roots are the leaves of the tree on top; its one group is null
    subroots = levels[-1].select(F.lit(None).cast("string").alias("g"), F.col("g").alias("lang"), F.col("node"))
    subroots = materialize(_ranged(materialize(subroots, "merkle-subroots"), "g", F.col("lang").asc_nulls_first()), "merkle-top")
    tops = _levels(subroots, height)
    one = tops[-1].select("node").first()
    root = one["node"] if one else ""
    upper = tops[-1].select("g", "pos", F.array().cast("array<int>").alias("sides"), F.array().cast("array<string>").alias("path"))
    for nodes in tops[-2::-1]:
        upper = _above(nodes, upper, height)
    named = subroots.select("lang", F.col("pos").alias("top"))
    upper = materialize(upper.join(named, F.col("pos") == F.col("top")).select(F.col("lang").alias("g"), F.lit(0).cast("long").alias("pos"), "sides", "path"), "merkle-upper")
    upper = upper.join(subroots.select(F.col("lang").alias("_l"), F.col("node").alias("subroot")), F.col("g").eqNullSafe(F.col("_l"))).drop("_l")
    subroot = materialize(upper.select("g", "subroot"), "merkle-of")
    upper = upper.drop("subroot")
    for nodes in levels[-2:0:-1]:
        upper = _above(nodes, upper, height)
    if len(levels) > 1:
        upper = materialize(upper, "merkle-upper")
    upper = upper.join(subroot.withColumnRenamed("g", "_g"), F.col("g").eqNullSafe(F.col("_g"))).drop("_g")

    return _proofs(placed, upper, height if len(levels) > 1 else 0, root)


def _proofs(placed: DataFrame, upper: DataFrame, height: int, root: str) -> DataFrame:
    """The second pass over the blocks of leaves; height 0: each leaf is its group's root."""
    def run(key, left, right):
        import pyarrow as pa
        import pyarrow.compute as pc

        left = left.take(pc.sort_indices(left, [("pos", "ascending")]))
        leaves, others, places = (left.column(c).to_pylist() for c in ("node", "other", "pos"))
        h = min(height, depth_of(left.column("n")[0].as_py()))
        sides, path, subroot = (right.column(c)[0].as_py() for c in ("sides", "path", "subroot"))
        above = sum(s << k for k, s in enumerate(sides))
        proofs, folded = [], []
        for leaf, other, pos, own in zip(leaves, others, places, paths(leaves, h)):
            whole = [*own, *path]
            place = pos & ((1 << h) - 1) | above << h
            # siblings from the lowest level up
            proofs.append(digest(*[s for s in whole if s is not None]))
            folded.append(fold(leaf if other is None else other, place, whole))
        n = len(leaves)
        return pa.table({"doc_id": left.column("doc_id"), "lang": left.column("g"), "leaf": left.column("node"), "subroot": pa.array([subroot] * n, pa.string()), "root": pa.array([root] * n, pa.string()),
                         "proof_sha256": pa.array(proofs, pa.string()), "folded_root": pa.array(folded, pa.string()), "verified": pa.array([f == root for f in folded], pa.bool_())})

    rows = placed.select("doc_id", "g", "pos", "n", "node", "other").groupBy("g", F.shiftright("pos", height))
    return rows.cogroup(upper.groupBy("g", "pos")).applyInArrow(run, "doc_id long, lang string, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")
