"""Removal of lines that many documents share.

Every line with a key (the line without ASCII white space at both ends, A-Z lower-cased) becomes a row
(128-bit key hash, document, position). The rows are range-partitioned by hash and document and sorted by
hash, document and position, so each task streams whole runs in order and a line of any frequency is dealt
over as many tasks as it needs. A run that lies inside one task is settled there with a buffer of fewer
rows than ``min_docs`` documents have of it. The first and the last run of a task may go on elsewhere: their
rows are written as pending with one count per task, and the counts, at most two a task, are summed after.
What comes back is not text but one compressed keep bitmap per document that loses lines.

A document is a row; rows equal in doc_id and text count as one. Null text: empty, that is one line without
key. Null doc_id: an id like any other. Empty table: no rows. Other columns pass through untouched.
"""

from __future__ import annotations

import zlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.llm._common import ROW, WHITE_CHARS, bounded_batches, materialize, narrow, partitions, with_row

KEYED = "h1 long, h2 long, d1 long, d2 long, pos int"


def line_keys(lines: list[bytes]) -> list[bytes]:
    return [x.strip(WHITE_CHARS.encode()).lower() for x in lines]


def _identity() -> tuple:
    """A row's doc_id (null: the text's hash) and its text's hash. Equal rows have equal values."""
    th = F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")), F.col("doc_id").isNull())
    return F.coalesce(F.col("doc_id").cast("long"), th), th


def keyed_lines(docs: DataFrame, min_key_chars: int = 1) -> DataFrame:
    def run(batches):
        import numpy as np
        import pyarrow as pa
        import xxhash

        for b in batches:
            d1, d2, rows = b.column(1).to_pylist(), b.column(2).to_pylist(), [[], [], [], []]
            digest = bytearray()
            for i, t in enumerate(b.column(0).to_pylist()):
                for pos, key in enumerate(line_keys(t.encode("utf-8", "surrogatepass").split(b"\n"))):
                    if len(key) >= min_key_chars and (min_key_chars < 2 or len(key.decode("utf-8", "surrogatepass")) >= min_key_chars):
                        digest += xxhash.xxh3_128_digest(key)
                        rows[0].append(d1[i])
                        rows[1].append(d2[i])
                        rows[2].append(pos)
            h = np.frombuffer(bytes(digest), dtype=">i8").astype(np.int64).reshape(-1, 2)
            yield pa.record_batch([pa.array(h[:, 0].copy()), pa.array(h[:, 1].copy()), pa.array(rows[0], pa.int64()), pa.array(rows[1], pa.int64()), pa.array(rows[2], pa.int32())], names=["h1", "h2", "d1", "d2", "pos"])

    text = F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    bounded_batches(docs.sparkSession)
    return docs.select(text, *_identity()).mapInArrow(run, KEYED)


def dropped_lines(docs: DataFrame, min_docs: int = 10, keep: str = "none", min_key_chars: int = 1) -> DataFrame:
    """(d1, d2, pos) of every line to drop: all lines whose key is found in at least min_docs documents;
    keep="first" leaves the first line of each such key, in order of document and position."""
    if keep not in ("none", "first"):
        raise ValueError("keep is none or first")
    spark = docs.sparkSession

    def run(batches):
        from itertools import chain

        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        task = TaskContext.get().partitionId()

        def out(state, h, d1, d2, pos):
            n = len(pos)
            return pa.record_batch([pa.array(np.full(n, state, np.int32)), pa.array(np.full(n, task, np.int32)), pa.array(np.full(n, h[0], np.int64)), pa.array(np.full(n, h[1], np.int64)), pa.array(d1, pa.int64()), pa.array(d2, pa.int64()), pa.array(pos, pa.int64())], names=["state", "task", "h1", "h2", "d1", "d2", "pos"])

        now, first, docs_now, held, last, any_rows = None, True, 0, [], None, False

        def close(final):
            """Ends the run: its count if it may go on in another task; what is still held is below the threshold or pending."""
            if first or final:
                if held:
                    yield out(1, now, *(np.concatenate([x[i] for x in held]) for i in range(3)))
                yield out(2, now, [None], [None], [docs_now])

        for b in batches:
            if not b.num_rows:
                continue
            h = np.stack([b.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (0, 1)], axis=1)
            d1, d2, pos = (b.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (2, 3, 4))
            fresh = np.ones(len(pos), dtype=bool)
            fresh[1:] = (h[1:] != h[:-1]).any(axis=1) | (d1[1:] != d1[:-1]) | (d2[1:] != d2[:-1])
            fresh[0] = last != (h[0, 0], h[0, 1], d1[0], d2[0])
            last = (h[-1, 0], h[-1, 1], d1[-1], d2[-1])
            cut = np.flatnonzero(np.concatenate(([True], (h[1:] != h[:-1]).any(axis=1), [True])))
            settled = [[], [], []]
            for a, z in zip(cut[:-1].tolist(), cut[1:].tolist()):
                key = (int(h[a, 0]), int(h[a, 1]))
                if key != now:
                    if now is not None:
                        if first:
                            yield from close(False)
                        first = not any_rows
                    now, docs_now, held = key, 0, []
                any_rows = True
                docs_now += int(fresh[a:z].sum())
                held.append((d1[a:z], d2[a:z], pos[a:z]))
                if docs_now >= min_docs and not first:
                    rows = [np.concatenate([x[i] for x in held]) for i in range(3)] if len(held) > 1 else list(held[0])
                    if keep == "first" and docs_now - int(fresh[a:z].sum()) < min_docs:
                        rows = [x[1:] for x in rows]
                    for i in range(3):
                        settled[i].append(rows[i])
                    held = []
                elif first:
                    yield out(1, now, d1[a:z], d2[a:z], pos[a:z])
                    held = []
            if settled[2]:
                yield out(0, (0, 0), *(np.concatenate(x) for x in settled))
        if now is not None:
            yield from close(True)

    # written first: dealing by range reads its input twice
    keyed = materialize(keyed_lines(docs, min_key_chars), "lines-keyed")
    ranged = keyed.repartitionByRange(partitions(spark), "h1", "h2", "d1", "d2").sortWithinPartitions("h1", "h2", "d1", "d2", "pos")
    streamed = materialize(ranged.mapInArrow(run, "state int, task int, h1 long, h2 long, d1 long, d2 long, pos long"), "lines-streamed")
    settled = streamed.where("state = 0").select("d1", "d2", F.col("pos").cast("int").alias("pos"))
    # at most two runs a task, so a table of twice the number of tasks
    open_runs = streamed.where("state = 2").groupBy("h1", "h2").agg(F.sum("pos").alias("docs"), F.min("task").alias("task")).where(F.col("docs") >= min_docs)
    pending = streamed.where("state = 1").join(F.broadcast(open_runs.select("h1", "h2", F.col("task").alias("at"))), ["h1", "h2"])
    if keep == "first":
        lead = pending.where("task = at").groupBy("h1", "h2").agg(F.min(F.struct("d1", "d2", "pos")).alias("lead"))
        pending = pending.join(F.broadcast(lead), ["h1", "h2"], "left").where(~F.struct("d1", "d2", "pos").eqNullSafe(F.col("lead")))
    return settled.unionByName(pending.select("d1", "d2", F.col("pos").cast("int").alias("pos")))


def pack_bitmap(drop: list[int], n_lines: int) -> bytes:
    """A keep bitmap (1 keeps, first line in the lowest bit), deflated."""
    import numpy as np

    keep = np.ones(n_lines, dtype=np.uint8)
    keep[drop] = 0
    return zlib.compress(np.packbits(keep, bitorder="little").tobytes(), 6)


def unpack_bitmap(bitmap: bytes, n_lines: int):
    import numpy as np

    return np.unpackbits(np.frombuffer(zlib.decompress(bitmap), dtype=np.uint8), bitorder="little", count=n_lines).astype(bool)


def keep_bitmaps(docs: DataFrame, **options) -> DataFrame:
    """(d1, d2, bitmap, n_bits) of each document that loses lines; bits past n_bits keep."""
    def run(batches):
        import pyarrow as pa

        for b in batches:
            got = [sorted(x) for x in b.column(2).to_pylist()]
            yield pa.record_batch([b.column(0), b.column(1), pa.array([pack_bitmap(x, x[-1] + 1) for x in got], pa.binary()), pa.array([x[-1] + 1 for x in got], pa.int32())], names=["d1", "d2", "bitmap", "n_bits"])

    # a group is one document's lines
    return dropped_lines(docs, **options).groupBy("d1", "d2").agg(F.collect_set("pos").alias("pos")).mapInArrow(run, "d1 long, d2 long, bitmap binary, n_bits int")


def apply_bitmap(text: str, bitmap: bytes | None, n_bits: int | None) -> tuple[int, int, str]:
    lines = text.split("\n")
    if bitmap is None:
        return len(lines), 0, text
    keep = unpack_bitmap(bitmap, n_bits)
    left = [x for x, k in zip(lines, keep.tolist()) if k] + lines[n_bits:]
    return len(lines), len(lines) - len(left), "\n".join(left)


def with_bitmaps(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs (ROW) with the columns bitmap and n_bits (null where nothing goes)."""
    maps = keep_bitmaps(docs, **options)
    d1, d2 = _identity()
    return with_row(docs, d1=d1, d2=d2).join(maps, ["d1", "d2"], "left").select(ROW, "bitmap", "n_bits")


def line_digest(docs: DataFrame, **options) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256 of each row."""
    def run(batches):
        import hashlib

        import pyarrow as pa

        for b in batches:
            got = [apply_bitmap(*x) for x in zip(*(b.column(i).to_pylist() for i in (1, 2, 3)))]
            yield pa.record_batch([b.column(0), pa.array([x[0] for x in got], pa.int64()), pa.array([x[1] for x in got], pa.int64()), pa.array([hashlib.sha256(x[2].encode("utf-8", "surrogatepass")).hexdigest() for x in got], pa.string())], names=["doc_id", "n_lines", "n_dropped", "kept_sha256"])

    marked = with_bitmaps(narrow(docs, "text"), **options).select(f"{ROW}.doc_id", f"{ROW}.text", "bitmap", "n_bits")
    return marked.mapInArrow(run, "doc_id long, n_lines long, n_dropped long, kept_sha256 string")


def dedup_lines(docs: DataFrame, **options) -> DataFrame:
    """docs with the shared lines gone from text (null stays null); n_chars, where there is such a column, follows."""
    marked, names = with_bitmaps(docs, **options), docs.columns

    def run(batches):
        import pyarrow as pa

        for b in batches:
            columns = dict(zip(names, b.column(0).flatten()))
            text = [None if t is None else apply_bitmap(t, m, n)[2] for t, m, n in zip(columns["text"].to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist())]
            columns["text"] = pa.array(text, pa.string())
            if "n_chars" in columns:
                columns["n_chars"] = pa.array([None if t is None else len(t) for t in text], pa.int64()).cast(columns["n_chars"].type)
            yield pa.record_batch(list(columns.values()), names=list(columns))

    return marked.mapInArrow(run, docs.schema)
