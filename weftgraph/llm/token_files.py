"""Token-id files with one shared zstandard dictionary and an index for reading single documents.

A file set is two Parquet tables in one folder. ``dictionary`` has one row: the dictionary trained on serialized id
arrays and its SHA-256. ``blocks`` has rows of up to ``block_docs`` documents in ascending doc_id order (nulls
first, ties by text hash), each document compressed on its own:

    task, block      place in the order          dict_sha256   the dictionary its frames need
    first_id, last_id  doc_ids of the block      start         ids of the task's documents before the block
    index            doc_id, offset, n_tokens of each document (64-bit little-endian triples; null id: the least long)
    payload          the frames, one after another

Ids are little-endian, two bytes each where the vocabulary and the end id allow it, else four; the dictionary's row says which. Parquet's writer commits whole
files, so a lost executor leaves no half-written blocks, and any store that Spark writes will do.

The dictionary is fitted to a bounded sample: of the ``sample_docs`` documents of least id hash (ties by text) a stretch of
``sample_bytes`` each, at a place that the hash gives. It changes sizes only. Where the sample is small it is repeated until the
trainer takes it, so every file set has a dictionary; that of an empty table is trained on the end id.

Null text: empty, the end id alone. Repeated rows: each is written. Empty table: no blocks.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftgraph.llm._common import materialize, narrow, partitions, scratch_dir
from weftgraph.llm.encoding import encoder, forget

NO_ID = -(1 << 63)
BLOCKS = "task int, block int, dict_sha256 string, first_id long, last_id long, start long, n_tokens long, index binary, payload binary"


def train(samples: list[bytes], size: int = 32_768) -> bytes:
    """A dictionary of at most size bytes. Few or equal samples are repeated; content that the trainer finds nothing in is
    the dictionary itself."""
    import zstandard

    samples = [x for x in samples if len(x) >= 8] or [b"\0" * 8]
    total = sum(map(len, samples))
    rounds = max(1, -(-64 // len(samples)), -(-8 * size // total))
    try:
        return zstandard.train_dictionary(size, samples * rounds, threads=1).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[:size]


def _dictionary(data: bytes):
    import zstandard

    return zstandard.ZstdCompressionDict(data)


def _compressor(dictionary: bytes, level: int):
    import zstandard

    own = _dictionary(dictionary)
    own.precompute_compress(level=level)  # else each frame digests it anew
    return zstandard.ZstdCompressor(level=level, write_content_size=True, write_dict_id=False, dict_data=own)


def _decompressor(dictionary: bytes):
    import zstandard

    return zstandard.ZstdDecompressor(dict_data=_dictionary(dictionary))


def width_of(tokenizer: str, end_id: int) -> int:
    """Bytes an id takes."""
    most = max(max(encoder(tokenizer).tokenizer.get_vocab().values()), end_id)
    return 2 if most < 1 << 16 else 4


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int = 2, block_docs: int = 512, level: int = 3,
          sample_docs: int = 1000, sample_bytes: int = 4096) -> None:
    import numpy as np

    spark = docs.sparkSession
    texts = narrow(docs, "text").withColumn("text_hash", F.xxhash64("text"))
    id_bytes = width_of(tokenizer, end_id)
    kind = f"<u{id_bytes}"
    # the ids alone give the cut; then rows of bounded length are read
    h = F.xxhash64("doc_id")
    least = docs.select(F.xxhash64(F.col("doc_id").cast("long")).alias("h")).orderBy("h").limit(sample_docs).agg(F.max("h")).first()[0]
    start = F.pmod(h, F.greatest(F.length("text") - 2 * sample_bytes, F.lit(0)) + 1).cast("int") + 1
    stretch = F.substring(F.col("text"), start, F.lit(2 * sample_bytes))
    picked = texts.where(h <= F.lit(least)).select(h.alias("h"), stretch.alias("text")).distinct().orderBy("h", "text").limit(sample_docs).collect()
    own = encoder(tokenizer)
    dictionary = train([np.append(own.ids(r["text"]), np.uint32(end_id)).astype(kind).tobytes()[:sample_bytes] for r in picked])
    digest = hashlib.sha256(dictionary).hexdigest()
    head = spark.createDataFrame([(digest, bytearray(dictionary), id_bytes)], "sha256 string, dictionary binary, id_bytes int")
    head.coalesce(1).write.parquet(f"{path}/dictionary")

    def encode(batches):
        import numpy as np
        import pyarrow as pa

        own, zip_ = encoder(tokenizer), _compressor(dictionary, level)
        for b in batches:
            frames, counts = [], []
            for ids in own.encode(b.column("text").to_pylist()):
                ids = np.append(ids, np.uint32(end_id)).astype(kind)
                counts.append(len(ids))
                frames.append(zip_.compress(ids.tobytes()))
            yield pa.record_batch([b.column("doc_id"), b.column("text_hash"), pa.array(counts, pa.int64()), pa.array(frames, pa.binary())], names=["doc_id", "text_hash", "n_tokens", "frame"])

    def block(batches):
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        forget()
        task, at, start, held = TaskContext.get().partitionId(), 0, 0, []

        def full():
            nonlocal at, start, held
            ids = [NO_ID if d is None else d for d, _, _ in held]
            counts = [n for _, n, _ in held]
            frames = [f for _, _, f in held]
            places = np.cumsum([0, *map(len, frames)])[:-1]
            index = np.array([ids, places, counts], dtype="<i8").T.tobytes()
            row = {"task": task, "block": at, "dict_sha256": digest, "first_id": ids[0], "last_id": ids[-1],
                   "start": start, "n_tokens": sum(counts), "index": index, "payload": b"".join(frames)}
            at, start, held = at + 1, start + row["n_tokens"], []
            types = [pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary()]
            return pa.record_batch([pa.array([v], t) for v, t in zip(row.values(), types)], names=list(row))

        for b in batches:
            for row in zip(*(b.column(c).to_pylist() for c in ("doc_id", "n_tokens", "frame"))):
                held.append(row)
                if len(held) == block_docs:
                    yield full()
        if held:
            yield full()

    # written first: dealing by range reads its input twice
    frames = materialize(texts.mapInArrow(encode, "doc_id long, text_hash long, n_tokens long, frame binary"), "token-frames")
    order = [F.col("doc_id").asc_nulls_first(), F.col("text_hash")]
    ranged = frames.repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order)
    ranged.mapInArrow(block, BLOCKS).write.option("compression", "none").parquet(f"{path}/blocks")


def dictionary_of(spark: SparkSession, path: str) -> tuple[bytes, int]:
    """The dictionary, and the bytes an id takes."""
    row = spark.read.parquet(f"{path}/dictionary").first()
    if hashlib.sha256(row["dictionary"]).hexdigest() != row["sha256"]:
        raise ValueError("the dictionary does not have the hash it is filed under")
    return bytes(row["dictionary"]), row["id_bytes"]


def read(spark: SparkSession, path: str, digest_only: bool = False, doc_ids: list[int] | None = None) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32 (of the ids as 32-bit little-endian) and, unless
    digest_only, ids. doc_ids: these documents alone; only the blocks and frames that hold them are read and decompressed."""
    dictionary, id_bytes = dictionary_of(spark, path)
    digest, kind = hashlib.sha256(dictionary).hexdigest(), f"<u{id_bytes}"
    blocks = spark.read.schema(BLOCKS).parquet(f"{path}/blocks")
    # one row a task of the writer: broadcast up to a counted 200 000 of them
    totals = blocks.groupBy("task").agg(F.sum("n_tokens").alias("n"))
    bases = totals.select(F.col("task").alias("of"), F.coalesce(F.sum("n").over(Window.orderBy("task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    if totals.count() <= 200_000:
        bases = F.broadcast(bases)
    if doc_ids is not None:
        wanted = F.lit(False)
        for d in doc_ids:
            wanted = wanted | F.lit(d).between(F.col("first_id"), F.col("last_id"))
        blocks = blocks.where(wanted)
    placed = blocks.join(bases, F.col("task") == F.col("of")).select("dict_sha256", (F.col("start") + F.col("base")).alias("start"), "index", "payload")
    only = None if doc_ids is None else set(doc_ids)

    def decode(batches):
        import zlib

        import numpy as np
        import pyarrow as pa

        forget()
        unzip = _decompressor(dictionary)
        for b in batches:
            for sha, start, index, payload in zip(*(c.to_pylist() for c in b.columns)):
                if sha != digest:
                    raise ValueError("a block needs another dictionary")
                at = np.frombuffer(index, dtype="<i8").reshape(-1, 3)
                starts = start + np.concatenate(([0], np.cumsum(at[:-1, 2])))
                ends, rows = np.append(at[1:, 1], len(payload)), []
                for i in range(len(at)):
                    d = None if at[i, 0] == NO_ID else int(at[i, 0])
                    if only is None or d in only:
                        ids = np.frombuffer(unzip.decompress(payload[at[i, 1]:ends[i]]), dtype=kind).astype("<u4")
                        if len(ids) != at[i, 2]:
                            raise ValueError("a frame's length differs from its index")
                        rows.append((d, int(starts[i]), len(ids), zlib.crc32(ids.tobytes()), ids))
                cols = list(zip(*rows)) or [()] * 5
                out = [pa.array(c, pa.int64()) for c in cols[:4]]
                if not digest_only:
                    out.append(pa.array([x.astype(np.int64) for x in cols[4]], pa.list_(pa.int64())))
                yield pa.record_batch(out, names=["doc_id", "start", "n_tokens", "ids_crc32", "ids"][:len(out)])

    return placed.mapInArrow(decode, "doc_id long, start long, n_tokens long, ids_crc32 long" + ("" if digest_only else ", ids array<long>"))


def round_trip(docs: DataFrame, tokenizer: str, end_id: int = 2) -> DataFrame:
    """Writes docs to a file set in the shared folder and returns what its files say."""
    import uuid

    path = f"{scratch_dir(docs.sparkSession)}/tokens-{uuid.uuid4().hex}"
    write(docs, path, tokenizer, end_id)
    return read(docs.sparkSession, path, digest_only=True)
