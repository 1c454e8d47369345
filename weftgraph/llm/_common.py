"""Scratch tables, document normalisation and range helpers shared by the operators."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space of the contracts: 0x20 and 0x09 to 0x0D (also what bytes.split() takes).
WHITE = "[\\x20\\x09-\\x0D]+"
WHITE_CHARS = " \t\n\x0b\x0c\r"


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir; where it is unset and all runs on one machine, one of this session's own."""
    conf = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not conf:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        os.makedirs("/tmp/checkpoints", exist_ok=True)
        conf = f"file://{tempfile.mkdtemp(prefix='weft-', dir='/tmp/checkpoints')}"
        spark.conf.set("spark.checkpoint.dir", conf)
        atexit.register(shutil.rmtree, conf[len("file://"):], ignore_errors=True)
    return conf.rstrip("/")


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Writes df to the shared folder and reads it back: lineage ends there, and a lost executor costs nothing before it."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{label}-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(schema).parquet(path)
    out._weft_path = path
    return out


def release(*tables: DataFrame) -> None:
    """Deletes tables of materialize() that nothing reads any more."""
    for df in tables:
        path = getattr(df, "_weft_path", None)
        if path:
            spark = df.sparkSession
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def bounded_batches(spark: SparkSession, rows: int = 2000, size: str = "16m") -> None:
    """Whole texts go to Python in Arrow batches of at most so many rows and bytes; smaller settings of the session stay."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key, "10000")) <= rows:
        spark.conf.set(key, str(rows))
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    bytes_of = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes
    now = spark.conf.get(key, None)
    if now is not None and not 0 < bytes_of(now) <= bytes_of(size):
        spark.conf.set(key, size)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def narrow(docs: DataFrame, *columns: str) -> DataFrame:
    """doc_id (long), text (null: empty) and the columns named; all others are left unread."""
    bounded_batches(docs.sparkSession)
    out = [F.col("doc_id").cast("long").alias("doc_id")]
    if "text" in columns:
        out.append(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    out += [F.col(c) for c in columns if c != "text"]
    return docs.select(*out)


#: Whole rows travel in one column of this name, so that no column of theirs clashes with an operator's own.
ROW = "_weft_row"


def with_row(docs: DataFrame, **columns) -> DataFrame:
    """docs as one struct column ROW beside further columns of the operator's."""
    return docs.select(F.struct("*").alias(ROW), *[c.alias(n) for n, c in columns.items()])


def rows_of(marked: DataFrame, names: list[str]) -> DataFrame:
    """The rows of with_row() as they were."""
    return marked.select(*[F.col(ROW).getField(n).alias(n) for n in names])


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def chunks(sorted_keys):
    """(start, end) of the runs of equal rows in a sorted 2-d numpy array or 1-d array."""
    import numpy as np

    n = len(sorted_keys)
    if not n:
        return []
    differ = sorted_keys[1:] != sorted_keys[:-1]
    if differ.ndim == 2:
        differ = differ.any(axis=1)
    cut = np.concatenate(([0], np.flatnonzero(differ) + 1, [n]))
    return list(zip(cut[:-1].tolist(), cut[1:].tolist()))
