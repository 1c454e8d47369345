"""Written tables that end a lineage, in the shared folder named by spark.checkpoint.dir."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset and all runs on one machine, a folder of this session's own."""
    conf = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not conf:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        os.makedirs("/tmp/checkpoints", exist_ok=True)
        conf = f"file://{tempfile.mkdtemp(prefix='weft-', dir='/tmp/checkpoints')}"
        spark.conf.set("spark.checkpoint.dir", conf)
        atexit.register(shutil.rmtree, conf[len("file://"):], ignore_errors=True)
    return conf.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    return f"{folder(spark)}/{label}-{uuid.uuid4().hex}"


def stored(df: DataFrame, label: str) -> DataFrame:
    path, schema = new_path(df.sparkSession, label), df.schema
    df.write.parquet(path)
    return df.sparkSession.read.schema(schema).parquet(path)


def stored_with(df: DataFrame, label: str, **sums) -> tuple[DataFrame, dict]:
    """stored(), and aggregates over the rows, made on the way."""
    seen = Observation()
    out = stored(df.observe(seen, *[c.alias(n) for n, c in sums.items()]), label)
    return out, seen.get


def counted(df: DataFrame, path: str) -> int:
    """Writes df and returns how many rows it has, counted on the way."""
    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("n")).write.parquet(path)
    return seen.get["n"]
