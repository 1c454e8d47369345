"""Incremental maintenance: debounced change windows and micro-batch replacement of changed modules."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.operators.store import file_differences


def debounce(changes: DataFrame, quiet: str, key: str | None = None, at: str = "ts") -> DataFrame:
    """Runs of changes with less than quiet between them: first_change, last_change, changes, per key. Works on streams and tables."""
    window = F.session_window(F.col(at), quiet)
    got = changes.groupBy(*([F.col(key)] if key else []), window).agg(F.min(at).alias("first_change"), F.max(at).alias("last_change"), F.count("*").alias("changes"))
    return got.select(*([key] if key else []), "first_change", "last_change", "changes")


def file_states(files: DataFrame) -> DataFrame:
    """files: path, content (binary). (path, hash)."""
    return files.select(F.regexp_replace("path", r"\\", "/").alias("path"), F.sha2("content", 256).alias("hash"))


def changed_modules(before: DataFrame, after: DataFrame, module_of) -> DataFrame:
    """(module) of added, modified and deleted files; module_of: a column function of path."""
    return file_differences(before, after).select(module_of(F.col("path")).alias("module")).distinct()


CHANGE = "path string, status string, hash string, first_change timestamp, last_change timestamp, changes long"
_KEPT = "known string, now string, first_change timestamp, last_change timestamp, changes long"


def settled_changes(seen: DataFrame, quiet: float, delay: str = "0 seconds") -> DataFrame:
    """Changes of files, each once it has been quiet for so many seconds: path, status (added, modified, deleted), hash, first_change,
    last_change and changes, the number of sightings in the burst.

    seen: a stream of path, hash (null: the file is gone) and at. The state of a path is the hash it was last told with and the burst
    that is going on; event time ends a burst, once the watermark (delay behind the latest time) is past its last change by the quiet time. A burst that ends with the hash it began with
    tells nothing. The state lies with the query's checkpoint, so a restart goes on where it was. Sightings of one path in a trigger are
    taken by time; later ones win."""
    from pyspark.sql.streaming.state import GroupStateTimeout

    def step(key, frames, state):
        import pandas as pd

        known, now, first, last, n = state.get if state.exists else (None, None, None, None, 0)
        told = []

        def settle():
            nonlocal known, first, last, n
            if now != known:
                told.append((key[0], "added" if known is None else "deleted" if now is None else "modified", now, first, last, n))
            known, first, last, n = now, None, None, 0

        if state.hasTimedOut:
            settle()
        else:
            rows = pd.concat(list(frames)).sort_values("at", kind="stable")
            for h, at in zip(rows["hash"].tolist(), rows["at"].tolist()):
                if last is not None and (at - last).total_seconds() >= quiet:
                    settle()
                if last is None or at >= last:
                    now, last = (None if pd.isna(h) else h), at
                first, n = at if first is None else min(first, at), n + 1
        if last is None and known is None:
            state.remove()
        else:
            state.update((known, now, first, last, n))
        if last is not None:
            state.setTimeoutTimestamp(max(int(pd.Timestamp(last).timestamp() * 1000 + quiet * 1000), state.getCurrentWatermarkMs() + 1))
        if told:
            yield pd.DataFrame(told, columns=["path", "status", "hash", "first_change", "last_change", "changes"])

    timed = seen.select("path", "hash", "at").withWatermark("at", delay)
    return timed.groupBy("path").applyInPandasWithState(step, CHANGE, _KEPT, "append", GroupStateTimeout.EventTimeTimeout)


def watch(files: DataFrame, update, checkpoint: str, once: bool = True, trigger: str = "300 milliseconds", attempts: int = 3):
    """A streaming query that hands each micro-batch of changed files to update(batch, id).

    A trigger gathers what changed since the last one, so a burst of changes is one batch. An error does not end the watch and loses
    no change: a failed batch is tried up to attempts times, and one that still fails is kept below checkpoint and handed over
    together with the next batch. once: handle what is there, then stop."""
    spark, kept = files.sparkSession, f"{checkpoint}/failed"

    def path(number):
        where = spark._jvm.org.apache.hadoop.fs.Path(number if isinstance(number, str) else f"{kept}/{number}")
        return where.getFileSystem(spark._jsc.hadoopConfiguration()), where

    def failed() -> list[str]:
        fs, where = path(kept)
        return [str(x.getPath()) for x in fs.listStatus(where)] if fs.exists(where) else []

    def guarded(batch: DataFrame, number: int) -> None:
        before = failed()
        whole = batch
        for f in before:
            whole = whole.unionByName(spark.read.schema(batch.schema).parquet(f))
        for attempt in range(attempts):
            try:
                update(whole, number)
                break
            except Exception as error:  # noqa: BLE001  the watch goes on
                print(f"update {number}, attempt {attempt + 1}: {error}")
        else:
            batch.write.mode("overwrite").parquet(f"{kept}/{number}")
            return
        for f in before:
            fs, where = path(f)
            fs.delete(where, True)

    writer = files.writeStream.foreachBatch(guarded).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=trigger)).start()
