"""Aggregates over a whole stream with a bounded working set, exactly once.

Each micro-batch is reduced to parts (one row a key) and merged with the live parts, those of keys that were
seen in the last days. What leaves the live parts goes to an archive, a folder per batch; a key that
comes back starts a new part, and readers merge all parts of a key. Folders carry the number of the batch
that wrote them, and a batch reads only those of batches before it: if it is repeated after a failure, it
writes the same again, and what it left half done is overwritten. Live parts of the batch before last are
deleted. So what a batch reads and writes follows its own rows and the keys of the last days, not the
whole history; only readers of the result merge the archive."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F


def folders(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the batches whose folder is complete."""
    jvm = spark._jvm
    top = jvm.org.apache.hadoop.fs.Path(path)
    fs = top.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(top):
        return []
    found = [f.getPath() for f in fs.listStatus(top) if f.getPath().getName().startswith("batch=")]
    return sorted(int(p.getName().split("=")[1]) for p in found if fs.exists(jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))


def dropped(spark: SparkSession, path: str) -> None:
    top = spark._jvm.org.apache.hadoop.fs.Path(path)
    top.getFileSystem(spark._jsc.hadoopConfiguration()).delete(top, True)


def put_batch(batch: DataFrame, number: int, path: str, parts: Callable, merged: Callable, seen: str, days: int) -> None:
    """Merges a batch's rows into the live parts of the last batch before it, and archives keys unseen for `days`."""
    spark = batch.sparkSession
    new = parts(batch)
    before = [n for n in folders(spark, f"{path}/live") if n < number]
    if before:
        new = merged(spark.read.schema(new.schema).parquet(f"{path}/live/batch={before[-1]}").unionByName(new))
    new.write.mode("overwrite").parquet(f"{path}/all/batch={number}")
    whole = spark.read.schema(new.schema).parquet(f"{path}/all/batch={number}")
    newest = whole.agg(F.max(seen)).first()[0]
    gone = F.lit(False) if newest is None else F.coalesce(F.col(seen) < F.lit(newest) - F.expr(f"INTERVAL {days} DAYS"), F.lit(False))
    whole.where(gone).write.mode("overwrite").parquet(f"{path}/archive/batch={number}")
    whole.where(~gone).write.mode("overwrite").parquet(f"{path}/live/batch={number}")
    dropped(spark, f"{path}/all/batch={number}")
    for n in before[:-1]:
        dropped(spark, f"{path}/live/batch={n}")


def run_rolling(stream: DataFrame, path: str, parts: Callable, merged: Callable, seen: str, days: int) -> None:
    """Runs all available input of the stream into `path`; goes on where it stopped."""
    put = lambda batch, number: put_batch(batch, number, path, parts, merged, seen, days)
    stream.writeStream.trigger(availableNow=True).option("checkpointLocation", f"{path}/stream").foreachBatch(put).start().awaitTermination()


def result_parts(spark: SparkSession, path: str, schema, merged: Callable) -> DataFrame:
    """One part per key, of all complete batches."""
    live = folders(spark, f"{path}/live")
    if not live:
        return spark.createDataFrame([], schema)
    last = live[-1]
    names = [f"{path}/live/batch={last}", *(f"{path}/archive/batch={n}" for n in folders(spark, f"{path}/archive") if n <= last)]
    return merged(spark.read.schema(schema).parquet(*names))


def rolled(stream: DataFrame, path: str, parts: Callable, merged: Callable, seen: str, days: int) -> DataFrame:
    run_rolling(stream, path, parts, merged, seen, days)
    spark = stream.sparkSession
    return result_parts(spark, path, parts(spark.createDataFrame([], stream.schema)).schema, merged)
