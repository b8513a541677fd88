"""A keyed log that a stream appends to, each key once.

The log is a table of Parquet files in folders writer=.../batch=...; rows that were there before any stream
are a writer of their own. A batch takes the rows whose key neither the folders of other writers nor those of
its writer's other batches hold, and overwrites its own folder: a batch that is repeated, because the
stream died between the write and the commit, changes nothing. Two writers that run at the same time can't
see each other's last batch; readers then keep, of equal keys, the row that stands first by writer and batch."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType


def log_files(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """All rows of the log with the writer and batch of their folder."""
    whole = StructType([*schema.fields, StructField("writer", StringType()), StructField("batch", LongType())])
    top = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not top.getFileSystem(spark._jsc.hadoopConfiguration()).exists(top):
        return spark.createDataFrame([], whole)
    return spark.read.schema(whole).option("basePath", path).parquet(path)


def read_log(spark: SparkSession, path: str, schema: StructType, keys: list[str]) -> DataFrame:
    """The log's rows, each key once; null keys count as equal."""
    w = Window.partitionBy(*keys).orderBy("writer", "batch")
    return log_files(spark, path, schema).withColumn("__k", F.row_number().over(w)).where("__k = 1").drop("__k", "writer", "batch")


def equal_keys(a: DataFrame, b: DataFrame, keys: list[str]) -> Column:
    return reduce(lambda x, y: x & y, [a[k].eqNullSafe(b[k]) for k in keys])


def put_log_batch(rows: DataFrame, number: int, path: str, keys: list[str], writer: str) -> None:
    """Writes the rows of a batch whose keys are new to the log, in place of what an earlier try left."""
    known = log_files(rows.sparkSession, path, rows.schema).where(~((F.col("writer") == writer) & (F.col("batch") == number))).select(*keys)
    new = rows.dropDuplicates(keys)
    new.join(known, equal_keys(new, known, keys), "left_anti").write.mode("overwrite").parquet(f"{path}/writer={writer}/batch={number}")


def start_log(rows: DataFrame, path: str, keys: list[str]) -> None:
    """Rows from before any stream."""
    put_log_batch(rows, 0, path, keys, "0-start")


def append_stream(rows: DataFrame, path: str, keys: list[str], writer: str, state: str) -> None:
    """Appends all available input of a stream; `state` is its checkpoint folder, one per writer."""
    put = lambda batch, number: put_log_batch(batch, number, path, keys, writer)
    rows.writeStream.trigger(availableNow=True).option("checkpointLocation", state).foreachBatch(put).start().awaitTermination()
