"""The driver's tables, and tables cut from their lineage where every executor can read them again."""

from __future__ import annotations

import contextlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

from ..sources.tables import saved, shared_dir

__all__ = ["rows_a_batch", "saved", "shared_dir", "table"]

BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


@contextlib.contextmanager
def rows_a_batch(spark: SparkSession, most: int) -> Iterator[None]:
    """What is run inside gives Python at most so many rows at a time: a batch stands in memory on both sides."""
    before = spark.conf.get(BATCH)
    if not 0 < int(before) <= most:
        spark.conf.set(BATCH, str(most))
    try:
        yield
    finally:
        spark.conf.set(BATCH, before)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
