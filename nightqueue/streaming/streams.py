"""Structured Streaming over the feed. Each result equals its batch twin once all input is read.

First postings and evolution are kept as parts that can be merged (see `rolling`): objects that were seen
lately are rewritten with each batch, others lie in an archive, and an object that comes back starts a
new part. Outcome keys can be forgotten after STATE_DAYS, if asked for."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.columns import followup_status, size_m
from ..operators.snapshots import evolution, evolution_parts, merged_evolution, merged_postings, posting_parts, postings
from ..sources.tables import shared_dir
from .rolling import rolled
from .sightings import first_sightings

#: How long an object may be unseen before its state can go; the longest stay on the page was 35 days.
STATE_DAYS = 60


def drain(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Runs a stream over all available input into files (append) or the session's memory (complete, bounded by groups)."""
    spark, name = stream.sparkSession, f"s{uuid.uuid4().hex}"
    at = f"{shared_dir(spark)}/stream-{name}"
    out = stream.writeStream.trigger(availableNow=True).option("checkpointLocation", f"{at}/state").outputMode(mode)
    if mode == "append":
        out.format("parquet").start(f"{at}/out").awaitTermination()
        return spark.read.schema(stream.schema).parquet(f"{at}/out")
    def put(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").parquet(f"{at}/out")
    out.foreachBatch(put).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{at}/out")


def first_postings(snap: DataFrame, path: str, days: int = STATE_DAYS) -> DataFrame:
    """first_posting of a stream's rows, read after all that is there has run: order of files doesn't matter."""
    return postings(rolled(snap, path, posting_parts, merged_postings, "last_stamp", days))


def evolutions(snap: DataFrame, path: str, days: int = STATE_DAYS) -> DataFrame:
    """evolution_features of a stream's rows."""
    return evolution(rolled(snap, path, evolution_parts, merged_evolution, "t1", days))


def outcome_stream(rows: DataFrame, keys: list[str], time_col: str | None = None, days: int = STATE_DAYS) -> DataFrame:
    """Each key once (append mode); the checkpoint makes it exactly once. With `time_col` keys are forgotten after `days`."""
    if time_col is None:
        return rows.dropDuplicates(keys)
    return rows.withWatermark(time_col, f"{days} days").dropDuplicatesWithinWatermark(keys)


def enriched_stream(snap: DataFrame, static: DataFrame, key: str = "trksub") -> DataFrame:
    """Stream rows with a static table's columns, tier and size."""
    return snap.join(static, key, "left").withColumn("followup_status", followup_status("arc", "unseen")).withColumn("size_m", size_m("h"))


def daily_stream(snap: DataFrame, late: str = "2 days", key: str | None = None, days: int = STATE_DAYS) -> DataFrame:
    """Postings, mean unseen, top score and new objects (n_new) by day; a day comes out (append mode) once the
    watermark has passed its end, and rows that are later than that are left out (our policy).

    Two stateful operators in a row: first sightings of objects within the watermark, then days. An object
    that wasn't seen for `days` days counts as new again. Without a key there is no n_new."""
    rows = snap.withWatermark("stamp", late)
    each = rows.select("stamp", F.lit(1).alias("row"), "unseen", "score", F.lit(0).alias("new"))
    if key is not None:
        first = first_sightings(rows.select(key, "stamp"), key, days)
        nothing = lambda c: F.lit(None).cast(snap.schema[c].dataType).alias(c)
        each = each.union(first.select("stamp", F.lit(0).alias("row"), nothing("unseen"), nothing("score"), F.lit(1).alias("new")))
    g = each.groupBy(F.window("stamp", "1 day").alias("w"))
    out = g.agg(F.sum("row").alias("n_rows"), F.avg("unseen").alias("mean_unseen"), F.max("score").alias("top_score"), F.sum("new").alias("n_new"))
    return out.select(F.col("w.start").alias("day"), "n_rows", "mean_unseen", "top_score", *(["n_new"] if key else []))
