"""Isotonic calibration: the nondecreasing step function of a score that fits the labels best (least squares).

Adjacent violators are pooled in two phases. Rows are grouped by score and dealt to ranges of scores, which pool
their own; then pairs of neighbouring ranges pool across their borders, in rounds, until every border is in order.
Pooling in any order ends at the same blocks. Blocks of equal means become one, so with labels 0 and 1 and no
weights n rows leave at most some n^(2/3) blocks, however the scores lie.

Rows without score or label, and rows whose weight is null or not positive, take no part in a fit. Scores are
compared as doubles; NaN counts as no score. A fit on no rows has no blocks, and calibrates to null."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..sources.tables import saved
from .metrics import running

BLOCK = "part int, lo double, hi double, weight double, total double"


def pooled(blocks: Iterable[tuple]) -> list[list]:
    """(lo, hi, weight, total) in order of lo, until the means rise from each to the next."""
    out: list[list] = []
    for lo, hi, weight, total in blocks:
        out.append([lo, hi, weight, total])
        while len(out) > 1 and out[-2][3] * out[-1][2] >= out[-1][3] * out[-2][2]:
            _, hi, weight, total = out.pop()
            out[-1][1:] = [hi, out[-1][2] + weight, out[-1][3] + total]
    return out


def _frame(part: int, blocks: list[list]) -> pd.DataFrame:
    out = pd.DataFrame(blocks, columns=["lo", "hi", "weight", "total"])
    out.insert(0, "part", part)
    return out


def _rows(frame: pd.DataFrame) -> Iterable[tuple]:
    return frame[["lo", "hi", "weight", "total"]].itertuples(index=False, name=None)


def pool_range(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The blocks of one range; rows come in order and carry the range's number."""
    part, blocks = 0, []
    for frame in frames:
        if len(frame):
            part, blocks = int(frame["part"].iloc[0]), pooled([*map(tuple, blocks), *_rows(frame)])
    yield _frame(part, blocks)


def pool_pair(frame: pd.DataFrame) -> pd.DataFrame:
    """The blocks of two neighbouring ranges; each stays with the range that it begins in."""
    frame = frame.sort_values("lo")
    part = dict(zip(frame["lo"], frame["part"]))
    blocks = pooled(_rows(frame))
    out = _frame(0, blocks)
    out["part"] = [part[b[0]] for b in blocks]
    return out


def isotonic_fit(scored: DataFrame, weight: Column | None = None) -> DataFrame:
    """lo, hi (scores), weight, value: one row per block, of rising values. scored: p, y."""
    w = F.lit(1.0) if weight is None else weight.cast("double")
    rows = scored.select(F.nanvl(F.col("p").cast("double"), F.lit(None)).alias("p"), F.col("y").cast("double").alias("y"), w.alias("w")).where("p IS NOT NULL AND y IS NOT NULL AND w > 0")
    sums = rows.groupBy("p").agg(F.sum("w").alias("weight"), F.sum(F.col("w") * F.col("y")).alias("total"))
    n = int(scored.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges = sums.repartitionByRange(n, "p").sortWithinPartitions("p").select(F.spark_partition_id().alias("part"), F.col("p").alias("lo"), F.col("p").alias("hi"), "weight", "total")
    blocks = saved(ranges.mapInPandas(pool_range, BLOCK), "isotonic")
    side = 0
    while True:
        # one row per range that still has blocks: at most as many as shuffle partitions
        ends = blocks.groupBy("part").agg(F.min_by(F.col("total") / F.col("weight"), "lo").alias("first"), F.max_by(F.col("total") / F.col("weight"), "lo").alias("last"))
        order = Window.orderBy("part")
        ends = ends.select("part", (F.row_number().over(order) - 1).alias("k"), (F.col("last") >= F.lead("first").over(order)).alias("open"))
        found = ends.orderBy("k").collect()
        open_ = [r["k"] for r in found if r["open"]]
        if not open_:
            return blocks.select("lo", "hi", "weight", (F.col("total") / F.col("weight")).alias("value"))
        if not any(k % 2 == side for k in open_):
            side = 1 - side
        # ranges 2i + side and 2i + side + 1 of those left meet
        numbers = scored.sparkSession.createDataFrame([(r["part"], (r["k"] + side) // 2) for r in found], "part int, pair int")
        blocks = saved(blocks.join(F.broadcast(numbers), "part").groupBy("pair").applyInPandas(lambda f: pool_pair(f.drop(columns="pair")), BLOCK), "isotonic")
        side = 1 - side


def isotonic_apply(df: DataFrame, blocks: DataFrame, score: str = "p", out: str = "calibrated") -> DataFrame:
    """Adds the value of the block that holds the score, or of the last one below it; below all, the first one's.

    Rows meet blocks by the running number of blocks that begin at or before them, so blocks may be many."""
    columns = [F.col(c) for c in df.columns if c != out]
    rows = df.select(F.struct(*columns).alias("__row"), F.nanvl(F.col(score).cast("double"), F.lit(None)).alias("__score"), F.lit(None).cast("double").alias("__value"), F.lit(0).alias("__kind"))
    begins = blocks.select(F.lit(None).cast(rows.schema["__row"].dataType).alias("__row"), F.col("lo").alias("__score"), F.col("value").alias("__value"), F.lit(-1).alias("__kind"))
    known = rows.where("__score IS NOT NULL")
    numbered = saved(running(known.unionByName(begins), [F.col("__score"), F.col("__kind")], {"__k": -F.col("__kind")}), "calibrated")
    steps = numbered.where("__kind = -1").select("__k", F.col("__value").alias("__v"))
    met = numbered.where("__kind = 0").withColumn("__k", F.greatest("__k", F.lit(1))).join(steps, "__k", "left")
    return met.select("__row.*", F.col("__v").alias(out)).unionByName(rows.where("__score IS NULL").select("__row.*", F.lit(None).cast("double").alias(out)))
