"""Exact ranking metrics, conformal thresholds and deterministic splits.

Global orders, and orders within classes or tags, run as two-phase prefix sums over range partitions,
not in one task; single ranks are found by counting. Splits order rows by an integer hash of (id, rep), so that any engine can repeat them."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..sources.tables import saved
from .selection import select_ranks

#: Fixed choices of the split hash.
HASH_MUL, HASH_REP, HASH_MOD = 2654435761, 40503, 1000003


def split_hash(idc: str = "id", rep=None) -> Column:
    r = F.lit(0) if rep is None else F.col(rep)
    # the id's remainder first: the product of a large id would overflow
    return F.pmod(F.pmod(F.col(idc).cast("long"), F.lit(HASH_MOD)) * F.lit(HASH_MUL) + r.cast("long") * F.lit(HASH_REP), F.lit(HASH_MOD))


Keys = str | list[str] | None


def _keys(by: Keys) -> list[str]:
    return [by] if isinstance(by, str) else list(by or [])


def running(df: DataFrame, order: list[Column], values: dict[str, Column], by: Keys = None) -> DataFrame:
    """Adds inclusive running sums of `values` in the given total order (within `by`, if given).

    Rows are dealt to ranges of (by, order) and written with the number of their range: range bounds are
    sampled anew whenever a plan runs, so totals and rows must come from one run. A group of any size is
    spread over as many ranges as it fills. Null groups are groups."""
    keys = _keys(by)
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = df.select(*[c for c in df.columns if c not in values], *[v.alias(x) for x, v in values.items()])
    parts = saved(rows.repartitionByRange(n, *[F.col(k) for k in keys], *order).withColumn("__p", F.spark_partition_id()), "ranges")
    before = Window.partitionBy(*keys).orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    totals = parts.groupBy(*keys, "__p").agg(*[F.sum(x).alias(x) for x in values])
    totals = totals.select(F.col("__p").alias("__q"), *[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], *[F.coalesce(F.sum(x).over(before), F.lit(0)).alias(f"__{x}") for x in values])
    w = Window.partitionBy(*keys, "__p").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    inside = parts.withColumns({x: F.sum(x).over(w) for x in values})
    same = F.col("__p") == F.col("__q")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"__k{i}"))
    met = inside.join(totals if keys else F.broadcast(totals), same)  # without groups: one row per shuffle partition
    return met.select(*[c for c in rows.columns if c not in values], *[(F.col(x) + F.col(f"__{x}")).alias(x) for x in values])


def thresholds(scored: DataFrame, by: Keys = None) -> DataFrame:
    """p, pos, neg per distinct score, and tp, fp from the highest score down to it."""
    g = scored.groupBy(*_keys(by), "p").agg(F.sum(F.col("y").cast("long")).alias("pos"), F.sum((1 - F.col("y")).cast("long")).alias("neg"))
    return running(g, [F.col("p").desc()], {"tp": F.col("pos"), "fp": F.col("neg")}, by)


def ranking(scored: DataFrame, by: Keys = None) -> DataFrame:
    """roc_auc and average_precision from one table of thresholds; null where a class that they need is absent."""
    tp, fp = F.col("tp"), F.col("fp")
    sums = thresholds(scored, by).groupBy(*_keys(by)).agg(F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"), F.sum(F.col("neg") * (tp - F.col("pos") / 2)).alias("u"), F.sum(F.col("pos") * tp / (tp + fp)).alias("s"))
    auc = F.when(F.col("n_pos") * F.col("n_neg") > 0, F.col("u") / F.col("n_pos") / F.col("n_neg"))
    return sums.select(*_keys(by), auc.alias("roc_auc"), F.when(F.col("n_pos") > 0, F.col("s") / F.col("n_pos")).alias("average_precision"))


def roc_auc(scored: DataFrame, by: Keys = None) -> DataFrame:
    return ranking(scored, by).select(*_keys(by), "roc_auc")


def average_precision(scored: DataFrame, by: Keys = None) -> DataFrame:
    return ranking(scored, by).select(*_keys(by), "average_precision")


def recall_point(scored: DataFrame, target: float = 0.99, by: Keys = None, weight: Column | None = None) -> DataFrame:
    """The first row, in order (p desc, id), at which the recall target is met: threshold, recall, excluded negatives, precision."""
    w = F.lit(1.0) if weight is None else weight
    rows = scored.withColumn("__w", w)
    tot = rows.groupBy(*_keys(by)).agg(F.sum(F.when(F.col("y") == 1, F.col("__w")).otherwise(0.0)).alias("np"), F.sum(F.when(F.col("y") == 0, F.col("__w")).otherwise(0.0)).alias("nn"))
    r = running(rows, [F.col("p").desc(), F.col("id")], {"tp": F.when(F.col("y") == 1, F.col("__w")).otherwise(0.0), "fp": F.when(F.col("y") == 0, F.col("__w")).otherwise(0.0)}, by)
    met = r.join(tot, _keys(by)) if by else r.crossJoin(F.broadcast(tot))  # one row of totals
    need = F.ceil(F.lit(target) * F.col("np")) if weight is None else F.lit(target) * F.col("np")
    hit = met.where(F.col("tp") >= need - F.lit(1e-9))
    best = F.max(F.struct("p", -F.col("id"), "tp", "fp", "np", "nn"))
    g = hit.groupBy(*_keys(by)).agg(best.alias("m"))
    m = lambda c: F.col(f"m.{c}")
    return g.select(*_keys(by), m("p").alias("threshold"), F.try_divide(m("tp"), m("np")).alias("recall"), F.try_divide(m("nn") - m("fp"), m("nn")).alias("excluded"), F.try_divide(m("tp"), m("tp") + m("fp")).alias("precision"))


def prior_shift(scored: DataFrame, share: float = 0.08, target: float = 0.99) -> DataFrame:
    """The recall point when positives are weighed to the given share."""
    actual = scored.agg(F.avg(F.col("y").cast("double"))).first()[0] or 0.0
    if actual in (0.0, 1.0):
        return recall_point(scored, target)
    return recall_point(scored, target, weight=F.when(F.col("y") == 1, share / actual).otherwise((1 - share) / (1 - actual)))


def evaluate(scored: DataFrame, by: str = "tag", target: float = 0.99) -> DataFrame:
    """One record per tag with both classes: n, n_pos, roc_auc, average_precision and the recall point."""
    n = scored.groupBy(by).agg(F.count("*").alias("n"), F.sum(F.col("y").cast("long")).alias("n_pos")).where("n_pos > 0 AND n_pos < n")
    return n.join(ranking(scored, by), by).join(recall_point(scored, target, by), by)


def hash_places(rows: DataFrame, reps: int) -> DataFrame:
    """Adds rep and place: the row's rank (from 1) among those of its class y in the order of (split_hash, id), a row per rep.

    The hash of a repetition is that of the first, turned by a fixed step. So rows are ranked once, and the
    place in another repetition follows from how many of the class lie before the turn: copies are never sorted."""
    steps = [(rep, HASH_MOD - rep * HASH_REP % HASH_MOD) for rep in range(reps)]
    before = lambda cut: F.count_if(split_hash("id") < cut)
    turns = F.array(*[F.struct(F.lit(rep).alias("rep"), F.lit(cut).alias("cut"), before(cut).alias("before")) for rep, cut in steps])
    once = saved(running(rows, [split_hash("id"), F.col("id")], {"__k": F.lit(1)}, "y"), "places")
    classes = F.broadcast(saved(once.groupBy(F.col("y").alias("__y")).agg(F.count("*").alias("__n"), turns.alias("__turns")), "classes"))  # one row per class
    each = once.join(classes, F.col("y").eqNullSafe(F.col("__y"))).withColumn("__t", F.explode("__turns"))
    place = F.col("__k") - F.col("__t.before") + F.when(split_hash("id") < F.col("__t.cut"), F.col("__n")).otherwise(0)
    return each.select(*rows.columns, F.col("__t.rep").alias("rep"), place.alias("place"))


def _rank(n: Column, alpha: float) -> Column:
    return F.greatest(F.floor((n + 1) * F.lit(alpha)) - 1, F.lit(0)) + 1


def conformal_threshold(scored: DataFrame, alpha: float, by: Keys = None) -> DataFrame:
    """The positive score of rank max(floor((n + 1) alpha) - 1, 0) from below; 0 without positives.

    Scores that are null or not a number take no part; null keys are a group."""
    keys = _keys(by)
    tot = scored.groupBy(*keys).agg(F.count("*").alias("__n"))
    got = select_ranks(scored.where("y = 1"), _rank(F.col("n"), alpha), keys).withColumnsRenamed({k: f"__k{i}" for i, k in enumerate(keys)})
    same = F.lit(True)
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"__k{i}"))
    met = tot.join(got if keys else F.broadcast(got), same, "left")  # without groups: one row at most
    return met.select(*keys, F.coalesce("p", F.lit(0.0)).alias("threshold"))


def conformal_repeated(scored: DataFrame, alpha: float, n_splits: int = 40, least: int = 5) -> DataFrame:
    """Mean and deviation over stratified halves: threshold from one, recall and exclusion on the other."""
    rep = hash_places(scored.select("id", "y", "p"), n_splits).withColumn("half", F.col("place") % 2)
    rank = F.when(F.col("n") >= least, _rank(F.col("n"), alpha))
    thr = select_ranks(rep.where("half = 0 AND y = 1"), rank, ["rep"]).withColumnRenamed("p", "threshold")
    test = rep.where("half = 1").join(F.broadcast(thr), "rep")  # one row per split
    each = test.groupBy("rep").agg(F.avg(F.when(F.col("y") == 1, (F.col("p") >= F.col("threshold")).cast("double"))).alias("recall"), F.avg(F.when(F.col("y") == 0, (F.col("p") < F.col("threshold")).cast("double"))).alias("excluded"), F.max("threshold").alias("threshold"))
    return each.agg(F.count("*").alias("n_splits"), *[f(c).alias(f"{c}_{n}") for c in ("recall", "excluded", "threshold") for n, f in (("mean", F.avg), ("std", F.stddev_pop))])


def time_split(rows: DataFrame, share: float = 0.75, order: tuple[str, ...] = ("disc", "id")) -> DataFrame:
    """Adds is_train: the first share of rows by discovery."""
    n = rows.count()
    return running(rows, [F.col(c) for c in order], {"k": F.lit(1)}).withColumn("is_train", F.col("k") <= math.floor(share * n)).drop("k")


def stratified_folds(rows: DataFrame, k: int = 5, reps: int = 6) -> DataFrame:
    """rep and fold of each row; k is at most the smaller class's size."""
    small = rows.groupBy("y").count().agg(F.min("count")).first()[0] or 1
    return hash_places(rows, reps).withColumn("fold", ((F.col("place") - 1) % max(1, min(k, small))).cast("int")).drop("place")


def stratified_holdout(rows: DataFrame, share: float) -> DataFrame:
    """Adds is_test: the last share of each class in hash order."""
    return _last_share(rows, [share])


def three_way_split(rows: DataFrame, test: float = 0.2, valid: float = 0.15) -> DataFrame:
    """Adds part: train, valid or test, with the given shares of each class in hash order."""
    cut = _last_share(rows, [test, test + valid], ("__t", "__v"))
    return cut.withColumn("part", F.when(F.col("__t"), "test").when(F.col("__v"), "valid").otherwise("train")).drop("__t", "__v")


def _last_share(rows: DataFrame, shares: list[float], names: tuple[str, ...] = ("is_test",)) -> DataFrame:
    sizes = F.broadcast(rows.groupBy(F.col("y").alias("__y")).agg(F.count("*").alias("__n")))  # one row per class
    ranked = running(rows, [split_hash("id"), F.col("id")], {"__k": F.lit(1)}, "y").join(sizes, F.col("y").eqNullSafe(F.col("__y")))
    return ranked.withColumns({c: F.col("__k") > F.floor(F.col("__n") * F.lit(1 - s)) for c, s in zip(names, shares)}).drop("__k", "__n", "__y")


def balance_classes(rows: DataFrame) -> DataFrame:
    """As many rows of each class as the smallest has, in hash order (a sampling operator)."""
    least = rows.groupBy("y").count().agg(F.min("count")).first()[0] or 0
    return running(rows, [split_hash("id"), F.col("id")], {"__k": F.lit(1)}, "y").where(F.col("__k") <= least).drop("__k")


def site_frequency(rows: DataFrame, c: str = "obscode_first") -> DataFrame:
    total = rows.agg(F.count("*").alias("n"))
    g = rows.groupBy(F.coalesce(c, F.lit("")).alias(c)).agg(F.count("*").alias("k"))
    return g.crossJoin(F.broadcast(total)).select(c, (F.col("k") / F.col("n")).alias("site_freq"))  # one row of totals


def cv_summary(scored: DataFrame, by: str = "fold") -> DataFrame:
    return roc_auc(scored, by).agg(F.avg("roc_auc").alias("auc_mean"), F.stddev_pop("roc_auc").alias("auc_std"), F.count("roc_auc").alias("n_folds"))
