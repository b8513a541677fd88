"""Feed snapshots: first and latest posting, evolution, positions and motion."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.columns import SLOPE_FLOOR, followup_status, rate_parts, size_m, wrap_hours


def _micros(c: str):
    return F.unix_micros(F.col(c).cast("timestamp"))


FIELDS = ("score", "nobs", "arc", "unseen", "v", "h")


def posting_parts(snap: DataFrame, key: str = "trksub", order: tuple[str, ...] = ("stamp", "tie")) -> DataFrame:
    """What first_posting has to know of some of an object's rows: its first row, last stamp and last values. Parts can be merged."""
    o = F.struct(*order)
    rest = [c for c in snap.columns if c != key]
    last = F.struct(o.alias("o"), F.struct(*FIELDS).alias("x"))
    return snap.groupBy(key).agg(F.min(F.struct(o.alias("o"), F.struct(*rest).alias("x"))).alias("first"), F.max("stamp").alias("last_stamp"), F.max(last).alias("last"))


def merged_postings(parts: DataFrame, key: str = "trksub") -> DataFrame:
    return parts.groupBy(key).agg(F.min("first").alias("first"), F.max("last_stamp").alias("last_stamp"), F.max("last").alias("last"))


def postings(parts: DataFrame, key: str = "trksub") -> DataFrame:
    """The result of first_posting from one part per object."""
    rest = [f.name for f in parts.schema["first"].dataType["x"].dataType]
    return parts.select(key, *[F.col(f"first.x.{c}").alias(c) for c in rest], "last_stamp", *[F.col(f"last.x.{c}").alias(f"latest_{c}") for c in FIELDS])


def first_posting(snap: DataFrame, key: str = "trksub", order: tuple[str, ...] = ("stamp", "tie")) -> DataFrame:
    """Each object's first posting, its last stamp and latest values; one shuffle."""
    return postings(posting_parts(snap, key, order), key)


def discoveries(snap: DataFrame, gap_days: int = 60, key: str = "trksub", order: tuple[str, ...] = ("stamp", "tie")) -> DataFrame:
    """The first posting of each epoch of an object, with its number: an epoch ends when the object is unseen
    for more than `gap_days` days. Rows are reduced to days first, so an object has at most one row a day to sort."""
    rest = [c for c in snap.columns if c != key]
    days = snap.groupBy(key, F.col("stamp").cast("date").alias("__day")).agg(F.min(F.struct(F.struct(*order).alias("o"), F.struct(*rest).alias("x")))["x"].alias("f"))
    w = Window.partitionBy(key).orderBy("__day")
    begins = days.withColumn("__was", F.lag("__day").over(w)).where(F.col("__was").isNull() | (F.datediff("__day", "__was") > gap_days))
    return begins.withColumn("epoch", F.row_number().over(w)).select(key, *[F.col(f"f.{c}").alias(c) for c in rest], "epoch")


#: Fields whose change evolution follows.
FOLLOWED = ("score", "arc", "nobs", "unseen", "v")


def evolution_parts(snap: DataFrame, key: str = "trksub", order: tuple[str, ...] = ("stamp", "tie")) -> DataFrame:
    """What evolution has to know of some of an object's rows; parts can be merged."""
    known = lambda c: F.when(F.col(c).isNotNull(), F.struct(*order, F.col(c).cast("double").alias("x")))
    ends = [f(known(c)).alias(f"{c}_{n}") for c in FOLLOWED for n, f in (("a", F.min), ("b", F.max))]
    return snap.groupBy(key).agg(F.count("*").alias("n"), F.min("stamp").alias("t0"), F.max("stamp").alias("t1"), F.max("unseen").alias("unseen_max"), *ends)


def merged_evolution(parts: DataFrame, key: str = "trksub") -> DataFrame:
    ends = [f(f"{c}_{n}").alias(f"{c}_{n}") for c in FOLLOWED for n, f in (("a", F.min), ("b", F.max))]
    return parts.groupBy(key).agg(F.sum("n").alias("n"), F.min("t0").alias("t0"), F.max("t1").alias("t1"), F.max("unseen_max").alias("unseen_max"), *ends)


def evolution(parts: DataFrame, key: str = "trksub") -> DataFrame:
    """Change of each object's values from its first to its last snapshot, from one part per object."""
    g = parts.withColumn("span", (_micros("t1") - _micros("t0")) / 86400e6)
    delta = lambda c: F.col(f"{c}_b")["x"] - F.col(f"{c}_a")["x"]
    slope = lambda c: F.when(delta(c).isNotNull(), F.when(F.col("span") > SLOPE_FLOOR, delta(c) / F.col("span")).otherwise(0.0))
    return g.select(key, F.col("n").alias("ts_n_snapshots"), F.round("span", 3).alias("ts_span_days"), delta("score").alias("ts_score_delta"), slope("score").alias("ts_score_slope"), delta("arc").alias("ts_arc_growth"), delta("nobs").alias("ts_nobs_growth"), slope("nobs").alias("ts_nobs_rate"), F.col("unseen_max").alias("ts_unseen_max"), delta("unseen").alias("ts_unseen_trend"), delta("v").alias("ts_v_faded"))


def evolution_features(snap: DataFrame, key: str = "trksub", order: tuple[str, ...] = ("stamp", "tie")) -> DataFrame:
    """Change of each object's values from its first to its last snapshot; nulls are skipped per field."""
    return evolution(evolution_parts(snap, key, order), key)


def evolution_summary(ev: DataFrame) -> DataFrame:
    return ev.agg(F.count("*").alias("n_objects"), F.count_if(F.col("ts_n_snapshots") > 1).alias("n_repeated"), F.median("ts_nobs_growth").alias("median_nobs_growth"))


def position_history(snap: DataFrame, key: str = "trksub", order: tuple[str, ...] = ("stamp", "tie")) -> DataFrame:
    """Positions in time without consecutive repeats, with their number."""
    w = Window.partitionBy(key).orderBy(*order)
    was = snap.withColumn("__ra", F.lag("ra_h").over(w)).withColumn("__dec", F.lag("dec_deg").over(w)).withColumn("__n", F.row_number().over(w))
    new = was.where((F.col("__n") == 1) | ~F.col("ra_h").eqNullSafe(F.col("__ra")) | ~F.col("dec_deg").eqNullSafe(F.col("__dec")))
    return new.select(key, *order, "ra_h", "dec_deg").withColumn("pos", F.row_number().over(w))


def motion_rate(history: DataFrame, key: str = "trksub") -> DataFrame:
    """Hours and degrees a day from the last two distinct positions; null with fewer."""
    w = Window.partitionBy(key).orderBy(F.col("pos").desc())
    last = history.withColumn("k", F.row_number().over(w)).where("k <= 2")
    at = lambda c, k: F.max(F.when(F.col("k") == k, F.col(c)))
    g = last.groupBy(key).agg(*[at(c, k).alias(f"{c}{k}") for c in ("ra_h", "dec_deg", "stamp") for k in (1, 2)])
    days = (_micros("stamp1") - _micros("stamp2")) / 86400e6
    d = F.when(days > 0, days)
    return g.select(key, F.col("ra_h1").alias("ra_h"), F.col("dec_deg1").alias("dec_deg"), F.col("stamp1").alias("stamp"), (wrap_hours(F.col("ra_h1") - F.col("ra_h2")) / d).alias("ra_rate"), ((F.col("dec_deg1") - F.col("dec_deg2")) / d).alias("dec_rate"))


def motion_or_tracklet(rates: DataFrame, tracks: DataFrame, key: str = "trksub") -> DataFrame:
    """motion_rate, with the rate and angle of the object's tracklet where there are fewer than two positions; 0 without either."""
    met = rates.join(tracks.select(key, "sky_rate_deg_day", "motion_pa_deg"), key, "left")
    known = lambda c: F.coalesce(c, F.lit(0.0))
    east, north = rate_parts(known(F.col("sky_rate_deg_day")), known(F.col("motion_pa_deg")), "dec_deg")
    return met.select(*[c for c in rates.columns if c not in ("ra_rate", "dec_rate")], F.coalesce("ra_rate", east / 15).alias("ra_rate"), F.coalesce("dec_rate", north).alias("dec_rate"))


def vetting_rows(snap: DataFrame) -> DataFrame:
    """First postings with tier, size and probability: the rows of the queue."""
    f = first_posting(snap)
    return f.select("trksub", "score", "v", "h", "nobs", "arc", "unseen", followup_status("arc", "unseen").alias("followup_status"), size_m("h").alias("size_m"), F.coalesce(F.col("score") / 100, F.lit(0.0)).alias("p"))


def current_only(rows: DataFrame, snap: DataFrame, key: str = "trksub") -> DataFrame:
    """Rows of objects on the newest snapshot."""
    newest = snap.agg(F.max("stamp").alias("stamp"))
    return rows.join(snap.join(F.broadcast(newest), "stamp", "left_semi").select(key), key, "left_semi")


def rolled_off(rows: DataFrame, snap: DataFrame, key: str = "trksub") -> DataFrame:
    newest = snap.agg(F.max("stamp").alias("stamp"))
    return rows.join(snap.join(F.broadcast(newest), "stamp", "left_semi").select(key), key, "left_anti")


def frame_summary(snap: DataFrame) -> DataFrame:
    return snap.agg(F.count("*").alias("n"), F.min("score").alias("lowest"), F.max("score").alias("highest"), F.count_if(F.col("score") >= 90).alias("n_high"), F.count_if(F.col("unseen") > 3).alias("n_at_risk"))
