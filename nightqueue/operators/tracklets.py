"""Observations of one object: geometry and motion, discovery nights, qualifying observations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.columns import ecliptic_lat, ecliptic_lon, elongation, opposition_distance, solar_longitude, wrap180
from ..functions.sky import FINE, sky_cell, with_cells


def tracklet_features(obs: DataFrame, key: str = "trksub", order: tuple[str, ...] = ("t", "line_no")) -> DataFrame:
    """Per object with two observations at least: arc, rate, angle, geometry, residual, magnitudes, first site.

    Endpoints come with every row by a window over the object, so the residual needs no join."""
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    end = lambda f, c: f(c).over(w)
    rows = obs.select(key, *order, "ra", "dec", "mag", "obscode")
    for c in ("t", "ra", "dec"):
        rows = rows.withColumn(f"{c}0", end(F.first, c)).withColumn(f"{c}1", end(F.last, c))
    rows = rows.withColumn("site", end(F.first, "obscode")).withColumn("dt", F.greatest(F.col("t1") - F.col("t0"), F.lit(1e-6)))
    rows = rows.withColumn("cosd", F.cos(F.radians((F.col("dec0") + F.col("dec1")) / 2))).withColumn("dra", wrap180(F.col("ra1") - F.col("ra0"))).withColumn("ddec", F.col("dec1") - F.col("dec0"))
    part = (F.col("t") - F.col("t0")) / F.col("dt")
    r2 = F.pow(wrap180(F.col("ra") - (F.col("ra0") + F.col("dra") * part)) * F.col("cosd"), 2) + F.pow(F.col("dec") - (F.col("dec0") + F.col("ddec") * part), 2)
    one = ("t0", "ra0", "dec0", "dt", "cosd", "dra", "ddec", "site")
    g = rows.withColumn("r2", r2).groupBy(key).agg(F.count("*").alias("n"), *[F.first(c).alias(c) for c in one], F.avg("r2").alias("r2"), F.avg("mag").alias("mag_mean"), F.when(F.count("mag") > 1, F.max("mag") - F.min("mag")).otherwise(0.0).alias("mag_range"))
    g = g.where("n >= 2").withColumn("lon", ecliptic_lon("ra0", "dec0")).withColumn("sun", solar_longitude("t0"))
    x = F.col("dra") * F.col("cosd")
    return g.select(
        key, F.col("n").alias("nobs_tracklet"), F.col("dt").alias("arc_days_tracklet"), (F.hypot(x, F.col("ddec")) / F.col("dt")).alias("sky_rate_deg_day"), F.pmod(F.degrees(F.atan2(x, F.col("ddec"))), F.lit(360.0)).alias("motion_pa_deg"),
        ecliptic_lat("ra0", "dec0").alias("ecl_lat_deg"), elongation("lon", "sun").alias("solar_elong_deg"), opposition_distance("lon", "sun").alias("opposition_dist_deg"), (F.sqrt("r2") * 3600).alias("gc_rms_arcsec"),
        "mag_mean", "mag_range", F.col("site").alias("obscode_first"), (F.bround("dt") >= 1).cast("int").alias("multi_night"),
    )


def in_posting_window(obs: DataFrame, end_col: str = "window_end", days: float = 120, key: str = "trksub") -> DataFrame:
    """Observations from `days` before to two days after the posting; all of an object that has none there."""
    inside = F.col("t").between(F.col(end_col) - days, F.col(end_col) + 2)
    any_in = F.max(F.coalesce(inside, F.lit(False))).over(Window.partitionBy(key))
    return obs.withColumn("__any", any_in).where(~F.col("__any") | inside).drop("__any")


def discovery_tracklet(obs: DataFrame, key: str = "trksub", order: tuple[str, ...] = ("t", "line_no")) -> DataFrame:
    """The observations of the earliest day by the site of its first observation."""
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    day = F.col("t").cast("int")
    rows = obs.withColumn("__d", F.first(day).over(w)).withColumn("__s", F.first("obscode").over(w))
    return rows.where((day == F.col("__d")) & (F.col("obscode") == F.col("__s"))).drop("__d", "__s")


def earliest_site_obs(obs: DataFrame, code: str, y0: int, y1: int, key: str = "trksub") -> DataFrame:
    """The earliest (date, ra, dec) of a site within whole years; obs has a date column."""
    ok = obs.where((F.col("obscode") == code) & F.year("date").between(y0, y1))
    m = F.min(F.struct("date", "ra", "dec"))
    return ok.groupBy(key).agg(m.alias("m")).select(key, "m.date", "m.ra", "m.dec")


def by_source(rows: DataFrame, priority: list[str], least: int = 1, key: str = "trksub") -> DataFrame:
    """All rows of each object's best source, in the given order of sources; a source counts from `least` rows on."""
    rank = F.array_position(F.array(*[F.lit(p) for p in priority]), F.col("source"))
    enough = rows.groupBy(key, "source").agg(F.count("*").alias("n"), F.first(rank).alias("r")).where(F.col("n") >= least)
    best = enough.groupBy(key).agg(F.min(F.struct("r", "source"))["source"].alias("source"))
    return rows.join(best, [key, "source"], "left_semi")


#: Exposures of a date whose cells are known before the others'. Any number gives the same result.
HEAD = 256


def match_exposures(obs: DataFrame, exposures: DataFrame, radius: float, key: str = "trksub") -> DataFrame:
    """For each position the first exposure (by id) of the same date within `radius` degrees that has a stamp.

    Exposures of one date and place are one before they meet anything, and are dealt to the cells of the sky
    that they reach; a position lies in one cell. Of a cell's exposures those go that come after one which
    holds the whole cell: they are first nowhere in it. So what a position meets doesn't grow with the
    exposures of its date. Nor does what is shuffled: cells that the first HEAD exposures of a date hold are
    known before the others of that date are dealt to cells. Ids are aggregated as numbers, which needs no sort; a stamp is looked up where the
    id was first. Rows without a date or a place match nothing."""
    stamped = exposures.where("coalesce(stamp, '') <> ''")
    places = stamped.groupBy("date", F.col("ra").alias("era"), F.col("dec").alias("edec")).agg(F.min("exposure").alias("exposure"))
    deal = lambda rows: with_cells(rows, "era", "edec", radius, "__cell", FINE, "__whole")
    head = places.withColumn("__k", F.row_number().over(Window.partitionBy("date").orderBy("exposure"))).where(F.col("__k") <= HEAD).drop("__k")
    held = deal(head).where("__whole").groupBy("date").agg(F.max("exposure").alias("__last"), F.collect_set("__cell").alias("__held"))
    reached = deal(places.join(held, "date", "left")).where("__held IS NULL OR exposure <= __last OR NOT array_contains(__held, __cell)").drop("__held", "__last")
    first = reached.where("__whole").groupBy("date", "__cell").agg(F.min("exposure").alias("__least"))
    reached = reached.drop("__whole").join(first, ["date", "__cell"], "left").where("__least IS NULL OR exposure <= __least").drop("__least")
    seen = obs.select(key, "date", "ra", "dec")
    met = seen.withColumn("__cell", sky_cell("ra", "dec", radius, FINE)).join(reached, ["date", "__cell"]).where(_within("era", "edec", radius))
    won = met.groupBy(key).agg(F.min("exposure").alias("exposure"))
    # an id may stand in several rows, with other stamps: of those that match, the least stamp
    same = stamped.select("exposure", "date", F.col("ra").alias("era"), F.col("dec").alias("edec"), "stamp")
    near = seen.join(won, key).join(same, ["date", "exposure"]).where(_within("era", "edec", radius))
    return near.groupBy(key).agg(F.min(F.struct("exposure", "stamp")).alias("m")).select(key, "m.exposure", "m.stamp")


def _within(ra: str, dec: str, radius: float) -> Column:
    """Whether the position (ra, dec) lies within `radius` degrees of another."""
    d = F.pow(F.sin(F.radians(F.col("dec") - F.col(dec)) / 2), 2) + F.cos(F.radians("dec")) * F.cos(F.radians(dec)) * F.pow(F.sin(F.radians(F.col("ra") - F.col(ra)) / 2), 2)
    return F.degrees(2 * F.asin(F.sqrt(F.least(F.lit(1.0), d)))) <= radius
