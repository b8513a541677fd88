"""Images as pixel tables: cleaning, standardising, smoothing, blobs, motion, cutouts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

FRAME = ["subject", "frame"]


def clean_frames(pixels: DataFrame, crop: int | None = None) -> DataFrame:
    """Grey values of red, green, blue pixels; overlay pixels take the frame's median; optional centre crop."""
    grey = (F.col("red") + F.col("green") + F.col("blue")) / 3.0
    marked = (F.col("green") > 1.4 * F.col("red") + 20) & (F.col("green") > 1.4 * F.col("blue") + 20)
    w = Window.partitionBy(*FRAME)
    rows = pixels.withColumn("v", grey).withColumn("__m", F.median("v").over(w)).withColumn("v", F.when(marked, F.col("__m")).otherwise(F.col("v")))
    if crop is not None:
        half = crop // 2
        for c in ("r", "c"):
            mid = F.floor((F.max(c).over(w) + 1) / 2)
            rows = rows.withColumn(f"__{c}", mid)
        rows = rows.where((F.col("r") >= F.col("__r") - half) & (F.col("r") < F.col("__r") + half) & (F.col("c") >= F.col("__c") - half) & (F.col("c") < F.col("__c") + half))
    return rows.select(*FRAME, "r", "c", "v")


def standardize(pixels: DataFrame) -> DataFrame:
    w = Window.partitionBy("subject")
    return pixels.withColumn("v", (F.col("v") - F.avg("v").over(w)) / (F.stddev_pop("v").over(w) + 1e-6))


def window_pixels(pixels: DataFrame, search: int) -> DataFrame:
    """The centre window of half width `search`, with its own coordinates from 0."""
    w = Window.partitionBy(*FRAME)
    rows = pixels.withColumn("__r", F.floor((F.max("r").over(w) + 1) / 2) - search).withColumn("__c", F.floor((F.max("c").over(w) + 1) / 2) - search)
    out = rows.select(*FRAME, (F.col("r") - F.col("__r")).alias("r"), (F.col("c") - F.col("__c")).alias("c"), "v")
    return out.where(F.col("r").between(0, 2 * search - 1) & F.col("c").between(0, 2 * search - 1))


def box_smooth(pixels: DataFrame) -> DataFrame:
    """3 x 3 means with zeros outside, for the cells that exist: each pixel is added to its neighbours."""
    steps = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (-1, 0, 1) for b in (-1, 0, 1)])
    # dealt by frame before pixels are copied, so that the sums and what callers then do by frame need no other exchange
    spread = pixels.repartition(*FRAME).withColumn("s", F.explode(steps)).select(*FRAME, (F.col("r") + F.col("s.a")).alias("r"), (F.col("c") + F.col("s.b")).alias("c"), "v", ((F.col("s.a") == 0) & (F.col("s.b") == 0)).alias("own"))
    g = spread.groupBy(*FRAME, "r", "c").agg((F.sum("v") / 9.0).alias("sm"), F.max(F.when(F.col("own"), F.col("v"))).alias("v"), F.max("own").alias("own"))
    return g.where("own").drop("own")


def blob_peaks(pixels: DataFrame, search: int = 100) -> DataFrame:
    """The brightest smoothed cell of each frame's centre window: offset, signal to noise, flux."""
    sm = box_smooth(window_pixels(pixels, search))
    w = Window.partitionBy(*FRAME)
    sm = sm.withColumn("med", F.median("v").over(w))
    best = F.max(F.struct("sm", (-(F.col("r") * 2 * search + F.col("c"))).alias("k"), "r", "c"))
    g = sm.groupBy(*FRAME).agg(F.first("med").alias("med"), (F.median(F.abs(F.col("v") - F.col("med"))) + 1e-6).alias("mad"), best.alias("b"))
    flux = F.col("b.sm") - F.col("med")
    return g.select(*FRAME, (F.col("b.r") - search).alias("r"), (F.col("b.c") - search).alias("c"), (flux / (1.4826 * F.col("mad"))).alias("snr"), flux.alias("flux"))


def motion_features(blobs: DataFrame, least_snr: float = 3.0) -> DataFrame:
    """Consistency of the motion of each subject's blobs; fits need three detections."""
    w = Window.partitionBy("subject").orderBy("frame")
    det = F.col("snr") > least_snr
    rows = blobs.withColumn("det", det).withColumn("step", F.hypot(F.col("r") - F.lag("r").over(w), F.col("c") - F.lag("c").over(w)))
    fit = lambda f, y: F.expr(f"{f}(CAST({y} AS DOUBLE), CAST(frame AS DOUBLE)) FILTER (WHERE det)")
    one = rows.groupBy("subject").agg(
        F.count_if("det").alias("n_detected"), fit("regr_slope", "r").alias("rs"), fit("regr_intercept", "r").alias("ri"), fit("regr_slope", "c").alias("cs"), fit("regr_intercept", "c").alias("ci"),
        (F.stddev_pop("step") / (F.avg("step") + 1e-6)).alias("step_cv"), F.max("step").alias("max_step_px"), F.min("snr").alias("min_snr"), F.avg("snr").alias("mean_snr"),
        F.coalesce(F.stddev_pop(F.when(F.col("det"), F.col("flux"))), F.stddev_pop("flux")).alias("fs"), F.coalesce(F.avg(F.when(F.col("det"), F.col("flux"))), F.avg("flux")).alias("fm"),
    )
    off = F.pow(F.col("r") - F.col("ri") - F.col("rs") * F.col("frame"), 2) + F.pow(F.col("c") - F.col("ci") - F.col("cs") * F.col("frame"), 2)
    rms = rows.where("det").join(one.select("subject", "rs", "ri", "cs", "ci"), "subject").groupBy("subject").agg(F.sqrt(F.avg(off)).alias("rms"))
    fits = F.col("n_detected") >= 3
    return one.join(rms, "subject", "left").select("subject", "n_detected", F.when(fits, F.col("rms")).alias("linearity_rms"), F.when(fits, F.hypot("rs", "cs")).alias("rate_px_frame"), "step_cv", (F.col("fs") / (F.abs("fm") + 1e-6)).alias("flux_cv"), "max_step_px", "min_snr", "mean_snr")


def motion_score():
    """0.01 to 0.99: moves in a line, steadily, with steady brightness; 0.15 where barely detected."""
    over = lambda c, a, b: F.exp(-F.greatest(F.col(c) - a, F.lit(0.0)) / b)
    s = over("linearity_rms", 2.0, 6.0) * over("step_cv", 0.25, 0.5) * over("flux_cv", 0.6, 1.0) * F.when(F.col("rate_px_frame") < 1.0, 0.3).otherwise(1.0)
    return F.when((F.col("n_detected") < 3) | F.col("linearity_rms").isNull(), 0.15).otherwise(F.least(F.lit(0.99), F.greatest(F.lit(0.01), s)))


def cutout_features(pixels: DataFrame, key: str = "trksub", least: int = 100) -> DataFrame:
    """Features of difference-image cutouts; null pixels are masked; degenerate ones have has_cutout 0."""
    w = Window.partitionBy(key)
    rows = pixels.withColumn("med", F.median("v").over(w)).withColumn("dr", F.col("r") - F.floor((F.max("r").over(w) + 1) / 2)).withColumn("dc", F.col("c") - F.floor((F.max("c").over(w) + 1) / 2))
    rows = rows.withColumn("rc", F.sqrt((F.col("dr") * F.col("dr") + F.col("dc") * F.col("dc")).cast("double"))).withColumn("up", F.greatest(F.col("v") - F.col("med"), F.lit(0.0)))
    within = lambda r, x: F.when((F.col("rc") <= r) & F.col("v").isNotNull(), x)
    g = rows.groupBy(key).agg(
        F.count("v").alias("n"), (F.max("v") - F.min("v")).alias("ptp"), F.first("med").alias("med"), (F.median(F.abs(F.col("v") - F.col("med"))) * 1.4826 + 1e-6).alias("mad"), F.max(within(5, F.col("v"))).alias("peak"),
        F.coalesce(F.sum(within(5, F.col("up"))), F.lit(0.0)).alias("pos"), F.coalesce(F.sum(within(1.5, F.col("up"))), F.lit(0.0)).alias("core"), F.coalesce(F.sum(within(2.5, F.col("up"))), F.lit(0.0)).alias("box"),
        F.coalesce(F.avg(within(5, (F.col("v") < F.col("med")).cast("double"))), F.lit(0.0)).alias("neg"), F.avg(F.col("v").isNull().cast("double")).alias("masked"),
    )
    ok = (F.col("n") >= least) & (F.col("ptp") >= 1e-3)
    keep = lambda x: F.when(ok, x)
    return g.select(key, ok.cast("int").alias("has_cutout"), keep((F.coalesce("peak", "med") - F.col("med")) / F.col("mad")).alias("snr"), keep(F.col("pos")).alias("pos_flux"), keep(F.col("core") / (F.col("box") + 1e-6)).alias("compactness"), keep(F.col("neg")).alias("neg_frac"), F.col("masked").alias("masked_frac"), keep(F.col("mad")).alias("bkg_mad"))


def alignment_guard(a: DataFrame, b: DataFrame, key: str = "subject", label: str = "y") -> DataFrame:
    """One row: keys on one side only, labels that differ, and whether the tables may be fused."""
    j = a.select(key, F.col(label).alias("ya"), F.lit(1).alias("ina")).join(b.select(key, F.col(label).alias("yb"), F.lit(1).alias("inb")), key, "full_outer")
    g = j.agg(F.count_if(F.col("ina").isNull() | F.col("inb").isNull()).alias("unmatched"), F.count_if(F.col("ina").isNotNull() & F.col("inb").isNotNull() & ~F.col("ya").eqNullSafe(F.col("yb"))).alias("differing"))
    return g.withColumn("aligned", (F.col("unmatched") == 0) & (F.col("differing") == 0))
