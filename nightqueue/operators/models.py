"""Classifiers on MLlib: fitting, out-of-fold scores, queue scores, fusion, comparison."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import Imputer, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.columns import MAIN_BELT, SITES
from ..sources.tables import saved
from .boosting import Options, boosted_scores, fit_boosted
from .images import alignment_guard
from .metrics import conformal_repeated, stratified_folds, stratified_holdout

#: Rows below which the logistic pipeline is used, not trees.
SMALL = 200


def augment(df: DataFrame, freq: DataFrame | None = None) -> DataFrame:
    """Derived features of sub-scores, one-hot sites, and the site's share of training rows (0 if unseen)."""
    c = lambda n: F.col(n)
    belt = sum((F.coalesce(c(f"d2_{m}_noid"), F.lit(0)) for m in MAIN_BELT), F.lit(0))
    out = df.withColumn("mb_sum", belt).withColumn("neo_minus_mb", c("d2_NEO_noid") - F.col("mb_sum")).withColumn("noid_minus_raw", c("d2_NEO_noid") - c("d2_NEO_raw")).withColumn("neo_minus_mc", c("d2_NEO_noid") - c("d2_MC_noid"))
    site = F.coalesce("obscode_first", F.lit(""))
    for s in SITES:
        out = out.withColumn(f"site_{s}", (site == s).cast("double"))
    if freq is not None:
        known = freq.select(F.col("obscode_first").alias("__site"), "site_freq")
        out = out.withColumn("__s", site).join(known, F.col("__s") == F.col("__site"), "left").drop("__s", "__site").withColumn("site_freq", F.coalesce("site_freq", F.lit(0.0)))
    return out


def model_columns(df: DataFrame, allowed: tuple[str, ...], prefix: str = "d2_") -> list[str]:
    return sorted(c for c in df.columns if c in allowed or c.startswith(prefix))


def weighted(df: DataFrame) -> DataFrame:
    """Adds class weights that balance the labels."""
    n = {r["y"]: r["count"] for r in df.groupBy("y").count().collect()}
    total = sum(n.values())
    w = F.lit(1.0)
    for y, k in n.items():
        w = F.when(F.col("y") == y, total / (len(n) * k)).otherwise(w)
    return df.withColumn("weight", w).withColumn("label", F.col("y").cast("double"))


def missing_flags(df: DataFrame, cols: list[str]) -> DataFrame:
    for c in cols:
        df = df.withColumn(c, F.col(c).cast("double")).withColumn(f"{c}_missing", F.col(c).isNull().cast("double"))
    return df


def fit_vetting(df: DataFrame, cols: list[str], small: bool | None = None, seed: int = 7, rounds: int = 20) -> PipelineModel:
    """Logistic pipeline below SMALL rows, else depth-4 boosted trees; medians for missing values, which trees also see as flags."""
    small = df.count() < SMALL if small is None else small
    imputer = Imputer(inputCols=cols, outputCols=[f"{c}_i" for c in cols], strategy="median")
    names = [f"{c}_i" for c in cols] + ([] if small else [f"{c}_missing" for c in cols])
    vector = VectorAssembler(inputCols=names, outputCol="v")
    tail = [StandardScaler(inputCol="v", outputCol="x", withMean=True), LogisticRegression(featuresCol="x", weightCol="weight")] if small else [GBTClassifier(featuresCol="v", maxDepth=4, maxIter=rounds, weightCol="weight", seed=seed, stepSize=0.1)]
    return Pipeline(stages=[imputer, vector, *tail]).fit(weighted(missing_flags(df, cols)))


def scored(df: DataFrame, model: PipelineModel, cols: list[str], keep: tuple[str, ...] = ("id", "y")) -> DataFrame:
    return model.transform(missing_flags(df, cols)).select(*keep, vector_to_array("probability")[1].alias("p"))


def oof_scores(df: DataFrame, cols: list[str], k: int = 3, small: bool = True) -> DataFrame:
    """Every row scored by a model that its fold didn't train."""
    folds = saved(stratified_folds(df, k, 1).drop("rep"), "folds")
    n = folds.agg(F.max("fold")).first()[0] or 0
    out = None
    for f in range(n + 1):
        part = scored(folds.where(F.col("fold") == f), fit_vetting(folds.where(F.col("fold") != f), cols, small), cols, ("id", "y", "fold"))
        out = part if out is None else out.unionByName(part)
    return out


def oof_conformal(df: DataFrame, cols: list[str], alpha: float, k: int = 3, n_splits: int = 40) -> DataFrame:
    """The conformal step on out-of-fold scores: no score comes from a model that saw its row."""
    return conformal_repeated(saved(oof_scores(df, cols, k), "oof"), alpha, n_splits)


def save_artifact(path: str, model: PipelineModel, cols: list[str], freq: DataFrame, n: int, mode: str) -> None:
    """A model with all that scoring needs: its columns, the sites' training shares, rows and mode."""
    spark = freq.sparkSession
    model.write().overwrite().save(f"{path}/model")
    freq.write.mode("overwrite").parquet(f"{path}/site_frequency")
    spark.createDataFrame([(cols, n, mode)], "columns array<string>, n long, mode string").coalesce(1).write.mode("overwrite").json(f"{path}/about")


def load_artifact(spark: SparkSession, path: str) -> tuple[PipelineModel, list[str], DataFrame]:
    about = spark.read.schema("columns array<string>, n long, mode string").json(f"{path}/about").first()
    return PipelineModel.load(f"{path}/model"), about["columns"], spark.read.parquet(f"{path}/site_frequency")


def compare_vectors(rows: DataFrame, seeds: tuple[int, ...] = (1, 2, 3), share: float = 0.25, rounds: int = 10) -> DataFrame:
    """tag, seed, id, y, p of held-out rows: a logistic on the score alone, trees on motion and on pixels, and
    a logistic over all three. rows: id, y, d2, x_img and x_mot (vectors). Each seed holds out another share."""
    out = None
    for seed in seeds:
        cut = saved(stratified_holdout(rows.withColumn("__id", F.col("id")).withColumn("id", F.xxhash64("id", F.lit(seed)) % 1_000_003), share).withColumn("id", F.col("__id")).drop("__id"), "holdout")
        train, test = weighted(cut.where(~F.col("is_test"))), cut.where("is_test")
        fits = {"score": ["d2"], "motion": ["x_mot"], "pixels": ["x_img"], "fused": ["d2", "x_mot", "x_img"]}
        for tag, cols in fits.items():
            vector = VectorAssembler(inputCols=cols, outputCol="v")
            last = GBTClassifier(featuresCol="v", maxDepth=4, maxIter=rounds, weightCol="weight", seed=seed) if tag in ("motion", "pixels") else LogisticRegression(featuresCol="v", weightCol="weight", regParam=0.01)
            model = Pipeline(stages=[vector, last]).fit(train)
            part = model.transform(test).select(F.lit(tag).alias("tag"), F.lit(seed).alias("seed"), "id", "y", vector_to_array("probability")[1].alias("p"))
            out = part if out is None else out.unionByName(part)
    return out


def score_queue(features: DataFrame, model: PipelineModel | None = None, cols: list[str] | None = None) -> DataFrame:
    """Probabilities of a model, or of the feed's score where there is none; highest first."""
    if model is None:
        return features.withColumn("p", F.coalesce(F.col("score") / 100, F.lit(0.0)))
    return model.transform(missing_flags(features, cols)).withColumn("p", vector_to_array("probability")[1]).select(*features.columns, "p")


def late_fusion(scores: DataFrame, feats: DataFrame, cols: list[str], key: str = "id", small: bool = True, zero_is_missing: tuple[str, ...] = (), share: float = 0.25, boosted: Options | None = None) -> DataFrame:
    """p of held-out rows by a model over an image logit, the feed score, magnitude and motion, joined by subject;
    0 in `zero_is_missing` means none. The model is fitted on the other rows: boosted trees with options `boosted`, else
    `fit_vetting`. Where `scores` carries labels, both sides must have the same subjects and labels, or nothing is fused: no rows."""
    if "y" in scores.columns:
        aligned = alignment_guard(scores, feats, key).first()["aligned"]
        scores = scores.drop("y") if aligned else scores.drop("y").limit(0)
    rows = feats.join(scores, key)
    for c in zero_is_missing:
        rows = rows.withColumn(c, F.nullif(F.col(c).cast("double"), F.lit(0.0)))
    cut = saved(stratified_holdout(rows.withColumnRenamed(key, "id"), share), "fusion-holdout")
    train, test = cut.where(~F.col("is_test")), cut.where("is_test")
    if train.isEmpty():
        return test.select(F.col("id").alias(key), "y", F.lit(None).cast("double").alias("p"))
    found = boosted_scores(test, fit_boosted(train, cols, boosted)) if boosted else scored(test, fit_vetting(train, cols, small), cols)
    return found.withColumnRenamed("id", key)


def compare_models(df: DataFrame, sets: dict[str, list[str]], k: int = 3) -> DataFrame:
    """Out-of-fold scores of each set of columns under its tag."""
    out = None
    for tag, cols in sets.items():
        part = oof_scores(df, cols, k).withColumn("tag", F.lit(tag))
        out = part if out is None else out.unionByName(part)
    return out
