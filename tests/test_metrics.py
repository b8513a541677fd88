"""Running sums and splits on tables that a range partitioner samples."""

import pytest
from nightqueue.operators import metrics as M
from pyspark.sql import Window, functions as F


@pytest.fixture(scope="module")
def many(spark):
    """300,000 rows with wide columns, one tag for a third of them, and ties in p."""
    i = F.col("id")
    return spark.range(300_000).select(i, (F.xxhash64(i) % 1000 / 1000.0).alias("p"), F.when(i % 3 == 0, "hot").when(i % 1000 > 1, F.concat(F.lit("t"), i % 7)).alias("tag"), (F.pmod(F.xxhash64(i, F.lit(1)), F.lit(4)) == 0).cast("long").alias("y"), F.sha2(i.cast("string"), 256).alias("wide"), F.pmod(F.xxhash64(i, F.lit(2)), F.lit(500)).alias("disc"))


@pytest.mark.parametrize("reuse", ["true", "false"])
def test_ranks_are_exact_with_all_columns(spark, many, reuse):
    spark.conf.set("spark.sql.exchange.reuse", reuse)
    try:
        ranked = M.running(many, [F.col("p").desc(), F.col("id")], {"rank": F.lit(1), "total": F.col("y")})
        n = 300_000
        assert ranked.agg(F.countDistinct("rank"), F.min("rank"), F.max("rank")).first()[:] == (n, 1, n)
        top = ranked.where("rank <= 50").orderBy("rank").select("id", "p", "wide").collect()
        assert top == many.orderBy(F.col("p").desc(), "id").limit(50).select("id", "p", "wide").collect()
        assert ranked.agg(F.max("total")).first()[0] == many.agg(F.sum("y")).first()[0]
    finally:
        spark.conf.unset("spark.sql.exchange.reuse")


def test_ranks_within_groups_equal_a_window(many):
    got = M.running(many, [F.col("p"), F.col("id")], {"k": F.lit(1)}, ["tag", "y"])
    w = Window.partitionBy("tag", "y").orderBy("p", "id")
    want = many.withColumn("n", F.row_number().over(w)).select("id", "n")
    assert got.join(want, "id").where("k = n").count() == 300_000


def test_time_split_and_folds(many):
    assert M.time_split(many).where("is_train").count() == 225_000
    folds = M.stratified_folds(many, 5, 1).groupBy("y", "fold").count().collect()
    for y in (0, 1):
        sizes = [r["count"] for r in folds if r["y"] == y]
        assert len(sizes) == 5 and max(sizes) - min(sizes) <= 1


def test_three_way_split_keeps_shares_of_classes(many):
    parts = {(r["y"], r["part"]): r["count"] for r in M.three_way_split(many).groupBy("y", "part").count().collect()}
    for y in (0, 1):
        n = sum(v for k, v in parts.items() if k[0] == y)
        assert abs(parts[y, "test"] - 0.2 * n) <= 1 and abs(parts[y, "valid"] - 0.15 * n) <= 1


def test_metrics_of_a_large_table_equal_one_task(many):
    """The area from ranks, computed apart: mean rank of positives among all."""
    auc = M.roc_auc(many).first()["roc_auc"]
    w = Window.orderBy("p")
    g = many.groupBy("p").agg(F.sum("y").alias("pos"), F.count("*").alias("n")).withColumn("below", F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    s, pos, n = g.agg(F.sum(F.col("pos") * (F.col("below") + (F.col("n") + 1) / 2)), F.sum("pos"), F.sum("n")).first()
    assert auc == pytest.approx((s - pos * (pos + 1) / 2) / pos / (n - pos))
