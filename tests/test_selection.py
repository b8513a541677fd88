"""Order statistics by counting, and splits by one ranking, against sorted lists."""

import math
import random

import pytest
from nightqueue.operators import metrics as M
from nightqueue.operators.selection import select_ranks
from pyspark.sql import Window, functions as F

NAN = float("nan")
CASES = {
    "spread": lambda r: r.random(),
    "ties": lambda r: r.randrange(4) / 4,
    "steep": lambda r: 2.0 ** -r.randrange(60),
    "negative": lambda r: r.choice([-1e300, -3.5, 0.0, 5e-324, 7e200]),
    "gaps": lambda r: r.choice([None, NAN, r.gauss(0, 1)]),
}


@pytest.mark.parametrize("case, few", [(c, 1) for c in sorted(CASES)] + [("gaps", 100), ("steep", 4096)])
def test_ranks_equal_sorted_lists(spark, case, few):
    rng = random.Random(11)
    rows = [(rng.choice(["a", "b", None, "b"]), CASES[case](rng)) for _ in range(400)] + [("alone", 0.25), ("empty", None)]
    groups = {g: sorted(p for h, p in rows if h == g and p is not None and not math.isnan(p)) for g in ("a", "b", None, "alone", "empty")}
    wanted = [(g, k) for g in groups for k in (0, 1, 2, 57, 60, 61, len(groups[g]), len(groups[g]) + 1)] + [("absent", 1)]
    wanted = sorted(set(wanted), key=str)
    got = select_ranks(spark.createDataFrame(rows, "g string, p double"), spark.createDataFrame(wanted + wanted[:3], "g string, k long"), ["g"], few=few)
    want = [(g, groups[g][k - 1]) for g, k in wanted if 1 <= k <= len(groups.get(g, []))]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    whole = sorted(p for v in groups.values() for p in v)
    one = select_ranks(spark.createDataFrame(rows, "g string, p double"), spark.createDataFrame([(7,)], "k long"), [])
    assert [r[0] for r in one.collect()] == [whole[6]]


def test_values_must_be_finite(spark):
    rows = spark.createDataFrame([(0.0,), (float("inf"),)], "p double")
    with pytest.raises(ValueError):
        select_ranks(rows, spark.createDataFrame([(1,)], "k long"), [], few=1)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "id long, y long, p double, tag string")
    assert M.conformal_threshold(none, 0.1).collect() == [(0.0,)] and M.conformal_threshold(none, 0.1, "tag").count() == 0
    assert M.conformal_repeated(none, 0.1, 3).first()["n_splits"] == 0 and M.stratified_folds(none).count() == 0


def test_thresholds_by_group_with_null_keys(spark):
    rng = random.Random(2)
    rows = [(i, i % 3 % 2, rng.choice([None, NAN, rng.random()]), rng.choice(["x", None, "y"])) for i in range(300)] + [(900, 0, 0.5, "no positives")]
    got = {r["tag"]: r["threshold"] for r in M.conformal_threshold(spark.createDataFrame(rows, "id long, y long, p double, tag string"), 0.1, "tag").collect()}
    for tag in ("x", "y", None, "no positives"):
        p = sorted(p for _, y, p, t in rows if t == tag and y == 1 and p is not None and not math.isnan(p))
        assert got.pop(tag) == (p[max(math.floor((len(p) + 1) * 0.1) - 1, 0)] if p else 0.0)
    assert not got


def test_places_of_all_repetitions_equal_a_sort_of_each(spark):
    i = F.col("id")
    rows = spark.range(5000).select(F.when(i % 50 == 0, i * 1_000_003 + 7).when(i % 77 == 0, -i).otherwise(i * i).alias("id"), F.when(i % 9 > 0, i % 2).alias("y"), F.col("id").alias("wide"))
    got = M.hash_places(rows, 30)
    assert got.columns == ["id", "y", "wide", "rep", "place"] and got.count() == 150_000
    h = M.split_hash("id", "rep")
    w = Window.partitionBy("rep", "y").orderBy(h, "id")
    assert got.withColumn("want", F.row_number().over(w)).where("place <> want").count() == 0
    assert spark.range(2**62, 2**62 + 5).select(M.split_hash("id")).distinct().count() == 5
