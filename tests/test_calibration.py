"""Isotonic calibration against the largest of the least means over all runs of scores."""

import random

import pytest
from nightqueue.operators import calibration as K
from pyspark.sql import functions as F


def brute(rows):
    """score to value; rows: (p, y, w)."""
    ps = sorted({p for p, _, _ in rows})
    w = [sum(x[2] for x in rows if x[0] == p) for p in ps]
    t = [sum(x[1] * x[2] for x in rows if x[0] == p) for p in ps]
    mean = lambda a, b: sum(t[a : b + 1]) / sum(w[a : b + 1])
    n = len(ps)
    return {ps[i]: max(min(mean(a, b) for b in range(i, n)) for a in range(i + 1)) for i in range(n)}


CASES = {
    "rising": lambda r, i: (i / 90, float(r.random() < i / 90), 1.0),
    "falling": lambda r, i: (i / 90, float(r.random() > i / 90), 1.0),
    "weights": lambda r, i: (i % 31 / 31, float(r.random() < 0.4), r.choice([0.5, 1.0, 4.0])),
    "one score": lambda r, i: (0.5, float(i % 3 == 0), 1.0),
    "perfect": lambda r, i: (i / 90, float(i > 40), 1.0),
}


@pytest.mark.parametrize("case", sorted(CASES))
def test_blocks_equal_brute_force(spark, case):
    rng = random.Random(5)
    rows = [CASES[case](rng, i) for i in range(90)]
    df = spark.createDataFrame(rows, "p double, y double, w double")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "7")  # borders to pool across
        blocks = K.isotonic_fit(df, F.col("w"))
        found = blocks.orderBy("lo").collect()
        got = {r["p"]: r["calibrated"] for r in K.isotonic_apply(df, blocks).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    want = brute(rows)
    assert got == {p: pytest.approx(v) for p, v in want.items()}
    assert len(found) == len({round(v, 9) for v in want.values()})
    assert all(a["hi"] < b["lo"] and a["value"] < b["value"] for a, b in zip(found, found[1:]))


def test_odd_rows_and_new_scores(spark):
    df = spark.createDataFrame([(0.2, 0), (0.4, 1), (0.4, 0), (0.6, 1), (None, 1), (0.9, None), (float("nan"), 1)], "p double, y int").withColumn("calibrated", F.lit("clash")).withColumn("part", F.lit(1))
    blocks = K.isotonic_fit(df)
    assert [tuple(r) for r in blocks.orderBy("lo").collect()] == [(0.2, 0.2, 1.0, 0.0), (0.4, 0.4, 2.0, 0.5), (0.6, 0.6, 1.0, 1.0)]
    fresh = spark.createDataFrame([(1, 0.1), (2, 0.3), (3, 0.59), (4, 5.0), (5, None), (6, 0.3)], "id int, p double")
    assert sorted((r["id"], r["calibrated"]) for r in K.isotonic_apply(fresh, blocks).collect()) == [(1, 0.0), (2, 0.0), (3, 0.5), (4, 1.0), (5, None), (6, 0.0)]
    assert len(K.isotonic_apply(df, blocks).collect()) == 7
    nothing = K.isotonic_fit(df.limit(0))
    assert nothing.count() == 0 and {r["calibrated"] for r in K.isotonic_apply(fresh, nothing).collect()} == {None}
    assert K.isotonic_apply(fresh.limit(0), blocks).count() == 0
