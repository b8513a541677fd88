"""Boosted trees against a plain version that tries every split by hand, and what is fused."""

import dataclasses
import math
import random

import numpy as np
import pytest
from nightqueue.operators import boosting as B, metrics as M, models as ML
from pyspark.sql import functions as F


def rows_of(n=400, seed=1):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        y = int(rng.random() < 0.3)
        a, b = rng.gauss(y * 1.2, 1), rng.gauss(0, 1)
        c = None if rng.random() < (0.5 if y else 0.1) else float(rng.randrange(4))
        out.append((i, y, None if rng.random() < 0.05 else a, b, c))
    return out


SCHEMA = "id long, y int, a double, b double, c double"
COLS = ["a", "b", "c"]


def plain(model: B.Booster, x: np.ndarray, y: np.ndarray, o: B.Options):
    """The trees again, one row and one split at a time; draws of columns and dropped trees are the model's own."""
    n, n1 = len(y), int(y.sum())
    w = [n / (2 * n1) if v else n / (2 * (n - n1)) for v in y]
    trees, weights = [], []

    def walk(tree, row):
        while isinstance(tree, tuple):
            f, edge, missing_left, left, right = tree
            tree = (left if missing_left else right) if math.isnan(row[f]) else left if row[f] <= edge else right
        return tree


    for turn in range(o.rounds):
        features = sorted(sorted(range(3), key=lambda f: B.chance(o.seed, turn, 1, f))[: max(1, round(o.columns * 3))])
        out = [k for k in range(turn) if B.chance(o.seed, turn, 2, k) < o.dropout][: o.most_dropped]
        margin = [sum(weights[k] * walk(trees[k], r) for k in range(turn) if k not in out) for r in x]
        p = [1 / (1 + math.exp(-m)) for m in margin]
        g = [round(wi * (pi - yi) * B.UNIT) / B.UNIT for wi, pi, yi in zip(w, p, y)]
        h = [round(wi * pi * (1 - pi) * B.UNIT) / B.UNIT for wi, pi in zip(w, p)]
        score = lambda ids: sum(g[i] for i in ids) ** 2 / (sum(h[i] for i in ids) + o.l2)
        value = lambda ids: -o.rate * sum(g[i] for i in ids) / (sum(h[i] for i in ids) + o.l2)
        nodes, splits, active, leaves = {0: list(range(n))}, {}, [0], 1
        for _ in range(o.depth):
            found = []
            for k in active:
                best = None
                for f in features:
                    here = None
                    for missing_left in (False, True):
                        for edge in model.edges[f]:
                            left = [i for i in nodes[k] if (missing_left if math.isnan(x[i][f]) else x[i][f] <= edge)]
                            right = [i for i in nodes[k] if i not in set(left)]
                            if min(len(left), len(right)) < o.least_rows:
                                continue
                            gain = (score(left) + score(right) - score(nodes[k])) / 2
                            if gain > 1e-9 and (here is None or gain > here[0] + 1e-10):
                                here = (gain, f, edge, missing_left, left, right)
                    if here and (best is None or here[0] > best[0] + 1e-10):
                        best = here
                if best:
                    found.append((best[0], -k, best))
            active = []
            for _, k, best in sorted(found, key=lambda s: s[:2], reverse=True):
                if leaves < o.leaves:
                    a = max(nodes) + 1
                    splits[-k], nodes[a], nodes[a + 1] = (best, a), best[4], best[5]
                    active += [a, a + 1]
                    leaves += 1

        def built(k):
            if k not in splits:
                return value(nodes[k])
            (_, f, edge, missing_left, _, _), a = splits[k]
            return (f, edge, missing_left, built(a), built(a + 1))

        trees.append(built(0))
        for k in out:
            weights[k] *= len(out) / (len(out) + 1)
        weights.append(1 / (len(out) + 1))
    return [1 / (1 + math.exp(-sum(wk * walk(t, r) for wk, t in zip(weights, trees)))) for r in x]


def test_boosting_equals_the_plain_version_in_any_order(spark, monkeypatch):
    monkeypatch.setattr(B, "EDGES", 7)
    monkeypatch.setattr(B, "SAVE", 2)
    rows, o = rows_of(150), B.Options(rounds=5, rate=0.3, depth=3, leaves=6, least_rows=8, l2=2.0, columns=0.67, dropout=0.4)
    df = spark.createDataFrame(rows, SCHEMA)
    model = B.fit_boosted(df.repartition(3), COLS, o)
    again = B.fit_boosted(df.orderBy(F.desc("b")).repartition(5), COLS, o)
    assert model == again and len(model.trees) == 5 and min(t.weight for t in model.trees) < 1
    got = {r["id"]: r["p"] for r in B.boosted_scores(df, B.Booster.from_json(model.to_json())).collect()}
    x = np.array([[math.nan if v is None else v for v in r[2:]] for r in rows])
    want = plain(model, x, np.array([r[1] for r in rows]), o)
    assert max(abs(got[r[0]] - p) for r, p in zip(rows, want)) < 1e-9


def test_boosting_learns_from_values_and_from_their_absence(spark):
    train, test = spark.createDataFrame(rows_of(3000, 2), SCHEMA), spark.createDataFrame(rows_of(3000, 3), SCHEMA)
    o = B.Options(rounds=25, rate=0.2)
    ours = M.roc_auc(B.boosted_scores(test, B.fit_boosted(train, COLS, o))).first()[0]
    only = M.roc_auc(B.boosted_scores(test, B.fit_boosted(train, ["c"], o))).first()[0]
    theirs = M.roc_auc(ML.scored(test, ML.fit_vetting(train, COLS, small=False, rounds=25), COLS)).first()[0]
    assert ours > theirs - 0.01 and ours > 0.8 and only > 0.6


def test_boosting_edge_cases(spark):
    df = spark.createDataFrame(rows_of(60), SCHEMA)
    o = B.Options(rounds=2)
    for odd in (df.limit(0), df.where("y = 1"), df.withColumn("y", F.lit(None).cast("int"))):
        assert B.fit_boosted(odd, COLS, o).trees == []
    nothing = df.withColumns({c: F.lit(None).cast("double") for c in COLS})
    model = B.fit_boosted(nothing, COLS, o)
    assert all(abs(r["p"] - 0.5) < 1e-6 for r in B.boosted_scores(nothing, model).collect())
    assert B.boosted_scores(df.limit(0), model).count() == 0
    twice = B.fit_boosted(df.union(df.withColumn("y", F.lit(None).cast("int"))), COLS, o)  # rows without a label change nothing
    assert dataclasses.asdict(twice) == dataclasses.asdict(B.fit_boosted(df, COLS, o))


@pytest.mark.parametrize("boosted", [None, B.Options(rounds=25, rate=0.3)])
def test_fusion_scores_rows_that_it_was_not_fitted_on(spark, boosted):
    rows = spark.createDataFrame(rows_of(400), SCHEMA)
    logit = rows.select("id", (F.col("b") / 2).alias("logit"), "y")
    got = ML.late_fusion(logit, rows, [*COLS, "logit"], boosted=boosted)
    held = M.stratified_holdout(rows, 0.25).where("is_test")
    assert {r["id"] for r in got.collect()} == {r["id"] for r in held.collect()}
    assert M.roc_auc(got).first()[0] > 0.6
    # labels or subjects that don't agree: nothing is fused
    assert ML.late_fusion(logit.withColumn("y", 1 - F.col("y")), rows, [*COLS, "logit"], boosted=boosted).count() == 0
    assert ML.late_fusion(logit.where("id > 0"), rows, [*COLS, "logit"], boosted=boosted).count() == 0
