"""Cells of the sky and exposures against brute force over all pairs."""

import math
import random

import pytest
from nightqueue.functions.sky import FINE, sky_cell, with_cells
from nightqueue.operators import tracklets as T
from pyspark.sql import functions as F


def apart(a, b):
    (r1, d1), (r2, d2) = [(math.radians(x), math.radians(y)) for x, y in (a, b)]
    h = math.sin((d1 - d2) / 2) ** 2 + math.cos(d1) * math.cos(d2) * math.sin((r1 - r2) / 2) ** 2
    return math.degrees(2 * math.asin(math.sqrt(min(1.0, h))))


def around(rng, radius, n):
    """Places in pairs that lie a little within or beyond the radius of each other, the poles and 0 h among them."""
    out = [(0.0, 90.0), (123.0, -90.0), (359.999, 0.0), (0.001, 0.0), (10.0, 89.999), (190.0, 89.999), (360.0, 5.0), (-0.001, 5.0)]
    while len(out) < n:
        ra, dec = rng.uniform(0, 360), math.degrees(math.asin(rng.uniform(-1, 1)))
        turn, step = rng.uniform(0, 2 * math.pi), radius * rng.uniform(0.5, 1.3)
        d2 = max(-90.0, min(90.0, dec + step * math.cos(turn)))
        out += [(ra, dec), ((ra + step * math.sin(turn) / max(0.01, math.cos(math.radians(dec)))) % 360, d2)]
    return out


@pytest.mark.parametrize("radius", [25.0, 3.0, 30 / 3600, 100.0])
def test_matches_equal_all_pairs(spark, radius):
    rng = random.Random(7)
    places = around(rng, radius, 120)
    obs = [(i, f"2024-01-0{1 + i % 2}", ra, dec) for i, (ra, dec) in enumerate(places)]
    exp = [(1000 - i, f"2024-01-0{1 + i // 2 % 2}", ra, dec, "" if i % 9 == 0 else f"s{i}") for i, (ra, dec) in enumerate(reversed(places))]
    exp += [(2000 + e, d, ra, dec, s) for e, d, ra, dec, s in exp]  # the same places again, later
    want = {}
    for k, day, ra, dec in obs:
        found = [(e, s) for e, d, r2, d2, s in exp if d == day and s and apart((ra, dec), (r2, d2)) <= radius]
        if found:
            want[k] = min(found)
    bad_o, bad_e = [(900, "2024-01-01", None, 5.0), (901, None, 5.0, 5.0)], [(1, "2024-01-01", None, None, "s"), (2, None, 5.0, 5.0, "s"), (3, "2024-01-01", 5.0, 5.0, None)]
    o = spark.createDataFrame(obs + bad_o, "trksub long, date string, ra double, dec double")
    e = spark.createDataFrame(exp + bad_e, "exposure long, date string, ra double, dec double, stamp string")
    got = {r["trksub"]: (r["exposure"], r["stamp"]) for r in T.match_exposures(o, e, radius).collect()}
    assert got == want and len(want) > 20
    assert T.match_exposures(o.limit(0), e, radius).count() == 0 and T.match_exposures(o, e.limit(0), radius).count() == 0


def test_circles_reach_few_cells_and_each_once(spark):
    rng = random.Random(3)
    rows = around(rng, 0.5, 400)
    df = spark.createDataFrame([(i, *x) for i, x in enumerate(rows)], "id long, ra double, dec double").withColumn("own", sky_cell("ra", "dec", 0.5))
    near = {}
    for r in with_cells(df, "ra", "dec", 0.5, "cell").collect():
        near.setdefault((r["id"], r["own"]), []).append(r["cell"])
    assert len(near) == len(rows)
    assert all(own in cells and len(set(cells)) == len(cells) <= 24 for (_, own), cells in near.items())


def test_positions_meet_few_exposures_however_many_there_are(spark):
    rng = random.Random(11)
    near = lambda n: [(rng.uniform(0, 360), math.degrees(math.asin(rng.uniform(-1, 1)))) for _ in range(n)]
    places = spark.createDataFrame([(i, "2024-01-01", *p) for i, p in enumerate(near(4000))], "exposure long, date string, ra double, dec double")
    cells = with_cells(places, "ra", "dec", 25.0, "cell", FINE, "whole")
    least = {r["cell"]: r["e"] for r in cells.where("whole").groupBy("cell").agg(F.min("exposure").alias("e")).collect()}
    left = [r for r in cells.collect() if r["exposure"] <= least.get(r["cell"], 1 << 40)]
    # 4,000 exposures reach 90,000 cells; some ten a cell can be the first of a position
    assert len(left) < 15 * cells.select("cell").distinct().count() < cells.count() / 10
    # a circle that covers a cell holds every position of it
    spots = {}
    for r in spark.createDataFrame(near(3000), "ra double, dec double").withColumn("cell", sky_cell("ra", "dec", 25.0, FINE)).collect():
        spots.setdefault(r["cell"], []).append((r["ra"], r["dec"]))
    whole = [r for r in cells.where("whole AND exposure % 20 = 0").collect()]
    assert len(whole) > 100 and all(apart((r["ra"], r["dec"]), s) <= 25 for r in whole for s in spots.get(r["cell"], []))
