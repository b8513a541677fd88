"""Epochs of designations, and streams whose files come late, out of order or twice."""

import collections
import datetime
import os
import random

import pytest
from nightqueue.operators import outcomes as O, snapshots as S
from nightqueue.streaming import logs as L, rolling, streams as ST
from nightqueue.streaming.sightings import spans_with
from pyspark.sql import functions as F

DAY = datetime.date(2024, 1, 1)


def days(n):
    return datetime.timedelta(days=n)


# --- epochs


def test_a_designation_that_is_used_again_has_an_outcome_per_epoch(spark):
    log = spark.createDataFrame([("P1", "neo", "D1", "M1", datetime.date(2024, 1, 10), 1), ("P1", "was_not_confirmed", "", None, datetime.date(2026, 1, 10), 2)], "trksub string, outcome_class string, designation string, mpec string, stamp date, line_no int")
    found = spark.createDataFrame([("P1", datetime.date(2024, 1, 5)), ("P1", datetime.date(2025, 12, 30)), ("P1", datetime.date(2025, 1, 5)), ("P2", datetime.date(2024, 1, 5)), (None, datetime.date(2024, 1, 5)), ("P1", None)], "trksub string, discovered date")
    got = {(r["trksub"], str(r["discovered"])): (r["outcome_class"], r["y"], r["state"], r["designation"]) for r in O.label_epochs(found, log).collect()}
    assert got == {("P1", "2024-01-05"): ("neo", 1, "labeled", "D1"), ("P1", "2025-12-30"): ("was_not_confirmed", 0, "labeled", ""), ("P1", "2025-01-05"): (None, None, "unresolved", None), ("P2", "2024-01-05"): (None, None, "unresolved", None), (None, "2024-01-05"): (None, None, "unresolved", None), ("P1", "None"): (None, None, "unresolved", None)}
    assert O.label_epochs(found, log.limit(0)).where("state <> 'unresolved'").count() == 0 and O.label_epochs(found.limit(0), log).count() == 0


@pytest.mark.parametrize("within", [0, 1, 7, 60])
def test_epochs_equal_brute_force(spark, within):
    rng = random.Random(within)
    kinds = ["neo", "linked", "other", "comet", "was_a_star", "designated_other"]
    outs = [(rng.choice("abH"), rng.choice(kinds), f"d{i}", None, DAY + days(rng.randrange(-200, 200)), i) for i in range(400)]
    asks = [(rng.choice("abHz"), DAY + days(rng.randrange(-250, 250)), i) for i in range(300)]
    log = spark.createDataFrame(outs, "trksub string, outcome_class string, designation string, mpec string, stamp date, line_no int")
    got = O.label_epochs(spark.createDataFrame(asks, "trksub string, discovered date, n int"), log, within).collect()
    assert len(got) == len(asks)
    for r in got:
        near = [o for o in outs if o[0] == r["trksub"] and abs((o[4] - r["discovered"]).days) <= within]
        want = max(near, key=lambda o: (o[1] not in ("linked", "other"), o[4], o[5]), default=None)
        assert (r["outcome_class"], r["designation"]) == ((want[1], want[2]) if want else (None, None))


def test_a_hot_designation_meets_by_days(spark):
    """200,000 outcomes and as many discoveries of one name in 400 days: what meets is bounded by days."""
    i = F.col("id")
    log = spark.range(200_000).select(F.lit("H").alias("trksub"), F.when(i % 3 == 0, "linked").otherwise("neo").alias("outcome_class"), i.cast("string").alias("designation"), F.lit(None).cast("string").alias("mpec"), F.date_add(F.lit(DAY), (i % 400).cast("int")).alias("stamp"), i.alias("line_no"))
    found = spark.range(200_000).select(F.lit("H").alias("trksub"), F.date_add(F.lit(DAY), (i % 400).cast("int")).alias("discovered"), i)
    got = O.label_epochs(found, log, 10).agg(F.count("*").alias("n"), F.count_if(F.col("outcome_class") == "neo").alias("neo")).first()
    assert tuple(got) == (200_000, 200_000)


def test_discoveries_begin_after_a_gap(spark):
    rng = random.Random(4)
    rows = [(rng.choice("abc"), datetime.datetime(2024, 1, 1) + datetime.timedelta(hours=rng.randrange(24 * 300)), i, i % 7) for i in range(60)]
    got = collections.defaultdict(list)
    for r in S.discoveries(spark.createDataFrame(rows, "trksub string, stamp timestamp, tie int, x int"), gap_days=10).orderBy("trksub", "epoch").collect():
        got[r["trksub"]].append((r["stamp"], r["tie"], r["x"], r["epoch"]))
    for name in "abc":
        own, want = sorted((t, tie, x) for k, t, tie, x in rows if k == name), []
        for k, row in enumerate(own):
            if k == 0 or (row[0].date() - own[k - 1][0].date()).days > 10:
                want.append((*row, len(want) + 1))
        assert got[name] == want


# --- streams

SNAP = "trksub string, stamp timestamp, tie long, score int, nobs int, arc double, unseen double, v double, h double"


def snap_rows(n=400, seed=9, span=300):
    rng = random.Random(seed)
    maybe = lambda x: None if rng.random() < 0.2 else x
    return [(f"o{int(rng.random() ** 2 * 40)}", datetime.datetime(2024, 1, 1) + datetime.timedelta(minutes=rng.randrange(1440 * span)), i, maybe(rng.randrange(100)), maybe(rng.randrange(2, 60)), maybe(rng.random()), maybe(rng.random() * 9), maybe(20 + rng.random()), maybe(18.0)) for i in range(n)]


def put_files(spark, parts, folder):
    for i, rows in enumerate(parts):
        spark.createDataFrame(rows, SNAP).coalesce(1).write.parquet(f"{folder}/{i:03d}")
        for f in os.listdir(f"{folder}/{i:03d}"):
            os.utime(f"{folder}/{i:03d}/{f}", (1_700_000_000 + 60 * i,) * 2)


def file_stream(spark, folder, at_once=1):
    return spark.readStream.schema(SNAP).option("maxFilesPerTrigger", at_once).option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").parquet(str(folder))


@pytest.mark.parametrize("shuffled", [False, True])
def test_rolling_parts_equal_the_batch(spark, tmp_path, shuffled):
    rows = sorted(snap_rows(), key=lambda r: r[1])
    if shuffled:
        random.Random(1).shuffle(rows)
    put_files(spark, [rows[i::6] if shuffled else rows[i * 70 : (i + 1) * 70] for i in range(6)], tmp_path / "in")
    whole = spark.createDataFrame(rows if shuffled else rows[:420], SNAP)
    got = ST.evolutions(file_stream(spark, tmp_path / "in"), str(tmp_path / "ev"), days=20)
    assert collections.Counter(map(tuple, got.collect())) == collections.Counter(map(tuple, S.evolution_features(whole).select(got.columns).collect()))
    got = ST.first_postings(file_stream(spark, tmp_path / "in"), str(tmp_path / "fp"), days=20)
    assert collections.Counter(map(tuple, got.collect())) == collections.Counter(map(tuple, S.first_posting(whole).select(got.columns).collect()))
    # live parts: objects of the last 20 days only; older ones are in the archive, some more than once
    live = rolling.folders(spark, f"{tmp_path}/ev/live")
    newest = max(r[1] for r in rows)
    seen = spark.read.parquet(f"{tmp_path}/ev/live/batch={live[-1]}")
    assert len(live) <= 2 and seen.where(F.col("t1") < F.lit(newest - days(20))).count() == 0
    assert seen.count() <= len({r[0] for r in rows if r[1] >= newest - days(20)})
    if not shuffled:
        old = spark.read.parquet(f"{tmp_path}/ev/archive/*")
        assert old.count() > old.select("trksub").distinct().count() > 0


def test_a_repeated_batch_changes_nothing(spark, tmp_path):
    rows = snap_rows(200)
    batches = [spark.createDataFrame(rows[i : i + 50], SNAP) for i in range(0, 200, 50)]
    path, how = str(tmp_path), (S.evolution_parts, S.merged_evolution, "t1", 30)
    for number, batch in enumerate(batches):
        rolling.put_batch(batch, number, path, *how)
        rolling.put_batch(batch, number, path, *how)  # as after a failure before the commit
    schema = S.evolution_parts(batches[0]).schema
    got = S.evolution(rolling.result_parts(spark, path, schema, S.merged_evolution))
    assert collections.Counter(map(tuple, got.collect())) == collections.Counter(map(tuple, S.evolution_features(spark.createDataFrame(rows, SNAP)).collect()))
    assert rolling.result_parts(spark, f"{path}/nothing", schema, S.merged_evolution).count() == 0


def test_new_objects_by_day(spark, tmp_path):
    at = lambda day, hour=0: datetime.datetime(2024, 1, 1) + datetime.timedelta(days=day, hours=hour)
    row = lambda name, t: (name, t, 0, 50, 3, 0.1, 1.0, 20.0, 18.0)
    parts = [
        [row("a", at(0, 12)), row("a", at(0, 13)), row("b", at(1, 9))],
        [row("b", at(1, 1)), row("c", at(2, 5)), row(None, at(2, 6))],  # b's first row comes after a later one
        [row("a", at(5)), row("d", at(5, 1))],  # the watermark moves to day 3
        [row("d", at(5, 2))],
        [row("e", at(1, 3)), row("d", at(4, 2))],  # e is late; d was seen before
        [row("a", at(40)), row("c", at(40, 1))],
        [row("x", at(60))],
    ]
    put_files(spark, parts, tmp_path / "in")
    got = {str(r["day"])[:10]: (r["n_rows"], r["n_new"]) for r in ST.drain(ST.daily_stream(file_stream(spark, tmp_path / "in"), key="trksub", days=30)).collect()}
    # on day 40 a and c were unseen for over 30 days, so both are new again
    assert got == {"2024-01-01": (2, 1), "2024-01-02": (2, 1), "2024-01-03": (2, 1), "2024-01-05": (1, 1), "2024-01-06": (3, 0), "2024-02-10": (2, 2)}


def test_spans_of_sightings():
    one = lambda stamps: spans_with([], stamps, 10)
    assert one([5, 1, 30, 15]) == [[1, 15, False], [30, 30, False]] and one([]) == []
    assert spans_with([[1, 15, True], [30, 30, False]], [22], 10) == [[1, 30, True]]
    assert spans_with([[1, 15, True]], [26], 10) == [[1, 15, True], [26, 26, False]]


def test_days_of_new_objects_equal_the_batch(spark, tmp_path):
    rows = sorted(snap_rows(300, 3, 40), key=lambda r: r[1])
    put_files(spark, [rows[i * 60 : (i + 1) * 60] for i in range(5)], tmp_path / "in")
    got = ST.drain(ST.daily_stream(file_stream(spark, tmp_path / "in"), key="trksub")).collect()
    closed = max(r[1] for r in rows) - days(2)
    n, new = collections.Counter(r[1].date() for r in rows), collections.Counter()
    for name in {r[0] for r in rows}:
        new[min(r[1] for r in rows if r[0] == name).date()] += 1
    assert {r["day"].date(): (r["n_rows"], r["n_new"]) for r in got} == {d: (n[d], new[d]) for d in n if datetime.datetime.combine(d + days(1), datetime.time()) <= closed}


def test_a_log_has_each_key_once_after_a_crash(spark, tmp_path):
    path, state, keys = str(tmp_path / "log"), str(tmp_path / "state"), ["trksub", "score"]
    rows = [(f"o{i % 30}", datetime.datetime(2024, 1, 1), i, i % 3, 1, 0.0, 0.0, 0.0, 0.0) for i in range(120)] + [(None, datetime.datetime(2024, 1, 1), 999, None, 1, 0.0, 0.0, 0.0, 0.0)] * 2
    old = spark.createDataFrame([("o1", datetime.datetime(2020, 1, 1), -1, 1, 1, 0.0, 0.0, 0.0, 0.0)], SNAP)
    L.start_log(old, path, keys)
    put_files(spark, [rows[i::3] for i in range(3)], tmp_path / "in")
    L.append_stream(file_stream(spark, tmp_path / "in"), path, keys, "w1", state)
    want = collections.Counter({(r[0], r[3]): 1 for r in rows})
    once = lambda: collections.Counter((r["trksub"], r["score"]) for r in L.log_files(spark, path, old.schema).collect())
    assert once() == want and L.read_log(spark, path, old.schema, keys).where("tie = -1").count() == 1
    # the stream died after the last batch was written and before it was committed: it runs again
    last = max(int(f) for f in os.listdir(f"{state}/commits") if f.isdigit())
    for f in (f"{state}/commits/{last}", f"{state}/commits/.{last}.crc"):
        os.path.exists(f) and os.remove(f)
    before = spark.read.parquet(f"{path}/writer=w1/batch={last}").count()
    L.append_stream(file_stream(spark, tmp_path / "in"), path, keys, "w1", state)
    assert once() == want and spark.read.parquet(f"{path}/writer=w1/batch={last}").count() == before
    # a second writer that has seen nothing of the first may write a key again; readers still get it once
    spark.createDataFrame(rows[:40], SNAP).dropDuplicates(keys).write.parquet(f"{path}/writer=w2/batch=0")
    assert collections.Counter((r["trksub"], r["score"]) for r in L.read_log(spark, path, old.schema, keys).collect()) == want
