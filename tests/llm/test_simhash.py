import random

import numpy as np
import pytest
import xxhash
from nightqueue.llm import simhash
from pyspark.sql import functions as F


def brute_fingerprint(text, k=3):
    w = (text or "").lower().split() if (text or "").isascii() else [x.decode() for x in (text or "").encode().lower().split()]
    s = [" ".join(w[i : i + k]) for i in range(len(w) - k + 1)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(rows):
    fps = {i: brute_fingerprint(t) for i, t in rows if i is not None}
    root = {i: i for i in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in fps:
        for b in fps:
            if (fps[a] ^ fps[b]).bit_count() <= 3:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return fps, {i: find(i) for i in fps}


@pytest.mark.parametrize("n", [1, 2, 63, 64, 65, 300, 700])
@pytest.mark.parametrize("radius", [0, 3, 6])
@pytest.mark.parametrize("size", [1, 2])
def test_bit_sliced_pairs_equal_brute_force(n, radius, size):
    """Groups of one to many words of lanes, one radius or one per row, fingerprints of one or two words."""
    rng = np.random.default_rng(n)
    base = rng.integers(0, 2**63, (7, size))
    values = np.array([base[i % 7] ^ [sum(1 << int(b) for b in rng.integers(0, 63, rng.integers(0, 5))) for _ in range(size)] for i in range(n)], np.int64)
    group = np.sort(rng.integers(0, max(1, n // 90) + 1, n)) if n % 2 else np.repeat(np.arange(n), 3)[:n]
    far = np.bitwise_count(values[:, None].astype(np.uint64) ^ values[None, :].astype(np.uint64)).sum(2)
    for limit in (np.full(n, radius), np.arange(n) % (radius + 2)):
        got = {(int(a), int(b)) for i, j in simhash.near_pairs(values, simhash.group_ends(group), limit, block=100) for a, b in zip(i, j)}
        assert got == {(i, j) for i in range(n) for j in range(i + 1, n) if group[i] == group[j] and far[i, j] <= limit[i]}


def test_every_link_is_decided_by_the_bit_sliced_comparison(spark, monkeypatch):
    """Without what it finds nothing links."""
    rows = [(i, " ".join(f"w{j}" for j in range(i // 2, i // 2 + 300))) for i in range(0, 8, 2)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r["component"] for r in simhash.near_duplicates(df, radius=12).collect()} != {r[0] for r in rows}
    monkeypatch.setattr(simhash, "star", lambda values, nodes, ends, radius: (nodes[:0], nodes[:0]))
    assert {r["component"] for r in simhash.near_duplicates(df, radius=12).collect()} == {r[0] for r in rows}


def test_groups_equal_brute_force(spark):
    random.seed(3)
    words = [f"w{i}" for i in range(50)]
    rows = []
    for i in range(60):
        base = [random.choice(words) for _ in range(random.randint(1, 90))]
        rows.append((3 * i + 1, " ".join(base)))
        for j in range(random.randint(0, 3)):
            copy = list(base)
            copy[random.randrange(len(copy))] = "changed"
            rows.append((3 * i + 2 + 1000 * j, " ".join(copy)))
    rows += [(5000, ""), (5001, None), (5002, " \t"), (None, "a b c"), (1, rows[0][1]), (5003, "Ünder Über"), (5004, "x " * 20000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("fp", F.lit("clash"))
    got = simhash.near_duplicates(df).select("*", simhash.hex_digits().alias("h")).collect()
    fps, roots = brute_components(rows)
    assert len(got) == len(rows)
    for r in got:
        if r["id"] is None:
            assert r["component"] is None
        else:
            assert r["h"] == f"{fps[r['id']]:016x}" and r["component"] == roots[r["id"]]


def test_hot_bucket_is_cut_without_losing_links(spark):
    rng = np.random.default_rng(0)
    values = sorted({int(x) for x in (np.int64(12345678901234567) ^ (np.int64(1) << rng.integers(0, 60, 400)) ^ (np.int64(1) << rng.integers(0, 60, 400)))})
    nodes = spark.createDataFrame([(v, i) for i, v in enumerate(values)], "fp long, node long")
    found = simhash.components(simhash.links(nodes, 3, bucket_rows=16)).collect()
    whole = simhash.components(simhash.links(nodes, 3, bucket_rows=100000)).collect()
    assert sorted(found) == sorted(whole) and len(found) > 300


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.near_duplicates(df).count() == 0


def edited(rng, words, edits):
    copy = list(words)
    for at in rng.sample(range(len(copy)), edits):
        copy[at] = f"new{rng.randrange(10**6)}"
    return copy


def share(a, b):
    a, b = ({tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (a, b))
    return len(a & b) / len(a | b)


def test_near_texts_find_copies_and_leave_others(spark):
    rng = random.Random(5)
    rows, twins = [], []
    for i in range(200):
        base = [f"w{rng.randrange(3000)}" for _ in range(rng.randrange(150, 900))]
        copy = edited(rng, base, max(1, len(base) // 100))
        rows += [(10 * i, " ".join(base)), (10 * i + 1, " ".join(copy))]
        twins.append((10 * i, 10 * i + 1, share(base, copy)))
        half = base[: len(base) // 2] + [f"w{rng.randrange(3000)}" for _ in range(len(base) // 2)]
        rows.append((10 * i + 5, " ".join(half)))
    rows += [(9000, ""), (9001, None), (9002, " "), (None, rows[0][1]), (9003, rows[1][1].upper()), (9004, "one two"), (9005, "One two")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("component", F.lit("clash"))
    got = simhash.near_texts(df).collect()
    assert len(got) == len(rows)
    root = {r["id"]: r["component"] for r in got}
    assert root[None] is None
    near = [(a, b) for a, b, s in twins if s >= 0.85]
    assert len(near) > 150 and sum(root[a] == root[b] for a, b in near) >= 0.95 * len(near)
    assert all(root[10 * i + 5] == 10 * i + 5 for i in range(200)) and all(root[10 * i] == 10 * i for i in range(200))
    assert root[9001] == root[9002] == 9000 and root[9003] == root[1] and root[9005] == 9004


def test_near_texts_in_a_hot_group(spark):
    rng = random.Random(6)
    base = [f"w{i}" for i in range(300)]
    rows = [(i, " ".join(edited(rng, base, 2))) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    small = {tuple(r) for r in simhash.near_texts(df, bucket_rows=32).collect()}
    assert small == {tuple(r) for r in simhash.near_texts(df).collect()} and {r[-1] for r in small} == {0}


def test_near_texts_of_nothing(spark):
    assert simhash.near_texts(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def planted(rng, i):
    """A text and copies of it: with a passage appended or replaced, a line repeated, words changed here and there."""
    word = lambda: f"w{rng.randrange(3000)}"
    base = [word() for _ in range(rng.randrange(80, 300))]
    n = len(base)
    fresh = lambda k: [f"x{i}y{rng.randrange(10**6)}" for _ in range(k)]
    at, size = rng.randrange(n // 2), rng.randrange(1, n // 4)
    return [base, base + fresh(size), base[:at] + fresh(size) + base[at + size :], base + base[:12] * (2 * n // 12), edited(rng, base, rng.randrange(1, max(2, n // 30)))]


def brute_groups(rows, similarity=0.8):
    sets, root = {}, {}
    for i, text in rows:
        w = (text or "").lower().split()
        sets[i], root[i] = {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} if w else set(), i

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and (sets[a] == sets[b] or len(sets[a] & sets[b]) >= similarity * len(sets[a] | sets[b]) > 0):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: find(i) for i in root}


def test_near_texts_equal_brute_force_on_planted_passages(spark):
    rng = random.Random(11)
    line = [f"l{j}" for j in range(30)]
    rows = [(10 * i + j, " ".join(w if i % 3 else line + w)) for i in range(60) for j, w in enumerate(planted(rng, i))]
    rows += [(2000 + i, " ".join(line[: rng.randrange(20, 31)])) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute_groups(rows)
    for found in (simhash.near_texts(df, hot_texts=8, bucket_rows=16), simhash.near_texts(df)):
        assert {r["id"]: r["component"] for r in found.collect()} == want
    repeated = [10 * i + 3 for i in range(60)]
    assert all(want[r] == r - 3 for r in repeated)


def test_pipeline_stage_deletes_what_brute_force_deletes(spark):
    import corpus_pipeline

    rng = random.Random(12)
    rows = [(10 * i, " ".join(f"w{rng.randrange(3000)}" for _ in range(100))) for i in range(80)]
    # appended or replaced words leave shares between 0.6 and 0.95, on both sides of 0.8
    for i in range(80):
        w, k = rows[i][1].split(), rng.randrange(3, 45)
        rows += [(10 * i + 1, " ".join(w + [f"x{j}" for j in range(i * 100, i * 100 + k)])), (10 * i + 2, " ".join(edited(rng, w, rng.randrange(1, 6))))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    kept = corpus_pipeline.drop_near_duplicates(spark, df, "").collect()
    groups = brute_groups(rows)
    assert sorted(map(tuple, kept)) == sorted((i, t) for i, t in rows if groups[i] == i)
    assert 80 < len(kept) < len(rows)
