"""Whitening, tokenizer alignment and MinHash near-duplicates against brute force, and their edge cases."""

import collections
import hashlib
import itertools
import math
import random
import re

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from nightqueue.llm import alignment, minhash, whitening
from pyspark.sql import functions as F
from tokenizers import Tokenizer

BYTE, PIECE = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "piece_bpe_32k.model"))


# --- whitening


def plain_whitening(rows, k=4):
    """numpy on one machine: (id, whitened), n, deviations, explained."""
    x = {i: np.floor(256 * np.array(v, float)).astype(np.int64) for i, v in rows}
    fit = np.unique(np.array(list(x.values())), axis=0)
    n, s = len(fit), fit.sum(0)
    z = fit - s / n
    e, q = np.linalg.eigh(z.T @ z / n)
    e, q = e[::-1], q[:, ::-1]
    return {i: ((v - s / n) @ q[:, :k] / np.sqrt(e[:k]), int(((n * v - s) ** 2).sum())) for i, v in x.items()}, n, e[:k] / e.sum()


def test_whitening_equals_numpy(spark):
    rng = np.random.default_rng(7)
    rows = [(i, (rng.standard_normal(9) * np.arange(1, 10) / 5).tolist()) for i in range(300)]
    rows += [(1000 + i, rows[0][1]) for i in range(200)]  # copies count once
    bad = [(-1, None), (-2, [0.5] * 8 + [None]), (-3, [0.5] * 8 + [float("nan")]), (-4, [float("-inf")] + [0.5] * 8), (-5, []), (-6, [1.0, 2.0])]
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in rows + bad], "vec_id long, embedding array<double>, n string, component int")
    want, n, explained = plain_whitening(rows)
    for parts in (1, 5):
        got = whitening.whiten(df.repartition(parts).select("vec_id", "embedding", F.col("n").alias("other"), "component"), 4).collect()
        assert {r["vec_id"] for r in got} == set(want) and len(got) == len(rows)
        own = np.array([r["whitened"] for r in got])
        ref = np.array([want[r["vec_id"]][0] for r in got])
        sign = np.sign((own * ref).sum(0))
        assert np.abs(own * sign - ref).max() < 1e-9
        assert all(int(r["deviation"]) == want[r["vec_id"]][1] and r["n"] == n and np.allclose(r["explained"], explained, rtol=1e-9) for r in got)
        assert got[0]["identity_error"] < 1e-9 and got[0]["other"] == "x"
    each = whitening.by_component(whitening.whiten(df.select("vec_id", "embedding"), 4))
    assert each.groupBy("component").count().orderBy("component").collect() == [(k, 500) for k in (1, 2, 3, 4)]


def test_whitening_edge_cases(spark):
    one = lambda rows: whitening.by_component(whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), 4))
    assert one([]).count() == 0 and one([(1, None)]).count() == 0
    assert one([(1, [1.0, 2.0]), (2, [1.0, 2.0])]).count() == 0  # nothing varies
    line = one([(None, [0.0, 0.0]), (1, [1.0, 1.0]), (1, [1.0, 1.0])]).collect()  # one direction, a null id, a repeated row
    assert len(line) == 3 and {r["component"] for r in line} == {1} and all(abs(abs(r["whitened"]) - 1) < 1e-12 and abs(r["explained"] - 1) < 1e-12 for r in line)
    huge = one([(1, [1e30, 0.0]), (2, [-1e30, 1.0]), (3, [0.0, 5.0])]).collect()
    assert len(huge) == 3 and all(math.isfinite(r["whitened"]) for r in huge)  # beside this axis the other is rounding


@pytest.mark.parametrize("d", [1, 2, 3, 6, 40])
def test_leading_eigenvectors(d):
    rng = np.random.default_rng(d)
    b = rng.standard_normal((d, d))
    q = np.linalg.qr(b)[0]
    for a in (b @ b.T, np.diag(rng.integers(0, 3, d).astype(float)), np.eye(d), q @ np.diag([5.0] * (d // 2) + [1e-9] * (d - d // 2)) @ q.T, np.zeros((d, d))):
        a = (a + a.T) / 2
        values, axes = whitening.leading(a, 4)
        if not a.any():
            assert len(values) == 0
            continue
        most = max(1.0, np.abs(a).max())
        assert np.abs(values - np.linalg.eigvalsh(a)[::-1][:4]).max() < 1e-12 * most
        assert np.abs(a @ axes.T - axes.T * values).max() < 1e-12 * most * d
        assert np.abs(axes @ axes.T - np.eye(len(axes))).max() < 1e-12
        # Sturm counts say how many eigenvalues lie below
        diag, off, _ = whitening.householder(a)
        for at in (-1.0, 0.3, 1.7, 4.0):
            assert whitening.below(diag, off, np.array([at]))[0] == (np.linalg.eigvalsh(a) < at).sum()


# --- alignment

random.seed(11)
SIGNS = [*"abc ABC éß中😀\n\t\r1 2.,▁", " ", " ", "<s>", "</s>", "<0x41>", "<|endoftext|>", "\x00", " the", " of", "ing"]
TEXTS = ["", None, " ", "  ", "a ", "a  ", "   x", "<s>", "\n", " \n ", "▁", "x" * 3000, " the" * 800, *("".join(random.choice(SIGNS) for _ in range(random.randint(1, 60))) for _ in range(250)), *("".join(random.choice(SIGNS[:-20] + [" the", " of", "ing", " "]) for _ in range(80)) for _ in range(60))]


def aligned(text, lib, model):
    """By comparing all tokens with all: the groups and the links of a text."""
    if not text:
        return None
    full = (" " + text).encode()
    a, b = lib.encode(" " + text, add_special_tokens=False).ids, model.encode(text)
    to_byte = {c: i for i, c in enumerate(alignment.byte_alphabet())}
    spell_a = [bytes(to_byte[c] for c in lib.id_to_token(i)) for i in a]
    spell_b = [bytes([int(model.id_to_piece(i)[3:5], 16)]) if model.is_byte(i) else model.id_to_piece(i).replace("▁", " ").encode() for i in b]
    if b"".join(spell_a) != full or b"".join(spell_b) != full:
        return None
    ends = lambda s: list(itertools.accumulate(map(len, s)))
    end_a, end_b = ends(spell_a), ends(spell_b)
    groups, last = [], 0
    for cut in sorted(set(end_a) & set(end_b)):
        of = lambda ids, e, lo=last, hi=cut: ",".join(str(i) for i, x in zip(ids, e) if lo < x <= hi)
        groups.append(f"{of(a, end_a)}|{of(b, end_b)}")
        last = cut
    links = [(x, y) for x, i, p in zip(a, [0, *end_a], end_a) for y, j, q in zip(b, [0, *end_b], end_b) if i < q and j < p]
    return len(a), len(b), groups, links


def test_alignment_equals_brute_force(spark):
    lib, model = Tokenizer.from_file(BYTE), sentencepiece.SentencePieceProcessor(model_file=PIECE)
    lib.encode_special_tokens = True
    rows = list(enumerate(TEXTS)) + [(20, TEXTS[20]), (None, TEXTS[30])]
    each = [aligned(t, lib, model) for _, t in rows]
    count = collections.Counter(p for e in each if e for p in set(e[3]))
    best = {}
    for (a, _), c in count.items():
        best[a] = max(best.get(a, 0), c)
    want = collections.Counter()
    for (i, _), e in zip(rows, each):
        if e is None:
            want[i, 0, 0, 0, 0, 0, 0, ""] += 1
        else:
            want[i, e[0], e[1], len(e[2]), len(e[3]), sum(count[p] == best[p[0]] for p in e[3]), sum(count[p] for p in e[3]), hashlib.sha256(";".join(e[2]).encode()).hexdigest()] += 1
    assert sum(e is not None for e in each) > 100
    df = spark.createDataFrame([(i, t, "clash", 5) for i, t in rows], "doc_id long, text string, run string, n_a int").repartition(3)
    columns = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    for how in ({}, {"radixes": 3, "run_records": 500, "fan_in": 2}):  # the second: many runs, merged in rounds
        found = alignment.align(df, BYTE, PIECE, **how)
        assert {r["run"] for r in found.select("run").distinct().collect()} == {"clash"}
        assert collections.Counter(tuple(r) for r in found.select(columns).collect()) == want
    assert alignment.align(df.limit(0), BYTE, PIECE).count() == 0
    only = alignment.align(df.where("doc_id < 2").select("doc_id", "text"), BYTE, PIECE).collect()
    assert len(only) == 2 and {r["n_links"] for r in only} == {0} and {r["groups_sha256"] for r in only} == {""}


def test_runs_merge_like_a_counter(monkeypatch):
    monkeypatch.setattr(alignment, "BLOCK", 7)
    rng, want, runs = np.random.default_rng(5), collections.Counter(), []
    for _ in range(9):
        pairs = np.unique(rng.integers(0, 400, rng.integers(0, 150)))
        counts = rng.integers(1, 9, len(pairs))
        want.update(dict(zip(pairs.tolist(), counts.tolist())))
        runs.append((alignment.blocks(pairs, alignment.pack_sorted), alignment.blocks(counts, alignment.pack_counts)))
    found = list(alignment.merged(runs))
    pairs, counts = (np.concatenate(x) for x in zip(*found))
    assert (np.diff(pairs) > 0).all() and dict(zip(pairs.tolist(), counts.tolist())) == want and len(found) > 20
    best = alignment.best_of(pairs, counts, 20)
    assert all(b == (c == max(want[q] for q in want if q // 20 == p // 20)) for p, c, b in zip(pairs.tolist(), counts.tolist(), best.tolist()))


# --- MinHash


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4) if w else 0)}


def groups_by_brute_force(rows):
    """(id, text) to (number of shingles, smallest id that is reachable)."""
    sets = {(i, t): shingles(t) for i, t in rows}
    root = {k: k for k in sets}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for x, y in itertools.combinations(sets, 2):
        a, b = sets[x], sets[y]
        both = len(a & b)
        if a and b and 100 * both >= 85 * (len(a) + len(b) - both):
            low, high = sorted((find(x), find(y)), key=lambda k: k[0])
            root[high] = low
    return {k: (len(sets[k]), min(j[0] for j in sets if find(j) == find(k))) for k in sets}


def near_rows():
    rng = random.Random(3)
    word = lambda: f"w{rng.randrange(4000)}"
    rows, at = [], 0

    def add(text):
        nonlocal at
        at += rng.randint(1, 3)
        rows.append((at, text))

    for n in (1, 3, 5, 6, 11, 30, 120, 600):
        for _ in range(6):
            base = [word() for _ in range(n)]
            add(" ".join(base))
            add("  ".join(base).upper() + "\n")
            for part in (0.01, 0.03, 0.06, 0.15):  # one passage replaced, appended, left out, around 0.85
                k = max(1, round(n * part))
                add(" ".join([*base[:2], *(word() for _ in range(k)), *base[2 + k :]]))
                add(" ".join([*base, *(word() for _ in range(k))]))
                add(" ".join(base[k:]))
    chain = [word() for _ in range(200)]
    for _ in range(25):  # each near the one before, the ends far apart
        add(" ".join(chain))
        chain = [*chain[5:], *(word() for _ in range(5))]
    shared = [word() for _ in range(300)]
    for _ in range(60):  # a large group that shares half of its words
        add(" ".join([*shared, *(word() for _ in range(200))]))
    for text in ("", None, " \t\r\n", "\x1c", "a\x1cb a\x1cb"):
        add(text)
    rng.shuffle(rows)
    return rows


def test_minhash_equals_brute_force(spark):
    rows = near_rows()
    want = groups_by_brute_force(rows)
    df = spark.createDataFrame([(i, t, "clash", 1) for i, t in rows] + [(None, "no id", "clash", 1), (None, None, "clash", 1)], "doc_id long, text string, key string, n int")
    for how in ({}, {"bucket_rows": 8, "rounds": 2}):
        got = minhash.near_documents(df, **how).collect()
        assert len(got) == len(rows) + 2
        of = {i: t for i, t in rows}
        for r in got:
            if r["id"] is None:
                assert r["component"] is None and r["kept"] is False
            else:
                assert (r["n_shingles"], r["component"]) == want[r["id"], of[r["id"]]] and r["kept"] == (r["component"] == r["id"]), of[r["id"]]
    assert minhash.near_documents(df.limit(0)).count() == 0


def test_repeated_rows_and_shared_ids(spark):
    same, other = "one two three four five six", "seven eight nine ten eleven twelve"
    df = spark.createDataFrame([(5, same)] * 300 + [(3, same), (5, other), (9, "")], "doc_id long, text string")
    got = collections.Counter(tuple(r) for r in minhash.near_documents(df).collect())
    assert got == {(5, 2, 3, False): 300, (3, 2, 3, True): 1, (5, 2, 5, True): 1, (9, 0, 9, True): 1}


def test_sketches_estimate_similarity_and_always_fill():
    rng = np.random.default_rng(2)
    draw = lambda n: rng.integers(-(1 << 62), 1 << 62, n)
    for n in (1, 2, 40, 160, 5000):
        s = minhash.sketch(np.unique(draw(n)), 160)
        assert (s != minhash.NONE).all() and (s == minhash.sketch(np.unique(draw(n)), 160)).sum() == 0
    for n in (30, 400):
        errors = []
        for _ in range(60):
            common, a, b = draw(n), draw(n // 5), draw(n // 5)
            x, y = minhash.sketch(np.unique(np.r_[common, a]), 160), minhash.sketch(np.unique(np.r_[common, b]), 160)
            errors.append((x == y).mean() - n / (n + 2 * (n // 5)))
        # no bias, and no wider than 160 independent coordinates
        assert abs(np.mean(errors)) < 0.012 and np.std(errors) < 1.3 * math.sqrt(0.71 * 0.29 / 160)
