"""The stages of the pipeline against brute force, on rows with nulls, repeats, clashing names, and on nothing."""

import random
import re

import corpus_pipeline
import pytest
from nightqueue.llm import simhash, toxicity
from nightqueue.llm.store import BATCH
from test_simhash import brute_groups, edited, planted

STAGES = dict(corpus_pipeline.STAGES)
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, toxic int, n_words string, hit_starts string, hit_ends int, item_ids long, id int, key string, component string, fp string, ids string"
EXTRA = (0.5, 3, "w", "h", 7, 8, 9, "k", "c", "f", "i")


def table_of(spark, rows):
    """(doc_id, text, lang) as documents, with columns that have the names of those that operators make."""
    return spark.createDataFrame([(i, t, lang, "s", len(t or ""), *EXTRA) for i, t, lang in rows], SCHEMA)


def plain(df):
    return sorted((str(r["doc_id"]), str(r["text"])) for r in df.collect() if tuple(r)[5:] == EXTRA or pytest.fail(f"changed: {r}"))


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    rng = random.Random(3)
    path = tmp_path_factory.mktemp("tables")
    word = lambda: f"w{rng.randrange(3000)}"
    rows = []
    for i in range(900):
        words = [word() for _ in range(rng.randrange(30, 60))]
        if i % 5 == 0:
            words[4], words[9] = f"badstem{i % 7}", f"badstem{i % 11}"
        rows.append((i, " ".join(words), "en" if i % 2 else "de"))
    near = random.Random(4)
    clean = [(2000 + 10 * i + j, " ".join(w), "en") for i in range(40) for j, w in enumerate(planted(near, i))]
    items = [(i, " ".join(f"b{rng.randrange(50)}" for _ in range(rng.choice([6, 10, 30])))) for i in range(20)]
    leaks = [(5000 + i, f"{rows[1][1]} x{i} " + items[i % 20][1] + " " + " ".join(f"y{i}z{j}" for j in range(200)), "en") for i in range(30)]
    odd = [(None, "no id", "en"), (None, None, None), (7000, None, None), (7001, "", "en"), (7002, " \t", "xx"), (7003, "long " * 40000, "en"), clean[0], clean[0], (clean[0][0], "another text under a used id entirely", "de")]
    docs = rows + clean + leaks + odd
    table_of(spark, docs).write.parquet(str(path / "documents.parquet"))
    spark.createDataFrame([(i, 1, int(i % 5 == 0)) for i in range(900)] + [(None, 1, 1), (3, 1, None)], "doc_id long, quality int, toxic int").write.parquet(str(path / "labels.parquet"))
    spark.createDataFrame(items + [(90, None), (91, "")], "item_id long, text string").write.parquet(str(path / "benchmark.parquet"))
    return str(path), docs, items


def kept_by_toxicity(spark, path, docs):
    """Scores text by text, by the convolution written out."""
    net = toxicity.fit(spark.read.parquet(f"{path}/documents.parquet"), spark.read.parquet(f"{path}/labels.parquet"))
    p = net.scores([toxicity.rows_of(t) for _, t, _ in docs])
    return [d for d, x in zip(docs, p) if x < net.thresholds.get(d[2], net.threshold)]


def kept_near(docs):
    known = list(enumerate(d for d in docs if d[0] is not None))
    groups = brute_groups([(k, d[1]) for k, d in known])
    best = {}
    for k, d in known:
        best.setdefault(groups[k], []).append(d)
    return [min(g, key=lambda d: d[0]) for g in best.values()] + [d for d in docs if d[0] is None], best


def kept_clean(docs, items, size=10):
    cut = lambda t: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (t or "").lower())
    windows = {tuple(w[i : i + size]) for _, t in items for w in [cut(t)] for i in range(max(1, len(w) - size + 1) if w else 0)}
    sizes = {len(w) for w in windows}
    holds = lambda w: any(tuple(w[i : i + n]) in windows for n in sizes for i in range(len(w) - n + 1))
    return [d for d in docs if not holds(cut(d[1]))]


def as_rows(docs):
    return sorted((str(i), str(t)) for i, t, _ in docs)


def test_every_stage_keeps_what_brute_force_keeps(spark, sf):
    path, docs, items = sf
    df = spark.read.parquet(f"{path}/documents.parquet")
    assert plain(STAGES["toxicity"](spark, df, path)) == as_rows(kept_by_toxicity(spark, path, docs))
    assert plain(STAGES["decontamination"](spark, df, path)) == as_rows(kept_clean(docs, items))
    got = plain(STAGES["near_duplicates"](spark, df, path))
    want, groups = kept_near(docs)
    assert [r[0] for r in got] == sorted(str(d[0]) for d in want)
    # of several texts with the smallest id of a group, one stays
    assert all(sum((str(i), str(t)) in got for i, t, _ in set(g)) == 1 for g in groups.values())


def test_run_equals_brute_force_from_stage_to_stage(spark, sf):
    path, docs, items = sf
    want = kept_clean(kept_near(kept_by_toxicity(spark, path, docs))[0], items)
    got = corpus_pipeline.run(spark, path).collect()
    assert sorted(str(r["doc_id"]) for r in got) == sorted(str(d[0]) for d in want)
    assert len([d for d in want if (d[0] or 0) >= 5000 and (d[0] or 0) < 6000]) == 0
    assert sum(r["doc_id"] is not None and r["doc_id"] < 900 and r["doc_id"] % 5 == 0 for r in got) < 20


def test_rows_not_ids_are_grouped(spark):
    rng = random.Random(1)
    x, z = (" ".join(f"w{rng.randrange(900)}" for _ in range(60)) for _ in range(2))
    k = " ".join(f"k{j}" for j in range(50))
    docs = [(1, x, "en"), (5, x, "en"), (5, z, "en"), (7, z + " two more", "en"), (9, k, "en"), (9, k, "en")]
    got = plain(STAGES["near_duplicates"](spark, table_of(spark, docs), ""))
    assert got == as_rows([(1, x, 0), (5, z, 0), (9, k, 0)])


def test_stages_of_nothing(spark, tmp_path):
    none = table_of(spark, [(0, "x", "en")]).limit(0)
    none.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for stage in STAGES.values():
        assert stage(spark, none, str(tmp_path)).count() == 0
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    # nothing learnt, nothing to compare with: all stay
    some = table_of(spark, [(1, "one text", "en"), (2, None, None)])
    for name in ("toxicity", "decontamination"):
        assert STAGES[name](spark, some, str(tmp_path)).count() == 2


def test_recall_and_partners_on_given_documents(spark):
    """All pairs of distinct texts at 0.8 or more fall together, and no text goes without a partner."""
    path = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{path}/documents.parquet").select("doc_id", "text")
    rows = [tuple(r) for r in docs.collect()]
    groups = brute_groups(rows)
    got = {r["doc_id"] for r in corpus_pipeline.drop_near_duplicates(spark, docs, path).collect()}
    assert got == {i for i, _ in rows if groups[i] == i}


def test_edits_of_a_hot_text(spark):
    rng = random.Random(9)
    base = [f"w{j}" for j in range(200)]
    docs = [(i, " ".join(edited(rng, base, 1)), "en") for i in range(200)] + [(900 + i, " ".join(base[i : i + 60] + [f"q{i}r{j}" for j in range(60)]), "en") for i in range(40)]
    got = {r["doc_id"] for r in STAGES["near_duplicates"](spark, table_of(spark, docs), "").collect()}
    assert got == {0, *range(900, 940)}


def test_few_texts_go_to_python_at_a_time(spark, sf, monkeypatch):
    asked = {}

    def wrote(df, name, saved=simhash.saved, **options):
        asked[name] = int(spark.conf.get(BATCH))
        return saved(df, name, **options)

    monkeypatch.setattr(simhash, "saved", wrote)
    monkeypatch.setattr(toxicity, "saved", wrote)
    before = spark.conf.get(BATCH)
    path = sf[0]
    docs = spark.read.parquet(f"{path}/documents.parquet")
    for name in ("toxicity", "decontamination", "token_ids"):
        STAGES[name](spark, docs, path)
    assert spark.conf.get(BATCH) == before
    assert {k: asked.get(k) for k in ("labelled", "not-toxic", "not-hit", "token-ids")} == dict.fromkeys(("labelled", "not-toxic", "not-hit", "token-ids"), simhash.WIDE_ROWS)
