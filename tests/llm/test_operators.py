"""Edge cases and brute-force comparisons of the training-data operators."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from nightqueue.llm import ann, bpe_prefix, chat, decontam, pitman_yor, token_count, token_files, toxicity, warc
from pyspark.sql import functions as F
from tokenizers import Tokenizer

WORD, BYTE = (public_tokenizers.path(n) for n in ("word_bpe_49k.json", "byte_bpe_50k.json"))
random.seed(5)
ALPHABET = [*"aAbeilnorst ΣσßİéÉñ \t\n\r\x0b\x1c\x1f\x85 　.,'!?_-#012²½Ⅷ一٣x́<|>/w", "'s", "'ll", "aaaaaaaa", "<|endoftext|>", "<|startoftext|>", "</w>", "😀", "the "]
TEXTS = ["", None, " ", "a" * 3000, "ab" * 1500, " " * 500, "Hello  world.\nThe end", *("".join(random.choice(ALPHABET) for _ in range(random.randint(0, 60))) for _ in range(300))]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", "clash", i) for i, t in enumerate(TEXTS)] + [(3, TEXTS[3], "en", "clash", 3), (None, "no id", None, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, ids string, n_tokens long")


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string")


@pytest.mark.parametrize("path", [WORD, BYTE])
def test_bpe_equals_the_library(docs, empty, path):
    lib = Tokenizer.from_file(path)
    got = bpe_prefix.decode(bpe_prefix.encode(docs, path), path).collect()
    assert len(got) == docs.count()
    for r in got:
        text = "no id" if r["doc_id"] is None else TEXTS[r["doc_id"]] or ""
        want = lib.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(bytes(r["ids"]), "<u4").tolist() == want
        assert r["decoded"] == lib.decode(want, skip_special_tokens=False)
    assert bpe_prefix.encode(empty, path).count() == 0
    both = bpe_prefix.encode(docs, path, decoded_col="decoded").collect()
    assert {(r["doc_id"], bytes(r["ids"]), r["decoded"]) for r in both} == {(r["doc_id"], bytes(r["ids"]), r["decoded"]) for r in got}


@pytest.mark.parametrize("path", [WORD, BYTE])
def test_every_character_encodes_as_in_the_library(path):
    """Code points up to U+1FFFF and the last plane, assigned or not, between letters, numbers, blanks and marks."""
    lib, raw = Tokenizer.from_file(path), open(path, "rb").read()
    points = [chr(c) for c in [*range(0x20000), *range(0xE0000, 0xE0200)] if not 0xD800 <= c < 0xE000]
    rows = ["".join(f"a{c}b 1{c} {c}'s{c}Á{c}\u0301" for c in points[i : i + 64]) for i in range(0, len(points), 64)]
    coder = bpe_prefix.PrefixCoder(raw)
    counts = token_count.RankMerger(raw).tokens(rows) if path == BYTE else None
    for i, (ids, want) in enumerate(zip(coder.packed(rows), lib.encode_batch_fast(rows, add_special_tokens=False))):
        assert np.frombuffer(ids, "<u4").tolist() == want.ids, rows[i]
        assert counts is None or counts[i] == len(want.ids)


def test_long_texts_are_cut_at_seams(monkeypatch):
    from nightqueue.llm import words

    monkeypatch.setattr(words, "GROUP_CHARS", 40)
    lib, raw = Tokenizer.from_file(BYTE), open(BYTE, "rb").read()
    rows = [*(t or "" for t in TEXTS[:60]), "the end  of it's all " * 40, "", "x" * 500, "<|endoftext|>" * 9]
    values, sizes = token_files.LibraryCoder(raw).encode(rows)
    assert [v.tolist() for v in np.split(values, np.cumsum(sizes)[:-1])] == [lib.encode(t, add_special_tokens=False).ids for t in rows]


def test_token_files_give_ranges_and_metadata_alone(spark, tmp_path):
    """Ids lie in dictionary pages, page indexes are there, and a reader of few documents or of metadata reads less."""
    import pyarrow.parquet as pq

    rows = [(i, " ".join(f"word{random.randrange(50)}" for _ in range(40))) for i in range(4000)]
    path = str(tmp_path / "ids")
    token_files.write_token_files(spark.createDataFrame(rows, "doc_id long, text string"), BYTE, path, layout={"parquet.block.size": str(64 << 10)})
    files = sorted(tmp_path.glob("ids/*.parquet"))
    meta = [pq.ParquetFile(f).metadata for f in files]
    columns = {c.path_in_schema.split(".")[0]: c for c in (meta[0].row_group(0).column(k) for k in range(4))}
    assert any("DICTIONARY" in e for e in columns["ids"].encodings) and any("DELTA" in e for e in columns["doc_id"].encodings)
    assert all(c.has_offset_index and c.has_column_index for c in columns.values())
    assert sum(m.num_row_groups for m in meta) > len(files)
    some = token_files.read_token_files(spark, path, first=1000, last=1010)
    assert sorted(r["doc_id"] for r in some.collect()) == list(range(1000, 1011))
    assert "PushedFilters: [IsNotNull(doc_id), GreaterThanOrEqual(doc_id,1000), LessThanOrEqual(doc_id,1010)]" in some._jdf.queryExecution().toString()
    assert "ids" not in token_files.read_token_files(spark, path, ids=False).columns


def test_counts_equal_the_library(docs, empty):
    lib = Tokenizer.from_file(BYTE)
    for r in token_count.count_tokens(docs, BYTE, limit=10).collect():
        text = "no id" if r["doc_id"] is None else TEXTS[r["doc_id"]] or ""
        n = len(lib.encode(text, add_special_tokens=False).ids)
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len(text.encode()), n, n > 10)
    assert token_count.count_tokens(empty, BYTE).count() == 0


def test_token_files_round_trip(spark, docs, empty, tmp_path):
    lib = Tokenizer.from_file(BYTE)
    path = str(tmp_path / "ids")
    token_files.write_token_files(docs.where("doc_id IS NOT NULL"), BYTE, path, end_id=2)
    got = token_files.document_digests(spark, path).orderBy("start").collect()
    start = 0
    for r, i in zip(got, sorted([*range(len(TEXTS)), 3]), strict=True):
        ids = [*lib.encode(TEXTS[i] or "", add_special_tokens=False).ids, 2]
        assert (r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) == (i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    token_files.write_token_files(empty, BYTE, str(tmp_path / "none"))
    assert token_files.document_digests(spark, str(tmp_path / "none")).count() == 0


def test_chat_round_trip(spark):
    odd = [None, "", "\\", "\\### Assistant: </turn> ok", "<turn user>\nx</turn>\n", "a\\</turn>", "ß" * 40, "<", "</", "line\nline"]
    rows = [(c, t, ["user", "assistant", None, "sys>\n<turn"][(c + t) % 4], random.choice(odd)) for c in range(40) for t in range(random.randint(1, 9))]
    rows += [(None, 0, "assistant", "x"), (5, 0, "user", "repeated"), (5, 0, "user", "repeated")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("part", F.lit(9))
    for size in (1 << 20, 200):
        got = {r["conv_id"]: r for r in chat.conversation_digests(chat.format_conversations(df, part_bytes=size)).collect()}
        assert len(got) == len({r[0] for r in rows})
        for conv, r in got.items():
            turns = sorted(((t, role or "", text or "") for c, t, role, text in rows if c == conv), key=lambda x: (x[0], x[1], x[2]))
            said = "".join(t for _, role, t in turns if role == "assistant")
            assert r["n_turns"] == len(turns)
            assert r["loss_chars"] == len(said) and r["loss_sha256"] == hashlib.sha256(said.encode()).hexdigest()
            by_turn = collections.defaultdict(list)
            for t in turns:
                by_turn[t[0]].append(t)
            if all(len(set(x)) == 1 for x in by_turn.values()):
                assert r["turns_sha256"] == hashlib.sha256("".join(f"{role}\n{t}\n" for _, role, t in turns).encode()).hexdigest()
    assert chat.format_conversations(df.limit(0)).count() == 0


def test_toxicity_learns_stems_and_takes_any_text(spark, empty):
    random.seed(1)
    fill = [f"w{random.randint(0, 400)}x" for _ in range(900)]
    rows = []
    for i in range(700):
        words = random.sample(fill, 25)
        if i % 4 == 0:
            words[3], words[9] = f"badstem{i % 17}", f"badstem{i % 13}"
        rows.append((i, " ".join(words), "en" if i % 2 else "de", int(i % 4 == 0)))
    all_docs = spark.createDataFrame([(a, b, c) for a, b, c, _ in rows] + [(900, None, None), (901, "", "en"), (902, "x " * 30000, "xx"), (0, rows[0][1], "de")], "doc_id long, text string, lang string").withColumn("score", F.lit("clash"))
    labels = spark.createDataFrame([(a, y) for a, _, _, y in rows] + [(1, None), (None, 1), (5000, 1)], "doc_id long, toxic int")
    net = toxicity.fit(all_docs, labels, most_rows=400)
    got = toxicity.score(all_docs, net).withColumn("held", toxicity.held_out("doc_id")).collect()
    assert len(got) == all_docs.count() and all(0 <= r["score"] <= 1 for r in got)
    held = [r for r in got if r["held"] and r["doc_id"] < 700]
    hits = sum((r["score"] >= 0.7) == (r["doc_id"] % 4 == 0) for r in held)
    assert hits / len(held) > 0.97
    flat = toxicity.fit(empty, labels.limit(0))
    assert flat.scores([toxicity.rows_of("x")])[0] < 1e-9 and toxicity.score(empty, flat).count() == 0


def test_neighbours_reach_brute_force(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(1500, 16)).astype(np.float32)
    x[100:400] = x[99]
    rows = [(i, [float(v) for v in x[i]]) for i in range(len(x))]
    bad = [(9000, None), (9020, [0.0] * 16), (9040, [float("nan")] * 16), (9060, [1.0, None] + [0.0] * 14), (9080, [1.0]), (None, rows[0][1])]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<float>").withColumn("rank", F.lit(0))
    got = collections.defaultdict(list)
    for r in ann.nearest(df, lambda i: i % 20 == 0, k=20, shard_rows=500, block_rows=40).collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    assert set(got) == set(range(0, 1500, 20))
    found, y = 0, x.astype(np.float64)
    for q, rs in got.items():
        s = y @ y[q]
        want = sorted((i for i in range(len(y)) if i != q), key=lambda i: (-s[i], i))[:20]
        rs.sort()
        assert [r[0] for r in rs] == list(range(1, 21))
        assert rs == sorted(rs, key=lambda r: (-r[2], r[1]))
        found += len(set(want) & {r[1] for r in rs})
        if 99 <= q < 400:
            assert [r[1] for r in rs] == [i for i in range(99, 120) if i != q][:20]
    assert found / 20 / len(got) > 0.95
    assert ann.nearest(df.limit(0), lambda i: i % 20 == 0).count() == 0


def test_every_shard_is_asked_where_some_numbers_have_none(spark):
    df = spark.createDataFrame([(i, [float(i + 1), float(i * i % 7)]) for i in range(12)], "vec_id long, embedding array<double>")
    got = ann.nearest(df, lambda i: i % 20 == 0, k=20, shard_rows=1)
    assert sorted(r["vec_id"] for r in got.collect()) == [*range(1, 12)]


def test_shards_grow_so_that_a_search_asks_few():
    assert ann.rows_of_shards(60_000, 64) == 8192
    assert ann.rows_of_shards(10**8, 64) == 320_000
    assert ann.rows_of_shards(10**12, 64) * 64 * 8 <= ann.SHARD_BYTES


def test_language_model_counts_and_sums(spark, empty):
    random.seed(4)
    vocab = [f"w{int(random.paretovariate(0.7))}" for _ in range(500)]
    rows = [(i, " ".join(random.choice(vocab) for _ in range(random.randint(0, 60)))) for i in range(300)] + [(300, None), (301, " \t"), (302, "Ünder ÜNDER x"), (7, "w1 w1 w1"), (None, "w1")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit("clash"))
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    toks = [(i, [*re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")), "\n"]) for i, t in rows]
    c = collections.Counter(w for i, ws in toks if not held(i) for w in ws)
    n, v = sum(c.values()), len(c)
    got = pitman_yor.lm_scores(df, lambda i: F.crc32(i.cast("string")) % 7 == 2).collect()
    want = sorted((str(i), len(ws), sum(w in c for w in ws), round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws), 6)) for i, ws in toks)
    assert sorted((str(r["doc_id"]), r["n_tokens"], r["n_known"], round(r["base_score"], 6)) for r in got) == want
    assert all(r["train_tokens"] == n and r["score"] < 0 and r["held_out"] == held(r["doc_id"]) for r in got)
    assert pitman_yor.lm_scores(empty, lambda i: F.lit(False)).count() == 0
    unlearnt = pitman_yor.lm_scores(df, lambda i: F.lit(True)).collect()
    assert len(unlearnt) == len(rows) and all(r["n_known"] == r["train_tokens"] == 0 and r["score"] == pytest.approx(0) for r in unlearnt)
    few = pitman_yor.lm_scores(spark.createDataFrame([(7, "w1 w1 w1"), (302, "x y")], df.select("doc_id", "text").schema), lambda i: i == 302).collect()
    assert sorted((r["n_known"], r["train_tokens"]) for r in few) == [(1, 4), (4, 4)]  # the end token, and three words with theirs


def test_language_model_probabilities_sum_to_one():
    rng, classes = np.random.default_rng(0), 256
    keys = np.unique(rng.integers(0, 30, 200) * classes + rng.integers(0, 6, 200))
    train = rng.integers(1, 200, len(keys))
    row = {"words": pitman_yor.pack_sorted(np.sort(rng.integers(0, 1 << 62, 30))), "keys": pitman_yor.pack_sorted(keys), "train": pitman_yor.pack(train)}
    r = pitman_yor.Restaurants(row, 30, classes)
    customers = np.bincount(r.k2, r.c2, classes).astype(np.int64)
    totals = lambda: np.r_[np.bincount(r.k2, r.t2, classes), r.t0.sum()].astype(np.int64)
    for _ in range(3):
        r.sweep(customers, totals())
        assert (r.t2 >= 1).all() and (r.t2 <= r.c2).all()
    p0, unknown, p2, back = r.predictive(customers, totals())
    root = np.concatenate([p0, np.full(31 - len(p0), unknown)])
    assert root.sum() == pytest.approx(1)
    for k in range(6):
        whole = back[k] * root
        whole[r.up0[r.k2 == k]] = p2[r.k2 == k]
        assert whole.sum() == pytest.approx(1)


def table_law(n, base, discount, parent):
    """The chance of each number of tables from 1 to n; parent(j): what the parent gives the j-th table after the first."""
    logs = np.r_[0.0, np.full(n - 1, -np.inf)]
    for m in range(1, n):
        with np.errstate(divide="ignore"):
            stay = np.log(np.maximum(m - discount * np.arange(1, n + 1), 0)) + logs
        logs = np.logaddexp(stay, np.r_[-np.inf, logs[:-1]])
    j = np.arange(1, n)
    logs = logs + np.r_[0, np.cumsum(np.log((base + discount * j) * parent(j)))]
    chance = np.exp(logs - logs.max())
    return chance / chance.sum()


LAWS = [(2, 1.0, 0.8, 0.3, 1, 0), (20, 50.0, 0.8, 0.01, 1, 0), (50, 200.0, 0.8, 0.02, 1, 0), (50, 10.0, 0.8, 3.2, 90, 1), (1024, 5.0, 0.8, 0.6, 1, 0), (1025, 5.0, 0.8, 0.6, 1, 0), (3000, 2.0, 0.8, 0.0001, 1, 0), (3000, 900.0, 0.8, 0.5, 1, 0), (3000, 9000.0, 0.8, 0.5, 1, 0), (4000, 5000.0, 0.8, 200.0, 9000, 1), (3000, 3.0, 0.5, 0.2, 1, 0), (3000, 9000.0, 0.5, 0.01, 1, 0)]


@pytest.mark.parametrize("n, base, discount, own, everyone, step", LAWS)
def test_tables_follow_the_exact_conditional(n, base, discount, own, everyone, step):
    """Up to 1,024 customers within sampling error; above, the mean also may be off by 1 %."""
    many = 4000
    keys = pitman_yor.mixed(np.arange(many, dtype=np.uint64))
    args = np.full(many, n), np.full(many, base), discount, np.full(many, own), np.full(many, float(everyone)), step, keys
    got = pitman_yor.seat(*args, 5)
    chance, t = table_law(n, base, discount, lambda j: (own + step * j) / (everyone + step * j)), np.arange(1, n + 1)
    mean = chance @ t
    std = math.sqrt(chance @ (t - mean) ** 2)
    assert (got >= 1).all() and (got <= n).all()
    assert abs(got.mean() - mean) < 4 * std / math.sqrt(many) + (0.01 * mean if n > pitman_yor.EXACT else 0)
    assert got.std() == pytest.approx(std, rel=0.1, abs=0.02)
    assert (pitman_yor.seat(*args, 5) == got).all() and (n < 9 or std < 0.1 or (pitman_yor.seat(*args, 4) != got).any())


def test_tables_are_those_of_customers_removed_and_reseated():
    rng, n, base, discount, parent = np.random.default_rng(3), 20, 50.0, 0.8, 0.01
    sizes, seen = [n], []
    for sweep in range(4000):
        for _ in range(n):
            k = rng.choice(len(sizes), p=np.array(sizes) / n)
            if n > 1 and sizes[k] == 1 and len(sizes) == 1:
                continue
            sizes[k] -= 1
            sizes = [s for s in sizes if s]
            # the first table of a dish has the factor base, each further one base + discount * tables
            weights = np.array([s - discount for s in sizes] + [(base + discount * len(sizes)) * parent])
            k = rng.choice(len(weights), p=weights / weights.sum())
            sizes = sizes + [1] if k == len(sizes) else [s + (i == k) for i, s in enumerate(sizes)]
        seen.append(len(sizes))
    keys = pitman_yor.mixed(np.arange(4000, dtype=np.uint64))
    got = pitman_yor.seat(np.full(4000, n), np.full(4000, base), discount, np.full(4000, parent), np.ones(4000), 0, keys, 2)
    assert got.mean() == pytest.approx(np.mean(seen), abs=0.1) and got.std() == pytest.approx(np.std(seen), abs=0.1)


def test_many_customers_need_no_more_work():
    n = np.array([10**6, 10**9, 10**12])
    t = pitman_yor.seat(n, np.full(3, 20.0), 0.8, np.full(3, 0.1), np.ones(3), 0, pitman_yor.mixed(np.arange(3, dtype=np.uint64)), 1)
    assert (t >= 1).all() and (t < n / 1000).all()


def test_language_model_learns_and_does_not_depend_on_settings(spark, monkeypatch):
    random.seed(14)
    after = {w: [random.randint(0, 300) for _ in range(3)] for w in range(301)}

    def text():
        w, out = random.randint(0, 300), []
        for _ in range(40):
            w = random.choice(after[w])
            out.append(f"w{w}")
        return " ".join(out)

    df = spark.createDataFrame([(i, text()) for i in range(500)], "doc_id long, text string")
    held = lambda i: F.crc32(F.col(i).cast("string") if isinstance(i, str) else i.cast("string")) % 7 == 2
    score = lambda d: {r["doc_id"]: (r["score"], r["base_score"], r["held_out"], r["n_tokens"]) for r in pitman_yor.lm_scores(d, held).collect()}
    got = score(df)
    own = [r for r in got.values() if r[2]]
    # three ways on from each word: log10(3) = 0.48 a token, against log10(301) = 2.48 without context
    assert sum(r[0] for r in own) / sum(r[3] for r in own) > -0.8 > -2.2 > sum(r[1] for r in own) / sum(r[3] for r in own)
    same = lambda again: len(again) == len(got) and all(again[i] == (pytest.approx(r[0], abs=1e-9), *r[1:]) for i, r in got.items())
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "7")
        again = score(df.repartition(3))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert same(again)
    # rows that teach nothing change no score, however many
    more = df.where(held("doc_id")).select(F.lit(-2).cast("long"), F.concat("text", F.lit(" unheard of "), F.repeat(F.lit("much more text "), 300)))
    again = score(df.union(more))
    assert again.pop(-2)[2] and same(again)
    # every bucket in several parts, each block in one of them
    made = []
    monkeypatch.setattr(pitman_yor, "PART_BYTES", 1500)
    monkeypatch.setattr(pitman_yor, "saved", lambda df, name, saved=pitman_yor.saved, **options: made.append(name) or saved(df, name, **options))
    assert same(score(df.repartition(9))) and made.count("lm-models") > 1


def test_classes_of_contexts_grow_with_the_text():
    sizes = [pitman_yor.n_classes(10**k) for k in range(15)]
    assert sizes == sorted(sizes) and sizes[7] == 8192 and sizes[14] == 1 << 23


def test_decontamination_equals_brute_force(spark, empty):
    random.seed(8)
    words = [f"v{i}" for i in range(6)]
    items = [(i, " ".join(random.choice(words) for _ in range(random.choice([0, 3, 9, 10, 14])))) for i in range(30)] + [(50, None), (3, "v1 v2"), (51, "Ä-ö v0"), (52, "Ä ö V0"), (None, "nobody's own")]
    texts = [" ".join(random.choice(words) for _ in range(60)) for _ in range(40)] + [None, "", "ä ö v0", "Ä Ö V0", items[2][1] or "x", "v1 " * 5000, "of nobody's own"]
    df = spark.createDataFrame([(i, t, "clash", "own") for i, t in enumerate(texts)], "doc_id long, text string, item_ids string, words string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    cut = lambda t: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    for most in (2 << 20, 300):  # in every task, and by shuffled joins
        rows = decontam.contamination(df, bench, most_bytes=most).collect()
        assert sorted(r["doc_id"] for r in rows) == list(range(len(texts)))
        for r in rows:
            w, hit, found = cut(texts[r["doc_id"]]), set(), set()
            for item, t in items:
                b = cut(t)
                for s in range(max(1, len(b) - 9) if b else 0):
                    win = b[s : s + 10]
                    for i in range(len(w) - len(win) + 1):
                        if w[i : i + len(win)] == win:
                            hit |= set(range(i, i + len(win)))
                            found |= {str(item)} - {"None"}
            assert r["n_words"] == len(w) and r["item_ids"] == sorted(found) and r["words"] == "own"
            assert sum(b - a for a, b in zip(r["hit_starts"], r["hit_ends"])) == len(hit)
        assert decontam.contamination(empty, bench, most_bytes=most).count() == 0
    assert decontam.contamination(df.union(df), bench, most_bytes=300).count() == 2 * len(texts)
    assert decontam.contamination(df, bench.limit(0)).where(F.size("hit_starts") > 0).count() == 0


@pytest.mark.parametrize("chunk", [1 << 20, 7])
def test_warc_round_trip(spark, tmp_path, chunk):
    pages = [(i, f"http://x/{i % 3}\r\n/WARC/1.1", ["", None, "same", "WARC/1.1\r\nWARC-Type: x\r\n\r\n", "ends in WARC/1.1", "ünï" * 50, "\r\n\r\n", f"own {i}"][i % 8]) for i in range(64)] + [(None, None, "same"), (7, "http://x", "own 7")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("hex", F.lit("clash"))
    path = str(tmp_path / "warc")
    warc.write_archives(warc.record_chunks(df, "page_id", "url", "html", chunk_bytes=chunk), path)
    got = warc.read_archives(spark, path).collect()
    best = {}
    for i, _, t in pages:
        best[t or ""] = max(best.get(t or "", -1), -1 if i is None else i)
    import base64

    want = [(i, len((t or "").encode()), base64.b32encode(hashlib.sha1((t or "").encode()).digest()).decode(), "response" if i == best[t or ""] else "revisit", None if i == best[t or ""] else best[t or ""]) for i, _, t in pages]
    key = lambda r: (str(r[0]), r[2])
    assert sorted(((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got), key=key) == sorted(want, key=key)


def test_warc_of_nothing(spark, tmp_path):
    df = spark.createDataFrame([], "page_id long, url string, html string")
    warc.write_archives(warc.record_chunks(df, "page_id", "url", "html"), str(tmp_path / "w"))
    assert warc.read_archives(spark, str(tmp_path / "w")).count() == 0
