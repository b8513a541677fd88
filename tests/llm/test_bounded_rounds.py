"""Links of bounded number are settled without rounds; how pairs meet their sets doesn't change the groups."""

import random

from nightqueue.llm import components as C, minhash, simhash


def brute(pairs):
    root = {x: x for p in pairs for x in p}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    return {x: find(x) for x in root}


def test_few_links_need_no_rounds(spark, monkeypatch):
    """A long chain, a star, a loop, copies of links and both directions: one table is written, not several a round."""
    rng = random.Random(3)
    names = rng.sample(range(-(2**61), 2**61), 400)
    pairs = [*zip(names[:150], names[1:151]), *((names[200], x) for x in names[201:300]), (names[300], names[301]), (names[301], names[300]), (names[5], names[6])]
    rng.shuffle(pairs)
    written = []
    monkeypatch.setattr(C, "saved", lambda df, name, save=C.saved: written.append(name) or save(df, name))
    links = spark.createDataFrame([*pairs, (names[390], names[390])], "a long, b long")
    expected = brute(pairs)
    assert {r["node"]: r["root"] for r in C.components(links).collect()} == expected
    assert written == ["links"]
    rows = C.components(links, part=40).collect()
    assert len(rows) == len(expected) and {r["node"]: r["root"] for r in rows} == expected
    assert C.components(links.limit(0)).collect() == []


def test_pairs_sent_and_pairs_joined_give_the_same_groups(spark, monkeypatch):
    rng = random.Random(4)
    base = [[f"w{rng.randrange(900)}" for _ in range(80)] for _ in range(12)]
    rows = [(i, " ".join(w if rng.random() > 0.01 else "new" for w in rng.choice(base))) for i in range(120)] + [(500, None), (501, ""), (None, "x y z")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    look = lambda: sorted(map(tuple, minhash.near_documents(df).collect()), key=str)
    sent = look()
    assert len({r[2] for r in sent}) < 100
    monkeypatch.setattr(simhash, "FEW_PAIRS", -1)
    monkeypatch.setattr(simhash, "PAIRS_A_TASK", 1)
    monkeypatch.setattr(simhash, "ROWS_A_TASK", 1)
    assert look() == sent
