"""Toxicity learns from every labelled row, however few rows of a class a part holds."""

import random

import numpy as np
from nightqueue.llm import toxicity


def test_every_labelled_row_teaches(spark):
    rng = random.Random(5)
    fill = [f"w{i}x" for i in range(300)]
    rows, stems = [], [f"{chr(97 + i % 26)}{chr(97 + i // 26)}stem" for i in range(40)]
    for i in range(2400):
        words = [rng.choice(fill) for _ in range(20)]
        if i % 4 == 0:
            words[5] = stems[i // 4 % 40]
        rows.append((i, " ".join(words), "en", int(i % 4 == 0)))
    docs = spark.createDataFrame([r[:3] for r in rows], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(r[0], r[3]) for r in rows], "doc_id long, toxic int")
    # a part holds some 80 toxic rows: most of the 40 stems stand in other parts
    found, _, parts = toxicity.labelled_rows(docs, labels, lambda c: ~toxicity.held_out(c), most_rows=60)
    assert parts > 3 and found.count() == labels.where(~toxicity.held_out("doc_id")).count() and 0 < found.where("test").count() < found.count() / 3
    net = toxicity.fit(docs, labels, most_rows=60, least_steps=200, epochs=60)
    p = net.scores([toxicity.rows_of(f"w1x w2x {s} w3x") for s in stems])
    plain = net.scores([toxicity.rows_of("w1x w2x w7x w3x")])
    assert (p > plain[0]).mean() > 0.9 and p.mean() > plain[0] + 0.2, np.round(p, 2)
    again = toxicity.fit(docs.orderBy("text"), labels.orderBy("doc_id"), most_rows=60, least_steps=200, epochs=60)
    assert (again.flat() == net.flat()).all() and again.threshold == net.threshold and again.thresholds == net.thresholds


def test_nets_survive_a_line_of_parameters():
    net = toxicity.ConvNet.new(3)
    net.offset = -0.5
    net.embeddings[2][5] = 1.5
    same = toxicity.ConvNet.of(net.flat())
    assert (same.flat() == net.flat()).all() and same.offset == -0.5 and (same.filters[3] == net.filters[3]).all()
