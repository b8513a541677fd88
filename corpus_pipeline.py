"""The corpus pipeline: toxicity, near duplicates, benchmark passages, token ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; what it keeps is written and read
again as the next one's docs. All but the last return the columns of documents, whatever else these
are called: an input column that has the name of one that an operator makes keeps its own values. What goes
through Python with its text is written by the stage itself, as few rows go to Python at a time: batches of
whole texts stay in the executor's memory on both sides, and all later stages have to do with what is left.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from nightqueue.llm import bpe_prefix, decontam, simhash, toxicity
from nightqueue.llm.queries import tokenizer
from nightqueue.llm.store import rows_a_batch, saved, table


def set_apart(docs: DataFrame, *needed: str) -> tuple[DataFrame, list[Column]]:
    """docs with all columns but the needed ones under names that no operator uses, and what gives them back."""
    names = {c: c if c in needed else f"__col{i}" for i, c in enumerate(docs.columns)}
    return docs.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()]), [F.col(n).alias(c) for c, n in names.items()]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score stays below the threshold of their language.

    Null and empty texts are scored like one unknown word, and stay unless most documents are toxic.
    Repeated rows share their score, so all stay or all go. Without labels of both kinds nothing is
    learnt: then all stay, or all go where every label is toxic. An empty table stays empty."""
    with rows_a_batch(spark, simhash.WIDE_ROWS):
        net = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    rows, back = set_apart(docs, "doc_id", "text", "lang")
    return simhash.saved_wide(toxicity.score(rows, net, keep_text=True).where(~F.col("toxic")).drop("score", "toxic"), "not-toxic").select(*back)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of texts linked by 0.8 of their five-word shingles: the one with the smallest id.

    Rows are told apart by id and text: two texts under one id fall into the groups of their texts, and of
    rows that repeat both one stays. Texts without words, null ones too, are copies of each other. Rows
    without an id stay and take no part. An empty table stays empty."""
    row = ["__id", "__t1", "__t2"]
    found = saved(simhash.near_texts(docs), "near-texts").where("id IS NOT NULL")
    each = found.select(F.col("id").alias("__id"), F.col("t1").alias("__t1"), F.col("t2").alias("__t2"), "cluster").groupBy("cluster", *row).agg(F.count("*").alias("n"))
    each = saved(each, "near-rows")
    stay = saved(each.groupBy("cluster").agg(F.min(F.struct(*row, "n")).alias("x")).select("x.*"), "near-stay")
    twice = stay.where("n > 1").select(*row)
    gone = each.select(*row).join(stay.where("n = 1").select(*row), row, "left_anti")
    rows = docs.select("*", F.col("doc_id").alias("__id"), *[h.alias(n) for h, n in zip(simhash.identity(), row[1:])])
    out = rows.join(gone, row, "left_anti")
    if not twice.isEmpty():
        out = out.union(rows.join(twice, row, "left_semi").dropDuplicates(row))
    return out.drop(*row)


def drop_benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item.

    Null and empty texts have no words, and stay. Repeated rows all stay or all go. Without benchmark
    items all stay; an empty table stays empty."""
    rows, back = set_apart(docs, "text")
    found = decontam.contamination(rows, table(spark, sf_dir, "benchmark"), keep_text=True)
    return simhash.saved_wide(found.where(F.size("hit_starts") == 0).select(*rows.columns), "not-hit").select(*back)


def encode_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, and digests of the ids and of the text that they decode to: one row per row of docs.

    Null and empty texts have no ids; an empty table gives no rows."""
    both = bpe_prefix.encode(docs.select("doc_id", "text"), tokenizer("word_bpe_49k.json"), decoded_col="decoded")
    out = both.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
    # few texts go to Python at a time: what is sent ahead counts against the memory that earlier stages have left
    return simhash.saved_wide(out, "token-ids")


STAGES = [("toxicity", drop_toxic), ("near_duplicates", drop_near_duplicates), ("decontamination", drop_benchmark_passages), ("token_ids", encode_ids)]

#: A trained classifier and a tokenizer decide: SQL can't say it.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
