"""Token ids in Parquet: list columns, encoded and cut so that tokens and metadata can be read apart.

The files hold doc_id, row_no (place in the file), n_tokens and ids (with the end id), sorted by doc_id within and across files.
Page indexes come with every file; row groups and pages are kept small enough that a reader of some
documents touches some pages. Ids repeat, so dictionary pages come first and delta encoding takes
over (writer version 2) where a dictionary grows too large.

Null text encodes as empty: just the end id. Rows with equal doc_id stay next to each other, ordered
by their texts. An empty table gives files without rows. Extra columns can be written too.
"""

from __future__ import annotations

import hashlib
import os
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .arrow_rows import slices, texts
from .memos import take
from .store import shared_dir
from .vocab import read_tokenizer
from .words import GLUED, Cutter, Memo, encoded, gathered

#: How the Parquet writer lays files out; any of them can be overridden.
LAYOUT = {
    "parquet.block.size": str(32 << 20),
    "parquet.page.size": str(256 << 10),
    "parquet.page.row.count.limit": "2000",
    "parquet.enable.dictionary": "true",
    "parquet.writer.version": "v2",
    "compression": "zstd",
}


class LibraryCoder:
    """The tokenizers library, asked once for each word that a worker meets."""

    #: New words that the library gets as one text, with line feeds between them.
    RUN = 100

    def __init__(self, raw: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_buffer(raw)
        special = {t.content: i for i, t in self.library.get_added_tokens_decoder().items()}
        self.cutter, self.memo = Cutter(GLUED, special), Memo(self.learn)
        (self.mark,) = self.library.encode("\n", add_special_tokens=False).ids

    def learn(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The words' ids and how many each has. A line feed ends any word that isn't white space itself, and is one token."""
        blank = np.array([w.isspace() for w in words])
        plain, alone = ([w for w, b in zip(words, blank.tolist()) if b == white] for white in (False, True))
        runs = ["\n".join(plain[i : i + self.RUN]) for i in range(0, len(plain), self.RUN)]
        found = [e.ids for e in self.library.encode_batch_fast([*runs, *alone], add_special_tokens=False)]
        values = np.array([i for ids in found[: len(runs)] for i in (*ids, self.mark)], "<i4")
        ends = np.flatnonzero(values == self.mark)
        begins, sizes = np.empty(len(words), np.int64), np.empty(len(words), np.int64)
        begins[~blank] = np.r_[0, ends + 1][:-1]
        sizes[~blank] = ends - begins[~blank]
        sizes[blank] = [len(ids) for ids in found[len(runs) :]]
        begins[blank] = len(values) + np.cumsum(sizes[blank]) - sizes[blank]
        values = np.r_[values, np.array([i for ids in found[len(runs) :] for i in ids], "<i4")]
        return gathered(values, begins, sizes)[0], sizes

    def encode(self, batch: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, one after another, and how many each text has."""
        return encoded(self.cutter, self.memo, batch)


_CODERS: dict[str, LibraryCoder] = {}


def _coder(raw: bytes) -> LibraryCoder:
    take("token_files", _CODERS.clear)
    key = hashlib.sha1(raw).hexdigest()
    if key not in _CODERS:
        _CODERS[key] = LibraryCoder(raw)
    return _CODERS[key]


def write_token_files(df: DataFrame, tokenizer_path: str, path: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", extra: tuple[str, ...] = (), layout: dict[str, str] | None = None) -> None:
    """Encodes `text_col` and writes the files to `path`. Texts are dealt by ranges of `id_col` first, so
    that encoding runs on the sorted partitions and the ids are written where they are made."""
    raw = df.sparkSession.sparkContext.broadcast(read_tokenizer(tokenizer_path))
    kept = [id_col, *extra]
    src = df.select(*[F.col(f"`{c}`") for c in kept], F.coalesce(F.col(text_col), F.lit("")).alias("__text__")).repartitionByRange(id_col).sortWithinPartitions(id_col, "__text__")

    def body(batches):
        own, row = _coder(raw.value), 0
        for whole in batches:
            for batch in slices(whole, "__text__"):
                values, sizes = own.encode(texts(batch, "__text__"))
                ids = np.insert(values, np.cumsum(sizes), end_id)
                sizes = sizes + 1
                offsets = np.r_[0, np.cumsum(sizes)].astype(np.int32)
                rows = pa.array(np.arange(row, row + len(sizes)))
                row += len(sizes)
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), rows, pa.array(sizes), pa.ListArray.from_arrays(offsets, pa.array(ids))], names=[*kept, "row_no", "n_tokens", "ids"])

    schema = ", ".join([f"`{c}` {df.schema[c].dataType.simpleString()}" for c in kept] + ["row_no long", "n_tokens long", "ids array<int>"])
    src.mapInArrow(body, schema).write.options(**(LAYOUT | (layout or {}))).parquet(path)


def read_token_files(spark: SparkSession, path: str, ids: bool = True, first=None, last=None, id_col: str = "doc_id") -> DataFrame:
    """The documents of the files, all or those from `first` to `last`: files, row groups and pages of others
    are skipped by their statistics. Without `ids` only the metadata pages are read."""
    df = spark.read.parquet(path)
    if first is not None:
        df = df.where(F.col(id_col) >= F.lit(first))
    if last is not None:
        df = df.where(F.col(id_col) <= F.lit(last))
    return df if ids else df.drop("ids")


def file_starts(spark: SparkSession, path: str, id_col: str = "doc_id") -> DataFrame:
    """file, base: the number of ids in all files before, in ascending order of ids. One row per file."""
    per_file = read_token_files(spark, path, ids=False).groupBy(F.col("_metadata.file_name").alias("file")).agg(F.min(id_col).alias("low"), F.sum("n_tokens").alias("total"))
    before = Window.orderBy(F.col("low").asc_nulls_first(), "file").rowsBetween(Window.unboundedPreceding, -1)
    return per_file.select("file", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base"))


def document_digests(spark: SparkSession, path: str, id_col: str = "doc_id") -> DataFrame:
    """Reads the files back: id, start (ids of all documents before), n_tokens and the crc32 of the ids."""

    def body(batches):
        for batch in batches:
            col = batch.column("ids")
            values, offs = np.ascontiguousarray(col.values.to_numpy(zero_copy_only=False), "<i4"), col.offsets.to_numpy()
            crc = [zlib.crc32(memoryview(values[a:b]).cast("B")) if b > a else 0 for a, b in zip(offs[:-1], offs[1:])]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in (id_col, "file", "row_no")), pa.array(np.diff(offs).astype(np.int64)), pa.array(crc, pa.int64())], names=[id_col, "file", "row_no", "n_tokens", "ids_crc32"])

    df = read_token_files(spark, path)
    rows = df.select(id_col, F.col("_metadata.file_name").alias("file"), "row_no", "ids").mapInArrow(body, f"`{id_col}` {df.schema[id_col].dataType.simpleString()}, file string, row_no long, n_tokens long, ids_crc32 long")
    inside = Window.partitionBy("file").orderBy("row_no").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("inside", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)))
    # one row per file: a broadcast only while Spark finds it small
    return rows.join(file_starts(spark, path, id_col), "file").select(id_col, (F.col("base") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32")


def token_path(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/token-files-{uuid.uuid4().hex}"
