"""Benchmark decontamination: an exact containment join of item windows with documents.

A window is `size` consecutive item words (a shorter item is one window). Words are ordered by
rarity over the benchmark's windows; since a window must be contained whole, its rarest word alone
is its prefix: a document can hold the window only where it holds that word. So only occurrences of
prefix words are candidates. The place of the prefix word in the window bounds where the window starts
and ends; what stays is compared word by word with the windows of that length.

A benchmark whose text is at most `most_bytes`, a checked size, goes to every task, and documents never
shuffle. A larger one stays in tables: the occurrences of prefix words, each with the words around it, are
joined with the prefix words' places and then with the windows. What each task gets then is a bitmap of
prefix words, of one size for all benchmarks; no join has more than one row per word or window on its
other side, so Spark can split hot words and hot windows.

Null and empty texts have no words and no hits; items without words have no windows. Items without an id
mark words but aren't reported. Equal items are all reported, repeated item ids once. Repeated documents give repeated rows. Extra columns stay.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .arrow_rows import slices
from .store import saved

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
ADDED = "n_words long, hit_starts array<int>, hit_ends array<int>, item_ids array<string>"
#: Bits that tell tasks which words are prefixes of windows: 2 MB at any size of the benchmark.
SLOTS = 1 << 24
#: Bytes of text that stand as words in a task at a time, about; as words they take several times that.
SLICE_BYTES = 1_000_000
#: Rows of windows or candidates that leave a task at a time.
ROWS = 10_000


def words(text: str | None) -> list[bytes]:
    return WORD.findall((text or "").encode("utf-8", "surrogatepass").lower())


class PrefixIndex:
    """Windows of a block of items, and where to look for them."""

    def __init__(self, items: list[tuple[str, str | None]], size: int):
        self.windows: dict[bytes, set[str]] = {}
        cut = []
        for item, text in items:
            found = words(text)
            for i in range(max(1, len(found) - size + 1) if found else 0):
                w = tuple(found[i : i + size])
                key = b" ".join(w)
                if key not in self.windows:
                    cut.append(w)
                self.windows.setdefault(key, set()).add(item)
        seen = Counter(x for w in cut for x in set(w))
        self.places: dict[bytes, list[tuple[int, int]]] = {}
        for w in cut:
            at = min(range(len(w)), key=lambda i: (seen[w[i]], -len(w[i]), w[i]))
            place = (at, len(w))
            if place not in self.places.setdefault(w[at], []):
                self.places[w[at]].append(place)

    def search(self, found: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Merged spans of hit words, and the items that have a window here."""
        spans, items, places, n = [], set(), self.places, len(found)
        for i in [i for i, w in enumerate(found) if w in places]:
            for at, length in places[found[i]]:
                start = i - at
                if start >= 0 and start + length <= n:
                    hit = self.windows.get(b" ".join(found[start : start + length]))
                    if hit:
                        items |= hit
                        spans.append((start, start + length))
        return spans, items


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


def contamination(df: DataFrame, benchmark: DataFrame, size: int = 10, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", most_bytes: int = 2 << 20, keep_text: bool = False) -> DataFrame:
    """Adds n_words, hit_starts, hit_ends (spans of hit words) and item_ids to df.

    Columns of df with these names are replaced; the text is dropped unless `keep_text`."""
    items = benchmark.select(F.col(item_col).cast("string").alias("item"), F.coalesce(F.col(item_text), F.lit("")).alias("text"))
    total = items.agg(F.sum(F.octet_length("text") + F.coalesce(F.octet_length("item"), F.lit(0)))).first()[0] or 0
    added = StructType.fromDDL(ADDED)
    kept = [c for c in df.columns if c not in added.names and (keep_text or c != text_col)]
    src = df.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{text_col}`").alias("__text__"))
    schema = StructType([*(df.schema[c] for c in kept), *added])
    if total > most_bytes:
        return from_tables(src, items, size, schema)
    sent = df.sparkSession.sparkContext.broadcast([tuple(r) for r in items.collect()])

    def body(batches):
        index = PrefixIndex(sent.value, size)
        for whole in batches:
            for batch in slices(whole, "__text__", SLICE_BYTES):
                texts = [words(t) for t in batch.column("__text__").to_pylist()]
                yield with_hits(batch, schema.names, [len(t) for t in texts], *zip(*(index.search(t) for t in texts)))

    return src.mapInArrow(body, schema)


def with_hits(batch: pa.RecordBatch, names: list[str], n_words, spans, items) -> pa.RecordBatch:
    """The batch with the added columns (the last four names) made from unmerged spans and items of its rows."""
    spans, ints = [merged(s) for s in spans], pa.list_(pa.int32())
    found = pa.array(n_words, pa.int64()), *(pa.array([[x[i] for x in s] for s in spans], ints) for i in (0, 1)), pa.array([sorted(x for x in i if x is not None) for i in items], pa.list_(pa.string()))
    return pa.RecordBatch.from_arrays([*(batch.column(c) for c in names[:-4]), *found], names=names)


def runs(rows, columns: dict[str, pa.DataType]):
    """Batches of at most ROWS of the tuples."""
    schema, held = pa.schema(list(columns.items())), []
    for row in rows:
        held.append(row)
        if len(held) == ROWS:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), columns.values())], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), columns.values())], schema=schema)


def prefix_places(windows: DataFrame) -> DataFrame:
    """w, places: each word that is the rarest of a window (words), and the places (at, length) where it is that."""
    each = windows.select("words", F.posexplode("words").alias("at", "w"))
    seen = each.select("words", "w").distinct().groupBy("w").agg(F.count("*").alias("n"))
    rarest = each.join(seen, "w").groupBy("words").agg(F.min(F.struct("n", (-F.octet_length("w")).alias("short"), "w", "at")).alias("x"))
    return rarest.groupBy("x.w").agg(F.collect_set(F.struct("x.at", F.size("words").alias("length"))).alias("places"))


def prefix_bits(places: DataFrame) -> np.ndarray:
    """A bitmap over hashes of the prefix words: SLOTS bits, whatever their number."""
    slot = (F.pmod(F.xxhash64("w"), F.lit(SLOTS)) + 1).alias("slot")  # Spark's bitmaps begin at 1
    bits = np.zeros(SLOTS // 8, np.uint8)
    marks = places.select(slot).groupBy(F.bitmap_bucket_number("slot").alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("slot")).alias("m"))
    for r in marks.collect():
        bits[(r["k"] - 1) * 4096 : r["k"] * 4096] = np.frombuffer(bytes(r["m"]), np.uint8)
    return bits


def from_tables(src: DataFrame, items: DataFrame, size: int, schema: StructType) -> DataFrame:
    """The same by shuffled joins, for a benchmark of any size."""
    binary, several = pa.binary(), pa.list_(pa.binary())

    def cut(batches):
        for batch in batches:
            for item, text in zip(batch.column("item").to_pylist(), batch.column("text").to_pylist()):
                found = words(text)
                for i in range(max(1, len(found) - size + 1) if found else 0):
                    yield item, found[i : i + size]

    held = saved(items.mapInArrow(lambda b: runs(cut(b), {"item": pa.string(), "words": several}), "item string, words array<binary>").distinct(), "benchmark-windows")
    windows = saved(held.select("words").distinct(), "windows")
    places = saved(prefix_places(windows), "window-places")
    sent = src.sparkSession.sparkContext.broadcast(prefix_bits(places))

    def numbered(batches):
        for whole in batches:
            for batch in slices(whole, "__text__"):
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([len(words(t)) for t in batch.column("__text__").to_pylist()], pa.int64())], names=[*batch.schema.names, "__n__"])

    # written once, so that a row keeps its number
    rows = saved(src.mapInArrow(numbered, StructType([*src.schema, StructField("__n__", LongType())])).withColumn("__row__", F.monotonically_increasing_id()), "numbered")

    def candidates(batches):
        bits = sent.value
        for batch in batches:
            for row, text in zip(batch.column("__row__").to_pylist(), batch.column("__text__").to_pylist()):
                found = words(text)
                for i, w in enumerate(found):
                    slot = xxhash.xxh64_intdigest(w, 42) % SLOTS
                    if bits[slot >> 3] >> (slot & 7) & 1:
                        lo = max(0, i - size + 1)
                        yield row, i, i - lo, len(found), w, found[lo : i + size]

    kinds = {"row": pa.int64(), "i": pa.int32(), "left": pa.int32(), "n": pa.int32(), "w": binary, "near": several}
    met = rows.select("__row__", "__text__").mapInArrow(lambda b: runs(candidates(b), kinds), "row long, i int, left int, n int, w binary, near array<binary>")
    met = met.join(places, "w").select("row", "i", "left", "n", "near", F.inline("places"))
    met = met.where("i >= at AND i - at + length <= n").select("row", (F.col("i") - F.col("at")).alias("from"), "length", F.expr("slice(near, left - at + 1, length)").alias("words"))
    hits = saved(met.join(windows, "words"), "hits")
    spans = hits.groupBy("row").agg(F.collect_set(F.struct("from", (F.col("from") + F.col("length")).alias("to"))).alias("__spans__"))
    names = hits.select("row", "words").distinct().join(held, "words").groupBy("row").agg(F.collect_set("item").alias("__items__"))
    found = rows.drop("__text__").join(spans.withColumnRenamed("row", "__row__"), "__row__", "left").join(names.withColumnRenamed("row", "__row__"), "__row__", "left")

    def body(batches):
        for batch in batches:
            spans = [[(s["from"], s["to"]) for s in r or []] for r in batch.column("__spans__").to_pylist()]
            yield with_hits(batch, schema.names, batch.column("__n__"), spans, [r or [] for r in batch.column("__items__").to_pylist()])

    return found.mapInArrow(body, schema)
