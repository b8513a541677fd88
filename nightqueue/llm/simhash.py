"""SimHash near-duplicates: fingerprints, bit-sliced comparison inside buckets, and groups.

A fingerprint bit is 1 if it is set in over half of the XXH64 values (seed 42) of a text's word
shingles. Two fingerprints link if at most `radius` of 64 bits differ. Equal fingerprints fall
together before anything is compared. `radius` + 2 blocks of bits have at least two blocks in which
linked fingerprints agree, so each fingerprint goes to one bucket for every two blocks. Buckets above
`bucket_rows` are cut into chunks by a hash, and every two chunks meet in a group of their own: no
group grows with the data and no pair is left out.

A task compares its buckets bit-sliced: the fingerprints of all of them lie one after another, bit
planes stand vertically, 64 fingerprints to a word. Each fingerprint meets the words that its bucket
reaches into; distances to all lanes of a word are counted at once by carry-save adders that overflow
above the radius, and words whose lanes have all overflowed are given up. Of the links in a bucket only
a spanning star per class leaves the task; none between classes is lost.

`near_texts` groups texts by the similarity of their distinct word shingles instead, exactly: 0.8 of
five words if not said otherwise. In any order of all shingles, two texts that share that much share
one of the first n - ceil(0.8 n) + 1 of their n shingles; the order is by hash, with the shingles that
many texts begin with moved to the end, and texts that share one of these first shingles meet. First,
in a few rounds, each text is checked against two texts that lead its meetings; then all that meet and aren't
in one group yet are compared bit-sliced by parity fingerprints, whose distance is a lower bound of how
many shingles differ. Every pair is checked by its whole shingle sets (48 bits of each hash) before it links.

Texts without words have the fingerprint zero and link like others (in `near_texts` they are copies of
each other). Rows without an id get a fingerprint, no component and take no part in links. Repeated rows
share a component, and so do, in `near_duplicates`, rows with equal ids; `near_texts` groups rows by
their texts, so that two texts under one id can fall apart. Empty tables give no rows. Extra columns,
whatever their names, don't matter.
"""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, LongType, StructField, StructType

from .arrow_rows import slices
from .components import classes, components
from .memos import give_back, take
from .packed import pack, unpack
from .store import rows_a_batch, saved

SEED = 42
BITS = 64
#: Hashes of a text that are counted at a time.
HASHES = 65_536
#: Bytes of text whose shingle sets a task holds at a time, about.
SET_BYTES = 2_000_000
#: Rows with texts or shingle sets that are in a batch on its way to Python, at most.
WIDE_ROWS = 500
#: A shingle set is kept by the low 48 bits of its hashes: two sets of 10,000 shingles share one by chance once in 3 million pairs.
HASH48 = np.int64((1 << 48) - 1)
#: Slots of the bitmap that tells tasks which texts to make whole shingle sets of: 2 MB in memory, at any size of the table.
SLOTS = 1 << 24
#: Tasks that end its making: it has 512 pieces of 4 kB.
MARK_TASKS = 16
#: Pairs that are sent to the rows of their ends, at most: some 5 MB. More are joined with them.
FEW_PAIRS = 100_000
#: Pairs with the sets of both, and rows of signs that meet, that a task gets where there are few in all: it needn't have more tasks.
PAIRS_A_TASK = 500
ROWS_A_TASK = 5_000


def split(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def shingle_hashes(w: list[bytes], words: int) -> np.ndarray:
    """XXH64 of the shingles, repeats included; fewer words than that make one shingle."""
    if not w:
        return np.zeros(0, np.uint64)
    if len(w) < words:
        shingles = iter([b" ".join(w)])
    else:
        shingles = map(b" ".join, zip(*(w[i:] for i in range(words))))
    digest = xxhash.xxh64_intdigest
    return np.array([digest(s, SEED) for s in shingles], np.uint64)


def majority(values: np.ndarray) -> int:
    """The bits set in over half of the hashes, as a signed 64-bit integer."""
    ones = np.zeros(BITS, np.int64)
    for i in range(0, len(values), HASHES):
        ones += np.unpackbits(values[i : i + HASHES].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(values), bitorder="little").view(np.int64)[0])


def fingerprint(text: str | None, words: int = 3) -> int:
    """The fingerprint of a whole text as a signed 64-bit integer."""
    return majority(shingle_hashes(split(text), words))


def shingle_set(w: list[bytes], words: int) -> np.ndarray:
    """The distinct shingles' hashes as signed integers, ascending."""
    return np.unique(shingle_hashes(w, words).view(np.int64))


def set_key(values: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(values.tobytes(), SEED) - (1 << 63)


def first_shingles(values: np.ndarray, similarity: float, hot: np.ndarray) -> np.ndarray:
    """The shingles of which a text of this similarity must share one: by hash, those in `hot` (ascending) last."""
    n = len(values)
    if n and len(hot):
        late = hot[np.minimum(np.searchsorted(hot, values), len(hot) - 1)] == values
        values = np.r_[values[~late], values[late]]
    return values[: n - math.ceil(similarity * n - 1e-9) + 1]


def parity(values: np.ndarray, width: int | None = None) -> bytes:
    """Bit i tells whether the hashes that fall to it are odd in number: sets differ in at least as many hashes as bits.

    `width` words; if not given, a power of two that grows with the set, so that it separates sets of any size."""
    width = width or 8 << max(0, (len(values) - 1) // 128).bit_length()
    ones = np.bincount((values.view(np.uint64) % np.uint64(BITS * width)).astype(np.int64), minlength=BITS * width)
    return np.packbits(ones & 1, bitorder="little").tobytes()


def parity_distance(x: bytes, y: bytes) -> int:
    """Bits in which two parity fingerprints differ; the longer is folded to the length of the shorter."""
    a, b = sorted((np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8")), key=len)
    return int(np.bitwise_count(a ^ np.bitwise_xor.reduce(b.reshape(-1, len(a)), axis=0)).sum())


def sorted_set(values: np.ndarray) -> bytes:
    """A shingle set by the low 48 bits of its hashes, packed as sorted differences."""
    return pack(np.diff(np.sort(values & HASH48), prepend=0)) if len(values) else b""


def common(x: bytes, y: bytes) -> int:
    """How many hashes two packed sets share."""
    if not x or not y:
        return 0
    return len(np.intersect1d(np.cumsum(unpack(x, "<i8")), np.cumsum(unpack(y, "<i8")), assume_unique=True))


def fingerprints(df: DataFrame, words: int = 3, text_col: str = "text", out_col: str = "fp") -> DataFrame:
    """Replaces the text by its fingerprint (a long); other columns stay."""
    kept = [c for c in df.columns if c not in (text_col, out_col)]

    def body(batches):
        for whole in batches:
            for batch in slices(whole, "__text__"):
                made = pa.array([fingerprint(t, words) for t in batch.column("__text__").to_pylist()], pa.int64())
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), made], names=[*kept, out_col])

    src = df.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{text_col}`").alias("__text__"))
    return src.mapInArrow(body, StructType([*(df.schema[c] for c in kept), StructField(out_col, LongType())]))


def table_of(values: np.ndarray) -> np.ndarray:
    """A row of words for each fingerprint; single words are rows of one."""
    return (values[:, None] if values.ndim == 1 else values).astype("<u8")


def planes(values: np.ndarray) -> np.ndarray:
    """A row of words for each bit: bit j of row b is bit b of fingerprint j (a row of 64-bit words)."""
    lanes, size = -(-len(values) // 64) * 64, values.shape[1]
    bits = np.zeros((lanes, BITS * size), np.uint8)
    bits[: len(values)] = np.unpackbits(values.view(np.uint8).reshape(-1, 8 * size), axis=1, bitorder="little")
    return np.ascontiguousarray(np.packbits(bits.T, axis=1, bitorder="little")).view("<u8")


ALL = ~np.uint64(0)


def low_bits(n: np.ndarray) -> np.ndarray:
    """Words with their n lowest bits set, 0 <= n <= 64."""
    return np.where(n >= 64, ALL, (np.uint64(1) << np.minimum(n, 63).astype(np.uint64)) - np.uint64(1))


def near_pairs(values: np.ndarray, ends: np.ndarray, radius, block: int = 1 << 16):
    """i, j (i < j) of all values in one group that differ in at most `radius` bits, in runs of pairs.

    Groups are runs of rows; ends[i] is the end of row i's group. `radius` is one number, or one per row i."""
    values = table_of(values)
    n, plane = len(values), planes(values)
    rows = np.arange(n)
    first, radius = (rows + 1) // 64, np.broadcast_to(np.asarray(radius, np.int64), n)
    reach = np.maximum((ends + 63) // 64 - first, 0)
    offset = np.cumsum(reach) - reach
    adders = max(1, int(radius.max(initial=0)).bit_length())
    start = (1 << adders) - 1 - radius
    for lo in range(0, int(reach.sum()), block):
        # entry e: row i against the 64 lanes of one word
        e = np.arange(lo, min(lo + block, int(reach.sum())))
        i = np.searchsorted(offset + reach, e, side="right")
        word = first[i] + e - offset[i]
        valid = low_bits(np.clip(ends[i] - 64 * word, 0, 64)) & ~low_bits(np.clip(i + 1 - 64 * word, 0, 64))
        over, count = ~valid, [np.where(start[i] >> k & 1, ALL, np.uint64(0)) for k in range(adders)]
        own = values[i]
        for b in range(len(plane)):
            mask = np.uint64(0) - (own[:, b // BITS] >> np.uint64(b % BITS) & np.uint64(1))
            carry = plane[b][word] ^ mask
            for k in range(adders):
                count[k], carry = count[k] ^ carry, count[k] & carry
            over |= carry
            if b % 8 == 7:
                live = over != ALL
                if not live.all():
                    i, word, over, own, count = i[live], word[live], over[live], own[live], [c[live] for c in count]
                    if not len(i):
                        break
        if len(i):
            entry, lane = np.nonzero(np.unpackbits((~over)[:, None].view(np.uint8), axis=1, bitorder="little"))
            yield i[entry], 64 * word[entry] + lane


def group_ends(group: np.ndarray) -> np.ndarray:
    """The end of each row's run of equal values."""
    heads = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    sizes = np.diff(np.r_[heads, len(group)])
    return np.repeat(heads + sizes, sizes)


def star(values: np.ndarray, nodes: np.ndarray, ends: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links (node, the first node of its class) among fingerprints of a group within the radius."""
    label = classes(len(values), near_pairs(values, ends, radius))
    linked = label != np.arange(len(values))
    return nodes[linked], nodes[label[linked]]


def whole_groups(batches):
    """Batches that are sorted by g, cut so that no group is in two of them."""
    held = None
    for batch in batches:
        if held is not None:
            batch = pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
        if not batch.num_rows:
            continue
        group = batch.column("g").to_numpy()
        last = int(np.searchsorted(group, group[-1]))
        if last:
            yield batch.slice(0, last)
        held = batch.slice(last)
    if held is not None:
        yield held


def links(nodes: DataFrame, radius: int = 3, bucket_rows: int = 1024) -> DataFrame:
    """a, b: links that connect all fingerprints (fp, node: distinct longs) within `radius`, a spanning set."""
    n = radius + 2
    edges = [round(i * BITS / n) for i in range(n + 1)]
    masks = [((1 << edges[i + 1]) - 1) ^ ((1 << edges[i]) - 1) for i in range(n)]
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    pick = [F.col("fp").bitwiseAND(F.lit(signed(masks[i] | masks[j]))) for i, j in combinations(range(n), 2)]
    rows = saved(nodes.select(F.col("fp").alias("bits"), "node", F.posexplode(F.array(*pick)).alias("band", "key")), "bands")
    size = saved(rows.groupBy("band", "key").agg(F.count("*").alias("n")).where("n > 1").select("band", "key", F.ceil(F.col("n") / bucket_rows).cast("int").alias("k")), "buckets")
    met = rows.join(size, ["band", "key"]).withColumn("c", F.pmod(F.xxhash64("node"), F.col("k")).cast("int"))
    others = F.when(F.col("k") == 1, F.array(F.lit(0))).otherwise(F.filter(F.sequence(F.lit(0), F.col("k") - 1), lambda o: o != F.col("c")))
    met = met.withColumn("o", F.explode(others)).select("bits", "node", F.xxhash64("band", "key", F.least("c", "o"), F.greatest("c", "o")).alias("g"))

    def found(rows):
        group, own, values = rows.column("g").to_numpy(), rows.column("node").to_numpy(), rows.column("bits").to_numpy()
        a, b = star(values, own, group_ends(group), radius)
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return met.repartition("g").sortWithinPartitions("g").mapInArrow(lambda batches: map(found, whole_groups(batches)), "a long, b long")


def near_duplicates(df: DataFrame, words: int = 3, radius: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, fp, component (smallest id that is reachable by links): one row per row of df."""
    each = saved(fingerprints(df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), words), "fingerprints")
    nodes = saved(each.where("id IS NOT NULL").groupBy("fp").agg(F.min("id").alias("node")), "nodes")
    roots = saved(components(links(nodes, radius)), "roots")
    groups = saved(nodes.join(roots, "node", "left").select("fp", F.coalesce("root", "node").alias("component")), "groups")
    met = each.join(groups, "fp", "left")
    return met.select("id", "fp", F.when(F.col("id").isNotNull(), F.col("component")).alias("component"))


def identity(text_col: str = "text") -> list:
    """Two hashes, 96 bits, that tell texts apart; null is its own text."""
    text = F.col(f"`{text_col}`")
    return [F.xxhash64(text).alias("t1"), F.coalesce(F.crc32(text.cast("binary")), F.lit(-1)).alias("t2")]


def mark_bits(slots: DataFrame) -> np.ndarray:
    """A bitmap of SLOTS bits with those of a frame (slot: from 0 on) set; it is made on the executors, in pieces of one size."""
    marks = np.zeros(SLOTS // 8, np.uint8)
    slots = slots.select((F.col("slot") + 1).alias("slot"))  # Spark's bitmaps begin at 1
    for r in slots.groupBy(F.bitmap_bucket_number("slot").alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("slot")).alias("m")).coalesce(MARK_TASKS).collect():
        marks[(r["k"] - 1) * 4096 : r["k"] * 4096] = np.frombuffer(bytes(r["m"]), np.uint8)
    return marks


def marked(marks: np.ndarray, slots: np.ndarray) -> np.ndarray:
    return (marks[slots >> 3] >> (slots & 7).astype(np.uint8) & 1).astype(bool)


def saved_wide(df: DataFrame, name: str) -> DataFrame:
    """`saved` for rows that hold texts or whole sets: few of them go to Python at a time."""
    with rows_a_batch(df.sparkSession, WIDE_ROWS):
        return saved(df, name)


def set_columns(docs: DataFrame, words: int, columns, types: dict, wanted=lambda batch: batch) -> DataFrame:
    """id, t1, t2 of docs, key and n (of the shingle set), and more columns made from the sets of wanted rows."""
    keep = [docs.schema[c] for c in ("id", "t1", "t2")]

    def body(batches):
        take("simhash", lambda: None)  # it remembers nothing itself
        for whole in batches:
            for batch in slices(wanted(whole), "__text__", SET_BYTES):
                sets = [shingle_set(split(t), words) for t in batch.column("__text__").to_pylist()]
                keys = pa.array([set_key(v) for v in sets], pa.int64())
                yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in keep), keys, pa.array([len(v) for v in sets], pa.int32()), *columns(sets)], names=[*(f.name for f in keep), "key", "n", *types])
        give_back()

    return docs.mapInArrow(body, StructType([*keep, StructField("key", LongType()), StructField("n", IntegerType()), *(StructField(k, t) for k, t in types.items())]))


def identified(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("__text__"), *identity(text_col))


LONGS = pa.list_(pa.int64())


def near_texts(df: DataFrame, words: int = 5, similarity: float = 0.8, width: int = 8, bucket_rows: int = 1024, id_col: str = "doc_id", text_col: str = "text", hot_texts: int = 32, most_hot: int = 250_000, rounds: int = 4) -> DataFrame:
    """id, t1, t2 (`identity` of the text), cluster (a number of the group of texts that are linked by sharing
    `similarity` of their distinct `words`-word shingles), component (its smallest id): one row per row of df.

    Shingles that over `hot_texts` texts begin with go last, at most `most_hot` of them; `width` words make
    the parity fingerprint of the bit-sliced comparison; in up to `rounds` rounds each text is checked against
    two of those it meets before all pairs are compared. None of these four changes the result."""
    src = identified(df, id_col, text_col)
    none = np.zeros(0, np.int64)
    # a quarter of the texts tells which shingles are hot; any choice gives an order that holds for all texts
    quarter = set_columns(src.where(F.col("id").isNotNull() & (F.pmod("t1", F.lit(4)) == 0)), words, lambda sets: [pa.array([first_shingles(v, similarity, none) for v in sets], LONGS)], {"first": ArrayType(LongType())})
    often = saved_wide(quarter.dropDuplicates(["key"]).select(F.explode("first").alias("h")).groupBy("h").agg(F.count("*").alias("c")).where(F.col("c") > hot_texts // 4), "hot-shingles")
    hot = np.sort(np.array([r["h"] for r in often.orderBy(F.desc("c"), "h").limit(most_hot).collect()], np.int64))
    sent = df.sparkSession.sparkContext.broadcast(hot)
    return linked_texts(src, lambda v: first_shingles(v, similarity, sent.value), words, similarity, width, bucket_rows, rounds).select("id", "t1", "t2", "cluster", "component")


def linked_texts(src: DataFrame, signs, words: int, similarity: float, width: int = 8, bucket_rows: int = 1024, rounds: int = 4) -> DataFrame:
    """id, t1, t2, n (distinct shingles), cluster and component as in `near_texts`: one row per row of src
    (`identified`). Texts meet where `signs`, numbers made from their shingle sets, are equal."""
    spark = src.sparkSession
    types = {"first": ArrayType(LongType()), "bits": BinaryType(), "wide": BinaryType()}
    each = saved_wide(set_columns(src, words, lambda sets: [pa.array([signs(v) for v in sets], LONGS), pa.array([parity(v, width) for v in sets], pa.binary()), pa.array([parity(v) for v in sets], pa.binary())], types), "signs")
    known = each.where("id IS NOT NULL")
    # one row of df for each key, whose text gives the shingle set again, and the key's fingerprints
    nodes = saved(known.groupBy("key").agg(F.min(F.struct("id", "t1", "t2", "n", "bits", "wide", "first")).alias("x")).select("key", "x.*"), "nodes")
    rows = meetings(nodes.select("key", "first"))
    n_rows = rows.count()

    def ends_of(pairs):
        """a, b, key: both ends of each pair; of few pairs they are sent to what they meet. And the number of pairs."""
        ends, n = pairs.select("a", "b", F.explode(F.array("a", "b")).alias("key")), pairs.count()
        return F.broadcast(ends) if n <= FEW_PAIRS else ends, n

    def both(ends, n, sides):
        """The pairs (a, b) with n and x of both their keys, from sides (key, n, x)."""
        own = lambda c: F.max(F.when(F.col("key") == F.col(c), F.struct("n", "x"))).alias(f"__{c}")
        met = ends.join(sides, "key").groupBy("a", "b").agg(own("a"), own("b")).where("__a IS NOT NULL AND __b IS NOT NULL")
        met = met.select("a", "b", F.col("__a.n").alias("na"), F.col("__a.x").alias("xa"), F.col("__b.n").alias("nb"), F.col("__b.x").alias("xb"))
        return in_tasks(met, n, PAIRS_A_TASK)

    def checked(pairs):
        """The pairs (a, b) of texts that share `similarity`: first by fingerprints as long as the sets, then by the sets."""
        ends, n = ends_of(saved_wide(pairs, "candidates"))
        wide = nodes.select("key", "n", F.col("wide").alias("x"))
        pairs = saved_wide(both(ends, n, wide).mapInArrow(lambda batches: all_decided(batches, similarity, lambda n, m, x, y: parity_distance(x, y) <= (n + m) * (1 - similarity) / (1 + similarity) + 1e-9), "a long, b long"), "pairs")
        ends, n = ends_of(pairs)
        slot = F.pmod(F.xxhash64("id", "t1", "t2"), F.lit(SLOTS))
        marks = spark.sparkContext.broadcast(mark_bits(ends.join(nodes, "key").select(slot.alias("slot"))))
        wanted = lambda batch: batch.filter(pa.array(marked(marks.value, batch.column("__slot__").to_numpy())))
        known = src.where(F.col("id").isNotNull()).withColumn("__slot__", slot)
        # other texts may share a slot, and rows may be repeated: one row a key
        sets = set_columns(known, words, lambda sets: [pa.array(map(sorted_set, sets), pa.binary())], {"shingles": BinaryType()}, wanted)
        sets = saved_wide(in_tasks(sets.dropDuplicates(["key"]).select("key", "n", F.col("shingles").alias("x")), 2 * n, PAIRS_A_TASK), "shingle-sets")
        return saved_wide(both(ends, n, sets).mapInArrow(lambda batches: all_decided(batches, similarity, lambda n, m, x, y: common(x, y) * (1 + similarity) >= similarity * (n + m) - 1e-9), "a long, b long"), "checked")

    def two_of(met):
        """a, b: each key of met (key, centre) with the two centres that it meets most."""
        led = met.repartition("key").groupBy("key", "centre").agg(F.count("*").alias("c"))
        led = led.groupBy("key").agg(F.slice(F.sort_array(F.collect_list(F.struct((-F.col("c")).alias("c"), "centre"))), 1, 2).alias("x"))
        return in_tasks(led.select(F.col("key").alias("a"), F.explode("x.centre").alias("b")), n_rows, ROWS_A_TASK)

    def still_apart(rows, roots):
        """Of the rows (key, h) those of signs where texts of several groups meet, with their roots."""
        apart = rows.select("key", "h").join(roots, "key", "left").withColumn("root", F.coalesce("root", "key"))
        lively = apart.groupBy("h").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count("*").alias("c")).where("lo <> hi")
        met = apart.join(lively.select("h", F.ceil(F.col("c") / bucket_rows).cast("int").alias("k")), "h")
        return saved(in_tasks(met, n_rows, ROWS_A_TASK), "apart")

    def grouped(linked):
        return saved(components(linked), "roots").toDF("key", "root")

    more = checked(two_of(rows.where("key <> centre").select("key", "centre")))
    roots = grouped(more)
    apart = still_apart(rows, roots)
    for turn in range(1, rounds):
        # a large group may have missed its first centres: now its texts try one of the largest group that they meet
        if more.isEmpty() or apart.isEmpty():
            break
        each_root = apart.groupBy("h", "root").agg(F.count("*").alias("c"), F.min(F.struct(F.xxhash64("key", F.lit(turn)).alias("x"), "key"))["key"].alias("centre"))
        largest = each_root.groupBy("h").agg(F.max(F.struct("c", "root", "centre")).alias("x")).where("x.c > 1").select("h", F.col("x.root").alias("other"), F.col("x.centre").alias("centre"))
        more = checked(two_of(apart.join(largest, "h").where("root <> other").select("key", "centre")))
        # what was linked before is known by its roots
        roots = grouped(more.union(roots))
        apart = still_apart(apart, roots)
    if not apart.isEmpty():
        met = apart.join(nodes.select("key", "n", "bits"), "key")
        roots = grouped(checked(met_pairs(met, similarity).distinct()).union(roots))
    groups = nodes.select("key", "id").join(roots, "key", "left").withColumn("root", F.coalesce("root", "key"))
    names = groups.groupBy("root").agg(F.min("id").alias("component"))
    groups = saved(groups.join(names, "root").select("key", F.col("root").alias("cluster"), "component"), "groups")
    own = lambda c: F.when(F.col("id").isNotNull(), F.col(c)).alias(c)
    return each.select("id", "t1", "t2", "key", "n").join(groups, "key", "left").select("id", "t1", "t2", "n", own("cluster"), own("component"))


def in_tasks(df: DataFrame, rows: int, most: int) -> DataFrame:
    """df of at most so many rows, in no more tasks than `most` rows for each ask for: near-empty ones cost a job its time."""
    return df.coalesce(max(1, -(-rows // most)))


def meetings(nodes: DataFrame) -> DataFrame:
    """key, h, centre: the signs h (of `first`) that several keys have, and the smallest of these keys.

    Smallest and largest keys are gathered before anything moves; of the signs only those go on whose bit
    is set among the ones that meet. A hot sign is met in a join, which Spark can split."""
    each = nodes.select("key", F.explode("first").alias("h"))
    heads = saved(each.groupBy("h").agg(F.min("key").alias("centre"), F.max("key").alias("other")).where("centre <> other").select("h", "centre"), "heads")
    marks = nodes.sparkSession.sparkContext.broadcast(mark_bits(heads.select(F.pmod("h", F.lit(SLOTS)).alias("slot"))))

    def body(batches):
        for batch in batches:
            lists = batch.column("first")
            signs, ends = lists.flatten().to_numpy(), np.diff(lists.offsets.to_numpy())
            keep = marked(marks.value, signs & np.int64(SLOTS - 1))
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(batch.column("key").to_numpy(), ends)[keep]), pa.array(signs[keep])], names=["key", "h"])

    return saved(nodes.mapInArrow(body, "key long, h long").join(heads, "h").select("key", "h", "centre"), "meetings")


def decided(t: pa.RecordBatch, similarity: float, fits) -> pa.RecordBatch:
    """The rows a, b of a batch (a, b, na, xa, nb, xb) whose lengths and what `fits` says of (na, nb, xa, xb) allow them."""
    n, m = (t.column(c).to_numpy().astype(np.int64) for c in ("na", "nb"))
    fair = np.minimum(n, m) >= similarity * np.maximum(n, m) - 1e-9
    x, y = t.column("xa"), t.column("xb")
    keep = [bool(ok) and fits(int(n[i]), int(m[i]), x[i].as_py(), y[i].as_py()) for i, ok in enumerate(fair)]
    return t.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


def all_decided(batches, similarity: float, fits):
    rows = 0
    for t in batches:
        rows += t.num_rows
        yield decided(t, similarity, fits)
    if rows > WIDE_ROWS:  # few rows leave little behind
        give_back()


def may_share(n, m, x, y, similarity: float) -> np.ndarray:
    """False where sets of n and m shingles, by their lengths and parity fingerprints, can't share `similarity`."""
    differ = np.bitwise_count(x ^ y).sum(-1, dtype=np.int64)
    return (np.minimum(n, m) >= similarity * np.maximum(n, m) - 1e-9) & (differ <= (n + m) * (1 - similarity) / (1 + similarity) + 1e-9)


def met_pairs(met: DataFrame, similarity: float) -> DataFrame:
    """a, b (keys, a < b) of the rows (key, n, h, k, root, bits) that meet in h, have different roots, and
    may share `similarity`. The rows of h are cut into k chunks, and every two chunks meet in a task.

    In a group rows stand by n. Of a longer text at most n / similarity shingles can be met, which bounds
    the distance from a row to all that follow it: this is the radius of the bit-sliced comparison."""
    met = met.withColumn("c", F.pmod(F.xxhash64("key"), F.col("k")).cast("int"))
    others = F.when(F.col("k") == 1, F.array(F.lit(0))).otherwise(F.filter(F.sequence(F.lit(0), F.col("k") - 1), lambda o: o != F.col("c")))
    met = met.withColumn("o", F.explode(others)).select("key", "n", "root", "bits", F.xxhash64("h", F.least("c", "o"), F.greatest("c", "o")).alias("g"))

    def found(rows):
        group, key, n, root = (rows.column(c).to_numpy() for c in ("g", "key", "n", "root"))
        bits = np.frombuffer(b"".join(rows.column("bits").to_pylist()), "<u8").reshape(len(key), -1)
        n = n.astype(np.int64)
        # rows end where lengths grow too far apart: what follows can't share enough
        far = np.minimum(group_ends(group), end_of_lengths(group, n, similarity))
        radius = np.minimum(np.floor(n * (1 - similarity) / similarity + 1e-9).astype(np.int64), BITS * bits.shape[1])
        out = [np.zeros((0, 2), np.int64)]
        for i, j in near_pairs(bits, far, radius):
            at = (root[i] != root[j]) & may_share(n[i], n[j], bits[i], bits[j], similarity)
            i, j = key[i[at]], key[j[at]]
            out.append(np.unique(np.stack([np.minimum(i, j), np.maximum(i, j)], 1), axis=0))
        pairs = np.unique(np.concatenate(out), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

    def body(batches):
        yield from map(found, whole_groups(batches))
        give_back()

    return met.repartition("g").sortWithinPartitions("g", "n").mapInArrow(body, "a long, b long")


def end_of_lengths(group: np.ndarray, n: np.ndarray, similarity: float) -> np.ndarray:
    """Per row the first row after which lengths of its group exceed n / similarity; rows stand by group, then n."""
    step = int(n.max(initial=0) / similarity) + 2
    place = np.cumsum(np.r_[0, group[1:] != group[:-1]]) * step
    return np.searchsorted(place + n, place + np.floor(n / similarity + 1e-9).astype(np.int64), side="right")


def hex_digits(fp: str = "fp"):
    """The fingerprint as 16 lowercase hexadecimal digits."""
    return F.lower(F.lpad(F.hex(F.col(fp)), 16, "0"))
