"""Language-model scores of a hierarchical Pitman-Yor model, fitted by Gibbs sampling on Spark.

Restaurants stand in a tree: one for each class of the previous word, all sharing the root of all words as
parent, and a uniform base over the V known words and one unknown. The number of classes grows with the
training text (`n_classes`). A customer of a restaurant is a token (or, in the root, a table of a child); `t`
tables serve its dish. A Gibbs sweep draws the tables of every dish in every restaurant, bottom up, from
their distribution given its customers and all other tables (`seat`): the law that removing and reseating
its customers one by one would reach. Dishes of one sweep are drawn at the same time, given the others' tables
of the sweep before. Probabilities are averaged over the last `keep` sweeps.

How it runs: tasks turn runs of documents into blocks: a type number for each token, where a type is a
context class and a word; plus, for each bucket of words, the block's words, types and training counts.
Buckets, whose number follows the bytes of text, merge these; a word lies whole in one bucket. Where very
frequent words make the blocks' requests to a bucket larger than `PART_BYTES`, the blocks are dealt to parts
of the bucket: parts are merged in rounds to the bucket's model, and each answers its blocks with a copy of
it. So no row grows with the number of blocks. Only the tables' totals per restaurant join the buckets between sweeps; random
numbers are hashes of word, class and sweep, so that nothing depends on how rows are dealt, no state
is kept, and a lost task repeats exactly. At last each bucket answers each block with the probability of
its types and the count of its words, and blocks add up their documents.

Words are lower-cased runs without white space, known by a 64-bit hash; each text ends with one end
token, which is also the context of its first word. Null texts count as empty (the end token alone).
Rows without an id take part in training. Repeated rows count as often as they stand. An empty table
gives no rows; without training tokens every word is unknown.
"""

from __future__ import annotations

from collections import defaultdict
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .packed import pack, pack_sorted, unpack, unpack_sorted
from .store import saved

#: Discount and strength of context and root restaurants.
DISCOUNT = (0.8, 0.5)
STRENGTH = (1.0, 10.0)
#: Bytes of text for each bucket of words, and the least number of buckets.
BUCKET_BYTES, LEAST_BUCKETS = 16 << 20, 8
#: Packed requests to a bucket that one task takes, about.
PART_BYTES = 64 << 20
BLOCK_TOKENS = 1_000_000
#: Customers of a dish up to which tables are weighed by a table of Stirling numbers; cells of a matrix of weights;
#: points of a grid of tables above.
EXACT, CELLS, GRID = 1024, 1 << 20, 256
END = xxhash.xxh64_intdigest(b" ") & (1 << 63) - 1

REQUESTS = "array<struct<bucket:int,words:binary,sizes:binary,classes:binary,train:binary>>"
BLOCKS = f"block long, ids array<long>, held array<boolean>, n_tokens array<int>, types binary, word_types binary, requests {REQUESTS}"
MODEL = "bucket int, part int, n_train long, n_words long, words binary, counts binary, keys binary, train binary"
BUCKETS = MODEL + ", requests array<struct<block:long,words:binary,sizes:binary,classes:binary>>"
SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"


def n_classes(n_bytes: int) -> int:
    """Classes of previous words: a power of two near 16 * n_bytes ** 0.4, so 8 thousand at 10 MB, 8 million at 100 TB."""
    return 1 << max(8, round(np.log2(16 * max(n_bytes, 1) ** 0.4)))


def word_hash(word: bytes) -> int:
    return xxhash.xxh64_intdigest(word) & (1 << 63) - 1


def make_block(docs: list, number: int, local: dict, buckets: int, classes: int) -> dict:
    """docs: (id, held, numbers of the words and END) of each document; local: word to number."""
    hashes = np.array([END if w is None else word_hash(w) for w in local], np.int64)
    bucket = (hashes >> 20) % buckets
    order = np.lexsort((hashes, bucket))
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    sizes = np.array([len(d[2]) for d in docs])
    words = np.concatenate([d[2] for d in docs])
    before = np.r_[0, words[:-1]]
    before[np.cumsum(sizes) - sizes] = 0  # local number 0 is END
    key = rank[words] * classes + (hashes[before] >> 8) % classes
    types, of_token = np.unique(key, return_inverse=True)
    train = np.bincount(of_token, np.repeat([not d[1] for d in docs], sizes), len(types)).astype(np.int32)
    type_word = (types // classes).astype(np.int32)
    of_type = (types % classes).astype(np.uint32)
    per_word = np.bincount(type_word, minlength=len(order)).astype(np.int32)
    hashes, bucket = hashes[order], bucket[order]
    requests = []
    for b in np.unique(bucket).tolist():
        lo, hi = np.searchsorted(bucket, [b, b + 1])
        t0, t1 = np.searchsorted(type_word, [lo, hi])
        requests.append({"bucket": b, "words": pack_sorted(hashes[lo:hi]), "sizes": pack(per_word[lo:hi]), "classes": pack(of_type[t0:t1]), "train": pack(train[t0:t1])})
    return {"block": number, "ids": [d[0] for d in docs], "held": [d[1] for d in docs], "n_tokens": sizes.tolist(), "types": pack(of_token.astype(np.int32)), "word_types": pack(per_word), "requests": requests}


def blocks(docs: DataFrame, buckets: int, classes: int) -> DataFrame:
    """docs: id, held, text. One row per run of about BLOCK_TOKENS tokens."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    schema = to_arrow_schema(StructType.fromDDL(BLOCKS))

    def body(batches):
        number = TaskContext.get().partitionId() << 32

        def fresh():
            local = defaultdict()
            local.default_factory = local.__len__
            local[None]  # END comes first
            return local

        local, docs, total = fresh(), [], 0
        for batch in batches:
            for key, held, text in zip(*(batch.column(c).to_pylist() for c in ("id", "held", "text"))):
                words = (text or "").encode("utf-8", "surrogatepass").lower().split()
                docs.append((key, held, np.array([*map(local.__getitem__, words), 0], np.int32)))
                total += len(words) + 1
                if total >= BLOCK_TOKENS:
                    yield pa.RecordBatch.from_pylist([make_block(docs, number, local, buckets, classes)], schema)
                    number, local, docs, total = number + 1, fresh(), [], 0
        if docs:
            yield pa.RecordBatch.from_pylist([make_block(docs, number, local, buckets, classes)], schema)

    return docs.mapInArrow(body, BLOCKS)


def counted(table: pa.Table, own: np.ndarray, key: np.ndarray, train: np.ndarray, classes: int) -> dict:
    """The model of a group of rows of one bucket: its words (own), and the training counts of the types (key)."""
    seen = train > 0
    keys, of = np.unique(key[seen], return_inverse=True)
    total = np.bincount(of, train[seen], len(keys)).astype(np.int64)
    counts = np.bincount(keys // classes, total, len(own)).astype(np.int64)
    part = min(table.column("part").to_pylist())
    return {"bucket": table.column("bucket")[0].as_py(), "part": part, "n_train": int(total.sum()), "n_words": int((counts > 0).sum()), "words": pack_sorted(own), "counts": pack(counts), "keys": pack_sorted(keys), "train": pack(total)}


def one_row(out: dict) -> pa.Table:
    request = pa.struct([("block", pa.int64()), *((k, pa.binary()) for k in ("words", "sizes", "classes"))])
    kinds = {"bucket": pa.int32(), "part": pa.int32(), "n_train": pa.int64(), "n_words": pa.int64(), "requests": pa.list_(request)}
    return pa.table({k: pa.array([v], kinds.get(k, pa.binary())) for k, v in out.items()})


def merge(table: pa.Table, classes: int) -> pa.Table:
    """All requests to a part of a bucket as one row: its words, their training counts, and types with training tokens."""
    rows = table.select(["block", "words", "sizes", "classes", "train"]).to_pylist()
    own, at = np.unique(np.concatenate([unpack_sorted(r["words"]) for r in rows]), return_inverse=True)
    sizes = np.concatenate([unpack(r["sizes"], "<i4") for r in rows])
    key = np.repeat(at, sizes) * classes + np.concatenate([unpack(r["classes"], "<u4") for r in rows])
    train = np.concatenate([unpack(r["train"], "<i4") for r in rows])
    return one_row(counted(table, own, key, train, classes) | {"requests": [{k: r[k] for k in ("block", "words", "sizes", "classes")} for r in rows]})


def merge_models(table: pa.Table, classes: int) -> pa.Table:
    """Models of parts of one bucket as one model."""
    rows = table.select(["words", "keys", "train"]).to_pylist()
    words = [unpack_sorted(r["words"]) for r in rows]
    own, keys = np.unique(np.concatenate(words)), [unpack_sorted(r["keys"]) for r in rows]
    key = np.concatenate([np.searchsorted(own, w)[k // classes] * classes + k % classes for w, k in zip(words, keys)])
    return one_row(counted(table, own, key, np.concatenate([unpack(r["train"], "<i8") for r in rows]), classes))


def in_parts(rows: DataFrame, columns: list[str]) -> DataFrame:
    """bucket, k: in how many parts the packed columns of a bucket's rows fill tasks; only buckets of several rows and parts."""
    size = rows.groupBy("bucket").agg(F.sum(sum(F.octet_length(c) for c in columns)).alias("n"), F.count("*").alias("rows"))
    return size.select("bucket", F.least(F.ceil(F.col("n") / PART_BYTES), F.ceil(F.col("rows") / 2)).cast("int").alias("k"), "rows").where("rows > 1")


def merged_buckets(asked: DataFrame, classes: int) -> tuple[DataFrame, DataFrame]:
    """The model of each bucket, and rows of BUCKETS: the parts with their requests, each with its bucket's whole model."""
    hot = saved(in_parts(asked, ["words", "sizes", "classes", "train"]).where("k > 1").select("bucket", "k"), "lm-hot")
    dealt = asked.join(hot, "bucket", "left").withColumn("part", F.coalesce(F.pmod(F.xxhash64("block"), F.col("k")).cast("int"), F.lit(0)))
    parts = saved(dealt.drop("k").groupBy("bucket", "part").applyInArrow(lambda rows: merge(rows, classes), BUCKETS), "lm-buckets", compression="zstd")
    if hot.isEmpty():
        return parts, parts
    models = parts.join(hot, "bucket", "left_semi").drop("requests")
    while True:
        left = saved(in_parts(models, ["words", "keys", "train"]), "lm-left")
        if left.isEmpty():
            break
        met = models.join(left.select("bucket", "k"), "bucket", "left").withColumn("g", F.pmod(F.xxhash64("part"), F.coalesce("k", F.lit(1)))).drop("k")
        # at most half as many groups as rows: every round leaves fewer rows of a bucket
        models = saved(met.groupBy("bucket", "g").applyInArrow(lambda rows: merge_models(rows.drop_columns(["g"]), classes), MODEL), "lm-models", compression="zstd")
    asks = parts.join(hot, "bucket", "left_semi").select("bucket", F.col("part").alias("p"), "requests")
    cold = parts.join(hot, "bucket", "left_anti")
    return cold.drop("requests").union(models.select(*cold.drop("requests").columns)), cold.union(asks.join(models, "bucket").select(*cold.columns))


def mixed(x: np.ndarray) -> np.ndarray:
    """64-bit hashes of 64-bit numbers (the finalizer of SplitMix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def uniforms(keys: np.ndarray, stream: int, draw: int) -> np.ndarray:
    """A number between 0 and 1, both excluded, for each key: always the same for one (key, stream, draw)."""
    salt = (((stream << 40) + draw) * 0x9E3779B97F4A7C15) & (1 << 64) - 1
    return ((mixed(keys + np.uint64(salt)) >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


def rising(x: np.ndarray, n: np.ndarray) -> np.ndarray:
    """log(Gamma(x + n) / Gamma(x)) for x > 0, without the cancellation of two large logarithms."""
    y = x + 7.0
    tail = lambda v: (1 / 12 - (1 / 360 - 1 / (1260 * v * v)) / (v * v)) / v
    first = 1 + n / x
    for i in range(1, 7):
        first = first * (1 + n / (x + i))
    return (y - 0.5) * np.log1p(n / y) + n * (np.log(y + n) - 1) + tail(y + n) - tail(y) - np.log(first)


@lru_cache(4)
def stirling_table(discount: float) -> np.ndarray:
    """[n, t]: log of the generalized Stirling number, the weight of all seatings of n customers at t tables, up to EXACT."""
    out = np.full((EXACT + 1, EXACT + 1), -np.inf)
    out[1, 1] = 0.0
    t = np.arange(1, EXACT + 1)
    for n in range(1, EXACT):
        stay = np.log(np.maximum(n - discount * t[:n], 0)) + out[n, 1 : n + 1]
        out[n + 1, 1 : n + 2] = np.logaddexp(np.r_[stay, -np.inf], out[n, : n + 1])
    return out


def log_stirling(n: np.ndarray, t: np.ndarray, discount: float) -> np.ndarray:
    """The same for n above EXACT and any t between 1 and n, but for a constant of n.

    n! / (t! discount^t) times a(n, t) = [z^n] (1 - (1 - z)^discount)^t. For a discount of 1/2 the coefficient is a
    ballot number. Otherwise log(a / t), as a function of t / n^discount, hardly changes with n while t is far below
    n, and its slope depends on t / n alone where t is not: both parts are read from the table's last row."""
    known = -rising(np.ones_like(t), t) - t * np.log(discount)
    if discount == 0.5:
        return known + np.log(t / (2 * n - t)) + rising(n - t + 1, n + 0 * t) + t * np.log(2)
    s = np.arange(1, EXACT + 1)
    row = stirling_table(discount)[EXACT, 1:] + s * np.log(discount) + rising(np.ones(EXACT), s) - np.log(s)
    shape = lambda at: np.where(at < 1, row[0] + (at - 1) * (row[1] - row[0]), np.interp(at, s, row))
    edge = 0.4 * EXACT * (n / EXACT) ** discount
    near = shape(np.minimum(t, edge) * (EXACT / n) ** discount)
    far = n / EXACT * (shape(np.maximum(t, edge) * EXACT / n) - shape(edge * EXACT / n))
    return known + np.log(t) + near + far


def drawn(weights: np.ndarray, u: np.ndarray) -> np.ndarray:
    """The place in each row that its number u falls on; weights: logarithms."""
    total = np.cumsum(np.exp(weights - weights.max(1, keepdims=True)), axis=1)
    return (total < (u * total[:, -1])[:, None]).sum(1)


def seat(customers, base, discount: float, own, everyone, step: int, keys: np.ndarray, stream: int) -> np.ndarray:
    """Tables of each dish, drawn from their conditional distribution given all other dishes' tables: a Gibbs step.

    base: strength + discount * tables of other dishes; a table after the first sends its dish to the parent, which
    takes the j-th such one with probability (own + step * j) / (everyone + step * j). t tables have weight
    S(customers, t) times the product over j < t of (base + discount * j) and that probability, where S is the
    generalized Stirling number: from a table up to EXACT customers; above, log_stirling on grids that close in on
    the weight within e^-40 of the largest, so that work doesn't grow with the customers."""
    t = (customers > 0).astype(np.int64)
    u = uniforms(keys, stream, 0)
    order = np.argsort(customers, kind="stable")
    at = customers[order]
    ends = np.flatnonzero(np.r_[at[1:] != at[:-1], True]) + 1 if len(at) else []
    lo = 0
    for hi in ends:
        n = int(at[lo])
        for i in range(lo, hi if 1 < n <= EXACT else lo, max(1, CELLS // n) if n else 1):
            rows = order[i : min(hi, i + max(1, CELLS // n))]
            j = np.arange(1, n)
            new = (base[rows, None] + discount * j) * (own[rows, None] + step * j) / (everyone[rows, None] + step * j)
            weights = np.zeros((len(rows), n))
            np.cumsum(np.log(new), axis=1, out=weights[:, 1:])
            t[rows] = 1 + drawn(weights + stirling_table(discount)[n, 1 : n + 1], u[rows])
        lo = hi
    many = order[np.searchsorted(at, EXACT, "right") :]
    for i in range(0, len(many), 64):
        rows = many[i : i + 64]
        n, b, o, e = (x[rows, None].astype(np.float64) for x in (customers, base, own, everyone))

        def weight(at):
            sent = rising(o + 1, at - 1) - rising(e + 1, at - 1) if step else (at - 1) * np.log(o / e)
            return log_stirling(n, at, discount) + rising(b / discount + 1, at - 1) + at * np.log(discount) + sent

        first, last = np.ones_like(n), n
        for zoom in range(3):
            part = np.linspace(0, 1, GRID)
            grid = np.clip(np.round(first * (last / first) ** part if zoom == 0 else first + (last - first) * part), 1, n)
            w = weight(grid)
            near = w > w.max(1, keepdims=True) - 40
            to = GRID - 1 - np.argmax(near[:, ::-1], axis=1)
            pick = lambda k: np.take_along_axis(grid, np.clip(k, 0, GRID - 1)[:, None], 1)
            first, last = pick(np.argmax(near, axis=1) - 1), pick(to + 1)
        grid = first + np.arange(GRID) * np.maximum(1, (last - first) / (GRID - 1))
        w = np.where(grid <= last + 0.5, weight(np.minimum(grid, n)), -np.inf)
        t[rows] = np.round(np.take_along_axis(np.minimum(grid, n), drawn(w, u[rows])[:, None], 1)[:, 0]).astype(np.int64)
    return t


class Restaurants:
    """The seating of one bucket's words, replayed up to the sweeps whose totals are known.

    Totals are the tables of each class and, last, of the root; customers of classes never change, and those
    of the root are the tables of all classes."""

    def __init__(self, row: dict, n_words: int, classes: int):
        self.keys, self.c2 = unpack_sorted(row["keys"]), unpack(row["train"], "<i8")
        self.classes, self.k2 = classes, self.keys % classes
        self.words, self.up0 = np.unique(self.keys // classes, return_inverse=True)
        self.uniform = 1.0 / (n_words + 1)
        self.seed0 = mixed(unpack_sorted(row["words"])[self.words].astype(np.uint64))
        self.seed2 = mixed(self.seed0[self.up0] + self.k2.astype(np.uint64))
        self.sweeps = 0
        self._seated(np.ones(len(self.keys), np.int64), np.ones(len(self.words), np.int64))

    def _seated(self, t2: np.ndarray, t0: np.ndarray) -> None:
        self.t2, self.t0 = t2, t0
        self.c0 = np.bincount(self.up0, t2, len(self.words)).astype(np.int64)

    def predictive(self, customers: np.ndarray, tables: np.ndarray):
        """The root's probabilities of its words and of an unknown one, those of the types, and what each class leaves to the root."""
        rest, all0 = STRENGTH[1] + DISCOUNT[1] * tables[-1], tables[:-1].sum() + STRENGTH[1]
        p0 = (self.c0 - DISCOUNT[1] * self.t0 + rest * self.uniform) / all0
        back = (STRENGTH[0] + DISCOUNT[0] * tables[:-1]) / (customers + STRENGTH[0])
        p2 = (self.c2 - DISCOUNT[0] * self.t2) / (customers[self.k2] + STRENGTH[0]) + back[self.k2] * p0[self.up0]
        return p0, rest * self.uniform / all0, p2, back

    def sweep(self, customers: np.ndarray, tables: np.ndarray) -> None:
        rest, all0 = STRENGTH[1] + DISCOUNT[1] * tables[-1], tables[:-1].sum() + STRENGTH[1]
        others = self.c0[self.up0] - self.t2  # what other classes send to the root
        own = others - DISCOUNT[1] * np.minimum(self.t0[self.up0], others + 1) + rest * self.uniform
        base = STRENGTH[0] + DISCOUNT[0] * np.maximum(tables[self.k2] - self.t2, 0)
        t2 = seat(self.c2, base, DISCOUNT[0], own, all0 - self.t2, 1, self.seed2, 2 * self.sweeps)
        c0 = np.bincount(self.up0, t2, len(self.words)).astype(np.int64)
        base = STRENGTH[1] + DISCOUNT[1] * np.maximum(tables[-1] - self.t0, 0)
        t0 = seat(c0, base, DISCOUNT[1], np.full(len(c0), self.uniform), np.ones(len(c0)), 0, self.seed0, 2 * self.sweeps + 1)
        self._seated(t2, t0)
        self.sweeps += 1


def gibbs_totals(buckets: DataFrame, n_words: int, sweeps: int, classes: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Customers of each class, and the totals before the first sweep and after each, one job each."""
    customers, known = np.zeros(classes, np.int64), []
    for sweep in range(sweeps + 1):
        asked = ["customers", "tables"] if sweep == 0 else ["tables"]
        sent = buckets.sparkSession.sparkContext.broadcast((customers, list(known)))

        def body(batches):
            seated = np.zeros((2, classes + 1), np.int64)
            for batch in batches:
                for i in range(batch.num_rows):
                    r = Restaurants(batch.slice(i, 1).to_pylist()[0], n_words, classes)
                    for t in sent.value[1]:
                        r.sweep(sent.value[0], t)
                    for out, x in zip(seated, (r.c2, r.t2)):
                        np.add.at(out, r.k2, x)
                    seated[1, -1] += r.t0.sum()
            k = np.flatnonzero(seated[1])
            yield pa.RecordBatch.from_arrays([pa.array(k), *(pa.array(seated[int(c == "tables"), k]) for c in asked)], names=["k", *asked])

        rows = buckets.select("words", "keys", "train").mapInArrow(body, ", ".join(f"{c} long" for c in ["k", *asked]))
        found = rows.groupBy("k").agg(*[F.sum(c).alias(c) for c in asked]).toArrow()
        totals = {c: np.zeros(classes + 1, np.int64) for c in asked}
        for c in asked:
            totals[c][found.column("k").to_numpy()] = found.column(c).to_numpy()
        if sweep == 0:
            customers = totals["customers"][:-1]
        known.append(totals["tables"])
        sent.unpersist()
    return customers, known


def answers(buckets: DataFrame, n_words: int, customers: np.ndarray, totals: list[np.ndarray], keep: int) -> DataFrame:
    """block, bucket, logs (log10 probability of each type that the block asked for), counts (of its words)."""
    classes = len(customers)
    sent = buckets.sparkSession.sparkContext.broadcast((customers, totals))

    def body(batches):
        for batch in batches:
            customers, totals = sent.value
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                r, words, counts = Restaurants(row, n_words, classes), unpack_sorted(row["words"]), unpack(row["counts"], "<i8")
                kept = []
                for s, t in enumerate(totals[:-1]):
                    r.sweep(customers, t)
                    if s >= len(totals) - 1 - keep:
                        kept.append(r.predictive(customers, totals[s + 1]))
                for q in row["requests"]:
                    at = np.searchsorted(words, unpack_sorted(q["words"]))
                    w, k = np.repeat(at, unpack(q["sizes"], "<i4")), unpack(q["classes"], "<u4").astype(np.int64)
                    i2, i0 = _find(r.keys, w * classes + k), _find(r.words, w)
                    total = np.zeros(len(w))
                    for p0, unknown, p2, back in kept:
                        root = np.where(i0 < 0, unknown, p0[i0] if len(p0) else unknown)
                        total += np.where(i2 < 0, back[k] * root, p2[i2] if len(p2) else 0)
                    yield pa.RecordBatch.from_arrays([pa.array([q["block"]]), pa.array([row["bucket"]], pa.int32()), pa.array([pack(np.log10(total / len(kept)).astype("<f4"))], pa.binary()), pa.array([pack(counts[at])], pa.binary())], names=["block", "bucket", "logs", "counts"])

    return buckets.mapInArrow(body, "block long, bucket int, logs binary, counts binary")


def _find(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """The place of each wanted key among sorted keys, -1 where it isn't."""
    if not len(keys):
        return np.full(len(wanted), -1)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, at, -1)


def lm_scores(df: DataFrame, is_held, id_col: str = "doc_id", text_col: str = "text", sweeps: int = 5, keep: int = 3) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, base_score, score (log10), train_tokens, perplexity: one row per row of df."""
    src = df.select(F.col(id_col).cast("long").alias("id"), F.coalesce(is_held(F.col(id_col)), F.lit(False)).alias("held"), F.col(text_col).alias("text"))
    n_bytes, n_taught = src.agg(*[F.coalesce(F.sum(F.when(rows, F.octet_length("text"))), F.lit(0)) for rows in (F.lit(True), ~F.col("held"))]).first()
    buckets, classes = max(LEAST_BUCKETS, -(-n_bytes // BUCKET_BYTES)), n_classes(n_taught)
    made = saved(blocks(src, buckets, classes), "lm-blocks", compression="zstd")
    asked = made.select("block", F.explode("requests").alias("r")).select("r.bucket", "block", "r.words", "r.sizes", "r.classes", "r.train")
    models, merged = merged_buckets(asked, classes)
    n, v = models.agg(F.coalesce(F.sum("n_train"), F.lit(0)), F.coalesce(F.sum("n_words"), F.lit(0))).first()
    customers, totals = gibbs_totals(models, v, sweeps, classes)
    replies = answers(merged, v, customers, totals, keep)
    own = made.select("block", "ids", "held", "n_tokens", "types", "word_types")

    def add_up(block: pa.Table, reply: pa.Table) -> pa.Table:
        row = block.to_pylist()[0]
        got = sorted(reply.to_pylist(), key=lambda r: r["bucket"])
        logs = np.concatenate([unpack(r["logs"], "<f4") for r in got]).astype(np.float64)
        count = np.concatenate([unpack(r["counts"], "<i8") for r in got])
        base = np.log10((count + 1) / (n + v + 1))
        types, per_word = unpack(row["types"], "<i4"), unpack(row["word_types"], "<i4")
        word = np.repeat(np.arange(len(per_word)), per_word)
        sizes = np.array(row["n_tokens"])
        at = np.cumsum(sizes) - sizes
        tokens = word[types]
        return pa.table({"doc_id": pa.array(row["ids"], pa.int64()), "held_out": pa.array(row["held"]), "n_tokens": pa.array(sizes, pa.int64()), "n_known": pa.array(np.add.reduceat((count[tokens] > 0).astype(np.int64), at)), "base_score": pa.array(np.add.reduceat(base[tokens], at)), "score": pa.array(np.add.reduceat(logs[types], at))})

    found = own.groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(add_up, SCORES)
    return found.withColumn("train_tokens", F.lit(n).cast("long")).withColumn("perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")))
