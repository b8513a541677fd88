"""Toxicity by a convolutional text classifier trained in numpy.

A word is four hashed embedding rows side by side: one for the whole word and one each for its first
4, 5 and 6 bytes, so that inflected forms of a stem share what they have learnt. Filters of several widths run over the words; each
filter keeps its maximum over the whole text (max pooling), and a logistic unit weighs the maxima.
Training learns from every labelled row: rows are dealt into shares by a hash of the id, each task trains
a copy of the net on its shares, and Spark averages what the copies changed, over the copies that changed
it, so a word that one share knows is learnt whole. The fitted arrays have a fixed size and are broadcast.
For scoring, embeddings and filters are multiplied out once per worker, so that a convolution is a sum of
table rows.

Thresholds for the decision `toxic` are calibrated by language on all of the fifth of the labelled rows that
fitting leaves out; scores never see the language. Labels that are null, or of unknown documents, are left
out; without both classes every score is the share of label 1 (0 without labels). Null and empty
texts are scored like a text of one unknown word. Repeated rows get equal scores; extra columns stay.
"""

from __future__ import annotations

import math
import re
import uuid
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .arrow_rows import slices
from .memos import take
from .simhash import SLOTS, mark_bits, marked
from .store import saved

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+").findall
BITS = 15
ROWS = 1 << BITS
#: Bytes of a word that each embedding sees; None: all.
PIECES = (None, 4, 5, 6)
DIM, FILTERS, WIDTHS = 6, 8, (1, 2, 3)
MEMO_WORDS = 200_000
#: Words of texts that a copy of the net trains on at a time; a longer share is cut.
CHUNK_WORDS = 4_000_000
#: Changes of parameters and of Adagrad's squares are summed as integers, so that their order doesn't matter.
UNITS = (2.0**20, 2.0**26)
#: Thresholds that are tried.
GRID = np.round(np.arange(0.3, 0.91, 0.05), 2)


def held_out(id_col: str, mod: int = 3, rest: int = 1):
    return F.crc32(F.col(id_col).cast("string")) % mod == rest


class _Rows(dict):
    """Words to their embedding rows, packed into one integer."""

    def __missing__(self, word: bytes) -> int:
        value = 0
        for k, size in enumerate(PIECES):
            value |= zlib.crc32(word[:size], k) % ROWS << BITS * k
        if len(self) < MEMO_WORDS:
            self[word] = value
        return value


_ROWS = _Rows()
#: The row that stands for no word, zero for ever.
PAD = ROWS


def rows_of(text: str | None) -> np.ndarray:
    found = list(map(_ROWS.__getitem__, WORD((text or "").encode("utf-8", "surrogatepass").lower())))
    return np.array(found, np.int64)


def padded(docs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A line of embedding rows per piece, each text followed by padding, and where each text starts and ends."""
    gap = max(WIDTHS) - 1
    sizes = np.array([max(1, len(d)) for d in docs])
    starts = np.cumsum(sizes + gap) - sizes - gap
    rows = np.full((len(PIECES), int((sizes + gap).sum()) + gap), PAD, np.int32)
    for at, d in zip(starts, docs):
        for k in range(len(PIECES)):
            rows[k, at : at + len(d)] = d >> BITS * k & ROWS - 1
    return rows, starts, starts + sizes


@dataclass
class ConvNet:
    embeddings: list[np.ndarray]
    filters: dict[int, np.ndarray]
    bias: np.ndarray
    weight: np.ndarray
    offset: float
    thresholds: dict[str, float] = field(default_factory=dict)
    threshold: float = 0.7
    key: str = ""

    @staticmethod
    def new(seed: int) -> ConvNet:
        rng = np.random.default_rng(seed)
        n = FILTERS * len(WIDTHS)
        return ConvNet(
            [np.zeros((ROWS + 1, DIM), np.float32) for _ in PIECES],
            {w: rng.normal(0, 0.5, (w, len(PIECES) * DIM, FILTERS)).astype(np.float32) for w in WIDTHS},
            np.full(n, 0.05, np.float32), rng.normal(0, 0.5, n).astype(np.float32), 0.0,
        )

    @staticmethod
    def of(flat: np.ndarray) -> ConvNet:
        """The net (or its squares) of one line of parameters."""
        net, at = ConvNet.new(0), 0
        for part in (*net.embeddings, *net.filters.values(), net.bias, net.weight):
            part[...] = flat[at : at + part.size].reshape(part.shape)
            at += part.size
        net.offset = float(flat[at])
        return net

    def flat(self) -> np.ndarray:
        """All parameters in one line, filled up to whole rows of DIM."""
        line = np.concatenate([*(p.ravel() for p in (*self.embeddings, *self.filters.values(), self.bias, self.weight)), [self.offset]]).astype(np.float32)
        return np.pad(line, (0, -len(line) % DIM))

    def train(self, docs: list[np.ndarray], y: np.ndarray, epochs: int, seed, squares: ConvNet, rate: float = 0.1) -> None:
        """Adagrad over mini-batches; the gradient of a maximum goes to the words that made it. `squares` is carried on."""
        rng = np.random.default_rng(seed)
        for _ in range(epochs):
            order = rng.permutation(len(docs))
            for lo in range(0, len(order), 64):
                pick = order[lo : lo + 64]
                rows, starts, ends = padded([docs[i] for i in pick])
                e = np.concatenate([table[r] for table, r in zip(self.embeddings, rows)], 1)
                best, peak = [], []
                for w in WIDTHS:
                    z = sum(e[k : len(e) - w + 1 + k] @ self.filters[w][k] for k in range(w))
                    at = np.array([s + z[s:t].argmax(0) for s, t in zip(starts, ends)])
                    best.append(at)
                    peak.append(np.take_along_axis(z, at, 0))
                h = np.concatenate(peak, 1) + self.bias
                r = np.maximum(h, 0)
                p = 1 / (1 + np.exp(-(r @ self.weight + self.offset)))
                d = ((p - y[pick]) / len(pick)).astype(np.float32)
                dh = d[:, None] * self.weight * (h > 0)
                grads = {"weight": r.T @ d, "bias": dh.sum(0)}
                g0 = float(d.sum())
                squares.offset += g0 * g0
                self.offset -= rate * g0 / squares.offset**0.5
                for j, w in enumerate(WIDTHS):
                    at, dz = best[j], dh[:, j * FILTERS : (j + 1) * FILTERS]
                    for k in range(w):
                        words = e[at + k]
                        grad = np.einsum("nf,nfd->df", dz, words)
                        back = np.einsum("nf,df->nfd", dz, self.filters[w][k]).reshape(-1, len(PIECES) * DIM)
                        live = np.abs(back).sum(1) > 0
                        for i, (table, square) in enumerate(zip(self.embeddings, squares.embeddings)):
                            own, inverse = np.unique(rows[i][(at + k).ravel()[live]], return_inverse=True)
                            total = np.zeros((len(own), DIM), np.float32)
                            np.add.at(total, inverse, back[live, i * DIM : (i + 1) * DIM])
                            total[own == PAD] = 0
                            square[own] += total**2
                            table[own] -= rate * total / np.sqrt(square[own])
                        squares.filters[w][k] += grad**2
                        self.filters[w][k] -= rate * grad / np.sqrt(squares.filters[w][k])
                for name, grad in grads.items():
                    setattr(squares, name, getattr(squares, name) + grad**2)
                    setattr(self, name, getattr(self, name) - rate * grad / np.sqrt(getattr(squares, name)))

    def tables(self) -> list[list[np.ndarray]]:
        """For each place of each filter width: what every row of each embedding adds to its filters."""
        return [[e @ self.filters[w][k][i * DIM : (i + 1) * DIM] for i, e in enumerate(self.embeddings)] for w in WIDTHS for k in range(w)]

    def scores(self, docs: list[np.ndarray], tables: list | None = None) -> np.ndarray:
        if not docs:
            return np.zeros(0)
        tables = iter(tables or self.tables())
        rows, starts, ends = padded(docs)
        cuts = np.stack([starts, ends], 1).ravel()
        peak = []
        for w in WIDTHS:
            n = rows.shape[1] - max(WIDTHS) + 1
            z = np.zeros((n, FILTERS), np.float32)
            for k in range(w):
                for table, r in zip(next(tables), rows):
                    z += table[r[k : n + k]]
            peak.append(np.maximum.reduceat(z, np.minimum(cuts, n - 1), 0)[::2])
        r = np.maximum(np.concatenate(peak, 1) + self.bias, 0).astype(np.float64)
        return 1 / (1 + np.exp(-(r @ self.weight.astype(np.float64) + self.offset)))


def labelled_rows(docs: DataFrame, labels: DataFrame, train_only, most_rows: int, id_col: str = "doc_id", label_col: str = "toxic") -> tuple[DataFrame | None, dict[int, int], int]:
    """part, y, lang, text, test (a fifth) of all labelled documents, the classes' sizes, and the number of
    parts, of which each holds about 4 * most_rows of the larger class.

    Texts without a label are dropped by a bitmap of fixed size before anything is shuffled; a part is a partition."""
    known = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("y")).where(train_only("id"))
    share = {r["y"]: r["count"] for r in known.groupBy("y").count().collect()}
    if not share:
        return None, {}, 0
    parts = math.ceil(max(share.values()) / (4 * most_rows))
    slot = F.pmod(F.xxhash64("id"), F.lit(SLOTS)).alias("slot")
    marks = docs.sparkSession.sparkContext.broadcast(mark_bits(known.select(slot)))

    def body(batches):
        for batch in batches:
            yield batch.filter(pa.array(marked(marks.value, batch.column("slot").to_numpy()))).select(["id", "lang", "text"])

    lang = F.coalesce(F.col("lang"), F.lit("")) if "lang" in docs.columns else F.lit("")
    texts = docs.select(F.col(id_col).cast("long").alias("id"), lang.alias("lang"), "text").where(F.col("id").isNotNull()).where(train_only("id")).withColumn("slot", slot)
    made = texts.mapInArrow(body, "id long, lang string, text string").repartition(parts, "id").join(known.repartition(parts, "id"), "id")
    made = made.select("id", F.pmod(F.hash("id"), F.lit(parts)).alias("part"), "y", "lang", "text", (F.pmod(F.xxhash64("id"), F.lit(5)) == 4).alias("test"))
    return saved(made.sortWithinPartitions("part", "id", "y", "text"), "labelled"), share, parts


def runs(batches):
    """part, embedding rows and labels of the rows (part, y, text), which stand by part, about CHUNK_WORDS words at most."""
    part, docs, y, words = None, [], [], 0
    for batch in batches:
        for p, label, text in zip(batch.column("part").to_pylist(), batch.column("y").to_pylist(), batch.column("text")):
            if docs and (p != part or words > CHUNK_WORDS):
                yield part, docs, np.array(y, np.float64)
                docs, y, words = [], [], 0
            part = p
            docs.append(rows_of(text.as_py()))
            y.append(label)
            words += len(docs[-1])
    if docs:
        yield part, docs, np.array(y, np.float64)


CHANGES = [f"{k}{i}" for k in "ds" for i in range(DIM)]


def averaged(rows: DataFrame, state: tuple[np.ndarray, np.ndarray], passes: int, seed: int, turn: int) -> tuple[np.ndarray, np.ndarray]:
    """Parameters and squares after a copy of the net has trained on each part of the rows: each changed by the mean of the copies that changed it."""
    sent = rows.sparkSession.sparkContext.broadcast(state)

    def changes(*own: ConvNet) -> pa.RecordBatch:
        moved = [np.rint((net.flat().astype(np.float64) - was) * unit).astype(np.int64).reshape(-1, DIM) for net, was, unit in zip(own, sent.value, UNITS)]
        moved = np.concatenate(moved, 1)
        at = np.flatnonzero(moved.any(1))
        return pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), *(pa.array(moved[at, i]) for i in range(2 * DIM))], names=["at", *CHANGES])

    def body(batches):
        take("toxicity", _forget)
        last = own = None
        for part, docs, y in runs(batches):
            if part != last:
                if own:
                    yield changes(*own)
                last, own = part, tuple(map(ConvNet.of, sent.value))
            own[0].train(docs, y, passes, [seed, turn, part], own[1])
        if own:
            yield changes(*own)

    made = rows.select("part", "y", "text").mapInArrow(body, f"at long, {', '.join(f'{c} long' for c in CHANGES)}")
    got = made.groupBy("at").agg(F.count("*").alias("n"), *[F.sum(c).alias(c) for c in CHANGES]).toArrow()  # as many rows as the net has, at most
    at, n = got.column("at").to_numpy(), got.column("n").to_numpy()
    out = tuple(was.copy() for was in state)
    for k, unit, new in zip("ds", UNITS, out):
        new.reshape(-1, DIM)[at] += np.stack([got.column(f"{k}{i}").to_numpy() / (n * unit) for i in range(DIM)], 1).astype(np.float32)
    return out


def fit(docs: DataFrame, labels: DataFrame, most_rows: int = 3000, epochs: int = 5, least_steps: int = 200, seed: int = 7, train_only=lambda c: ~held_out(c)) -> ConvNet:
    """Fits on all labelled rows, on the executors. If they are one part (4 * most_rows of the larger class), it is passed `epochs`
    times, more often if it is small, up to `least_steps` batches. If there are more, copies of the net start from two passes over
    one of them, and are averaged after each of half as many passes as `epochs` over all."""
    rows, share, parts = labelled_rows(docs, labels, train_only, most_rows)
    met = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count_if(~F.col("test")).alias("n")).collect()} if share else {}
    if len(met) < 2:
        net = ConvNet.new(seed)
        net.key = uuid.uuid4().hex
        total = sum(share.values())
        p = share.get(1, 0) / total if total else 0.0
        net.offset = float(np.log(p / (1 - p))) if 0 < p < 1 else (-40.0 if p == 0 else 40.0)
        return net
    part, test = rows.where("NOT test"), rows.where("test")
    state = ConvNet.new(seed).flat()
    state = state, np.full_like(state, 1e-3)
    if parts == 1:
        state = averaged(part, state, max(epochs, -(-64 * least_steps // max(1, sum(met.values())))), seed, 0)
    else:
        for turn in range(1 + -(-epochs // 2)):
            state = averaged(part if turn else part.where("part = 0"), state, 1 if turn else 2, seed, turn)
    net = ConvNet.of(state[0])
    net.key = uuid.uuid4().hex
    sent = docs.sparkSession.sparkContext.broadcast(net)

    def body(batches):
        tables = _tables(sent.value)
        for whole in batches:
            for batch in slices(whole, "text"):
                made = sent.value.scores([rows_of(t) for t in batch.column("text").to_pylist()], tables)
                yield pa.RecordBatch.from_arrays([batch.column("lang"), batch.column("y"), pa.array(np.searchsorted(GRID, made, side="right"), pa.int64())], names=["lang", "y", "reached"])

    counts = saved(test.select("lang", "y", "text").mapInArrow(body, "lang string, y int, reached long").groupBy("lang", "y", "reached").agg(F.count("*").alias("n")), "reached")
    net.threshold = calibrated(counts.groupBy("y", "reached").agg(F.sum("n").alias("n")).collect())
    enough = counts.where("y = 1 AND lang <> ''").groupBy("lang").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_TOXIC).select("lang")
    by_lang: dict[str, list] = {}
    for r in counts.join(enough, "lang").collect():
        by_lang.setdefault(r["lang"], []).append(r)
    net.thresholds = {k: calibrated(v, net.threshold) for k, v in by_lang.items()}
    return net


#: Toxic rows that a threshold is calibrated on at least.
LEAST_TOXIC = 20


def calibrated(counts: list, other: float = 0.7) -> float:
    """The threshold of GRID with the best F1, nearest to 0.7 among equals, of rows (y, reached: how many thresholds, n); `other` below LEAST_TOXIC positives."""
    table = np.zeros((2, len(GRID) + 1))
    for r in counts:
        table[r["y"], r["reached"]] += r["n"]
    if table[1].sum() < LEAST_TOXIC:
        return other
    hits = table[:, ::-1].cumsum(1)[:, ::-1][:, 1:]
    f1 = 2 * hits[1] / np.maximum(1e-9, hits.sum(0) + table[1].sum())
    return float(GRID[max(range(len(GRID)), key=lambda k: (round(f1[k], 6), -abs(GRID[k] - 0.7)))])


_TABLES: dict[str, list] = {}


def _forget() -> None:
    _ROWS.clear()
    _TABLES.clear()


def _tables(net: ConvNet) -> list:
    take("toxicity", _forget)
    if net.key not in _TABLES:
        _TABLES.clear()
        _TABLES[net.key] = net.tables()
    return _TABLES[net.key]


def score(df: DataFrame, net: ConvNet, text_col: str = "text", keep_text: bool = False) -> DataFrame:
    """Adds score, and toxic: whether it reaches the threshold of the row's language."""
    spark = df.sparkSession
    model = spark.sparkContext.broadcast(net)
    kept = [c for c in df.columns if c not in ("score", "toxic") and (keep_text or c != text_col)]

    def body(batches):
        own = model.value
        tables = _tables(own)
        for whole in batches:
            for batch in slices(whole, "__text__"):
                made = own.scores([rows_of(t) for t in batch.column("__text__").to_pylist()], tables)
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(made, pa.float64())], names=[*kept, "score"])

    src = df.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{text_col}`").alias("__text__"))
    out = src.mapInArrow(body, StructType([*(df.schema[c] for c in kept), StructField("score", DoubleType())]))
    limit = F.lit(net.threshold)
    if "lang" in kept:
        for lang, t in sorted(net.thresholds.items()):
            limit = F.when(F.col("lang") == lang, t).otherwise(limit)
    return out.withColumn("toxic", F.col("score") >= limit)
