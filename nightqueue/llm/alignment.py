"""Alignment of two tokenizers over a corpus, with external spill counting of linked token pairs.

Both tokenizers see the same bytes, a blank and the text. Places where tokens of both end cut a document
into groups; between any two ends, of whichever side, one token of A and one of B overlap: these are the
links. How many documents hold a pair of ids linked is counted over the corpus:

* A task encodes its documents and turns them into runs of about `run_records` distinct (pair, document)
  records. A run is sorted by pair, A's id first, and dealt by radix of A's id; the piece for each radix is
  kept as zstd blocks: the pairs, how many of the run's documents hold each, and which, how often.
* The pairs and counts of a radix are met in a k-way heap merge that holds one block of each run. More than
  `fan_in` runs are merged in rounds, so no task gets more than that; a pair that every document holds is
  one entry per run. In A-major order all partners of an id stand together, which gives its highest count.
* Runs of a radix meet the merged counts in groups of `fan_in`, and each run gets back what its documents
  gain: the sum of counts over links, and links whose count is the highest of their A id.

Null and empty texts, and texts whose tokens don't give their bytes back on either side (as where a text
holds U+2581, B's sign for a blank), have no tokens: zeros, and an empty digest. Rows that are repeated,
also under one id, count as documents of their own. Rows without an id are counted and returned like
others. An empty table gives no rows. Other columns stay; one that has the name of an output is replaced.
A text is aligned as a whole, so memory follows the longest text of a table.
"""

from __future__ import annotations

import hashlib
import heapq

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, LongType, StringType, StructField, StructType

from .arrow_rows import slices, texts
from .memos import take
from .packed import pack, pack_sorted, unpack, unpack_sorted
from .store import saved
from .token_files import LibraryCoder
from .vocab import byte_alphabet, read_tokenizer
from .words import GLUED, Cutter, Memo, encoded, special_split

#: Bytes of text that are aligned at a time, about, and distinct words that a worker remembers of each side.
BATCH_BYTES = 1_200_000
MEMO_WORDS = 300_000
RADIXES = 64
#: Pairs of a block, the unit in which runs are read.
BLOCK = 8192
#: In a record's number: bits of the document's place in its run.
DOC_BITS = 24
BLANK = "▁"
COUNTS = ("n_a", "n_b", "n_groups", "n_links")
MADE = (*COUNTS, "n_best", "count_sum", "groups_sha256")


def checked_values(words: list[str], values: np.ndarray, sizes: np.ndarray, spelled: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of words; a word whose ids don't spell it has a single id of -1."""
    each = [spelled[v] for v in values.tolist()]
    if b"".join(each) == "".join(words).encode("utf-8", "surrogatepass"):
        return values, sizes
    ends = np.cumsum(sizes).tolist()
    good = [b"".join(each[b - n : b]) == w.encode("utf-8", "surrogatepass") for w, b, n in zip(words, ends, sizes.tolist())]
    parts = [values[b - n : b] if ok else np.full(1, -1, values.dtype) for ok, b, n in zip(good, ends, sizes.tolist())]
    return np.concatenate(parts), np.array([len(p) for p in parts], np.int64)


class PlainCoder(LibraryCoder):
    """Side A: byte-level ids, special strings as plain text."""

    def __init__(self, raw: bytes):
        super().__init__(raw)
        self.library.encode_special_tokens = True
        self.cutter, self.memo = Cutter(GLUED, {}), Memo(self.learn_checked, most=MEMO_WORDS)
        to_byte = {c: b for b, c in enumerate(byte_alphabet())}
        vocab = self.library.get_vocab(with_added_tokens=True)
        self.spelled = [b""] * (max(vocab.values()) + 1)
        for token, i in vocab.items():
            self.spelled[i] = bytes(to_byte[c] for c in token) if all(c in to_byte for c in token) else token.encode()

    def learn_checked(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        values, sizes = self.learn(words)
        return checked_values(words, values, sizes, self.spelled)


def unit_starts(cp: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A unit is a run of blanks with what follows them up to the next blank."""
    start = first[: len(cp)].copy()
    start[1:] |= (cp[1:] == 32) & (cp[:-1] != 32)
    return start


class UnitCutter(Cutter):
    def __init__(self):
        self.split, self.normal, self.starts = special_split({}), None, unit_starts


class PieceCoder:
    """Side B: sentencepiece ids of a text behind one blank, which the model puts there itself.

    If no piece has its blank sign behind another character, merges never cross the start of a unit, and
    units are encoded once each; else whole texts are."""

    def __init__(self, raw: bytes):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_proto=raw)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.spelled = [bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else b"" if self.model.is_control(i) else p.replace(BLANK, " ").encode() for i, p in enumerate(pieces)]
        self.apart = all(BLANK not in p.lstrip(BLANK) for p in pieces)
        self.blank = self.model.piece_to_id(BLANK)
        self.cutter, self.memo = UnitCutter(), Memo(self.learn, most=MEMO_WORDS)

    def ids(self, units: list[str]) -> list[list[int]]:
        """Each unit begins with the blank that the model adds; a lone one stands for nothing to the model."""
        return [ids if u != " " else [self.blank] for u, ids in zip(units, self.model.encode([u[1:] for u in units], num_threads=1))]

    def learn(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = self.ids(units)
        return checked_values(units, np.array([i for ids in found for i in ids], "<i4"), np.array([len(ids) for ids in found], np.int64), self.spelled)

    def encode(self, batch: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if self.apart:
            return encoded(self.cutter, self.memo, batch)
        each = [self.learn([t]) if t else (np.zeros(0, "<i4"), np.zeros(1, np.int64)) for t in batch]
        return np.concatenate([np.zeros(0, "<i4"), *(v for v, _ in each)]), np.array([len(v) for v, _ in each], np.int64)


class Aligner:
    def __init__(self, raw_a: bytes, raw_b: bytes):
        self.a, self.b = PlainCoder(raw_a), PieceCoder(raw_b)
        self.len_a, self.len_b = (np.array([len(s) for s in c.spelled], np.int64) for c in (self.a, self.b))
        self.width = len(self.len_b)
        most = max(len(self.len_a), self.width)
        wide = len(str(most - 1))
        self.digits = np.zeros((most, wide + 1), np.uint8)
        for i in range(most):
            self.digits[i, : len(str(i))] = np.frombuffer(str(i).encode(), np.uint8)
        self.size = (self.digits != 0).sum(1) + 1

    def align(self, batch: list[str]) -> tuple[dict[str, np.ndarray], list[str], np.ndarray, np.ndarray]:
        """Counts by document, digests of groups, and the links' documents and pairs (A's id * width + B's id)."""
        full = [" " + t if t else "" for t in batch]
        (a, n_a), (b, n_b) = self.a.encode(full), self.b.encode(full)
        lost = odd(a, n_a) | odd(b, n_b)
        if lost.any():
            a, b = a[np.repeat(~lost, n_a)], b[np.repeat(~lost, n_b)]
            n_a, n_b = np.where(lost, 0, n_a), np.where(lost, 0, n_b)
        end_a, end_b = np.cumsum(self.len_a[a]), np.cumsum(self.len_b[b])
        if len(a) == 0:
            zero = np.zeros(len(batch), np.int64)
            return dict.fromkeys(COUNTS, zero), [""] * len(batch), zero[:0], zero[:0]
        # for each end, the token of the other side that reaches it or ends with it
        over_a, over_b = np.searchsorted(end_b, end_a), np.searchsorted(end_a, end_b)
        both, alone = end_b[over_a] == end_a, end_a[over_b] != end_b
        n_groups = np.diff(np.r_[0, np.cumsum(both)][np.r_[0, np.cumsum(n_a)]])
        doc = np.repeat(np.arange(len(batch)), n_a)
        pairs = np.r_[a.astype(np.int64) * self.width + b[over_a], a[over_b[alone]].astype(np.int64) * self.width + b[alone]]
        digests = self.digests(a, b, np.cumsum(both) - both, np.cumsum(~alone) - ~alone, int(both.sum()), n_a + n_b)
        return {"n_a": n_a, "n_b": n_b, "n_groups": n_groups, "n_links": n_a + n_b - n_groups}, digests, np.r_[doc, doc[over_b[alone]]], pairs

    def digests(self, a: np.ndarray, b: np.ndarray, group_a: np.ndarray, group_b: np.ndarray, groups: int, tokens: np.ndarray) -> list[str]:
        """Digests of the documents' groups: A's ids, a bar, B's ids, groups apart by semicolons."""
        own_a, own_b = np.bincount(group_a, minlength=groups), np.bincount(group_b, minlength=groups)
        begin = np.cumsum(own_a + own_b) - own_a - own_b
        place_a = np.arange(len(a)) + (begin - (np.cumsum(own_a) - own_a))[group_a]
        place_b = np.arange(len(b)) + (begin + own_a - (np.cumsum(own_b) - own_b))[group_b]
        said, size = np.empty((len(a) + len(b), self.digits.shape[1]), np.uint8), np.empty(len(a) + len(b), np.int64)
        for ids, place, group, sign in ((a, place_a, group_a, b"|"), (b, place_b, group_b, b";")):
            said[place], size[place] = self.digits[ids], self.size[ids]
            said[place, -1] = np.where(np.r_[group[1:] != group[:-1], True], ord(sign), ord(","))
        flat = said[said != 0]
        text_ends = np.r_[0, np.cumsum(size)][np.cumsum(tokens)].tolist()
        view = memoryview(np.ascontiguousarray(flat))
        return [hashlib.sha256(view[x : y - 1]).hexdigest() if n else "" for x, y, n in zip([0, *text_ends], text_ends, tokens.tolist())]


def odd(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Whether each text has an id of -1."""
    ends = np.cumsum(sizes)
    before = np.r_[0, np.cumsum(values < 0)]
    return before[ends] > before[ends - sizes]


_ALIGNERS: dict[str, Aligner] = {}


def aligner(raw_a: bytes, raw_b: bytes) -> Aligner:
    take("alignment", _ALIGNERS.clear)
    key = hashlib.sha1(raw_a + raw_b).hexdigest()
    if key not in _ALIGNERS:
        _ALIGNERS[key] = Aligner(raw_a, raw_b)
    return _ALIGNERS[key]


def blocks(values: np.ndarray, packed) -> list[bytes]:
    return [packed(values[i : i + BLOCK]) for i in range(0, len(values), BLOCK)]


def pack_counts(values: np.ndarray) -> bytes:
    return pack(values.astype("<i8"))


def run_pieces(keys: np.ndarray, times: np.ndarray, width: int, radixes: int):
    """Of a run's records (pair and document in one number, distinct) for each radix: pairs, how many documents
    hold each, the documents and how often: sorted by pair, then document."""
    order = np.argsort(keys, kind="stable")
    keys, times = keys[order], times[order]
    pair, doc = keys >> DOC_BITS, (keys & ((1 << DOC_BITS) - 1)).astype("<i4")
    radix = pair // width % radixes
    order = np.argsort(radix, kind="stable")
    pair, doc, times, radix = pair[order], doc[order], times[order].astype("<i4"), radix[order]
    cuts = np.flatnonzero(np.r_[True, radix[1:] != radix[:-1]])
    for lo, hi in zip(cuts, np.r_[cuts[1:], len(radix)]):
        heads = np.flatnonzero(np.r_[True, pair[lo + 1 : hi] != pair[lo : hi - 1]])
        yield int(radix[lo]), pair[lo:hi][heads], np.diff(np.r_[heads, hi - lo]), doc[lo:hi], times[lo:hi]


def merged(runs: list[tuple[list[bytes], list[bytes]]]):
    """K-way merge of runs (blocks of ascending pairs, blocks of their counts): ascending distinct pairs and summed counts, in pieces.

    The heap holds the last pair of each run's open block. Its smallest bounds what all open blocks can give
    for good; after that, the blocks that are used up make way for the next ones of their runs."""
    open_blocks: dict[int, tuple[int, np.ndarray, np.ndarray]] = {}
    heap: list[tuple[int, int]] = []

    def load(k: int, i: int) -> None:
        pairs, counts = runs[k]
        if i < len(pairs):
            open_blocks[k] = (i, unpack_sorted(pairs[i]), unpack(counts[i], "<i8"))
            heapq.heappush(heap, (int(open_blocks[k][1][-1]), k))
        else:
            open_blocks.pop(k, None)

    for k in range(len(runs)):
        load(k, 0)
    while heap:
        bound, out, more = heap[0][0], [], []
        while heap and heap[0][0] == bound:
            more.append(heapq.heappop(heap)[1])
        for k, (i, pairs, counts) in open_blocks.items():
            upto = int(np.searchsorted(pairs, bound, side="right"))
            if upto:
                out.append((pairs[:upto], counts[:upto]))
                open_blocks[k] = (i, pairs[upto:], counts[upto:])
        pairs, counts = (np.concatenate(x) for x in zip(*out))
        order = np.argsort(pairs, kind="stable")
        pairs, counts = pairs[order], counts[order]
        heads = np.flatnonzero(np.r_[True, pairs[1:] != pairs[:-1]])
        yield pairs[heads], np.add.reduceat(counts, heads)
        for k in more:
            load(k, open_blocks[k][0] + 1)


def best_of(pairs: np.ndarray, counts: np.ndarray, width: int) -> np.ndarray:
    """Whether each pair's count is the highest of its A id; all pairs of an id stand together."""
    if not len(pairs):
        return np.zeros(0, bool)
    a = pairs // width
    heads = np.flatnonzero(np.r_[True, a[1:] != a[:-1]])
    return counts == np.repeat(np.maximum.reduceat(counts, heads), np.diff(np.r_[heads, len(a)]))


def gains(pairs, counts, best, own, held, doc, times) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Documents of a run piece, and for each the links whose pair is best and the sum of counts over its links."""
    at, times = np.repeat(np.searchsorted(pairs, own), held), times.astype(np.int64)
    n_best, total = np.zeros(int(doc.max()) + 1, np.int64), np.zeros(int(doc.max()) + 1, np.int64)
    np.add.at(n_best, doc, times * best[at])
    np.add.at(total, doc, times * counts[at])
    docs = np.flatnonzero(total)  # a link's count is 1 at least
    return docs, n_best[docs], total[docs]


def lists(table: pa.Table, *columns: str):
    return zip(*(table.column(c).to_pylist() for c in columns))


def align(df: DataFrame, path_a: str, path_b: str, text_col: str = "text", radixes: int = RADIXES, run_records: int = 1_500_000, fan_in: int = 256) -> DataFrame:
    """Replaces the text by MADE: counts of tokens, groups and links, n_best, count_sum and groups_sha256.

    `radixes`, `run_records` and `fan_in` bound what a task holds, and don't change the result."""
    kept = [c for c in df.columns if c != text_col and c not in MADE]
    own_names = [f"__c{i}" for i in range(len(kept))]
    spark = df.sparkSession
    raw = spark.sparkContext.broadcast((read_tokenizer(path_a), read_tokenizer(path_b)))
    src = df.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(kept, own_names)], F.col(f"`{text_col}`").alias("__text__"))
    whole = StructType(
        [StructField("run", LongType()), StructField("row", IntegerType()), *[StructField(n, df.schema[c].dataType) for c, n in zip(kept, own_names)]]
        + [StructField(c, LongType()) for c in COUNTS]
        + [StructField("groups_sha256", StringType()), StructField("radix", IntegerType()), StructField("width", IntegerType())]
        + [StructField("pairs", ArrayType(BinaryType())), StructField("held", ArrayType(BinaryType())), StructField("docs", BinaryType()), StructField("times", BinaryType())]
    )

    def body(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        kind = to_arrow_schema(whole)
        own = aligner(*raw.value)
        state = {"run": TaskContext.get().partitionId() << 32, "rows": 0, "records": 0, "keys": [], "times": []}

        def rows(n: int, **columns) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if f.name in columns and not isinstance(columns[f.name], pa.Array) else columns.get(f.name, pa.nulls(n, f.type)) for f in kind], schema=kind)

        def flushed():
            if state["records"]:
                for radix, pair, held, doc, times in run_pieces(np.concatenate(state["keys"]), np.concatenate(state["times"]), own.width, radixes):
                    delta = np.diff(doc, prepend=doc.dtype.type(0))
                    yield rows(1, run=[state["run"]], radix=[radix], width=[own.width], pairs=[blocks(pair, pack_sorted)], held=[blocks(held, pack_counts)], docs=[pack(delta)], times=[pack(times)])
            state.update(run=state["run"] + 1, rows=0, records=0, keys=[], times=[])

        for large in batches:
            for batch in slices(large, "__text__", BATCH_BYTES):
                counts, digests, doc, pairs = own.align(texts(batch, "__text__"))
                n, first = batch.num_rows, state["rows"]
                yield rows(n, run=np.full(n, state["run"]), row=np.arange(first, first + n), **counts, groups_sha256=digests, **{c: batch.column(c) for c in own_names})
                keys, times = np.unique(pairs << DOC_BITS | (doc + first), return_counts=True)
                state["keys"].append(keys)
                state["times"].append(times)
                state["rows"] += n
                state["records"] += len(keys)
                if state["records"] >= run_records or state["rows"] + (1 << 20) > 1 << DOC_BITS:
                    yield from flushed()
        yield from flushed()

    made = saved(src.mapInArrow(body, whole), "aligned", **{"parquet.block.size": str(32 << 20)})
    docs = made.where("radix IS NULL").select("run", "row", *own_names, *COUNTS, "groups_sha256")
    pieces = made.where("radix IS NOT NULL").select("radix", "run", "width", "pairs", "held", "docs", "times")
    counts = counted(pieces.select("radix", "run", "width", "pairs", "held"), fan_in)
    gained = contributions(pieces, counts, fan_in)
    out = docs.join(gained, ["run", "row"], "left")
    names = dict(zip(own_names, kept))
    return out.select(*[F.col(n).alias(c) for n, c in names.items()], *COUNTS, F.coalesce("n_best", F.lit(0)).alias("n_best"), F.coalesce("count_sum", F.lit(0)).alias("count_sum"), "groups_sha256")


def counted(runs: DataFrame, fan_in: int) -> DataFrame:
    """radix, pairs, held, best: all distinct pairs of each radix and how many documents hold them, one row a radix."""

    def merge(last: bool):
        def each(key, table):
            width = table.column("width")[0].as_py()
            found = list(merged(list(lists(table, "pairs", "held"))))
            pairs, counts = (np.concatenate(x) for x in zip(*found))
            out = {"radix": [key[0].as_py()], "run": [key[1].as_py()], "width": [width], "pairs": [blocks(pairs, pack_sorted)], "held": [blocks(counts, pack_counts)]}
            if last:
                out["best"] = [zstandard.ZstdCompressor(level=1).compress(np.packbits(best_of(pairs, counts, width)).tobytes())]
            kinds = {"radix": pa.int32(), "run": pa.int64(), "width": pa.int32(), "pairs": pa.list_(pa.binary()), "held": pa.list_(pa.binary()), "best": pa.binary()}
            return pa.table({k: pa.array(v, kinds[k]) for k, v in out.items()})

        return each

    kind = "radix int, run long, width int, pairs array<binary>, held array<binary>"
    while (parts := -(-runs.select("run").distinct().count() // fan_in)) > 1:
        # at least halved each round, as parts are made by a hash
        dealt = runs.withColumn("run", F.pmod(F.xxhash64("run"), F.lit(parts)))
        runs = saved(dealt.groupBy("radix", "run").applyInArrow(merge(False), kind), "merged-runs")
    one = runs.withColumn("run", F.lit(0).cast("long"))
    return saved(one.groupBy("radix", "run").applyInArrow(merge(True), f"{kind}, best binary").drop("run"), "pair-counts")


def contributions(pieces: DataFrame, counts: DataFrame, fan_in: int) -> DataFrame:
    """run, row, n_best, count_sum: what each document gains over all radixes."""
    parts = max(1, -(-pieces.select("run").distinct().count() // fan_in))
    dealt = pieces.withColumn("part", F.pmod(F.xxhash64("run"), F.lit(parts)))
    known = counts.select("radix", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))).alias("part"), "pairs", "held", "best")

    def back(left, right):
        (blocks_of, held_of, best), = lists(right, "pairs", "held", "best")
        pairs, counts = np.concatenate([unpack_sorted(b) for b in blocks_of]), np.concatenate([unpack(b, "<i8") for b in held_of])
        best = np.unpackbits(np.frombuffer(zstandard.decompress(best), np.uint8), count=len(pairs)).astype(bool)
        out = {"run": [], "docs": [], "n_best": [], "count_sum": []}
        for run, own, held, docs, times in lists(left, "run", "pairs", "held", "docs", "times"):
            own, held = np.concatenate([unpack_sorted(b) for b in own]), np.concatenate([unpack(b, "<i8") for b in held])
            doc = np.cumsum(unpack(docs, "<i4"), dtype=np.int32)
            for c, v in zip(out, (run, *gains(pairs, counts, best, own, held, doc, unpack(times, "<i4")))):
                out[c].append(v if c == "run" else pack(v.astype("<i8")))
        return pa.table({"run": pa.array(out["run"], pa.int64()), **{c: pa.array(out[c], pa.binary()) for c in ("docs", "n_best", "count_sum")}})

    each = dealt.groupBy("radix", "part").cogroup(known.groupBy("radix", "part")).applyInArrow(back, "run long, docs binary, n_best binary, count_sum binary")

    def summed(key, table):
        docs, best, total = (np.concatenate([unpack(b, "<i8") for b in table.column(c).to_pylist()]) for c in ("docs", "n_best", "count_sum"))
        sums = [np.zeros(int(docs.max()) + 1, np.int64), np.zeros(int(docs.max()) + 1, np.int64)]
        for s, v in zip(sums, (best, total)):
            np.add.at(s, docs, v)
        rows = np.flatnonzero(sums[1])
        return pa.table({"run": pa.array(np.full(len(rows), key[0].as_py()), pa.int64()), "row": pa.array(rows, pa.int32()), "n_best": sums[0][rows], "count_sum": sums[1][rows]})

    return each.groupBy("run").applyInArrow(summed, "run long, row int, n_best long, count_sum long")
