"""BPE encoding by dynamic programming over prefixes, and decoding.

Every prefix of a word has one BPE encoding, and the encoding of a longer prefix is that of a
shorter one plus a last token. So it is enough to store the last token of each prefix. The tokens
that end at a prefix come from a suffix matcher (Aho-Corasick over the vocabulary); the right one
is the only one that is compatible with the last token of the prefix before it. Back-pointers from
the whole word give the ids.

Null text encodes as the empty text: no ids. Special strings inside a text become their ids, as the
tokenizers library does by default. All columns but those written are kept; an input column that
has the name of an output column is replaced. Repeated rows give repeated rows.
"""

from __future__ import annotations

import hashlib
import math
import unicodedata
from array import array
from functools import cached_property

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .arrow_rows import slices, texts
from .memos import hand_back_large, take
from .vocab import MergeTable, read_tokenizer, unknown_here
from .words import GLUED, SPACE, Cutter, Memo, classes, encoded

#: Marks the last symbol of a word where the vocabulary has word ends.
_END = 0x10000
#: Words that a worker remembers before it starts anew: bounds its memory.
MEMO_WORDS = 250_000
#: Places for pairs of tokens whose border it remembers, 8 bytes each; a prime. Of pairs that fall to one place the last stays.
MEMO_PAIRS = 524_287


class PrefixCoder:
    """Words to ids for one tokenizer file."""

    def __init__(self, raw: bytes):
        self.raw, self.table = raw, MergeTable(raw)
        t = self.table
        pre = t.spec["pre_tokenizer"]
        steps = pre.get("pretokenizers", [pre])
        pattern = next((s["pattern"]["Regex"] for s in steps if s["type"] == "Split"), GLUED)
        norm = t.spec.get("normalizer") or {}
        kinds = {n["type"] for n in norm.get("normalizers", [norm] if norm else [])}
        self.nfc, self.lower = "NFC" in kinds, "Lowercase" in kinds
        self.cutter = Cutter(pattern, t.special, self.normal if kinds else None)
        self.bare = pattern != GLUED
        self.memo = Memo(self.learn, most=MEMO_WORDS)
        self.to_symbol = {b: c for b, c in enumerate(t.alphabet)}
        self._right: dict[int, list[tuple[int, float]]] = {}
        self._left: dict[int, list[tuple[int, float]]] = {}
        self._fits = array("q", [-(1 << 62)]) * MEMO_PAIRS  # a pair, or what ~ makes of it if it doesn't fit

    @cached_property
    def normalizer(self):
        """The library's own, for characters that Python doesn't know yet."""
        from tokenizers import Tokenizer

        return Tokenizer.from_buffer(self.raw).normalizer

    def normal(self, piece: str) -> str:
        if not piece.isascii():
            if unknown_here(piece):
                return self.normalizer.normalize_str(piece)
            if self.nfc:
                piece = unicodedata.normalize("NFC", piece)
        return piece.replace("Σ", "σ").lower() if self.lower else piece

    @cached_property
    def matcher(self) -> ahocorasick.Automaton:
        """Made when a word is first encoded: workers that only decode go without."""
        t, out = self.table, ahocorasick.Automaton()
        symbol = {i: c for i, c in zip(t.byte_ids, t.alphabet)}
        if t.suffix:
            symbol |= {i: chr(ord(c) + _END) for i, c in zip(t.last_byte_ids, t.alphabet)}
        for token in t.vocab.values():
            s = "".join(symbol[b] for b in t.base(token))
            out.add_word(s, (token, len(s)))
        out.make_automaton()
        return out

    def _edge(self, token: int, side: int, known: dict) -> list[tuple[int, float]]:
        """The tokens at one edge of a token's merge tree, base first, each with the rank at which it is used up."""
        if token not in known:
            out, used, t = [], math.inf, token
            while True:
                out.append((t, used))
                if t not in self.table.made_of:
                    break
                used = self.table.made_of[t][2]
                t = self.table.made_of[t][side]
            known[token] = out[::-1]
        return known[token]

    def fits(self, a: int, b: int) -> bool:
        """Whether a then b stay two tokens: no merge across their border comes before both edges are used up."""
        pair = a << 32 | b
        place = pair % MEMO_PAIRS
        known = self._fits[place]
        if known == pair:
            return True
        if known == ~pair:
            return False
        left, right, i, j, found = self._edge(a, 1, self._right), self._edge(b, 0, self._left), 0, 0, True
        while True:
            (x, x_used), (y, y_used) = left[i], right[j]
            rank = self.table.pair_rank.get((x, y), (math.inf, 0))[0]
            if rank < x_used and rank <= y_used and rank < math.inf:
                found = False
                break
            if x_used == y_used == math.inf:
                break
            if x_used <= y_used:
                i += 1
            else:
                j += 1
        self._fits[place] = pair if found else ~pair
        return found

    def word_ids(self, word: str) -> list[int]:
        s = word.encode("utf-8", "surrogatepass").decode("latin-1").translate(self.to_symbol)
        if self.table.suffix:
            s = s[:-1] + chr(ord(s[-1]) + _END)
        last, back, fits = [-1] * (len(s) + 1), [0] * (len(s) + 1), self.fits
        for end, (token, size) in self.matcher.iter(s):
            end += 1
            if last[end] < 0:
                start = end - size
                before = last[start]
                if start == 0 or (before >= 0 and fits(before, token)):
                    last[end], back[end] = token, start
        ids, at = [], len(s)
        while at:
            ids.append(last[at])
            at = back[at]
        return ids[::-1]

    def learn(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        kind, special = classes(), self.table.special
        found = [[special[w]] if w in special else [] if self.bare and kind[ord(w[0])] == SPACE else self.word_ids(w) for w in words]
        return np.array([i for ids in found for i in ids], "<i4"), np.array([len(ids) for ids in found], np.int64)

    def packed(self, batch: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        values, sizes = encoded(self.cutter, self.memo, batch)
        whole, ends = values.tobytes(), (4 * np.cumsum(sizes)).tolist()
        return [whole[a:b] for a, b in zip([0, *ends], ends)]

    def text(self, ids: bytes) -> str:
        """What the library's decode gives with special tokens kept; ids that the file doesn't have are left out."""
        known, found = self.table.strings, np.frombuffer(ids, "<u4").tolist()
        try:
            tokens = list(map(known.__getitem__, found))
        except KeyError:
            tokens = [known[i] for i in found if i in known]
        kind = self.table.spec.get("decoder")
        if kind is None:
            return " ".join(tokens)
        if kind["type"] != "ByteLevel":
            raise ValueError(f"no decoder of the type {kind['type']}")
        to_byte = {c: b for b, c in self.to_symbol.items()}
        joined = "".join(tokens)
        return bytes(to_byte[c] for c in joined if c in to_byte).decode("utf-8", "replace") if all(c in to_byte for c in joined) else joined


_CODERS: dict[str, PrefixCoder] = {}


def coder(raw: bytes) -> PrefixCoder:
    """The worker's coder of a tokenizer file, made once per Python worker."""
    take("bpe_prefix", _CODERS.clear)
    hand_back_large()
    key = hashlib.sha1(raw).hexdigest()
    if key not in _CODERS:
        _CODERS[key] = PrefixCoder(raw)
    return _CODERS[key]


def _mapped(df: DataFrame, column: str, outs: dict[str, str], each) -> DataFrame:
    """Adds the columns `outs` (names to types), computed batch by batch from `column`."""
    kept = [c for c in df.columns if c != column and c not in outs]
    src = df.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{column}`").alias("__in__"))
    kinds = [pa.binary() if kind == "binary" else pa.string() for kind in outs.values()]

    def body(batches):
        for whole in batches:
            for batch in slices(whole, "__in__"):
                made = [pa.array(x, kind) for x, kind in zip(each(batch), kinds)]
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *made], names=[*kept, *outs])

    fields = [df.schema[c] for c in kept]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in fields] + [f"`{out}` {kind}" for out, kind in outs.items()])
    return src.mapInArrow(body, schema)


def encode(df: DataFrame, tokenizer_path: str, text_col: str = "text", out_col: str = "ids", decoded_col: str | None = None) -> DataFrame:
    """Replaces `text_col` by `out_col`: the ids as packed little-endian unsigned 32-bit integers.

    With `decoded_col` the ids are decoded in the same pass, as `decode` does in one of its own: then
    one Python worker a task is enough, and the ids go to it once."""
    raw = df.sparkSession.sparkContext.broadcast(read_tokenizer(tokenizer_path))

    def each(batch):
        own = coder(raw.value)
        ids = own.packed(texts(batch, "__in__"))
        return [ids, [own.text(i) for i in ids]] if decoded_col else [ids]

    return _mapped(df, text_col, {out_col: "binary"} | ({decoded_col: "string"} if decoded_col else {}), each)


def decode(df: DataFrame, tokenizer_path: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """Adds `out_col`, the decoded text of `ids_col` (null ids: the empty text), and keeps the ids."""
    raw = df.sparkSession.sparkContext.broadcast(read_tokenizer(tokenizer_path))

    def each(batch):
        own = coder(raw.value)
        return [[own.text(x or b"") for x in batch.column("__in__").to_pylist()]]

    return _mapped(df.withColumn("__ids__", F.col(ids_col)), "__ids__", {out_col: "string"}, each)
