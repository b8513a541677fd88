"""Token counts by rank-synchronous merging of ragged numpy arrays.

All new words of a batch lie one after another in a flat array of token ids. In each round every
word finds the lowest rank among its adjacent pairs, and all words merge all places of their pair
at once (a run of equal symbols pairs up from its left). Words without a pair leave; what is left
of each is its count. Counts of words met before come from a bounded memo.

Null text counts as empty: 0 bytes, 0 tokens. Empty tables give empty results. Input columns named
like an output column are replaced; all others but the text are kept.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .arrow_rows import slices, texts
from .memos import take
from .vocab import MergeTable, read_tokenizer
from .words import GLUED, Cutter, Memo, encoded

#: New words that are merged at a time.
RUN = 50_000
NONE = np.iinfo(np.int64).max


class RankMerger:
    def __init__(self, raw: bytes):
        table = MergeTable(raw)
        self.special = table.special
        self.cutter, self.memo = Cutter(GLUED, table.special), Memo(self.learn)
        self.base = np.array(table.byte_ids, np.int64)
        self.width = max(table.vocab.values()) + 1
        keys = np.array([a * self.width + b for a, b in table.pair_rank], np.int64)
        ranks = np.array([r for r, _ in table.pair_rank.values()], np.int64)
        order = np.argsort(keys)
        self.keys, self.ranks = keys[order], ranks[order]
        self.merged = np.zeros(len(ranks), np.int64)
        for rank, token in table.pair_rank.values():
            self.merged[rank] = token

    def pair_ranks(self, ids: np.ndarray, same: np.ndarray) -> np.ndarray:
        """The rank of each symbol with the next one of its word; NONE where there is no such merge."""
        key = ids[:-1] * self.width + ids[1:]
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(same & (self.keys[at] == key), self.ranks[at], NONE)

    def counts(self, words: list[bytes]) -> np.ndarray:
        """The number of tokens of each word, none of them empty."""
        sizes = np.array([len(w) for w in words], np.int64)
        ids = self.base[np.frombuffer(b"".join(words), np.uint8)]
        owner = np.repeat(np.arange(len(words)), sizes)
        out = sizes.copy()
        while len(ids) > 1:
            ranks = self.pair_ranks(ids, owner[:-1] == owner[1:])
            heads = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            lowest = np.minimum.reduceat(np.r_[ranks, NONE], heads)
            live = lowest < NONE
            if not live.any():
                break
            each = np.diff(np.r_[heads, len(ids)])
            hit = np.r_[ranks == np.repeat(lowest, each)[:-1], False] & np.repeat(live, each)
            # in a run of hits that follow each other, every second one merges, from the left
            place = np.flatnonzero(hit)
            first = np.r_[True, place[1:] != place[:-1] + 1]
            run = np.maximum.accumulate(np.where(first, np.arange(len(place)), 0))
            place = place[(np.arange(len(place)) - run) % 2 == 0]
            ids[place] = self.merged[ranks[place]]
            keep = np.repeat(live, each)
            keep[place + 1] = False
            np.subtract.at(out, owner[place], 1)
            ids, owner = ids[keep], owner[keep]
        return out

    def learn(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = [self.counts([w.encode("utf-8", "surrogatepass") for w in words[i : i + RUN]]) for i in range(0, len(words), RUN)]
        values = np.concatenate(found).astype(np.int32)
        values[[i for i, w in enumerate(words) if w in self.special]] = 1
        return values, np.ones(len(words), np.int64)

    def tokens(self, batch: list[str]) -> np.ndarray:
        counts, words = encoded(self.cutter, self.memo, batch)
        before = np.r_[0, np.cumsum(counts, dtype=np.int64)]
        ends = np.cumsum(words)
        return before[ends] - before[ends - words]


_MERGERS: dict[str, RankMerger] = {}


def merger(raw: bytes) -> RankMerger:
    take("token_count", _MERGERS.clear)
    key = hashlib.sha1(raw).hexdigest()
    if key not in _MERGERS:
        _MERGERS[key] = RankMerger(raw)
    return _MERGERS[key]


def count_tokens(df: DataFrame, tokenizer_path: str, text_col: str = "text", limit: int = 1024) -> DataFrame:
    """Replaces the text by n_bytes, n_tokens and over_limit (n_tokens above `limit`)."""
    made = ("n_bytes", "n_tokens", "over_limit")
    kept = [c for c in df.columns if c != text_col and c not in made]
    raw = df.sparkSession.sparkContext.broadcast(read_tokenizer(tokenizer_path))

    def body(batches):
        own = merger(raw.value)
        for whole in batches:
            for batch in slices(whole, "__in__"):
                n = pa.array(own.tokens(texts(batch, "__in__")))
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), batch.column("__bytes__"), n], names=[*kept, "n_bytes", "n_tokens"])

    text = F.coalesce(F.col(text_col), F.lit(""))
    src = df.select(*[F.col(f"`{c}`") for c in kept], text.alias("__in__"), F.octet_length(text).cast("long").alias("__bytes__"))
    schema = ", ".join([f"`{df.schema[c].name}` {df.schema[c].dataType.simpleString()}" for c in kept] + ["n_bytes long", "n_tokens long"])
    return src.mapInArrow(body, schema).withColumn("over_limit", F.col("n_tokens") > limit)
