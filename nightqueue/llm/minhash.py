"""MinHash near-duplicates: fast similarity sketching, banding, and links confirmed on whole shingle sets.

A sketch has `size` coordinates. In round i every shingle is thrown into one of the bins by a hash of the
round; a bin keeps the smallest hash of the first round in which anything falls to it. After `size` rounds
bin j gets, in round size + j, the smallest hash of all shingles, so that each coordinate fills for every
set that isn't empty. Coordinates of two sets agree with the probability of their Jaccard similarity, and
as in one round bins are drawn without replacement, agreement is as concentrated as with independent ones.

`rows` coordinates make a band; texts that share a band meet. Of two texts at a similarity of 0.85, with
32 bands of 5, all but 7 in 10^9 meet; at 0.5, 64 of 100. Texts that meet are checked on their whole sets
by the rounds of `simhash.linked_texts`: no pair links by an estimate, and no group is expanded into all
of its pairs. Equal sets are one node.

Texts without words, empty and null ones have no shingles, link with nothing and are their own component;
texts of fewer words than a shingle have their whole sequence as one. Rows without an id have no component
and aren't kept. Rows with equal texts, whatever their ids, share a component; rows that share an id but not
a text keep the component of their text. An empty table gives no rows; other columns don't matter.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F

from .simhash import identified, linked_texts

#: Bits of a coordinate that hold a hash; the round stands above them.
HASH_BITS = np.uint64(54)
#: Hashes that are made at a time.
AT_ONCE = 4096
NONE = ~np.uint64(0)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose bits all depend on all bits of x."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def round_hashes(values: np.ndarray, rounds: np.ndarray) -> np.ndarray:
    """A row for each round: hashes of all values."""
    keys = mixed((rounds.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))
    return mixed(values[None, :] ^ keys[:, None])


def sketch(values: np.ndarray, size: int) -> np.ndarray:
    """`size` coordinates (unsigned) of a set of distinct hashes that isn't empty."""
    values, out = values.view(np.uint64), np.full(size, NONE)
    step, i = max(1, AT_ONCE // len(values)), 0
    while i < size and (out == NONE).any():
        rounds = np.arange(i, min(size, i + step))
        h = round_hashes(values, rounds)
        bins = (h >> np.uint64(40)) * np.uint64(size) >> np.uint64(24)
        own = rounds.astype(np.uint64)[:, None] << HASH_BITS | mixed(h) >> (np.uint64(64) - HASH_BITS)
        np.minimum.at(out, bins.ravel().astype(np.int64), own.ravel())
        i += step
    for j in np.flatnonzero(out == NONE):
        h = round_hashes(values, np.array([size + j]))
        out[j] = np.uint64(size + j) << HASH_BITS | mixed(h).min() >> (np.uint64(64) - HASH_BITS)
    return out


def bands(values: np.ndarray, size: int, rows: int) -> np.ndarray:
    """A number for each band of a set's sketch; none for the empty set."""
    if not len(values):
        return np.zeros(0, np.int64)
    each = sketch(values, size).reshape(-1, rows)
    out = mixed(np.arange(1, len(each) + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    for k in range(rows):
        out = mixed(out ^ each[:, k])
    return out.view(np.int64)


def near_documents(df: DataFrame, words: int = 5, similarity: float = 0.85, size: int = 160, rows: int = 5, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """id, n_shingles (distinct), component (smallest id reachable over links), kept: one row per row of df.

    `size` is a multiple of `rows`; `how` goes to `linked_texts`, and doesn't change the result."""
    found = linked_texts(identified(df, id_col, text_col), lambda v: bands(v, size, rows), words, similarity, **how)
    component = F.when(F.col("n") == 0, F.col("id")).otherwise(F.col("component"))
    return found.select("id", F.col("n").cast("long").alias("n_shingles"), component.alias("component"), F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"))
