"""Words of tokenizer patterns, cut from whole batches of texts at once, and what is known of them.

All texts of a batch lie one after another as code points in a numpy array. A table gives each its
class (letter, number, white space, other); words begin where the class changes, but for the rules that
the two public patterns have for blanks, single numbers and contractions. Equal words are then met by
Arrow's dictionary encoding, so that Python sees each distinct word of a batch once.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

#: The patterns of the public tokenizer files. The first glues a blank to the word after it.
GLUED = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
BARE = r"""'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"""
OTHER, LETTER, NUMBER, SPACE = range(4)
#: Code points that are cut at once, about, and distinct words that a worker remembers.
GROUP_CHARS = 2_000_000
#: Code points whose classes are asked for at once.
CLASSES_AT_ONCE = 1 << 14
MEMO_WORDS = 800_000
#: A blank between two Latin letters: both patterns end a word there, so a long text can be parted.
_SEAM = re.compile(r"(?<=[A-Za-z]) (?=[A-Za-z])")


@lru_cache(1)
def classes() -> np.ndarray:
    """The class of every code point, as the tokenizers library has them: Unicode versions differ."""
    from tokenizers import Regex, normalizers

    out = np.zeros(0x110000, np.uint8)
    for kind, others in ((LETTER, r"[^\p{L}]+"), (NUMBER, r"[^\p{N}]+"), (SPACE, r"\S+")):
        only = normalizers.Replace(Regex(others), "")
        # the library keeps some 100 bytes for each code point that it is given at once
        for first in range(0, 0x110000, CLASSES_AT_ONCE):
            own = only.normalize_str("".join(chr(c) for c in range(first, first + CLASSES_AT_ONCE) if not 0xD800 <= c < 0xE000))
            out[np.frombuffer(own.encode("utf-32-le"), "<u4")] = kind
    return out


def special_split(specials: dict[str, int]):
    """Splits a text at special strings, longest first; odd places of the result are specials."""
    if not specials:
        return lambda text: [text]
    names = sorted(specials, key=len, reverse=True)
    cut = re.compile("(" + "|".join(map(re.escape, names)) + ")").split
    return lambda text: cut(text) if any(s in text for s in names) else [text]


def parted(text: str) -> list[str]:
    """A text as runs of about GROUP_CHARS code points that end at a seam, where there is one."""
    out, at = [], 0
    while len(text) - at > GROUP_CHARS and (seam := _SEAM.search(text, at + GROUP_CHARS)):
        out.append(text[at : seam.start()])
        at = seam.start()
    return [*out, text[at:]]


def glued_starts(cp: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Where the words of GLUED begin; `first` marks the first code point of each text, and the end."""
    kind, n = classes()[cp], len(cp)
    head, space = first[:n], kind == SPACE
    start = head.copy()
    start[1:] |= kind[1:] != kind[:-1]
    last = space & ~first[1:]  # the last of a run of white space, before something visible
    last[:-1] &= ~space[1:]
    start |= last
    start[1:] &= ~((cp[:-1] == 32) & ~space[1:]) | head[1:]
    mark_contractions(cp, first, start)
    return start


def bare_starts(cp: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Where the words of BARE begin, and white space between them, which stands for nothing."""
    kind = classes()[cp]
    start = first[: len(cp)].copy()
    start[1:] |= (kind[1:] != kind[:-1]) | (kind[1:] == NUMBER)
    mark_contractions(cp, first, start)
    return start


def mark_contractions(cp: np.ndarray, first: np.ndarray, start: np.ndarray) -> None:
    """An apostrophe at which a word begins takes s, t, m, d, re, ve or ll with it."""
    n = len(cp)
    at = np.flatnonzero(start & (cp == ord("'")))
    at = at[at + 1 < n]
    at = at[~first[at + 1]]
    a = cp[at + 1]
    b = np.where(first[at + 2], 0, cp[np.minimum(at + 2, n - 1)])
    one = np.isin(a, [*map(ord, "stmd")])
    two = (b == ord("e")) & ((a == ord("r")) | (a == ord("v"))) | (a == ord("l")) & (b == ord("l"))
    for hit, size in ((one, 2), (two, 3)):
        start[at[hit] + 1] = False
        after = at[hit] + size
        start[after[after < n]] = True


class Cutter:
    """Cuts texts into words: `groups` gives, for runs of pieces of texts, the distinct words, the word
    of each place, and where each text's places begin."""

    def __init__(self, pattern: str, specials: dict[str, int], normal: Callable[[str], str] | None = None):
        rules = {GLUED: glued_starts, BARE: bare_starts}
        if pattern not in rules:
            raise ValueError(f"no rules for the words of the pattern {pattern}")
        self.split, self.normal, self.starts = special_split(specials), normal, rules[pattern]

    def pieces(self, texts: list[str]) -> Iterator[tuple[int, str, bool]]:
        """row, piece and whether it is a special string."""
        for row, text in enumerate(texts):
            for k, piece in enumerate(self.split(text)):
                if k % 2:
                    yield row, piece, True
                else:
                    for part in parted(piece) if len(piece) > GROUP_CHARS else (piece,):
                        yield row, self.normal(part) if self.normal else part, False

    def groups(self, texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        held, size = [], 0
        for piece in self.pieces(texts):
            held.append(piece)
            size += len(piece[1])
            if size >= GROUP_CHARS:
                yield self.cut(held, len(texts))
                held, size = [], 0
        if held:
            yield self.cut(held, len(texts))

    def cut(self, pieces: list[tuple[int, str, bool]], rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        joined = "".join(p for _, p, _ in pieces)
        cp = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), "<u4")
        ends = np.cumsum([len(p) for _, p, _ in pieces])
        first = np.zeros(len(cp) + 2, bool)
        first[0] = first[len(cp)] = first[len(cp) + 1] = True
        first[ends] = True
        start = self.starts(cp, first[:-1]) if len(cp) else np.zeros(0, bool)
        for (_, piece, special), end in zip(pieces, ends.tolist()):
            if special:
                start[end - len(piece) + 1 : end] = False
        place = np.flatnonzero(start)
        offsets = np.r_[place, len(cp)]
        if not joined.isascii():
            width = 1 + (cp >= 0x80).astype(np.int8) + (cp >= 0x800) + (cp >= 0x10000)
            offsets = np.r_[0, np.cumsum(width, dtype=np.int64)][offsets]
        words = pa.StringArray.from_buffers(len(place), pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(joined.encode("utf-8", "surrogatepass")))
        coded = words.dictionary_encode()
        row_of = np.array([r for r, _, _ in pieces])
        cuts = np.searchsorted(place, np.r_[0, ends])  # the first word of each piece
        begin = cuts[np.searchsorted(row_of, np.arange(rows + 1))]
        return coded.dictionary.to_numpy(zero_copy_only=False), coded.indices.to_numpy(), begin


def gathered(values: np.ndarray, begins: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs of values, one after another, and where each ends."""
    ends = np.cumsum(sizes)
    at = np.repeat(begins - (ends - sizes), sizes)
    at += np.arange(len(at))
    return values[at], np.r_[0, ends]


class Memo:
    """Values of distinct words: `learn` is asked for runs of new ones and gives all their values and how many each has."""

    def __init__(self, learn: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], kind: str = "<i4", most: int = MEMO_WORDS):
        self.learn, self.kind, self.most = learn, kind, most
        self.clear()

    def clear(self) -> None:
        self.rows: dict[str, int] = {}
        self.values, self.sizes, self.begins = np.zeros(0, self.kind), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def of(self, words: np.ndarray) -> np.ndarray:
        """The place of each word in sizes and begins."""
        get = self.rows.get
        rows = np.fromiter((get(w, -1) for w in words), np.int64, len(words))
        new = np.flatnonzero(rows < 0)
        if len(new) and self.rows and len(self.rows) + len(new) > self.most:
            self.clear()
            return self.of(words)
        if len(new):
            rows[new] = np.arange(len(self.rows), len(self.rows) + len(new))
            asked = words[new].tolist()
            values, sizes = self.learn(asked)
            self.begins = np.r_[self.begins, len(self.values) + np.cumsum(sizes) - sizes]
            self.values, self.sizes = np.r_[self.values, values], np.r_[self.sizes, sizes]
            self.rows.update(zip(asked, rows[new].tolist()))
        return rows

    def all(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The values of words at these places, one after another, and where each word's end."""
        return gathered(self.values, self.begins[rows], self.sizes[rows])


def encoded(cutter: Cutter, memo: Memo, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The values of all words of the texts, one after another, and how many each text has."""
    parts, sizes = [], np.zeros(len(texts), np.int64)
    for words, places, begin in cutter.groups(texts):
        values, ends = memo.all(memo.of(words)[places])
        parts.append(values)
        sizes += np.diff(ends[begin])
    return np.concatenate(parts) if parts else np.zeros(0, memo.kind), sizes
