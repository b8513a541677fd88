"""Reading of public tokenizer files: merges as number tables, special strings, and what Python's Unicode tables lack."""

from __future__ import annotations

import json
import unicodedata
from functools import lru_cache

import numpy as np


def read_tokenizer(path: str) -> bytes:
    """The file's bytes, read once on the driver (under 2 MB for the public files) to be broadcast."""
    with open(path, "rb") as f:
        return f.read()


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies.

    Printable Latin-1 bytes stand for themselves; the others follow from U+0100 in byte order."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class MergeTable:
    """A BPE vocabulary over base symbols: `pair_rank[(a, b)] = (rank, id of the merged token)`."""

    def __init__(self, raw: bytes):
        spec = json.loads(raw)
        self.spec, model = spec, spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix: str = model.get("end_of_word_suffix") or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.strings: dict[int, str] = {i: t for t, i in self.vocab.items()} | {i: t for t, i in self.special.items()}
        self.alphabet = byte_alphabet()
        self.byte_ids = [self.vocab[c] for c in self.alphabet]
        self.last_byte_ids = [self.vocab[c + self.suffix] for c in self.alphabet]
        self.pair_rank: dict[tuple[int, int], tuple[int, int]] = {}
        self.made_of: dict[int, tuple[int, int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            a, b, c = self.vocab[left], self.vocab[right], self.vocab[left + right]
            self.pair_rank[a, b] = (rank, c)
            self.made_of[c] = (a, b, rank)

    def base(self, token: int) -> list[int]:
        """The base symbols that a token is merged from."""
        out, todo = [], [token]
        while todo:
            t = todo.pop()
            if t in self.made_of:
                a, b, _ = self.made_of[t]
                todo += [b, a]
            else:
                out.append(t)
        return out


#: Combining marks whose order Python's tables and the library's normalizer disagree on.
REORDERED = (0x1DF6, 0x1E4EC, 0x1E4ED)


@lru_cache(1)
def unassigned() -> np.ndarray:
    """Whether Python's Unicode tables lack each code point, or order it otherwise."""
    return np.array([c in REORDERED or unicodedata.category(chr(c)) == "Cn" for c in range(0x110000)])


def unknown_here(text: str) -> bool:
    """Whether a text has characters that only the library normalizes as it does."""
    return bool(unassigned()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")].any())
