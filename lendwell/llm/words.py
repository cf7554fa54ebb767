"""Words of many texts at once, as 64-bit hashes, with array operations instead of strings."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import lru_cache

import numpy as np

CHUNK_BYTES = 256 << 10
# An odd base of the polynomial and two odd factors that mix its value.
BASE = np.uint64(0x9E3779B97F4A7C15)
MIX_1, MIX_2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
SPACES = b" \t\n\x0b\x0c\r"


def byte_table(spaces: bytes) -> np.ndarray:
    """Lower case for A-Z; 0 for bytes that part words."""
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    table[list(spaces)] = 0
    return table


PLAIN = byte_table(SPACES + b"\x00")
# ASCII letters and digits, and all bytes of other characters, make words.
ALNUM = byte_table(bytes(c for c in range(128) if not chr(c).isalnum()))


@dataclass
class Words:
    hashes: np.ndarray  # of each word
    docs: np.ndarray  # the text each word is in, ascending
    counts: np.ndarray  # words of each text


@lru_cache(maxsize=1)
def powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    up = np.full(size, BASE, np.uint64)
    down = np.full(size, pow(int(BASE), -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down)


def mixed(values: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads their bits."""
    values = (values ^ (values >> np.uint64(30))) * MIX_1
    values = (values ^ (values >> np.uint64(27))) * MIX_2
    return values ^ (values >> np.uint64(31))


def words_of(texts: Sequence[str | None], table: np.ndarray = PLAIN) -> Words:
    """All words of the texts in order. A NUL byte stands for itself with the plain table."""
    raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    joined = np.frombuffer(b" ".join(raw) + b" ", np.uint8)
    low = table[joined]
    if table is PLAIN:
        low = low.copy()
        low[joined == 0] = 1
    letter = low != 0
    edges = np.flatnonzero(np.diff(letter.astype(np.int8), prepend=np.int8(0)))
    starts, ends = edges[0::2], edges[1::2]
    size = 1 << max(19, int(len(joined) + 1).bit_length())
    up, down = powers(size)
    sums = np.cumsum(low * up[: len(low)], dtype=np.uint64)
    sums = np.concatenate([np.zeros(1, np.uint64), sums])
    hashes = mixed((sums[ends] - sums[starts]) * down[starts])
    limits = np.cumsum([len(r) + 1 for r in raw])
    docs = np.searchsorted(limits, starts, side="right")
    return Words(hashes, docs, np.bincount(docs, minlength=len(raw)))


def combined(hashes: Sequence[np.ndarray]) -> np.ndarray:
    """One hash of several in order, elementwise."""
    out = np.zeros(len(hashes[0]), np.uint64)
    for part in hashes:
        out = mixed(out * BASE + part)
    return out


def shingles(words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the shingle that starts at each word but the last ones, and whether one text holds it."""
    count = len(words.hashes) - size + 1
    if count <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, bool)
    out = combined([words.hashes[i : i + count] for i in range(size)])
    return out, words.docs[:count] == words.docs[size - 1 :]
