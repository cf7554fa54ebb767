"""Elias-Fano sequences and the n-gram trie built from them, in memory-mapped files.

A non-decreasing sequence keeps the low bits of each value packed and its high bits in unary;
a value is found among the few that share its high bits (successor search).
"""

from __future__ import annotations

import os

import numpy as np

WORD = np.uint64(64)
ONE = np.uint64(1)


def packed(values: np.ndarray, bits: int) -> np.ndarray:
    """Values of so many bits, one after the other, in 64-bit words."""
    words = np.zeros(len(values) * bits // 64 + 2, np.uint64)
    if not len(values) or not bits:
        return words
    at = np.arange(len(values), dtype=np.uint64) * np.uint64(bits)
    word, shift = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
    first = np.flatnonzero(np.diff(word, prepend=-1))
    words[word[first]] = np.add.reduceat(values << shift, first)
    over = shift + np.uint64(bits) > WORD
    # At most one value crosses each border between words.
    words[word[over] + 1] += values[over] >> (WORD - shift[over])
    return words


def unpacked(words: np.ndarray, at: np.ndarray, bits: int) -> np.ndarray:
    if not bits:
        return np.zeros(len(at), np.uint64)
    place = at.astype(np.uint64) * np.uint64(bits)
    word, shift = (place >> np.uint64(6)).astype(np.int64), place & np.uint64(63)
    low = words[word] >> shift
    high = np.where(shift > 0, words[word + 1] << ((WORD - shift) & np.uint64(63)), np.uint64(0))
    out = low | high
    return out if bits == 64 else out & ((ONE << np.uint64(bits)) - ONE)


class EliasFano:
    """A non-decreasing sequence of unsigned values, kept in two files."""

    def __init__(self, folder: str, name: str, values: np.ndarray, universe: int):
        self.size = len(values)
        self.bits = max(0, (max(universe, 1) // max(self.size, 1)).bit_length() - 1)
        highs = (values >> np.uint64(self.bits)).astype(np.int64) if self.bits < 64 else np.zeros(self.size, np.int64)
        self.buckets = int((universe - 1) >> self.bits) + 1 if universe > 0 else 1
        mask = (ONE << np.uint64(self.bits)) - ONE if self.bits < 64 else np.uint64(0xFFFFFFFFFFFFFFFF)
        unary = np.zeros(self.size + self.buckets + 1, bool)
        unary[highs + np.arange(self.size)] = True
        self.lows = mapped(folder, f"{name}.low", packed(values & mask, self.bits))
        self.highs = mapped(folder, f"{name}.high", np.packbits(unary))
        # Where each bucket of equal high bits begins, read from the unary part
        bits = np.unpackbits(self.highs, count=len(unary))
        zeros = np.flatnonzero(bits == 0)[: self.buckets + 1]
        self.starts = np.concatenate([[0], zeros - np.arange(len(zeros))])

    def high(self, at: np.ndarray) -> np.ndarray:
        return (np.searchsorted(self.starts, at, side="right") - 1).astype(np.uint64)

    def __getitem__(self, at: np.ndarray) -> np.ndarray:
        low = unpacked(self.lows, at, self.bits)
        return (self.high(at) << np.uint64(self.bits)) | low if self.bits < 64 else low

    def successor(self, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place of the first element not below each value, and whether it is equal."""
        bucket = (values >> np.uint64(self.bits)).astype(np.int64) if self.bits < 64 else np.zeros(len(values), np.int64)
        beyond = bucket >= self.buckets
        bucket = np.minimum(bucket, self.buckets - 1)
        mask = (ONE << np.uint64(self.bits)) - ONE if self.bits < 64 else np.uint64(0xFFFFFFFFFFFFFFFF)
        wanted = values & mask
        place = np.where(beyond, self.size, self.starts[bucket])
        end = np.where(beyond, self.size, self.starts[bucket + 1])
        equal = np.zeros(len(values), bool)
        # Elements that share the high bits: one by one in short buckets, by halves in long ones.
        low, high = place.copy(), end.copy()
        open_at = np.flatnonzero(low < high)
        while len(open_at):
            middle = (low[open_at] + high[open_at]) // 2
            below = unpacked(self.lows, middle, self.bits) < wanted[open_at]
            low[open_at] = np.where(below, middle + 1, low[open_at])
            high[open_at] = np.where(below, high[open_at], middle)
            open_at = open_at[low[open_at] < high[open_at]]
        inside = np.flatnonzero(low < end)
        equal[inside] = unpacked(self.lows, low[inside], self.bits) == wanted[inside]
        return low, equal

    def place(self, values: np.ndarray) -> np.ndarray:
        """Place of each value, -1 where it is not in the sequence."""
        at, equal = self.successor(values)
        return np.where(equal, at, -1)


def mapped(folder: str, name: str, values: np.ndarray) -> np.ndarray:
    """Values written to a file and mapped into memory."""
    path = os.path.join(folder, name)
    if not len(values):
        return values
    values.tofile(path)
    return np.memmap(path, values.dtype, "r")


class Trie:
    """Two levels: contexts, and under each its successors with a quantised value.

    Contexts and words are 64-bit hashes. Successors have the ids that the trie's own words
    have in order, shifted by their context, so the whole level is one sequence; pointers
    give the range of each context.
    """

    def __init__(self, folder: str, contexts: np.ndarray, words: np.ndarray, keys: np.ndarray, codes: np.ndarray):
        """Sorted contexts and words; sorted keys ``context place * words + word place``; their codes."""
        self.width = max(len(words), 1)
        universe = 1 << 64
        self.contexts = EliasFano(folder, "contexts", contexts, universe)
        self.words = EliasFano(folder, "words", words, universe)
        pointers = np.searchsorted(keys, np.arange(len(contexts) + 1, dtype=np.uint64) * np.uint64(self.width))
        self.pointers = EliasFano(folder, "pointers", pointers.astype(np.uint64), len(keys) + 1)
        self.successors = EliasFano(folder, "successors", keys, max(len(contexts), 1) * self.width)
        self.codes = mapped(folder, "codes", codes)

    def lookup(self, context: np.ndarray, word: np.ndarray) -> np.ndarray:
        """Codes of pairs, 0 where the trie does not have them."""
        out = np.zeros(len(context), self.codes.dtype)
        at, follower = self.contexts.place(context), self.words.place(word)
        known = np.flatnonzero((at >= 0) & (follower >= 0))
        if len(known):
            at = at[known].astype(np.int64)
            begin, end = self.pointers[at], self.pointers[at + 1]
            key = at.astype(np.uint64) * np.uint64(self.width) + follower[known].astype(np.uint64)
            place, equal = self.successors.successor(key)
            found = equal & (place >= begin.astype(np.int64)) & (place < end.astype(np.int64))
            out[known[found]] = self.codes[place[found]]
        return out
