"""Elias-Fano sequences and an n-gram trie made of them.

A non-decreasing sequence keeps each number's low bits in a packed array and
its high bits in a bitmap, one set bit per number.  ``successor`` finds the
first number at or above a bound by one select in the bitmap and a short
search among the numbers that share the high bits.

In the trie a level holds, for all parents in a row, the sorted word ids of
their children, made monotone: the ids of a parent go on from the last number
of the parent before, so no base has to be stored, and a child is found by a
successor search relative to its context.  Pointers to where each parent's
children begin are one more monotone sequence.  A level may carry any number
of values per node, such as codes of quantised log probabilities and back-off
weights.  All arrays are plain files that are mapped into memory.
"""

from __future__ import annotations

import os

import numpy as np


#: Queries are worked off in runs that stay in the processor's cache.
RUN = 1 << 16


def _select_in_word(word: np.ndarray, left: np.ndarray) -> np.ndarray:
    """Position of the left-th set bit of each word."""
    place = np.zeros(len(word), np.int64)
    for width in (32, 16, 8, 4, 2, 1):
        low = word & np.uint64((1 << width) - 1)
        ones = np.bitwise_count(low).astype(np.int64)
        beyond = left >= ones
        left = left - ones * beyond
        place += width * beyond
        word = np.where(beyond, word >> np.uint64(width), low)
    return place


class EliasFano:
    """A non-decreasing sequence of non-negative integers below 2^62."""

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray, ones: np.ndarray):
        self.n, self.low_bits, self.low, self.high, self.ones = n, low_bits, low, high, ones
        self.zeros = np.arange(len(ones)) * 64 - ones

    @classmethod
    def build(cls, values: np.ndarray) -> EliasFano:
        values = values.astype(np.int64)
        n = len(values)
        top = int(values[-1]) + 1 if n else 1
        low_bits = max(0, (top // max(n, 1)).bit_length() - 1)
        low = np.zeros((n * low_bits + 63) // 64 + 2, np.uint64)
        if low_bits:
            part = (values & ((1 << low_bits) - 1)).astype(np.uint64)
            at = np.arange(n) * low_bits
            shift = (at & 63).astype(np.uint64)
            np.bitwise_or.at(low, at >> 6, part << shift)
            over = np.flatnonzero(shift + np.uint64(low_bits) > 64)
            np.bitwise_or.at(low, (at[over] >> 6) + 1, part[over] >> (np.uint64(64) - shift[over]))
        bitmap = np.zeros(-(-((top >> low_bits) + n + 2) // 64) * 64, np.uint8)
        bitmap[(values >> low_bits) + np.arange(n)] = 1
        high = np.packbits(bitmap, bitorder="little").view(np.uint64)
        ones = np.concatenate([[0], np.cumsum(np.bitwise_count(high).astype(np.int64))])
        return cls(n, low_bits, low, high, ones)

    def _low(self, index: np.ndarray) -> np.ndarray:
        if not self.low_bits:
            return np.zeros(len(index), np.int64)
        at = index * self.low_bits
        word, shift = at >> 6, (at & 63).astype(np.uint64)
        # the second shift in two steps, as one by 64 is not defined
        both = (self.low[word] >> shift) | ((self.low[word + 1] << np.uint64(1)) << (np.uint64(63) - shift))
        return (both & np.uint64((1 << self.low_bits) - 1)).astype(np.int64)

    def _select(self, index: np.ndarray) -> np.ndarray:
        """Position in the bitmap of the index-th set bit."""
        block = np.searchsorted(self.ones, index, side="right") - 1
        return block * 64 + _select_in_word(self.high[block], index - self.ones[block])

    def _upto(self, part: np.ndarray) -> np.ndarray:
        """How many numbers have high bits at most ``part``: the part-th clear bit stands behind them."""
        block = np.searchsorted(self.zeros, part, side="right") - 1
        inside = block < len(self.high)
        block = np.minimum(block, len(self.high) - 1)
        place = block * 64 + _select_in_word(~self.high[block], part - self.zeros[block])
        return np.where(inside & (part >= 0), place - part, np.where(part < 0, 0, self.n))

    def get(self, index: np.ndarray) -> np.ndarray:
        return ((self._select(index) - index) << self.low_bits) | self._low(index)

    def successor(self, bound: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """First index in [begin, end) whose number is at least ``bound``; ``end`` if none is."""
        out = np.empty(len(bound), np.int64)
        for at in range(0, len(bound), RUN):
            part = slice(at, at + RUN)
            out[part] = self._successor(bound[part], begin[part], end[part])
        return out

    def _successor(self, bound: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        part, rest = bound >> self.low_bits, bound & ((1 << self.low_bits) - 1)
        # only numbers with the bound's own high bits need their low bits looked at
        low = np.clip(self._upto(part - 1), begin, end)
        high = np.clip(self._upto(part), begin, end)
        alive = np.flatnonzero(low < high)
        while len(alive):
            middle = (low[alive] + high[alive]) >> 1
            less = self._low(middle) < rest[alive]
            low[alive[less]] = middle[less] + 1
            high[alive[~less]] = middle[~less]
            alive = alive[low[alive] < high[alive]]
        return low

    def save(self, folder: str, name: str) -> None:
        np.save(f"{folder}/{name}.low.npy", self.low)
        np.save(f"{folder}/{name}.high.npy", self.high)
        np.save(f"{folder}/{name}.ones.npy", self.ones)
        np.save(f"{folder}/{name}.size.npy", np.array([self.n, self.low_bits]))

    @classmethod
    def load(cls, folder: str, name: str) -> EliasFano:
        part = lambda x: np.load(f"{folder}/{name}.{x}.npy", mmap_mode="r")
        n, low_bits = part("size")
        return cls(int(n), int(low_bits), part("low"), part("high"), part("ones"))


class NgramTrie:
    """Sorted distinct n-grams, level by level; a node is a beginning of some n-gram."""

    def __init__(self, levels: list[tuple[EliasFano, EliasFano]], values: list[dict[str, np.ndarray]]):
        self.levels, self.values = levels, values

    @staticmethod
    def build(nodes: list[tuple[np.ndarray, np.ndarray]], values: list[dict[str, np.ndarray]], folder: str) -> None:
        """Writes the levels to ``folder``.

        ``nodes`` has for each level the parent (a node of the level above, 0
        on the first) and the word id of each node, in lexicographic order
        without repeats.  ``values`` are the named arrays of each level.
        """
        parents = 1
        for level, ((owner, words), named) in enumerate(zip(nodes, values)):
            pointers = np.searchsorted(owner, np.arange(parents + 1))
            # each parent's ids go on above the last one of the parent before
            last = np.zeros(parents, np.int64)
            filled = np.diff(pointers) > 0
            last[filled] = words[pointers[1:][filled] - 1] + 1
            base = np.concatenate([[0], np.cumsum(last)[:-1]])
            EliasFano.build(words + base[owner]).save(folder, f"{level}.words")
            EliasFano.build(pointers).save(folder, f"{level}.pointers")
            for name, array in named.items():
                np.save(f"{folder}/{level}.value.{name}.npy", array)
            parents = len(words)

    @classmethod
    def load(cls, folder: str) -> NgramTrie:
        levels, values = [], []
        while os.path.exists(f"{folder}/{len(levels)}.words.size.npy"):
            at = f"{len(levels)}."
            values.append({f[len(at) + 6 : -4]: np.load(f"{folder}/{f}", mmap_mode="r") for f in sorted(os.listdir(folder)) if f.startswith(f"{at}value.")})
            levels.append(tuple(EliasFano.load(folder, at + x) for x in ("words", "pointers")))
        return cls(levels, values)

    def children(self, level: int, parent: np.ndarray, word: np.ndarray) -> np.ndarray:
        """The node of ``level`` below each parent that has the word; -1 if there is none, or no parent (-1)."""
        out = np.full(len(parent), -1, np.int64)
        alive = np.flatnonzero(parent >= 0)
        words, pointers = self.levels[level]
        if not len(alive) or not words.n:
            return out
        # queries that follow each other often share their parent: it is looked up once
        above, same = np.unique(parent[alive], return_inverse=True)
        begin, end = pointers.get(above), pointers.get(above + 1)
        base = np.where(begin > 0, words.get(np.maximum(begin - 1, 0)) + 1, 0)
        begin, end, wanted = begin[same], end[same], base[same] + word[alive].astype(np.int64)
        at = words.successor(wanted, begin, end)
        found = at < end
        found[found] = words.get(at[found]) == wanted[found]
        out[alive[found]] = at[found]
        return out

    def find(self, grams: np.ndarray) -> np.ndarray:
        """The node of each n-gram on the level of its last word, -1 where the trie lacks it."""
        node = np.zeros(len(grams), np.int64)
        for level in range(grams.shape[1]):
            node = self.children(level, node, grams[:, level])
        return node


def level_nodes(grams: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Nodes for ``NgramTrie.build`` from sorted distinct n-grams of one order."""
    n, order = grams.shape
    parent, out = np.zeros(n, np.int64), []
    for level in range(order):
        new = np.ones(n, bool)
        new[1:] = (grams[1:, : level + 1] != grams[:-1, : level + 1]).any(axis=1)
        out.append((parent[new], grams[new, level].astype(np.int64)))
        parent = np.cumsum(new) - 1
    return out
