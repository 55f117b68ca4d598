"""Distinct words of a slice of texts and the features of their spelling, inside Spark tasks and in training."""

from __future__ import annotations

import sys

import numpy as np
from pyspark import cloudpickle

from codeatlas.llm.textscan import group_starts, mix, owners, span_hashes, tables, words

cloudpickle.register_pickle_by_value(sys.modules[__name__])

GRAMS = 4
"""Longest run of bytes that is a feature; the blank put before and after a word makes affixes of the runs at its ends."""


def fold(data: np.ndarray) -> np.ndarray:
    """A-Z and the two-byte capitals of Latin-1 in lower case."""
    low = tables()["lower"][data]
    if len(low) > 1:
        second = low[1:]
        capital = (low[:-1] == 0xC3) & (second >= 0x80) & (second <= 0x9E) & (second != 0x97)
        low[1:][capital] += 32
    return low


class Words:
    """Words of a slice: for each occurrence its text and its distinct word; for each distinct word hash and spelling."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        low = fold(data)
        starts, ends, self.first = words(low, offsets)
        hashes = span_hashes(low, starts, ends)
        self.hashes, where, self.which = np.unique(hashes, return_index=True, return_inverse=True)
        self.owner = owners(self.first)
        sizes = (ends - starts)[where]
        self.places = np.concatenate(([0], np.cumsum(sizes + 2)))
        self.spelled = np.full(self.places[-1], 0x20, np.uint8)
        inner = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        self.spelled[np.repeat(self.places[:-1] + 1, sizes) + inner] = low[np.repeat(starts[where], sizes) + inner]
        letter = (self.spelled >= 0x80) | ((self.spelled >= 97) & (self.spelled <= 122))
        self.has_letter = np.logical_or.reduceat(letter, self.places[:-1]) if len(sizes) else np.zeros(0, bool)
        self.has_ascii = np.logical_or.reduceat(letter & (self.spelled < 0x80), self.places[:-1]) if len(sizes) else np.zeros(0, bool)

    def grams(self, buckets: int):
        """For each length of run the bucket of the run that begins at each byte of the spellings; `buckets` where it would
        leave its word."""
        left = np.repeat(self.places[1:], np.diff(self.places)) - np.arange(len(self.spelled))
        code = np.zeros(len(self.spelled), np.uint64)
        for n in range(1, GRAMS + 1):
            code = code * np.uint64(257)
            code[: len(code) - n + 1] += self.spelled[n - 1 :].astype(np.uint64) + np.uint64(1)
            place = (mix(code + np.uint64(n)) >> np.uint64(40)) % np.uint64(buckets)
            yield np.where(left >= n, place.astype(np.int64), buckets)

    def sums(self, weights: np.ndarray) -> np.ndarray:
        """Sum of the rows of `weights` (one more than there are buckets, the last all zero) over the runs of each distinct word."""
        out = np.zeros((len(self.hashes), weights.shape[1]), weights.dtype)
        if len(self.hashes):
            for place in self.grams(len(weights) - 1):
                out += np.add.reduceat(weights[place], self.places[:-1], axis=0)
        return out

    def lists(self, buckets: int) -> tuple[np.ndarray, np.ndarray]:
        """All runs of all distinct words: their buckets, and where each word's begin."""
        owner = np.repeat(np.arange(len(self.hashes)), np.diff(self.places))
        all_places = np.concatenate(list(self.grams(buckets)))
        who = np.tile(owner, GRAMS)
        who, all_places = who[all_places < buckets], all_places[all_places < buckets]
        order = np.argsort(who, kind="stable")
        return all_places[order], np.searchsorted(who[order], np.arange(len(self.hashes) + 1))


def pick(lists: np.ndarray, begin: np.ndarray, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The lists of the chosen rows end to end, and the row (by its place in `chosen`) of each element."""
    count = begin[chosen + 1] - begin[chosen]
    inner = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    return lists[np.repeat(begin[chosen], count) + inner], np.repeat(np.arange(len(chosen)), count)


def find(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Place of each key in a sorted table, -1 where it is missing."""
    if not len(table):
        return np.full(len(keys), -1)
    at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return np.where(table[at] == keys, at, -1)


def document_counts(owner: np.ndarray, which: np.ndarray, n: int) -> np.ndarray:
    """Number of texts that hold each of n distinct words."""
    pairs = np.sort(owner.astype(np.int64) * n + which)
    return np.bincount(pairs[group_starts(pairs)] % n, minlength=n)
