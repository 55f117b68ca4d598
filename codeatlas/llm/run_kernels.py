"""Runs of periodic word sequences, inside Spark tasks: suffix array, wavelet tree and range successors on whole arrays."""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle

from codeatlas.llm.textscan import buffers, group_starts, mix, owners, slices, span_hashes, words

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def substring_ranks(keys: np.ndarray) -> list[np.ndarray]:
    """For k = 0, 1, ... the rank of the substring of 2**k keys that starts at each place: how many such substrings are smaller.

    Doubling ends with the first k where no substring repeats; these ranks are the last ones, and order all suffixes.
    Only substrings that still repeat are sorted again.
    """
    n = len(keys)
    order = np.argsort(keys, kind="stable")
    heads = group_starts(keys[order])
    sizes = np.diff(np.concatenate((heads, [n])))
    rank = np.empty(n, np.int32)
    rank[order] = np.repeat(heads, sizes)
    ranks, width = [rank], 1
    open_ = order[np.repeat(sizes > 1, sizes)]  # places whose substring repeats, in order of their ranks
    while len(open_):
        old = rank[open_].astype(np.int64)
        behind = open_ + width
        second = np.where(behind < n, rank[np.minimum(behind, n - 1)].astype(np.int64) + 1, 0)
        order = np.argsort(old * (n + 1) + second, kind="stable")
        open_, old, second = open_[order], old[order], second[order]
        group = group_starts(old)
        new = np.concatenate(([True], (old[1:] != old[:-1]) | (second[1:] != second[:-1])))
        heads = np.flatnonzero(new)
        base = np.repeat(group, np.diff(np.concatenate((group, [len(old)]))))  # where the former group begins
        sizes = np.diff(np.concatenate((heads, [len(old)])))
        rank = rank.copy()
        rank[open_] = np.repeat((old + np.arange(len(old)) - base)[heads], sizes)
        ranks.append(rank)
        open_ = open_[np.repeat(sizes > 1, sizes)]
        width *= 2
    return ranks


class WaveletTree:
    """Values below 2**bits, bit by bit from the highest, as packed bits with counts: 1/5 byte a value and bit."""

    def __init__(self, values: np.ndarray, bits: int):
        self.length, self.levels, self.bits = len(values), [], bits
        for b in range(bits - 1, -1, -1):
            ones = (values >> b) & 1 == 1
            packed = np.packbits(ones, bitorder="little")
            packed = np.concatenate((packed, np.zeros(-len(packed) % 8 + 8, np.uint8))).view(np.uint64)
            before = np.concatenate(([0], np.cumsum(np.bitwise_count(packed), dtype=np.int64)[:-1]))
            self.levels.append((b, packed, before, self.length - int(ones.sum())))
            values = np.concatenate((values[~ones], values[ones]))

    @staticmethod
    def _ones(packed: np.ndarray, before: np.ndarray, at: np.ndarray) -> np.ndarray:
        word = at >> 6
        mask = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return before[word] + np.bitwise_count(packed[word] & mask)

    def below(self, low: np.ndarray, high: np.ndarray, bound: np.ndarray) -> np.ndarray:
        """How many values at places low..high-1 are less than `bound`."""
        total = np.zeros(len(low), np.int64)
        for b, packed, before, zeros in self.levels:
            one_low, one_high = self._ones(packed, before, low), self._ones(packed, before, high)
            right = (bound >> b) & 1 == 1
            total += np.where(right, (high - low) - (one_high - one_low), 0)
            low, high = np.where(right, zeros + one_low, low - one_low), np.where(right, zeros + one_high, high - one_high)
        return total

    def nth(self, low: np.ndarray, high: np.ndarray, n: np.ndarray) -> np.ndarray:
        """The value at places low..high-1 that has n smaller ones there."""
        value, n = np.zeros(len(low), np.int64), n.copy()
        for b, packed, before, zeros in self.levels:
            one_low, one_high = self._ones(packed, before, low), self._ones(packed, before, high)
            left = (high - low) - (one_high - one_low)
            right = n >= left
            n -= np.where(right, left, 0)
            value |= np.where(right, 1 << b, 0)
            low, high = np.where(right, zeros + one_low, low - one_low), np.where(right, zeros + one_high, high - one_high)
        return value


def _extend(ranks: list[np.ndarray], a: np.ndarray, b: np.ndarray, back: bool) -> np.ndarray:
    """How far the keys from places a and b on agree (with `back`: those before them), a < b."""
    n, a, b, total = len(ranks[0]), a.copy(), b.copy(), np.zeros(len(a), np.int64)
    for k in range(len(ranks) - 2, -1, -1):  # at the last level nothing repeats, so all lengths are below 2**it
        width = 1 << k
        if back:
            fits = a >= width
            left, right = np.where(fits, a - width, 0), np.where(fits, b - width, 0)
        else:
            fits = b + width <= n
            left, right = np.where(fits, a, 0), np.where(fits, b, 0)
        step = np.where(fits & (ranks[k][left] == ranks[k][right]), width, 0)
        total += step
        a, b = (a - step, b - step) if back else (a + step, b + step)
    return total


def periodic_runs(keys: np.ndarray, first: np.ndarray, least: int = 6, times: int = 4) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, start, length, period) of every run of each text, by text, start and period; `first` has the texts' first words.

    A run of period q has at least `times` (4 or more) periods and `least` (6 or more) words, and neither neighbour continues it.  `keys` of
    different texts differ.

    Let B be the largest power of two up to 2q.  Of the blocks of B words at multiples of B, one lies in the run with q words of
    the run behind or before it, and occurs there again.  Occurrences of a block of B words in the window of B
    words next to it form one arithmetic progression, whose difference is the block's least period; as B > q, it is q.  So
    the successor and the predecessor of each block among its occurrences give all candidates, in a number of queries that is linear.  A block's
    occurrences are an interval of the suffix array, and the wavelet tree over that array finds both.
    """
    none = np.zeros(0, np.int64)
    if len(keys) < least:
        return none, none, none, none
    ranks = substring_ranks(keys)
    owner = owners(first)
    begin = first[:-1][owner]
    local = np.arange(len(keys)) - begin
    left = first[1:][owner] - np.arange(len(keys))
    asked, low, high, level = [], [], [], []
    for k in range(1, len(ranks) - 1):
        width = 1 << k
        at = np.flatnonzero((local & (width - 1) == 0) & (left >= width))
        if not len(at):
            break
        count = np.bincount(ranks[k], minlength=len(keys))[ranks[k][at]]
        at, count = at[count >= 2], count[count >= 2]
        asked.append(at)
        low.append(ranks[k][at].astype(np.int64))
        high.append(ranks[k][at] + count)
        level.append(np.full(len(at), width))
    if not sum(map(len, asked)):
        return none, none, none, none
    asked, low, high, width = (np.concatenate(x) for x in (asked, low, high, level))
    suffixes = np.empty(len(keys), np.int64)
    suffixes[ranks[-1]] = local  # an interval holds places of one text
    tree = WaveletTree(suffixes, max(1, int(local.max()).bit_length()))
    smaller = tree.below(low, high, local[asked])
    found = []
    for shift in (1, -1):
        there = np.flatnonzero((smaller + shift >= 0) & (smaller + shift < high - low))
        other = begin[asked[there]] + tree.nth(low[there], high[there], smaller[there] + shift)
        gap = (other - asked[there]) * shift
        fits = (2 * gap >= width[there]) & (gap < width[there])
        found.append((np.minimum(asked[there], other)[fits], gap[fits]))
    place, period = (np.concatenate(x) for x in zip(*found))
    if not len(place):
        return none, none, none, none
    start = place - _extend(ranks, place, place + period, back=True)
    stop = place + period + _extend(ranks, place, place + period, back=False)
    runs = np.stack((start, period, stop - start), 1)[stop - start >= np.maximum(least, times * period)]
    runs = np.unique(runs, axis=0)  # in order of start (so of text), period
    start, period, length = runs.T
    text = owner[start]
    return text, start - first[text], length, period


def collapsed_rows(least: int, times: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """From (key, text) to (key, n_words, runs, collapsed)."""

    def run(batches):
        for batch in slices(batches, "text"):
            data, offsets = buffers(batch.column(1))
            starts, ends, first = words(data, offsets)
            n = len(first) - 1
            keys = mix(span_hashes(data, starts, ends) + mix(owners(first).astype(np.uint64) + np.uint64(1)))
            text, start, length, period = periodic_runs(keys, first, least, times)
            # A word goes where more runs have covered it, past their first periods, than have ended.
            cover = np.zeros(len(keys) + 1, np.int64)
            np.add.at(cover, first[text] + start + period, 1)
            np.add.at(cover, first[text] + start + length, -1)
            kept = np.flatnonzero(np.cumsum(cover[:-1]) == 0)
            flat = data.tobytes()
            parts = [flat[s:e] for s, e in zip(starts[kept].tolist(), ends[kept].tolist())]
            cuts = np.searchsorted(kept, first)
            collapsed = [b" ".join(parts[a:b]).decode() for a, b in zip(cuts.tolist(), cuts[1:].tolist())]
            runs = pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in (start, length, period)], names=["start", "length", "period"])
            lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(text, np.arange(n + 1)), pa.int32()), runs)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(first), pa.int64()), lists, pa.array(collapsed, pa.string())], names=["key", "n_words", "runs", "collapsed"])

    return run
