"""Shingle sets and similarity sketches of texts, inside Spark tasks."""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle

from codeatlas.llm.textscan import SLICE_BYTES, buffers, group_starts, mix, owners, slices, span_hashes, tables, window_hashes, words

cloudpickle.register_pickle_by_value(sys.modules[__name__])

HASH_BITS = 50
ROWS = 1 << (64 - HASH_BITS)
MASK = np.uint64((1 << HASH_BITS) - 1)


def shingle_sets(texts: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Text number and 50-bit hash of each distinct shingle of k words, sorted by both; a text of fewer words is one shingle."""
    data, offsets = buffers(texts)
    data = tables()["lower"][data]
    starts, ends, first = words(data, offsets)
    hashes = span_hashes(data, starts, ends)
    owner, lengths = owners(first), np.diff(first)
    found, at = window_hashes(hashes, first, k)
    keys = [owner[at].astype(np.uint64) << np.uint64(HASH_BITS) | found >> np.uint64(64 - HASH_BITS)]
    for n in range(1, k):
        short = np.flatnonzero(lengths == n)
        if len(short):
            total = np.full(len(short), np.uint64(n), np.uint64)
            for i in range(n):
                total = mix(total * np.uint64(31) + hashes[first[short] + i])
            keys.append(short.astype(np.uint64) << np.uint64(HASH_BITS) | total >> np.uint64(64 - HASH_BITS))
    key = np.sort(np.concatenate(keys))
    key = key[group_starts(key)]
    return (key >> np.uint64(HASH_BITS)).astype(np.int64), key & MASK


def similarity_sketches(owner: np.ndarray, hashes: np.ndarray, n: int, bins: int) -> np.ndarray:
    """(n, bins) sketches whose share of equal places estimates the Jaccard similarity.

    Each round throws every element of a set into one bin by a fresh hash, and a bin keeps its least value, earlier rounds
    being less than later ones.  After `bins` rounds of random bins, round bins + b throws all elements into bin b, so
    every bin of a set with an element is filled.  A set leaves once it has no empty bin.  Empty sets stay at the maximum.
    """
    empty = np.uint64(0xFFFFFFFFFFFFFFFF)
    out = np.full(n * bins, empty, np.uint64)
    live, element = owner, hashes
    for turn in range(2 * bins):
        if not len(live):
            break
        value = mix(element + np.uint64((turn + 1) * 0x9E3779B97F4A7C15 % (1 << 64)))
        if turn < bins:
            place = (value >> np.uint64(32)) * np.uint64(bins) >> np.uint64(32)
            np.minimum.at(out, live * bins + place.astype(np.int64), np.uint64(turn) << np.uint64(50) | value & MASK)
        else:
            starts = group_starts(live)
            least = np.minimum.reduceat(value & MASK, starts) | np.uint64(turn) << np.uint64(50)
            at = live[starts] * bins + (turn - bins)
            out[at] = np.minimum(out[at], least)
        if turn < 16 or turn % 8 == 7 or turn >= bins:
            sets = live[group_starts(live)]
            open_sets = sets[(out.reshape(n, bins)[sets] == empty).any(axis=1)]
            flag = np.zeros(n, bool)
            flag[open_sets] = True
            still = flag[live]
            live, element = live[still], element[still]
    return out.reshape(n, bins)


def sketch_rows(bands: int, rows: int, k: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """From (id, text) to (id, n, f1, f2, bands): size of the shingle set, 128 bits that tell the set, a key per band."""

    def run(batches):
        for part in slices(batches, "text", SLICE_BYTES):
            for at in range(0, part.num_rows, ROWS):
                batch = part.slice(at, ROWS)
                n = batch.num_rows
                owner, hashes = shingle_sets(batch.column(1), k)
                sizes = np.bincount(owner, minlength=n)
                prints = np.zeros((2, n), np.uint64)
                if len(owner):
                    starts = group_starts(owner)
                    for i, seed in enumerate((0x1234567, 0x89ABCDEF01)):
                        prints[i, owner[starts]] = np.add.reduceat(mix(hashes + np.uint64(seed)), starts)
                sketch = similarity_sketches(owner, hashes, n, bands * rows).reshape(n, bands, rows)
                keys = np.repeat(np.arange(1, bands + 1, dtype=np.uint64)[None, :], n, 0)
                for i in range(rows):
                    keys = mix(keys * np.uint64(0xD6E8FEB86659FD93 | 1) + sketch[:, :, i])
                flat = pa.array(keys.astype(np.uint64).view(np.int64).ravel())
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, n * bands + 1, bands, dtype=np.int32)), flat)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(sizes.astype(np.int64)), pa.array(prints[0].view(np.int64)), pa.array(prints[1].view(np.int64)), lists],
                    names=["id", "n", "f1", "f2", "bands"],
                )

    return run


def set_rows(k: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """From (id, text) to (id, shingles): the sorted hashes of the shingle set."""

    def run(batches):
        for part in slices(batches, "text", SLICE_BYTES):
            for at in range(0, part.num_rows, ROWS):
                batch = part.slice(at, ROWS)
                owner, hashes = shingle_sets(batch.column(1), k)
                ends = np.searchsorted(owner, np.arange(batch.num_rows + 1)).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(hashes.view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column(0), lists], names=["id", "shingles"])

    return run


def linked_in_block(percent: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """Links (a, b) between the asked sets and the members of one block, by counting shared shingles over an inverted list."""

    def run(frame):
        members, asked = frame[~frame.asked], frame[frame.asked]
        pairs = []
        if len(members) and len(asked):
            sets = [np.asarray(x, np.int64) for x in members.shingles]
            sizes = np.array([len(x) for x in sets])
            terms = np.concatenate(sets)
            order = np.argsort(terms, kind="stable")
            terms, holder = terms[order], np.repeat(np.arange(len(sets)), sizes)[order]
            ids, groups = members.id.to_numpy(), members.part.to_numpy()
            for mine, group, shingles in zip(asked.id, asked.part, asked.shingles):
                shingles = np.asarray(shingles, np.int64)
                low, high = np.searchsorted(terms, shingles, "left"), np.searchsorted(terms, shingles, "right")
                count = high - low
                place = np.repeat(low - np.concatenate(([0], np.cumsum(count)[:-1])), count) + np.arange(count.sum())
                shared = np.bincount(holder[place], minlength=len(sets))
                hit = (100 * shared >= percent * (sizes + len(shingles) - shared)) & (groups != group)
                pairs += [(mine, other) for other in ids[hit]]
        return pd.DataFrame(pairs, columns=["a", "b"], dtype="int64")

    return run
