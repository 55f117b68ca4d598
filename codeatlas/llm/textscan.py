"""Vectorised reading of words out of Arrow text columns, on UTF-8 bytes, for code that runs inside Spark tasks.

Words are runs of characters other than space and the controls 0x09-0x0D.  All of those are single bytes in UTF-8, so
cutting bytes cuts characters exactly.  A word is told by a 64-bit hash of its bytes: the sum of a random number per byte
value times a power of an odd base, which one running sum gives for all words of a slice at once.
"""

from __future__ import annotations

import ctypes
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SLICE_BYTES = 1 << 20
"""Bytes of text handled at once; a longer text is a slice of its own."""

BASE = 0x9E3779B97F4A7C15 | 1
SEED = 20240607

_state: dict = {}


def tables() -> dict:
    """Lookup tables by byte value: blank or not, lower case of A-Z, random numbers."""
    if not _state:
        blank = np.zeros(256, bool)
        blank[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
        lower = np.arange(256, dtype=np.uint8)
        lower[65:91] += 32
        rng = np.random.RandomState(SEED)
        noise = rng.randint(0, 1 << 32, 256, dtype=np.uint64) << np.uint64(32) | rng.randint(0, 1 << 32, 256, dtype=np.uint64)
        _state.update(blank=blank, lower=lower, noise=noise | np.uint64(1), powers=np.ones(1, np.uint64), inverses=np.ones(1, np.uint64))
    return _state


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base, and of its inverse, modulo 2**64."""
    t = tables()
    if len(t["powers"]) < n:
        size = max(n, SLICE_BYTES + 1024)
        for name, base in (("powers", BASE), ("inverses", pow(BASE, -1, 1 << 64))):
            factors = np.full(size, np.uint64(base), np.uint64)
            factors[0] = 1
            t[name] = np.cumprod(factors)
    return t["powers"][:n], t["inverses"][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64 bits that spreads every input bit (the splitmix finaliser)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts of an Arrow string array end to end, and where each begins (one more for the end); null is empty."""
    texts = texts.cast(pa.large_string())
    if texts.null_count:
        texts = texts.fill_null("")
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batches: Iterator[pa.RecordBatch], text: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut so that the texts of each piece have at most `limit` bytes, or are one text.  At the end the process gives
    its free memory back, as it waits for other tasks beside other processes."""
    for batch in batches:
        _, offsets = buffers(batch.column(batch.schema.get_field_index(text)))
        start, n = 0, len(offsets) - 1
        while start < n:
            end = max(start + 1, int(np.searchsorted(offsets, offsets[start] + limit, "right")) - 1)
            yield batch.slice(start, end - start)
            start = end
    release()


def release() -> None:
    """Give free memory back to the system, where the allocators can."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First byte and end of each word, and for each text the number of its first word (one more for the end)."""
    inside = ~tables()["blank"][data]
    edge = np.empty(len(data) + 1, bool)
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    cut = np.zeros(len(data) + 1, bool)
    cut[offsets[:-1]] = True  # a text ends the word of the text before it
    edge[0], edge[-1] = inside[0], False
    edge[1:-1] = inside[1:] & (~inside[:-1] | cut[1:-1])
    starts = np.flatnonzero(edge[:-1])
    edge[:-1] = False
    edge[-1] = inside[-1]
    edge[1:-1] = inside[:-1] & (~inside[1:] | cut[1:-1])
    ends = np.flatnonzero(edge)
    return starts, ends, np.searchsorted(starts, offsets)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each span."""
    up, down = powers(len(data) + 1)
    running = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(tables()["noise"][data] * up[:-1], out=running[1:])
    return mix((running[ends] - running[starts]) * down[starts] + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def owners(first: np.ndarray) -> np.ndarray:
    """For each word the text it is in, from the numbers of first words."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


def window_hashes(hashes: np.ndarray, first: np.ndarray, k: int, salt: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each run of k words that lies in one text, and the number of its first word."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    factor = np.uint64(BASE)
    total = np.full(n, np.uint64(salt), np.uint64)
    for i in range(k):
        total = mix(total * factor + hashes[i : i + n])
    left = np.repeat(first[1:], np.diff(first))[:n] - np.arange(n)  # words left in the text
    at = np.flatnonzero(left >= k)
    return total[at], at


def group_starts(keys: np.ndarray) -> np.ndarray:
    """Where each run of equal keys begins in a sorted array."""
    if not len(keys):
        return np.zeros(0, np.int64)
    return np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
