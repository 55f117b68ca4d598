"""Overlap of texts as sets of words, told in the memory of tasks that hold all targets; `sessions` deals them out."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_ROWS = 200_000  # rows handed back at a time
PAIRS = "q long, t long, hits long, `all` long"


def _lists(batches: list[pa.RecordBatch], name: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids, lengths and words, one after the other, of the rows that have such an id."""
    told = [batch.filter(pc.is_valid(batch.column(name))) for batch in batches]
    join = lambda arrays: np.concatenate([x.to_numpy(zero_copy_only=False).astype(np.int64) for x in arrays] or [np.empty(0, np.int64)])
    return join([x.column(name) for x in told]), join([pc.list_value_length(x.column("words")) for x in told]), join([x.column("words").flatten() for x in told])


def best(batches: Iterator[pa.RecordBatch], n: int, least: float) -> Iterator[pa.RecordBatch]:
    """The rows of `PAIRS` that can be among the best `n` of a question (q, words) with a score of `least` and more.

    `hits` is how many of its words a target (t, words) has, repeats counted, and `all` how many different words both have.  Where the n-th best
    is shared by several targets, or by what rounding to six digits makes of it, all of them are told.
    """
    held = list(batches)
    (t, sizes, words), (q, lengths, asked) = _lists(held, "t"), _lists(held, "q")
    held.clear()
    known, word = np.unique(words, return_inverse=True)
    order = np.argsort(word, kind="stable")
    has = np.repeat(np.arange(len(t), dtype=np.int32), sizes)[order]
    bounds = np.concatenate(([0], np.cumsum(np.bincount(word, minlength=len(known)))))
    ends, kept, rows = np.cumsum(lengths), [], 0
    for i, end in enumerate(ends):
        own, times = np.unique(asked[end - lengths[i] : end], return_counts=True)
        at = np.searchsorted(known, own)
        found = np.flatnonzero(known[np.minimum(at, len(known) - 1)] == own) if len(known) else []
        if not len(found):
            continue
        lists = [has[bounds[p] : bounds[p + 1]] for p in at[found]]
        targets = np.concatenate(lists)
        shared = np.bincount(targets, minlength=len(t))
        hits = shared
        if (times[found] > 1).any():
            hits = np.bincount(targets, weights=np.repeat(times[found], [len(x) for x in lists]), minlength=len(t))
        together = len(own) + sizes - shared
        score = hits / together
        able = np.flatnonzero((score >= least - 1e-6) & (shared > 0))
        if len(able) > n:
            able = able[score[able] >= np.partition(score[able], -n)[-n] - 2e-6]
        kept.append((np.full(len(able), q[i]), t[able], hits[able].astype(np.int64), together[able]))
        rows += len(able)
        if rows >= _ROWS or i == len(ends) - 1:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*kept)], names=["q", "t", "hits", "all"])
            kept, rows = [], 0
    if kept:
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*kept)], names=["q", "t", "hits", "all"])
