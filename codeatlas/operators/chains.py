"""Chains of callers, walked in the memory of tasks that hold all steps; `reach` deals the steps and the names to them."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_CELLS = 32_000_000  # names times roots that are walked together
_STEPS = 4_000_000  # steps taken at a time
_ROWS = 200_000  # rows handed back at a time

CHAIN = "repo string, root string, name string, parent string, branch string, depth int, file string, line int, language string"
ROOTS = "repo string, root string, name string, file string, line int, upstream long"


def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Steps (a, b, info) as rows of bytes: many steps travel as one row."""
    for batch in batches:
        a, b, info = (batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(3))
        yield pa.RecordBatch.from_arrays([pa.array([((a << 32) | b).tobytes()], pa.binary()), pa.array([info.astype(np.int32).tobytes()], pa.binary())], names=["steps", "infos"])


class _Held:
    """What a task has been dealt: from `bounds[a]` on, `to` has the callers of name a and `info` the number of what is told of the step."""

    def __init__(self, batches: Iterator[pa.RecordBatch], n: int):
        steps, infos, names, told, roots = [], [], [], [], []
        for batch in batches:
            for column, to in (("steps", steps), ("num", names), ("info", told), ("root", roots)):
                rows = batch.filter(pc.is_valid(batch.column(column)))
                if rows.num_rows == 0:
                    continue
                if to is steps:
                    steps.extend(np.frombuffer(x.as_buffer(), np.int64) for x in rows.column("steps"))
                    infos.extend(np.frombuffer(x.as_buffer(), np.int32) for x in rows.column("infos"))
                else:
                    to.append(rows.select({"num": ["num", "repo", "name"], "info": ["info", "file", "line", "language"], "root": ["root"]}[column]))
        key = np.concatenate(steps) if steps else np.empty(0, np.int64)
        steps.clear()
        order = np.argsort(key, kind="stable")
        self.info = (np.concatenate(infos) if infos else np.empty(0, np.int32))[order]
        infos.clear()
        key = key[order]
        self.n = n
        self.bounds = np.searchsorted(key, np.arange(n + 1, dtype=np.int64) << 32)
        self.to = (key & 0xFFFFFFFF).astype(np.int32)
        self.names, self.told = (pa.Table.from_batches(x).sort_by(x[0].schema.names[0]).combine_chunks() if x else None for x in (names, told))
        self.roots = np.concatenate([x.column(0).to_numpy(zero_copy_only=False) for x in roots]).astype(np.int64) if roots else np.empty(0, np.int64)

    def walks(self):
        """Roots that are walked together."""
        at_once = max(1, min(len(self.roots), _CELLS // max(1, self.n)))
        self.seen = np.zeros(at_once * self.n, bool)
        return (self.roots[i : i + at_once] for i in range(0, len(self.roots), at_once))

    def levels(self, roots: np.ndarray, depth: int | None):
        """For each level (root's place times n + name, its step, its parent, the place of its branch in level 1), the first two in order.

        What is found is met in the order of its parents, so the first way to a name is that by its smallest parent.
        """
        n = self.n
        key, branch, level = np.arange(len(roots), dtype=np.int64) * n + roots, None, 0
        seen, marked, marks = self.seen, [key], 0
        seen[key] = True
        while len(key) and (depth is None or level < depth):
            level += 1
            node = key % n
            size = self.bounds[node + 1] - self.bounds[node]
            some = np.flatnonzero(size)
            if not len(some):
                break
            first, size, row = self.bounds[node[some]], size[some], (key - node)[some]
            ends, pieces, lo = np.cumsum(size), [], 0
            while lo < len(some):
                done = ends[lo - 1] if lo else 0
                hi = max(lo + 1, int(np.searchsorted(ends, done + _STEPS, "right")))
                s, e = size[lo:hi], ends[lo:hi] - done
                step = np.repeat(first[lo:hi] - (e - s), s) + np.arange(e[-1])
                at = np.repeat(row[lo:hi], s) + self.to[step]
                fresh = np.flatnonzero(~seen[at])
                both = (at[fresh] << 32) | fresh  # sorted together, the first of a name is its first way
                both.sort()
                at = both >> 32
                own = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1]))) if len(at) else fresh
                at, where = at[own], both[own] & 0xFFFFFFFF
                seen[at] = True
                pieces.append((at, step[where], some[lo + np.searchsorted(e, where, "right")]))
                lo = hi
            key, step, source = (np.concatenate(x) for x in zip(*pieces))
            if len(pieces) > 1:
                order = np.argsort(key, kind="stable")
                key, step, source = key[order], step[order], source[order]
            branch = np.arange(len(key)) if branch is None else branch[source]
            marks += len(key)
            if marks > len(seen) // 16:
                marked = []
            elif marked:
                marked.append(key)
            yield key, step, node[source], branch
        for key in marked:
            seen[key] = False
        if not marked:
            seen[:] = False

    def named(self, num: np.ndarray, column: str = "name") -> pa.Array:
        return self.names.column(column).take(pa.array(num)).combine_chunks()

    def of_step(self, step: np.ndarray, column: str) -> pa.Array:
        return self.told.column(column).take(pa.array(self.info[step])).combine_chunks()


def _handed(pieces: Iterator[tuple[np.ndarray, ...]], told: Callable[..., dict[str, pa.Array]]) -> Iterator[pa.RecordBatch]:
    kept, rows = [], 0
    for piece in pieces:
        kept.append(piece)
        rows += len(piece[0])
        if rows >= _ROWS:
            yield from _cut(kept, told)
            kept, rows = [], 0
    if rows:
        yield from _cut(kept, told)


def _cut(kept: list, told: Callable[..., dict[str, pa.Array]]) -> Iterator[pa.RecordBatch]:
    columns = [np.concatenate(x) for x in zip(*kept)]
    for i in range(0, len(columns[0]), _ROWS):
        yield pa.RecordBatch.from_pydict(told(*(x[i : i + _ROWS] for x in columns)))


def chain(batches: Iterator[pa.RecordBatch], n: int, depth: int | None = None) -> Iterator[pa.RecordBatch]:
    """The rows of `CHAIN` for the roots dealt to the task."""
    held = _Held(batches, n)

    def found():
        for roots in held.walks():
            top = None
            for level, (key, step, parent, branch) in enumerate(held.levels(roots, depth), 1):
                top = key % n if top is None else top
                yield roots[key // n], key % n, parent, top[branch], np.full(len(key), level, np.int32), step

    return _handed(found(), lambda root, name, parent, branch, level, step: {
        "repo": held.named(root, "repo"), "root": held.named(root), "name": held.named(name), "parent": held.named(parent), "branch": held.named(branch), "depth": pa.array(level),
        **{c: held.of_step(step, c) for c in ("file", "line", "language")}})


def roots_of(batches: Iterator[pa.RecordBatch], n: int, depth: int | None = None) -> Iterator[pa.RecordBatch]:
    """The rows of `ROOTS` for the roots dealt to the task: only counts of the chains are kept."""
    held = _Held(batches, n)

    def found():
        for roots in held.walks():
            top = None
            for key, step, _, branch in held.levels(roots, depth):
                if top is None:
                    top, hung = (key, step), np.zeros(len(key), np.int64)
                hung += np.bincount(branch, minlength=len(hung))
            if top is not None:
                yield roots[top[0] // n], top[0] % n, top[1], hung - 1

    return _handed(found(), lambda root, name, step, upstream: {
        "repo": held.named(root, "repo"), "root": held.named(root), "name": held.named(name), **{c: held.of_step(step, c) for c in ("file", "line")}, "upstream": pa.array(upstream)})
