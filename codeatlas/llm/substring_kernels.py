"""Super-k-mers of word sequences, inside Spark tasks."""

from __future__ import annotations

import hashlib
import sys
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import cloudpickle

from codeatlas.llm.textscan import buffers, group_starts, mix, owners, powers, slices, span_hashes, window_hashes, words

cloudpickle.register_pickle_by_value(sys.modules[__name__])

CHUNK_BYTES = 4 << 20


def run_hashes(hashes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each run of words, from one running sum over all of them."""
    up, down = powers(len(hashes) + 1)
    running = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(hashes * up[:-1], out=running[1:])
    return mix((running[ends] - running[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Least of each `width` neighbours, by doubling."""
    span, out = 1, values
    while 2 * span <= width:
        out = np.minimum(out[:-span], out[span:])
        span *= 2
    return out if span == width else np.minimum(out[: len(values) - width + 1], out[width - span : width - span + len(values) - width + 1])


def cut_super_kmers(hashes: np.ndarray, first: np.ndarray, k: int, m: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first window, windows, minimiser) of each longest run of consecutive windows of one text that share a minimiser.

    A window of k words is named by its first word; its minimiser is the least hash of the m-word runs in it.
    """
    none = np.zeros(0, np.int64)
    if len(hashes) < k:
        return none, none, np.zeros(0, np.uint64)
    grams, at = window_hashes(hashes, first, m, 7)
    place = np.full(len(hashes) - m + 1, np.uint64(0xFFFFFFFFFFFFFFFF), np.uint64)
    place[at] = grams
    least = sliding_min(place, k - m + 1)
    left = np.repeat(first[1:], np.diff(first))[: len(least)] - np.arange(len(least))
    valid = np.flatnonzero(left >= k)
    if not len(valid):
        return none, none, np.zeros(0, np.uint64)
    value, owner = least[valid], owners(first)[valid]
    new = np.flatnonzero(np.concatenate(([True], (value[1:] != value[:-1]) | (owner[1:] != owner[:-1]))))
    return valid[new], np.diff(np.concatenate((new, [len(valid)]))), value[new]


def earliest(keys: np.ndarray, docs: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows that come first, by (doc, start), among those with their key, and the others that come strictly later."""
    order = np.lexsort((starts, docs, keys))
    heads = group_starts(keys[order])
    lead = np.repeat(order[heads], np.diff(np.concatenate((heads, [len(order)]))))
    later = (docs[order] != docs[lead]) | (starts[order] != starts[lead])
    return order[heads], order[later]


def pack(meta: np.ndarray, lengths: np.ndarray, text: bytes, done: np.ndarray) -> bytes:
    """One string of super-k-mers (rows doc, start, windows; bytes of each; their texts) and of runs already found repeated."""
    head = np.array([len(meta), len(done)], np.int64).tobytes()
    return zstandard.ZstdCompressor(level=3).compress(head + meta.tobytes() + lengths.astype(np.int64).tobytes() + done.tobytes() + text)


def unpack(payload: bytes) -> tuple[np.ndarray, np.ndarray, bytes, np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(payload)
    n, d = np.frombuffer(raw, np.int64, 2)
    at = 16
    meta = np.frombuffer(raw, np.int64, 3 * n, at).reshape(n, 3)
    at += 24 * n
    lengths = np.frombuffer(raw, np.int64, n, at)
    at += 8 * n
    done = np.frombuffer(raw, np.int64, 3 * d, at).reshape(d, 3)
    return meta, lengths, raw[at + 24 * d :], done


def chunk_super_kmers(batch: pa.RecordBatch, k: int, m: int):
    """Of a chunk of (id, text): its bytes, the words' starts, ends, hashes and first words, then (first window, windows, minimiser, text,
    id) of its super-k-mers, the hash of each, and which are the earliest of their kind and which equal an earlier one."""
    data, offsets = buffers(batch.column(1))
    starts, ends, first = words(data, offsets)
    hashes = span_hashes(data, starts, ends)
    window, count, least = cut_super_kmers(hashes, first, k, m)
    doc = np.searchsorted(first, window, "right") - 1
    ids = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)[doc]
    keys = run_hashes(hashes, window, window + count + k - 1) if len(window) else least
    lead, repeats = earliest(keys, ids, window - first[doc])
    return data, (starts, ends, hashes, first), (window, count, least, doc, ids), keys, lead, repeats


def cells_of(least: np.ndarray, cells: int) -> np.ndarray:
    """Cell of each minimiser; the bucket is its remainder."""
    return (mix(least + np.uint64(99)) % np.uint64(cells)).astype(np.int64)


def cell_rows(k: int, m: int, cells: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """From (id, text) to (cell, windows): how many windows travel by the minimisers of a cell, summed over a task."""

    def run(batches):
        total = np.zeros(cells, np.int64)
        for batch in slices(batches, "text", CHUNK_BYTES):
            _, _, (_, count, least, _, _), _, lead, _ = chunk_super_kmers(batch, k, m)
            np.add.at(total, cells_of(least[lead], cells), count[lead])
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], names=["cell", "windows"])

    return run


def packed_rows(k: int, m: int, buckets: int, cells: int | None = None, hot: np.ndarray | None = None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """From (id, text) to (bucket, payload).  Of equal super-k-mers in a chunk only the earliest travels as text.

    Super-k-mers whose minimiser is in one of the `hot` cells (of `cells`, a multiple of `buckets`) travel window by window instead,
    each to the bucket of the hash of all its words, which equal windows share.
    """
    cells, hot = cells or buckets, np.zeros(0, np.int64) if hot is None else hot

    def run(batches):
        for batch in slices(batches, "text", CHUNK_BYTES):
            data, (starts, ends, hashes, first), (window, count, least, doc, ids), keys, lead, repeats = chunk_super_kmers(batch, k, m)
            if not len(window):
                continue
            cell = cells_of(least, cells)
            bucket = cell % buckets
            split = np.isin(cell, hot)
            bucket[split] = (mix(keys[split]) % np.uint64(buckets)).astype(np.int64)  # what is known to repeat needs no meeting
            # Windows of the super-k-mers that are taken apart follow the others as rows of one window.
            apart, lead = lead[split[lead]], lead[~split[lead]]
            n = count[apart]
            single = np.repeat(window[apart], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            owner = np.repeat(doc[apart], n)
            whole = run_hashes(hashes, single, single + k) if len(single) else keys[:0]
            heads, again = earliest(whole, np.repeat(ids[apart], n), single - first[owner])
            at = len(window)
            window, count, doc = np.concatenate((window, single)), np.concatenate((count, np.ones(len(single), np.int64))), np.concatenate((doc, owner))
            ids = np.concatenate((ids, np.repeat(ids[apart], n)))
            bucket = np.concatenate((bucket, (mix(whole) % np.uint64(buckets)).astype(np.int64)))
            lead, repeats = np.concatenate((lead, heads + at)), np.concatenate((repeats, again + at))
            last = window + count + k - 1
            rows = np.stack((ids, window - first[doc], count), 1)
            lead, repeats = lead[np.argsort(bucket[lead], kind="stable")], repeats[np.argsort(bucket[repeats], kind="stable")]
            mine, others = bucket[lead], bucket[repeats]
            flat = data.tobytes()
            out_bucket, out_payload = [], []
            for b in np.union1d(mine, others):
                part = lead[np.searchsorted(mine, b) : np.searchsorted(mine, b, "right")]
                low, high = np.searchsorted(others, b), np.searchsorted(others, b, "right")
                text = b"".join([flat[s:e] for s, e in zip(starts[window[part]], ends[last[part] - 1])])
                out_bucket.append(b)
                out_payload.append(pack(rows[part], ends[last[part] - 1] - starts[window[part]], text, rows[repeats[low:high]]))
            yield pa.RecordBatch.from_arrays([pa.array(out_bucket, pa.int64()), pa.array(out_payload, pa.binary())], names=["bucket", "payload"])

    return run


def repeated_runs(k: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """From the payloads of a bucket to (id, start, stop): words covered by windows that also start earlier."""

    def run(frame):
        metas, sizes, texts, found = [], [], [], []
        for payload in frame.payload:
            meta, lengths, text, done = unpack(payload)
            metas.append(meta)
            sizes.append(lengths)
            texts.append(text)
            found.append(done)
        meta, lengths = np.concatenate(metas), np.concatenate(sizes)
        data = np.frombuffer(b"".join(texts), np.uint8)
        offsets = np.concatenate(([0], np.cumsum(lengths)))
        spans, order, hashes, first = [], [], [], []
        # Texts are hashed in pieces, as a running sum takes eight bytes a byte.
        at, total = 0, 0
        while at < len(meta):
            end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + CHUNK_BYTES, "right")) - 1)
            part = data[offsets[at] : offsets[end]]
            starts, ends, begun = words(part, offsets[at : end + 1] - offsets[at])
            hashes.append(span_hashes(part, starts, ends))
            first.append(begun[:-1] + total)
            total += len(starts)
            at = end
        hashes, first = np.concatenate(hashes), np.concatenate(first)
        counts = meta[:, 2]
        # Equal super-k-mers of different chunks: all but the earliest are repeats as a whole.
        lead, repeats = earliest(run_hashes(hashes, first, first + counts + k - 1), meta[:, 0], meta[:, 1])
        found.append(meta[repeats])
        lead = lead[np.lexsort((meta[lead, 1], meta[lead, 0]))]
        n = counts[lead]
        owner = np.repeat(np.arange(len(lead)), n)
        step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        window = first[lead][owner] + step
        docs, starts = meta[lead, 0][owner], meta[lead, 1][owner] + step
        keys = run_hashes(hashes, window, window + k)
        order = np.argsort(keys, kind="stable")
        heads = group_starts(keys[order])
        head = np.repeat(order[heads], np.diff(np.concatenate((heads, [len(order)]))))
        again = np.flatnonzero(order != head)
        same = np.ones(len(again), bool)
        for i in range(k):
            same &= hashes[window[order[again]] + i] == hashes[window[head[again]] + i]
        if not same.all():  # two sequences with one hash: told apart by all their words
            table = np.stack([hashes[window + i] for i in range(k)], 1)
            _, keys = np.unique(table, axis=0, return_inverse=True)
            order = np.argsort(keys, kind="stable")
            heads = group_starts(keys[order])
            head = np.repeat(order[heads], np.diff(np.concatenate((heads, [len(order)]))))
            again = np.flatnonzero(order != head)
        later = (docs[order[again]] != docs[head[again]]) | (starts[order[again]] != starts[head[again]])
        hit = np.sort(order[again][later])
        runs = [np.concatenate(found)] if found else []
        if len(hit):
            new = np.flatnonzero(np.concatenate(([True], (np.diff(hit) != 1) | (np.diff(owner[hit]) != 0))))
            runs.append(np.stack((docs[hit[new]], starts[hit[new]], np.diff(np.concatenate((new, [len(hit)])))), 1))
        runs = np.concatenate(runs)
        return pd.DataFrame({"id": runs[:, 0], "start": runs[:, 1], "stop": runs[:, 1] + runs[:, 2] + k - 1})

    return run


def kept_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From (id, text, runs) to (id, n_words, n_removed, kept): words outside the runs (start << 32 | stop) joined by one space."""
    for batch in slices(batches, "text"):
        data, offsets = buffers(batch.column(1))
        starts, ends, first = words(data, offsets)
        lists = batch.column(2)
        marks = np.zeros(len(starts) + 1, np.int64)
        if len(lists.flatten()):
            flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            base = np.repeat(first[:-1], pa.compute.fill_null(pa.compute.list_value_length(lists), 0).to_numpy(zero_copy_only=False))
            np.add.at(marks, base + (flat >> 32), 1)
            np.add.at(marks, base + (flat & 0xFFFFFFFF), -1)
        stay = np.cumsum(marks)[:-1] == 0
        sizes = np.where(stay, ends - starts + 1, 0)
        places = np.concatenate(([0], np.cumsum(sizes)))
        out = np.full(places[-1], 0x20, np.uint8)
        held = np.flatnonzero(stay)
        length = (ends - starts)[held]
        inner = np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length)
        out[np.repeat(places[held], length) + inner] = data[np.repeat(starts[held], length) + inner]
        flat = out.tobytes()
        total = np.concatenate(([0], np.cumsum(stay)))
        kept = [flat[places[a] : places[b] - 1] if total[b] > total[a] else b"" for a, b in zip(first[:-1], first[1:])]
        n = np.diff(first)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(n), pa.array(n - (total[first[1:]] - total[first[:-1]])), pa.array(kept, pa.binary()).cast(pa.string())],
            names=["id", "n_words", "n_removed", "kept"],
        )


def digest_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """As `kept_rows`, with the SHA-256 of the kept words instead of the words."""
    for batch in kept_rows(batches):
        shas = [hashlib.sha256(x.as_buffer()).hexdigest() for x in batch.column(3)]
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(shas, pa.string())], names=["id", "n_words", "n_removed", "kept_sha256"])
