"""Quality rules: a conditional random field labels lines as content or boilerplate, and the share of content decides."""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, functions as F

from codeatlas.llm.base import bounded_sample, fitted, text_batches
from codeatlas.llm.crf import Adam, best_path, gradient
from codeatlas.llm.substring_kernels import run_hashes
from codeatlas.llm.textscan import buffers, group_starts, mix, owners, release, slices, span_hashes, tables, words

cloudpickle.register_pickle_by_value(sys.modules[__name__])

WINDOW = 8
SYMBOLS = "#*$%&|<>"
MIN_WORDS = 20
MAX_REPEATED = 30
"""Percent of words in repeated windows past which a text fails."""
MIN_CONTENT = 0.5
"""Share of words on content lines from which on a text is kept."""
SAMPLE_PER_CLASS = 500
SAMPLE_BYTES = 16384
CONTENT, BOILERPLATE = 0, 1
FEATURES = 12


def line_table(texts: pa.Array) -> dict:
    """Counts of each text and features of each of its lines that has a word."""
    data, offsets = buffers(texts)
    n = len(offsets) - 1
    starts, ends, first = words(data, offsets)
    hashes, owner = span_hashes(data, starts, ends), owners(first)
    count = np.diff(first)
    lead = (data & 0xC0) != 0x80  # first byte of a character
    letters = np.concatenate(([0], np.cumsum(lead & ~tables()["blank"][data])))
    marks = np.zeros(256, bool)
    marks[[ord(c) for c in SYMBOLS]] = True
    symbols = np.concatenate(([0], np.cumsum(marks[data])))

    # Words covered by windows that the text holds twice or more; windows with equal hashes are compared word by word.
    covered = np.zeros(len(starts) + 1, np.int64)
    left = np.repeat(first[1:], count) - np.arange(len(starts))
    at = np.flatnonzero(left >= WINDOW)
    if len(at):
        keys = mix(run_hashes(hashes, at, at + WINDOW) + owner[at].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        order = np.argsort(keys, kind="stable")
        heads = group_starts(keys[order])
        size = np.diff(np.concatenate((heads, [len(order)])))
        group = np.repeat(np.arange(len(size)), size)
        several = size[group] > 1
        group, head, member = group[several], at[order[heads]][group[several]], at[order[several]]
        same = owner[head] == owner[member]
        for i in range(WINDOW):
            same &= hashes[head + i] == hashes[member + i]
        hit = member[same & (np.bincount(group, same, len(size))[group] >= 2)]
        np.add.at(covered, hit, 1)
        np.add.at(covered, hit + WINDOW, -1)
    repeated = np.cumsum(covered)[:-1] > 0

    # Lines: cut at each line feed and at each text's beginning.
    cut = np.concatenate((offsets[:-1], np.flatnonzero(data == 0x0A) + 1))
    begin = np.unique(cut[cut < len(data)]) if len(data) else np.zeros(0, np.int64)
    text = np.searchsorted(offsets, begin, "right") - 1
    stop = np.concatenate((begin[1:], [len(data)])) if len(begin) else begin
    stop = np.minimum(stop, offsets[text + 1]) if len(begin) else begin
    stop = stop - ((stop > begin) & (data[np.maximum(stop - 1, 0)] == 0x0A)) if len(begin) else begin
    low, high = np.searchsorted(starts, begin), np.searchsorted(starts, stop)
    held = np.flatnonzero(high > low)
    begin, stop, text, low, high = begin[held], stop[held], text[held], low[held], high[held]
    line_keys = span_hashes(data, begin, stop)
    order = np.lexsort((np.arange(len(begin)), line_keys, text))
    again = np.zeros(len(begin), bool)
    if len(order):
        equal = (line_keys[order][1:] == line_keys[order][:-1]) & (text[order][1:] == text[order][:-1])
        again[order[1:][equal]] = True

    def per_line(values):
        total = np.concatenate(([0], np.cumsum(values)))
        return total[high] - total[low]

    neighbour = np.zeros(len(starts), bool)
    neighbour[1:] = (hashes[1:] == hashes[:-1]) & (owner[1:] == owner[:-1])
    n_words = (high - low).astype(float)
    chars = np.maximum(letters[stop] - letters[begin], 1).astype(float)
    digit = np.concatenate(([0], np.cumsum((data >= 48) & (data <= 57))))
    upper = np.concatenate(([0], np.cumsum((data >= 65) & (data <= 90))))
    last = data[ends[high - 1] - 1] if len(begin) else np.zeros(0, np.uint8)
    pipes = np.concatenate(([0], np.cumsum((data == ord("|")) | (data == ord("/")) | (data == ord("=")))))
    features = np.stack((
        np.ones(len(begin)), np.log1p(n_words), np.minimum(10 * (symbols[stop] - symbols[begin]) / chars, 5), again.astype(float), per_line(repeated) / np.maximum(n_words, 1),
        5 * per_line(neighbour) / np.maximum(n_words, 1), 5 * (digit[stop] - digit[begin]) / chars, 5 * (upper[stop] - upper[begin]) / chars,
        np.isin(last, [46, 33, 63]).astype(float), np.log1p(chars / np.maximum(n_words, 1)), (n_words < 4).astype(float), np.minimum(10 * (pipes[stop] - pipes[begin]) / chars, 5),
    ), 1) if len(begin) else np.zeros((0, FEATURES))
    return {
        "n_words": count, "word_chars": letters[offsets[1:]] - letters[offsets[:-1]], "n_symbols": symbols[offsets[1:]] - symbols[offsets[:-1]],
        "n_dup_lines": np.bincount(text[again], minlength=n), "n_repeat_words": np.bincount(owner[repeated], minlength=n),
        "line_text": text, "line_words": high - low, "features": features, "first_line": np.searchsorted(text, np.arange(n + 1)),
    }


def sample_rows(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", per_class: int = SAMPLE_PER_CLASS) -> DataFrame:
    """(id, text, mark) of at most `per_class` labelled documents a class, by hash of their key."""
    named = labels.select(F.col(f"`{key}`").alias("id"), F.col("quality").alias("mark")).filter("id IS NOT NULL AND mark IN (0, 1)")
    texts = docs.select(F.col(f"`{key}`").alias("id"), F.col(f"`{text}`").alias("text")).filter(F.octet_length("text") <= SAMPLE_BYTES)
    return bounded_sample(named, texts, per_class)


def training_sample(docs: DataFrame, labels: DataFrame, **names) -> tuple[list[str], list[int]]:
    """Texts and quality labels of the sample."""
    rows = sample_rows(docs, labels, **names).orderBy("id").collect()
    return [r.text for r in rows], [r.mark for r in rows]


def fit(docs: DataFrame, labels: DataFrame, **names) -> dict:
    """The model that `train` makes of the sample."""
    return fitted(sample_rows(docs, labels, **names), train, "id")


def train(texts: list[str], quality: list[int], seed: int = 3, length: int = 24, epochs: int = 60) -> dict:
    """A model from texts with labels: the lines of a good text are content, those of a bad one boilerplate."""
    weights, step = np.zeros((FEATURES, 2)), np.zeros((2, 2))
    table = line_table(pa.array(texts, pa.string()))
    label = 1 - np.array(quality, np.int64)
    begin = [(a, min(a + length, table["first_line"][i + 1]), label[i]) for i in range(len(texts)) for a in range(table["first_line"][i], table["first_line"][i + 1], length)]
    if not begin or len(set(quality)) < 2:
        weights[0, CONTENT] = 1.0  # nothing to learn from: all lines are content
        return {"weights": weights, "step": step}
    x, y, mask = np.zeros((len(begin), length, FEATURES)), np.zeros((len(begin), length), np.int64), np.zeros((len(begin), length))
    for s, (a, b, mark) in enumerate(begin):
        x[s, : b - a], y[s, : b - a], mask[s, : b - a] = table["features"][a:b], mark, 1
    rng, rule = np.random.RandomState(seed), Adam([weights, step], 0.05)
    for _ in range(epochs):
        for part in np.array_split(rng.permutation(len(begin)), max(1, len(begin) // 128)):
            _, d_emit, d_step = gradient(x[part] @ weights, y[part], step, mask[part])
            rule.step([np.einsum("bti,btl->il", x[part], d_emit) + 1e-4 * weights, d_step + 1e-3 * step])
    del x, y, mask, table
    release()
    return {"weights": weights, "step": step}


def _rate_rows(model: dict) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches):
        for batch in slices(batches, "_text"):
            n = batch.num_rows
            t = line_table(batch.column(batch.schema.get_field_index("_text")))
            marks = best_path(t["features"] @ model["weights"], t["first_line"], model["step"])
            content = np.bincount(t["line_text"], t["line_words"] * (marks == CONTENT), n) / np.maximum(t["n_words"], 1)
            failed = (t["n_words"] < MIN_WORDS) | (100 * t["n_repeat_words"] > MAX_REPEATED * t["n_words"])
            longs = [pa.array(t[c].astype(np.int64)) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, *longs, pa.array(failed), pa.array(content.astype(float)), pa.array(~failed & (content >= MIN_CONTENT))],
                names=[*batch.schema.names, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "content_share", "kept"],
            )

    return run


def rate(docs: DataFrame, model: dict, carry: list[str], text: str = "text") -> DataFrame:
    """The columns in `carry`, then counts of the whole text and whether it is kept, for every document.

    `word_chars` are the code points of the words, `n_symbols` the characters `#*$%&|<>`, `n_dup_lines` the lines (cut at line feeds)
    with a word that equal an earlier one, `n_repeat_words` the words in windows of 8 words that the text holds twice or more.
    `base_failed`: fewer than 20 words or more than 30 % of them repeated.  `content_share` is the share of the words that is on lines
    which the likeliest labelling of all lines calls content; `kept` needs half and no base failure.  Null and empty text have
    counts of 0 and fail; rows are judged one by one, so repeated rows agree and empty frames stay empty.
    """
    picked = text_batches(docs).select(*[F.col(f"`{c}`") for c in carry], F.col(f"`{text}`").alias("_text"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in picked.schema.fields)
    counts = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, content_share double, kept boolean"
    return picked.mapInArrow(_rate_rows(model), f"{fields}, {counts}").drop("_text")
