"""Language ID: a linear-chain conditional random field labels the words of texts that may switch language."""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, functions as F

from codeatlas.llm.base import bounded_sample, fitted, text_batches
from codeatlas.llm.crf import Adam, gradient, marginals
from codeatlas.llm.textscan import buffers, release, slices
from codeatlas.llm.wordgrams import Words, document_counts, find, pick

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SAMPLE_PER_LANGUAGE = 200
"""Training documents of each language: those with the least hashes of their ids."""
SAMPLE_BYTES = 8192
"""Longest text taken for training, so that what the driver holds is bounded."""
BUCKETS = 1 << 14
SEQUENCES, LENGTH, EPOCHS = 2500, 32, 3
UNKNOWN = "und"
DOUBT_WORDS, DOUBT_QUANTILE, DOUBT_MARGIN, KNOWN_SHARE = 20, 0.01, 0.03, 0.1
"""A text is no language where it has at least 20 words with a letter, the lexicon knows less than a tenth of them, and their likeliest languages are less
probable, on the mean, than in the 1 % most doubtful texts of the sample, by 0.03."""


def sample_rows(docs: DataFrame, may_learn: Column, lang: str = "lang", text: str = "text", key: str = "doc_id", per_language: int = SAMPLE_PER_LANGUAGE) -> DataFrame:
    """(id, text, mark) of at most `per_language` documents of each of the 64 commonest languages, by hash of their key; rows without a key, a text or a
    language, or where `may_learn` isn't true, are no samples."""
    fit = docs.filter(may_learn & F.col(f"`{key}`").isNotNull() & F.col(f"`{lang}`").isNotNull() & (F.octet_length(f"`{text}`") <= SAMPLE_BYTES))
    named = fit.select(F.col(f"`{key}`").alias("id"), F.col(f"`{lang}`").alias("mark"), F.col(f"`{text}`").alias("text"))
    return bounded_sample(named.select("id", "mark"), named.select("id", "text"), per_language)


def training_sample(docs: DataFrame, may_learn: Column, **names) -> tuple[list[str], list[str]]:
    """Texts and languages of the sample."""
    rows = sample_rows(docs, may_learn, **names).orderBy("mark", "id").collect()
    return [r.text for r in rows], [r.mark for r in rows]


def fit(docs: DataFrame, may_learn: Column, **names) -> dict:
    """The model that `train` makes of the sample."""
    return fitted(sample_rows(docs, may_learn, **names), train, "mark", "id")


def train(texts: list[str], langs: list[str], seed: int = 5) -> dict:
    """A model from labelled texts.  Half of the training sequences are spliced from texts of different languages, so that steps
    between languages are learned too; words that several texts share enter the lexicon."""
    names = sorted(set(langs))
    if not names:
        return {"names": []}
    rng = np.random.RandomState(seed)
    w = Words(*buffers(pa.array(texts, pa.string())))
    label = np.array([names.index(x) for x in langs])
    spread = document_counts(w.owner, w.which, max(1, len(w.hashes)))
    known = np.flatnonzero(spread >= 3)
    lexicon = w.hashes[known]  # sorted, as all distinct words are
    lists, begin = w.lists(BUCKETS)
    entry = find(lexicon, w.hashes)
    weights = np.zeros((BUCKETS + 1, len(names)))
    entries = np.zeros((len(lexicon) + 1, len(names)))
    step = np.zeros((len(names), len(names)))
    by_label = [np.flatnonzero((label == i) & (np.diff(w.first) > 0)) for i in range(len(names))]
    usable = [i for i in range(len(names)) if len(by_label[i])]
    if not usable:
        return {"names": []}
    seen, marks, mask = np.zeros((SEQUENCES, LENGTH), np.int64), np.zeros((SEQUENCES, LENGTH), np.int64), np.zeros((SEQUENCES, LENGTH))
    for s in range(SEQUENCES):
        at, pure = 0, rng.rand() < 0.5
        lang = usable[s % len(usable)]
        while at < LENGTH:
            doc = by_label[lang][rng.randint(len(by_label[lang]))]
            a, b = w.first[doc], w.first[doc + 1]
            n = int(min(b - a, LENGTH - at if pure else rng.randint(4, 17), LENGTH - at))
            where = a + rng.randint(b - a - n + 1)
            seen[s, at : at + n], marks[s, at : at + n], mask[s, at : at + n] = w.which[where : where + n], lang, 1
            at += n
            if pure:
                break
            lang = usable[rng.randint(len(usable))]
    rule = Adam([weights, entries, step], 0.05)
    for _ in range(EPOCHS):
        for part in np.array_split(rng.permutation(SEQUENCES), max(1, SEQUENCES // 64)):
            distinct, back = np.unique(seen[part], return_inverse=True)
            places, owner = pick(lists, begin, distinct)
            score = entries[entry[distinct]].copy()
            np.add.at(score, owner, weights[places])
            _, d_emit, d_step = gradient(score[back.reshape(seen[part].shape)], marks[part], step, mask[part])
            d_score = np.zeros_like(score)
            np.add.at(d_score, back.ravel(), d_emit.reshape(-1, len(names)))
            d_weights, d_entries = 1e-5 * weights, 1e-5 * entries
            np.add.at(d_weights, places, d_score[owner])
            np.add.at(d_entries, entry[distinct], d_score)
            d_entries[-1] = 0
            rule.step([d_weights, d_entries, d_step])
            weights[-1], entries[-1] = 0, 0
    del w, lists, rule
    model = {"names": names, "weights": weights.astype(np.float32), "lexicon": lexicon, "entries": entries.astype(np.float32), "step": step.astype(np.float32), "least": 0.0}
    lettered, sure, _ = (np.concatenate(x) for x in zip(*(certainty(model, *word_languages(model, pa.array(texts[i : i + 64]))) for i in range(0, len(texts), 64))))
    full = sure[lettered >= DOUBT_WORDS]
    model["least"] = float(np.quantile(full, DOUBT_QUANTILE) - DOUBT_MARGIN) if len(full) else 0.0
    release()
    return model


def word_languages(model: dict, texts: pa.Array) -> tuple[Words, np.ndarray]:
    """Words of the texts, and for each occurrence the probability of each language given the whole text."""
    w = Words(*buffers(texts))
    emit = w.sums(model["weights"]) + model["entries"][find(model["lexicon"], w.hashes)]
    return w, marginals(emit[w.which], w.first, model["step"])


def certainty(model: dict, w: Words, chance: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each text: its words with a letter, the mean probability of their likeliest languages, and the share of them that the lexicon knows."""
    n, lettered = len(w.first) - 1, w.has_letter[w.which]
    count = np.bincount(w.owner[lettered], minlength=n)
    known = (find(model["lexicon"], w.hashes) >= 0)[w.which]
    sure = np.bincount(w.owner[lettered], chance[lettered].max(axis=1), n) / np.maximum(count, 1)
    return count, sure, np.bincount(w.owner[lettered], known[lettered], n) / np.maximum(count, 1)


def _predict_rows(model: dict) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches):
        for batch in slices(batches, "_text"):
            n = batch.num_rows
            share, ascii_letter, letter = np.zeros((n, max(1, len(model["names"])))), np.zeros(n, bool), np.zeros(n, bool)
            doubtful = np.zeros(n, bool)  # where no language is known there is nothing to doubt
            texts = batch.column(batch.schema.get_field_index("_text"))
            if model["names"]:
                w, chance = word_languages(model, texts)
                lettered = w.has_letter[w.which]
                for i in range(len(model["names"])):
                    share[:, i] = np.bincount(w.owner[lettered], chance[lettered, i], n)
                count, sure, known = certainty(model, w, chance)
                doubtful = (count >= DOUBT_WORDS) & (sure < model["least"]) & (known < KNOWN_SHARE)
                ascii_letter[w.owner[w.has_ascii[w.which]]] = True
                letter[w.owner[lettered]] = True
                # Bytes above ASCII may be letters or not: read such texts as characters, where no plain letter settles it.
                for i in np.flatnonzero(letter & ~ascii_letter):
                    letter[i] = any(c.isalpha() for c in texts[i].as_py())
            else:
                letter[:] = [any(c.isalpha() for c in t or "") for t in texts.to_pylist()]
            total = share.sum(axis=1)
            best = share.argmax(axis=1)
            score = np.where(letter & (total > 0), share[np.arange(n), best] / np.maximum(total, 1e-12), 0.0)
            names = np.array([*model["names"], UNKNOWN], object)
            named = names[np.where(letter & (total > 0), best, len(names) - 1)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(named, pa.string()), pa.array(np.clip(score, 0.0, 1.0)), pa.array(letter & ~doubtful)],
                names=[*batch.schema.names, "lang_pred", "score", "_told"],
            )

    return run


def identify(docs: DataFrame, model: dict, carry: list[str], text: str = "text") -> DataFrame:
    """The columns in `carry`, then `lang_pred` and `score`, for every document.

    Every word of the whole text gets the probabilities of its language by forward-backward over the text; `lang_pred` is the
    language with the largest sum over the words that have a letter, `score` its share of that sum.  Null text, text
    without a letter, and any text where the model knows no language, get `und` and 0.  Repeated rows and empty frames need no
    care, as each row is judged alone.
    """
    return _judged(docs, model, carry, text).drop("_told")


def _judged(docs: DataFrame, model: dict, carry: list[str], text: str) -> DataFrame:
    """As `identify`, and `_told`: whether the text has a letter and isn't doubtful (see `DOUBT_WORDS`)."""
    others = [c for c in carry if c not in (text, "lang_pred", "score")]
    picked = text_batches(docs).select(*[F.col(f"`{c}`") for c in others], F.col(f"`{text}`").alias("_text"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in picked.schema.fields)
    found = picked.mapInArrow(_predict_rows(model), f"{fields}, lang_pred string, score double, _told boolean")
    return found.select(*[F.col("_text").alias(c) if c == text else F.col(f"`{c}`") for c in [c for c in carry if c in others or c == text]], "lang_pred", "score", "_told")


def drop_unidentified(docs: DataFrame, may_learn: Column, text: str = "text", lang: str = "lang", **names) -> DataFrame:
    """`docs` with the language that is found in `lang`, without the rows whose language can't be told.

    Dropped are texts without a letter, and those of `DOUBT_WORDS` words or more whose words fit no language that was learned (noise, codes, other scripts).
    A text of several languages is kept however they share it, as long as its words are told, and so is every short one; without any language to learn,
    every text with a letter is kept, with its own `lang`.  The model is learned from their own labels where `may_learn` holds."""
    model = fit(docs, may_learn, text=text, lang=lang, **names)
    given = {c: f"_given_{c}" for c in ("lang_pred", "score") if c in docs.columns}
    found = _judged(docs.withColumnsRenamed(given), model, [given.get(c, c) for c in docs.columns], text).filter("_told")
    back = {new: old for old, new in given.items()}
    told = F.col("lang_pred") if model["names"] else F.col(f"`{lang}`")
    return found.select(*[(told if c == lang else F.col(f"`{c}`")).alias(back.get(c, c)) for c in found.columns if c not in ("lang_pred", "score", "_told")])
