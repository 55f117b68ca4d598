"""Toxicity: a bidirectional gated recurrent network with attention pooling over windows of words."""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, functions as F

from codeatlas.llm.base import bounded_sample, fitted, text_batches
from codeatlas.llm.crf import Adam
from codeatlas.llm.minhash_kernels import shingle_sets, similarity_sketches
from codeatlas.llm.textscan import buffers, release, slices
from codeatlas.llm.wordgrams import Words, document_counts, find, pick

cloudpickle.register_pickle_by_value(sys.modules[__name__])

WIDTH, STRIDE = 40, 10
"""Words of a window, and from one window to the next: any run of up to 31 words lies in one window."""
HIDDEN, SPELLING, BUCKETS = 8, 7, 1 << 13
THRESHOLD = 0.7
SAMPLE_PER_CLASS = 1200
"""Labelled documents of each class that training takes, by hash of their ids."""
SAMPLE_BYTES = 16384
EPOCHS = 8
LANES = 4096
"""Windows worked on at once."""


def sample_rows(docs: DataFrame, labels: DataFrame, may_learn: Column, key: str = "doc_id", text: str = "text", per_class: int = SAMPLE_PER_CLASS) -> DataFrame:
    """(id, text, mark) of at most `per_class` documents a class, by hash of their key."""
    named = labels.filter(may_learn).select(F.col(f"`{key}`").alias("id"), F.col("toxic").alias("mark")).filter("id IS NOT NULL AND mark IN (0, 1)")
    texts = docs.select(F.col(f"`{key}`").alias("id"), F.col(f"`{text}`").alias("text")).filter(F.octet_length("text") <= SAMPLE_BYTES)
    return bounded_sample(named, texts, per_class)


def training_sample(docs: DataFrame, labels: DataFrame, may_learn: Column, **names) -> tuple[list[str], list[int]]:
    """Texts and toxicity labels of the sample."""
    rows = sample_rows(docs, labels, may_learn, **names).orderBy("id").collect()
    return [r.text for r in rows], [r.mark for r in rows]


def fit(docs: DataFrame, labels: DataFrame, may_learn: Column, **names) -> Network:
    """The network that `train` makes of the sample."""

    def parts(texts, toxic):
        net = train(texts, toxic)
        return net.lexicon, net.worth[:-1], net.w

    lexicon, worth, weights = fitted(sample_rows(docs, labels, may_learn, **names), parts, "id")
    net = Network(lexicon, worth)
    net.w = weights
    return net


def window_table(first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, first word, words) of every window: one for each stride that a text reaches beyond the window before."""
    length = np.diff(first)
    count = np.where(length > 0, np.maximum(1, -(-(length - WIDTH) // STRIDE) + 1), 0)
    text = np.repeat(np.arange(len(length)), count)
    at = (np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)) * STRIDE
    return text, first[text] + at, np.minimum(WIDTH, length[text] - at)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Network:
    """Weights of the network, its scores and its slopes.

    A word is its lexicon weight and the mean vector of the byte runs of its spelling.  Two recurrent layers read a window from either
    end; attention weighs their joint states, and the weighted mean gives the score.
    """

    NAMES = ["spelling", "forward_x", "forward_h", "forward_b", "backward_x", "backward_h", "backward_b", "look", "look_v", "out", "out_b"]

    def __init__(self, lexicon: np.ndarray, worth: np.ndarray, seed: int = 11):
        rng = np.random.RandomState(seed)
        d, h = SPELLING + 1, HIDDEN
        shape = {
            "spelling": (BUCKETS + 1, SPELLING), "forward_x": (d, 3 * h), "forward_h": (h, 3 * h), "forward_b": (3 * h,), "backward_x": (d, 3 * h), "backward_h": (h, 3 * h),
            "backward_b": (3 * h,), "look": (2 * h, h), "look_v": (h,), "out": (2 * h,), "out_b": (1,),
        }
        self.w = {k: (rng.randn(*shape[k]) * (0.1 if k == "spelling" else 0.3)).astype(np.float32) for k in self.NAMES}
        for k in ("forward_b", "backward_b", "out_b"):
            self.w[k][:] = 0
        self.w["spelling"][-1] = 0
        self.lexicon, self.worth = lexicon, np.append(worth, 0).astype(np.float32)

    def inputs(self, w: Words) -> np.ndarray:
        """Vectors of the distinct words."""
        spelled = w.sums(self.w["spelling"])
        runs = np.maximum(4 * np.diff(w.places) - 6, 1)
        return np.concatenate((self.worth[find(self.lexicon, w.hashes)][:, None], spelled / runs[:, None]), 1).astype(np.float32)

    def run(self, x: np.ndarray, live: np.ndarray, side: str, keep: list | None = None, project: bool = True) -> np.ndarray:
        """States (length, windows, hidden) of one direction; `x` is (length, windows, inputs), `live` 1 for true words."""
        gates, h = self.w[side + "_h"], HIDDEN
        length, n = x.shape[:2]
        states, state = np.zeros((length, n, h), np.float32), np.zeros((n, h), np.float32)
        for t in range(length) if side == "forward" else range(length - 1, -1, -1):
            given = x[t] @ self.w[side + "_x"] + self.w[side + "_b"] if project else x[t]
            old = state @ gates
            gate = 1 / (1 + np.exp(-(given[:, : 2 * h] + old[:, : 2 * h])))
            reset, update = gate[:, :h], gate[:, h:]
            new = np.tanh(given[:, 2 * h :] + reset * old[:, 2 * h :])
            held = live[t][:, None]
            after = state + held * (1 - update) * (new - state)
            if keep is not None:
                keep.append((t, state, old, reset, update, new))
            states[t] = state = after
        return states

    def pool(self, states: np.ndarray, live: np.ndarray):
        """Attention over the words of each window: looks, weights, mean state and score."""
        looked = np.tanh(states @ self.w["look"])
        level = np.where(live > 0, looked @ self.w["look_v"], -1e9)
        level = np.exp(level - level.max(axis=0))
        share = (level / level.sum(axis=0)).astype(np.float32)
        mean = np.einsum("tn,tnh->nh", share, states)
        return looked, share, mean, mean @ self.w["out"] + self.w["out_b"][0]

    def score(self, w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(text, first word, words, score before the sigmoid) of every window of the texts."""
        text, start, size = window_table(w.first)
        scores = np.zeros(len(text), np.float32)
        if len(text):
            x = self.inputs(w)
            ahead, back = (x @ self.w[s + "_x"] + self.w[s + "_b"] for s in ("forward", "backward"))
            for a in range(0, len(text), LANES):
                place = np.minimum(start[a : a + LANES] + np.arange(WIDTH)[:, None], len(w.which) - 1)
                live = (np.arange(WIDTH)[:, None] < size[a : a + LANES]).astype(np.float32)
                word = w.which[place]
                states = np.concatenate((self.run(ahead[word], live, "forward", project=False), self.run(back[word], live, "backward", project=False)), 2)
                scores[a : a + LANES] = self.pool(states, live)[3]
        return text, start, size, scores

    def slopes(self, x: np.ndarray, live: np.ndarray, target: np.ndarray) -> tuple[dict, np.ndarray, float]:
        """Slopes of the mean log loss in the weights (without spelling) and in the inputs, and the loss."""
        kept = {"forward": [], "backward": []}
        states = np.concatenate([self.run(x, live, s, kept[s]) for s in kept], 2)
        looked, share, mean, score = self.pool(states, live)
        chance = _sigmoid(score)
        loss = float(-np.mean(np.where(target > 0, np.log(chance + 1e-9), np.log(1 - chance + 1e-9))))
        d_score = ((chance - target) / len(target)).astype(np.float32)
        d = {"out": mean.T @ d_score, "out_b": np.array([d_score.sum()], np.float32)}
        d_mean = d_score[:, None] * self.w["out"]
        d_states = share[..., None] * d_mean
        d_share = np.einsum("tnh,nh->tn", states, d_mean)
        d_level = share * (d_share - (share * d_share).sum(axis=0))
        d["look_v"] = np.einsum("tn,tnh->h", d_level, looked)
        d_look = d_level[..., None] * self.w["look_v"] * (1 - looked**2)
        d["look"] = np.einsum("tni,tnj->ij", states, d_look)
        d_states = d_states + d_look @ self.w["look"].T
        d_x, h = np.zeros_like(x), HIDDEN
        for i, side in enumerate(kept):
            wx, wh = self.w[side + "_x"], self.w[side + "_h"]
            d_wx, d_wh, d_b = np.zeros_like(wx), np.zeros_like(wh), np.zeros(3 * h, np.float32)
            d_state = np.zeros((x.shape[1], h), np.float32)
            for t, state, old, reset, update, new in reversed(kept[side]):
                total = d_state + d_states[t][:, i * h : (i + 1) * h]
                held = live[t][:, None]
                d_new = total * held * (1 - update) * (1 - new**2)
                d_update = -total * held * (new - state) * update * (1 - update)
                d_reset = d_new * old[:, 2 * h :] * reset * (1 - reset)
                d_old = np.concatenate((d_reset, d_update, d_new * reset), 1)
                d_given = np.concatenate((d_reset, d_update, d_new), 1)
                d_wx += x[t].T @ d_given
                d_wh += state.T @ d_old
                d_b += d_given.sum(axis=0)
                d_x[t] += d_given @ wx.T
                d_state = total * (1 - held * (1 - update)) + d_old @ wh.T
            d[side + "_x"], d[side + "_h"], d[side + "_b"] = d_wx, d_wh, d_b
        return d, d_x, loss


def lexicon_of(w: Words, label: np.ndarray, chosen: np.ndarray, least: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """Words that at least `least` chosen texts hold, and how much likelier they are in toxic ones (log odds, drawn to 0)."""
    counts = []
    for mark in (1, 0):
        held = (chosen & (label == mark))[w.owner]
        counts.append(document_counts(w.owner[held], w.which[held], max(1, len(w.hashes))))
    toxic, clean = counts
    n = toxic + clean
    odds = np.log((toxic + 0.5) / ((chosen & (label == 1)).sum() + 1)) - np.log((clean + 0.5) / ((chosen & (label == 0)).sum() + 1))
    known = np.flatnonzero(n >= least)
    return w.hashes[known], (np.clip(odds, -3, 5) * n / (n + 8.0) / 2)[known]


def first_of_copies(texts: list[str], bands: int = 16, rows: int = 4) -> np.ndarray:
    """Places of the texts that share no band of their similarity sketch with an earlier one: near copies would make words of one text
    look like words of many."""
    owner, hashes = shingle_sets(pa.array(texts, pa.string()), 2)
    sketch = similarity_sketches(owner, hashes, len(texts), bands * rows).reshape(len(texts), bands, rows)
    seen, kept = set(), []
    for i in range(len(texts)):
        keys = {(b, sketch[i, b].tobytes()) for b in range(bands)}
        if not keys & seen:
            kept.append(i)
        seen |= keys
    return np.array(kept, np.int64)


def train(texts: list[str], toxic: list[int], seed: int = 11) -> Network:
    """A network from labelled texts.  The lexicon that a text is trained with is weighed on the other half of the texts, so that
    the network learns how far a lexicon can be trusted; in use, the lexicon of all texts stands in.  A text is as toxic as its worst
    window: each epoch learns the worst window of every text and, of clean texts, another one.  Near copies are taken once."""
    single = first_of_copies(texts)
    texts, toxic = [texts[i] for i in single], [toxic[i] for i in single]
    label = np.array(toxic, np.int64)
    rng = np.random.RandomState(seed)
    w = Words(*buffers(pa.array(texts, pa.string())))
    half = np.zeros(len(label), np.int64)
    half[rng.permutation(len(label))[: len(label) // 2]] = 1
    everything = np.ones(len(label), bool)
    net = Network(*(lexicon_of(w, label, everything) if len(w.hashes) else (np.zeros(0, np.uint64), np.zeros(0))), seed)
    if len(set(toxic)) < 2 or not len(w.hashes):
        net.w["out"][:], net.w["out_b"][:] = 0, -5.0  # nothing to learn from: nothing is toxic
        return net
    # The lexicon of the half that a text is not in, and the worth it gives each distinct word.
    apart = [lexicon_of(w, label, half != i) for i in (0, 1)]
    others = np.stack([np.append(worth, 0)[find(known, w.hashes)].astype(np.float32) for known, worth in apart])
    lists, begin = w.lists(BUCKETS)
    runs = np.maximum(4 * np.diff(w.places) - 6, 1)
    names = Network.NAMES
    rule = Adam([net.w[k] for k in names], 0.02)
    for _ in range(EPOCHS):
        text, start, size, score = net.score(w)
        order = np.lexsort((-score, text))
        worst = order[np.concatenate(([True], text[order][1:] != text[order][:-1]))]
        other = rng.permutation(len(text))
        other = other[(label[text[other]] == 0)][: (label == 0).sum()]
        chosen = np.concatenate((worst, other))
        for part in np.array_split(rng.permutation(chosen), max(1, len(chosen) // 64)):
            place = np.minimum(start[part] + np.arange(WIDTH)[:, None], len(w.which) - 1)
            live = (np.arange(WIDTH)[:, None] < size[part]).astype(np.float32)
            distinct, back = np.unique(w.which[place], return_inverse=True)
            back = back.reshape(place.shape)
            places, owner = pick(lists, begin, distinct)
            spelled = np.zeros((len(distinct), SPELLING), np.float32)
            np.add.at(spelled, owner, net.w["spelling"][places])
            x = np.concatenate((others[half[text[part]][None, :], w.which[place]][..., None], (spelled / runs[distinct][:, None])[back]), 2).astype(np.float32)
            slopes, d_x, _ = net.slopes(x, live, label[text[part]].astype(np.float32))
            d_word = np.zeros((len(distinct), SPELLING), np.float32)
            np.add.at(d_word, back.ravel(), d_x.reshape(-1, SPELLING + 1)[:, 1:])
            slopes["spelling"] = np.zeros_like(net.w["spelling"])
            np.add.at(slopes["spelling"], places, (d_word / runs[distinct][:, None])[owner])
            slopes["spelling"][-1] = 0
            rule.step([slopes[k] + 1e-4 * net.w[k] for k in names])
            net.w["spelling"][-1] = 0
    whole = net.lexicon, net.worth
    worst = np.full(len(label), -np.inf)
    for i in (0, 1):
        net.lexicon, net.worth = apart[i][0], np.append(apart[i][1], 0).astype(np.float32)
        text, _, _, score = net.score(w)
        mine = half[text] == i
        np.maximum.at(worst, text[mine], score[mine])
    net.lexicon, net.worth = whole
    net.w["out_b"] -= np.float32(best_cut(worst[np.isfinite(worst)], label[np.isfinite(worst)]) - np.log(THRESHOLD / (1 - THRESHOLD)))
    del w, lists, rule
    release()
    return net


def best_cut(scores: np.ndarray, label: np.ndarray, cost: float = 3.0) -> float:
    """Score from which on a text is called toxic: the middle of the widest gap among those cuts that lose least, a clean text called
    toxic counting `cost` times a toxic one missed (each as a share of its class)."""
    order = np.argsort(scores, kind="stable")
    s, y = scores[order], label[order]
    missed = np.concatenate(([0], np.cumsum(y == 1))) / max(1, (y == 1).sum())
    accused = np.concatenate((np.cumsum((y == 0)[::-1])[::-1], [0])) / max(1, (y == 0).sum())
    loss = missed + cost * accused
    edge = np.concatenate(([s[0] - 1], s, [s[-1] + 1]))
    best = np.flatnonzero(loss <= loss.min() + 1e-12)
    at = best[np.argmax(edge[best + 1] - edge[best])]
    return float((edge[at] + edge[at + 1]) / 2)


def _score_rows(net: Network) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches):
        for batch in slices(batches, "_text"):
            w = Words(*buffers(batch.column(batch.schema.get_field_index("_text"))))
            text, _, _, score = net.score(w)
            worst = np.full(batch.num_rows, -np.inf)
            np.maximum.at(worst, text, score)
            chance = np.where(np.isfinite(worst), _sigmoid(np.where(np.isfinite(worst), worst, 0)), 0.0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(chance.astype(float))], names=[*batch.schema.names, "score"])

    return run


def score_texts(docs: DataFrame, net: Network, carry: list[str], text: str = "text") -> DataFrame:
    """The columns in `carry`, then `score` (0 to 1) and `predicted` (1 from 0.7 on), for every document.

    The score of a whole text is that of its worst window of 40 words; windows begin every 10 words.  Null and empty text scores 0.
    Rows are judged one by one, so repeated rows agree and empty frames stay empty.
    """
    picked = text_batches(docs).select(*[F.col(f"`{c}`") for c in carry], F.col(f"`{text}`").alias("_text"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in picked.schema.fields)
    scored = picked.mapInArrow(_score_rows(net), f"{fields}, score double").drop("_text")
    return scored.withColumn("predicted", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0))
