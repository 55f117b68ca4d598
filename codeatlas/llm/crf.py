"""Linear-chain conditional random fields in numpy: training, marginals of whole sequences, best paths."""

from __future__ import annotations

import sys

import numpy as np
from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# A sequence begins with a step from an unseen label, all labels being as likely there.  Scores are given for each
# element and label (emit) and for each step from label to label (step); sequences lie end to end, `first` tells where each begins.


def _unit(x: np.ndarray, axis) -> np.ndarray:
    return x / np.maximum(x.max(axis=axis, keepdims=True), 1e-30)


def marginals(emit: np.ndarray, first: np.ndarray, step: np.ndarray, block: int = 64) -> np.ndarray:
    """Probability of each label at each element, by forward-backward.

    Sequences are cut into blocks that are worked on side by side: the product of each block's steps, then the vectors at the
    borders of blocks along each sequence, then the elements inside.  The result is that of the plain recursion.
    """
    n, labels = emit.shape
    out = np.zeros((n, labels), np.float32)
    if not n:
        return out
    potential = np.exp(emit - emit.max(axis=1, keepdims=True)).astype(np.float32)
    move = np.exp(step - step.max()).astype(np.float32)
    lengths = np.diff(first)
    count = -(-lengths // block)
    owner = np.repeat(np.arange(len(lengths)), count)
    turn = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
    start = first[owner] + turn * block
    size = np.minimum(block, first[owner + 1] - start)
    order = np.argsort(-size, kind="stable")
    live = [int(np.searchsorted(-size[order], -t, "left")) for t in range(block)]  # blocks longer than t come first
    at = start[order]

    product = np.repeat(np.eye(labels, dtype=np.float32)[None], len(order), 0)
    for t in range(block):
        k = live[t]
        if not k:
            break
        product[:k] = _unit((product[:k].reshape(-1, labels) @ move).reshape(k, labels, labels) * potential[at[:k] + t][:, None, :], (1, 2))
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    before = np.full((len(order), labels), 1.0 / labels, np.float32)
    after = np.ones((len(order), labels), np.float32)
    top = np.cumsum(count) - count  # number of a sequence's first block
    for j in range(1, int(count.max())):
        b = top[count > j] + j
        before[b] = _unit(np.einsum("bi,bij->bj", before[b - 1], product[place[b - 1]]), 1)
    for j in range(1, int(count.max())):
        b = top[count > j] + count[count > j] - 1 - j
        after[b] = _unit(np.einsum("bij,bj->bi", product[place[b + 1]], after[b + 1]), 1)
    alpha = before[order]
    for t in range(block):
        k = live[t]
        if not k:
            break
        alpha[:k] = _unit((alpha[:k] @ move) * potential[at[:k] + t], 1)
        out[at[:k] + t] = alpha[:k]
    beta, last = after[order], size[order]
    for t in range(block - 1, -1, -1):
        k = live[t]
        if not k:
            continue
        out[at[:k] + t] *= beta[:k]
        beta[:k] = _unit((potential[at[:k] + t] * beta[:k]) @ move.T, 1)
    return out / np.maximum(out.sum(axis=1, keepdims=True), 1e-30)


def best_path(emit: np.ndarray, first: np.ndarray, step: np.ndarray) -> np.ndarray:
    """The likeliest labels of each sequence (Viterbi), all sequences side by side."""
    n, labels = emit.shape
    out = np.zeros(n, np.int64)
    lengths = np.diff(first)
    order = np.argsort(-lengths, kind="stable")
    order = order[lengths[order] > 0]
    if not len(order):
        return out
    longest = int(lengths[order[0]])
    live = np.searchsorted(-lengths[order], -np.arange(longest), "left")
    start = first[order]
    came = np.zeros((n, labels), np.int8)
    score = np.zeros((len(order), labels))
    for t in range(longest):
        k = live[t]
        ways = score[:k, :, None] + step[None]
        came[start[:k] + t] = ways.argmax(axis=1)
        score[:k] = ways.max(axis=1) + emit[start[:k] + t]
    state = np.zeros(len(order), np.int64)
    for t in range(longest - 1, -1, -1):
        k = live[t]
        ending = lengths[order[:k]] - 1 == t
        state[:k][ending] = score[:k][ending].argmax(axis=1)
        place = start[:k] + t
        out[place] = state[:k]
        state[:k] = came[place, state[:k]]
    return out


def gradient(emit: np.ndarray, labels: np.ndarray, step: np.ndarray, mask: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Mean log loss a sequence, and its slopes in `emit` (batch, length, labels) and `step`, for equally long padded
    sequences; `mask` is 1 for true elements, which come first."""
    size, length, n = emit.shape
    potential = np.exp(emit - emit.max(axis=2, keepdims=True)) * mask[..., None] + (1 - mask[..., None])
    move = np.exp(step)
    still = np.eye(n)
    alpha, scale = np.zeros((length + 1, size, n)), np.ones((length, size))
    alpha[0] = 1.0 / n
    for t in range(length):
        on = mask[:, t, None]
        value = np.where(on > 0, (alpha[t] @ move) * potential[:, t], alpha[t] @ still)
        scale[t] = value.sum(axis=1)
        alpha[t + 1] = value / scale[t][:, None]
    beta = np.ones((size, n))
    d_emit, d_step = np.zeros_like(emit), np.zeros_like(step)
    index = np.arange(size)
    for t in range(length - 1, -1, -1):
        on = mask[:, t]
        marginal = alpha[t + 1] * beta
        marginal /= marginal.sum(axis=1, keepdims=True)
        d_emit[:, t] = marginal * on[:, None]
        d_emit[index, t, labels[:, t]] -= on
        ahead = potential[:, t] * beta
        pair = alpha[t][:, :, None] * move[None] * ahead[:, None, :]
        pair *= (on / pair.sum(axis=(1, 2)))[:, None, None]
        d_step += pair.sum(axis=0)
        if t:
            np.add.at(d_step, (labels[:, t - 1], labels[:, t]), -on)
        else:  # the unseen label before the first one
            prior = move[:, labels[:, 0]] / move[:, labels[:, 0]].sum(axis=0)
            np.add.at(d_step.T, labels[:, 0], -(prior * on).T)
        beta = np.where(on[:, None] > 0, (ahead @ move.T), beta)
        beta /= beta.max(axis=1, keepdims=True)
    top = emit.max(axis=2)
    true = np.take_along_axis(emit, labels[..., None], 2)[..., 0]
    steps = (step[labels[:, :-1], labels[:, 1:]] * mask[:, 1:]).sum() if length > 1 else 0.0
    begin = np.log(move[:, labels[:, 0]].mean(axis=0)).sum()
    loss = (np.log(scale).sum() + (top * mask).sum() - (true * mask).sum() - steps - begin) / size
    return float(loss), d_emit / size, d_step / size


class Adam:
    """Steps of the Adam rule on a list of arrays, in place."""

    def __init__(self, arrays: list[np.ndarray], rate: float):
        self.arrays, self.rate, self.turn = arrays, rate, 0
        self.moments = [(np.zeros_like(a), np.zeros_like(a)) for a in arrays]

    def step(self, slopes: list[np.ndarray]) -> None:
        self.turn += 1
        for a, g, (m, v) in zip(self.arrays, slopes, self.moments):
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            a -= self.rate * (m / (1 - 0.9**self.turn)) / (np.sqrt(v / (1 - 0.999**self.turn)) + 1e-8)
