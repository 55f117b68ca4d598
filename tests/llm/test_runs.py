import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from codeatlas.llm import queries_runs
from codeatlas.llm.periodic_runs import collapse_runs
from codeatlas.llm.run_kernels import WaveletTree, periodic_runs, substring_ranks
from tests.llm.plain import words


def plain_runs(w, least=6, times=4):
    """(start, length, period) by definition: each longest stretch for each period, unless a smaller period fits it too."""
    out, n = [], len(w)
    for q in range(1, n // times + 1):
        i = 0
        while i + q < n:
            stop = i
            while stop + q < n and w[stop] == w[stop + q]:
                stop += 1
            length = stop + q - i
            if stop > i and length >= max(least, times * q):
                stretch = w[i : i + length]
                if not any(all(stretch[x] == stretch[x + r] for x in range(length - r)) for r in range(1, q)):
                    out.append((i, length, q))
            i = max(stop, i + 1) if stop > i else i + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def collapse(w, runs):
    gone = {p for s, n, q in runs for p in range(s + q, s + n)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


def by_kernel(texts):
    first = np.concatenate(([0], np.cumsum([len(t) for t in texts])))
    keys = np.array([hash((i, x)) for i, t in enumerate(texts) for x in t], np.int64).astype(np.uint64)
    out = [[] for _ in texts]
    for t, *run in zip(*(x.tolist() for x in periodic_runs(keys, first))):
        out[t].append((run[0], run[1], run[2]))
    return out


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2), max_size=70), min_size=1, max_size=4))
def test_runs_of_small_alphabets(texts):
    assert by_kernel(texts) == [plain_runs(t) for t in texts]


def test_runs_of_many_periods():
    rng = random.Random(5)
    texts = []
    for q in [*range(1, 40), 63, 64, 65, 127, 128, 129]:
        for times in (3.9, 4, 4.3, 6):
            unit = [f"u{rng.randrange(60)}" for _ in range(q)]
            body = (unit * 8)[: int(times * q)]
            texts.append([f"x{i}" for i in range(rng.randrange(9))] + body + [f"y{i}" for i in range(rng.randrange(9))])
    texts.append(("a b " * 30 + "c " + "a b " * 30 + "a a a a a a a a").split() * 5)
    fib = ["a", "ab"]
    while len(fib[-1]) < 600:
        fib.append(fib[-1] + fib[-2])
    texts += [list(fib[-1]), list("a" * 500), list("ab" * 300), list("aab" * 100 + "aba" * 100), [], ["one"]]
    assert by_kernel(texts) == [plain_runs(t) for t in texts]


def test_suffix_ranks_and_range_successors():
    rng = np.random.RandomState(0)
    text = rng.randint(0, 3, 200).astype(np.uint64)
    suffixes = sorted(range(200), key=lambda i: text[i:].tolist())
    assert np.argsort(substring_ranks(text)[-1]).tolist() == suffixes
    values = rng.permutation(200)
    tree = WaveletTree(values, 8)
    low, high, bound = rng.randint(0, 100, 50), rng.randint(120, 201, 50), rng.randint(0, 200, 50)
    assert tree.below(low, high, bound).tolist() == [int((values[a:b] < x).sum()) for a, b, x in zip(low, high, bound)]
    n = np.minimum(rng.randint(0, 20, 50), high - low - 1)
    assert tree.nth(low, high, n).tolist() == [sorted(values[a:b])[k] for a, b, k in zip(low, high, n)]


def odd_rows():
    rng = random.Random(8)
    texts = [" ".join(f"w{rng.randrange(30)}" for _ in range(rng.randrange(300))) for _ in range(150)]
    texts += [None, "", " \t\n", "z " * 45, "a\tb\n" * 20 + "é ü " * 9, "x  y " * 3, "lone", "w " * 20_000 + "end", " ".join(str(i % 700) for i in range(30_000))]
    return [(i, t) for i, t in enumerate(texts)] + [(None, "p q " * 8), (3, "again " * 9)]


def test_collapsed_texts_agree_with_plain(spark, docs):
    rows = odd_rows()
    small = [r for r in rows if len(r[1] or "") < 3000]
    found = sorted(((r.doc_id, r.n_words, tuple(map(tuple, r.runs)), r.collapsed) for r in collapse_runs(docs(small)).collect()), key=str)
    wanted = sorted(((i, len(w := words(t)), tuple(runs := plain_runs(w)), collapse(w, runs)) for i, t in small), key=str)
    assert found == wanted
    long = {r.n_words: (list(map(tuple, r.runs)), r.collapsed) for r in collapse_runs(docs([r for r in rows if len(r[1] or "") >= 3000])).collect()}
    assert long[20_001] == ([(0, 20_000, 1)], "w end")
    assert long[30_000] == ([(0, 30_000, 700)], " ".join(map(str, range(700))))
    assert collapse_runs(docs(rows).limit(0)).collect() == []
    with pytest.raises(ValueError):
        collapse_runs(docs(rows), least_periods=2)


def test_query_agrees_with_plain(spark, docs, monkeypatch):
    rows = [r for r in odd_rows() if len(r[1] or "") < 3000]
    rows += [(i, t) for i, (_, t) in enumerate(rows, 1000)]
    monkeypatch.setattr(queries_runs, "table", lambda *_: docs(rows))

    def told(doc, text):
        w = words(text)
        n, h = len(w), None if doc is None else zlib.crc32(str(doc).encode())
        if h is not None and h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[a + (i - a) % p] if i >= a else w[i] for i in range(n)]
        runs = plain_runs(w)
        top = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        return (doc, len(runs), *(top or (None,) * 3), top and 1000 * top[1] // top[2], sha("".join(f"{s},{m},{q}\n" for s, m, q in runs)), sha(collapse(w, runs)))

    got = sorted((tuple(r) for r in queries_runs.op13_periodic_runs(spark, "").collect()), key=str)
    assert got == sorted((told(*r) for r in rows), key=str)
    assert sum(r[1] > 0 for r in got) > 20
