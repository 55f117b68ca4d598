import random

import pytest

LONG = 60_000


def prose(rng, n, vocabulary=4000):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


@pytest.fixture(scope="session")
def corpus():
    """(id, text) with exact copies, a star of near copies, a chain, shared passages, junk and a very long text."""
    rng = random.Random(4)
    base = prose(rng, 150).split()
    texts = [prose(rng, rng.randrange(1, 120)) for _ in range(60)]
    for edits in [1, 2, 3, 4, 5, 7, 9, 12, 16, 24] * 5:
        copy = list(base)
        for p in rng.sample(range(len(copy)), edits):
            copy[p] = f"x{rng.randrange(10**6)}"
        texts.append(" ".join(copy))
    texts += [texts[3]] * 30 + [texts[0].upper()]
    chain = list(base[:100])
    for step in range(8):
        chain = chain[4:] + [f"c{step}{i}" for i in range(4)]
        texts.append(" \n ".join(chain))
    passage = prose(rng, 60)
    texts += [f"{prose(rng, 30)}\n{passage}\n{prose(rng, rng.randrange(40))}" for _ in range(25)]
    texts += ["", None, " \t\n", "one", "One", "two words", "a " * 100, "\n".join(["same line here"] * 12), prose(rng, LONG), "### $$$ <b> | % é ü ñ"]
    order = list(range(len(texts)))
    rng.shuffle(order)
    return [(i, texts[p]) for i, p in enumerate(order)]


@pytest.fixture
def docs(spark):
    """Frame of documents from (id, text) rows, with columns named like the operators' own."""

    def make(rows, sources=("a", "b", None), lang="en"):
        full = [(i, t, lang, sources[n % len(sources)], None if t is None else len(t), n, "clash") for n, (i, t) in enumerate(rows)]
        return spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long, id long, kept string")

    return make
