import random

from pyspark.sql import functions as F

from codeatlas.llm.connected import components
from codeatlas.llm.minhash import drop_near_duplicates, near_duplicates
from codeatlas.llm.minhash_kernels import linked_in_block, shingle_sets, similarity_sketches
from codeatlas.llm.substring_dedup import drop_repeated_windows
from tests.llm import plain


def test_near_duplicates_agree_with_all_pairs(spark, docs, corpus):
    for k in (2, 5):
        found = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(docs(corpus), k=k).collect()}
        assert found == plain.components(corpus, k, 80)


def test_near_duplicates_of_odd_rows(spark, docs):
    rows = [(None, "a b c"), (5, "a b c"), (5, "a b c"), (7, None), (8, ""), (9, "a  b\tc"), (10, " ")]
    found = sorted((tuple(r) for r in near_duplicates(docs(rows), k=2).select("doc_id", "n_shingles", "component_id", "kept").collect()), key=str)
    assert found == sorted([(None, 2, None, False), (5, 2, 5, True), (5, 2, 5, True), (7, 0, 7, True), (8, 0, 8, True), (9, 2, 5, False), (10, 0, 10, True)], key=str)
    assert near_duplicates(docs(rows).limit(0)).collect() == []
    kept = drop_near_duplicates(docs(rows), k=2)
    assert kept.columns == docs(rows).columns
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted([None, 5, 7, 8, 10], key=str)


def test_a_large_group_of_near_copies(spark, docs):
    rng = random.Random(9)
    base = [f"b{i}" for i in range(120)]
    rows = []
    for i in range(700):
        copy = list(base)
        for p in rng.sample(range(120), rng.randrange(0, 14)):
            copy[p] = f"n{rng.randrange(10**7)}"
        rows.append((i, " ".join(copy)))
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(docs(rows), k=2).collect()}
    assert found == plain.components(rows, 2, 80)


def test_sketches_fill_and_estimate():
    import numpy as np
    import pyarrow as pa

    a, b = [f"t{i}" for i in range(300)], [f"t{i}" for i in range(60, 360)]
    owner, hashes = shingle_sets(pa.array([" ".join(a), " ".join(b), "x", None]), 1)
    sketch = similarity_sketches(owner, hashes, 4, 400)
    assert (sketch[:3] != np.uint64(0xFFFFFFFFFFFFFFFF)).all()
    assert abs((sketch[0] == sketch[1]).mean() - 240 / 360) < 0.1


def test_blocks_find_links_between_groups():
    import pandas as pd

    frame = pd.DataFrame({"id": [1, 2, 3], "part": [1, 2, 3], "asked": [False, False, True], "shingles": [[1, 2, 3, 4, 5], [7, 8], [1, 2, 3, 4]]})
    assert linked_in_block(80)(frame).values.tolist() == [[3, 1]]


def test_components_of_a_path_and_a_star(spark):
    path = [(i, i + 1) for i in range(40)]
    star = [(1000, 100 + i) for i in range(50)]
    found = {r.node: r.root for r in components(spark.createDataFrame(path + star, "a long, b long")).collect()}
    assert {found[i] for i in range(41)} == {0}
    assert {found[i] for i in range(100, 150)} | {found[1000]} == {100}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_repeated_windows_agree_with_plain(spark, docs, corpus):
    found = {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in drop_repeated_windows(docs(corpus)).collect()}
    assert found == plain.kept_words(corpus)


def test_repeated_windows_of_odd_rows(spark, docs):
    run = " ".join(f"q{i}" for i in range(20))
    rows = [(None, run), (1, run), (1, run), (2, f"a {run}  b"), (3, None), (4, ""), (5, f"{run} {run}"), (6, "z " * 45)]
    found = sorted((tuple(r) for r in drop_repeated_windows(docs(rows)).collect()), key=str)
    assert found == sorted([
        (None, 20, 0, run), (1, 20, 0, run), (1, 20, 0, run), (2, 22, 20, "a b"), (3, 0, 0, ""), (4, 0, 0, ""), (5, 40, 40, ""), (6, 45, 44, "z"),
    ], key=str)
    assert drop_repeated_windows(docs(rows).limit(0)).collect() == []
    digests = drop_repeated_windows(docs(rows), digest=True).filter("doc_id = 3").first()
    assert digests.kept_sha256 == "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"


def test_passages_that_travel_in_many_chunks(spark, docs, monkeypatch):
    from codeatlas.llm import substring_dedup, substring_kernels

    monkeypatch.setattr(substring_kernels, "CHUNK_BYTES", 2000)
    monkeypatch.setattr(substring_dedup, "BUCKET_BYTES", 5000)
    rng = random.Random(2)
    passage = " ".join(f"p{i}" for i in range(70))
    rows = [(i, " ".join(f"u{rng.randrange(50)}" for _ in range(30)) + "\n" + passage) for i in range(200)]
    found = {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in drop_repeated_windows(docs(rows).repartition(7)).collect()}
    assert found == plain.kept_words(rows)


def test_a_frequent_run_among_varying_neighbours_is_shared_out(spark, docs, monkeypatch):
    import pyarrow as pa

    from codeatlas.llm import substring_dedup, substring_kernels as K

    rng = random.Random(3)

    def minimiser(text):  # the least hash that the runs of three words of a text have
        data, offsets = K.buffers(pa.array([text]))
        starts, ends, first = K.words(data, offsets)
        return int(K.window_hashes(K.span_hashes(data, starts, ends), first, 3, 7)[0].min())

    phrase = min((f"a{i} b{i} c{i}" for i in range(2000)), key=minimiser)
    shared = " ".join(f"s{i}" for i in range(25))
    rows = [(i, " ".join([*(f"u{rng.randrange(10**6)}" for _ in range(25)), phrase, *(f"v{rng.randrange(10**6)}" for _ in range(25))])) for i in range(300)]
    rows += [(300 + i, f"{shared} {phrase} tail{i % 3} {shared}") for i in range(60)]
    monkeypatch.setattr(substring_dedup, "BUCKET_BYTES", 2000)
    monkeypatch.setattr(substring_dedup, "SPLIT_WINDOWS", 1000)
    largest = []
    real = substring_dedup.packed_rows

    def watched(*args):
        batch = pa.RecordBatch.from_arrays([pa.array([i for i, _ in rows]), pa.array([t for _, t in rows])], names=["id", "text"])
        sizes = [K.unpack(p)[0][:, 2].sum() for out in real(*args)([batch]) for p in out.column(1).to_pylist()]
        largest.append((max(sizes), sum(sizes)))
        return real(*args)

    monkeypatch.setattr(substring_dedup, "packed_rows", watched)
    found = {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in drop_repeated_windows(docs(rows).repartition(3)).collect()}
    assert found == plain.kept_words(rows)
    assert largest[0][0] < 0.1 * largest[0][1]
