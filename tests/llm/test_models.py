import random
import tracemalloc

import numpy as np
import pyarrow as pa

from codeatlas.llm import crf, language_id, quality_rules, toxicity
from codeatlas.llm.html_extraction import extract_main_text
from codeatlas.llm.html_kernels import align, main_text, parse, shape_of
from pyspark.sql import functions as F
from tests.llm import plain


def speech(rng, lang, n):
    parts = {"x": ["ka", "to", "mi"], "y": ["sch", "ung", "eit"], "z": ["oué", "eaux", "ê"]}[lang]
    return " ".join("".join(rng.choice(parts) for _ in range(rng.randrange(1, 4))) for _ in range(n))


def chance(emit, step):
    """Marginals by the plain recursion."""
    n = len(step)
    ahead, back, out = [np.ones(n) / n], np.ones(n), []
    for e in emit:
        v = (ahead[-1] @ np.exp(step)) * np.exp(e)
        ahead.append(v / v.sum())
    for t in range(len(emit) - 1, -1, -1):
        out.append(ahead[t + 1] * back / (ahead[t + 1] * back).sum())
        back = np.exp(step) @ (np.exp(emit[t]) * back)
        back /= back.sum()
    return np.array(out[::-1])


def test_marginals_and_paths_agree_with_plain_recursions():
    from itertools import product

    rng = np.random.RandomState(0)
    first, step = np.array([0, 0, 90, 91, 150]), rng.randn(3, 3)
    emit = rng.randn(150, 3)
    found = crf.marginals(emit, first, step, block=8)
    for a, b in zip(first, first[1:]):
        if b > a:
            assert np.abs(found[a:b] - chance(emit[a:b], step)).max() < 1e-5
    short = np.array([0, 5, 5, 9])
    path = crf.best_path(emit[:9], short, step)
    for a, b in zip(short, short[1:]):
        if b > a:
            def worth(labels):
                begin = max(step[i, labels[0]] for i in range(3))
                return begin + sum(emit[a + t, x] for t, x in enumerate(labels)) + sum(step[x, y] for x, y in zip(labels, labels[1:]))

            assert max(product(range(3), repeat=b - a), key=worth) == tuple(path[a:b])


def test_slopes_agree_with_differences():
    rng = np.random.RandomState(1)
    emit, step, mask = rng.randn(3, 5, 3), rng.randn(3, 3), np.ones((3, 5))
    labels = rng.randint(0, 3, (3, 5))
    mask[1, 3:] = 0
    loss, d_emit, d_step = crf.gradient(emit, labels, step, mask)
    for array, slope, place in ((emit, d_emit, (0, 2, 1)), (emit, d_emit, (1, 4, 0)), (step, d_step, (1, 2)), (step, d_step, (0, 0))):
        array[place] += 1e-6
        assert abs((crf.gradient(emit, labels, step, mask)[0] - loss) / 1e-6 - slope[place]) < 1e-4
        array[place] -= 1e-6


def test_language_of_held_out_and_mixed_texts(spark, docs):
    rng = random.Random(3)
    rows = [(i, speech(rng, "xyz"[i % 3], rng.randrange(5, 60))) for i in range(300)]
    frame = docs(rows).withColumn("lang", F.element_at(F.array(*[F.lit(x) for x in "xyz"]), (F.col("doc_id") % 3 + 1).cast("int")))
    learn = F.col("doc_id") % 4 != 2
    model = language_id.train(*language_id.training_sample(frame, learn))
    found = {r.doc_id: r for r in language_id.identify(frame, model, ["doc_id", "kept"]).collect()}
    held = [i for i, _ in rows if i % 4 == 2]
    assert np.mean([found[i].lang_pred == "xyz"[i % 3] for i in held]) > 0.97 and all(0 <= r.score <= 1 for r in found.values())
    mixed = speech(rng, "x", 30) + " " + speech(rng, "y", 20)
    w, share = language_id.word_languages(model, pa.array([mixed]))
    assert (share[:30].argmax(axis=1) == 0).mean() > 0.9 and (share[30:].argmax(axis=1) == 1).mean() > 0.9
    odd = [(1, None), (2, ""), (3, "12 34 !"), (4, "… — €"), (5, "12 ka to mi katomi"), (None, "schung eit"), (7, speech(rng, "z", 50_000)), (7, "mi ka")]
    got = {(r.doc_id, r.text): (r.lang_pred, r.score) for r in language_id.identify(docs(odd), model, docs(odd).columns).collect()}
    assert [got[i, t][0] for i, t in odd] == ["und"] * 4 + ["x", "y", "z", "x"] and all(got[i, t][1] == 0 for i, t in odd[:4])
    rest = language_id.drop_unidentified(frame.filter("doc_id > 10").unionByName(docs(odd)), learn).collect()
    assert {r.doc_id for r in rest if r.doc_id is None or r.doc_id <= 10} == {5, None, 7} and len(rest) == 289 + 4
    assert language_id.identify(docs(odd).limit(0), model, ["doc_id"]).collect() == []
    empty = language_id.train([], [])
    assert {r.lang_pred for r in language_id.identify(docs(odd), empty, ["doc_id"]).collect()} == {"und"}


def test_quality_counts_agree_with_plain(spark, docs, corpus):
    model = quality_rules.train([], [])
    found = {r.doc_id: r for r in quality_rules.rate(docs(corpus), model, ["doc_id"]).collect()}
    for i, text in corpus:
        r = found[i]
        expected = plain.counts(text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == expected
        assert r.base_failed == (expected[0] < 20 or 100 * expected[4] > 30 * expected[0]) and r.kept == (not r.base_failed)
    assert quality_rules.rate(docs(corpus).limit(0), model, ["doc_id"]).collect() == []


def test_lines_of_junk_are_told_from_content(spark, docs):
    rng = random.Random(5)
    good = ["\n".join(" ".join(f"word{rng.randrange(3000)}" for _ in range(rng.randrange(8, 20))) + "." for _ in range(rng.randrange(2, 9))) for _ in range(120)]
    junk = ["\n".join(" ".join(f"word{rng.randrange(3000)}{rng.choice(['###', '$$$', '&&&'])}" for _ in range(12)) for _ in range(rng.randrange(2, 9))) for _ in range(120)]
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(160)], "doc_id long, quality int, toxic int")
    rows = [(i, (good if i % 2 else junk)[i // 2]) for i in range(240)]
    model = quality_rules.train(*quality_rules.training_sample(docs(rows), labels))
    found = {r.doc_id: r.kept for r in quality_rules.rate(docs(rows), model, ["doc_id"]).collect()}
    assert np.mean([found[i] == bool(i % 2) for i in range(160, 240)]) > 0.95
    half = docs([(1, good[0] + "\n" + good[1] + "\n" + good[2] + "\n" + junk[0][:60]), (1, good[0]), (None, junk[1])])
    assert {(r.doc_id, r.kept) for r in quality_rules.rate(half, model, ["doc_id"]).collect()} == {(1, True), (None, False)}


def test_network_slopes_agree_with_differences():
    rng = np.random.RandomState(2)
    net = toxicity.Network(np.zeros(0, np.uint64), np.zeros(0))
    for k in net.NAMES:
        net.w[k] = (0.5 * rng.randn(*net.w[k].shape))
    x, live = rng.randn(6, 4, toxicity.SPELLING + 1), np.ones((6, 4))
    live[4:, 1] = 0
    target = np.array([1.0, 0, 1, 0])
    slopes, d_x, loss = net.slopes(x, live, target)
    for array, slope, place in [(net.w[k], slopes[k], (0,) * net.w[k].ndim) for k in net.NAMES if k != "spelling"] + [(x, d_x, (2, 1, 3)), (x, d_x, (5, 0, 0))]:
        array[place] += 1e-4
        up = net.slopes(x, live, target)[2]
        array[place] -= 2e-4
        down = net.slopes(x, live, target)[2]
        array[place] += 1e-4
        assert abs((up - down) / 2e-4 - slope[place]) < 2e-3, place


def test_toxic_documents_are_caught_and_clean_ones_left(spark, docs):
    rng = random.Random(7)
    bad = ["wretch", "fiend", "villain", "brute"]

    def text(toxic):
        w = [f"w{rng.randrange(400)}" for _ in range(rng.randrange(10, 300))]
        for _ in range(rng.randrange(3, 6) if toxic else 0):
            w.insert(rng.randrange(len(w)), rng.choice(bad))
        return " ".join(w)

    rows = [(i, text(i % 2)) for i in range(600)]
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(400)], "doc_id long, quality int, toxic int")
    net = toxicity.train(*toxicity.training_sample(docs(rows), labels, F.col("doc_id") >= 0))
    odd = [(1000, None), (1001, ""), (1002, " \n"), (1003, " ".join(["w1 w2 w3"] * 20_000) + " wretch fiend brute"), (None, "w1 w2"), (1004, "w1"), (1004, "w1")]
    found = {(r.doc_id, r.text): r for r in toxicity.score_texts(docs(rows + odd).withColumn("copy", F.col("text")), net, ["doc_id", "copy"]).withColumnRenamed("copy", "text").collect()}
    held = [(found[i, t].predicted, i % 2) for i, t in rows if i >= 400]
    assert np.mean([a == b for a, b in held]) > 0.95
    assert [found[i, t].score for i, t in odd[:3]] == [0, 0, 0] and found[odd[3]].predicted == 1 and found[odd[4]].predicted == 0
    assert toxicity.score_texts(docs(rows).limit(0), net, ["doc_id"]).collect() == []


def page(title, paragraphs, notice="Join our club today", menu="<nav><a href=/>Home</a></nav>", ends=True):
    body = "".join(f"<p>{p}" + ("</p>" if ends else "") for p in paragraphs)
    return (
        f"<!DOCTYPE html><html><head><title>{title}</title><style>p{{}}</style><script>var t='</p>';</script></head><body>{menu}<div class='cookie-notice'>We use cookies</div>"
        f"<article><h1>{title}</h1><div><span>{notice}</span></div>{body}<div id=comments><p>first!</p></div></article><aside>more</aside><footer>&copy; x</footer></body></html>"
    )


def test_main_text_is_the_varying_part_of_the_article(spark):
    rows = [(i, f"https://h.example/{i}", page(f"Title {i}", [f"one &amp; {i}", f"two\n  <b>bold</b>ness {i}"] + [f"more {n} {i}" for n in range(i % 4)], ends=i % 3 > 0)) for i in range(30)]
    rows += [(100, "https://alone.example/", page("Only", ["a<br>b"])), (101, None, "<p>plain"), (102, "https://h.example/x", None), (103, "bad", ""), (104, "https://h.example/0", rows[0][2])]
    rows += [(105, "https://c.example/", "<article><p>same"), *[(200 + i, "https://c.example/", "<article><p>same") for i in range(9)], (None, "https://d.example", "<div>" * 3000 + "deep")]
    frame = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, text string")
    found = {r.page_id: r.text for r in extract_main_text(frame).collect()}
    assert len(found) == len(rows)
    for i in range(30):
        assert found[i] == " ".join([f"Title {i}", f"one & {i}", f"two boldness {i}"] + [f"more {n} {i}" for n in range(i % 4)])
    assert found[104] == found[0] and found[100] == "Only Join our club today a b" and found[101] == "plain" and found[102] == "" and found[103] == ""
    assert found[105] == "same" and found[None] == "deep"
    assert extract_main_text(frame.limit(0)).collect() == []
    lengths = {r.page_id: r.n_chars for r in extract_main_text(frame).collect()}
    assert all(lengths[i] == len(t) for i, t in found.items())


def test_trees_are_aligned_by_labels_and_order():
    a = shape_of(parse("<div><p>1</p><p>2</p><ul><li>x</li></ul><h2>t</h2></div>"))[0]
    b = shape_of(parse("<div><h2>0</h2><p>1</p><table></table><ul><li>x</li><li>y</li></ul></div>"))[0]
    score, pairs = align(a, b)
    assert score == len(pairs) == 5  # root, div, p, ul, li: h2 stands elsewhere
    assert main_text(parse("<main>a <i>b</i>c<div class=AdBox>no</div> 1 < 2 <!-- x --></main>z"), set()) == "a bc 1 < 2"


def plain_matching(a, b):
    if a.label != b.label:
        return 0
    best = [[0] * (len(b.kids) + 1) for _ in range(len(a.kids) + 1)]
    for i, x in enumerate(a.kids, 1):
        for j, y in enumerate(b.kids, 1):
            best[i][j] = max(best[i - 1][j], best[i][j - 1], best[i - 1][j - 1] + plain_matching(x, y))
    return 1 + best[-1][-1]


def test_matchings_of_random_trees_are_largest_and_keep_order():
    rng = random.Random(11)

    def tree(depth):
        tag = rng.choice(["div", "ul", "dl"])
        return f"<{tag}>{''.join(tree(depth - 1) for _ in range(rng.randrange(5 if depth else 1)))}</{tag}>"

    for _ in range(150):
        (a, _, left), (b, _, right) = (shape_of(parse(tree(3) + tree(2))) for _ in range(2))
        score, pairs = align(a, b)
        assert score == len(pairs) == plain_matching(a, b)
        assert len({x for x, _ in pairs}) == len({y for _, y in pairs}) == score and all(left[x].label == right[y].label for x, y in pairs)
        assert [y for _, y in sorted(pairs)] == sorted(y for _, y in pairs)  # numbers are in reading order
        up = [{k.number: s.number for s in shapes for k in s.kids} for shapes in (left, right)]
        assert all((up[0][x], up[1][y]) in set(pairs) for x, y in pairs if x in up[0])


def test_deep_and_wide_pages_are_aligned_in_little_memory():
    deep = shape_of(parse("<div>" * 3000 + "<p>x"))[0]
    other = shape_of(parse("<div>" * 3000 + "<p>x<ul><li>y"))[0]
    assert align(deep, other)[0] == deep.size
    wide = shape_of(parse("<i></i><p><b></b></p>" * 2500 + "<h1>"))[0]
    most = shape_of(parse("<h2></h2>" + "<p><b></b></p><i></i>" * 2500 + "<h3>"))[0]
    tracemalloc.start()
    score, pairs = align(wide, most)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert score == len(pairs) == 1 + 2500 * 3 - 1 and peak < 100 << 20


def test_only_names_of_attributes_mark_side_parts():
    for attributes in ("style='overflow:hidden'", 'title="a hidden place"', 'href="?id=search"', "href=?id=search", "data-role=banner", "data-id='ads'", "aria-label='role=search'", "alt='x' data-hidden aria-hidden=false"):
        assert main_text(parse(f"<body {attributes}><div {attributes}><article {attributes}><p {attributes}>kept</p></article></div></body>"), set()) == "kept", attributes
    for attributes in ("hidden", "HIDDEN", "title=x hidden=''", "aria-hidden=true", "ROLE = 'search'", "id=ads", "title='id=main' class='top banner'", "data-x=y\nrole=banner"):
        assert main_text(parse(f"<main>a <div {attributes}>no</div>b</main>"), set()) == "a b", attributes


def test_every_passage_lies_in_one_window_wherever_it_stands():
    first = np.array([0, 7, 7, 47, 88, 400])
    text, start, size = toxicity.window_table(first)
    for t, (a, b) in enumerate(zip(first, first[1:])):
        mine = [(s, s + n) for s, n in zip(start[text == t], size[text == t])]
        assert all(a <= s < e <= b for s, e in mine) and len(set(mine)) == len(mine)
        for n in (1, 11, 20, 31):
            assert all(any(s <= at and at + n <= e for s, e in mine) for at in range(a, b - n + 1))


def test_texts_of_several_languages_are_kept(spark, docs):
    rng = random.Random(13)
    rows = [(i, speech(rng, "xyz"[i % 3], rng.randrange(5, 60))) for i in range(300)]
    mixed = [(1000 + i, " ".join(speech(rng, c, 40) for c in "xyz")) for i in range(5)] + [(2000, "12 34 !"), (2001, None), (2002, "… €")]
    frame = docs(rows + mixed).withColumn("lang", F.element_at(F.array(*[F.lit(x) for x in "xyz"]), (F.col("doc_id") % 3 + 1).cast("int")))
    learn = F.col("doc_id") < 1000
    model = language_id.train(*language_id.training_sample(frame, learn))
    assert max(r.score for r in language_id.identify(frame.filter("doc_id BETWEEN 1000 AND 1004"), model, ["doc_id"]).collect()) < 0.4
    kept = language_id.drop_unidentified(frame, learn)
    assert kept.columns == frame.columns and {r.doc_id for r in kept.collect()} == {*range(300), *range(1000, 1005)}
    assert {r.doc_id for r in language_id.drop_unidentified(frame, F.lit(False)).collect()} == {*range(300), *range(1000, 1005)}


def test_noise_is_dropped_and_languages_are_written(spark, docs):
    rng = random.Random(21)

    def told(lang, n):
        common = {"x": ["the", "of"], "y": ["und", "der"], "z": ["le", "et"]}[lang]
        return " ".join(w if rng.random() < 0.6 else rng.choice(common) for w in speech(rng, lang, n).split())

    def noise():
        return " ".join("".join(rng.choice("bcdfghjklmnpqrstvwxz0123456789") for _ in range(rng.randrange(3, 9))) for _ in range(60))

    rows = [(i, told("xyz"[i % 3], rng.randrange(25, 60))) for i in range(300)] + [(1000 + i, noise()) for i in range(60)]
    label = F.when(F.col("doc_id") < 150, F.element_at(F.array(*[F.lit(x) for x in "xyz"]), (F.col("doc_id") % 3 + 1).cast("int")))
    found = {r.doc_id: r.lang for r in language_id.drop_unidentified(docs(rows).withColumn("lang", label), F.lit(True)).collect()}
    assert sum(i >= 1000 for i in found) <= 12
    assert all(found.get(i) == "xyz"[i % 3] for i in range(300))


def test_samples_are_bounded_in_any_table(spark):
    from codeatlas.llm.base import bounded_sample, fitted

    marked = spark.range(50_000).selectExpr("id", "CASE WHEN id % 500 = 0 THEN 'rare' WHEN id < 40000 THEN 'a' ELSE concat('k', id % 300) END AS mark")
    marked = marked.unionByName(marked.filter("id < 20")).unionByName(spark.createDataFrame([(1, "zz")], "id long, mark string"))
    texts = spark.range(50_000).selectExpr("id", "concat('t', id) AS text").unionByName(spark.createDataFrame([(1, "other")], "id long, text string"))
    sample = bounded_sample(marked, texts, 40, kinds=10).collect()
    sizes = {}
    for r in sample:
        sizes[r.mark] = sizes.get(r.mark, 0) + 1
    assert len(sizes) == 10 and sizes["a"] == 40 and sizes["rare"] == 40 and len({r.id for r in sample}) == len(sample)
    assert sorted(bounded_sample(marked.repartition(13), texts, 40, kinds=10).collect()) == sorted(sample)
    assert fitted(bounded_sample(marked, texts, 40, kinds=10), lambda t, m: (len(t), m[0]), "mark", "id") == (len(sample), "a")
    assert fitted(bounded_sample(marked.limit(0), texts, 40), lambda t, m: (t, m), "id") == ([], [])
