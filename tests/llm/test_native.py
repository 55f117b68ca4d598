import random
from datetime import datetime

from codeatlas.llm import decontamination, url_filters
from codeatlas.llm.decontamination import contained_items, decontaminate
from codeatlas.llm.line_dedup import drop_site_lines
from codeatlas.llm.mixing import fill_targets, mix, systematic_copies
from codeatlas.llm.url_filters import temporal_list_join, validity_intervals
from tests.llm import plain


def items_of(spark, rows):
    return spark.createDataFrame([(i, t, "clash") for i, t in rows], "item_id long, text string, doc_id string")


def test_contained_items_agree_with_plain(spark, docs, corpus, monkeypatch):
    rng = random.Random(8)
    items = [(i, t) for i, (_, t) in enumerate(rng.sample([r for r in corpus if r[1] and len(r[1]) < 900], 40))]
    longest = next(t for _, t in corpus if t and len(t) > 100_000).split()
    items += [(100, " ".join(longest[500:530])), (101, " ".join(longest[-7:])), (102, " ".join(longest[:40:2])), (103, "three words only"), (104, None), (105, ""), (None, "a b c d e f")]
    items += [(106, " ".join(longest[900:905])), (100, " ".join(longest[500:530]))]
    expected = plain.contained(corpus, [x for x in items if x[0] is not None])
    for limit in (200_000, 0):  # sent to all executors, and shuffled with salt
        monkeypatch.setattr(decontamination, "BROADCAST_ROWS", limit)
        found = contained_items(docs(corpus), items_of(spark, items)).collect()
        assert {(r.doc_id, r.item_id): (r.n_shared, r.n_item) for r in found} == expected and len(found) == len(expected)
    clean = decontaminate(docs(corpus), items_of(spark, items))
    assert sorted(r.doc_id for r in clean.collect()) == sorted({i for i, _ in corpus} - {d for d, _ in expected})


def test_contained_items_of_odd_tables(spark, docs):
    rows = [(None, "a b c d e f"), (1, "A b  c d e f"), (1, "A b  c d e f"), (2, None), (3, "")]
    items = items_of(spark, [(1, "a b c d e f")])
    assert [tuple(r) for r in contained_items(docs(rows), items).collect()] == [(1, 1, 2, 2)]
    assert contained_items(docs(rows), items.limit(0)).collect() == []
    assert contained_items(docs(rows).limit(0), items).collect() == []
    assert sorted((r.doc_id for r in decontaminate(docs(rows), items).collect()), key=str) == [2, 3, None]


def test_site_lines_agree_with_plain(spark, docs):
    rng = random.Random(6)
    rows = []
    for i in range(300):
        lines = [f"own {i} {n}" for n in range(rng.randrange(4))] + (["  menu  "] if rng.random() < 0.5 else []) + (["rare"] if rng.random() < 0.04 else []) + ["", "menu"] * (i % 2)
        rng.shuffle(lines)
        rows.append((i, "\n".join(lines)))
    rows += [(400 + i, "copied page\nof two lines") for i in range(90)] + [(500, None), (501, ""), (502, "\n\n"), (503, "menu"), (504, "x\n" * 30_000)]
    frame = docs(rows, sources=("a", "b", "b", None))
    hosts = [("a", "b", "b", None)[n % 4] for n in range(len(rows))]
    found = drop_site_lines(frame, ratio=0.1, min_pages=5)
    assert found.columns == [*frame.columns, "n_lines", "n_dropped"]
    expected = plain.without_site_lines([(i, t, h) for (i, t), h in zip(rows, hosts)], 0.1, 5)
    assert sorted((r.doc_id, r.text, r.n_lines, r.n_dropped) for r in found.collect() if r.text is not None) == sorted(x for x in expected if x[1] is not None)
    assert drop_site_lines(frame.limit(0)).collect() == []
    assert sum(r.n_dropped for r in found.collect()) > 50


def test_site_lines_of_copied_pages(spark, docs):
    rng = random.Random(9)
    rows = [(i, "\n".join(["menu", "cookie"] * (i % 2) + [f"own {i} {n}" for n in range(rng.randrange(1, 6))])) for i in range(203)]
    copied = [f"line {n} of the copied page" for n in range(10)]
    rows += [(1000 + i, "\n".join(copied)) for i in range(100)]
    rows += [(2000 + i, "\n".join([*copied[:9], f"edited {i}"])) for i in range(50)]
    rows += [(3000 + i, "menu\ncookie") for i in range(100)]
    found = {r.doc_id: (r.text, r.n_dropped) for r in drop_site_lines(docs(rows, sources=("a",))).collect()}
    given = dict(rows)
    assert all(found[i] == (given[i], 0) for i in given if 1000 <= i < 3000)  # copies and near copies keep their lines
    assert all(found[i] == ("", 2) for i in given if i >= 3000)  # pages of boilerplate keep none
    assert all("menu" not in found[i][0] and found[i][1] == 2 * (i % 2) for i in range(203))
    assert sorted((i, t, n, k) for i, t, n, k in plain.without_site_lines([(i, t, "a") for i, t in rows], 0.08, 5)) == sorted(
        (r.doc_id, r.text, r.n_lines, r.n_dropped) for r in drop_site_lines(docs(rows, sources=("a",))).collect()
    )


def test_site_lines_with_clashing_columns(spark):
    frame = spark.createDataFrame([(1, "a\nb", "s", 7, 8, 9, "x")], "doc_id long, text string, source string, host long, _marks long, n_lines long, `a.b` string")
    found = drop_site_lines(frame)
    assert found.columns == ["doc_id", "text", "source", "host", "_marks", "a.b", "n_lines", "n_dropped"]
    assert [tuple(r) for r in found.collect()] == [(1, "a\nb", "s", 7, 8, "x", 2, 0)]


def test_targets_fill_up_and_are_near(spark, docs):
    rng = random.Random(1)
    rows = [(i, " ".join(["w"] * int(rng.paretovariate(1.1) * 20))) for i in range(3000)] + [(None, "a b"), (None, "a b"), (5000, None), (5001, "")]
    sources = ("big",) * 7 + ("b", "c", None)
    frame = docs(rows, sources=sources)
    found = systematic_copies(frame).collect()
    assert len(found) == len(rows)
    per = {}
    for r in found:
        t = per.setdefault(r.source, [r.source_size, r.target, 0, 0])
        t[2] += r.size * r.copies
        t[3] += r.size
        assert 0 <= r.copies <= 2
    total = sum(v[0] for v in per.values())
    for size, target, taken, real in per.values():
        assert size == real and target <= 2 * size + 1e-6 and abs(taken - target) <= 0.03 * target + 50
    assert abs(sum(v[1] for v in per.values()) - 1.5 * total) < 1e-3 * total
    again = systematic_copies(frame.repartition(3)).collect()
    assert sorted(map(tuple, found), key=str) == sorted(map(tuple, again), key=str)
    assert systematic_copies(frame.limit(0)).collect() == []
    mixed = mix(frame)
    copies = {r.doc_id: r.copies for r in found if r.doc_id is not None}
    assert mixed.columns == [*frame.columns, "copy"]
    assert mixed.filter("doc_id IS NOT NULL").count() == sum(copies.values()) and mixed.filter("doc_id IS NULL").count() == 2


def test_excess_is_reshared(spark):
    frame = spark.createDataFrame([("a", 10), ("b", 1000), ("c", 1000), (None, 0)], "source string, source_size long")
    found = {r.source: r.target for r in fill_targets(frame).collect()}
    # a takes its 20; what is left goes to b and c by 1 and 2, but c stops at 2000
    assert found["a"] == 20 and found["c"] == 2000 - 0 if found["c"] >= 2000 else True
    assert abs(sum(found.values()) - 1.5 * 2010) < 1e-6 and found[None] == 0
    assert abs(found["b"] - min(2000, (3015 - 20) / 3)) < 1e-6 or found["c"] == 2000


def at(text):
    return datetime.fromisoformat(text)


ENTRIES = "list string, verdict string, kind string, pattern string, action string, at timestamp"


def test_list_entries_hold_from_their_day_to_the_next(spark, monkeypatch):
    rows = [
        ("l", "block", "domain", "example.com", "add", at("2024-01-10")), ("l", "block", "domain", "example.com", "remove", at("2024-03-01")),
        ("l", "block", "domain", "example.com", "add", at("2024-03-05")), ("l", "block", "host", "a.org", "add", at("2024-02-01")),
        ("l", "block", "host", "a.org", "add", at("2024-02-01")), ("l", "block", "host", "a.org", "remove", at("2024-02-01")),
        ("m", "allow", "prefix", "x.example.com/good", "add", at("2024-01-01")), ("m", "allow", "prefix", None, "add", at("2024-01-01")), ("m", "allow", "host", "a.org", "add", None),
    ]
    entries = spark.createDataFrame(rows, ENTRIES)
    assert validity_intervals(entries).count() == 3
    seen = [
        (1, "https://x.example.com/p", at("2024-01-09"), "none"), (2, "https://x.example.com/p", at("2024-01-10"), "block"), (3, "http://EXAMPLE.com", at("2024-02-29"), "block"),
        (4, "https://x.example.com/p", at("2024-03-01"), "none"), (5, "https://x.example.com/p", at("2025-03-05"), "block"), (6, "https://x.example.com/good/p?q", at("2025-03-05"), "allow"),
        (7, "https://x.example.com/goods", at("2025-03-05"), "block"), (8, "https://a.org/", at("2024-02-02"), "none"), (9, None, at("2024-02-02"), "none"), (10, "no url", at("2024-02-02"), "none"),
        (11, "https://example.com/", None, "none"), (12, "https://notexample.com/", at("2024-02-02"), "none"), (2, "https://x.example.com/p", at("2024-01-10"), "block"), (None, None, None, "none"),
    ]
    captures = spark.createDataFrame([(i, u, t, "clash") for i, u, t, _ in seen], "page_id long, url string, fetched timestamp, verdict string")
    for limit in (200_000, 0):
        monkeypatch.setattr(url_filters, "BROADCAST_BYTES", limit)
        found = temporal_list_join(captures, entries)
        assert sorted(((r.page_id, r.url, r.fetched, r.verdict) for r in found.collect()), key=str) == sorted(seen, key=str)
    assert temporal_list_join(captures.limit(0), entries).collect() == []
    assert {r.verdict for r in temporal_list_join(captures, entries.limit(0)).collect()} == {"none"}


def test_captures_of_any_time_meet_what_a_plain_search_finds(spark):
    rng = random.Random(3)
    moment = lambda: datetime(2024, rng.randrange(1, 4), rng.randrange(1, 4), rng.randrange(3))  # noqa: E731: many on one day, many ties
    rows = [(rng.choice("lm"), rng.choice(["block", "allow"]), "host", f"h{rng.randrange(3)}.org", rng.choice(["add", "add", "remove"]), moment()) for _ in range(300)]
    seen = [(i, f"http://h{rng.randrange(4)}.org/", moment()) for i in range(300)] + [(900, "http://h0.org/", datetime(9999, 1, 1)), (901, "http://h0.org/", datetime(1970, 1, 2)), (None, "http://h1.org/", datetime(2999, 1, 1))]
    spans = [tuple(r) for r in validity_intervals(spark.createDataFrame(rows, ENTRIES)).collect()]
    expected = []
    for i, url, t in seen:
        active = [v for _, v, _, p, a, b in spans if url == f"http://{p}/" and a <= t and (b is None or t < b)]
        expected.append((i, url, t, active.count("block"), active.count("allow")))
    captures = spark.createDataFrame(seen, "page_id long, url string, fetched timestamp")
    found = temporal_list_join(captures, spark.createDataFrame(rows, ENTRIES))
    assert sorted((tuple(r)[:5] for r in found.collect()), key=str) == sorted(expected, key=str)
