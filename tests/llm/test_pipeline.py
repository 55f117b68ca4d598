import random

import pytest

import corpus_pipeline
from tests.llm import plain


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(12)

    def speech(lang, n):
        parts = {"x": ["ka", "to", "mi", "ru"], "y": ["sch", "ung", "eit", "der"]}[lang]
        return " ".join("".join(rng.choice(parts) for _ in range(rng.randrange(2, 6))) for _ in range(n))

    items = [(i, speech("x", 30)) for i in range(5)]
    rows = []
    for i in range(200):
        lang = "xy"[i % 2]
        lines = [speech(lang, rng.randrange(20, 60)) for _ in range(rng.randrange(1, 4))]
        if i % 3 == 0:
            lines.append("All rights reserved by the site")
        if i % 20 == 0:
            lines.insert(1, items[i // 20 % 5][1])
        rows.append((i, "\n".join(lines), lang, f"s{i % 4}"))
    rows += [(300 + i, rows[7][1] + (" extra" if i % 2 else ""), "y", "s1") for i in range(40)]
    rows += [(400, None, "x", "s0"), (401, "", None, None), (402, "12 34", "x", "s0"), (None, speech("y", 25), "y", None), (403, speech("y", 25), None, None), (403, rows[3][1], "y", "s3")]
    rows += [(500 + i, " ".join("".join(rng.choice("bcdfghjklmnpqrstvwxz0123456789") for _ in range(rng.randrange(3, 9))) for _ in range(60)), None, "s2") for i in range(5)]
    path = tmp_path_factory.mktemp("tables")
    spark.createDataFrame([(*r, None if r[1] is None else len(r[1])) for r in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path), items


def test_each_stage_does_its_whole_work(spark, folder):
    path, items = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    columns = docs.columns
    for number, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = [tuple(r) for r in docs.collect()]
        out = stage(spark, docs, path)
        after = [tuple(r) for r in out.collect()]
        if name == "language_id":
            kept = {(r[0], r[1], r[3]): r[2] for r in after}
            noise = {r[0] for r in before if (r[0] or 0) >= 500}
            gone = {(r[0], r[1], r[3]) for r in before} - set(kept)
            assert sorted((r for r in gone if r[0] not in noise), key=str) == sorted({(r[0], r[1], r[3]) for r in before if r[0] not in noise and not any(c.isalpha() for c in r[1] or "")}, key=str)
            assert 2 * sum(r[0] in noise for r in gone) > len(noise)  # noise is told by chances
            assert all(kept[r[0], r[1], r[3]] == r[2] for r in before if r[2] and (r[0], r[1], r[3]) in kept) and all(kept.values())
        elif name == "line_dedup":
            expected = plain.without_site_lines([(n, r[1], r[3]) for n, r in enumerate(before)], 0.08, 5)
            assert sorted((r[0], r[1]) for r in after if r[0] is not None) == sorted((before[n][0], t) for n, t, _, _ in expected if before[n][0] is not None)
            assert all(r[4] == len(r[1]) for r in after)
        elif name == "minhash_dedup":
            keyed = {r[0]: r[1] for r in before if r[0] is not None}
            groups = plain.components(list(keyed.items()), 5, 80)
            assert {r[0] for r in after if r[0] is not None} == {g for _, g in groups.values()}
            assert len(after) == len(set(after)) and any(r[0] is None for r in after)
        elif name == "decontamination":
            bad = {d for d, _ in plain.contained([(r[0], r[1]) for r in before], items)}
            assert len(bad) == 10 and sorted(after, key=str) == sorted([r for r in before if r[0] not in bad], key=str)
        else:
            assert out.columns == [*columns, "copy"] and {r[:5] for r in after} <= set(before) and len(after) > len(before)
            break
        assert out.columns == columns
        out.write.parquet(f"{path}/stage{number}")
        docs = spark.read.parquet(f"{path}/stage{number}")


def test_the_run_is_the_stages_in_order(spark, folder):
    path, _ = folder
    found = corpus_pipeline.run(spark, path)
    assert found.columns == ["doc_id", "text", "lang", "source", "n_chars", "copy"] and found.count() > 150
    assert corpus_pipeline.ORACLE_SQL is None and 4 <= len(corpus_pipeline.STAGES) <= 5
