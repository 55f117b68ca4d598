"""Logs, sessions, configuration, JSON, indexing and streaming."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from codeatlas.functions.series import forward_fill
from codeatlas.operators import activity as H, config as C, jsondocs as J, sessions as L, verify as V
from codeatlas.operators.enrich import parse_enrichment
from codeatlas.session import shared_dir
from codeatlas.sources import convert, index_store as I, logs, manifests
from codeatlas.streaming import index_stream as T
from tests.conftest import rows


def test_forward_fill_crosses_chunks(spark):
    df = spark.createDataFrame([("k", i, i if i in (2, 11) else None) for i in range(20)] + [("z", 5, None)], "key string, pos long, v long")
    got = {(r["key"], r["pos"]): r["f"] for r in forward_fill(df, ["key"], "pos", F.col("v"), "f", chunk=4).collect()}
    assert [got["k", i] for i in range(20)] == [None] * 2 + [2] * 9 + [11] * 9 and got["z", 5] is None


def test_commit_log(spark):
    text = "stray.ts\n__COMMIT__h1__2024-01-02 03:04:05__Ann\n\n  a.ts\nb.ts\n__COMMIT__h2__2024-01-03 00:00:00__Bob\na.ts"
    got = logs.read_commit_log(logs.log_lines(spark.createDataFrame([("r", text)], "repo string, text string")), chunk=2)
    assert rows(got, "file", "hash", "author") == [("a.ts", "h1", "Ann"), ("a.ts", "h2", "Bob"), ("b.ts", "h1", "Ann"), ("stray.ts", None, None)]


def test_diffs_stats_and_sanity(spark):
    one = "diff --git a/x.ts b/x.ts\n--- a/x.ts\n+++ b/x.ts\n@@\n-old\n+new\n+more"
    two = "diff --git a/p b/p\n+1\ndiff --git a/conf/.env b/conf/.env\n" + "-gone\n" * 60
    df = logs.read_unified_diff(spark.createDataFrame([("r", "1", one), ("r", "2", two)], "repo string, change_id string, text string"))
    assert rows(V.diff_stats(df)) == [("r", "1", 1, 2, 1), ("r", "2", 2, 1, 60)]
    assert rows(df.filter("kind = '+'"), "change_id", "file", "text") == [("1", "x.ts", "more"), ("1", "x.ts", "new"), ("2", "p", "1")]
    assert rows(V.diff_sanity(df)) == [("r", "1", "pass", 0), ("r", "2", "warn", 2)]


def test_risk_score(spark):
    checks = [("a", "secrets", "fail", ""), ("a", "lint", "warn", ""), ("b", "ai-review", "warn", "Risk: x (50%)"), ("b", "typecheck", "fail", ""),
              ("b", "tests", "fail", ""), ("c", "ai-review", "warn", "none"), ("d", "lint", "pass", "")]
    df = spark.createDataFrame([("r", *c) for c in checks], "repo string, change_id string, name string, status string, message string")
    assert rows(V.risk_score(df), "change_id", "score", "risk", "failed") == [
        ("a", 0.45, "high", True), ("b", 0.6, "high", True), ("c", 0.15, "low", False), ("d", 0.0, "low", False)]
    assert rows(V.risk_score(df, "medium"), "change_id", "failed") == [("a", True), ("b", True), ("c", False), ("d", False)]


def test_env(spark, files):
    f = files({".env": "# the host\nHOST = 'a b'\n# lost\n\nTOKEN=\nHOST=x y\nbad-Name=1\nURL=postgres://u:secret@h/db\nMY_SECRET=abcdefgh\nFLAG=true\nnoise"})
    s = C.parse_env(f)
    assert rows(s, "line", "key", "value", "comment") == [
        (10, "FLAG", "true", None), (2, "HOST", "a b", "the host"), (5, "TOKEN", "", None), (6, "HOST", "x y", None), (7, "bad-Name", "1", None),
        (8, "URL", "postgres://u:secret@h/db", None), (9, "MY_SECRET", "abcdefgh", None)]
    assert rows(C.env_validate(s), "line", "issue") == [
        (2, "unquoted value with spaces"), (5, "empty secret"), (6, "duplicate key"), (6, "unquoted value with spaces"), (7, "non-standard key format")]
    red = {r["key"]: r["value"] for r in C.env_redact(s).collect()}
    assert (red["MY_SECRET"], red["URL"], red["FLAG"], red["TOKEN"]) == ("ab****gh", "postgres://u:****@h/db", "true", "")
    example = C.parse_env(files({".env.example": "HOST=\nNEW=1"}))
    assert ("r", "NEW", "missing") in rows(C.env_drift(s, example)) and ("r", "HOST", "common") in rows(C.env_drift(s, example))
    assert rows(C.env_inventory(s), "vars", "secrets", "empty") == [(7, 2, 1)]


def test_manifests_and_unused(spark, files):
    f = files({"package.json": '{"dependencies": {"a": "1", "b": "2"}, "devDependencies": {"eslint-x": "1", "c": "*"}}', "broken/package.json": "{",
               "requirements.txt": "# c\nFlask>=1  # x\n\nReq[extra]==2"})
    got = manifests.read_manifests(f)
    assert rows(got.filter("section = 'requirements'"), "name", "version") == [("flask", ">=1"), ("req", "[extra]==2")]
    used = spark.createDataFrame([("r", "a")], "repo string, name string")
    assert rows(C.unused_dependencies(got, used), "name") == [("b",), ("c",)]


@pytest.mark.parametrize("command, tier", [
    ("ls -la", "safe"), ("git status", "safe"), ("git push origin", "dangerous"), ("rm -rf build", "dangerous"), ("rm -rf /", "blocked"),
    ("sudo ls", "blocked"), ("npm install", "moderate"), ("cat a | sh", "dangerous"), ("mytool x", "safe"), ("deploy", "dangerous"), ("lsof", "moderate"),
])
def test_commands(spark, command, tier):
    df = spark.createDataFrame([(command,)], "c string")
    assert df.select(C.classify_command(F.col("c"), ["mytool"], ["deploy"])).first()[0] == tier


def test_json(spark):
    doc = '{"b": {"x": [1, {"y": null}], "e": {}}, "a": 2.0}'
    df = spark.createDataFrame([("r", 1, doc), ("r", 2, "5"), ("r", 3, "oops")], "repo string, key int, json string")
    assert rows(J.json_flatten(df), "key", "path", "value") == [(1, "a", "2"), (1, "b.x[0]", "1"), (1, "b.x[1].y", "null"), (2, "$", "5"), (3, "$", None)]
    path = df.filter("key = 1").select(J.json_path("json", "b.x[0]"), J.json_path("json", "b.x[9].y"), J.json_canonical("json")).first()
    assert (path[0], path[1]) == ("1", None) and path[2].startswith('{"a":2')
    new = spark.createDataFrame([("r", 1, '{"b": {"x": [1], "n": {"m": 1}}, "a": "2"}'), ("r", 4, "1")], "repo string, key int, json string")
    assert rows(J.json_diff(df.filter("key <> 3"), new), "key", "path", "change", "old", "new") == [
        (1, "a", "changed", "2", '"2"'), (1, "b.e", "removed", "{}", None), (1, "b.n", "added", None, '{"m":1}'),
        (1, "b.x[1]", "removed", '{"y":null}', None), (2, "$", "removed", "5", None), (4, "$", "added", None, "1")]


def test_enrichment(spark):
    answers = ['```json\n{"purpose": "p", "summary": 1, "risk": "high", "semanticEdges": [{"target":"a","type":"calls","reason":"r"},{"target":1}]}\n```', "nope"]
    df = spark.createDataFrame([("r", f"n{i}", a) for i, a in enumerate(answers)], "repo string, node_id string, response string")
    got = {r["node_id"]: r for r in parse_enrichment(df, "deep", F.lit(None).cast("timestamp")).collect()}
    assert (got["n0"]["purpose"], got["n0"]["summary"], got["n0"]["risk"], len(got["n0"]["semantic_edges"])) == ("p", None, "high", 1)
    assert got["n1"]["purpose"] is None and got["n1"]["semantic_edges"] is None
    shallow = parse_enrichment(df, "shallow", F.lit(None).cast("timestamp")).filter("node_id = 'n0'").first()
    assert shallow["purpose"] == "p" and shallow["risk"] is None


NOW = dt.datetime(2024, 1, 31)


def test_cache_lookup_matches_brute_force(spark):
    import random

    random.seed(3)
    at = lambda s: NOW + dt.timedelta(seconds=s)
    entries = [("k" + str(random.randint(0, 2)), random.randint(0, 20000)) for _ in range(60)]
    asked = [(i, "k" + str(random.randint(0, 2)), random.randint(0, 20000)) for i in range(80)] + [(99, "none", 5)]
    e = spark.createDataFrame([("r", k, at(s)) for k, s in entries], "repo string, key string, created_at timestamp_ntz")
    q = spark.createDataFrame([("r", i, k, at(s)) for i, k, s in asked], "repo string, id long, key string, created_at timestamp_ntz")
    got = {r["id"]: (r["hit"], r["age"]) for r in L.cache_lookup(q, e, 600).collect()}
    for i, k, s in asked:
        last = max((t for kk, t in entries if kk == k and t <= s), default=None)
        hit = last is not None and s - last <= 600
        assert got[i] == (hit, float(s - last) if hit else None)


def test_related_exchanges_write_no_pair_below_the_score(spark):
    """Pairs are made distinct after they are scored; before that only texts and words are shuffled."""
    messages = spark.createDataFrame(
        [("r", s, t, ["user", "assistant"][t % 2], f"alpha beta word{s % 3}", NOW) for s in range(8) for t in range(2)],
        "repo string, session_id long, turn int, role string, text string, ts timestamp_ntz")
    questions = spark.createDataFrame([("r", 1, "alpha word1"), ("r", 2, "alpha word1"), ("r", 3, "nothing like it")], "repo string, id long, text string")
    found = L.related_exchanges(questions, messages, n=2, min_score=0.5)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    distinct = [line for line in plan.splitlines() if "Aggregate [" in line and "session_id" in line]
    assert not distinct and any("Aggregate [" in line and "score" in line for line in plan.splitlines())
    assert rows(found, "id", "session_id", "turn", "score") == [(i, s, 0, 0.666667) for i in (1, 2) for s in (1, 4)]


def test_related_exchanges_in_memory_are_those_of_the_joins(spark, monkeypatch):
    """Without a join of questions and exchanges, where tasks hold the words; equal scores, repeats and other repos' words are told alike."""
    import random

    rng = random.Random(7)
    said = lambda: " ".join(rng.choices([f"word{i}" for i in range(9)] + ["common"] * 5 + ["the"], k=rng.randint(0, 7)))
    talk = [(repo, s, t, ["user", "assistant"][t % 2], None if s == 3 and t == 0 else said(), NOW) for repo in "rs" for s in range(30) for t in range(4)]
    messages = spark.createDataFrame(talk, "repo string, session_id long, turn int, role string, text string, ts timestamp_ntz")
    questions = spark.createDataFrame([(repo, i % 35, said()) for repo in "rsx" for i in range(40)] + [("r", 99, None), ("r", None, "word1 word2")], "repo string, id long, text string")
    told, joined = {}, []
    monkeypatch.setattr(L, "_scored_by_joins", lambda *a, by=L._scored_by_joins: joined.append(a) or by(*a))
    for held in (-1, L._HELD):
        monkeypatch.setattr(L, "_HELD", held)
        told[held] = [rows(L.related_exchanges(questions, messages, n=n, min_score=least)) for n, least in ((3, 0.15), (1, 0.6))]
        assert len(joined) == 2
    assert told[-1] == told[L._HELD] and all(told[-1])


def test_related_exchanges_match_brute_force(spark):
    """The join leaves out common words; the answer must not change."""
    import random

    random.seed(5)
    words = ["common"] * 6 + [f"word{i}" for i in range(12)]
    said = lambda: " ".join(random.choices(words, k=random.randint(3, 9)))
    talk = [("r", s, t, ["user", "assistant"][t % 2], said(), NOW) for s in range(12) for t in range(4)]
    asked = [("r", i, said()) for i in range(10)]
    messages = spark.createDataFrame(talk, "repo string, session_id long, turn int, role string, text string, ts timestamp_ntz")
    questions = spark.createDataFrame(asked, "repo string, id long, text string")
    got = {}
    for r in L.related_exchanges(questions, messages, n=3, min_score=0.4, recent=None).collect():
        got.setdefault(r["id"], set()).add((r["session_id"], r["turn"], r["score"]))
    for _, i, q in asked:
        scored = []
        for _, s, t, role, text, _ in talk:
            if role == "user":
                hits = sum(w in text.split() for w in q.split())
                score = round(hits / len(set(q.split()) | set(text.split())), 6)
                if score >= 0.4:
                    scored.append((-score, s, t))
        assert got.get(i, set()) == {(s, t, -x) for x, s, t in sorted(scored)[:3]}


def test_qa_pairs_and_validation(spark):
    talk = [("user", "how does the parser work here"), ("assistant", "{\"a\": 1, \"b\": 22222}"), ("user", "[Tool result: x"), ("assistant", "fine"),
            ("user", "parser tokens explained please"), ("assistant", "The parser reads tokens one after the other, see parse.ts for details."), ("user", "x")]
    df = spark.createDataFrame([("r", 1, i, r, t) for i, (r, t) in enumerate(talk)], "repo string, session_id long, turn int, role string, text string")
    assert rows(L.validate_answers(L.qa_pairs(df)), "turn", "valid", "reason") == [(0, False, "raw json"), (4, True, None)]


def test_budgets_and_compaction(spark):
    df = spark.createDataFrame([("llama3.2:1b",), ("llama3.2:9b",), ("LLAMA2-x",), ("other",), (None,)], "m string")
    assert [r[0] for r in df.select(L.context_budget(F.col("m"))).collect()] == [6144, 96000, 3072, 6144, 6144]
    messages = spark.createDataFrame([("r", 1, i, "user", "x" * 3000) for i in range(10)], "repo string, session_id long, turn int, role string, text string")
    models = spark.createDataFrame([("r", 1, "llama3")], "repo string, session_id long, model string")
    plan = {r["turn"]: r["action"] for r in L.compaction_plan(messages, models).collect()}
    assert [plan[i] for i in range(10)] == ["keep"] + ["summarise"] * 3 + ["keep"] * 6


def test_truncation(spark):
    text = "".join(chr(97 + i % 26) for i in range(1000))
    got = spark.createDataFrame([(text,)], "t string").select(L.truncate_middle(F.col("t"), 100), L.truncate_middle(F.col("t"), 300)).first()
    assert got[0] == text[:171] + "\n\n[… ~164 tokens omitted …]\n\n" + text[-171:] and got[1] == text


def test_loop_detection(spark):
    calls = [(1, i, "search_text", f"q{i}", False) for i in range(3)] + [(2, i, "read", "same", False) for i in range(3)] + [(3, i, "x", str(i), True) for i in range(2)] + [(4, 0, "x", "y", True)]
    df = spark.createDataFrame([("r", *c) for c in calls], "repo string, session_id long, seq int, name string, args string, error boolean")
    assert rows(L.loop_detection(df), "session_id", "repeats", "errors", "hint") == [(1, 0, 0, "searching"), (2, 2, 0, "repeats"), (3, 0, 2, "errors"), (4, 0, 1, None)]


def test_verdicts(spark):
    texts = ["PASS\nCONFIDENCE: 0.8\nREASON: fine", "fail\nconfidence 7", "", "looks like pass"]
    got = L.parse_verdicts(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string"))
    assert rows(got, "i", "pass", "confidence", "reason") == [
        (0, True, 0.8, "fine"), (1, False, 1.0, "No reason provided."), (2, True, 0.0, "Empty critic response."), (3, True, 0.5, "No reason provided.")]


def test_commit_conventions(spark):
    def log(subjects):
        return spark.createDataFrame([("r", f"h{i:02}", NOW + dt.timedelta(minutes=i), s) for i, s in enumerate(subjects)], "repo string, hash string, ts timestamp_ntz, subject string")

    assert rows(H.commit_convention(log(["AB-1: feat", "AB-2: x", "feat: y"])), "format") == [("{ticket} {type}({scope}): {description}",)]
    assert rows(H.commit_convention(log(["[AB-1] a", "[AB-2] b", "c"])), "format", "ticket_pattern") == [("[{ticket}] {description}", r"[A-Z]{2,10}-\d+")]
    assert H.commit_convention(log(["feat: a", "fix: b"])).count() == 0
    assert rows(H.commit_style(log(["feat: a", "x"])), "commit_convention") == [("conventional",)]


def test_status_counts(spark):
    df = spark.createDataFrame([("r", x) for x in ["M  a", " M b", "?? c", "UU d", "AA e"]], "repo string, line string")
    assert rows(H.status_counts(df)) == [("r", 2, 1, 1, 2)]


def test_incremental_equals_full_and_force(spark):
    snap = spark.createDataFrame([("r", "a", 2, "x"), ("r", "b", 1, "y"), ("r", "c", 1, "z")], "repo string, path string, mtime_ms int, content string")
    extract = lambda f: {"texts": f.select("repo", F.col("path").alias("file"), "content")}
    old = snap.filter("path <> 'c'").withColumn("mtime_ms", F.lit(1)).withColumn("content", F.lit("old"))
    index = {"files": old.select("repo", "path", "mtime_ms"), **extract(old)}
    assert rows(I.incremental_index(snap, index, extract)["texts"], "file", "content") == [("a", "x"), ("b", "old"), ("c", "z")]
    assert rows(I.incremental_index(snap, index, extract, force=True)["texts"]) == rows(extract(snap)["texts"])
    again = I.incremental_index(snap, I.incremental_index(snap, index, extract), extract)
    assert rows(again["texts"], "file", "content") == [("a", "x"), ("b", "old"), ("c", "z")]


def test_index_version(spark, tmp_path):
    root = str(tmp_path / "index")
    assert I.read_index(spark, root, ["t"]) is None
    df = spark.createDataFrame([("r", 1), ("s", 2)], "repo string, v int")
    I.write_index({"t": df}, root)
    assert rows(I.read_index(spark, root, ["t"])["t"], "repo", "v") == [("r", 1), ("s", 2)]
    I.write_index({"t": df.filter("repo = 'r'").withColumn("v", F.lit(9))}, root)  # other repos stay
    assert rows(I.read_index(spark, root, ["t"])["t"], "repo", "v") == [("r", 9), ("s", 2)]
    assert I.read_index(spark, root, ["t"], version=2) is None


def test_stream_keeps_youngest_version(spark, tmp_path):
    root, sink = tmp_path / "in", str(tmp_path / "out")
    (root / "r1").mkdir(parents=True)
    (root / "r1" / "a.ts").write_text("one\ntwo")
    extract = lambda b: {"lines": b.select("repo", F.col("path").alias("file"), F.explode(F.split("content", "\n")).alias("text"))}
    T.stream_index(T.stream_corpus(spark, str(root)), sink, extract).awaitTermination()
    (root / "r1" / "b.py").write_text("three")
    T.stream_index(T.stream_corpus(spark, str(root)), sink, extract).awaitTermination()
    assert rows(T.current_index(spark, sink, ["lines"])["lines"]) == [("r1", "a.ts", "one"), ("r1", "a.ts", "two"), ("r1", "b.py", "three")]
    # a late, older version of a file is kept in the log but never shown
    stale = spark.createDataFrame([("r1", "a.ts", "stale", 99)], "repo string, file string, text string, batch int").drop("batch")
    stale.write.parquet(f"{sink}/lines/batch=99")
    old = spark.createDataFrame([("r1", "a.ts", dt.datetime(2001, 1, 1))], "repo string, file string, mtime timestamp")
    old.write.parquet(f"{sink}/files/batch=99")
    assert "stale" not in {r["text"] for r in T.current_index(spark, sink, ["lines"])["lines"].collect()}


def test_convert_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("1", 'say "hi", you', None), ("2", "two\nlines", "x")], "a string, b string, c string")
    convert.write_dataset(df, str(tmp_path / "1"), "csv")
    convert.convert_dataset(spark, str(tmp_path / "1"), "csv", str(tmp_path / "2"), "json")
    convert.convert_dataset(spark, str(tmp_path / "2"), "json", str(tmp_path / "3"), "csv")
    assert rows(convert.read_dataset(spark, str(tmp_path / "3"), "csv"), "a", "b", "c") == [("1", 'say "hi", you', ""), ("2", "two\nlines", "x")]


def test_shared_dir_follows_the_session(spark):
    assert shared_dir(spark) == shared_dir(spark)


def test_json_documents_that_are_broken_deep_or_missing(spark):
    from codeatlas.operators import jsondocs as J

    deep, deepest = '{"a":' * 40 + "[1,2.50]" + "}" * 40, "[" * 5000 + "]" * 5000
    frame = lambda rows_: spark.createDataFrame([("r", k, t) for k, t in rows_], "repo string, key int, json string")
    docs = frame([(1, deep), (2, "{broken"), (3, None), (4, deepest), (5, '{"x": {}, "y": [], "z": 1.0}'), (6, "[]")])
    path = ".".join(["a"] * 40)
    assert rows(J.json_flatten(docs), "key", "path", "value") == [
        (1, f"{path}[0]", "1"), (1, f"{path}[1]", "2.5"), (2, "$", None), (3, "$", None), (4, "$", None), (5, "z", "1")]
    old = frame([(1, deep), (2, "{broken"), (3, '{"a":1}'), (4, '{"a":[1,{"b":2}],"c":3}'), (5, None), (7, '{"k":[1,2]}')])
    new = frame([(1, deep.replace("2.50", "3")), (2, '{"a":1}'), (4, '{"a":[1,{"b":{"d":4}},5],"c":3.0}'), (5, None), (6, "[1]"), (7, '{"k":{"0":1,"1":9}}')])
    assert rows(J.json_diff(old, new), "key", "path", "change", "old", "new") == [
        (1, f"{path}[1]", "changed", "2.5", "3"), (2, "$", "unreadable", None, '{"a":1}'), (3, "$", "removed", '{"a":1}', None), (4, "a[1].b", "changed", "2", '{"d":4}'),
        (4, "a[2]", "added", None, "5"), (6, "$", "added", None, "[1]"), (7, "k.1", "changed", "2", "9")]


def test_files_that_come_in_any_order_of_age_are_all_indexed(spark, tmp_path):
    import os

    from codeatlas.streaming import index_stream as T

    root, sink = tmp_path / "tree", str(tmp_path / "index")
    extract = lambda batch: {"sizes": batch.select("repo", batch["path"].alias("file"), "mtime")}
    for name, age in (("a", 1_717_200_000), ("b", 1_577_836_800), ("c", 1_609_459_200)):
        (root / "repo").mkdir(parents=True, exist_ok=True)
        at = root / "repo" / f"{name}.ts"
        at.write_text(f"const {name} = 1;\n")
        os.utime(at, (age, age))
        T.stream_index(T.stream_corpus(spark, str(root)), sink, extract).awaitTermination()
    now = T.current_index(spark, sink, ["sizes"])
    assert rows(now["sizes"], "file") == [("a.ts",), ("b.ts",), ("c.ts",)] and now["files"].count() == 3


def test_a_key_with_a_third_of_all_requests(spark):
    from datetime import datetime, timedelta

    from codeatlas.operators import sessions as L

    start = datetime(2024, 1, 1)
    at = lambda s: start + timedelta(seconds=s)
    entries = spark.createDataFrame([("r", "hot", at(7 * n)) for n in range(300)] + [("r", f"k{n}", at(n)) for n in range(300)], "repo string, key string, created_at timestamp")
    asked = [(n, "hot" if n % 3 == 0 else f"k{n}", 3 * n + 1) for n in range(900)]
    requests = spark.createDataFrame([("r", k, at(s), i) for i, k, s in asked], "repo string, key string, created_at timestamp, id long")
    found = {r.id: (r.hit, r.age) for r in L.cache_lookup(requests, entries, 60).collect()}
    stored = {}
    for n in range(300):
        stored.setdefault("hot", []).append(7 * n)
        stored.setdefault(f"k{n}", []).append(n)
    for i, key, second in asked:
        before = [e for e in stored.get(key, []) if e <= second]
        age = second - max(before) if before else None
        hit = age is not None and age <= 60
        assert found[i] == (hit, float(age) if hit else None)


def test_diffs_are_dealt_out_by_their_number(spark, tmp_path):
    """A small table of keys is one partition, but its changes are a hundred times as large."""
    from codeatlas.plans import config_queries as Q

    part = spark.range(25_001).selectExpr("id AS p_partkey", "'Brand#1' AS p_brand", "CAST(id % 3 AS int) AS p_size").coalesce(1)
    part.unionByName(part.limit(1)).coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    found = Q.diffs(spark, str(tmp_path))
    assert found.rdd.getNumPartitions() == 6
    assert found.count() == 25_002 and found.select("change_id").distinct().count() == 25_001
