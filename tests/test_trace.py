"""Symbol and impact operators: call chain, risk ladder, cross-language impact."""

import random

import pytest

from codeatlas.operators import chains, reach as R, trace as T
from tests.conftest import rows

SYMBOLS = "repo string, id long, name string, kind string, file string, line int, language string"
CALLS = "repo string, id long, caller_id long, callee_name string, file string, line int, arguments string, kind string"
COLUMNS = "repo string, id long, symbol_id long, table_name string, column_name string, operation string"


@pytest.fixture
def chain(spark):
    names = ["main", "handleRequest", "processData", "sanitize"]
    symbols = spark.createDataFrame([("r", i, n, "function", f"{n}.ts", i + 1, "typescript") for i, n in enumerate(names)], SYMBOLS)
    calls = spark.createDataFrame([("r", i, i, names[i + 1], f"{names[i]}.ts", 5, None, "direct") for i in range(3)], CALLS)
    return symbols, calls


def ask(spark, *names):
    return spark.createDataFrame([("r", n) for n in names], "repo string, name string")


def test_chain_and_depth(spark, chain):
    symbols, calls = chain
    up = R.upstream_chain(symbols, calls, ask(spark, "sanitize"))
    assert rows(up, "name", "parent", "depth") == [("handleRequest", "processData", 2), ("main", "handleRequest", 3), ("processData", "sanitize", 1)]
    assert R.upstream_chain(symbols, calls, ask(spark, "sanitize"), depth=2).count() == 2


def test_chain_survives_cycles(spark, chain):
    symbols, calls = chain
    back = spark.createDataFrame([("r", 9, 3, "main", "sanitize.ts", 7, None, "direct")], CALLS)
    up = R.upstream_chain(symbols, calls.union(back), ask(spark, "sanitize"))
    assert rows(up, "name") == [("handleRequest",), ("main",), ("processData",)]


def test_callers_keep_sites_and_direct_callers_do_not(spark, chain):
    symbols, calls = chain
    more = spark.createDataFrame([("r", 8, 2, "sanitize", "processData.ts", 2, "x", "direct"), ("r", 7, 99, "sanitize", "?", 1, None, "direct")], CALLS)
    both = calls.union(more)
    assert T.callers(symbols, both, ask(spark, "sanitize")).count() == 2
    assert rows(T.direct_callers(symbols, both).filter("callee = 'sanitize'"), "caller", "line") == [("processData", 2)]
    assert rows(T.caller_multiplicity(T.callers(symbols, both, ask(spark, "sanitize"))), "caller", "sites", "first_line") == [("processData", 2, 2)]


def test_candidates_only_without_exact_name(chain):
    symbols, _ = chain
    assert rows(T.candidates(symbols, "PROCESS"), "name") == [("processData",)]
    assert T.candidates(symbols, "main").count() == 0


@pytest.mark.parametrize(
    "callers, foreign, columns, risk, reason",
    [
        (0, False, 0, "LOW", "No callers found"),
        (1, False, 0, "LOW", "1 caller, no column references"),
        (3, False, 0, "MEDIUM", "3 direct callers"),
        (4, False, 0, "HIGH", "4 direct callers"),
        (10, False, 0, "CRITICAL", "10 total dependents (10 callers, 0 column dependents)"),
        (1, True, 0, "HIGH", "cross-language callers"),
        (0, False, 2, "MEDIUM", "2 column references"),
        (0, False, 4, "HIGH", "4 column references"),
    ],
)
def test_risk_ladder(spark, callers, foreign, columns, risk, reason):
    lang = "java" if foreign else "sql"
    symbols = spark.createDataFrame(
        [("r", 0, "target", "procedure", "t.sql", 1, "sql")] + [("r", i + 1, f"c{i}", "method", "c", 1, lang) for i in range(callers)], SYMBOLS
    )
    calls = spark.createDataFrame([("r", i, i + 1, "target", "c", 1, None, "direct") for i in range(callers)], CALLS)
    cols = spark.createDataFrame([("r", i, 0, "t", f"c{i}", "UPDATE") for i in range(columns)], COLUMNS)
    got = T.impact_report(symbols, calls, cols).filter("symbol_id = 0").first()
    assert (got["risk"], got["reason"]) == (risk, reason)


def test_cross_language_impact(spark):
    symbols = spark.createDataFrame(
        [("r", 1, "update_balance", "procedure", "p.sql", 1, "sql"), ("r", 2, "v_summary", "view", "v.sql", 1, "sql"),
         ("r", 3, "processPayment", "method", "P.java", 1, "java"), ("r", 4, "refundPayment", "method", "P.java", 9, "java")], SYMBOLS
    )
    calls = spark.createDataFrame([("r", i, i, "update_balance", "P.java", i, None, "cross-language") for i in (3, 4)], CALLS)
    cols = spark.createDataFrame(
        [("r", 1, 1, "customer", "balance", "UPDATE"), ("r", 2, 1, "customer", "balance", "SELECT"), ("r", 3, 2, "customer", "balance", "SELECT")], COLUMNS
    )
    ids = symbols.filter("id = 1")
    assert rows(T.column_dependents(symbols, cols, ids), "other_id", "operation") == [(2, "SELECT")]
    assert rows(T.downstream_effects(symbols, cols, ids), "other_id") == [(2,)]
    got = T.impact_report(symbols, calls, cols).filter("symbol_id = 1").first()
    assert (got["callers"], got["columns"], got["dependents"], got["downstream"], got["risk"]) == (2, 2, 1, 1, "HIGH")


def test_counts_equal_pairs(spark):
    """The pair-free counts agree with brute force over pairs."""
    data = [(s, f"t{s % 2}", f"c{(s * k) % 3}", ["UPDATE", "SELECT", "DELETE"][(s + k) % 3]) for s in range(8) for k in range(3)]
    symbols = spark.createDataFrame([("r", i, f"f{i}", "function", "f", i, "sql") for i in range(8)], SYMBOLS)
    cols = spark.createDataFrame([("r", i, s, t, c, o) for i, (s, t, c, o) in enumerate(data)], COLUMNS)
    calls = spark.createDataFrame([], CALLS)
    got = {r["symbol_id"]: (r["dependents"], r["downstream"]) for r in T.impact_report(symbols, calls, cols).collect()}
    for s in range(8):
        mine = {(t, c) for x, t, c, _ in data if x == s}
        dep = {(x, t, c) for x, t, c, _ in data if x != s and (t, c) in mine}
        written = {(t, c) for x, t, c, o in data if x == s and o != "SELECT"}
        down = {(x, t, c) for x, t, c, o in data if x != s and o == "SELECT" and (t, c) in written}
        assert got[s] == (len(dep), len(down))


def test_bind_ids_last_duplicate_wins(spark):
    symbols = spark.createDataFrame([("r", 1, "f", "function", "a", 1, "ts"), ("r", 2, "f", "function", "a", 9, "ts")], SYMBOLS)
    records = spark.createDataFrame([("r", "a", "f", "x"), ("r", "a", "<module>", "y"), ("r", "b", "f", "z")], "repo string, file string, owner string, callee_name string")
    assert rows(T.bind_ids(records, symbols), "callee_name", "symbol_id") == [("x", 2)]


def test_summary(spark, chain):
    symbols, calls = chain
    imports = spark.createDataFrame([("r", "z.ts", "sanitize", "./s")], "repo string, file string, symbol_name string, source_module string")
    got = T.trace_summary(symbols, calls, imports, ask(spark, "sanitize"))
    assert {(r["section"], r["item"], r["more"]) for r in got.collect()} == {
        ("callers", "processData at processData.ts:5", 0), ("imports", "z.ts from ./s", 0), ("chain", "processData at processData.ts:3 (2 upstream)", 0),
    }


def test_a_bounded_chain_tells_which_roots_were_cut(spark):
    from codeatlas.operators import reach as R

    symbols = spark.createDataFrame([("r", i, f"f{i}", "f.ts", i, "typescript") for i in range(6)], "repo string, id long, name string, file string, line int, language string")
    calls = spark.createDataFrame([("r", f"f{i}", i + 1) for i in range(4)] + [("r", "f5", 0)], "repo string, callee_name string, caller_id long")
    names = spark.createDataFrame([("r", "f0"), ("r", "f3")], "repo string, name string")
    told = {(r.root, r.name): r.cut for r in R.upstream_chain(symbols, calls, names, depth=2).collect()}
    assert told == {("f0", "f1"): True, ("f0", "f2"): True, ("f3", "f4"): False}
    assert "cut" not in R.upstream_chain(symbols, calls, names).columns and R.upstream_chain(symbols, calls, names).count() == 5


def test_chains_in_slices(spark, monkeypatch):
    """Slices of a graph with cycles give the whole chains; levels that were counted are dropped."""
    from pathlib import Path

    from codeatlas import session

    symbols = spark.createDataFrame([("r", i, f"f{i}", "function", "f.ts", i, "typescript") for i in range(6)], SYMBOLS)
    calls = spark.createDataFrame([("r", 9 * i + k, i, f"f{c}", "f.ts", k, None, "direct") for i in range(6) for k, c in enumerate((i // 2, i ^ 1))], CALLS)
    monkeypatch.setattr(R, "_ROOTS", 3)
    up = R.upstream_chain(symbols, calls, symbols.select("repo", "name")).collect()
    reached = {(a, a) for a in range(6)}
    while (more := reached | {(o, i) for o, a in reached for i in range(6) if a in (i // 2, i ^ 1)}) != reached:
        reached = more
    assert {(r.root, r.name) for r in up} == {(f"f{o}", f"f{a}") for o, a in reached if o != a} and len(up) == len(reached) - 6
    below = {}
    for row in up:
        below[row.root, row.branch] = below.get((row.root, row.branch), -1) + 1
    assert {(r.root, r.name): r.upstream for r in R.chain_roots(symbols, calls, symbols.select("repo", "name")).collect()} == below
    app = Path(session.shared_dir(spark).removeprefix("file:")) / "codeatlas" / spark.sparkContext.applicationId
    assert not list(app.glob("chain-*"))


def test_a_written_table_keeps_no_shuffle(spark):
    import time
    from pathlib import Path

    from codeatlas.session import cut

    local = Path(spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()[0])
    held = lambda: {p.name for p in local.rglob("shuffle_*.data")}
    was = held()
    table = cut(spark.range(10_000).selectExpr("id % 1000 AS k").repartition(4, "k").groupBy("k").count())
    for _ in range(50):
        if not held() - was:
            break
        time.sleep(0.1)
    assert not held() - was and table.count() == 1000


def test_chains_walked_in_memory_are_those_walked_by_joins(spark, monkeypatch):
    """No level of a walk is written or shuffled where tasks hold the steps; loops, equal names, missing callers and nulls are told alike."""
    rng = random.Random(5)
    symbols = spark.createDataFrame([(rng.choice("rs"), i, f"f{i % 37}" if i else None, "function", None if i % 11 == 0 else f"x{i % 5}", i % 9, rng.choice(["java", None])) for i in range(45)], SYMBOLS)
    calls = spark.createDataFrame([(rng.choice("rs"), i, rng.randrange(48), f"f{rng.randrange(45)}" if i % 13 else None, "f", 1, None, "direct") for i in range(500)], CALLS)
    names = spark.createDataFrame([(repo, f"f{i}") for repo in "rs" for i in range(50)] * 2 + [("r", None)], "repo string, name string")
    told = []
    for held, cells, steps in ((-1, 1, 1), (R._HELD, 200, 7), (R._HELD, chains._CELLS, chains._STEPS)):
        with monkeypatch.context() as m:
            for module, name, value in ((R, "_HELD", held), (chains, "_CELLS", cells), (chains, "_STEPS", steps), (chains, "_ROWS", 3)):
                m.setattr(module, name, value)
            walked = []
            m.setattr(R, "_walk", lambda *a, walk=R._walk: walked.append(a) or walk(*a))
            told.append((rows(R.upstream_chain(symbols, calls, names)), rows(R.chain_roots(symbols, calls, names)), rows(R.chain_roots(symbols, calls, names, depth=2))))
            assert bool(walked) == (held < 0)
    assert told[0] == told[1] == told[2] and len(told[0][0]) > 300
