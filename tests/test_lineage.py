import random

from codeatlas.functions.select_lists import column_flows
from codeatlas.operators import closure as C, lineage as L, reach as R, trace as T, triggers as G
from tests.conftest import rows

EDGES = "repo string, src string, dst string"


def sql(spark, **files):
    return spark.createDataFrame([("r", name, text) for name, text in files.items()], "repo string, path string, content string")


def flows(spark, *texts):
    """For each text the flows between its tables, all read in one go."""
    out = [set() for _ in texts]
    for r in L.column_edges(sql(spark, **{str(i): text for i, text in enumerate(texts)})).collect():
        out[int(r.file)].add((f"{r.source}.{r.source_column}", f"{r.table}.{r.column}", r.mask))
    return out


# ---------------------------------------------------------------- reach


def closure(edges, direction):
    out = {}
    for s, d in edges:
        a, b = (d, s) if direction == "incoming" else (s, d)
        out.setdefault(a, set()).add(b)
    ends = {x for e in edges for x in e}

    def walk(start):
        seen, todo = set(), [start]
        while todo:
            for n in out.get(todo.pop(), ()):
                if n not in seen:
                    seen.add(n)
                    todo.append(n)
        return seen - {start}

    return {x: len(walk(x)) for x in ends}


def test_reach_of_all_agrees_with_a_walk(spark):
    rng = random.Random(4)
    edges = [(f"n{a}", f"n{rng.randrange(a // 2 + 1)}") for a in range(1, 500) for _ in range(2)] + [("n3", "n490"), ("n5", "n5"), ("n7", "n499")]
    df = spark.createDataFrame([("r", *e) for e in edges], EDGES)
    want = closure(edges, "outgoing")
    assert {r.id: (r.reached, r.exact) for r in C.reach_estimates(df, direction="outgoing", least=1024).collect()} == {x: (n, True) for x, n in want.items()}
    want = closure(edges, "incoming")
    rough = {r.id: r for r in C.reach_estimates(df).collect()}
    assert all(r.reached == want[x] for x, r in rough.items() if r.exact) and {x for x, r in rough.items() if r.exact} == {x for x, n in want.items() if n < 63}
    off = [abs(r.reached / want[x] - 1) for x, r in rough.items() if not r.exact]
    assert off and max(off) < 0.5 and sum(off) / len(off) < 0.15
    starts = df.selectExpr("repo", "src AS id").filter("id IN ('n3', 'n300', 'n499')")
    assert {r.id: r.reached for r in C.reach_sizes(df, starts).collect()} == {x: want[x] for x in ("n3", "n300", "n499")}


def test_reach_keeps_repos_apart(spark):
    df = spark.createDataFrame([("a", "x", "y"), ("b", "x", "y"), ("b", "z", "x")], EDGES)
    assert rows(C.reach_estimates(df), "repo", "id", "reached") == [("a", "x", 0), ("a", "y", 1), ("b", "x", 1), ("b", "y", 2), ("b", "z", 0)]
    assert C.reach_estimates(df.limit(0)).collect() == []
    missing = C.reach_sizes(df, spark.createDataFrame([("a", "nowhere")], "repo string, id string"))
    assert rows(missing) == [("a", "nowhere", 0)]


# ---------------------------------------------------------------- lineage


def test_select_lists(spark):
    assert flows(
        spark,
        "CREATE VIEW v AS SELECT a.x AS k, a.y + 1 z, t.w FROM s.t, u a WHERE a.q = 1",
        "INSERT INTO t (a, b) SELECT x, (y) FROM u",
        "INSERT INTO t VALUES (1, 2); DELETE FROM t; SELECT a FROM b",
        "create table t as select cast(a as int) c, b::text, 'x' d, f(e, g.h) from g",
    ) == [
        {("u.x", "v.k", 0), ("u.y", "v.z", 1), ("s.t.w", "v.w", 0)},
        {("u.x", "t.a", 2), ("u.y", "t.b", 3)},
        set(),
        {("g.a", "t.c", 3), ("g.b", "t.column2", 3), ("g.e", "t.column4", 3), ("g.h", "t.column4", 3)},
    ]


def test_sub_selects_and_common_tables(spark):
    nested = "INSERT INTO t SELECT a.k FROM (SELECT max(b.v) AS k FROM (SELECT c AS v FROM base WHERE z IN (SELECT q FROM other)) b) a"
    loop = "CREATE VIEW v AS WITH RECURSIVE r AS (SELECT id, up FROM t UNION ALL SELECT t.id, r.up FROM t JOIN r ON t.up = r.id) SELECT id, up FROM r"
    assert flows(
        spark,
        nested,
        "CREATE VIEW v AS WITH a(x) AS (SELECT q FROM t1), b AS (SELECT x FROM a UNION ALL SELECT lower(y) FROM t2) SELECT * FROM b",
        "WITH w AS (SELECT k FROM u) UPDATE t SET a = w.k, b = t.c || w.k FROM w WHERE w.k = t.a",
        loop,
        "INSERT INTO t (m) SELECT (SELECT sum(x.n) FROM x WHERE x.id = y.id) FROM y",
    ) == [
        {("base.c", "t.k", 3)},
        {("t1.q", "v.x", 0), ("t2.y", "v.x", 1)},
        {("u.k", "t.a", 2), ("t.c", "t.b", 3), ("u.k", "t.b", 3)},
        {("t.id", "v.id", 0), ("t.up", "v.up", 0)},
        {("x.n", "t.m", 3)},
    ]


def test_stars_stand_for_unnamed_columns(spark):
    assert flows(
        spark,
        "CREATE VIEW v AS SELECT t.*, a.x + 1 AS c FROM t, a",
        "INSERT INTO f (k) SELECT s.k FROM (SELECT *, z AS w FROM t) s",
    ) == [
        {("t.*", "v.*", 0), ("a.x", "v.c", 1)},
        {("t.k", "f.k", 2)},
    ]
    edges = L.column_edges(sql(spark, a="CREATE VIEW v AS SELECT t.*, a.x AS c FROM t, a", b="INSERT INTO f SELECT c, d FROM v"))
    found = {(r.column, r.other_table, r.other_column, r.hops) for r in L.lineage(edges).filter("`table` = 'f'").collect()}
    assert found == {("c", "v", "c", 1), ("c", "a", "x", 2), ("d", "v", "d", 1), ("d", "t", "d", 2)}


def test_unqualified_columns_of_several_tables_are_ambiguous(spark):
    assert flows(
        spark,
        "CREATE VIEW v AS SELECT p FROM t JOIN u ON t.i = u.i",
        "CREATE VIEW v AS SELECT p FROM t JOIN (SELECT p FROM w) u ON t.i = u.i",
    ) == [
        {("t.p", "v.p", L.AMBIGUOUS), ("u.p", "v.p", L.AMBIGUOUS)},
        {("w.p", "v.p", 0)},
    ]


def test_comments_strings_and_broken_text(spark):
    assert flows(
        spark,
        "INSERT INTO t /* (a; */ SELECT 'SELECT x FROM y;' || b AS c -- , d\nFROM u;",
        "CREATE TABLE t (a INT); CREATE VIEW (; INSERT INTO; UPDATE; UPDATE t; SELECT FROM ((((",
    ) == [
        {("u.b", "t.c", 3)},
        set(),
    ]
    assert column_flows("create view v as " + "select a from (" * 3000 + "t" + ")" * 3000) == []
    empty = spark.createDataFrame([("r", "n", None), ("r", "e", "")], "repo string, path string, content string")
    assert L.column_edges(empty).collect() == []
    assert L.lineage(L.column_edges(empty)).collect() == []


def test_update_in_a_procedure(spark):
    text = "CREATE PROCEDURE p() AS BEGIN\n UPDATE t SET a = (SELECT max(m) FROM u), b = s.q * 2 FROM src s WHERE s.id = t.id;\n INSERT INTO l (x) SELECT a FROM t;\nEND;"
    assert flows(
        spark,
        text,
    ) == [
        {("u.m", "t.a", 3), ("src.q", "t.b", 3), ("t.a", "l.x", 2)},
    ]


def test_lineage_puts_kinds_together_along_paths(spark):
    files = sql(spark, a="CREATE VIEW v AS SELECT x AS k FROM base", b="INSERT INTO f (k) SELECT k FROM v", c="INSERT INTO f (k) SELECT upper(k) FROM v", d="UPDATE base SET x = f.k FROM f")
    edges = L.column_edges(files)
    ask = spark.createDataFrame([("r", "f", "k")], "repo string, `table` string, `column` string")
    up = {(r.other_table, r.mask): r.hops for r in L.lineage(edges, ask).collect()}
    assert up == {("v", 2): 1, ("v", 3): 1, ("base", 2): 2, ("base", 3): 2, ("f", 2): 3, ("f", 3): 3}
    down = L.lineage(edges, spark.createDataFrame([("r", "base", "x")], "repo string, `table` string, `column` string"), direction="downstream")
    assert {(r.other_table, r.mask): r.hops for r in down.collect()} == {("v", 0): 1, ("f", 2): 2, ("f", 3): 2, ("base", 2): 3, ("base", 3): 3, ("v", 2): 4, ("v", 3): 4}
    assert [r.f for r in spark.range(4).select(L.flow(G.F.col("id").cast("int")).alias("f")).collect()] == ["READ", "READ>TRANSFORM", "READ>WRITE", "READ>TRANSFORM>WRITE"]


def test_lineage_moves_numbers_not_names(spark, monkeypatch):
    """Names of tables and columns are written once each, and the rounds write numbers; `*` carries a column that stands in no flow."""
    edges = spark.createDataFrame(
        [("r", f"t{i}", "*", f"t{i + 1}", "*", 0) for i in range(4)] + [("r", "t4", "x", "u", "y", 1)],
        "repo string, source string, source_column string, `table` string, `column` string, mask int")
    written = []
    keep = lambda was: lambda df: written.append(dict(df.dtypes)) or was(df)
    for module in (L, R):
        monkeypatch.setattr(module, "cut", keep(module.cut))
    ask = spark.createDataFrame([("r", "t3", "z"), ("r", "u", "y")], "repo string, `table` string, `column` string")
    got = rows(L.lineage(edges, ask), "table", "column", "other_table", "other_column", "mask", "hops")
    down = [("t3", "z", f"t{i}", "z", 0, 3 - i) for i in range(3)]
    assert got == sorted(down + [("u", "y", f"t{i}", "x", 1, 5 - i) for i in range(5)])
    assert sum("string" in kinds.values() for kinds in written) == 2


# ---------------------------------------------------------------- triggers


CHAIN = """
CREATE PROCEDURE pay() AS BEGIN UPDATE Acct a SET a.bal = 1 WHERE id = 2; END;
CREATE TRIGGER one AFTER UPDATE OF bal ON acct FOR EACH ROW BEGIN INSERT INTO log VALUES (1); END;
CREATE TRIGGER two AFTER INSERT OR DELETE ON log BEGIN DELETE FROM queue; END;
CREATE TRIGGER three BEFORE DELETE ON queue BEGIN UPDATE acct SET lim = 0; END;
CREATE TRIGGER other AFTER UPDATE OF lim, x ON acct BEGIN DELETE FROM queue; END;
CREATE TRIGGER view_one INSTEAD  OF UPDATE ON v_acct BEGIN UPDATE acct SET bal = 3; END;
CREATE VIEW v_acct AS SELECT * FROM acct;
CREATE FUNCTION idle() AS $$ UPDATE acct SET name = 'UPDATE acct SET bal = 1' -- DELETE FROM queue
$$;
"""


def test_triggers_and_writes_are_read(spark):
    files = sql(spark, f=CHAIN)
    assert rows(G.extract_triggers(files), "name", "timing", "table_name", "operation", "columns") == sorted([
        ("one", "AFTER", "acct", "UPDATE", ["bal"]), ("two", "AFTER", "log", "INSERT", []), ("two", "AFTER", "log", "DELETE", []), ("three", "BEFORE", "queue", "DELETE", []),
        ("other", "AFTER", "acct", "UPDATE", ["lim", "x"]), ("view_one", "INSTEAD OF", "v_acct", "UPDATE", []),
    ], key=lambda t: tuple((x is None, str(x)) for x in t))
    assert ("pay", "acct", "UPDATE", ["bal"]) in rows(G.write_events(files), "name", "table_name", "operation", "columns")
    assert rows(G.fires(G.write_events(files), G.extract_triggers(files)), "src", "dst") == [("one", "two"), ("other", "three"), ("pay", "one"), ("three", "other"), ("two", "three"), ("view_one", "one")]


def test_chains_of_triggers(spark):
    files = sql(spark, f=CHAIN)
    fired = G.fires(G.write_events(files), G.extract_triggers(files))
    found = {(r.name, r.trigger): (r.firings, r.path, r.cyclic) for r in G.trigger_chains(fired).collect()}
    assert {k[1]: v for k, v in found.items() if k[0] == "pay"} == {
        "one": (1, ["one"], False), "two": (2, ["one", "two"], False), "three": (3, ["one", "two", "three"], True), "other": (4, ["one", "two", "three", "other"], True)}
    assert found["three", "three"] == (2, ["other", "three"], True)
    calls = spark.createDataFrame([("r", "main", "helper"), ("r", "helper", "pay"), ("r", "pay", "main")], EDGES)
    with_calls = {(r.name, r.trigger): r.firings for r in G.trigger_chains(fired, calls).collect()}
    assert with_calls["main", "one"] == 1 and with_calls["main", "other"] == 4 and with_calls["helper", "two"] == 2
    assert G.trigger_chains(fired.limit(0)).collect() == []


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_firings_and_chains_are_not_broadcast(spark):
    """Rows taken from texts are many more than Catalyst expects: two triggers look as small as two million."""
    files = sql(spark, f=CHAIN)
    fired = G.fires(G.write_events(files), G.extract_triggers(files))
    assert "Broadcast" not in plan(fired)
    assert "Broadcast" not in plan(G.trigger_chains(fired))


def test_report_counts_triggers(spark):
    symbols = spark.createDataFrame([("r", 1, "pay", "procedure", "f", 1, "sql"), ("r", 2, "idle", "function", "f", 9, "sql")], "repo string, id long, name string, kind string, file string, line int, language string")
    calls = spark.createDataFrame([], "repo string, id long, caller_id long, callee_name string, file string, line int, arguments string, kind string")
    columns = spark.createDataFrame([], "repo string, id long, symbol_id long, table_name string, column_name string, operation string")
    files = sql(spark, f=CHAIN)
    chains = G.trigger_chains(G.fires(G.write_events(files), G.extract_triggers(files)))
    report = T.impact_report(symbols, calls, columns, chains)
    assert {r.symbol_id: r.triggers for r in report.collect()} == {1: 4, 2: 0}
    assert report._jdf.queryExecution().optimizedPlan().toString().count("strategy=merge") >= 2  # chains are never broadcast
    assert "triggers" not in T.impact_report(symbols, calls, columns).columns
