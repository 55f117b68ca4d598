"""Registered queries of the extraction, analyser and convention operators.

The driver's tables hold no source code, so every part is written out as one source file per language, row by row.
The SQL tells the symbols, calls, imports, nodes and edges those files must give back straight from the part table.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from codeatlas.operators import analyse as N, extract_lines as E, extract_trace as X, graph as G, resolve as P, style as Y
from codeatlas.plans import adapters as A
from codeatlas.plans.config_queries import lines, text
from codeatlas.plans.registry import query, table
from codeatlas.session import cut

# Per part: its key, two keys it refers to, and its paths.
PARTS = """
n AS (SELECT count(*) AS n FROM part),
p AS (
  SELECT 'shop' AS repo, p_partkey AS p, (p_partkey * p_partkey + 7) % n AS c1, (p_partkey * 31 + 5) % n AS c2,
         ((p_partkey * p_partkey + 7) % n) % 4 AS d1, p_partkey % 4 AS d FROM part, n)
"""
WITH = "WITH " + PARTS
TS = "'src/' || d || '/fn_' || p || '.ts'"
PY, JAVA, SQL = "'py/fn_' || p || '.py'", "'java/Fn' || p || '.java'", "'models/staging/s' || p || '.sql'"


def parts(spark, sf):
    n = table(spark, sf, "part").agg(F.count("*")).scalar()
    p = F.col("p_partkey")
    # The keys are dealt out before they become files: a small table is one partition, its files are work for all cores.
    keys = table(spark, sf, "part").select("p_partkey").repartition(spark.sparkContext.defaultParallelism, "p_partkey")
    return keys.select(
        F.lit("shop").alias("repo"), p.alias("p"), ((p * p + 7) % n).alias("c1"), ((p * 31 + 5) % n).alias("c2"), (p % 4).alias("d")
    ).withColumn("d1", F.col("c1") % 4)


def _file(df, path, language, *body):
    return df.select("repo", path.alias("path"), F.lit(language).alias("language"), lines(*body).alias("content"))


def refs():
    return [F.col(x) for x in ("p", "c1", "c2", "d", "d1")]


def ts_files(spark, sf):
    p, c1, c2, d, d1 = refs()
    return _file(
        parts(spark, sf), text("src/", d, "/fn_", p, ".ts"), "typescript",
        text("import { fn_", c1, " as other, type T } from '../", d1, "/fn_", c1, ".js';"),
        text("import lib from 'lib", p % 10, "/deep';"),
        "// fn_skip(1)",
        text("export function fn_", p, "(a: number): string {"),
        text("  const x = fn_", c1, "(a, ", p, ");"),
        "  console.log(x);",
        text("  return db.fn_", c2, "(x);"),
        "}",
        text("export class K", p, " {"),
        text("  run", p, "(q: string) { return fn_", c1, "(q); }"),
        "}",
        text("app.get('/r", p, "', process.env.KEY_", p % 10, ");"),
    )


def js_files(spark, sf):
    """A function in a function, a call after it, and calls that stand in a comment or a template only."""
    p, c1, c2, d, d1 = refs()
    return _file(
        parts(spark, sf), text("web/o", p, ".js"), "javascript",
        text("function outer", p, "(a) {"),
        text("  function inner", p, "(b) {"),
        text("    if (b) { first_", c1, "(b); }"),
        "  }",
        "  /* dead(1) {",
        "     dead(2) */",
        "  const t = `${a} ghost(1) {",
        "    ghost(2)`;",
        text("  second_", c2, "('} lost(3)');"),
        "}",
        text("last_", p, "();"),
    )


def tsx_files(spark, sf):
    """Patterns with quotes, slashes and backticks, divisions, templates in templates, and markup around calls."""
    p, c1, c2, d, d1 = refs()
    return _file(
        parts(spark, sf), text("web/x", p, ".tsx"), "typescript",
        text("export function view", p, "(s: string) {"),
        text("  if (/[\"'/]/.test(s)) { inside_", c1, "(s); }"),
        text("  const parts = s.split(/`/);"),
        text("  after_", c2, "(s.replace(/https?:\\/\\//, own_", p, "(s)));"),
        text("  const t = `a ${nested_", c1, "(`b } ${deep_", c2, "(s)} {`)} ghost(1) {`;"),
        text("  const n = total / half_", p, "(s) / 2; // no(1)"),
        text("  return <p title=\"it's {\" onClick={() => click_", p, "(s)}>Don't stop( {tell_", c1, "(s)} ghost(2) } <b/> // no(2)</p>;"),
        "}",
        text("tail_", p, "();"),
    )


def nested_py_files(spark, sf):
    p, c1, c2, d, d1 = refs()
    return _file(
        parts(spark, sf), text("py/outer_", p, ".py"), "python",
        text("def outer_", p, "(a):"),
        '    """Says dead(1).',
        "",
        'dead(2)"""',
        text("    def inner_", p, "(b):"),
        text("        return first_", c1, "("),
        "  b)",
        "",
        text("    return second_", c2, "(a)"),
        text("last_", p, "()"),
    )


def nested_java_files(spark, sf):
    p, c1, c2, d, d1 = refs()
    return _file(
        parts(spark, sf), text("java/Outer", p, ".java"), "java",
        text("public class Outer", p, " {"),
        text("  void run", p, "() {"),
        "    task.add(new Runnable() {",
        text("      public void go", p, "() { first_", c1, "(); }"),
        "    });",
        "    /* dead(1); } */",
        text("    second_", c2, "();"),
        "  }",
        "}",
    )


def py_files(spark, sf):
    p, c1, c2, d, d1 = refs()
    return _file(
        parts(spark, sf), text("py/fn_", p, ".py"), "python",
        text("from .fn_", c1, " import fn_", c1, " as f, helper"),
        "import os.path as p",
        text('@app.route("/x', p, '", methods=["GET", "post"])'),
        text("def fn_", p, "(a, b=1):"),
        text("    return f(a).save_", p, "(b)"),
        "",
        text("class K", p, "(Base):"),
        text("    c_", p % 25, " = Column(Integer)"),
        text("    def run_", p, "(self):"),
        "        self.go(1)  # call(2)",
        text("main_", p, "()"),
        text('os.getenv("KEY_', p % 10, '")'),
    )


def java_files(spark, sf):
    p, c1, c2, d, d1 = refs()
    return _file(
        parts(spark, sf), text("java/Fn", p, ".java"), "java",
        "package shop;",
        text("import com.shop.Fn", c1, ";"),
        text("public class Fn", p, " {"),
        text("  public Fn", p, "(int x) { this.init", p, "(x); }"),
        text('  @Procedure("proc_', c2, '")'),
        text("  public List<String> run", p, "(int a, String b) throws IOException {"),
        "    Math.abs(a);",
        text('    jdbc.execute("CALL upd_', c1, '(?)");'),
        text("    return fn.call", p, "(a);"),
        "  }",
        "}",
    )


def sql_files(spark, sf):
    p, c1, c2, d, d1 = refs()
    return _file(
        parts(spark, sf), text("models/staging/s", p, ".sql"), "sql",
        text("CREATE OR REPLACE PROCEDURE proc_", p, "(x int) AS"),
        "BEGIN",
        text("  UPDATE t", p % 20, " SET c", p % 25, " = 1, `d` = 2 WHERE id = x;"),
        text("  CALL proc_", c1, "(x);"),
        "END;",
        text("create view v_", p, " AS"),
        text("SELECT a.c", p % 25, " AS k,"),
        "  e",
        text("FROM t", c2 % 20, ";"),
        text("INSERT INTO log", p % 3, " (a, b) VALUES (1, 2);"),
        text("DELETE FROM log", p % 3, ";"),
        text("CREATE TABLE base_", p, " ("),
        "  id INT PRIMARY KEY,",
        text("  ref_id INT REFERENCES base_", c1, "(id),"),
        "  UNIQUE (id)",
        ");",
    )


# ---------------------------------------------------------------- line-level extraction

C1_SQL = WITH + f""",
s AS (SELECT repo, 'fn_' || p AS name, 'function' AS kind, {TS} AS file, 4 AS line FROM p
      UNION ALL SELECT repo, 'K' || p, 'class', {TS}, 9 FROM p)
"""


@query("c1_extract_symbols_ts", C1_SQL + "SELECT * FROM s")
def c1_ts(spark, sf):
    return E.extract_symbols_ts(ts_files(spark, sf))


@query("c1_exported_symbols", C1_SQL + "SELECT repo, name, kind, file FROM s")
def c1_exported(spark, sf):
    return E.exported_symbols(ts_files(spark, sf))


@query("c2_extract_symbols_py", WITH + f"""
SELECT repo, 'fn_' || p AS name, 'function' AS kind, {PY} AS file, 4 AS line FROM p
UNION ALL SELECT repo, 'K' || p, 'class', {PY}, 7 FROM p""")
def c2_py(spark, sf):
    return E.extract_symbols_py(py_files(spark, sf))


@query("c3_find_definitions", WITH + f"""
SELECT repo, 'fn_' || p AS name, 'function' AS kind, {TS} AS file, 4 AS line, 10 AS priority FROM p
UNION ALL SELECT repo, 'run' || p, 'method', {TS}, 10, 6 FROM p""")
def c3(spark, sf):
    p, c1, c2, d, d1 = refs()
    base = parts(spark, sf)
    names = base.select("repo", text("fn_", p).alias("name")).unionByName(base.select("repo", text("run", p).alias("name")))
    return E.find_definitions(ts_files(spark, sf), names)


@query("c4_find_references", WITH + f""",
r AS (
  SELECT repo, c1 AS k, p, {TS} AS file, 'import' AS kind, 1 AS line, 'import {{ fn_' || c1 || ' as other, type T }} from ''../' || d1 || '/fn_' || c1 || '.js'';' AS code, NULL AS args FROM p WHERE c1 <> p
  UNION ALL SELECT repo, c1, p, {TS}, 'call', 5, 'const x = fn_' || c1 || '(a, ' || p || ');', 'a, ' || p FROM p
  UNION ALL SELECT repo, c2, p, {TS}, 'call', 7, 'return db.fn_' || c2 || '(x);', 'x' FROM p
  UNION ALL SELECT repo, c1, p, {TS}, 'call', 10, 'run' || p || '(q: string) {{ return fn_' || c1 || '(q); }}', 'q' FROM p)
SELECT repo, 'fn_' || k AS symbol, kind, file, line, code, args FROM r""")
def c4(spark, sf):
    p, c1, c2, d, d1 = refs()
    names = parts(spark, sf).select("repo", text("fn_", p).alias("name"), text("src/", d, "/fn_", p, ".ts").alias("def_file"))
    return E.find_references(ts_files(spark, sf), names)


@query("c5_enclosing_function", WITH + f"""
SELECT repo, {TS} AS path, CAST(i AS INTEGER) AS line, CASE WHEN i < 4 THEN NULL WHEN i < 10 THEN 'fn_' || p ELSE 'run' || p END AS enclosing
FROM p, range(1, 13) r(i)""")
def c5(spark, sf):
    return E.enclosing_function(ts_files(spark, sf)).drop("text")


@query("c5_latest_signup_before", """
WITH e AS (SELECT 'u' || (user_id % 5) AS repo, event_id, user_id, ts, event_type FROM events)
SELECT repo, event_id, max(CASE WHEN event_type = 'signup' THEN event_id END)
  OVER (PARTITION BY repo ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS enclosing FROM e""")
def c5_events(spark, sf):
    """The same as-of step over a log: the latest sign-up at or before each event of a group."""
    from codeatlas.functions.series import forward_fill

    events = table(spark, sf, "events").select(text("u", F.col("user_id") % 5).alias("repo"), "event_id", "event_type")
    mark = F.when(F.col("event_type") == "signup", F.col("event_id"))
    return forward_fill(events, ["repo"], "event_id", mark, "enclosing", chunk=1024).drop("event_type")


@query("c6_outgoing_calls", WITH + """,
r AS (SELECT repo, p, c1 AS k, 2 AS line, 'a, ' || p AS args FROM p UNION ALL SELECT repo, p, c2, 4, 'x' FROM p),
f AS (SELECT repo, p, k, min(line) AS line, min_by(args, line) AS args FROM r WHERE k <> p GROUP BY 1, 2, 3)
SELECT repo, 'fn_' || p AS caller, 'fn_' || k AS name, line, args, true AS known FROM f
UNION ALL SELECT repo, 'fn_' || p, 'log', 3, 'x', false FROM p""")
def c6(spark, sf):
    files = ts_files(spark, sf)
    name = F.regexp_extract("path", r"(fn_\d+)", 1)
    bodies = files.select("repo", name.alias("caller"), F.array_join(F.slice(F.split("content", "\n"), 4, 5), "\n").alias("body"))
    return E.outgoing_calls(bodies, E.extract_symbols_ts(files))


# ---------------------------------------------------------------- trace extraction


def _records(rows: str) -> str:
    return WITH + f", r AS ({rows}) SELECT * FROM r"


def _shown(df):
    return df.select("repo", "file", "language", "record_type", "name", "kind", "line", "end_line", "signature", "return_type", "caller", "source_module", "alias")


NONE = "NULL::VARCHAR"


LANGUAGES = {"src": "typescript", "web": "javascript", "py": "python", "java": "java", "models": "sql"}
JS, PY_OUTER, JAVA_OUTER = "'web/o' || p || '.js'", "'py/outer_' || p || '.py'", "'java/Outer' || p || '.java'"


def _row(file, kind, name, what=NONE, line="NULL", sig=NONE, ret=NONE, caller=NONE, module=NONE, alias=NONE, where="", end="NULL::INTEGER"):
    language = LANGUAGES[file.strip("'").split("/")[0]]
    return (
        f"SELECT repo, {file} AS file, '{language}' AS language, '{kind}' AS record_type, {name} AS name, {what} AS kind, {line} AS line, {end} AS end_line, {sig} AS signature, "
        f"{ret} AS return_type, {caller} AS caller, {module} AS source_module, {alias} AS alias FROM p {where}"
    )


C7_ROWS = [
    _row(TS, "symbol", "'fn_' || p", "'function'", 4, "'(a: number)'", "'string'", end=8),
    _row(TS, "symbol", "'K' || p", "'class'", 9, end=11),
    _row(TS, "symbol", "'run' || p", "'method'", 10, "'(q: string)'", end=10),
    _row(TS, "call", "'fn_' || c1", "'direct'", 5, caller="'fn_' || p"),
    _row(TS, "call", "'fn_' || c2", "'direct'", 7, caller="'fn_' || p"),
    _row(TS, "call", "'fn_' || c1", "'direct'", 10, caller="'run' || p"),
    _row(TS, "call", "'get'", "'direct'", 12, caller="'<module>'"),
    _row(TS, "import", "'fn_' || c1", module="'../' || d1 || '/fn_' || c1 || '.js'", alias="'other'"),
    _row(TS, "import", "'lib'", module="'lib' || (p % 10) || '/deep'"),
    _row(JS, "symbol", "'outer' || p", "'function'", 1, "'(a)'", end=10), _row(JS, "symbol", "'inner' || p", "'function'", 2, "'(b)'", end=4),
    _row(JS, "call", "'first_' || c1", "'direct'", 3, caller="'inner' || p"), _row(JS, "call", "'second_' || c2", "'direct'", 9, caller="'outer' || p"),
    _row(JS, "call", "'last_' || p", "'direct'", 11, caller="'<module>'"),
]
TSX, VIEW = "'web/x' || p || '.tsx'", "'view' || p"
TSX_ROWS = [_row(TSX, "symbol", VIEW, "'function'", 1, "'(s: string)'", end=8).replace("'javascript'", "'typescript'")] + [
    _row(TSX, "call", name, "'direct'", line, caller=caller).replace("'javascript'", "'typescript'")
    for name, line, caller in [
        ("'test'", 2, VIEW), ("'inside_' || c1", 2, VIEW), ("'split'", 3, VIEW), ("'after_' || c2", 4, VIEW), ("'replace'", 4, VIEW), ("'own_' || p", 4, VIEW),
        ("'nested_' || c1", 5, VIEW), ("'deep_' || c2", 5, VIEW), ("'half_' || p", 6, VIEW), ("'click_' || p", 7, VIEW), ("'tell_' || c1", 7, VIEW), ("'tail_' || p", 9, "'<module>'"),
    ]
]


@query("c7_patterns_and_markup", _records(" UNION ALL ".join(TSX_ROWS)))
def c7_tsx(spark, sf):
    return _shown(X.extract_trace_ts(tsx_files(spark, sf)))


@query("c7_extract_trace_ts", _records(" UNION ALL ".join(C7_ROWS)))
def c7(spark, sf):
    return _shown(X.extract_trace_ts(ts_files(spark, sf).unionByName(js_files(spark, sf))))


C8_ROWS = [
    _row(PY, "symbol", "'fn_' || p", "'function'", 3, "'(a, b=1)'", end=5), _row(PY, "symbol", "'K' || p", "'class'", 7, end=10),
    _row(PY, "symbol", "'run_' || p", "'function'", 9, "'(self)'", end=10),
    _row(PY, "call", "'route'", "'direct'", 3, caller="'fn_' || p"), _row(PY, "call", "'f'", "'direct'", 5, caller="'fn_' || p"),
    _row(PY, "call", "'save_' || p", "'direct'", 5, caller="'fn_' || p"), _row(PY, "call", "'Column'", "'direct'", 8, caller="'<module>'"),
    _row(PY, "call", "'go'", "'direct'", 10, caller="'run_' || p"), _row(PY, "call", "'main_' || p", "'direct'", 11, caller="'<module>'"),
    _row(PY, "call", "'getenv'", "'direct'", 12, caller="'<module>'"),
    _row(PY, "import", "'fn_' || c1", module="'.fn_' || c1", alias="'f'"), _row(PY, "import", "'helper'", module="'.fn_' || c1"),
    _row(PY, "import", "'os.path'", module="'os.path'", alias="'p'"),
    _row(PY_OUTER, "symbol", "'outer_' || p", "'function'", 1, "'(a)'", end=9), _row(PY_OUTER, "symbol", "'inner_' || p", "'function'", 5, "'(b)'", end=7),
    _row(PY_OUTER, "call", "'first_' || c1", "'direct'", 6, caller="'inner_' || p"), _row(PY_OUTER, "call", "'second_' || c2", "'direct'", 9, caller="'outer_' || p"),
    _row(PY_OUTER, "call", "'last_' || p", "'direct'", 10, caller="'<module>'"),
]


@query("c8_extract_trace_py", _records(" UNION ALL ".join(C8_ROWS)))
def c8(spark, sf):
    return _shown(X.extract_trace_py(py_files(spark, sf).unionByName(nested_py_files(spark, sf))))


C9_ROWS = [
    _row(JAVA, "symbol", "'Fn' || p", "'class'", 3, end=11), _row(JAVA, "symbol", "'Fn' || p", "'method'", 4, "'(int x)'", end=4),
    _row(JAVA, "symbol", "'run' || p", "'method'", 5, "'(int a, String b)'", "'List<String>'", end=10),
    _row(JAVA, "call", "'init' || p", "'direct'", 4, caller="'Fn' || p"),
    _row(JAVA, "call", "'proc_' || c2", "'cross-language'", 5, caller="'run' || p"),
    _row(JAVA, "call", "'upd_' || c1", "'cross-language'", 8, caller="'run' || p"),
    _row(JAVA, "call", "'execute'", "'direct'", 8, caller="'run' || p"), _row(JAVA, "call", "'call' || p", "'direct'", 9, caller="'run' || p"),
    _row(JAVA, "import", "'Fn' || c1", module="'com.shop.Fn' || c1"),
    _row(JAVA_OUTER, "symbol", "'Outer' || p", "'class'", 1, end=9), _row(JAVA_OUTER, "symbol", "'run' || p", "'method'", 2, "'()'", "'void'", end=8),
    _row(JAVA_OUTER, "symbol", "'go' || p", "'method'", 4, "'()'", "'void'", end=4), _row(JAVA_OUTER, "call", "'add'", "'direct'", 3, caller="'run' || p"),
    _row(JAVA_OUTER, "call", "'first_' || c1", "'direct'", 4, caller="'go' || p"), _row(JAVA_OUTER, "call", "'second_' || c2", "'direct'", 7, caller="'run' || p"),
]


@query("c9_extract_trace_java", _records(" UNION ALL ".join(C9_ROWS)))
def c9(spark, sf):
    return _shown(X.extract_trace_java(java_files(spark, sf).unionByName(nested_java_files(spark, sf))))


C10_ROWS = [
    _row(SQL, "symbol", "'proc_' || p", "'procedure'", 1, end=5), _row(SQL, "symbol", "'v_' || p", "'view'", 6, end=9),
    _row(SQL, "call", "'proc_' || c1", "'cross-language'", 4, caller="'proc_' || p"),
]


@query("c10_extract_trace_sql", _records(" UNION ALL ".join(C10_ROWS)))
def c10(spark, sf):
    return _shown(X.extract_trace_sql(sql_files(spark, sf)).filter("record_type <> 'column'"))


@query("c10_sql_columns", WITH + f"""
SELECT repo, {SQL} AS file, 'proc_' || p AS caller, 't' || (p % 20) AS table_name, 'c' || (p % 25) AS column_name, 'UPDATE' AS operation FROM p
UNION ALL SELECT repo, {SQL}, 'proc_' || p, 't' || (p % 20), 'd', 'UPDATE' FROM p
UNION ALL SELECT repo, {SQL}, 'v_' || p, 't' || (c2 % 20), 'c' || (p % 25), 'SELECT' FROM p
UNION ALL SELECT repo, {SQL}, 'v_' || p, 't' || (c2 % 20), 'e', 'SELECT' FROM p
UNION ALL SELECT repo, {SQL}, 'v_' || p, 'log' || (p % 3), 'a', 'INSERT' FROM p
UNION ALL SELECT repo, {SQL}, 'v_' || p, 'log' || (p % 3), 'b', 'INSERT' FROM p
UNION ALL SELECT repo, {SQL}, 'v_' || p, 'log' || (p % 3), '*', 'DELETE' FROM p""")
def c10_columns(spark, sf):
    rows = X.extract_trace_sql(sql_files(spark, sf)).filter("record_type = 'column'")
    return rows.select("repo", "file", "caller", "table_name", "column_name", "operation")


def all_files(spark, sf):
    return ts_files(spark, sf).unionByName(py_files(spark, sf)).unionByName(java_files(spark, sf)).unionByName(sql_files(spark, sf))


@query("c7_c10_trace_index", WITH + """
SELECT 'symbols' AS tbl, (3 + 3 + 3 + 2) * count(*) AS n FROM p UNION ALL SELECT 'calls', (3 + 4 + 5 + 1) * count(*) FROM p
UNION ALL SELECT 'imports', (2 + 3 + 1) * count(*) FROM p UNION ALL SELECT 'columns', 7 * count(*) FROM p""")
def trace_index(spark, sf):
    """All languages through extraction and binding of ids: rows per index table."""
    tables = X.split_records(cut(X.extract_trace(all_files(spark, sf))))
    out = None
    for name, df in tables.items():
        one = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("tbl"), "n")
        out = one if out is None else out.unionByName(one)
    return out


@query("c7_c10_index_calls", _records(" UNION ALL ".join([*C7_ROWS, *C8_ROWS, *C9_ROWS, *C10_ROWS])).replace("SELECT * FROM r", """
SELECT repo, file, language, caller, name AS callee, line, kind FROM r WHERE record_type = 'call' AND caller <> '<module>'"""))
def index_calls(spark, sf):
    """The calls of the index of all languages, with the names behind their ids."""
    files = all_files(spark, sf).unionByName(js_files(spark, sf)).unionByName(nested_py_files(spark, sf)).unionByName(nested_java_files(spark, sf))
    tables = X.split_records(cut(X.extract_trace(files)))
    owner = tables["symbols"].select("repo", F.col("id").alias("caller_id"), F.col("name").alias("caller"), "language")
    return tables["calls"].join(owner, ["repo", "caller_id"]).select("repo", "file", "language", "caller", F.col("callee_name").alias("callee"), "line", "kind")


@query("c11_resolve_imports", WITH + f"""
SELECT repo, {TS} AS file, '../' || d1 || '/fn_' || c1 || '.js' AS raw, 'src/' || d1 || '/fn_' || c1 || '.ts' AS resolved FROM p""")
def c11(spark, sf):
    files = ts_files(spark, sf)
    return P.resolve_imports(P.extract_imports(files), files)


@query("c12_package_usage", WITH + "SELECT DISTINCT repo, 'lib' || (p % 10) AS name FROM p UNION SELECT 'shop', 'typescript'")
def c12(spark, sf):
    return P.package_usage(ts_files(spark, sf))


# ---------------------------------------------------------------- analysers


def _graph(records):
    """Nodes and edges in one table, metadata as sorted text."""
    pairs = F.array_sort(F.transform(F.map_entries("metadata"), lambda e: F.concat_ws("=", e["key"], e["value"])))
    return records.select(
        "repo", "record_type", F.coalesce("id", "src").alias("id"), "type", F.coalesce("name", "dst").alias("name"), "framework",
        F.when(F.col("record_type") == "node", F.array_join(pairs, ";")).alias("metadata"),
    )


def _n(id_, kind, name, framework=NONE, meta="''"):
    return f"SELECT repo, 'node' AS record_type, {id_} AS id, '{kind}' AS type, {name} AS name, {framework} AS framework, {meta} AS metadata FROM p"


def _e(src, kind, dst):
    return f"SELECT repo, 'edge', {src}, '{kind}', {dst}, NULL::VARCHAR, NULL::VARCHAR FROM p"


def _analysis(*rows):
    return WITH + ", g AS (" + " UNION ALL ".join(rows) + ") SELECT * FROM g"


FILE = "'file:' || "
_fts, _fpy, _fsql = FILE + TS, FILE + PY, FILE + SQL


@query("c13_analyze_ts", _analysis(
    _n(_fts, "file", TS), _n(f"'function:' || {TS} || '#fn_' || p", "function", "'fn_' || p"), _n(f"'class:' || {TS} || '#K' || p", "class", "'K' || p"),
    _e(_fts, "contains", f"'function:' || {TS} || '#fn_' || p"), _e(_fts, "contains", f"'class:' || {TS} || '#K' || p"),
    _e(_fts, "imports", "'file:src/' || d1 || '/fn_' || c1 || '.ts'"),
    _n("'endpoint:GET /r' || p", "endpoint", "'GET /r' || p", "'express'", "'method=GET;path=/r' || p"),
    _n("'config:KEY_' || (p % 10)", "config", "'KEY_' || (p % 10)"),
))
def c13(spark, sf):
    return _graph(N.analyze_ts(ts_files(spark, sf)))


@query("c14_analyze_py", _analysis(
    _n(_fpy, "file", PY), _e(_fpy, "imports", "'file:.fn_' || c1"),
    _n("'table:K' || p", "table", "'K' || p", "'sqlalchemy'", "'columns=[\"c_' || (p % 25) || '\"]'"), _e(_fpy, "contains", "'table:K' || p"),
    _n(f"'function:' || {PY} || '#fn_' || p", "function", "'fn_' || p"), _e(_fpy, "contains", f"'function:' || {PY} || '#fn_' || p"),
    _n(f"'function:' || {PY} || '#run_' || p", "function", "'run_' || p"), _e(_fpy, "contains", f"'function:' || {PY} || '#run_' || p"),
    _n("'endpoint:GET /x' || p", "endpoint", "'GET /x' || p", "'flask'", "'method=GET;path=/x' || p"),
    _n("'endpoint:POST /x' || p", "endpoint", "'POST /x' || p", "'flask'", "'method=POST;path=/x' || p"),
    _n("'config:KEY_' || (p % 10)", "config", "'KEY_' || (p % 10)"),
))
def c14(spark, sf):
    return _graph(N.analyze_py(py_files(spark, sf)))


@query("c15_analyze_sql", _analysis(
    _n(_fsql, "file", SQL, meta="'dbtLayer=staging'"), _n("'table:base_' || p", "table", "'base_' || p", meta="'columns=[\"id\",\"ref_id\"]'"),
    _e(_fsql, "contains", "'table:base_' || p"), _e("'table:base_' || p", "depends-on", "'table:base_' || c1"),
    _n("'table:log' || (p % 3)", "table", "'log' || (p % 3)"), _n("'table:t' || (c2 % 20)", "table", "'t' || (c2 % 20)"),
    _e(_fsql, "writes", "'table:log' || (p % 3)"), _e(_fsql, "reads", "'table:t' || (c2 % 20)"), _e(_fsql, "reads", "'table:log' || (p % 3)"),
))
def c15(spark, sf):
    return _graph(N.analyze_sql(sql_files(spark, sf)))


CBL = "'cbl/P' || p || '.cbl'"


def cobol_files(spark, sf):
    p, c1, c2, d, d1 = refs()
    return _file(
        parts(spark, sf), text("cbl/P", p, ".cbl"), "cobol",
        "       IDENTIFICATION DIVISION.", text("       PROGRAM-ID. P", p, "."), text("       FD  FILE", p % 10, "."), text("       COPY BOOK", c1, " ."),
        "       WORKING-STORAGE SECTION.", text("       MAIN-", p, " SECTION."), text("           CALL 'P", c2, "'"),
        text("           EXEC SQL SELECT a FROM emp", p % 7, " JOIN dept ON x END-EXEC"), "           EXEC SQL",
        "             UPDATE dept SET a = 1", "           END-EXEC", F.when(p % 2 == 0, "           EXEC CICS RETURN END-EXEC"),
    )


@query("c16_analyze_cobol", _analysis(
    _n(FILE + CBL, "file", "'P' || p", "CASE WHEN p % 2 = 0 THEN 'cics' END", "'programId=P' || p"),
    _e(FILE + CBL, "imports", "'file:BOOK' || c1"), _e(FILE + CBL, "calls", "'file:P' || c2"),
    _n("'table:EMP' || (p % 7)", "table", "'EMP' || (p % 7)"), _n("'table:DEPT'", "table", "'DEPT'"),
    _e(FILE + CBL, "reads", "'table:EMP' || (p % 7)"), _e(FILE + CBL, "reads", "'table:DEPT'"), _e(FILE + CBL, "writes", "'table:DEPT'"),
    _n(f"'function:' || {CBL} || '#MAIN-' || p", "function", "'MAIN-' || p", meta="'sectionType=SECTION'"),
    _e(FILE + CBL, "contains", f"'function:' || {CBL} || '#MAIN-' || p"),
    _n("'external:FILE' || (p % 10)", "external", "'FILE' || (p % 10)", meta="'fdType=file-descriptor'"),
    _e(FILE + CBL, "contains", "'external:FILE' || (p % 10)"),
))
def c16(spark, sf):
    return _graph(N.analyze_cobol(cobol_files(spark, sf)))


def docker_files(spark, sf):
    p, c1, c2, d, d1 = refs()
    base = parts(spark, sf)
    image = _file(
        base, text("d", p, "/Dockerfile"), "docker", text("FROM node:", p % 9, " AS build"), "FROM scratch", text("from base:", p),
        "COPY . .", text("EXPOSE ", p % 9 + 80, " 443"),
    )
    compose = _file(
        base, text("d", p, "/docker-compose.yml"), "docker", 'version: "3"', "services:", text("  web", p, ":"), text("    image: nginx:", p % 5),
        "    ports:", text('      - "', p % 9 + 80, ':80"'), "      - 443:443", text("    depends_on: [db", p, ", cache]"), text("  db", p, ":"),
        "    volumes:", "      - data:/x", "    depends_on:", "      - 'cache'", "volumes:", "  data:",
    )
    return image.unionByName(compose)


DF, DC = "'d' || p || '/Dockerfile'", "'d' || p || '/docker-compose.yml'"


@query("c17_analyze_docker", _analysis(
    _n(FILE + DF, "file", DF, meta="'exposedPorts=[\"' || (p % 9 + 80) || '\",\"443\"]'"),
    _n("'external:node:' || (p % 9)", "external", "'node:' || (p % 9)", meta="'imageType=base-image'"), _e(FILE + DF, "depends-on", "'external:node:' || (p % 9)"),
    _n("'external:base:' || p", "external", "'base:' || p", meta="'imageType=base-image'"), _e(FILE + DF, "depends-on", "'external:base:' || p"),
    _n(FILE + DC, "file", DC),
    _n("'service:web' || p", "service", "'web' || p", "'docker-compose'", "'image=nginx:' || (p % 5) || ';ports=[\"' || (p % 9 + 80) || ':80\",\"443:443\"];volumes=[]'"),
    _e(FILE + DC, "contains", "'service:web' || p"), _e("'service:web' || p", "deploys-with", "'service:db' || p"), _e("'service:web' || p", "deploys-with", "'service:cache'"),
    _n("'service:db' || p", "service", "'db' || p", "'docker-compose'", "'ports=[];volumes=[\"data:/x\"]'"),
    _e(FILE + DC, "contains", "'service:db' || p"), _e("'service:db' || p", "deploys-with", "'service:cache'"),
))
def c17(spark, sf):
    return _graph(N.analyze_docker(docker_files(spark, sf)))


API = "'api/' || p || '.yaml'"


def openapi_files(spark, sf):
    p, c1, c2, d, d1 = refs()
    return _file(
        parts(spark, sf), text("api/", p, ".yaml"), "openapi", F.when(p % 5 == 0, "kind: other").otherwise("openapi: 3.0.0"), "# note", "paths:",
        text("  /u/", p, ":"), "    get:", "      summary: x", "    post:", "      x: y", "components:", "  schemas:", text("    S", p, ":"),
        "      properties:", "        addr:", text("          $ref: '#/components/schemas/S", c1, "'"), "    Addr:", "      type: object",
        "  securitySchemes:", "    key:", "      in: header",
    )


_API_ROWS = [
    _n(FILE + API, "file", API), _n("'endpoint:GET /u/' || p", "endpoint", "'GET /u/' || p", meta="'method=GET;path=/u/' || p"),
    _e(FILE + API, "contains", "'endpoint:GET /u/' || p"),
    _n("'endpoint:POST /u/' || p", "endpoint", "'POST /u/' || p", meta="'method=POST;path=/u/' || p"), _e(FILE + API, "contains", "'endpoint:POST /u/' || p"),
    _n("'schema:S' || p", "schema", "'S' || p"), _e(FILE + API, "contains", "'schema:S' || p"), _n("'schema:Addr'", "schema", "'Addr'"),
    _e(FILE + API, "contains", "'schema:Addr'"),
]


@query("c18_analyze_openapi", _analysis(
    *[row + " WHERE p % 5 <> 0" for row in _API_ROWS],
    _e("'schema:S' || p", "depends-on", "'schema:S' || c1") + " WHERE p % 5 <> 0 AND c1 <> p",
))
def c18(spark, sf):
    return _graph(N.analyze_openapi(openapi_files(spark, sf)))


# one TypeScript, Python, SQL and COBOL file, two Docker files and, for four parts in five, an OpenAPI file
@query("c13_c18_code_graph", WITH + "SELECT repo, 6 * count(*) + count(*) FILTER (WHERE p % 5 <> 0) AS files FROM p GROUP BY repo")
def code_graph(spark, sf):
    """Every analyser over every file, put together as one graph; files in it."""
    files = ts_files(spark, sf).unionByName(py_files(spark, sf)).unionByName(sql_files(spark, sf))
    files = files.unionByName(cobol_files(spark, sf)).unionByName(docker_files(spark, sf)).unionByName(openapi_files(spark, sf))
    nodes, edges = G.build_graph(*[[x] for x in N.split_graph(cut(N.analyze(files)))])
    return G.graph_stats(nodes, edges).select("repo", "files")


@query("e28_class_inventory", WITH + """,
k AS (SELECT repo, d::VARCHAR AS module, 'K' || p AS name, row_number() OVER (PARTITION BY d ORDER BY 'K' || p) AS place FROM p)
SELECT repo, module, 'class' AS kind, name, CAST(place AS INTEGER) AS place FROM k WHERE place <= 20""")
def e28(spark, sf):
    symbols = E.exported_symbols(ts_files(spark, sf)).withColumn("module", G.module_of(F.col("file")))
    return G.class_inventory(symbols, classes=20)


@query("e28_all_kinds", WITH + """,
k AS (SELECT repo, d::VARCHAR AS module, unnest(['K', 'I', 'E']) AS t, p FROM p)
SELECT repo, module, CASE t WHEN 'K' THEN 'class' WHEN 'I' THEN 'interface' ELSE 'enum' END AS kind, t || p AS name,
  CAST(row_number() OVER (PARTITION BY d_.module, d_.t ORDER BY t || p) AS INTEGER) AS place FROM k d_""")
def e28_kinds(spark, sf):
    p, d = F.col("p"), F.col("d")
    files = _file(parts(spark, sf), text("src/", d, "/t_", p, ".ts"), "typescript", text("export class K", p, " {}"), text("export interface I", p, " {}"), text("export enum E", p, " { A }"))
    return G.class_inventory(E.exported_symbols(files).withColumn("module", G.module_of(F.col("file"))))


@query("e22_resolved_imports", WITH + f"""
SELECT DISTINCT repo, {TS} AS src, 'src/' || d1 || '/fn_' || c1 || '.ts' AS dst FROM p""")
def e22_resolved(spark, sf):
    """The import graph from import statements over path resolution."""
    files = ts_files(spark, sf)
    resolved = P.resolve_imports(P.extract_imports(files), files)
    return G.import_graph(resolved.select("repo", F.col("file").alias("src"), F.col("resolved").alias("dst")), files)


@query("e16_parse_enrichment", """
WITH e AS (SELECT event_id, event_type AS t, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events)
SELECT 'app' AS repo, 'n' || event_id AS node_id, CASE WHEN k % 4 <> 3 THEN 'does ' || t END AS purpose,
  CASE WHEN k % 4 = 0 THEN 'sum' END AS summary, CASE WHEN k % 4 IN (0, 1) THEN 'p' || k END AS pattern,
  CASE WHEN k % 4 = 1 THEN 'high' END AS risk, CASE WHEN k % 4 = 1 THEN 1 WHEN k % 4 = 0 THEN 0 END AS edges FROM e""")
def e16(spark, sf):
    from codeatlas.operators.enrich import parse_enrichment

    k, kind = F.get_json_object("props", "$.k").cast("int"), F.col("event_type")
    good = text('{"purpose": "does ', kind, '", "summary": "sum", "pattern": "p', k, '", "risk": "extreme", "semanticEdges": [{"target": 1}]}')
    fenced = text(
        '```json\n{"purpose": "does ', kind, '", "summary": 5, "pattern": "p', k,
        '", "risk": "high", "semanticEdges": [{"target": "t", "type": "calls", "reason": "r"}, {"target": "x"}]}\n```',
    )
    answer = F.when(k % 4 == 0, good).when(k % 4 == 1, fenced).when(k % 4 == 2, text('{"purpose": "does ', kind, '"}')).otherwise("no json {")
    rows = table(spark, sf, "events").select(F.lit("app").alias("repo"), text("n", F.col("event_id")).alias("node_id"), answer.alias("response"))
    told = parse_enrichment(rows, "deep", A.as_of())
    return told.select("repo", "node_id", "purpose", "summary", "pattern", "risk", F.when(F.col("semantic_edges").isNotNull(), F.size("semantic_edges")).alias("edges"))


# ---------------------------------------------------------------- conventions: one repo per supplier


def repo_files(spark, sf):
    k = F.col("s_suppkey")
    base = table(spark, sf, "supplier").select(text("s", k).alias("repo"), k.alias("k"))

    def make(path, content, where=None):
        rows = base if where is None else base.filter(where)
        return rows.select("repo", (F.lit(path) if isinstance(path, str) else path).alias("path"), content.alias("content"))

    k = F.col("k")
    package = F.concat(
        F.lit('{"name": "x", "dependencies": {"express": "1"'), F.when(k % 3 == 0, ', "react": "2"').otherwise(""),
        F.lit('}, "devDependencies": {"zzz": "1"'), F.when(k % 2 == 0, ', "typescript": "5"').otherwise(""),
        F.when(k % 5 == 0, ', "vitest": "1", "eslint": "8"').when(k % 5 == 1, ', "jest": "1", "prettier": "3", "vite": "1"').otherwise(""),
        F.lit('}, "scripts": {"test": "'), F.when(k % 5 == 0, "vitest run").when(k % 5 == 1, "x jest").when(k % 5 == 2, "make").otherwise(""),
        F.lit('"}'), F.when(k % 7 == 0, ', "workspaces": []').otherwise(""), F.lit("}"),
    )
    tabbed, quoted = k % 2 == 0, k % 3 == 0
    pad = F.when(tabbed, "\t").otherwise("    ")
    q = F.when(quoted, '"').otherwise("'")
    source = lines(
        text("import a from ", q, F.when(k % 4 == 0, "@/lib").otherwise("./lib"), q, ";"),
        text("const ", F.when(k % 5 == 0, "someName").when(k % 5 == 1, "some_name").otherwise("SomeName"), " = ", q, "v", q, ";"),
        "export const list = [", text(pad, "1", F.when(k % 7 == 0, "").otherwise(",")), "];",
        text("function go() {"), text(pad, "run()", F.when(k % 9 == 0, "").otherwise(";")), text(pad, "run()", F.when(k % 9 == 0, "").otherwise(";")),
        text(pad, "run()", F.when(k % 9 == 0, "").otherwise(";")), text(pad, "run()", F.when(k % 9 == 0, "").otherwise(";")), "}",
        F.when(k % 6 == 0, "export default go"),
    )
    parts_ = [
        make("package.json", package, "k % 10 <> 9"), make("pyproject.toml", F.lit("[tool.pytest]"), "k % 10 = 9"),
        make("yarn.lock", F.lit(""), "k % 4 = 1"), make("requirements.txt", F.lit("Flask==1\npyspark # x"), "k % 11 = 0"),
        make("manage.py", F.lit(""), "k % 13 = 0"), make("dags/a.py", F.lit(""), "k % 17 = 0"),
        make("src/index.ts", F.lit("// hello"), "k % 4 = 2"), make(F.when(k % 2 == 0, "src/my-part.ts").otherwise("lib/myPart.ts"), source),
        make("tests/a.spec.ts", F.lit(""), "k % 5 = 0"), make("src/b.test.ts", F.lit(""), "k % 5 = 1"), make("packages/a/x.ts", F.lit(""), "k % 19 = 0"),
    ]
    out = parts_[0]
    for part in parts_[1:]:
        out = out.unionByName(part)
    return out


SUP = "WITH s AS (SELECT 's' || s_suppkey AS repo, s_suppkey AS k FROM supplier)"


VOTES_SQL = SUP + """,
v AS (
  SELECT repo, k, CASE WHEN k % 2 = 0 THEN 'src/my-part.ts' ELSE 'lib/myPart.ts' END AS path,
    CASE WHEN k % 2 = 0 THEN 4 + 1 ELSE 0 END AS tabs, CASE WHEN k % 2 = 0 THEN 0 ELSE 4 + 1 END AS spaces,
    CASE WHEN k % 3 = 0 THEN 0 ELSE 2 END AS single, CASE WHEN k % 3 = 0 THEN 2 ELSE 0 END AS double,
    CASE WHEN k % 9 = 0 THEN 3 ELSE 7 END AS "semi",
    1 + CASE WHEN k % 7 = 0 THEN 1 ELSE 0 END + CASE WHEN k % 6 = 0 THEN 1 ELSE 0 END AS no_semi,
    CASE WHEN k % 7 = 0 THEN 0 ELSE 1 END AS trailing_comma FROM s)
"""


@query("b12_style_votes", VOTES_SQL + """
SELECT repo, path, tabs::BIGINT AS tabs, spaces::BIGINT AS spaces, single::BIGINT AS single, double::BIGINT AS double, "semi"::BIGINT AS "semi",
  no_semi::BIGINT AS no_semi, trailing_comma::BIGINT AS trailing_comma FROM v""")
def b12_votes(spark, sf):
    return Y.style_votes(repo_files(spark, sf).filter("path like '%art.ts'")).select(
        "repo", "path", "tabs", "spaces", "single", "double", "semi", "no_semi", "trailing_comma"
    )


@query("b12_code_style", VOTES_SQL + """
SELECT repo, CASE WHEN tabs > spaces THEN 'tabs' ELSE 'spaces' END AS indent, 2 AS indent_size,
  CASE WHEN single >= double THEN 'single' ELSE 'double' END AS quotes, "semi" >= no_semi AS semicolons, trailing_comma > 0 AS trailing_commas,
  CASE k % 5 WHEN 0 THEN 'camelCase' WHEN 1 THEN 'snake_case' ELSE 'PascalCase' END AS naming FROM v""")
def b12(spark, sf):
    return Y.code_style(Y.style_votes(repo_files(spark, sf).filter("path like '%art.ts'")))


# names in the root, src/ and lib/, by the file list of repo_files
ENTRY_SQL = SUP + """,
e AS (
  SELECT repo, 'package' AS name FROM s WHERE k % 10 <> 9 UNION ALL SELECT repo, 'pyproject' FROM s WHERE k % 10 = 9
  UNION ALL SELECT repo, 'yarn' FROM s WHERE k % 4 = 1 UNION ALL SELECT repo, 'requirements' FROM s WHERE k % 11 = 0
  UNION ALL SELECT repo, 'manage' FROM s WHERE k % 13 = 0 UNION ALL SELECT repo, 'dags' FROM s WHERE k % 17 = 0
  UNION ALL SELECT repo, 'src' FROM s WHERE k % 2 = 0 OR k % 5 = 1 UNION ALL SELECT repo, 'index' FROM s WHERE k % 4 = 2
  UNION ALL SELECT repo, 'my-part' FROM s WHERE k % 2 = 0 UNION ALL SELECT repo, 'myPart' FROM s WHERE k % 2 = 1
  UNION ALL SELECT repo, 'lib' FROM s WHERE k % 2 = 1 UNION ALL SELECT repo, 'tests' FROM s WHERE k % 5 = 0
  UNION ALL SELECT repo, 'b.test' FROM s WHERE k % 5 = 1 UNION ALL SELECT repo, 'packages' FROM s WHERE k % 19 = 0),
c AS (SELECT repo, count(*) FILTER (WHERE name = 'my-part') AS kebab, count(*) FILTER (WHERE regexp_matches(name, '^[a-z][a-zA-Z0-9]+$')) AS camel FROM e GROUP BY 1)
"""


@query("b13_file_naming", ENTRY_SQL + "SELECT repo, CASE WHEN camel >= kebab THEN 'camelCase' ELSE 'kebab-case' END AS file_naming FROM c")
def b13(spark, sf):
    return Y.file_naming(repo_files(spark, sf))


@query("b14_export_import_style", SUP + """
SELECT repo, CASE WHEN k % 4 = 2 THEN 'barrel' ELSE 'named' END AS export_style, CASE WHEN k % 4 = 0 THEN 'alias' ELSE 'relative' END AS import_style FROM s""")
def b14(spark, sf):
    return Y.export_import_style(repo_files(spark, sf))


@query("b15_test_layout", SUP + """
SELECT repo, CASE k % 5 WHEN 0 THEN 'tests' WHEN 1 THEN 'co-located' ELSE 'unknown' END AS test_location,
  CASE WHEN k % 5 = 0 THEN '*.spec.ts' ELSE '*.test.ts' END AS test_naming,
  CASE k % 5 WHEN 0 THEN 'dedicated-directory' WHEN 1 THEN 'co-located' ELSE 'unknown' END AS test_style FROM s""")
def b15(spark, sf):
    return Y.test_layout(repo_files(spark, sf))


@query("b16_tooling", SUP + """
SELECT repo, CASE WHEN k % 10 = 9 THEN 'python' WHEN k % 2 = 0 THEN 'typescript' ELSE 'javascript' END AS language,
  CASE WHEN k % 10 <> 9 AND k % 4 = 1 THEN 'yarn' ELSE 'npm' END AS package_manager,
  CASE WHEN k % 10 = 9 THEN 'pytest' WHEN k % 5 = 0 THEN 'vitest' WHEN k % 5 = 1 THEN 'jest' ELSE 'unknown' END AS test_framework,
  CASE WHEN k % 10 = 9 THEN 'pytest' WHEN k % 5 = 0 THEN 'npx vitest run' WHEN k % 5 = 1 THEN 'npx jest'
       WHEN k % 5 = 2 THEN CASE WHEN k % 4 = 1 THEN 'yarn' ELSE 'npm' END || ' run test' ELSE 'npm test' END AS test_command,
  CASE WHEN k % 5 = 0 THEN 'eslint' END AS linter, CASE WHEN k % 5 = 1 THEN 'prettier' END AS formatter, CASE WHEN k % 5 = 1 THEN 'vite' END AS build_tool
FROM s""")
def b16(spark, sf):
    return Y.tooling(repo_files(spark, sf))


@query("b17_detect_frameworks", SUP + """
SELECT repo, 'express' AS framework FROM s WHERE k % 10 <> 9 UNION SELECT repo, 'react' FROM s WHERE k % 10 <> 9 AND k % 3 = 0
UNION SELECT repo, 'flask' FROM s WHERE k % 11 = 0 UNION SELECT repo, 'spark' FROM s WHERE k % 11 = 0
UNION SELECT repo, 'django' FROM s WHERE k % 13 = 0 UNION SELECT repo, 'airflow' FROM s WHERE k % 17 = 0""")
def b17(spark, sf):
    return Y.detect_frameworks(repo_files(spark, sf))


@query("b18_modules", WITH + """,
t AS (SELECT repo, d::VARCHAR AS module, unnest(['fn_' || p, 'K' || p]) AS name FROM p),
r AS (SELECT *, row_number() OVER (PARTITION BY module ORDER BY name) AS nth FROM t)
SELECT repo, module, (SELECT count(*) FROM p WHERE p.d::VARCHAR = r.module) AS file_count, string_agg(name, ',' ORDER BY name) AS exported_symbols
FROM r WHERE nth <= 20 GROUP BY 1, 2""")
def b18(spark, sf):
    return Y.modules(ts_files(spark, sf), symbols=20).withColumn("exported_symbols", F.array_join("exported_symbols", ","))


@query("b18_page_modules", r"""
WITH f AS (SELECT regexp_extract(url, '^[a-z]+://([^/]+)', 1) AS repo, regexp_extract(url, '^[a-z]+://[^/]+/([^?#]*)', 1) AS path FROM pages)
SELECT repo, CASE WHEN contains(path, '/') THEN split_part(path, '/', 1) ELSE 'root' END AS module, count(*) AS file_count, '' AS exported_symbols
FROM f GROUP BY 1, 2""")
def b18_pages(spark, sf):
    files = table(spark, sf, "pages").select(
        F.regexp_extract("url", "^[a-z]+://([^/]+)", 1).alias("repo"), F.regexp_extract("url", "^[a-z]+://[^/]+/([^?#]*)", 1).alias("path"),
        F.lit("").alias("content"),
    )
    return Y.modules(files).withColumn("exported_symbols", F.array_join("exported_symbols", ","))


@query("b19_project_layout", SUP + """
SELECT repo, CASE WHEN k % 2 = 0 OR k % 5 = 1 THEN 'src/' ELSE 'lib/' END AS src_layout, k % 19 = 0 OR (k % 7 = 0 AND k % 10 <> 9) AS monorepo,
  CASE WHEN k % 4 = 2 THEN 'src/index.ts' ELSE '' END AS entry_points FROM s""")
def b19(spark, sf):
    return Y.project_layout(repo_files(spark, sf)).withColumn("entry_points", F.array_join("entry_points", ","))
