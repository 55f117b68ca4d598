"""Registered queries of the symbol and impact operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from codeatlas.operators import closure as C, reach as R, trace as T
from codeatlas.plans import adapters as A
from codeatlas.plans.registry import query

WITH = "WITH RECURSIVE " + A.TRACE_SQL

HOT_SQL = """,
hot AS (SELECT DISTINCT name FROM symbols)
"""


def all_names(spark, sf):
    return A.symbols(spark, sf).select("repo", "name").distinct()


@query("d1_lookup", WITH + "SELECT * FROM symbols WHERE file = 'Brand#7'")
def d1(spark, sf):
    return T.lookup(A.symbols(spark, sf), file="Brand#7")


@query("d2_candidates", WITH + "SELECT repo, id, name, file FROM symbols WHERE lower(name) LIKE '%n\\_19%' ESCAPE '\\' ORDER BY repo, name, id LIMIT 10")
def d2(spark, sf):
    return T.candidates(A.symbols(spark, sf), "N_19", 10).select("repo", "id", "name", "file")


@query("d3_callers", WITH + """
SELECT c.repo, callee_name AS callee, caller_id, s.name AS caller, s.kind, c.file, c.line, c.arguments AS args, s.language
FROM calls c JOIN symbols s ON s.id = c.caller_id""")
def d3(spark, sf):
    return T.callers(A.symbols(spark, sf), A.calls(spark, sf))


@query("d4_callees", WITH + """
SELECT repo, caller_id, callee_name AS name, file, line, arguments AS args FROM calls
WHERE caller_id IN (SELECT id FROM symbols WHERE kind = 'class')""")
def d4(spark, sf):
    classes = A.symbols(spark, sf).filter("kind = 'class'")
    return T.callees(A.calls(spark, sf), classes)


@query("d5_importers", WITH + """
SELECT repo, file, symbol_name, source_module FROM imports WHERE symbol_name IN (SELECT name FROM symbols WHERE kind = 'method')""")
def d5(spark, sf):
    return T.importers(A.imports(spark, sf), A.symbols(spark, sf).filter("kind = 'method'"))


CHAIN_SQL = WITH + HOT_SQL + """,
step AS (
  SELECT callee_name AS name, s.name AS caller, min({'id': s.id, 'file': s.file, 'line': s.line, 'language': s.language}) AS info
  FROM calls c JOIN symbols s ON s.id = c.caller_id GROUP BY 1, 2),
up(root, name, depth) AS (
  SELECT name, name, 0 FROM hot
  UNION SELECT root, caller, depth + 1 FROM up JOIN step USING (name) WHERE depth < 40),
best AS (SELECT root, name, min(depth) AS depth FROM up GROUP BY 1, 2),
tree AS (
  SELECT b.root, b.name, b.depth, min({'parent': p.name, 'info': step.info}) AS m
  FROM best b JOIN best p ON p.root = b.root AND p.depth = b.depth - 1 JOIN step ON step.name = p.name AND step.caller = b.name
  WHERE b.depth > 0 GROUP BY ALL)
"""


@query("d6_upstream_chain", CHAIN_SQL + """
SELECT 'shop' AS repo, root, name, m.parent AS parent, CAST(depth AS INTEGER) AS depth, m.info.file AS file,
       m.info.line AS line, m.info.language AS language FROM tree""")
def d6(spark, sf):
    return R.upstream_chain(A.symbols(spark, sf), A.calls(spark, sf), all_names(spark, sf)).drop("branch")


@query("d7_direct_callers", WITH + """
SELECT c.repo, callee_name AS callee, caller_id, s.name AS caller, s.file, min(c.line) AS line, s.language
FROM calls c JOIN symbols s ON s.id = c.caller_id GROUP BY ALL""")
def d7(spark, sf):
    return T.direct_callers(A.symbols(spark, sf), A.calls(spark, sf))


TOUCH_SQL = """,
touch AS (
  SELECT symbol_id, table_name, column_name, min(operation) AS operation,
         bool_or(operation IN ('UPDATE', 'INSERT', 'DELETE')) AS writes, bool_or(operation IN ('SELECT', 'READ')) AS reads
  FROM columns_ WHERE symbol_id IN (SELECT id FROM symbols) GROUP BY 1, 2, 3),
changed AS (SELECT id FROM symbols WHERE file = 'Brand#7')
"""


@query("d8_column_dependents", WITH + TOUCH_SQL + """
SELECT 'shop' AS repo, a.symbol_id, b.symbol_id AS other_id, table_name, column_name, b.operation
FROM touch a JOIN touch b USING (table_name, column_name)
WHERE a.symbol_id <> b.symbol_id AND a.symbol_id IN (SELECT id FROM changed)""")
def d8(spark, sf):
    symbols = A.symbols(spark, sf)
    return T.column_dependents(symbols, A.columns(spark, sf), T.lookup(symbols, file="Brand#7"))


@query("d9_downstream_effects", WITH + TOUCH_SQL + """
SELECT 'shop' AS repo, a.symbol_id, b.symbol_id AS other_id, table_name, column_name
FROM touch a JOIN touch b USING (table_name, column_name)
WHERE a.symbol_id <> b.symbol_id AND a.writes AND b.reads AND a.symbol_id IN (SELECT id FROM changed)""")
def d9(spark, sf):
    symbols = A.symbols(spark, sf)
    return T.downstream_effects(symbols, A.columns(spark, sf), T.lookup(symbols, file="Brand#7"))


IMPACT_SQL = WITH + TOUCH_SQL + """,
cal AS (SELECT s.id, count(DISTINCT c.caller_id) AS n, bool_or(k.language <> s.language) AS foreign_
        FROM symbols s JOIN calls c ON c.callee_name = s.name JOIN symbols k ON k.id = c.caller_id GROUP BY 1),
ref AS (SELECT symbol_id AS id, count(*) AS n FROM columns_ GROUP BY 1),
dep AS (SELECT a.symbol_id AS id, count(*) AS n, count(*) FILTER (WHERE a.writes AND b.reads) AS d
        FROM touch a JOIN touch b USING (table_name, column_name) WHERE a.symbol_id <> b.symbol_id GROUP BY 1),
cnt AS (
  SELECT s.id AS symbol_id, coalesce(cal.n, 0) AS callers, coalesce(ref.n, 0) AS columns, coalesce(dep.n, 0) AS dependents,
         coalesce(dep.d, 0) AS downstream, coalesce(foreign_, false) AS f
  FROM symbols s LEFT JOIN cal USING (id) LEFT JOIN ref USING (id) LEFT JOIN dep USING (id)),
lvl AS (SELECT *, CASE WHEN callers + dependents >= 10 THEN 'CRITICAL' WHEN callers >= 4 OR columns >= 4 OR f THEN 'HIGH'
                       WHEN callers >= 2 OR columns >= 1 THEN 'MEDIUM' ELSE 'LOW' END AS risk FROM cnt),
why AS (SELECT *, CASE risk
  WHEN 'CRITICAL' THEN (callers + dependents) || ' total dependents (' || callers || ' callers, ' || dependents || ' column dependents)'
  WHEN 'HIGH' THEN concat_ws(', ', CASE WHEN callers >= 4 THEN callers || ' direct callers' END,
    CASE WHEN columns >= 4 THEN columns || ' column references' END, CASE WHEN f THEN 'cross-language callers' END)
  WHEN 'MEDIUM' THEN concat_ws(', ', CASE WHEN callers >= 2 THEN callers || ' direct callers' END,
    CASE WHEN columns >= 1 THEN columns || ' column references' END)
  ELSE CASE WHEN callers = 0 THEN 'No callers found' ELSE callers || ' caller, no column references' END END AS reason FROM lvl)
"""


@query("d10_risk_level", IMPACT_SQL + "SELECT 'shop' AS repo, risk, count(*) AS symbols FROM why GROUP BY 2")
def d10(spark, sf):
    counts = T.impact_counts(A.symbols(spark, sf), A.calls(spark, sf), A.columns(spark, sf))
    return T.risk_level(counts).groupBy("repo", "risk").agg(F.count("*").alias("symbols"))


@query("d11_impact_report", IMPACT_SQL + """
SELECT 'shop' AS repo, symbol_id, callers, columns, dependents, downstream, risk, reason FROM why""")
def d11(spark, sf):
    return T.impact_report(A.symbols(spark, sf), A.calls(spark, sf), A.columns(spark, sf))


@query("d12_caller_multiplicity", WITH + """
SELECT c.repo, callee_name AS callee, s.name AS caller, c.file, count(*) AS sites, min(c.line) AS first_line
FROM calls c JOIN symbols s ON s.id = c.caller_id GROUP BY 1, 2, 3, 4""")
def d12(spark, sf):
    return T.caller_multiplicity(T.callers(A.symbols(spark, sf), A.calls(spark, sf)))


@query("d13_trace_summary", CHAIN_SQL + """,
br(root, name, branch, depth) AS (
  SELECT root, name, name, depth FROM tree WHERE depth = 1
  UNION ALL SELECT t.root, t.name, br.branch, t.depth FROM br JOIN tree t ON t.root = br.root AND t.m.parent = br.name AND t.depth = br.depth + 1),
sec AS (
  SELECT callee_name AS name, 'callers' AS section, s.name || ' at ' || c.file || ':' || c.line AS item,
         row_number() OVER (PARTITION BY callee_name ORDER BY c.file, c.line, s.name, c.arguments) AS place, 10 AS k,
         count(*) OVER (PARTITION BY callee_name) AS total
  FROM calls c JOIN symbols s ON s.id = c.caller_id WHERE callee_name IN (SELECT name FROM hot)
  UNION ALL
  SELECT s.name, 'callees', callee_name, row_number() OVER (PARTITION BY s.name ORDER BY c.file, c.line, callee_name, c.arguments), 10,
         count(*) OVER (PARTITION BY s.name)
  FROM calls c JOIN symbols s ON s.id = c.caller_id WHERE s.name IN (SELECT name FROM hot)
  UNION ALL
  SELECT symbol_name, 'imports', file || ' from ' || source_module, row_number() OVER (PARTITION BY symbol_name ORDER BY file, source_module), 10,
         count(*) OVER (PARTITION BY symbol_name)
  FROM imports WHERE symbol_name IN (SELECT name FROM hot)
  UNION ALL
  SELECT root, 'chain', name || ' at ' || m.info.file || ':' || m.info.line || ' (' ||
         (SELECT count(*) - 1 FROM br WHERE br.root = tree.root AND br.branch = tree.name) || ' upstream)',
         row_number() OVER (PARTITION BY root ORDER BY name), 5, count(*) OVER (PARTITION BY root)
  FROM tree WHERE depth = 1)
SELECT 'shop' AS repo, name, section, CAST(place AS INTEGER) AS place, item, greatest(total - k, 0) AS more FROM sec WHERE place <= k""")
def d13(spark, sf):
    return T.trace_summary(A.symbols(spark, sf), A.calls(spark, sf), A.imports(spark, sf), all_names(spark, sf), k=10, roots=5)


@query("c19_bind_ids", WITH + """
SELECT c.repo, c.file, c.id, c.callee_name, s.symbol_id FROM calls c
JOIN symbols k ON k.id = c.caller_id
JOIN (SELECT file, name, max_by(id, line) AS symbol_id FROM symbols GROUP BY 1, 2) s ON s.file = c.file AND s.name = k.name""")
def c19(spark, sf):
    symbols = A.symbols(spark, sf)
    owner = symbols.select("repo", F.col("id").alias("caller_id"), F.col("name").alias("owner"))
    named = A.calls(spark, sf).join(owner, ["repo", "caller_id"]).select("repo", "file", "id", "callee_name", "owner")
    return T.bind_ids(named, symbols)


# ---------------------------------------------------------------- reach of every symbol


def reach_sql(edges: str, least: int = C.LEAST) -> str:
    """The closure of (src, dst), and what a node's `least` smallest hashes tell of its size."""
    return f""",
reach_edges AS ({edges}),
ends AS (SELECT src AS id FROM reach_edges UNION SELECT dst FROM reach_edges),
under(id, n) AS (SELECT id, id FROM ends UNION SELECT u.id, e.src FROM under u JOIN reach_edges e ON e.dst = u.n),
hashed AS (SELECT id, ('0x' || substr(md5('shop/' || n), 1, 15))::BIGINT AS h FROM under),
placed AS (SELECT id, h, row_number() OVER (PARTITION BY id ORDER BY h) AS place, count(*) OVER (PARTITION BY id) AS n FROM hashed),
told AS (
  SELECT id, n < {least} AS exact, n - 1 AS size,
         CASE WHEN n < {least} THEN n ELSE floor({least - 1}::DOUBLE * {2**60}::DOUBLE / h::DOUBLE + 0.5)::BIGINT END - 1 AS reached
  FROM placed WHERE place = least(n, {least}))
"""


CALL_EDGES = "SELECT DISTINCT s.name AS src, callee_name AS dst FROM calls c JOIN symbols s ON s.id = c.caller_id WHERE s.name <> callee_name"


@query("d6_reach_of_all", WITH + reach_sql(CALL_EDGES) + "SELECT 'shop' AS repo, id, reached, exact FROM told")
def d6_all(spark, sf):
    return C.reach_estimates(C.call_edges(A.symbols(spark, sf), A.calls(spark, sf)))


@query("d6_reach_exact", WITH + reach_sql(CALL_EDGES) + """
SELECT 'shop' AS repo, name AS id, coalesce(size, 0) AS reached FROM symbols LEFT JOIN told ON told.id = name WHERE file = 'Brand#7'""")
def d6_exact(spark, sf):
    """All transitive callers of what one file declares, counted."""
    symbols = A.symbols(spark, sf)
    changed = T.lookup(symbols, file="Brand#7").select("repo", F.col("name").alias("id"))
    return C.reach_sizes(C.call_edges(symbols, A.calls(spark, sf)), changed)


@query("d10_risk_and_reach", IMPACT_SQL + reach_sql(CALL_EDGES) + """
SELECT 'shop' AS repo, symbol_id, risk, coalesce(reached, 0) AS reached FROM why JOIN symbols s ON s.id = symbol_id LEFT JOIN told ON told.id = s.name""")
def d10_reach(spark, sf):
    """Risk of changing each symbol by its direct counts, beside how many symbols call it through others."""
    symbols, calls = A.symbols(spark, sf), A.calls(spark, sf)
    risk = T.risk_level(T.impact_counts(symbols, calls, A.columns(spark, sf))).select("repo", "symbol_id", "risk")
    under = C.reach_estimates(C.call_edges(symbols, calls)).select("repo", F.col("id").alias("name"), "reached")
    named = symbols.select("repo", F.col("id").alias("symbol_id"), "name")
    return risk.join(named, ["repo", "symbol_id"]).join(under, ["repo", "name"], "left").select("repo", "symbol_id", "risk", F.coalesce("reached", F.lit(0)).alias("reached"))


@query("e6_reach_of_all", "WITH RECURSIVE " + A.FK_SQL + reach_sql("SELECT DISTINCT src, dst FROM fk WHERE src <> dst") + "SELECT 'shop' AS repo, id, reached, exact FROM told")
def e6_all(spark, sf):
    """How many nodes of the foreign-key graph depend on each."""
    return C.reach_estimates(A.fk_edges(spark, sf))
