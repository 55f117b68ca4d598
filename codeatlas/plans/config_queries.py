"""Registered queries of configuration, change and JSON operators, over files written out from the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from codeatlas.operators import config as C, jsondocs as J, verify as V
from codeatlas.plans import adapters as A
from codeatlas.plans.registry import query, table
from codeatlas.session import scratch_path
from codeatlas.sources import convert, logs, manifests


def lines(*parts):
    """A text of several lines; null lines are left out."""
    return F.concat_ws("\n", *[p if not isinstance(p, str) else F.lit(p) for p in parts])


def text(*parts):
    return F.concat(*[p.cast("string") if not isinstance(p, str) else F.lit(p) for p in parts])


# ---------------------------------------------------------------- environment files: one per customer

ENV_ROWS = """
c AS (SELECT lower(c_mktsegment) AS repo, c_custkey AS k, c_name AS n FROM customer),
env AS (
  SELECT repo, '.env.' || k AS file, CAST(line AS INTEGER) AS line, key, value, comment, raw, k FROM (
    SELECT repo, k, 2 AS line, 'DB_HOST' AS key, 'host' || k AS value, 'owner ' || n AS comment, 'DB_HOST = host' || k AS raw FROM c
    UNION ALL SELECT repo, k, 5, 'API_KEY', 'k' || k || 'abc', NULL, 'API_KEY="k' || k || 'abc"' FROM c
    UNION ALL SELECT repo, k, 6, 'EMPTY_TOKEN', '', NULL, 'EMPTY_TOKEN=' FROM c
    UNION ALL SELECT repo, k, 8, 'DATABASE', 'pg://u:pw' || k || '@db/x', 'where data lives', 'DATABASE=pg://u:pw' || k || '@db/x' FROM c
    UNION ALL SELECT repo, k, 9, 'GREETING', 'hello world', NULL, 'GREETING=hello world' FROM c
    UNION ALL SELECT repo, k, 10, 'DEBUG', 'true', NULL, 'DEBUG=''true''' FROM c
    UNION ALL SELECT repo, k, 11, CASE WHEN k % 3 = 0 THEN 'bad-key' ELSE 'DB_HOST' END, 'a=b', NULL,
                     CASE WHEN k % 3 = 0 THEN 'bad-key' ELSE 'DB_HOST' END || '=a=b' FROM c))
"""
ENV_SQL = "WITH " + ENV_ROWS


def env_files(spark, sf):
    k = F.col("c_custkey")
    body = lines(
        text("# owner ", F.col("c_name")), text("DB_HOST = host", k), "# lost", "", text('API_KEY="k', k, 'abc"'), "EMPTY_TOKEN=",
        "  # where data lives", text("DATABASE=pg://u:pw", k, "@db/x"), "GREETING=hello world", "DEBUG='true'",
        F.when(k % 3 == 0, "bad-key=a=b").otherwise("DB_HOST=a=b"), "no setting here",
    )
    return table(spark, sf, "customer").select(F.lower("c_mktsegment").alias("repo"), text(".env.", k).alias("path"), body.alias("content"))


def settings(spark, sf):
    return C.parse_env(env_files(spark, sf))


SECRET = "regexp_matches(key, '(?i)password|secret|token|key|private|credential|auth|jwt|bearer|connection_string|database_url|dsn')"


@query("s7_parse_env", ENV_SQL + "SELECT * EXCLUDE (k) FROM env")
def s7(spark, sf):
    return settings(spark, sf)


@query("s8_env_inventory", ENV_SQL + f"""
SELECT repo, file, count(*) AS vars, count(*) FILTER (WHERE {SECRET}) AS secrets, count(*) FILTER (WHERE value = '') AS empty FROM env GROUP BY 1, 2""")
def s8(spark, sf):
    return C.env_inventory(settings(spark, sf))


@query("s9_env_drift", ENV_SQL + """,
a AS (SELECT DISTINCT repo, key || CASE WHEN k % 2 = 0 THEN '' ELSE '_' || k END AS key FROM env),
b AS (SELECT DISTINCT repo, key || CASE WHEN k % 4 < 2 THEN '' ELSE '_' || k END AS key FROM env WHERE key <> 'DEBUG')
SELECT coalesce(a.repo, b.repo) AS repo, coalesce(a.key, b.key) AS key,
  CASE WHEN a.key IS NULL THEN 'missing' WHEN b.key IS NULL THEN 'extra' ELSE 'common' END AS side
FROM a FULL JOIN b ON a.repo = b.repo AND a.key = b.key""")
def s9(spark, sf):
    s = settings(spark, sf).withColumn("k", F.substring_index("file", ".", -1).cast("long"))
    tail = text("_", F.col("k"))
    a = s.withColumn("key", F.concat("key", F.when(F.col("k") % 2 == 0, "").otherwise(tail)))
    b = s.filter("key <> 'DEBUG'").withColumn("key", F.concat("key", F.when(F.col("k") % 4 < 2, "").otherwise(tail)))
    return C.env_drift(a, b)


@query("s10_env_empty", ENV_SQL + "SELECT repo, file, line, key, comment FROM env WHERE value = ''")
def s10(spark, sf):
    return C.env_empty(settings(spark, sf))


@query("s11_env_validate", ENV_SQL + f""",
n AS (SELECT *, row_number() OVER (PARTITION BY repo, file, key ORDER BY line) AS nth FROM env)
SELECT repo, file, line, key, 'duplicate key' AS issue FROM n WHERE nth > 1
UNION ALL SELECT repo, file, line, key, 'non-standard key format' FROM n WHERE key = 'bad-key'
UNION ALL SELECT repo, file, line, key, 'empty secret' FROM n WHERE value = '' AND {SECRET}
UNION ALL SELECT repo, file, line, key, 'unquoted value with spaces' FROM n WHERE contains(value, ' ') AND NOT contains(raw, '"')""")
def s11(spark, sf):
    return C.env_validate(settings(spark, sf))


@query("s12_env_redact", ENV_SQL + """
SELECT repo, file, line, key, CASE key WHEN 'API_KEY' THEN left(value, 2) || repeat('*', length(value) - 4) || right(value, 2)
  WHEN 'DATABASE' THEN 'pg://u:****@db/x' WHEN 'bad-key' THEN '****' ELSE value END AS value FROM env""")
def s12(spark, sf):
    return C.env_redact(settings(spark, sf)).select("repo", "file", "line", "key", "value")


# ---------------------------------------------------------------- manifests: one package.json and requirements.txt per supplier

DEPS_ROWS = """
sup AS (SELECT 's' || (s_nationkey % 5) AS repo, s_suppkey AS k FROM supplier),
deps AS (
  SELECT repo, k || '/package.json' AS path, 'lib' || (k % 9) AS name, 'dependencies' AS section, '^' || k AS version, k FROM sup
  UNION ALL SELECT repo, k || '/package.json', 'pkg' || k, 'dependencies', '1.0', k FROM sup
  UNION ALL SELECT repo, k || '/package.json', 'eslint-x' || (k % 3), 'devDependencies', '2', k FROM sup
  UNION ALL SELECT repo, k || '/package.json', '@a/dev' || k, 'devDependencies', '*', k FROM sup
  UNION ALL SELECT repo, k || '/requirements.txt', 'py-lib' || k, 'requirements', '==1.' || k, k FROM sup
  UNION ALL SELECT repo, k || '/requirements.txt', 'flask', 'requirements', '', k FROM sup WHERE k % 4 = 0)
"""


def manifest_files(spark, sf):
    k = F.col("s_suppkey")
    package = F.to_json(F.struct(
        text("s", k).alias("name"),
        F.create_map(text("lib", k % 9), text("^", k), text("pkg", k), F.lit("1.0")).alias("dependencies"),
        F.create_map(text("eslint-x", k % 3), F.lit("2"), text("@a/dev", k), F.lit("*")).alias("devDependencies"),
    ))
    pins = lines("# pinned", text("Py-Lib", k, "==1.", k, "   # why"), "", F.when(k % 4 == 0, "flask"))
    base = table(spark, sf, "supplier").withColumn("repo", text("s", F.col("s_nationkey") % 5))
    return base.select("repo", text(k, "/package.json").alias("path"), package.alias("content")).unionByName(
        base.select("repo", text(k, "/requirements.txt").alias("path"), pins.alias("content"))
    )


@query("a9_read_manifests", "WITH " + DEPS_ROWS + "SELECT * EXCLUDE (k) FROM deps")
def a9(spark, sf):
    return manifests.read_manifests(manifest_files(spark, sf))


@query("s13_unused_dependencies", "WITH " + DEPS_ROWS + """,
d AS (SELECT DISTINCT repo, name, section FROM deps WHERE section = 'dependencies' OR (section = 'devDependencies' AND name NOT LIKE 'eslint%')),
used AS (SELECT 'pkg' || (l_suppkey * 2) AS name FROM lineitem UNION SELECT 'lib' || (l_orderkey % 8) FROM lineitem)
SELECT repo, name, section FROM d WHERE name NOT IN (SELECT name FROM used)""")
def s13(spark, sf):
    declared = manifests.read_manifests(manifest_files(spark, sf)).select("repo", "name", "section").distinct()
    item = table(spark, sf, "lineitem")
    used = item.select(text("pkg", F.col("l_suppkey") * 2).alias("name")).unionByName(
        item.select(text("lib", F.col("l_orderkey") % 8).alias("name"))
    ).distinct()
    repos = declared.select("repo").distinct()
    # what one repo uses, all use: a handful of repos takes the same small list each
    return C.unused_dependencies(declared, used.withColumn("repo", F.explode(F.array(*[F.lit(f"s{i}") for i in range(5)]))).join(repos, "repo", "left_semi"))


@query("s13_parts_never_returned", """
SELECT 'shop' AS repo, 'c' || p_partkey AS name, 'dependencies' AS section FROM part
WHERE p_partkey NOT IN (SELECT 3 * l_partkey FROM lineitem WHERE l_returnflag = 'R')""")
def s13_parts(spark, sf):
    declared = table(spark, sf, "part").select(
        F.lit("shop").alias("repo"), text("c", F.col("p_partkey")).alias("name"), F.lit("dependencies").alias("section")
    )
    returned = table(spark, sf, "lineitem").filter("l_returnflag = 'R'")
    return C.unused_dependencies(declared, returned.select(F.lit("shop").alias("repo"), text("c", F.col("l_partkey") * 3).alias("name")))


@query("s14_dependency_counts", "WITH " + DEPS_ROWS + "SELECT repo, section, count(*) AS dependencies FROM deps GROUP BY 1, 2")
def s14_counts(spark, sf):
    return C.dependency_counts(manifests.read_manifests(manifest_files(spark, sf)))


@query("s14_dependency_sizes", """
WITH f AS (SELECT 'docs' AS repo, CASE WHEN lang = 'en' THEN source ELSE '@' || source || '/' || lang END AS name, n_chars AS size FROM documents)
SELECT repo, name, CAST(sum(size) AS BIGINT) AS bytes, count(*) AS files FROM f WHERE name <> 'src3' GROUP BY 1, 2
ORDER BY bytes DESC, repo, name LIMIT 25""")
def s14_sizes(spark, sf):
    docs = table(spark, sf, "documents")
    name = F.when(F.col("lang") == "en", F.col("source")).otherwise(F.concat(F.lit("@"), "source", F.lit("/"), "lang"))
    files = docs.select(F.lit("docs").alias("repo"), text("node_modules/", name, "/x/", F.col("doc_id")).alias("path"), F.col("n_chars").alias("size"))
    declared = docs.select(F.lit("docs").alias("repo"), name.alias("name")).filter("name <> 'src3'").distinct()
    return C.dependency_sizes(files, declared)


COMMANDS = [
    "ls -la", "git  status", "git push origin main", "rm -rf /tmp/x", "rm -rf build", "npm test", "npm install x", "cat a | wc", "sudo ls",
    "python -m pytest -q", "terraform apply", "deploy now", "chmod 777 /etc", "chmod +x a", "git branch -D old", "make build", "lsof",
    "node a.js", "su", "git checkout -- a",
]


def _command_tier() -> str:
    told = {
        "blocked": ["rm -rf /tmp/x", "sudo ls", "chmod 777 /etc", "su"], "safe": ["ls -la", "git  status", "npm test", "python -m pytest -q",
        "terraform apply", "node a.js"], "moderate": ["npm install x", "make build", "lsof"],
    }
    whens = " ".join(f"WHEN cmd IN ({', '.join(repr(c) for c in cs)}) THEN '{tier}'" for tier, cs in told.items())
    return f"CASE {whens} ELSE 'dangerous' END"


@query("s15_classify_commands", f"""
WITH c AS (SELECT 'p' || (user_id % 10) AS repo, list_extract([{', '.join(repr(c) for c in COMMANDS)}], CAST((event_id * 7 + user_id) % 20 AS INTEGER) + 1) AS cmd FROM events)
SELECT repo, array_to_string(regexp_split_to_array(cmd, '\\s+')[1:2], ' ') AS kind, {_command_tier()} AS tier, count(*) AS commands FROM c GROUP BY ALL""")
def s15(spark, sf):
    pick = F.get(F.array(*[F.lit(c) for c in COMMANDS]), ((F.col("event_id") * 7 + F.col("user_id")) % 20).cast("int"))
    log = table(spark, sf, "events").select(text("p", F.col("user_id") % 10).alias("repo"), pick.alias("command"))
    return C.classify_commands(log, safe=["terraform"], dangerous=["deploy"])


# ---------------------------------------------------------------- diffs: one change per part

DIFF_ROWS = """
ch AS (
  SELECT p_brand AS repo, CAST(p_partkey AS VARCHAR) AS change_id, p_partkey AS k, 1 + p_partkey % 40 AS files, p_size AS ins,
         (p_partkey * 13) % 90 AS del, p_partkey % 11 = 0 AS env FROM part)
"""


CHANGES_A_TASK = 5_000


def diffs(spark, sf):
    k = F.col("p_partkey")
    # A change is some hundred times its key: keys are dealt out before they become texts, so a task has so many texts at any size of the table.
    part = table(spark, sf, "part").select("p_partkey", "p_brand", "p_size")
    part = part.repartition(max(spark.sparkContext.defaultParallelism, -(-part.count() // CHANGES_A_TASK)))
    header = lambda f: F.concat(F.lit("diff --git a/"), f, F.lit(" b/"), f, F.lit("\n--- a/"), f, F.lit("\n+++ b/"), f, F.lit("\n@@ -1 +1 @@"))
    names = F.transform(
        F.sequence(F.lit(0).cast("long"), k % 40),
        lambda i: F.when((i == 0) & (k % 11 == 0), F.lit("conf/.env")).otherwise(F.concat(F.lit("src/f"), i.cast("string"), F.lit(".ts"))),
    )
    body = F.concat(
        F.array_join(F.transform(names, header), "\n"), F.lit("\n same\n"),
        F.repeat(text("+new ", k, "\n"), F.col("p_size")), F.repeat(F.lit("-old\n"), ((k * 13) % 90).cast("int")), F.lit(" end"),
    )
    return part.select(F.col("p_brand").alias("repo"), k.cast("string").alias("change_id"), body.alias("text"))


def diff_rows(spark, sf):
    return logs.read_unified_diff(diffs(spark, sf))


@query("a11_read_unified_diff", "WITH " + DIFF_ROWS + """,
f AS (SELECT repo, change_id, files, ins, del, k, CASE WHEN i = 0 AND env THEN 'conf/.env' ELSE 'src/f' || i || '.ts' END AS file, i
      FROM ch, LATERAL (SELECT unnest(range(0, files)) AS i))
SELECT repo, change_id, file, NULL::VARCHAR AS kind, 1::BIGINT AS n FROM f
UNION ALL SELECT repo, change_id, file, '+', ins FROM f WHERE i = files - 1 AND ins > 0
UNION ALL SELECT repo, change_id, file, '-', del FROM f WHERE i = files - 1 AND del > 0""")
def a11(spark, sf):
    return diff_rows(spark, sf).groupBy("repo", "change_id", "file", "kind").agg(F.count("*").alias("n"))


@query("s3_diff_stats", "WITH " + DIFF_ROWS + """
SELECT repo, change_id, files, CAST(ins AS BIGINT) AS insertions, del AS deletions FROM ch""")
def s3(spark, sf):
    return V.diff_stats(diff_rows(spark, sf))


@query("s4_diff_sanity", "WITH " + DIFF_ROWS + """,
i AS (SELECT *, CAST(del > 50 AND del > 3 * ins AS BIGINT) + CAST(files > 30 AS BIGINT) + CAST(env AS BIGINT) AS issues FROM ch)
SELECT repo, change_id, CASE WHEN issues > 0 THEN 'warn' ELSE 'pass' END AS status, issues FROM i""")
def s4(spark, sf):
    return V.diff_sanity(diff_rows(spark, sf))


@query("s5_risk_score", """
WITH c AS (
  SELECT p_brand AS repo, p_partkey AS change_id,
    list_extract([0, 0.4, 0.05], CAST(p_partkey % 3 AS INTEGER) + 1) + list_extract([0, 0.2, 0.05, 0], CAST(p_partkey % 4 AS INTEGER) + 1)
    + list_extract([0, 0.25, 0.05, 0, 0], CAST(p_partkey % 5 AS INTEGER) + 1)
    + CASE WHEN p_partkey % 2 = 0 THEN CASE WHEN p_size % 4 = 0 THEN 0.15 ELSE p_size / 100.0 * 0.3 END ELSE 0.1 END AS s,
    p_partkey % 3 = 1 OR p_partkey % 4 = 1 OR p_partkey % 5 = 1 OR p_partkey % 2 = 1 AS failed FROM part),
r AS (SELECT repo, change_id, failed, CAST(round(least(s, 1.0) * 10000) AS INTEGER) AS u FROM c)
SELECT repo, change_id, floor(u / 100.0 + 0.5) / 100 AS score,
  CASE WHEN u < 2000 THEN 'low' WHEN u < 4500 THEN 'medium' WHEN u < 7000 THEN 'high' ELSE 'critical' END AS risk, failed FROM r""")
def s5(spark, sf):
    k = F.col("p_partkey")
    state = lambda n: F.when(k % n == 1, "fail").when(k % n == 2, "warn").otherwise("pass")
    check = lambda name, status, message="": F.struct(
        F.lit(name).alias("name"), status.alias("status"), (F.lit(message) if isinstance(message, str) else message).alias("message")
    )
    review = F.when(F.col("p_size") % 4 == 0, "Risk: unclear").otherwise(text("Risk: high (", F.col("p_size"), "%) - look"))
    rows = F.array(
        check("secrets", state(3)), check("typecheck", state(4)), check("tests", state(5)),
        check("ai-review", F.when(k % 2 == 0, "warn").otherwise("pass"), review),
        check("other", F.when(k % 2 == 1, "fail").otherwise("skip")),
    )
    checks = table(spark, sf, "part").select(F.col("p_brand").alias("repo"), k.alias("change_id"), F.explode(rows).alias("c")).select(
        "repo", "change_id", "c.*"
    )
    return V.risk_score(checks)


# ---------------------------------------------------------------- JSON documents

DOC_ROWS = """
doc AS (SELECT lower(c_mktsegment) AS repo, c_custkey AS key, c_name AS n, c_nationkey AS nk FROM customer)
"""


def docs(spark, sf):
    """A nested document per customer."""
    k, nk = F.col("c_custkey"), F.col("c_nationkey")
    body = F.concat(
        F.lit('{"name": "'), F.col("c_name"), F.lit('", "geo": {"nation": '), nk.cast("string"),
        F.lit(', "tags": ["a", {"deep": '), (k % 7).cast("string"), F.lit("}], \"none\": null, \"empty\": {}}, \"ok\": true}"),
    )
    return table(spark, sf, "customer").select(F.lower("c_mktsegment").alias("repo"), k.alias("key"), body.alias("json"))


@query("j1_json_path", "WITH " + DOC_ROWS + """
SELECT repo, key, CAST(key % 7 AS VARCHAR) AS deep, 'a' AS tag, n AS name, NULL::VARCHAR AS missing FROM doc""")
def j1(spark, sf):
    return docs(spark, sf).select(
        "repo", "key", J.json_path("json", "geo.tags[1].deep").alias("deep"), J.json_path("json", "geo.tags[0]").alias("tag"),
        J.json_path("json", "name").alias("name"), J.json_path("json", "geo.tags[5].x").alias("missing"),
    )


@query("j1_json_path_events", "SELECT event_id, json_extract_string(props, '$.k') AS k FROM events")
def j1_events(spark, sf):
    return table(spark, sf, "events").select("event_id", J.json_path("props", "k").alias("k"))


@query("j2_json_flatten", "WITH " + DOC_ROWS + """
SELECT repo, key, 'name' AS path, '"' || n || '"' AS value FROM doc UNION ALL SELECT repo, key, 'geo.nation', nk::VARCHAR FROM doc
UNION ALL SELECT repo, key, 'geo.tags[0]', '"a"' FROM doc UNION ALL SELECT repo, key, 'geo.tags[1].deep', (key % 7)::VARCHAR FROM doc
UNION ALL SELECT repo, key, 'geo.none', 'null' FROM doc UNION ALL SELECT repo, key, 'ok', 'true' FROM doc""")
def j2(spark, sf):
    return J.json_flatten(docs(spark, sf))


@query("j2_json_flatten_events", "SELECT 'app' AS repo, event_id AS key, 'k' AS path, json_extract_string(props, '$.k') AS value FROM events")
def j2_events(spark, sf):
    return J.json_flatten(table(spark, sf, "events").select(F.lit("app").alias("repo"), F.col("event_id").alias("key"), F.col("props").alias("json")))


@query("j3_json_diff", "WITH " + DOC_ROWS + """,
old AS (SELECT 'app' AS repo, event_id AS key, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events)
SELECT repo, key, 'k' AS path, 'changed' AS change, k::VARCHAR AS old, (k + 1)::VARCHAR AS new FROM old WHERE key % 10 = 0 AND key % 97 <> 0
UNION ALL SELECT repo, key, '$', 'removed', '{"k":' || k || '}', NULL FROM old WHERE key % 97 = 0
UNION ALL SELECT repo, key, 'geo.tags[1].deep', 'changed', (key % 7)::VARCHAR, '"x"' FROM doc WHERE key % 2 = 0
UNION ALL SELECT repo, key, 'geo.more', 'added', NULL, '[1,2]' FROM doc WHERE key % 2 = 0
UNION ALL SELECT repo, key, 'ok', 'removed', 'true', NULL FROM doc WHERE key % 2 = 0""")
def j3(spark, sf):
    old = table(spark, sf, "events").select(F.lit("app").alias("repo"), F.col("event_id").alias("key"), F.col("props").alias("json"))
    k = F.get_json_object("json", "$.k").cast("int")
    new = old.filter("key % 97 <> 0").withColumn(
        "json", F.when(F.col("key") % 10 == 0, F.concat(F.lit('{"k": '), (k + 1).cast("string"), F.lit("}"))).otherwise(F.col("json"))
    )
    nested = docs(spark, sf)
    changed = F.replace(F.regexp_replace("json", r'"deep": \d+', '"deep": "x"'), F.lit(', "ok": true'), F.lit(""))
    changed = F.replace(changed, F.lit('"empty": {}'), F.lit('"empty": {}, "more": [1, 2]'))
    nested_new = nested.withColumn("json", F.when(F.col("key") % 2 == 0, changed).otherwise(F.col("json")))
    return J.json_diff(old.unionByName(nested), new.unionByName(nested_new))


@query("j4_json_canonical", "WITH " + DOC_ROWS + """
SELECT repo, key, '{"geo":{"empty":{},"nation":' || nk || ',"none":null,"tags":["a",{"deep":' || (key % 7) || '}]},"name":"' || n || '","ok":true}' AS canonical FROM doc""")
def j4(spark, sf):
    return docs(spark, sf).select("repo", "key", J.json_canonical("json").alias("canonical"))


@query("a13_convert_dataset", """
SELECT n_nationkey::VARCHAR AS n_nationkey, n_name, n_regionkey::VARCHAR AS n_regionkey, 'a "quoted", ' || n_name AS note FROM nation""")
def a13(spark, sf):
    """nation -> CSV -> JSON -> CSV, read back; cells come out as text."""
    base = scratch_path(spark, "convert")
    nation = table(spark, sf, "nation").withColumn("note", F.concat(F.lit('a "quoted", '), "n_name"))
    convert.write_dataset(nation, f"{base}/1", "csv")
    convert.convert_dataset(spark, f"{base}/1", "csv", f"{base}/2", "json")
    convert.convert_dataset(spark, f"{base}/2", "json", f"{base}/3", "csv")
    return convert.read_dataset(spark, f"{base}/3", "csv")
