"""Deterministic views of the driver's tables in the library's schemas, in Spark and in SQL.

Each `*_SQL` text is a list of CTEs that DuckDB can run; the function next to it builds the same rows in Spark.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from codeatlas.plans.registry import table

AS_OF = "2024-01-31 00:00:00"


def as_of() -> Column:
    return F.lit(AS_OF).cast("timestamp_ntz")


# ---------------------------------------------------------------- foreign-key graph

FK_SQL = """
fk AS (
  SELECT DISTINCT 'shop' AS repo, src, dst, type FROM (
    SELECT 'nation:' || n_nationkey AS src, 'region:' || n_regionkey AS dst, 'depends-on' AS type FROM nation
    UNION ALL SELECT 'customer:' || c_custkey, 'nation:' || c_nationkey, 'depends-on' FROM customer
    UNION ALL SELECT 'supplier:' || s_suppkey, 'nation:' || s_nationkey, 'depends-on' FROM supplier
    UNION ALL SELECT 'order:' || o_orderkey, 'customer:' || o_custkey, 'depends-on' FROM orders
    UNION ALL SELECT 'order:' || l_orderkey, 'part:' || l_partkey, 'reads' FROM lineitem
    UNION ALL SELECT 'order:' || l_orderkey, 'supplier:' || l_suppkey, 'writes' FROM lineitem)),
fkn AS (
  SELECT 'shop' AS repo, * FROM (
    SELECT 'region:' || r_regionkey AS id, 'schema' AS type, r_name AS name, NULL AS file_path,
           NULL AS language, NULL AS framework FROM region
    UNION ALL SELECT 'nation:' || n_nationkey, 'service', n_name, NULL, NULL, NULL FROM nation
    UNION ALL SELECT 'customer:' || c_custkey, 'file', c_name, lower(c_mktsegment) || '/c' || c_custkey || '.ts',
           CASE WHEN c_custkey % 2 = 0 THEN 'typescript' ELSE 'python' END,
           CASE WHEN c_nationkey % 5 = 0 THEN 'react' END FROM customer
    UNION ALL SELECT 'supplier:' || s_suppkey, 'external', s_name, NULL, NULL, NULL FROM supplier
    UNION ALL SELECT 'order:' || o_orderkey, 'endpoint', o_orderpriority || ' ' || o_orderkey, NULL, NULL,
           CASE WHEN o_orderstatus = 'F' THEN 'express' END FROM orders
    UNION ALL SELECT 'part:' || p_partkey, 'table', p_name, NULL, 'sql', NULL FROM part))
"""


def _id(kind: str, col: str) -> Column:
    return F.concat(F.lit(kind + ":"), F.col(col).cast("string"))


def fk_edges(spark: SparkSession, sf: str) -> DataFrame:
    def part_of(name, src, dst, kind, repeats=False):
        keys = table(spark, sf, name).select(src[1], dst[1])
        # Only the order -> part / supplier edges can repeat, so only they pay for a distinct, on the plain keys.
        keys = keys.distinct() if repeats else keys
        return keys.select(
            F.lit("shop").alias("repo"), _id(*src).alias("src"), _id(*dst).alias("dst"), F.lit(kind).alias("type")
        )

    parts = [
        part_of("nation", ("nation", "n_nationkey"), ("region", "n_regionkey"), "depends-on"),
        part_of("customer", ("customer", "c_custkey"), ("nation", "c_nationkey"), "depends-on"),
        part_of("supplier", ("supplier", "s_suppkey"), ("nation", "s_nationkey"), "depends-on"),
        part_of("orders", ("order", "o_orderkey"), ("customer", "o_custkey"), "depends-on"),
        part_of("lineitem", ("order", "l_orderkey"), ("part", "l_partkey"), "reads", repeats=True),
        part_of("lineitem", ("order", "l_orderkey"), ("supplier", "l_suppkey"), "writes", repeats=True),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def fk_nodes(spark: SparkSession, sf: str) -> DataFrame:
    nothing = F.lit(None).cast("string")

    def part_of(name, key, kind, label, path=nothing, language=nothing, framework=nothing):
        return table(spark, sf, name).select(
            F.lit("shop").alias("repo"), _id(*key).alias("id"), F.lit(kind).alias("type"), label.alias("name"),
            path.alias("file_path"), language.alias("language"), framework.alias("framework"),
        )

    parts = [
        part_of("region", ("region", "r_regionkey"), "schema", F.col("r_name")),
        part_of("nation", ("nation", "n_nationkey"), "service", F.col("n_name")),
        part_of(
            "customer", ("customer", "c_custkey"), "file", F.col("c_name"),
            F.concat(F.lower("c_mktsegment"), F.lit("/c"), F.col("c_custkey").cast("string"), F.lit(".ts")),
            F.when(F.col("c_custkey") % 2 == 0, "typescript").otherwise("python"),
            F.when(F.col("c_nationkey") % 5 == 0, "react"),
        ),
        part_of("supplier", ("supplier", "s_suppkey"), "external", F.col("s_name")),
        part_of(
            "orders", ("order", "o_orderkey"), "endpoint",
            F.concat_ws(" ", "o_orderpriority", F.col("o_orderkey").cast("string")),
            framework=F.when(F.col("o_orderstatus") == "F", "express"),
        ),
        part_of("part", ("part", "p_partkey"), "table", F.col("p_name"), language=F.lit("sql")),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


# ---------------------------------------------------------------- cyclic graph over part keys

MOD_SQL = """
mg AS (
  SELECT DISTINCT 'mod' AS repo, CAST(src AS VARCHAR) AS src, CAST(dst AS VARCHAR) AS dst, 'imports' AS type FROM (
    SELECT p_partkey AS src, (p_partkey * p_partkey + 7) % (SELECT count(*) FROM part) AS dst FROM part
    UNION ALL
    SELECT (p_partkey * p_partkey + 7) % (SELECT count(*) FROM part), p_partkey FROM part WHERE p_partkey % 7 = 0))
"""


def mod_edges(spark: SparkSession, sf: str) -> DataFrame:
    part = table(spark, sf, "part").select("p_partkey")
    n = part.agg(F.count("*")).scalar()
    step = part.select(F.col("p_partkey").alias("a"), ((F.col("p_partkey") * F.col("p_partkey") + 7) % n).alias("b"))
    both = step.select(F.col("a").alias("src"), F.col("b").alias("dst")).unionByName(
        step.filter(F.col("a") % 7 == 0).select(F.col("b").alias("src"), F.col("a").alias("dst"))
    )
    return both.select(
        F.lit("mod").alias("repo"), F.col("src").cast("string").alias("src"), F.col("dst").cast("string").alias("dst"),
        F.lit("imports").alias("type"),
    ).distinct()


# ---------------------------------------------------------------- trace index

TRACE_SQL = """
symbols AS (
  SELECT 'shop' AS repo, p_partkey AS id, 'fn_' || p_partkey AS name,
         CASE p_size % 3 WHEN 0 THEN 'function' WHEN 1 THEN 'method' ELSE 'class' END AS kind,
         p_brand AS file, p_size AS line,
         CASE p_partkey % 4 WHEN 0 THEN 'typescript' WHEN 1 THEN 'java' WHEN 2 THEN 'python' ELSE 'sql' END AS language
  FROM part),
sites AS (
  SELECT *, CASE WHEN l_orderkey % 20 = 0 THEN n + l_suppkey WHEN l_linenumber = 7 THEN xor(l_partkey, 1)
                 ELSE l_partkey // (2 + (l_orderkey + l_suppkey) % 8) END AS callee,
         (l_orderkey * 17 + l_linenumber * 5 + l_partkey) % (3 * n // 5) AS toucher FROM lineitem, (SELECT count(*) AS n FROM part)),
calls AS (
  SELECT 'shop' AS repo, l_orderkey * 10 + l_linenumber AS id, l_partkey AS caller_id, 'fn_' || callee AS callee_name,
         p_brand AS file, l_linenumber AS line, 'order ' || l_orderkey AS arguments,
         CASE WHEN l_partkey % 4 <> callee % 4 THEN 'cross-language' ELSE 'direct' END AS kind
  FROM sites JOIN part ON p_partkey = l_partkey),
columns_ AS (
  SELECT 'shop' AS repo, l_orderkey * 10 + l_linenumber AS id, toucher AS symbol_id, 't' || (l_suppkey % 20) AS table_name,
         'c' || (l_orderkey % 25) AS column_name,
         CASE l_returnflag WHEN 'A' THEN 'INSERT' WHEN 'N' THEN 'SELECT' ELSE 'UPDATE' END AS operation
  FROM sites),
imports AS (
  SELECT DISTINCT 'shop' AS repo, a.p_brand AS file, 'fn_' || callee AS symbol_name, b.p_brand AS source_module
  FROM sites JOIN part a ON a.p_partkey = l_partkey JOIN part b ON b.p_partkey = callee)
"""


def symbols(spark: SparkSession, sf: str) -> DataFrame:
    def pick(col, *names):
        out = F.lit(names[-1])
        for i, name in reversed(list(enumerate(names[:-1]))):
            out = F.when(col == i, name).otherwise(out)
        return out

    return table(spark, sf, "part").select(
        F.lit("shop").alias("repo"), F.col("p_partkey").alias("id"),
        F.concat(F.lit("fn_"), F.col("p_partkey").cast("string")).alias("name"),
        pick(F.col("p_size") % 3, "function", "method", "class").alias("kind"),
        F.col("p_brand").alias("file"), F.col("p_size").alias("line"),
        pick(F.col("p_partkey") % 4, "typescript", "java", "python", "sql").alias("language"),
    )


def _sites(spark: SparkSession, sf: str) -> DataFrame:
    """Every line item is a call site and a touch of a column.

    Parts call parts with a half to a ninth of their number, so a low number is called, through others, by most; pairs of neighbours call
    each other; and one call in twenty leads out of the index.  Three parts in five touch columns, of which there are 500.
    """
    n = table(spark, sf, "part").agg(F.count("*")).scalar()
    part, order = F.col("l_partkey"), F.col("l_orderkey")
    below = F.floor(part / (2 + (order + F.col("l_suppkey")) % 8))
    callee = F.when(order % 20 == 0, n + F.col("l_suppkey")).when(F.col("l_linenumber") == 7, part.bitwiseXOR(F.lit(1).cast("long"))).otherwise(below)
    return table(spark, sf, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_returnflag", callee.alias("callee"),
        ((order * 17 + F.col("l_linenumber") * 5 + part) % F.floor(n * 3 / 5)).alias("toucher"),
    )


def _callee_name() -> Column:
    return F.concat(F.lit("fn_"), F.col("callee").cast("string"))


def _row_id() -> Column:
    return F.col("l_orderkey") * 10 + F.col("l_linenumber")


def calls(spark: SparkSession, sf: str) -> DataFrame:
    brand = table(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand")
    return _sites(spark, sf).join(brand, "l_partkey").select(
        F.lit("shop").alias("repo"), _row_id().alias("id"), F.col("l_partkey").alias("caller_id"),
        _callee_name().alias("callee_name"), F.col("p_brand").alias("file"), F.col("l_linenumber").alias("line"),
        F.concat(F.lit("order "), F.col("l_orderkey").cast("string")).alias("arguments"),
        F.when(F.col("l_partkey") % 4 != F.col("callee") % 4, "cross-language").otherwise("direct").alias("kind"),
    )


def columns(spark: SparkSession, sf: str) -> DataFrame:
    return _sites(spark, sf).select(
        F.lit("shop").alias("repo"), _row_id().alias("id"), F.col("toucher").alias("symbol_id"),
        F.concat(F.lit("t"), (F.col("l_suppkey") % 20).cast("string")).alias("table_name"),
        F.concat(F.lit("c"), (F.col("l_orderkey") % 25).cast("string")).alias("column_name"),
        F.when(F.col("l_returnflag") == "A", "INSERT").when(F.col("l_returnflag") == "N", "SELECT")
        .otherwise("UPDATE").alias("operation"),
    )


def imports(spark: SparkSession, sf: str) -> DataFrame:
    part = table(spark, sf, "part")
    a = part.select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("file"))
    b = part.select(F.col("p_partkey").alias("callee"), F.col("p_brand").alias("source_module"))
    return _sites(spark, sf).join(a, "l_partkey").join(b, "callee").select(
        F.lit("shop").alias("repo"), "file", _callee_name().alias("symbol_name"), "source_module"
    ).distinct()


# ---------------------------------------------------------------- files, commits, messages, requests

FILES_SQL = """
files AS (
  SELECT source AS repo, doc_id, source || '/' || lang || '/' || doc_id || '.txt' AS path, lang AS language,
         n_chars AS size, text AS content FROM documents)
"""


def files(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select(
        F.col("source").alias("repo"), "doc_id",
        F.concat_ws("/", "source", "lang", F.concat(F.col("doc_id").cast("string"), F.lit(".txt"))).alias("path"),
        F.col("lang").alias("language"), F.col("n_chars").alias("size"), F.col("text").alias("content"),
    )


LINES_SQL = FILES_SQL.rstrip() + """,
lines AS (
  SELECT repo, path, language, CAST(u.i AS INTEGER) AS line, u.t AS text
  FROM (SELECT repo, path, language, unnest(list_zip(range(1, len(p) + 1), p)) AS z
        FROM (SELECT *, string_split(content, chr(10)) AS p FROM files)) f,
       LATERAL (SELECT f.z[1] AS i, f.z[2] AS t) u)
"""

COMMITS_SQL = """
commits AS (
  SELECT 'r' || (user_id % 5) AS repo, CAST(event_id AS VARCHAR) AS hash, 'u' || user_id AS author, ts,
         event_type AS subject, event_type || '/' || json_extract_string(props, '$.k') AS file FROM events)
"""


def commits(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select(
        F.concat(F.lit("r"), (F.col("user_id") % 5).cast("string")).alias("repo"),
        F.col("event_id").cast("string").alias("hash"),
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("author"), "ts",
        F.col("event_type").alias("subject"),
        F.concat_ws("/", "event_type", F.get_json_object("props", "$.k")).alias("file"),
    )


MESSAGES_SQL = """
messages AS (
  SELECT 'chat' AS repo, conv_id AS session_id, CAST(turn AS INTEGER) AS turn, role, text,
         TIMESTAMP '2024-01-01' + to_seconds(conv_id * 3600 + turn * 60) AS ts FROM conversations)
"""


def messages(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "conversations").select(
        F.lit("chat").alias("repo"), F.col("conv_id").alias("session_id"), F.col("turn").cast("int").alias("turn"),
        "role", "text",
        F.timestamp_add("SECOND", F.col("conv_id") * 3600 + F.col("turn") * 60, F.lit("2024-01-01").cast("timestamp_ntz")).alias("ts"),
    )


REQUESTS_SQL = """
requests AS (
  SELECT 'u' || (user_id % 5) AS repo, event_id AS id, user_id || ':' || event_type AS key, ts AS created_at,
         props AS text FROM events)
"""


def requests(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select(
        F.concat(F.lit("u"), (F.col("user_id") % 5).cast("string")).alias("repo"), F.col("event_id").alias("id"),
        F.concat_ws(":", F.col("user_id").cast("string"), "event_type").alias("key"), F.col("ts").alias("created_at"),
        F.col("props").alias("text"),
    )
