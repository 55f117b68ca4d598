"""Registered queries of incremental and continuous indexing."""

from __future__ import annotations

from pyspark.sql import functions as F

from codeatlas.operators import corpus_stats as B
from codeatlas.plans import adapters as A
from codeatlas.plans.corpus_queries import LINES, MARKER_WORDS, TRIM
from codeatlas.plans.registry import query, table
from codeatlas.session import scratch_path
from codeatlas.sources import corpus as S, index_store as I
from codeatlas.streaming import index_stream as T

WITH = "WITH " + A.FILES_SQL


def snapshots(spark, sf):
    """Two states of the corpus: before, and now with new and touched files."""
    files = A.files(spark, sf)
    now = files.withColumn("mtime_ms", F.when(F.col("doc_id") % 10 == 1, 2).otherwise(1).cast("long"))
    before = files.filter("doc_id % 5 <> 0").withColumn("mtime_ms", F.lit(1).cast("long"))
    return before, now


def line_counts(run):
    def extract(files):
        return {"sizes": files.select("repo", F.col("path").alias("file"), B.line_count("content").alias("lines"), F.lit(run).alias("run"))}

    return extract


@query("a5_incremental_index", WITH + """
SELECT repo, path AS file, CAST(len(string_split(content, chr(10))) AS BIGINT) AS lines,
  CASE WHEN doc_id % 5 = 0 OR doc_id % 10 = 1 THEN 2 ELSE 1 END AS run FROM files""")
def a5(spark, sf):
    before, now = snapshots(spark, sf)
    index = {"files": before.select("repo", "path", "mtime_ms"), **line_counts(1)(before)}
    return I.incremental_index(now, index, line_counts(2))["sizes"]


@query("a5_index_files", WITH + "SELECT repo, path, CASE WHEN doc_id % 10 = 1 THEN 2 ELSE 1 END::BIGINT AS mtime_ms FROM files")
def a5_files(spark, sf):
    before, now = snapshots(spark, sf)
    index = {"files": before.select("repo", "path", "mtime_ms"), **line_counts(1)(before)}
    return I.incremental_index(now, index, line_counts(2))["files"]


GRAPH_SQL = """
WITH n AS (SELECT count(*) AS n FROM documents),
d AS (SELECT doc_id AS k, doc_id % 5 = 0 OR doc_id % 10 = 1 AS changed FROM documents),
old_nodes AS (
  SELECT k, 'd' || k AS id, 'd' || k AS file_path FROM d WHERE k % 5 <> 0
  UNION ALL SELECT k, 'gone' || k, 'gone' || k FROM d WHERE k % 50 = 1),
old_edges AS (
  SELECT id AS src, 'd' || ((k * 7 + 3) % n) AS dst, 'imports' AS type FROM old_nodes, n
  UNION ALL SELECT id, 'd' || ((k + 1) % n), 'calls' FROM old_nodes, n
  UNION ALL SELECT 'd' || k, 'gone' || k, 'calls' FROM d WHERE k % 50 = 1),
fresh_edges AS (SELECT 'd' || k AS src, 'd' || ((k * 7 + 3) % n) AS dst, 'imports' AS type FROM d, n WHERE changed),
nodes AS (SELECT 'd' || k AS id, CASE WHEN changed THEN 2 ELSE 1 END AS run FROM d)
"""


def graphs(spark, sf):
    docs = table(spark, sf, "documents")
    n = docs.agg(F.count("*")).scalar()
    k = F.col("k")
    name = lambda prefix, col=k: F.concat(F.lit(prefix), col.cast("string"))
    d = docs.select(F.lit("docs").alias("repo"), F.col("doc_id").alias("k")).withColumn("changed", (k % 5 == 0) | (k % 10 == 1))
    old_nodes = d.filter(k % 5 != 0).select("repo", "k", name("d").alias("id")).unionByName(
        d.filter(k % 50 == 1).select("repo", "k", name("gone").alias("id"))
    ).withColumn("file_path", F.col("id")).withColumn("run", F.lit(1))
    link = lambda df, src, dst, kind: df.select("repo", src.alias("src"), dst.alias("dst"), F.lit(kind).alias("type"))
    old_edges = (
        link(old_nodes, F.col("id"), name("d", (k * 7 + 3) % n), "imports")
        .unionByName(link(old_nodes, F.col("id"), name("d", (k + 1) % n), "calls"))
        .unionByName(link(d.filter(k % 50 == 1), name("d"), name("gone"), "calls"))
    )
    changed = d.filter("changed")
    fresh_nodes = changed.select("repo", name("d").alias("id"), name("d").alias("file_path"), F.lit(2).alias("run"))
    fresh_edges = link(changed, name("d"), name("d", (k * 7 + 3) % n), "imports")
    before = old_nodes.select("repo", F.col("id").alias("path"), F.lit(1).alias("mtime_ms"))
    now = d.select("repo", name("d").alias("path"), F.when(k % 10 == 1, 2).otherwise(1).alias("mtime_ms"))
    return I.incremental_graph(old_nodes.drop("k"), old_edges, before, fresh_nodes, fresh_edges, now)


@query("a6_incremental_graph_nodes", GRAPH_SQL + "SELECT 'docs' AS repo, id, run FROM nodes")
def a6_nodes(spark, sf):
    return graphs(spark, sf)[0].select("repo", "id", "run")


@query("a6_incremental_graph_edges", GRAPH_SQL + """
SELECT 'docs' AS repo, * FROM fresh_edges
UNION ALL SELECT 'docs', o.* FROM old_edges o WHERE src IN (SELECT id FROM nodes) AND dst IN (SELECT id FROM nodes)
  AND NOT EXISTS (SELECT 1 FROM fresh_edges f WHERE f.src = o.src AND f.dst = o.dst AND f.type = o.type)""")
def a6_edges(spark, sf):
    return graphs(spark, sf)[1]


AGES = [2024, 2021, 2020]


@query("a7_stream_index", LINES + rf"""
SELECT repo, path AS file, line, upper(regexp_extract(text, '(?i)\b({MARKER_WORDS})\b[:\s-]*(.*)', 1)) AS type,
  trim(regexp_extract(text, '(?i)\b({MARKER_WORDS})\b[:\s-]*(.*)', 2), {TRIM}) AS text
FROM lines WHERE regexp_matches(text, '(?i)\b({MARKER_WORDS})\b')""")
def a7(spark, sf):
    """The documents as a stream of files that arrive in three batches, each older than the one before; their markers, indexed
    batch by batch and read back."""
    landing, sink = scratch_path(spark, "landing"), scratch_path(spark, "stream")
    files = table(spark, sf, "documents").select(
        F.col("source").alias("repo"),
        F.concat_ws("/", "source", "lang", F.concat(F.col("doc_id").cast("string"), F.lit(".txt"))).alias("path"),
        F.element_at(F.array(*[F.lit(f"{y}-01-01").cast("timestamp") for y in AGES]), (F.col("doc_id") % len(AGES) + 1).cast("int")).alias("mtime"),
        F.col("text").alias("content"),
    )

    def extract(batch):
        lines = S.explode_lines(batch, "content", ["repo", "path"])
        return {"markers": B.scan_markers(lines, pattern=MARKER_WORDS).withColumnRenamed("path", "file")}

    for number, year in enumerate(AGES):
        files.filter(F.year("mtime") == year).write.parquet(f"{landing}/{number}")
        T.stream_index(spark.readStream.schema(files.schema).parquet(f"{landing}/*"), sink, extract).awaitTermination()
    return T.current_index(spark, sink, ["markers"])["markers"]


@query("a8_write_read_index", "WITH " + A.TRACE_SQL + "SELECT repo, id, name, kind, file, line, language FROM symbols")
def a8(spark, sf):
    root = scratch_path(spark, "index")
    I.write_index({"symbols": A.symbols(spark, sf), "calls": A.calls(spark, sf)}, root)
    if I.read_index(spark, root, ["symbols"], version=I.INDEX_VERSION + 1) is not None:
        raise ValueError("an index of another version must not be read")
    return I.read_index(spark, root, ["symbols", "calls"])["symbols"].select("repo", "id", "name", "kind", "file", "line", "language")
