"""Registered queries of the corpus operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from codeatlas.functions import languages as L
from codeatlas.operators import corpus_stats as B
from codeatlas.plans import adapters as A
from codeatlas.plans.registry import query, table
from codeatlas.session import scratch_path
from codeatlas.sources import corpus as S

WITH = "WITH " + A.FILES_SQL
LINES = WITH + r""",
parts AS (SELECT *, string_split(content, chr(10)) AS p FROM files),
lines AS (SELECT repo, path, language, CAST(unnest(range(1, len(p) + 1)) AS INTEGER) AS line, unnest(p) AS text FROM parts)
"""
TRIM = "' ' || chr(9) || chr(13) || chr(10) || chr(11) || chr(12) || chr(160) || chr(65279)"
MARKER_WORDS = "license|token|password|secret"


def lines_of(spark, sf):
    return S.explode_lines(A.files(spark, sf), "content", ["repo", "path", "language"])


@query("a1_corpus_files", WITH + "SELECT repo, path, language, size, md5(content) AS digest FROM files")
def a1(spark, sf):
    return A.files(spark, sf).select("repo", "path", "language", "size", F.md5("content").alias("digest"))


FILES_A_FOLDER = 5000


def _partition(key):
    """A directory's name as Spark's writers make it from a value."""
    escaped = F.transform(F.split(F.col(key).cast("string"), ""), lambda c: F.when(
        c.rlike(r"""[\x01-\x1f\x7f"#%'*/:=?\\{\[\]^]"""), F.concat(F.lit("%"), F.lpad(F.hex(c), 2, "0"))).otherwise(c))
    return F.concat(F.lit(f"{key}="), F.coalesce(F.nullif(F.array_join(escaped, ""), F.lit("")), F.lit("__HIVE_DEFAULT_PARTITION__")))


@query("a1_read_corpus", "SELECT source AS repo, doc_id, octet_length(encode(text)) + 1 AS size, sha256(text || chr(10)) AS digest FROM documents")
def a1_read(spark, sf):
    """The documents written as a tree of files, one each below its source, and read as a corpus."""
    root = scratch_path(spark, "corpus")
    docs = table(spark, sf, "documents").select("text", F.col("source").alias("repo"), F.col("doc_id").alias("doc"))
    if shared := S.mounted(spark, root):
        folder = F.pmod(F.xxhash64("doc"), F.lit(docs.count() // FILES_A_FOLDER + 1)).cast("string")
        path = F.concat_ws("/", folder, F.concat(_partition("doc"), F.lit(".txt")))
        S.write_tree(docs.select(_partition("repo").alias("repo"), path.alias("path"), F.col("text").alias("content")), shared)
    else:
        # Dealt out, so that every core writes files; each task moves its own into place, where the driver would do it one by one at the end.
        dealt_out = docs.repartition(spark.sparkContext.defaultParallelism, "repo", "doc")
        dealt_out.write.option("mapreduce.fileoutputcommitter.algorithm.version", "2").partitionBy("repo", "doc").text(root)
    found = S.read_corpus(spark, root, known_only=False)
    number = F.regexp_extract("path", r"(?:^|/)doc=(\d+)(?:/[^/]*)?\.txt$", 1).try_cast("long")
    return found.select(F.substring_index("repo", "=", -1).alias("repo"), number.alias("doc_id"), "size", F.sha2("content", 256).alias("digest"))


@query("a2_prune_paths", WITH + """
SELECT repo, path FROM files WHERE NOT contains(path, 'src7/') AND NOT regexp_matches(path, '^src1[^/]*/fr/.*$')
  AND NOT starts_with(path, 'src2/de') AND size <= 5000""")
def a2(spark, sf):
    kept = S.prune_paths(A.files(spark, sf), globs=["src7/", "src1*/fr/**", "src2/de"], max_bytes=5000)
    return kept.select("repo", "path")


URL_PATH = r"^[a-z]+://[^/]+/([^?#]*)"


@query("a3_with_language", r"""
WITH p AS (SELECT page_id, regexp_extract(url, '^[a-z]+://[^/]+/([^?#]*)', 1) AS path FROM pages),
q AS (SELECT page_id, path || CASE split_part(path, '/', 1) WHEN 'en' THEN '/a.ts' WHEN 'fr' THEN '/b.PY' WHEN 'de' THEN '/Dockerfile' ELSE '/c.txt' END AS path FROM p)
SELECT page_id, path, CASE WHEN path LIKE '%/a.ts' THEN 'typescript' WHEN path LIKE '%/b.PY' THEN 'python'
  WHEN path LIKE '%/Dockerfile' THEN 'docker' END AS language FROM q""")
def a3(spark, sf):
    path = F.regexp_extract("url", URL_PATH, 1)
    top = F.split(path, "/")[0]
    name = F.when(top == "en", "/a.ts").when(top == "fr", "/b.PY").when(top == "de", "/Dockerfile").otherwise("/c.txt")
    pages = table(spark, sf, "pages").select("page_id", F.concat(path, name).alias("path"))
    return L.with_language(pages)


@query("a4_explode_lines", LINES + "SELECT repo, path, line, text FROM lines")
def a4(spark, sf):
    return lines_of(spark, sf).select("repo", "path", "line", "text")


CLASS_SQL = LINES + f""",
t AS (SELECT *, trim(text, {TRIM}) AS x FROM lines),
cls AS (
  SELECT repo, path, language, count(*) AS lines, count(*) FILTER (WHERE x = '') AS blank,
         count(*) FILTER (WHERE x LIKE '//%' OR x LIKE '#%' OR x LIKE '--%') AS comment
  FROM t GROUP BY ALL)
"""


@query("b1_classify_lines", CLASS_SQL + "SELECT repo, path, lines, blank, comment, lines - blank - comment AS code FROM cls")
def b1(spark, sf):
    return B.classify_lines(A.files(spark, sf))


@query("b2_loc_by_language", CLASS_SQL + """,
s AS (
  SELECT repo, CASE WHEN grouping(language) = 1 THEN 'total' ELSE language END AS language, count(*) AS files,
         CAST(sum(lines) AS BIGINT) AS lines, CAST(sum(blank) AS BIGINT) AS blank, CAST(sum(comment) AS BIGINT) AS comment,
         CAST(sum(lines - blank - comment) AS BIGINT) AS code
  FROM cls GROUP BY GROUPING SETS ((repo, language), (repo)))
SELECT s.*, round(s.code * 100.0 / a.code, 1) AS share FROM s JOIN s a ON a.repo = s.repo AND a.language = 'total'""")
def b2(spark, sf):
    return B.loc_by_language(A.files(spark, sf))


@query("b3_largest_files", WITH + """
SELECT repo, path, CAST(len(string_split(content, chr(10))) AS BIGINT) AS lines, size AS bytes FROM files
ORDER BY lines DESC, repo, path LIMIT 10""")
def b3(spark, sf):
    return B.largest_files(A.files(spark, sf))


@query("b4_complexity_hotspots", WITH + r""",
c AS (SELECT repo, path, len(string_split(content, chr(10))) AS lines,
             len(regexp_extract_all(content, '\b(if|else|switch|case|for|while|catch|&&|\|\||\?)\b')) AS branches FROM files)
SELECT repo, path, CAST(branches AS BIGINT) AS branches, CAST(lines AS BIGINT) AS lines, round(branches / lines, 6) AS density
FROM c WHERE lines > 20 AND branches > 5 ORDER BY density DESC, repo, path LIMIT 10""")
def b4(spark, sf):
    return B.complexity_hotspots(A.files(spark, sf))


@query("b5_churn", "WITH " + A.COMMITS_SQL + f"""
SELECT repo, file, count(*) AS commits FROM commits
WHERE ts > TIMESTAMP '{A.AS_OF}' - INTERVAL 14 DAYS AND ts <= TIMESTAMP '{A.AS_OF}'
GROUP BY 1, 2 ORDER BY commits DESC, repo, file LIMIT 10""")
def b5(spark, sf):
    return B.churn(A.commits(spark, sf), A.as_of(), days=14)


@query("b6_search_text", LINES + """
SELECT repo, path, line, text FROM lines WHERE contains(lower(text), 'license') ORDER BY repo, path, line LIMIT 20""")
def b6(spark, sf):
    return B.search_text(A.files(spark, sf), "License", max_total=20)


@query("b6_search_regex", LINES + r""",
m AS (SELECT *, row_number() OVER (PARTITION BY repo, path ORDER BY line) AS r FROM lines WHERE regexp_matches(text, '(^|\s)the [a-z]+ing'))
SELECT repo, path, line, text FROM m WHERE r <= 3""")
def b6_regex(spark, sf):
    return B.search_text(A.files(spark, sf), r"(^|\s)the [a-z]+ing", regex=True, max_per_file=3, max_total=None)


MARK_SQL = LINES + rf""",
marks AS (
  SELECT repo, path, line, upper(regexp_extract(text, '(?i)\b({MARKER_WORDS})\b[:\s-]*(.*)', 1)) AS type,
         trim(regexp_extract(text, '(?i)\b({MARKER_WORDS})\b[:\s-]*(.*)', 2), {TRIM}) AS text
  FROM lines WHERE regexp_matches(text, '(?i)\b({MARKER_WORDS})\b'))
"""


def markers(spark, sf):
    return B.scan_markers(lines_of(spark, sf), pattern=MARKER_WORDS)


@query("b7_scan_markers", MARK_SQL + "SELECT repo, path, line, type, text FROM marks")
def b7(spark, sf):
    return markers(spark, sf)


@query("b8_group_markers", MARK_SQL + """
SELECT repo, type AS "group", path, line, type, text, count(*) OVER (PARTITION BY repo, type) AS count FROM marks""")
def b8(spark, sf):
    return B.group_markers(markers(spark, sf))


BLAME_SQL = """,
latest AS (
  SELECT event_id % (SELECT count(*) FROM documents) AS doc_id, CAST(1 + CAST(json_extract_string(props, '$.k') AS INTEGER) % 10 AS INTEGER) AS line,
         max_by({'author': 'u' || user_id, 'ts': ts}, event_id) AS b
  FROM events GROUP BY 1, 2),
blame AS (SELECT repo, path, line, b.author AS author, b.ts AS ts FROM latest JOIN files USING (doc_id))
"""


def blame(spark, sf):
    """Who last touched each line, told from events spread over the documents."""
    n = table(spark, sf, "documents").agg(F.count("*")).scalar()
    k = F.get_json_object("props", "$.k").cast("int")
    latest = (
        table(spark, sf, "events")
        .groupBy((F.col("event_id") % n).alias("doc_id"), (1 + k % 10).alias("line"))
        .agg(F.max_by(F.struct(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("author"), "ts"), "event_id").alias("b"))
    )
    return latest.join(A.files(spark, sf).select("repo", "path", "doc_id"), "doc_id").select("repo", "path", "line", "b.author", "b.ts")


@query("b9_join_blame", MARK_SQL + BLAME_SQL + f"""
, j AS (SELECT m.*, author, ts, (epoch_us(TIMESTAMP '{A.AS_OF}') - epoch_us(ts)) // 86400000000 AS d
        FROM marks m LEFT JOIN blame USING (repo, path, line))
SELECT repo, path, line, type, text, coalesce(author, 'uncommitted') AS author, ts,
       CASE WHEN ts IS NULL THEN 'new' WHEN d = 0 THEN 'today' WHEN d = 1 THEN '1 day ago' WHEN d < 30 THEN d || ' days ago'
            WHEN d // 30 < 12 THEN (d // 30) || 'mo ago' ELSE (d // 30 // 12) || 'y ago' END AS age FROM j""")
def b9(spark, sf):
    return B.join_blame(markers(spark, sf), blame(spark, sf), A.as_of())


@query("b10_debt_score", WITH + r""",
c AS (
  SELECT repo, CAST(sum(len(regexp_extract_all(content, '(?i)\btoken\b'))) AS BIGINT) AS todo,
         CAST(sum(len(regexp_extract_all(content, '(?i)\blicense\b'))) AS BIGINT) AS fixme,
         CAST(sum(len(regexp_extract_all(content, '(?i)\bemail\b'))) AS BIGINT) AS hack,
         count(*) FILTER (WHERE language = 'es') AS tests
  FROM files GROUP BY repo),
w AS (SELECT 'src' || (user_id % 20) AS repo, count(*) AS cw FROM events WHERE event_type = 'signup' GROUP BY 1),
d AS (SELECT c.*, coalesce(cw, 0) AS cw, todo + 2 * fixme + 3 * hack AS debt FROM c LEFT JOIN w USING (repo))
SELECT repo, todo, fixme, hack, debt, greatest(0, 100 - 2 * debt) AS health,
  CASE WHEN debt = 0 AND tests > 0 THEN 'Immaculate' WHEN debt < 5 AND tests > 0 AND cw > 5 THEN 'Cautiously Optimistic'
       WHEN debt < 15 AND tests > 0 THEN 'Content' WHEN debt < 30 THEN 'Pensive' WHEN debt < 60 THEN 'Nervous Laughter'
       WHEN tests = 0 AND debt > 30 THEN 'This Is Fine' ELSE 'Send Help' END AS mood FROM d""")
def b10(spark, sf):
    week = (
        table(spark, sf, "events").filter("event_type = 'signup'")
        .groupBy(F.concat(F.lit("src"), (F.col("user_id") % 20).cast("string")).alias("repo"))
        .agg(F.count("*").alias("commits_week"))
    )
    return B.debt_score(A.files(spark, sf), week, ("token", "license", "email"), F.col("language") == "es")


@query("b11_repo_summary", WITH + """,
n AS (SELECT *, len(string_split(content, chr(10))) AS n FROM files),
top AS (SELECT repo, path, n, row_number() OVER (PARTITION BY repo ORDER BY n DESC, path) AS r FROM n)
SELECT n.repo, count(*) AS files, CAST(sum(n.n) AS BIGINT) AS lines, CAST(floor(sum(n.n) / count(*) + 0.5) AS BIGINT) AS avg_lines,
  max(split_part(top.path, '/', 3)) AS largest, CAST(max(top.n) AS BIGINT) AS largest_lines,
  string_agg(DISTINCT n.language, ',' ORDER BY n.language) AS languages, false AS has_ci, false AS has_lockfile
FROM n JOIN top ON top.repo = n.repo AND top.r = 1 GROUP BY n.repo""")
def b11(spark, sf):
    return B.repo_summary(A.files(spark, sf))
