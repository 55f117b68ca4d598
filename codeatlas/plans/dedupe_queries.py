"""Registered queries of duplicate detection, hashing and secret scanning."""

from __future__ import annotations

from pyspark.sql import functions as F

from codeatlas.operators import dedupe as D, verify as V
from codeatlas.plans import adapters as A
from codeatlas.plans.corpus_queries import LINES
from codeatlas.plans.registry import query, table

WITH = "WITH " + A.FILES_SQL

# Prose has long lines; a line per word gives the windows of source code.  The documents hold no block comments, so
# the SQL only strips line comments.
WORD_FILES = "WITH " + A.FILES_SQL.replace("text AS content", "replace(text, ' ', chr(10)) AS content")
_TOKENS = r""",
stripped AS (
  SELECT repo, path, list_transform(string_split(content, chr(10)), lambda x:
    CASE WHEN contains(split_part(split_part(x, '//', 1), '#', 1), '"') OR contains(split_part(split_part(x, '//', 1), '#', 1), '''')
         THEN split_part(x, '//', 1) ELSE split_part(split_part(x, '//', 1), '#', 1) END) AS ls FROM files),
toks AS (
  SELECT repo, path, flatten(list_transform(ls, lambda x, i:
    list_transform(regexp_extract_all(x, '\w+|[^\s\w]'), lambda t: {'t': t, 'l': i}))) AS tokens FROM stripped),
win AS (
  SELECT repo, path, unnest(list_transform(range(0, len(tokens) - 17, 9), lambda i: list_slice(tokens, i + 1, i + 18))) AS w
  FROM toks WHERE len(tokens) >= 18),
blk AS (
  SELECT repo, path, CAST(w[1].l AS INTEGER) AS start_line, CAST(w[18].l AS INTEGER) AS end_line,
         list_transform(w, lambda x: x.t) AS tokens
  FROM win WHERE w[18].l - w[1].l + 1 >= 6)
"""
TOKENS_SQL, WORD_TOKENS_SQL = WITH + _TOKENS, WORD_FILES + _TOKENS


def word_files(spark, sf):
    """The documents with one word per line."""
    return A.files(spark, sf).withColumn("content", F.replace("content", F.lit(" "), F.lit("\n")))


@query("f1_tokenize", TOKENS_SQL + """
SELECT repo, path, CAST(len(tokens) AS INTEGER) AS tokens, md5(array_to_string(list_transform(tokens, lambda x: x.t), ' ')) AS digest FROM toks""")
def f1(spark, sf):
    toks = D.tokenize(A.files(spark, sf))
    return toks.select("repo", "path", F.size("tokens").alias("tokens"), F.md5(F.array_join("tokens.token", " ")).alias("digest"))


@query("f2_token_windows", WORD_TOKENS_SQL + "SELECT repo, path, start_line, end_line, array_to_string(tokens, ' ') AS tokens FROM blk")
def f2(spark, sf):
    windows = D.token_windows(D.tokenize(word_files(spark, sf)))
    return windows.withColumn("tokens", F.array_join("tokens", " "))


@query("f3_window_hash", WORD_TOKENS_SQL + """
SELECT repo, path, start_line, end_line, md5(array_to_string(tokens, '')) AS hash FROM blk""")
def f3(spark, sf):
    return D.window_hash(D.token_windows(D.tokenize(word_files(spark, sf)))).select("repo", "path", "start_line", "end_line", "hash")


# Plain statement of the rule: every block with a non-overlapping twin, and the partner the operator names.  The
# buckets of these tables hold one spelling each, which `spellings` shows.
PAIRS_SQL = WORD_TOKENS_SQL + """,
b AS (SELECT {'repo': repo, 'file': path, 's': start_line, 'e': end_line} AS spot, md5(array_to_string(tokens, chr(1))) AS h FROM blk),
c AS (SELECT *, min(spot) OVER (PARTITION BY h) AS lo, max(spot) OVER (PARTITION BY h) AS hi FROM b),
p AS (
  SELECT spot AS b, CASE WHEN NOT (lo.file = spot.file AND abs(lo.s - spot.s) < 6) THEN lo
                       WHEN NOT (hi.file = spot.file AND abs(hi.s - spot.s) < 6) THEN hi END AS a FROM c),
q AS (SELECT DISTINCT least(a, b) AS a, greatest(a, b) AS b FROM p WHERE a IS NOT NULL),
pairs AS (
  SELECT a.repo AS repo_a, a.file AS file_a, a.s AS start_a, a.e AS end_a, b.repo AS repo_b, b.file AS file_b, b.s AS start_b,
         b.e AS end_b, CAST(greatest(a.e - a.s, b.e - b.s) + 1 AS INTEGER) AS lines, 1.0::DOUBLE AS similarity FROM q)
"""


@query("f4_duplicate_pairs", PAIRS_SQL + "SELECT * FROM pairs")
def f4(spark, sf):
    return D.duplicate_pairs(word_files(spark, sf), across_repos=True)


SPELLINGS = {"0c": (2, 3), "1a": None, "2b": (0, 1), "3d": (0, 2)}


def spelled_files(spark, sf):
    """Four files a supplier, one token a line, of the same characters: a boundary between two tokens stands elsewhere."""
    k = F.col("s_suppkey").cast("string")
    parts = []
    for name, shift in SPELLINGS.items():
        tokens = [F.concat(F.lit(f"w{i}k"), k, F.lit("e")) for i in range(1, 19)]
        if shift:
            at, n = shift[0], shift[1] - shift[0]
            tokens[at], tokens[at + 1] = F.concat(tokens[at], F.left(tokens[at + 1], F.lit(n))), F.substring(tokens[at + 1], n + 1, 40)
        parts.append(table(spark, sf, "supplier").select(
            F.lit("s").alias("repo"), F.concat(k, F.lit(f"_{name}.txt")).alias("path"), F.concat_ws("\n", *tokens).alias("content")))
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


@query("f4_spelled_pairs", """
SELECT s_suppkey || '_' || x || '.txt' AS file_a, s_suppkey || '_' || y || '.txt' AS file_b, 1 AS start_a, 18 AS end_b, 18 AS lines, 16 / 20.0::DOUBLE AS similarity
FROM supplier, (VALUES ('0c', '1a'), ('1a', '2b'), ('1a', '3d'), ('2b', '3d')) v(x, y)""")
def f4_spelled(spark, sf):
    """Blocks of the same characters cut into other tokens: every two that agree in four of five tokens."""
    return D.duplicate_pairs(spelled_files(spark, sf)).select("file_a", "file_b", "start_a", "end_b", "lines", "similarity")


@query("f5_duplicate_report", PAIRS_SQL + """,
k AS (SELECT *, list_sort([concat_ws(':', repo_a, file_a, start_a // 6), concat_ws(':', repo_b, file_b, start_b // 6)]) AS key FROM pairs),
r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY similarity DESC, lines DESC, repo_a, file_a, start_a, repo_b, file_b, start_b) AS r FROM k)
SELECT * EXCLUDE (key, r) FROM r WHERE r = 1
ORDER BY similarity DESC, lines DESC, repo_a, file_a, start_a, repo_b, file_b, start_b LIMIT 20""")
def f5(spark, sf):
    return D.duplicate_report(D.duplicate_pairs(word_files(spark, sf), across_repos=True))


@query("f6_content_hash", WITH + """
SELECT repo, path, sha256(content) AS sha256, md5(content) AS md5, sha1(content) AS sha1, left(sha256(content), 12) AS short FROM files""")
def f6(spark, sf):
    c = F.col("content")
    return A.files(spark, sf).select(
        "repo", "path", D.content_hash(c).alias("sha256"), D.content_hash(c, "md5").alias("md5"),
        D.content_hash(c, "sha1").alias("sha1"), D.content_hash(c, short=True).alias("short"),
    )


_LANES = ", ".join(f"sum(('0x' || substr(one, {1 + 8 * i}, 8))::BIGINT)::VARCHAR" for i in range(8))


@query("f7_directory_checksum", WITH + f""",
o AS (SELECT repo, repo || '/' || language AS path, size, sha256(concat(path, chr(0), sha256(content))) AS one FROM files)
SELECT repo, path, sha256(concat_ws(',', {_LANES})) AS hash, count(*) AS files, CAST(sum(size) AS BIGINT) AS bytes
FROM o GROUP BY 1, 2""")
def f7(spark, sf):
    return D.directory_checksum(A.files(spark, sf), F.substring_index("path", "/", 2))


@query("f8_check_manifest", WITH + """
SELECT repo, path, CASE WHEN doc_id % 4 = 0 THEN left(sha256(content), 12) WHEN doc_id % 4 = 1 THEN md5(content) ELSE sha256(content) END AS expected,
  CASE WHEN doc_id % 5 <> 3 THEN sha256(content) END AS hash,
  CASE WHEN doc_id % 5 = 3 THEN 'MISS' WHEN doc_id % 4 = 1 THEN 'FAIL' ELSE 'OK' END AS status FROM files""")
def f8(spark, sf):
    files = A.files(spark, sf)
    full = D.content_hash(F.col("content"))
    manifest = files.select(
        "repo", "path",
        F.when(F.col("doc_id") % 4 == 0, D.content_hash(F.col("content"), short=True))
        .when(F.col("doc_id") % 4 == 1, F.md5("content")).otherwise(full).alias("expected"),
    )
    return D.check_manifest(manifest, files.filter("doc_id % 5 <> 3").select("repo", "path", full.alias("hash")))


@query("f9_dirty_set", WITH + """
SELECT repo, path, CASE WHEN language = 'es' THEN 'deleted' ELSE left(sha256(content), 12) END AS hash
FROM files WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1 OR quality = 0)""")
def f9(spark, sf):
    """Toxic documents stand for modified files, poor ones for staged files, and the Spanish ones are gone."""
    files, labels = A.files(spark, sf), table(spark, sf, "labels")
    actual = files.filter("language <> 'es'").select("repo", "path", D.content_hash(F.col("content")).alias("hash"))
    modified = files.join(labels.filter("toxic = 1"), "doc_id", "left_semi")
    staged = files.join(labels.filter("quality = 0"), "doc_id", "left_semi")
    return D.dirty_set(modified, staged, actual, short=True)


_PART_LANES = ", ".join(f"coalesce(sum(('0x' || substr(sha256(part), {1 + 8 * i}, 8))::BIGINT), 0)::VARCHAR" for i in range(8))


@query("f10_profile_fingerprint", WITH + f""",
g AS (SELECT repo, 'en/' || doc_id || '.txt' AS path, language, content FROM files),
parts AS (
  SELECT DISTINCT repo, 'src-file:' || split_part(split_part(path, '/', 2), '/', 1) AS part FROM g WHERE path LIKE 'en/%'
  UNION ALL SELECT repo, path || ':' || sha256(content) FROM g WHERE path IN ('en/1.txt', 'en/2.txt', 'en/3.txt'))
SELECT repo, sha256(concat_ws(',', {_PART_LANES})) AS fingerprint FROM parts GROUP BY repo""")
def f10(spark, sf):
    files = A.files(spark, sf).withColumn("path", F.concat(F.lit("en/"), F.col("doc_id").cast("string"), F.lit(".txt")))
    return D.profile_fingerprint(files, "en", ["en/1.txt", "en/2.txt", "en/3.txt"])


@query("f11_exact_duplicates", WITH + """
SELECT sha256(content) AS hash, count(*) AS copies, min({'repo': repo, 'path': path}).repo AS first_repo,
       min({'repo': repo, 'path': path}).path AS first_path FROM files GROUP BY 1 HAVING count(*) > 1""")
def f11(spark, sf):
    return D.exact_duplicates(A.files(spark, sf))


def _sql_text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


_RULES = " UNION ALL ".join(f"SELECT {_sql_text(n)} AS rule, {_sql_text(('(?i)' if i else '') + p)} AS re" for n, p, i in V.SECRET_RULES)


@query("s1_scan_secrets", LINES + f""",
rules AS ({_RULES}),
hit AS (
  SELECT repo, path, line, rule, text, CASE WHEN length(text) > 80 THEN left(text, 80) || '...' ELSE text END AS excerpt
  FROM lines JOIN rules ON regexp_matches(text, re)),
f AS (SELECT *, row_number() OVER (PARTITION BY repo, rule, text ORDER BY path, line) AS r FROM hit)
SELECT repo, path, line, rule, excerpt FROM f WHERE r = 1""")
def s1(spark, sf):
    return V.scan_secrets(A.files(spark, sf))


@query("s2_forbidden_paths", r"""
WITH p AS (SELECT page_id, url || CASE page_id % 6 WHEN 0 THEN '/.env' WHEN 1 THEN '/credentials.json' WHEN 2 THEN '/.ssh/id_rsa'
           WHEN 3 THEN '/x.env.local' WHEN 4 THEN '/env' ELSE '' END AS path FROM pages)
SELECT page_id, path, reason FROM p, (VALUES ('\.env(?:\.|$)', 'environment file with potential secrets'),
  ('credentials\.\w+$', 'credentials file'), ('(?:^|/)\.ssh/', 'SSH directory'),
  ('id_rsa|id_ed25519|id_ecdsa', 'SSH private key')) r(re, reason) WHERE regexp_matches(path, re)""")
def s2(spark, sf):
    k = F.col("page_id") % 6
    tail = (
        F.when(k == 0, "/.env").when(k == 1, "/credentials.json").when(k == 2, "/.ssh/id_rsa").when(k == 3, "/x.env.local")
        .when(k == 4, "/env").otherwise("")
    )
    return V.forbidden_paths(table(spark, sf, "pages").select("page_id", F.concat("url", tail).alias("path")))


@query("s6_redact_text", WITH + r"""
SELECT repo, path, md5(regexp_replace(content, '(token|secret)\s*=\s*"[^"]*"', '[REDACTED]', 'gi')) AS digest,
       regexp_matches(content, '(?i)(token|secret)\s*=\s*"[^"]*"') AS changed FROM files""")
def s6(spark, sf):
    clean = V.redact_text(F.col("content"), [r'(token|secret)\s*=\s*"[^"]*"'])
    return A.files(spark, sf).select("repo", "path", F.md5(clean).alias("digest"), (clean != F.col("content")).alias("changed"))
