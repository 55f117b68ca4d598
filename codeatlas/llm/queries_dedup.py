"""Queries of the near-duplicate and substring operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from codeatlas.llm.minhash import near_duplicates
from codeatlas.llm.registry import query, table
from codeatlas.llm.substring_dedup import drop_repeated_windows

_ASCII_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = r"list_filter(string_split_regex({}, '[\x20\x09-\x0D]+'), lambda w: w <> '')"

# ---------------------------------------------------------------- 1 MinHash near-dedup

OP1_SQL = rf"""
WITH RECURSIVE w AS (SELECT doc_id, {_WORDS.format(_ASCII_LOWER)} AS w FROM documents),
s AS (SELECT doc_id, unnest(CASE WHEN len(w) < 2 THEN w ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END) AS s FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b USING (s) WHERE a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM shared JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 80 * (x.n + y.n - k)),
ends AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, e.b FROM reach r JOIN ends e ON e.a = r.b)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id JOIN (SELECT a, min(b) AS component_id FROM reach GROUP BY a) c ON c.a = d.doc_id
"""


@query("op1_minhash", OP1_SQL)
def op1_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of documents linked by 80 % of their two-word shingles."""
    return near_duplicates(table(spark, sf_dir, "documents"), k=2, percent=80)


# ---------------------------------------------------------------- 8 substring dedup

OP8_SQL = rf"""
WITH d AS (SELECT doc_id, {_WORDS.format("coalesce(text, '')")} AS w FROM documents),
win AS (
  SELECT doc_id, i, array_to_string(w[i:i + 19], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM d WHERE len(w) >= 20)),
later AS (SELECT doc_id, i, row_number() OVER (PARTITION BY s ORDER BY doc_id, i) > 1 AS again FROM win),
word AS (SELECT doc_id, unnest(w) AS w, generate_subscripts(w, 1) AS p FROM d),
mark AS (
  SELECT word.doc_id, p, w, coalesce(max(CASE WHEN again THEN 1 ELSE 0 END) OVER (PARTITION BY word.doc_id ORDER BY p ROWS BETWEEN 19 PRECEDING AND CURRENT ROW), 0) = 1 AS gone
  FROM word LEFT JOIN later ON later.doc_id = word.doc_id AND later.i = word.p),
per AS (SELECT doc_id, count(*) FILTER (gone) AS n_removed, string_agg(w, ' ' ORDER BY p) FILTER (NOT gone) AS rest FROM mark GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(rest, '')) AS kept_sha256 FROM d LEFT JOIN per USING (doc_id)
"""


@query("op8_substring_dedup", OP8_SQL)
def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the words of 20-word runs that start earlier elsewhere."""
    return drop_repeated_windows(table(spark, sf_dir, "documents"), digest=True)
