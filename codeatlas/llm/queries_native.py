"""Queries of the URL filter, line dedup, mixing and decontamination operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from codeatlas.llm.decontamination import contained_items
from codeatlas.llm.line_dedup import MIN_PAGES, RATIO, drop_site_lines
from codeatlas.llm.mixing import SEED, systematic_copies
from codeatlas.llm.registry import query, table
from codeatlas.llm.url_filters import temporal_list_join, url_host, url_path

WORD_SQL = r"list_filter(string_split_regex({}, '[\x20\x09-\x0D]+'), lambda w: w <> '')"

# ---------------------------------------------------------------- 3 URL filters


def _number(text: Column) -> Column:
    return F.conv(F.substring(F.md5(text), 1, 6), 16, 10).cast("int")


def _day(n: Column) -> Column:
    return F.timestamp_add("DAY", n, F.lit("2024-01-01 00:00:00").cast("timestamp"))


def captures_of(pages: DataFrame) -> DataFrame:
    """Pages with a fetch time told by their address."""
    n = _number(F.col("url"))
    return pages.select("page_id", "url", F.timestamp_add("SECOND", (n % 86400).cast("int"), _day(n % 366)).alias("fetched"))


def entries_of(pages: DataFrame) -> DataFrame:
    """A dated block list of hosts and domains and an allow list of directories, told by the addresses of the pages."""
    places = pages.select(url_host(F.col("url")).alias("host"), F.regexp_extract(url_path(F.col("url")), r"^/([^/]+)", 1).alias("top")).filter("host != ''")
    hosts = places.select("host").distinct().withColumn("n", _number(F.col("host")))
    domains = hosts.select(F.regexp_extract("host", r"([^.]+\.[^.]+)$", 1).alias("host")).filter("host != ''").distinct().withColumn("n", _number(F.col("host")))
    tops = places.filter("top != ''").select(F.concat_ws("/", "host", "top").alias("host")).distinct().withColumn("n", _number(F.col("host")))

    def part(df, name, verdict, kind, action, day):
        return df.select(F.lit(name).alias("list"), F.lit(verdict).alias("verdict"), F.lit(kind).alias("kind"), F.col("host").alias("pattern"), F.lit(action).alias("action"), _day(day).alias("at"))

    some = hosts.filter("n % 3 = 0")
    n = F.col("n")
    return (
        part(some, "spam", "block", "host", "add", n % 200).unionByName(part(some, "spam", "block", "host", "remove", n % 200 + 60))
        .unionByName(part(some, "spam", "block", "host", "add", n % 200 + 120)).unionByName(part(domains.filter("n % 2 = 0"), "malware", "block", "domain", "add", n % 300))
        .unionByName(part(tops.filter("n % 4 = 0"), "trusted", "allow", "prefix", "add", n % 250)).unionByName(part(tops.filter("n % 8 = 0"), "trusted", "allow", "prefix", "remove", n % 250 + 90))
    )


OP3_SQL = r"""
WITH c AS (
  SELECT page_id, url, ('0x' || substr(md5(url), 1, 6))::INT AS n FROM pages),
cap AS (
  SELECT row_number() OVER () AS rid, page_id, url,
         TIMESTAMP '2024-01-01 00:00:00' + to_days((n % 366)::INT) + to_seconds(n % 86400) AS fetched,
         lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1)) AS host,
         regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^?#]*)', 1) AS path
  FROM c),
tops AS (SELECT DISTINCT host || '/' || regexp_extract(path, '^/([^/]+)', 1) AS host FROM cap WHERE host <> '' AND regexp_extract(path, '^/([^/]+)', 1) <> ''),
hosts AS (SELECT DISTINCT host FROM cap WHERE host <> ''),
domains AS (SELECT DISTINCT regexp_extract(host, '([^.]+\.[^.]+)$', 1) AS host FROM hosts WHERE regexp_extract(host, '([^.]+\.[^.]+)$', 1) <> ''),
num AS (
  SELECT 'host' AS kind, host, ('0x' || substr(md5(host), 1, 6))::INT AS n FROM hosts
  UNION ALL SELECT 'domain', host, ('0x' || substr(md5(host), 1, 6))::INT FROM domains
  UNION ALL SELECT 'prefix', host, ('0x' || substr(md5(host), 1, 6))::INT FROM tops),
ent AS (
  SELECT 'block' AS verdict, kind, host, 'add' AS action, n % 200 AS day FROM num WHERE kind = 'host' AND n % 3 = 0
  UNION ALL SELECT 'block', kind, host, 'remove', n % 200 + 60 FROM num WHERE kind = 'host' AND n % 3 = 0
  UNION ALL SELECT 'block', kind, host, 'add', n % 200 + 120 FROM num WHERE kind = 'host' AND n % 3 = 0
  UNION ALL SELECT 'block', kind, host, 'add', n % 300 FROM num WHERE kind = 'domain' AND n % 2 = 0
  UNION ALL SELECT 'allow', kind, host, 'add', n % 250 FROM num WHERE kind = 'prefix' AND n % 4 = 0
  UNION ALL SELECT 'allow', kind, host, 'remove', n % 250 + 90 FROM num WHERE kind = 'prefix' AND n % 8 = 0),
iv AS (
  SELECT verdict, kind, host, action, TIMESTAMP '2024-01-01 00:00:00' + to_days(day::INT) AS a,
         lead(TIMESTAMP '2024-01-01 00:00:00' + to_days(day::INT)) OVER (PARTITION BY verdict, kind, host ORDER BY day) AS b FROM ent),
hit AS (
  SELECT rid, count(*) FILTER (verdict = 'block') AS nb, count(*) FILTER (verdict = 'allow') AS na
  FROM cap JOIN iv ON action = 'add' AND fetched >= a AND (b IS NULL OR fetched < b)
   AND ((kind = 'host' AND cap.host = iv.host) OR (kind = 'domain' AND (cap.host = iv.host OR ends_with(cap.host, '.' || iv.host)))
        OR (kind = 'prefix' AND starts_with(cap.host || path || '/', iv.host || '/')))
  GROUP BY rid)
SELECT page_id, url, fetched, coalesce(nb, 0) AS n_block, coalesce(na, 0) AS n_allow,
       CASE WHEN na > 0 THEN 'allow' WHEN nb > 0 THEN 'block' ELSE 'none' END AS verdict
FROM cap LEFT JOIN hit USING (rid)
"""


@query("op3_url_filters", OP3_SQL)
def op3_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page judged by the list entries that were active when it was fetched."""
    pages = table(spark, sf_dir, "pages")
    joined = temporal_list_join(captures_of(pages), entries_of(pages))
    return joined.withColumn("fetched", F.col("fetched").cast("timestamp_ntz"))


# ---------------------------------------------------------------- 6 line dedup

OP6_SQL = rf"""
WITH l AS (
  SELECT doc_id, source, pos, line, trim(line, chr(32) || chr(9) || chr(11) || chr(12) || chr(13)) AS t
  FROM (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents)),
total AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
seen AS (SELECT source, t, count(*) AS k FROM (SELECT DISTINCT doc_id, source, t FROM l WHERE t <> '') GROUP BY source, t),
often AS (SELECT source, t FROM seen JOIN total USING (source) WHERE k >= {MIN_PAGES} AND k > {RATIO} * n),
kinds AS (SELECT doc_id, source, min(substr(md5(t), 1, 15)) AS a, min(substr(md5(t), 17, 15)) AS b FROM l WHERE t <> '' GROUP BY doc_id, source),
host AS (SELECT source, count(DISTINCT a) AS host_a, count(DISTINCT b) AS host_b FROM kinds GROUP BY source),
line AS (
  SELECT source, t, count(DISTINCT a) AS a, count(DISTINCT b) AS b
  FROM (SELECT DISTINCT doc_id, source, t FROM l) JOIN often USING (source, t) JOIN kinds USING (doc_id, source) GROUP BY source, t),
common AS (
  SELECT source, t FROM line JOIN host USING (source)
  WHERE (a >= {MIN_PAGES} AND a > {RATIO} * host_a) OR (b >= {MIN_PAGES} AND b > {RATIO} * host_b)),
marked AS (SELECT l.*, c.t IS NOT NULL AS bad FROM l LEFT JOIN common c ON l.source = c.source AND l.t = c.t)
SELECT doc_id, count(*) FILTER (t <> '') AS n_lines, count(*) FILTER (bad) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT bad), '')) AS text_sha256
FROM marked GROUP BY doc_id
"""


@query("op6_line_dedup", OP6_SQL)
def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the lines that are boilerplate of its source."""
    cleaned = drop_site_lines(table(spark, sf_dir, "documents"))
    return cleaned.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("text_sha256"))


# ---------------------------------------------------------------- 7 mixing

OP7_SQL = rf"""
WITH d AS (
  SELECT doc_id, source, len({WORD_SQL.format("coalesce(text, '')")})::BIGINT AS size,
         md5('{SEED}:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT source, source_size, ([3, 1, 2])[((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS w FROM s),
o AS (
  SELECT *, (1.5::DOUBLE * sum(source_size) OVER ()
             - coalesce(2.0::DOUBLE * sum(source_size) OVER (ORDER BY 2.0::DOUBLE * source_size / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / (sum(w) OVER () - coalesce(sum(w) OVER (ORDER BY 2.0::DOUBLE * source_size / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS level
  FROM w),
t AS (SELECT source, source_size, least(2.0::DOUBLE * source_size, max(level) OVER () * w) AS target FROM o),
r AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS rate,
         row_number() OVER (PARTITION BY d.source ORDER BY d.size, d.h, d.doc_id) AS k,
         ('0x' || substr(md5('{SEED}:' || coalesce('=' || d.source, 'null')), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, (size * (floor(u + rate * k) - floor(u + rate * (k - 1))))::BIGINT AS taken FROM r
"""


@query("op7_mixing", OP7_SQL)
def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of every document."""
    taken = systematic_copies(table(spark, sf_dir, "documents"))
    return taken.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


# ---------------------------------------------------------------- 10 benchmark decontamination

_FIVE = "list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')))"
_ASCII_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
OP10_SQL = rf"""
WITH dw AS (SELECT doc_id, {WORD_SQL.format(_ASCII_LOWER)} AS w FROM documents WHERE text IS NOT NULL),
iw AS (SELECT item_id, {WORD_SQL.format(_ASCII_LOWER)} AS w FROM benchmark WHERE text IS NOT NULL),
ds AS (SELECT doc_id, unnest({_FIVE}) AS s FROM dw WHERE len(w) >= 5),
i AS (SELECT item_id, unnest({_FIVE}) AS s FROM iw WHERE len(w) >= 5),
q AS (SELECT item_id, count(*) AS n FROM i GROUP BY item_id),
hits AS (
  SELECT doc_id, item_id, count(*) AS k, any_value(n) AS n FROM ds JOIN i USING (s) JOIN q USING (item_id)
  GROUP BY doc_id, item_id HAVING 100 * count(*) >= 80 * any_value(n)),
per AS (SELECT doc_id, count(*) AS n_links, string_agg(item_id::VARCHAR, ',' ORDER BY item_id) AS item_ids, max(k::DOUBLE / n) AS containment FROM hits GROUP BY doc_id)
SELECT doc_id, coalesce(n_links, 0) AS n_links, coalesce(item_ids, '') AS item_ids, coalesce(containment, 0) AS containment, n_links IS NULL AS kept
FROM documents LEFT JOIN per USING (doc_id)
"""


@query("op10_decontamination", OP10_SQL)
def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the benchmark items it contains."""
    docs = table(spark, sf_dir, "documents")
    links = contained_items(docs, table(spark, sf_dir, "benchmark"))
    per = links.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("n_links"), F.array_join(F.array_sort(F.collect_list("item_id")).cast("array<string>"), ",").alias("item_ids"),
        F.max(F.col("n_shared") / F.col("n_item")).alias("containment"),
    )
    return docs.select("doc_id").join(per, "doc_id", "left").select(
        "doc_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), F.coalesce("item_ids", F.lit("")).alias("item_ids"),
        F.coalesce("containment", F.lit(0.0)).alias("containment"), F.col("n_links").isNull().alias("kept"),
    )
