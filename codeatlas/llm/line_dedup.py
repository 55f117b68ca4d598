"""Line dedup by site-relative frequency: a line found on a large share of a host's pages is boilerplate of that host."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from codeatlas.llm.base import digest, once
from codeatlas.session import cut

RATIO = 0.08
MIN_PAGES = 5
SALTS = 8
TRIMMED = " \t\x0b\x0c\r"


def _lines(text: Column) -> Column:
    """Distinct lines of a text, trimmed, without the blank one."""
    trimmed = F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.btrim(x, F.lit(TRIMMED)))
    return F.array_remove(F.array_distinct(trimmed), "")


def _with_lines_of_host(pages: DataFrame, lines: DataFrame, how: str) -> DataFrame:
    """`pages` (with `host` and `text`) and the array `_marks` of their host's rows of `lines` (host, h1, h2).

    The few lines per host are written as a table so that its true size decides on a broadcast; past that, hosts are joined in
    `SALTS` parts each, so a hot host is no single task.
    """
    marks = cut(
        lines.groupBy("host").agg(F.collect_list(F.struct("h1", "h2")).alias("_marks"))
        .withColumn("_salt", F.explode(F.array(*[F.lit(i) for i in range(SALTS)])))
    )
    return pages.withColumn("_salt", F.pmod(F.xxhash64("text"), F.lit(SALTS)).cast("int")).join(marks, ["host", "_salt"], how).drop("_salt")


def boilerplate_lines(docs: DataFrame, host: str = "source", text: str = "text", ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """(host, h1, h2) of each line that is boilerplate of its host.

    Such a line is on at least `min_pages` pages of the host and on more than `ratio` of them, and these pages aren't copies of
    each other: copied pages share their lines, too.  A page's class is told by the least hash of its lines, which a copy with
    few edits mostly keeps; of two such hashes one must give the line at least `min_pages` classes of pages, and more
    than `ratio` of the host's classes.  Blank lines are no lines, a line counts once a page, pages without host aren't counted.

    Counts are summed before they are shuffled.  Only lines that pass the first test, at most (mean number of lines a page) /
    ratio a host, are counted by class.
    """
    pages = docs.select(F.col(f"`{host}`").alias("host"), F.col(f"`{text}`").alias("text")).filter("host IS NOT NULL")
    totals = pages.groupBy("host").agg(F.count(F.lit(1)).alias("host_pages"))
    lines = pages.select("host", F.explode(_lines(F.col("text"))).alias("line"))
    counts = lines.select("host", *digest(F.col("line"))).groupBy("host", "h1", "h2").agg(F.count(F.lit(1)).alias("pages"))
    common = counts.filter(F.col("pages") >= min_pages).join(totals, "host").filter(F.col("pages") > F.lit(ratio) * F.col("host_pages"))
    met = _with_lines_of_host(pages, common, "inner").select("host", "_marks", once(_lines(F.col("text"))).alias("_l")).filter(F.size("_l") > 0)
    hits = F.array_intersect(F.transform("_l", lambda x: F.struct(*digest(x))), F.col("_marks"))
    nothing = F.lit(None).cast("struct<h1:bigint,h2:bigint>")  # stands for the host itself
    told = met.select("host", F.concat(hits, F.array(nothing)).alias("_hits"), once(F.transform("_l", lambda x: F.md5(x))).alias("_md5"))
    least = [F.array_min(F.transform("_md5", lambda x: F.substring(x, start, 15))) for start in (1, 17)]
    classes = F.array(*[F.struct(F.lit(i).alias("way"), F.conv(m, 16, 10).cast("long").alias("class")) for i, m in enumerate(least)])
    seen = told.select("host", "_hits", F.explode(classes).alias("c")).select("host", "c.way", "c.class", F.explode("_hits").alias("hit"))
    each = seen.select("host", "hit.h1", "hit.h2", "way", "class").distinct().groupBy("host", "h1", "h2", "way").agg(F.count(F.lit(1)).alias("classes"))
    of_host = F.max(F.when(F.col("h1").isNull(), F.col("classes"))).over(Window.partitionBy("host", "way"))  # a host's few common lines
    differing = each.withColumn("_host_classes", of_host).filter(F.col("h1").isNotNull() & (F.col("classes") >= min_pages))
    return differing.filter(F.col("classes") > F.lit(ratio) * F.col("_host_classes")).select("host", "h1", "h2").distinct()


def drop_site_lines(docs: DataFrame, host: str = "source", text: str = "text", ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """`docs` with `text` rid of its host's boilerplate lines, and the long columns `n_lines` and `n_dropped` (blank lines
    count in neither and stay where they are).

    A page of nothing but boilerplate is left without a line.  Copied pages, exact or with few edits, keep theirs: near-duplicate
    removal handles them.  Null text stays null with 0 lines; a page without host and a host with fewer than `min_pages`
    pages lose nothing; repeated rows are pages of their own, copies of each other; empty frames give no rows; other
    columns pass through, whatever their names, but `n_lines` and `n_dropped`, which are replaced.
    """
    keep = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("_row"), F.col(f"`{host}`").alias("host"), F.col(f"`{text}`").alias("text"))
    joined = _with_lines_of_host(rows, boilerplate_lines(docs, host, text, ratio, min_pages), "left").withColumn("_raw", F.split("text", "\n"))
    marked = joined.withColumn(
        "_bad",
        F.when(F.col("_marks").isNull(), F.transform("_raw", lambda x: F.lit(False)))
        .otherwise(F.transform("_raw", lambda x: F.array_contains(F.col("_marks"), F.struct(*digest(F.btrim(x, F.lit(TRIMMED))))))),
    )
    full = F.size(F.filter("_raw", lambda x: F.btrim(x, F.lit(TRIMMED)) != "")).cast("long")
    hits = F.size(F.filter("_bad", lambda b: b)).cast("long")
    counted = marked.withColumn("_full", F.when(F.col("_raw").isNull(), F.lit(0)).otherwise(full)).withColumn("_hits", F.when(F.col("_raw").isNull(), F.lit(0)).otherwise(hits))
    rest = F.array_join(F.filter("_raw", lambda x, i: ~F.element_at("_bad", i + 1)), "\n")
    out = [F.when(F.col("_hits") == 0, F.col("text")).otherwise(rest).alias(c) if c == text else F.col("_row").getField(c).alias(c) for c in keep]
    return counted.select(*out, F.col("_full").cast("long").alias("n_lines"), F.col("_hits").cast("long").alias("n_dropped"))
