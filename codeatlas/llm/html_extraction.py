"""HTML extraction by wrapper induction."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from codeatlas.llm.base import text_batches
from codeatlas.llm.html_kernels import constant_rows, text_rows
from codeatlas.llm.url_filters import url_host
from codeatlas.session import cut

MIN_PAGES = 5
CONSTANT = 0.9
"""A place is template if at least `MIN_PAGES` pages of its host have a text there and this share of them the same one."""
BROADCAST_BYTES = 16 << 20
SALTS = 16


def _with_host(pages: DataFrame, url: str) -> DataFrame:
    return pages.withColumn("host", url_host(F.col(f"`{url}`")))


def _joined(pages: DataFrame, table: DataFrame, small: bool) -> DataFrame:
    """`pages` with their host's row: sent to all executors if it is small, else both shuffled by host and salt."""
    if small:
        return pages.join(F.broadcast(table), "host", "left")
    salted = table.withColumn("_salt", F.explode(F.array(*[F.lit(i) for i in range(SALTS)])))
    return pages.withColumn("_salt", F.pmod(F.xxhash64("html"), F.lit(SALTS)).cast("int")).join(salted, ["host", "_salt"], "left").drop("_salt")


def references(pages: DataFrame) -> DataFrame:
    """(host, reference): of each host one page, that with the least hash, as every page is aligned with the same one."""
    marked = pages.filter("html IS NOT NULL").select("host", "html", F.xxhash64("html").alias("_h"))
    least = cut(marked.groupBy("host").agg(F.min("_h").alias("_h")))  # its true size decides how pages meet it
    return cut(marked.join(least, ["host", "_h"]).groupBy("host").agg(F.min("html").alias("reference")))


def extract_main_text(pages: DataFrame, key: str = "page_id", url: str = "url", markup: str = "html") -> DataFrame:
    """(key, url, text, n_chars) of every page: its main text from the whole markup, and the code points of that.

    Wrapper induction: the tree of each page of a host (neighbouring children of equal structure taken as one place) is aligned with
    that of the host's reference page by simple tree matching.  A place whose text is the same on nearly all pages of the host
    that differ at all is template, one whose text varies a slot.  Main text are the slots inside the `article` (else `main`, else
    the page) and outside side parts: navigation, headers, footers, asides, forms, dialogs, and elements whose class, id or
    role names an advert, menu, sidebar, notice, share bar or comments.  References are decoded, white space in a block becomes
    one space, blocks are joined by one space.

    Null markup has empty text; pages without a readable URL are one host; a host with few pages has no template; a page that is
    template all over keeps its text; repeated rows are pages of their own; empty frames give no rows; other columns are ignored.

    Counts are summed in the tasks before they are shuffled.  References are sent to all executors only up to
    `BROADCAST_BYTES`; past that hosts are joined in `SALTS` parts each, so a host may have any share of the pages.
    """
    hosted = _with_host(text_batches(pages).select(F.col(f"`{key}`").alias("_key"), F.col(f"`{url}`").alias("_url"), F.col(f"`{markup}`").alias("html")), "_url")
    known = references(hosted)
    size = known.agg(F.sum(F.octet_length("reference") + F.octet_length("host"))).first()[0] or 0
    small = size <= BROADCAST_BYTES
    counts = _joined(hosted.select("host", "html"), known, small).mapInPandas(constant_rows, "host string, place int, seen long, same long")
    places = counts.groupBy("host", "place").agg(F.sum("seen").alias("seen"), F.sum("same").alias("same"))
    constant = places.filter((F.col("seen") >= MIN_PAGES) & (F.col("same") >= CONSTANT * F.col("seen"))).groupBy("host").agg(F.collect_list("place").alias("constant"))
    wrappers = cut(known.join(constant, "host", "left"))
    texts = _joined(hosted, wrappers, small).select("_key", "_url", "html", "reference", "constant").mapInPandas(
        text_rows, f"_key {dict(hosted.dtypes)['_key']}, _url string, text string"
    )
    return texts.select(F.col("_key").alias(key), F.col("_url").alias(url), "text", F.char_length("text").cast("long").alias("n_chars"))
