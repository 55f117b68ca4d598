"""Mixing sources to target weights by systematic sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from codeatlas.llm.base import word_list
from codeatlas.session import cut

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MAX_COPIES = 2.0
SEED = "mix-1"
HASH_DIGITS = 3
"""Hexadecimal digits of a hash that part the documents of one source and size into 4096 groups."""


def text_size(text: Column) -> Column:
    """Number of words; 0 for null."""
    return F.size(word_list(text)).cast("long")


def fill_targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, cap: float = MAX_COPIES) -> DataFrame:
    """Adds `target` to (source, source_size): `share` of all sizes dealt out by weight, none above `cap` times its size.

    Weights go to the sources in order of their names, null last, over and over.  Raising one level of words per unit of
    weight fills the sources in order of capacity per weight, so a running sum over the sources gives the level that
    resharing the excess round by round ends at.  The frame has one row per source: a table of settings in size, so its
    windows need no partition.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    pick = F.array(*[F.lit(w) for w in weights])
    weighted = sources.withColumn("_w", F.element_at(pick, (F.row_number().over(by_name) - 1) % len(weights) + 1)).withColumn(
        "_cap", F.lit(cap) * F.col("source_size")
    )
    order = Window.orderBy(F.col("_cap") / F.col("_w"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    level = (F.lit(share) * F.sum("source_size").over(everything) - F.coalesce(F.lit(cap) * F.sum("source_size").over(before), F.lit(0.0))) / (
        F.sum("_w").over(everything) - F.coalesce(F.sum("_w").over(before), F.lit(0))
    )
    return (
        weighted.withColumn("_level", level).withColumn("_level", F.max("_level").over(everything))
        .withColumn("target", F.least(F.col("_cap"), F.col("_level") * F.col("_w"))).drop("_w", "_cap", "_level")
    )


def _offset(source: Column) -> Column:
    """The random offset of a source, in [0, 1)."""
    name = F.md5(F.concat(F.lit(SEED + ":"), F.coalesce(F.concat(F.lit("="), source), F.lit("null"))))
    return F.conv(F.substring(name, 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def systematic_copies(docs: DataFrame, source: str = "source", text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, size, source, source_size, target, copies): how many times the mix takes each document.

    A source's documents stand in order of size (then of a hash of their id), each with the expected copies
    target / source_size.  The running sum of expected copies plus one random offset a source is cut at the integers: a
    document comes once for each integer that its stretch crosses, so copies are the floor or the ceiling of what is
    expected, and the order by size keeps the words taken close to the target.

    Null text has size 0; null is a source of its own; null ids stand first; repeated rows are documents of their own;
    an empty frame gives no rows; sources without any word have target 0 and no copies.

    A rank is the number of documents of the source that are smaller, plus those of the same size whose hash begins with
    less, plus the rank among those that agree in both.  The first two come from counts, whose running sums span the distinct
    sizes of a source and the beginnings of hashes, so a source, or copies of one text, with any share of the rows are
    spread over many tasks.
    """
    sized = cut(docs.select(F.col(f"`{key}`").alias("_key"), F.col(f"`{source}`").alias("source"), text_size(F.col(f"`{text}`")).alias("size")))
    hashed = F.md5(F.concat(F.lit(SEED + ":"), F.coalesce(F.col("_key").cast("string"), F.lit(""))))
    tagged = sized.select("_key", "size", F.col("source").isNull().alias("_null"), F.coalesce("source", F.lit("")).alias("_name"), hashed.alias("_hash"))
    tagged = tagged.withColumn("_bin", F.substring("_hash", 1, HASH_DIGITS))
    own, same = ["_null", "_name"], ["_null", "_name", "size"]
    bins = tagged.groupBy(*same, "_bin").agg(F.count(F.lit(1)).alias("_n"))
    sizes = bins.groupBy(*same).agg(F.sum("_n").alias("_n"))
    smaller = Window.partitionBy(*own).orderBy("size").rowsBetween(Window.unboundedPreceding, -1)
    less = Window.partitionBy(*same).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    sources = sizes.groupBy(*own).agg(F.sum(F.col("size") * F.col("_n")).alias("source_size")).withColumn("source", F.when(~F.col("_null"), F.col("_name")))
    targets = fill_targets(sources).select(*own, "source", "source_size", "target")
    levels = sizes.select(*same, F.coalesce(F.sum("_n").over(smaller), F.lit(0)).alias("_smaller")).join(targets, own)
    steps = bins.select(*same, "_bin", F.coalesce(F.sum("_n").over(less), F.lit(0)).alias("_less")).join(levels, same)
    inside = Window.partitionBy(*same, "_bin").orderBy("_hash", "_key")
    ranked = tagged.withColumn("_row", F.row_number().over(inside)).join(steps, [*same, "_bin"])
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    ranked = ranked.withColumn("_rate", rate).withColumn("_rank", F.col("_smaller") + F.col("_less") + F.col("_row")).withColumn("_offset", _offset(F.col("source")))
    copies = F.floor(F.col("_offset") + F.col("_rate") * F.col("_rank")) - F.floor(F.col("_offset") + F.col("_rate") * (F.col("_rank") - 1))
    return ranked.select(F.col("_key").alias(key), "size", "source", "source_size", "target", copies.cast("long").alias("copies"))


def mix(docs: DataFrame, source: str = "source", text: str = "text", key: str = "doc_id") -> DataFrame:
    """`docs` with each row as often as the mix takes it, and `copy` counting from 1.

    Rows of one key are taken alike; rows with a null key, which can't be told apart, are taken once each.
    """
    copies = systematic_copies(docs, source, text, key).filter(F.col(key).isNotNull()).groupBy(key).agg(F.max("copies").alias("_copies"))
    # The table of copies grows with the documents, so both sides are shuffled at every size.
    joined = docs.drop("copy").join(cut(copies).hint("merge"), key, "left").filter(F.col(key).isNull() | (F.col("_copies") > 0))
    again = F.explode(F.sequence(F.lit(1).cast("long"), F.coalesce("_copies", F.lit(1).cast("long"))))
    return joined.select(*[F.col(f"`{c}`") for c in docs.columns if c != "copy"], again.alias("copy"))
