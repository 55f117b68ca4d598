"""Benchmark decontamination: size-partitioned MinHash containment search, verified by exact shingle containment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from codeatlas.llm.base import once, word_list
from codeatlas.session import cut

SHINGLE = 5
PERCENT = 80
BROADCAST_ROWS = 200_000
"""Signature rows (24 bytes each, so 5 MB) up to which they are sent to every executor."""
SALTS = 8


def _shingles(words: Column, k: int, make) -> Column:
    """One value for each run of k words, of which there must be one."""
    return F.transform(F.sequence(F.lit(0), F.size(words) - k), lambda i: make(*[F.get(words, i + j) for j in range(k)]))


def _hash(*words: Column) -> Column:
    return F.xxhash64(*words)


def _pair(*words: Column) -> Column:
    return F.struct(F.xxhash64(F.lit(1), *words).alias("h1"), F.xxhash64(F.lit(2), *words).alias("h2"))


def _hashed(words: Column) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w))


def _need(n: Column, percent: int) -> Column:
    """Fewest of n shingles that are `percent` of them."""
    return F.ceil(n * percent / F.lit(100)).cast("long")


def contained_items(
    docs: DataFrame, items: DataFrame, key: str = "doc_id", item_key: str = "item_id", text: str = "text", k: int = SHINGLE, percent: int = PERCENT
) -> DataFrame:
    """(key, item_key, n_shared, n_item) of each document that has at least `percent` of an item's distinct shingles of
    `k` words (A-Z in lower case).

    Search.  Documents are partitioned by size (powers of two of their number of shingles).  An item of q shingles has
    as MinHash signature the q - need + 1 lowest of its shingles' hashes: a document that has `need` of the q shingles has one of
    those at least, so no link can be lost.  For each size partition the items small enough to be contained there set
    a ceiling, the largest hash of their signatures, and a document's signature is its hashes up to its partition's ceiling.
    Documents and items whose signatures share a hash and whose sizes allow containment are candidates.
    Check.  The candidates' shingles, as 128-bit digests, are counted exactly.

    Items and documents with fewer than k words (or null text) have no shingle and no link; rows with null keys have none
    either; repeated rows of a document or item count as one; documents and items may be empty tables; other columns
    are ignored.

    Signatures go to all executors only while they are at most `BROADCAST_ROWS` rows; past that both sides are shuffled by
    hash and salt, since one passage may be in a third of all documents.
    """
    texts = docs.select(F.col(f"`{key}`").alias("_doc"), F.col(f"`{text}`").alias("_text")).filter("_doc IS NOT NULL AND _text IS NOT NULL")
    wanted = items.select(F.col(f"`{item_key}`").alias("_item"), F.col(f"`{text}`").alias("_text")).filter("_item IS NOT NULL AND _text IS NOT NULL")

    item_words = wanted.select("_item", once(word_list(F.col("_text"), lower=True)).alias("_w")).filter(F.size("_w") >= k)
    item_hashed = item_words.select("_item", "_w", once(_hashed(F.col("_w"))).alias("_v"))
    parts = F.arrays_zip(_shingles(F.col("_v"), k, _hash).alias("h"), _shingles(F.col("_w"), k, _pair).alias("p"))
    item_sets = cut(item_hashed.select("_item", F.explode(parts).alias("s")).select("_item", "s.h", "s.p.h1", "s.p.h2").distinct())
    sizes = item_sets.groupBy("_item").agg(F.count(F.lit(1)).alias("n_item"), F.sort_array(F.collect_set("h")).alias("_hashes"))
    signed = sizes.withColumn("need", _need(F.col("n_item"), percent)).withColumn("_kept", F.slice("_hashes", F.lit(1), (F.col("n_item") - F.col("need") + 1).cast("int")))
    signatures = cut(signed.select("_item", "need", F.explode("_kept").alias("h")))
    n_signatures = signatures.count()

    # A partition's ceiling: the largest hash of any signature whose item can be contained there; at most 32 rows.
    smallest = F.floor(F.log2(F.col("need"))).cast("int")
    ceilings = (
        signatures.groupBy(smallest.alias("_least")).agg(F.max("h").alias("_top"))
        .select(F.explode(F.sequence(F.col("_least"), F.lit(31))).alias("_class"), "_top").groupBy("_class").agg(F.max("_top").alias("_ceiling"))
    )

    worded = texts.select("_doc", once(word_list(F.col("_text"), lower=True)).alias("_w")).filter(F.size("_w") >= k)
    hashed = worded.select("_doc", once(_hashed(F.col("_w"))).alias("_v")).withColumn("_n", F.size("_v") - (k - 1))
    classed = hashed.withColumn("_class", F.floor(F.log2(F.col("_n"))).cast("int")).join(F.broadcast(ceilings), "_class")
    hashes = classed.select("_doc", "_n", "_ceiling", F.explode(_shingles(F.col("_v"), k, _hash)).alias("h")).filter(F.col("h") <= F.col("_ceiling")).select("_doc", "_n", "h")
    if n_signatures <= BROADCAST_ROWS:
        met = hashes.join(F.broadcast(signatures), "h")
    else:
        salted = signatures.withColumn("_salt", F.explode(F.array(*[F.lit(i) for i in range(SALTS)])))
        met = hashes.withColumn("_salt", F.pmod(F.xxhash64("_doc"), F.lit(SALTS)).cast("int")).join(salted, ["h", "_salt"])
    candidates = cut(met.filter(F.col("_n") >= F.col("need")).select("_doc", "_item").distinct())

    chosen = cut(candidates.select("_doc").distinct())
    found = texts.join(chosen, "_doc", "left_semi").select("_doc", once(word_list(F.col("_text"), lower=True)).alias("_w")).filter(F.size("_w") >= k)
    parts = found.select("_doc", F.explode(_shingles(F.col("_w"), k, _pair)).alias("p")).select("_doc", "p.h1", "p.h2").distinct()
    asked = candidates.join(item_sets.select("_item", "h1", "h2"), "_item")
    shared = asked.join(parts, ["_doc", "h1", "h2"]).groupBy("_doc", "_item").agg(F.count(F.lit(1)).alias("n_shared"))
    return (
        shared.join(signed.select("_item", "n_item", "need"), "_item").filter("n_shared >= need")
        .select(F.col("_doc").alias(key), F.col("_item").alias(item_key), "n_shared", "n_item")
    )


def decontaminate(docs: DataFrame, items: DataFrame, key: str = "doc_id", **options) -> DataFrame:
    """`docs` without the documents that contain an item; rows with null keys stay."""
    bad = contained_items(docs, items, key, **options).select(key).distinct()
    return docs.join(cut(bad), key, "left_anti").select(*docs.columns)
