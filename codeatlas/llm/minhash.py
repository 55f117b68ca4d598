"""MinHash near-dedup by fast similarity sketching, banding and exact verification."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from codeatlas.llm.base import text_batches
from codeatlas.llm.connected import components
from codeatlas.llm.minhash_kernels import linked_in_block, set_rows, sketch_rows
from codeatlas.llm.textscan import release
from codeatlas.session import cut

BANDS = 45
ROWS = 6
"""45 bands of 6 bins: two sets of similarity 0.8 share no band with probability (1 - 0.8**6)**45 = 1e-6; of 0.3, with 0.97."""
BLOCK = 128
SALTS = 16


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(key, n_shingles, component_id, kept) of every document: which are linked by near copies, directly or over others.

    Sets are the distinct shingles of k words (A-Z in lower case); a text of fewer words is one shingle, no word gives the
    empty set, linked with nothing.  Two documents are linked if 100 * shared >= percent * all shingles of both.  The
    component is named by its least key, which alone is kept.

    1. Every text is sketched; equal sets become one class, so exact copies cost no pairs.
    2. Classes that share a band are candidates.  In each band bucket all are compared with one leader, the class
       that shares most buckets, on whole sets.  That links nearly all of a group of copies, in linear work.
    3. Buckets that still hold several components are joined to clusters.  All that is not in a cluster's largest component
       is compared with all of the cluster, in blocks of `BLOCK` by `BLOCK` sets.  So no candidate pair between different
       components goes unchecked, and nothing is capped.

    Keys are whole numbers.  Null text is an empty set; a null key gets a null component and is not kept; repeated rows share
    their key and component (each is told, `kept` alike); an empty frame gives no rows; other columns are ignored.
    """
    release()  # the driver may have trained a model before
    named = text_batches(docs).select(F.col(f"`{key}`").cast("long").alias("id"), F.col(f"`{text}`").alias("text"))
    sketched = cut(named.mapInArrow(sketch_rows(bands, rows, k), "id long, n long, f1 long, f2 long, bands array<long>"))
    classes = cut(
        sketched.filter("n > 0 AND id IS NOT NULL").groupBy("f1", "f2", "n").agg(F.min("id").alias("rep"), F.first("bands").alias("bands"), F.count(F.lit(1)).alias("copies"))
    )
    buckets = classes.select("rep", F.explode("bands").alias("bucket"))
    shared = buckets.groupBy("bucket").agg(F.count(F.lit(1)).alias("members")).filter("members > 1")
    members = cut(buckets.join(shared, "bucket"))
    roots = _linked(named, members, k, percent)
    copied = classes.filter("copies > 1").select("f1", "f2", "n", "rep", F.explode(F.array(*[F.lit(i) for i in range(SALTS)])).alias("salt"))
    placed = (
        sketched.select("id", "n", "f1", "f2", F.pmod("id", F.lit(SALTS)).cast("int").alias("salt")).join(copied, ["f1", "f2", "n", "salt"], "left")
        .select("id", "n", F.coalesce("rep", "id").alias("node"))
    )
    return placed.join(roots, "node", "left").select(
        F.col("id").alias(key), F.col("n").alias("n_shingles"), F.coalesce("root", "node").alias("component_id"),
        F.coalesce(F.coalesce("root", "node") == F.col("id"), F.lit(False)).alias("kept"),
    )


def drop_near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """`docs` with one document of each group of near copies, that with the least key; of rows that repeat a key one stays, rows with a
    null key all stay."""
    found = cut(near_duplicates(docs, key, text, **options).filter(F.col(key).isNotNull()))
    gone = found.filter("NOT kept").select(key).distinct()
    rest = docs.join(cut(gone), key, "left_anti").select(*docs.columns)
    twice = cut(found.filter("kept").groupBy(key).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(key))
    if twice.isEmpty():
        return rest
    return rest.join(twice, key, "left_anti").select(*docs.columns).unionByName(rest.join(twice, key, "left_semi").select(*docs.columns).dropDuplicates([key]))


def _linked(named: DataFrame, members: DataFrame, k: int, percent: int) -> DataFrame:
    """(node, root) of the classes in shared buckets (rep, bucket, members)."""
    ids = cut(members.groupBy("rep").agg(F.sum("members").alias("weight")))
    sets = cut(
        named.join(ids.select(F.col("rep").alias("id")), "id", "left_semi").mapInArrow(set_rows(k), "id long, shingles array<long>").dropDuplicates(["id"])
    )
    leaders = members.join(ids, "rep").groupBy("bucket").agg(F.max(F.struct("weight", (-F.col("rep")).alias("minus"))).alias("best"))
    led = members.join(leaders.select("bucket", (-F.col("best.minus")).alias("leader")), "bucket")
    stars = led.filter("rep != leader").select("rep", "leader").distinct()
    one = sets.select(F.col("id").alias("rep"), F.col("shingles").alias("s"))
    two = sets.select(F.col("id").alias("leader"), F.col("shingles").alias("t"))
    common = F.size(F.array_intersect("s", "t"))
    compared = stars.join(one, "rep").join(two, "leader").select("rep", "leader", common.alias("c"), (F.size("s") + F.size("t")).alias("both"))
    links = cut(compared.filter(F.lit(100) * F.col("c") >= F.lit(percent) * (F.col("both") - F.col("c"))).select(F.col("rep").alias("a"), F.col("leader").alias("b")))
    first = components(links)

    parted = members.select("bucket", "rep").join(first.select(F.col("node").alias("rep"), "root"), "rep", "left").select("bucket", "rep", F.coalesce("root", "rep").alias("part"))
    open_buckets = parted.groupBy("bucket").agg(F.min("part").alias("low"), F.max("part").alias("high"), F.min("rep").alias("head")).filter("low != high")
    unsettled = cut(parted.join(open_buckets.select("bucket", "head"), "bucket"))
    if unsettled.isEmpty():
        return first
    clusters = components(unsettled.select(F.col("rep").alias("a"), F.col("head").alias("b")))
    inside = cut(unsettled.select("rep", "part").distinct().join(clusters.select(F.col("node").alias("rep"), F.col("root").alias("cluster")), "rep"))
    parts = inside.groupBy("cluster", "part").agg(F.count(F.lit(1)).alias("size"))
    shape = parts.groupBy("cluster").agg(F.max(F.struct("size", "part")).alias("main"), F.sum("size").alias("size")).select(
        "cluster", F.col("main.part").alias("main"),
        F.ceil(F.col("size") / BLOCK).cast("int").alias("blocks"), F.ceil((F.col("size") - F.col("main.size")) / BLOCK).cast("int").alias("chunks"),
    )
    full = inside.join(shape, "cluster").join(sets.withColumnRenamed("id", "rep"), "rep")
    spread = F.xxhash64("rep")
    rows = full.select(
        "cluster", F.pmod(spread, F.col("blocks")).cast("int").alias("block"), F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"),
        F.lit(False).alias("asked"), F.col("rep").alias("id"), "part", "shingles",
    ).unionByName(full.filter("part != main").select(
        "cluster", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.pmod(spread, F.col("chunks")).cast("int").alias("chunk"),
        F.lit(True).alias("asked"), F.col("rep").alias("id"), "part", "shingles",
    ))
    more = rows.groupBy("cluster", "block", "chunk").applyInPandas(linked_in_block(percent), "a long, b long")
    known = inside.select("rep", "part").distinct()
    joined = more.join(known.select(F.col("rep").alias("a"), F.col("part").alias("p")), "a").join(known.select(F.col("rep").alias("b"), F.col("part").alias("q")), "b")
    second = components(joined.select(F.col("p").alias("a"), F.col("q").alias("b")))
    both = first.join(second.select(F.col("node").alias("root"), F.col("root").alias("top")), "root", "left").select("node", F.coalesce("top", "root").alias("root"))
    alone = second.join(first, "node", "left_anti")
    return cut(both.unionByName(alone))
