"""URL filters: a temporal list join of captures with dated list entries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from codeatlas.session import cut

BROADCAST_BYTES = 16 << 20
"""Bytes of the listed patterns up to which they are sent to every executor."""
SALTS = 16


def url_host(url: Column) -> Column:
    """Lower-cased host of a URL, empty where there is none."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def url_path(url: Column) -> Column:
    """Path of a URL without query and fragment, `/` where it is empty."""
    path = F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^?#]*)", 1)
    return F.when(path == "", F.lit("/")).otherwise(path)


def validity_intervals(entries: DataFrame) -> DataFrame:
    """(list, verdict, kind, pattern, valid_from, valid_to) from dated entries (list, verdict, kind, pattern, action, at).

    An `add` holds from its time until the next entry of the same list and pattern, add or remove (null: still valid); a
    `remove` ends what holds.  Of entries at one time the removal comes last; equal entries count as one; entries with a
    null time, pattern or action are ignored.

    The next entry is looked up inside a month, and for a month's last entry in a table with one row per pattern and
    month, so that a pattern with any number of entries is not one task.
    """
    key = ["list", "verdict", "kind", "pattern"]
    dated = entries.select(*key, "action", "at").filter("at IS NOT NULL AND pattern IS NOT NULL AND action IN ('add', 'remove')").distinct()
    dated = dated.groupBy(*key, "at").agg(F.max("action").alias("action")).withColumn("_month", F.trunc("at", "month"))
    inside = Window.partitionBy(*key, "_month").orderBy("at")
    following = Window.partitionBy(*key).orderBy("_month")
    months = dated.groupBy(*key, "_month").agg(F.min("at").alias("_first")).withColumn("_next", F.lead("_first").over(following)).drop("_first")
    ends = dated.withColumn("_end", F.lead("at").over(inside)).join(months, [*key, "_month"])
    return ends.filter("action = 'add'").select(*key, F.col("at").alias("valid_from"), F.coalesce("_end", "_next").alias("valid_to"))


def _keys(url: Column) -> Column:
    """(kind, pattern) under which a list can hold a URL: its host, each domain above and including it, and each
    directory of its path behind the host."""
    host, path = url_host(url), url_path(url)
    labels = F.split(host, r"\.")
    domains = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.struct(F.lit("domain").alias("kind"), F.array_join(F.slice(labels, i, F.size(labels)), ".").alias("pattern")))
    steps = F.filter(F.split(path, "/"), lambda s: s != "")
    below = F.when(F.size(steps) > 0, F.transform(F.sequence(F.lit(1), F.size(steps)), lambda i: F.struct(F.lit("prefix").alias("kind"), F.concat(host, F.lit("/"), F.array_join(F.slice(steps, F.lit(1), i), "/")).alias("pattern")))).otherwise(
        F.array().cast("array<struct<kind:string,pattern:string>>")
    )
    alone = F.array(F.struct(F.lit("host").alias("kind"), host.alias("pattern")))
    return F.when(host == "", F.array(F.struct(F.lit("host").alias("kind"), F.lit(None).cast("string").alias("pattern")))).otherwise(F.concat(alone, domains, below))


def changes(entries: DataFrame) -> DataFrame:
    """(kind, pattern, at, block, allow): by how much the numbers of active entries of a pattern change at a time."""
    spans = validity_intervals(entries)
    ends = F.array(F.struct(F.col("valid_from").alias("at"), F.lit(1).alias("by")), F.struct(F.col("valid_to").alias("at"), F.lit(-1).alias("by")))
    each = spans.select("kind", "pattern", "verdict", F.explode(ends).alias("e")).filter("e.at IS NOT NULL")
    by = lambda verdict: F.sum(F.when(F.col("verdict") == verdict, F.col("e.by")).otherwise(0)).alias(verdict)
    return each.groupBy("kind", "pattern", F.col("e.at").alias("at")).agg(by("block"), by("allow"))


def as_of(asked: DataFrame, steps: DataFrame) -> DataFrame:
    """`asked` (kind, pattern, at, and whatever else) with the sums `block` and `allow` of all `steps` (kind, pattern, at, block,
    allow) of its pattern up to and at its time.

    As-of join.  A day starts with the sum of the days before it, which are few per pattern; inside a day rows and steps are
    sorted together and summed on.  The rows of a pattern and day are dealt into `SALTS` parts that each get the day's steps, so a
    pattern may have any share of the rows.  No step is repeated for a day without rows, however far apart the days lie.
    """
    key = ["kind", "pattern", "_day"]
    rows = asked.withColumn("_day", F.to_date("at"))
    dated = steps.withColumn("_day", F.to_date("at"))
    needed = rows.select(*key).distinct()
    days = dated.groupBy(*key).agg(F.sum("block").alias("block"), F.sum("allow").alias("allow"), F.lit(False).alias("_asked")).unionByName(
        needed.select(*key, F.lit(0).cast("long").alias("block"), F.lit(0).cast("long").alias("allow"), F.lit(True).alias("_asked"))
    ).groupBy(*key).agg(F.sum("block").alias("block"), F.sum("allow").alias("allow"), F.max("_asked").alias("_asked"))
    earlier = Window.partitionBy("kind", "pattern").orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)
    opening = days.select(*key, "_asked", *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(c) for c in ("block", "allow")]).filter("_asked")
    inside = dated.join(needed, key, "left_semi").select(*key, "at", "block", "allow")
    known = opening.select(*key, F.lit(None).cast("timestamp").alias("at"), "block", "allow").unionByName(inside)
    dealt = known.withColumn("_salt", F.explode(F.array(*[F.lit(i) for i in range(SALTS)]))).withColumn("_row", F.lit(None).cast(asked.select(F.struct("*")).schema[0].dataType))
    whole = F.struct(*[F.col(f"`{c}`") for c in asked.columns])
    wanted = rows.select(
        *key, "at", F.lit(0).cast("long").alias("block"), F.lit(0).cast("long").alias("allow"), F.pmod(F.xxhash64(whole), F.lit(SALTS)).cast("int").alias("_salt"), whole.alias("_row")
    )
    so_far = Window.partitionBy(*key, "_salt").orderBy(F.col("at").asc_nulls_first(), F.col("_row").isNotNull()).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    summed = dealt.unionByName(wanted).select("_row", F.sum("block").over(so_far).alias("block"), F.sum("allow").over(so_far).alias("allow"))
    return summed.filter("_row IS NOT NULL").select("_row.*", "block", "allow")


def temporal_list_join(captures: DataFrame, entries: DataFrame, key: str = "page_id", url: str = "url", fetched: str = "fetched") -> DataFrame:
    """(key, url, fetched, n_block, n_allow, verdict) for every capture: the entries active at its fetch time.

    `verdict` is `allow` if an allow entry is active, else `block` if a block entry is, else `none`.  A null or
    unreadable URL and a null time meet no entry.  Rows that agree in all three columns are told as often as they come;
    empty captures give no row, an empty list blocks nothing; other columns are ignored.

    Of the (kind, pattern) keys of a capture those that any list names are joined as of the fetch time with the running numbers of
    active entries (`as_of`).  The named patterns are sent to all executors only up to `BROADCAST_BYTES`; past that both
    sides are shuffled with a salt, as one host may have a third of all captures.
    """
    steps = cut(changes(entries))
    listed = cut(steps.select("kind", "pattern").distinct())
    size = listed.agg(F.sum(F.octet_length("pattern") + 32)).first()[0] or 0
    seen = captures.select(F.col(f"`{key}`").alias("_key"), F.col(f"`{url}`").alias("_url"), F.col(f"`{fetched}`").alias("_at"))
    once = seen.groupBy("_key", "_url", "_at").agg(F.count(F.lit(1)).alias("_copies"))
    keyed = once.filter("_at IS NOT NULL").select("_key", "_url", F.col("_at").cast("timestamp").alias("at"), "_at", F.explode(_keys(F.col("_url"))).alias("_k")).select(
        "_key", "_url", "_at", "at", "_k.kind", "_k.pattern"
    )
    if size <= BROADCAST_BYTES:
        named = keyed.join(F.broadcast(listed), ["kind", "pattern"], "left_semi")
    else:
        salted = listed.withColumn("_salt", F.explode(F.array(*[F.lit(i) for i in range(SALTS)])))
        named = keyed.withColumn("_salt", F.pmod(F.xxhash64("_key", "_url", "_at"), F.lit(SALTS)).cast("int")).join(salted, ["kind", "pattern", "_salt"], "left_semi").drop("_salt")
    met = as_of(cut(named), steps).select("_key", "_url", "_at", F.lit(0).cast("long").alias("_copies"), "block", "allow")
    none = F.lit(0).cast("long")
    counted = once.select("*", none.alias("block"), none.alias("allow")).unionByName(met).groupBy("_key", "_url", "_at").agg(
        F.max("_copies").alias("_copies"), F.sum("block").alias("n_block"), F.sum("allow").alias("n_allow")
    )
    verdict = F.when(F.col("n_allow") > 0, "allow").when(F.col("n_block") > 0, "block").otherwise("none")
    return counted.withColumn("_again", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_copies")))).select(
        F.col("_key").alias(key), F.col("_url").alias(url), F.col("_at").alias(fetched), "n_block", "n_allow", verdict.alias("verdict")
    )
