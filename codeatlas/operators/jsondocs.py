"""Operators over JSON document columns, on Spark's variant type: documents are taken apart level by level in the JVM."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from codeatlas.session import cut

LEVELS = 4
"""Levels of a document that are taken apart per written table; flatter documents need one."""


def json_path(col: Column | str, path: str) -> Column:
    """The value at a dot path with indices (`a.b[0].c`) as text; null where the path leads nowhere."""
    doc = F.col(col) if isinstance(col, str) else col
    steps = [p for p in re.sub(r"\[(\d+)\]", r".\1", path).split(".") if p]
    variant = "$" + "".join(f"[{s}]" if s.isdigit() else f"['{s}']" for s in steps)
    return F.try_variant_get(F.try_parse_json(doc), variant, "string")


def json_canonical(col: Column | str) -> Column:
    """Minified text with sorted keys at every level (how variant objects are stored)."""
    return F.to_json(F.try_parse_json(F.col(col) if isinstance(col, str) else col))


def _text(value: Column) -> Column:
    """A leaf or subtree as JSON; numbers lose zeros at the end of their fraction."""
    said = F.to_json(value)
    return F.regexp_replace(F.regexp_replace(said, r"^(-?\d+)\.0+$", "$1"), r"^(-?\d+\.\d*?[1-9])0+$", "$1")


def _listed(value: Column) -> Column:
    return F.try_variant_get(value, "$", "array<variant>")


def _children(value: Column) -> Column:
    """Children of an object by key or of an array by index, as a map; null for a scalar."""
    keyed = F.try_variant_get(value, "$", "map<string,variant>")
    index = F.transform(_listed(value), lambda _, i: i.cast("string"))
    return F.coalesce(keyed, F.map_from_arrays(index, _listed(value)))


def _below(path: Column, key: Column, listed: Column) -> Column:
    return F.when(listed, F.concat(path, F.lit("["), key, F.lit("]"))).when(path == "", key).otherwise(F.concat(path, F.lit("."), key))


def _rounds(rows: DataFrame, step) -> DataFrame:
    """Steps that open every open row, until none is left; a written table after each few levels."""
    done = []
    while True:
        for _ in range(LEVELS):
            rows = step(rows)
        rows = cut(rows)
        done.append(rows.filter("NOT open"))
        rows = rows.filter("open")
        if not rows.count():
            return reduce(DataFrame.unionByName, done)


def json_flatten(docs: DataFrame, col: str = "json", key: str = "key") -> DataFrame:
    """(repo, key, path, value): one row per leaf; a scalar document is `$`, empty containers vanish, and a document that can't be
    read is one row at `$` without value."""
    parsed = docs.select("repo", F.col(key).alias("_key"), F.lit("").alias("path"), F.try_parse_json(col).alias("v"))
    start = parsed.withColumn("open", F.coalesce(_children(F.col("v")).isNotNull(), F.lit(False)))

    def step(rows):
        listed = _listed(F.col("v")).isNotNull()
        child = lambda k, v: F.struct(_below(F.col("path"), k, listed).alias("path"), v.alias("v"), _children(v).isNotNull().alias("open"))
        inner = F.transform(F.map_entries(_children(F.col("v"))), lambda e: child(e["key"], e["value"]))
        same = F.array(F.struct("path", "v", "open"))
        return rows.select("repo", "_key", F.explode(F.when(F.col("open"), inner).otherwise(same)).alias("r")).select("repo", "_key", "r.*")

    leaves = _rounds(start, step)
    return leaves.select("repo", F.col("_key").alias(key), F.when(F.col("path") == "", "$").otherwise(F.col("path")).alias("path"), _text(F.col("v")).alias("value"))


def json_diff(left: DataFrame, right: DataFrame, col: str = "json", key: str = "key") -> DataFrame:
    """(repo, key, path, change, old, new) between two snapshots of keyed documents.

    An added or removed subtree is one row at its top; a document on one side only is a row at `$`; a pair of which one can't be
    read (null text included) is a row `unreadable` at `$`.  Documents with the same text are dropped first.  The children of two
    containers are matched by key inside their row, so pairs meet in one join only.
    """
    side = lambda df, name: df.select("repo", F.col(key).alias("_key"), F.col(col).alias(name), F.lit(True).alias(f"_in{name}"))
    both = side(left, "_a").join(side(right, "_b"), ["repo", "_key"], "full")
    alone = both.filter("_in_a IS NULL OR _in_b IS NULL").select(
        "repo", "_key", F.lit("$").alias("path"), F.when(F.col("_in_a").isNull(), "added").otherwise("removed").alias("change"),
        json_canonical("_a").alias("old"), json_canonical("_b").alias("new"),
    )
    parsed = both.filter("_in_a AND _in_b AND NOT (_a <=> _b)").select("repo", "_key", F.try_parse_json("_a").alias("a"), F.try_parse_json("_b").alias("b"))
    broken = F.col("a").isNull() | F.col("b").isNull()
    unread = parsed.filter(broken).select("repo", "_key", F.lit("$").alias("path"), F.lit("unreadable").alias("change"), F.to_json("a").alias("old"), F.to_json("b").alias("new"))
    opened = lambda a, b: F.coalesce(_children(a).isNotNull() & _children(b).isNotNull(), F.lit(False))
    start = parsed.filter(~broken).select("repo", "_key", F.lit("").alias("path"), "a", "b", opened(F.col("a"), F.col("b")).alias("open"))

    def step(rows):
        listed = _listed(F.col("a")).isNotNull() & _listed(F.col("b")).isNotNull()
        pairs = F.map_entries(F.map_zip_with(_children(F.col("a")), _children(F.col("b")), lambda _, x, y: F.struct(x.alias("a"), y.alias("b"))))
        inner = F.transform(pairs, lambda e: F.struct(
            _below(F.col("path"), e["key"], listed).alias("path"), e["value"]["a"].alias("a"), e["value"]["b"].alias("b"),
            opened(e["value"]["a"], e["value"]["b"]).alias("open"),
        ))
        same = F.array(F.struct("path", "a", "b", "open"))
        return rows.select("repo", "_key", F.explode(F.when(F.col("open"), inner).otherwise(same)).alias("r")).select("repo", "_key", "r.*")

    ends = _rounds(start, step).select(
        "repo", "_key", F.when(F.col("path") == "", "$").otherwise(F.col("path")).alias("path"), _text(F.col("a")).alias("old"), _text(F.col("b")).alias("new")
    ).filter("NOT (old <=> new)")
    change = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").otherwise("changed")
    told = ends.select("repo", "_key", "path", change.alias("change"), "old", "new")
    return alone.unionByName(unread).unionByName(told).select("repo", F.col("_key").alias(key), "path", "change", "old", "new")
