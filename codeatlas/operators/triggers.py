"""Triggers: which writes fire which, and the chains that follow from a change."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from codeatlas.functions.scan import matches
from codeatlas.functions.text import trim
from codeatlas.operators.reach import _folded, _union
from codeatlas.session import cut

OBJECT = r"(?i)\bCREATE\s+(?:OR\s+REPLACE\s+)?(?:CONSTRAINT\s+)?(PROCEDURE|FUNCTION|VIEW|TRIGGER)\s+(\w+)"
HEAD = (
    r"(?is)^CREATE\s+(?:OR\s+REPLACE\s+)?(?:CONSTRAINT\s+)?TRIGGER\s+\w+\s+(BEFORE|AFTER|INSTEAD\s+OF)\s+"
    r"((?:INSERT|DELETE|UPDATE(?:\s+OF\s+\w+(?:\s*,\s*\w+)*)?)(?:\s+OR\s+(?:INSERT|DELETE|UPDATE(?:\s+OF\s+\w+(?:\s*,\s*\w+)*)?))*)\s+ON\s+(\w+)"
)
SILENT = r"--[^\n]*|/\*(?:[^*]++|\*(?!/))*+(?:\*/|\z)|'(?:[^']++|'')*+'?"


def _objects(files: DataFrame) -> DataFrame:
    """(repo, file, kind, owner, body): the stretch of a SQL file from each CREATE of an object to the next one, without comments and strings."""
    quiet = F.regexp_replace(F.coalesce("content", F.lit("")), SILENT, " ")
    parts = F.split(quiet, r"(?i)(?=\bCREATE\s+(?:OR\s+REPLACE\s+)?(?:CONSTRAINT\s+)?(?:PROCEDURE|FUNCTION|VIEW|TRIGGER)\s+\w)")
    rows = files.select("repo", F.col("path").alias("file"), F.explode(parts).alias("body")).filter(F.col("body").rlike(OBJECT))
    return rows.select("repo", "file", F.lower(F.regexp_extract("body", OBJECT, 1)).alias("kind"), F.regexp_extract("body", OBJECT, 2).alias("owner"), "body")


def _names(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, ","), lambda c: F.lower(trim(c))), lambda c: c != "")


def extract_triggers(files: DataFrame) -> DataFrame:
    """(repo, file, name, timing, table_name, operation, columns): a row for each event that fires a trigger.

    `columns` are those of UPDATE OF, in lower case; empty for all.  Table names are in lower case.  Nothing is shuffled.
    """
    made = _objects(files).filter("kind = 'trigger'").filter(F.col("body").rlike(HEAD))
    events = F.explode(F.split(F.regexp_extract("body", HEAD, 2), r"(?i)\s+OR\s+")).alias("event")
    told = made.select(
        "repo", "file", F.col("owner").alias("name"), F.regexp_replace(F.upper(F.regexp_extract("body", HEAD, 1)), r"\s+", " ").alias("timing"),
        F.lower(F.regexp_extract("body", HEAD, 3)).alias("table_name"), events,
    )
    return told.withColumns({"operation": F.upper(F.regexp_extract("event", r"^\s*(\w+)", 1)), "columns": _names(F.regexp_extract("event", r"(?is)\bOF\s+(.*)$", 1))}).drop("event")


def write_events(files: DataFrame) -> DataFrame:
    """(repo, file, name, table_name, operation, columns): what each SQL object inserts, updates or deletes; `columns` are those an UPDATE sets."""
    body = F.col("body")
    event = lambda table, operation, columns: F.struct(F.lower(table).alias("table_name"), F.lit(operation).alias("operation"), columns.alias("columns"))
    nothing = F.array().cast("array<string>")
    found = F.concat(
        F.transform(F.regexp_extract_all(body, F.lit(r"(?i)\bINSERT\s+INTO\s+(\w+)"), F.lit(1)), lambda t: event(t, "INSERT", nothing)),
        F.transform(F.regexp_extract_all(body, F.lit(r"(?i)\bDELETE\s+FROM\s+(\w+)"), F.lit(1)), lambda t: event(t, "DELETE", nothing)),
        F.transform(
            matches(body, r"(?is)\bUPDATE\s+(\w+)\s+(?:(?:AS\s+)?(?!SET\b)\w+\s+)?SET\s+(.*?)(?=\bWHERE\b|\bFROM\b|;|\z)", "table", "sets"),
            lambda m: event(m["table"], "UPDATE", F.transform(
                F.regexp_extract_all(F.concat(F.lit(","), m["sets"]), F.lit(r",\s*(?:\w+\.)?(\w+)\s*="), F.lit(1)), lambda c: F.lower(c))),
        ),
    )
    rows = _objects(files).filter("kind <> 'view'").select("repo", "file", F.col("owner").alias("name"), F.explode(found).alias("e"))
    return rows.select("repo", "file", "name", "e.*").distinct()


def fires(writes: DataFrame, triggers: DataFrame) -> DataFrame:
    """(repo, src, dst, timing): which object's writes fire which trigger; an UPDATE that sets none of the named columns fires nothing.

    Both sides are taken from texts, whose rows Catalyst can't foresee; it would broadcast the triggers of any number of files.
    """
    when = triggers.select("repo", "table_name", "operation", F.col("columns").alias("only"), F.col("name").alias("dst"), "timing")
    hit = writes.join(when.hint("merge"), ["repo", "table_name", "operation"]).filter((F.size("only") == 0) | F.arrays_overlap("only", "columns"))
    return hit.select("repo", F.col("name").alias("src"), "dst", "timing").distinct()


def trigger_chains(fired: DataFrame, calls: DataFrame | None = None) -> DataFrame:
    """(repo, name, trigger, firings, path, cyclic): every trigger that a change of an object sets off, directly or through others.

    Rounds alternate between writes and firings: what a trigger writes fires the next ones.  With `calls` (repo, src, dst), an object also sets off what
    the objects it calls write.  `firings` is the least number of triggers in a row, `path` their names (the first in order, of several), and `cyclic`
    tells the triggers that set themselves off again, where a database may never come to rest.  A round moves only what is new,
    and nothing is broadcast: files of names are far smaller than their rows.
    """
    steps = fired.select("repo", "src", "dst", F.lit(1).alias("fires"))
    if calls is not None:
        steps = steps.unionByName(calls.select("repo", "src", "dst", F.lit(0).alias("fires")))
    steps = cut(steps.distinct())
    nothing = F.array().cast("array<string>")
    now = cut(steps.select("repo", F.col("src").alias("name")).distinct().select("repo", "name", F.col("name").alias("at"), nothing.alias("path")))
    seen: list[DataFrame] = []
    while not now.isEmpty():
        moved = now.withColumnRenamed("at", "src").join(steps.hint("merge"), ["repo", "src"])
        path = F.when(F.col("fires") == 1, F.concat("path", F.array("dst"))).otherwise(F.col("path"))
        found = moved.groupBy("repo", "name", F.col("dst").alias("at")).agg(F.min(F.struct(F.size(path).alias("n"), path.alias("path"))).alias("m"))
        if seen:  # a way that was found before stays, unless this one has fewer firings
            best = _union(seen).groupBy("repo", "name", "at").agg(F.min(F.size("path")).alias("known"))
            found = found.join(best.hint("merge"), ["repo", "name", "at"], "left").filter("known IS NULL OR m.n < known")
        now = cut(found.select("repo", "name", "at", F.col("m.path").alias("path")))
        seen = _folded([*seen, now])
    every = _union(seen).groupBy("repo", "name", "at").agg(F.min(F.struct(F.size("path").alias("n"), "path")).alias("m")) if seen else now.withColumn("m", F.struct(F.lit(0).alias("n"), "path"))
    names = fired.select("repo", F.col("dst").alias("at")).distinct()
    hits = cut(every.join(names.hint("merge"), ["repo", "at"], "left_semi").filter("m.n > 0"))
    loops = hits.filter("name = at").select("repo", "at", F.lit(True).alias("_loop"))
    return hits.join(loops.hint("merge"), ["repo", "at"], "left").select(
        "repo", "name", F.col("at").alias("trigger"), F.col("m.n").alias("firings"), F.col("m.path").alias("path"), F.coalesce("_loop", F.lit(False)).alias("cyclic")
    )
