"""Scanning whole texts with JVM expressions: all matches of a pattern, and blocks of lines that keep their numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from codeatlas.functions.text import split_lines


def matches(text: Column | str, pattern: str, *names: str) -> Column:
    """Array of structs, one per match, a field per capture group."""
    col = F.col(text) if isinstance(text, str) else text
    groups = [F.regexp_extract_all(col, F.lit(pattern), F.lit(i + 1)).alias(n) for i, n in enumerate(names)]
    if len(groups) == 1:
        return F.transform(groups[0], lambda g: F.struct(g.alias(names[0])))
    return F.arrays_zip(*groups)


def keep_where(df: DataFrame, name: str, value: Column, condition) -> DataFrame:
    """Adds the column and keeps the rows where `condition(value)` holds.

    A plain filter on a computed column is pushed below the projection, and the value is then computed twice; here it
    is computed once.
    """
    return df.withColumn(name, F.explode(F.filter(F.array(value), condition)))


def held(value: Column, body) -> Column:
    """`body(value)` with the value computed once.

    Inside a lambda every mention of a column is computed again, and what is made from it as often as all mentions together.
    """
    return F.transform(F.array(value), body)[0]


def first_seen(values: Column, key: str | None = None) -> Column:
    """Array without repeats, first occurrence kept; structs are told apart by one of their fields."""
    if key is None:
        return F.array_distinct(values)

    def firsts(all_values):
        keyed = F.array_sort(F.transform(all_values, lambda x, i: F.struct(x[key].alias("k"), i.alias("i"))))
        heads = lambda s: F.filter(s, lambda x, i: (i == 0) | ~F.get(s, i - 1)["k"].eqNullSafe(x["k"]))
        places = F.transform(F.transform(F.array(keyed), heads)[0], lambda x: x["i"])
        return F.transform(F.array_sort(places), lambda p: F.get(all_values, p))

    # Held by a lambda's name, the array is built once however often it is looked into.
    return F.transform(F.array(values), firsts)[0]


def numbered(text: Column | str) -> Column:
    """The text with `<line number>:` before every line."""
    return F.array_join(
        F.transform(split_lines(text), lambda x, i: F.concat((i + 1).cast("string"), F.lit(":"), x)), "\n"
    )


def sections(files: DataFrame, head: str, text: Column, keep: list[str]) -> DataFrame:
    """(keep..., head, lines): a numbered text cut before every line that matches `head` (a pattern for the line).

    Every section but possibly the first begins with its head line, so all its lines know the nearest declaration
    above them; the numbers written into the lines survive the cut.  Nothing is shuffled.
    """
    cut = F.split(text, rf"(?md)^(?=\d+:{head})")
    rows = files.select(*keep, F.explode(cut).alias("section")).filter("section <> ''")
    lines = F.transform(
        F.filter(split_lines("section"), lambda x: x != ""),  # a section ends with the break before the next one
        lambda x: F.struct(
            F.substring_index(x, ":", 1).try_cast("int").alias("line"), F.regexp_replace(x, r"^\d+:", "").alias("text")
        ),
    )
    return rows.select(*keep, lines.alias("lines")).withColumn("head", F.col("lines")[0]["text"])


def blocks(text: Column, indent: int) -> Column:
    """Array of the blocks a YAML-like text falls into: each begins at a line with exactly this indentation."""
    return F.split(text, rf"(?md)^(?= {{{indent}}}[^\s#-])")
