"""Ordered computations that stay distributed when one key holds a large share of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

CHUNK = 65536


def forward_fill(df: DataFrame, keys: list[str], position: str, value: Column, name: str, chunk: int = CHUNK) -> DataFrame:
    """Adds `name`: the latest non-null `value` at or before each row, per key, in order of the integer position.

    Positions are cut into chunks.  Each chunk fills itself, and the last value before a chunk comes from a table with
    one row per chunk, so a key's rows are spread over many tasks however long it is.
    """
    tagged = df.withColumn("_v", value).withColumn("_chunk", F.floor(F.col(position) / chunk))
    part = [*keys, "_chunk"]
    inside = Window.partitionBy(*part).orderBy(position).rowsBetween(Window.unboundedPreceding, 0)
    tails = tagged.filter(F.col("_v").isNotNull()).groupBy(*part).agg(F.max_by("_v", position).alias("_tail"))
    chunks = tagged.select(*part).distinct().join(tails, part, "left")
    before = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    carried = chunks.select(*part, F.last("_tail", ignorenulls=True).over(before).alias("_carry"))
    return (
        tagged.withColumn("_own", F.last("_v", ignorenulls=True).over(inside))
        .join(carried, part)
        .withColumn(name, F.coalesce("_own", "_carry"))
        .drop("_v", "_chunk", "_own", "_carry")
    )
