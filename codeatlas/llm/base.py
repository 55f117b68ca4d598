"""Small Spark helpers that the operators of this package share."""

from __future__ import annotations

import pickle
import sys
from collections.abc import Callable

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window, functions as F

cloudpickle.register_pickle_by_value(sys.modules[__name__])

BLANKS = "\t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def word_list(text: Column, lower: bool = False) -> Column:
    """Words of a text in order (with `lower`, A-Z in lower case); no words for null.

    Every blank is made a space first, so that the cut needs no pattern.
    """
    upper, low = (UPPER, LOWER) if lower else ("", "")
    spaced = F.translate(F.coalesce(text, F.lit("")), upper + BLANKS, low + " " * len(BLANKS))
    return F.array_remove(F.split(spaced, " "), "")


def once(value: Column) -> Column:
    """The value as a generator of one row: what stands above it reads it, and can't compute it again."""
    return F.explode(F.array(value))


# Settings that are changed where a session has left them at Spark's own value: rows handed to Python at once, since rows here are
# whole texts, and characters of a plan's description, of which the driver keeps one for each of a thousand jobs.
DEFAULTS = {
    "spark.sql.execution.arrow.maxRecordsPerBatch": ("10000", "1000"),
    "spark.sql.maxPlanStringLength": (str((1 << 31) - 16), "16384"),
}


def text_batches(docs: DataFrame) -> DataFrame:
    """`docs`, with `DEFAULTS` in force in its session."""
    spark = docs.sparkSession
    for key, (given, wanted) in DEFAULTS.items():
        if spark.conf.get(key, given) == given:
            spark.conf.set(key, wanted)
    return docs


def digest(*parts: Column) -> list[Column]:
    """Two 64-bit hashes with different seeds: 128 bits that tell values apart."""
    return [F.xxhash64(F.lit(1), *parts).alias("h1"), F.xxhash64(F.lit(2), *parts).alias("h2")]


def only(df: DataFrame, *cols: str) -> DataFrame:
    """The named columns, whatever else the frame has."""
    return df.select(*[F.col(f"`{c}`") for c in cols])


KINDS = 64
"""Most kinds of a bounded sample: those with most rows."""


def bounded_sample(marked: DataFrame, texts: DataFrame, per_kind: int, kinds: int = KINDS) -> DataFrame:
    """(id, text, mark) of at most `per_kind` rows for each of at most `kinds` marks, in any table: those with the least hashes of their ids.

    `marked` has (id, mark), `texts` has (id, text).  An id with several marks or texts counts once, with the least of them.  Rows are counted by mark
    first, so that all but a few times `per_kind` are left out by their hashes before anything is sorted: no task meets all rows of a mark.
    """
    place = F.shiftrightunsigned(F.xxhash64("id"), 1) / F.lit(2.0**63)
    sizes = marked.groupBy("mark").agg(F.count(F.lit(1)).alias("_n")).orderBy(F.desc("_n"), "mark").limit(kinds)
    near = marked.join(F.broadcast(sizes), "mark").filter(place * F.col("_n") < 4.0 * per_kind + 64)
    single = near.groupBy("id").agg(F.min("mark").alias("mark"))
    order = Window.partitionBy("mark").orderBy(place, "id")
    chosen = single.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= per_kind).select("id", "mark")
    return texts.join(F.broadcast(chosen), "id").groupBy("id").agg(F.min("text").alias("text"), F.first("mark").alias("mark"))


def fitted(sample: DataFrame, train: Callable, *order: str):
    """What `train(texts, marks)` makes of a bounded sample's rows in the given order: worked out in one task, so that the driver holds nothing but the
    model.  A lost executor costs one more run of it."""

    def run(batches):
        rows = [row for batch in batches for row in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(train([t for t, _ in rows], [m for _, m in rows]))], pa.binary())], names=["model"])

    one = sample.repartition(1).sortWithinPartitions(*order).select("text", "mark")
    made = one.mapInArrow(run, "model binary").first()
    return pickle.loads(made.model) if made else train([], [])
