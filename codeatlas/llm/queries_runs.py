"""Query of the periodic run operator."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from codeatlas.llm.base import word_list
from codeatlas.llm.periodic_runs import collapse_runs
from codeatlas.llm.registry import query, table


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """(doc_id, text), where the contract's tenth of the documents repeats a stretch of its words up to the end."""
    crc = F.crc32(F.col("doc_id").cast("string"))
    g, n = F.floor(crc / 10), F.size("w")
    a = (g % n).cast("int")
    p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")

    def planted(words: Column) -> Column:
        return F.transform(words, lambda w, i: F.when(i < F.col("a"), w).otherwise(F.get(words, F.col("a") + (i - F.col("a")) % F.col("p"))))

    hit = docs.select("doc_id", "text", (F.coalesce(crc % 10 == 0, F.lit(False))).alias("hit"), crc.alias("crc"))
    words = hit.withColumn("w", F.when(F.col("hit"), word_list(F.col("text"))))
    placed = words.withColumn("a", F.when(n > 0, a)).withColumn("p", F.when(n > 0, p))
    return placed.select("doc_id", F.when(F.col("hit") & (n > 0), F.array_join(planted(F.col("w")), " ")).otherwise(F.col("text")).alias("text"))


@query("op13_periodic_runs")
def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of every document, the one with the most periods, and digests of all runs and of the text without them."""
    found = collapse_runs(with_planted_runs(table(spark, sf_dir, "documents").select("doc_id", "text")))
    none = F.lit(None).cast("struct<start: long, length: long, period: long>")
    # In order of start and period: a later run must be longer, counted in periods, and not only as long.
    best = F.aggregate("runs", none, lambda acc, x: F.when(acc.isNull() | (x.length * acc.period > acc.length * x.period), x).otherwise(acc))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r.start, r.length, r.period))
    return found.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.floor(1000 * F.col("best.length") / F.col("best.period")).alias("exponent_milli"),
        F.sha2(F.concat(F.array_join(lines, "\n"), F.when(F.size("runs") > 0, "\n").otherwise("")), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
