"""Continuous indexing: files that arrive are extracted once and added to a log-structured index.

Every micro-batch writes its rows under its own batch number, so a replayed batch replaces itself and nothing else is
rewritten.  Readers take, for each path, the rows of its youngest version: a late batch with an older version cannot
hide a newer one.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from codeatlas.functions.languages import language_of


def stream_corpus(spark: SparkSession, root: str) -> DataFrame:
    """Streaming `files` table (repo, path, language, mtime, content) of a tree <root>/<repo>/<path> that grows.

    The source would leave out files much older than the newest it has seen; here a checkout may bring files of any age.
    """
    raw = spark.readStream.option("maxFileAge", "365000d").text(root, wholetext=True, recursiveFileLookup=True)
    rel = F.regexp_extract(F.url_decode(F.col("_metadata.file_path")), rf"{re.escape(root.rstrip('/'))}/(.*)$", 1)
    return (
        raw.select(rel.alias("rel"), F.col("_metadata.file_modification_time").alias("mtime"), F.col("value").alias("content"))
        .select(
            F.split("rel", "/")[0].alias("repo"), F.regexp_extract("rel", r"^[^/]*/(.*)$", 1).alias("path"), "mtime", "content"
        )
        .withColumn("language", language_of("path"))
    )


def stream_index(
    files: DataFrame, sink: str, extract: Callable[[DataFrame], dict[str, DataFrame]], once: bool = True
) -> StreamingQuery:
    """Run `extract(files)` on every micro-batch of (repo, path, mtime, ...) and add its tables to the index at `sink`.

    Tables need the columns repo and file.  The age of a file is no event time, so nothing is ever late: a version that comes
    twice in a batch is taken once, and one that an earlier batch has brought is skipped.
    """

    def add(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        batch = batch.dropDuplicates(["repo", "path", "mtime"])
        try:
            known = spark.read.parquet(f"{sink}/files").filter(F.col("batch") < number)
        except AnalysisException:  # the first batch
            known = None
        if known is not None:
            batch = batch.join(known.select("repo", F.col("file").alias("path"), "mtime"), ["repo", "path", "mtime"], "left_anti")
        batch = batch.persist()  # read by every table of the batch
        try:
            versions = batch.select("repo", F.col("path").alias("file"), "mtime")
            for name, rows in {**extract(batch), "files": versions}.items():
                rows.write.mode("overwrite").parquet(f"{sink}/{name}/batch={number}")
        finally:
            batch.unpersist()

    writer = files.writeStream.foreachBatch(add).option("checkpointLocation", f"{sink}/_progress")
    return (writer.trigger(availableNow=True) if once else writer).start()


def current_index(spark: SparkSession, sink: str, names: list[str]) -> dict[str, DataFrame]:
    """The tables of a streamed index as of now: for each file the rows of its youngest version."""
    files = spark.read.parquet(f"{sink}/files")
    latest = files.groupBy("repo", "file").agg(F.max(F.struct("mtime", "batch")).alias("v")).select(
        "repo", "file", "v.mtime", F.col("v.batch").alias("batch")
    )
    out = {"files": latest.drop("batch")}
    for name in names:
        rows = spark.read.parquet(f"{sink}/{name}")
        out[name] = rows.join(latest.select("repo", "file", "batch"), ["repo", "file", "batch"], "left_semi").drop("batch")
    return out
