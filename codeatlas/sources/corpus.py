"""Reading trees of source files, choosing files and taking them apart into lines."""

from __future__ import annotations

import itertools
import os
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from codeatlas.functions.languages import language_of
from codeatlas.functions.text import extension, split_lines

# Directories no index looks into, and extensions of files that are not text.
IGNORED_DIRS = [
    "node_modules", "dist", "build", ".git", "coverage", "__pycache__", ".next", ".nuxt", "target", "out",
    ".venv", "venv",
]
BINARY_EXTENSIONS = [
    ".png", ".jpg", ".jpeg", ".gif", ".ico", ".svg", ".woff", ".woff2", ".ttf", ".eot", ".mp3", ".mp4", ".zip", ".tar",
    ".gz", ".pdf", ".exe", ".dll", ".so", ".dylib", ".lock", ".bin",
]
TEST_SUFFIXES = [".test.ts", ".test.tsx", ".spec.ts", ".spec.tsx", ".d.ts"]


LISTING = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
PACKED = ["gz", "bz2", "deflate", "lz4", "snappy", "zst"]  # fixed values: what Spark's text reader unpacks
_READS = 32  # tasks a core that open files


def _listed(spark: SparkSession, root: str, kind: str, **options) -> DataFrame:
    """Files below `root`.  Reading lists all directories at once, by default with a task for each of up to 10,000; in a tree of many small
    directories that is mostly the start of tasks, so here each core gets four lists of them."""
    before = spark.conf.get(LISTING)
    spark.conf.set(LISTING, str(min(int(before), 4 * spark.sparkContext.defaultParallelism)))
    try:
        return spark.read.format(kind).options(recursiveFileLookup=True, **options).load(root)
    finally:
        spark.conf.set(LISTING, before)


def _texts(spark: SparkSession, root: str, packed: bool) -> DataFrame:
    """(file_path, size, mtime, content) of whole files below `root`, and of `packed` ones, if they are asked for, what is packed in them.

    Files are read as they are: Spark's reader of texts sets up a job's configuration for each, which for small files is most of the time.  It
    reads the packed ones; that there are any is told by the listing.
    """
    meta = {"file_path": "file_path", "size": "file_size", "mtime": "file_modification_time"}
    told = lambda df, text: df.select(*[F.col(f"_metadata.{c}").alias(name) for name, c in meta.items()], F.col(text).cast("string").alias("content"))
    plain = _listed(spark, root, "binaryFile")
    if not packed:
        return told(plain, "content")
    is_packed = F.col("_metadata.file_name").rlike(r"\.(" + "|".join(PACKED) + ")$")
    if plain.filter(is_packed).isEmpty():
        return told(plain, "content")
    unpacked = _listed(spark, root, "text", wholetext=True, pathGlobFilter="*.{" + ",".join(PACKED) + "}")
    return told(plain.filter(~is_packed), "content").unionByName(told(unpacked, "value"))


def _write_texts(batches: Iterator[pa.RecordBatch], root: str) -> Iterator[pa.RecordBatch]:
    rows = itertools.chain.from_iterable(zip(*(c.to_pylist() for c in batch.columns)) for batch in batches)
    files = 0
    for (repo, path), texts in itertools.groupby(rows, lambda row: row[:2]):
        to = os.path.join(root, repo, path)
        part = os.path.join(os.path.dirname(to), f".{TaskContext.get().taskAttemptId()}")
        os.makedirs(os.path.dirname(to), exist_ok=True)
        with open(part, "wb") as out:
            for _, _, text in texts:
                out.write((text or b"") + b"\n")
        os.replace(part, to)  # a task that runs again writes the same, and no reader meets half a file
        files += 1
    yield pa.RecordBatch.from_arrays([pa.array([files], pa.int64())], names=["files"])


def mounted(spark: SparkSession, root: str) -> str | None:
    """`root` as a path of the machine, if it lies below a `file:` folder, which all executors share; else None."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    store = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return path.toUri().getPath() if store.getUri().getScheme() == "file" else None


def write_tree(files: DataFrame, root: str) -> int:
    """Write texts (repo, path, content) as a tree of files below `root`, a folder of the machine that all executors share, and tell their number.

    Every core writes files by itself.  Rows of one path make one file, a line each, as Spark's text writer has it; that writer starts
    several processes a file to set its mode, which for small files is most of the time.
    """
    os.makedirs(root, exist_ok=True)
    dealt_out = files.select("repo", "path", F.col("content").cast("binary")).repartition(files.sparkSession.sparkContext.defaultParallelism, "repo", "path")
    written = dealt_out.sortWithinPartitions("repo", "path").mapInArrow(lambda batches: _write_texts(batches, root), "files long")
    return written.agg(F.coalesce(F.sum("files"), F.lit(0))).first()[0]


def read_corpus(
    spark: SparkSession, root: str, repo: str | None = None, known_only: bool = True, max_bytes: int | None = None
) -> DataFrame:
    """Files below `root` as the `files` table.

    Without `repo` the first directory below the root names the repository.  Path, size and age come from the file
    listing, so files dropped by language or size are never opened.
    """
    # Spark tells `file:///a` as `file:/a`, so the store's name is left out of what is compared.
    base = re.sub(r"^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?(?=/)", "", root).rstrip("/")
    start = "^(?:[A-Za-z][A-Za-z0-9+.-]*:(?://[^/]*)?)?" if base.startswith("/") else ""
    rel = F.regexp_extract(F.url_decode("file_path"), rf"{start}{re.escape(base)}/(.*)$", 1)
    raw = _texts(spark, root, not known_only).withColumn("rel", rel).drop("file_path")
    # By Spark's cost of opening a file a partition takes a few small ones; a bounded number of tasks reads one partition after the other.
    raw = raw.coalesce(_READS * spark.sparkContext.defaultParallelism)
    if max_bytes is not None:
        raw = raw.filter(F.col("size") <= max_bytes)
    if repo is None:
        named = raw.withColumn("repo", F.split("rel", "/")[0]).withColumn("path", F.regexp_extract("rel", r"^[^/]*/(.*)$", 1))
    else:
        named = raw.withColumn("repo", F.lit(repo)).withColumn("path", F.col("rel"))
    out = named.select(
        "repo", "path", extension("path").alias("ext"), language_of("path").alias("language"), "size", "mtime", "content"
    )
    return out.filter(F.col("language").isNotNull()) if known_only else out


def store_corpus(files: DataFrame, root: str, rows_per_file: int = 100_000) -> None:
    """Write a `files` table by language, so that a job for one language reads that language's files only.

    The rebalance hint cuts a language of any size into writers of the session's
    advisory partition size.
    """
    balanced = files.hint("rebalance", F.col("language"))
    balanced.write.mode("overwrite").option("maxRecordsPerFile", rows_per_file).partitionBy("language").parquet(root)


def glob_pattern(glob: str) -> str:
    """`*` stays within a directory, `**` does not, `**/` is any number of directories; everything else is literal."""
    pieces = re.split(r"(\*\*/|\*\*|\*)", glob)
    return "".join({"**/": "(?:.*/)?", "**": ".*", "*": "[^/]*"}.get(p) or re.escape(p) for p in pieces if p)


def excluded(path: Column, globs: list[str]) -> Column:
    """A glob hits the whole path, the path as a directory, its beginning, or any part of it as plain text."""
    hit = F.lit(False)
    for glob in globs:
        hit = hit | path.rlike(f"^(?:{glob_pattern(glob)})/?$") | path.startswith(re.sub(r"\*$", "", glob)) | path.contains(glob)
    return hit


def prune_paths(
    files: DataFrame,
    ignore_dirs: list[str] = IGNORED_DIRS,
    globs: list[str] = (),
    max_bytes: int | None = None,
    skip_tests: bool = True,
) -> DataFrame:
    """Drop ignored directories, excluded globs, tests and declarations, binaries and, with `max_bytes`, larger files.

    Everything looks at path and size only, so a scan prunes before it touches contents.
    """
    path = F.col("path")
    keep = ~F.arrays_overlap(F.split(path, "/"), F.array(*[F.lit(d) for d in ignore_dirs]))
    keep = keep & ~extension("path").isin(BINARY_EXTENSIONS)
    if globs:
        keep = keep & ~excluded(path, list(globs))
    if max_bytes is not None:
        keep = keep & (F.col("size") <= max_bytes)
    if skip_tests:
        for suffix in TEST_SUFFIXES:
            keep = keep & ~path.endswith(suffix)
    return files.filter(keep)


def explode_lines(df: DataFrame, text: str = "content", keep: list[str] = ("repo", "path")) -> DataFrame:
    """One row per line, 1-based: (keep..., line, text).  A narrow step: no shuffle."""
    return df.select(*keep, F.posexplode(split_lines(text)).alias("pos", "text")).select(
        *keep, (F.col("pos") + 1).alias("line"), "text"
    )
