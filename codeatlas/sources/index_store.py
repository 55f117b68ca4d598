"""Index and graph tables: writing, reading, and refreshing only what changed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

INDEX_VERSION = 1


def changed_files(snapshot: DataFrame, index_files: DataFrame, force: bool = False) -> DataFrame:
    """Files of a snapshot (repo, path, mtime_ms, ...) that are new or younger than their index entry."""
    if force:
        return snapshot
    known = index_files.select("repo", "path", F.col("mtime_ms").alias("_seen"))
    return snapshot.join(known, ["repo", "path"], "left").filter(
        F.col("_seen").isNull() | (F.col("_seen") < F.col("mtime_ms"))
    ).drop("_seen")


def replace_rows(old: DataFrame, fresh: DataFrame, changed: DataFrame, file: str = "file") -> DataFrame:
    """Old rows of unchanged files and the fresh rows of changed ones."""
    touched = changed.select("repo", F.col("path").alias(file)).distinct()
    return old.join(touched, ["repo", file], "left_anti").unionByName(fresh, allowMissingColumns=True)


def incremental_index(snapshot: DataFrame, index: dict[str, DataFrame], extract, force: bool = False) -> dict[str, DataFrame]:
    """Index tables after a refresh: `extract(files)` gives the tables of the changed files only.

    `index` holds `files` (repo, path, mtime_ms, ...) and any tables with a `file` column.
    """
    changed = changed_files(snapshot, index["files"], force)
    fresh = extract(changed)
    out = {name: replace_rows(index[name], fresh[name], changed) for name in fresh}
    entry = changed.select(*[c for c in index["files"].columns if c in changed.columns])
    out["files"] = replace_rows(index["files"], entry, changed, "path")
    return out


def incremental_graph(
    prev_nodes: DataFrame, prev_edges: DataFrame, prev_mtimes: DataFrame, fresh_nodes: DataFrame, fresh_edges: DataFrame, mtimes: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """Graph after a rescan: nodes of files with an equal mtime stay, others come from the rescan.

    An old edge is carried over only where both ends survive and the rescan has not told it again.  `*mtimes` are
    (repo, path, mtime_ms).
    """
    now = mtimes.select("repo", F.col("path").alias("file_path"), F.col("mtime_ms").alias("now"))
    then = prev_mtimes.select("repo", F.col("path").alias("file_path"), F.col("mtime_ms").alias("then"))
    same = now.join(then, ["repo", "file_path"]).filter("now = then").select("repo", "file_path")
    kept = prev_nodes.join(same, ["repo", "file_path"], "left_semi").join(fresh_nodes.select("repo", "id"), ["repo", "id"], "left_anti")
    nodes = fresh_nodes.unionByName(kept, allowMissingColumns=True)
    ids = nodes.select("repo", "id").distinct()
    key = ["repo", "src", "dst", "type"]
    carried = (
        prev_edges.join(ids.withColumnRenamed("id", "src"), ["repo", "src"], "left_semi")
        .join(ids.withColumnRenamed("id", "dst"), ["repo", "dst"], "left_semi")
        .join(fresh_edges.select(*key), key, "left_anti")
    )
    return nodes, fresh_edges.unionByName(carried.select(*fresh_edges.columns))


def write_index(tables: dict[str, DataFrame], root: str, version: int = INDEX_VERSION, by_repo: bool = True) -> None:
    """Write every table below `root`, one directory per repo, and the version last, so a half-written index never counts.

    With `spark.sql.sources.partitionOverwriteMode=dynamic` on the writer only the repos present are replaced.
    """
    spark = next(iter(tables.values())).sparkSession
    for name, df in tables.items():
        writer = df.write.mode("overwrite")
        if by_repo:
            # the hint cuts a repo of any size into writers of the session's advisory partition size
            writer = df.hint("rebalance", F.col("repo")).write.mode("overwrite").partitionBy("repo").option("partitionOverwriteMode", "dynamic")
        writer.parquet(f"{root}/{name}")
    spark.createDataFrame([(version,)], "version int").coalesce(1).write.mode("overwrite").parquet(f"{root}/_version")


def read_index(spark: SparkSession, root: str, names: list[str], version: int = INDEX_VERSION) -> dict[str, DataFrame] | None:
    """The tables of an index, or None when there is none of this version: the caller then rebuilds it."""
    try:
        found = spark.read.schema("version int").parquet(f"{root}/_version").first()
    except Exception as error:  # a missing index is an answer, anything else is not
        if "PATH_NOT_FOUND" in str(error):
            return None
        raise
    if found is None or found["version"] != version:
        return None
    return {name: spark.read.parquet(f"{root}/{name}") for name in names}

