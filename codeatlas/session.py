"""Session settings the library expects, and the one place that names the shared folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Runtime settings that matter for plan quality.  They are only defaults: a value already present in the
# session is left alone, so a cluster's own tuning wins.
RUNTIME_DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # A hot key may hold a third of a table: let AQE split it even when that costs one more exchange.
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
}

ROWS_A_TASK = 500_000
_FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def build_session(app: str = "codeatlas", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the library's defaults; extra settings are passed as `conf`."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**RUNTIME_DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def local_session(cpus: int = 8, app: str = "codeatlas-local") -> SparkSession:
    """Single-machine session for tests and the bench."""
    spark = build_session(
        app,
        f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": str(cpus),
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": "20g",
            "spark.driver.bindAddress": "127.0.0.1",
            "spark.driver.host": "127.0.0.1",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as named by `spark.checkpoint.dir`.

    Only a local session may go without it; there a temporary folder is made once and kept as the context's
    checkpoint folder.  On a cluster a missing setting is an error, because a machine-local folder would
    lose data together with the machine.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="codeatlas-"))
    return context.getCheckpointDir()


def scratch_path(spark: SparkSession, kind: str) -> str:
    """A fresh path in the shared folder, below the application's own directory (which can be dropped as a whole)."""
    return f"{shared_dir(spark).rstrip('/')}/codeatlas/{spark.sparkContext.applicationId}/{kind}-{uuid.uuid4().hex}"


def cut(df: DataFrame, folder: str = "") -> DataFrame:
    """Write `df` as a table in the shared folder and return that table.

    Loops call this once per round: the lineage stays flat, the rows survive the loss of an executor, and the
    files carry their true size, so Catalyst broadcasts the result only while it is under the session's
    `spark.sql.autoBroadcastJoinThreshold` and shuffles it beyond.  What was shuffled for the table is freed once it is written, so that
    a loop's disk holds one round's shuffles and not those of all rounds.  Tables of one `folder` can be dropped together (`drop_scratch`).
    """
    spark = df.sparkSession
    path = scratch_path(spark, f"{folder}/step" if folder else "step")
    was = spark.conf.get(_FREE_SHUFFLES, None)
    spark.conf.set(_FREE_SHUFFLES, "true")
    try:
        df.write.parquet(path)
    finally:
        if was is None:
            spark.conf.unset(_FREE_SHUFFLES)
        else:
            spark.conf.set(_FREE_SHUFFLES, was)
    return spark.read.schema(df.schema).parquet(path)


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """`df` dealt by `keys` over as many partitions as leave a task about `ROWS_A_TASK` rows, however large the table is.

    For steps that hold all rows of a partition in memory, as `distinct` does: the session's number of partitions is fixed, and
    adaptive execution puts partitions together by their packed size.  The rows are counted first.
    """
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // ROWS_A_TASK)), *keys)


def drop_scratch(spark: SparkSession, folder: str = "") -> None:
    """Remove what `cut` has written to `folder`, or all that this application has written to the shared folder."""
    root = f"{shared_dir(spark).rstrip('/')}/codeatlas/{spark.sparkContext.applicationId}/{folder}".rstrip("/")
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def clear_scratch(spark: SparkSession) -> None:
    """Remove all tables that this application has written to the shared folder; results that still read them must be stored first."""
    drop_scratch(spark)
