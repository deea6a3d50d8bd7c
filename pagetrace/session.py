"""Session set-up and the one place that decides where lineage is cut."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROWS_A_TASK = 2**19


def local_session(cores: str = "*", name: str = "pagetrace", **conf: str) -> SparkSession:
    """A local session for tests and the bench; clusters bring their own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder named by the cluster.

    Only a local session without the setting gets a temporary folder: on a
    cluster a machine-local folder would be lost with its executor.
    """
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not context.master.startswith("local"):
            raise RuntimeError("Set spark.checkpoint.dir to a shared folder.")
        configured = tempfile.mkdtemp(prefix="spark-checkpoint-")
    context.setCheckpointDir(configured)
    return configured


def tasks_for(spark: SparkSession, rows: int) -> int:
    return max(spark.sparkContext.defaultParallelism, -(-rows // ROWS_A_TASK))


def deal(df: DataFrame, *by: str, rows: int | None = None, tasks: int | None = None) -> DataFrame:
    """Rows dealt by expressions over a number of partitions that adaptive execution keeps.

    It merges other partitions up to a size in compressed bytes; narrow rows then come by the
    million into one task's hash map. With the number of ``rows`` a task gets about
    ``ROWS_A_TASK`` of them, else there are ``tasks`` partitions or as many as the session's shuffles have.
    """
    spark = df.sparkSession
    if rows is not None:
        count = tasks_for(spark, rows)
    else:
        count = tasks or int(spark.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(count, *[F.expr(e) for e in by])


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` reliably and drop its lineage."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
