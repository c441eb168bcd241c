"""Session settings the package relies on, and the checkpoint folder rule."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

RECOMMENDED = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def local_session(cpus: int | str = 8, app: str = "panelweave") -> SparkSession:
    """A local session for tests and the bench; clusters bring their own."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "12g")
    )
    for key, value in RECOMMENDED.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the cluster's shared ``spark.checkpoint.dir``.

    Only a local master, where driver and executors share one disk, may fall
    back to a temporary folder.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is not None:
        return
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        context.setCheckpointDir(shared)
    elif context.master.startswith("local"):
        context.setCheckpointDir(tempfile.mkdtemp(prefix="panelweave-ckpt-"))
    else:
        raise ValueError("iterative operators need spark.checkpoint.dir to name a shared folder")


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the checkpoint folder, so that rounds do not re-run their past."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def free_files(spark: SparkSession) -> None:
    """Have Spark delete shuffle files and checkpoints that nothing refers to any more.

    It does so only once the driver's heap is collected, which may be long after a big step.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """Rows over as many tasks as the session shuffles into, for rows that cost far more to work on than to move.

    The number is given, so that adaptive execution does not merge small partitions into one slow task.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


#: Rows of one task in steps that hold them, or a group for each, in memory.
TASK_ROWS = 500_000


def tasks_for(df: DataFrame, rows: int = TASK_ROWS) -> int:
    """As many tasks as the session shuffles into, and more for a table of more than ``rows`` for each; counts ``df``.

    So the memory of a task does not follow the size of the table.
    """
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-df.count() // rows))


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new path below the checkpoint folder, for tables that later steps read."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"
