"""Session construction and the shared scratch folder."""

from __future__ import annotations

import math
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "balanza", cores: int | str = "*", memory: str = "8g") -> SparkSession:
    """A local session for tests and benches; on a cluster pass your own session instead."""
    width = os.cpu_count() if cores == "*" else int(cores)
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(width))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )


def scratch_dir(spark: SparkSession) -> str:
    """The folder every executor shares, as named by ``spark.checkpoint.dir``.

    A machine-local folder is used only when the master itself is local.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not folder:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="balanza-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return folder.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"


def checkpoint(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder: cuts lineage and survives executor loss."""
    scratch_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def materialize(df: DataFrame, name: str, partition_by: str | None = None) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back, with its size known."""
    path = scratch_path(df.sparkSession, name)
    writer = df.write.mode("errorifexists")
    if partition_by:
        writer = writer.partitionBy(partition_by)
    writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows that a task sorts or groups at a time, so that it does so in memory.
ROWS_A_TASK = 500_000


def tasks_for(spark: SparkSession, rows: int, rows_a_task: int = ROWS_A_TASK) -> int:
    """Shuffle partitions for ``rows`` rows: as configured, and more where tasks would get too many rows and spill."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(rows / rows_a_task))


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Hash-partition by ``keys`` into twice the shuffle partitions, for compute-heavy groups.

    Adaptive execution sizes partitions by bytes and would merge small but expensive groups into
    one task. A partition number given by hand is kept; it differs from the default, because a
    repartition equal to the one below it is dropped. A grouping by the same keys needs no
    further shuffle.
    """
    return df.repartition(2 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)

