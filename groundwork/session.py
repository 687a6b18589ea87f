"""Session settings, scratch storage and size checks."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Largest table handed to every executor, in rows. Rows of such tables are short.
BROADCAST_ROWS = 200_000


def build_session(name: str = "groundwork", cpus: str = "*", memory: str = "8g") -> SparkSession:
    """A local session for tests and benchmarks. Clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(name)
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.shuffle.partitions", "8" if cpus == "*" else cpus)
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )


def scratch_dir(spark: SparkSession, purpose: str) -> str:
    """A fresh folder path under the shared folder that ``spark.checkpoint.dir`` names, else under the warehouse."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        # The warehouse is the other folder that all executors reach.
        shared = os.path.join(spark.conf.get("spark.sql.warehouse.dir"), "_scratch")
    return os.path.join(shared, f"{purpose}-{uuid.uuid4().hex}")


def is_small(table: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    """Whether a table has at most so many rows. Reads no more than one row beyond that."""
    return table.limit(rows + 1).count() <= rows


def ship(table: DataFrame, small: bool) -> DataFrame:
    """Broadcast a side whose size was checked; else leave the join to the optimizer."""
    return F.broadcast(table) if small else table


def settle(table: DataFrame, purpose: str) -> DataFrame:
    """Write a table to the shared folder and go on from there.

    For what a plan reads many times: its lineage is cut, its size is known to the optimizer, and
    the files outlive any executor.
    """
    path = scratch_dir(table.sparkSession, purpose)
    table.write.parquet(path)
    return table.sparkSession.read.schema(table.schema).parquet(path)


def remove_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder that this library wrote, in whatever store it lies. A missing one is no error."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def discard(table: DataFrame) -> None:
    """Delete the files of a table that ``settle`` wrote, once nothing reads it any more."""
    for folder in {file.rsplit("/", 1)[0] for file in table.inputFiles()}:
        remove_folder(table.sparkSession, folder)
