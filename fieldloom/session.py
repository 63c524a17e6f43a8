"""Session defaults for local runs and a durable hand-off that survives lost executors."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

#: Bytes of a Parquet row group between steps: what a writing task holds in memory.
ROW_GROUP = 32 << 20


def local_session(cores: int = 8, partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session for tests and the benchmark; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("fieldloom")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.warehouse.dir", os.path.join(tempfile.gettempdir(), "fieldloom-warehouse"))
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors see: spark.checkpoint.dir; a temporary one only for a local master without it (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return "file://" + os.path.join(tempfile.gettempdir(), "fieldloom-shared")


def measured_broadcasts(spark: SparkSession) -> None:
    """Joins without a hint broadcast a table by its size as measured at run time, not by that of its files, unless the session has chosen.

    Pixel tables shrink to a hundredth in Parquet, and runs grow again when they are exploded to cells, so by the size of its files
    a table of millions of rows would be sent through the driver.
    """
    measured, planned = "spark.sql.adaptive.autoBroadcastJoinThreshold", "spark.sql.autoBroadcastJoinThreshold"
    if spark.conf.get(measured, None) is None:
        spark.conf.set(measured, spark.conf.get(planned))
        spark.conf.set(planned, "-1")


def _remove(spark: SparkSession, path: str) -> None:
    try:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # the session has ended; its shared folder is the cluster's to clear
        pass


_made: list[str] = []


def scratch(spark: SparkSession) -> str:
    """A fresh path in the shared folder, removed by `settled` or when the driver's interpreter ends."""
    path = f"{shared_dir(spark)}/fieldloom-{uuid.uuid4().hex}"
    _made.append(path)
    atexit.register(_remove, spark, path)
    return path


def settled(spark: SparkSession, make: Callable[[], DataFrame], *over: DataFrame) -> DataFrame:
    """make()'s result, stored; the folders made on the way are removed, and those of the tables `over` that it replaces."""
    first = len(_made)
    out = stored(make())
    done = _made[first:-1] + [p for p in _made[:first] for t in over for f in t.inputFiles()[:1] if f"/{os.path.basename(p)}/" in f]
    for path in done:
        _remove(spark, path)
        _made.remove(path)
    return out


def stored(df: DataFrame, *partition_by: str) -> DataFrame:
    """Write once to the shared folder and read back: cuts lineage, computed once, survives lost executors."""
    spark = df.sparkSession
    path = scratch(spark)
    out = df.write.option("compression", "zstd").option("parquet.block.size", ROW_GROUP)
    (out.partitionBy(*partition_by) if partition_by else out).parquet(path)
    return spark.read.schema(df.schema).parquet(path)
