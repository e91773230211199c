"""Lineage cuts for iterative operators, in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset a local master (tests) gets a temporary folder, and a cluster an error, since
    its executors would write elsewhere."""
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and (not sc.master.startswith("local") or sc.master.startswith("local-cluster")):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="meshloom-"))
    return sc.getCheckpointDir()


def settle(df: DataFrame) -> DataFrame:
    """df written to spark.checkpoint.dir, so that later rounds neither replay it nor depend on one executor."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder that goes when the session ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(jpath)
    return path


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder as Parquet and read back: smaller than a checkpoint where rows are many, and later steps
    read the columns they need only."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


#: Rows of a table that are broadcast at most, and rows of a partition where a task holds what a key's rows multiply into.
SMALL, DEALT = 1_000_000, 1 << 18


def small(df: DataFrame) -> DataFrame:
    """df settled, and broadcast if its rows are few."""
    df = settle(df)
    return F.broadcast(df) if df.count() <= SMALL else df


def parts(df: DataFrame) -> int | None:
    """Partitions of DEALT rows for df, where Spark's number would make larger ones; else None."""
    n = -(-df.count() // DEALT)
    return n if n > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else None
