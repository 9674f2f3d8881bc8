"""Reliable cutting of lineage for iterative operators, and dealing of small inputs."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that the session names for checkpoints; one of its own only where Spark runs on one machine."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        shared = context.getConf().get("spark.checkpoint.dir", None)
        if not shared and not context.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        context.setCheckpointDir(shared or tempfile.mkdtemp(prefix="checkpoints-"))
    return context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """``df`` checkpointed in the shared folder, to be joined by sorting.

    A checkpoint keeps the estimate of its plan, which starts from compressed files and knows
    nothing of exploded rows: by that, tables of any size would be sent through the driver.
    """
    shared_folder(df.sparkSession)
    return df.checkpoint().hint("merge")


def tasks_for(df: DataFrame, rows: int = 50_000) -> int:
    """Tasks of about so many rows, and one for each core at least.

    Rows are counted first: give it a table, or what is written, not a costly plan.
    """
    return max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // rows))


def spread(df: DataFrame, *keys: str, rows: int = 50_000) -> DataFrame:
    """``df`` in tasks of about so many rows, and over all cores: for rows that cost far more to analyse than to read.

    With ``keys``, rows of one key stay together, so windows and groups by these keys move
    nothing again.  The number of tasks grows with the rows, so what a task holds doesn't.
    """
    count = tasks_for(df, rows)
    if keys:
        return df.repartition(count, *keys)
    return df.repartition(count) if df.rdd.getNumPartitions() < count else df
