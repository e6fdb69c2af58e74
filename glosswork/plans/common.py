"""Helpers that every plan shares: reading tables, cutting lineage, checked broadcasts."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table `name` of the folder `sf_dir`."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def settle(df: DataFrame) -> DataFrame:
    """`df` written to the reliable checkpoint folder, with its lineage cut.

    The folder is the session's `spark.checkpoint.dir`. Only where that is unset and Spark runs in one local
    process, as in tests, is a temporary folder taken; on a cluster an unset folder is an error, because a
    machine-local folder would not outlive an executor.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not context.master.startswith("local["):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="glosswork-checkpoint-")
        context.setCheckpointDir(folder)
    return df.checkpoint(eager=True)


def bounded(df: DataFrame, most: int) -> list | None:
    """The rows of `df` if they are `most` at the most, else None. Never more than `most` + 1 rows reach the driver."""
    rows = df.limit(most + 1).collect()
    return rows if len(rows) <= most else None


def small(df: DataFrame, rows: int) -> DataFrame:
    """A broadcast hint for a side that has `rows` rows at the most; beyond them the side is joined by shuffle.

    The check counts up to `rows` + 1 rows and collects none.
    """
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df
