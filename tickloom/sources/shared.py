"""The folder that executors and driver share, and rows dealt for work that outgrows them."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, SparkSession


def with_checkpoints(spark: SparkSession) -> str:
    """Checkpoints go to spark.checkpoint.dir; only where it is unset and the master is local (tests on one machine) to a
    temporary folder. Elsewhere that is an error: executors don't share such a folder."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found and not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(found or tempfile.mkdtemp(prefix="tickloom-"))
    return (found or spark.sparkContext.getCheckpointDir()).rstrip("/")


def spread(df: DataFrame, *columns: str) -> DataFrame:
    """``df`` dealt by ``columns`` to several tasks a core, however few bytes it has: for joins whose result is far larger than their sides."""
    return df.repartition(max(64, 4 * df.sparkSession.sparkContext.defaultParallelism), *columns)
