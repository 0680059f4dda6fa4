"""The folder that driver and executors share, and tables kept in it between jobs."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Largest table, in rows of a few numbers or words each, that a broadcast hint is given for.
BROADCAST_ROWS = 1_000_000


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a temporary folder only where none is set and Spark runs in this process. A cluster without one is an error."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="wrenchlake-")
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def kept(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read back, so that a loop's plans stay short and a lost executor costs one round's tasks."""
    path = f"{shared_dir(df.sparkSession)}/wrenchlake/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small(df: DataFrame, bound: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``bound`` rows, else as it is: a shuffled join, whose skew adaptive execution splits. ``df`` should be cheap to count."""
    return F.broadcast(df) if df.limit(bound + 1).count() <= bound else df
