"""Shared helpers: the shared folder, cut lineage, checked broadcasts, bounded samples."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Largest table, in rows of a few longs each, that a broadcast hint may be given for.
BROADCAST_ROWS = 1_000_000
#: Largest Arrow batch between the JVM and a Python worker. Spark's defaults (10 000 rows, 64 MiB) let one task hold a batch of tens of
#: megabytes several times over, outside the heap, and an executor keeps what it took.
BATCH_ROWS, BATCH_BYTES = 1000, 4 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors see: ``spark.checkpoint.dir``; a temporary one only where none is set and Spark runs in this process, as in
    tests. A cluster without one is an error: its executors would not see the driver's folders."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not (spark.sparkContext.master == "local" or spark.sparkContext.master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="wrenchlake-")
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: for small tables of iterative jobs; files go when the frame is collected."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back, so later jobs don't recompute it."""
    path = f"{shared_dir(df.sparkSession)}/wrenchlake/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small(df: DataFrame, bound: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``bound`` rows, else as it is (a shuffled join).

    ``df`` should be cheap to count: a stored or checkpointed table of narrow rows.
    """
    return F.broadcast(df) if df.count() <= bound else df


def bounded_batches() -> None:
    """Bound the session's Arrow batches in rows (unless they have fewer) and bytes. Results don't depend on batches."""
    conf = SparkSession.active().conf
    rows = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(rows)) <= BATCH_ROWS:
        conf.set(rows, BATCH_ROWS)
    conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def text_of(col: str) -> Column:
    """The text, null as empty."""
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def id_crc(col: str) -> Column:
    return F.crc32(F.col(col).cast("string").cast("binary"))


def whole_row(df: DataFrame) -> Column:
    """All columns as one struct, whatever their names."""
    return F.struct(*[F.col(f"`{c.replace('`', '``')}`") for c in df.columns])
