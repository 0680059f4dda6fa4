"""Appends that can be repeated: a run replaces what it wrote before and nothing else."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def append_run(rows: DataFrame, path: str, run_id: str) -> None:
    """Write ``rows`` as the part ``run_id`` of the table at ``path``.

    Only that part is replaced (dynamic partition overwrite), when the job commits: a run that failed halfway leaves the table as it was, and repeating a run leaves
    each row once. Runs of other ids may write at the same time. No rows: the part stays as it is.
    """
    rows.withColumn("run_id", F.lit(run_id)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_id").parquet(path)


def runs(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """All runs' rows with ``run_id`` as text; none where nothing has been written."""
    try:
        return spark.read.schema(f"{schema}, run_id string").parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], f"{schema}, run_id string")


def add_new(rows: DataFrame, path: str, keys: list[str], run_id: str) -> None:
    """Append the rows of keys that the table's other runs don't have, once each: a log of what is done. A null key is a key like any other; a run that is
    repeated writes the same rows, as its own part doesn't count as done before."""
    fields = ", ".join(f"`{n}` {t}" for n, t in rows.dtypes)
    done = runs(rows.sparkSession, path, fields).where(F.col("run_id") != run_id).select(*keys).distinct()
    same = F.lit(True)
    for k in keys:
        same = same & rows[k].eqNullSafe(done[k])
    append_run(rows.join(done, same, "left_anti").dropDuplicates(keys), path, run_id)
