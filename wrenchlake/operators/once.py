"""Dear functions computed once for each distinct input."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wrenchlake.shared import kept


def compute_once(rows: DataFrame, inputs: str, result: str, function: Callable[[Column], Column], known: DataFrame | None = None) -> DataFrame:
    """``rows`` with ``result``: the function of the column ``inputs``, evaluated once for each distinct value, however often it comes.

    Distinct values are found per task first, evaluated, stored, and joined back (null is a value). ``known(<inputs>, <result>)``, one row a value, are results of earlier runs: they are used
    and not evaluated again. The results are stored so that no retry and no second use of the plan evaluates anew.
    """
    values = rows.select(F.col(inputs).alias("__value")).distinct()
    old = None
    if known is not None:
        old = known.select(F.col(inputs).alias("__value"), F.col(result).alias("__result"))
        values = values.join(old.select("__value"), values["__value"].eqNullSafe(old["__value"]), "left_anti")
    # a shuffle stands between the distinct values and the function, so that it runs on rows that are distinct over all tasks
    made = kept(values.select("__value", function(F.col("__value")).alias("__result")), "once")
    table = made if old is None else made.unionByName(old)
    table = table.withColumnRenamed("__value", "__key")
    return rows.join(table, rows[inputs].eqNullSafe(table["__key"]), "left").drop("__key").withColumnRenamed("__result", result)
