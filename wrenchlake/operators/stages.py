"""Ordered stages as column rules, with counts and reasons of what each drops, from the same pass."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Stage:
    """A rule that rows must pass and, optionally, columns that it sets for the rows that do. A null rule counts as not passed."""

    name: str
    keep: Column
    sets: tuple[tuple[str, Column], ...] = ()


@dataclass(frozen=True)
class Chain:
    """``rows``: all rows with ``dropped_by``, the stage that dropped each, null for those that stay. ``counts``: filled by the first job that computes them."""

    rows: DataFrame
    counts: Observation
    names: tuple[str, ...]

    def kept(self) -> DataFrame:
        return self.rows.where("dropped_by is null").drop("dropped_by")

    def report(self) -> list[tuple[str, int, int]]:
        """(stage, rows in, rows dropped), in order; waits for the job that computes the rows."""
        got, out = self.counts.get, []
        left = got["rows"]
        for k, name in enumerate(self.names):
            out.append((name, left, got[f"dropped_{k}"]))
            left -= got[f"dropped_{k}"]
        return out


def chain(rows: DataFrame, stages: Sequence[Stage], name: str = "stages") -> Chain:
    """Run each row through the stages in order until one drops it. Everything is one projection: no stage costs a pass, and the counts are
    taken by ``observe`` where the rows are made, so they are those of the very rows that come out."""
    out = rows.withColumn("dropped_by", F.lit(None).cast("string"))
    for stage in stages:
        passed = F.coalesce(stage.keep, F.lit(False))
        out = out.withColumn("dropped_by", F.when(F.col("dropped_by").isNull() & ~passed, F.lit(stage.name)).otherwise(F.col("dropped_by")))
        alive = F.col("dropped_by").isNull()
        for column, value in stage.sets:
            before = F.col(f"`{column}`") if column in out.columns else F.lit(None)
            out = out.withColumn(column, F.when(alive, value).otherwise(before))
    counts = Observation(name)
    each = [F.count_if(F.coalesce(F.col("dropped_by") == s.name, F.lit(False))).alias(f"dropped_{k}") for k, s in enumerate(stages)]
    return Chain(out.observe(counts, F.count(F.lit(1)).alias("rows"), *each), counts, tuple(s.name for s in stages))
