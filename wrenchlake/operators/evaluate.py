"""Retrieval quality: hits, reciprocal ranks, comparisons, weight search, samples."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wrenchlake.operators import blocks as K
from wrenchlake.operators.retrieval import top_k
from wrenchlake.shared import kept, small

#: Weight vectors that one search may try.
GRID_ROWS = 10_000


def rank_of(ids: Column, expected: Column) -> Column:
    """The 1-based place of the expected id among the distinct ids, 0 if missing. Chunk suffixes are cut off."""
    plain = F.transform(ids, lambda i: F.regexp_replace(i, "_chunk_[0-9]+$", ""))
    return F.coalesce(F.array_position(F.array_distinct(plain), expected), F.lit(0))


def hits(ranks: DataFrame, at: tuple[int, ...] = (1, 5, 10)) -> DataFrame:
    """Mean hits at each cut and mean reciprocal rank of ``ranks(rank)``; 0 is a miss."""
    r = F.col("rank")
    return ranks.agg(F.count("*").alias("n"), *[F.avg(F.when((r > 0) & (r <= k), 1.0).otherwise(0.0)).alias(f"hit_at_{k}") for k in at], F.avg(F.when(r > 0, 1.0 / r).otherwise(0.0)).alias("mrr"))


def compare(pairs: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Means, population deviations, paired difference, relative change in percent, wins and losses of b over a."""
    A, B = F.col(a), F.col(b)
    return pairs.agg(
        F.count("*").alias("n"), F.avg(A).alias("mean_a"), F.avg(B).alias("mean_b"), F.stddev_pop(A).alias("std_a"), F.stddev_pop(B).alias("std_b"),
        F.avg(B - A).alias("mean_diff"), (100 * F.avg(B - A) / F.nullif(F.avg(A), F.lit(0.0))).alias("relative_pct"),
        F.count_if(B > A).alias("wins"), F.count_if(B < A).alias("losses"),
    )


def grid(spark, steps: tuple[float, ...] = (0.3, 0.4, 0.5), last_most: float = 0.5) -> DataFrame:
    """Weight vectors of three free weights, the fourth what is left to 1, between 0 and ``last_most``."""
    rows = [(round(a, 6), round(b, 6), round(c, 6), round(1 - a - b - c, 6)) for a in steps for b in steps for c in steps]
    return spark.createDataFrame([(i, *r) for i, r in enumerate(r for r in rows if 0 <= r[3] <= last_most)], "grid_no int, w1 double, w2 double, w3 double, w4 double")


def grid_search(candidates: DataFrame, weights: DataFrame, k: int = 5) -> DataFrame:
    """Hit@k of each weight vector; ``candidates(query_id, id, relevant, s1, s2, s3, s4)``.

    The grid is broadcast after a check of its size; candidates are ranked again under each of its rows.
    """
    if weights.limit(GRID_ROWS + 1).count() > GRID_ROWS:
        raise ValueError(f"more than {GRID_ROWS} weight vectors")
    every = candidates.crossJoin(F.broadcast(weights))
    score = sum((F.col(f"w{i}") * F.col(f"s{i}") for i in (2, 3, 4)), F.col("w1") * F.col("s1"))
    w = Window.partitionBy("grid_no", "query_id").orderBy(F.desc("__s"), "id")
    top = every.withColumn("__s", score).withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= k)
    per = top.groupBy("grid_no", "query_id").agg(F.max(F.col("relevant").cast("int")).alias("hit"))
    return per.groupBy("grid_no").agg(F.avg(F.col("hit").cast("double")).alias("hit_rate"))


def grid_views(weights: DataFrame, terms: Callable, kept: Callable) -> list[K.View]:
    """The scores of ``grid_search`` as views, one a weight vector: ``terms`` gives the four of a tile, ``kept`` the pairs that take part."""
    rows = weights.limit(GRID_ROWS + 1).collect()
    if len(rows) > GRID_ROWS:
        raise ValueError(f"more than {GRID_ROWS} weight vectors")

    def view(w1: float, w2: float, w3: float, w4: float) -> K.View:
        def score(s: np.ndarray, item: K.Columns, query: K.Columns) -> np.ndarray:
            s1, s2, s3, s4 = terms(s, item)
            return w1 * s1 + w2 * s2 + w3 * s3 + w4 * s4

        return K.where(kept, score)

    return [view(r.w1, r.w2, r.w3, r.w4) for r in rows]


def rank_change(scored: DataFrame, boosted: Column, most: int = 10) -> DataFrame:
    """the ``most`` best of each query after a boost, with ``rank_after``, ``rank_before`` and ``gain``, the places won. Ties go to smaller ids.

    The best are found by limited groups; their ranks before are one more than the rows counted ahead of each, ``most`` counts a query, added up
    per task. No task sees all rows of a query.
    """
    best = kept(top_k(scored.withColumn("boosted", boosted), most, by="boosted", rank="rank_after"), "boosted")
    places = best.groupBy("query_id").agg(F.map_from_entries(F.collect_list(F.struct("rank_after", F.struct("score", "id")))).alias("at"))  # most entries a query
    met = scored.select("query_id", "score", "id").join(small(places), "query_id")
    own = lambda k: F.try_element_at("at", F.lit(k))
    ahead = lambda k: (F.col("score") > own(k)["score"]) | ((F.col("score") == own(k)["score"]) & (F.col("id") < own(k)["id"]))
    counts = met.groupBy("query_id").agg(F.array(*[F.count_if(ahead(k)) for k in range(1, most + 1)]).alias("ahead"))
    out = best.join(counts, "query_id").withColumn("rank_before", (F.element_at("ahead", F.col("rank_after")) + 1).cast("int")).drop("ahead")
    return out.withColumn("gain", F.col("rank_before") - F.col("rank_after"))


def vector_rank_change(items: DataFrame, queries: DataFrame, view: K.View, boosted: Column, most: int = 10) -> DataFrame:
    """``rank_change`` of the similarities of ``queries(query_id, query_vec)`` with ``items(id, vec, ...)``; ``view`` gives the same numbers as ``boosted``.

    The ``most`` best of each query are found in a first pass over the tiles, the items ahead of them counted in a second.
    """
    found = K.nearest(items, queries, most, view).drop("by_view")
    best = kept(top_k(found.withColumn("boosted", boosted), most, by="boosted", rank="rank_after"), "boosted")
    own = lambda k, c: F.max(F.when(F.col("rank_after") == k, F.col(c))).alias(f"{c}_{k}")
    places = best.groupBy("query_id").agg(*[own(k, c) for k in range(1, most + 1) for c in ("score", "id")])
    counts = K.counted_ahead(items, queries.join(places, "query_id"), most).withColumnRenamed("nth", "rank_after")
    out = best.join(counts, ["query_id", "rank_after"]).withColumn("rank_before", (F.col("ahead") + 1).cast("int")).drop("ahead")
    return out.withColumn("gain", F.col("rank_before") - F.col("rank_after"))


def stratified(rows: DataFrame, strata: list[tuple[str, Column, int]], order: list[Column], key: str) -> DataFrame:
    """the first so many rows of each stratum; a row counts for the first stratum that takes it (no repeats)."""
    every = None
    for i, (name, where, n) in enumerate(strata):
        part = rows.where(where).orderBy(*order).limit(n).withColumn("stratum", F.lit(name)).withColumn("__i", F.lit(i))
        every = part if every is None else every.unionByName(part)
    first = Window.partitionBy(key).orderBy("__i")
    return every.withColumn("__n", F.row_number().over(first)).where("__n = 1").drop("__n", "__i")


def seeded_sample(rows: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """``n`` rows by a seeded hash of the key; the same on every run."""
    return rows.orderBy(F.sha2(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")), 256), key).limit(n)


def is_validation(key: Column, seed: int = 42, percent: int = 20) -> Column:
    """A split by a seeded hash of the key; a null key counts as an empty one."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % 100 < percent
