"""Feedback statistics, ratings, trends, sessions and request limits."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wrenchlake.shared import small


def blended_score(avg_rating: Column, success: Column, partial: Column, outcomes: Column) -> Column:
    """0.6 of the scaled rating and 0.4 of the outcome rate; either alone if the other is missing; in [0, 1]."""
    rating = (avg_rating - 1) / 4
    rate = (success + 0.5 * partial) / F.nullif(outcomes, F.lit(0))
    blend = F.when(rating.isNotNull() & rate.isNotNull(), 0.6 * rating + 0.4 * rate).otherwise(F.coalesce(rating, rate))
    return F.when(blend.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), blend)))


def statistics(entries: DataFrame) -> DataFrame:
    """One row of counts, mean rating, distinct entities and coverage of ``entries(entity, rating, outcome)``."""
    return entries.agg(
        F.count("*").alias("n"),
        F.count("rating").alias("n_rated"),
        F.coalesce(F.avg("rating"), F.lit(0.0)).alias("avg_rating"),
        F.count_distinct("entity").alias("n_entities"),
        F.count_if(F.col("outcome") == "success").alias("n_success"),
        F.count_if(F.col("outcome") == "failure").alias("n_failure"),
        F.count_if(F.col("outcome") == "partial").alias("n_partial"),
        F.coalesce(F.count("rating") / F.nullif(F.count("*"), F.lit(0)), F.lit(0.0)).alias("coverage"),
    )


def corrections(sessions: DataFrame, by: list[str]) -> DataFrame:
    """By group the sessions and those with ``corrections`` that aren't null; an empty list counts."""
    return sessions.groupBy(*by).agg(F.count("*").alias("n_sessions"), F.count("corrections").alias("n_corrected"))


def memory_statistics(memory: DataFrame) -> DataFrame:
    """One row of patterns, records and records a pattern (0 without patterns) of ``memory(codes_key, doc_ids)``."""
    n = F.coalesce(F.sum(F.size("doc_ids")), F.lit(0))
    return memory.agg(F.count("*").alias("n_patterns"), n.alias("n_records"), F.coalesce(n / F.nullif(F.count("*"), F.lit(0)), F.lit(0.0)).alias("mean_records"))


def token_costs(calls: DataFrame, prices: DataFrame, by: list[str]) -> DataFrame:
    """By group the tokens and their cost, of ``calls(kind, tokens, ...)`` and ``prices(kind, price)``, a price for a million tokens; kinds without one cost nothing. Kinds
    are few; their prices are broadcast after a check of their number."""
    priced = calls.join(small(prices.groupBy("kind").agg(F.max("price").alias("price"))), "kind", "left")
    cost = F.coalesce(F.col("price"), F.lit(0.0)) * F.col("tokens") / 1e6
    return priced.groupBy(*by).agg(F.count("*").alias("n_calls"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("n_tokens"), F.coalesce(F.sum(cost), F.lit(0.0)).alias("cost"))


def newest(rows: DataFrame, order: str, key: str, limit: int | None = None, **wanted) -> DataFrame:
    """Rows whose columns have the wanted values (none: any), newest first, ties by key, null times last; the first ``limit``."""
    for column, value in wanted.items():
        rows = rows if value is None else rows.where(F.col(column) == value)
    out = rows.orderBy(F.desc_nulls_last(order), F.asc(key))
    return out if limit is None else out.limit(limit)


def ratings(entries: DataFrame, below: float | None = None) -> DataFrame:
    """Counts, mean rating and blended score of each entity; ``below`` keeps lower means and drops those of none."""
    if below is not None and not 1 <= below <= 5:
        raise ValueError("the threshold must be from 1 to 5")
    is_ = lambda o: F.count_if(F.col("outcome") == o)
    agg = entries.groupBy("entity").agg(
        F.avg("rating").alias("avg_rating"), F.count("*").alias("n"), is_("success").alias("n_success"), is_("failure").alias("n_failure"), is_("partial").alias("n_partial"),
        F.count_if(F.coalesce(F.col("outcome"), F.lit("")) != "").alias("n_outcomes"),
    )
    out = agg.withColumn("score", blended_score(F.col("avg_rating"), F.col("n_success"), F.col("n_partial"), F.col("n_outcomes")))
    return out.where(F.col("avg_rating") < below) if below is not None else out


def trends(sessions: DataFrame, entries: DataFrame, granularity: str) -> DataFrame:
    """By day, Monday week or month: sessions, and the ratings and outcomes of entries in periods that have sessions.

    ``sessions(ts, outcome)``, ``entries(ts, rating, outcome)``; rows without a time are passed over.
    """
    if granularity not in ("day", "week", "month"):
        raise ValueError(granularity)
    period = F.date_format(F.date_trunc(granularity, "ts"), "yyyy-MM-dd")
    s = sessions.where("ts is not null").groupBy(period.alias("period")).agg(F.count("*").alias("n_sessions"), F.count_if(F.col("outcome") == "success").alias("s_success"))
    f = entries.where("ts is not null").groupBy(period.alias("period")).agg(F.count("rating").alias("n_ratings"), F.sum("rating").alias("sum_ratings"), F.count_if(F.col("outcome") == "success").alias("f_success"))
    j = s.join(f, "period", "left")
    return j.select(
        "period", "n_sessions", F.coalesce("n_ratings", F.lit(0)).alias("n_ratings"), (F.col("sum_ratings") / F.col("n_ratings")).alias("avg_rating"),
        (F.col("s_success") + F.coalesce("f_success", F.lit(0))).alias("n_success"),
    )


def tier_limits(rows: DataFrame, key: str, tiers: DataFrame, guest: str = "3/day", ip: str = "1000/minute", none: str = "1/day") -> DataFrame:
    """The limit string of each key: by prefix, or by the tier of the named user (``tiers(user, per_minute, per_hour, per_day)``).

    Unknown keys and users get ``0/minute``; a user of no tier (all null) gets ``none``.
    """
    name = F.lower(F.trim(F.substring(F.col(key), F.lit(len("ratelimit:") + 1), F.length(key))))
    part = lambda c, unit: F.when(F.col(c) > 0, F.concat(F.col(c).cast("string"), F.lit(f"/{unit}")))
    listed = F.concat_ws(",", part("per_minute", "minute"), part("per_hour", "hour"), part("per_day", "day"))
    t = tiers.select(F.col("user").alias("__user"), F.col("per_minute").isNull().alias("__none"), listed.alias("__listed"))
    joined = rows.withColumn("__name", name).join(t, F.col("__name") == F.col("__user"), "left")
    limit = (
        F.when(F.col(key).startswith("guest:"), guest)
        .when(F.col(key).startswith("ratelimit:ip:"), ip)
        .when(~F.col(key).startswith("ratelimit:") | F.col("__user").isNull(), "0/minute")
        .when(F.col("__none"), none)
        .when(F.col("__listed") == "", "0/minute")
        .otherwise(F.col("__listed"))
    )
    return joined.withColumn("limit", F.coalesce(limit, F.lit("0/minute"))).drop("__name", "__user", "__none", "__listed")


def sliding_limit(requests: DataFrame, client: str, ts: str, tie: str, most: int = 60, seconds: float = 60.0) -> DataFrame:
    """Which requests a trailing-window limiter accepts; rejected ones are not counted, so each decision
    depends on those before.

    State is the client's accepted times within the window, ``most`` at most. Rows are dealt by client and sorted by time in
    Spark; a task streams over them, so a busy client needs no more memory than a quiet one.
    """
    ordered = requests.repartition(F.col(client)).sortWithinPartitions(client, ts, tie)
    schema = requests.select("*").withColumn("accepted", F.lit(True)).schema

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, held = object(), deque()
        for pdf in batches:
            out = []
            for who, at in zip(pdf[client], pdf[ts]):
                if who != current:
                    current, held = who, deque()
                while held and (at - held[0]).total_seconds() >= seconds:
                    held.popleft()
                out.append(len(held) < most)
                if out[-1]:
                    held.append(at)
            yield pdf.assign(accepted=out)

    return ordered.mapInPandas(run, schema)


def session_rounds(turns: DataFrame, most: int = 3) -> DataFrame:
    """L2, L3: of ``turns(conv_id, turn, role, text)``: questions and answers, and rounds = max(1, answers div ``most``) if any."""
    agg = turns.groupBy("conv_id").agg(F.count_if(F.col("role") == "assistant").alias("n_questions"), F.count_if(F.col("role") == "user").alias("n_answers"))
    return agg.withColumn("rounds", F.when(F.col("n_answers") > 0, F.greatest(F.lit(1).cast("long"), F.expr(f"n_answers div {most}"))).otherwise(0).cast("long"))


def expired(sessions: DataFrame, created: str, fallback: str, now: Column, hours: int = 24) -> DataFrame:
    """L4: sessions whose creation (else last time) is more than ``hours`` before ``now``."""
    return sessions.where(F.coalesce(F.col(created), F.col(fallback)) + F.expr(f"interval {hours} hours") < now)
