"""Mixing sources to target weights: budgets met by bounded knapsack over exact lengths."""

from __future__ import annotations

from math import gcd

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wrenchlake.llm.common import small, stored, text_of, whole_row

#: The remaining budget, in words, that dynamic programming fits first; what exceeds it is taken in proportion before.
DP_WORDS = 1 << 15
#: The remaining budget that dynamic programming fits where the smaller windows miss the budget, some 100 MB of one task. Few lengths need it.
MOST_WORDS = 1 << 24
#: Hash ranges that rows of one source and length are ranked in, so that a hot length isn't ranked by one task.
RANGES = 256
SEED = 20240


def split_budget(sizes: list[int], weights: list[float], share: float = 1.5, most: float = 2.0) -> list[float]:
    """Targets: ``share`` of all sizes by weight, each at most ``most`` times its source's size, the excess reshared
    by weight among the sources below their limit until none is above."""
    left, open_, out = share * sum(sizes), set(range(len(sizes))), [0.0] * len(sizes)
    while open_ and left > 0:
        unit = left / sum(weights[i] for i in open_)
        full = [i for i in sorted(open_) if unit * weights[i] >= most * sizes[i]]
        for i in full or sorted(open_):
            out[i] = float(most * sizes[i]) if full else unit * weights[i]
            open_.discard(i)
        left = share * sum(sizes) - sum(out) if full else 0
    return out


def _reachable(room: dict[int, int], budget: int) -> tuple[int, dict[int, int]]:
    """The largest sum of at most ``room`` lengths within ``budget``, and the counts that make it.

    Counts are split into powers of two, each an item to take or leave; of every sum the item is noted that first reached it, so following the
    items back gives the counts. Five bytes a word of the budget, and some for the step at hand."""
    reach, first, items = np.zeros(budget + 1, bool), np.full(budget + 1, -1, np.int32), []
    reach[0] = True
    for n in sorted((n for n in room if n <= budget), reverse=True):
        free, group = min(room[n], budget // n), 1
        while free > 0:
            k = min(group, free)
            new = np.flatnonzero(reach[: budget + 1 - n * k] & ~reach[n * k :]) + n * k
            reach[new], first[new] = True, len(items)
            items.append((n, k))
            free, group = free - k, group * 2
        if reach[budget]:
            break
    best = at = int(np.flatnonzero(reach)[-1])
    take: dict[int, int] = {}
    while at:
        n, k = items[first[at]]
        take[n], at = take.get(n, 0) + k, at - n * k
    return best, take


def fit_counts(counts: dict[int, int], budget: int, dp_words: int = DP_WORDS, most_words: int = MOST_WORDS) -> dict[int, int]:
    """How many documents of each length to take so that their lengths sum to ``budget`` or as near below it as can be reached.

    A budget of at most ``dp_words`` is met by a bounded knapsack over all lengths. Of a larger one most is taken in proportion from every
    length, so the lengths stay mixed as they are, and the knapsack fits the rest from what is left; where that misses, more of the
    proportional part is given back: first windows of ``dp_words`` and less, which many lengths meet exactly, then
    one of ``most_words``, which is the whole budget unless it is larger. So the sum is the best reachable of every budget up to ``most_words``, and of
    larger ones too if it is the budget itself. All is counted in the lengths' common divisor.
    """
    counts = {n: c for n, c in counts.items() if n > 0 and c > 0}
    total = sum(n * c for n, c in counts.items())
    if budget >= total:
        return counts
    unit = gcd(*counts)
    if unit > 1:
        return {n * unit: c for n, c in fit_counts({n // unit: c for n, c in counts.items()}, budget // unit, dp_words, most_words).items()}
    if budget <= dp_words:
        return _reachable(counts, budget)[1]
    best: tuple[int, dict[int, int]] = (-1, {})
    for window in (dp_words // 64, dp_words // 8, dp_words, most_words):
        part = max(0, budget - window)
        take = {n: c * part // total for n, c in counts.items()}
        rest = budget - sum(n * c for n, c in take.items())
        # rounding down leaves more than the window: fill up, longest first
        for n in sorted(counts, reverse=True):
            if rest <= window:
                break
            more = min(counts[n] - take[n], (rest - window + n - 1) // n, rest // n)
            take[n], rest = take[n] + more, rest - more * n
        if rest > most_words:
            continue
        got, more = _reachable({n: c - take[n] for n, c in counts.items()}, rest)
        reached = budget - rest + got
        if reached > best[0]:
            best = (reached, {n: take[n] + more.get(n, 0) for n in take})
        if reached == budget:
            break
    if best[0] < 0:  # only lengths beyond every window
        best = (0, take)
    return {n: c for n, c in best[1].items() if c}


def mix(docs: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, most: int = 2, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """``(doc_id, source, size, source_size, target, taken, text_key)`` per row of ``docs``.

    ``size`` is the number of words (null text: 0), ``taken`` a multiple of it: whole repeats of the source, and
    once more for the documents that fill the remaining budget. Those are chosen by counts of exact lengths: each
    source's histogram is solved in a task of its own, then documents of a (source, length) are ranked by a seeded
    hash, ties by id, and the first so many are taken. Ranking is by ranges of the hash, so no length of any source
    is gathered whole. The driver sees one row per source: sources are few. Null source is a source of its own,
    last; null ids are ranked like others; rows equal in id and text are interchangeable.
    """
    spark = docs.sparkSession
    size = F.when(F.trim(F.translate(text_of(text_col), "\t\n\x0b\x0c\r", "     ")) == "", 0).otherwise(
        F.size(F.split(F.trim(F.translate(text_of(text_col), "\t\n\x0b\x0c\r", "     ")), " +"))
    )
    key = F.xxhash64(text_of(text_col))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), size.cast("long").alias("size"), key.alias("text_key"))
    rows = rows.withColumn("draw", F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("text_key")))
    rows = stored(rows.withColumn("range", F.pmod(F.shiftright("draw", 40), F.lit(RANGES)).cast("int")), "mix-rows")

    by_source = [(r[0], r[1]) for r in rows.groupBy("source").agg(F.sum("size")).collect()]
    by_source.sort(key=lambda r: (r[0] is None, r[0] or ""))
    sizes = [n for _, n in by_source]
    targets = split_budget(sizes, [weights[i % len(weights)] for i in range(len(sizes))], share, most)
    plan = []
    for (source, n), target in zip(by_source, targets):
        times = min(most, int(target // n)) if n else 0
        plan.append((source, n, target, times, 0 if times >= most else round(target - times * n)))
    plan_df = F.broadcast(spark.createDataFrame(plan, "p_source string, source_size long, target double, times int, budget long"))  # a row per source
    same = F.col("source").eqNullSafe(F.col("p_source"))

    lengths = rows.where("size > 0").groupBy("source", "size", "range").agg(F.count("*").alias("n"))
    lengths = stored(lengths, "mix-lengths")
    histogram = lengths.groupBy("source", "size").agg(F.sum("n").alias("n"))
    solved = histogram.join(plan_df, same).where("budget > 0")

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        take = fit_counts(dict(zip(pdf["size"].tolist(), pdf["n"].tolist())), int(pdf["budget"].iloc[0])) or {0: 0}
        return pd.DataFrame({"t_source": [pdf["source"].iloc[0]] * len(take), "t_size": list(take), "take": list(take.values())}).astype({"t_size": "int64", "take": "int64"})

    take = solved.groupBy("source").applyInPandas(solve, "t_source string, t_size long, take long")
    up_to = Window.partitionBy("source", "size").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    before = lengths.withColumn("before", F.coalesce(F.sum("n").over(up_to), F.lit(0)))
    quota = before.join(take, F.col("source").eqNullSafe(F.col("t_source")) & (F.col("size") == F.col("t_size"))).select(
        F.col("source").alias("q_source"), F.col("size").alias("q_size"), F.col("range").alias("q_range"), (F.col("take") - F.col("before")).alias("quota")
    ).where("quota > 0")
    rank = Window.partitionBy("source", "size", "range").orderBy("draw", "doc_id")
    ranked = rows.withColumn("nth", F.row_number().over(rank))
    drawn = ranked.join(quota, F.col("source").eqNullSafe(F.col("q_source")) & (F.col("size") == F.col("q_size")) & (F.col("range") == F.col("q_range")), "left")
    chosen = drawn.withColumn("once_more", F.coalesce((F.col("nth") <= F.col("quota")).cast("int"), F.lit(0)))
    out = chosen.join(plan_df, same)
    return out.select("doc_id", "source", "size", "source_size", "target", ((F.col("times") + F.col("once_more")) * F.col("size")).cast("long").alias("taken"), "text_key", (F.col("times") + F.col("once_more")).alias("times"))


def apply_mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **how) -> DataFrame:
    """``docs`` with each row as often as the mix takes it: 0, 1 or 2 times; columns as they are, whatever their names. A document
    without words is taken as often as its source is taken whole. Rows equal in id, source and text share what the mix takes of them
    exactly: each as often as all are whole, and the first few once more. Null ids, texts and sources count like others. An
    empty table gives an empty one."""
    mixed = mix(docs, id_col=id_col, text_col=text_col, source_col=source_col, **how)
    times = mixed.groupBy("doc_id", "source", "text_key").agg(F.sum("times").alias("times"), F.count("*").alias("rows")).where("times > 0")
    times = small(stored(times.toDF("t_id", "t_source", "t_key", "times", "rows"), "mix-times"))
    row = F.col("row")  # the whole row as one value, so that no name of its columns meets one of ours
    rows = docs.select(whole_row(docs).alias("row")).select("row", row[id_col].alias("id"), row[source_col].cast("string").alias("of"), F.xxhash64(F.coalesce(row[text_col].cast("string"), F.lit(""))).alias("key"))
    same = F.col("id").eqNullSafe(F.col("t_id")) & F.col("of").eqNullSafe(F.col("t_source")) & (F.col("key") == F.col("t_key"))
    joined = rows.join(times, same)
    even = joined.where("times % rows = 0").select("row", F.expr("int(times div rows)").alias("n"))
    nth = F.row_number().over(Window.partitionBy("id", "of", "key").orderBy(F.lit(1)))  # of equal rows, few or none
    odd = joined.where("times % rows <> 0").withColumn("nth", nth).select("row", F.expr("int(times div rows) + int(nth <= times % rows)").alias("n"))
    return even.unionByName(odd).where("n > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("copy")).select([row[c].alias(c) for c in docs.columns])
