"""Reranking of retrieved candidates by BM25 over a stored table of term statistics."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wrenchlake.functions import vectors as V

#: How soon repeats of a term stop counting, and how much a text's length weighs.
K1, B = 1.2, 0.75


def terms(text: Column) -> Column:
    """The lower-cased runs of letters and digits of a text, in order; none of a null text."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda t: t != "")


@dataclass(frozen=True)
class Statistics:
    """``terms(term, df)``, in how many texts a term occurs, and ``corpus(n_docs, mean_length)``, one row. Both lazy."""

    terms: DataFrame
    corpus: DataFrame

    def save(self, path: str) -> None:
        """Replaces what ``path`` holds."""
        self.terms.write.mode("overwrite").parquet(f"{path}/terms")
        self.corpus.write.mode("overwrite").parquet(f"{path}/corpus")

    @staticmethod
    def load(spark: SparkSession, path: str) -> Statistics:
        return Statistics(spark.read.parquet(f"{path}/terms"), spark.read.parquet(f"{path}/corpus"))


def term_statistics(docs: DataFrame, text: str = "text") -> Statistics:
    """Of all rows of ``docs``; null texts are texts without terms. Terms are counted per task before the shuffle, so frequent ones cost no more
    than others."""
    found = docs.select(terms(F.col(text)).alias("terms"))
    df = found.select(F.explode(F.array_distinct("terms")).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    return Statistics(df, found.agg(F.count("*").alias("n_docs"), F.avg(F.size("terms")).alias("mean_length")))


def bm25(pairs: DataFrame, asked: DataFrame, docs: DataFrame, statistics: Statistics, k1: float = K1, b: float = B) -> DataFrame:
    """``(query_id, id, bm25)`` of each distinct ``pairs(query_id, id)``; ``asked(query_id, query_text)``, ``docs(id, text)``.

    A query's repeated terms count once. Only terms that some query asks for are taken from the statistics and only texts of some pair are
    taken apart, each once however many queries it is a candidate of. A pair without a common term, or with a text or query that is
    missing or null, scores 0. Of several texts of one id the longest (then the greatest) counts.
    """
    pairs = pairs.select("query_id", "id").distinct()
    wanted = asked.select("query_id", F.explode(F.array_distinct(terms(F.col("query_text")))).alias("term")).distinct()
    vocabulary = wanted.select("term").distinct()
    n = F.col("n_docs")
    idf = F.log(1 + (n - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weights = statistics.terms.join(vocabulary, "term", "left_semi").crossJoin(F.broadcast(statistics.corpus)).select("term", idf.alias("idf"), "mean_length")  # corpus is one row
    text = docs.join(pairs.select("id").distinct(), "id", "left_semi").groupBy("id").agg(F.max(F.struct(F.length("text").alias("n"), "text"))["text"].alias("text"))
    held = text.select("id", terms(F.col("text")).alias("terms")).select("id", F.size("terms").alias("length"), F.explode("terms").alias("term"))
    counted = held.join(vocabulary, "term", "left_semi").groupBy("id", "term", "length").agg(F.count("*").alias("tf"))
    part = F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("length") / F.col("mean_length")))
    met = pairs.join(wanted, "query_id").join(counted, ["id", "term"]).join(weights, "term").groupBy("query_id", "id").agg(F.sum(part).alias("bm25"))
    return pairs.join(met, ["query_id", "id"], "left").select("query_id", "id", F.coalesce("bm25", F.lit(0.0)).alias("bm25"))


#: From pairs, asked and docs to (query_id, id, rerank_score): what a model of one's own has to offer to take BM25's place.
Scorer = Callable[[DataFrame, DataFrame, DataFrame], DataFrame]


def bm25_scorer(statistics: Statistics) -> Scorer:
    """Scores in (0, 1): the logistic function of BM25, so 0.5 without a common term."""

    def score(pairs: DataFrame, asked: DataFrame, docs: DataFrame) -> DataFrame:
        return bm25(pairs, asked, docs, statistics).select("query_id", "id", V.sigmoid(F.col("bm25")).alias("rerank_score"))

    return score


def rerank(candidates: DataFrame, asked: DataFrame, docs: DataFrame, scorer: Scorer | None, top_k: int, order: str = "rank") -> DataFrame:
    """The first ``top_k`` candidates of each query by ``order``, with ``rerank_score`` and by it ranked anew.

    ``candidates(query_id, id, <order>, ...)`` have one row a query and id. Only those first ones are scored. One the scorer leaves out has 0. Equal scores keep their
    order. Without a scorer all score 0 and nothing is reordered; with ``top_k`` of 0 or less nothing is left.
    """
    if top_k <= 0:
        return candidates.limit(0).withColumn("rerank_score", F.lit(0.0))
    by = lambda *columns: F.row_number().over(Window.partitionBy("query_id").orderBy(*columns))
    first = candidates.withColumn(order, by(F.asc(order), F.asc("id"))).where(F.col(order) <= top_k)
    if scorer is None:
        return first.withColumn("rerank_score", F.lit(0.0))
    scored = first.join(scorer(first.select("query_id", "id"), asked, docs), ["query_id", "id"], "left")
    scored = scored.withColumn("rerank_score", F.coalesce("rerank_score", F.lit(0.0)))
    return scored.withColumn(order, by(F.desc("rerank_score"), F.asc(order)))
