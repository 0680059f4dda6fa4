"""The whole retrieval as one plan: filter, neighbours, rerank, graph scores, feedback, fusion, best per group."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wrenchlake.operators import reranker as K
from wrenchlake.operators import retrieval as R


@dataclass(frozen=True)
class Config:
    """Caps of the stages, threshold and weights; checked when made."""

    initial_k: int = 20
    rerank_k: int = 10
    final_k: int = 5
    min_similarity: float = 0.5
    rerank: bool = False
    weights: dict[str, float] = field(default_factory=lambda: dict(R.WEIGHTS))

    def __post_init__(self) -> None:
        R.checked_weights(self.weights)
        if min(self.initial_k, self.rerank_k, self.final_k) < 1:
            raise ValueError("caps must be positive")


def retrieve(items: DataFrame, queries: DataFrame, graph_scores: DataFrame, feedback_scores: DataFrame, config: Config = Config(), scorer: K.Scorer | None = None) -> DataFrame:
    """``(query_id, rank, id, procedure_id, score, combined_score)``.

    ``items(id, vec, procedure_id, title, ...)``, ``queries(query_id, query_vec, query_text)``,
    ``graph_scores(query_id, procedure_id, kg_score)`` (the maximum of several counts), ``feedback_scores(procedure_id, feedback_score)``.
    With ``config.rerank`` the first ``rerank_k`` neighbours are scored by ``scorer``, by default BM25 with statistics of all items. An item's
    text is its column ``text``, if there is one and it isn't blank, else its title; a query without text asks by its ``codes``, if there
    are any, joined by commas.
    """
    near = R.knn(items, queries.select("query_id", "query_vec"), config.initial_k, config.min_similarity)
    if config.rerank:
        blank = lambda c: F.nullif(F.trim(c), F.lit(""))
        docs = items.select("id", F.coalesce(*[blank(F.col(c)) for c in ("text", "title") if c in items.columns]).alias("text"))
        codes = [F.array_join("codes", ", ")] if "codes" in queries.columns else []
        asked = queries.select("query_id", F.coalesce("query_text", *codes).alias("query_text"))
        scorer = scorer or K.bm25_scorer(K.term_statistics(docs))
        near = K.rerank(near, asked, docs, scorer, config.rerank_k)
    else:
        near = K.rerank(near, queries, items, None, config.rerank_k)
    graph = graph_scores.groupBy("query_id", "procedure_id").agg(F.max("kg_score").alias("kg_score"))
    joined = near.join(graph, ["query_id", "procedure_id"], "left").join(feedback_scores, "procedure_id", "left")
    best = R.best_per_group(R.fuse(joined.drop("rank"), config.weights), "procedure_id")
    return R.top_k(best, config.final_k, by="combined_score").select("query_id", "rank", "id", "procedure_id", "score", "combined_score")
