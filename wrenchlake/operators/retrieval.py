"""Batched retrieval: nearest neighbours, fusion, grouping, merging, feedback boosts."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wrenchlake.functions import vectors as V
from wrenchlake.operators import blocks as K
from wrenchlake.shared import kept, small

WEIGHTS = {"embedding_similarity": 0.4, "rerank_score": 0.3, "kg_path_score": 0.2, "feedback_score": 0.1}
#: Query rows that are broadcast; more are dealt into blocks of about as many.
QUERY_ROWS = 100_000


def checked_weights(weights: dict[str, float]) -> dict[str, float]:
    """Weights divided by their sum; negative or all-zero weights are an error."""
    total = sum(weights.values())
    if min(weights.values()) < 0 or total == 0:
        raise ValueError("weights must be non-negative and not all zero")
    return {k: v / total for k, v in weights.items()}


def similarities(items: DataFrame, queries: DataFrame) -> DataFrame:
    """Every item's cosine with every query: a stated query set against all rows.

    Up to ``QUERY_ROWS`` queries (``query_id, query_vec``) are broadcast, so that items are neither shuffled nor collected. More are dealt into blocks of about that
    many: a task then meets one block with one part of the items, each of them some rows, however many there are of either. Items have ``id, vec``
    and more. Vectors of other sizes or without length have none.
    """
    q = queries.select("query_id", V.normalize(F.col("query_vec")).alias("query_vec"))
    unit = items.withColumn("__unit", V.normalize(F.col("vec")))
    n = q.count()
    if n <= QUERY_ROWS:
        joined = unit.crossJoin(F.broadcast(q))  # checked just above
    else:
        blocks, parts = -(-n // QUERY_ROWS), int(items.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        every = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
        dealt = q.withColumn("__block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int")).withColumn("__part", every(parts))
        spread = unit.withColumn("__part", F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int")).withColumn("__block", every(blocks))
        joined = spread.join(dealt, ["__block", "__part"]).drop("__block", "__part")
    joined = joined.where(F.size("__unit") == F.size("query_vec"))
    return joined.withColumn("score", V.dot(F.col("__unit"), F.col("query_vec"))).drop("__unit", "query_vec", "vec")


def top_k(scored: DataFrame, k: int, by: str = "score", tie: str = "id", group: str = "query_id", rank: str = "rank") -> DataFrame:
    """G1: the best ``k`` of each query; Spark limits each task's groups before the shuffle."""
    w = Window.partitionBy(group).orderBy(F.desc_nulls_last(by), F.asc(tie))
    return scored.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= k)


def knn(items: DataFrame, queries: DataFrame, k: int, min_similarity: float = 0.0) -> DataFrame:
    """The ``k`` nearest items of each query at a similarity of at least ``min_similarity`` (if above 0).

    All pairs are compared, but only the best of each block and part leave a task.
    """
    found = K.nearest(items, queries.select("query_id", "query_vec"), k).drop("by_view")
    return top_k(found.where(F.col("score") >= min_similarity) if min_similarity > 0 else found, k)


def filtered_or_all(items: DataFrame, queries: DataFrame, matches: Callable[[K.Columns, K.Columns], np.ndarray], k: int) -> DataFrame:
    """C4: of each query the best ``k`` items that match its filter, or of all items if none does.

    ``matches`` sees the columns of items and queries as arrays (``blocks.where``). Both rankings come from one pass over the similarities.
    """
    found = K.nearest(items, queries, k, K.similarity, K.where(matches))
    filtered = F.max(F.col("by_view")[1]).over(Window.partitionBy("query_id"))
    kept = found.withColumn("filtered", filtered).where(F.when(F.col("filtered"), F.col("by_view")[1]).otherwise(F.col("by_view")[0]))
    return top_k(kept, k).drop("by_view")


def fuse(candidates: DataFrame, weights: dict[str, float] = WEIGHTS) -> DataFrame:
    """``combined_score`` of the clamped scores; a missing rerank or graph score counts 0, feedback 0.5."""
    w = checked_weights(weights)
    terms = {
        "embedding_similarity": F.col("score"),
        "rerank_score": F.coalesce(F.col("rerank_score"), F.lit(0.0)),
        "kg_path_score": F.coalesce(F.col("kg_score"), F.lit(0.0)),
        "feedback_score": F.coalesce(F.col("feedback_score"), F.lit(0.5)),
    }
    total = F.lit(0.0)
    for name, term in terms.items():
        total = total + F.lit(w[name]) * V.clamp(term)
    return candidates.withColumn("combined_score", total)


def fused(weights: dict[str, float] = WEIGHTS) -> K.View:
    """``fuse`` as a view: items have ``rerank_score``, ``kg_score`` and ``feedback_score``."""
    w = checked_weights(weights)
    terms = (("rerank_score", "rerank_score", 0.0), ("kg_path_score", "kg_score", 0.0), ("feedback_score", "feedback_score", 0.5))

    def view(score: np.ndarray, item: K.Columns, query: K.Columns) -> np.ndarray:
        total = 0.0 + w["embedding_similarity"] * K.clamp(score)
        for name, column, missing in terms:
            total = total + w[name] * K.clamp(K.filled(item[column], missing))
        return total

    return view


def best_per_group(candidates: DataFrame, group: str, tie: str = "id") -> DataFrame:
    """Of each query and group the candidate of best combined score, then vector score, then tie column."""
    w = Window.partitionBy("query_id", group).orderBy(F.desc("combined_score"), F.desc("score"), F.asc(tie))
    return candidates.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def merge_weighted(original: DataFrame, expansions: DataFrame, original_weight: float = 0.7, expansion_weight: float = 0.3) -> DataFrame:
    """Sums of weighted scores of a document over the original and all expansion results; ``boosted`` if above its own."""
    both = original.select("query_id", "id", (F.col("score") * original_weight).alias("part"), F.col("score").alias("own")).unionByName(
        expansions.select("query_id", "id", (F.col("score") * expansion_weight).alias("part"), F.lit(None).cast("double").alias("own"))
    )
    merged = both.groupBy("query_id", "id").agg(F.sum("part").alias("merged_score"), F.max("own").alias("own_score"))
    return merged.withColumn("boosted", F.col("merged_score") > F.coalesce("own_score", F.lit(0.0)))


def merge_coverage(results: DataFrame, original_weight: float = 0.6, expansion_weight: float = 0.4, divisor: int = 2) -> DataFrame:
    """``results(query_id, id, score, list_no)``, list 0 the original; expansions weigh ``expansion_weight / divisor`` each."""
    weight = F.when(F.col("list_no") == 0, original_weight).otherwise(expansion_weight / divisor)
    return results.groupBy("query_id", "id").agg(F.sum(F.col("score") * weight).alias("merged_score"), F.count("*").alias("coverage"))


def reciprocal_rank_fusion(lists: DataFrame, k: int = 60) -> DataFrame:
    """``lists(query_id, list_no, id, rank)``: sums of 1 / (k + rank) over the number of the query's lists."""
    n = lists.groupBy("query_id").agg(F.count_distinct("list_no").alias("n"))
    fused = lists.groupBy("query_id", "id").agg(F.sum(1.0 / (k + F.col("rank"))).alias("s"))
    return fused.join(n, "query_id").select("query_id", "id", (F.col("s") / F.col("n")).alias("rrf_score"))


def held_codes(patterns: DataFrame) -> DataFrame:
    """``(p_doc, p_codes, position)``: of each document and code set the first of ``patterns(position, codes, doc_ids)``; added up per task before the shuffle."""
    held = patterns.select("position", F.array_sort(F.array_distinct("codes")).alias("p_codes"), F.explode("doc_ids").alias("p_doc"))
    return held.groupBy("p_doc", "p_codes").agg(F.min("position").alias("position"))


def overlap_boost(candidates: DataFrame, patterns: DataFrame, exact: float = 1.2, partial: float = 0.1) -> DataFrame:
    """``boost`` by remembered choices ``patterns(position, codes, doc_ids)`` for candidates with ``codes, id``.

    An equal code set with the document gives ``exact``; else the first stored pattern that overlaps and holds the document
    gives 1 + partial * overlap / own size; else 1. Of the patterns that hold a document with the same codes only the first tells,
    so candidates meet a row a document and code set, however many patterns there are. Candidates are stored, as they are read twice.
    """
    candidates, held = kept(candidates, "candidates"), held_codes(patterns)
    joined = candidates.join(held, F.col("id") == F.col("p_doc"), "left")
    own = F.array_sort(F.array_distinct("codes"))
    overlap = F.size(F.array_intersect(own, F.col("p_codes"))) / F.nullif(F.size(own), F.lit(0))
    scored = joined.withColumn("__exact", own == F.col("p_codes")).withColumn("__part", F.when(overlap > 0, overlap))
    keys = ["query_id", "id"]
    best = scored.groupBy(*keys).agg(F.max("__exact").alias("e"), F.min_by("__part", F.when(F.col("__part").isNotNull(), F.col("position"))).alias("p"))
    boost = F.when(F.col("e"), exact).when(F.col("p").isNotNull(), 1 + partial * F.col("p")).otherwise(1.0)
    return candidates.join(best, keys).withColumn("boost", boost).drop("e", "p")


def ambiguity(ranked: DataFrame, low: float = 0.65, spread: float = 0.02) -> DataFrame:
    """By query the best score, the sample variance of the first three, and whether either says it is ambiguous."""
    first = ranked.where("rank <= 3").groupBy("query_id").agg(F.max("score").alias("top_score"), F.var_samp("score").alias("var3"))
    return first.withColumn("ambiguous", (F.col("top_score") < low) | F.coalesce(F.col("var3") < spread, F.lit(False)))


def _flagged(out: DataFrame, low: float, spread: float) -> DataFrame:
    flag = (F.col("top_score") < low) | (F.col("var3") < spread) | (F.col("entropy") > 0.8 * F.log2(F.lit(3.0)))
    return out.withColumn("uncertain", flag)


def vector_uncertainty(items: DataFrame, queries: DataFrame, low: float = 0.65, spread: float = 0.02) -> DataFrame:
    """``uncertainty`` of the similarities of ``queries(query_id, query_vec)`` with ``items(id, vec)``: sums are added up in the tiles, two passes over them."""
    whole = kept(K.spread(items, queries), "uncertainty")
    entropy = K.entropies(items, queries.join(whole, "query_id"))
    var3 = knn(items.select("id", "vec"), queries, 3).groupBy("query_id").agg(F.var_pop("score").alias("var3"))
    out = whole.join(var3, "query_id").join(entropy, "query_id")
    return _flagged(out.select("query_id", F.col("top").alias("top_score"), "var3", F.when(F.col("n") < 2, 0.0).otherwise(F.col("h")).alias("entropy")), low, spread)


def uncertainty(scores: DataFrame, low: float = 0.65, spread: float = 0.02) -> DataFrame:
    """By query the best score, the population variance of the three largest, the softmax entropy in bits of
    all, and whether any marks it as uncertain.

    Three sums over the scores, each added up per task before the shuffle: the maximum, the softmax's denominator, the entropy. No task sees all scores of a query.
    """
    top = kept(scores.groupBy("query_id").agg(F.max("score").alias("top_score"), F.count("*").alias("n")), "uncertainty")
    shifted = scores.select("query_id", "score").join(small(top), "query_id").select("query_id", "n", F.exp(F.col("score") - F.col("top_score")).alias("e"))
    whole = kept(shifted.groupBy("query_id").agg(F.sum("e").alias("z")), "uncertainty")
    p = F.col("e") / F.col("z")
    entropy = shifted.join(small(whole), "query_id").groupBy("query_id").agg((-F.sum(p * F.log2(p + 1e-10))).alias("h"))
    var3 = top_k(scores, 3).groupBy("query_id").agg(F.var_pop("score").alias("var3"))
    out = top.join(var3, "query_id").join(entropy, "query_id").select("query_id", "top_score", "var3", F.when(F.col("n") < 2, 0.0).otherwise(F.col("h")).alias("entropy"))
    return _flagged(out, low, spread)


def fulltext_lookup(docs: DataFrame, asked: DataFrame, words: int = 5, longer_than: int = 2, least: int = 50) -> DataFrame:
    """For each of ``asked(item_id, text)`` the document of ``docs(doc_id, text)``, of over ``least`` characters, that holds most of the text's first ``words`` distinct words of more
    than ``longer_than`` letters, ties to the smaller id: ``(item_id, doc_id, n_words)``. Items none of whose words is held are left out.

    Only asked words leave a document's task, and each counts once a document: a word that all documents hold is joined with those who ask for it only, and hits are added
    up per task before the shuffle.
    """
    of = lambda c: F.array_distinct(F.filter(F.split(F.lower(c), "[^a-z]+"), lambda w: F.length(w) > longer_than))
    wanted = kept(asked.select("item_id", F.explode(F.slice(of(F.col("text")), 1, words)).alias("word")), "asked-words")
    vocabulary = small(wanted.select("word").distinct())
    held = docs.where(F.length("text") > least).select("doc_id", F.explode(of(F.col("text"))).alias("word")).join(vocabulary, "word", "left_semi")
    hits = held.join(small(wanted), "word").groupBy("item_id", "doc_id").agg(F.count("*").alias("n"))
    best = hits.groupBy("item_id").agg(F.max(F.struct("n", (-F.col("doc_id")).alias("neg"))).alias("b"))
    return best.select("item_id", (-F.col("b.neg")).alias("doc_id"), F.col("b.n").alias("n_words"))


def expand(queries: DataFrame, synonyms: DataFrame, most: int = 3) -> DataFrame:
    """``(query_id, no, query)``: each of ``queries(query_id, query_text)`` itself, then at most ``most`` forms of it with one word replaced by another of ``synonyms(word, form)``,
    in order of the word's place in the text, then of the form. Words are runs of letters and digits, of any case. The other expander is a table of one's own, made by a model or by hand.

    Only words that have synonyms are joined; a text's words are few, and so are a word's forms.
    """
    known = synonyms.where("word is not null and form is not null").select(F.lower("word").alias("word"), "form").distinct()
    words = F.regexp_extract_all(F.lower("query_text"), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    held = queries.select("query_id", "query_text", F.posexplode(F.array_distinct(words)).alias("place", "word")).join(known, "word")
    pattern = F.concat(F.lit(r"(?iu)(?<![\p{L}\p{N}])"), "word", F.lit(r"(?![\p{L}\p{N}])"))
    quoted = F.regexp_replace("form", r"([\\$])", r"\\$1")
    forms = held.select("query_id", "place", "form", F.regexp_replace("query_text", pattern, quoted).alias("query"))
    nth = F.row_number().over(Window.partitionBy("query_id").orderBy("place", "form"))
    replaced = forms.withColumn("no", nth).where(F.col("no") <= most).select("query_id", "no", "query")
    return queries.select("query_id", F.lit(0).alias("no"), F.col("query_text").alias("query")).unionByName(replaced)


def assign_best(matches: DataFrame, threshold: float = 0.6) -> DataFrame:
    """Of each record its best match at or above the threshold, ties to the smaller id; none: null."""
    best = matches.groupBy("query_id").agg(F.max(F.struct("score", (-F.col("id")).alias("neg"))).alias("b"))
    ok = F.col("b.score") >= threshold
    return best.select("query_id", F.when(ok, -F.col("b.neg")).alias("matched_id"), F.col("b.score").alias("best_score"))


def mean_pool(vectors: DataFrame, group: str, vec: str) -> DataFrame:
    """The mean vector of each group by components, of unit length. Components are summed per task before the shuffle."""
    parts = vectors.select(group, F.posexplode(V.as_double(F.col(vec))).alias("i", "x")).groupBy(group, "i").agg(F.avg("x").alias("x"))
    whole = parts.groupBy(group).agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("v"))
    return whole.select(group, V.normalize(F.transform("v", lambda e: e["x"])).alias("centroid"))


def hard_negatives(anchors: DataFrame, items: DataFrame, k: int) -> DataFrame:
    """K9: of each anchor (``query_id, query_vec, label``) the ``k`` most similar items of another label."""
    found = K.nearest(items, anchors.withColumnRenamed("label", "own_label"), k, K.where(lambda item, anchor: K.differ(item["label"], anchor["own_label"])))
    return top_k(found.drop("by_view"), k)
