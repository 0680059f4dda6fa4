"""Nearest items by blocks and parts, held against all pairs: ties, odd vectors, tiny blocks, views."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from wrenchlake.functions import vectors as V
from wrenchlake.operators import blocks, evaluate, retrieval
from wrenchlake.plans import more_queries, retrieval_queries


@pytest.fixture(scope="module")
def sides(spark):
    rng = random.Random(7)
    vecs = [[rng.choice([-1.0, 0.0, 0.5, 2.0]) for _ in range(3)] for _ in range(90)]  # many equal ones
    vecs += [None, [], [1.0], [0.0, 0.0, 0.0], [1.0, None, 2.0], [float("nan"), 1.0, 1.0], [float("inf"), 1.0, 0.0]]
    rows = [(i, v, None if i % 13 == 0 else i % 4) for i, v in enumerate(vecs)]
    items = spark.createDataFrame(rows, "id long, vec array<double>, label int").repartition(3).cache()
    queries = items.where("id % 6 = 0 or id > 89").select(F.col("id").alias("query_id"), F.col("vec").alias("query_vec"), F.col("label").alias("own_label")).cache()
    return items, queries


def rows(df):
    return sorted(str(tuple(r[c] for c in sorted(df.columns))) for r in df.collect())


@pytest.mark.parametrize("components", [2**20, 30])
def test_knn_equals_all_pairs(spark, monkeypatch, sides, components):
    monkeypatch.setattr(blocks, "COMPONENTS", components)
    monkeypatch.setattr(blocks, "TILE", 64)
    items, queries = sides
    every = retrieval.similarities(items, queries)
    for k in (1, 5, 200):
        assert rows(retrieval.knn(items, queries, k)) == rows(retrieval.top_k(every, k))
    assert rows(retrieval.knn(items, queries, 7, 0.5)) == rows(retrieval.top_k(every.where("score >= 0.5"), 7))
    assert retrieval.knn(items.limit(0), queries, 3).count() == retrieval.knn(items, queries.limit(0), 3).count() == 0


def test_knn_leaves_no_pairs_in_spark(spark, sides, capsys):
    retrieval.knn(*sides, 3).explain()
    plan = capsys.readouterr().out
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_length_is_taken_once_a_vector(spark, capsys):
    spark.createDataFrame([([1.0],)], "v array<double>").select(V.normalize(F.col("v")).alias("u")).explain()
    assert capsys.readouterr().out.count("SQRT") == 1


@pytest.fixture
def plain(spark, monkeypatch):
    """Vectors without gaps, met in blocks and parts of a few rows."""
    monkeypatch.setattr(blocks, "COMPONENTS", 60)
    monkeypatch.setattr(blocks, "TILE", 64)
    rng = random.Random(8)
    rows = [(i, [rng.choice([-1.0, 0.5, 2.0]) for _ in range(3)], None if i % 13 == 0 else i % 4) for i in range(80)]
    items = spark.createDataFrame(rows, "id long, vec array<double>, label int")
    return items, items.where("id % 5 = 0").select(F.col("id").alias("query_id"), F.col("vec").alias("query_vec"), "label")


def test_filters_equal_those_of_all_pairs(plain):
    items, queries = plain
    every = retrieval.similarities(items, queries.drop("label"))
    own = queries.select("query_id", F.col("label").alias("own_label"))
    want = retrieval.top_k(every.join(own, "query_id").where("label <> own_label").drop("own_label"), 4)
    assert rows(retrieval.hard_negatives(queries, items, 4)) == rows(want)
    matches = lambda item, query: blocks.same(item["label"], np.array([[3]])) & (query["query_id"] % 2 == 0)
    got = retrieval.filtered_or_all(items, queries.drop("label"), matches, 30)
    hits, rest = retrieval.top_k(every.where("query_id % 2 = 0 and label = 3"), 30), retrieval.top_k(every.where("query_id % 2 = 1"), 30)
    assert rows(got) == rows(hits.withColumn("filtered", F.lit(True)).unionByName(rest.withColumn("filtered", F.lit(False))))


def test_fused_view_ranks_as_fuse(plain):
    items, queries = plain
    rated = items.withColumn("rerank_score", (F.col("id") % 7) / 7.0).withColumn("kg_score", F.when(F.col("id") % 3 == 0, 0.5)).withColumn("feedback_score", F.when(F.col("id") % 2 == 0, 1.0))
    near = retrieval.fuse(blocks.nearest(rated, queries.drop("label"), 6, retrieval.fused())).drop("by_view")
    every = retrieval.fuse(retrieval.similarities(rated, queries.drop("label")))
    assert rows(retrieval.top_k(near, 6, by="combined_score")) == rows(retrieval.top_k(every, 6, by="combined_score"))


def test_vector_uncertainty_and_rank_change(plain):
    items, queries = plain
    queries = queries.drop("label")
    every = retrieval.similarities(items, queries)
    got, want = ({r.query_id: r for r in df.collect()} for df in (retrieval.vector_uncertainty(items, queries), retrieval.uncertainty(every)))
    assert len(got) == len(want) == 16 and all(tuple(got[q]) == pytest.approx(tuple(want[q]), abs=1e-9) for q in want)
    boosted = F.col("score") * F.when(F.col("id") % 5 == 0, 1.5).otherwise(1.0)
    view = lambda score, item, query: score * np.where(item["id"] % 5 == 0, 1.5, 1.0)
    assert rows(evaluate.vector_rank_change(items, queries, view, boosted, 7)) == rows(evaluate.rank_change(every, boosted, 7))


@pytest.mark.parametrize("n", [1, 5, 700, 5000])
def test_greatest_equals_all_products(n):
    """Also among copies and vectors that differ in their last bits, of which a matrix product rounds some otherwise."""
    rng = np.random.default_rng(9)
    made = rng.normal(size=(max(1, n // 5), 16))
    items = np.concatenate([made[rng.integers(len(made), size=n - n // 4)], made[rng.integers(len(made), size=n // 4)] + rng.choice([0, 1e-16, -1e-16], size=(n // 4, 16))])
    items /= np.linalg.norm(items, axis=1)[:, None]
    queries, columns = items[: 1 + n // 9], np.ascontiguousarray(items.T)
    every = blocks._dots(queries, columns)
    for k in (1, 5, 20):
        q, i, score = blocks.greatest(queries, columns, k)
        chosen = blocks._best(every, k)
        assert sorted(zip(q.tolist(), i.tolist(), strict=True)) == list(map(tuple, np.argwhere(chosen).tolist()))
        assert (score == every[q, i]).all()


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """Folders of embeddings and labels: copies and close ties without gaps; the same with odd vectors, ids and labels."""
    rng, out = random.Random(3), []
    plain = [(100 * i if i % 7 == 0 else i, [rng.choice([-1.0, 0.5, 0.5000001, 2.0]) for _ in range(3)], i % 3) for i in range(160)]
    odd = [(None, [1.0, 2.0, 0.5], 1), (None, None, None), (-200, [2.0, 0.5, 0.5], None), (-7, [0.5, 0.5, 2.0], 7), (-1200, [0.0, 0.0, 0.0], 1), (100_000, [1.0], 2), (100_001, [None, 1.0, 1.0], 2), (100_100, [float("nan"), 1.0, 1.0], 0), (100_010, [float("inf"), 1.0, 2.0], None)]
    for n, rows in enumerate((plain, plain + odd, plain[:90] + odd[:1] + odd[2:5], odd[:1])):
        folder = str(tmp_path_factory.mktemp(f"tables{n}"))
        spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(3).write.parquet(f"{folder}/embeddings.parquet")
        spark.createDataFrame([(i, i % 2) for i in range(0, 16_000, 3)], "doc_id long, quality int").write.parquet(f"{folder}/labels.parquet")
        out.append(folder)
    return out


def _all_pairs(spark, folder, of_items=lambda df: df):
    items = spark.read.parquet(f"{folder}/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"), "label")
    queries = items.where("id % 100 = 0").select(F.col("id").alias("query_id"), F.col("vec").alias("query_vec"))
    return retrieval.similarities(of_items(items), queries)


def _without_pairs(df, capsys):
    """``df``, whose plan meets vectors in tiles and doesn't join them by their sizes, which makes rows of all pairs."""
    df.explain()
    plan = capsys.readouterr().out
    assert "FlatMapCoGroupsInArrow" in plan and "size(" not in plan and "NestedLoop" not in plan and "Cartesian" not in plan
    return df


@pytest.mark.parametrize("components", [2**20, 60])
def test_hybrid_exact_equals_all_pairs(spark, monkeypatch, capsys, tables, components):
    monkeypatch.setattr(blocks, "COMPONENTS", components)
    monkeypatch.setattr(blocks, "TILE", 256)
    for folder in tables:
        score = 0.3 * (F.col("id") % 10 == F.floor(F.col("query_id") / 100) % 10).cast("double") + 0.7 * F.col("score")
        every = retrieval.top_k(_all_pairs(spark, folder).withColumn("hybrid", score), 5, by="hybrid").select("query_id", "rank", "id", F.round("hybrid", 6).alias("hybrid"))
        assert rows(_without_pairs(more_queries.hybrid_exact(spark, folder), capsys)) == rows(every)


@pytest.mark.parametrize("components", [2**20, 60])
def test_multi_field_max_equals_all_pairs(spark, monkeypatch, capsys, tables, components):
    monkeypatch.setattr(blocks, "COMPONENTS", components)
    monkeypatch.setattr(blocks, "TILE", 256)
    for folder in tables:
        score = F.round(F.greatest(F.col("score"), (F.col("id") % 11) / 11.0), 6)
        every = _all_pairs(spark, folder).select("query_id", "id", score.alias("score")).where("score > 0.9")
        assert rows(_without_pairs(retrieval_queries.multi_field_max(spark, folder), capsys)) == rows(every)


@pytest.mark.parametrize("components", [2**20, 60])
def test_best_per_group_equals_all_pairs(spark, monkeypatch, capsys, tables, components):
    monkeypatch.setattr(blocks, "COMPONENTS", components)
    monkeypatch.setattr(blocks, "TILE", 256)
    for folder in tables:
        quality = spark.read.parquet(f"{folder}/labels.parquet").select(F.col("doc_id").alias("id"), F.col("quality").cast("double").alias("feedback_score"))
        rated = lambda df: df.withColumn("rerank_score", (F.col("id") % 7) / 7.0).withColumn("kg_score", F.when(F.col("id") % 3 == 0, 0.5)).join(quality, "id", "left")  # noqa: E731, B023
        every = retrieval.best_per_group(retrieval.fuse(_all_pairs(spark, folder, rated)), "label")
        got = _without_pairs(retrieval_queries.best_per_group(spark, folder), capsys)
        assert rows(got) == rows(every.select("query_id", "label", "id", F.round("combined_score", 6).alias("combined_score")))
