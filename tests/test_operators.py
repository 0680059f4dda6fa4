"""Operators on small fixtures: ties, nulls, empty tables, repeated rows."""

from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from wrenchlake.functions import vectors as V
from wrenchlake.operators import evaluate as E
from wrenchlake.operators import feedback as B
from wrenchlake.operators import graph as G
from wrenchlake.operators import relational as R
from wrenchlake.operators import retrieval as Q
from wrenchlake.sources import records as S
from wrenchlake.streaming import events as X


def test_knn_ties_and_bad_vectors(spark):
    items = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 0.0]), (4, None), (5, [1.0]), (6, [-1.0, 0.0])], "id long, vec array<double>")
    queries = spark.createDataFrame([(9, [2.0, 0.0])], "query_id long, query_vec array<double>")
    got = [(r.id, r.rank, r.score) for r in Q.knn(items, queries, 4).orderBy("rank").collect()]
    assert got == [(1, 1, 1.0), (2, 2, 1.0), (3, 3, 0.0), (6, 4, -1.0)]
    assert Q.knn(items.limit(0), queries, 3).count() == 0


def test_weights(spark):
    assert Q.checked_weights({"a": 1, "b": 3}) == {"a": 0.25, "b": 0.75}
    for bad in ({"a": -1, "b": 2}, {"a": 0, "b": 0}):
        with pytest.raises(ValueError):
            Q.checked_weights(bad)


def test_fuse_defaults_and_clamp(spark):
    c = spark.createDataFrame([(1, 1, 1.5, None, None, None), (1, 2, -1.0, 1.0, 1.0, 1.0)], "query_id long, id long, score double, rerank_score double, kg_score double, feedback_score double")
    got = {r.id: round(r.combined_score, 6) for r in Q.fuse(c).collect()}
    assert got == {1: 0.45, 2: 0.6}


def test_upsert_rules(spark):
    schema = "source_url string, confidence double, outcome string, summary string, source_type string, created_at string"
    old = spark.createDataFrame([("a", 0.9, "failure", "s", "old", "1"), ("b", 0.5, "success", None, "old", "1"), ("c", 0.5, None, "s", "old", "1")], schema)
    new = spark.createDataFrame([("a", 0.1, "failure", "t", "new", "2", 1), ("b", 0.1, None, "t", "new", "2", 1), ("c", 0.1, "success", "t", "new", "2", 1), ("d", 0.1, None, None, "new", "2", 1)], schema + ", arrival long")
    got = {r.source_url: (r.action, r.summary, r.source_type) for r in R.conditional_upsert(old, new).collect()}
    assert got == {"a": ("kept", "s", "old"), "b": ("updated", "t", "old"), "c": ("updated", "t", "old"), "d": ("inserted", None, "new")}


def test_variants(spark):
    rows = spark.createDataFrame([("p0301",), ("P0000",), ("2A87",), (None,)], "code string")
    got = {}
    for r in R.expand_codes(rows, R.built_in_map(spark)).orderBy("variant_no").collect():
        got.setdefault(r.code, []).append(r.variant)
    assert got == {"p0301": ["P0301", "29CC", "0301", "301"], "P0000": ["P0000", "0000", "0"], "2A87": ["2A87"]}


def test_metadata_predicate(spark):
    df = spark.createDataFrame([(["a", "b"], "x"), (["c"], "x"), (["a"], "y")], "codes array<string>, kind string")
    assert df.where(R.metadata_predicate({"codes": ["a", " "], "kind": "x"})).count() == 1
    assert R.metadata_predicate({"codes": [" "]}) is None


def test_boost(spark):
    c = spark.createDataFrame([(1, 10, ["a", "b"]), (1, 11, ["a", "b"]), (1, 12, ["z"])], "query_id long, id long, codes array<string>")
    p = spark.createDataFrame([(0, ["a"], [11, 12]), (1, ["b", "a"], [10])], "position long, codes array<string>, doc_ids array<long>")
    assert {r.id: round(r.boost, 6) for r in Q.overlap_boost(c, p).collect()} == {10: 1.2, 11: 1.05, 12: 1.0}


def test_ratings(spark):
    e = spark.createDataFrame([("a", 5, "success"), ("a", 1, "partial"), ("b", None, "failure"), ("c", 3, None), ("d", None, None)], "entity string, rating int, outcome string")
    got = {r.entity: None if r.score is None else round(r.score, 6) for r in B.ratings(e).collect()}
    assert got == {"a": 0.6, "b": 0.0, "c": 0.5, "d": None}
    assert [r.entity for r in B.ratings(e, 3.5).orderBy("entity").collect()] == ["a", "c"]
    with pytest.raises(ValueError):
        B.ratings(e, 9)


def test_statistics_of_nothing(spark):
    r = B.statistics(spark.createDataFrame([], "entity string, rating int, outcome string")).first()
    assert (r.n, r.avg_rating, r.coverage) == (0, 0.0, 0.0)


def test_paths(spark):
    e = spark.createDataFrame([("a", "b", 5.0), ("a", "b", 1.0), ("b", "t", None), ("a", "t", 9.0), ("b", "a", 1.0), ("t", "u", 1.0), ("u", "v", 1.0)], "src string, dst string, weight double")
    of = lambda c, *v: spark.createDataFrame([(x,) for x in v], f"{c} string")
    got = {(r.src, r.dst): (r.cost, r.n, r.path) for r in G.cheapest_paths(e, of("src", "a", "z"), of("dst", "t", "v", "a")).collect()}
    assert got == {("a", "t"): (2.0, 2, "a>b>t"), ("a", "v"): (11.0, 3, "a>t>u>v")}


def test_merge_graph(spark):
    old = spark.createDataFrame([("a", "b", "r", 1.0)], "src string, dst string, relationship string, weight double")
    new = spark.createDataFrame([("a", "b", "r", 2.0), ("a", "c", "r", 1.0), ("a", "c", "r", 1.0)], old.schema)
    assert G.merge_graph(old, new, ["src", "dst", "relationship"]).count() == 2


def test_rank_of(spark):
    df = spark.createDataFrame([(["x_chunk_1", "x_chunk_2", "y"], "y"), (["x"], "z"), ([], "z")], "ids array<string>, want string")
    assert [r[0] for r in df.select(E.rank_of(F.col("ids"), F.col("want"))).collect()] == [2, 0, 0]


def test_vector_rules(spark):
    df = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],)], "v array<double>")
    assert [r[0] for r in df.select(V.normalize(F.col("v"))).collect()] == [[0.6, 0.8], [0.0, 0.0]]
    d = spark.createDataFrame([(0.5,), (2.0,)], "d double")
    assert [round(r[0], 4) for r in d.select(V.distance_score(F.col("d"), legacy=True)).collect()] == [0.5, 0.3333]
    assert [r[0] for r in spark.createDataFrame([(float("nan"),), (None,), (2.0,), (0.3,)], "x double").select(V.clamp(F.col("x"))).collect()] == [0.0, 0.0, 1.0, 0.3]
    loss = spark.createDataFrame([(0.9, [0.1, 0.2])], "p double, n array<double>").select(V.info_nce(F.col("p"), F.col("n"))).first()[0]
    z = [math.exp(s / 0.05) for s in (0.9, 0.1, 0.2)]
    assert abs(loss + math.log(z[0] / sum(z))) < 1e-9


def test_sources(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"fault_codes": ["P0301"], "source_url": "u", "source_type": null, "repair_summary": "s"}\nbroken\n{"source_url": "v", "source_type": "doc"}\n')
    df = S.read_records(spark, str(tmp_path / "*.jsonl"))
    assert sorted(r.source_url for r in df.collect()) == ["u", "v"]
    S.write_records(df, str(tmp_path / "out"))
    back = spark.read.json(str(tmp_path / "out"))
    assert {(r.source_url, r.source_type, r.repair_guide) for r in back.select("source_url", "source_type", "repair_guide").collect()} == {("u", "forum", "s"), ("v", "doc", None)}
    (tmp_path / "t.csv").write_text("title,procedure_id\nGood title,1\nx,2\n Good title ,3\n")
    assert [(r.title, r.procedure_id) for r in S.read_titles(spark, str(tmp_path / "t.csv")).collect()] == [("Good title", "3")]
    nodes, edges = S.read_graph(spark, str(tmp_path / "none"))
    assert nodes.count() == edges.count() == 0
    S.write_graph(spark.createDataFrame([("a", "k", "l")], S.NODES), edges, str(tmp_path / "g"))
    assert S.read_graph(spark, str(tmp_path / "g"))[0].count() == 1


def test_pages(spark):
    html = '<script>a<b</script><p>Some <b>text</b>&nbsp;here</p><a href="/x">Misfire <i>fix</i></a><a href="/y">Next</a><table><tbody><tr><td>1</td><td> 2 </td></tr><tr><td>3</td></tr></tbody></table>'
    pages = spark.createDataFrame([(1, html), (2, None), (3, "")], "page_id long, html string")
    assert [(r.href, r.label) for r in S.page_links(pages).collect()] == [("/x", "Misfire fix")]
    assert [r.cells for r in S.table_rows(pages, 2).collect()] == [["1", "2"]]
    assert pages.select(S.page_text(F.col("html"))).first()[0].startswith("Some text here")


def test_streams(spark, tmp_path):
    rows = spark.sql("SELECT timestamp'2024-01-01 00:10:00' AS ts, 1L AS user_id, 'a' AS event_type, 2.0D AS value UNION ALL SELECT timestamp'2024-01-01 00:50:00', 1L, 'a', 3.0D UNION ALL SELECT timestamp'2024-01-01 09:00:00', 2L, 'b', 1.0D")
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))  # one file, so that no order of files decides what is late
    stream = X.read_events(spark, str(tmp_path / "in"), "ts timestamp, user_id long, event_type string, value double")
    q = X.tumbling(stream).writeStream.format("memory").queryName("tumbling").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert [(r.event_type, r.n, r.total) for r in spark.table("tumbling").collect()] == [("a", 2, 5.0)]
    assert X.sessions(rows).count() == 3


def test_overlap_boost_meets_a_code_set_once(spark):
    """Many users of few code sets hold one document: candidates meet a row a code set, of the first position."""
    p = spark.createDataFrame([(i, ["a", "b"] if i % 2 else ["b", "c", "b"], [10]) for i in range(200, 0, -1)] + [(0, ["a"], None), (None, ["z"], [10])], "position long, codes array<string>, doc_ids array<long>")
    assert sorted((r.p_doc, r.p_codes, r.position) for r in Q.held_codes(p).where("position is not null").collect()) == [(10, ["a", "b"], 1), (10, ["b", "c"], 2)]
    c = spark.createDataFrame([(1, 10, ["c", "b"]), (2, 10, ["b", "x"]), (3, 10, ["z", "q"]), (4, 11, ["a"])], "query_id long, id long, codes array<string>")
    assert {r.query_id: round(r.boost, 6) for r in Q.overlap_boost(c, p).collect()} == {1: 1.2, 2: 1.05, 3: 1.0, 4: 1.0}
