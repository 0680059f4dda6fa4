"""Operators that only had a query, or nothing: small cases by hand, ties, nulls and empty tables."""

from __future__ import annotations

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from wrenchlake.functions import dialogue, plugins
from wrenchlake.functions import text as T
from wrenchlake.operators import evaluate, records, relational, retrieval
from wrenchlake.sources import records as S


# --- vectors ---


def _vectors(spark, n, seed=1):
    rng = random.Random(seed)
    return spark.createDataFrame([(i, [rng.uniform(-1, 1) for _ in range(4)], i % 3) for i in range(n)], "id long, vec array<double>, label int")


def test_blocks_of_queries_give_the_same(spark, monkeypatch):
    items = _vectors(spark, 60)
    queries = _vectors(spark, 25, 2).select(F.col("id").alias("query_id"), F.col("vec").alias("query_vec"))
    rows = lambda df: sorted((r.query_id, r.id, r.label, round(r.score, 9)) for r in df.collect())
    whole = rows(retrieval.similarities(items, queries))
    assert len(whole) == 60 * 25
    monkeypatch.setattr(retrieval, "QUERY_ROWS", 4)
    assert rows(retrieval.similarities(items, queries)) == whole
    assert retrieval.similarities(items.limit(0), queries).count() == retrieval.similarities(items, queries.limit(0)).count() == 0


def test_similarities_of_odd_vectors(spark):
    items = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, [1.0]), (5, [])], "id long, vec array<double>")
    queries = spark.createDataFrame([(1, [2.0, 0.0]), (2, None)], "query_id long, query_vec array<double>")
    assert sorted((r.query_id, r.id, r.score) for r in retrieval.similarities(items, queries).collect()) == [(1, 1, 1.0), (1, 2, 0.0)]


def _uncertain(scores):
    top, e = max(scores), [math.exp(s - max(scores)) for s in scores]
    p = [x / sum(e) for x in e]
    return top, float(np.var(sorted(scores)[-3:])), 0.0 if len(scores) < 2 else -sum(x * math.log2(x + 1e-10) for x in p)


def test_uncertainty_equals_the_formula(spark):
    rng = random.Random(3)
    of = {1: [rng.uniform(-1, 1) for _ in range(200)], 2: [0.4], 3: [0.5, 0.5], 4: [700.0, 1.0, -700.0]}
    df = spark.createDataFrame([(q, i, s) for q, ss in of.items() for i, s in enumerate(ss)], "query_id long, id long, score double").repartition(5)
    got = {r.query_id: (r.top_score, r.var3, r.entropy) for r in retrieval.uncertainty(df).collect()}
    assert all(got[q] == pytest.approx(_uncertain(ss), abs=1e-9) for q, ss in of.items()) and len(got) == 4
    assert retrieval.uncertainty(df.limit(0)).count() == 0


def test_rank_change_equals_sorting(spark):
    rng = random.Random(4)
    rows = [(q, i, rng.choice([0.1, 0.2, 0.3, 0.4]), i % 5 == 0) for q in (1, 2) for i in range(80)] + [(3, 7, 0.5, False)]
    df = spark.createDataFrame(rows, "query_id long, id long, score double, hit boolean").repartition(6)
    got = {(r.query_id, r.id): (r.rank_before, r.rank_after, r.gain) for r in evaluate.rank_change(df, F.col("score") * F.when(F.col("hit"), 2.0).otherwise(1.0), 9).collect()}
    want = {}
    for q in (1, 2, 3):
        own = [r for r in rows if r[0] == q]
        before = {r[1]: n for n, r in enumerate(sorted(own, key=lambda r: (-r[2], r[1])), 1)}
        for n, r in enumerate(sorted(own, key=lambda r: (-r[2] * (2 if r[3] else 1), r[1]))[:9], 1):
            want[q, r[1]] = (before[r[1]], n, before[r[1]] - n)
    assert got == want


def test_grid_is_bounded(spark, monkeypatch):
    monkeypatch.setattr(evaluate, "GRID_ROWS", 3)
    with pytest.raises(ValueError):
        evaluate.grid_search(spark.range(1), evaluate.grid(spark))


# --- texts ---


def test_fulltext_lookup(spark):
    docs = spark.createDataFrame([(1, "the pump fails " * 5), (2, "the pump and the valve fail now and then again " * 2), (3, "valve pump"), (4, None), (0, "THE the " * 20)], "doc_id long, text string")
    asked = spark.createDataFrame([(10, "Pump, valve!"), (11, "the"), (12, "of it"), (13, None), (14, "one two three four five pump"), (15, "pump pump the")], "item_id long, text string")
    got = {r.item_id: (r.doc_id, r.n_words) for r in retrieval.fulltext_lookup(docs, asked).collect()}
    assert got == {10: (2, 2), 11: (0, 1), 15: (1, 2)}
    assert retrieval.fulltext_lookup(docs.limit(0), asked).count() == retrieval.fulltext_lookup(docs, asked.limit(0)).count() == 0


def test_expand(spark):
    synonyms = spark.createDataFrame([("Stall", "engine dies"), ("stall", "no start"), ("leak", "cost $1 \\ more"), ("été", "summer"), (None, "x"), ("leak", None)], "word string, form string")
    queries = spark.createDataFrame([(1, "Stall, stalls and STALL"), (2, "a leak"), (3, None), (4, ""), (5, "L'été, leak stall")], "query_id long, query_text string")
    got = {}
    for r in retrieval.expand(queries, synonyms, 2).orderBy("query_id", "no").collect():
        got.setdefault(r.query_id, []).append(r["query"])
    assert got == {
        1: ["Stall, stalls and STALL", "engine dies, stalls and engine dies", "no start, stalls and no start"], 2: ["a leak", "a cost $1 \\ more"], 3: [None], 4: [""],
        5: ["L'été, leak stall", "L'summer, leak stall", "L'été, cost $1 \\ more stall"],
    }
    assert retrieval.expand(queries.limit(0), synonyms).count() == 0


def test_encoder_and_projection(spark):
    texts = ["one two  two", "TWO one\ntwo", "", None, "three"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").coalesce(1)
    v = [r[0] for r in df.orderBy("i").select(plugins.encode(F.col("t"), plugins.HashingEncoder(8))).collect()]
    assert v[0] == v[1] and v[2] == v[3] == [0.0] * 8 and v[4] != v[0] and np.linalg.norm(v[0]) == pytest.approx(1)

    class Upper:
        dims = 2

        def encode(self, texts, is_query=False):
            return np.array([[len(t), float(is_query)] for t in texts])

    assert [r[0] for r in df.orderBy("i").select(plugins.encode(F.col("t"), Upper(), True)).collect()] == [[len(t or ""), 1.0] for t in texts]
    vecs = [[1.0, 2.0, 3.0], [4.0, 5.0], None, [0.0, 0.0], [-1.0, 0.5, 2.0], []]
    out = [r[0] for r in spark.createDataFrame([(i, x) for i, x in enumerate(vecs)], "i int, v array<double>").coalesce(1).orderBy("i").select(plugins.project(F.col("v"), 5)).collect()]
    for x, y in zip(vecs, out, strict=True):
        if x is None:
            assert y is None
        else:
            want = np.array(x) @ np.random.default_rng(42).normal(0, 1 / np.sqrt(5), (len(x), 5))
            assert y == pytest.approx(want / (np.linalg.norm(want) or 1))


def test_sentence_summary(spark):
    cases = {
        "One. Two! Three? Four": "One. Two. Three. ...", "  a \n b.  c ": "a b. c", "": "", None: "", "x" * 30: "x" * 17 + "...", "first part. second part. third": "first part", "abc. " + "d" * 30 + ". e": "abc", "no end": "no end", "a. b. c.": "a. b. c.",
    }
    got = spark.createDataFrame([(k,) for k in cases], "t string").select("t", T.sentence_summary(F.col("t"), 20).alias("s")).collect()
    assert {r.t: r.s for r in got} == cases


def test_solution_text(spark):
    cases = [
        ('{"title": " T ", "procedure_steps": ["a", " b ", null, ""]}', "s", "T a b"), ('{"title": "T", "steps": "one text"}', "s", "T one text"), ('{"title": null, "steps": []}', "s", '{"title": null, "steps": []}'),
        (" plain guide ", "s", "plain guide"), ("{broken", "s", "{broken"), (None, " s ", "s"), ("", " s ", "s"), (None, None, ""),
    ]
    got = spark.createDataFrame(cases, "g string, s string, want string").select(T.solution_text(F.col("g"), F.col("s")).alias("x"), "want").collect()
    assert [r.x for r in got] == [r.want for r in got]


def test_lenient_values(spark):
    rows = [("1.5", "2024-01-02T03:04:05Z"), (" 2 ", "2024-01-02 03:04:05"), ("x", "soon"), (None, None), ("", "")]
    got = spark.createDataFrame(rows, "n string, t string").select(T.float_or(F.col("n"), -1.0), T.iso_timestamp(F.col("t")).cast("string")).collect()
    assert [tuple(r) for r in got] == [(1.5, "2024-01-02 03:04:05"), (2.0, "2024-01-02 03:04:05"), (-1.0, None), (-1.0, None), (-1.0, None)]
    lists = spark.createDataFrame([('["a", "b"]',), ("",), (None,), ("[bad",)], "c string").select(S.json_column(F.col("c"))).collect()
    assert [r[0] for r in lists] == [["a", "b"], [], [], []]


def test_repair_words_and_titles(spark):
    pad = " " + "x" * 200
    cases = {"Replaced it" + pad: True, "irreplaced" + pad: False, "the fix was simple" + pad: True, "Replaced": False, "P0301 code" + pad: True, "ÉREPLACED" + pad: False, None: False}
    got = {r.t: r.w for r in spark.createDataFrame([(k,) for k in cases], "t string").select("t", records.worth_extracting(F.col("t")).alias("w")).collect()}
    assert got == cases
    titles = {"Last": False, "123456": False, "abc": False, "Misfires on cold start": True, "unsolved": True, "ab cd ef gh": False, "page": False, "a word here": True, None: False}
    got = {r.t: r.w for r in spark.createDataFrame([(k,) for k in titles], "t string").select("t", records.title_is_relevant(F.col("t")).alias("w")).collect()}
    assert got == titles


def test_questions_and_candidates(spark):
    texts = {
        "Some thoughts first\n1. Does it stall when cold?\n - bulleted, without a mark\nWhen did it start, exactly?\n2) short?\n* one too many, that is cut": ["Does it stall when cold?", "bulleted, without a mark", "When did it start, exactly?"],
        "no question here": [], "": [], None: [],
    }
    got = {r.t: r.q for r in spark.createDataFrame([(k,) for k in texts], "t string").select("t", dialogue.parse_questions(F.col("t")).alias("q")).collect()}
    assert got == texts
    line = dialogue.candidate_line(F.lit(2), F.lit("Pump"), F.lit(0.8756))
    assert spark.range(1).select(line).first()[0] == "2. Pump (score: 0.876)"


# --- scans and projections ---


def test_procedures(spark):
    rows = [(1, " - ", "n1"), (1, " - ", "n1"), (2, None, " "), (3, " T ", "n3"), (None, "x", "y"), (4, "", "n4")]
    df = spark.createDataFrame(rows, "id long, title string, name string")
    out = lambda **k: sorted(map(tuple, records.procedures(df, **k).collect()))
    assert out() == [("1", "n1", "n1"), ("2", None, None), ("3", "T", "n3"), ("4", "n4", "n4")]
    assert out(issue_only=True) == [("1", "n1", "n1"), ("2", None, None), ("4", "n4", "n4")]
    assert out(limit=2) == out()[:2] and out(ids=[3, " 4", ""], limit=1) == out()[2:] and out(ids=["", " "], limit=1) == out()[:1]


def test_recommendations(spark):
    rows = [("d1", "", None, "P", None, 0.5), ("d2", "p2", "T", "", 0.9, 0.1), (None, None, None, None, None, None), ("d4", None, "", "N", 0.0, 0.7)]
    got = records.recommendations(spark.createDataFrame(rows, "id string, procedure_id string, title string, procedure_name string, combined_score double, score double")).collect()
    assert [tuple(r) for r in got] == [("d1", "P", "P", "d1", 0.5), ("p2", "T", "T", "p2", 0.9), ("", "Unknown", "Unknown", None, 0.0), ("d4", "N", "N", "d4", 0.0)]


def test_search_labels(spark):
    faults = spark.createDataFrame([(1, "ABC"), (2, None), (3, "x"), (2, None)], "id long, code string")
    labels = spark.createDataFrame([(2, "has aBc", None), (2, None, "abc too"), (3, "no", "no"), (9, "abc", None), (None, "abc", None)], "fault_id long, label string, description string")
    assert sorted(map(tuple, records.search_labels(faults, labels, "ABC").collect())) == [(1, "ABC"), (2, None)]
    assert [r.id for r in records.search_labels(faults, labels, "abc", 1).collect()] == [1]
    assert [r.id for r in records.search_labels(faults, labels.limit(0), "%").collect()] == []


def test_golden_records(spark):
    schema = "record_id long, codes array<string>, symptoms string, summary string, guide string, matched_id long, matched_title string, sensors map<string,double>, quality_score double, category string"
    rows = [(1, ["P1", "P2"], "s" * 300, None, "g" * 600, 5, "t", {"a": 1.0}, 0.5, "hard"), (2, None, None, "", None, None, None, {}, None, None)]
    a, b = sorted(records.enrich(spark.createDataFrame(rows, schema)).collect())
    assert a.query_symptom == "Fault codes: P1, P2. Problem: " + "s" * 200 and a.query_solution == "Fix: " + "g" * 300 and len(a.truth.repair_text) == 500 and tuple(a.evaluation) == (2, True, True, 0.5, "hard")
    assert b.query_symptom == b.query_solution == "Fault codes: " and b.truth.repair_text is None and tuple(b.evaluation) == (0, False, False, None, "general")


def test_coverage(spark):
    schema = "codes array<string>, guide_id long, has_symptoms boolean, has_sensors boolean"
    df = spark.createDataFrame([(["a", "b", "a"], 1, True, False), ([], 1, False, None), (None, None, True, True)], schema)
    assert records.coverage(df).first().asDict() == {"n_records": 3, "n_guides": 1, "symptom_share": 2 / 3, "sensor_share": 1 / 3, "n_codes": 2}
    assert {r.code: r.n for r in records.code_counts(df).collect()} == {"a": 2, "b": 1}
    assert records.coverage(df.limit(0)).first().symptom_share == 0


def test_form_overhead(spark):
    df = spark.createDataFrame([(1, "a", 1.0, 10), (1, "b", 1.5, 30), (2, "a", 3.0, 10), (2, "b", 4.5, 10), (3, "a", 99.0, 1)], "query_id long, form string, seconds double, length long")
    assert evaluate is not None and tuple(records.form_overhead(df).first()) == pytest.approx((2, 2.0, 3.0, 50.0, 2.0))


def test_unseen_urls(spark):
    urls = spark.createDataFrame([("http://a/x/",), ("http://a/x#f",), ("http://a/threads/t.12/page",), ("http://b",), (None,)], "url string")
    stored = spark.createDataFrame([("http://a/threads/other.12/",), ("http://b/",)], "url string")
    assert [(r.norm, r.url) for r in S.unseen(urls.where("url is not null"), stored).collect()] == [("http://a/x", "http://a/x#f")]


def test_upsert_and_exports(spark, tmp_path):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "id long, v string")
    new = spark.createDataFrame([(2, "c"), (3, "d")], "id long, v string")
    assert sorted(map(tuple, relational.upsert_by_key(old, new, ["id"]).collect())) == [(1, "a"), (2, "c"), (3, "d")]
    for kind in ("json", "csv"):
        S.export(new, str(tmp_path / kind), kind, ["id"])
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).count() == spark.read.json(str(tmp_path / "json")).count() == 2
    S.export(new.select("v"), str(tmp_path / "text"), "text")
    assert Counter(r.value for r in spark.read.text(str(tmp_path / "text")).collect()) == {"c": 1, "d": 1}
