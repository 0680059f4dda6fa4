"""Odd input that the other tests of the first ten operators don't have: very long texts, clashing names, odd vectors."""

from __future__ import annotations

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F
from tests.llm.test_operators import clashing, odd_docs

from wrenchlake.llm import hamming, imatch, langid, quality, sharding, warc

LONG = "alpha beta gamma " * 120_000  # two million characters


def _long_docs(spark):
    docs = odd_docs(spark)
    return clashing(docs.unionByName(docs.where("doc_id = 6").withColumn("doc_id", F.lit(77).cast("long")).withColumn("text", F.lit(LONG))))


def test_warc_of_a_long_page_and_other_columns(spark):
    rows = [(1, LONG, "u1"), (2, LONG, "u2"), (3, "é" * 99, "u3"), (4, None, "u4"), (5, "\r\n\r\nWARC/1.0\r\n\r\n" * 50, "u5")]
    pages = spark.createDataFrame(rows, "page_id long, html string, url string").withColumn("warc_type", F.lit("x")).withColumn("payload_digest", F.lit("y")).withColumn("a.b", F.lit(1))
    got = {r.page_id: r for r in warc.round_trip(spark, pages).collect()}
    assert {i: (got[i].payload_bytes, got[i].payload_digest) for i in got} == {i: (len((h or "").encode()), hashlib.sha256((h or "").encode()).hexdigest()) for i, h, _ in rows}
    assert {i: (r.warc_type, r.refers_to_page) for i, r in got.items()} == {1: ("response", None), 2: ("revisit", 1), 3: ("response", None), 4: ("response", None), 5: ("response", None)}


def test_shards_of_long_texts_and_other_columns(spark):
    docs = _long_docs(spark)
    got = sharding.reshard(docs, 3, 2).collect()
    want = sorted((r.doc_id or -1, len((r.text or "").encode()) + 1, zlib.crc32((r.text or "").encode())) for r in docs.collect())
    assert sorted((r.doc_id or -1, r["size"], r.text_crc32) for r in got) == want
    for shard in {r.shard for r in got}:
        assert sorted(r.slot for r in got if r.shard == shard) == list(range(sum(r.shard == shard for r in got)))


def test_sign_codes(spark):
    vectors = [None, [], [0.5], [-0.5, 0.0, 1.0], [float("nan"), 2.0], [None, 2.0], [1.0] * 70, [float("inf"), float("-inf"), 1.0], [-1.0] * 63 + [1.0]]
    got = [r[0] for r in spark.createDataFrame([(i, v) for i, v in enumerate(vectors)], "i int, v array<float>").orderBy("i").select(hamming.sign_code("v")).collect()]
    assert got == [None, 0, 1, 4, 2, 2, -1, 5, -(1 << 63)]


def test_topk_ignores_other_columns(spark):
    rows = spark.createDataFrame([(1, 5, 9), (2, 4, 9)], "id long, code long, distance int").withColumn("rank", F.lit(1)).withColumn("query_id", F.lit(7))
    asked = spark.createDataFrame([(1, 5, 3)], "query_id long, query_code long, id long").withColumn("a.b", F.lit(1))
    assert [(r.id, r.distance, r["rank"]) for r in hamming.topk_search(rows, asked, 2).orderBy("rank").collect()] == [(1, 0, 1), (2, 1, 2)]


def test_scores_of_long_texts_and_other_columns(spark):
    docs = _long_docs(spark)
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(9)], "doc_id long, quality int, toxic int")
    scored = quality.score_documents(docs, labels).collect()
    assert len(scored) == 11 and all(0 <= r.score <= 1 for r in scored)
    found = langid.identify(docs).collect()
    assert len(found) == 11 and all(0 <= r.score <= 1 for r in found)
    assert {r.lang_pred for r in found if r.doc_id in (2, 3, 5)} == {"und"} and "und" not in {r.lang_pred for r in found if r.doc_id == 77}


def test_fingerprints_of_long_texts_and_other_columns(spark):
    docs = _long_docs(spark)
    got = {r.doc_id: r for r in imatch.compare_edited(docs, parts=3).collect()}
    assert got[77].n_chars == len(LONG) and got[77].near_edited == pytest.approx(1.0)  # the first text, put at its end, brings no term but its own
    assert imatch.fingerprints(docs).count() == 11
