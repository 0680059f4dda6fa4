"""Operator 12 against a plain version."""

from __future__ import annotations

import hashlib
import math
import random
import re
import string
import zlib
from collections import Counter

import pytest
from tests.llm.test_operators import SF, docs_of, odd_docs

from wrenchlake.llm import importance, queries

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def plain_features(text):
    words = WORD.findall((text or "").translate(LOWER))
    return words, Counter(zlib.crc32(" ".join(words[i : i + n]).encode()) % 10000 for n in (1, 2, 3) for i in range(len(words) - n + 1))


def plain(docs, target, percent=5, min_words=20):
    """Rows of (doc_id, n_features, weight, score, rank) by loops."""
    own = [(i, *plain_features(t)) for i, t in docs]
    s, t = sum((c for _, _, c in own), Counter()), sum((plain_features(x)[1] for x in target), Counter())
    of_s, of_t = s.total(), t.total()
    gain = [math.floor(1000 * math.log((t[b] + 1) * (of_s + 10000) / ((s[b] + 1) * (of_t + 10000)))) for b in range(10000)]
    rows = []
    for i, words, c in own:
        weight = sum(gain[b] * n for b, n in c.items())
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append((i, c.total(), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(words)))
    fit = sorted([k for k, r in enumerate(rows) if r[4] >= min_words], key=lambda k: (-rows[k][3], rows[k][0] is None, rows[k][0] or 0))
    rank = {k: n for n, k in enumerate(fit[: percent * len(fit) // 100], 1)}
    return sorted([(*r[:4], rank.get(k)) for k, r in enumerate(rows)], key=str)


def same(got, want):
    assert sorted(map(tuple, got.collect()), key=str) == want


def test_query_equals_loops(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    target = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    got = queries.QUERIES["op12_importance"](spark, SF)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"] and {t for _, t in got.dtypes} == {"bigint"}
    same(got, plain(docs, target))


def test_odd_documents(spark):
    docs, target = odd_docs(spark), [None, "", "Alpha BETA gamma", "日本語", "one two"]
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    named = docs.withColumnRenamed("lang", "buckets").withColumnRenamed("source", "a.b").withColumnRenamed("key", "__part")
    wanted = spark.createDataFrame([(t, 1) for t in target], "text string, n int")
    same(importance.resample(named, wanted, percent=60, min_words=2), plain(rows, target, 60, 2))
    same(importance.resample(docs, wanted.limit(0), percent=100, min_words=0), plain(rows, [], 100, 0))
    assert importance.resample(docs.limit(0), wanted).count() == 0


def test_texts_with_any_characters(spark):
    rng = random.Random(8)
    letters = "AaBbZz09 .-_`{|}~@[/:\n\t\x00\x7f\x80éÉß日'"
    rows = [(i, "".join(rng.choice(letters) for _ in range(rng.randint(0, 200)))) for i in range(200)]
    target = spark.createDataFrame([(rows[3][1],)], "text string")
    same(importance.resample(docs_of(spark, rows), target, percent=50, min_words=3), plain(rows, [rows[3][1]], 50, 3))


def test_ties_and_repeated_rows(spark):
    rows = [(i % 7, "a b c d e f g h " * (1 + i % 3)) for i in range(60)] + [(5, "x y z " * 9)] * 90
    target = spark.createDataFrame([("a b",)], "text string")
    same(importance.resample(docs_of(spark, rows).repartition(5), target, percent=50), plain(rows, ["a b"], 50))


@pytest.mark.parametrize("limit", [1, 2, 7, 50])
def test_pieces_lose_and_repeat_nothing(limit):
    rng = random.Random(limit)
    for _ in range(200):
        text = "".join(rng.choice("ab c.-") for _ in range(rng.randint(0, 80)))
        words, got = WORD.findall(text), []
        for context, part in importance.pieces(text, limit):
            own = WORD.findall(part)
            assert context == min(2, len(got)) and own[:context] == got[len(got) - context :]
            got += own[context:]
        assert got == words


def test_long_text_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(importance, "SLICE", 1000)
    rng = random.Random(9)
    texts = [" ".join(rng.choice("alpha beta Gamma d e f".split()) for _ in range(n)) for n in (3000, 1, 5, 2000)]
    con = importance.connect()
    row, bucket, n = importance._counts(con, texts)
    for k, text in enumerate(texts):
        at = row == k
        assert dict(zip(bucket[at].tolist(), n[at].tolist())) == dict(plain_features(text)[1])
    long = "word " * 400_000
    assert importance._counts(con, [long])[2].sum() == 3 * 400_000 - 3


def test_ranks_have_no_gaps_and_follow_the_order(spark):
    rows = importance.stored(spark.range(5000).selectExpr("pmod(xxhash64(id), 40) as score", "id % 900 as doc_id"), "test-ranks")
    got = importance.ranked(rows, [importance.F.desc("score"), importance.F.asc("doc_id")]).orderBy("rank").collect()
    assert [r["rank"] for r in got] == list(range(1, 5001))
    keys = [(-r.score, r.doc_id) for r in got]
    assert keys == sorted(keys)
