"""The training-data operators against brute force, the reference libraries and edge cases."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from array import array
from collections import Counter
from itertools import combinations

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import xxhash
from pyspark.sql import functions as F

from tests import oracle
from wrenchlake.llm import common, components, hamming, imatch, langid, linededup, mixing, quality, queries, sentencepiece_bpe, sharding, simhash, warc

SF = "/root/testdata/sf0.001"
DOC = "doc_id long, text string, lang string, source string, n_chars long, score double, key string, n long"


def docs_of(spark, texts, lang="en", source="s"):
    rows = [(i, t, lang, source, None if t is None else len(t), 0.5, "k", 1) for i, t in texts]
    return spark.createDataFrame(rows, DOC)


def odd_docs(spark):
    """Null and repeated ids, null, empty and long texts, ties; columns whose names clash with those of results."""
    long = "alpha beta gamma delta. " * 3000
    texts = [(1, "one two three four five"), (1, "one two three four five"), (2, None), (3, ""), (None, "one two three"), (4, long), (5, "  \n\t "), (6, "one two three four five"), (7, "日本語 テキスト\nline"), (8, "x" * 20000)]
    return docs_of(spark, texts)


@pytest.fixture(scope="module")
def sample(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


# --- components, hamming ---


def test_components(spark):
    chain = [(i, i + 1) for i in range(60)] + [(100, 200), (200, 100), (300, 300), (None, 5)]
    got = dict(components.connected_components(spark.createDataFrame(chain, "src long, dst long")).collect())
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 200: 100}
    assert components.connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


@pytest.mark.parametrize("radius,segments", [(3, 2), (5, 3)])
def test_radius_pairs_are_complete(spark, radius, segments):
    rng = random.Random(1)
    codes = {rng.getrandbits(64) for _ in range(60)}
    for c in list(codes):
        codes |= {c ^ sum(1 << b for b in rng.sample(range(64), rng.randint(1, radius + 1))) for _ in range(3)}
    signed = [c - (1 << 64) if c >> 63 else c for c in codes]
    got = {tuple(r) for r in hamming.radius_pairs(spark.createDataFrame([(c,) for c in signed], "code long"), "code", radius, segments).collect()}
    want = {(min(a, b), max(a, b)) for a, b in combinations(signed, 2) if ((a ^ b) & (2**64 - 1)).bit_count() <= radius}
    assert got == want


def test_topk_with_ties_and_hot_codes(spark):
    rng = random.Random(2)
    rows = [(i, rng.getrandbits(62)) for i in range(150)] + [(1000 + i, 77) for i in range(40)] + [(None, 5), (2000, None)]
    asked = [(1, 77), (2, rng.getrandbits(62)), (3, None)]
    got = hamming.topk_search(spark.createDataFrame(rows, "id long, code long"), spark.createDataFrame(asked, "query_id long, query_code long"), 7).collect()
    for q, c in asked[:2]:
        want = sorted(((c ^ x).bit_count(), i) for i, x in rows if i is not None and x is not None)[:7]
        assert [(r.distance, r.id) for r in sorted((r for r in got if r.query_id == q), key=lambda r: r["rank"])] == want
    few = spark.createDataFrame([(1, 0), (1, 0), (2, 1)], "id long, code long")
    assert hamming.topk_search(few, few.selectExpr("id as query_id", "code as query_code"), 10).count() == 4
    assert hamming.topk_search(few.limit(0), few.selectExpr("id as query_id", "code as query_code"), 10).count() == 0


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_queries_with_sql(spark, name):
    oracle.same(queries.QUERIES[name](spark, SF).toPandas(), oracle.connect(SF).sql(queries.ORACLE_SQL[name]).df())


# --- 1 ---


def test_warc_false_magic_and_borders(spark, tmp_path):
    rng = random.Random(3)
    payloads = [b"", b"a" * 99, b"b" * 100, "é\r\n\r\nWARC/1.1\r\n".encode() * 9, bytes(rng.randbytes(50_000)), warc.gzip_member(b"WARC/x") + warc.MAGIC * 30]
    path, where = tmp_path / "x.warc.gz", []
    with open(path, "wb") as f:
        for i, p in enumerate(payloads):
            where.append(f.tell())
            # stored, not deflated: the payload's own magic bytes stand in the file as they are
            f.write(warc.gzip_member(warc.build_record(i, "http://x/\r\n y", p, hashlib.sha256(p).hexdigest(), None), level=0))
    size = path.stat().st_size
    for step in (1000, 777, size):
        got = [r for a in range(0, size, step) for r in warc.records_between(str(path), size, a, min(size, a + step))]
        assert [(r["offset"], r["page_id"], r["payload"], r["intact"]) for r in got] == [(w, i, p, True) for i, (w, p) in enumerate(zip(where, payloads))]


def test_warc_revisits_and_odd_pages(spark):
    """Every row has a record: null and repeated ids, null and very long pages, clashing column names."""
    body, long = "p" * 100, "é<p>" * 300_000
    rows = [(5, "u", body), (3, None, body), (9, "u", body), (1, "u", "short"), (2, "u", "short"), (4, "u", None), (6, "u", ""), (None, "u", body), (None, "u", None), (9, "u", body), (9, "v", "other"), (3, "w", body), (7, "u", long)]
    pages = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], "page_id long, url string, html string, payload long, nth long, digest long")
    got = [(r.page_id, r.warc_type, r.refers_to_page, r.payload_bytes, r.intact) for r in warc.round_trip(spark, pages, split_bytes=200).collect()]
    of = lambda i: sorted(r[1:4] for r in got if r[0] == i)
    assert len(got) == len(rows) and all(r[4] for r in got)
    assert of(3) == [("response", None, 100), ("revisit", 3, 100)] and of(5) == [("revisit", 3, 100)]
    assert sorted(map(str, of(9))) == sorted(map(str, [("response", None, 5), ("revisit", 3, 100), ("revisit", 3, 100)]))
    assert of(1) == of(2) == [("response", None, 5)] and of(4) == of(6) == [("response", None, 0)] and of(7) == [("response", None, len(long.encode()))]
    assert sorted(r[1:4] for r in got if r[0] is None) == [("response", None, 0), ("response", None, 100)]
    assert warc.round_trip(spark, pages.limit(0)).count() == 0


def test_warc_member_of_several_records(tmp_path):
    record = lambda i, p: warc.build_record(i, "http://x/", p, hashlib.sha256(p).hexdigest(), None)
    path = tmp_path / "x.warc.gz"
    path.write_bytes(warc.gzip_member(record(1, b"one") + record(2, b"two WARC/1.1\r\n") + record(3, b"")) + warc.gzip_member(record(4, b"four")))
    got = list(warc.records_between(str(path), path.stat().st_size, 0, path.stat().st_size))
    assert [(r["page_id"], r["payload"], r["intact"]) for r in got] == [(1, b"one", True), (2, b"two WARC/1.1\r\n", True), (3, b"", True), (4, b"four", True)]


# --- 2, 10 ---


def test_quality_on_held_out(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    got = quality.score_documents(docs, labels).join(labels, "doc_id").where("held_out").toPandas()
    assert (got.predicted == got.quality).mean() > 0.93
    assert got[got.quality == 1].predicted.mean() > 0.97


def test_quality_attention_by_hand():
    rng = np.random.default_rng(0)
    model = quality.Model.start(rng)
    text = "Some text. " * 100
    x = np.vstack([f for f, _ in quality.encode_passages([text])])
    h, _, _, e = model.attend(x)
    a = np.exp(e) / np.exp(e).sum()
    assert np.allclose(model.scores([text, ""])[0], 1 / (1 + np.exp(-((a @ h) @ model.c + model.b))))
    long = "word " * 700_000  # several blocks
    parts = [n for f, o in quality.encode_passages([long]) for n in o]
    assert len(parts) == -(-len(long) // quality.PASSAGE)


def test_quality_odd_rows(spark):
    labels = spark.createDataFrame([(1, 1, 0), (4, 0, 0), (None, 1, 0), (6, None, 0), (7, 9, 0)], "doc_id long, quality int, toxic int")
    got = quality.score_documents(odd_docs(spark), labels).collect()
    assert len(got) == 10 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    assert {r.score for r in quality.score_documents(odd_docs(spark), labels.limit(0)).collect()} == {0.5}
    assert quality.keep_good(odd_docs(spark), labels).columns == odd_docs(spark).columns
    assert quality.score_documents(odd_docs(spark).limit(0), labels).count() == 0


def test_language_on_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = langid.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").toPandas()
    assert (got.lang_pred == got.lang).mean() > 0.97


def test_language_odd_rows(spark, sample):
    model = langid.fit_on(sample, 50)
    assert model.predict([None, "", "123 !", "The and of the thing"])[:3] == [("und", 0.0, True)] * 3
    assert model.predict(["The and of the thing"])[0][0] == "en"
    got = langid.identify(odd_docs(spark)).collect()
    assert len(got) == 10 and {r.lang_pred for r in got if r.doc_id in (2, 3, 5)} == {"und"}
    assert {r.lang_pred for r in langid.identify(odd_docs(spark).withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    assert langid.identify(sample.limit(0)).count() == 0


def slow_ngrams(text):
    data = re.sub(rb"  +", b" ", b" " + bytes(b if b > 127 or chr(b).isalpha() else 32 for b in text.lower().encode()) + b" ")
    out = np.zeros(langid.DIMS)
    for n in (2, 3):
        for i in range(len(data) - n + 1):
            out[(int.from_bytes(data[i : i + n], "big") * 2654435761 + n * 40503) % 2**32 >> 20] += 1
    return out


@pytest.mark.parametrize("block", [1, 7, 1 << 20])
def test_ngrams_against_brute_force(monkeypatch, block):
    monkeypatch.setattr(langid, "BLOCK", block)
    texts = ["ab", "cd", "", "a", "abc déf 12 x", "The quick  brown--fox" * 5]
    assert np.array_equal(langid.ngram_counts(texts), np.array([slow_ngrams(t) for t in texts]))


def test_cosine_by_hand(sample):
    rows = [(r.text, r.lang) for r in sample.select("text", "lang").limit(60).collect()]
    model = langid.fit_model([t for t, _ in rows], [g for _, g in rows])
    df = sum((slow_ngrams(t) > 0).astype(int) for t, _ in rows)
    for text, _ in rows[:15]:
        v = np.sqrt(slow_ngrams(text)) * (np.log((1 + len(rows)) / (1 + df)) + 1)
        cosine = model.centroids @ (v / np.linalg.norm(v))
        lang, score, _ = model.predict([text])[0]
        assert lang == model.languages[model.language_of[cosine.argmax()]] and score == pytest.approx(cosine.max(), abs=1e-5)


def test_scores_are_functions_of_the_text(spark, sample):
    """Equal texts, other neighbours, other partitions: the same scores."""
    docs = sample.unionByName(sample.withColumn("doc_id", F.col("doc_id") + 1_000_000))
    model = langid.fit_on(sample, 100)
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    good = quality.fit_on(sample, labels, 200)
    for score in (langid.predict(F.col("text"), model)["score"], quality.score(F.col("text"), good)):
        a = docs.select("text", score.alias("s"))
        b = docs.repartition(3, "doc_id").select("text", score.alias("s"))
        spread = a.unionByName(b).groupBy("text").agg((F.max("s") - F.min("s")).alias("d"))
        assert spread.agg(F.max("d")).first()[0] <= 1e-9


def test_quality_gradients():
    """Fitting steps go against the loss's slope, found by differences."""
    texts, labels = ["Good text, well said. " * 60, "#$%&@ 123 !!! " * 50, "plain words here " * 40, "AAAA@@@@ " * 70], [1, 0, 1, 0]
    weight = np.ones(4)  # both classes are as common

    def loss(model):
        p = model.scores(texts)
        return -np.mean(weight * (np.array(labels) * np.log(p) + (1 - np.array(labels)) * np.log(1 - p)))

    model = quality.fit_model(texts, labels, seed=3)
    assert loss(model) < 0.9 * loss(quality.Model.start(np.random.default_rng(3)))
    x = [np.vstack([f for f, _ in quality.encode_passages([t])]) for t in texts]
    start = quality.Model.start(np.random.default_rng(3))
    grads = quality.gradients(start, x, np.array(labels, float), weight)
    rng = np.random.default_rng(1)
    for name, grad in grads.items():
        value = getattr(start, name)
        for _ in range(4):
            at = tuple(rng.integers(0, n) for n in value.shape)
            kept = value[at]
            value[at] = kept + 1e-5
            up = loss(start)
            value[at] = kept - 1e-5
            down = loss(start)
            value[at] = kept
            assert grad[at] == pytest.approx((up - down) / 2e-5, abs=1e-6)


def test_fit_samples_are_bounded(spark):
    """An id that repeats, and a very long text, do not make the sample that goes to the driver larger."""
    docs = docs_of(spark, [(1, "one two"), (2, "three"), (3, "x " * 40_000)]).crossJoin(spark.range(50)).drop("id")
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 1)], "doc_id long, quality int")
    seen = []
    fit, quality.fit_model = quality.fit_model, lambda t, y: seen.append((t, y)) or fit(t, y)
    try:
        quality.fit_on(docs, labels, 3)
    finally:
        quality.fit_model = fit
    assert len(seen[0][0]) == 3 and max(map(len, seen[0][0])) <= quality.FIT_CHARS
    fit, langid.fit_model = langid.fit_model, lambda t, y: seen.append((t, y)) or fit(t, y)
    try:
        langid.fit_on(docs, 10)
    finally:
        langid.fit_model = fit
    assert len(seen[1][0]) <= 3 and max(map(len, seen[1][0])) <= langid.FIT_BYTES


# --- 3 ---


def slow_fingerprint(text, size=3):
    words = [w for w in "".join(c.lower() if c.isascii() else c for c in text).replace("\t", " ").replace("\n", " ").replace("\x0b", " ").replace("\x0c", " ").replace("\r", " ").split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + size]) for i in range(len(words) - size + 1)] or [" ".join(words)]
    h = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


@pytest.mark.parametrize("words,radius,segments", [(3, 3, 2), (5, 5, 3)])
def test_simhash_against_brute_force(spark, sample, words, radius, segments):
    docs = sample.unionByName(sample.where("doc_id < 30").withColumn("doc_id", F.col("doc_id") + 100_000).withColumn("text", F.concat("text", F.lit(" end"))))
    rows = docs.select("doc_id", "text").collect()
    codes = {r.doc_id: slow_fingerprint(r.text or "", words) for r in rows}
    found = simhash.near_groups(docs, words=words, radius=radius, segments=segments).collect()
    got = {r.doc_id: (r.code & (2**64 - 1), r.component_id) for r in found}
    assert {k: v[0] for k, v in got.items()} == codes
    parent = {i: i for i in codes}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in combinations(sorted(codes), 2):
        if (codes[a] ^ codes[b]).bit_count() <= radius and find(a) != find(b):
            parent[max(find(a), find(b))] = min(find(a), find(b))
    assert {k: v[1] for k, v in got.items()} == {i: find(i) for i in codes}


def test_simhash_odd_rows(spark):
    got = [(r.doc_id, r.component_id) for r in simhash.near_groups(odd_docs(spark)).collect()]
    assert len(got) == 10 and {c for i, c in got if i in (2, 3, 5)} == {2} and {c for i, c in got if i in (1, 6)} == {1}
    kept = simhash.dedup(odd_docs(spark))
    assert kept.columns == odd_docs(spark).columns
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 2, 4, 7, 8]
    assert simhash.dedup(odd_docs(spark).limit(0)).count() == 0


# --- 4 ---


def brute_lines(rows):
    at, lines = {}, []
    for i, text in sorted(rows, key=lambda r: (r[0] is not None, r[0])):
        for n, line in enumerate((text or "").split("\n")):
            line = line.lower().strip(" ")
            if line:
                at.setdefault(line, []).append((-1 if i is None else i, n))
    lines = list(at)
    sets = [{x[j : j + 8] for j in range(max(1, len(x) - 7))} for x in lines]
    parent = list(range(len(lines)))

    def find(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for a, b in combinations(range(len(lines)), 2):
        common = len(sets[a] & sets[b]) if 0.8 * max(len(sets[a]), len(sets[b])) <= min(len(sets[a]), len(sets[b])) else 0
        if common >= 0.8 * (len(sets[a]) + len(sets[b]) - common):
            parent[find(a)] = find(b)
    groups = {}
    for i, x in enumerate(lines):
        groups.setdefault(find(i), set()).update(at[x])
    drops = {}
    for g in groups.values():
        for i, n in g - {min(g)}:
            drops.setdefault(i, set()).add(n)
    return drops


def test_lines_against_brute_force(spark, sample):
    extra = "\n".join("This line of the report is much the same but for number %d." % n for n in range(60))
    docs = sample.where("doc_id < 120").unionByName(docs_of(spark, [(5000, extra), (5001, extra)]).select(sample.columns))
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    drops = brute_lines(rows)
    for r in linededup.dedup_lines(docs).collect():
        text = dict(rows)[r.doc_id]
        assert r.text == "\n".join(x for n, x in enumerate(text.split("\n")) if n not in drops.get(r.doc_id, ()))


def components_of(spark, lines):
    """The lines' components, by their numbers."""
    made = spark.createDataFrame(lines, "line_id long, line string")
    signed, weak = linededup.signatures(made)
    assert not weak.take(1)
    return {r[0]: r[1] for r in linededup.near_lines(linededup.buckets(signed), made).collect()}


@pytest.mark.parametrize("size", [60, 300])
def test_lines_recall_in_a_crowd(spark, size):
    """Edits of one line, most of them less alike than 0.8: of the pairs that brute force links, at least 0.9 are linked; none besides."""
    rng = random.Random(size)
    word = lambda n: "".join(rng.choice("abcdefghijklmnop") for _ in range(n))
    base, lines = word(size), []
    for i in range(250):
        x = base
        for _ in range(rng.randint(1, max(1, size // 40))):
            at = rng.randrange(size - 10)
            x = x[:at] + word(rng.randint(1, 8)) + x[at + rng.randint(1, 8) :]
        lines.append((i, x))
    found = components_of(spark, lines)
    sets = [{x[j : j + 8] for j in range(len(x) - 7)} for _, x in lines]
    alike = lambda a, b: len(sets[a] & sets[b]) / len(sets[a] | sets[b])
    links = [(a, b) for a, b in combinations(range(len(lines)), 2) if alike(a, b) >= 0.8]
    assert len(links) > 30
    assert np.mean([found.get(a, a) == found.get(b, b) for a, b in links]) >= 0.9
    parent = list(range(len(lines)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in links:
        parent[max(find(a), find(b))] = min(find(a), find(b))
    assert all(find(i) == find(c) for i, c in found.items())


def test_lines_short_and_long_meet(spark):
    """Lines of any length share a key with their near copies: short ones, those near the border, long and repetitive ones."""
    rng = random.Random(9)
    word = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    missed = {}
    for size in (11, 30, 95, 110, 400):
        pairs = [(2 * i, word(size)) for i in range(400)]
        differ = max(1, round(0.09 * (size - 7)))
        pairs += [(i + 1, x + "#" if size == 11 else x[:-differ] + "0123456789"[:differ].ljust(differ, "#")) for i, x in pairs]
        keys = {}
        for r in linededup.signatures(spark.createDataFrame(pairs, "line_id long, line string"))[0].collect():
            keys.setdefault(r.line_id, set()).update(r["keys"])
        missed[size] = np.mean([not keys[i] & keys[i + 1] for i in range(0, 800, 2)])
    assert max(missed.values()) <= 0.02, missed
    found = components_of(spark, [(1, "-" * 60), (2, "-" * 500), (3, "=-" * 90), (4, "-=" * 30 + "-")])
    assert found == {1: 1, 2: 1, 3: 3, 4: 3}


def test_lines_weakly_signed(spark):
    """A long line of few shingles that was not told as such is signed again and meets its short near copy."""
    rng = random.Random(5)
    word = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    core = word(23)
    long = core + core * 9
    signed = spark.createDataFrame([(1, [1], False), (2, [2], False)], "line_id long, keys array<long>, collides boolean")
    texts = spark.createDataFrame([(1, long), (2, core * 3)], "line_id long, line string")
    again = linededup._signed(texts.where("line_id = 2"), F.array(F.lit(0))).first()["keys"]
    signed = signed.where("line_id = 1").unionByName(spark.createDataFrame([(2, again, False)], signed.schema))
    more = linededup._more_buckets(signed, texts.where("line_id = 1").select("line_id"), texts)
    assert {r.line_id for r in more.collect()} == {1, 2}


def test_lines_clashing_columns(spark):
    docs = docs_of(spark, [(1, "a line that is there twice\nanother one here"), (2, "a line that is there twice")]).select("doc_id", "text")
    docs = docs.selectExpr("doc_id", "text", "1 as drops", "2 as n_lines", "3 as n_dropped", "4 as line", "5 as line_id", "6 as key", "7 as __drops", "8 as __id", "9 as `a.b`")
    got = linededup.dedup_lines(docs)
    assert got.columns == ["doc_id", "text", "drops", "line", "line_id", "key", "__drops", "__id", "a.b", "n_lines", "n_dropped"]
    assert {(r.doc_id, r.text, r.n_lines, r.n_dropped, r.drops, r["a.b"]) for r in got.collect()} == {(1, "a line that is there twice\nanother one here", 2, 0, 1, 9), (2, "", 1, 1, 1, 9)}


def test_lines_odd_rows(spark):
    got = linededup.dedup_lines(odd_docs(spark)).collect()
    assert len(got) == 10 and [r.text for r in got if r.doc_id == 2] == [None] and [r.text for r in got if r.doc_id == 3] == [""]
    assert [r.text for r in got if r.doc_id == 6] == [""] and [r.n_dropped for r in got if r.doc_id == 6] == [1]
    assert [r.text for r in got if r.doc_id == 5] == ["  \n\t "]
    assert linededup.dedup_lines(odd_docs(spark).limit(0)).count() == 0


# --- 5 ---


def test_flow_is_cheapest():
    supply, capacity = [50, 10, 0, 30], [20, 20, 25, 30]
    flows = sharding.min_cost_flow(supply, capacity)
    assert [sum(v for (i, _), v in flows.items() if i == k) for k in range(4)] == supply
    assert all(sum(v for (_, j), v in flows.items() if j == k) <= capacity[k] for k in range(4))
    assert sum(v for (i, j), v in flows.items() if i != j) == 30
    with pytest.raises(ValueError):
        sharding.min_cost_flow([5], [4])


def test_shards(spark, sample):
    got = sharding.shard_documents(sample).toPandas()
    sizes = got.groupby("shard")["size"].sum()
    assert len(sizes) == 8 and sizes.max() - sizes.min() <= 2 * got["size"].max()
    for _, g in got.groupby("shard"):
        assert sorted(g.slot) == list(range(len(g)))
    moved = got[got.old_shard != got.shard]["size"].sum()
    fair = got["size"].sum() / 8
    least = sum(max(0, s - fair) for s in got.groupby("old_shard")["size"].sum())
    assert moved <= least + 8 * got["size"].max()
    text = {r.doc_id: (r.text or "").encode() for r in sample.collect()}
    assert all((len(text[i]) + 1, zlib.crc32(text[i])) == (n, c) for i, n, c in zip(got.doc_id, got["size"], got.text_crc32))
    assert got.equals(sharding.shard_documents(sample.repartition(7)).toPandas().set_index("doc_id").loc[got.doc_id].reset_index()[got.columns])


def test_shards_of_odd_rows(spark):
    got = sharding.shard_documents(odd_docs(spark)).collect()
    assert len(got) == 10
    for s in {r.shard for r in got}:
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
    assert sharding.shard_documents(odd_docs(spark).limit(0)).count() == 0


def test_rewrite(spark, sample, tmp_path):
    placed = sharding.shard_documents(sample)
    old = sample.join(placed.select("doc_id", "old_shard"), "doc_id").withColumnRenamed("old_shard", "shard")
    old.write.partitionBy("shard").parquet(str(tmp_path / "old"))
    stayed = sharding.rewrite(spark, str(tmp_path / "old"), str(tmp_path / "new"), placed)
    new = spark.read.parquet(str(tmp_path / "new")).select("doc_id", "shard")
    assert {tuple(r) for r in new.collect()} == {(r.doc_id, r.shard) for r in placed.collect() if r.old_shard not in stayed}


def test_rewrite_of_odd_rows(spark, tmp_path):
    docs = odd_docs(spark).unionByName(docs_of(spark, [(None, "one two three"), (None, None), (1, "other")])).select("doc_id", "text")
    placed = sharding.shard_documents(docs)
    docs.withColumn("shard", F.pmod(F.xxhash64("doc_id"), F.lit(6)).cast("int")).write.partitionBy("shard").parquet(str(tmp_path / "old"))
    stayed = sharding.rewrite(spark, str(tmp_path / "old"), str(tmp_path / "new"), placed)
    new = spark.read.parquet(str(tmp_path / "new")).select("doc_id", F.octet_length(F.coalesce("text", F.lit(""))) + 1, "shard")
    assert sorted(map(str, new.collect())) and sorted(str(tuple(r)) for r in new.collect()) == sorted(str((r.doc_id, r["size"], r.shard)) for r in placed.collect() if r.old_shard not in stayed)
    back = sharding.reshard(docs)
    assert sorted(str(tuple(r)) for r in back.collect()) == sorted(str(tuple(r)) for r in placed.collect())
    assert sharding.reshard(docs.limit(0)).count() == 0


def test_query_writes_shards(spark, monkeypatch):
    called = []
    rewrite = sharding.rewrite
    monkeypatch.setattr(sharding, "rewrite", lambda *a, **k: called.append(a) or rewrite(*a, **k))
    assert queries.op5_sharding(spark, SF).count() == spark.read.parquet(f"{SF}/documents.parquet").count() and called


# --- 7 ---


@pytest.fixture(scope="module")
def codec():
    model = sentencepiece_bpe.read_model(public_tokenizers.path("piece_bpe_32k.model"))
    return sentencepiece_bpe.PieceCodec(model), sentencepiece.SentencePieceProcessor(model_proto=model)


def test_pieces_like_the_library(codec, sample):
    own, lib = codec
    rng = random.Random(5)
    pieces = [lib.id_to_piece(i).replace("▁", " ") for i in range(259, 32000)]
    texts = [r.text for r in sample.select("text").collect()]
    texts += ["", " ", "   ", "\n\n ", "▁x▁", "<s></s><unk><0x0A>", "é中😀​\x00", "a" * 3000, "中" * 3000]
    texts += ["".join(rng.choice(pieces) for _ in range(rng.randint(1, 12))) for _ in range(2000)]
    texts += ["".join(rng.choice(" ab\n\téß中😀the.,1") for _ in range(rng.randint(0, 30))) for _ in range(2000)]
    for t in texts:
        ids = lib.encode(t, add_bos=True, add_eos=True)
        packed, decoded = own.encode_decode(t)
        assert array("I", packed).tolist() == ids and decoded.decode() == lib.decode(ids), t
        assert own.decode(ids) == lib.decode(ids)
    for _ in range(2000):
        ids = [rng.choice((rng.randrange(3, 259), rng.randrange(32000))) for _ in range(6)]
        assert own.decode(ids) == lib.decode(ids), ids


def test_encode_documents(spark, codec):
    got = {r.doc_id: r for r in sentencepiece_bpe.encode_documents(odd_docs(spark), public_tokenizers.path("piece_bpe_32k.model")).collect()}
    empty = hashlib.sha256(array("I", [1, 2]).tobytes()).hexdigest()
    assert (got[2].n_tokens, got[2].ids_sha256, got[2].decoded_sha256) == (2, empty, hashlib.sha256(b"").hexdigest())
    assert len(got) == 9


def test_caches_are_bounded_and_emptied(codec, monkeypatch):
    own, lib = codec
    own.forget()
    monkeypatch.setattr(own.kept, "limit", 20_000)
    rng = random.Random(8)
    for _ in range(300):
        text = " ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(20))
        assert array("I", own.encode_decode(text)[0]).tolist() == lib.encode(text, add_bos=True, add_eos=True)
        assert own.kept.bytes <= 10_000 + 2_000 and len(own.kept) + len(own.kept.old) <= 20_000 // sentencepiece_bpe.ENTRY + 2
    own.forget()
    assert not own.kept and own.fits.cache_info().currsize == 0


def test_encode_an_empty_table(spark):
    got = sentencepiece_bpe.encode_documents(odd_docs(spark).limit(0), public_tokenizers.path("piece_bpe_32k.model"))
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and got.count() == 0


# --- 8 ---


def test_budgets():
    assert mixing.split_budget([100, 100, 100], [3, 1, 2]) == pytest.approx([200, 250 / 3, 500 / 3])
    assert sum(mixing.split_budget([10, 1000, 5, 0], [3, 1, 2, 3])) == pytest.approx(1.5 * 1015)
    assert mixing.split_budget([0, 0], [3, 1]) == [0.0, 0.0] and mixing.split_budget([], []) == []


def test_fit_counts_is_the_best_reachable():
    rng = random.Random(6)
    for _ in range(600):
        counts = {rng.randint(1, 40): rng.randint(1, 6) for _ in range(rng.randint(1, 6))}
        sums = {0}
        for n, c in counts.items():
            sums = {s + k * n for s in sums for k in range(c + 1)}
        budget = rng.randint(0, max(sums))
        for words in (mixing.DP_WORDS, 50):  # the smaller window tries only what the proportional part leaves
            took = mixing.fit_counts(counts, budget, words)
            got = sum(n * c for n, c in took.items())
            assert all(0 < took[n] <= counts[n] for n in took) and got <= budget
            assert got == max(s for s in sums if s <= budget)


@pytest.mark.parametrize("low,high,lengths", [(3000, 20_000, 12), (30_000, 90_000, 4), (2, 9, 5), (1000, 40_000, 40)])
def test_fit_counts_beyond_the_first_window(low, high, lengths):
    """The best reachable sum with the windows of production, of few long lengths, many short ones, and lengths beyond the first window."""
    rng = random.Random(low)
    for _ in range(8):
        counts = {rng.randint(low, high): rng.randint(1, 9 if low > 100 else 20_000) for _ in range(rng.randint(2, lengths))}
        total = sum(n * c for n, c in counts.items())
        budget = rng.randint(total // 3, total)
        bits = 1
        for n, c in counts.items():
            k = 1
            while c:
                k = min(k, c)
                bits |= bits << n * k
                c, k = c - k, 2 * k
        best = (bits & ((1 << budget + 1) - 1)).bit_length() - 1
        took = mixing.fit_counts(counts, budget)
        assert all(0 < took[n] <= counts[n] for n in took) and sum(n * c for n, c in took.items()) == best
    assert sum(n * c for n, c in mixing.fit_counts({40_000: 5, 50_000: 7, 9000: 1}, 215_000).items()) == 210_000


CLASHING = ["row", "id", "key", "of", "n", "times", "rows", "copy", "nth", "t_id", "t_key", "stay_id", "code", "component", "__n", "__t", "__r", "__k", "__rows", "__stay", "a.b", "doc id", "range", "draw"]


def clashing(df):
    for c in CLASHING:
        df = df.withColumn(c, F.lit(c)) if c not in df.columns else df
    return df


def test_any_column_names(spark):
    docs = clashing(odd_docs(spark).withColumn("n_chars", F.col("n_chars").cast("long")))
    for out in (mixing.apply_mix(docs), simhash.dedup(docs), linededup.dedup_lines(docs).select([F.col(f"`{c}`") for c in docs.columns])):
        assert out.columns == docs.columns and out.count() > 0
        assert {tuple(r) for r in out.select([F.col(f"`{c}`") for c in CLASHING if c not in ("n", "key")]).collect()} == {tuple(c for c in CLASHING if c not in ("n", "key"))}


def test_simhash_dedup_loses_no_text(spark):
    a, b, c = "alpha beta gamma delta epsilon zeta", "one two three four five six seven", "der die das und oder aber denn weil"
    rows = [(1, a), (1, b), (2, c), (2, a), (1, a), (None, b), (None, "nur hier steht dieser satz"), (None, "nur hier steht dieser satz"), (7, None), (6, ""), (3, c), (3, c)]
    kept = sorted(((r.doc_id or -1, r.text) for r in simhash.dedup(docs_of(spark, rows).repartition(3)).collect()), key=str)
    assert kept == sorted([(1, a), (1, b), (2, c), (-1, "nur hier steht dieser satz"), (6, "")], key=str)


def test_mix_of_repeated_rows(spark):
    """Equal rows share what the mix takes of them, to the word; all copies together are what ``mix`` says."""
    docs = docs_of(spark, [(1, "a b c")] * 5 + [(2, "d e")] * 3 + [(None, "f g h i")] * 2 + [(3, None)]).withColumn("__times", F.lit(1)).withColumn("size", F.lit(2))
    docs = docs.unionByName(docs_of(spark, [(9, "z " * 40)], source="t").withColumn("__times", F.lit(1)).withColumn("size", F.lit(2)))
    words = lambda df: sum(len((r.text or "").split()) for r in df.collect())
    mixed = mixing.apply_mix(docs)
    assert mixed.columns == docs.columns
    assert words(mixed) == sum(r.taken for r in mixing.mix(docs).collect())
    assert mixing.apply_mix(docs.limit(0)).count() == 0


def test_mix(spark, sample):
    got = mixing.mix(sample).toPandas()
    assert len(got) == sample.count()
    words = {r.doc_id: len((r.text or "").encode().split()) for r in sample.collect()}
    assert all(words[i] == n for i, n in zip(got.doc_id, got["size"]))
    assert (got.taken <= 2 * got["size"]).all() and (got[got["size"] > 0].taken % got[got["size"] > 0]["size"] == 0).all()
    for _, g in got.groupby("source"):
        assert abs(g.taken.sum() - g.target.iloc[0]) <= g["size"].max() and g.source_size.iloc[0] == g["size"].sum()
    again = mixing.mix(sample.repartition(5)).toPandas().set_index("doc_id").taken
    assert (again.loc[got.doc_id].values == got.taken.values).all()
    assert mixing.apply_mix(sample).groupBy().agg(F.sum(F.size(F.split(F.trim(F.regexp_replace("text", "[ \t\n\x0b\x0c\r]+", " ")), " ")))).first()[0] == got.taken.sum()


def test_mix_odd_rows(spark):
    docs = odd_docs(spark).withColumn("source", F.when(F.col("doc_id") > 5, "b"))
    got = mixing.mix(docs).collect()
    assert len(got) == 10 and all(r["size"] == 0 and r.taken == 0 for r in got if r.doc_id in (2, 3, 5))
    assert mixing.apply_mix(docs).columns == docs.columns
    assert mixing.mix(docs.limit(0)).count() == 0


def test_flows_move_the_least():
    """Of all ways to deal small shards, none moves fewer bytes than the flow, which keeps within supplies and capacities."""
    rng = random.Random(12)

    def least(supply, capacity):
        """By trying every deal of every shard's bytes."""
        def deals(n, room):
            if not room:
                return [()] if n == 0 else []
            return [(k, *rest) for k in range(min(n, room[0]) + 1) for rest in deals(n - k, room[1:])]

        def best(i, room):
            if i == len(supply):
                return 0
            found = [sum(k for j, k in enumerate(d) if j != i) + best(i + 1, tuple(r - k for r, k in zip(room, d))) for d in deals(supply[i], room)]
            return min(found, default=10**9)

        return best(0, tuple(capacity))

    for _ in range(60):
        supply = [rng.randint(0, 5) for _ in range(rng.randint(1, 3))]
        capacity = [rng.randint(0, 6) for _ in range(rng.randint(1, 4))]
        if sum(capacity) < sum(supply):
            with pytest.raises(ValueError):
                sharding.min_cost_flow(supply, capacity)
            continue
        flows = sharding.min_cost_flow(supply, capacity)
        assert all(sum(v for (i, _), v in flows.items() if i == a) == n for a, n in enumerate(supply))
        assert all(sum(v for (_, j), v in flows.items() if j == b) <= n for b, n in enumerate(capacity))
        assert sum(v for (i, j), v in flows.items() if i != j) == least(supply, capacity)


# --- 9 ---


def test_imatch_edits(spark, sample):
    docs = sample.unionByName(docs_of(spark, [(90_000, ""), (90_001, None), (90_002, "…"), (90_003, "x")]).select(sample.columns))
    rows = sorted((r.doc_id, r.text or "") for r in docs.collect())
    got = {r.doc_id: r for r in imatch.compare_edited(docs, parts=5).collect()}
    assert len(got) == len(rows)
    for k, (i, text) in enumerate(rows):
        q, following = len(text) // 4, rows[(k + 1) % len(rows)][1]
        edited = text[: len(text) - q] + following[:q]
        assert (got[i].n_chars, got[i].edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert 0 <= got[i].near_edited <= 1 and 0 <= got[i].near_next <= 1
        if edited == text:
            assert got[i].near_edited == 1 and got[i].fingerprint == got[i].edited_fingerprint
        if got[rows[(k + 1) % len(rows)][0]].fingerprint == got[i].fingerprint:
            assert got[i].near_next == 1
    by_text = {}
    for i, text in rows:
        assert by_text.setdefault(text, got[i].fingerprint) == got[i].fingerprint
    far = [r for r in got.values() if r.n_chars > 500]
    assert np.mean([r.near_edited for r in far]) > 0.25 > 0.05 > np.mean([r.near_next for r in far])


def _signed(v):
    return v - (1 << 64) if v >> 63 else v


def _hash(data, seed=42):
    return _signed(xxhash.xxh64_intdigest(data, seed & (2**64 - 1)))


def slow_imatch(texts):
    """Fingerprints of all texts as lists of strings, by loops, from the documents' own statistics."""

    def terms(text):
        for c in imatch.SEPARATORS:
            text = text.replace(c, " ")
        return list(dict.fromkeys(_hash(w.encode()) for w in text.lower().split(" ") if w))

    held = [t for text in texts for t in terms(text)]
    count = Counter(held)
    low, high = max(2, imatch.LEAST_SHARE * len(texts)), max(2, imatch.MOST_SHARE * len(texts))

    def of(text):
        own = terms(text)
        used = sorted([t for t in own if low <= count.get(t, 0) <= high] or own)
        out = []
        level = len(used).bit_length() - 1
        for number in range(level * imatch.SUBSETS, (level + imatch.LEVELS) * imatch.SUBSETS) if used else ():
            mask = (1 << number // imatch.SUBSETS) - 1
            chosen = [t for t in used if _hash(number.to_bytes(4, "little"), _hash(t.to_bytes(8, "little", signed=True))) & mask == 0]
            if chosen:
                h = 42
                for t in chosen:
                    h = _hash(t.to_bytes(8, "little", signed=True), h)
                out.append(f"{number:03d}:{h & (2**64 - 1):016x}"[:4] + f"{h & (2**64 - 1):016x}"[-imatch.HEX :])
        return out

    return of


def slow_likeness(a, b):
    either = {e[:3] for e in a} | {e[:3] for e in b}
    return len(set(a) & set(b)) / len(either) if either else 1.0


def test_imatch_against_loops(spark, sample):
    docs = sample.unionByName(docs_of(spark, [(90_000, ""), (90_001, None), (90_002, "… .,"), (90_003, "x"), (90_004, "ÀB àb, (ab)|Ab!"), (90_005, "unheard words only here")]).select(sample.columns))
    rows = sorted((r.doc_id, r.text or "") for r in docs.collect())
    of = slow_imatch([t for _, t in rows])
    prints = {i: of(t) for i, t in rows}
    got = {r.doc_id: r for r in imatch.compare_edited(docs, parts=4).collect()}
    for k, (i, text) in enumerate(rows):
        after = rows[(k + 1) % len(rows)]
        q = len(text) // 4
        edited = of(text[: len(text) - q] + after[1][:q])
        assert got[i].fingerprint == " ".join(prints[i]) and got[i].edited_fingerprint == " ".join(edited), i
        assert got[i].near_edited == pytest.approx(slow_likeness(prints[i], edited)) and got[i].near_next == pytest.approx(slow_likeness(prints[i], prints[after[0]]))
    assert {r.doc_id: r.hashes for r in imatch.fingerprints(docs).collect()} == prints


def test_imatch_odd_rows(spark):
    assert imatch.compare_edited(odd_docs(spark), parts=3).count() == 10
    assert imatch.fingerprints(odd_docs(spark)).count() == 10
    one = imatch.compare_edited(docs_of(spark, [(1, "one two three four")])).first()
    assert one.edited_sha256 == hashlib.sha256(b"one two three one ").hexdigest()
    assert imatch.compare_edited(odd_docs(spark).limit(0)).count() == 0


def test_no_python_in_native_plans(spark, sample):
    for df in (imatch.compare_edited(sample), linededup.dedup_lines(sample)):
        plan = df._jdf.queryExecution().toString()
        assert not any(w in plan for w in ("Python", "Pandas", "Arrow"))


def test_batches_are_bounded(spark):
    rows, size = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"
    before, texts = spark.conf.get(rows), spark.createDataFrame([(i, f"word {i % 7} " * 40) for i in range(5000)], "doc_id long, text string")
    try:
        spark.conf.set(rows, 10_000)
        groups = simhash.near_groups(texts)
        assert int(spark.conf.get(rows)) == common.BATCH_ROWS and int(spark.conf.get(size).rstrip("b")) == common.BATCH_BYTES
        assert len({r.code for r in groups.collect()}) == 7
        spark.conf.set(rows, 10)
        assert simhash.near_groups(texts).count() == 5000 and spark.conf.get(rows) == "10"
    finally:
        spark.conf.set(rows, before)


def test_merged_components_equal_those_of_all_edges(spark):
    rng = random.Random(11)
    edges = [(rng.randrange(120), rng.randrange(120)) for _ in range(110)] + [(5, None), (None, 6), (7, 7)]
    made = lambda rows: spark.createDataFrame(rows, "src long, dst long")
    want = sorted(map(tuple, components.connected_components(made(edges)).collect()))
    for n in (0, 40, 80, len(edges)):
        parts = common.cut(components.connected_components(made(edges[:n])))
        assert sorted(map(tuple, components.merged(parts, made(edges[n:])).collect())) == want


def test_line_dedup_meets_a_pair_in_one_bucket(spark):
    """Lines of different components that share several buckets: each pair is met once, also where the buckets' largest components differ."""
    text = " ".join(f"word{i:03d}" for i in range(12))
    lines = spark.createDataFrame([(n, text + f" {n}") for n in range(1, 6)], "line_id long, line string")
    part = {1: 1, 2: 1, 3: 3, 4: 4, 5: 3}
    held = {10: (1, 2, 3, 4), 11: (1, 3, 4, 5), 12: (2, 3, 4, 5), 13: (3, 5, 4)}
    main = {10: 1, 11: 3, 12: 3, 13: 3}
    split = spark.createDataFrame([(k, n, part[n], main[k]) for k, ns in held.items() for n in ns], "key long, line_id long, part long, main long")
    sketches = linededup._sketches(lines)
    side = lambda x: sketches.withColumnsRenamed({c: f"{x}_{c}" for c in sketches.columns if c != "line_id"})
    got = sorted(map(tuple, linededup._across(split, side("a"), side("b")).collect()))
    assert got == sorted({(a, b) for ns in held.values() for a in ns for b in ns if a < b and part[a] != part[b]})


def test_lines_unlike_lines_share_few_buckets(spark):
    """Of 4000 long lines that have a tenth of their shingles in common few share a band; near copies that share many bands are met in one bucket."""
    rng = random.Random(11)
    word = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    base = word(27)
    signed, _ = linededup.signatures(spark.createDataFrame([(i, base + word(180)) for i in range(4000)], "line_id long, line string"))
    assert linededup.buckets(signed).count() <= 12
    keys = spark.createDataFrame([(1, [5, 6, 7], False), (2, [5, 6, 7], False), (3, [7, 8], False)], "line_id long, keys array<long>, collides boolean")
    assert sorted(map(tuple, linededup.buckets(keys).select("low", "line_id").collect())) == [(1, 1), (1, 1), (1, 2), (1, 2), (1, 3)]


def test_line_dedup_only_links_leave_the_join(spark):
    """Pairs that sketches can't rule out but that aren't alike don't leave the join of a bucket's components: no table of them grows with a group's square."""
    rng = random.Random(3)
    word = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    base = word(400)
    texts = [(n, base[:354] + word(46)) for n in range(1, 9)] + [(9, base), (10, base[:380] + word(20))]
    sets = {n: {x[j : j + 8] for j in range(len(x) - 7)} for n, x in texts}
    links = [(a, b) for a, b in combinations(sets, 2) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    sketches = linededup._sketches(spark.createDataFrame(texts, "line_id long, line string"))
    side = lambda x: sketches.withColumnsRenamed({c: f"{x}_{c}" for c in sketches.columns if c != "line_id"})
    split = spark.createDataFrame([(k, n, n, 9) for k in (1, 2) for n in sets], "key long, line_id long, part long, main long")
    likely = side("a").withColumnRenamed("line_id", "x").crossJoin(side("b").withColumnRenamed("line_id", "y")).where("x < y").where(linededup._possible())
    assert links == [(9, 10)] and likely.count() > 20
    assert sorted(map(tuple, linededup._across(split, side("a"), side("b")).collect())) == links
