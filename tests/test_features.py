"""Reranking, pairing, remembered choices, back-off, pages, GraphML, paths, stages, appends, ids and cached functions: against plain versions and odd input."""

from __future__ import annotations

import random
import uuid
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tests import oracle
from wrenchlake.functions import ids
from wrenchlake.operators import backoff, graph, matching, once, reranker, retrieval, retriever, stages
from wrenchlake.plans import feature_queries as Q
from wrenchlake.sources import appends, graphml, markup
from wrenchlake.streaming import memory

SF = "/root/testdata/sf0.001"


# --- reranker ---


def _docs(spark):
    rows = [(1, "brake disc brake pad"), (2, "the engine misfires, cylinder 2"), (3, None), (4, ""), (5, "Brake fluid"), (6, "été à l'usine ÉTÉ")]
    return spark.createDataFrame(rows, "id long, text string")


def test_bm25_by_hand(spark):
    import math

    docs = _docs(spark)
    stats = reranker.term_statistics(docs)
    df = {r.term: r.df for r in stats.terms.collect()}
    n, mean = stats.corpus.first()
    assert (df["brake"], df["été"], n) == (2, 1, 6) and mean == (4 + 5 + 0 + 0 + 2 + 5) / 6
    pairs = spark.createDataFrame([(10, 1), (10, 5), (10, 3), (10, 99), (11, 6), (12, 1), (10, 1)], "query_id long, id long")
    asked = spark.createDataFrame([(10, "BRAKE brake pad"), (11, "Été"), (12, None)], "query_id long, query_text string")
    got = {(r.query_id, r.id): r.bm25 for r in reranker.bm25(pairs, asked, docs, stats).collect()}
    idf = lambda d: math.log(1 + (6 - d + 0.5) / (d + 0.5))
    part = lambda d, tf, length: idf(d) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / mean))
    assert got == pytest.approx({(10, 1): part(2, 2, 4) + part(1, 1, 4), (10, 5): part(2, 1, 2), (10, 3): 0, (10, 99): 0, (11, 6): part(1, 2, 5), (12, 1): 0})


def test_statistics_are_stored(spark, tmp_path):
    stats = reranker.term_statistics(_docs(spark))
    for _ in range(2):
        stats.save(str(tmp_path / "s"))
    again = reranker.Statistics.load(spark, str(tmp_path / "s"))
    assert sorted(again.terms.collect()) == sorted(stats.terms.collect()) and again.corpus.collect() == stats.corpus.collect()
    empty = reranker.term_statistics(_docs(spark).limit(0))
    assert empty.terms.count() == 0 and empty.corpus.first().n_docs == 0


def test_rerank_rules(spark):
    docs = _docs(spark)
    asked = spark.createDataFrame([(1, "brake"), (2, "nothing of this")], "query_id long, query_text string")
    found = spark.createDataFrame([(1, 2, 1), (1, 3, 2), (1, 5, 3), (1, 1, 4), (2, 2, 1), (2, 1, 2)], "query_id long, id long, rank int")
    scorer = reranker.bm25_scorer(reranker.term_statistics(docs))
    ranked = lambda df: {q: [r.id for r in sorted(df.collect(), key=lambda r: r["rank"]) if r.query_id == q] for q in (1, 2)}
    assert ranked(reranker.rerank(found, asked, docs, scorer, 3)) == {1: [5, 2, 3], 2: [2, 1]}  # the fourth is never scored; equal scores keep their order
    assert ranked(reranker.rerank(found, asked, docs, scorer, 9)) == {1: [1, 5, 2, 3], 2: [2, 1]}
    off = reranker.rerank(found, asked, docs, None, 2)
    assert ranked(off) == {1: [2, 3], 2: [2, 1]} and {r.rerank_score for r in off.collect()} == {0.0}
    for k in (0, -1):
        assert reranker.rerank(found, asked, docs, scorer, k).count() == 0
    assert reranker.rerank(found.limit(0), asked, docs, scorer, 3).count() == 0
    only = lambda pairs, asked, docs: pairs.where("id = 3").withColumn("rerank_score", F.lit(0.7))
    assert {r.id: r.rerank_score for r in reranker.rerank(found, asked, docs, only, 3).where("query_id = 1").collect()} == {3: 0.7, 2: 0.0, 5: 0.0}


def test_retrieve_with_reranker(spark):
    items = spark.createDataFrame([(1, [1.0, 0.0], 7, "other", " "), (2, [0.9, 0.1], 8, "brake pad", None), (3, [0.8, 0.2], 9, "x", "fuel pump")], "id long, vec array<double>, procedure_id int, title string, text string")
    queries = spark.createDataFrame([(5, [1.0, 0.0], None, ["brake", "pad"])], "query_id long, query_vec array<double>, query_text string, codes array<string>")
    none = spark.createDataFrame([], "query_id long, procedure_id int, kg_score double"), spark.createDataFrame([], "procedure_id int, feedback_score double")
    config = retriever.Config(rerank=True, weights={"embedding_similarity": 0.1, "rerank_score": 0.9, "kg_path_score": 0.0, "feedback_score": 0.0})
    assert [r.id for r in retriever.retrieve(items, queries, *none, config).orderBy("rank").collect()] == [2, 1, 3]
    assert [r.id for r in retriever.retrieve(items, queries, *none).orderBy("rank").collect()] == [1, 2, 3]


# --- pairing ---


def _greedy(wishes):
    seen, out = set(), []
    for record, _, wants in sorted(wishes, key=lambda w: (w[1] is None, w[1] or 0, w[0])):
        for n, p in enumerate(wants, 1):
            if p not in seen:
                seen.add(p)
                out.append((record, p, n))
                break
    return out


@pytest.mark.parametrize("seed", range(4))
def test_greedy_pairs_equal_the_loop(spark, seed):
    rng = random.Random(seed)
    wishes = [(i, rng.choice([None, *range(60)]), rng.sample(range(40), rng.randint(0, 5))) for i in range(120)]
    wishes += [(1000 + i, 1000 + i, [0, i]) for i in range(50)]  # one procedure that many ask for
    df = spark.createDataFrame(wishes, "record_id long, turn long, wants array<long>")
    want = _greedy(wishes)
    assert sorted(map(tuple, matching.greedy_pairs(df).collect())) == sorted(want)
    assert sorted(map(tuple, matching.greedy_pairs(df, 7).collect())) == sorted(want[:7])
    assert matching.greedy_pairs(df.limit(0)).count() == 0


def test_greedy_chain_of_refusals(spark):
    wishes = [(i, i, [max(0, i - 1), i]) for i in range(12)]
    df = spark.createDataFrame(wishes, "record_id long, turn long, wants array<long>")
    assert sorted(map(tuple, matching.greedy_pairs(df).collect())) == sorted(_greedy(wishes))


def test_greedy_query_over_whole_tables(spark):
    duck = oracle.connect(SF)
    firsts = dict(duck.sql("SELECT p_brand || '/' || p_size AS code, arg_min(p_partkey, {'a': p_retailprice, 'b': p_partkey}) FROM part GROUP BY code").fetchall())
    codes = duck.sql("""SELECT o_orderkey, -epoch_us(any_value(o_orderdate)), list(p_brand || '/' || p_size ORDER BY l_linenumber, p_brand || '/' || p_size)
        FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey GROUP BY o_orderkey""").fetchall()
    wishes = [(o, t, list(dict.fromkeys(firsts[c] for c in cs[:5]))) for o, t, cs in codes]
    assert sorted(map(tuple, Q.greedy_pairing(spark, SF).collect())) == sorted(_greedy(wishes))


def test_choices(spark):
    bridge = spark.createDataFrame([("A", 2.0, 1), ("A", 1.0, 2), ("A", 1.0, 3), ("B", 1.0, 2), ("C", 1.0, 9)], "code string, place double, procedure_id long")
    records = spark.createDataFrame([(1, [" ", "C", "A ", "B"]), (2, ["x"]), (3, None), (4, ["x", "x", "x", "x", "x", "A"]), (5, [None, "B"])], "record_id long, codes array<string>")
    assert sorted(map(tuple, matching.choices(records, bridge).collect())) == [(1, [9, 2]), (5, [2])]
    some = spark.createDataFrame([(5,), (4,)], "procedure_id long")
    assert sorted(map(tuple, matching.procedure_of(records, bridge, some).collect())) == [(1, 9, True), (2, 4, False), (3, 4, False), (4, 4, False), (5, 2, True)]


def test_substantive(spark):
    long = "the water pump was replaced and the system bled"
    rows = [(long, True), ("short", False), (None, False), (f"  {long[:39]}  ", False), (long + " Problem Solved!", False), ("", False)]
    got = spark.createDataFrame([r[:1] for r in rows], "s string").select(matching.substantive(F.col("s"))).collect()
    assert [r[0] for r in got] == [r[1] for r in rows]


def test_fixed_negatives(spark):
    rows = [(1, "q", "p", ["a", "b"]), (2, "q", "p", ["a", None, "p", "b", "c", "d", "e", "f"]), (3, "q", "p", []), (4, "q", "p", ["p"]), (5, "q", "p", ["a", "a", "b", "c", "d"])]
    df = spark.createDataFrame(rows, "sample_id long, anchor string, positive string, negatives array<string>")
    run = lambda seed: {r.sample_id: r.negatives for r in matching.fixed_negatives(df.repartition(3), 4, seed).collect()}
    got = run(1)
    assert got == run(1) and all(len(v) == 4 for v in got.values())
    assert got[1] == ["a", "b", "b", "b"] and got[3] == got[4] == ["q"] * 4
    assert len(set(got[2])) == 4 and set(got[2]) <= set("abcdef")
    assert len({tuple(run(s)[2]) for s in range(6)}) > 3


def test_pair_dataset(spark):
    rows = [(i, f"q{i}", "g1", ["g1", "g2", "g3"]) for i in range(300)] + [(900, None, "g1", ["g2"]), (901, "q", None, ["g2"]), (902, "q", "g1", ["g1"]), (903, "q", "g1", None)]
    df = spark.createDataFrame(rows, "sample_id long, anchor string, selected string, recommended array<string>")
    got = matching.pair_dataset(df, n=2).collect()
    assert len(got) == 300 and {tuple(r.negatives) for r in got} == {("g2", "g3")}
    held = {r.sample_id for r in got if r.validation}
    assert 30 < len(held) < 90 and held == {r.sample_id for r in matching.pair_dataset(df.where("sample_id % 2 = 0"), n=2).collect() if r.validation} | {i for i in held if i % 2}
    with pytest.raises(ValueError):
        matching.pair_dataset(df.limit(3), min_samples=4)


# --- remembered choices ---


@pytest.mark.parametrize("parts", [1, 3])
def test_memory_of_stream_and_batch_agree(spark, tmp_path, parts):
    rng = random.Random(parts)
    rows = [(i, rng.choice([None, [], ["P1"], ["P2", "P1"], ["P1", "P2"], ["P1", "P1"]]), rng.choice([None, "a", "b", "c"]), rng.choice([None, 1, 3, 4, 5])) for i in range(150)]
    events = spark.createDataFrame(rows, "event_id long, codes array<string>, doc_id string, rating int")
    want = {r.codes_key: (r.position, r.doc_ids) for r in memory.remembered(events).collect()}
    plain = defaultdict(list)
    for _, codes, doc, rating in rows:
        if codes is not None and doc is not None and (rating is None or rating >= 4) and doc not in plain[",".join(sorted(codes))]:
            plain[",".join(sorted(codes))].append(doc)
    assert {k: v[1] for k, v in want.items()} == dict(plain)
    for k in range(parts):
        events.where(F.pmod(F.hash("event_id"), F.lit(parts)) == k).coalesce(1).write.parquet(str(tmp_path / f"in/{k}"))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))
        last, triggers = {}, set()

        def take(batch, number):
            triggers.add(number)
            last.update({r.codes_key: (r.position, r.doc_ids) for r in batch.collect()})

        memory.remember(stream).writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).foreachBatch(take).start().awaitTermination(180)
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    assert last == want and len(triggers) == parts


def test_memory_feeds_the_boost(spark):
    events = spark.createDataFrame([(1, ["B", "A"], "d1", 5), (2, [], "d2", None), (3, ["A"], "d3", 2)], "event_id long, codes array<string>, doc_id string, rating int")
    candidates = spark.createDataFrame([(1, "d1", ["A", "B"]), (2, "d1", ["A", "C"]), (3, "d3", ["A"])], "query_id long, id string, codes array<string>")
    got = {r.query_id: r.boost for r in retrieval.overlap_boost(candidates, memory.patterns(memory.remembered(events))).collect()}
    assert got == pytest.approx({1: 1.2, 2: 1.05, 3: 1.0})


# --- back-off ---


def _loop(rows, keys, rotate_at, most):
    """A crawl's responses by nested conditions, one dictionary of everything."""
    out, by = {}, {}
    for crawl, seq, domain, status, proxied in sorted(rows, key=lambda r: (str(r[0]), r[1])):
        s = by.setdefault(crawl, {"key": 0, "kf": 0, "f": Counter(), "ban": set(), "gone": set()})
        said = "returned"
        if domain in s["ban"]:
            said = "ignored"
        elif keys and status in (403, 429) and not proxied:
            said = "returned" if domain in s["gone"] else "retry_with_proxy"
        elif keys and status in (403, 429):
            s["kf"] += 1
            if s["kf"] >= rotate_at and s["key"] < keys - 1:
                s["key"] += 1
                s["kf"], said = 0, "rotated"
            elif s["key"] == keys - 1:
                s["gone"].add(domain)
                said = "exhausted"
            else:
                s["f"][domain] += 1
                said = "failed"
                if s["f"][domain] >= most:
                    s["ban"].add(domain)
                    said = "banned"
        elif keys and status == 200 and proxied:
            s["f"][domain], s["kf"] = max(0, s["f"][domain] - 1), 0
        out[crawl, seq] = (said, s["key"], s["kf"], s["f"][domain], domain in s["ban"])
    return out


@pytest.mark.parametrize("keys,rotate_at,most", [(0, 2, 2), (1, 2, 2), (3, 3, 2), (4, 9, 3)])
def test_back_off_equals_the_loop(spark, keys, rotate_at, most):
    rng = random.Random(keys)
    rows = [(rng.choice([None, "a", "b", "c"]), i, rng.choice([None, "x", "y"]), rng.choice([None, 200, 200, 404, 403, 429]), rng.choice([None, True, True, False])) for i in range(400)]
    df = spark.createDataFrame(rows, "crawl string, seq long, domain string, status int, proxied boolean").repartition(7)
    got = {(r.crawl, r.seq): tuple(r)[5:] for r in backoff.back_off(df, keys, rotate_at, most).collect()}
    assert got == _loop(rows, keys, rotate_at, most)
    assert backoff.back_off(df.limit(0)).count() == 0


def test_back_off_query_over_the_whole_table(spark):
    rows = oracle.connect(SF).sql("SELECT user_id, event_id, event_type, CASE WHEN event_id * 7 % 10 < 5 THEN 403 WHEN event_id * 7 % 10 = 5 THEN 429 ELSE 200 END, event_id % 3 <> 0 FROM events").fetchall()
    got = {(r.crawl, r.seq): tuple(r)[5:] for r in Q.backoff_states(spark, SF).collect()}
    assert got == _loop(rows, 3, 4, 2) and {v[0] for v in got.values()} >= {"rotated", "failed", "retry_with_proxy"}


# --- pages ---

NESTED = """<html><body><p>one<table id=a><tr><td>no body</td></tr></table>
<TABLE class="o"><thead><tr><th>Head</th></tr></thead><tbody><tr><td> P1 <td>C&amp;1<td>L<td><table><tbody><tr><td>x</td><td>y</td></tr></tbody></table></td><td>E</td><td><a title='>' href="/View?id=7">View</a></tr>
<tr><td>P2</td><td></td><td>3</td><td>4</td><td>5</td><td>6</td></tr><tr><td>P3</td><td>C3</td><td>short</td></tr>
<tr><td>P4</td><td>C4</td><td></b>3</td><td>4</td><td>5</td><td>&#233;&nbsp;&lt;</td></tr></tbody></table><script>"<table><tbody><tr><td>js"</script><a href=''>none</a><a href=" /two ">t <b>w</b> o</a></body>"""


def test_tables_within_tables():
    assert markup.table_rows(NESTED) == [["P1", "C&1", "L", "x y", "E", "View"], ["P4", "C4", "3", "4", "5", "é <"]]
    assert markup.links(NESTED) == [("/View?id=7", "View"), ("/two", "t w o")]
    for page in (None, "", "plain", "<table>", "<tbody><tr><td>a", "<<<>>", "</table></tr>", "<table><tbody></tbody></table>", "<tr><td>1<td>2<td>3<td>4<td>5<td>6"):
        assert markup.table_rows(page) == [] and markup.token(page) is None
    assert len(markup.table_rows("<table><tbody>" + "<tr>" + "<td>v</td>" * 6 + "</tr>" * 20_000)) == 1
    deep = "<div>" * 20_000 + "text"
    assert markup.blocks_text(deep) == "text"


def test_rows_of_plain_pages_need_no_parser(monkeypatch):
    """Pages with plain tags only are cut at their brackets; all others, such as those of the second list, are parsed."""
    row = "<tr><td>a &amp; b</td><td class='x y' z=1>&nbsp;1<br/>2</td ><TD>\n<table><tbody><tr><td>in<td>x &gt; y</table><td><template>no</template>4<td/><td>6</tr>"
    plain = ["<table><tbody>" + row * n + "</table>" for n in (0, 1, 3)] + ["<tbody>" + row.replace("a &amp; b", ""), "text", "", None]
    odd = ["<tbody>" + row.replace("6", x) for x in ("<", "a < b", "<a title='>'>6", "<!-- <td> -->6", "<script><td></script>6", "<title><td></title>6", "</td x='>'>6", "<td x=y/>6", "<td x='1'y=2>6", "<td\v>6", "<td >", "<td", "6>", "<>6")]
    want = [[[c.text() for c in r] for r in markup._body_rows(markup.parse(p), 2)] for p in plain + odd]
    want = [[r for r in rows if r[0] and r[1]] for rows in want]
    assert [len(r) for r in want[:7]] == [0, 1, 3, 0, 0, 0, 0]
    assert [markup.table_rows(p, 2) for p in plain + odd] == want
    monkeypatch.setattr(markup, "parse", None)
    assert [markup.table_rows(p, 2) for p in plain[:4]] == want[:4]


def test_rows_of_any_tags_equal_those_of_the_tree():
    rng = random.Random(5)
    tags = ["<tr>", "<td>", "</td>", "</tr>", "<table>", "</table>", "<tbody>", "</tbody>", "<td/>", "<br/>", "<p>", "<ul>", "</ul>", "<template>", "</template>", "<td x=y/>", "</td x>", "<!-- -->", "<", ">", "<th>", "<div>", "</div>"]
    for _ in range(1500):
        page = "<table><tbody>" + "".join(t + rng.choice(["a", " b ", "&lt;c", ""]) for t in rng.choices(tags, [8, 16, 4, 4] + [1] * 19, k=rng.randint(5, 50)))
        rows = [[c.text() for c in r] for r in markup._body_rows(markup.parse(page), 2)]
        assert markup.table_rows(page, 2) == [r for r in rows if r[0] and r[1]], page


def test_pages_of_orders_are_made_after_the_shuffle(spark, capsys):
    Q.html_table_rows(spark, SF).explain()
    plan = capsys.readouterr().out
    assert plan.count("Exchange hashpartitioning") == 1 and "<tr>" not in plan.split("Exchange hashpartitioning")[1]


def test_sections():
    page = """<table><thead class="dark"><tr><th colspan="2">Fault  Code
        Description</th></tr></thead> <tbody><tr><td>A</td><td> <b>B</b> &lt;1&gt; </td></tr><tr><td></td></tr></tbody></table>
        <table><thead><tr><th>service plan</th></tr></thead><tbody><tr><td>outer<table><thead><tr><th>Warnings</th></tr></thead><tbody><tr><td>inner</td></tr></tbody></table></td></tr></tbody></table>
        <table><thead><tr><th>Service Plan</th></tr></thead><tbody><tr><td>second</td></tr></tbody></table>"""
    got = markup.sections(page)
    assert got == {**dict.fromkeys(markup.SECTIONS.values(), ""), "fault_code_description": "A\nB <1>", "service_plan": "outer Warnings inner", "warnings": "inner"}
    assert set(markup.sections(None).values()) == {""}


def test_tokens_in_either_order():
    assert markup.token('<input type="hidden" name="__RequestVerificationToken" data-x="1" value="a&amp;b">') == "a&b"
    assert markup.token("<INPUT VALUE='t' NAME='__RequestVerificationToken'/>") == "t"
    assert markup.token('<input name="__RequestVerificationToken"><input value="2" name="__RequestVerificationToken">') == "2"


# --- GraphML ---


def test_graphml_round_trip(spark, tmp_path):
    nodes = spark.createDataFrame([("a", 'fault <1> & "x"\n two', 1.5, None), ("b é", None, 2.0, 7), ("c", "  sp  ", None, 8), ("d", None, None, None)], "node_id string, `a.title` string, w double, k long").repartition(3)
    edges = spark.createDataFrame([("a", "b é", 0.5, "has"), ("a", "c", None, None), ("a", "c", 1.0, "x"), ("c", "a&b", 2.0, "")], "src string, dst string, weight double, relationship string")
    for parts in (None, 1):
        path = str(tmp_path / f"g{parts}")
        graphml.write(nodes, edges, path, parts)
        n, e = graphml.read(spark, path)
        assert {r.node_id: r.attributes for r in n.collect()} == {"a": {"a.title": 'fault <1> & "x"\n two', "w": "1.5"}, "b é": {"w": "2.0", "k": "7"}, "c": {"a.title": "  sp  ", "k": "8"}, "d": {}}
        assert sorted((r.src, r.dst, sorted(r.attributes.items())) for r in e.collect()) == [
            ("a", "b é", [("relationship", "has"), ("weight", "0.5")]), ("a", "c", []), ("a", "c", [("relationship", "x"), ("weight", "1.0")]), ("c", "a&b", [("relationship", ""), ("weight", "2.0")]),
        ]
    assert len(list((tmp_path / "gNone").glob("part-*"))) > 1 and len(list((tmp_path / "g1").glob("part-*"))) == 1
    graphml.write(nodes.limit(0), edges.limit(0), str(tmp_path / "empty"))
    assert [t.count() for t in graphml.read(spark, str(tmp_path / "empty"))] == [0, 0]


def test_graphml_absent_broken_and_defaults(spark, tmp_path):
    assert [t.count() for t in graphml.read(spark, str(tmp_path / "none"))] == [0, 0]
    (tmp_path / "bad").write_text("not xml <<< & <node")
    assert [t.count() for t in graphml.read(spark, str(tmp_path / "bad"))] == [0, 0]
    keys = '<key id="d" for="node" attr.name="kind"><default>plain</default></key><key id="w" for="all" attr.name="weight"/>'
    (tmp_path / "half").write_text(f'<graphml>{keys}<graph><node id="x"><data key="d">v</data><data key="z">q</data><data key="d">w</data></node><node id="y"/><node/><edge source="x" target="y"><data key="w">2</data></edge><node id="cut"><data key="d">')
    nodes, edges = graphml.read(spark, str(tmp_path / "half"))
    assert {r.node_id: r.attributes for r in nodes.collect()} == {"x": {"kind": "w", "z": "q"}, "y": {"kind": "plain"}}
    assert [tuple(r) for r in edges.collect()] == [("x", "y", {"weight": "2"})]


# --- paths ---


def _dijkstra(edges, source):
    best, todo = {source: (0.0, 0, None)}, {source}
    while todo:
        changed = set()
        for a, b, w in edges:
            if a in todo and b != source:
                new = (best[a][0] + w, best[a][1] + 1, a)
                if b not in best or (new[0], new[1], new[2]) < best[b]:
                    best[b] = new
                    changed.add(b)
        todo = changed
    return best


@pytest.mark.parametrize("seed", range(3))
def test_shortest_paths_equal_the_loop(spark, seed):
    rng = random.Random(seed)
    names = [f"n{i:02d}" for i in range(25)]
    rows = [(rng.choice(names), rng.choice(names), rng.choice([None, 0.5, 1.0, 2.0, 4.0])) for _ in range(70)]
    rows += [("n00", "n01", 64.0), ("n01", "n02", 1.0)]
    least = {}
    for a, b, w in rows:
        w = 1.0 if w is None else w
        least[a, b] = min(least.get((a, b), w), w)
    e = spark.createDataFrame([(a, b, "r", w) for a, b, w in rows], "src string, dst string, relationship string, weight double")
    sources, targets = [(n,) for n in names[:6]] + [("absent",), (None,)], [(n,) for n in names[::2]] + [("n99",)]
    for length, most in ((2, None), (4, 3), (30, None)):
        got = graph.shortest_paths(e, spark.createDataFrame(sources, "src string"), spark.createDataFrame(targets, "dst string"), length, most).collect()
        want = {}
        for (s,) in sources[:6]:
            best = _dijkstra([(a, b, w) for (a, b), w in least.items()], s)
            fit = sorted((best[t][1], t) for (t,) in targets if t in best and 1 <= best[t][1] <= length)
            want |= {(s, t): (best[t][0], n) for n, t in fit[:most]}
        assert {(r.src, r.dst): (r.cost, r.n) for r in got} == want
        for r in got:
            assert r.path[0] == r.src and r.path[-1] == r.dst and len(r.path) == r.n + 1 and sum(least[x] for x in zip(r.path, r.path[1:])) == r.cost and r.score == r.cost / r.n


def test_shortest_paths_drop_long_and_refuse_negative(spark):
    e = spark.createDataFrame([("a", "b", 1.0), ("b", "c", 1.0), ("c", "d", 1.0), ("a", "d", 9.0)], "src string, dst string, weight double")
    ends = spark.createDataFrame([("a", "d")], "src string, dst string")
    assert graph.shortest_paths(e, ends, ends, 2).count() == 0  # the cheapest has three edges; the direct one is dearer
    assert graph.shortest_paths(e, ends, ends, 3).first().path == ["a", "b", "c", "d"]
    with pytest.raises(ValueError):
        graph.shortest_paths(e.withColumn("weight", -F.col("weight")), ends, ends)
    assert graph.shortest_paths(e.limit(0), ends, ends).count() == 0


# --- stages, appends, ids, cached functions ---


def test_stage_counts_equal_a_second_pass(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rules = [stages.Stage("long", F.length("text") > 300, (("n", F.length("text")),)), stages.Stage("never null", F.when(F.col("doc_id") % 3 > 0, True)), stages.Stage("english", F.col("lang") == "en"), stages.Stage("longer", F.col("n") > 900)]
    run = stages.chain(docs, rules)
    run.rows.write.format("noop").mode("overwrite").save()
    again, left, want = Counter(r.dropped_by for r in run.rows.select("dropped_by").collect()), docs.count(), []
    for rule in rules:
        want.append((rule.name, left, again[rule.name]))
        left -= again[rule.name]
    assert run.report() == want and run.kept().count() == left > 0
    assert run.rows.where("dropped_by = 'long' and n is not null").count() == 0
    none = stages.chain(docs.limit(0), rules, "none")
    none.rows.collect()
    assert none.report() == [(r.name, 0, 0) for r in rules]


def test_repeated_and_failed_runs_leave_each_row_once(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = spark.range(100).withColumn("k", F.col("id") % 7)
    read = lambda: Counter((r.id, r.run_id) for r in appends.runs(spark, path, "id long, k long").collect())
    assert read() == {}
    appends.append_run(rows, path, "a=1/x")
    appends.append_run(rows.limit(10), path, "b")
    before = read()
    assert sum(before.values()) == 110
    for run in ("a=1/x", "c"):
        with pytest.raises(Exception, match="halfway|DIVIDE|division"):
            appends.append_run(rows.repartition(4).withColumn("k", F.when(F.col("id") == 77, F.raise_error(F.lit("halfway"))).otherwise(F.col("k"))), path, run)
        assert read() == before
    appends.append_run(rows, path, "a=1/x")
    assert read() == before


def test_only_new_keys_are_added(spark, tmp_path):
    path = str(tmp_path / "log")
    log = lambda *keys: spark.createDataFrame([(k,) for k in keys], "code string")
    for _ in range(2):
        appends.add_new(log("A", "B", None, "A"), path, ["code"], "one")
    appends.add_new(log("B", None, "C"), path, ["code"], "two")
    assert sorted(map(tuple, appends.runs(spark, path, "code string").collect()), key=str) == [("A", "one"), ("B", "one"), ("C", "two"), (None, "one")]


def test_uuids_equal_the_library(spark):
    texts = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()] + ["", "é\x00", "7", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    for ns in (uuid.NAMESPACE_DNS, uuid.NAMESPACE_URL):
        got = df.orderBy("i").select(ids.uuid5(F.col("t"), ns)).collect()
        assert [r[0] for r in got] == [None if t is None else str(uuid.uuid5(ns, t)) for t in texts]


def test_dear_functions_run_once_for_each_input(spark):
    calls = spark.sparkContext.accumulator(0)

    def dear(column):
        @F.udf("int")
        def f(x):
            calls.add(1)
            return -1 if x is None else len(x)

        return f(column)

    rows = spark.createDataFrame([(i, [None, "a", "bb", "ccc"][i % 4]) for i in range(200)] + [(i, "hot") for i in range(900)], "i int, t string").repartition(6)
    out = once.compute_once(rows, "t", "n", dear)
    assert out.count() == 1100 and calls.value == 5
    assert Counter(r.n for r in out.collect()) == {-1: 50, 1: 50, 2: 50, 3: 950} and calls.value == 5
    known = spark.createDataFrame([("hot", 77), (None, 78), ("unused", 1)], "t string, n int")
    again = once.compute_once(rows, "t", "n", dear, known)
    assert Counter(r.n for r in again.collect()) == {78: 50, 1: 50, 2: 50, 3: 50, 77: 900} and calls.value == 8
    assert once.compute_once(rows.limit(0), "t", "n", dear).count() == 0


def test_node_by_code(spark):
    n = spark.createDataFrame([("fault_code:1", "fault_code", "9"), ("fault_code:x", "fault_code", "2"), ("fault_code:w", "fault_code", "2"), ("ecu:3", "ecu", "3")], "node_id string, node_type string, code string")
    asked = spark.createDataFrame([("1",), ("2",), ("3",), ("9",), (None,), ("1",)], "code string")
    got = {r.code: r.node_id for r in graph.node_by_code(n, asked).collect()}
    assert got == {"1": "fault_code:1", "2": "fault_code:w", "3": None, "9": "fault_code:1", None: None}
