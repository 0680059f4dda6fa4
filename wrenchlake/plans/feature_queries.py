"""Queries of reranking, pairing, training pairs, remembered choices, back-off, pages, graphs as files, cheapest paths, stages, appends, ids and cached functions."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from wrenchlake.functions import ids as I
from wrenchlake.operators import backoff as B
from wrenchlake.operators import graph as G
from wrenchlake.operators import matching as M
from wrenchlake.operators import once as O
from wrenchlake.operators import reranker as K
from wrenchlake.operators import retrieval as R
from wrenchlake.operators import retriever as T
from wrenchlake.operators import stages as C
from wrenchlake.plans.model_queries import ORACLE_SQL as MODEL_SQL
from wrenchlake.plans.model_queries import _graph
from wrenchlake.plans.tables import SIM_SQL, items, queries, table
from wrenchlake.shared import kept, shared_dir
from wrenchlake.sources import appends as A
from wrenchlake.sources import graphml as X
from wrenchlake.sources import records as S
from wrenchlake.streaming import memory as Y


def _texts(spark, d):
    return table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")


def _asked(spark, d):
    """Each query of the set asks with the whole text of its own document, if there is one."""
    return queries(spark, d).join(_texts(spark, d), F.col("query_id") == F.col("id"), "left").select("query_id", "query_vec", F.col("text").alias("query_text"))


def bm25_scores(spark, d):
    """BM25 of the ten nearest of each query, with statistics of all documents."""
    pairs = R.knn(items(spark, d), queries(spark, d).drop("label"), 10).select("query_id", "id")
    docs = _texts(spark, d)
    scores = K.bm25(pairs, _asked(spark, d), docs, K.term_statistics(docs))
    return scores.select("query_id", "id", F.round("bm25", 6).alias("bm25"))


def retrieve_reranked(spark, d):
    """The whole retrieval with the reranker on: the first ten of twenty neighbours are reordered by BM25 before they are fused."""
    vectors = items(spark, d).select("id", "vec", F.col("label").alias("procedure_id"))
    its = vectors.join(_texts(spark, d), "id", "left").withColumn("title", F.concat(F.lit("guide "), F.col("procedure_id").cast("string")))
    graph = queries(spark, d).select("query_id", F.explode(F.sequence(F.lit(0), F.lit(9))).alias("procedure_id")).withColumn("kg_score", F.col("procedure_id") / 10.0)
    rated = table(spark, d, "labels").join(vectors, F.col("doc_id") == F.col("id")).groupBy("procedure_id").agg(F.avg(F.col("quality").cast("double")).alias("feedback_score"))
    out = T.retrieve(its, _asked(spark, d), graph, rated, T.Config(min_similarity=0.1, rerank=True))
    return out.withColumns({c: F.round(c, 6) for c in ("score", "combined_score")})


def _wishes(spark, d):
    """Orders as records, newest first, their line items' brand and size as codes; parts as procedures of the code of their own brand and size."""
    p = table(spark, d, "part").withColumn("code", F.concat_ws("/", "p_brand", "p_size"))
    lines = table(spark, d, "lineitem").join(p, F.col("l_partkey") == F.col("p_partkey"))
    lines = lines.groupBy(F.col("l_orderkey").alias("record_id")).agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "code"))).alias("lines"))  # an order's lines are few
    records = lines.select("record_id", F.transform("lines", lambda x: x["code"]).alias("codes"))
    bridge = p.select("code", F.col("p_retailprice").alias("place"), F.col("p_partkey").alias("procedure_id"))
    return records, bridge


def greedy_pairing(spark, d):
    """Every order, from the newest, takes the first part of its codes that no newer one took."""
    records, bridge = _wishes(spark, d)
    dated = table(spark, d, "orders").select(F.col("o_orderkey").alias("record_id"), (-F.unix_micros(F.col("o_orderdate").cast("timestamp"))).alias("turn"))
    return M.greedy_pairs(M.choices(records, bridge).join(dated, "record_id"))


def procedure_lookup(spark, d):
    """The first part that any code of an order leads to, or the least part."""
    records, bridge = _wishes(spark, d)
    every = table(spark, d, "orders").select(F.col("o_orderkey").alias("record_id")).join(records, "record_id", "left")
    return M.procedure_of(every, bridge, table(spark, d, "part").select(F.col("p_partkey").alias("procedure_id")))


def substantive_summaries(spark, d):
    """C15."""
    return table(spark, d, "conversations").select("conv_id", "turn", M.substantive(F.col("text")).alias("substantive"))


def pair_dataset(spark, d):
    """Customers as sessions: their parts are recommended, the cheapest order's first is selected; three negatives each."""
    lines = table(spark, d, "orders").join(table(spark, d, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"))
    name = F.format_string("part:%08d", F.col("l_partkey"))
    s = lines.groupBy(F.col("o_custkey").alias("sample_id")).agg(F.min(F.struct("o_totalprice", name.alias("part")))["part"].alias("selected"), F.array_sort(F.collect_set(name)).alias("recommended"))
    rows = M.pair_dataset(s.withColumn("anchor", F.concat(F.lit("query:"), F.col("sample_id").cast("string"))), n=3)
    return rows.select("sample_id", "anchor", "positive", F.array_join("negatives", " ").alias("negatives"), "validation")


def _rated_choices(spark, d):
    e = table(spark, d, "events")
    codes = F.when(F.col("event_id") % 11 == 0, F.array("event_type")).otherwise(F.array("event_type", F.concat(F.lit("u"), (F.col("user_id") % 5).cast("string"))))
    rating = F.when(F.col("event_id") % 4 > 0, F.pmod(F.floor(F.abs("value")), F.lit(5)).cast("int") + 1)
    return e.select("event_id", codes.alias("codes"), F.concat(F.lit("doc"), (F.col("event_id") % 97).cast("string")).alias("doc_id"), rating.alias("rating"))


def remembered_choices(spark, d):
    """The memory that the stream of all events leaves."""
    return Y.remembered(_rated_choices(spark, d)).select("codes_key", "position", F.array_join("doc_ids", ",").alias("doc_ids"))


def backoff_states(spark, d):
    """Events as responses of each user's crawl."""
    e = table(spark, d, "events")
    kind = F.col("event_id") * 7 % 10
    status = F.when(kind < 5, 403).when(kind == 5, 429).otherwise(200)
    rows = e.select(F.col("user_id").alias("crawl"), F.col("event_id").alias("seq"), F.col("event_type").alias("domain"), status.alias("status"), (F.col("event_id") % 3 != 0).alias("proxied"))
    return B.back_off(rows, keys=3, rotate_at=4, most=2)


def _cell(column):
    for plain, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        column = F.replace(column, F.lit(plain), F.lit(name))
    return F.concat(F.lit("<td>"), column, F.lit("</td>"))


def _order_pages(spark, d):
    """A page of each order: a layout table around a table of its line items, one of whose cells holds a table again. Only line items' keys are shuffled, not their rows of the page."""
    li = table(spark, d, "lineitem")
    key = F.struct(*[F.col(c) for c in ("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_returnflag", "l_linestatus")])

    def row(k):
        text = lambda c: F.coalesce(k[c].cast("string"), F.lit(""))
        cells = [_cell(text("l_partkey")), _cell(text("l_linenumber")), _cell(F.concat(F.lit("<"), text("l_returnflag"), F.lit(" & "), text("l_linestatus"), F.lit(">")))]
        nested = F.concat(F.lit("<td class='x'><table><tbody><tr><td>in</td><td>"), text("l_suppkey"), F.lit("</td><td>1<td>2<td>3<td>4</tr></tbody></table></td>"))
        return F.concat(F.lit("<tr>"), *cells, _cell(text("l_suppkey")), nested, F.lit("<TD>end&nbsp;of &eacute;</TD></tr>\n"))

    rows = li.groupBy(F.col("l_orderkey").alias("page_id")).agg(F.array_sort(F.collect_list(key)).alias("rows"))  # an order's lines are few
    body = F.array_join(F.transform("rows", row), "")
    return rows.select("page_id", F.concat(F.lit("<html><body><div><table><thead><tr><th>A</th></tr></thead><tbody class=rows>"), body, F.lit("<tr><td>too</td><td>few</td></tr></tbody></table></div></body>")).alias("html"))


def html_table_rows(spark, d):
    """The line items are found again in their orders' pages."""
    rows = S.table_rows(_order_pages(spark, d))
    return rows.select("page_id", "row_no", F.array_join("cells", "|").alias("cells"))


def page_sections(spark, d):
    """Sections of pages made of parts: two filled, one heading without cells, four absent."""
    p = table(spark, d, "part")
    block = lambda head, *rows: F.concat(F.lit(f"<table><thead class='dark'><tr><th colspan=2>{head}</th></tr></thead>\n<tbody>"), *rows, F.lit("</tbody></table>"))
    row = lambda *cols: F.concat(F.lit("<tr>"), *[_cell(F.col(c).cast("string")) for c in cols], F.lit("</tr>"))
    html = F.concat(block("Fault Code Description", row("p_name", "p_brand"), row("p_type")), F.lit("<p>between</p>"), block("SERVICE PLAN", row("p_size")), block("Warnings"))
    return S.page_sections(p.select(F.col("p_partkey").alias("page_id"), html.alias("html")))


def form_tokens(spark, d):
    """The token of a form whose attributes stand in either order, or that has none."""
    from wrenchlake.sources.markup import token_column

    c = table(spark, d, "customer")
    name, value = F.lit(' name="__RequestVerificationToken" type=hidden'), F.concat(F.lit(' value="'), "c_name", F.lit('"'))
    tag = F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit("<input"), name, value, F.lit(">"))).when(F.col("c_custkey") % 3 == 1, F.concat(F.lit("<INPUT"), value, name, F.lit("/>"))).otherwise(F.lit("<input name=other value=x>"))
    return c.select("c_custkey", token_column(F.concat(F.lit("<form><input name=first value=1>"), tag, F.lit("</form>"))).alias("token"))


def graphml_edges(spark, d):
    """The graph of the tables, written as GraphML and read again."""
    nodes, edges = _graph(spark, d)
    path = f"{shared_dir(spark)}/wrenchlake/graphml-{uuid.uuid4().hex}"
    X.write(nodes, edges, path)
    back = X.read(spark, path)[1]
    return back.select("src", "dst", F.col("attributes.relationship").alias("relationship"), F.round(F.col("attributes.weight").cast("double"), 6).alias("weight"))


def shortest_paths(spark, d):
    """From nations over suppliers and parts to brands: the cheapest of all ways, the twenty shortest of each nation."""
    s, p = table(spark, d, "supplier"), table(spark, d, "part")
    li = table(spark, d, "lineitem")
    name = lambda kind, c: F.concat(F.lit(f"{kind}:"), F.col(c).cast("string"))
    edges = S.union_all(
        G.edges(s, name("nation", "s_nationkey"), name("supplier", "s_suppkey"), "has", F.abs("s_acctbal") / 1000),
        G.edges(li, name("supplier", "l_suppkey"), name("part", "l_partkey"), "sells", F.col("l_extendedprice") / 1000),
        G.edges(p, name("part", "p_partkey"), name("brand", "p_brand"), "of", F.col("p_retailprice") / 1000),
    )
    sources, targets = s.select(name("nation", "s_nationkey").alias("src")), p.select(name("brand", "p_brand").alias("dst"))
    out = G.shortest_paths(edges, sources, targets, max_length=4)
    return out.select("src", "dst", F.round("cost", 6).alias("cost"), "n", F.round("score", 6).alias("score"), F.array_join("path", ">").alias("path"))


def stage_chain(spark, d):
    """M7: documents through ordered stages; the language stage rewrites the source."""
    docs = table(spark, d, "documents").join(table(spark, d, "labels").select("doc_id", "quality", "toxic"), "doc_id", "left")
    run = C.chain(docs, [
        C.Stage("content", F.length("text") >= 200),
        C.Stage("language", F.col("lang").isin("en", "fr", "de"), (("source", F.concat_ws("/", "lang", "source")),)),
        C.Stage("toxic", F.coalesce(F.col("toxic"), F.lit(0)) == 0),
        C.Stage("quality", F.col("quality") == 1),
    ])
    return run.rows.select("doc_id", "source", "dropped_by")


def run_appends(spark, d):
    """Two runs of nearest neighbours are appended, one of them twice, then a log of the queries that were answered."""
    near = kept(R.knn(items(spark, d), queries(spark, d).drop("label"), 3).select("query_id", "rank", "id"), "near")  # read by each of the runs
    base = f"{shared_dir(spark)}/wrenchlake/runs-{uuid.uuid4().hex}"
    for run, rows in (("first", near), ("second", near.where("rank = 1")), ("first", near)):
        A.append_run(rows, f"{base}/results", run)
    for run, rows in (("first", near.where("query_id % 200 = 0")), ("second", near), ("second", near)):
        A.add_new(rows.select("query_id"), f"{base}/done", ["query_id"], run)
    done = A.runs(spark, f"{base}/done", "query_id long").withColumnRenamed("run_id", "done_by")
    return A.runs(spark, f"{base}/results", "query_id long, rank int, id long").join(done, "query_id")


def document_ids(spark, d):
    """The stored ids of documents: of their id, of their place where they have none, or as they are where they are UUIDs."""
    docs = table(spark, d, "documents")
    given = F.when(F.col("doc_id") % 3 == 0, F.concat_ws("é", "lang", "doc_id")).when(F.col("doc_id") % 3 == 1, F.concat(F.lit("6ba7b810-9dad-11d1-80b4-"), F.lpad(F.col("doc_id").cast("string"), 12, "0")))
    return docs.select("doc_id", I.document_id(given, F.col("doc_id")).alias("stored_id"))


def node_codes(spark, d):
    """Brands asked for by code: some are nodes by name, some by their code attribute, some none."""
    p = table(spark, d, "part")
    direct = (F.col("p_partkey") % 2 == 0)
    nodes = p.select(F.when(direct, F.concat(F.lit("fault_code:"), F.col("p_partkey").cast("string"))).otherwise(F.concat(F.lit("part:"), F.col("p_partkey").cast("string"))).alias("node_id"),
                     F.when(F.col("p_partkey") % 5 == 0, "ecu").otherwise("fault_code").alias("node_type"), F.col("p_partkey").cast("string").alias("code"))
    return G.node_by_code(nodes, table(spark, d, "lineitem").select(F.col("l_partkey").cast("string").alias("code")))


def computed_once(spark, d):
    """A dear function of the types of all line items' parts, evaluated once a type; those of brands ending in 1 are known from before."""
    p = table(spark, d, "part")
    rows = table(spark, d, "lineitem").join(p, F.col("l_partkey") == F.col("p_partkey")).select("l_orderkey", "l_linenumber", "l_partkey", F.concat_ws("/", "p_type", "p_brand").alias("kind"))
    known = p.where("p_brand like '%1'").select(F.concat_ws("/", "p_type", "p_brand").alias("kind")).distinct().withColumn("digest", F.lit("known"))
    return O.compute_once(rows, "kind", "digest", lambda c: F.sha2(c, 256), known)


QUERIES = {f.__name__: f for f in (
    computed_once, bm25_scores, retrieve_reranked, greedy_pairing, procedure_lookup, substantive_summaries, pair_dataset, remembered_choices, backoff_states, html_table_rows, page_sections, form_tokens, graphml_edges, shortest_paths,
    stage_chain, run_appends, document_ids, node_codes,
)}

_TERMS = r"list_filter(regexp_split_to_array(lower(text), '[^\pL\pN]+'), lambda w: w <> '')"
_NEAR = f"SELECT query_id, id, label, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM ({SIM_SQL})"


def _bm25_sql(pairs: str, docs: str) -> str:
    """WITH parts that end in ``bm(query_id, id, bm25)`` for a query of pairs and one of (id, text)."""
    return f"""pairs AS MATERIALIZED ({pairs}), docs AS MATERIALIZED ({docs}), split AS MATERIALIZED (SELECT id, {_TERMS} AS ws FROM docs), corpus AS (SELECT count(*) AS n, avg(coalesce(len(ws), 0)) AS mean FROM split),
        df AS MATERIALIZED (SELECT w, count(*) AS df FROM (SELECT unnest(list_distinct(ws)) AS w FROM split) GROUP BY w), tf AS MATERIALIZED (SELECT id, w, count(*) AS tf FROM (SELECT id, unnest(ws) AS w FROM split) GROUP BY ALL),
        asked AS MATERIALIZED (SELECT id AS query_id, unnest(list_distinct({_TERMS})) AS w FROM (SELECT doc_id AS id, text FROM documents)),
        own AS MATERIALIZED (SELECT p.query_id, p.id, a.w FROM pairs p JOIN asked a USING (query_id)),
        hit AS MATERIALIZED (SELECT query_id, id, w, tf FROM own JOIN tf USING (id, w)),
        met AS (SELECT query_id, id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * len(ws) / mean))) AS s
                FROM hit JOIN df USING (w) JOIN split USING (id), corpus GROUP BY ALL),
        bm AS (SELECT query_id, id, coalesce(s, 0)::DOUBLE AS bm25 FROM pairs LEFT JOIN met USING (query_id, id))"""


_CODED = """p AS (SELECT p_partkey, p_retailprice, p_brand || '/' || p_size AS code FROM part), firsts AS (SELECT code, p_partkey AS procedure_id FROM p QUALIFY row_number() OVER (PARTITION BY code ORDER BY p_retailprice, p_partkey) = 1),
    c AS (SELECT l_orderkey AS record_id, code, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, code) AS nth FROM lineitem JOIN p ON l_partkey = p_partkey)"""

ORACLE_SQL = {
    "bm25_scores": f"WITH {_bm25_sql(f'SELECT query_id, id FROM ({_NEAR}) WHERE rank <= 10', 'SELECT doc_id AS id, text FROM documents')} SELECT query_id, id, round(bm25, 6) AS bm25 FROM bm",
    "retrieve_reranked": f"""
        WITH near AS ({_NEAR} WHERE score >= 0.1 QUALIFY rank <= 10),
        {_bm25_sql('SELECT query_id, id FROM near', "SELECT vec_id AS id, coalesce(nullif(trim(text), ''), 'guide ' || label) AS text FROM embeddings LEFT JOIN documents ON doc_id = vec_id")},
        rated AS (SELECT label, avg(quality::DOUBLE) AS fb FROM labels JOIN embeddings ON doc_id = vec_id GROUP BY label),
        c AS (SELECT near.*, 0.4::DOUBLE * greatest(0, least(1, score)) + 0.3::DOUBLE / (1 + exp(-bm25)) + 0.2::DOUBLE * (near.label / 10.0::DOUBLE) + 0.1::DOUBLE * coalesce(fb, 0.5::DOUBLE) AS combined
              FROM near JOIN bm USING (query_id, id) LEFT JOIN rated ON rated.label = near.label),
        b AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY query_id, label ORDER BY combined DESC, score DESC, id) = 1),
        t AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY combined DESC, id)::INTEGER AS place FROM b)
        SELECT query_id, place AS rank, id, label AS procedure_id, round(score, 6) AS score, round(combined, 6) AS combined_score FROM t WHERE place <= 5""",
    "greedy_pairing": f"""
        WITH {_CODED}, w AS (SELECT record_id, procedure_id, min(nth) AS nth FROM c JOIN firsts USING (code) WHERE nth <= 5 GROUP BY ALL),
        r AS (SELECT record_id, list(procedure_id ORDER BY nth) AS wants, any_value(o_orderdate) AS newest FROM w JOIN orders ON o_orderkey = record_id GROUP BY record_id),
        s AS (SELECT list_reduce(list_concat([{{'taken': []::BIGINT[], 'records': []::BIGINT[], 'choices': []::INTEGER[]}}], list({{'taken': wants, 'records': [record_id], 'choices': []::INTEGER[]}} ORDER BY newest DESC, record_id)),
            lambda a, x: CASE WHEN len(list_filter(x.taken, lambda p: NOT list_contains(a.taken, p))) = 0 THEN a ELSE {{
                'taken': list_append(a.taken, list_filter(x.taken, lambda p: NOT list_contains(a.taken, p))[1]), 'records': list_append(a.records, x.records[1]),
                'choices': list_append(a.choices, list_position(x.taken, list_filter(x.taken, lambda p: NOT list_contains(a.taken, p))[1])::INTEGER)}} END) AS s FROM r)
        SELECT unnest(s.records) AS record_id, unnest(s.taken) AS procedure_id, unnest(s.choices) AS choice FROM s""",
    "procedure_lookup": f"""
        WITH {_CODED}, f AS (SELECT record_id, min_by(procedure_id, nth) AS procedure_id FROM c JOIN firsts USING (code) WHERE nth <= 5 GROUP BY record_id)
        SELECT o_orderkey AS record_id, coalesce(procedure_id, (SELECT min(p_partkey) FROM part)) AS procedure_id, procedure_id IS NOT NULL AS by_code FROM orders LEFT JOIN f ON record_id = o_orderkey""",
    "substantive_summaries": "SELECT conv_id, turn, coalesce(length(trim(text)) >= 40 AND NOT (" + " OR ".join(f"contains(lower(text), '{p}')" for p in M.GENERIC_PHRASES) + "), false) AS substantive FROM conversations",
    "pair_dataset": """
        WITH l AS (SELECT o_custkey AS sample_id, o_totalprice, format('part:{:08d}', l_partkey) AS part FROM orders JOIN lineitem ON o_orderkey = l_orderkey),
        s AS (SELECT sample_id, arg_min(part, {'a': o_totalprice, 'b': part}) AS positive FROM l GROUP BY sample_id),
        n AS (SELECT DISTINCT sample_id, positive, part FROM l JOIN s USING (sample_id) WHERE part <> positive),
        r AS (SELECT *, count(*) OVER (PARTITION BY sample_id) AS many, row_number() OVER (PARTITION BY sample_id ORDER BY part) AS place,
                     row_number() OVER (PARTITION BY sample_id ORDER BY sha256('42:' || sample_id || ':' || part), part) AS drawn FROM n),
        g AS (SELECT sample_id, any_value(positive) AS positive, list(part ORDER BY CASE WHEN many > 3 THEN drawn ELSE place END) AS ns FROM r GROUP BY sample_id)
        SELECT sample_id, 'query:' || sample_id AS anchor, positive, array_to_string(list_concat(ns, [ns[-1], ns[-1]])[1:3], ' ') AS negatives,
               ('0x' || substr(sha256('42:' || sample_id), 1, 8))::BIGINT % 100 < 20 AS validation FROM g""",
    "remembered_choices": """
        WITH e AS (SELECT event_id, CASE WHEN event_id % 11 = 0 THEN event_type ELSE array_to_string(list_sort([event_type, 'u' || (user_id % 5)]), ',') END AS codes_key, 'doc' || (event_id % 97) AS doc_id
                   FROM events WHERE event_id % 4 = 0 OR value IS NULL OR floor(abs(value))::BIGINT % 5 + 1 >= 4),
        f AS (SELECT codes_key, doc_id, min(event_id) AS first FROM e GROUP BY ALL)
        SELECT codes_key, min(first) AS position, string_agg(doc_id, ',' ORDER BY first) AS doc_ids FROM f GROUP BY codes_key""",
    "backoff_states": """
        WITH e AS (SELECT user_id AS crawl, event_id AS seq, event_type AS domain, CASE WHEN event_id * 7 % 10 < 5 THEN 403 WHEN event_id * 7 % 10 = 5 THEN 429 ELSE 200 END AS status, event_id % 3 <> 0 AS proxied FROM events),
        x AS (SELECT crawl, list({'k': 0, 'kf': 0, 'f': MAP([domain], [0]), 'ban': []::VARCHAR[], 'gone': []::VARCHAR[], 'd': domain, 's': status, 'p': proxied,
                                  'out': [{'decision': '', 'k': 0, 'kf': 0, 'f': 0, 'ban': false}]} ORDER BY seq) AS xs, list(seq ORDER BY seq) AS seqs, list(domain ORDER BY seq) AS ds, list(status ORDER BY seq) AS ss, list(proxied ORDER BY seq) AS ps FROM e GROUP BY crawl),
        w AS (SELECT crawl, seqs, ds, ss, ps, list_reduce(list_concat([{'k': 0, 'kf': 0, 'f': MAP(['?'], [0]), 'ban': []::VARCHAR[], 'gone': []::VARCHAR[], 'd': '', 's': 0, 'p': false, 'out': [{'decision': '', 'k': 0, 'kf': 0, 'f': 0, 'ban': false}]}], xs),
            lambda a, x: list_transform([CASE
                WHEN list_contains(a.ban, x.d) THEN 'ignored' WHEN x.s = 200 THEN 'returned' WHEN NOT x.p THEN CASE WHEN list_contains(a.gone, x.d) THEN 'returned' ELSE 'retry_with_proxy' END
                WHEN a.kf + 1 >= 4 AND a.k < 2 THEN 'rotated' WHEN a.k >= 2 THEN 'exhausted' WHEN coalesce(a.f[x.d], 0) + 1 >= 2 THEN 'banned' ELSE 'failed' END],
            lambda v: list_transform([{
                'k': a.k + (v = 'rotated')::INTEGER, 'kf': CASE WHEN v = 'rotated' OR v = 'returned' AND x.s = 200 AND x.p THEN 0 ELSE a.kf + (v IN ('exhausted', 'failed', 'banned'))::INTEGER END,
                'n': CASE WHEN v = 'returned' AND x.s = 200 AND x.p THEN greatest(0, coalesce(a.f[x.d], 0) - 1) ELSE coalesce(a.f[x.d], 0) + (v IN ('failed', 'banned'))::INTEGER END,
                'ban': CASE WHEN v = 'banned' THEN list_append(a.ban, x.d) ELSE a.ban END}],
            lambda u: {'k': u.k, 'kf': u.kf, 'f': map_concat(a.f, MAP([x.d], [u.n])), 'ban': u.ban, 'gone': CASE WHEN v = 'exhausted' THEN list_append(a.gone, x.d) ELSE a.gone END, 'd': x.d, 's': x.s, 'p': x.p,
                       'out': list_append(a.out, {'decision': v, 'k': u.k, 'kf': u.kf, 'f': u.n, 'ban': list_contains(u.ban, x.d)})})[1])[1]).out[2:] AS o FROM x),
        r AS (SELECT crawl, unnest(seqs) AS seq, unnest(ds) AS domain, unnest(ss) AS status, unnest(ps) AS proxied, unnest(o) AS o FROM w)
        SELECT crawl, seq, domain, status, proxied, o.decision, o.k AS key_index, o.kf AS key_failures, o.f AS domain_failures, o.ban AS domain_banned FROM r""",
    "html_table_rows": """
        SELECT l_orderkey AS page_id, (row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_returnflag, l_linestatus) - 1)::INTEGER AS row_no,
               concat_ws('|', l_partkey, l_linenumber, '<' || l_returnflag || ' & ' || l_linestatus || '>', l_suppkey, 'in ' || l_suppkey || ' 1 2 3 4', 'end of é') AS cells FROM lineitem""",
    "page_sections": """
        SELECT p_partkey AS page_id, section, CASE section WHEN 'fault_code_description' THEN concat_ws(chr(10), p_name, p_brand, p_type) WHEN 'service_plan' THEN p_size::VARCHAR ELSE '' END AS text
        FROM part, (SELECT unnest(['fault_code_description', 'fault_code_conditions', 'fault_time_condition', 'service_plan', 'fault_impact', 'warnings', 'service_notes']) AS section)""",
    "form_tokens": "SELECT c_custkey, CASE WHEN c_custkey % 3 < 2 THEN c_name END AS token FROM customer",
    "computed_once": """SELECT l_orderkey, l_linenumber, l_partkey, p_type || '/' || p_brand AS kind, CASE WHEN p_brand LIKE '%1' THEN 'known' ELSE sha256(p_type || '/' || p_brand) END AS digest
        FROM lineitem JOIN part ON l_partkey = p_partkey""",
    "graphml_edges": MODEL_SQL["graph_edges"],
    "shortest_paths": """
        WITH RECURSIVE e AS (
            SELECT src, dst, min(w) AS w FROM (
                SELECT 'nation:' || s_nationkey AS src, 'supplier:' || s_suppkey AS dst, abs(s_acctbal) / 1000 AS w FROM supplier
                UNION ALL SELECT 'supplier:' || l_suppkey, 'part:' || l_partkey, l_extendedprice / 1000 FROM lineitem
                UNION ALL SELECT 'part:' || p_partkey, 'brand:' || p_brand, p_retailprice / 1000 FROM part) GROUP BY src, dst),
        walks AS (
            SELECT DISTINCT src, src AS node, 0.0::DOUBLE AS cost, 0 AS n, src AS path FROM e WHERE src LIKE 'nation:%'
            UNION ALL SELECT walks.src, e.dst, cost + w, n + 1, path || '>' || e.dst FROM walks JOIN e ON e.src = walks.node),
        best AS (SELECT * FROM walks WHERE node LIKE 'brand:%' QUALIFY row_number() OVER (PARTITION BY src, node ORDER BY cost, n, path) = 1)
        SELECT src, node AS dst, round(cost, 6) AS cost, n, round(cost / n, 6) AS score, path FROM best WHERE n <= 4 QUALIFY row_number() OVER (PARTITION BY src ORDER BY n, node) <= 20""",
    "stage_chain": """
        SELECT d.doc_id, CASE WHEN length(text) >= 200 AND lang IN ('en', 'fr', 'de') THEN lang || '/' || source ELSE source END AS source,
               CASE WHEN length(text) >= 200 IS NOT true THEN 'content' WHEN lang IN ('en', 'fr', 'de') IS NOT true THEN 'language' WHEN coalesce(toxic, 0) <> 0 THEN 'toxic' WHEN (quality = 1) IS NOT true THEN 'quality' END AS dropped_by
        FROM documents d LEFT JOIN labels USING (doc_id)""",
    "run_appends": f"""
        WITH near AS ({_NEAR} QUALIFY rank <= 3) SELECT query_id, rank::INTEGER AS rank, id, run_id, CASE WHEN query_id % 200 = 0 THEN 'first' ELSE 'second' END AS done_by
        FROM near JOIN (VALUES ('first', 3), ('second', 1)) v(run_id, most) ON rank <= most""",
    "document_ids": r"""
        WITH n AS (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN concat_ws('é', lang, doc_id) WHEN 2 THEN doc_id::VARCHAR END AS name FROM documents),
        h AS (SELECT doc_id, name, sha1('\x6b\xa7\xb8\x10\x9d\xad\x11\xd1\x80\xb4\x00\xc0\x4f\xd4\x30\xc8'::BLOB || encode(name)) AS h FROM n)
        SELECT doc_id, CASE WHEN name IS NULL THEN '6ba7b810-9dad-11d1-80b4-' || lpad(doc_id::VARCHAR, 12, '0')
            ELSE h[1:8] || '-' || h[9:12] || '-5' || h[14:16] || '-' || ['8', '9', 'a', 'b'][('0x' || h[17])::INTEGER % 4 + 1] || h[18:20] || '-' || h[21:32] END AS stored_id FROM h""",
    "node_codes": """
        WITH n AS (SELECT CASE WHEN p_partkey % 2 = 0 THEN 'fault_code:' ELSE 'part:' END || p_partkey AS node_id, p_partkey % 5 = 0 AS ecu, p_partkey FROM part)
        SELECT c AS code, CASE WHEN p_partkey % 2 = 0 OR NOT ecu THEN node_id END AS node_id FROM (SELECT DISTINCT l_partkey, l_partkey::VARCHAR AS c FROM lineitem) LEFT JOIN n ON p_partkey = l_partkey""",
}
