"""Further queries: full-text lookup, title merging, dialogue, hybrids, sweeps, counters, queues."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from wrenchlake.functions import dialogue as D
from wrenchlake.operators import blocks as K
from wrenchlake.operators import evaluate as E
from wrenchlake.operators import relational as R
from wrenchlake.operators import retrieval as Q
from wrenchlake.operators import retriever as T
from wrenchlake.plans.tables import SIM_SQL, items, queries, table
from wrenchlake.sources import records as S


def fulltext_lookup(spark, d):
    """For each benchmark item the document that shares most of its first five longer words."""
    return Q.fulltext_lookup(table(spark, d, "documents").select("doc_id", "text"), table(spark, d, "benchmark"))


def title_merge(spark, d):
    """H5: of equal titles the relational source's row, then the described one, then the first."""
    p = table(spark, d, "part").select(F.col("p_name").alias("title"), F.lit(0).alias("source"), F.when(F.col("p_size") > 25, F.col("p_type")).alias("description"), F.col("p_partkey").alias("row_no"))
    v = table(spark, d, "part").select(F.concat(F.col("p_name"), F.when(F.col("p_partkey") % 2 == 0, " x").otherwise("")).alias("title"), F.lit(1).alias("source"), F.col("p_brand").alias("description"), F.col("p_partkey").alias("row_no"))
    best = R.first_per_key(p.unionByName(v), ["title"], [F.asc("source"), F.asc(F.col("description").isNull()), F.asc("row_no")])
    return best.select("title", "source", "description", "row_no")


def url_query(spark, d):
    """Host and two query values of page addresses."""
    return table(spark, d, "pages").select("page_id", *[F.expr(f"try_parse_url(url, 'QUERY', '{k}')").alias(k) for k in ("page", "ref")])


def parse_questions(spark, d):
    q = D.parse_questions(F.col("text"))
    return table(spark, d, "conversations").select("conv_id", "turn", F.size(q).alias("n_questions"), F.array_join(q, "|").alias("questions"))


def expanded_query(spark, d):
    c = table(spark, d, "conversations")
    response = F.when(F.col("turn") % 2 == 0, F.concat(F.lit("Query: "), "text")).otherwise(F.concat(F.lit(" "), "role"))
    return c.select("conv_id", "turn", D.expanded_query(response, F.col("text")).alias("expanded"))


def format_candidates(spark, d):
    near = Q.knn(items(spark, d), queries(spark, d).drop("label"), 3).where("score < 0.9995")
    line = D.candidate_line(F.col("rank"), F.col("id").cast("string"), F.col("label") / 8.0)
    return near.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", line.alias("line")))), lambda x: x["line"]), "\n").alias("lines"))


def clarification_prompts(spark, d):
    """The prompt of each query, with its codes, readings and three nearest."""
    near = Q.knn(items(spark, d), queries(spark, d).drop("label"), 3)
    line = F.concat(F.col("rank").cast("string"), F.lit(". item "), F.col("id").cast("string"))
    lines = near.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", line.alias("line")))), lambda x: x["line"]), "\n").alias("lines"))  # three a query
    asked = queries(spark, d).select("query_id", F.array(F.lit("P1"), F.concat(F.lit("L"), F.col("label").cast("string"))).alias("codes"), F.when(F.col("label") % 2 == 0, F.create_map(F.lit("rpm"), F.col("label") * 100.0)).alias("sensors"))
    prompt = D.clarification_prompt(F.col("codes"), F.col("sensors"), F.col("lines"), "Codes {fault_codes}; readings {obd_data}.\n{top_candidates}\n{fault_codes}?")
    return asked.join(lines, "query_id").select("query_id", prompt.alias("prompt"))


def prompt_fill(spark, d):
    c = table(spark, d, "customer")
    return c.select("c_custkey", D.fill("Codes {codes} of {name}: {codes}?", {"codes": F.col("c_mktsegment"), "name": F.col("c_name")}).alias("prompt"))


def limit_keys(spark, d):
    c = table(spark, d, "customer")
    pick = lambda k: F.when(F.col("c_custkey") % 4 == k, F.col("c_name"))
    return c.select("c_custkey", D.limit_key(pick(0), pick(1), pick(2), F.when(F.col("c_custkey") % 8 == 3, F.lit("10.0.0.1"))).alias("key"))


def hybrid_exact(spark, d):
    """0.3 of an exact hit and 0.7 of the similarity."""

    def view(score, item, query):  # without an id there is no number, which comes last
        value = 0.3 * (np.fmod(item["id"], 10) == np.fmod(query["query_id"] // 100, 10)) + 0.7 * score
        missing = pd.isna(item["id"])
        return np.where(missing, -np.inf, value) if missing.any() else value

    near = K.nearest(items(spark, d), queries(spark, d).drop("label"), 5, view, steady=True)
    score = 0.3 * (F.col("id") % 10 == F.floor(F.col("query_id") / 100) % 10).cast("double") + 0.7 * F.col("score")
    return Q.top_k(near.withColumn("hybrid", score), 5, by="hybrid").select("query_id", "rank", "id", F.round("hybrid", 6).alias("hybrid"))


def related_codes(spark, d):
    """Codes that share an order with each part, without itself, by how many orders. Orders hold few parts, so pairs within one are few."""
    li = table(spark, d, "lineitem").select("l_orderkey", "l_partkey").distinct()
    q = li.select("l_orderkey", F.col("l_partkey").alias("query_part"))
    pairs = q.join(li, "l_orderkey").where("query_part <> l_partkey")
    return pairs.groupBy("query_part", "l_partkey").agg(F.count("*").alias("n_orders"))


def additive_boost(spark, d):
    """Code sets of the first half of the documents are remembered; the others' scores rise by 0.1, up to 1, if theirs is."""
    docs = table(spark, d, "documents").select("doc_id", F.concat_ws("|", "lang", "source").alias("codes"), (F.pmod(F.col("n_chars"), F.lit(100)) / 100.0).alias("score"))
    memory = docs.where("doc_id % 2 = 0 and score > 0.5").select("codes").distinct().withColumn("known", F.lit(True))
    rest = docs.where("doc_id % 2 = 1").join(memory, "codes", "left")
    return rest.select("doc_id", F.round(F.when(F.col("known"), F.least(F.lit(1.0), F.col("score") + 0.1)).otherwise(F.col("score")), 6).alias("score"))


def param_sweep(spark, d):
    """Mean similarity of the five best by threshold."""
    near = Q.knn(items(spark, d), queries(spark, d).drop("label"), 5)
    values = F.explode(F.array(*[F.lit(x) for x in (0.0, 0.2, 0.3, 0.5)]))
    return near.select("score", values.alias("threshold")).where("score >= threshold").groupBy("threshold").agg(F.count("*").alias("n"), F.round(F.avg("score"), 6).alias("mean_score"))


def expansion_stats(spark, d):
    """By query the best own similarity and the mean over its next four."""
    near = Q.knn(items(spark, d), queries(spark, d).drop("label"), 6).where("rank > 1")
    per = near.groupBy("query_id").agg(F.max("score").alias("a"), F.avg(F.when(F.col("rank") > 2, F.col("score"))).alias("b"))
    return E.compare(per).select("n", F.round("mean_a", 6).alias("mean_a"), F.round("mean_b", 6).alias("mean_b"), "wins", "losses")


def etl_counters(spark, d):
    """Records by status and their share."""
    docs = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left")
    status = F.when(F.col("quality").isNull(), "unlabelled").when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 1, "kept").otherwise("dropped")
    return docs.groupBy(status.alias("status")).agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))


def mapping_coverage(spark, d):
    """Orders with and without line items, and the rows per order."""
    o = table(spark, d, "orders").select("o_orderkey")
    li = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n"))
    j = o.join(li, "o_orderkey", "left")
    return j.agg(F.count("*").alias("total"), F.count("n").alias("mapped"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"), F.round(F.avg("n"), 6).alias("mean_rows"))


def sessions_entries(spark, d):
    """Conversations with their turns nested, as digests."""
    turns = table(spark, d, "conversations")
    s = turns.select("conv_id").distinct()
    e = turns.select("conv_id", F.col("turn").alias("created_at"), "role", "text")
    nested = S.sessions_with_entries(s, e, "conv_id")
    return nested.select("conv_id", F.size("entries").alias("n"), F.sha2(F.array_join(F.transform("entries", lambda x: F.concat_ws(":", x["role"], x["text"])), "\n"), 256).alias("digest"))


def queue_counts(spark, d):
    """Work states after stuck tasks (started over an hour before the end) are reset and failures retried."""
    e = table(spark, d, "events")
    state = F.element_at(F.array(F.lit("pending"), F.lit("in_progress"), F.lit("completed"), F.lit("failed")), (F.col("event_id") % 4 + 1).cast("int"))
    stuck = F.col("ts") < F.lit("2024-01-30 12:00:00").cast("timestamp") - F.expr("interval 1 hour")
    after = F.when(F.col("s").isin("failed") | ((F.col("s") == "in_progress") & stuck), "pending").otherwise(F.col("s"))
    return e.select("ts", state.alias("s")).groupBy(after.alias("status")).agg(F.count("*").alias("n"))


def tree_edges(spark, d):
    """A self-join through one table: orders to the customer's order before."""
    o = table(spark, d, "orders")
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return o.select(F.lag("o_orderkey").over(w).alias("parent"), F.col("o_orderkey").alias("child")).where("parent is not null")


def related_expansions(spark, d):
    """Whole benchmark texts, with words replaced by the documents' languages they are held in most."""
    docs = table(spark, d, "documents")
    words = F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))))
    counted = docs.where("lang is not null").select("lang", words.alias("word")).where("length(word) = 6").groupBy("word", "lang").agg(F.count("*").alias("n"))
    synonyms = counted.where("n >= 2").select("word", F.concat("lang", F.lit(" $1\\"), F.col("n").cast("string")).alias("form"))
    return Q.expand(table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query_text")), synonyms)


def retrieve_config(spark, d):
    """The configured retrieval: threshold, rerank, graph and feedback scores, best per procedure."""
    it = items(spark, d).select("id", "vec", F.col("label").alias("procedure_id"), F.concat(F.lit("guide "), F.col("label").cast("string")).alias("title"))
    qs = queries(spark, d).select("query_id", "query_vec", F.concat(F.lit("guide "), F.col("label").cast("string")).alias("query_text"))
    graph = qs.select("query_id", F.explode(F.sequence(F.lit(0), F.lit(9))).alias("procedure_id")).withColumn("kg_score", F.col("procedure_id") / 10.0)
    fb = spark.range(0, 10, 2).select(F.col("id").cast("int").alias("procedure_id"), F.lit(0.9).alias("feedback_score"))
    out = T.retrieve(it, qs, graph, fb, T.Config(min_similarity=0.1))
    return out.withColumns({c: F.round(c, 6) for c in ("score", "combined_score")})


QUERIES = {f.__name__: f for f in (
    fulltext_lookup, title_merge, url_query, parse_questions, expanded_query, format_candidates, clarification_prompts, prompt_fill, limit_keys, hybrid_exact, related_codes, additive_boost, param_sweep, expansion_stats, etl_counters, mapping_coverage,
    sessions_entries, queue_counts, tree_edges, related_expansions, retrieve_config,
)}

_TOP = f"SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id)::INTEGER AS rank FROM ({SIM_SQL})"
_WORDS = "list_filter(regexp_split_to_array(lower(text), '[^a-z]+'), lambda w: length(w) > 2)"

ORACLE_SQL = {
    "fulltext_lookup": f"""
        WITH b0 AS (SELECT item_id, {_WORDS} AS ws FROM benchmark), b1 AS (SELECT item_id, list_filter(ws, lambda w, i: list_position(ws, w) = i)[1:5] AS ws FROM b0),
        b AS (SELECT item_id, unnest(ws) AS word FROM b1), h AS (SELECT doc_id, unnest(list_distinct({_WORDS})) AS word FROM documents WHERE length(text) > 50),
        n AS (SELECT item_id, doc_id, count(*) AS n FROM h JOIN b USING (word) GROUP BY ALL)
        SELECT item_id, doc_id, n AS n_words FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY n DESC, doc_id) AS r FROM n) WHERE r = 1""",
    "title_merge": """
        WITH u AS (SELECT p_name AS title, 0 AS source, CASE WHEN p_size > 25 THEN p_type END AS description, p_partkey AS row_no FROM part
            UNION ALL SELECT p_name || CASE WHEN p_partkey % 2 = 0 THEN ' x' ELSE '' END, 1, p_brand, p_partkey FROM part)
        SELECT title, source, description, row_no FROM (SELECT *, row_number() OVER (PARTITION BY title ORDER BY source, description IS NULL, row_no) AS r FROM u) WHERE r = 1""",
    "related_expansions": r"""
        WITH w AS (SELECT lang, unnest(list_distinct(regexp_extract_all(lower(text), '[\pL\pN]+'))) AS word FROM documents WHERE lang IS NOT NULL),
        s AS (SELECT word, lang || ' $1\' || count(*) AS form FROM w WHERE length(word) = 6 GROUP BY word, lang HAVING count(*) >= 2),
        q AS (SELECT item_id, text, regexp_extract_all(lower(text), '[\pL\pN]+') AS ws FROM benchmark), h AS (SELECT DISTINCT item_id, text, ws, unnest(ws) AS word FROM q),
        f AS (SELECT item_id, list_position(ws, word) AS place, form, regexp_split_to_array(lower(text), '[^\pL\pN]+') AS x,
                     array_to_string(list_transform(regexp_extract_all(text, '[\pL\pN]+|[^\pL\pN]+'), lambda t: CASE WHEN lower(t) = word THEN form ELSE t END), '') AS query FROM h JOIN s USING (word)),
        r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY place, form)::INTEGER AS no FROM f)
        SELECT item_id AS query_id, no, query FROM r WHERE no <= 3 UNION ALL SELECT item_id, 0, text FROM benchmark""",
    "url_query": r"""SELECT page_id, nullif(regexp_extract(split_part(url, '#', 1), '[?&]page=([^&]*)', 1), '') AS page, nullif(regexp_extract(split_part(url, '#', 1), '[?&]ref=([^&]*)', 1), '') AS ref FROM pages""",
    "expanded_query": """SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN trim(text) WHEN length(role) < 0.5 * length(text) THEN text ELSE role END AS expanded FROM conversations""",
    "clarification_prompts": f"""WITH n AS (SELECT query_id, own_label AS l, rank, id FROM ({_TOP}) WHERE rank <= 3)
        SELECT query_id, 'Codes P1, L' || l || '; readings {{' || CASE WHEN l % 2 = 0 THEN 'rpm: ' || (l * 100) || '.0' ELSE '' END || '}}.' || chr(10) || string_agg(rank || '. item ' || id, chr(10) ORDER BY rank) || chr(10) || 'P1, L' || l || '?' AS prompt
        FROM n GROUP BY query_id, l""",
    "format_candidates": f"""
        SELECT query_id, string_agg(rank || '. ' || id || ' (score: ' || format('{{:.3f}}', label / 8.0::DOUBLE) || ')', chr(10) ORDER BY rank) AS lines FROM ({_TOP}) WHERE rank <= 3 AND score < 0.9995 GROUP BY query_id""",
    "parse_questions": r"""
        WITH l AS (SELECT conv_id, turn, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda s: regexp_matches(s, '^([0-9]+[.)]|[-*•])\s+') OR ends_with(s, '?')) AS ls FROM conversations),
        q AS (SELECT conv_id, turn, list_filter(list_transform(ls, lambda s: trim(regexp_replace(s, '^([0-9]+[.)]|[-*•])\s+', ''))), lambda s: length(s) > 10)[1:3] AS qs FROM l)
        SELECT conv_id, turn, len(qs)::INTEGER AS n_questions, array_to_string(qs, '|') AS questions FROM q""",
    "prompt_fill": "SELECT c_custkey, 'Codes ' || c_mktsegment || ' of ' || c_name || ': ' || c_mktsegment || '?' AS prompt FROM customer",
    "limit_keys": """SELECT c_custkey, CASE WHEN c_custkey % 4 < 2 THEN 'ratelimit:' || lower(c_name) WHEN c_custkey % 4 = 2 THEN 'guest:' || c_name WHEN c_custkey % 8 = 3 THEN 'ratelimit:ip:10.0.0.1' ELSE 'ratelimit:ip:unknown' END AS key FROM customer""",
    "hybrid_exact": f"""WITH h AS (SELECT query_id, id, 0.3::DOUBLE * (id % 10 = (query_id // 100) % 10)::INTEGER + 0.7::DOUBLE * score AS hybrid FROM ({SIM_SQL})),
        r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY hybrid DESC, id)::INTEGER AS rank FROM h) SELECT query_id, rank, id, round(hybrid, 6) AS hybrid FROM r WHERE rank <= 5""",
    "related_codes": """WITH l AS (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem) SELECT a.l_partkey AS query_part, b.l_partkey, count(*) AS n_orders FROM l a JOIN l b USING (l_orderkey)
        WHERE a.l_partkey <> b.l_partkey GROUP BY ALL""",
    "additive_boost": """WITH d AS (SELECT doc_id, lang || '|' || source AS codes, (n_chars % 100) / 100.0::DOUBLE AS score FROM documents)
        SELECT doc_id, round(CASE WHEN codes IN (SELECT codes FROM d WHERE doc_id % 2 = 0 AND score > 0.5) THEN least(1, score + 0.1) ELSE score END, 6) AS score FROM d WHERE doc_id % 2 = 1""",
    "param_sweep": f"SELECT t AS threshold, count(*) AS n, round(avg(score), 6) AS mean_score FROM ({_TOP}), (VALUES (0.0::DOUBLE), (0.2), (0.3), (0.5)) v(t) WHERE rank <= 5 AND score >= t GROUP BY t",
    "expansion_stats": f"""WITH p AS (SELECT query_id, max(score) AS a, avg(score) FILTER (WHERE rank > 2) AS b FROM ({_TOP}) WHERE rank BETWEEN 2 AND 6 GROUP BY query_id)
        SELECT count(*) AS n, round(avg(a), 6) AS mean_a, round(avg(b), 6) AS mean_b, count(*) FILTER (WHERE b > a) AS wins, count(*) FILTER (WHERE b < a) AS losses FROM p""",
    "etl_counters": """SELECT CASE WHEN quality IS NULL THEN 'unlabelled' WHEN toxic = 1 THEN 'toxic' WHEN quality = 1 THEN 'kept' ELSE 'dropped' END AS status, count(*) AS n, sum(n_chars)::BIGINT AS chars
        FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1""",
    "mapping_coverage": """WITH l AS (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) SELECT count(*) AS total, count(n) AS mapped, coalesce(sum(n), 0)::BIGINT AS n_rows, round(avg(n), 6) AS mean_rows FROM orders LEFT JOIN l ON l_orderkey = o_orderkey""",
    "sessions_entries": "SELECT conv_id, count(*)::INTEGER AS n, sha256(string_agg(role || ':' || text, chr(10) ORDER BY turn, role, text)) AS digest FROM conversations GROUP BY conv_id",
    "queue_counts": """SELECT CASE WHEN event_id % 4 = 3 OR (event_id % 4 = 1 AND ts < TIMESTAMP '2024-01-30 11:00:00') THEN 'pending' ELSE ['pending', 'in_progress', 'completed', 'failed'][event_id % 4 + 1] END AS status, count(*) AS n FROM events GROUP BY 1""",
    "tree_edges": "SELECT * FROM (SELECT lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS parent, o_orderkey AS child FROM orders) WHERE parent IS NOT NULL",
    "retrieve_config": f"""
        WITH n AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS r FROM ({SIM_SQL}) WHERE score >= 0.1) WHERE r <= 10),
        c AS (SELECT *, 0.4::DOUBLE * greatest(0, least(1, score)) + 0.2::DOUBLE * (label / 10.0::DOUBLE) + 0.1::DOUBLE * CASE WHEN label % 2 = 0 THEN 0.9 ELSE 0.5 END::DOUBLE AS combined FROM n),
        b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, label ORDER BY combined DESC, score DESC, id) AS g FROM c) WHERE g = 1),
        t AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY combined DESC, id)::INTEGER AS rank FROM b)
        SELECT query_id, rank, id, label AS procedure_id, round(score, 6) AS score, round(combined, 6) AS combined_score FROM t WHERE rank <= 5""",
}
