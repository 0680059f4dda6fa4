"""Queries of the operators on records, pairs, updates and accounting."""

from __future__ import annotations

from pyspark.sql import functions as F

from wrenchlake.functions import text as T
from wrenchlake.operators import blocks as K
from wrenchlake.operators import feedback as B
from wrenchlake.operators import records as O
from wrenchlake.operators import retrieval as Q
from wrenchlake.plans.tables import SIM_SQL, items, queries, table
from wrenchlake.plans.text_queries import _CODES
from wrenchlake.shared import kept
from wrenchlake.streaming import memory as Y


def chunk_merge(spark, d):
    """Searches in two filtered halves of the index, merged to documents of four chunks each by their best score."""
    halves = [K.where(lambda item, query: item["label"] < 5), K.where(lambda item, query: item["label"] >= 5)]
    near = kept(K.nearest(items(spark, d), queries(spark, d).drop("label"), 20, *halves), "halves")
    halves = [Q.top_k(near.where(w), 20).select("query_id", F.expr("id div 4").alias("id"), "score") for w in ("label < 5", "label >= 5")]
    out = O.merge_chunks(halves[0].unionByName(halves[1]), 5)
    return out.select("query_id", "id", F.round("score", 6).alias("score"), "rank")


def rerank_order(spark, d):
    """The first ten of twenty neighbours are scored again."""
    near = Q.knn(items(spark, d), queries(spark, d).drop("label"), 20)
    out = O.rerank(near, F.pmod("id", F.lit(7)) / 2.0 - 1.0, 10)
    return out.select("query_id", "id", F.round("rerank_score", 6).alias("rerank_score"), "rank_before", "rank")


def _records(spark, d):
    """Parts as scraped records."""
    n = F.col("p_partkey")
    codes = F.when(n % 4 == 0, F.array().cast("array<string>")).when(n % 4 == 1, F.array(F.lit(" p0300 "))).when(n % 4 == 2, F.array(F.lit("bad"), F.lit("S1A22"))).otherwise(F.array(F.lit("X1234")))
    text = F.when(n % 3 == 0, "").otherwise(F.concat_ws(" ", "p_name", "p_type", "p_brand", "p_name"))
    vehicle = F.struct(F.when(n % 5 > 0, F.col("p_brand")).alias("make"), F.when(n % 5 > 1, F.col("p_type")).alias("model"), F.when(n % 5 > 2, F.col("p_size")).alias("year"))
    return table(spark, d, "part").select(
        "p_partkey", codes.alias("codes"), text.alias("summary"), F.col("p_name").alias("symptoms"), vehicle.alias("vehicle"), F.when(n % 2 == 0, F.col("p_type")).alias("title"), (n % 3).alias("n_steps"), (n % 7).alias("n_sensors"),
        F.when(n % 6 == 0, "Success").when(n % 6 == 1, "unclear").otherwise("partial").alias("outcome"), (n % 4 == 0).alias("cause"),
    )


def batch_gate(spark, d):
    """Score and fate of records in the batch route."""
    r = _records(spark, d)
    score = O.batch_score(*[F.col(c) for c in ("codes", "symptoms", "vehicle", "title", "n_steps", "summary", "n_sensors", "outcome", "cause")])
    r = r.withColumn("score", score)
    return r.select("p_partkey", F.round("score", 6).alias("score"), O.batch_gate(F.col("codes"), F.col("summary"), F.col("cause"), F.round("score", 6)).alias("fate"))


def _told(doc_id, text):
    """Texts that end with or without a word of repair."""
    return F.concat(text, F.when(doc_id % 4 == 0, " ... It was REPLACED.").when(doc_id % 4 == 1, " Irreplaced; prefixed").when(doc_id % 4 == 2, " Problem solved").otherwise(""))


def prefilter(spark, d):
    """Texts of 200 characters and more with a code or a word of repair."""
    return table(spark, d, "documents").select("doc_id", O.worth_extracting(_told(F.col("doc_id"), F.col("text"))).alias("worth"))


def title_relevance(spark, d):
    """Which titles suggest a fault; titles outside 3 to 200 characters are null."""
    p = table(spark, d, "part")
    kind = F.col("p_partkey") % 6
    title = F.when(kind == 0, "Next").when(kind == 1, F.col("p_partkey").cast("string")).when(kind == 2, F.concat_ws("x", "p_type", "p_brand")).when(kind == 3, F.concat(F.lit(" Unsolved "), "p_type")).when(kind == 4, F.concat(F.lit("Cylinder Misfires "), "p_type")).otherwise(F.concat(F.lit(" "), "p_name"))
    return p.select("p_partkey", O.title_is_relevant(title).alias("relevant"), O.clean_title(title).alias("title"))


def item_defaults(spark, d):
    """Fields as given, else found in the text."""
    docs = table(spark, d, "documents")
    given = {"codes": O.normal_codes(F.when(F.col("doc_id") % 2 == 0, F.array(F.concat(F.lit(" p"), F.col("lang")), F.lit(" ")))), "outcome": F.when(F.col("doc_id") % 3 == 0, "given")}
    out = O.with_defaults(docs.select("doc_id", "text", "lang"), "text", given)
    return out.select("doc_id", F.array_join("codes", ",").alias("codes"), "confidence", F.when(F.col("doc_id") % 3 == 0, F.col("outcome")).alias("given_outcome"))


def key_fallback(spark, d):
    """Labels by the part's key, else by its size; blank labels don't count."""
    rows = table(spark, d, "part").select(F.col("p_partkey").alias("id"), "p_partkey", "p_size")
    labels = table(spark, d, "supplier").select("s_suppkey", F.when(F.col("s_suppkey") % 3 == 0, " ").otherwise(F.col("s_name")).alias("title"))
    return O.first_key_join(rows, labels, ["p_partkey", "p_size"], "s_suppkey", "title")


def linked_objects(spark, d):
    """The distinct suppliers of each ordered part that are linked to it by an order."""
    l, s = table(spark, d, "lineitem"), table(spark, d, "supplier")
    return l.select("l_partkey", "l_suppkey").distinct().join(s, F.col("l_suppkey") == F.col("s_suppkey")).select("l_partkey", "s_suppkey", "s_name")


def description_lookup(spark, d):
    """Descriptions by any of two ids, else by the first three words of the title."""
    p = table(spark, d, "part")
    rows = p.select((F.col("p_partkey") * 2).alias("id"), F.col("p_name").alias("title"))
    held = p.where("p_partkey % 3 = 0").select(F.col("p_partkey").alias("a"), (F.col("p_partkey") + 1).alias("b"), F.col("p_name").alias("title"), F.concat_ws(" / ", "p_name", "p_type", "p_brand", "p_name").alias("description"))
    return O.lookup_or_search(rows, held, ["a", "b"], 20)


def json_unnest(spark, d):
    """The distinct elements of arrays kept as JSON."""
    o = table(spark, d, "orders").select(F.concat(F.lit('["'), "o_orderpriority", F.lit('", "'), "o_orderstatus", F.lit('"]')).alias("codes"))
    return o.select(F.explode(F.from_json("codes", "array<string>")).alias("code")).distinct()


def procedure_content(spark, d):
    """Customers with orders, with how many and which states; those without are left out."""
    o = table(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("n_orders"), F.array_join(F.array_sort(F.collect_set("o_orderstatus")), ",").alias("states"))
    return table(spark, d, "customer").join(o, F.col("c_custkey") == F.col("o_custkey")).select("c_custkey", "c_name", "n_orders", "states")


def session_pairs(spark, d):
    """The selected of an order's parts is the smallest, the others are negatives."""
    s = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.min("l_partkey").alias("selected"), F.collect_set("l_partkey").alias("recommended"))
    return O.session_pairs(s).select("id", "positive", F.array_join("negatives", ",").alias("negatives"))


def scraped_pairs(spark, d):
    """Orders as records to learn from."""
    k = F.col("o_orderkey")
    o = table(spark, d, "orders").select(
        "o_orderkey", F.when(k % 3 == 0, "success").when(k % 3 == 1, "partial").otherwise("failure").alias("outcome"), F.when(k % 4 > 0, (k % 10) / 10.0).alias("confidence"),
        F.when(k % 5 > 0, F.col("o_orderpriority")).alias("summary"), F.when(k % 7 > 0, F.array("o_orderstatus")).alias("codes"), F.when(k % 2 == 0, "cause_to_solution").otherwise("fault_code").alias("record_type"),
    )
    return O.scraped_pairs(o).select("o_orderkey", "outcome")


def matcher_accuracy(spark, d):
    """Neighbours as solutions; without one above the floor there is no result."""
    best = Q.knn(items(spark, d), queries(spark, d).drop("label"), 2).where("rank = 2").select("query_id", F.when(F.col("score") > 0.3, F.col("score")).alias("similarity"))
    out = O.matcher_accuracy(best, 0.4)
    return out.withColumns({c: F.round(c, 6) for c in ("accuracy", "accuracy_all", "coverage", "mean_similarity")})


def success_by_form(spark, d):
    """Hits by the form of the query."""
    near = Q.knn(items(spark, d), queries(spark, d).withColumnRenamed("label", "own"), 10)
    own = queries(spark, d).select("query_id", F.col("label").alias("own_label"))
    found = near.join(own, "query_id").where("label = own_label and id <> query_id").groupBy("query_id").agg(F.min("rank").alias("rank"))
    ranks = own.join(found, "query_id", "left").select(F.when(F.col("query_id") % 200 == 0, "short").otherwise("long").alias("form"), F.coalesce("rank", F.lit(0)).alias("rank"))
    return O.success_by_form(ranks).withColumns({c: F.round(c, 6) for c in ("hit_rate", "mean_rank")})


def accounting(spark, d):
    """By user, sessions with corrections and the cost of their tokens."""
    e = table(spark, d, "events")
    corrected = B.corrections(e.select("user_id", F.when(F.col("event_id") % 3 == 0, F.when(F.col("event_id") % 2 == 0, "[]").otherwise("[1]")).alias("corrections")), ["user_id"])
    prices = e.select(F.col("event_type").alias("kind")).distinct().where("kind <> 'error'").withColumn("price", F.length("kind") * 2.5)
    costs = B.token_costs(e.select("user_id", F.col("event_type").alias("kind"), (F.col("event_id") % 1000).alias("tokens")), prices, ["user_id"])
    return corrected.join(costs, "user_id").withColumn("cost", F.round("cost", 9))


def memory_statistics(spark, d):
    """The memory that all rated events leave."""
    e = table(spark, d, "events")
    rating = F.pmod(F.floor(F.abs("value")), F.lit(5)).cast("int") + 1
    m = Y.remembered(e.select("event_id", F.array("event_type", (F.col("user_id") % 7).cast("string")).alias("codes"), (F.col("event_id") % 31).alias("doc_id"), rating.alias("rating")))
    return B.memory_statistics(m).withColumn("mean_records", F.round("mean_records", 6))


def newest_entries(spark, d):
    """The hundred newest entries of one type."""
    return B.newest(table(spark, d, "events").select("event_id", "ts", "event_type"), "ts", "event_id", 100, event_type="click", user_id=None)


def repeated_changes(spark, d):
    """Of several changes of a key the latest counts."""
    o = table(spark, d, "orders")
    changes = o.select(F.col("o_custkey").alias("c_custkey"), F.col("o_orderkey").alias("arrival"), F.when(F.col("o_orderkey") % 4 > 0, F.col("o_orderpriority")).alias("c_mktsegment"))
    return O.update_rows(table(spark, d, "customer").select("c_custkey", "c_mktsegment"), changes, "c_custkey", order="arrival")


def update_delete(spark, d):
    """A payload column is updated, nulls keep it, and some rows are deleted."""
    c = table(spark, d, "customer").select("c_custkey", "c_name", "c_mktsegment")
    changes = c.where("c_custkey % 3 = 0").select("c_custkey", F.when(F.col("c_custkey") % 2 == 0, "CHANGED").alias("c_mktsegment"))
    return O.delete_rows(O.update_rows(c, changes, "c_custkey"), c.where("c_custkey % 10 = 1"), "c_custkey")


def write_back(spark, d):
    """Matched values overwrite what was there, nulls too."""
    s = table(spark, d, "supplier").select("s_suppkey", "s_name", "s_nationkey")
    return O.update_rows(s, s.where("s_suppkey % 2 = 0").select("s_suppkey", F.when(F.col("s_suppkey") % 4 == 0, F.col("s_nationkey") + 100).alias("s_nationkey")), "s_suppkey", keep=False)


def latest_weights(spark, d):
    """The active weights of the highest id."""
    n = table(spark, d, "nation").select(F.col("n_nationkey").alias("id"), (F.col("n_nationkey") % 4 == 1).alias("is_active"), F.col("n_name").alias("name"))
    return O.latest_active(n).select("id", "name")


def resume_after(spark, d):
    """Parts beyond the last one of a brand."""
    p = table(spark, d, "part").select("p_partkey", "p_brand")
    return O.resume_after(p, p.where("p_brand = 'Brand#11'").agg((F.max("p_partkey") / 2).cast("long").alias("p_partkey")), "p_partkey")


def parent_join(spark, d):
    """A table joined to itself through its parent's key."""
    p = table(spark, d, "part").select("p_partkey", "p_name")
    parent = p.select(F.col("p_partkey").alias("parent"), F.col("p_name").alias("parent_name"))
    return p.join(parent, F.expr("p_partkey div 10") == F.col("parent")).select("p_partkey", "parent", "parent_name")


QUERIES = {f.__name__: f for f in (
    memory_statistics, newest_entries, repeated_changes, chunk_merge, rerank_order, batch_gate, prefilter, title_relevance, item_defaults, key_fallback, linked_objects, description_lookup, json_unnest, procedure_content, session_pairs, scraped_pairs, matcher_accuracy, success_by_form,
    accounting, update_delete, write_back, latest_weights, resume_after, parent_join,
)}

_RANKED = f"SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id)::INTEGER AS rank FROM ({SIM_SQL})"
_FOUND = r"""regexp_matches(text, '(?i)\bP[0-9][0-9][0-9][0-9]\b') OR regexp_matches(text, '\b[A-Z][0-9][A-Z][0-9][0-9]\b') OR regexp_matches(text, '\b[A-Z][0-9][0-9][0-9][0-9]\b')"""

ORACLE_SQL = {
    "chunk_merge": f"""WITH h AS (SELECT *, row_number() OVER (PARTITION BY query_id, label < 5 ORDER BY score DESC, id) AS n FROM ({SIM_SQL})),
        m AS (SELECT query_id, id // 4 AS id, max(score) AS score FROM h WHERE n <= 20 GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id)::INTEGER AS rank FROM m)
        SELECT query_id, id, round(score, 6) AS score, rank FROM r WHERE rank <= 5""",
    "rerank_order": f"""WITH n AS (SELECT query_id, id, rank AS rank_before, CASE WHEN rank <= 10 THEN 1 / (1 + exp(-((id % 7) / 2.0::DOUBLE - 1))) ELSE 0 END::DOUBLE AS s FROM ({_RANKED}) WHERE rank <= 20)
        SELECT query_id, id, round(s, 6) AS rerank_score, rank_before, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, rank_before)::INTEGER AS rank FROM n""",
    "batch_gate": """
        WITH r AS (SELECT *, p_partkey AS n, CASE WHEN p_partkey % 3 = 0 THEN '' ELSE concat_ws(' ', p_name, p_type, p_brand, p_name) END AS summary, p_partkey % 4 = 0 AS cause FROM part),
        s AS (SELECT n, summary, cause, n % 4 <> 0 AS coded,
            CASE WHEN n % 4 <> 0 THEN 0.3 WHEN length(p_name) >= 20 THEN 0.2 WHEN length(p_name) > 0 THEN 0.1 ELSE 0 END::DOUBLE + CASE WHEN n % 5 > 2 THEN 0.2 WHEN n % 5 > 1 THEN 0.1 ELSE 0 END::DOUBLE
            + CASE WHEN n % 2 = 0 AND (n % 3 > 0 OR length(summary) >= 50) THEN 0.3 WHEN n % 2 = 0 OR n % 3 > 0 OR length(summary) >= 50 THEN 0.15 ELSE 0 END::DOUBLE
            + CASE WHEN n % 7 >= 5 THEN 0.15 WHEN n % 7 >= 3 THEN 0.1 WHEN n % 7 >= 1 THEN 0.05 ELSE 0 END::DOUBLE + CASE WHEN n % 6 <> 1 THEN 0.05 ELSE 0 END::DOUBLE AS raw FROM r)
        SELECT n AS p_partkey, round(raw, 6) AS score, CASE WHEN CASE WHEN cause THEN length(trim(summary)) < 50 ELSE NOT coded END THEN 'invalid' WHEN round(raw, 6) < 0.6 THEN 'quality' ELSE 'valid' END AS fate FROM s""",
    "prefilter": f"""WITH t AS (SELECT doc_id, text || CASE doc_id % 4 WHEN 0 THEN ' ... It was REPLACED.' WHEN 1 THEN ' Irreplaced; prefixed' WHEN 2 THEN ' Problem solved' ELSE '' END AS text FROM documents)
        SELECT doc_id, coalesce(length(text) >= 200 AND ({_FOUND} OR regexp_matches(text, '(?i)(^|[^\\pL\\pN_])({"|".join(T.REPAIR_WORDS)})($|[^\\pL\\pN_])')), false) AS worth FROM t""",
    "title_relevance": r"""WITH t AS (SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN 'Next' WHEN 1 THEN p_partkey::VARCHAR WHEN 2 THEN p_type || 'x' || p_brand WHEN 3 THEN ' Unsolved ' || p_type WHEN 4 THEN 'Cylinder Misfires ' || p_type ELSE ' ' || p_name END AS title FROM part),
        l AS (SELECT *, trim(lower(title)) AS low FROM t)
        SELECT p_partkey, length(title) >= 5 AND NOT regexp_matches(low, '^[0-9]+$') AND low NOT IN ('last', 'next', 'prev', 'previous', 'page') AND (regexp_matches(low, '\b[0-9a-z]{4,5}\b') OR """
    + " OR ".join(f"contains(low, '{w}')" for w in T.TITLE_FIX_WORDS + T.TITLE_WORDS)
    + """) AS relevant, CASE WHEN length(trim(title)) BETWEEN 3 AND 200 THEN trim(title) END AS title FROM l""",
    "item_defaults": f"""SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'P' || upper(lang) ELSE array_to_string({_CODES}, ',') END AS codes, CASE WHEN doc_id % 2 = 0 THEN 1.0 ELSE 0.5 END::DOUBLE AS confidence,
        CASE WHEN doc_id % 3 = 0 THEN 'given' END AS given_outcome FROM documents""",
    "key_fallback": """WITH l AS (SELECT s_suppkey, s_name AS label FROM supplier WHERE s_suppkey % 3 <> 0), t AS (SELECT p_partkey AS id, 0 AS key_no, p_partkey AS k FROM part UNION ALL SELECT p_partkey, 1, p_size FROM part),
        h AS (SELECT id, key_no, label, min(key_no) OVER (PARTITION BY id) AS f FROM t JOIN l ON k = s_suppkey)
        SELECT p.p_partkey AS id, key_no::INTEGER AS key_no, label FROM part p LEFT JOIN (SELECT DISTINCT id, key_no, label FROM h WHERE key_no = f) x ON x.id = p.p_partkey""",
    "linked_objects": "SELECT DISTINCT l_partkey, s_suppkey, s_name FROM lineitem JOIN supplier ON l_suppkey = s_suppkey",
    "description_lookup": """
        WITH h AS (SELECT p_partkey AS a, p_partkey + 1 AS b, array_to_string(string_split(lower(p_name), ' ')[1:3], ' ') AS w, concat_ws(' / ', p_name, p_type, p_brand, p_name) AS description FROM part WHERE p_partkey % 3 = 0),
        g AS (SELECT * FROM h WHERE length(description) > 20), i AS (SELECT k, min(description) AS by_id FROM (SELECT a AS k, description FROM g UNION ALL SELECT b, description FROM g) GROUP BY k), v AS (SELECT w, min(description) AS by_words FROM g GROUP BY w)
        SELECT p_partkey * 2 AS id, coalesce(by_id, by_words) AS description, CASE WHEN by_id IS NOT NULL THEN 'id' WHEN by_words IS NOT NULL THEN 'words' END AS found_by
        FROM part LEFT JOIN i ON k = p_partkey * 2 LEFT JOIN v ON v.w = array_to_string(string_split(lower(p_name), ' ')[1:3], ' ')""",
    "json_unnest": "SELECT DISTINCT unnest([o_orderpriority, o_orderstatus]) AS code FROM orders",
    "procedure_content": "SELECT c_custkey, any_value(c_name) AS c_name, count(*) AS n_orders, string_agg(DISTINCT o_orderstatus, ',' ORDER BY o_orderstatus) AS states FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey",
    "session_pairs": """WITH s AS (SELECT l_orderkey AS id, min(l_partkey) AS positive, list_sort(list_distinct(list(l_partkey))) AS r FROM lineitem GROUP BY 1)
        SELECT id, positive, array_to_string(r[2:], ',') AS negatives FROM s WHERE len(r) > 1""",
    "scraped_pairs": """SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 'success' ELSE 'partial' END AS outcome FROM orders
        WHERE o_orderkey % 3 < 2 AND (o_orderkey % 4 = 0 OR o_orderkey % 10 >= 7) AND o_orderkey % 5 > 0 AND (o_orderkey % 7 > 0 OR o_orderkey % 2 = 0)""",
    "matcher_accuracy": f"""WITH p AS (SELECT CASE WHEN score > 0.3 THEN score END AS s FROM ({_RANKED}) WHERE rank = 2), a AS (SELECT count(*) AS n, count(s) AS e, count(*) FILTER (WHERE s >= 0.4) AS m, avg(s) AS x FROM p)
        SELECT n AS attempted, e AS evaluated, m AS matched, round(m / nullif(e, 0), 6) AS accuracy, round(m / nullif(n, 0), 6) AS accuracy_all, round(e / nullif(n, 0), 6) AS coverage, round(x, 6) AS mean_similarity FROM a""",
    "success_by_form": f"""WITH f AS (SELECT query_id, min(rank) AS rank FROM ({_RANKED}) WHERE rank <= 10 AND label = own_label AND id <> query_id GROUP BY 1),
        r AS (SELECT CASE WHEN vec_id % 200 = 0 THEN 'short' ELSE 'long' END AS form, coalesce(rank, 0) AS rank FROM embeddings LEFT JOIN f ON query_id = vec_id WHERE vec_id % 100 = 0)
        SELECT form, count(*) AS n, round(avg(CASE WHEN rank BETWEEN 1 AND 5 THEN 1.0 ELSE 0.0 END), 6) AS hit_rate, round(avg(rank) FILTER (WHERE rank > 0), 6) AS mean_rank FROM r GROUP BY form""",
    "accounting": """SELECT user_id, count(*) AS n_sessions, count(*) FILTER (WHERE event_id % 3 = 0) AS n_corrected, count(*) AS n_calls, sum(event_id % 1000)::BIGINT AS n_tokens,
        round(sum(CASE WHEN event_type = 'error' THEN 0 ELSE length(event_type) * 2.5::DOUBLE END * (event_id % 1000) / 1e6), 9) AS cost FROM events GROUP BY user_id""",
    "memory_statistics": """WITH m AS (SELECT array_to_string(list_sort([event_type, (user_id % 7)::VARCHAR]), ',') AS k, count(DISTINCT event_id % 31) AS n FROM events WHERE value IS NULL OR floor(abs(value))::BIGINT % 5 + 1 >= 4 GROUP BY k)
        SELECT count(*) AS n_patterns, sum(n)::BIGINT AS n_records, round(sum(n) / count(*), 6) AS mean_records FROM m""",
    "newest_entries": "SELECT event_id, ts, event_type FROM events WHERE event_type = 'click' ORDER BY ts DESC NULLS LAST, event_id LIMIT 100",
    "repeated_changes": """WITH l AS (SELECT o_custkey, arg_max(CASE WHEN o_orderkey % 4 > 0 THEN o_orderpriority ELSE '' END, o_orderkey) AS p FROM orders GROUP BY o_custkey)
        SELECT c_custkey, coalesce(nullif(p, ''), c_mktsegment) AS c_mktsegment FROM customer LEFT JOIN l ON o_custkey = c_custkey""",
    "update_delete": "SELECT c_custkey, c_name, CASE WHEN c_custkey % 6 = 0 THEN 'CHANGED' ELSE c_mktsegment END AS c_mktsegment FROM customer WHERE c_custkey % 10 <> 1",
    "write_back": "SELECT s_suppkey, s_name, CASE WHEN s_suppkey % 4 = 0 THEN s_nationkey + 100 WHEN s_suppkey % 2 = 0 THEN NULL ELSE s_nationkey END AS s_nationkey FROM supplier",
    "latest_weights": "SELECT n_nationkey AS id, n_name AS name FROM nation WHERE n_nationkey % 4 = 1 ORDER BY 1 DESC LIMIT 1",
    "resume_after": "SELECT p_partkey, p_brand FROM part WHERE p_partkey > coalesce((SELECT (max(p_partkey) // 2) FROM part WHERE p_brand = 'Brand#11'), -1)",
    "parent_join": "SELECT c.p_partkey, p.p_partkey AS parent, p.p_name AS parent_name FROM part c JOIN part p ON c.p_partkey // 10 = p.p_partkey",
}
