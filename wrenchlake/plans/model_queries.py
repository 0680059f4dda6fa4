"""Queries over the star tables: lookups, joins, feedback, state, graphs, upserts, streams' batch forms."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from wrenchlake.functions import vectors as V
from wrenchlake.operators import evaluate as E
from wrenchlake.operators import feedback as B
from wrenchlake.operators import graph as G
from wrenchlake.operators import relational as R
from wrenchlake.plans.tables import ENTRIES_SQL, entries, table
from wrenchlake.sources import records as S
from wrenchlake.streaming import events as X


def distinct_scan(spark, d):
    return R.distinct_scan(table(spark, d, "part"), "p_brand", "Brand%")


def offset_page(spark, d):
    return R.page(table(spark, d, "customer").select("c_custkey", "c_name"), ["c_custkey"], 50, 25)


def first_per_key(spark, d):
    o = table(spark, d, "orders")
    return R.first_per_key(o, ["o_custkey"], [F.asc("o_orderdate"), F.asc("o_orderkey")]).select("o_custkey", "o_orderkey", "o_orderdate")


def latest_per_key(spark, d):
    e = table(spark, d, "events").select("user_id", "event_type", F.struct("ts", "event_id").alias("at"), "event_id")
    return R.latest_per_key(e, ["user_id", "event_type"], "at").select("user_id", "event_type", "event_id")


def search_like(spark, d):
    return R.search_like(table(spark, d, "part").select("p_partkey", "p_name", "p_type"), ["p_name", "p_type"], "ECONOMY", None)


def bridge_codes(spark, d):
    """Suppliers as procedures, line items as the bridge, part brands as codes."""
    parts = table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand")
    return R.codes_of(table(spark, d, "lineitem").select("l_partkey", "l_suppkey"), parts, "l_partkey", "l_suppkey", "p_brand")


def first_variant(spark, d):
    """Codes that stand for part keys; the first variant that a part has wins."""
    c = spark.range(0, 1).select(F.explode(F.sequence(F.lit(1), F.lit(999))).alias("n")).select(F.concat(F.lit("P"), F.lpad(F.col("n").cast("string"), 4, "0")).alias("code"))
    parts = table(spark, d, "part").select(F.col("p_partkey").cast("string").alias("part_code"), "p_name")
    return R.first_variant_match(R.expand_codes(c, R.built_in_map(spark)), parts, "part_code", ["code"]).select("code", "variant", "variant_no", "p_name")


def layered_mapping(spark, d):
    own = table(spark, d, "part").select(F.concat(F.lit("P"), F.lpad(F.col("p_partkey").cast("string"), 9, "0")).alias("key"), F.col("p_brand").alias("value"))
    return R.layered_map(R.built_in_map(spark), own)


def _upsert_sides(spark, d):
    o = table(spark, d, "orders")
    made = lambda key, dt: [key.alias("source_url"), (F.pmod(F.col("o_orderkey"), F.lit(10)) / 10.0).alias("confidence"), F.when(F.col("o_orderstatus") == "F", "success").when(F.col("o_orderstatus") == "P", "partial").alias("outcome"), F.when(F.pmod(F.col("o_orderkey"), F.lit(3)) > 0, F.col("o_orderpriority")).alias("summary"), F.lit(dt).alias("source_type"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("created_at")]
    current = R.first_per_key(o.select(*made(F.col("o_custkey"), "old"), "o_orderkey"), ["source_url"], [F.asc("o_orderkey")]).drop("o_orderkey")
    staged = o.where("o_orderkey % 4 = 0").select(*made(F.col("o_custkey") + 20, "new"), F.col("o_orderkey").alias("arrival"))
    return current, staged


def upsert_conditional(spark, d):
    return R.conditional_upsert(*_upsert_sides(spark, d))


def patch_sessions(spark, d):
    e = table(spark, d, "events").select("user_id", F.struct("ts", "event_id").alias("at"), F.when(F.col("event_type") == "click", F.col("value")).alias("clicked"), F.when(F.col("event_id") % 3 == 0, F.col("event_type")).alias("last_type"))
    return R.patch_events(e, "user_id", "at", ["clicked", "last_type"]).select("user_id", F.round("clicked", 6).alias("clicked"), "last_type")


def attempt_counts(spark, d):
    e = table(spark, d, "events").select("user_id", "event_type", F.struct("ts", "event_id").alias("at"))
    return R.attempts(e, "user_id", "event_type", "at")


def missing_keys(spark, d):
    c = table(spark, d, "customer").select("c_custkey", "c_name")
    o = table(spark, d, "orders")
    a, b = (o.where(w).select(F.col("o_custkey").alias("c_custkey")) for w in ("o_orderstatus = 'F'", "o_orderstatus = 'P'"))
    return R.missing_keys(c, "c_custkey", a, b)


def anti_resume(spark, d):
    return table(spark, d, "documents").select("doc_id", "source").join(table(spark, d, "labels"), "doc_id", "left_anti")


def semi_scope(spark, d):
    return table(spark, d, "documents").select("doc_id", "source").join(table(spark, d, "labels").where("toxic = 1"), "doc_id", "left_semi")


def feedback_stats(spark, d):
    out = B.statistics(entries(spark, d))
    return out.withColumns({c: F.round(c, 6) for c in ("avg_rating", "coverage")})


def entity_ratings(spark, d):
    out = B.ratings(entries(spark, d))
    return out.withColumns({c: F.round(c, 6) for c in ("avg_rating", "score")})


def low_rated(spark, d):
    return B.ratings(entries(spark, d), 3.0).select("entity", F.round("avg_rating", 6).alias("avg_rating"))


def _trend(granularity):
    def run(spark, d):
        e = entries(spark, d)
        sessions = e.where("event_id % 3 = 0").select("ts", "outcome")
        return B.trends(sessions, e.where("event_id % 3 <> 0"), granularity).withColumn("avg_rating", F.round("avg_rating", 6))

    run.__name__ = f"trends_{granularity}"
    return run


def json_props(spark, d):
    e = table(spark, d, "events").select("event_id", F.from_json("props", "k int").alias("p"))
    return e.select("event_id", F.col("p.k").alias("k"))


def since_filter(spark, d):
    return table(spark, d, "events").where(F.col("ts") >= F.lit("2024-01-20 00:00:00").cast("timestamp")).groupBy("event_type").agg(F.count("*").alias("n"))


def session_rounds(spark, d):
    return B.session_rounds(table(spark, d, "conversations"))


def ttl_expired(spark, d):
    last = table(spark, d, "events").groupBy("user_id").agg(F.max("ts").alias("ts"))
    return B.expired(last.withColumn("created", F.when(F.col("user_id") % 2 == 0, F.col("ts"))), "created", "ts", F.lit("2024-01-31 00:00:00").cast("timestamp")).select("user_id")


def tier_limits(spark, d):
    c = table(spark, d, "customer")
    kind = F.col("c_custkey") % 5
    keys = c.select("c_custkey", F.when(kind == 0, F.concat(F.lit("guest:"), "c_name")).when(kind == 1, F.lit("ratelimit:ip:10.0.0.1")).when(kind == 2, F.lit("other")).otherwise(F.concat(F.lit("ratelimit: "), F.upper("c_name"))).alias("key"))
    tiers = c.where("c_custkey % 2 = 0").select(F.lower("c_name").alias("user"), F.when(F.col("c_nationkey") > 3, F.col("c_nationkey")).alias("per_minute"), F.when(F.col("c_nationkey") % 2 == 0, 100).otherwise(0).alias("per_hour"), F.lit(1000).alias("per_day"))
    return B.tier_limits(keys, "key", tiers).select("c_custkey", "limit")


def sliding_limit_exact(spark, d):
    """Three requests an hour of each user."""
    return B.sliding_limit(table(spark, d, "events").select("event_id", "user_id", "ts"), "user_id", "ts", "event_id", 3, 3600.0)


def sliding_counts(spark, d):
    """The window form: requests of the user in the hour before each."""
    table(spark, d, "events").createOrReplaceTempView("wrenchlake_events")
    return spark.sql("SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 1 HOUR PRECEDING AND CURRENT ROW) AS n FROM wrenchlake_events")


def _graph(spark, d):
    c, o, n, r = (table(spark, d, t) for t in ("customer", "orders", "nation", "region"))
    nodes = S.union_all(G.nodes(r, "region", "r_regionkey", "r_name"), G.nodes(n, "nation", "n_nationkey", "n_name"), G.nodes(c, "customer", "c_custkey", "c_name"), G.nodes(o, "order", "o_orderkey", "o_orderpriority"))
    name = lambda kind, col: F.concat(F.lit(f"{kind}:"), F.col(col).cast("string"))
    edges = S.union_all(
        G.edges(n, name("region", "n_regionkey"), name("nation", "n_nationkey"), "has_nation"),
        G.edges(c, name("nation", "c_nationkey"), name("customer", "c_custkey"), "has_customer", G.priority_weight(F.col("c_acctbal") / 1000)),
        G.edges(o, name("customer", "o_custkey"), name("order", "o_orderkey"), "has_order"),
    )
    return nodes, G.with_both_ends(edges, nodes)


def graph_edges(spark, d):
    return _graph(spark, d)[1].withColumn("weight", F.round("weight", 6))


def graph_type_counts(spark, d):
    return G.type_counts(_graph(spark, d)[0], "node_type")


def graph_neighbors(spark, d):
    nodes, edges = _graph(spark, d)
    return G.neighbors(edges, nodes, "has_customer").select("src", "dst", "node_type", "label")


def graph_paths(spark, d):
    """From each region to each order, three hops."""
    nodes, edges = _graph(spark, d)
    of = lambda kind, col: nodes.where(F.col("node_type") == kind).select(F.col("node_id").alias(col))
    return G.cheapest_paths(edges, of("region", "src"), of("order", "dst"), 3).select("src", "dst", F.round("cost", 6).alias("cost"), "n", F.round("score", 6).alias("score"))


def popularity_top3(spark, d):
    """The twenty most ordered parts, and the three dearest line items of each."""
    li = table(spark, d, "lineitem")
    top = li.groupBy("l_partkey").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "l_partkey").limit(20)
    rows = li.join(F.broadcast(top), "l_partkey")  # 20 rows
    best = R.first_per_key(rows, ["l_partkey", "l_orderkey", "l_linenumber"], [F.asc("l_suppkey")])
    w = Window.partitionBy("l_partkey").orderBy(F.desc("l_extendedprice"), "l_orderkey", "l_linenumber")
    return best.withColumn("rank", F.row_number().over(w)).where("rank <= 3").select("l_partkey", "n", "rank", "l_orderkey", "l_linenumber")


def group_concat_distinct(spark, d):
    p = table(spark, d, "part").groupBy(F.upper("p_brand").alias("brand"))
    return p.agg(F.array_join(F.array_sort(F.collect_set("p_type")), ",").alias("types"))


def stratified_sample(spark, d):
    docs = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id")
    strata = [("toxic", F.col("toxic") == 1, 10), ("poor", F.col("quality") == 0, 10), ("french", F.col("lang") == "fr", 10), ("long", F.col("n_chars") > 5000, 5)]
    return E.stratified(docs, strata, [F.asc("doc_id")], "doc_id").select("doc_id", "stratum")


def seeded_sample(spark, d):
    return E.seeded_sample(table(spark, d, "documents").select("doc_id"), "doc_id", 50, 7)


def quality_order(spark, d):
    """Null ratings first, as the source database orders descending."""
    e = entries(spark, d).select("event_id", F.when(F.col("event_id") % 5 > 0, F.col("rating")).alias("rating"))
    return e.orderBy(F.desc_nulls_first("rating"), "event_id").limit(3000)


def match_buckets(spark, d):
    r = (F.col("event_id") % 100) / 100.0
    b = F.when(r >= 0.75, "high").when(r >= 0.6, "medium").otherwise("low")
    return table(spark, d, "events").groupBy(b.alias("bucket")).agg(F.count("*").alias("n"), F.round(F.avg(r), 6).alias("mean_score"))


def test_composition(spark, d):
    docs = table(spark, d, "documents")
    return docs.groupBy("lang", "source").agg(F.count("*").alias("n"), F.round(100.0 * F.avg((F.col("n_chars") > 500).cast("double")), 6).alias("long_pct"))


def sensor_features(spark, d):
    from wrenchlake.functions.text import SENSOR_RANGES

    e = table(spark, d, "events")
    sensors = F.create_map(F.lit("engine_rpm"), F.col("value") * 10, F.lit("coolant_temp"), F.col("value"), F.lit("extra"), -F.col("value"))
    f = V.sensor_features(sensors, {k: (float(a), float(b)) for k, (a, b) in SENSOR_RANGES.items()}, 16)
    return e.select("event_id", F.round(f[0] + 1e-9, 5).alias("rpm"), F.round(f[1] + 1e-9, 5).alias("temp"), F.round(f[11] + 1e-9, 5).alias("extra"), F.size(f).alias("dims"))


def cosine_schedule(spark, d):
    """The rate at the step of each event, of 1100 steps, the first hundred of them rising."""
    step = F.col("event_id") % 1100
    return table(spark, d, "events").select("event_id", step.alias("step"), F.round(V.cosine_schedule(step, 100, 1100), 6).alias("rate"))


def stream_tumbling(spark, d):
    return X.tumbling(table(spark, d, "events")).withColumn("total", F.round("total", 4))


def stream_session(spark, d):
    return X.sessions(table(spark, d, "events"))


def stream_dedup(spark, d):
    return X.first_seen(table(spark, d, "events").select("user_id", "event_type"), ["user_id", "event_type"])


def start_urls(spark, d):
    sites = table(spark, d, "region").select(F.col("r_name").alias("site"))
    codes = table(spark, d, "part").select(F.col("p_partkey").alias("code"))
    searched = codes.where("code % 2 = 0").withColumn("site", F.lit("ASIA"))
    return S.start_urls(sites, codes, searched).select("site", "code")


def disjoint_negatives(spark, d):
    """For each query part five parts of the same size that share no brand or type with it, by key."""
    p = table(spark, d, "part")
    a = p.where("p_partkey % 100 = 0").select(F.col("p_partkey").alias("anchor"), F.array("p_brand", "p_type").alias("a_codes"), "p_size")
    # of parts with the same size, brand and type only the first can be taken: six keys, as one may be the anchor's own, and five rows of each
    by = lambda *keys: Window.partitionBy("p_size", "p_brand", "p_type", *keys).orderBy("p_partkey")
    first = p.where("p_partkey is not null").withColumn("nth", F.dense_rank().over(by())).where("nth <= 6")
    first = first.withColumn("copy", F.row_number().over(by("p_partkey"))).where("copy <= 5")
    b = first.select("p_partkey", F.array("p_brand", "p_type").alias("b_codes"), "p_size")
    # a size is a key of many parts: they are dealt over salts, and each anchor asks all of them
    a = a.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(15))))
    b = b.withColumn("salt", F.pmod(F.xxhash64("p_partkey"), F.lit(16)).cast("int"))
    pairs = a.join(b, ["p_size", "salt"]).where((F.col("anchor") != F.col("p_partkey")) & ~F.arrays_overlap("a_codes", "b_codes"))
    w = Window.partitionBy("anchor").orderBy("p_partkey")
    return pairs.withColumn("n", F.row_number().over(w)).where("n <= 5").select("anchor", "p_partkey", "n")


QUERIES = {f.__name__: f for f in (
    distinct_scan, offset_page, first_per_key, latest_per_key, search_like, bridge_codes, first_variant, layered_mapping, upsert_conditional, patch_sessions, attempt_counts, missing_keys, anti_resume, semi_scope,
    feedback_stats, entity_ratings, low_rated, _trend("day"), _trend("week"), _trend("month"), json_props, since_filter, session_rounds, ttl_expired, tier_limits, sliding_limit_exact, sliding_counts,
    graph_edges, graph_type_counts, graph_neighbors, graph_paths, popularity_top3, group_concat_distinct, stratified_sample, seeded_sample, quality_order, match_buckets, test_composition, sensor_features, cosine_schedule,
    stream_tumbling, stream_session, stream_dedup, start_urls, disjoint_negatives,
)}

_E = f"e AS ({ENTRIES_SQL})"
_G = """
    w AS (SELECT 'nation:' || c_nationkey AS src, 'customer:' || c_custkey AS dst, 'has_customer' AS relationship, CASE WHEN c_acctbal / 1000 > 0 THEN 1 / greatest(c_acctbal / 1000, 0.1) ELSE 1 END::DOUBLE AS weight FROM customer
        WHERE c_nationkey IN (SELECT n_nationkey FROM nation)),
    r AS (SELECT 'region:' || n_regionkey AS src, 'nation:' || n_nationkey AS dst, 'has_nation' AS relationship, 1.0::DOUBLE AS weight FROM nation WHERE n_regionkey IN (SELECT r_regionkey FROM region)),
    o AS (SELECT DISTINCT 'customer:' || o_custkey AS src, 'order:' || o_orderkey AS dst, 'has_order' AS relationship, 1.0::DOUBLE AS weight FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer))"""


def _trend_sql(g: str) -> str:
    return f"""WITH {_E}, s AS (SELECT strftime(date_trunc('{g}', ts), '%Y-%m-%d') AS period, count(*) AS n_sessions, count(*) FILTER (WHERE outcome = 'success') AS ss FROM e WHERE event_id % 3 = 0 GROUP BY 1),
        f AS (SELECT strftime(date_trunc('{g}', ts), '%Y-%m-%d') AS period, count(rating) AS n_ratings, sum(rating) AS sr, count(*) FILTER (WHERE outcome = 'success') AS fs FROM e WHERE event_id % 3 <> 0 GROUP BY 1)
        SELECT period, n_sessions, coalesce(n_ratings, 0) AS n_ratings, round(sr::DOUBLE / n_ratings, 6) AS avg_rating, ss + coalesce(fs, 0) AS n_success FROM s LEFT JOIN f USING (period)"""


_RATINGS = f"""WITH {_E}, a AS (SELECT entity, avg(rating) AS r, count(*) AS n, count(*) FILTER (WHERE outcome = 'success') AS s, count(*) FILTER (WHERE outcome = 'failure') AS f, count(*) FILTER (WHERE outcome = 'partial') AS p, count(outcome) AS o FROM e GROUP BY entity)
    SELECT entity, round(r, 6) AS avg_rating, n, s AS n_success, f AS n_failure, p AS n_partial, o AS n_outcomes, round(greatest(0, least(1, CASE WHEN r IS NOT NULL AND o > 0 THEN 0.6 * (r - 1) / 4 + 0.4 * (s + 0.5 * p) / o ELSE coalesce((r - 1) / 4, (s + 0.5 * p) / nullif(o, 0)) END::DOUBLE)), 6) AS score FROM a"""

_MAP = ", ".join(f"('{k}', '{v}')" for k, v in R.BUILT_IN_CODES.items())

ORACLE_SQL = {
    "layered_mapping": f"""WITH b(key, value) AS (VALUES {_MAP}), p AS (SELECT 'P' || lpad(p_partkey::VARCHAR, 9, '0') AS key, p_brand AS value FROM part)
        SELECT key, value FROM p UNION ALL SELECT key, value FROM b WHERE key NOT IN (SELECT key FROM p)""",
    "first_variant": f"""
        WITH b(key, value) AS (VALUES {_MAP}), c AS (SELECT 'P' || lpad(range::VARCHAR, 4, '0') AS code, range AS n FROM range(1, 1000)),
        e AS (SELECT code, [code, value, substring(code, 2), CASE WHEN n < 1000 THEN n::VARCHAR END] AS every FROM c LEFT JOIN b ON key = code),
        f AS (SELECT code, list_filter(every, lambda x, i: x IS NOT NULL AND list_position(every, x) = i) AS vs FROM e),
        x AS (SELECT code, unnest(vs) AS variant, unnest(range(len(vs))) AS i FROM f),
        h AS (SELECT code, variant, i::INTEGER AS variant_no, p_name, min(i) OVER (PARTITION BY code) AS first_i FROM x JOIN part ON p_partkey::VARCHAR = variant)
        SELECT code, variant, variant_no, p_name FROM h WHERE variant_no = first_i""",
    "distinct_scan": "SELECT DISTINCT p_brand FROM part WHERE p_brand <> '' AND p_brand LIKE 'Brand%'",
    "offset_page": "SELECT c_custkey, c_name FROM customer ORDER BY c_custkey LIMIT 25 OFFSET 50",
    "first_per_key": "SELECT o_custkey, o_orderkey, o_orderdate FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS n FROM orders) WHERE n = 1",
    "latest_per_key": "SELECT user_id, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1",
    "search_like": "SELECT DISTINCT p_partkey, p_name, p_type FROM part WHERE p_name ILIKE '%economy%' OR p_type ILIKE '%economy%'",
    "bridge_codes": "SELECT l_suppkey, string_agg(DISTINCT p_brand, ',' ORDER BY p_brand) AS codes, count(DISTINCT p_brand) AS n_codes FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY l_suppkey",
    "upsert_conditional": """
        WITH b AS (SELECT *, (o_orderkey % 10) / 10.0::DOUBLE AS confidence, CASE o_orderstatus WHEN 'F' THEN 'success' WHEN 'P' THEN 'partial' END AS outcome, CASE WHEN o_orderkey % 3 > 0 THEN o_orderpriority END AS summary, strftime(o_orderdate, '%Y-%m-%d') AS created_at FROM orders),
        c AS (SELECT * FROM (SELECT *, o_custkey AS k, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM b) WHERE n = 1),
        s AS (SELECT * FROM (SELECT *, o_custkey + 20 AS k, row_number() OVER (PARTITION BY o_custkey ORDER BY confidence DESC NULLS LAST, o_orderkey DESC) AS n FROM b WHERE o_orderkey % 4 = 0) WHERE n = 1),
        j AS (SELECT coalesce(c.k, s.k) AS k, c.k IS NOT NULL AS had, s.k IS NOT NULL AND (c.k IS NULL OR s.confidence > c.confidence OR coalesce(s.outcome = 'success' AND c.outcome IS DISTINCT FROM 'success', false) OR (c.summary IS NULL AND s.summary IS NOT NULL)) AS take,
            c.confidence AS cc, s.confidence AS sc, c.outcome AS co, s.outcome AS so, c.summary AS cs, s.summary AS su, c.created_at AS ca, s.created_at AS sa FROM c FULL JOIN s ON c.k = s.k)
        SELECT k AS source_url, CASE WHEN take THEN sc ELSE cc END AS confidence, CASE WHEN take THEN so ELSE co END AS outcome, CASE WHEN take THEN su ELSE cs END AS summary,
            CASE WHEN had THEN 'old' ELSE 'new' END AS source_type, CASE WHEN had THEN ca ELSE sa END AS created_at, CASE WHEN NOT had THEN 'inserted' WHEN take THEN 'updated' ELSE 'kept' END AS action FROM j""",
    "patch_sessions": "SELECT user_id, round(arg_max(value, (ts, event_id)) FILTER (WHERE event_type = 'click' AND value IS NOT NULL), 6) AS clicked, arg_max(event_type, (ts, event_id)) FILTER (WHERE event_id % 3 = 0) AS last_type FROM events GROUP BY user_id",
    "attempt_counts": "SELECT user_id, arg_max(event_type, (ts, event_id)) AS status, count(*) AS attempts FROM events GROUP BY user_id",
    "missing_keys": "SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus IN ('F', 'P'))",
    "anti_resume": "SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
    "semi_scope": "SELECT doc_id, source FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)",
    "feedback_stats": f"""WITH {_E} SELECT count(*) AS n, count(rating) AS n_rated, round(avg(rating), 6) AS avg_rating, count(DISTINCT entity) AS n_entities, count(*) FILTER (WHERE outcome = 'success') AS n_success,
        count(*) FILTER (WHERE outcome = 'failure') AS n_failure, count(*) FILTER (WHERE outcome = 'partial') AS n_partial, round(count(rating)::DOUBLE / count(*), 6) AS coverage FROM e""",
    "entity_ratings": _RATINGS,
    "low_rated": f"SELECT entity, avg_rating FROM ({_RATINGS}) WHERE avg_rating < 3",
    "trends_day": _trend_sql("day"),
    "trends_week": _trend_sql("week"),
    "trends_month": _trend_sql("month"),
    "json_props": "SELECT event_id, (props ->> '$.k')::INTEGER AS k FROM events",
    "since_filter": "SELECT event_type, count(*) AS n FROM events WHERE ts >= TIMESTAMP '2024-01-20' GROUP BY event_type",
    "session_rounds": """WITH a AS (SELECT conv_id, count(*) FILTER (WHERE role = 'assistant') AS n_questions, count(*) FILTER (WHERE role = 'user') AS n_answers FROM conversations GROUP BY conv_id)
        SELECT *, CASE WHEN n_answers > 0 THEN greatest(1, n_answers // 3) ELSE 0 END::BIGINT AS rounds FROM a""",
    "ttl_expired": "SELECT user_id FROM events GROUP BY user_id HAVING max(ts) + INTERVAL 24 HOURS < TIMESTAMP '2024-01-31'",
    "tier_limits": """
        SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN '3/day' WHEN c_custkey % 5 = 1 THEN '1000/minute' WHEN c_custkey % 5 = 2 OR c_custkey % 2 = 1 THEN '0/minute' WHEN c_nationkey <= 3 THEN '1/day'
            ELSE c_nationkey || '/minute,' || CASE WHEN c_nationkey % 2 = 0 THEN '100/hour,' ELSE '' END || '1000/day' END AS "limit" FROM customer""",
    "sliding_counts": "SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 1 HOUR PRECEDING AND CURRENT ROW) AS n FROM events",
    "graph_edges": f"WITH {_G} SELECT src, dst, relationship, round(weight, 6) AS weight FROM (SELECT * FROM w UNION ALL SELECT * FROM r UNION ALL SELECT * FROM o)",
    "graph_type_counts": "SELECT 'region' AS node_type, count(*) AS n FROM region UNION ALL SELECT 'nation', count(*) FROM nation UNION ALL SELECT 'customer', count(*) FROM customer UNION ALL SELECT 'order', count(*) FROM orders",
    "graph_neighbors": f"WITH {_G} SELECT src, dst, 'customer' AS node_type, trim(c_name) AS label FROM w JOIN customer ON dst = 'customer:' || c_custkey",
    "graph_paths": f"""WITH {_G}, p AS (SELECT r.src, o.dst, r.weight + w.weight + o.weight AS cost FROM r JOIN w ON r.dst = w.src JOIN o ON w.dst = o.src)
        SELECT src, dst, round(min(cost), 6) AS cost, 3 AS n, round(min(cost) / 3, 6) AS score FROM p GROUP BY src, dst""",
    "popularity_top3": """WITH t AS (SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY 1 ORDER BY n DESC, l_partkey LIMIT 20),
        r AS (SELECT l_partkey, n, row_number() OVER (PARTITION BY l_partkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber)::INTEGER AS rank, l_orderkey, l_linenumber
              FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey, l_orderkey, l_linenumber ORDER BY l_suppkey) AS d FROM lineitem) JOIN t USING (l_partkey) WHERE d = 1) SELECT * FROM r WHERE rank <= 3""",
    "group_concat_distinct": "SELECT upper(p_brand) AS brand, string_agg(DISTINCT p_type, ',' ORDER BY p_type) AS types FROM part GROUP BY 1",
    "stratified_sample": """
        WITH d AS (SELECT * FROM documents JOIN labels USING (doc_id)),
        u AS (SELECT * FROM (SELECT doc_id, 'toxic' AS stratum, 0 AS i FROM d WHERE toxic = 1 ORDER BY doc_id LIMIT 10) UNION ALL SELECT * FROM (SELECT doc_id, 'poor', 1 FROM d WHERE quality = 0 ORDER BY doc_id LIMIT 10)
            UNION ALL SELECT * FROM (SELECT doc_id, 'french', 2 FROM d WHERE lang = 'fr' ORDER BY doc_id LIMIT 10) UNION ALL SELECT * FROM (SELECT doc_id, 'long', 3 FROM d WHERE n_chars > 5000 ORDER BY doc_id LIMIT 5))
        SELECT doc_id, arg_min(stratum, i) AS stratum FROM u GROUP BY doc_id""",
    "seeded_sample": "SELECT doc_id FROM documents ORDER BY sha256('7:' || doc_id), doc_id LIMIT 50",
    "quality_order": f"WITH {_E} SELECT event_id, CASE WHEN event_id % 5 > 0 THEN rating END AS rating FROM e ORDER BY rating DESC NULLS FIRST, event_id LIMIT 3000",
    "match_buckets": """SELECT CASE WHEN s >= 0.75 THEN 'high' WHEN s >= 0.6 THEN 'medium' ELSE 'low' END AS bucket, count(*) AS n, round(avg(s), 6) AS mean_score FROM (SELECT (event_id % 100) / 100.0::DOUBLE AS s FROM events) GROUP BY 1""",
    "test_composition": "SELECT lang, source, count(*) AS n, round(100 * avg((n_chars > 500)::INTEGER), 6) AS long_pct FROM documents GROUP BY ALL",
    "sensor_features": """SELECT event_id, round(greatest(0, least(1, coalesce(value * 10, 0) / 8000)) + 1e-9, 5) AS rpm, round(greatest(0, least(1, (coalesce(value, 0) + 40) / 190)) + 1e-9, 5) AS temp,
        round(-value / greatest(abs(value), 1) + 1e-9, 5) AS extra, 16 AS dims FROM events""",
    "cosine_schedule": "SELECT event_id, event_id % 1100 AS step, round(CASE WHEN event_id % 1100 < 100 THEN (event_id % 1100) / 100.0::DOUBLE ELSE greatest(0, 0.5 * (1 + cos(pi() * (event_id % 1100 - 100) / 1000.0::DOUBLE))) END, 6) AS rate FROM events",
    "sliding_limit_exact": """
        WITH e AS (SELECT user_id, list({'held': [ts], 'taken': [true]} ORDER BY ts, event_id) AS xs, list(event_id ORDER BY ts, event_id) AS ids, list(ts ORDER BY ts, event_id) AS tss FROM events GROUP BY user_id),
        d AS (SELECT user_id, ids, tss, list_reduce(xs, lambda a, x: CASE WHEN len(list_filter(a.held, lambda t: x.held[1] - t < INTERVAL 1 HOUR)) < 3
            THEN {'held': list_append(list_filter(a.held, lambda t: x.held[1] - t < INTERVAL 1 HOUR), x.held[1]), 'taken': list_append(a.taken, true)}
            ELSE {'held': list_filter(a.held, lambda t: x.held[1] - t < INTERVAL 1 HOUR), 'taken': list_append(a.taken, false)} END).taken AS taken FROM e)
        SELECT unnest(ids) AS event_id, user_id, unnest(tss) AS ts, unnest(taken) AS accepted FROM d""",
    "stream_tumbling": "SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL",
    "stream_session": """
        WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTES THEN 0 ELSE 1 END AS starts FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
        s AS (SELECT user_id, ts, sum(starts) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
        SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 30 MINUTES AS session_end, count(*) AS n FROM s GROUP BY user_id, k""",
    "stream_dedup": "SELECT DISTINCT user_id, event_type FROM events",
    "start_urls": "SELECT r_name AS site, p_partkey AS code FROM region, part WHERE NOT (r_name = 'ASIA' AND p_partkey % 2 = 0)",
    "disjoint_negatives": """WITH p AS (SELECT a.p_partkey AS anchor, b.p_partkey, row_number() OVER (PARTITION BY a.p_partkey ORDER BY b.p_partkey)::INTEGER AS n FROM part a JOIN part b USING (p_size)
        WHERE a.p_partkey % 100 = 0 AND a.p_partkey <> b.p_partkey AND a.p_brand <> b.p_brand AND a.p_type <> b.p_type AND a.p_brand <> b.p_type AND a.p_type <> b.p_brand) SELECT * FROM p WHERE n <= 5""",
}
