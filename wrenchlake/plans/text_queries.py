"""Queries over documents and pages: extraction, cleaning, chunking, scoring, dedup."""

from __future__ import annotations

from pyspark.sql import functions as F

from wrenchlake.functions import text as T
from wrenchlake.operators import relational as R
from wrenchlake.plans.tables import table
from wrenchlake.sources import records as S


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _any(words: list[str], low: str = "low") -> str:
    return "(" + " OR ".join(f"contains({low}, {_q(w)})" for w in words) + ")"


def _case(pairs: list[tuple[str, list[str]]], other: str) -> str:
    return "CASE " + " ".join(f"WHEN {_any(words)} THEN {_q(name)}" for name, words in pairs) + f" ELSE {_q(other)} END"


def extract_codes(spark, d):
    docs = table(spark, d, "documents")
    return docs.select("doc_id", F.array_join(T.extract_codes(F.col("text")), ",").alias("codes"), F.size(T.extract_codes(F.col("text"))).alias("n_codes"))


def classify_outcome(spark, d):
    return table(spark, d, "documents").select("doc_id", T.classify_outcome(F.col("text")).alias("outcome"))


def extract_sensors(spark, d):
    s = T.extract_sensors(F.col("text"))
    return table(spark, d, "documents").select("doc_id", *[s[k].alias(k) for k in ("engine_rpm", "coolant_temp", "throttle_position", "maf_sensor")])


def extract_vehicle(spark, d):
    return table(spark, d, "documents").select("doc_id", T.extract_vehicle(F.col("text")).alias("v")).select("doc_id", "v.*")


def repair_summary(spark, d):
    s = T.repair_summary(F.col("text"))
    return table(spark, d, "documents").select("doc_id", F.length(s).alias("n"), F.sha2(s, 256).alias("digest"))


def substantial_solution(spark, d):
    return table(spark, d, "documents").select("doc_id", T.substantial(F.col("text")).alias("substantial"))


def validation_gate(spark, d):
    """Record type, heuristic score and the reason of a rejected record."""
    docs = table(spark, d, "documents")
    r = docs.select("doc_id", "text", T.extract_codes(F.col("text")).alias("codes"), T.classify_outcome(F.col("text")).alias("outcome"), F.col("text").alias("summary"), F.col("text").alias("symptoms"))
    kind = F.when(F.size("codes") > 0, "fault_code").when(T.substantial(F.col("summary")) & F.col("outcome").isin("success", "partial"), "cause_to_solution")
    r = r.withColumn("record_type", kind)
    none = F.from_json(F.lit("{}"), "make string, model string, year int")
    score = T.quality_score(F.col("codes"), F.col("symptoms"), none, F.col("summary"), F.create_map().cast("map<string,double>"), F.col("outcome"), F.coalesce(F.col("record_type") == "cause_to_solution", F.lit(False)))
    least = F.when(F.col("record_type") == "cause_to_solution", 0.5).otherwise(0.6)
    out = r.withColumn("score", F.round(score, 6))
    return out.select("doc_id", "record_type", "score", F.when(F.col("record_type").isNull(), "no_signal").when(F.col("score") < least, "low_score").alias("drop_reason"))


def chunk_documents(spark, d):
    out = table(spark, d, "documents").select("doc_id", F.posexplode(T.chunks(F.col("text"))).alias("chunk_no", "chunk"))
    return out.select("doc_id", "chunk_no", F.length("chunk").alias("n"), F.sha2("chunk", 256).alias("digest"))


def doc_assembly(spark, d):
    """Text to encode and its id per chunk."""
    docs = table(spark, d, "documents").withColumn("parts", T.chunks(F.col("text")))
    x = docs.select("doc_id", "source", F.size("parts").alias("n_parts"), F.posexplode("parts").alias("i", "chunk"))
    chunk_id = F.when(F.col("n_parts") > 1, F.concat_ws("_chunk_", F.col("doc_id").cast("string"), F.col("i").cast("string"))).otherwise(F.col("doc_id").cast("string"))
    return x.select("doc_id", chunk_id.alias("chunk_id"), F.sha2(F.concat(F.lit("Fault codes: "), "source", F.lit("\n\n"), "chunk"), 256).alias("digest"))


def strip_html(spark, d):
    t = T.strip_markup(F.col("html"))
    return table(spark, d, "pages").select("page_id", F.length(t).alias("n"), F.sha2(t, 256).alias("digest"))


def clean_response(spark, d):
    t = T.clean_response(F.col("html"))
    return table(spark, d, "pages").select("page_id", F.length(t).alias("n"), F.sha2(t, 256).alias("digest"))


def page_text(spark, d):
    t = S.page_text(F.col("html"), 100)
    return table(spark, d, "pages").select("page_id", F.length(t).alias("n"), F.sha2(t, 256).alias("digest"))


def page_links(spark, d):
    return S.page_links(table(spark, d, "pages"))


def problem_solution(spark, d):
    return table(spark, d, "documents").select("doc_id", T.problem_solution(F.col("text")).alias("sections"))


def steps_extract(spark, d):
    s = T.repair_steps(F.col("text"))
    return table(spark, d, "documents").select("doc_id", F.size(s).alias("n_steps"), F.sha2(F.array_join(s, "\n"), 256).alias("digest"))


def title_truncate(spark, d):
    return table(spark, d, "documents").select("doc_id", T.truncate_title(F.col("text")).alias("title"))


def text_preview(spark, d):
    return table(spark, d, "documents").select("doc_id", F.sha2(T.preview(F.col("text")), 256).alias("digest"))


def categorize(spark, d):
    return table(spark, d, "part").select("p_partkey", T.categorize(F.concat_ws(" ", "p_name", "p_type")).alias("category"))


def keyword_df(spark, d):
    words = table(spark, d, "documents").select("doc_id", F.explode(T.keywords(F.col("text"))).alias("word"))
    return words.groupBy("word").agg(F.count("*").alias("n_docs"))


def url_normalize(spark, d):
    return table(spark, d, "pages").select("page_id", T.normalize_url(F.col("url")).alias("url_key"), F.expr("try_parse_url(url, 'HOST')").alias("host"))


def rate_limited_pages(spark, d):
    return table(spark, d, "pages").select("page_id", T.rate_limited(F.col("html")).alias("limited"))


def dedup_signature(spark, d):
    """F8: the first record of each signature of codes and the lower-cased start of the text."""
    docs = table(spark, d, "documents").withColumn("signature", F.concat_ws("|", F.array_join(T.extract_codes(F.col("text")), ","), F.substring(F.lower("text"), 1, 50)))
    best = docs.groupBy("signature").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n"))
    return best.select("doc_id", "n")


def dedup_hash(spark, d):
    """H6: the first document of each content hash."""
    return table(spark, d, "documents").groupBy(F.sha2("text", 256).alias("digest")).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n"))


def placeholder_titles(spark, d):
    p = table(spark, d, "part")
    return p.select("p_partkey", T.placeholder_title(F.when(F.col("p_partkey") % 3 == 0, "-").when(F.col("p_partkey") % 3 == 1, " ").otherwise(F.col("p_name")), F.col("p_type")).alias("title"))


def code_variants(spark, d):
    """Variants of codes made from part keys through the built-in mapping."""
    p = table(spark, d, "part").select("p_partkey", F.concat(F.lit("P"), F.lpad((F.col("p_partkey") % 1000).cast("string"), 4, "0")).alias("code"))
    return R.expand_codes(p, R.built_in_map(spark))


def query_text(spark, d):
    docs = table(spark, d, "documents")
    return docs.select("doc_id", T.query_text(F.when(F.col("doc_id") % 2 == 0, F.array("source", "lang")), F.col("text")).alias("query_text"))


QUERIES = {f.__name__: f for f in (
    extract_codes, classify_outcome, extract_sensors, extract_vehicle, repair_summary, substantial_solution, validation_gate, chunk_documents, doc_assembly, strip_html, clean_response, page_text, page_links,
    problem_solution, steps_extract, title_truncate, text_preview, categorize, keyword_df, url_normalize, rate_limited_pages, dedup_signature, dedup_hash, placeholder_titles, code_variants, query_text,
)}

_SUBSTANTIAL = f"""CASE WHEN length(s) < 50 THEN false WHEN {_any(T.ACTION_WORDS)} THEN true WHEN {_any(T.VAGUE_PHRASES)} AND length(s) < 80 THEN false
    WHEN length(s) >= 80 AND {_any(T.PART_WORDS)} THEN true ELSE length(s) >= 100 END"""
_CODES = r"""list_sort(list_distinct(list_concat(list_concat(
    list_transform(regexp_extract_all(text, '\b[Pp][0-9][0-9][0-9][0-9]\b'), lambda x: upper(x)),
    regexp_extract_all(text, '\b[A-Z][0-9][A-Z][0-9][0-9]\b')), regexp_extract_all(text, '\b[A-Z][0-9][0-9][0-9][0-9]\b'))))"""
_CHUNKS = """CASE WHEN length(text) <= 1200 THEN [text] ELSE list_transform(range(0, length(text), 1000), lambda s: substring(text, (s + 1)::BIGINT, 1200)) END"""


def _strip(col: str, rules: list[tuple[str, str]]) -> str:
    out = col
    for pattern, to in rules:
        out = f"regexp_replace({out}, {_q(pattern)}, {_q(to)}, 'g')"
    return rf"trim(regexp_replace({out}, '[\s\x0B\x{{0085}}\x{{00A0}}\x{{1680}}\x{{2000}}-\x{{200A}}\x{{2028}}\x{{2029}}\x{{202F}}\x{{205F}}\x{{3000}}]+', ' ', 'g'))"


def _found(pattern: str, groups: int, col: str = "text") -> str:
    """The first group of the first match that isn't empty, without commas."""
    parts = ", ".join(f"nullif(regexp_extract({col}, {_q(pattern)}, {g}), '')" for g in range(1, groups + 1))
    return f"replace(coalesce({parts}), ',', '')"


def _word(pattern: str) -> str:
    """A pattern between characters that are no letters or digits, as group 2."""
    return _q(r"(^|[^\pL\pN_])" + pattern + r"($|[^\pL\pN_])")


_PREVIEW = _strip("text", T.PREVIEW_STRIP)
_SENSORS = {k: T.SENSOR_PATTERNS[k] for k in ("engine_rpm", "coolant_temp", "throttle_position", "maf_sensor")}

ORACLE_SQL = {
    "extract_sensors": "SELECT doc_id, " + ", ".join(f"try_cast({_found(p, 2)} AS DOUBLE) AS {k}" for k, p in _SENSORS.items()) + " FROM documents",
    "extract_vehicle": f"""
        WITH v AS (SELECT doc_id, nullif(regexp_extract(text, {_word('(' + '|'.join(T.VEHICLE_MAKES) + ')').replace("'(^", "'(?i)(^")}, 2), '') AS m, try_cast(regexp_extract(text, {_word('(19[89][0-9]|20[0-2][0-9])')}, 2) AS INTEGER) AS year,
            upper(nullif(regexp_extract(text, {_word('(N54|N55|B58|B48|S55|S58|M54|M52|2JZ|1JZ|LS[0-9]|VQ[0-9]{2})').replace("'(^", "'(?i)(^")}, 2), '')) AS engine, try_cast({_found(T.MILEAGE_PATTERN, 2)} AS INTEGER) AS mileage FROM documents)
        SELECT doc_id, upper(m[1]) || lower(m[2:]) AS make, year, engine, mileage FROM v""",
    "repair_summary": f"""
        WITH t AS (SELECT doc_id, trim(text) AS t FROM documents), c AS (SELECT doc_id, t, coalesce({", ".join(f"nullif(regexp_extract(t, {_q(p)}, 0), '')" for p in T.SUMMARY_PATTERNS)}) AS section, regexp_split_to_array(t, '[.!?]\\s+') AS parts FROM t),
        p AS (SELECT doc_id, unnest(parts) AS s, generate_subscripts(parts, 1) AS n FROM c), l AS (SELECT *, sum(length(s) + 1) OVER (PARTITION BY doc_id ORDER BY n) AS upto FROM p),
        k AS (SELECT doc_id, string_agg(trim(s), '. ' ORDER BY n) || '.' AS kept FROM l WHERE upto <= 500 GROUP BY doc_id),
        r AS (SELECT doc_id, CASE WHEN length(t) <= 500 THEN t WHEN section IS NOT NULL THEN substring(trim(section), 1, 500) ELSE coalesce(kept, '') END AS r FROM c LEFT JOIN k USING (doc_id))
        SELECT doc_id, length(r)::INTEGER AS n, sha256(r) AS digest FROM r""",
    "steps_extract": r"""
        WITH f AS (SELECT doc_id, list_transform(regexp_extract_all(text, '(?m)(?:^|\n)\s*[0-9]+[.)]\s*(.+)$', 1), lambda x: trim(x)) AS a, list_transform(regexp_extract_all(text, '(?m)(?:^|\n)\s*[-•*]\s*(.+)$', 1), lambda x: trim(x)) AS b,
            list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: length(x) > 20)[1:10] AS c FROM documents),
        s AS (SELECT doc_id, CASE WHEN len(a) > 0 THEN a WHEN len(b) > 0 THEN b ELSE c END AS s FROM f)
        SELECT doc_id, len(s)::INTEGER AS n_steps, sha256(array_to_string(s, chr(10))) AS digest FROM s""",
    "title_truncate": """
        WITH i AS (SELECT doc_id, unnest(string_split(text, ',')) AS x, generate_subscripts(string_split(text, ','), 1) AS n FROM documents), l AS (SELECT doc_id, trim(x) AS x, n, sum(length(trim(x)) + 2) OVER (PARTITION BY doc_id ORDER BY n) AS upto FROM i),
        k AS (SELECT doc_id, coalesce(string_agg(x, ', ' ORDER BY n) FILTER (WHERE upto <= 180), '') AS head, count(*) FILTER (WHERE upto > 180) AS more FROM l GROUP BY doc_id),
        d AS (SELECT doc_id, text, substring(text, 1, 200) AS cut, position(' ' IN reverse(substring(text, 1, 200))) AS gap FROM documents)
        SELECT doc_id, CASE WHEN text IS NULL THEN '' WHEN length(text) <= 200 THEN text WHEN contains(text, ',') THEN CASE WHEN more > 0 THEN head || ' (+' || more || ' more)' ELSE head END
            WHEN gap > 0 AND length(cut) - gap > 160 THEN substring(cut, 1, length(cut) - gap) || '...' ELSE cut || '...' END AS title FROM d LEFT JOIN k USING (doc_id)""",
    "text_preview": f"""
        WITH c AS (SELECT doc_id, {_PREVIEW} AS c FROM documents),
        p AS (SELECT doc_id, c, greatest(coalesce({", ".join(f"CASE WHEN position({_q(k)} IN c) BETWEEN 1 AND 500 THEN position({_q(k)} IN c) END" for k in T.PREVIEW_KEYWORDS)}, 0) - 51, 0) AS s FROM c)
        SELECT doc_id, sha256(substring(c, s + 1, 500) || CASE WHEN length(c) > s + 500 THEN '...' ELSE '' END) AS digest FROM p""",
    "problem_solution": f"""
        WITH t AS (SELECT doc_id, {_strip('text', T.INDEX_STRIP)} AS t FROM documents),
        f AS (SELECT doc_id, t, list_transform(list_concat(regexp_extract_all(t, {_q(T.PROBLEM_PATTERN)}, 1), regexp_extract_all(t, {_q(T.SOLUTION_PATTERN)}, 1)), lambda x: trim(x)) AS l FROM t),
        u AS (SELECT doc_id, t, list_transform(list_filter(l, lambda x, i: list_position(l, x) = i), lambda x: substring(x, 1, 400))[1:5] AS five FROM f)
        SELECT doc_id, CASE WHEN length(t) >= 20 AND len(five) > 0 THEN ' Problem/Solution: ' || array_to_string(five, '; ') ELSE '' END AS sections FROM u""",
    "page_text": f"""
        WITH b AS (SELECT page_id, regexp_replace(html, '(?is)<script\\b.*?</script>|<style\\b.*?</style>|<!--.*?-->', ' ', 'g') AS body FROM pages), t AS (SELECT page_id, {_strip('body', [('<[^>]+>', ' '), ('&[a-zA-Z]+;', ' ')])} AS t FROM b)
        SELECT page_id, CASE WHEN length(t) >= 100 THEN length(t)::INTEGER END AS n, CASE WHEN length(t) >= 100 THEN sha256(t) END AS digest FROM t""",
    "page_links": f"""
        WITH a AS (SELECT page_id, regexp_extract_all(html, '<a href="([^"]*)">[^<]*</a>', 1) AS hs, regexp_extract_all(html, '<a href="[^"]*">([^<]*)</a>', 1) AS ls FROM pages),
        l AS (SELECT page_id, unnest(hs) AS href, {_strip("replace(replace(unnest(ls), '&quot;', chr(34)), '&amp;', '&')", [])} AS label, generate_subscripts(hs, 1)::INTEGER - 1 AS link_no FROM a)
        SELECT page_id, link_no, href, label FROM l WHERE label <> '' AND (length(label) > 80 OR NOT (regexp_matches(label, '^[0-9]+$') OR lower(label) IN ({", ".join(map(_q, T.NAV_WORDS))}) OR starts_with(lower(label), 'page ') OR ends_with(lower(label), ' page')))""",
    "extract_codes": f"SELECT doc_id, array_to_string({_CODES}, ',') AS codes, len({_CODES})::INTEGER AS n_codes FROM documents",
    "classify_outcome": f"SELECT doc_id, {_case(T.OUTCOME_WORDS, 'unknown')} AS outcome FROM (SELECT doc_id, lower(text) AS low FROM documents)",
    "substantial_solution": f"SELECT doc_id, {_SUBSTANTIAL} AS substantial FROM (SELECT doc_id, text AS s, lower(text) AS low FROM documents)",
    "validation_gate": f"""
        WITH r AS (SELECT doc_id, {_CODES} AS codes, {_case(T.OUTCOME_WORDS, 'unknown').replace('low', 'lower(text)')} AS outcome, text AS s, lower(text) AS low, text AS symptoms FROM documents),
        k AS (SELECT *, CASE WHEN len(codes) > 0 THEN 'fault_code' WHEN {_SUBSTANTIAL} AND outcome IN ('success', 'partial') THEN 'cause_to_solution' END AS record_type FROM r),
        q AS (SELECT doc_id, record_type, round(CASE WHEN len(codes) > 0 THEN 0.3 WHEN record_type = 'cause_to_solution' AND length(trim(symptoms)) >= 20 THEN 0.2 WHEN record_type = 'cause_to_solution' AND length(trim(symptoms)) > 0 THEN 0.1 ELSE 0 END::DOUBLE
            + CASE WHEN length(trim(s)) >= 50 THEN 0.3 WHEN length(trim(s)) > 0 THEN 0.15 ELSE 0 END::DOUBLE + CASE WHEN outcome IN ('success', 'failure', 'partial') THEN 0.05 ELSE 0 END::DOUBLE, 6) AS score FROM k)
        SELECT doc_id, record_type, score, CASE WHEN record_type IS NULL THEN 'no_signal' WHEN score < CASE WHEN record_type = 'cause_to_solution' THEN 0.5 ELSE 0.6 END THEN 'low_score' END AS drop_reason FROM q""",
    "chunk_documents": f"""WITH c AS (SELECT doc_id, {_CHUNKS} AS parts FROM documents), x AS (SELECT doc_id, unnest(parts) AS chunk, unnest(range(len(parts))) AS i FROM c)
        SELECT doc_id, i::INTEGER AS chunk_no, length(chunk)::INTEGER AS n, sha256(chunk) AS digest FROM x""",
    "doc_assembly": f"""WITH c AS (SELECT doc_id, source, {_CHUNKS} AS parts FROM documents), x AS (SELECT doc_id, source, len(parts) AS n, unnest(parts) AS chunk, unnest(range(len(parts))) AS i FROM c)
        SELECT doc_id, CASE WHEN n > 1 THEN doc_id || '_chunk_' || i ELSE doc_id::VARCHAR END AS chunk_id, sha256('Fault codes: ' || source || chr(10) || chr(10) || chunk) AS digest FROM x""",
    "strip_html": f"SELECT page_id, length({_strip('html', T.INDEX_STRIP)})::INTEGER AS n, sha256({_strip('html', T.INDEX_STRIP)}) AS digest FROM pages",
    "clean_response": f"SELECT page_id, length({_strip('html', T.RESPONSE_STRIP)})::INTEGER AS n, sha256({_strip('html', T.RESPONSE_STRIP)}) AS digest FROM pages",
    "categorize": f"SELECT p_partkey, {_case(T.CATEGORY_WORDS, 'other')} AS category FROM (SELECT p_partkey, lower(p_name || ' ' || p_type) AS low FROM part)",
    "keyword_df": f"""WITH w AS (SELECT doc_id, unnest(list_distinct(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{M}}\\p{{N}}_]+'))) AS word FROM documents)
        SELECT word, count(*) AS n_docs FROM w WHERE length(word) > 3 AND word NOT IN ({', '.join(map(_q, T.STOP_WORDS))}) GROUP BY word""",
    "rate_limited_pages": f"SELECT page_id, {_any(T.RATE_LIMIT_PHRASES)} AS limited FROM (SELECT page_id, lower(html) AS low FROM pages)",
    "dedup_signature": f"SELECT min(doc_id) AS doc_id, count(*) AS n FROM (SELECT doc_id, array_to_string({_CODES}, ',') || '|' || substring(lower(text), 1, 50) AS signature FROM documents) GROUP BY signature",
    "dedup_hash": "SELECT sha256(text) AS digest, min(doc_id) AS doc_id, count(*) AS n FROM documents GROUP BY 1",
    "placeholder_titles": "SELECT p_partkey, CASE WHEN p_partkey % 3 = 2 THEN trim(p_name) ELSE trim(p_type) END AS title FROM part",
    "query_text": """SELECT doc_id, concat_ws('. ', CASE WHEN doc_id % 2 = 0 THEN 'Fault codes: ' || source || ', ' || lang END,
        'Problem: ' || nullif(trim(text), '')) AS query_text FROM documents""",
    "url_normalize": r"""
        WITH u AS (SELECT page_id, url, trim(regexp_replace(split_part(url, '#', 1), '/+$', '')) AS u FROM pages)
        SELECT page_id, CASE WHEN (contains(u, 'showthread') OR contains(u, 'viewtopic')) AND regexp_matches(u, '(?i)[?&]t=(\d+)') THEN 'thread_t_' || regexp_extract(u, '(?i)[?&]t=(\d+)', 1)
            WHEN contains(u, 'threads/') AND regexp_matches(u, 'threads/[^/]+\.(\d+)(?:/|$)') THEN 'thread_t_' || regexp_extract(u, 'threads/[^/]+\.(\d+)(?:/|$)', 1) ELSE u END AS url_key,
            regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1) AS host FROM u""",
    "code_variants": None,
}
ORACLE_SQL["code_variants"] = f"""
    WITH m(key, value) AS (VALUES {', '.join(f"({_q(k)}, {_q(v)})" for k, v in R.BUILT_IN_CODES.items())}),
    p AS (SELECT p_partkey, 'P' || lpad((p_partkey % 1000)::VARCHAR, 4, '0') AS code FROM part),
    v AS (SELECT p_partkey, code, [code, value, substring(code, 2), CASE WHEN code[2] = '0' THEN coalesce(nullif(ltrim(substring(code, 2), '0'), ''), '0') END] AS every FROM p LEFT JOIN m ON key = code),
    f AS (SELECT p_partkey, code, list_filter(every, lambda x, i: x IS NOT NULL AND list_position(every, x) = i) AS vs FROM v),
    x AS (SELECT p_partkey, code, unnest(vs) AS variant, unnest(range(len(vs))) AS i FROM f)
    SELECT p_partkey, code, i::INTEGER AS variant_no, variant FROM x"""
