"""The subpackage's registered queries: one per operator, over whole tables, and the pipeline."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wrenchlake.llm import byte_bpe, hamming, imatch, importance, langid, linededup, mixing, negatives, quality, sentencepiece_bpe, sharding, simhash, warc

TOKENIZER = "piece_bpe_32k.model"
RANKS = "byte_bpe_50k.tiktoken"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = warc.round_trip(spark, table(spark, sf_dir, "pages"))
    return records.select("page_id", "payload_bytes", "payload_digest", F.col("warc_type").alias("record_type"), F.col("refers_to_page").alias("refers_to"), "intact")


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash.near_groups(table(spark, sf_dir, "documents"))
    return groups.select("doc_id", F.lower(F.lpad(F.hex("code"), 16, "0")).alias("fingerprint"), "component_id")


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.dedup_lines(table(spark, sf_dir, "documents")).select("doc_id", "text", "n_lines", "n_dropped")


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.reshard(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "old_shard")


def op6_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), hamming.sign_code("embedding").alias("code"))
    queries = codes.where("id % 100 = 0").select(F.col("id").alias("query_id"), F.col("code").alias("query_code"))
    found = hamming.topk_search(codes, queries, k=10)
    return found.select("query_id", F.col("id").alias("vec_id"), "distance", "rank")


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_bpe.encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source")


def op9_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return imatch.compare_edited(table(spark, sf_dir, "documents"))


def op10_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    shifted = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), shifted.cast("long").alias("label"), negatives.scaled("embedding").alias("code"))
    return negatives.mine(rows, F.col("id") % 100 == 0)


def op12_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path(RANKS), public_tokenizers.PATTERN)


QUERIES = {f.__name__: f for f in (op1_warc, op2_quality, op3_simhash, op4_line_dedup, op5_sharding, op6_topk, op7_sentencepiece, op8_mixing, op9_imatch, op10_langid, op11_hard_negatives, op12_importance, op13_byte_bpe)}

_CODE = "list_sum([CASE WHEN embedding[i + 1] > 0 THEN (1::UBIGINT << i)::HUGEINT ELSE 0 END FOR i IN range(64)])::UBIGINT"

#: CRC-32 of each value of one byte, by its rule.
_TABLE = [0] * 256
for _i in range(256):
    _c = _i
    for _ in range(8):
        _c = _c >> 1 ^ (0xEDB88320 if _c & 1 else 0)
    _TABLE[_i] = _c

ORACLE_SQL = {
    "op1_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
        d AS (SELECT page_id, strlen(html)::BIGINT AS payload_bytes, sha256(html) AS payload_digest,
                     row_number() OVER (PARTITION BY page_id, html) AS nth FROM p),
        f AS (SELECT payload_digest, min(page_id) AS first_id FROM d WHERE payload_bytes >= 100 GROUP BY payload_digest)
        SELECT d.page_id, payload_bytes, payload_digest,
               CASE WHEN f.first_id < d.page_id OR f.first_id = d.page_id AND nth > 1 THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN f.first_id < d.page_id OR f.first_id = d.page_id AND nth > 1 THEN f.first_id END AS refers_to, true AS intact
        FROM d LEFT JOIN f USING (payload_digest)""",
    "op6_topk": f"""
        WITH c AS (SELECT vec_id, {_CODE} AS code FROM embeddings WHERE embedding IS NOT NULL),
        m AS (SELECT q.vec_id AS query_id, c.vec_id, bit_count(xor(q.code, c.code))::INTEGER AS distance
              FROM c AS q, c WHERE q.vec_id % 100 = 0),
        r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id)::INTEGER AS rank FROM m)
        SELECT query_id, vec_id, distance, rank FROM r WHERE rank <= 10""",
    "op11_hard_negatives": """
        WITH r AS (
          SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, [floor(256 * x::DOUBLE) FOR x IN embedding] AS v
          FROM embeddings
          WHERE label IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
        s AS (SELECT a.id AS anchor_id, r.id, a.label = r.label AS same, list_dot_product(a.v, r.v)::BIGINT AS score
              FROM r AS a, r WHERE a.id % 100 = 0 AND a.id <> r.id),
        p AS (SELECT anchor_id, id, score FROM s WHERE same
              QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5),
        n AS (SELECT p.anchor_id, p.id AS positive_id, p.score AS positive_score, s.id AS negative_id, s.score AS negative_score,
                     row_number() OVER (PARTITION BY p.anchor_id, p.id ORDER BY s.score DESC, s.id)::INTEGER AS rank
              FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 80 * p.score <= 100 * s.score AND 100 * s.score <= 100 * p.score)
        SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5""",
    "op12_importance": f"""
        WITH texts AS (
          SELECT 0 AS side, doc_id, row_number() OVER () AS row, text FROM documents
          UNION ALL SELECT 1, NULL, row_number() OVER (), text FROM benchmark),
        placed AS (SELECT side, row, unnest(words) AS w, generate_subscripts(words, 1) AS place FROM (
          SELECT side, row, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS words FROM texts)),
        runs AS (SELECT side, row, w, lag(w, 1) OVER o AS w1, lag(w, 2) OVER o AS w2 FROM placed WINDOW o AS (PARTITION BY side, row ORDER BY place)),
        features AS (SELECT side, row, w AS f FROM runs UNION ALL SELECT side, row, w1 || ' ' || w FROM runs WHERE w1 IS NOT NULL
          UNION ALL SELECT side, row, w2 || ' ' || w1 || ' ' || w FROM runs WHERE w2 IS NOT NULL),
        grouped AS (SELECT side, row, f, count(*) AS n FROM features GROUP BY ALL),
        hexed AS (SELECT f, hex(encode(f)) AS h FROM (SELECT DISTINCT f FROM grouped)),
        crcs AS (SELECT f, xor(list_reduce([('0x' || substr(h, 2 * i + 1, 2))::BIGINT FOR i IN range(length(h) // 2)],
           lambda c, b: xor(c >> 8, {_TABLE}[(xor(c, b) & 255) + 1]), 4294967295), 4294967295) % 10000 AS bucket FROM hexed),
        counted AS (SELECT side, row, bucket, sum(n) AS n FROM grouped JOIN crcs USING (f) GROUP BY ALL),
        sums AS (SELECT bucket, coalesce(sum(n) FILTER (side = 0), 0) AS s, coalesce(sum(n) FILTER (side = 1), 0) AS t FROM counted GROUP BY bucket),
        gains AS (SELECT bucket, floor(1000 * ln((t + 1)::DOUBLE * (sum(s) OVER () + 10000)::DOUBLE / ((s + 1)::DOUBLE * (sum(t) OVER () + 10000)::DOUBLE)))::BIGINT AS gain FROM sums),
        weights AS (SELECT row, sum(n)::BIGINT AS n_features, sum(n * gain)::BIGINT AS weight FROM counted JOIN gains USING (bucket) WHERE side = 0 GROUP BY row),
        scored AS (SELECT doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
          coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('42:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score
          FROM (SELECT doc_id, row FROM texts WHERE side = 0) LEFT JOIN weights USING (row)),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY n_features >= 57 ORDER BY score DESC, doc_id) AS place, count(*) OVER (PARTITION BY n_features >= 57) AS fit FROM scored)
        SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 57 AND place <= 5 * fit // 100 THEN place END AS rank FROM ranked""",
}
