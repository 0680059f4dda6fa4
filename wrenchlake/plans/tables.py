"""Driver tables in the roles of the diagnostic model."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vector index."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"), "label")


def queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stated query set: every hundredth vector, against all rows."""
    return table(spark, sf_dir, "embeddings").where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vec"), "label")


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as feedback: rating 1 to 5 from the value, outcome from the type, the user as the rated entity."""
    e = table(spark, sf_dir, "events")
    rating = F.when(F.col("value").isNotNull(), (F.pmod(F.floor(F.abs("value")), F.lit(5)) + 1).cast("int"))
    outcome = F.element_at(F.array(F.lit("success"), F.lit("failure"), F.lit("partial"), F.lit("")), (F.col("event_id") % 4 + 1).cast("int"))
    return e.select("event_id", "ts", F.col("user_id").alias("entity"), rating.alias("rating"), F.when(outcome != "", outcome).alias("outcome"), "event_type")


#: The same rows in SQL.
ENTRIES_SQL = """
    SELECT event_id, ts, user_id AS entity, (floor(abs(value))::BIGINT % 5 + 1)::INTEGER AS rating, event_type,
           CASE event_id % 4 WHEN 0 THEN 'success' WHEN 1 THEN 'failure' WHEN 2 THEN 'partial' END AS outcome
    FROM events"""

#: Unit similarities of the query set with all items, in SQL.
SIM_SQL = """
    SELECT q.vec_id AS query_id, q.label AS own_label, e.vec_id AS id, e.label, list_cosine_similarity(q.embedding::DOUBLE[], e.embedding::DOUBLE[]) AS score
    FROM embeddings q, embeddings e WHERE q.vec_id % 100 = 0"""
