"""Record sources and sinks: JSON lines, CSV, GraphML-like tables, HTML pages, links and table rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wrenchlake.functions import text as T
from wrenchlake.sources import markup as M

RECORD = (
    "fault_codes array<string>, obd_data map<string,double>, vehicle_context struct<make:string,model:string,year:int,engine:string,mileage:int>, "
    "repair_summary string, repair_guide string, outcome string, source_url string, source_type string, record_type string, symptoms string, timestamp string"
)
NODES = "node_id string, node_type string, label string"
EDGES = "src string, dst string, relationship string, weight double"


def read_records(spark: SparkSession, glob: str, schema: str = RECORD) -> DataFrame:
    """JSON lines; lines that can't be parsed are dropped. Fields of another type than stated make the line malformed."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(glob)


def write_records(df: DataFrame, folder: str) -> None:
    """B1: appended by source type (missing: forum), without raw text, the guide filled by the summary."""
    out = df.drop("raw_text").withColumn("source_type", F.coalesce("source_type", F.lit("forum"))).withColumn("repair_guide", F.coalesce("repair_guide", "repair_summary"))
    out.write.mode("append").partitionBy("source_type").json(folder)


def read_titles(spark: SparkSession, path: str) -> DataFrame:
    """A CSV with header; titles of 3 to 200 characters; the last row of a title counts."""
    rows = spark.read.option("header", True).csv(path).withColumn("title", F.trim("title")).where(F.length("title").between(3, 200))
    rest = [c for c in rows.columns if c != "title"]
    return rows.withColumn("__at", F.monotonically_increasing_id()).groupBy("title").agg(F.max(F.struct("__at", *rest)).alias("r")).select("title", *[f"r.{c}" for c in rest])


def table_or_empty(spark: SparkSession, name: str, schema: str) -> DataFrame:
    """A catalog table, or no rows of its schema."""
    return spark.table(name) if spark.catalog.tableExists(name) else spark.createDataFrame([], schema)


def first_non_empty(*sources: DataFrame) -> DataFrame:
    """The first source that has rows, else the last."""
    return next((s for s in sources[:-1] if not s.isEmpty()), sources[-1])


def missing_columns(df: DataFrame, expected: set[str]) -> set[str]:
    """Expected columns that a table lacks."""
    return expected - set(df.columns)


def page_text(html: Column, least: int = 0) -> Column:
    """A page's text without scripts, styles and comments; null if shorter than ``least``."""
    body = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1>|<!--.*?-->", " ")
    out = T.squeeze(F.regexp_replace(F.regexp_replace(body, r"<[^>]+>", " "), r"&[a-zA-Z]+;", " "))
    return F.when(F.length(out) >= least, out)


def _dealt(pages: DataFrame) -> DataFrame:
    """Pages over as many tasks as shuffles have: parsing takes long for its bytes, and files or small shuffles that Spark packs by their bytes would leave few tasks."""
    return pages.repartition(int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions")), "page_id")


def page_links(pages: DataFrame) -> DataFrame:
    """``(page_id, link_no, href, label)`` of the links that aren't navigation."""
    out = _dealt(pages).select("page_id", F.posexplode(M.links_column(F.col("html"))).alias("link_no", "x")).select("page_id", "link_no", "x.href", F.col("x.text").alias("label"))
    return out.where(~T.nav_link(F.col("label")))


def table_rows(pages: DataFrame, least: int = 6) -> DataFrame:
    """``(page_id, row_no, cells)`` of the rows with at least ``least`` data cells, the first two filled, in a page's first table body."""
    return _dealt(pages).select("page_id", F.posexplode(M.table_rows_column(F.col("html"), least)).alias("row_no", "cells"))


def page_sections(pages: DataFrame) -> DataFrame:
    """``(page_id, section, text)``, the seven named sections of each page, missing ones empty."""
    return _dealt(pages).select("page_id", F.explode(M.sections_column(F.col("html"))).alias("section", "text"))


def start_urls(sites: DataFrame, codes: DataFrame, searched: DataFrame) -> DataFrame:
    """Site by code without what has been searched, dealt in turn over the sites. Up to 100 000 sites; more are an error."""
    if sites.limit(100_001).count() > 100_000:
        raise ValueError("more than 100 000 sites")
    return codes.crossJoin(F.broadcast(sites)).join(searched, ["site", "code"], "left_anti").orderBy("code", "site")


def unseen(urls: DataFrame, stored: DataFrame) -> DataFrame:
    """Of ``urls(url)`` one row for each normalised address that ``stored(url)`` has in no form: ``(norm, url)``, the least of its forms."""
    norm = T.normalize_url(F.col("url"))
    seen = stored.select(norm.alias("norm")).distinct()
    return urls.groupBy(norm.alias("norm")).agg(F.min("url").alias("url")).join(seen, "norm", "left_anti")


def json_column(col: Column, kind: str = "array<string>") -> Column:
    """JSON in a text column; null, empty and broken texts give an empty array (or null of other kinds)."""
    parsed = F.from_json(F.nullif(F.trim(col), F.lit("")), kind)
    return F.coalesce(parsed, F.array().cast(kind)) if kind.startswith("array") else parsed


def write_graph(nodes: DataFrame, edges: DataFrame, folder: str) -> None:
    """B13."""
    nodes.write.mode("overwrite").parquet(f"{folder}/nodes")
    edges.write.mode("overwrite").parquet(f"{folder}/edges")


def read_graph(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Both tables, or none of their rows where the folder lacks them."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], NODES), spark.createDataFrame([], EDGES)
    return spark.read.schema(NODES).parquet(f"{folder}/nodes"), spark.read.schema(EDGES).parquet(f"{folder}/edges")


def export(df: DataFrame, folder: str, kind: str, order: list[str] | None = None) -> None:
    """JSON, CSV with header, or text, sorted if asked."""
    out = df.orderBy(*order) if order else df
    writer = out.write.mode("overwrite")
    {"json": writer.json, "text": writer.text, "csv": writer.option("header", True).csv}[kind](folder)


def sessions_with_entries(sessions: DataFrame, entries: DataFrame, key: str = "session_id") -> DataFrame:
    """Each session with its entries as an array, oldest first."""
    rest = [c for c in entries.columns if c != key]
    nested = entries.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("created_at", *[c for c in rest if c != "created_at"]))).alias("entries"))
    return sessions.join(nested, key, "left")


def union_all(*frames: DataFrame) -> DataFrame:
    """Rows of all frames by column name."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
