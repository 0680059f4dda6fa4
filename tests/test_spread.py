"""Parts that share their codes, and pages that lie in one file."""

from __future__ import annotations

import duckdb
import pytest
from pyspark.sql import functions as F

from tests import oracle
from wrenchlake.plans import model_queries
from wrenchlake.sources import records as S


def test_disjoint_negatives_join_few_parts_of_a_code(spark, tmp_path):
    c = duckdb.connect()
    c.sql("""CREATE TABLE part AS SELECT range AS p_partkey, 'n' || range AS p_name, 'b' || range % 3 AS p_brand, CASE WHEN range % 11 > 0 THEN 't' || range % 2 END AS p_type, (range % 2)::INTEGER AS p_size FROM range(600)
        UNION ALL SELECT 300, 'again', 'b9', 't9', 0 UNION ALL SELECT NULL, 'none', 'b9', 't9', 0""")
    c.sql(f"COPY part TO '{tmp_path}/part.parquet'")
    got = model_queries.disjoint_negatives(spark, str(tmp_path))
    oracle.same(got.toPandas(), c.sql(model_queries.ORACLE_SQL["disjoint_negatives"]).df())
    assert "dense_rank" in got._jdf.queryExecution().toString()


@pytest.mark.parametrize("of", [S.table_rows, S.page_sections, S.page_links])
def test_pages_of_one_file_are_parsed_in_several_tasks(spark, of):
    pages = spark.range(0, 400, 1, 1).select(F.col("id").alias("page_id"), F.lit("<a href=x>y</a><table><tbody><tr><td>1<td>2<td>3<td>4<td>5<td>6</tr></tbody></table>").alias("html"))
    assert of(pages).select(F.spark_partition_id().alias("p")).distinct().count() > 1


def test_sections_keep_any_text(spark):
    text = 'a "quoted" \\ back/slash é 漢'
    pages = spark.createDataFrame([(1, f"<table><thead>Warnings</thead><tbody><tr><td>{text}</td></tr></tbody></table>"), (2, None)], "page_id long, html string")
    got = {(r.page_id, r.section): r.text for r in S.page_sections(pages).collect()}
    assert len(got) == 14 and got[1, "warnings"] == text and got[2, "warnings"] == ""
