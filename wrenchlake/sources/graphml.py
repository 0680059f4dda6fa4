"""Graphs as GraphML, read and written by Spark: attributes are declared by keys and held in data elements."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

NODES = "node_id string, attributes map<string, string>"
EDGES = "src string, dst string, attributes map<string, string>"
DATA = "data array<struct<_key: string, _VALUE: string>>"
#: The attributes' declared types.
KINDS = ("string", "double", "long", "int", "float", "boolean")


def _rows(spark: SparkSession, path: str, tag: str, schema: str) -> DataFrame:
    """The elements of one tag, read in parallel; malformed ones are dropped. A path that isn't there gives no rows."""
    try:
        return spark.read.schema(schema).options(rowTag=tag, mode="DROPMALFORMED", ignoreSurroundingSpaces="false").format("xml").load(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def read(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges with their attributes by name. An absent file, one that isn't GraphML, or an empty graph gives empty tables.

    A data element whose key isn't declared for its kind of element keeps the key as its name; an absent attribute takes the declared default,
    as GraphML has it. Of a repeated one the last counts. A folder's documents are one graph. Elements without id, source or target are left out.
    """
    keys = _rows(spark, path, "key", "_id string, _for string, `_attr.name` string, default string").where("_id is not null")
    declared = keys.select(F.col("_id").alias("id"), F.coalesce("_for", F.lit("all")).alias("kind"), F.coalesce(F.col("`_attr.name`"), F.col("_id")).alias("name"), "default")

    def of(kind: str, tag_schema: str, *columns: Column) -> DataFrame:
        rows = _rows(spark, path, kind, f"{tag_schema}, {DATA}")
        known = declared.where(F.col("kind").isin(kind, "all")).groupBy("id").agg(F.min("name").alias("name"), F.min("default").alias("default")).agg(
            F.map_from_entries(F.collect_list(F.struct("id", "name"))).alias("names"),
            F.map_from_entries(F.collect_list(F.when(F.col("default").isNotNull(), F.struct("name", "default")))).alias("defaults"),
        )  # a row of a graph's few keys
        held = F.coalesce(F.filter("data", lambda d: d["_key"].isNotNull()), F.array().cast("array<struct<_key: string, _VALUE: string>>"))
        named = F.transform(held, lambda d: F.struct(F.coalesce(F.try_element_at("names", d["_key"]), d["_key"]).alias("key"), F.coalesce(d["_VALUE"], F.lit("")).alias("value")))
        last = F.transform(F.array_distinct(F.transform(named, lambda d: d["key"])), lambda k: F.struct(k.alias("key"), F.element_at(F.filter(named, lambda d: d["key"] == k), -1)["value"].alias("value")))
        own = F.map_from_entries(last)
        absent = F.map_filter("defaults", lambda k, _: ~F.map_contains_key(own, k))
        return rows.crossJoin(F.broadcast(known)).select(*columns, F.map_concat(own, absent).alias("attributes"))

    nodes = of("node", "_id string", F.col("_id").alias("node_id")).where("node_id is not null")
    edges = of("edge", "_source string, _target string", F.col("_source").alias("src"), F.col("_target").alias("dst")).where("src is not null and dst is not null")
    return nodes, edges


def _escaped(text: Column) -> Column:
    for plain, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("\r", "&#13;"), ("\n", "&#10;"), ("\t", "&#9;")):
        text = F.replace(text, F.lit(plain), F.lit(name))
    return text


def _kind(dtype: str) -> str:
    kind = {"bigint": "long", "smallint": "int", "tinyint": "int"}.get(dtype, dtype)
    return kind if kind in KINDS else "string"


def write(nodes: DataFrame, edges: DataFrame, path: str, parts: int | None = None) -> None:
    """Nodes (``node_id``, more columns as attributes) and edges (``src``, ``dst``, more) as a folder of GraphML documents.

    Every task writes a document of its own, with all keys declared; together they are the graph. ``parts=1`` writes one document for programs that
    want the whole graph in a file. Null attributes are left out; columns of other than GraphML's types are written as strings.
    """
    lines, declared = [], []
    for kind, df, ends in (("node", nodes, {"node_id": "id"}), ("edge", edges, {"src": "source", "dst": "target"})):
        data = []
        for n, (name, dtype) in enumerate((c, t) for c, t in df.dtypes if c not in ends):
            declared.append((kind, f"{kind[0]}{n}", name, _kind(dtype)))
            column = F.col(f"`{name}`")
            data.append(F.when(column.isNotNull(), F.concat(F.lit(f'<data key="{kind[0]}{n}">'), _escaped(column.cast("string")), F.lit("</data>"))))
        marks = [F.concat(F.lit(f' {a}="'), _escaped(F.col(c).cast("string")), F.lit('"')) for c, a in ends.items()]
        lines.append(df.select(F.concat(F.lit(f"<{kind}"), *marks, F.lit(">"), F.concat_ws("", F.lit(""), *data), F.lit(f"</{kind}>")).alias("value")))
    keys = [f'<key id="{i}" for="{kind}" attr.name="{name.replace("&", "&amp;").replace("<", "&lt;").replace(chr(34), "&quot;")}" attr.type="{t}"/>' for kind, i, name, t in declared]
    head = ['<?xml version="1.0" encoding="UTF-8"?>', '<graphml xmlns="http://graphml.graphdrawing.org/xmlns">', *keys, '<graph edgedefault="directed">']
    foot = ["</graph>", "</graphml>"]

    def framed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield pd.DataFrame({"value": head})
        yield from batches
        yield pd.DataFrame({"value": foot})

    every = lines[0].unionByName(lines[1])
    (every if parts is None else every.coalesce(parts)).mapInPandas(framed, "value string").write.mode("overwrite").text(path)
