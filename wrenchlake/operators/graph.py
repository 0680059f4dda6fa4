"""Typed graphs as node and edge tables; bounded cheapest paths by iterated joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wrenchlake.shared import kept


def nodes(df: DataFrame, kind: str, key: str, *labels: str) -> DataFrame:
    """``(node_id, node_type, label)``, one per key; the label is the first non-blank of the columns."""
    label = F.coalesce(*[F.nullif(F.trim(F.col(c).cast("string")), F.lit("")) for c in labels], F.lit(""))
    return df.where(F.col(key).isNotNull()).groupBy(F.concat(F.lit(f"{kind}:"), F.col(key).cast("string")).alias("node_id")).agg(F.lit(kind).alias("node_type"), F.min(label).alias("label"))


def edges(df: DataFrame, src: Column, dst: Column, relationship: str, weight: Column | float = 1.0) -> DataFrame:
    """``(src, dst, relationship, weight)``, one each, the least weight."""
    w = weight if isinstance(weight, Column) else F.lit(float(weight))
    return df.select(src.alias("src"), dst.alias("dst"), F.lit(relationship).alias("relationship"), w.cast("double").alias("weight")).where("src is not null and dst is not null").groupBy("src", "dst", "relationship").agg(F.min("weight").alias("weight"))


def priority_weight(priority: Column) -> Column:
    """1 / max(priority, 0.1) of a positive priority, else 1."""
    return F.when(priority > 0, 1 / F.greatest(priority, F.lit(0.1))).otherwise(1.0)


def with_both_ends(e: DataFrame, n: DataFrame) -> DataFrame:
    """Edges both of whose nodes exist."""
    ids = n.select("node_id")
    return e.join(ids, e["src"] == ids["node_id"], "left_semi").join(ids, e["dst"] == ids["node_id"], "left_semi")


def merge_graph(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """New rows of unknown keys are added; nothing is doubled."""
    return old.unionByName(new.dropDuplicates(keys).join(old.select(*keys).distinct(), keys, "left_anti"))


def type_counts(n: DataFrame, col: str) -> DataFrame:
    """E11."""
    return n.groupBy(col).agg(F.count("*").alias("n"))


def neighbors(e: DataFrame, n: DataFrame, relationship: str | None = None) -> DataFrame:
    """Successors with their types, one row an edge."""
    some = e.where(F.col("relationship") == relationship) if relationship else e
    return some.join(n.select(F.col("node_id").alias("dst"), "node_type", "label"), "dst")


def cheapest_paths(e: DataFrame, sources: DataFrame, targets: DataFrame, hops: int = 3) -> DataFrame:
    """From each source to each target the cheapest path of at most ``hops`` edges, ties to fewer edges, then to the smaller path.

    ``sources(src)``, ``targets(dst)``; weights missing count 1, parallel edges by their least weight. A step
    joins the frontier with the edges and keeps, of each (source, node), the cheapest walk of that length, so the frontier holds at most
    one row a pair. ``score`` is the mean weight of the path's edges.
    """
    step = e.groupBy(F.col("src").alias("at"), F.col("dst").alias("to")).agg(F.min(F.coalesce("weight", F.lit(1.0))).alias("w"))
    front = sources.distinct().select("src", F.col("src").alias("node"), F.lit(0.0).alias("cost"), F.lit(0).alias("n"), F.col("src").alias("path"))
    found = None
    for _ in range(hops):
        walked = front.join(step, front["node"] == step["at"]).select("src", F.col("to").alias("node"), (F.col("cost") + F.col("w")).alias("cost"), (F.col("n") + 1).alias("n"), F.concat_ws(">", "path", "to").alias("path"))
        front = walked.groupBy("src", "node").agg(F.min(F.struct("cost", "n", "path")).alias("b")).select("src", "node", "b.*")
        found = front if found is None else found.unionByName(front)
    best = found.join(targets.distinct(), found["node"] == targets["dst"], "left_semi").where("src <> node").groupBy("src", F.col("node").alias("dst")).agg(F.min(F.struct("cost", "n", "path")).alias("b"))
    return best.select("src", "dst", "b.*").withColumn("score", F.col("cost") / F.col("n"))


def shortest_paths(e: DataFrame, sources: DataFrame, targets: DataFrame, max_length: int = 4, most: int | None = 20) -> DataFrame:
    """From each source to each target the cheapest path of any number of edges, kept only if it has at most ``max_length`` edges; of each source the
    ``most`` shortest, by edges, then target. ``(src, dst, cost, n, score, path)``, the path as an array of nodes.

    A target whose cheapest path is longer is not reached by a dearer, shorter one. Equal costs go to fewer edges, then to the smaller node before. A
    missing weight counts 1, parallel edges by their least; negative weights are an error. ``score`` is the mean weight of the path's edges. A source that is a target has no path to itself.

    Frontiers run until nothing improves: only pairs (source, node) whose cost fell in the last round are joined with the edges, so a round costs
    what it changes; a pair keeps its cost and the node before it, not its path. The paths of the pairs that are left are then followed backwards,
    ``max_length`` joins at most. The rounds are as many as the longest cheapest path has edges.
    """
    step = kept(e.groupBy(F.col("src").alias("at"), F.col("dst").alias("to")).agg(F.min(F.coalesce("weight", F.lit(1.0))).alias("w")), "edges")
    if step.where("w < 0").take(1):
        raise ValueError("negative weights")
    reached = kept(sources.select("src").where("src is not null").distinct().select("src", F.col("src").alias("node"), F.struct(F.lit(0.0).alias("cost"), F.lit(0).alias("n"), F.lit(None).cast("string").alias("before")).alias("b")), "reached")
    front = reached
    while front.take(1):
        walked = front.join(step, front["node"] == step["at"]).where(F.col("to") != F.col("src"))
        new = walked.select("src", F.col("to").alias("node"), F.struct((F.col("b.cost") + F.col("w")).alias("cost"), (F.col("b.n") + 1).alias("n"), F.col("at").alias("before")).alias("b"))
        new = new.groupBy("src", "node").agg(F.min("b").alias("new"))
        both = kept(reached.join(new, ["src", "node"], "full").select("src", "node", F.least("b", "new").alias("b"), F.coalesce(F.col("new") < F.col("b"), F.col("b").isNull()).alias("better")), "reached")
        reached, front = both.drop("better"), both.where("better").drop("better")
    found = reached.join(targets.select(F.col("dst").alias("node")).distinct(), "node", "left_semi").where(F.col("b.n").between(1, max_length))
    if most is not None:
        nth = F.row_number().over(Window.partitionBy("src").orderBy("b.n", "node"))
        found = found.withColumn("nth", nth).where(F.col("nth") <= most).drop("nth")
    links = reached.select("src", F.col("node").alias("at"), F.col("b.before").alias("before"))
    back = found.select("src", F.col("node").alias("dst"), F.col("b.cost").alias("cost"), F.col("b.n").alias("n"), F.array("node").alias("path"), F.col("node").alias("at"))
    for _ in range(max_length):
        back = back.join(links, ["src", "at"], "left").select("src", "dst", "cost", "n", F.when(F.col("before").isNotNull(), F.concat(F.array("before"), "path")).otherwise(F.col("path")).alias("path"), F.coalesce("before", "at").alias("at"))
    return back.select("src", "dst", "cost", "n", (F.col("cost") / F.col("n")).alias("score"), "path")


def node_by_code(n: DataFrame, codes: DataFrame) -> DataFrame:
    """Of each of ``codes(code)`` the node ``fault_code:<code>``, else the least fault node whose ``code`` attribute it is; ``node_id`` is null for
    none. ``n(node_id, node_type, code)``."""
    asked = codes.select("code").distinct().withColumn("named", F.concat(F.lit("fault_code:"), "code"))
    direct = asked.join(n.select(F.col("node_id").alias("named")).distinct(), "named", "left_semi").select("code", F.col("named").alias("direct"))
    held = n.where("node_type = 'fault_code'").groupBy("code").agg(F.min("node_id").alias("held"))
    return asked.select("code").join(direct, "code", "left").join(held, "code", "left").select("code", F.coalesce("direct", "held").alias("node_id"))
