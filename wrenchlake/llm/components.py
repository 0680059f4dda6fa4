"""Connected components as alternating star contractions over DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wrenchlake.llm.common import cut


#: Edges a partition: few edges are not spread over many tasks.
EDGES = 200_000


def _hash_of(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 40)))).first())


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``edges(src long, dst long)`` -> ``(node, component)``: one row per node that has an edge to another
    node, ``component`` the smallest node reachable.

    Each round runs a large-star and a small-star contraction: every node points its larger (then its
    smaller) neighbours at the smallest node it knows. Minima are pre-aggregated before the shuffle, edges are joined
    back by node (a join that adaptive execution can split), so that a hub is never gathered in one task.
    Rounds grow with the logarithm of the longest chain. Each round's edges are checkpointed. Null ends and
    self-loops are ignored; an empty input gives an empty result.
    """
    def settle(df: DataFrame) -> tuple[DataFrame, tuple]:
        """The checkpointed edges in partitions of EDGES each, and what tells whether they changed."""
        out = cut(df.distinct())
        now = _hash_of(out)
        return out.coalesce(now[0] // EDGES + 1), now

    e, before = settle(edges.where("src is not null and dst is not null and src <> dst").select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")))
    for _ in range(max_rounds):
        if not before[0]:
            break
        ends = F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))
        both = e.select(F.explode(ends).alias("x")).select("x.u", "x.v")
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        linked = large.join(low, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x")).select("x.u", "x.v")
        e, now = settle(linked.where("u <> v"))
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )


def merged(parts: DataFrame, edges: DataFrame) -> DataFrame:
    """``parts(node, component)``, a result of ``connected_components``, with ``edges(src, dst)`` added: the same as from all edges at once.

    Only the edges between different components, as edges of these, are contracted. ``parts`` is read several times and should be stored.
    """
    of = lambda end: parts.select(F.col("node").alias(end), F.col("component").alias(f"{end}_part"))
    named = edges.select("src", "dst").join(of("src"), "src", "left").join(of("dst"), "dst", "left")
    between = named.select(F.coalesce("src_part", "src").alias("src"), F.coalesce("dst_part", "dst").alias("dst"))
    joined = cut(connected_components(between)).select(F.col("node").alias("old"), F.col("component").alias("new"))
    moved = parts.join(joined, F.col("component") == F.col("old"), "left").select("node", F.coalesce("new", "component").alias("component"))
    return moved.unionByName(joined.join(parts, F.col("old") == F.col("node"), "left_anti").select(F.col("old").alias("node"), F.col("new").alias("component")))
