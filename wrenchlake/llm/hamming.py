"""Multi-index hashing of 64-bit codes: radius joins and exact top-k search."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wrenchlake.llm.common import cut, stored

WIDTH = 64
#: Masks that one task applies to a row.
MASKS = 512


def _segments(code: str, segments: int) -> list:
    """The code's segments as longs, lowest bits first."""
    bits = WIDTH // segments
    return [F.shiftrightunsigned(F.col(code), s * bits).bitwiseAND(F.lit((1 << bits) - 1)) for s in range(segments)]


def _masks(bits: int, ring: int) -> list[int]:
    """All masks of exactly ``ring`` set bits in a segment of ``bits``."""
    return [sum(1 << b for b in c) for c in combinations(range(bits), ring)]


def _table(codes: DataFrame, by: str, segments: int, **keep: str) -> DataFrame:
    """One row per code in column ``by`` and segment: (seg, value, the kept columns by their new names)."""
    entries = F.array(*[F.struct(F.lit(s).alias("seg"), v.alias("value")) for s, v in enumerate(_segments(by, segments))])
    return codes.select(F.explode(entries).alias("entry"), *[F.col(c).alias(a) for a, c in keep.items()]).select("entry.*", *keep)


def _probes(table: DataFrame, bits: int, ring: int) -> DataFrame:
    """Every row of the table once for each value that differs from its own in exactly ``ring`` bits.

    The masks of a ring are made once and joined as a table of one row for each chunk of ``MASKS`` masks, so that the probes of a row
    are made by many tasks. A segment has at most 2**bits masks: 65 536 for 16 bits."""
    masks = _masks(bits, ring)
    if len(masks) <= MASKS:
        return table.withColumn("value", F.explode(F.transform(F.array(*[F.lit(m).cast("long") for m in masks]), lambda m: F.col("value").bitwiseXOR(m))))
    chunks = [(k, masks[at : at + MASKS]) for k, at in enumerate(range(0, len(masks), MASKS))]
    lists = table.sparkSession.createDataFrame(chunks, "chunk int, masks array<long>")
    dealt = table.withColumn("chunk", F.explode(F.array(*[F.lit(k) for k, _ in chunks]))).repartition(F.col("seg"), F.col("value"), F.col("chunk"))
    spread = dealt.join(F.broadcast(lists), "chunk").drop("chunk")  # 2**bits longs at most
    return spread.withColumn("value", F.explode(F.transform("masks", lambda m: F.col("value").bitwiseXOR(m)))).drop("masks")


def radius_pairs(codes: DataFrame, code: str = "code", radius: int = 3, segments: int = 2) -> DataFrame:
    """Pairs ``(src, dst)``, src < dst, of distinct codes at most ``radius`` bits apart; complete.

    ``codes`` holds distinct codes. Two codes within ``radius`` differ in at most ``radius // segments`` bits of
    at least one segment (pigeonhole), so each code enumerates that small ball around each of its segments,
    fetches the codes that the table holds there, and the complete distance is verified in the join. A pair
    may come twice. Where ``segments`` does not divide 64 the highest bits are in no segment; the argument holds for the others.
    """
    bits = WIDTH // segments
    table = _table(codes, code, segments, dst=code)
    own = _table(codes, code, segments, src=code)
    near = own
    for ring in range(1, radius // segments + 1):
        near = near.unionByName(_probes(own, bits, ring))
    return (
        near.join(table, ["seg", "value"])
        .where((F.col("src") < F.col("dst")) & (F.bit_count(F.col("src").bitwiseXOR(F.col("dst"))) <= radius))
        .select("src", "dst")
    )


def sign_code(vector: str):
    """64 sign bits of a vector: bit i is set where component i is positive. Null for a null vector; of longer
    vectors the first 64 components count, missing, null and NaN components give 0."""
    return F.expr(
        f"case when {vector} is not null then aggregate(transform(slice({vector}, 1, {WIDTH}), (x, i) -> "
        f"case when x > 0 and not isnan(x) then shiftleft(1L, i) else 0L end), 0L, (a, b) -> a | b) end"
    )


def topk_search(rows: DataFrame, queries: DataFrame, k: int = 10, segments: int = 4) -> DataFrame:
    """Exact ``k`` nearest ``rows(id, code)`` of each of ``queries(query_id, query_code)`` by Hamming distance, ties by id.

    The search radius of all segments grows by one a round. After radius s every code within
    ``segments * (s + 1) - 1`` bits has been met, so a query ends once its kth verified distance is within
    that. Of rows that share a code only the ``k`` smallest ids can be in a result; the rest of a hot code
    is cut per task before any shuffle. Only the best ``k`` of each query are carried between rounds, and matches
    farther than the kth best so far are dropped in the join.
    Rows or queries with null ids or codes take no part; a repeated (id, code) counts once; with
    fewer than ``k`` rows all are returned. Result: ``query_id, id, distance, rank``.
    """
    bits = WIDTH // segments
    of_code = Window.partitionBy("code").orderBy("id")
    kept = stored(
        rows.where("id is not null and code is not null").select("id", "code").distinct()
        .withColumn("n", F.row_number().over(of_code)).where(F.col("n") <= k).drop("n"), "topk-rows",
    )
    table = _table(kept, "code", segments, id="id", code="code")
    wanted = min(k, kept.limit(k).count())
    asked = cut(queries.where("query_id is not null and query_code is not null").select("query_id", "query_code").distinct())
    order = Window.partitionBy("query_id").orderBy("distance", "id")
    best = cut(asked.select("query_id", F.lit(None).cast("long").alias("id"), F.lit(WIDTH).alias("distance")).limit(0))
    for ring in range(bits + 1):
        state = best.groupBy("query_id").agg(F.count("*").alias("n"), F.max("distance").alias("d"))
        known = F.coalesce(F.col("n"), F.lit(0)) >= wanted
        bounded = asked.join(state, "query_id", "left").select("query_id", "query_code", F.when(known, F.col("d")).otherwise(WIDTH).alias("bound"), known.alias("known"))
        covered = segments * ring - 1  # by the rounds before
        active = cut(bounded.where(~(F.col("known") & (F.col("bound") <= covered))))
        if not wanted or not active.take(1):
            break
        own = _table(active, "query_code", segments, query_id="query_id", query_code="query_code", bound="bound")
        distance = F.bit_count(F.col("query_code").bitwiseXOR(F.col("code"))).cast("int")
        met = _probes(own, bits, ring).join(table, ["seg", "value"]).where(distance <= F.col("bound")).select("query_id", "id", distance.alias("distance"))
        met = met.unionByName(best).distinct()
        best = cut(met.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).drop("rank"))
    return best.select("query_id", "id", "distance", F.row_number().over(order).alias("rank"))
