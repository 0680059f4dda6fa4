"""Resharding by minimum-cost flow: the least bytes moved to meet new capacities."""

from __future__ import annotations

import heapq
import uuid
from bisect import bisect_right
from itertools import accumulate

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wrenchlake.llm.common import shared_dir, small, stored, text_of

#: Blocks per old shard. The driver sees one row of counts per block, never a document.
BLOCKS = 512


def min_cost_flow(supply: list[int], capacity: list[int]) -> dict[tuple[int, int], int]:
    """Flows (old, new) -> bytes of least cost, by successive shortest paths with potentials.

    Staying costs 0 a byte, moving 1. Needs sum(capacity) >= sum(supply). Old shard i stays if it flows to new i.
    """
    n, m = len(supply), len(capacity)
    source, sink = n + m, n + m + 1
    graph: list[list[list[int]]] = [[] for _ in range(n + m + 2)]  # of (to, left, cost, index of the reverse)

    def link(a: int, b: int, cap: int, cost: int) -> None:
        graph[a].append([b, cap, cost, len(graph[b])])
        graph[b].append([a, 0, -cost, len(graph[a]) - 1])

    for i, s in enumerate(supply):
        link(source, i, s, 0)
        for j in range(m):
            link(i, n + j, s, int(i != j))
    for j, c in enumerate(capacity):
        link(n + j, sink, c, 0)
    potential, todo = [0] * len(graph), sum(supply)
    if sum(capacity) < todo:
        raise ValueError("capacities are less than what there is")
    while todo:
        dist, back, queue = {source: 0}, {}, [(0, source)]
        while queue:
            d, a = heapq.heappop(queue)
            if d > dist[a]:
                continue
            for k, (b, left, cost, _) in enumerate(graph[a]):
                at = d + cost + potential[a] - potential[b]
                if left and at < dist.get(b, 1 << 60):
                    dist[b], back[b] = at, (a, k)
                    heapq.heappush(queue, (at, b))
        for a, d in dist.items():
            potential[a] += d
        path, b = [], sink
        while b != source:
            a, k = back[b]
            path.append((a, k))
            b = a
        amount = min(todo, *(graph[a][k][1] for a, k in path))
        for a, k in path:
            edge = graph[a][k]
            edge[1] -= amount
            graph[edge[0]][edge[3]][1] += amount
        todo -= amount
    flows = {(i, b - n): graph[b][back_at][1] for i in range(n) for b, _, _, back_at in graph[i] if n <= b < n + m}
    return {k: v for k, v in flows.items() if v}


def even_capacities(total: int, shards: int) -> list[int]:
    return [total // shards + (i < total % shards) for i in range(shards)]


def assign(rows: DataFrame, capacities: list[int] | int, blocks: int = BLOCKS) -> tuple[DataFrame, dict[tuple[int, int], int]]:
    """``rows(doc_id, size, ..., old_shard)`` with ``shard`` and ``slot`` (gapless from 0 in each shard), and the flows.

    Every old shard is cut into blocks by a hash of the row; their sizes go to the driver (``blocks`` rows
    a shard). Each flow is a range of the old shard's bytes in (block, id) order, so a document goes where the
    middle of its bytes lies: whole blocks move, and only in the block a border falls into documents are ranked.
    A shard thus misses its capacity by less than its largest border documents. Windows are per block, of
    narrow rows. ``capacities`` may be a count of shards of equal bytes. Reruns agree; equal rows are
    interchangeable. Rows must be stored: they are read three times. An empty input gives an empty result.
    """
    spark = rows.sparkSession
    columns = [c for c in rows.columns if c != "old_shard"]
    rows = rows.withColumn("block", F.pmod(F.xxhash64(*columns), F.lit(blocks)).cast("int"))
    sizes = {(r[0], r[1]): r[2] for r in rows.groupBy("old_shard", "block").agg(F.sum("size")).collect()}
    old = max((s for s, _ in sizes), default=-1) + 1
    supply = [sum(v for (s, _), v in sizes.items() if s == i) for i in range(old)]
    targets = even_capacities(sum(supply), capacities) if isinstance(capacities, int) else capacities
    flows = min_cost_flow(supply, targets)

    begins = {i: (at := 0) or {b: (at, at := at + sizes[i, b])[0] for b in sorted(b for s, b in sizes if s == i)} for i in range(old)}
    cuts = {i: [(j, v) for (a, j), v in sorted(flows.items()) if a == i] for i in range(old)}
    plan = []
    for i in range(old):
        ends = list(accumulate(v for _, v in cuts[i])) or [0]
        for b, at in begins[i].items():
            plan.append((i, b, at, [int(e) for e in ends], [j for j, _ in cuts[i]] or [0], bisect_right(ends, at)))
    schema = "old_shard int, block int, begin long, ends array<long>, goes array<int>, first int"
    plan_df = F.broadcast(spark.createDataFrame(plan, schema))  # blocks rows a shard at most

    order = Window.partitionBy("old_shard", "block").orderBy(*columns)
    placed = rows.join(plan_df, ["old_shard", "block"]).withColumn("run", F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    middle = F.col("begin") + F.col("run") - F.col("size") + F.expr("size div 2")
    passed = F.size(F.filter("ends", lambda e: e <= middle))
    placed = placed.withColumn("shard", F.element_at("goes", F.least(passed, F.size("goes") - 1) + 1))
    part = Window.partitionBy("old_shard", "block", "shard").orderBy(*columns)
    placed = stored(placed.withColumn("nth", F.row_number().over(part)).select(*columns, "old_shard", "block", "shard", "nth"), "sharding")
    counts = {(r[0], r[1], r[2]): r[3] for r in placed.groupBy("shard", "old_shard", "block").count().collect()}
    offsets, at, last = [], 0, None
    for s, i, b in sorted(counts):
        at = 0 if s != last else at
        offsets.append((s, i, b, at))
        at, last = at + counts[s, i, b], s
    offset_df = F.broadcast(spark.createDataFrame(offsets, "shard int, old_shard int, block int, before long"))
    out = placed.join(offset_df, ["shard", "old_shard", "block"])
    return out.withColumn("slot", F.col("before") + F.col("nth") - 1).select(*columns, "old_shard", "shard", "slot"), flows


def _size(text_col: str) -> Column:
    return F.octet_length(text_of(text_col)).cast("long") + 1


def _crc(text_col: str) -> Column:
    return F.crc32(text_of(text_col).cast("binary"))


def _old_shard(id_col: str, old_shards: int) -> Column:
    return F.pmod(F.xxhash64(F.col(id_col)), F.lit(old_shards)).cast("int")


def shard_documents(docs: DataFrame, shards: int = 8, old_shards: int = 6, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All documents in ``shards`` shards of near equal bytes, from the layout of ``old_shards`` by a hash of the
    id, moving the fewest bytes: ``(doc_id, size, text_crc32, old_shard, shard, slot)``.

    The size is the text's UTF-8 bytes plus 1 (null: 1). Only id, size and checksum are shuffled, never texts.
    Null ids and repeated rows are placed like any other row. Columns besides id and text are not read, whatever their names; an empty table gives an empty one.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), _size(text_col).alias("size"), _crc(text_col).alias("text_crc32"), _old_shard(id_col, old_shards).alias("old_shard"))
    return assign(stored(rows, "shard-rows"), shards)[0]


def _placed(old: DataFrame, moves: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The rows of old shards (in column ``shard``) with ``__to``, ``__slot``, each joined with one row of
    ``moves`` by old shard, id, size, checksum and a number among rows equal in these. Only repeated rows are numbered by a shuffle."""
    columns, keys = old.columns, ["__shard", "__id", "__size", "__crc"]
    goes = moves.select(F.col("old_shard").alias("__shard"), F.col("doc_id").alias("__id"), F.col("size").alias("__size"), F.col("text_crc32").alias("__crc"), F.col("shard").alias("__to"), F.col("slot").alias("__slot"))
    goes = stored(goes.withColumn("__nth", F.row_number().over(Window.partitionBy(*keys).orderBy("__to", "__slot"))), "shard-moves")
    again = small(stored(goes.where("__nth = 2").select([F.col(k).alias(f"{k}_2") for k in keys]), "shard-repeated"))
    rows = old.select("*", F.col("shard").alias("__shard"), F.col(id_col).alias("__id"), _size(text_col).alias("__size"), _crc(text_col).alias("__crc"))
    twice = F.lit(True)
    for k in keys:
        twice = twice & F.col(k).eqNullSafe(F.col(f"{k}_2"))
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy(F.xxhash64(*columns)))
    rows = rows.join(again, twice, "left_anti").withColumn("__nth", F.lit(1)).unionByName(rows.join(again, twice, "left_semi").withColumn("__nth", nth))
    rows, goes = rows.alias("a"), small(goes).alias("b")
    same = F.lit(True)
    for k in [*keys, "__nth"]:
        same = same & F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}"))
    return rows.join(goes, same).select(*[F.col(f"a.{c}") for c in columns], "__to", "__slot")


def rewrite(spark: SparkSession, old_path: str, new_path: str, moves: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> list[int]:
    """Rewrite the files of shards that gain or lose documents; shards that keep all of theirs are not read.

    ``old_path`` and ``new_path`` hold ``shard=N`` folders of Parquet, the new ones with ``slot``; ``moves`` is what
    ``shard_documents`` gives, for every row. Returns the shards whose contents stayed and whose files can be linked or kept. The
    documents of the others are written by Spark's writer, so a lost task is run again. Null and repeated ids are moved like any other.
    """
    changed = moves.where("old_shard <> shard").agg(F.collect_set("old_shard"), F.collect_set("shard")).first()
    touched = sorted({*changed[0], *changed[1]})  # at most one number a shard
    old = spark.read.parquet(old_path)
    columns = [c for c in old.columns if c != "shard"]
    part, goes = old.where(F.col("shard").isin(touched)), moves.where(F.col("old_shard").isin(touched))
    if not touched:
        part, goes = old.limit(0), moves.limit(0)
    _placed(part, goes, id_col, text_col).select(*columns, F.col("__slot").alias("slot"), F.col("__to").alias("shard")).write.partitionBy("shard").parquet(new_path)
    every = {r[0] for r in moves.select("old_shard").distinct().collect()}  # one row a shard
    return sorted(every - set(touched))


def reshard(docs: DataFrame, shards: int = 8, old_shards: int = 6, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write ``docs`` as old shards, move them as ``shard_documents`` says, rewrite the affected files and read all shards
    back: ``(doc_id, size, text_crc32, old_shard, shard, slot)`` of the documents found there."""
    spark = docs.sparkSession
    base = f"{shared_dir(spark)}/wrenchlake/shards-{uuid.uuid4().hex}"
    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    narrow.withColumn("shard", _old_shard("doc_id", old_shards)).write.partitionBy("shard").parquet(f"{base}/old")
    layout = narrow.withColumn("shard", F.lit(None).cast("int")).schema
    old = spark.read.schema(layout).parquet(f"{base}/old")
    moves = stored(shard_documents(old.drop("shard"), shards, old_shards), "shard-placed")
    if not moves.take(1):
        return moves
    stayed = rewrite(spark, f"{base}/old", f"{base}/new", moves)
    layout = narrow.select("*", F.lit(None).cast("long").alias("slot"), F.lit(None).cast("int").alias("shard")).schema
    back = spark.read.schema(layout).parquet(f"{base}/new")
    if stayed:
        kept = _placed(old.where(F.col("shard").isin(stayed)), moves.where(F.col("old_shard").isin(stayed)), "doc_id", "text")
        back = back.unionByName(kept.select("doc_id", "text", F.col("__slot").alias("slot"), F.col("__to").alias("shard")))
    return back.select("doc_id", _size("text").alias("size"), _crc("text").alias("text_crc32"), _old_shard("doc_id", old_shards).alias("old_shard"), "shard", "slot")
