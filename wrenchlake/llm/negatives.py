"""Hard-negative mining: exact search of k-means inverted lists by Cauchy-Schwarz bounds from stored centroid radii."""

from __future__ import annotations

from collections.abc import Iterator
from math import isqrt

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wrenchlake.llm.common import stored

#: Clusters at most (else the root of the number of rows), and rows that they are fitted on. Every row is indexed.
CLUSTERS, SAMPLE = 1024, 20_000
#: Rows of a list that lie in one block, and anchors that meet a block in one task, about.
BLOCK, GROUP = 2048, 1024
#: Clusters an anchor visits in the first round; each later round takes four times as many.
FIRST = 4
LEAST, MOST = -(1 << 63), (1 << 63) - 1

ROW = "row long, id long, label long, code array<long>"
ASKS = "array<struct<slot: int, lo: long, hi: long>>"
LIST = "cluster int, part int, n int, radius double, width int, ids binary, labels binary, codes binary"
FOUND = "row long, slot int, id long, score long"


def scaled(vector: str, by: int = 256) -> Column:
    """floor(by * x) of each component as longs (beyond a long: the nearest); null if the vector or any component is null or not finite."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.when(F.col(vector).isNotNull() & ~bad, F.transform(vector, lambda x: F.floor(x.cast("double") * F.lit(float(by)))))


def _scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of the rows of two matrices of longs; beyond a long the nearest long."""
    most = (int(np.abs(a.astype(float)).max(initial=0)) + 1) * (int(np.abs(b.astype(float)).max(initial=0)) + 1) * max(1, a.shape[1])
    if most < 1 << 53:  # sums of doubles are exact then
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    exact = a.astype(object) @ b.astype(object).T
    return np.clip(exact, LEAST, MOST).astype(np.int64)


def _matrix(codes, dims: int) -> np.ndarray:
    out = np.zeros((len(codes), dims), np.int64)
    for k, code in enumerate(codes):
        out[k, : len(code)] = code
    return out


def _bounds(codes: np.ndarray, centroids: np.ndarray, radii: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """By row and cluster, the least and the greatest inner product that a member can have: that with the centroid, give or take the
    row's length times the radius, with room for rounding."""
    q = codes.astype(np.float64)
    length = np.sqrt((q**2).sum(axis=1))[:, None]
    middle, reach = q @ centroids.T, length * radii
    room = 1e-9 * length * (np.sqrt((centroids**2).sum(axis=1)) + radii) + 1e-6
    low, high = np.clip(middle - reach - room, LEAST, MOST), np.clip(middle + reach + room, LEAST, MOST)  # as scores are
    low[:, radii < 0], high[:, radii < 0] = np.inf, -np.inf  # clusters without rows
    return low, high


class Lists:
    """Inverted lists of ``rows(row, id, label, code)``: blocks of packed rows by cluster, and each cluster's centroid and radius.

    k-means (Spark's) is fitted on about ``SAMPLE`` rows chosen by a hash, with at most ``CLUSTERS`` clusters; all rows are assigned, packed in blocks of about
    ``BLOCK`` rows and written. A cluster of many rows has many blocks, so none meets in one task. The driver holds centroids, radii and the
    numbers of blocks: ``CLUSTERS`` of each.
    """

    def __init__(self, rows: DataFrame):
        widest, total = rows.agg(F.max(F.size("code")), F.count("*")).first()
        self.dims = max(1, widest)
        features = array_to_vector(F.concat(F.col("code").cast("array<double>"), F.array_repeat(F.lit(0.0), F.lit(self.dims) - F.size("code"))))
        points = rows.withColumn("features", features)
        sample = points.where(F.pmod(F.xxhash64("row"), F.lit(total)) < SAMPLE).select("features")
        model = KMeans(k=max(2, min(CLUSTERS, isqrt(total))), seed=1, maxIter=8, predictionCol="cluster").fit(sample if sample.take(1) else points.select("features"))
        self.centroids = np.array(model.clusterCenters(), np.float64)
        assigned = stored(model.transform(points).select("row", "id", "label", "code", "cluster"), "negatives-assigned")
        self.parts = {r[0]: -(-r[1] // BLOCK) for r in assigned.groupBy("cluster").count().collect()}  # CLUSTERS rows at most
        parts = F.broadcast(rows.sparkSession.createDataFrame(list(self.parts.items()), "cluster int, parts int"))
        dealt = assigned.join(parts, "cluster").withColumn("part", F.pmod(F.xxhash64("row"), F.col("parts")).cast("int"))
        self.blocks = stored(dealt.groupBy("cluster", "part").applyInPandas(self._packer(), LIST), "negatives-lists")
        radius = dict(self.blocks.groupBy("cluster").agg(F.max("radius")).collect())
        self.radii = np.array([radius.get(c, -1.0) for c in range(len(self.centroids))])

    def _packer(self):
        centroids, dims = self.centroids, self.dims

        def pack(block: pd.DataFrame) -> pd.DataFrame:
            codes, cluster = _matrix(block["code"], dims), int(block["cluster"].iloc[0])
            radius = float(np.sqrt(((codes - centroids[cluster]) ** 2).sum(axis=1)).max()) * (1 + 1e-9)
            widest = max(abs(int(codes.max(initial=0))), abs(int(codes.min(initial=0))))
            width = next(w for w in (2, 4, 8) if widest < 1 << (8 * w - 1) or w == 8)
            packed = [block["id"].to_numpy(np.int64).tobytes(), block["label"].to_numpy(np.int64).tobytes(), codes.astype(f"<i{width}").tobytes()]
            return pd.DataFrame([(cluster, int(block["part"].iloc[0]), len(block), radius, width, *packed)], columns=[c.split()[0] for c in LIST.split(", ")])

        return pack

    def bounds(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return _bounds(codes, self.centroids, self.radii)

    def _frontier(self, step: int):
        """Of each anchor, the next ``step`` clusters by upper bound that can hold what one of its asks still wants."""
        dims, centroids, radii = self.dims, self.centroids, self.radii

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for whole in batches:
                for at in range(0, len(whole), 256):
                    batch = whole.iloc[at : at + 256]
                    low, high = _bounds(_matrix(batch["code"], dims), centroids, radii)
                    orders = np.argsort(-high, axis=1, kind="stable")
                    clusters, visited = [], []
                    for k, (seen, asks) in enumerate(zip(batch["visited"], batch["asks"])):
                        order = orders[k][seen:]
                        wanted = np.zeros(len(order), bool)
                        for ask in asks:
                            wanted |= (high[k][order] >= ask["lo"]) & (low[k][order] <= ask["hi"])
                        hits = np.flatnonzero(wanted)
                        clusters.append(order[hits[:step]].astype(np.int32).tolist())
                        visited.append(seen + int(hits[step - 1]) + 1 if len(hits) > step else len(high[k]))
                    yield batch.assign(clusters=clusters, visited=visited)

        return run

    def _meet(self, k: int, same: bool):
        """The best ``k`` rows of a block for each ask of each anchor of a group."""
        dims = self.dims

        def run(anchors: pd.DataFrame, block: pd.DataFrame) -> pd.DataFrame:
            out: list[tuple[int, int, int, int]] = []
            if len(anchors) and len(block):
                b = block.iloc[0]
                ids, labels = np.frombuffer(b["ids"], np.int64), np.frombuffer(b["labels"], np.int64)
                scores = _scores(_matrix(anchors["code"], dims), np.frombuffer(b["codes"], f"<i{b['width']}").reshape(len(ids), dims).astype(np.int64))
                for own, row, anchor, label, asks in zip(scores, anchors["row"], anchors["id"], anchors["label"], anchors["asks"]):
                    open_to = np.flatnonzero(((labels == label) == same) & (ids != anchor))
                    s, i = own[open_to], ids[open_to]
                    for ask in asks:
                        at = np.flatnonzero((s >= ask["lo"]) & (s <= ask["hi"]))
                        if len(at) > k:
                            at = at[s[at] >= np.partition(s[at], len(at) - k)[len(at) - k]]
                        at = at[np.lexsort((i[at], ~s[at]))][:k]  # ~s falls as s grows, also for the least long
                        out += [(row, ask["slot"], int(x), int(y)) for x, y in zip(i[at], s[at])]
            return pd.DataFrame(out, columns=["row", "slot", "id", "score"]).astype({"row": "int64", "slot": "int32", "id": "int64", "score": "int64"})

        return run

    def search(self, anchors: DataFrame, k: int, same: bool) -> DataFrame:
        """For each ask (slot, lo, hi) of each of ``anchors(row, id, label, code, asks)``, the ``k`` rows of greatest score in lo to hi, ties by smaller id, of
        the anchor's label or of any other, never of the anchor's id: ``(row, slot, id, score)``. Exact.

        Rounds: every anchor visits its next clusters in order of upper bounds, skipping those all of whose possible scores lie outside its
        asks' windows. An ask with k results wants no less than its kth score, so an anchor is done once the next bound is strictly
        below that. Only the best k of each ask are carried on.
        """
        spark = anchors.sparkSession
        salts = max(1, -(-anchors.count() // GROUP))
        parts = F.broadcast(spark.createDataFrame(list(self.parts.items()), "cluster int, parts int"))
        best = Window.partitionBy("row", "slot").orderBy(F.desc("score"), "id")
        found, state, step = spark.createDataFrame([], FOUND), anchors.withColumn("visited", F.lit(0)), FIRST
        while True:
            full = found.groupBy("row", "slot").agg(F.count("*").alias("n"), F.min("score").alias("kth")).where(F.col("n") >= k)
            full = full.groupBy("row").agg(F.map_from_entries(F.collect_list(F.struct("slot", "kth"))).alias("kths"))  # one entry an ask
            asked = state.join(full, "row", "left").withColumn("asks", F.expr("transform(asks, a -> named_struct('slot', a.slot, 'lo', greatest(a.lo, kths[a.slot]), 'hi', a.hi))")).drop("kths")
            schema = f"{ROW}, asks {ASKS}, visited int, clusters array<int>"
            front = stored(asked.select("row", "id", "label", "code", "asks", "visited").mapInPandas(self._frontier(step), schema), "negatives-frontier")
            pairs = front.withColumn("cluster", F.explode("clusters")).drop("clusters")
            touched = [r[0] for r in pairs.select("cluster").distinct().collect()]  # CLUSTERS at most
            if not touched:
                return found
            pairs = pairs.join(parts, "cluster").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
            pairs = pairs.select("cluster", "part", F.pmod(F.xxhash64("row"), F.lit(salts)).cast("int").alias("salt"), "row", "id", "label", "code", "asks")
            blocks = self.blocks.where(F.col("cluster").isin(touched)).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
            keys = ["cluster", "part", "salt"]
            met = pairs.groupBy(*keys).cogroup(blocks.groupBy(*keys)).applyInPandas(self._meet(k, same), FOUND)
            found = stored(found.unionByName(met).withColumn("nth", F.row_number().over(best)).where(F.col("nth") <= k).drop("nth"), "negatives-found")
            state, step = front.where(F.col("visited") < len(self.centroids)).drop("clusters"), 4 * step


def mine(rows: DataFrame, anchor: Column, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100) -> DataFrame:
    """Hard negatives of the anchors among ``rows(id long, label long, code array<long>)``, where ``anchor`` marks the anchors by columns of these.

    An anchor's positives are its ``positives`` best rows of its own label; for each, its negatives are the ``negatives`` best rows of other labels whose
    score s holds ``low * p <= 100 * s <= high * p`` for the positive's score p. Scores are inner products with the anchor, ties go to smaller ids. Result:
    ``(anchor_id, positive_id, rank, negative_id, positive_score, negative_score)``, exact.

    Rows with a null id, label or code take no part; a repeated (id, label, code) counts once; rows of one id that differ otherwise
    are rows of their own, but none is a positive or negative of an anchor of its id. Shorter codes count as
    filled up with zeros. Scores beyond a long count as the nearest long. Fewer rows than asked for: all of them; none, or an empty table: no row.
    """
    spark = rows.sparkSession
    kept = rows.select("id", "label", "code").where("id is not null and label is not null and code is not null").distinct()
    kept = stored(kept.withColumn("row", F.monotonically_increasing_id()).select("row", "id", "label", "code"), "negatives-rows")
    asking = kept.where(anchor)
    empty = spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    if not asking.take(1):
        return empty
    lists = Lists(kept)
    every = F.array(F.struct(F.lit(0).alias("slot"), F.lit(LEAST).alias("lo"), F.lit(MOST).alias("hi")))
    order = Window.partitionBy("row").orderBy(F.desc("score"), "id")
    near = lists.search(asking.withColumn("asks", every), positives, same=True).select("row", F.row_number().over(order).alias("slot"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    p = "cast(positive_score as decimal(20, 0))"
    near = near.withColumns({"lo": F.expr(f"cast(ceil({p} * {low} / 100) as long)"), "hi": F.expr(f"cast(floor({p} * {high} / 100) as long)")}).where("lo <= hi")
    near = stored(near, "negatives-positives")
    asks = near.groupBy("row").agg(F.collect_list(F.struct("slot", "lo", "hi")).alias("asks"))  # an entry a positive
    found = lists.search(asking.join(asks, "row"), negatives, same=False)
    nth = F.row_number().over(Window.partitionBy("row", "slot").orderBy(F.desc("score"), "id"))
    far = found.select("row", "slot", nth.alias("rank"), F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    out = far.join(near, ["row", "slot"]).join(asking.select("row", F.col("id").alias("anchor_id")), "row")
    return out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
