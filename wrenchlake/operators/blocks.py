"""Blocks of queries against parts of the items: similarities are computed a tile at a time, and only the rows or sums that are asked for leave a task."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, StructType

from wrenchlake.functions import vectors as V
from wrenchlake.shared import kept

#: Components that one block of queries or one part of the items holds (16 384 vectors of 64): 8 MB, a few copies of which a task has at a time.
COMPONENTS = 2**20
#: Similarities of a tile.
TILE = 2**19
#: Of so many similarities only the greatest is looked at when a query's least is sought.
RUN = 32
#: Of a tile's similarities, the rows of items and the queries as columns: the matrix by which pairs are ranked. NaN leaves a pair out.
View = Callable[[np.ndarray, "Columns", "Columns"], np.ndarray]


class Columns:
    """Columns of a table by name as numpy arrays, laid along the rows or the columns of a tile. Missing numbers are NaN, other missing values None."""

    def __init__(self, table: pa.Table, along_rows: bool):
        self.table, self.along_rows, self._held = table, along_rows, {}

    def __getitem__(self, name: str) -> np.ndarray:
        if name not in self._held:
            values = self.table[name].combine_chunks().to_numpy(zero_copy_only=False)
            self._held[name] = values[:, None] if self.along_rows else values[None, :]
        return self._held[name]


def same(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Where both are known and equal."""
    return (a == b) & ~(pd.isna(a) | pd.isna(b))


def differ(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Where both are known and not equal."""
    return (a != b) & ~(pd.isna(a) | pd.isna(b))


def filled(x: np.ndarray, value: float) -> np.ndarray:
    """Numbers with ``value`` for those that are missing."""
    return np.where(pd.isna(x), value, x).astype(float)


def clamp(x: np.ndarray) -> np.ndarray:
    """I37, as ``vectors.clamp``: to [0, 1]; a missing or undefined similarity (infinite here) becomes 0."""
    out, odd = np.clip(x, 0.0, 1.0), ~np.isfinite(x)
    return np.where(odd, 0.0, out) if odd.any() else out


def similarity(score: np.ndarray, item: Columns, query: Columns) -> np.ndarray:
    """The view that ranks by the similarity itself."""
    return score


def where(kept: Callable[[Columns, Columns], np.ndarray], view: View = similarity) -> View:
    """``view`` of the pairs that are ``kept``."""
    return lambda score, item, query: np.where(kept(item, query), view(score, item, query), np.nan)


def _vectors(table: pa.Table) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """By size of the vectors in ``__unit``: their rows, a matrix of them, and which have missing components."""
    units = table["__unit"].combine_chunks()
    sizes, values = pc.list_value_length(units).to_numpy(zero_copy_only=False), units.flatten()
    starts = np.concatenate([[0], np.cumsum(np.nan_to_num(sizes).astype(np.int64))])[:-1]
    flat = values.to_numpy(zero_copy_only=False).astype(float, copy=False)
    gaps = values.is_null().to_numpy(zero_copy_only=False)
    out = {}
    for n in np.unique(sizes[~np.isnan(sizes)] if sizes.dtype.kind == "f" else sizes).astype(int).tolist():
        rows = np.flatnonzero(sizes == n)
        at = starts[rows][:, None] + np.arange(n)[None, :]
        out[n] = rows, flat[at], gaps[at].any(axis=1)
    return out


def _dots(queries: np.ndarray, items: np.ndarray) -> np.ndarray:
    """Inner products, added up component by component as ``vectors.dot`` does: equal vectors have equal products wherever they lie. ``items`` has a row a component."""
    out = np.zeros((len(queries), items.shape[1]))
    step = max(1, 2**16 // max(1, len(queries)))  # what stays in the cache
    for a in range(0, items.shape[1], step):
        part = out[:, a : a + step]
        product = np.empty_like(part)
        for x, y in zip(queries.T, items[:, a : a + step], strict=True):
            np.multiply(x[:, None], y[None, :], out=product)
            part += product
    return out


def _slack(queries: np.ndarray, items: np.ndarray, longest: float | None = None) -> float:
    """More than a matrix product and ``_dots`` can differ; ``longest`` is the greatest squared length of the items, if it is known."""
    longest = (items**2).sum(axis=0).max() if longest is None else longest
    length = np.sqrt(max((queries**2).sum(axis=1).max(), 1.0) * max(longest, 1.0))
    return 8 * (len(items) + 1) * np.finfo(float).eps * length


def _pairs(queries: np.ndarray, items: np.ndarray, q: np.ndarray, i: np.ndarray) -> np.ndarray:
    """What ``_dots`` has at rows ``q`` and columns ``i``."""
    score = np.zeros(len(q))
    for x, y in zip(queries.T, items, strict=True):
        score += x[q] * y[i]
    return score


def _ranked(keys: np.ndarray) -> np.ndarray:
    """``keys`` with -inf for NaN."""
    return np.fmax(keys, -np.inf) if keys.size and np.isnan(keys.max()) else keys


def _seen(view: View, score: np.ndarray, q: np.ndarray, i: np.ndarray, item: Columns, query: Columns) -> np.ndarray:
    """What ``view`` has at rows ``q`` and columns ``i``, of whose similarities ``score`` is the list."""
    if view is similarity:
        return score
    return np.broadcast_to(view(score[None, :], Columns(item.table.take(i), along_rows=False), Columns(query.table.take(q), along_rows=False)), (1, len(score)))[0]


def greatest(queries: np.ndarray, items: np.ndarray, k: int, view: View = similarity, item: Columns | None = None, query: Columns | None = None, longest: float | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows, columns and similarities of what ``_best`` keeps of ``view`` of ``_dots``, all numbers being finite. ``view`` is steady: as ``nearest`` says.

    A matrix product, which rounds by where a vector lies, only tells which pairs can't be among the ``k`` best: they lie below ``k`` others by more than both
    ways of adding up can differ. The others' products are added up as ``_dots`` does, and these are ranked.
    """
    rough = queries @ items
    if view is not similarity:
        rough = _ranked(view(rough, item, query))
    n, m = rough.shape
    runs = m // RUN
    if runs >= 4 * k:  # k runs have a greatest value of at least that, so k pairs have
        tops = rough[:, : runs * RUN].reshape(n, RUN, runs).max(axis=1)
        least = np.partition(tops, runs - k, axis=1)[:, runs - k]
    else:
        least = np.partition(rough, m - k, axis=1)[:, m - k] if m > k else np.full(n, -np.inf)
    q, i = np.nonzero(rough >= (least - _slack(queries, items, longest))[:, None])
    score = _pairs(queries, items, q, i)
    value = _seen(view, score, q, i, item, query)
    order = np.lexsort((i, -value, q))
    order = order[~np.isnan(value[order])]
    q, i, score = q[order], i[order], score[order]
    first = np.arange(len(q)) - np.searchsorted(q, q) < k
    return q[first], i[first], score[first]


#: A tile's rows by themselves: what is to be made of the queries' units, the items' (a row a component), their greatest squared length and both tables' columns.
Plain = Callable[[np.ndarray, np.ndarray, float, "Columns", "Columns"], pa.Table]


def met(items: DataFrame, queries: DataFrame, of: Callable[[np.ndarray, Columns, Columns], pa.Table], schema: StructType | str, plain_of: Plain | None = None, components: int | None = None, order: tuple[str, ...] = ("id",)) -> DataFrame:
    """The rows that ``of`` makes of every tile of similarities between ``queries(query_id, query_vec, ...)`` and ``items(id, vec, ...)``.

    Both are dealt by a hash: queries into blocks, items into parts, of ``components`` (``COMPONENTS``) each, and every block meets every part in a task. A tile has
    some queries as rows and the part's items in the ``order`` of these columns, their ids, as columns; a similarity with missing components is -inf, an undefined one inf.
    Vectors of other sizes than the query's are left out, as in ``retrieval.similarities``. Tiles whose numbers are all finite go to ``plain_of`` instead, if it is given.
    """
    size = lambda df, c: df.agg(F.count("*").alias("n"), F.coalesce(F.max(F.size(c)), F.lit(1)).alias("d")).first()
    many = lambda r: max(1, -(-r["n"] * max(1, r["d"]) // (components or COMPONENTS)))
    blocks, parts = many(size(queries, "query_vec")), many(size(items, "vec"))
    dealt = lambda key, n: F.pmod(F.xxhash64(key), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    q = queries.withColumn("__unit", V.normalize(F.col("query_vec"))).drop("query_vec").withColumn("__block", dealt("query_id", blocks)).withColumn("__part", every(parts))
    i = items.withColumn("__unit", V.normalize(F.col("vec"))).drop("vec").withColumn("__part", dealt("id", parts)).withColumn("__block", every(blocks))
    tile = TILE

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        left = left.take(pc.sort_indices(left, sort_keys=[(c, "ascending") for c in order], null_placement="at_start"))
        of_items, found = _vectors(left), []
        plain = left.drop_columns(["__unit", "__block", "__part"]), right.drop_columns(["__unit", "__block", "__part"])
        for n, (rows, units, gaps) in _vectors(right).items():
            if n not in of_items:
                continue
            own, matrix, own_gaps = of_items[n]
            columns, item = np.ascontiguousarray(matrix.T), Columns(plain[0].take(own), along_rows=False)
            step = max(1, tile // len(own))
            finite = plain_of is not None and not own_gaps.any() and np.isfinite(matrix).all()
            longest = (matrix**2).sum(axis=1).max() if finite else 0.0
            for a in range(0, len(rows), step):
                if finite and not gaps[a : a + step].any() and np.isfinite(units[a : a + step]).all():
                    found.append(plain_of(units[a : a + step], columns, longest, item, Columns(plain[1].take(rows[a : a + step]), along_rows=True)))
                    continue
                score = _dots(units[a : a + step], columns)
                score[np.isnan(score)] = np.inf
                score[:, own_gaps] = -np.inf
                score[gaps[a : a + step]] = -np.inf
                found.append(of(score, item, Columns(plain[1].take(rows[a : a + step]), along_rows=True)))
        return pa.concat_tables(found) if found else None

    def safe(left: pa.Table, right: pa.Table) -> pa.Table:
        out = run(left, right) if len(left) and len(right) else None
        return empty if out is None else out

    from pyspark.sql.pandas.types import to_arrow_schema

    kind = to_arrow_schema(items.sparkSession.createDataFrame([], schema).schema)
    empty = kind.empty_table()
    # tasks of few bytes take long here, so that adaptive execution mustn't pack them by bytes
    tasks = min(2 * blocks * parts, int(items.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    met_in = lambda df: df.repartition(tasks, "__block", "__part").groupBy("__block", "__part")
    return met_in(i).cogroup(met_in(q)).applyInArrow(safe, schema)


def _best(keys: np.ndarray, k: int) -> np.ndarray:
    """Which of each row's entries are its ``k`` greatest, ties to the first; NaN never is."""
    if keys.shape[1] <= k:
        return ~np.isnan(keys)
    least = -np.partition(-keys, k - 1, axis=1)[:, k - 1 : k]  # NaN come last
    chosen = (keys >= least) | (np.isnan(least) & ~np.isnan(keys))
    for r in np.flatnonzero(chosen.sum(axis=1) > k):
        at = np.flatnonzero(chosen[r])
        ties = at[keys[r, at] == least[r]]
        chosen[r, ties[k - (len(at) - len(ties)) :]] = False
    return chosen


def nearest(items: DataFrame, queries: DataFrame, k: int, *views: View, steady: bool = False) -> DataFrame:
    """Pairs ``(query_id, items' columns without vec, score, by_view)`` among which are, for every view (by default the similarity), the ``k`` best of each query, ties to smaller ids.

    Each task keeps the best of its block and part, so ``k`` rows a query, part and view are left; the exact ranking of these is the caller's. Views calculate
    in the order of the expression that ranks afterwards, so that both round alike. Other columns of ``queries`` are only seen by views. ``by_view``
    is an array of whether each view took the row. A single view is ``steady`` if its numbers are of the similarity's size and, for any pair, move by no more than the
    similarity does: then most pairs are left out by a matrix product (``greatest``).
    """
    views = views or (similarity,)
    fields = [f for f in items.schema.fields if f.name != "vec"]
    schema = StructType([queries.schema["query_id"], *fields]).add("score", "double").add("by_view", ArrayType(BooleanType()))
    names = [f.name for f in fields]

    def rows(q: np.ndarray, i: np.ndarray, found: pa.Array, flags: np.ndarray, item: Columns, query: Columns) -> pa.Table:
        by_view = pa.ListArray.from_arrays(np.arange(0, flags.size + 1, len(views), dtype=np.int32), pa.array(flags.ravel()))
        taken = item.table.take(i)
        return pa.Table.from_arrays([query.table["query_id"].take(q), *[taken[n] for n in names], found, by_view], names=["query_id", *names, "score", "by_view"])

    def of(score: np.ndarray, item: Columns, query: Columns) -> pa.Table:
        chosen = [_best(view(score, item, query), k) for view in views]
        q, i = np.nonzero(np.logical_or.reduce(chosen))
        found = score[q, i]
        found = pa.array(np.where(np.isinf(found), np.nan, found), mask=found == -np.inf)
        return rows(q, i, found, np.stack([c[q, i] for c in chosen], axis=1), item, query)

    def plain_of(units: np.ndarray, columns: np.ndarray, longest: float, item: Columns, query: Columns) -> pa.Table:
        q, i, found = greatest(units, columns, k, views[0], item, query, longest)
        return rows(q, i, pa.array(found), np.ones((len(q), 1), bool), item, query)

    return met(items, queries, of, schema, plain_of if views == (similarity,) or steady and len(views) == 1 else None)


def best_of_groups(items: DataFrame, queries: DataFrame, group: str, view: View) -> DataFrame:
    """Pairs ``(query_id, items' columns without vec, score)`` among which are, of each query and value of the items' column ``group`` (none is a value too), the best by the steady
    ``view`` (as ``nearest`` says), then by similarity, then of smaller id. A row a query, group and part is left; the exact ranking of these is the caller's.
    """
    fields = [f for f in items.schema.fields if f.name != "vec"]
    schema = StructType([queries.schema["query_id"], *fields]).add("score", "double")

    def best(keys: np.ndarray, slack: float, item: Columns, query: Columns, exact: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> pa.Table:
        """The best by ``exact`` similarities at rows and columns, among pairs whose ``keys`` are less than a group's greatest by ``slack`` at most."""
        codes = item.table[group].combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy()
        starts = np.flatnonzero(np.diff(codes, prepend=-1))  # items lie in the order of groups
        keys = _ranked(keys)
        least = np.maximum.reduceat(keys, starts, axis=1) - slack
        q, i = np.divmod(np.flatnonzero(keys >= np.repeat(least, np.diff(starts, append=len(codes)), axis=1)), len(codes))
        score = exact(q, i)
        value = _seen(view, score, q, i, item, query)
        order = np.lexsort((i, -score, -value, codes[i], q))
        order = order[~np.isnan(value[order])]
        q, i, score = q[order], i[order], score[order]
        first = (np.diff(q, prepend=-1) != 0) | (np.diff(codes[i], prepend=-1) != 0)
        q, i, score = q[first], i[first], score[first]
        taken = item.table.take(i)
        found = pa.array(np.where(np.isinf(score), np.nan, score), mask=score == -np.inf)
        return pa.Table.from_arrays([query.table["query_id"].take(q), *[taken[f.name] for f in fields], found], names=["query_id", *[f.name for f in fields], "score"])

    def of(score: np.ndarray, item: Columns, query: Columns) -> pa.Table:
        return best(view(score, item, query), 0.0, item, query, lambda q, i: score[q, i])

    def plain_of(units: np.ndarray, columns: np.ndarray, longest: float, item: Columns, query: Columns) -> pa.Table:
        return best(view(units @ columns, item, query), _slack(units, columns, longest), item, query, lambda q, i: _pairs(units, columns, q, i))

    return met(items, queries, of, schema, plain_of, order=(group, "id"))


def exceeding(items: DataFrame, queries: DataFrame, least: float, own: str) -> DataFrame:
    """Pairs ``(query_id, items' columns without vec, score)`` where the greater of the similarity and the item's ``own`` number is more than ``least``; ``score`` is that number.
    As with Spark's ``greatest``, a missing one doesn't count and an undefined one is greater than any.

    These can be as many as all pairs. So blocks and parts are smaller here, and what a task has found goes on a tile at a time. Only pairs whose similarity may count are added up.
    """
    fields = [f for f in items.schema.fields if f.name != "vec"]
    schema = StructType([queries.schema["query_id"], *fields]).add("score", "double")

    def rows(q: np.ndarray, i: np.ndarray, score: np.ndarray, item: Columns, query: Columns) -> pa.Table:
        taken = item.table.take(i)
        return pa.Table.from_arrays([query.table["query_id"].take(q), *[taken[f.name] for f in fields], pa.array(score)], names=["query_id", *[f.name for f in fields], "score"])

    def of(score: np.ndarray, item: Columns, query: Columns) -> pa.Table:
        value = np.maximum(score, filled(item[own], -np.inf))
        q, i = np.nonzero(value > least)
        value = value[q, i]
        return rows(q, i, np.where(np.isinf(value), np.nan, value), item, query)

    def plain_of(units: np.ndarray, columns: np.ndarray, longest: float, item: Columns, query: Columns) -> pa.Table:
        base = filled(item[own], -np.inf)[0]
        bound = np.maximum(base, least)
        q, i = np.nonzero(units @ columns > bound - _slack(units, columns, longest))
        score = _pairs(units, columns, q, i)
        above = score > bound[i]
        q, i, score = q[above], i[above], score[above]
        always = np.flatnonzero(base > least)  # items that count with every query
        value = np.tile(base[always], (len(units), 1))
        inside = base[i] > least
        value[q[inside], np.searchsorted(always, i[inside])] = score[inside]
        q = np.concatenate([np.repeat(np.arange(len(units)), len(always)), q[~inside]])
        return rows(q, np.concatenate([np.tile(always, len(units)), i[~inside]]), np.concatenate([value.ravel(), score[~inside]]), item, query)

    return met(items, queries, of, schema, plain_of, max(1, COMPONENTS // 4))


def spread(items: DataFrame, queries: DataFrame) -> DataFrame:
    """``(query_id, top, z, n)``: of each query the greatest similarity, the sum of exp(similarity - top) and the number of its similarities."""

    def of(score: np.ndarray, item: Columns, query: Columns) -> pa.Table:
        top = score.max(axis=1)
        z = np.exp(score - top[:, None]).sum(axis=1)
        return pa.Table.from_arrays([query.table["query_id"], pa.array(top), pa.array(z), pa.array(np.full(len(top), score.shape[1]))], names=["query_id", "top", "z", "n"])

    schema = StructType([queries.schema["query_id"]]).add("top", "double").add("z", "double").add("n", "long")
    each = kept(met(items.select("id", "vec"), queries.select("query_id", "query_vec"), of, schema), "spread")  # a row a query and part
    top = each.groupBy("query_id").agg(F.max("top").alias("all_top"))
    return each.join(top, "query_id").groupBy("query_id").agg(F.max("all_top").alias("top"), F.sum(F.col("z") * F.exp(F.col("top") - F.col("all_top"))).alias("z"), F.sum("n").alias("n"))


def entropies(items: DataFrame, queries: DataFrame) -> DataFrame:
    """``(query_id, h)``: the softmax entropy in bits of all similarities of each of ``queries(query_id, query_vec, top, z)``."""

    def of(score: np.ndarray, item: Columns, query: Columns) -> pa.Table:
        p = np.exp(score - query["top"]) / query["z"]
        return pa.Table.from_arrays([query.table["query_id"], pa.array(-(p * np.log2(p + 1e-10)).sum(axis=1))], names=["query_id", "h"])

    found = met(items.select("id", "vec"), queries.select("query_id", "query_vec", "top", "z"), of, StructType([queries.schema["query_id"]]).add("h", "double"))
    return found.groupBy("query_id").agg(F.sum("h").alias("h"))


def counted_ahead(items: DataFrame, queries: DataFrame, most: int) -> DataFrame:
    """``(query_id, nth, ahead)``: how many items of each of ``queries(query_id, query_vec, score_1, id_1, ...)`` come before its nth place by similarity, then id."""

    def of(score: np.ndarray, item: Columns, query: Columns) -> pa.Table:
        ids = item["id"]
        ahead = [((score > query[f"score_{k}"]) | ((score == query[f"score_{k}"]) & (ids < query[f"id_{k}"]))).sum(axis=1) for k in range(1, most + 1)]
        n = len(score)
        return pa.Table.from_arrays([pa.concat_arrays(query.table["query_id"].chunks * most), pa.array(np.repeat(np.arange(1, most + 1, dtype=np.int32), n)), pa.array(np.concatenate(ahead).astype(np.int64))], names=["query_id", "nth", "ahead"])

    found = met(items.select("id", "vec"), queries, of, StructType([queries.schema["query_id"]]).add("nth", "integer").add("ahead", "long"))
    return found.groupBy("query_id", "nth").agg(F.sum("ahead").alias("ahead"))
