"""Operator 11 against brute force."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from tests import oracle

from wrenchlake.llm import negatives, queries

SF01 = "/root/testdata/sf0.01"


def plain(rows, is_anchor, positives=5, most=5, low=80, high=100):
    """All pairs, by loops; ``rows`` of (id, label, code), repeated ones once."""
    rows = sorted({(i, label, tuple(c)) for i, label, c in rows if None not in (i, label, c)})
    out = []
    for i, label, c in rows:
        if is_anchor(i):
            dot = lambda x: max(negatives.LEAST, min(negatives.MOST, sum(int(a) * int(b) for a, b in zip(c, x, strict=False))))
            scored = sorted((-dot(x), j, y) for j, y, x in rows if j != i)
            for s, j, _ in [x for x in scored if x[2] == label][:positives]:
                far = [x for x in scored if x[2] != label and low * -s <= 100 * -x[0] <= high * -s][:most]
                out += [(i, j, n, x[1], -s, -x[0]) for n, x in enumerate(far, 1)]
    return sorted(out)


def mined(spark, rows, every=10, **more):
    df = spark.createDataFrame(rows, "id long, label long, code array<long>")
    return sorted(map(tuple, negatives.mine(df, F.col("id") % every == 0, **more).collect()))


def test_query_equals_sql(spark):
    got = queries.QUERIES["op11_hard_negatives"](spark, SF01).toPandas()
    want = oracle.connect(SF01).sql(queries.ORACLE_SQL["op11_hard_negatives"]).df()
    assert len(want) > 0
    oracle.same(got, want)


@pytest.mark.parametrize("spread", [3, 40, 4000])
def test_clustered_rows_equal_brute_force(spark, spread):
    rng = np.random.default_rng(spread)
    centres = rng.integers(-900, 900, (8, 6))
    rows = [(i, int(rng.integers(0, 3)), (centres[i % 8] + rng.integers(-spread, spread + 1, 6)).tolist()) for i in range(700)]
    got = mined(spark, rows)
    assert got and got == plain(rows, lambda i: i % 10 == 0)


def test_small_blocks_groups_and_ties(spark, monkeypatch):
    monkeypatch.setattr(negatives, "BLOCK", 9)
    monkeypatch.setattr(negatives, "GROUP", 4)
    monkeypatch.setattr(negatives, "FIRST", 1)
    rng = random.Random(11)
    rows = [(i, rng.randint(0, 2), [rng.randint(-3, 3) for _ in range(3)]) for i in range(260)]
    rows += [(1000 + i, rng.randint(0, 1), [2, 2, 2]) for i in range(130)]  # one vector of a third of all rows
    got = mined(spark, rows)
    assert got == plain(rows, lambda i: i % 10 == 0)
    got = mined(spark, rows, positives=2, negatives=9, low=50, high=90)
    assert got == plain(rows, lambda i: i % 10 == 0, 2, 9, 50, 90)


def test_odd_rows(spark):
    rows = [(10, 1, [3, 4]), (10, 1, [3, 4]), (10, 2, [1, 1]), (None, 1, [3, 4]), (11, None, [3, 4]), (12, 1, None), (13, 1, []), (14, 2, [5]), (15, 2, [3, 4, 5]), (16, 1, [3, 5]), (17, 1, [-3, -5]), (20, 1, [0, 0])]
    rows += [(30 + i, i % 2, [(1 << 61) + i, -7, 1]) for i in range(4)]  # products beyond a long
    assert mined(spark, rows) == plain(rows, lambda i: i is not None and i % 10 == 0)
    assert mined(spark, []) == [] and mined(spark, [(1, 1, [1])]) == [] and mined(spark, [(10, 1, [1])]) == [] and mined(spark, [(10, 1, []), (20, 1, []), (21, 2, [])]) == plain([(10, 1, []), (20, 1, []), (21, 2, [])], lambda i: i % 10 == 0)


def test_scaling(spark):
    rows = [([0.1, -0.1, 0.0],), ([float("nan")],), ([float("inf"), 1.0],), ([1.0, None],), (None,), ([],), ([1e30],)]
    got = [r[0] for r in spark.createDataFrame(rows, "v array<float>").select(negatives.scaled("v")).collect()]
    assert got == [[25, -26, 0], None, None, None, None, [], [(1 << 63) - 1]]


def test_bounds_hold_and_clusters_are_skipped(spark):
    rng = np.random.default_rng(5)
    centres = rng.integers(-5000, 5000, (12, 8))
    rows = [(i, int(i % 3), (centres[i % 12] + rng.integers(-9, 10, 8)).tolist()) for i in range(600)]
    kept = negatives.stored(spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "row long, id long, label long, code array<long>"), "test-rows")
    lists = negatives.Lists(kept)
    assert sum(r.n for r in lists.blocks.collect()) == 600
    codes = np.array([r[2] for r in rows])
    low, high = lists.bounds(codes[:50])
    for b in lists.blocks.collect():
        members = np.frombuffer(b.codes, f"<i{b.width}").reshape(b.n, 8).astype(np.int64)
        scores = codes[:50] @ members.T
        assert (scores.max(axis=1) <= high[:, b.cluster]).all() and (scores.min(axis=1) >= low[:, b.cluster]).all()
    best = np.sort(codes[:50] @ codes.T, axis=1)[:, -5]
    assert (high >= best[:, None]).mean() < 0.5  # an anchor is done without half of the clusters
