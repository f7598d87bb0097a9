"""Operators on vectors against brute force, and on odd tables."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from storeglean.llm import hardneg, vptree, whitening
from storeglean.llm.vectors import finite

LABELLED = "vec_id long, label int, x array<bigint>, row string, score string"
PLAIN = "vec_id long, x array<double>, score string, bound int"


def vectors(n, d, seed, scale=100):
    rng = random.Random(seed)
    return [[rng.randrange(-scale, scale) for _ in range(d)] for _ in range(n)]


@pytest.mark.parametrize("scale", [3, 1000, 10**6, 5 * 10**7])
def test_products_are_exact(scale):
    a, b = (np.array(vectors(n, 1500, n, scale)) for n in (5, 7))
    wanted = a.astype(object) @ b.T.astype(object)
    assert (hardneg.products(a, b, hardneg.bound(a, b)) == wanted).all()


def test_products_to_the_edge_of_a_long():
    a = np.array([[(1 << 31) - 1, -(1 << 31)]])
    assert hardneg.products(a, a, hardneg.bound(a, a))[0, 0] == ((1 << 31) - 1) ** 2 + (1 << 62)
    with pytest.raises(OverflowError):
        hardneg.products(a, 2 * a, hardneg.bound(a, 2 * a))


def mined(rows, is_anchor, k=5, j=3):
    """Hard negatives of (id, label, x) rows by trying all pairs."""
    rows = sorted({(i, label, tuple(x)) for i, label, x in rows if None not in (i, label, x) and None not in x})
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=False))
    out = []
    for a in rows:
        if not is_anchor(a[0]):
            continue
        scored = sorted(((-dot(a[2], b[2]), b[0], b) for b in rows if b != a), key=lambda r: r[:2])
        for p, pid, _ in [s for s in scored if s[2][1] == a[1]][:k]:
            fits = [s for s in scored if s[2][1] != a[1] and -50 * p <= -100 * s[0] <= -95 * p][:j]
            out += [(a[0], pid, r, nid, -p, -n) for r, (n, nid, _) in enumerate(fits, 1)]
    return sorted(out)


@pytest.mark.parametrize("labels", [1, 2, 5])
def test_mine(spark, monkeypatch, labels):
    monkeypatch.setattr(hardneg, "ROWS", 16)
    monkeypatch.setattr(hardneg, "ANCHORS", 8)
    base = vectors(90, 4, 1, 6)  # few values: many ties
    rows = [(i, i * i % labels, x) for i, x in enumerate(base)]
    rows += rows[:20] + [(1000, None, base[0]), (None, 1, base[0]), (1001, 1, None), (1002, 1, [1, None, 1, 1]), (1003, 1, []), (1005, 0, [5, 5])]
    df = spark.createDataFrame([(*r, "a", "b") for r in rows], LABELLED)
    found = sorted(tuple(r) for r in hardneg.mine(df, F.col("vec_id") % 5 == 0).collect())
    assert found == mined(rows, lambda i: i % 5 == 0)


def test_mine_with_ids_that_repeat_and_empty(spark):
    rows = [(7, 0, [3, 3]), (7, 0, [3, 2]), (7, 1, [2, 2]), (8, 1, [2, 1])]
    df = spark.createDataFrame([(*r, "a", "b") for r in rows], LABELLED)
    found = hardneg.mine(df, F.col("vec_id") == 7).collect()
    assert {(r.positive_id, r.positive_score) for r in found} == {(7, 15)}  # both rows of label 0; [2, 2] and [2, 1] fit none
    assert hardneg.mine(df.limit(0), F.lit(True)).count() == 0
    with pytest.raises(Exception, match="may not fit"):
        big = spark.createDataFrame([(1, 0, [1 << 40], "", ""), (2, 0, [1 << 40], "", "")], LABELLED)
        hardneg.mine(big, F.lit(True)).collect()


def neighbours(rows, is_query, k):
    rows = sorted({(i, tuple(x)) for i, x in rows if i is not None and x and all(v is not None and math.isfinite(v) for v in x) and any(x)})
    out = []
    for q in rows:
        if is_query(q[0]):
            far = sorted((math.dist(q[1], b[1]), b[0]) for b in rows if b != q)[:k]
            out += [(q[0], rank, i, round(d, 9)) for rank, (d, i) in enumerate(far, 1)]
    return sorted(out)


@pytest.mark.parametrize("shard", [8, 64, 4096])
def test_nearest_is_exact_with_factor_one(spark, monkeypatch, shard):
    monkeypatch.setattr(vptree, "SLAB", 10)
    monkeypatch.setattr(vptree, "LEAF", 4)
    rows = [(i, [float(v) for v in x]) for i, x in enumerate(vectors(300, 3, 2, 5))]
    rows += [(400 + i, [1.0, 2.0, 3.0]) for i in range(60)] + rows[:30]  # one vector that many have; repeated rows
    inf, nan = float("inf"), float("nan")
    rows += [(None, [1.0, 1.0, 1.0]), (700, None), (701, []), (702, [0.0, 0.0, 0.0]), (703, [nan, 0.0, 1.0]), (704, [inf, 1.0, 1.0]), (705, [None, 1.0, 1.0])]
    df = spark.createDataFrame([(*r, "s", 1) for r in rows], PLAIN)
    found = vptree.nearest(df, F.col("vec_id") % 10 == 0, 6, shard=shard)
    assert sorted((r[0], r[1], r[2], round(r[3], 9)) for r in found.collect()) == neighbours(rows, lambda i: i % 10 == 0, 6)


def test_factor_trades_recall_for_distances():
    """Points in clusters: a larger factor looks at fewer points; up to 2 hardly any neighbour is missed."""
    rng = np.random.default_rng(3)
    points = (rng.standard_normal((40, 8))[:, None] * 4 + rng.standard_normal((40, 50, 8))).reshape(-1, 8)
    order, nodes = vptree.build(points)
    queries = points[::20]
    own = np.arange(0, len(points), 20)
    every = np.full(len(queries), np.inf)
    true = vptree.distances(queries, points)
    true[np.arange(len(queries)), own] = np.inf
    wanted = np.sort(true, 1)[:, :10]
    seen, recall = [], []
    for factor in (1.0, 1.5, 3.0):
        found = vptree.Search(points, order, nodes, queries, 10, factor, every, own)
        seen.append(found.seen)
        recall.append((found.score <= wanted[:, -1:]).mean())
        assert (found.place != own[:, None]).all()
    assert recall[0] == 1 and recall[1] > 0.9 and seen[0] > seen[1] > seen[2]
    assert seen[0] < 0.8 * len(queries) * len(points)


def test_nearest_odd_tables(spark):
    df = spark.createDataFrame([(0, [1.0], "s", 1), (1, [2.0, 2.0], "s", 1)], PLAIN)
    assert [tuple(r) for r in vptree.nearest(df, F.col("vec_id") == 0).collect()] == [(0, 1, 1, math.sqrt(5))]
    assert vptree.nearest(df.limit(0), F.lit(True)).count() == 0
    assert vptree.nearest(df.limit(1), F.lit(True)).count() == 0
    with pytest.raises(ValueError, match="factor"):
        vptree.nearest(df, F.lit(True), factor=0.5)


def symmetric(values, seed=0):
    turn = np.linalg.qr(np.random.default_rng(seed).standard_normal((len(values),) * 2))[0]
    return turn @ np.diag(np.array(values, float)) @ turn.T


@pytest.mark.parametrize(
    "values",
    [
        list(np.linspace(1, 2, 40)),
        [3.0] * 12,
        [5, 5, 5, 2, 2, 1, 0, 0, 0, 0],
        [1e6, 1e3, *np.linspace(1, 2, 20)],
        [9, 4, 4 - 1e-9, 4 - 2e-9, 1, 1, 1, 1, 1, 1],
        [2.0],
        [0.0, 0.0],
    ],
)
def test_components_against_a_dense_solver(spark, values):
    v = symmetric(values)
    found, vectors_ = whitening.components(spark, v, 8)
    wanted = np.sort(values)[::-1][:8]
    wanted = wanted[wanted > 1e-12]
    assert np.allclose(found, wanted, rtol=1e-9, atol=1e-12)
    assert np.allclose(vectors_.T @ vectors_, np.eye(len(found)), atol=1e-12)
    assert np.allclose(v @ vectors_, vectors_ * found, atol=1e-12 * max(1, max(values)))


def test_inertia_counts():
    v = symmetric([1, 2, 2, 3, 10])
    counts = [whitening.above(*whitening.tridiagonal(v), s) for s in (0, 1.5, 2.5, 5, 11)]
    assert counts == [5, 4, 2, 1, 0]


WHITE = "vec_id long, x array<bigint>, n string, component int"


def test_whiten(spark):
    x = np.array(vectors(200, 12, 5, 1000)) * np.arange(1, 13) + 10**6
    rows = [(i, [int(v) for v in r]) for i, r in enumerate(x)]
    odd = [(None, rows[0][1]), (0, rows[0][1]), (300, None), (301, [1, None])]
    df = spark.createDataFrame([(*r, "n", 1) for r in rows + odd], WHITE).repartition(5)
    out = whitening.whiten(df).toPandas()
    held = np.vstack([x, x[:1], x[:1]])
    n, sums = len(held), held.sum(0)
    centred = held - sums / n
    values, turn = np.linalg.eigh(centred.T @ centred / n)
    assert len(out) == 8 * n and (out.n == n).all() and (out.identity_error <= 1e-9).all()
    one = out[out.vec_id == 5].sort_values("component")
    assert one.deviation.iloc[0] == ((n * held[5] - sums) ** 2).sum()
    wanted = centred[5] @ turn[:, ::-1][:, :8] / np.sqrt(values[::-1][:8])
    assert np.allclose(np.abs(one.whitened), np.abs(wanted), atol=1e-9)
    assert np.allclose(one.explained, values[::-1][:8] / values.sum())
    wide = out[out.vec_id.notna()].drop_duplicates(["vec_id", "component"]).pivot(index="vec_id", columns="component", values="whitened")
    assert np.allclose(np.cov(wide.values.T, bias=True), np.eye(8), atol=0.05)


def test_whiten_odd_tables(spark):
    df = spark.createDataFrame([(1, [5, 5], "n", 1), (2, [5, 5], "n", 1), (3, None, "n", 1)], WHITE)
    assert whitening.whiten(df).count() == 0  # no direction with variance
    assert whitening.whiten(df.limit(0)).columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    short = spark.createDataFrame([(1, [4], "n", 1), (2, [0, 2], "n", 1), (3, [], "n", 1)], WHITE)
    out = whitening.whiten(short).toPandas()
    x = np.array([[4, 0], [0, 2], [0, 0]])
    assert out[out.vec_id == 1].deviation.iloc[0] == ((3 * x[0] - x.sum(0)) ** 2).sum() and out.component.max() == 2
    large = spark.createDataFrame([(i, [i * 10**12, 10**15], "n", 1) for i in range(4)], WHITE)
    out = whitening.whiten(large).toPandas()
    assert out.deviation.isna().all() and np.allclose(sorted(np.abs(out.whitened)), [0.4472136, 0.4472136, 1.3416408, 1.3416408])


def test_finite(spark):
    df = spark.createDataFrame([([1.0],), ([None],), ([float("nan")],), ([float("-inf")],), (None,), ([],)], "v array<float>")
    assert [r[0] for r in df.select(finite("v")).collect()] == [True, False, False, False, False, True]
