"""Whitening of embeddings by components that contour integration extracts from their covariance.

The covariance is summed exactly, in integers, over all rows. Its largest eigenvalues are shut into intervals by inertia
counts (the signs of the pivots of the shifted matrix). For each interval, solves of the complex shifted covariance at the
nodes of a quadrature around it project a block of vectors onto the eigenvectors inside; Rayleigh-Ritz on the projected block
gives these. That is repeated until the residuals vanish and each interval holds as many as the inertia says. The solves of
all intervals and nodes are independent: each is a row of a Spark job.
"""

from __future__ import annotations

from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from storeglean.llm.common import table
from storeglean.llm.vectors import finite, matrix

COMPONENTS = 8
#: Quadrature nodes on the upper half of a circle, rounds at most, extra vectors in a block.
NODES, ROUNDS, EXTRA = 8, 12, 6
#: Eigenvalues nearer to each other than the share NEAR of themselves, or CLOSE of the largest one, are one interval's; those
#: under FLAT of that are zero.
NEAR, CLOSE, FLAT = 1e-4, 1e-10, 1e-13
RESIDUAL = 5e-14
_PARTS = "i int, j int, s decimal(38,0)"


@dataclass
class Moments:
    """n, the sums of the dimensions, and the covariance (divisor n), from exact sums."""

    n: int
    sums: list[int]
    covariance: np.ndarray


def _summed(centre: list[int] | None):
    """Sums over a partition, as (i, j, s): for j = -1 of dimension i, else of the product of i and j less the centre; the
    number of rows is at i = -1."""

    def parts(batches):
        total, n = np.zeros(0 if centre is None else (len(centre),) * 2, object), 0
        for batch in batches:
            n += batch.num_rows
            if centre is None:
                x = matrix(batch.column("x"), np.int64, len(total))
                total = np.pad(total, (0, x.shape[1] - len(total))) + (x.astype(object) if _large(x, 1) else x).sum(0).astype(object)
            else:
                y = matrix(batch.column("x"), np.int64, len(centre)) - np.array(centre, np.int64)
                y = y.astype(object) if _large(y, 2) else y
                total = total + (y.T @ y).astype(object)
        if not n:
            return
        if centre is None:
            cells = [(-1, -1, n), *((i, -1, int(s)) for i, s in enumerate(total))]
        else:
            cells = [(i, j, int(total[i, j])) for i in range(len(centre)) for j in range(i + 1)]
        i, j, s = zip(*cells, strict=True)
        yield pa.record_batch({"i": pa.array(i, pa.int32()), "j": pa.array(j, pa.int32()), "s": pa.array(s, pa.decimal128(38, 0))})

    return parts


def _large(x: np.ndarray, power: int) -> bool:
    """Whether a sum of such powers may leave the longs."""
    return bool(x.size) and len(x) * max(abs(int(x.max())), abs(int(x.min()))) ** power >= 1 << 62


def moments(rows: DataFrame) -> Moments:
    """The exact moments of x (an array of longs). A row for each task and pair of dimensions is summed by Spark; what comes to
    the driver is as large as the covariance."""
    narrow = rows.select("x")

    def added(centre: list[int] | None) -> dict[tuple[int, int], int]:
        each = narrow.mapInArrow(_summed(centre), _PARTS)
        return {(r["i"], r["j"]): int(r["s"]) for r in each.groupBy("i", "j").agg(F.sum("s").alias("s")).collect()}

    first = added(None)
    n = first.get((-1, -1), 0)
    width = len(first) - 1 if n else 0
    sums = [first[i, -1] for i in range(width)]
    if not width:
        return Moments(n, [], np.zeros((0, 0)))
    # whole numbers next to the means: what they leave over is taken out exactly
    centre = [(2 * s + n) // (2 * n) for s in sums]
    rest = [s - n * c for s, c in zip(sums, centre, strict=True)]
    second = added(centre)
    covariance = np.zeros((width, width))
    for (i, j), s in second.items():
        covariance[i, j] = covariance[j, i] = float(Fraction(n * s - rest[i] * rest[j], n * n))
    return Moments(n, sums, covariance)


def tridiagonal(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The diagonal and the side of a tridiagonal matrix with the eigenvalues of a symmetric one, by reflections."""
    a = a.copy()
    for k in range(len(a) - 2):
        x = a[k + 1 :, k].copy()
        x[0] += np.copysign(np.linalg.norm(x), x[0])
        norm = np.linalg.norm(x)
        if norm == 0:
            continue
        v = np.zeros(len(a))
        v[k + 1 :] = x / norm
        a -= 2 * np.outer(v, v @ a)
        a -= 2 * np.outer(a @ v, v)
    return np.diag(a).copy(), np.diag(a, 1).copy()


def above(diagonal: np.ndarray, side: np.ndarray, shift: float) -> int:
    """How many eigenvalues are over `shift`: the positive pivots of the shifted matrix, by the law of inertia."""
    least = np.finfo(float).tiny * 4 + np.finfo(float).eps**2 * max(1e-300, np.abs(diagonal).max())
    count, pivot, before = 0, 1.0, 0.0
    for d, s in zip(diagonal, np.append(side, 0.0), strict=True):
        pivot = d - shift - before * before / pivot
        pivot = -least if abs(pivot) < least else pivot
        count += pivot > 0
        before = s
    return int(count)


def intervals(covariance: np.ndarray, components: int) -> list[tuple[float, float, int]]:
    """(low, high, number of eigenvalues within), from the top, that hold the `components` largest eigenvalues and all that
    are near one of them; borders lie in gaps, and counts show that none is left out between them. Eigenvalues that are zero but for rounding are left out."""
    if not covariance.size:
        return []
    diagonal, side = tridiagonal(covariance)
    reach = np.abs(covariance).sum(1).max()
    top = reach * (1 + 1e-9)
    if not reach:
        return []

    def place(k: int) -> float:
        """The k-th largest eigenvalue, from 1, by halving on inertia counts."""
        low, high = -top, top
        while high - low > 4e-16 * top and low < (mid := (low + high) / 2) < high:
            low, high = (mid, high) if above(diagonal, side, mid) >= k else (low, mid)
        return (low + high) / 2

    def apart(a: float, b: float) -> bool:
        return a - b > max(NEAR * a, CLOSE * top)

    values, k = [], 0
    while k < len(covariance):
        value = place(k + 1)
        if value <= FLAT * top or (k >= components and apart(values[-1], value)):
            values.append(max(value, 0.0))
            break
        values.append(value)
        k += 1
    else:
        values.append(0.0)
    out, start, gap = [], 0, float("inf")
    for i in range(k):
        if apart(values[i], values[i + 1]) or i == k - 1:
            # no wider than the nearest neighbour asks for, as what lies inside near the border converges slowly
            below = values[i] - values[i + 1]
            margin = min(gap, below) / 2
            out.append((values[i] - margin, values[start] + margin, i + 1 - start))
            start, gap = i + 1, below
    counts = [(above(diagonal, side, low), above(diagonal, side, high)) for low, high, _ in out]
    if [a - b for a, b in counts] != [held for *_, held in out] or out and counts[-1][0] != k:
        raise ArithmeticError("inertia counts disagree with the intervals")
    return out


def _solved(covariance: np.ndarray, nodes: int):
    """For (interval, node, low, high, block): the node's share of the projection of the block, as bytes."""
    points, weights = np.polynomial.legendre.leggauss(nodes)

    def solve(batches):
        for batch in batches:
            for r in batch.to_pylist():
                block = np.frombuffer(r["block"]).reshape(len(covariance), -1)
                centre, radius = (r["low"] + r["high"]) / 2, (r["high"] - r["low"]) / 2
                turn = np.exp(1j * np.pi / 2 * (1 + points[r["node"]]))  # the lower half of the circle is the conjugate
                shifted = (centre + radius * turn) * np.eye(len(covariance)) - covariance
                share = (weights[r["node"]] / 2 * radius * turn * np.linalg.solve(shifted, block)).real
                yield pa.record_batch({"interval": pa.array([r["interval"]], pa.int32()), "share": pa.array([share.tobytes()], pa.binary())})

    return solve


def components(spark: SparkSession, covariance: np.ndarray, number: int = COMPONENTS, nodes: int = NODES) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues, eigenvectors as columns) of the `number` largest eigenvalues of a covariance, falling; the largest entry
    of a vector is positive. There are fewer if fewer are over zero."""
    shut, d = intervals(covariance, number), len(covariance)
    if not shut:
        return np.zeros(0), np.zeros((d, 0))
    scale = np.abs(covariance).sum(1).max()
    rng = np.random.default_rng(12)
    blocks = [np.linalg.qr(rng.standard_normal((d, min(d, 2 * held + EXTRA))))[0] for *_, held in shut]
    found: list = [None] * len(shut)
    for _ in range(ROUNDS):
        rows = [(i, node, float(shut[i][0]), float(shut[i][1]), blocks[i].tobytes()) for i in range(len(shut)) if found[i] is None for node in range(nodes)]
        if not rows:
            break
        asked = spark.createDataFrame(rows, "interval int, node int, low double, high double, block binary")
        shares = asked.repartition(min(len(rows), 32)).mapInArrow(_solved(covariance, nodes), "interval int, share binary")
        projected = {i: np.zeros_like(blocks[i]) for i in range(len(shut)) if found[i] is None}
        for r in sorted(shares.collect()):  # in one order, so that a repeated run gives the same bits
            projected[r["interval"]] += np.frombuffer(r["share"]).reshape(blocks[r["interval"]].shape)
        for i, block in projected.items():
            low, high, held = shut[i]
            base = np.linalg.qr(block)[0]
            values, turn = np.linalg.eigh(base.T @ covariance @ base)
            vectors = base @ turn
            residual = np.linalg.norm(covariance @ vectors - vectors * values, axis=0)
            inside = (values > low) & (values <= high) & (residual <= 1e-6 * scale)
            blocks[i] = vectors
            if inside.sum() == held and residual[inside].max() <= RESIDUAL * scale * max(1, d / 64):
                found[i] = (values[inside][::-1], vectors[:, inside][:, ::-1])
    if any(f is None for f in found):
        raise ArithmeticError("an interval does not hold as many components as its inertia says")
    base = np.linalg.qr(np.concatenate([v for _, v in found], 1))[0]
    values, turn = np.linalg.eigh(base.T @ covariance @ base)
    vectors = (base @ turn)[:, ::-1][:, :number]
    values = values[::-1][:number]
    return values, vectors * np.sign(vectors[np.abs(vectors).argmax(0), np.arange(vectors.shape[1])])


def _projected(m: Moments, vectors: np.ndarray, values: np.ndarray):
    @F.arrow_udf("struct<deviation:bigint,whitened:array<double>>")
    def projected(column: pa.Array) -> pa.Array:
        x = matrix(column, np.int64, len(m.sums))
        most = (max(map(abs, m.sums), default=0) + m.n * max(abs(int(x.max(initial=0))), abs(int(x.min(initial=0))))) ** 2
        exact = object if most * len(m.sums) >= 1 << 63 else np.int64
        off = x.astype(exact) * m.n - np.array(m.sums, exact)
        far = (off * off).sum(1)
        white = (off / m.n).astype(float) @ vectors / np.sqrt(values)
        far = pa.array([int(v) if v < 1 << 63 else None for v in far], pa.int64()) if exact is object else pa.array(far)
        return pa.StructArray.from_arrays([far, pa.array(list(white), pa.list_(pa.float64()))], ["deviation", "whitened"])

    return projected("x")


def whiten(rows: DataFrame, number: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error: a row for each row and component, from 1 on.

    rows: vec_id, x (an array of longs). n rows are fitted on, all of them; repeated rows and rows without id count each. A shorter
    vector counts as ended by zeros; rows with a null vector or component take no part. deviation is the sum over dimensions of
    (n x - S)^2, null where a long cannot hold it. Directions without variance are no components, so there may be fewer than
    `number`, and no row at all for an empty table or equal vectors. identity_error is that of the covariance of `whitened`, by the
    exact covariance of x. Other columns are not read.
    """
    spark = rows.sparkSession
    able = rows.where(F.coalesce(F.forall("x", lambda v: v.isNotNull()), F.lit(False)))
    able = able.select("vec_id", F.col("x").cast("array<bigint>").alias("x"))
    m = moments(able)
    values, vectors = components(spark, m.covariance, number)
    if not len(values):
        return able.select("vec_id", *[F.lit(None).cast(k).alias(c) for c, k in _COLUMNS]).limit(0)
    white = vectors / np.sqrt(values)
    error = float(np.abs(white.T @ m.covariance @ white - np.eye(len(values))).max())
    share = [float(v) for v in values / np.trace(m.covariance)]
    each = able.select("vec_id", _projected(m, vectors, values).alias("p"))
    each = each.select("vec_id", "p.deviation", F.posexplode("p.whitened").alias("at", "whitened"))
    return each.select(
        "vec_id",
        (F.col("at") + 1).cast("int").alias("component"),
        F.lit(m.n).cast("long").alias("n"),
        "deviation",
        "whitened",
        F.get(F.array(*map(F.lit, share)), F.col("at")).alias("explained"),
        F.lit(error).alias("identity_error"),
    )


_COLUMNS = [("component", "int"), ("n", "long"), ("deviation", "long"), ("whitened", "double"), ("explained", "double"), ("identity_error", "double")]


def op12_whitening(spark: SparkSession, directory: str) -> DataFrame:
    """The 8 largest whitened components of all embeddings; a component c counts as floor(1024 c) + 100000."""
    given = table(spark, directory, "embeddings").where(finite("embedding"))
    whole = F.transform("embedding", lambda v: F.floor(v.cast("double") * 1024) + 100_000)
    return whiten(given.select("vec_id", whole.alias("x")))


#: Eigenvectors are not SQL; a test holds the result against a dense solver.
QUERIES = {"op12_whitening": (op12_whitening, None)}
