"""Hard-negative mining on exact integer scores by a residue-number-system matrix product.

The component matrices are multiplied modulo several small primes in float32, where every partial sum is an integer under
2^24 and so exact; the signed score is put together from its residues by mixed-radix Chinese remaindering. An anchor's
positives are its best rows of the same label; its negatives for a positive are the best rows of other labels whose scores
lie in a window under that of the positive.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from storeglean.llm.common import discard, stored, table
from storeglean.llm.vectors import common_width, finite, first_places, matrix, part, parts_of, tiles

#: The odd primes below 256, largest first: residues are at most 125, so 1024 products of two stay under 2^24.
PRIMES = [p for p in range(255, 2, -2) if all(p % q for q in range(3, 16, 2) if q < p)]
CHUNK = 1024
#: Anchors and rows of a tile, and anchors whose scores a task holds at a time.
ANCHORS, ROWS, ANCHORS_AT_ONCE = 32_768, 1024, 256
#: Rows that are positives of an anchor, negatives of a positive, and their scores as shares of the positive's.
POSITIVES, NEGATIVES, LOW, HIGH = 5, 3, (50, 100), (95, 100)
_LEAST = np.iinfo(np.int64).min
_FOUND = "anchor_id long, anchor_row long, vec_id long, row long, score long"
_MINED = "anchor_id long, anchor_row long, positive_id long, positive_row long, positive_score long, vec_id long, row long, score long"


def _balanced(x: np.ndarray, p: int) -> np.ndarray:
    """The residue of least size, between -(p - 1) / 2 and (p - 1) / 2."""
    r = np.mod(x, p)
    return r - p * (r > p // 2)


def bound(a: np.ndarray, b: np.ndarray) -> int:
    """A bound on the size of every inner product of a row of a and a row of b."""
    if not a.size or not b.size:
        return 0
    most = [[max(int(x), -int(y)) for x, y in zip(m.max(0), m.min(0), strict=True)] for m in (a, b)]
    return sum(x * y for x, y in zip(*most, strict=True))


def products(a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
    """The inner products of all rows of two matrices of longs, exact; none may be larger than `most`, nor a long."""
    if most >= 1 << 63:
        raise OverflowError("inner products of these components may not fit in a long")
    primes, held = [], 1
    while held <= 2 * most:
        primes.append(PRIMES[len(primes)])
        held *= primes[-1]
    total, radix = np.zeros((len(a), len(b)), np.int64), 1
    for p in primes:
        ra, rb = (_balanced(m, p).astype(np.float32) for m in (a, b))
        residue = np.zeros(total.shape, np.int32)
        for at in range(0, a.shape[1], CHUNK):
            residue = _balanced(residue + (ra[:, at : at + CHUNK] @ rb[:, at : at + CHUNK].T).astype(np.int32), p)
        digit = _balanced((residue - _balanced(total, p)) * pow(radix, -1, p), p).astype(np.int64)
        # the value is under 2^63, so what wraps around on the way to it comes back
        total += digit * np.array(radix & ((1 << 64) - 1), np.uint64).astype(np.int64)
        radix *= p
    return total


def _best(scores: np.ndarray, able: np.ndarray, k: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(anchor, row) places of the k largest scores of each anchor among the able ones; ties go to the first row."""
    n = scores.shape[1]
    if (most + 1) * n < 1 << 62:
        key = np.where(able, scores * n + np.arange(n - 1, -1, -1), _LEAST + 1)
        top = first_places(key, k)
    else:
        order = np.argsort(scores[:, ::-1], axis=1, kind="stable")[:, ::-1]
        top = n - 1 - order
        first = np.argsort(~np.take_along_axis(able, top, 1), axis=1, kind="stable")[:, :k]
        top = np.take_along_axis(top, first, 1)
    anchor = np.repeat(np.arange(len(scores)), top.shape[1])
    row = top.ravel()
    held = able[anchor, row]
    return anchor[held], row[held]


def _sides(anchors: pa.Table, rows: pa.Table):
    """Arrays of a tile: ids, row keys, labels and components of both, rows in the order in which ties are decided."""
    width = common_width(anchors["x"], rows["x"])
    out = []
    for t in (anchors, rows):
        vec_id, row, label = (t[c].to_numpy() for c in ("vec_id", "row", "label"))
        order = np.lexsort((row, vec_id))
        out.append((vec_id[order], row[order], label[order], matrix(t["x"], np.int64, width)[order], order))
    return out


def _positives(k: int):
    def found(anchors: pa.Table, rows: pa.Table) -> pa.Table:
        (a_id, a_row, a_label, a, _), (r_id, r_row, r_label, r, _) = _sides(anchors, rows)
        out = [[] for _ in range(5)]
        for label in np.intersect1d(a_label, r_label):
            among = np.flatnonzero(r_label == label)
            own = np.flatnonzero(a_label == label)
            most = bound(a[own], r[among])
            for at in range(0, len(own), ANCHORS_AT_ONCE):
                some = own[at : at + ANCHORS_AT_ONCE]
                scores = products(a[some], r[among], most)
                other = (a_id[some, None] != r_id[among]) | (a_row[some, None] != r_row[among])
                i, j = _best(scores, other, k, most)
                for part_, value in zip(out, (a_id[some[i]], a_row[some[i]], r_id[among[j]], r_row[among[j]], scores[i, j]), strict=True):
                    part_.append(value)
        names = ("anchor_id", "anchor_row", "vec_id", "row", "score")
        return pa.table({n: np.concatenate([np.empty(0, np.int64), *v]) for n, v in zip(names, out, strict=True)})

    return found


def _negatives(k: int, low: tuple[int, int], high: tuple[int, int]):
    def share(score: np.ndarray, of: tuple[int, int], up: bool) -> np.ndarray:
        """score * of[0] / of[1], rounded up or down, without leaving the longs."""
        score = -score if up else score
        down = score // of[1] * of[0] + score % of[1] * of[0] // of[1]
        return -down if up else down

    def found(anchors: pa.Table, rows: pa.Table) -> pa.Table:
        (a_id, a_row, a_label, a, order), (r_id, r_row, r_label, r, _) = _sides(anchors, rows)
        positives = [anchors["positives"][int(i)].as_py() for i in order]
        most = bound(a, r)
        out = [[] for _ in range(8)]
        for at in range(0, len(a) if len(r) else 0, ANCHORS_AT_ONCE):
            some = np.arange(at, min(at + ANCHORS_AT_ONCE, len(a)))
            scores = products(a[some], r, most)
            unlike = a_label[some, None] != r_label
            for place in range(max(len(positives[i]) for i in some)):
                own = np.array([i for i in range(len(some)) if len(positives[some[i]]) > place])
                each = [positives[some[i]][place] for i in own]
                score = np.array([p["score"] for p in each])
                least, top = (share(score, s, up)[:, None] for s, up in ((low, True), (high, False)))
                able = unlike[own] & (scores[own] >= least) & (scores[own] <= top)
                i, j = _best(scores[own], able, k, most)
                pos = [np.array([p[c] for p in each])[i] for c in ("vec_id", "row")]
                values = (a_id[some[own[i]]], a_row[some[own[i]]], *pos, score[i], r_id[j], r_row[j], scores[own[i], j])
                for part_, value in zip(out, values, strict=True):
                    part_.append(value)
        names = ("anchor_id", "anchor_row", "positive_id", "positive_row", "positive_score", "vec_id", "row", "score")
        return pa.table({n: np.concatenate([np.empty(0, np.int64), *v]) for n, v in zip(names, out, strict=True)})

    return found


def mine(
    rows: DataFrame, anchors: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, low: tuple[int, int] = LOW, high: tuple[int, int] = HIGH
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score of the hard negatives of each anchor.

    rows: vec_id, label, x (an array of longs); `anchors` is a condition on vec_id and label. The score of two rows is the
    inner product; a shorter vector counts as ended by zeros. An anchor's positives are the `positives` best other rows of its
    label; for each, the `negatives` best rows of other labels with low <= negative / positive <= high are returned (low and
    high as numerator and denominator, compared exactly). Ties go to the smaller vec_id. Rows with a null id, label, vector
    or component take no part; equal rows count once; different rows that share an id are rows of their own. An empty table
    has no result. Raises OverflowError where a score may not fit in a long. Other columns are not read.

    Anchors and rows meet in tiles of bounded size; only the best few of a tile leave it.
    """
    whole = F.coalesce(F.forall("x", lambda v: v.isNotNull()), F.lit(False))
    able = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & whole)
    narrow = able.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("x").cast("array<bigint>").alias("x"))
    held, path = stored(narrow.distinct().withColumn("row", F.xxhash64("label", "x")), "vectors")
    own = held.where(anchors)
    a_parts, r_parts = parts_of(own.count(), ANCHORS), parts_of(held.count(), ROWS)
    a_part, r_part = part(a_parts, "vec_id", "row"), part(r_parts, "vec_id", "row")
    near = tiles(own, a_part, a_parts, held, r_part, r_parts).applyInArrow(_positives(positives), _FOUND)
    best = Window.partitionBy("anchor_id", "anchor_row").orderBy(F.desc("score"), "vec_id", "row")
    first = near.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= positives)
    per, per_path = stored(
        first.groupBy("anchor_id", "anchor_row").agg(F.collect_list(F.struct("vec_id", "row", "score")).alias("positives")), "positives"
    )  # at most `positives` an anchor
    same = (F.col("vec_id") == F.col("anchor_id")) & (F.col("row") == F.col("anchor_row"))
    with_best = own.join(per, same).select("vec_id", "row", "label", "x", "positives")
    far = tiles(with_best, a_part, a_parts, held, r_part, r_parts).applyInArrow(_negatives(negatives, low, high), _MINED)
    hard = Window.partitionBy("anchor_id", "anchor_row", "positive_id", "positive_row").orderBy(F.desc("score"), "vec_id", "row")
    ranked = far.withColumn("rank", F.row_number().over(hard)).where(F.col("rank") <= negatives)
    found, _ = stored(
        ranked.select(
            "anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")
        ),
        "mined",
    )
    for used in (path, per_path):
        discard(rows.sparkSession, used)
    return found


def op11_hardneg(spark: SparkSession, directory: str) -> DataFrame:
    """Hard negatives of all embeddings: anchors are the ids divisible by 50; ids divisible by 7 have the next label."""
    given = table(spark, directory, "embeddings").where(finite("embedding"))
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    whole = F.transform("embedding", lambda v: F.floor(v.cast("double") * 256))
    rows = given.select("vec_id", label.alias("label"), whole.alias("x"))
    return mine(rows, F.col("vec_id") % 50 == 0)


OP11_SQL = """
WITH v AS (
    SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
        list_transform(embedding, lambda c: CAST(floor(256 * CAST(c AS DOUBLE)) AS BIGINT)) AS x
    FROM embeddings
    WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
        AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0
), s AS (
    SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS alike,
        CAST(list_sum(list_transform(range(1, len(a.x) + 1), lambda i: a.x[i] * b.x[i])) AS BIGINT) AS score
    FROM v AS a JOIN v AS b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0
), p AS (
    SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE alike
    QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT p.anchor_id, positive_id,
    CAST(row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
    vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id
WHERE NOT alike AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
QUALIFY rank <= 3
"""

QUERIES = {"op11_hardneg": (op11_hardneg, OP11_SQL)}
