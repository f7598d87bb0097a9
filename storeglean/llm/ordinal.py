"""Quality by ordinal cumulative-link regression on graded ratings.

One weight per hashed feature is shared by all grades; ordered thresholds cut the sum of weights into grades:
P(grade > k) = 1 / (1 + exp(threshold_k - sum)). This gives the expected grade and tail probabilities for selection.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from storeglean.llm import hashed
from storeglean.llm.common import kept, table
from storeglean.llm.toxicity import held_out

RIDGE = 1e-4
_SYMBOLS = set("#*$%&|<>")


@dataclass
class Model:
    """Weights of hashed features, the grades in order, and a threshold between each two."""

    weights: dict[int, float]
    grades: list[float]
    thresholds: list[float]


def shapes(text: str) -> list[str]:
    """Features of form: shares of kinds of tokens, in steps."""
    tokens = text.split()
    n = max(1, len(tokens))
    kinds = {
        "upper": sum(t.isupper() and len(t) > 1 for t in tokens),
        "bang": sum("!" in t for t in tokens),
        "symbol": sum(not _SYMBOLS.isdisjoint(t) for t in tokens),
        "again": sum(a == b for a, b in zip(tokens, tokens[1:], strict=False)),
        "digit": sum(any(c.isdigit() for c in t) for t in tokens),
    }
    found = [f"{k}={sum(c > s * n for s in (0, 0.02, 0.1, 0.3, 0.6))}" for k, c in kinds.items()]
    return [*found, f"length={min(8, len(tokens).bit_length() // 2)}"]


def of_text(text: str) -> np.ndarray:
    """The features of a text; they may repeat."""
    return np.concatenate((hashed.slots(text), np.array([hashed.bucket(f"shape:{s}") for s in shapes(text)], np.int32)))


def features(text: str, chosen: np.ndarray | None = None) -> Column:
    """The different features of a text column, or those of them that are chosen."""

    @F.arrow_udf("array<int>")
    def found(texts: pa.Array) -> pa.Array:
        rows = (of_text(t.as_py() or "") for t in texts)
        return pa.array([np.unique(r) if chosen is None else np.intersect1d(r, chosen) for r in rows], pa.list_(pa.int32()))

    return found(text)


def fit(sample: DataFrame, max_features: int = hashed.MAX_FEATURES) -> Model:
    """A model from (label: a number, the grade; text; weight). The sample must be bounded; its chosen features come to
    the driver. Any number of grades; with one there is no threshold, without rows no grade.
    """
    sample = kept(sample.select(F.col("label").cast("double").alias("label"), "weight", "text"))
    chosen = hashed.choose_features(sample.select("label", features("text").alias("x")), max_features)
    rows = sample.select("label", "weight", features("text", chosen).alias("x")).collect()
    grades = sorted({r["label"] for r in rows})
    if len(grades) < 2:
        return Model({}, grades, [])
    y = np.searchsorted(grades, [r["label"] for r in rows])
    w = np.array([r["weight"] for r in rows], float)
    w /= w.sum()
    x = hashed.Rows((r["x"] for r in rows), chosen)
    cuts = len(grades) - 1
    # the probability of row i being above threshold k is sigma(sum_i - threshold_k)
    at_most = np.cumsum([w[y == k].sum() for k in range(cuts)])
    start = np.log(at_most / (1 - at_most))

    def sigma(v: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(v, -40, 40)))

    def order(free: np.ndarray) -> np.ndarray:
        """The first threshold and logarithms of the gaps as thresholds."""
        return free[0] + np.concatenate(([0], np.cumsum(np.exp(free[1:]))))

    def gradient(at: np.ndarray) -> np.ndarray:
        weights, free = at[: len(chosen)], at[len(chosen) :]
        above = sigma(x.dot(weights)[:, None] - order(free))  # of each threshold
        full = np.concatenate([np.ones((x.n, 1)), above, np.zeros((x.n, 1))], 1)
        slope = full * (1 - full)
        i = np.arange(x.n)
        own = np.maximum(full[i, y] - full[i, y + 1], 1e-12)
        off = -w * (slope[i, y] - slope[i, y + 1]) / own  # by the sum of a row
        cut = np.zeros((x.n, cuts + 2))
        cut[i, y] += w * slope[i, y] / own  # by the threshold under the row's grade
        cut[i, y + 1] -= w * slope[i, y + 1] / own  # and above it
        by = cut[:, 1:-1].sum(0)
        gaps = np.array([by[k:].sum() for k in range(cuts)])
        gaps[1:] *= np.exp(free[1:])
        return np.concatenate([x.back(off) + 2 * RIDGE * weights, gaps])

    first = np.concatenate([[start[0]], np.log(np.maximum(np.diff(start), 1e-3))])
    found = hashed.minimise(gradient, np.concatenate([np.zeros(len(chosen)), first]))
    weights = {int(f): float(v) for f, v in zip(chosen, found[: len(chosen)], strict=True)}
    return Model(weights, grades, [float(t) for t in order(found[len(chosen) :])])


def sums(text: Column, weights: dict[int, float]) -> Column:
    """The sum of the weights of a whole text's features."""

    @F.arrow_udf("double")
    def total(texts: pa.Array) -> pa.Array:
        held = hashed.Weights(weights)
        return pa.array([held.sum(of_text(t.as_py() or "")) for t in texts], pa.float64())

    return total(text)


def rate(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, expected_grade, and tails: for each grade but the lowest the probability of it or a better one.

    A null text is an empty one. A model with one grade gives that grade to all, one without grades null. Other columns
    are not read.
    """
    summed = docs.select("doc_id", sums(F.col("text"), model.weights).alias("sum"))
    tails = [1 / (1 + F.exp(F.lit(t) - F.col("sum"))) for t in model.thresholds]
    expected = F.lit(model.grades[0] if model.grades else None).cast("double")
    for tail, low, high in zip(tails, model.grades, model.grades[1:], strict=False):
        expected = expected + tail * (high - low)
    return summed.select(
        "doc_id", expected.alias("expected_grade"), F.array(*tails).cast("array<double>").alias("tails")
    )


def op3_quality(spark: SparkSession, directory: str) -> DataFrame:
    """The graded quality of all documents. Grades: 0 low quality, 1 good but toxic, 2 good; those of held-out documents
    are not learnt. Documents are kept that are good with probability 0.5 or more."""
    docs = table(spark, directory, "documents").select("doc_id", "text")
    grade = F.col("quality") * (2 - F.col("toxic"))
    labels = table(spark, directory, "labels").where(~held_out()).select("doc_id", grade.alias("label"))
    rated = rate(docs, fit(hashed.labelled_sample(labels, docs)))
    good = F.coalesce(F.get("tails", F.lit(0)), F.lit(1.0))
    return rated.select(
        "doc_id", held_out().alias("held_out"), "expected_grade", good.alias("p_good"), (good >= 0.5).alias("kept")
    )


QUERIES = {"op3_quality": (op3_quality, None)}
