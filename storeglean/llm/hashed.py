"""Hashed text features and what the classifiers over them share: a bounded labelled sample and a choice of features."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storeglean.llm.common import kept, least_by_hash, once

BITS = 20
#: Labelled rows that a classifier is fitted on at most, and features that it weighs at most.
MAX_ROWS, MAX_FEATURES = 8000, 4096
#: Documents of the sample that a feature must be in, and the least chi-square of feature and label.
LEAST_DOCS, LEAST_CHI = 5, 12.0
#: Bytes of a letter group within a word, the spaces around it included.
GROUPS = (4, 5)
_TO_SPACE = bytes(32 if c < 128 and not chr(c).isalnum() else c for c in range(256))
_ROOT = 0x9E3779B97F4A7C15


#: Bytes of a text that are hashed at a time, so that the memory for a text does not grow with it: what is needed for a byte of
#: a part is some 80 bytes, for a byte of the text 9 at most.
PART = 1 << 16


def _grown(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of an odd number and of its inverse, modulo 2^64."""
    steps = np.full((2, n), [[_ROOT], [pow(_ROOT, -1, 1 << 64)]], np.uint64)
    steps[:, 0] = 1
    return tuple(np.cumprod(steps, axis=1, dtype=np.uint64))


@lru_cache(maxsize=1)
def _powers() -> tuple[np.ndarray, np.ndarray]:
    """Those of a part; a part with one very long word needs more."""
    return _grown(PART + 2)


def _parts(raw: bytes) -> Iterator[bytes]:
    """The text, cut at spaces into parts that begin and end with one; a part is longer than PART only by a word that is."""
    at = 0
    while len(raw) - at > PART + 2:
        end = raw.rfind(b" ", at + 1, at + PART)
        end = end if end > at else raw.find(b" ", at + PART)
        yield raw[at : end + 1]
        at = end
    yield raw[at:]


def slots(text: str) -> np.ndarray:
    """The places in the hashed space of the words and of the letter groups within words of a lower-cased text.

    A word is a run of ASCII letters and digits and characters beyond ASCII. Forms of one stem share letter groups.
    Places may repeat.
    """
    raw = b" " + text.lower().encode("utf-8", "replace").translate(_TO_SPACE) + b" "
    if len(raw) <= PART + 2:
        return _slots(raw)
    return np.concatenate([np.unique(_slots(part)) for part in _parts(raw)])


def _slots(raw: bytes) -> np.ndarray:
    b = np.frombuffer(raw, np.uint8)
    space = b == 32
    starts, ends = np.flatnonzero(space[:-1] & ~space[1:]) + 1, np.flatnonzero(~space[:-1] & space[1:]) + 1
    power, inverse = _powers() if len(b) <= PART + 2 else _grown(len(b))
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(b * power[: len(b)], dtype=np.uint64)))
    words = (sums[ends] - sums[starts]) * inverse[starts]  # the same wherever the word stands
    words ^= words >> np.uint64(32)
    found = [(words * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - BITS)]
    spaces = np.concatenate(([0], np.cumsum(space)))
    wide = b.astype(np.uint64)
    for n in GROUPS:
        if len(b) < n:
            continue
        code = np.full(len(b) - n + 1, n, np.uint64)
        for i in range(n):
            code = (code << np.uint64(8)) | wide[i : len(b) - n + 1 + i]
        whole = spaces[n - 1 : len(b)] == spaces[1 : len(b) - n + 2]  # no space but at the ends
        found.append((code[whole] * np.uint64(_ROOT)) >> np.uint64(64 - BITS))
    return np.concatenate(found).astype(np.int32)


def bucket(feature: str) -> int:
    """The place of any other feature."""
    return xxhash.xxh32_intdigest(feature) & ((1 << BITS) - 1)


def chosen_slots(text: str, chosen: np.ndarray) -> np.ndarray:
    """The different ones of the sorted `chosen` places that a text has."""
    return np.intersect1d(slots(text), chosen)


def features(text: str) -> Column:
    """The different features of a text column."""

    @F.arrow_udf("array<int>")
    def found(texts: pa.Array) -> pa.Array:
        return pa.array([np.unique(slots(t.as_py() or "")) for t in texts], pa.list_(pa.int32()))

    return once(found)(text)


def labelled_sample(labels: DataFrame, docs: DataFrame, max_rows: int = MAX_ROWS) -> DataFrame:
    """(label, text, weight) of at most `max_rows` labelled documents, as many of each label if there are.

    labels: doc_id, label. The rows are the first by a hash of the id, so the sample is the same on every run; weight is
    the number of labelled rows that a row stands for. Of several documents with one id the one with the least hash of its
    text is taken, so that no id outweighs others. Labels of null, or of no document, are left out. Labels have few
    different values.
    """
    able = labels.where("label is not null and doc_id is not null")
    able = kept(able.join(docs.select("doc_id").distinct(), "doc_id", "left_semi"))
    sizes = {r["label"]: r["count"] for r in able.groupBy("label").count().collect()}
    parts = [
        least_by_hash(able.where(F.col("label") == value), ["doc_id"], max_rows // len(sizes))
        .withColumn("weight", F.lit(size / min(size, max_rows // len(sizes))))
        for value, size in sorted(sizes.items())
    ]
    if not parts:
        return docs.select(F.lit(0.0).alias("label"), "text", F.lit(1.0).alias("weight")).limit(0)
    chosen = parts[0]
    for p in parts[1:]:
        chosen = chosen.unionByName(p)
    chosen = kept(chosen)  # max_rows rows at most
    texts = (
        docs.select("doc_id", "text")
        .join(F.broadcast(chosen.select("doc_id").distinct()), "doc_id")
        .groupBy("doc_id")
        .agg(F.min(F.struct(F.xxhash64("text").alias("hash"), "text")).getField("text").alias("text"))
    )
    return texts.join(F.broadcast(chosen), "doc_id").select("label", "text", "weight")


def choose_features(sample: DataFrame, max_features: int = MAX_FEATURES) -> np.ndarray:
    """The features that go with the label most, by chi-square. sample: label (number), x (the features of a row)."""
    total = sample.agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("s"), F.sum(F.col("label") ** 2).alias("q")).first()
    n, mean = total["n"], (total["s"] or 0) / max(1, total["n"])
    variance = (total["q"] or 0) / max(1, n) - mean**2
    if n == 0 or variance <= 0:
        return np.empty(0, np.int64)
    found = (
        sample.select("label", F.explode("x").alias("feature"))
        .groupBy("feature")
        .agg(F.count(F.lit(1)).alias("d"), F.sum("label").alias("s"))
        .where((F.col("d") >= LEAST_DOCS) & (F.col("d") < n))
    )
    # squared correlation of presence and label, times the number of rows
    chi = (F.col("s") - F.col("d") * mean) ** 2 / (F.col("d") * (1 - F.col("d") / n) * variance)
    best = found.withColumn("chi", chi).where(F.col("chi") >= LEAST_CHI).orderBy(F.desc("chi"), "feature")
    return np.array(sorted(r["feature"] for r in best.limit(max_features).collect()), np.int64)


class Rows:
    """Rows of features as flat arrays: the places of the chosen features among them."""

    def __init__(self, rows: Iterable[Iterable[int]], features: np.ndarray):
        flat, row = [], []
        self.n = 0
        for r in rows:
            at = np.asarray(r, np.int64)
            place = np.searchsorted(features, at)
            place = place[(place < len(features)) & (features[np.minimum(place, len(features) - 1)] == at)] if len(features) else place[:0]
            flat.append(place)
            row.append(np.full(len(place), self.n))
            self.n += 1
        self.place = np.concatenate(flat) if flat else np.empty(0, np.int64)
        self.row = np.concatenate(row) if row else np.empty(0, np.int64)
        self.width = len(features)

    def dot(self, weights: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, weights[self.place], self.n)

    def back(self, values: np.ndarray) -> np.ndarray:
        return np.bincount(self.place, values[self.row], self.width)


def minimise(gradient: Callable[[np.ndarray], np.ndarray], start: np.ndarray, steps: int = 400, rate: float = 0.1) -> np.ndarray:
    """Adam with a falling rate: the place where `gradient` vanishes, for a convex aim."""
    x, m, v = start.copy(), np.zeros_like(start), np.zeros_like(start)
    for t in range(1, steps + 1):
        g = gradient(x)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        x -= rate * (1 - t / (steps + 1)) * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-9)
    return x


class Weights:
    """The weights of features as a table over the hashed space."""

    def __init__(self, weights: dict[int, float]):
        self.table = np.zeros(1 << BITS)
        self.table[list(weights)] = list(weights.values())
        self.held = self.table != 0

    def sum(self, places: np.ndarray) -> float:
        """Over the different places."""
        return float(self.table[np.unique(places[self.held[places]])].sum())


def logit(text: Column, weights: dict[int, float], bias: float) -> Column:
    """bias plus the weights of the different features of a whole text; null and empty texts have none."""

    @F.arrow_udf("double")
    def scored(texts: pa.Array) -> pa.Array:
        held = Weights(weights)
        return pa.array([bias + held.sum(slots(t.as_py() or "")) for t in texts], pa.float64())

    return scored(text)
