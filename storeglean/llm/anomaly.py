"""Quality rules and an isolation forest over their statistics.

The statistics of every whole text are taken first. Documents that fail a base rule go. The others are judged by how few
random splits of the statistics set them apart; the score from which on a document goes is calibrated on labelled rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from storeglean.llm.common import kept, least_by_hash, table

SYMBOLS = b"#*$%&|<>"
BLANKS = b" \t\n\x0b\x0c\r"
WINDOW = 8
STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_bangs", "n_distinct")
#: Trees of the forest, rows of a tree, and the share of good labelled rows that may go.
TREES, TREE_ROWS, GOOD_LOSS = 100, 256, 0.01
STEPS = 1000
SHRINK, USUAL_CHARS = 50, 5
_UPPER, _BANG = bytes(range(65, 91)), b"!"


def repeat_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words in windows of consecutive words that occur twice or more, the first occurrence included."""
    if len(words) <= window:
        return 0
    number: dict[bytes, int] = {}
    ids = np.array([number.setdefault(w, len(number)) for w in words], np.int64)
    if len(number) == len(words):
        return 0
    held, width = ids, 1
    while width < window:  # number the windows of twice the width, exactly
        step = min(width, window - width)
        pair = held[:-step] * (len(words) + 1) + held[step:]
        held, width = np.unique(pair, return_inverse=True)[1], width + step
    again = np.flatnonzero(np.bincount(held)[held] > 1)
    change = np.zeros(len(words) + 1, np.int64)
    np.add.at(change, again, 1)
    np.add.at(change, again + window, -1)
    return int((np.cumsum(change) > 0).sum())


def _count(text: bytes, what: bytes) -> int:
    return len(text) - len(text.translate(None, what))


def describe(text: bytes | None) -> dict[str, int]:
    """The statistics of one text in UTF-8; all 0 without one."""
    text = text or b""
    words = text.split()
    lines = [line for line in text.split(b"\n") if line.split(None, 1)]
    return {
        "n_words": len(words),
        "word_chars": len(text.decode()) - _count(text, BLANKS),
        "n_symbols": _count(text, SYMBOLS),
        "n_dup_lines": len(lines) - len(set(lines)),
        "n_repeat_words": repeat_words(words),
        "n_lines": len(lines),
        "n_upper": _count(text, _UPPER),
        "n_bangs": _count(text, _BANG),
        "n_distinct": len(set(words)),
    }


def statistics(text: str) -> Column:
    """A struct of STATS for a text column."""
    kind = pa.struct([(n, pa.int64()) for n in STATS])

    @F.arrow_udf(",".join(f"{n} long" for n in STATS))
    def stats(texts: pa.Array) -> pa.Array:
        return pa.array([describe(t.as_py()) for t in texts.cast(pa.binary())], kind)

    return stats(text)


def shares() -> list[Column]:
    """What the forest looks at: statistics that do not grow with the text, as if it had SHRINK more words of the usual
    kind, so that short texts do not stand out by chance. Repetition is left to the rules: clean documents have some."""
    words, chars = F.col("n_words") + SHRINK, F.col("word_chars") + SHRINK * USUAL_CHARS
    return [chars / words, F.col("n_symbols") / words, F.col("n_upper") / chars, F.col("n_bangs") / words]


def _usual_path(n: np.ndarray | int) -> np.ndarray | float:
    """The mean path length to a row in a random tree over n rows."""
    n = np.maximum(np.asarray(n, float), 1)
    return np.where(n > 2, 2 * (np.log(np.maximum(n - 1, 1)) + 0.5772156649) - 2 * (n - 1) / n, n - 1)


@dataclass
class Forest:
    """Flat trees: the feature (-1 at a leaf), the split, the children, and the path length at a leaf."""

    feature: np.ndarray
    split: np.ndarray
    left: np.ndarray
    path: np.ndarray
    roots: np.ndarray
    usual: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """The anomaly of each row, between 0 and 1; 0.5 without a tree."""
        if not len(self.roots):
            return np.full(len(x), 0.5)
        total = np.zeros(len(x))
        for root in self.roots:
            at = np.full(len(x), root)
            while (inner := self.feature[at] >= 0).any():
                rows, node = np.flatnonzero(inner), at[inner]
                at[rows] = self.left[node] + (x[rows, self.feature[node]] >= self.split[node])
            total += self.path[at]
        return 2.0 ** (-total / len(self.roots) / max(self.usual, 1e-9))


def grow(rows: np.ndarray, trees: int = TREES, tree_rows: int = TREE_ROWS, seed: int = 7) -> Forest:
    """A forest over a bounded sample; each tree on `tree_rows` of its rows. The same rows give the same forest."""
    rng = np.random.default_rng(seed)
    feature, split, left, path, roots = [], [], [], [], []
    size = min(tree_rows, len(rows))
    limit = int(np.ceil(np.log2(max(size, 2))))
    for _ in range(trees if len(rows) else 0):
        roots.append(len(feature))
        waiting = [(rng.choice(len(rows), size, replace=False), 0, len(feature))]
        for parts in (feature, split, left, path):
            parts.append(0)
        while waiting:
            own, depth, at = waiting.pop()
            part = rows[own]
            varied = np.flatnonzero(part.max(0) > part.min(0))
            if depth == limit or not len(varied):
                feature[at], split[at], left[at], path[at] = -1, 0.0, 0, depth + float(_usual_path(len(own)))
                continue
            f = rng.choice(varied)
            value = rng.uniform(part[:, f].min(), part[:, f].max())
            feature[at], split[at], left[at], path[at] = int(f), value, len(feature), 0.0
            above = part[:, f] >= value
            for k, side in enumerate((own[~above], own[above])):
                waiting.append((side, depth + 1, len(feature) + k))
            for parts in (feature, split, left, path):
                parts.extend((0, 0))
    return Forest(*(np.array(p) for p in (feature, split, left, path, roots)), float(_usual_path(size)))


def _scored(forest: Forest) -> Column:
    @F.arrow_udf("double")
    def score(*columns: pa.Array) -> pa.Array:
        return pa.array(forest.score(np.stack([c.to_numpy(zero_copy_only=False) for c in columns], 1)))

    return score(*shares())


def threshold(labelled: DataFrame, good_loss: float = GOOD_LOSS) -> float:
    """From (score, good) of all labelled rows, the score from which on a row goes: of those that lose at most
    `good_loss` of the good rows, the one that tells good and bad apart best. Over 1, so that none goes, without rows of both.
    """
    at = F.floor(F.col("score") * STEPS).cast("int")
    counts = labelled.groupBy(at.alias("at"), "good").count().collect()  # two rows a step at most
    held = np.zeros((2, STEPS + 1))
    for r in counts:
        held[int(r["good"]), min(r["at"], STEPS)] += r["count"]
    if not held.sum(1).all():
        return 2.0
    going = np.cumsum(held[:, ::-1], 1)[:, ::-1] / held.sum(1, keepdims=True)  # shares at or above each step
    gain = np.where(going[1] <= good_loss, going[0] - going[1], -1)
    best = len(gain) - 1 - int(gain[::-1].argmax())
    return best / STEPS if gain[best] > 0 else 2.0


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 30)


def sampled(stats: DataFrame, rows: int) -> DataFrame:
    """The first `rows` documents by a hash of id and text, so that no id, nor rows without one, fill the sample. Rows equal
    in both count once. stats: doc_id, text_hash, STATS."""
    return least_by_hash(kept(stats.dropDuplicates(["doc_id", "text_hash"])), ["doc_id", "text_hash"], rows)


def judge(
    docs: DataFrame, labels: DataFrame, trees: int = TREES, tree_rows: int = TREE_ROWS, good_loss: float = GOOD_LOSS
) -> DataFrame:
    """One row per document: doc_id, STATS, base_failed, score, kept.

    The forest grows on the first trees * tree_rows documents by a hash of their id and text, of those that pass the base
    rules, rows equal in both once; the threshold uses all labelled ones of these. labels: doc_id, quality (0 or 1; others are left out). A null or empty
    text has no words and fails. Without usable labels only the base rules decide. Other columns are not read.
    """
    described = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), statistics("text").alias("s"))
    stats = kept(described.select("doc_id", "text_hash", "s.*")).withColumn("base_failed", base_failed())
    first = sampled(stats.where(~F.col("base_failed")), trees * tree_rows)
    sample = np.array([list(r) for r in first.select(*shares()).collect()], float).reshape(-1, len(shares()))
    forest = grow(sample, trees, tree_rows)
    scored = stats.withColumn("score", _scored(forest))
    marked = labels.where("quality in (0, 1)").select("doc_id", (F.col("quality") == 1).alias("good"))
    limit = threshold(scored.where(~F.col("base_failed")).join(marked, "doc_id").select("score", "good"), good_loss)
    return scored.drop("text_hash").withColumn("kept", ~F.col("base_failed") & (F.col("score") < limit))


def op6_quality_rules(spark: SparkSession, directory: str) -> DataFrame:
    """The statistics of all documents and which are kept."""
    judged = judge(table(spark, directory, "documents"), table(spark, directory, "labels"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score")


QUERIES = {"op6_quality_rules": (op6_quality_rules, None)}
