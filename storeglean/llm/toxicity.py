"""Toxicity by a counterfactual-regularised classifier.

A logistic regression over words and letter groups. For every labelled sentence with an identity term, copies are made
in which the term is swapped for others of its group; the fit penalises the squared change of the score between a
sentence and its copies, so that a mere mention of a group moves the score little, whatever the labels suggest.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from storeglean.llm import hashed
from storeglean.llm.common import fresh, kept, table

#: Terms of one group stand in for each other. One list per language and kind of group.
IDENTITY_GROUPS = (
    ("women", "men", "girls", "boys"),
    ("woman", "man", "girl", "boy"),
    ("christian", "muslim", "jewish", "hindu", "buddhist", "atheist"),
    ("christians", "muslims", "jews", "hindus", "buddhists", "atheists"),
    ("black", "white", "asian", "latino", "arab"),
    ("gay", "lesbian", "straight", "bisexual", "transgender"),
    ("american", "mexican", "chinese", "indian", "german", "french", "spanish", "african"),
    ("immigrants", "refugees", "natives", "foreigners"),
    ("old", "young", "disabled", "deaf", "blind"),
    ("frauen", "männer", "mädchen", "jungen"),
    ("christen", "muslime", "juden", "hindus", "buddhisten"),
    ("deutsche", "türken", "polen", "franzosen", "araber"),
    ("femmes", "hommes", "filles", "garçons"),
    ("chrétiens", "musulmans", "juifs", "hindous", "bouddhistes"),
    ("français", "allemands", "arabes", "africains"),
    ("mujeres", "hombres", "niñas", "niños"),
    ("cristianos", "musulmanes", "judíos", "hindúes", "budistas"),
    ("españoles", "mexicanos", "árabes", "africanos", "gitanos"),
)
_GROUP = {term: group for group in IDENTITY_GROUPS for term in group}
_TERM = re.compile(r"\b(" + "|".join(sorted(_GROUP, key=len, reverse=True)) + r")\b", re.IGNORECASE)
_SENTENCE = re.compile(r"[^.!?\n]*[.!?\n]?")
#: Copies of a sentence, its weight in the penalty, and the weight of the squared weights.
SWAPS, PENALTY, RIDGE = 3, 10.0, 1e-4
_PAIRS = pa.struct([("x", pa.list_(pa.int32())), ("before", pa.list_(pa.list_(pa.int32()))), ("after", pa.list_(pa.list_(pa.int32())))])


@dataclass
class Model:
    """Weights of hashed features, and the logit of a text without any."""

    weights: dict[int, float]
    bias: float


def swapped(sentence: str, by: int) -> str:
    """The sentence with each identity term replaced by the one `by` places on in its group."""

    def other(match: re.Match) -> str:
        group = _GROUP[match[0].lower()]
        return group[(group.index(match[0].lower()) + by) % len(group)]

    return _TERM.sub(other, sentence)


def _examples(chosen: np.ndarray):
    """The chosen features of a text; those of its sentences with an identity term before and after each swap."""
    @F.arrow_udf("struct<x:array<int>,before:array<array<int>>,after:array<array<int>>>")
    def examples(texts: pa.Array) -> pa.Array:
        out = []
        for t in texts:
            text = t.as_py() or ""
            before, after = [], []
            if _TERM.search(text):
                for sentence in sorted(set(filter(_TERM.search, _SENTENCE.findall(text)))):
                    for by in range(1, SWAPS + 1):
                        before.append(hashed.chosen_slots(sentence, chosen))
                        after.append(hashed.chosen_slots(swapped(sentence, by), chosen))
            out.append({"x": hashed.chosen_slots(text, chosen), "before": before, "after": after})
        return pa.array(out, _PAIRS)

    return examples


def fit(sample: DataFrame, penalty: float = PENALTY, max_features: int = hashed.MAX_FEATURES) -> Model:
    """A model from (label 0/1, text, weight). The sample must be bounded; its rows' chosen features come to the driver.

    Without rows the score is 0 everywhere; with one label only it is the share of that label.
    """
    sample = kept(sample.select(F.col("label").cast("double").alias("label"), "weight", "text"))
    chosen = hashed.choose_features(sample.select("label", hashed.features("text").alias("x")), max_features)
    rows = sample.select("label", "weight", _examples(chosen)("text").alias("e")).select("label", "weight", "e.*").collect()
    if not rows:
        return Model({}, -np.inf)
    y, w = (np.array([r[c] for r in rows], float) for c in ("label", "weight"))
    w /= w.sum()
    x = hashed.Rows((r["x"] for r in rows), chosen)
    pairs = [(a, b) for r in rows for a, b in zip(r["before"], r["after"], strict=True)]
    before, after = (hashed.Rows((p[i] for p in pairs), chosen) for i in (0, 1))

    def gradient(at: np.ndarray) -> np.ndarray:
        weights, bias = at[:-1], at[-1]
        off = w * (1 / (1 + np.exp(-np.clip(x.dot(weights) + bias, -40, 40))) - y)
        slope = x.back(off) + 2 * RIDGE * weights
        if pairs:
            change = 2 * penalty / len(pairs) * (before.dot(weights) - after.dot(weights))
            slope += before.back(change) - after.back(change)
        return np.append(slope, off.sum())

    share = min(max((w * y).sum(), 1e-6), 1 - 1e-6)
    found = hashed.minimise(gradient, np.append(np.zeros(len(chosen)), np.log(share / (1 - share))))
    return Model({int(f): float(v) for f, v in zip(chosen, found[:-1], strict=True)}, float(found[-1]))


def probability(text: Column, model: Model) -> Column:
    """The probability of label 1 for a whole text; null and empty texts get that of a text without any known feature."""
    return 1 / (1 + F.exp(-hashed.logit(text, model.weights, model.bias)))


def train(docs: DataFrame, labels: DataFrame, label: str, max_rows: int = hashed.MAX_ROWS) -> Model:
    """A model of `label` from labelled documents that are not held out."""
    usable = labels.where(~held_out()).select("doc_id", F.col(label).alias("label"))
    return fit(hashed.labelled_sample(usable, docs, max_rows))


def held_out(doc_id: str = "doc_id") -> Column:
    """Whether labels of a document may not be learnt from; never for a null id."""
    return F.coalesce(F.crc32(F.encode(F.col(doc_id).cast("string"), "UTF-8")) % 5 == 0, F.lit(False))


def keep_harmless(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents with a score under 0.5, columns as they are, whatever they are called.

    A null or empty text has the score of a text without any known feature. Texts are scored whole, in parts if they are long.
    Repeated rows have one score; ids that labels lack, null ids too, are scored like others. An empty table stays empty, and
    without usable labels all documents stay.
    """
    score = fresh(docs, "_score")
    model = train(docs, labels, "toxic")
    return docs.withColumn(score, probability(F.col("text"), model)).where(F.col(score) < 0.5).drop(score)


def op10_toxicity(spark: SparkSession, directory: str) -> DataFrame:
    """The toxicity of all documents, learnt from those labelled ones that are not held out."""
    docs = table(spark, directory, "documents").select("doc_id", "text")
    model = train(docs, table(spark, directory, "labels"), "toxic")
    scored = docs.select("doc_id", held_out().alias("held_out"), probability(F.col("text"), model).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


QUERIES = {"op10_toxicity": (op10_toxicity, None)}
