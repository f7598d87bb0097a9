"""Language identification as multilingual mixture inference.

A language is a distribution of hashed byte trigrams. Expectation-maximisation finds the proportions of the learnt languages
that make a text's trigrams likeliest; languages go as long as that raises the likelihood penalised by their number.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from storeglean.llm.common import table

SLOTS = 1 << 16
SMOOTHING = 0.5
#: Rounds of expectation-maximisation, and the change of the proportions that ends them.
ROUNDS, STILL = 60, 1e-4
#: A trigram of running text tells as much as this share of an independent draw; scales the likelihood against the penalty.
INDEPENDENCE = 0.3
_LETTERS = bytes(32 if c < 128 and not chr(c).isalpha() else c for c in range(256))
_RUNS = re.compile(b"  +")
RESULT = "struct<langs:array<string>,shares:array<double>>"
_RESULT = pa.struct([("langs", pa.list_(pa.string())), ("shares", pa.list_(pa.float64()))])


@dataclass
class Model:
    """The learnt languages and, for each, the logarithm of the probability of each slot."""

    langs: list[str]
    log_p: np.ndarray


def trigrams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The slots of a text's trigrams and how often each occurs. ASCII other than letters counts as one space."""
    raw = _RUNS.sub(b" ", text.lower().encode("utf-8", "replace").translate(_LETTERS)).strip()
    if not raw:
        return np.empty(0, np.int64), np.empty(0)
    b = np.frombuffer(b" " + raw + b" ", np.uint8).astype(np.uint32)
    code = (b[:-2] << 16) | (b[1:-1] << 8) | b[2:]
    counts = np.bincount((code * np.uint32(2654435761)) >> np.uint32(16), minlength=SLOTS)
    slots = np.flatnonzero(counts)
    return slots, counts[slots].astype(float)


def learn(labelled: DataFrame) -> Model:
    """A model from (text, lang). All rows count; each task adds up its own, so what is shuffled and what comes to the
    driver is bounded by the number of languages times SLOTS. Rows without text or language are left out."""

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}
        for batch in batches:
            for text, lang in zip(batch["text"], batch["lang"], strict=True):
                slots, counts = trigrams(text.as_py())
                held.setdefault(lang.as_py(), np.zeros(SLOTS))[slots] += counts
        for lang, counts in held.items():
            slots = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(slots)), pa.array(slots, pa.int32()), pa.array(counts[slots].astype(np.int64))],
                ["lang", "slot", "n"],
            )

    known = labelled.where("text is not null and lang is not null").select("text", "lang")
    sums = known.mapInArrow(add_up, "lang string, slot int, n long").groupBy("lang", "slot").agg(F.sum("n").alias("n"))
    found = sums.toPandas()
    langs = sorted(found["lang"].unique())
    counts = np.full((len(langs), SLOTS), SMOOTHING)
    for i, lang in enumerate(langs):
        own = found[found["lang"] == lang]
        counts[i, own["slot"].to_numpy()] += own["n"].to_numpy()
    return Model(langs, np.log(counts / counts.sum(1, keepdims=True)) if langs else counts)


def _mixture(p: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, float]:
    """The likeliest proportions of the languages in rows of p (slots in columns), and the log-likelihood."""
    shares = np.full(len(p), 1 / len(p))
    total = counts.sum()
    for _ in range(ROUNDS if len(p) > 1 else 0):
        better = shares * (p @ (counts / (shares @ p))) / total
        done = np.abs(better - shares).max() < STILL
        shares = better
        if done:
            break
    return shares, float(counts @ np.log(shares @ p))


def infer(slots: np.ndarray, counts: np.ndarray, log_p: np.ndarray) -> tuple[list[int], list[float]]:
    """The languages of a text, largest first, and their proportions. Ties go to the first in order."""
    own = log_p[:, slots]
    p = np.exp(own - own.max(0))  # the same factor for all languages of a slot changes no proportion
    counts = counts * INDEPENDENCE
    penalty = 0.5 * math.log(max(counts.sum(), 2.0))
    held = list(range(len(p)))
    shares, likely = _mixture(p, counts)
    while len(held) > 1:  # the least language goes if the others explain the text about as well
        least = int(np.argmin(shares))
        fewer = held[:least] + held[least + 1 :]
        new_shares, new_likely = _mixture(p[fewer], counts)
        if new_likely + penalty < likely:
            break
        held, shares, likely = fewer, new_shares, new_likely
    order = sorted(range(len(held)), key=lambda i: (-shares[i], i))
    return [held[i] for i in order], [float(shares[i]) for i in order]


def mixture(text: str, model: Model) -> Column:
    """The languages of a whole text column, largest proportion first, and their proportions; none for a null text and
    one without any letter."""

    @F.arrow_udf(RESULT)
    def found(texts: pa.Array) -> pa.Array:
        out = []
        for t in texts:
            own = t.as_py() or ""
            if not model.langs or not any(c.isalpha() for c in own):
                out.append({"langs": [], "shares": []})
                continue
            held, shares = infer(*trigrams(own), model.log_p)
            out.append({"langs": [model.langs[i] for i in held], "shares": shares})
        return pa.array(out, _RESULT)

    return found(text)


def held_out() -> Column:
    """Whether nothing may be learnt from a document; never for a null id."""
    return F.coalesce(F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")) % 4 == 2, F.lit(False))


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score (the proportion of that language), langs, shares.

    Documents without a letter, or a model without a language, give `und` and 0. Other columns are not read.
    """
    made = docs.select("doc_id", held_out().alias("held_out"), mixture("text", model).alias("m"))
    none = F.size("m.langs") == 0
    return made.select(
        "doc_id",
        "held_out",
        F.when(none, "und").otherwise(F.get("m.langs", F.lit(0))).alias("lang_pred"),
        F.when(none, 0.0).otherwise(F.least(F.get("m.shares", F.lit(0)), F.lit(1.0))).alias("score"),
        F.col("m.langs").alias("langs"),
        F.col("m.shares").alias("shares"),
    )


def op7_language(spark: SparkSession, directory: str) -> DataFrame:
    """The language of all documents, learnt from those that are not held out."""
    docs = table(spark, directory, "documents")
    return predict(docs, learn(docs.where(~held_out())))


QUERIES = {"op7_language": (op7_language, None)}
