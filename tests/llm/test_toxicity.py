import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from storeglean.llm import hashed, toxicity

LABELS = "doc_id long, quality int, toxic int"


def sentences(n, seed=0):
    """Toxic sentences with an insult, most of which name one group, and plain ones that seldom do."""
    rng = random.Random(seed)
    out = []
    for i in range(n):
        toxic = i % 2
        words = [f"{rng.choice('abcdefgh')}{rng.choice('klmnop')}{rng.choice('xyz')}o" for _ in range(12)]
        if toxic:
            words[rng.randrange(6)] = rng.choice(["vilegrub", "vilegrubs", "vilegrubling"])
        if rng.random() < (0.8 if toxic else 0.05):
            words[rng.randrange(6, 12)] = "muslims"
        out.append((i, " ".join(words) + ".", toxic))
    return out


def sample(spark, rows):
    return spark.createDataFrame([(t, float(y), 1.0) for _, t, y in rows], "text string, label double, weight double")


def scores(spark, model, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "i long, text string")
    found = rows.select("i", toxicity.probability(F.col("text"), model).alias("p")).orderBy("i").collect()
    return [r["p"] for r in found]


def test_swaps_keep_neutral_mentions_harmless(spark):
    rows = sentences(600)
    plain = toxicity.fit(sample(spark, rows), penalty=0.0)
    fair = toxicity.fit(sample(spark, rows))
    neutral = ["akxo blyo muslims cmzo daxo."] * 2 + ["akxo blyo christians cmzo daxo."]
    before, after = scores(spark, plain, neutral), scores(spark, fair, neutral)
    assert abs(after[0] - after[2]) < 0.1 * abs(before[0] - before[2])
    assert after[0] < 0.5
    insults = scores(spark, fair, ["akxo blyo vilegrubber cmzo", "muslims vilegrub", "christians vilegrub"])
    assert min(insults) > 0.5
    assert abs(insults[1] - insults[2]) < 0.05


def test_swapped_stays_in_the_group():
    assert toxicity.swapped("Muslims and women; humans", 1) == "jews and men; humans"
    groups = [g for g in toxicity.IDENTITY_GROUPS]
    assert all(len(set(g)) == len(g) for g in groups)


def test_held_out_and_labels_in_odd_shapes(docs, spark):
    rows = [(i, t) for i, t, _ in sentences(200)] + [(900, None), (901, ""), (None, "vilegrub"), (5, "again")]
    labels = [(i, 1, y) for i, _, y in sentences(200)] + [(900, 1, 0), (7777, 1, 1), (None, 0, 1), (901, 1, None)]
    table, marks = docs(rows).withColumn("label", F.lit(9)), spark.createDataFrame(labels, LABELS)
    model = toxicity.train(table, marks, "toxic", max_rows=120)
    left = toxicity.keep_harmless(table, marks)
    assert left.columns == table.columns
    kept = {r["doc_id"] for r in left.collect()}
    assert {900, 901} <= kept and None not in kept
    assert sum(i in kept for i in range(1, 200, 2)) <= 3 and sum(i in kept for i in range(0, 200, 2)) >= 95
    assert scores(spark, model, ["", None]) == pytest.approx([1 / (1 + np.exp(-model.bias))] * 2)
    flagged = table.select("doc_id", toxicity.held_out().alias("h")).collect()
    import zlib

    assert all(r["h"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in flagged)


def test_no_labels_and_one_label(docs, spark):
    table = docs([(1, "a"), (2, "b")])
    none = toxicity.train(table, spark.createDataFrame([], LABELS), "toxic")
    assert scores(spark, none, ["x", ""]) == [0.0, 0.0]
    one = toxicity.train(table, spark.createDataFrame([(1, 1, 1), (2, 1, 1)], LABELS), "toxic")
    assert min(scores(spark, one, ["x"])) > 0.5
    assert toxicity.keep_harmless(docs([]), spark.createDataFrame([], LABELS)).collect() == []


def test_slots_do_not_depend_on_the_place_of_a_word():
    one, two = set(hashed.slots("Straße quick")), set(hashed.slots("zz  Quick,\nvery long words before straße!"))
    assert one <= two
    assert len(hashed.slots("")) == len(hashed.slots(" ... ")) == 0
    assert set(hashed.slots("vilegrub")) & set(hashed.slots("vilegrubling"))


def test_the_sample_is_bounded_and_weighted(docs, spark):
    table = docs([(i, "t") for i in range(100)])
    labels = spark.createDataFrame([(i, int(i < 90)) for i in range(100)], "doc_id long, label int")
    rows = hashed.labelled_sample(labels, table, 20).collect()
    assert sorted((r["label"], r["weight"]) for r in rows) == [(0, 1.0)] * 10 + [(1, 9.0)] * 10


def test_a_repeated_id_is_one_row_of_the_sample(docs, spark):
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 0)], "doc_id long, label int")
    rows = [(1, f"text {i % 7}") for i in range(300)] + [(2, "two"), (3, None), (4, "four")]
    found = hashed.labelled_sample(labels, docs(rows)).collect()
    assert sorted((r["label"], r["weight"]) for r in found) == [(0, 1.0), (0, 1.0), (1, 1.0)]
    again = hashed.labelled_sample(labels, docs(rows[::-1])).collect()
    assert {r["text"] for r in found} == {r["text"] for r in again} and {"two", None} < {r["text"] for r in found}
