import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from storeglean.llm import langid

TEXT = {
    "en": "the weather in the north was cold and the people of the town were waiting for the train that should bring them home",
    "de": "das wetter im norden war kalt und die leute der stadt warteten auf den zug der sie wieder nach hause bringen sollte",
    "fr": "le temps dans le nord était froid et les gens de la ville attendaient le train qui devait les ramener à la maison",
}


@pytest.fixture(scope="module")
def model(spark):
    rows = [(f"{t} " * 40, lang) for lang, t in TEXT.items()] + [(None, "en"), ("", "de"), ("xyz", None)]
    return langid.learn(spark.createDataFrame(rows, "text string, lang string"))


def test_single_and_mixed_texts(docs, model):
    rows = [(1, TEXT["de"][10:60]), (2, f"{TEXT['en']} {TEXT['fr']}"), (3, TEXT["fr"].upper()), (4, f"{TEXT['en'] * 3} {TEXT['de']}")]
    got = {r["doc_id"]: r for r in langid.predict(docs(rows).withColumn("m", F.lit(1)), model).collect()}
    assert got[1]["langs"] == ["de"] and got[1]["score"] == 1.0
    assert set(got[2]["langs"]) == {"en", "fr"} and abs(got[2]["score"] - 0.5) < 0.1
    assert got[3]["langs"] == ["fr"]
    assert got[4]["langs"] == ["en", "de"] and abs(got[4]["score"] - 0.75) < 0.1


def test_undetermined_repeated_and_long(docs, model):
    rows = [(1, None), (2, ""), (3, "12 !? ²"), (None, TEXT["en"]), (5, TEXT["de"]), (5, TEXT["de"]), (6, TEXT["en"] * 2000)]
    got = langid.predict(docs(rows), model).collect()
    assert sorted((str(r["doc_id"]), r["lang_pred"]) for r in got) == sorted(
        [("1", "und"), ("2", "und"), ("3", "und"), ("None", "en"), ("5", "de"), ("5", "de"), ("6", "en")]
    )
    assert all((r["score"] == 0) == (r["lang_pred"] == "und") and 0 <= r["score"] <= 1 for r in got)
    assert all(r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got)


def test_nothing_learnt_and_nothing_to_do(docs, spark, model):
    empty = langid.learn(spark.createDataFrame([], "text string, lang string"))
    assert [(r["lang_pred"], r["score"]) for r in langid.predict(docs([(1, "abc")]), empty).collect()] == [("und", 0.0)]
    assert langid.predict(docs([]), model).collect() == []


def test_mixture_finds_the_likeliest_shares():
    rng = np.random.default_rng(3)
    p = rng.dirichlet(np.ones(50), 3)
    counts = 10_000 * (0.7 * p[0] + 0.3 * p[2])
    shares, likely = langid._mixture(p, counts)
    assert np.allclose(shares, [0.7, 0, 0.3], atol=0.01)
    for _ in range(50):
        other = rng.dirichlet(np.ones(3))
        assert counts @ np.log(other @ p) <= likely + 1e-3
