import re
from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F

from storeglean.llm import anomaly

LABELS = "doc_id long, quality int, toxic int"


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    places = defaultdict(list)
    for i in range(len(words) - 7):
        places[tuple(words[i : i + 8])].append(i)
    again = {j for v in places.values() if len(v) > 1 for i in v for j in range(i, i + 8)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(again)


def test_statistics(docs, prose):
    texts = [prose(1, 30), (prose(2, 9) + " ") * 3, "a b " * 40, "x\n\nx\n x\nx\r\n", "é<|>\x85 \xa0ü#\x1cq", "", None, "one two three four five six seven eight", "a " * 9]
    texts += [" ".join(prose(k, 60, 3).split(" ")) for k in range(20)] + [prose(5, 20_000) + " " + prose(5, 50)]
    names = anomaly.STATS[:5]
    rows = docs(list(enumerate(texts))).select("doc_id", anomaly.statistics("text").alias("s")).collect()
    assert {r["doc_id"]: tuple(r["s"][n] for n in names) for r in rows} == {i: brute(t) for i, t in enumerate(texts)}


def test_forest_sets_outliers_apart():
    rng = np.random.default_rng(1)
    rows = np.concatenate([rng.normal(0, 1, (2000, 3)), rng.normal(9, 1, (20, 3))])
    score = anomaly.grow(rows).score(rows)
    assert score[2000:].min() > np.quantile(score[:2000], 0.98)
    again = anomaly.grow(rows).score(rows)
    assert (score == again).all()
    assert (anomaly.grow(np.empty((0, 3))).score(rows[:4]) == 0.5).all()
    assert np.isfinite(anomaly.grow(np.zeros((1, 3))).score(rows[:4])).all()


def test_junk_goes_and_clean_documents_stay(docs, spark, prose):
    clean = [(i, prose(i, 40 + i)) for i in range(150)]
    junk = [(1000 + i, " ".join(w.upper() + "!!" for w in prose(i, 50 + 17 * i).split(" "))) for i in range(8)]
    bad = [(2000, "a b c"), (2001, None), (2002, ""), (2003, (prose(7, 10) + " ") * 6)]
    labels = spark.createDataFrame([(i, 1, 0) for i in range(0, 150, 2)] + [(1000 + i, 0, 0) for i in range(0, 8, 2)] + [(2000, 0, 0), (4, None, 0), (None, 1, 1)], LABELS)
    table = docs([*clean, *junk, *bad, (3, clean[3][1]), (None, clean[5][1])]).withColumn("score", F.lit("s")).withColumn("n_words", F.lit(None))
    got = anomaly.judge(table, labels, good_loss=0.04).collect()
    kept = {r["doc_id"]: r["kept"] for r in got}
    assert len(got) == len(clean) + len(junk) + len(bad) + 2
    assert sum(kept[i] for i, _ in clean) >= 142 
    assert not any(kept[i] for i, _ in [*junk, *bad])
    assert {r["doc_id"] for r in got if r["base_failed"]} == {2000, 2001, 2002, 2003}


def test_without_labels_or_rows(docs, spark, prose):
    none = spark.createDataFrame([], LABELS)
    assert [r["kept"] for r in anomaly.judge(docs([(1, prose(1, 30)), (2, "short")]), none).orderBy("doc_id").collect()] == [True, False]
    assert anomaly.judge(docs([]), none).collect() == []


def test_rows_without_id_do_not_fill_the_sample(docs, prose):
    rows = [(None, prose(i, 25)) for i in range(60)] + [(None, prose(100 + i, 90)) for i in range(60)] + [(i, prose(200 + i, 50)) for i in range(60)]
    rows += [(None, prose(1, 25))] * 40
    stats = docs(rows).select("doc_id", F.xxhash64("text").alias("text_hash"), anomaly.statistics("text").alias("s")).select("doc_id", "text_hash", "s.*")
    words = [r["n_words"] for r in anomaly.sampled(stats, 60).collect()]
    assert len(words) == 60 and min(words.count(n) for n in (25, 50, 90)) >= 8
    assert anomaly.sampled(stats, 1000).count() == 180
