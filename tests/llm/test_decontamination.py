import hashlib

import pytest
from pyspark.sql import functions as F

from storeglean.llm import decontamination as dc


def words(text):
    out, word = [], ""
    for c in (text or "") + " ":
        c = c.lower() if "A" <= c <= "Z" else c
        if c.isascii() and not ("0" <= c <= "9" or "a" <= c <= "z"):
            if word:
                out.append(word)
            word = ""
        else:
            word += c
    return out


def brute(text, items):
    own, hit, ids = words(text), set(), set()
    for item, passage in items:
        w = words(passage)
        n = min(13, len(w))
        windows = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if w else set()
        for i in range(len(own) - n + 1):
            if tuple(own[i : i + n]) in windows:
                hit.update(range(i, i + n))
                if item is not None:
                    ids.add(item)
    digest = hashlib.sha256(",".join(sorted(map(str, ids))).encode()).hexdigest()
    return len(own), len(hit), len(ids), digest, bool(hit) and 20 * len(hit) >= len(own)


@pytest.fixture()
def case(docs, prose, spark):
    items = [(1, prose(1, 40)), (10, "Wer ist's? Ünser Haus"), (2, prose(2, 13)), (2, "again 2"), (None, "no id here"), (5, None), (6, "!!"), (7, "x")]
    texts = [
        prose(50, 100) + " " + prose(1, 40).upper().replace(" ", "--") + " " + prose(51, 30),
        "é wer IST s ünser haus, wer ist s ünser haus é", "xx x", "axb", prose(1, 12), prose(2, 13), " ".join(prose(1, 40).split(" ")[5:25]),
        "again 2 again 2", "there is no id here", "", None, "...", prose(60, 3000) + " x", prose(2, 13) + " " + prose(61, 247), prose(2, 13) + " " + prose(61, 248),
    ]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, texts[0]), (3, texts[5]), (3, texts[5])]
    return docs(rows), spark.createDataFrame(items, "item_id long, text string"), rows, items


def test_report_matches_brute_force(case):
    table, benchmark, rows, items = case
    got = [tuple(r) for r in dc.report(table.withColumn("found", F.lit(1)), benchmark).collect()]
    assert sorted(got, key=str) == sorted(((i, *brute(t, items)) for i, t in rows), key=str)
    left = dc.clean(table.withColumn("_hits", F.lit(1)), benchmark).collect()
    assert sorted(str(r["doc_id"]) for r in left) == sorted(str(i) for i, t in rows if not brute(t, items)[-1])


def test_blocks_of_the_benchmark_give_the_same(case):
    table, benchmark, _, _ = case
    whole = dc.hits(table.select("doc_id", "text"), benchmark, "h").collect()
    parts = dc.hits(table.select("doc_id", "text"), benchmark, "h", block_bytes=60).collect()
    assert sorted(map(str, whole)) == sorted(map(str, parts))


def test_places_in_the_original_text(docs, spark):
    benchmark = spark.createDataFrame([(1, "größe des hauses")], "item_id long, text string")
    text = "Ö —  größe..DES\nHauses! und größe des hauses"
    found = dc.hits(docs([(1, text)]), benchmark, "h").first()["h"]
    assert [text[a:b] for a, b in zip(found["places"], found["ends"], strict=True)] == ["größe..DES\nHauses", "größe des hauses"]


def test_empty_tables(docs, spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert dc.report(docs([(1, "a b")]), none).first()["contaminated"] is False
    assert dc.report(docs([]), none).collect() == []
