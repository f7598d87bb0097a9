"""Near-duplicates against a brute-force comparison of all pairs."""

import random

import pytest
from pyspark.sql import functions as F

from storeglean.llm import neardup
from storeglean.llm.components import components


def shingle_set(text, words):
    parts = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        parts = parts.replace(c, " ")
    parts = [p for p in parts.split(" ") if p]
    if len(parts) < words:
        return {tuple(parts)} if parts else set()
    return {tuple(parts[i : i + words]) for i in range(len(parts) - words + 1)}


def brute(rows, words, percent):
    """doc_id -> (size of set, component)."""
    sets = [(i, shingle_set(t, words)) for i, t in rows]
    label = {i: i for i, _ in rows}

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for k, (a, s) in enumerate(sets):
        for b, t in sets[:k]:
            if s and t and 100 * len(s & t) >= percent * len(s | t):
                x, y = sorted((root(a), root(b)))
                label[y] = x
    return {i: (len(s), root(i)) for i, s in sets}


def copies(prose, seed, n, base_words=160):
    """One text and copies with more and more words changed, dropped or added."""
    rng = random.Random(seed)
    base = prose(seed, base_words).split(" ")
    out = [" ".join(base)]
    for _ in range(n):
        words = list(base)
        for _ in range(rng.randrange(0, 14)):
            at = rng.randrange(len(words))
            change = rng.randrange(3)
            if change == 0:
                words[at] = f"n{rng.randrange(10**6)}"
            elif change == 1:
                del words[at]
            else:
                words.insert(at, f"n{rng.randrange(10**6)}")
        out.append(" ".join(words))
    return out


@pytest.mark.parametrize(("words", "similarity"), [(3, 0.85), (5, 0.8)])
def test_components_match_brute_force(docs, prose, words, similarity):
    texts = [t for s in range(4) for t in copies(prose, s, 70)] + [prose(100 + s, 50) for s in range(60)]
    texts += [texts[5]] * 20 + ["", None, " \n ", "one two", "ONE  two", "one", prose(7, 3)] + [prose(9, 9000)]
    order = random.Random(3).sample(range(len(texts)), len(texts))
    rows = [(i * 7 - 300, texts[k]) for i, k in enumerate(order)]
    found = {r["doc_id"]: r for r in neardup.near_duplicates(docs(rows), words, similarity).collect()}
    wanted = brute(rows, words, round(100 * similarity))
    assert {i: (r["n_shingles"], r["component_id"]) for i, r in found.items()} == wanted
    assert all(r["kept"] == (i == r["component_id"]) for i, r in found.items())
    assert len({c for _, c in wanted.values()}) < len(rows) - 100


def test_long_lists_are_counted_in_blocks(docs, prose, monkeypatch):
    monkeypatch.setattr(neardup, "LIST_BLOCK", 16)
    monkeypatch.setattr(neardup, "TEXT_BLOCK", 8)
    monkeypatch.setattr(neardup, "PAIRS_AT_ONCE", 50)
    rows = list(enumerate(t for s in range(2) for t in copies(prose, s, 80)))
    found = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in neardup.near_duplicates(docs(rows), 3, 0.85).collect()}
    assert found == brute(rows, 3, 85)


def test_keep_one_of_each_group(docs, prose):
    a, b = prose(1, 80), prose(2, 80)
    rows = [(5, a), (3, a), (9, b), (9, b), (7, ""), (8, None), (None, a), (None, b), (2, "")]
    table = docs(rows).withColumn("node", F.lit("x")).withColumn("_goes", F.lit(1)).withColumn("fp", F.lit(None))
    left = neardup.keep_one(table)
    assert left.columns == table.columns
    got = [(r["doc_id"], r["text"]) for r in left.collect()]
    assert sorted(got, key=str) == sorted([(3, a), (9, b), (7, ""), (8, None), (None, a), (None, b), (2, "")], key=str)


def test_empty_table(docs):
    assert neardup.near_duplicates(docs([])).collect() == []
    assert neardup.keep_one(docs([])).collect() == []


def test_rows_of_one_id_are_one_document(docs, prose):
    a, b = prose(1, 60), prose(2, 60)
    rows = [(4, a), (4, b), (1, a), (2, b)]
    assert {r["component_id"] for r in neardup.near_duplicates(docs(rows)).collect()} == {1}


def test_threshold_misses_hardly_any(spark):
    from math import comb

    for similarity in (0.8, 0.85):
        m, k = neardup.matches_for(similarity), neardup.COORDINATES
        assert sum(comb(k, i) * similarity**i * (1 - similarity) ** (k - i) for i in range(m)) <= neardup.MISS


def test_components_of_a_path_a_star_and_nothing(spark):
    links = [(i, i + 1) for i in range(10, 60)] + [(100, 100 + i) for i in range(1, 40)] + [(7, 7), (None, 3)]
    found = {r["node"]: r["component"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert found == {**{i: 10 for i in range(10, 61)}, **{i: 100 for i in range(100, 140)}}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []
