"""Line dedup against a plain version of the same rules."""

import re
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from storeglean.llm import hashed
from storeglean.llm import linededup as ld


def tokens(line):
    parts = [t for t in re.split("[ \t\x0b\f\r]+", line) if t]
    masked = [ld.FIELD if re.search("[0-9]", t) else t for t in parts]
    return tuple(masked if len(parts) - masked.count(ld.FIELD) >= ld.LITERAL_SHARE * len(parts) else parts)


def brute(rows):
    seen, places, total = defaultdict(set), [], Counter()
    for i, text in rows:
        for at, line in enumerate(text.split("\n")):
            t = tokens(line)
            if len(t) >= ld.MIN_TOKENS:
                seen[t].add(i)
                places.append((i, at, t))
                total[i] += len(t)
    stays = {t: min(d) for t, d in seen.items() if len(d) >= ld.VERBATIM_DOCS}
    leaves = defaultdict(list)
    for t in seen:
        leaves[len(t), t[: ld.DEPTH]].append(t)
    for kinds in leaves.values():
        if len(kinds) < 2 or sum(len(seen[t]) for t in kinds) < ld.TEMPLATE_DOCS:
            continue
        often = Counter()
        for t in kinds:
            for place in enumerate(t):
                often[place] += len(seen[t])
        children = Counter(i for i, _ in often)
        for wide in (False, True):
            shapes, of = defaultdict(set), {}
            for t in kinds:
                shape = tuple(
                    x if i < ld.DEPTH or (often[i, x] >= ld.TEMPLATE_DOCS and not (wide and children[i] > ld.MAX_CHILDREN)) else ld.FIELD
                    for i, x in enumerate(t)
                )
                if sum(x != ld.FIELD for x in shape) >= ld.LITERAL_SHARE * len(shape):
                    shapes[shape] |= seen[t]
                    of[t] = shape
            for t, shape in of.items():
                if len(shapes[shape]) >= ld.TEMPLATE_DOCS:
                    stays[t] = min(stays.get(t, 1 << 62), min(shapes[shape]))
    gone, share = defaultdict(set), Counter()
    for i, at, t in places:
        if i > stays.get(t, 1 << 62):
            gone[i].add(at)
            share[i] += len(t)
    return {
        i: "\n".join(x for at, x in enumerate(text.split("\n")) if at not in gone[i]) if share[i] < ld.COPY_SHARE * total[i] else text
        for i, text in rows
    }


def own(prose, i):
    return "\n".join(prose(1000 + 10 * i + k, 14) for k in range(5))


def test_templates_match_brute_force(docs, prose):
    words = prose(5, 400).split(" ")
    rows = []
    for i in range(120):
        lines = [own(prose, i), f"{i} 1 2 3 4 5 6 7 8 9"]
        if i % 3 == 0:
            lines.insert(0, f"All rights reserved by the people of this site {i}")
        if i % 4 == 0:
            lines.append(f"Posted by user {words[i]} in group {words[i % 5]} on the old board today")
        if i % 5 == 0:
            lines.append("short footer line")
        rows.append((i, "\n".join(lines)))
    rows += [(500 + i, rows[7][1]) for i in range(4)] + [(600, ""), (601, "\n\n")]
    found = {r["doc_id"]: r["text"] for r in ld.dedup_lines(docs(rows)).collect()}
    wanted = brute(rows)
    assert found == wanted
    assert "All rights" in found[0] and "All rights" not in found[3]
    assert "Posted by" in found[0] and sum("Posted by" in t for t in found.values()) < 5
    assert found[500] == rows[7][1]  # a copy is not for this operator
    assert found[5].endswith("short footer line")


def test_nulls_repeated_rows_and_clashing_columns(docs, prose):
    passage = prose(1, 60)
    rows = [(2, f"{own(prose, 1)}\n{passage}"), (9, f"{passage}\n{own(prose, 2)}"), (9, f"{passage}\n{own(prose, 2)}")]
    rows += [(None, f"{own(prose, 3)}\n{passage}"), (4, None), (None, None)]
    table = docs(rows).withColumn("_doc", F.lit(1)).withColumn("leaf", F.lit("l")).withColumn("doc", F.lit("d"))
    got = ld.dedup_lines(table).collect()
    assert len(got) == len(rows)
    held = [r for r in got if r["text"] and passage in r["text"]]
    assert [r["doc_id"] for r in held] == [None]  # no id is the smallest
    assert sorted(r["n_dropped"] for r in got) == [0, 0, 0, 1, 1, 1]
    assert ld.dedup_lines(docs([])).collect() == []


def test_a_common_line_in_very_many_documents(docs, prose):
    rows = [(i, f"this line stands in every document of the whole table\n{own(prose, i)}") for i in range(400)]
    got = {r["doc_id"]: r["n_dropped"] for r in ld.dedup_lines(docs(rows)).collect()}
    assert got == {i: int(i > 0) for i in range(400)}


def test_only_a_whole_text_makes_a_copy(docs, prose):
    passage, long = prose(1, 60), [prose(20 + k, 60) for k in range(4)]
    verse = "\n".join(prose(40 + k, 6) for k in range(30))
    short = prose(80, 10)
    rows = [(1, f"{own(prose, 1)}\n{passage}")] + [(10 + k, f"{own(prose, 10 + k)}\n{long[k]}") for k in range(4)]
    rows += [(20, f"{verse}\n{passage}"), (21, "\n".join([*long, short])), (22, f"{passage}\n{prose(90, 9)}")]
    rows += [(30, f"{verse}\n{passage}"), (31, passage)]
    found = {r["doc_id"]: r["text"] for r in ld.dedup_lines(docs(rows)).collect()}
    assert {i for i, t in found.items() if passage in t} == {1, 30}  # the whole text of 30 is that of 20
    assert found[20] == verse and found[21] == short and found[22] == prose(90, 9) and found[31] == ""
    everywhere = {r["doc_id"]: r["text"] for r in ld.dedup_lines(docs(rows), 1.1).collect()}
    assert everywhere == found | {30: verse}


def test_the_query_drops_lines_in_copies(docs, spark, prose, tmp_path):
    docs([(1, own(prose, 1)), (2, own(prose, 1))]).write.parquet(f"{tmp_path}/documents.parquet")
    assert {r["doc_id"]: r["text"] for r in ld.op2_line_dedup(spark, str(tmp_path)).collect()} == {1: own(prose, 1), 2: ""}


def test_templates_with_many_values_among_other_lines(docs, prose):
    names, cities = prose(1, 300).split(" ")[:10], prose(2, 300).split(" ")[:10]
    rows = []
    for i in range(160):
        line = f"this page was written by {names[i % 10]} who lives in {cities[i // 10 % 10]} and likes to hear from readers"
        rows.append((i, f"{own(prose, i)}\n{line}"))
    other = {500 + i: f"this page was {prose(5000 + i, 13)}" for i in range(20)}
    rows += [(i, f"{own(prose, i)}\n{line}") for i, line in other.items()]
    assert {len(t.split(" ")) for t in other.values()} == {len(line.split(" "))}
    found = {r["doc_id"]: r["text"] for r in ld.dedup_lines(docs(rows)).collect()}
    assert [i for i, t in found.items() if "who lives in" in t] == [0]
    assert all(line in found[i] for i, line in other.items())


def test_passages_of_short_lines_go_whole(docs, prose):
    verse = [prose(300 + k, 5 + k % 3) for k in range(12)]
    stanzas = "\n".join([*verse[:6], "", *verse[6:]])
    passage, name = prose(1, 60), prose(2, 2)
    rows = [(1, f"{own(prose, 1)}\n{stanzas}\n{prose(3, 4)}"), (2, f"{stanzas}\n{own(prose, 2)}"), (3, f"{prose(4, 3)}\n{stanzas}\n{own(prose, 3)}")]
    rows += [(4, f"{own(prose, 4)}\n{name}\n{passage}\n{name}"), (5, f"{name}\n{passage}\n{name}\n{own(prose, 5)}"), (6, f"{own(prose, 6)}\n{name}")]
    found = {r["doc_id"]: r["text"] for r in ld.dedup_lines(docs(rows), runs=True).collect()}
    assert found == {1: rows[0][1], 2: own(prose, 2), 3: f"{prose(4, 3)}\n{own(prose, 3)}", 4: rows[3][1], 5: own(prose, 5), 6: rows[5][1]}
    assert ld.short_runs(b"") == ld.short_runs(b"a b\n \nc") == []
    assert ld.short_runs(b"a b c d\n\n1 2 3 4\r\n" + b"w " * 9) == [(0, 2, b"a b c d 1 2 3 4\r"), (2, 3, b"1 2 3 4\r " + b"w " * 9)]


def candidates(text):
    """(first, last, tokens) of lines with enough tokens, and of the shortest runs from each short line either way."""
    lines = [(at, tokens(line), line) for at, line in enumerate(text.split("\n"))]
    out = [(at, at, t) for at, t, _ in lines if len(t) >= ld.MIN_TOKENS]
    held = [(at, line) for at, t, line in lines if t]
    spans = set()
    for k, (at, line) in enumerate(held):
        if len(line.split()) < ld.MIN_TOKENS:
            for step in (1, -1):
                end, n = k, len(line.split())
                while n < ld.MIN_TOKENS and 0 <= end + step < len(held):
                    end += step
                    n += len(held[end][1].split())
                if n >= ld.MIN_TOKENS:
                    spans.add((min(k, end), max(k, end)))
    return out + [(held[a][0], held[b][0], tokens(" ".join(x for _, x in held[a : b + 1]))) for a, b in spans]


def brute_whole(rows):
    """The whole rule, as the query has it: verbatim lines, both templates, clusters of alike lines, and runs."""
    seen, places = defaultdict(set), []
    for i, text in rows:
        for first, last, t in candidates(text):
            seen[t].add(i)
            places.append((i, first, last, t))
    stays = {t: min(d) for t, d in seen.items() if len(d) >= ld.VERBATIM_DOCS}

    def recur(shapes):
        """shapes: lists of kinds that are one template each."""
        for kinds in shapes:
            docs = set().union(*(seen[t] for t in kinds))
            if len(docs) >= ld.TEMPLATE_DOCS:
                for t in kinds:
                    stays[t] = min(stays.get(t, 1 << 62), min(docs))

    leaves = defaultdict(list)
    for t in seen:
        leaves[len(t), t[: ld.DEPTH]].append(t)
    for (n, _), kinds in leaves.items():
        if len(kinds) < 2 or sum(len(seen[t]) for t in kinds) < ld.TEMPLATE_DOCS:
            continue
        often = Counter()
        for t in kinds:
            for place in enumerate(t):
                often[place] += len(seen[t])
        children = Counter(i for i, _ in often)
        for wide in (False, True):
            shapes = defaultdict(list)
            for t in kinds:
                general = lambda i, x: i >= ld.DEPTH and (often[i, x] < ld.TEMPLATE_DOCS or (wide and children[i] > ld.MAX_CHILDREN))  # noqa: B023, E731
                shape = tuple(ld.FIELD if general(i, x) else x for i, x in enumerate(t))
                if sum(x != ld.FIELD for x in shape) >= ld.LITERAL_SHARE * n:
                    shapes[shape].append(t)
            recur(shapes.values())
        fields = int(n * (1 - ld.LITERAL_SHARE) + 1e-12)
        cut = [ld.DEPTH + k * (n - ld.DEPTH) // (fields + 1) for k in range(fields + 2)]
        for k in range(fields + 1):
            blocks = defaultdict(list)
            for t in kinds:
                blocks[t[cut[k] : cut[k + 1]]].append(t)
            for block in blocks.values():
                if len(block) < 2 or sum(len(seen[t]) for t in block) < ld.TEMPLATE_DOCS:
                    continue
                centre = []
                for i in range(n):
                    votes = Counter()
                    for t in block:
                        votes[t[i]] += len(seen[t])
                    centre.append(max(votes, key=lambda x: (votes[x], x)))  # noqa: B023
                alike = [t for t in block if sum(a == b != ld.FIELD for a, b in zip(t, centre, strict=True)) >= ld.LITERAL_SHARE * n]
                recur([alike] if alike else [])
    gone = defaultdict(set)
    for i, first, last, t in places:
        if i > stays.get(t, 1 << 62):
            gone[i] |= set(range(first, last + 1))
    return {i: "\n".join(x for at, x in enumerate(text.split("\n")) if at not in gone[i]) for i, text in rows}


def test_the_whole_rule_against_brute_force(docs, prose):
    import random

    rng = random.Random(8)
    words = prose(5, 3000).split(" ")
    rows = []
    for i in range(150):
        lines = [own(prose, i)]
        if i % 2:
            lines.append(f"this page was written by {words[rng.randrange(40)]} who lives in {words[100 + rng.randrange(40)]} and likes to hear from readers")
        if i % 3 == 0:
            lines.append(f"this page was {prose(5000 + i, 13)}")
        if i % 4 == 0:
            lines.insert(0, f"Posted by user {words[200 + i]} in group {words[i % 5]} on the old board today")
        if i % 5 == 0:
            lines += ["roses are red", "violets are", "", "sugar is sweet so", "and so are you"][: rng.randrange(2, 6)]
        if i % 7 == 0:
            lines.append(f"{i} 2 3 4 5 6 7 8 9 of the numbers here {i + 1}")
        if i % 11 == 0:
            lines.append(f"version {i} of the text of the licence of this site as of today")
        rng.shuffle(lines)
        rows.append((i, "\n".join(lines)))
    rows += [(500, rows[9][1]), (501, rows[9][1])]
    found = {r["doc_id"]: r["text"] for r in ld.dedup_lines(docs(rows), 1.1, runs=True).collect()}
    wanted = brute_whole(rows)
    assert {i: t for i, t in found.items() if t != wanted[i]} == {}
    assert sum("who lives in" in t for t in found.values()) < 5 and sum("roses are red" in t for t in found.values()) < 30


def test_texts_are_taken_apart_once(spark):
    docs = spark.range(3).selectExpr("id doc_id", "'one two three four five six seven eight nine' text")
    kinds = spark.createDataFrame([(1, 2, 8)], "leaf long, line long, n_docs long")
    sample = docs.select(F.lit(1.0).alias("label"), hashed.features("text").alias("x"))
    explode = sample.select("label", F.explode("x").alias("feature"))
    for df in (ld._lines(docs, True), ld._kinds(docs, kinds, True), explode):
        text = df._jdf.queryExecution().optimizedPlan().toString()
        assert sum("ArrowEvalPython" in line for line in text.splitlines()) == 1, text
