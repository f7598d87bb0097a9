"""Folded Q:/A: text against a plain statement of the rules."""

import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from storeglean.functions.faq import from_text
from storeglean.rules import DISPLAY


def sequential(text):
    out, question, parts = [], None, []

    def close():
        if question and parts:
            out.append((question[:200], " ".join(parts)[:500]))

    for line in (s.strip() for s in text.split("\n")):
        if not line:
            continue
        if re.match(r"Q:|Question:|Q\.", line) or line.endswith("?"):
            close()
            question, parts = re.sub(r"^(Q:|Question:|Q\.)\s*", "", line), []
        elif re.match(r"A:|Answer:|A\.", line):
            parts.append(re.sub(r"^(A:|Answer:|A\.)\s*", "", line))
        elif question and len(parts) < 3:
            parts.append(line)
    close()
    return out[:20]


line = st.sampled_from(
    ["Q: a", "Q:", "Question: b?", "Q.c", "why?", "?", "A: x", "A:", "Answer: y" * 60, "A.z", "plain", " \t", "d" * 300, "\xa0e\xa0", "A: what?"]
)


@settings(max_examples=6, deadline=None)
@given(st.lists(st.lists(line, max_size=40).map("\n".join), min_size=50, max_size=50))
def test_from_text(spark, texts):
    rows = spark.createDataFrame([(t,) for t in texts], "t string").coalesce(1)
    found = [[(p["question"], p["answer"]) for p in r[0]] for r in rows.select(from_text(F.col("t"), DISPLAY)).collect()]
    assert found == [sequential(t) for t in texts]


def test_example(spark):
    rows = spark.createDataFrame([("Q: a\nA: b\nc\nd\ne",)], "t string")
    assert [tuple(p) for p in rows.select(from_text(F.col("t"))).first()[0]] == [("a", "b c d")]
