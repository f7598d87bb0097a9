import math
import random

from pyspark.sql import functions as F

from storeglean.llm import ordinal


def graded(n, seed):
    """Texts whose grade, 0 to 3, follows how many good words they have."""
    rng = random.Random(seed)
    out = []
    for i in range(n):
        grade = rng.randrange(4)
        words = [rng.choice(["alpha", "beta", "gamma", "delta"]) + rng.choice("klmn") for _ in range(10)]
        words += ["splendid", "careful", "thorough"][:grade]
        rng.shuffle(words)
        out.append((i, " ".join(words), grade))
    return out


def fitted(spark, rows):
    return ordinal.fit(spark.createDataFrame([(t, float(y), 1.0) for _, t, y in rows], "text string, label double, weight double"))


def test_grades_of_held_out_texts(docs, spark):
    model = fitted(spark, graded(500, 1))
    assert model.grades == [0.0, 1.0, 2.0, 3.0]
    assert model.thresholds == sorted(model.thresholds) and len(model.thresholds) == 3
    test = graded(200, 2)
    found = {r["doc_id"]: r for r in ordinal.rate(docs([(i, t) for i, t, _ in test]), model).collect()}
    assert sum(abs(found[i]["expected_grade"] - y) < 0.5 for i, _, y in test) > 180
    for r in found.values():
        assert list(r["tails"]) == sorted(r["tails"], reverse=True)
        assert math.isclose(r["expected_grade"], sum(r["tails"]), rel_tol=1e-9)


def test_odd_inputs(docs, spark):
    model = fitted(spark, graded(60, 1))
    table = docs([(1, None), (1, None), (None, ""), (3, "splendid " * 30_000)]).withColumn("sum", F.lit(1))
    rows = ordinal.rate(table, model).collect()
    assert len(rows) == 4 and len({r["expected_grade"] for r in rows if not r["doc_id"] == 3}) == 1
    one = fitted(spark, [(1, "a", 2)])
    assert [tuple(r) for r in ordinal.rate(docs([(1, "x")]), one).collect()] == [(1, 2.0, [])]
    none = fitted(spark, [])
    assert [tuple(r) for r in ordinal.rate(docs([(1, "x")]), none).collect()] == [(1, None, [])]
    assert ordinal.rate(docs([]), model).collect() == []
