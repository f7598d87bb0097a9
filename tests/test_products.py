"""Categories by lists and by response, and products grouped by category in chunks."""

import json

from pyspark.sql import functions as F

from storeglean.operators import products
from storeglean.queries import products as queries


def test_categories_by_response(spark):
    rows = [("a", "Mug", 1, "T"), ("a", "Cup", 2, ""), ("a", "Mug", 3, None), ("b", "Mug", 4, "T"), ("c", "Cup", 5, ""), (None, "Cup", 6, "U"), ("a", None, 7, "V")]
    table = spark.createDataFrame(rows, "store string, name string, pos long, product_type string")
    lists = {"Drink": ["Mug", "Cup", "Mug"], "Red": ["Mug"], "Empty": [], "None": None}
    responses = spark.createDataFrame([("a", f"```json\n{json.dumps(lists)}\n```"), ("b", "no list"), ("z", "{}")], "store string, response string")
    found = products.categorize(table, responses)
    assert sorted((r["category"], r["pos"]) for r in found.collect()) == [
        ("Drink", 1), ("Drink", 2), ("Drink", 3), ("Other", 5), ("Red", 1), ("Red", 3), ("T", 4), ("U", 6),
    ]
    assert set(found.columns) == {"store", "name", "pos", "product_type", "category"}
    text = found._jdf.queryExecution().optimizedPlan().toString()
    assert "map_filter" not in text and "collect_set" not in text


def test_chunks_of_categories(spark):
    rows = spark.range(1000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise("cold").alias("store"),
        F.when(F.col("id") % 5 == 0, "X").otherwise("Y").alias("category"),
        (F.col("id") * F.col("id")).alias("pos"),  # with gaps
        F.concat(F.lit("n"), F.col("id").cast("string")).alias("name"),
    )
    found = {}
    for r in products.grouped(rows, chunk=64).collect():
        assert len(r["products"]) <= 64 and r["first"] == 64 * r["chunk"]
        found.setdefault((r["store"], r["category"]), {})[r["chunk"]] = [tuple(p) for p in r["products"]]
    wanted = {}
    for r in rows.orderBy("pos").collect():
        wanted.setdefault((r["store"], r["category"]), []).append((r["pos"], r["name"]))
    assert {k: [p for c in sorted(v) for p in v[c]] for k, v in found.items()} == wanted
    assert all(len(c) == 64 for v in found.values() for k, c in v.items() if k < max(v))


def test_positions_are_gapless(spark):
    rows = spark.createDataFrame([("g", 5), ("g", -3), ("g", 10**12), ("h", 0)], "g string, p long")
    found = products.positions(rows, ["g"], "p", "place", 2).orderBy("g", "p").collect()
    assert [tuple(r) for r in found] == [("g", -3, 0), ("g", 5, 1), ("g", 10**12, 2), ("h", 0, 0)]


def test_all_types_are_keywords(spark, tmp_path):
    kinds = ["LARGE", "SMALL", "PROMO", "MEDIUM", "LARGE", "ECONOMY", "STANDARD"]
    rows = [(k, kind) for k, kind in enumerate(kinds)] + [(20, "PROMO")]
    spark.createDataFrame(rows, "p_partkey long, p_type string").write.parquet(f"{tmp_path}/part.parquet")
    types = "makeup,jewelry,fashion,home decor,sport shoes"
    found = queries.product_type_keywords(spark, str(tmp_path)).select("store", "keywords", "saved").collect()
    assert sorted(tuple(r) for r in found) == [(0, types, types), (1, "", "")]
