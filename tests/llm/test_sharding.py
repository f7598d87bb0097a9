import zlib

from pyspark.sql import functions as F

from storeglean.llm import sharding


def test_layout_of_nulls_ties_and_repeated_rows(docs):
    rows = [(i % 40 - 5, f"text {i % 7} é") for i in range(300)] + [(None, None), (None, ""), (3, None), (3, None)]
    table = docs(rows).withColumn("shard", F.lit("x")).withColumn("slot", F.lit("y"))
    got = sharding.layout(table, 5).collect()
    assert len(got) == len(rows)
    want = sorted((str(i), len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows)
    assert sorted((str(r["doc_id"]), r["size"], r["text_crc32"]) for r in got) == want
    for s in range(5):
        slots = sorted(r["slot"] for r in got if r["shard"] == s)
        assert slots == list(range(len(slots)))
    by_key = {}
    for r in got:
        assert by_key.setdefault(r["doc_id"], (r["shard"], r["grown_shard"])) == (r["shard"], r["grown_shard"])
        assert r["grown_shard"] in (r["shard"], 5)
    assert sharding.layout(docs([])).collect() == []


def test_slots_do_not_depend_on_partitions_or_buckets(docs, monkeypatch):
    rows = [(i, f"t{i}") for i in range(500)]
    one = sharding.layout(docs(rows).repartition(1)).collect()
    real = sharding.ranked
    monkeypatch.setattr(sharding, "ranked", lambda *a: real(*a, rows_per_bucket=7))
    many = sharding.layout(docs(rows[::-1]).repartition(9)).collect()
    assert sorted(map(tuple, one)) == sorted(map(tuple, many))


def test_weights_decide_shares_and_few_rows_move(spark):
    keys = spark.range(40_000).withColumnRenamed("id", "k")
    counts = {r["shard"]: r["count"] for r in sharding.assign(keys, ["k"], [1.0, 3.0, 0.0]).groupBy("shard").count().collect()}
    assert set(counts) == {0, 1}
    assert abs(counts[1] / 40_000 - 0.75) < 0.02
    moved = sharding.moved(keys, ["k"], [1.0] * 9, [1.0] * 10).collect()
    assert all(r["from_shard"] == r["to_shard"] or r["to_shard"] == 9 for r in moved)
    assert abs(sum(r["n_rows"] for r in moved if r["to_shard"] == 9) / 40_000 - 0.1) < 0.01


def test_shards_are_written_whole(spark, tmp_path):
    keys = spark.range(200).select(F.col("id").alias("k"), F.lit(1).alias("Shard"))
    sharding.write(keys, ["k"], [1.0, 2.0], str(tmp_path / "out"), 3)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.select("k").distinct().count() == back.count() == 200
