"""Tables of buckets and run-safe appends: what is read, what a repeated or failed run leaves."""

import datetime as dt
import re

import pytest
from pyspark.sql import functions as F

from storeglean.operators import bucketed, stores
from storeglean.plans import competitors
from storeglean.sources import workspace

DAY = dt.datetime(2024, 1, 1)


def at(n):
    return F.lit(DAY + dt.timedelta(days=n))


def records(spark, ids, score, day):
    rows = [(f"https://s{i}.com/", float(score), DAY + dt.timedelta(days=day)) for i in ids]
    return spark.createDataFrame(rows, "website_url string, quality_score double, extraction_timestamp timestamp")


def shown(df):
    return sorted((r["website_url"], r["quality_score"], r["created_at"], r["updated_at"]) for r in df.collect())


def files(df):
    return {re.search(r"run=([^/]*)/bucket=(\d+)", f).groups() for f in df.inputFiles()}


def test_only_touched_buckets_are_read_and_written(spark, tmp_path):
    place = str(tmp_path / "t")
    stores.upsert_buckets(spark, place, records(spark, range(40), 1, 0), at(0), "first", buckets=16)
    before = bucketed.state(spark, place)
    assert set(before.runs.values()) == {"first"} and len(before.runs) > 8
    two = stores.upsert_buckets(spark, place, records(spark, [3, 100], 2, 1), at(1), "second")
    after = bucketed.state(spark, place)
    touched = {b for b, run in after.runs.items() if run == "second"}
    assert 1 <= len(touched) <= 2
    assert {b for b in after.runs if after.runs[b] != before.runs.get(b)} == touched
    assert workspace.names_in(spark, f"{place}/data/run=second") == sorted(["_SUCCESS", *(f"bucket={b}" for b in touched)])
    rows = {r[0]: r[1:] for r in shown(two)}
    assert len(rows) == 41
    assert rows["https://s3.com/"] == (2.0, DAY, DAY + dt.timedelta(days=1))
    assert rows["https://s4.com/"] == (1.0, DAY, DAY) and rows["https://s100.com/"][1] == DAY + dt.timedelta(days=1)


def test_it_agrees_with_the_upsert_of_whole_tables(spark, tmp_path):
    place = str(tmp_path / "t")
    none = records(spark, [], 0, 0).withColumns({"created_at": at(0), "updated_at": at(0)})
    whole = none
    for day in range(4):
        rows = records(spark, range(day * 5, day * 5 + 12), day, day)
        whole = stores.upsert(whole, rows.unionByName(rows), at(day))
        table = stores.upsert_buckets(spark, place, rows.unionByName(rows), at(day), f"day {day}", buckets=8)
    assert shown(table) == shown(whole)


def test_repeated_and_failed_runs(spark, tmp_path):
    place = str(tmp_path / "t")
    one = stores.upsert_buckets(spark, place, records(spark, range(9), 1, 0), at(0), "1", buckets=4)
    wanted = shown(one)
    assert shown(stores.upsert_buckets(spark, place, records(spark, range(9), 5, 5), at(5), "1")) == wanted  # done already
    broken = records(spark, range(9), 2, 1).withColumn("quality_score", F.raise_error(F.lit("lost")).cast("double"))
    with pytest.raises(Exception, match="lost"):
        stores.upsert_buckets(spark, place, broken, at(1), "2")
    assert shown(bucketed.read(spark, place)) == wanted
    two = shown(stores.upsert_buckets(spark, place, records(spark, range(9), 2, 1), at(1), "2"))
    assert {r[1] for r in two} == {2.0}
    assert bucketed.vacuum(spark, place, keep=1) == ["run=1"]
    assert shown(bucketed.read(spark, place)) == two
    assert shown(stores.upsert_buckets(spark, place, records(spark, range(9), 5, 5), at(5), "1")) == two


def test_look_up_reads_one_bucket(spark, tmp_path):
    place = str(tmp_path / "t")
    stores.upsert_buckets(spark, place, records(spark, range(200), 1, 0), at(0), "a/../b", buckets=32)
    found = stores.lookup_bucket(spark, place, "S7.com")
    assert [r["website_url"] for r in found.collect()] == ["https://s7.com/"]
    assert len(found.inputFiles()) == 1 and "PushedFilters: [IsNotNull(website_url), EqualTo(website_url" in found._jdf.queryExecution().executedPlan().toString()
    assert stores.lookup_bucket(spark, place, "other.com").count() == 0


def test_new_columns_no_keys_and_empty_runs(spark, tmp_path):
    place = str(tmp_path / "t")
    with pytest.raises(ValueError, match="no table"):
        bucketed.read(spark, place)
    assert stores.upsert_buckets(spark, place, records(spark, [], 1, 0), at(0), "0", buckets=4).count() == 0
    stores.upsert_buckets(spark, place, records(spark, [1], 1, 0), at(0), "1")
    more = records(spark, [2], 2, 1).withColumn("country", F.lit("US"))
    keyless = more.withColumn("website_url", F.lit(None).cast("string"))
    table = stores.upsert_buckets(spark, place, more.unionByName(keyless), at(1), "2")
    assert {r["website_url"]: r["country"] for r in table.collect()} == {"https://s1.com/": None, "https://s2.com/": "US"}
    with pytest.raises(ValueError, match="called bucket"):
        stores.upsert_buckets(spark, place, more.withColumn("Bucket", F.lit(1)), at(1), "3")
    with pytest.raises(ValueError, match="run_id"):
        stores.upsert_buckets(spark, place, more, at(1), "")


def test_cache_of_buckets(spark, tmp_path):
    def rows(day, *domains):
        made = [("B", d, "home", [f"{d}.{day}"], DAY + dt.timedelta(days=day)) for d in domains]
        return spark.createDataFrame(made, "brand_name string, domain string, industry string, competitor_domains array<string>, last_updated timestamp")

    place = str(tmp_path / "c")
    competitors.update_cache_buckets(spark, place, rows(1, "a", "b", "c"), "1", buckets=4)
    cache = competitors.update_cache_buckets(spark, place, rows(2, "b", "d").unionByName(rows(0, "a")), "2")
    assert {r["domain"]: r["competitor_domains"] for r in cache.collect()} == {"a": ["a.1"], "b": ["b.2"], "c": ["c.1"], "d": ["d.2"]}


def test_an_append_that_is_repeated_adds_once(spark, tmp_path):
    stores.create_tables(spark, str(tmp_path), "x_")
    log = spark.createDataFrame([(f"https://s{i}.com/", True, None, 1.0, 5.0) for i in range(3)], "website_url string, extraction_success boolean, error_messages array<string>, extraction_duration_seconds double, quality_score double")
    rows = stores.run_log(log, at(0))
    try:
        stores.append(rows.limit(1), "x_extraction_logs", "r1")
        stores.append(rows, "x_extraction_logs", "r1")
        stores.append(rows, "x_extraction_logs", "r2")
        with pytest.raises(Exception, match="lost"):
            stores.append(rows.withColumn("status", F.raise_error(F.lit("lost")).cast("string")), "x_extraction_logs", "r2")
        assert {r["run_id"]: r["count"] for r in spark.table("x_extraction_logs").groupBy("run_id").count().collect()} == {"r1": 3, "r2": 3}
        stores.append(rows, "x_extraction_logs")
        assert spark.table("x_extraction_logs").count() == 9
    finally:
        for name in ("extraction_logs", "competitor_analyses", "industry_leaders", "competitors"):
            spark.sql(f"DROP TABLE x_{name}")


def test_a_cluster_needs_a_named_folder(spark, monkeypatch):
    assert workspace.shared_dir(spark)

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

        class conf:
            get = staticmethod(lambda *_: None)

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        workspace.shared_dir(Session())
