"""The competitor job as one chain: cache in and out, repeated runs, and the look-up of leaders by a part of a name."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from storeglean.operators import bucketed, leaders
from storeglean.plans import competitors

PRODUCTS = "website_url string, brand_name string, product_catalog array<struct<name:string,product_type:string>>, total_products int"
KNOWN = "website_url string, brand_name string, total_products int, faqs array<string>, social_handles array<string>"


def at(day):
    return F.lit(dt.datetime(2024, 1, day))


@pytest.fixture()
def job(spark, tmp_path):
    known = spark.createDataFrame([("https://x.com/", "X", 4, ["q"], ["a", "b"])], KNOWN)
    table = spark.createDataFrame([("toys", ["x.com", "y.com"], dt.datetime(2024, 1, 1))], "industry string, top_brands array<string>, last_updated timestamp")
    words = table.withColumn("industry", F.lit("cosmetics"))

    def run(names, day, run_id, links=()):
        stores = spark.createDataFrame([(f"https://{n}.com/", n, [("red", "Makeup")], 3) for n in names], PRODUCTS)
        results = spark.createDataFrame(list(links) or [("nobody", 1, "https://z.com")], "brand_name string, rank int, link string")
        return competitors.pipeline(spark, str(tmp_path), stores, words, known, at(day), run_id, results, 4, buckets=4)

    return run


def shown(df):
    return sorted((r["main_brand_url"], r["analysis_summary"], [c["website_url"] for c in r["competitors"]], r["analysis_timestamp"].day) for r in df.collect())


def test_runs_use_and_fill_the_cache(spark, job, tmp_path):
    one = shown(job(["a", "x"], 1, "r1", [("a", 1, "https://z.com/path"), ("a", 2, "https://a.com/")]))
    assert one == [("https://a.com/", "Found 3 competitors", ["https://x.com"], 1), ("https://x.com/", "Found 1 competitors", [], 1)]
    cache = {r["domain"]: (r["competitor_domains"], r["last_updated"].day) for r in bucketed.read(spark, f"{tmp_path}/competitors").collect()}
    assert cache == {"a.com": (["x.com", "y.com", "z.com", "a.com"], 1), "x.com": (["x.com", "y.com"], 1)}
    two = job(["a", "b"], 2, "r2", [("a", 1, "https://other.com")])  # a is in the cache: no search
    assert shown(two) == [("https://a.com/", "Found 3 competitors", ["https://x.com"], 2), ("https://b.com/", "Found 2 competitors", ["https://x.com"], 2)]
    after = {r["domain"]: r["last_updated"].day for r in bucketed.read(spark, f"{tmp_path}/competitors").collect()}
    assert after == {"a.com": 1, "x.com": 1, "b.com": 2}
    saved = spark.read.parquet(f"{tmp_path}/competitor_analyses")
    assert saved.groupBy("run_id").count().where("count = 2").count() == 2


def test_a_repeated_run_leaves_the_same(spark, job, tmp_path):
    links = [("a", 1, "https://z.com/path")]
    job(["c"], 1, "r0")
    wanted = shown(job(["a"], 1, "r1", links))
    job(["b"], 2, "r2")
    assert shown(job(["a"], 1, "r1", links)) == wanted
    assert spark.read.parquet(f"{tmp_path}/competitor_analyses").count() == 3
    assert [v[1] for v in bucketed._versions(spark, f"{tmp_path}/competitors")] == ["r0", "r1", "r2"]


def test_only_brands_without_a_list_are_searched_for(spark):
    brands = spark.createDataFrame([("A", "a.com", "toys"), ("B", "b.com", "toys"), ("C", None, None)], "brand_name string, domain string, industry string")
    cache = spark.createDataFrame([("A", "a.com", "toys", ["k.com"], dt.datetime(2024, 1, 1)), ("B", "b.com", "toys", [], dt.datetime(2024, 1, 1))], "brand_name string, domain string, industry string, competitor_domains array<string>, last_updated timestamp")
    table = spark.createDataFrame([("toys", ["x.com"], dt.datetime(2024, 1, 1))], "industry string, top_brands array<string>, last_updated timestamp")
    found = competitors.find_competitors(brands, table, cache)
    assert {r["brand_name"]: (r["from_cache"], r["competitor_urls"]) for r in found.collect()} == {
        "A": (True, ["https://k.com"]), "B": (False, ["https://x.com"]), "C": (False, []),
    }


def test_names_that_contain_a_word(spark):
    names = ["sports shoes", "shoe care", "a", "ab", "home & garden", "garden", "xsportsy", "", "ünder"]
    table = spark.createDataFrame([(n, [f"{n}.com"], dt.datetime(2024, 1, 1)) for n in names], "industry string, top_brands array<string>, last_updated timestamp")
    words = ["sport", "shoe", "a", "b", "&", "garden", "gardens", "s s", "ü", "zz", "", "ports"]
    found = leaders.containing(spark.createDataFrame([(w,) for w in [*words, None, "a"]], "word string"), table)
    wanted = {w: min(n for n in names if w in n) for w in words if w and any(w in n for n in names)}
    assert {r["word"]: r["name"] for r in found.collect()} == wanted
    long = spark.createDataFrame([("n" * 3000 + "m" * 10,)], "industry string")
    assert leaders.name_index(long).count() <= 3 * 3010
    brands = spark.createDataFrame([("Sports gear",), ("Home & Garden",), (None,), (" ",), ("a",), ("unheard of",)], "industry string")
    got = {r["industry"]: r["leaders"] for r in leaders.lookup_leaders(brands, table).collect()}
    assert got == {"Sports gear": ["sports shoes.com"], "Home & Garden": ["home & garden.com"], None: [], " ": [], "a": ["a.com"], "unheard of": []}
