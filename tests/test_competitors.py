import datetime as dt

from pyspark.sql import functions as F

from storeglean.functions import industry, lists
from storeglean.operators import leaders
from storeglean.plans import competitors

NOW = dt.datetime(2024, 1, 1)


def test_leader_lookup(spark):
    rows = [("home",), ("Jewel case",), ("makeup kits",), ("me",), ("toys",), ("",), (None,)]
    found = leaders.lookup_leaders(spark.createDataFrame(rows, "industry string"), leaders.seed_leaders(spark))
    first = {r["industry"]: (r["leaders"] or [None])[0] for r in found.collect()}
    assert first == {
        "home": "ikea.com", "Jewel case": "tiffany.com", "makeup kits": "sephora.com", "me": "sephora.com",
        "toys": None, "": None, None: None,
    }


def brand_rows(spark):
    rows = [("A", "a.com", "jewelry"), ("B", "b.com", None), ("C", "", "toys")]
    return spark.createDataFrame(rows, "brand_name string, domain string, industry string")


def test_sources_in_order(spark):
    results = spark.createDataFrame(
        [("A", 1, "https://z.com"), ("A", 2, "https://tiffany.com"), ("B", 2, "https://y.com"), ("B", 1, "http://reddit.com"),
         ("B", 3, "ftp://n.com"), ("B", 11, "https://late.com"), ("B", 2, "https://y.com")],
        "brand_name string, rank int, link string",
    )
    seeded = leaders.seed_leaders(spark)
    six = {r["brand_name"]: r["competitor_urls"] for r in competitors.find_competitors(brand_rows(spark), seeded, None, results, 6).collect()}
    assert six["A"][0] == "https://tiffany.com" and six["A"][5] == "https://z.com" and len(six["A"]) == 6
    assert six["B"] == ["https://y.com", "https://late.com"] and six["C"] == []
    five = {r["brand_name"]: r["competitor_urls"] for r in competitors.find_competitors(brand_rows(spark), seeded, None, results, 5).collect()}
    assert "https://z.com" not in five["A"]


def test_cache_round_trip(spark):
    seeded = leaders.seed_leaders(spark)
    found = competitors.find_competitors(brand_rows(spark), seeded)
    rows = competitors.cache_rows(found, F.lit(NOW))
    assert [(r["domain"], r["competitor_domains"][0]) for r in rows.collect()] == [("a.com", "tiffany.com")]
    cache = competitors.update_cache(rows.limit(0), rows)
    assert competitors.update_cache(cache, rows).count() == 1
    again = competitors.find_competitors(brand_rows(spark), seeded, cache, None, 2)
    a = [r for r in again.collect() if r["brand_name"] == "A"][0]
    assert a["from_cache"] and a["competitor_urls"] == ["https://tiffany.com", "https://pandora.net"]
    assert competitors.cache_rows(again, F.lit(NOW)).count() == 0


def test_report_and_text(spark):
    stores = spark.sql(
        """SELECT * FROM VALUES
        ('https://tiffany.com/', 'Tiff', 7), ('https://pandora.net/', CAST(NULL AS STRING), 3) t(website_url, brand_name, total_products)"""
    ).select(
        "*",
        F.expr("array(named_struct('name', 'Gold Earring', 'product_type', CAST(NULL AS STRING)))").alias("product_catalog"),
        F.expr("array('q')").alias("faqs"),
        F.expr("array('s', 't')").alias("social_handles"),
    )
    report = competitors.report(stores, leaders.seed_leaders(spark), stores, F.lit(NOW), max_competitors=99)
    rows = {r["main_brand_url"]: r for r in report.collect()}
    tiff = rows["https://tiffany.com/"]
    assert "https://tiffany.com" not in tiff["competitor_urls"] and tiff["competitors_found"] == 4
    assert tiff["analysis_summary"] == "Found 4 competitors" and tiff["industry_keywords"] == []
    assert [tuple(c) for c in tiff["competitors"]] == [("https://pandora.net", None, 3, True, 2)]
    text = competitors.comparison_text(F.col("main_brand_name"), F.col("main_brand_url"), F.lit(7), F.col("competitors"))
    found = report.where("main_brand_name = 'Tiff'").select(text).first()[0]
    assert found == (
        "Main Brand: Tiff\nWebsite: https://tiffany.com/\nProducts: 7\n\nFound 1 Competitors\n- https://pandora.net"
    )
    assert competitors.analyses_to_save(report).count() == 2


def test_url_lists(value):
    def urls(t):
        return value(lists.competitor_urls, t=t)

    assert urls(' ["https://a.com/", "ftp://b", 3, "http://example.com"] ') == ["https://a.com"]
    assert urls('Sure:\n```json\n["https://a.com//"]\n```') == ["https://a.com"]
    assert urls("```\nnone\n``` see [https://b.co.uk/x]") == ["https://b.co.uk"]
    assert urls('{"a": ["https://a.com"]}') == []
    assert urls("try https://a.com or http://b.org.") == ["https://a.com", "http://b.org"]
    assert value(lambda c: lists.industry_default_urls(c, 2), t="https://example.com https://a.com https://b.com") == [
        "https://example.com", "https://a.com",
    ]


def test_industries(value):
    assert value(industry.long_name, t="Gym wear") == "fitness and sportswear"
    assert value(industry.long_name, t="odd") == "general retail"
    assert value(industry.keyword_from_names, t="silver earring string") == "jewelry"
    assert value(industry.keyword_from_names, t="leather bag") == "accessories"
    assert value(lambda c: industry.of_keywords(F.array(c)), t="accessories") is None
    assert value(lambda c: industry.of_keywords(F.array(c)), t="Home Tech") == "electronics"


def test_category_lists(value):
    assert value(lists.category_lists, t='```json\n{"A": ["x", "y"], "B": []}\n```') == {"A": ["x", "y"], "B": []}
    assert value(lists.category_lists, t='{"A": ["x"]}') == {"A": ["x"]}
    assert value(lists.category_lists, t="no list") is None


def test_suggestions(spark):
    rows = spark.createDataFrame(
        [("a", '["https://a.com/"]', "https://z.com", ["k"]), ("b", "none", "https://z.com https://y.com", ["k"]),
         ("c", "none", "https://z.com", []), ("d", None, None, ["k"])],
        "id string, response string, industry_response string, industry_keywords array<string>",
    )
    found = {r["id"]: r["competitor_urls"] for r in competitors.suggested_competitors(rows, 1).collect()}
    assert found == {"a": ["https://a.com"], "b": ["https://z.com"], "c": [], "d": []}
