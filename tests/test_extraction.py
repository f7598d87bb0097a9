import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from storeglean import rules, schemas
from storeglean.functions import scoring
from storeglean.operators import stores
from storeglean.plans import competitors, extraction
from storeglean.sources import landed

NOW = dt.datetime(2024, 1, 1)
HOME = """<html><head><title>Acme | x</title></head><body><ul>
<li><a href="/products/mug" title="Mug"></a></li></ul>
<footer><a href="/pages/faq">FAQ</a> A@B.co a@b.co x@example.com 212-555-0199 instagram.com/acme </footer>
<script>cdn.shop-kit.example "currency":"USD","country":"US"</script></body></html>"""

MARKERS = ["cdn.shop-kit.example"]


def test_landed_tables_are_read_with_their_schemas(spark, tmp_path):
    for name, ddl in (("product_feed", schemas.PRODUCT_FEED), ("search_results", schemas.SEARCH_RESULTS)):
        spark.createDataFrame([], ddl).write.parquet(str(tmp_path / name))
        read = getattr(landed, f"read_{name}")(spark, str(tmp_path / name))
        assert read.columns == spark.createDataFrame([], ddl).columns and read.count() == 0


def page(path, html, status=200, minute=0, store="https://a.com"):
    return (store, path, store + path, status, NOW + dt.timedelta(minutes=minute), html)


def text(n, word="x"):
    return f"<html><body><nav>n</nav><p>{word * n}</p></body></html>"


@pytest.fixture(scope="module")
def records(spark):
    pages = [
        page("/", HOME),
        page("/", "<title>Old</title>", minute=-5),
        page("/pages/privacy-policy", text(100)),
        page("/policies/privacy-policy", text(101, "y")),
        page("/pages/return-policy", text(300), status=500),
        page("/pages/shipping-policy", text(6000, "s")),
        page("/pages/about", text(200, "a"), minute=2),
        page("/pages/elsewhere", text(500)),
        page("/", None, 404, store="b.com"),
    ]
    products = [{"title": t, "product_type": "Jewelry"} for t in ("Ring", "ring ", "Mug ", "MUG", "Cup")]
    feed = [("https://a.com/", 1, 200, json.dumps({"products": products}))]
    made = extraction.extract_stores(
        spark.createDataFrame(pages, schemas.STORE_PAGES),
        spark.createDataFrame(feed, schemas.PRODUCT_FEED),
        F.lit(NOW),
        MARKERS,
    )
    return made.cache()


def by_url(df):
    return {r["website_url"]: r for r in df.collect()}


def test_extraction(records):
    rows = by_url(records)
    a, b = rows["https://a.com/"], rows["https://b.com/"]
    assert a["brand_name"] == "Acme" and a["total_products"] == 5
    assert a["privacy_policy"] == "y" * 101 and a["return_refund_policy"] is None
    assert len(a["shipping_policy"]) == 6000 and a["brand_context"] == "a" * 200
    assert len(a["faqs"]) == 3 and a["currency"] == "USD" and a["country"] == "US"
    assert a["contact_info"]["emails"] == ["A@B.co", "a@b.co", "x@example.com"]
    assert a["extraction_success"] and a["extraction_duration_seconds"] == 420.0
    assert not b["extraction_success"] and b["error_messages"] == ["Failed to fetch homepage"]
    assert b["faqs"] == [] and b["quality_score"] == 0.0


def test_enrichment(records):
    a = by_url(extraction.enrich(records))["https://a.com/"]
    # Keys are trimmed for repeats but not for the comparison with featured names.
    assert [p["name"] for p in a["product_catalog"]] == ["Ring", "Mug ", "Cup"]
    assert a["total_products"] == 4
    assert a["contact_info"]["emails"] == ["a@b.co"]
    assert len(a["important_links"]) == len({k["url"] for k in a["important_links"]})


def test_crawl_profile(spark):
    pages = [
        page("/", HOME),
        page("/pages/contact", "<body>mail z@shop.org, +1 212-555-0199<p class='address'>1 Road</p></body>"),
        page("/pages/refund-policy", "<body><main>" + "r" * 3000 + "</main></body>"),
        page("/about", "<body>" + "a" * 60 + "</body>"),
        page("/", "<title>Other</title>", store="https://c.com"),
        page("/", None, 404, store="https://d.com"),
    ]
    feed = spark.createDataFrame([], schemas.PRODUCT_FEED)
    landed_pages = spark.createDataFrame(pages, schemas.STORE_PAGES)
    rows = by_url(extraction.extract_stores_crawl(landed_pages, feed, F.lit(NOW), MARKERS))
    a = rows["https://a.com/"]
    assert len(a["return_refund_policy"]) == 3000
    short = by_url(extraction.extract_stores_crawl(landed_pages, feed, F.lit(NOW), MARKERS, limits=rules.DISPLAY))
    assert len(short["https://a.com/"]["return_refund_policy"]) == 2000
    assert a["return_refund_policy_url"] == "https://a.com/pages/refund-policy"
    assert a["brand_context"] == "a" * 60 and a["contact_info"]["address"] == "1 Road"
    assert a["contact_info"]["emails"] == ["z@shop.org"] and a["faqs"] == []
    assert rows["https://c.com/"]["error_messages"] == ["Not a store of the platform"]
    assert rows["https://d.com/"]["error_messages"] == ["Website not found: https://d.com"]


def test_one_record_for_every_store_whatever_was_landed(spark):
    pages = [page("/", HOME, store="https://A.com"), page("/", "<title>Late</title>", minute=-9), page("/blogs/z", text(9), store="https://z.com")]
    feed = [("https://FEED.com/", 1, 200, json.dumps({"products": [{"title": "Mug"}]})), ("https://a.com", 1, 200, "{")]
    asked = spark.createDataFrame([("asked.com",), ("https://a.com//",), (None,)], "store_url string")
    landed_pages, landed_feed = spark.createDataFrame(pages, schemas.STORE_PAGES), spark.createDataFrame(feed, schemas.PRODUCT_FEED)
    for extract in (extraction.extract_stores, extraction.extract_stores_crawl):
        found = extract(landed_pages, landed_feed, F.lit(NOW), MARKERS, asked).collect()
        assert sorted(r["website_url"] for r in found) == [f"https://{h}.com/" for h in ("a", "asked", "feed", "z")]
        assert {r["website_url"] for r in found if r["extraction_success"]} == {"https://a.com/"}
        assert all(r["error_messages"] == ["Failed to fetch homepage"] for r in found if r["website_url"] != "https://a.com/")


def test_scores(spark):
    counts = "40 p, 5 h, 4 q, 10 f, true c, 5 s, true e, true t, 10 l"
    row = spark.sql(f"SELECT {counts}")
    full = scoring.score_from_counts(*[F.col(c) for c in "phqfcsetl"])
    assert row.select(full).first()[0] == 100.0
    none = spark.sql("SELECT 0 p, 0 h, 0 q, 0 f, false c, 0 s, false e, false t, 0 l")
    assert none.select(full).first()[0] == 0.0


def test_defaults_can_be_left_out_of_the_score(records):
    both = records.select(scoring.quality_score().alias("a"), scoring.quality_score(False).alias("b"), "extraction_success")
    row = both.where("extraction_success").first()
    assert row["a"] - row["b"] == 3 + 5


def test_upsert_publish_and_log(spark, records, tmp_path):
    first = extraction.to_table(extraction.enrich(records))
    none = first.limit(0).withColumn("created_at", F.lit(NOW)).withColumn("updated_at", F.lit(NOW))
    one = stores.publish(spark, stores.upsert(none, first, F.lit(NOW)), str(tmp_path), "1")
    later = NOW + dt.timedelta(days=1)
    newer = first.where("extraction_success").withColumns(
        {"brand_name": F.lit("New"), "extraction_timestamp": F.lit(later)}
    )
    two = stores.upsert(one, newer, F.lit(later))
    again = stores.upsert(two, newer, F.lit(later))
    assert two.count() == 2 and sorted(map(str, two.collect())) == sorted(map(str, again.collect()))
    published = stores.publish(spark, two, str(tmp_path), "2")
    row = stores.lookup(published, "A.com").first()
    assert (row["brand_name"], row["created_at"], row["updated_at"]) == ("New", NOW, later)
    assert stores.recent(published, 1).first()["brand_name"] == "New"
    read = {r["website_url"]: r for r in stores.decode_defaults(published).collect()}
    assert read["https://b.com/"]["contact_info"]["emails"] == []
    stores.create_tables(spark, str(tmp_path))
    stores.create_tables(spark, str(tmp_path))
    for n in (1, 2):
        stores.append(stores.run_log(published, F.lit(later)), "extraction_logs")
        assert spark.table("extraction_logs").count() == 2 * n
    failed = spark.table("extraction_logs").where("status = 'failed'").first()
    assert failed["error_message"] == "Failed to fetch homepage"
    for name in ("extraction_logs", "competitor_analyses", "industry_leaders", "competitors"):
        spark.sql(f"DROP TABLE {name}")


def test_search_conditions(records):
    found = stores.search(records, brand_name="ac_e", country="US", min_quality_score=1, start_date=NOW, end_date=NOW)
    assert [r["brand_name"] for r in found.collect()] == ["Acme"]
    assert stores.search(records, brand_name="a%e", start_date=NOW + dt.timedelta(seconds=1)).count() == 0
    assert stores.search(records, min_quality_score=0.0).count() == 2


def test_statistics_of_no_rows(records):
    row = stores.statistics(records.limit(0), F.lit(NOW)).first()
    assert (row["total_extractions"], row["success_rate"], row["average_quality_score"]) == (0, 0.0, 0.0)


def test_iso_text(value):
    assert value(lambda c: stores.iso(c.cast("timestamp")), t="2024-01-02 03:04:05") == "2024-01-02T03:04:05"
    assert value(lambda c: stores.iso(c.cast("timestamp")), t="2024-01-02 03:04:05.12") == "2024-01-02T03:04:05.120000"


def test_position_tie(spark):
    main = spark.sql("SELECT * FROM VALUES ('m', 10), ('n', 11), ('o', 1) t(main_brand_url, total_products)")
    others = spark.sql("SELECT * FROM VALUES ('m', 8), ('m', 12), ('n', 10) t(main_brand_url, total_products)")
    rows = {r["main_brand_url"]: r["position"] for r in competitors.position(main, others).collect()}
    assert rows == {"m": "below average", "n": "above average", "o": None}
