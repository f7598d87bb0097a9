import json

import pytest

from storeglean import rules, schemas
from storeglean.sources import feed


@pytest.fixture()
def landed(spark):
    def make(*rows):
        return spark.createDataFrame([("https://a.com", p, s, b) for p, s, b in rows], schemas.PRODUCT_FEED)

    return make


def body(*products):
    return json.dumps({"products": list(products)})


def titles(n, start=0):
    return body(*[{"title": f"t{i}"} for i in range(start, start + n)])


def test_product_fields(landed):
    full = {
        "title": "Mug", "body_html": "<p>m</p>", "vendor": "V", "product_type": "T", "tags": "a, b", "handle": "mug",
        "variants": [{"price": "9.50", "sku": "S", "available": False}, {"price": "1"}], "images": [{"src": "i.png"}],
    }
    bare = {"title": "Cup", "tags": ["x", "y"], "handle": "cup"}
    no_flag = {"title": "Jug", "variants": [{"price": "2"}]}
    rows = feed.feed_products(landed((1, 200, body(full, bare, no_flag)))).orderBy("pos").collect()
    assert rows[0].asDict() == {
        "store_url": "https://a.com", "pos": 0, "name": "Mug", "price": "9.50", "image_url": "i.png",
        "product_url": "https://a.com/products/mug", "description": "<p>m</p>", "sku": "S", "vendor": "V",
        "product_type": "T", "tags": ["a", "b"], "available": False,
    }
    assert (rows[1]["tags"], rows[1]["available"], rows[1]["price"]) == (["x", "y"], True, None)
    assert (rows[2]["tags"], rows[2]["available"]) == ([], True)


def test_broken_empty_and_failed_pages_give_nothing(landed):
    df = landed((1, 200, "{broken"), (2, 200, body()), (3, 500, titles(1)))
    assert feed.feed_products(df).count() == 0
    assert feed.feed_has_products(df).count() == 1
    assert feed.feed_has_products(landed((1, 200, "<html>"))).count() == 0


def test_pages_are_read_until_one_is_short(landed):
    df = landed((1, 200, titles(250)), (2, 200, titles(10, 250)), (3, 200, titles(250, 900)))
    row = feed.store_catalogs(df, limits=rules.DISPLAY).first()
    assert (row["product_count"], len(row["products"])) == (260, 100)
    assert row["products"][99]["name"] == "t99"
    assert len(feed.store_catalogs(df).first()["products"]) == 260
    assert feed.store_catalogs(landed((2, 200, titles(5)))).count() == 0
    assert [r["name"] for r in feed.feed_products(df).orderBy("pos").collect()] == [f"t{i}" for i in range(260)]


def test_limits_are_asked_for_and_repeats_do_not_add_up(landed):
    pages = [(p, 200, titles(250, 250 * p)) for p in range(1, 7)]
    row = feed.store_catalogs(landed(*pages, *pages), limits=rules.DISPLAY).first()
    assert row["product_count"] == 1250
    assert feed.store_catalogs(landed(*pages, *pages)).first()["product_count"] == 1500


def test_first_page_only(landed):
    df = landed((1, 200, titles(120)), (2, 200, titles(5)))
    assert len(feed.first_page_products(df).first()["products"]) == 120
    assert len(feed.first_page_products(df, rules.DISPLAY).first()["products"]) == 100


def stamped(spark, *rows):
    import datetime as dt

    made = [("https://a.com", p, s, b, None if h is None else dt.datetime(2024, 1, 1, h)) for p, s, b, h in rows]
    return spark.createDataFrame(made, schemas.FEED_LANDINGS)


def test_the_newest_landing_of_a_page_counts(spark):
    full = titles(250)
    df = stamped(spark, (1, 200, full, 5), (1, 200, titles(251, 7), 4), (1, 500, titles(3), 9), (1, 200, "{broken", 9), (2, 200, titles(2, 250), 6), (2, 200, titles(9, 300), None))
    assert [r["name"] for r in feed.feed_products(df).orderBy("pos").collect()] == [f"t{i}" for i in range(252)]
    assert feed.store_catalogs(df).first()["product_count"] == 252
    assert [p["name"] for p in feed.first_page_products(df).first()["products"]][:2] == ["t0", "t1"]
    emptied = df.unionByName(stamped(spark, (1, 200, body(), 8)))
    assert feed.feed_products(emptied).count() == 0 and feed.store_catalogs(emptied).count() == 0
    twice = df.unionByName(df)
    assert feed.feed_products(twice).count() == 252 and feed.store_catalogs(twice).first()["product_count"] == 252


def test_paging_stops_at_gaps_and_short_pages(landed):
    df = landed((1, 200, titles(250)), (3, 200, titles(250, 900)), (4, 200, titles(1, 1200)), (0, 200, titles(5)))
    assert [tuple(r) for r in feed.pages_read(df).collect()] == [("https://a.com", 1, 250, 0)]
    assert feed.feed_products(landed((1, 200, titles(3)), (2, 200, titles(4))), page_size=3).count() == 7
    limited = feed.feed_products(landed((1, 200, titles(250)), (2, 200, titles(250, 250))), limits=rules.DISPLAY)
    assert limited.count() == rules.DISPLAY.catalog


def test_products_of_a_feed_are_not_gathered_by_store(landed):
    text = feed.feed_products(landed((1, 200, titles(3))))._jdf.queryExecution().executedPlan().toString()
    assert "collect_list" not in text and "Aggregate" not in text
