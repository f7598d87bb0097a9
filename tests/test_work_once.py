"""Steps of the extraction that read a page, a body or a URL once, with the results they had."""

from pyspark.sql import functions as F

from storeglean import rules
from storeglean.functions import social, urls
from storeglean.plans import extraction
from storeglean.sources import feed

PAGES = "store_url string, path string, url string, status int, fetched_at timestamp, html string"
LANDED = "store_url string, page int, status int, body string, fetched_at timestamp"


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_a_feed_body_is_parsed_once(spark):
    def body(*names):
        return '{"products": [' + ", ".join(f'{{"title": "{n}"}}' for n in names) + "]}"

    rows = [
        ("a", 1, 200, body("x"), 1), ("a", 1, 200, "{broken", 3), ("a", 1, 503, body("z"), 4), ("a", 1, 200, body("y", "w"), 2),
        ("b", 1, 200, "{broken", 1), ("c", 1, 200, '{"other": 1}', 1), ("d", 1, 200, body("q"), 1), ("d", 1, 200, body(), 2),
        ("e", 1, 200, None, 1), ("e", 0, 200, body("q"), 1),
    ]
    landed = spark.createDataFrame([(*r[:4], None) for r in rows], LANDED).limit(0).unionByName(
        spark.createDataFrame([r for r in rows], "store_url string, page int, status int, body string, t long").select(
            "store_url", "page", "status", "body", F.timestamp_seconds("t").alias("fetched_at")
        )
    )
    newest = feed.newest_landings(landed)
    assert {r["store_url"]: [p["title"] for p in r["raw"]] for r in newest.collect()} == {"a": ["y", "w"], "d": []}
    assert [(r["store_url"], r["n"], r["start"]) for r in feed.pages_read(landed).collect()] == [("a", 2, 0)]
    one = spark.createDataFrame([("a", 1, 200, body("x"))], "store_url string, page int, status int, body string")
    one = one.where(F.rand() >= 0)  # kept from being worked out while planning
    assert plan(feed.newest_landings(one)).count("from_json(") == 1


def test_a_page_is_searched_once_for_each_platform(spark):
    html = '<a href="https://Instagram.com/one">x</a> facebook.com/sharer facebook.com/two youtube.com/c/three?x tiktok.com/@four'
    pages = spark.createDataFrame([(html,), ("",), (None,)], "html string").where(F.rand() >= 0)
    found = pages.select("html", social.find_handles(F.col("html")).alias("s"))
    told = {r["html"]: [tuple(s) for s in r["s"]] for r in found.collect()}
    assert told == {
        html: [
            ("instagram", "https://instagram.com/one", "one"), ("youtube", "https://youtube.com/three", "three"),
            ("tiktok", "https://tiktok.com/four", "four"),
        ],
        "": [], None: [],
    }
    assert plan(found).count("regexp_extract(") == len(rules.SOCIAL_PATTERNS)


def test_undelivered_pages_do_not_reach_the_parser(spark):
    rows = [("https://a.com", "/", "https://a.com/", status, None, "<p>x</p>") for status in (200, 404, 500, None)]
    pages = spark.createDataFrame(rows, PAGES)
    assert extraction._candidate_pages(pages, {"home": ["/"]}).count() == 1
    empty = spark.createDataFrame([], "store_url string, page int, status int, body string")
    gone = pages.where("status = 404")
    stores = extraction.extract_stores(gone, empty, F.current_timestamp(), ["m"]).collect()
    assert [(r["website_url"], r["extraction_success"]) for r in stores] == [("https://a.com/", False)]


def test_bare_hosts_have_the_key_they_had(spark):
    given = [
        "https://a.com", "http://a.com", "https://a.com/", "https://a.com///", "https://A.com", "https://a.com/x/", "a.com", "a.com/",
        "https://", "https:///", "https://a.com\n", "https://a.com/\n", "https://a.com:443", "http://a.com:80/", "https://a.com?q", "",
        "HTTPS://a.com", "https://a_b.com/", "https://-", "ftp://a.com", None,
    ]
    rows = spark.createDataFrame([(u,) for u in given], "u string").where(F.rand() >= 0)
    both = rows.select("u", urls.canonical(F.col("u")).alias("now"), urls._taken_apart(F.col("u")).alias("then")).collect()
    assert [(r["u"], r["now"]) for r in both] == [(r["u"], r["then"]) for r in both]
