import json
import time

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from storeglean import rules
from storeglean.functions import faq, links, page, social
from storeglean.sources import dom
from storeglean.sources.dom import page_facts


@pytest.fixture()
def facts(spark):
    def run(html, *names, product="/products/"):
        df = spark.createDataFrame([("https://a.com", html)], "base string, html string")
        return page_facts(df, list(names) or None, product)

    return run


def names(df, make):
    return df.select(
        make(F.col("og_site_name"), F.col("title"), F.lit("https://www.shop-one.co/"))
    ).first()[0]


def test_brand_names(facts):
    heads = "title", "og_site_name", "logo_alt"
    assert names(facts('<meta property="og:site_name" content=" Acme ">', *heads), page.brand_name) == "Acme"
    cut = facts("<title>A - B | C</title>", *heads)
    assert names(cut, page.brand_name) == "A"
    crawl = cut.select(page.brand_name_crawl(F.col("og_site_name"), F.col("title"), F.col("logo_alt"), F.lit("x")))
    assert crawl.first()[0] == "A - B"
    assert names(facts("<p>x</p>", *heads), page.brand_name) == "Shop-one"
    assert names(facts("<title>| x</title>", *heads), page.brand_name) == ""
    assert facts('<img id="mylogo" alt="L">', *heads).first()["logo_alt"] == "L"


def test_hero_links(facts):
    html = (
        '<li><a href="/products/x" title="X"><img src="/i.png"></a><span class="sale-price">9</span></li>'
        '<p><a href="/products/y"></a></p>'
    )
    df = facts(html, "anchors")
    heroes = df.select(links.hero_links(F.col("anchors"), F.col("base"))).first()[0]
    assert heroes[0].asDict() == {
        "name": "X", "price": "9", "image_url": "https://a.com/i.png", "product_url": "https://a.com/products/x"
    }
    assert heroes[1]["name"] == "Product"
    crawl = df.select(links.hero_links_crawl(F.col("anchors"), F.col("base"))).first()[0]
    assert [h["name"] for h in crawl] == ["X"]


def test_all_heroes_or_those_of_the_profile(facts):
    html = "".join(f'<a href="/products/{i}">n{i}</a>' for i in range(12))
    df = facts(html, "anchors")
    for make, few in ((links.hero_links, 5), (links.hero_links_crawl, 10)):
        assert len(df.select(make(F.col("anchors"), F.col("base"))).first()[0]) == 12
        assert len(df.select(make(F.col("anchors"), F.col("base"), limits=rules.DISPLAY)).first()[0]) == few


def test_main_text(facts):
    html = "<body><nav>n</nav><main> a <b>b</b><script>s</script></main><footer>f</footer></body>"
    row = facts(html, "main_text", "main_text_direct", "main_text_raw").first()
    assert (row["main_text"], row["main_text_direct"], row["main_text_raw"]) == ("a b", "a", "a b")
    plain = facts("<body>x<header>h</header> y</body>", "main_text", "main_text_raw").first()
    assert (plain["main_text"], plain["main_text_raw"]) == ("x y", None)
    hidden = facts("<body><header><main>h</main></header>z</body>", "main_text").first()
    assert hidden["main_text"] == "z"


def test_entities_unclosed_tags_and_null(facts, spark):
    row = facts("<title>a &amp; b</title><p><b>x<p>y", "title", "main_text").first()
    assert row["title"] == "a & b" and row["main_text"] is None
    df = spark.createDataFrame([(None,)], "html string")
    assert page_facts(df, ["title", "anchors"]).first().asDict() == {"title": None, "anchors": None}


def test_only_the_facts_of_the_kind_are_read(spark):
    df = spark.createDataFrame([("a", "<title>t</title>"), ("b", "<title>t</title>")], "kind string, html string")
    rows = page_facts(df, ["title"], kind_column="kind", kinds={"a": ["title"]}).collect()
    assert {r["kind"]: r["title"] for r in rows} == {"a": "t", "b": None}


def test_address(facts):
    assert facts("<address> 1 Road </address>", "address").first()["address"].strip() == "1 Road"


def pairs(df):
    rows = df.select(faq.of_page(F.col("jsonld"), F.col("faq_candidates"))).first()[0]
    return [(r["question"], r["answer"]) for r in rows]


def test_faq_elements(facts):
    both = "jsonld", "faq_candidates"
    assert pairs(facts("<h3>How long?</h3><div>About three days.</div>", *both)) == [("How long?", "About three days.")]
    short = "<h3>How?</h3><div>Soon.</div><dl><dt>What is it?</dt><dd>A very long answer.</dd></dl>"
    assert pairs(facts(short, *both)) == [("What is it?", "A very long answer.")]
    classes = '<p class="question big">Where?</p><b class="answer">In the warehouse.</b>'
    assert pairs(facts(classes, *both)) == [("Where?", "In the warehouse.")]
    assert pairs(facts("<h3>Terms</h3><div>Nothing to ask here at all.</div>", *both)) == []


def test_faq_jsonld(facts):
    def script(value):
        body = value if isinstance(value, str) else json.dumps(value)
        return f'<script type="application/ld+json">{body}</script>'

    def entry(q, a, kind="Question"):
        return {"@type": kind, "name": q, "acceptedAnswer": {"text": a}}

    good = {"@type": "FAQPage", "mainEntity": [entry("Q1", "A1"), entry("Q2", ""), entry("Q3", "A3", "Thing")]}
    html = script("{broken") + script(good) + script({"@type": "Store"}) + script([good]) + "<h3>How?</h3><div>Not used at all.</div>"
    assert pairs(facts(html, "jsonld", "faq_candidates")) == [("Q1", "A1")]


def test_faq_items(facts):
    html = '<details><summary>Q1</summary><div class="accordion-content">A1</div></details>'
    rows = facts(html, "faq_items").select(faq.from_items(F.col("faq_items"))).first()[0]
    assert [(r["question"], r["answer"], r["category"]) for r in rows] == [("Q1", "A1", "General")]


def important(df):
    return df.select(links.important_links(F.col("anchors"), F.col("link_regions"), F.col("base"))).first()[0]


def test_important_links(facts):
    html = (
        '<nav><a href="/blogs/n">News</a><a href="/pages/contact">Again</a></nav>'
        '<footer><a href="/pages/contact">Contact us</a><a href="https://facebook.com/shop">Shop on it</a>'
        '<a href="/zz">ab</a><a href="/qq">nothing</a></footer><div class="top-menu"><a href="/account">Mine</a></div>'
    )
    found = important(facts(html, "anchors", "link_regions"))
    assert [(k["name"], k["raw_category"], k["category"]) for k in found] == [
        ("Contact us", "contact", "other"), ("News", "blog", "blog"), ("Mine", "account", "account"),
    ]


def test_links_are_padded(facts):
    html = "<footer>" + "".join(f'<a href="/help{i}">Help</a>' for i in range(4)) + "</footer>"
    df = facts(html, "anchors", "link_regions")
    made = links.important_links(F.col("anchors"), F.col("link_regions"), F.col("base"))
    padded = df.select(links.pad_links(made, F.col("base"))).first()[0]
    assert [k["is_default"] for k in padded] == [False] * 4 + [True] * 5


def test_pad_pairs(spark):
    none = faq.pad_pairs(F.lit(None).cast("array<struct<question:string,answer:string,category:string,is_default:boolean>>"))
    rows = spark.range(1).select(none).first()[0]
    assert len(rows) == 3 and all(r["is_default"] for r in rows)


def test_social_handles(value):
    html = 'instagram.com/share" INSTAGRAM.com/acme" youtube.com/@tube? pinterest.com/pin/1'
    found = value(social.find_handles, html=html)
    assert [(s["platform"], s["handle"]) for s in found] == [("youtube", "tube"), ("pinterest", "pin")]
    past = value(lambda h: social.find_handles(h, scan_past=True), html=html)
    assert [s["handle"] for s in past] == ["acme", "tube", "pin"]
    crawl = value(social.find_handles_crawl, html="see linkedin.com/company/acme and instagram.com/share instagram.com/b ")
    assert [(s["platform"], s["url"]) for s in crawl] == [
        ("instagram", "https://instagram.com/b"), ("linkedin", "https://linkedin.com/company/acme"),
    ]


def test_links_of_platforms(value):
    html = "<a href='https://netflix.com/x'><a href=https://X.com/@me ><a href=\"https://x.com/@me\">"
    found = value(social.find_links, html=html)
    assert [(p["platform"], p["url"]) for p in found] == [
        ("twitter", "https://netflix.com/x"), ("twitter", "https://x.com/@me")
    ]
    exact = value(lambda h: social.find_links(h, exact_host=True), html=html)
    assert [p["url"] for p in exact] == ["https://X.com/@me", "https://x.com/@me"]
    assert value(social.handle_of_url, url="https://x.com/@me") == "me"
    assert value(social.handle_of_url, url="https://linkedin.com/in/a-b") == "a-b"


def test_platform_and_settings(value):
    marked = lambda html: page.has_platform_marker(html, ["Shop-Kit.theme", "cdn.kit"])
    assert value(marked, html="... SHOP-KIT.theme ...") is True
    assert value(marked, html="plain") is False
    row = value(page.embedded_settings, html='"currency":"USD","country":"US","shop_name":"Acme"')
    assert row.asDict() == {"currency": "USD", "country": "US", "shop_name": "Acme"}
    assert value(page.embedded_settings, html="x").asDict() == {"currency": None, "country": None, "shop_name": None}


@pytest.mark.parametrize("link", ['<a href="/products/{0}">{0}</a>', '<a href="/products/{0}">{0}'])
def test_very_many_links_are_read_in_a_moment(link):
    html = "<body>" + "".join(link.format(i) for i in range(20_000)) + "<span class=price>1</span></body>"
    start = time.perf_counter()
    rows = dom._anchors(dom._Page(html), "/products/")
    assert time.perf_counter() - start < 5
    assert [r["text"] for r in rows[:3]] == ["0", "1", "2"] and len(rows) == 20_000
    assert rows[0]["parent_price"] == "1"


def test_closed_lists(value):
    assert value(social.normalize_platform, p="TikTok") == "tiktok"
    assert value(social.normalize_platform, p="myspace") == "other"
    assert value(links.stored_category, c="HELP") == "help"
    assert value(links.stored_category, c="shopping") == "other"


def test_a_large_batch_of_pages_is_worked_off_in_parts(spark):
    held = {}

    class Pages:
        schema = spark.createDataFrame([], "k long, html string").schema

        def mapInArrow(self, parse, schema):
            held["parse"] = parse

    page_facts(Pages(), ["main_text_raw"])
    texts = [None, "é" * 400_000, "long " * 1_000_000, ""] + [f"{k} " * 5000 for k in range(300)]
    html = [t if t is None else f"<main>{t}</main>" for t in texts]
    batch = pa.RecordBatch.from_pydict({"k": list(range(len(html))), "html": html})
    out = list(held["parse"](iter([batch, batch.slice(0, 0)])))
    assert max(b.num_rows for b in out if b.nbytes > 1 << 21) == 1  # the long page is by itself
    assert len(out) > 5 and out[-1].num_rows == 0
    rows = [r for b in out for r in b.to_pylist()]
    assert rows == [{"k": k, "main_text_raw": None if t is None else t.strip()} for k, t in enumerate(texts)]
