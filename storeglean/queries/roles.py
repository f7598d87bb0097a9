"""Roles of the given tables: what stands in for landed pages, feeds, runs and stores.

Everything is derived by Spark from the whole tables, so the work grows with them. Groups that
are gathered here are bounded by construction (a block of 20 part keys, at most 20 pairs).
"""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import rules


def table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{directory}/{name}.parquet")


# ---- pages


def store_pages(pages: DataFrame) -> DataFrame:
    """Pages as landed pages; two of the hosts answer with errors."""
    url = F.col("url")
    return pages.select(
        "page_id",
        F.regexp_extract(url, "^[a-z]+://[^/?#]*", 0).alias("store_url"),
        F.regexp_extract(url, r"^[a-z]+://[^/?#]*([^?#]*)", 1).alias("path"),
        "url",
        F.when(url.contains("spam-farm"), 404).when(url.contains("cheap-pills"), 500).otherwise(200).alias("status"),
        "html",
    )


# ---- question and answer pairs


def turn_pairs(spark: SparkSession, directory: str) -> DataFrame:
    """Each user turn with the assistant turn after it; keys are unique on both sides."""
    turns = table(spark, directory, "conversations")
    asked = turns.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("question"))
    told = turns.where("role = 'assistant'").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer")
    )
    return asked.join(told, ["conv_id", "turn"])


def escape(c: Column) -> Column:
    for raw, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        c = F.replace(c, F.lit(raw), F.lit(entity))
    return c


def jsonld(question: Column, answer: Column) -> Column:
    """One FAQPage block with one pair."""
    entry = F.struct(
        F.lit("Question").alias("@type"),
        question.alias("name"),
        F.struct(answer.alias("text")).alias("acceptedAnswer"),
    )
    return F.to_json(F.struct(F.lit("FAQPage").alias("@type"), F.array(entry).alias("mainEntity")))


def jsonld_script(block: Column) -> Column:
    return F.concat(F.lit('<script type="application/ld+json">'), block, F.lit("</script>"))


# ---- runs


def runs(spark: SparkSession, directory: str) -> DataFrame:
    """Events as the history of extraction runs."""
    return table(spark, directory, "events").select(
        "event_id",
        "user_id",
        F.format_string("https://store-%d.example.com/", "user_id").alias("website_url"),
        F.col("ts").alias("extraction_timestamp"),
        (F.col("event_type") != "error").alias("extraction_success"),
        F.when(F.col("event_type") == "error", F.array("props"))
        .otherwise(F.array().cast("array<string>"))
        .alias("error_messages"),
        F.col("value").alias("extraction_duration_seconds"),
        F.get_json_object("props", "$.k").cast("double").alias("quality_score"),
    )


def latest_runs(spark: SparkSession, directory: str) -> DataFrame:
    """The newest run of each store."""
    rows = runs(spark, directory)
    rest = [c for c in rows.columns if c != "website_url"]
    newest = F.max_by(F.struct(*rest), F.struct("extraction_timestamp", "event_id"))
    return rows.groupBy("website_url").agg(newest.alias("r")).select("website_url", "r.*")


def named_stores(spark: SparkSession, directory: str) -> DataFrame:
    """Newest runs with the name and country of the customer of the same number."""
    customers = table(spark, directory, "customer").select(
        F.col("c_custkey").alias("user_id"), F.col("c_name").alias("brand_name"), "c_nationkey"
    )
    nations = table(spark, directory, "nation").select(
        F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("country")
    )
    return (
        latest_runs(spark, directory)
        .join(customers, "user_id", "left")
        .join(nations, "c_nationkey", "left")
        .drop("c_nationkey")
    )


# ---- products and feeds

BLOCK = 20  # part keys per store; part has 20 rows per supplier at every scale
FEED_BLOCK = 1000  # part keys per store of the large feed: four full pages of 250


def _price(c: Column) -> Column:
    return F.format_string("%.2f", c)


def feed_item(shown: Column | None = None) -> Column:
    """A part as a feed product, of its own type or the one `shown`. Promo parts have no variants, small ones list their tags."""
    kind, name = F.col("p_type"), F.col("p_name")
    tags = F.split(name, " ")
    variant = F.struct(
        _price(F.col("p_retailprice")).alias("price"),
        F.concat(F.lit("S"), F.col("p_partkey").cast("string")).alias("sku"),
        F.when(kind != "LARGE", F.col("p_size") > 10).alias("available"),
    )
    image = F.struct(F.concat(F.lit("/i/"), F.col("p_partkey").cast("string"), F.lit(".png")).alias("src"))
    return F.struct(
        name.alias("title"),
        F.concat(F.lit("<p>"), name, F.lit("</p>")).alias("body_html"),
        F.col("p_brand").alias("vendor"),
        (kind if shown is None else shown).alias("product_type"),
        F.when(kind == "SMALL", F.to_json(tags)).when(kind != "ECONOMY", F.array_join(tags, ", ")).alias("tags"),
        F.concat_ws("-", F.translate(name, " ", "-"), F.col("p_partkey").cast("string")).alias("handle"),
        F.when(kind != "PROMO", F.array(variant)).alias("variants"),
        F.when(F.col("p_size") > 5, F.array(image)).alias("images"),
    )


def _feed(parts: DataFrame, shown: Column | None = None) -> DataFrame:
    """Feed pages from rows of (store_url, page, pos, part columns), at most 250 rows a page."""
    return (
        parts.groupBy("store_url", "page")
        .agg(F.array_sort(F.collect_list(F.struct("pos", feed_item(shown).alias("item")))).alias("rows"))
        .select(
            "store_url",
            F.col("page").cast("int").alias("page"),
            F.lit(200).alias("status"),
            F.to_json(F.struct(F.transform("rows", lambda r: r["item"]).alias("products"))).alias("body"),
        )
    )


def large_feed(spark: SparkSession, directory: str) -> DataFrame:
    """Four pages of 250 products per store, landed at noon, and stale landings: every third page in the morning with other
    (and larger) products, every fourth page later, but not delivered, every fifth one later, but broken."""
    newest = _large_feed(spark, directory).withColumn("fetched_at", F.timestamp_seconds(F.lit(1704110400)))
    mark = F.pmod(F.xxhash64("store_url", "page"), F.lit(60))
    early = newest.where(mark % 3 == 0).withColumns(
        {"fetched_at": F.timestamp_seconds(F.lit(1704096000)), "body": F.replace("body", F.lit("title"), F.lit('handle":"zz","title'))}
    )
    failed = newest.where(mark % 4 == 0).withColumns({"fetched_at": F.timestamp_seconds(F.lit(1704114000)), "status": F.lit(503)})
    broken = newest.where(mark % 5 == 0).withColumns({"fetched_at": F.timestamp_seconds(F.lit(1704117600)), "body": F.lit("{broken")})
    return newest.unionByName(early).unionByName(failed).unionByName(broken)


def _large_feed(spark: SparkSession, directory: str) -> DataFrame:
    key = F.col("p_partkey")
    parts = table(spark, directory, "part").select(
        "*",
        F.format_string("https://shop-%d.example.com", F.floor(key / FEED_BLOCK)).alias("store_url"),
        (F.floor((key % FEED_BLOCK) / rules.FEED_PAGE_SIZE) + 1).alias("page"),
        key.alias("pos"),
    )
    return _feed(parts)


def supplier_url(key: Column) -> Column:
    return F.format_string("https://shop-%d.example.com", key)


def supplier_feed(spark: SparkSession, directory: str, shown: Column | None = None) -> DataFrame:
    """One short feed page per supplier, with the parts' own types or those `shown`."""
    key = F.col("p_partkey")
    parts = table(spark, directory, "part").select(
        "*",
        supplier_url(F.floor(key / BLOCK)).alias("store_url"),
        F.lit(1).alias("page"),
        key.alias("pos"),
    )
    return _feed(parts, shown)


# ---- supplier stores

HERO_SIZE = 40  # parts above this size are featured on the home page
DOC_PATHS = [
    "/pages/privacy-policy", "/policies/privacy-policy", "/pages/return-policy", "/pages/refund-policy",
    "/pages/shipping-policy", "/policies/shipping-policy", "/pages/terms-of-service", "/terms",
    "/pages/about", "/pages/our-story",
]


def _home_pages(spark: SparkSession, directory: str) -> DataFrame:
    """A home page per supplier, with its featured parts; every second one has its price inside the link."""
    key = F.col("p_partkey")
    price = F.format_string('<span class="price">%.2f</span>', "p_retailprice")
    card = F.concat(
        F.format_string('<li><a href="/products/p%d" title="%s"><img src="/i/%d.png">', key, "p_name", key),
        F.when(key % 2 == 0, F.concat(price, F.lit("</a></li>"))).otherwise(F.concat(F.lit("</a>"), price, F.lit("</li>"))),
    )
    cards = (
        table(spark, directory, "part")
        .where(F.col("p_size") > HERO_SIZE)
        .groupBy(F.floor(key / BLOCK).alias("s_suppkey"))
        .agg(F.array_sort(F.collect_list(F.struct(key, card.alias("card")))).alias("cards"))
        .select("s_suppkey", F.array_join(F.transform("cards", lambda c: c["card"]), "").alias("cards"))
    )
    stores = table(spark, directory, "supplier").join(cards, "s_suppkey", "left")
    number, nation = F.col("s_suppkey"), F.col("s_nationkey")
    low = F.col("s_acctbal") < 2000
    html = F.concat(
        F.lit("<!DOCTYPE html><html><head><title>"),
        F.format_string("Shop %d | Home - Deals", number),
        F.lit("</title>"),
        F.when(low, F.concat(F.lit('<meta property="og:site_name" content=" '), "s_name", F.lit(' ">'))).otherwise(F.lit("")),
        F.when(nation < 20, F.lit('<script src="//cdn.shop-kit.example/t.js"></script>')).otherwise(F.lit("")),
        F.format_string('<script>var s={"currency":"USD","country":"C%s"};</script>', F.char(F.lit(65) + nation)),
        F.lit('</head><body><header><a href="/account/login">Sign in</a>'),
        F.when(low, F.format_string(" Call (212) 555-%04d.", number % 10000)).otherwise(F.lit("")),
        F.lit("</header><nav>"),
        F.lit('<a href="/collections/all">Shop all</a><a href="/blogs/news">News</a><a href="/x">x</a></nav><main><ul>'),
        F.coalesce("cards", F.lit("")),
        F.lit("</ul></main><footer>"),
        F.when(nation % 2 == 0, F.lit('<a href="/pages/contact">Contact us</a><a href="/pages/track">Track order</a><a href="/policies/terms">Terms</a>')).otherwise(F.lit("")),
        F.format_string('<a href="https://instagram.com/shop%d">Instagram</a> <a href="https://facebook.com/sharer">Share</a> <a href="https://www.youtube.com/c/tube%d?x=1">Videos</a>', number, number),
        F.format_string(" Mail Sales%d@Shop.co or sales%d@shop.co or hi@example.com.", number, number),
        F.lit("</footer></body></html>"),
    )
    return stores.select(
        supplier_url(number).alias("store_url"),
        F.lit("/").alias("path"),
        F.when(nation == 24, 404).otherwise(200).alias("status"),
        F.lit(0).alias("second"),
        html.alias("html"),
    )


def _document_pages(spark: SparkSession, directory: str) -> DataFrame:
    """Ten policy and about pages per supplier from the documents."""
    doc = F.col("doc_id")
    place = (doc % len(DOC_PATHS)).cast("int")
    return table(spark, directory, "documents").select(
        supplier_url(F.floor(doc / len(DOC_PATHS))).alias("store_url"),
        F.get(F.lit(DOC_PATHS), place).alias("path"),
        F.when(F.col("lang") == "de", 404).otherwise(200).alias("status"),
        place.alias("second"),
        F.concat(
            F.lit("<html><body><nav>Menu</nav><div class='page-content'>"),
            escape(F.col("text")),
            F.lit("</div><footer>end</footer></body></html>"),
        ).alias("html"),
    )


def _faq_pages(spark: SparkSession, directory: str) -> DataFrame:
    """A FAQ page per supplier that has a conversation: its pairs in JSON-LD."""
    pairs = turn_pairs(spark, directory)
    script = jsonld_script(jsonld(F.col("question"), F.col("answer")))
    return (
        pairs.groupBy("conv_id")
        .agg(F.array_sort(F.collect_list(F.struct("turn", script.alias("script")))).alias("blocks"))
        .select(
            supplier_url(F.col("conv_id")).alias("store_url"),
            F.lit("/pages/faq").alias("path"),
            F.lit(200).alias("status"),
            F.lit(30).alias("second"),
            F.concat(
                F.lit("<html><body>"),
                F.array_join(F.transform("blocks", lambda b: b["script"]), ""),
                F.lit("<p>FAQ</p></body></html>"),
            ).alias("html"),
        )
    )


def _contact_pages(spark: SparkSession, directory: str) -> DataFrame:
    number = F.col("s_suppkey")
    return table(spark, directory, "supplier").select(
        supplier_url(number).alias("store_url"),
        F.lit("/pages/contact").alias("path"),
        F.lit(200).alias("status"),
        F.lit(40).alias("second"),
        F.concat(
            F.format_string('<body><div class="our-address"> %d Road </div>', number),
            F.format_string("<p>Info%d@Shop.co, a@test.com, call +1 212-555-%04d now</p></body>", number, number % 10000),
        ).alias("html"),
    )


def supplier_pages(spark: SparkSession, directory: str) -> DataFrame:
    """Landed pages of all supplier stores."""
    documents = _document_pages(spark, directory)
    pages = (
        _home_pages(spark, directory)
        .unionByName(_contact_pages(spark, directory))
        .unionByName(documents)
        .unionByName(_faq_pages(spark, directory))
    )
    return pages.select(
        "store_url",
        "path",
        F.concat("store_url", "path").alias("url"),
        "status",
        F.timestamp_seconds(F.lit(1704067200) + F.col("second")).alias("fetched_at"),
        "html",
    )


#: What marks the pages of a store of the (invented) platform.
MARKERS = ["cdn.shop-kit.example", "shop-kit-section"]

# ---- brands and competitors

TYPE_NAMES = {
    "ECONOMY": "Home Decor", "STANDARD": "Sport Shoes", "LARGE": "Makeup", "MEDIUM": "Fashion",
    "SMALL": "Jewelry",
}


def shown_type() -> Column:
    """Part type as a shop would name it; promo parts have none."""
    out = None
    for kind, name in TYPE_NAMES.items():
        hit = F.col("p_type") == kind
        out = F.when(hit, F.lit(name)) if out is None else out.when(hit, F.lit(name))
    return out.otherwise(F.lit(""))


def catalog_stores(spark: SparkSession, directory: str) -> DataFrame:
    """Supplier stores with a catalog of their 20 parts."""
    key = F.col("p_partkey")
    item = F.struct(F.col("p_name").alias("name"), shown_type().alias("product_type"))
    catalogs = (
        table(spark, directory, "part")
        .groupBy(F.floor(key / BLOCK).alias("s_suppkey"))
        .agg(F.array_sort(F.collect_list(F.struct(key, item.alias("item")))).alias("rows"))
        .select("s_suppkey", F.transform("rows", lambda r: r["item"]).alias("product_catalog"))
    )
    return table(spark, directory, "supplier").join(catalogs, "s_suppkey").select(
        F.concat(supplier_url(F.col("s_suppkey")), F.lit("/")).alias("website_url"),
        F.col("s_name").alias("brand_name"),
        "product_catalog",
        F.size("product_catalog").alias("total_products"),
    )


LEADER_SITES = sorted({site for sites in rules.INDUSTRY_LEADERS.values() for site in sites})


def leader_records(spark: SparkSession, directory: str) -> DataFrame:
    """Records of the leaders' sites: the parts are dealt out among them."""
    site = F.get(F.lit(LEADER_SITES), (F.col("p_partkey") % len(LEADER_SITES)).cast("int"))
    counted = table(spark, directory, "part").groupBy(site.alias("site")).agg(
        F.count("*").alias("n"), F.max("p_size").alias("top")
    )
    return counted.select(
        F.concat(F.lit("https://"), "site", F.lit("/")).alias("website_url"),
        F.upper("site").alias("brand_name"),
        F.col("n").cast("int").alias("total_products"),
        F.when(F.col("top") > 49, F.array(F.lit("faq"))).otherwise(F.array().cast("array<string>")).alias("faqs"),
        F.slice(F.array(F.lit("a"), F.lit("b"), F.lit("c")), F.lit(1), (F.col("n") % 4).cast("int")).alias("social_handles"),
    )


def search_results(spark: SparkSession, directory: str) -> DataFrame:
    """Search results per supplier: one per part, some of them excluded sites or the store itself."""
    key = F.col("p_partkey")
    number = F.floor(key / BLOCK)
    name = F.replace(F.translate("p_name", " ", "-"), F.lit("red"), F.lit("reddit"))
    link = F.when(F.col("p_size") < 4, supplier_url(number)).otherwise(
        F.concat(F.lit("https://"), name, F.lit(".shop.net/"))
    )
    return table(spark, directory, "part").select(
        F.format_string("Supplier#%09d", number).alias("brand_name"),
        (key % BLOCK + 1).cast("int").alias("rank"),
        link.alias("link"),
    )


INDUSTRIES = ["cosmetics", "Home", "sports shoes", "jewel case", "skincare goods", "toys", ""]


def brands(spark: SparkSession, directory: str) -> DataFrame:
    """Suppliers as brands with an industry text."""
    return table(spark, directory, "supplier").select(
        F.col("s_name").alias("brand_name"),
        F.format_string("shop-%d.example.com", "s_suppkey").alias("domain"),
        F.get(F.lit(INDUSTRIES), (F.col("s_suppkey") % len(INDUSTRIES)).cast("int")).alias("industry"),
        "s_acctbal",
    )
