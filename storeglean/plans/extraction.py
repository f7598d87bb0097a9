"""Store extraction: landed pages and feeds to one record per store.

Everything a page can say is worked out where the page is read. Of the candidates of a fact each
task sends the first valid one only, so a store with a very large share of the pages still sends
a few rows per task, and the texts of the others never move.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import rules, schemas
from ..functions import contact, faq, industry, links, page, scoring, social, urls
from ..functions.arrays import cut, empty, keep_first_by, or_empty, size0, without
from ..functions.text import (
    blank_to_null, clean, has_text, head, longer_than, one_of, sql_text, strip, text_array,
)
from ..operators.keyed import top_n
from ..operators.stores import seconds_between
from ..sources import feed as feeds
from ..sources.dom import page_facts

_POLICIES = ["privacy", "return_refund", "shipping", "terms"]
_LINK_FACTS = "ARRAY<STRUCT<name: STRING, url: STRING, category: STRING, raw_category: STRING, is_default: BOOLEAN>>"


def _hero_product(p: Column) -> Column:
    """A featured product in the shape of a catalog product."""
    rest = F.expr(
        "named_struct('description', CAST(NULL AS STRING), 'sku', CAST(NULL AS STRING),"
        " 'vendor', CAST(NULL AS STRING), 'product_type', CAST(NULL AS STRING),"
        " 'tags', CAST(array() AS ARRAY<STRING>), 'available', true)"
    )
    names = ["description", "sku", "vendor", "product_type", "tags", "available"]
    found = ["name", "price", "image_url", "product_url"]
    return F.struct(*[p[n].alias(n) for n in found], *[rest[n].alias(n) for n in names])


def _fact_of(path: Column, candidates: dict[str, list[str]]) -> tuple[Column, Column]:
    """The fact a path is a candidate for, and its place in the order of trial."""
    fact, place = None, None
    for name, paths in candidates.items():
        hit, rank = one_of(path, paths), F.array_position(text_array(paths), path)
        fact = F.when(hit, F.lit(name)) if fact is None else fact.when(hit, F.lit(name))
        place = F.when(hit, rank) if place is None else place.when(hit, rank)
    return fact, place


def _store_key() -> Column:
    """One spelling of a store's URL, without the last slash."""
    return F.regexp_replace(urls.canonical(F.col("store_url")), "/+$", "")


def _listed(candidates: dict[str, list[str]]) -> str:
    return ", ".join(sql_text(p) for paths in candidates.values() for p in paths)


def _reads(
    pages: DataFrame, feed: DataFrame, stores: DataFrame | None, candidates: dict[str, list[str]]
) -> DataFrame:
    """(store_url, read_at, missing): a narrow row for anything that was landed of a store or asks for it, with the time of the
    read and whether the home page was not there, of candidate pages. `feed` has keys already."""
    home = ", ".join(sql_text(p) for p in candidates["home"])
    none = [F.lit(None).cast("timestamp").alias("read_at"), F.lit(None).cast("boolean").alias("missing")]
    keys = pages.select(
        _store_key().alias("store_url"),
        F.expr(f"CASE WHEN path IN ({_listed(candidates)}) THEN fetched_at END").alias("read_at"),
        F.expr(f"path IN ({home}) AND status = 404").alias("missing"),
    ).unionByName(feed.select("store_url", *none))
    if stores is not None:
        keys = keys.unionByName(stores.select(_store_key().alias("store_url"), *none))
    return keys.where("store_url is not null")


def _candidate_pages(pages: DataFrame, candidates: dict[str, list[str]]) -> DataFrame:
    """Delivered pages on candidate paths. The others fill no fact: what they tell is in `_reads`, and they go no further."""
    fact, place = _fact_of(F.col("path"), candidates)
    return pages.where(f"path IN ({_listed(candidates)}) AND status = 200").select(
        _store_key().alias("store_url"), "url", "fetched_at", fact.alias("fact"), place.alias("place"), "html"
    )


def _chosen(rows: DataFrame, valid: Column, values: list[str]) -> DataFrame:
    """(store_url, won): the first valid candidate of each fact of a store, among equals the newest fetch. Map tasks send one
    row of a fact at most, so that texts that lose stay where they are; texts are in no aggregate's order."""
    order = [F.desc("_valid"), F.asc("place"), F.desc("fetched_at")]
    first = top_n(rows.withColumn("_valid", valid), ["store_url", "fact"], order, 1).where("_valid AND store_url IS NOT NULL")
    return first.select("store_url", F.struct("fact", *values).alias("won"))


def _per_store(chosen: DataFrame, reads: DataFrame) -> DataFrame:
    """One row per store: `won`, the rows of its facts, seven or eight at most, how long reading took, and `missing`."""
    nothing = F.lit(None)
    kinds = dict(chosen.dtypes) | dict(reads.dtypes)
    rows = chosen.withColumns({c: nothing.cast(kinds[c]) for c in ("read_at", "missing")}).unionByName(
        reads.withColumn("won", nothing.cast(chosen.schema["won"].dataType))
    )
    return rows.groupBy("store_url").agg(
        F.collect_list("won").alias("won"),
        seconds_between(F.min("read_at"), F.max("read_at")).alias("extraction_duration_seconds"),
        F.max("missing").alias("missing"),
    )


def _won(fact: str, value: str) -> Column:
    return F.get(F.filter("won", lambda w: w["fact"] == fact), F.lit(0))[value]


def _with_scores(stores: DataFrame) -> DataFrame:
    return stores.withColumn("quality_score", scoring.quality_score())


def extract_stores(
    pages: DataFrame, feed: DataFrame, run_ts: Column, markers: list[str], stores: DataFrame | None = None,
    limits: rules.Limits = rules.KEEP_ALL,
) -> DataFrame:
    """One brand_insights record per store, not yet enriched.

    A store is any canonical URL in `pages`, in `feed` or in `stores` (store_url), whatever was found of it. `markers`
    tell a store of the platform. `limits` cut lists and texts; by default all is kept.
    """
    candidates = {"home": [rules.HOME_PATH, ""], **rules.CANDIDATE_PATHS}
    html, is_home = F.col("html"), F.col("fact") == "home"
    raw = _candidate_pages(pages, candidates).drop("url").select(
        "*",
        F.when(
            is_home & html.isNotNull(),
            F.struct(
                page.has_platform_marker(html, markers).alias("is_platform"),
                page.embedded_settings(html).alias("settings"),
                social.find_handles(html).alias("socials"),
                cut(contact.find_emails(html), limits.emails).alias("emails"),
                contact.find_phones(html, limits).alias("phones"),
            ),
        ).alias("inline"),
    )
    text_only = ["main_text"]
    facts = page_facts(
        raw,
        ["title", "og_site_name", "main_text", "main_text_raw", "anchors", "link_regions", "jsonld", "faq_candidates"],
        kind_column="fact",
        kinds={
            "home": ["title", "og_site_name", "main_text_raw", "anchors", "link_regions"],
            "faq": ["jsonld", "faq_candidates"],
            "about": text_only,
            **{name: text_only for name in _POLICIES},
        },
    )
    base, text = F.col("store_url"), F.col("main_text")
    home = F.struct(
        page.brand_name(F.col("og_site_name"), F.col("title"), base).alias("brand_name"),
        F.transform(links.hero_links(F.col("anchors"), base, limits=limits), _hero_product).alias("heroes"),
        links.pad_links(
            links.important_links(F.col("anchors"), F.col("link_regions"), base, limits=limits), base, limits
        ).alias("links"),
        F.when(
            longer_than(F.col("main_text_raw"), rules.HOME_CONTEXT_MIN),
            head(F.col("main_text_raw"), limits.home_chars),
        ).alias("context"),
        "inline",
    )
    pairs = cut(faq.of_page(F.col("jsonld"), F.col("faq_candidates"), limits), limits.faqs)
    page_rows = facts.select(
        "store_url",
        "fact",
        "place",
        "fetched_at",
        F.when(is_home & F.col("inline").isNotNull(), home).alias("home"),
        F.when(F.col("fact") == "faq", pairs).alias("pairs"),
        F.when(
            F.col("fact").isin(_POLICIES) & longer_than(text, rules.POLICY_MIN), head(text, limits.policy_chars)
        )
        .when((F.col("fact") == "about") & longer_than(text, rules.ABOUT_MIN), head(text, limits.about_chars))
        .alias("text"),
    )
    valid = (
        F.when(is_home, F.col("home").isNotNull())
        .when(F.col("fact") == "faq", size0(F.col("pairs")) > 0)
        .otherwise(F.col("text").isNotNull())
    )
    feed = feed.withColumn("store_url", _store_key())
    per_store = _per_store(_chosen(page_rows, valid, ["home", "text", "pairs"]), _reads(pages, feed, stores, candidates))
    per_store = per_store.select(
        "*",
        _won("home", "home").alias("home"),
        *[_won(name, "text").alias(name) for name in (*_POLICIES, "about")],
        _won("faq", "pairs").alias("pairs"),
    )
    joined = per_store.join(feeds.store_catalogs(feed, limits=limits), "store_url", "left")
    home, inline, ok = F.col("home"), F.col("home.inline"), F.col("home").isNotNull()
    none = F.lit(None).cast("string")
    return _with_scores(
        joined.select(
            urls.canonical(base).alias("website_url"),
            home["brand_name"].alias("brand_name"),
            _when_ok(ok, F.col("products"), schemas.PRODUCT).alias("product_catalog"),
            _when_ok(ok, home["heroes"], schemas.PRODUCT).alias("hero_products"),
            F.when(ok, F.coalesce("product_count", F.lit(0))).otherwise(F.lit(0)).alias("total_products"),
            F.when(ok, F.col("privacy")).alias("privacy_policy"),
            none.alias("privacy_policy_url"),
            F.when(ok, F.col("return_refund")).alias("return_refund_policy"),
            none.alias("return_refund_policy_url"),
            F.when(ok, F.col("shipping")).alias("shipping_policy"),
            F.when(ok, F.col("terms")).alias("terms_of_service"),
            F.when(ok, F.coalesce("about", home["context"])).alias("brand_context"),
            none.alias("brand_description"),
            F.when(ok, faq.pad_pairs(F.col("pairs"), limits)).otherwise(_no_pairs()).alias("faqs"),
            _when_ok(ok, inline["socials"], schemas.SOCIAL).alias("social_handles"),
            F.struct(
                _when_ok(ok, inline["emails"], "STRING").alias("emails"),
                _when_ok(ok, inline["phones"], "STRING").alias("phone_numbers"),
                none.alias("address"),
                none.alias("support_hours"),
            ).alias("contact_info"),
            F.coalesce(home["links"], F.array().cast(_LINK_FACTS)).alias("important_links"),
            inline["settings"]["currency"].alias("currency"),
            inline["settings"]["country"].alias("country"),
            none.alias("language"),
            F.coalesce(inline["is_platform"], F.lit(True)).alias("is_platform_store"),
            run_ts.alias("extraction_timestamp"),
            ok.alias("extraction_success"),
            F.when(ok, F.array().cast("array<string>"))
            .otherwise(F.array(F.lit("Failed to fetch homepage")))
            .alias("error_messages"),
            F.when(ok, F.col("extraction_duration_seconds")).alias("extraction_duration_seconds"),
        )
    )


def _when_ok(ok: Column, arr: Column, ddl: str) -> Column:
    return F.when(ok, or_empty(arr, ddl)).otherwise(empty(ddl))


def _no_pairs() -> Column:
    return empty("STRUCT<question: STRING, answer: STRING, category: STRING, is_default: BOOLEAN>")


def enrich(stores: DataFrame, limits: rules.Limits = rules.KEEP_ALL) -> DataFrame:
    """Clean, de-duplicate and score records. All rules work inside the row: no shuffle."""

    def name_key(p: Column) -> Column:
        return strip(F.lower(p["name"]))

    contact_info = F.col("contact_info")
    cleaned = stores.withColumns(
        {
            name: F.when(has_text(F.col(name)), clean(F.col(name), limits.clean_chars)).otherwise(F.col(name))
            for name in ("privacy_policy", "return_refund_policy")
        }
        | {
            "brand_context": F.coalesce(
                blank_to_null(F.col("brand_context")),
                blank_to_null(F.col("brand_description")),
                F.col("brand_context"),
            ),
            "product_catalog": keep_first_by(F.col("product_catalog"), name_key),
            "hero_products": keep_first_by(F.col("hero_products"), name_key),
            "contact_info": F.struct(
                contact.clean_emails(contact_info["emails"], limits=limits).alias("emails"),
                contact.clean_phones(contact_info["phone_numbers"], limits).alias("phone_numbers"),
                contact_info["address"].alias("address"),
                contact_info["support_hours"].alias("support_hours"),
            ),
            "social_handles": social.dedup_handles(F.col("social_handles")),
            "important_links": links.dedup_links(F.col("important_links"), limits),
        }
    )
    hero_names = F.transform("hero_products", lambda p: F.lower(p["name"]))
    without_heroes = cleaned.withColumn(
        "product_catalog", without(F.col("product_catalog"), lambda p: F.lower(p["name"]), hero_names)
    )
    counted = without_heroes.withColumn("total_products", F.size("product_catalog") + F.size("hero_products"))
    return _with_scores(counted)


def to_table(stores: DataFrame) -> DataFrame:
    """Records in the stored shape: helper fields of FAQs and links are dropped."""
    faqs = F.transform("faqs", lambda q: F.struct(q["question"], q["answer"], q["category"]))
    kept = F.transform("important_links", lambda k: F.struct(k["name"], k["url"], k["category"]))
    return stores.withColumns(
        {
            "faqs": faqs.cast(f"ARRAY<{schemas.FAQ}>"),
            "important_links": kept.cast(f"ARRAY<{schemas.LINK}>"),
        }
    )


# ---- the other extraction profile


def extract_stores_crawl(
    pages: DataFrame, feed: DataFrame, run_ts: Column, markers: list[str], stores: DataFrame | None = None,
    limits: rules.Limits = rules.KEEP_ALL,
) -> DataFrame:
    """Records by the crawler's rules: other path lists, selectors, lengths and patterns.

    Stores and markers are those of `extract_stores`. Where several pages could fill one fact the first path in the list counts.
    """
    candidates = {"home": [rules.HOME_PATH, ""]}
    for path in rules.CRAWL_POLICY_PATHS + rules.CRAWL_CONTENT_PATHS:
        if _crawl_fact(path):
            candidates.setdefault(_crawl_fact(path), []).append(path)
    html, fact = F.col("html"), F.col("fact")
    raw = _candidate_pages(pages, candidates).select(
        "*",
        F.when(
            html.isNotNull() & (fact == "home"),
            F.struct(
                page.has_platform_marker(html, markers).alias("is_platform"),
                social.find_handles_crawl(html).alias("socials"),
            ),
        ).alias("inline"),
        F.when(
            html.isNotNull() & (fact == "contact"),
            F.struct(
                cut(contact.find_emails_bounded(html), limits.emails).alias("emails"),
                cut(contact.find_phones_grouped(html), limits.phones).alias("phones"),
            ),
        ).alias("reach"),
    )
    policies = ["privacy_policy", "return_refund_policy", "shipping_policy", "terms_of_service"]
    facts = page_facts(
        raw,
        ["title", "og_site_name", "logo_alt", "main_text_direct", "anchors", "jsonld", "faq_items", "address"],
        kind_column="fact",
        kinds={
            "home": ["title", "og_site_name", "logo_alt", "anchors"],
            "faq": ["jsonld", "faq_items"],
            "about": ["main_text_direct"],
            "contact": ["address"],
            **{name: ["main_text_direct"] for name in policies},
        },
    )
    base, text = F.col("store_url"), F.col("main_text_direct")
    structured = faq.from_jsonld(F.col("jsonld"), limits.faq_answer_chars)
    pairs = F.when(F.size(structured) > 0, structured).otherwise(faq.from_items(F.col("faq_items"), limits))
    home = F.struct(
        page.brand_name_crawl(F.col("og_site_name"), F.col("title"), F.col("logo_alt"), base).alias("brand_name"),
        F.transform(links.hero_links_crawl(F.col("anchors"), base, limits), _hero_product).alias("heroes"),
        links.important_links_crawl(F.col("anchors"), base, limits).alias("links"),
        "inline",
    )
    shown = F.when(fact == "about", head(text, limits.about_crawl_chars)).otherwise(head(text, limits.policy_crawl_chars))
    least = F.when(fact == "about", F.lit(rules.ABOUT_CRAWL_MIN)).otherwise(F.lit(rules.POLICY_MIN))
    rows = facts.select(
        "store_url",
        "fact",
        "place",
        "fetched_at",
        F.when(F.col("inline").isNotNull(), home).alias("home"),
        F.when(fact == "faq", pairs).alias("pairs"),
        F.when(
            F.length(text) > least,
            F.struct(shown.alias("text"), F.col("url").alias("url")),
        ).alias("page_text"),
        F.when(
            F.col("reach").isNotNull(),
            F.struct("reach.*", head(strip(F.col("address")), limits.address_chars).alias("address")),
        ).alias("reach"),
    )
    valid = (
        F.when(fact == "home", F.col("home").isNotNull())
        .when(fact == "faq", size0(F.col("pairs")) > 0)
        .when(fact == "contact", F.col("reach").isNotNull())
        .otherwise(F.col("page_text").isNotNull())
    )
    feed = feed.withColumn("store_url", _store_key())
    chosen = _chosen(rows, valid, ["home", "page_text", "pairs", "reach"])
    per_store = _per_store(chosen, _reads(pages, feed, stores, candidates)).select(
        "*",
        _won("home", "home").alias("home"),
        *[_won(name, "page_text").alias(name) for name in (*policies, "about")],
        _won("faq", "pairs").alias("pairs"),
        _won("contact", "reach").alias("reach"),
    )
    joined = per_store.join(feeds.first_page_products(feed, limits), "store_url", "left")
    home, inline, reach = F.col("home"), F.col("home.inline"), F.col("reach")
    ok = F.coalesce(inline["is_platform"], F.lit(False))
    none = F.lit(None).cast("string")
    error = (
        F.when(ok, None)
        .when(home.isNotNull(), F.lit("Not a store of the platform"))
        .when(F.col("missing"), F.concat(F.lit("Website not found: "), base))
        .otherwise(F.lit("Failed to fetch homepage"))
    )
    return _with_scores(
        joined.select(
            urls.canonical(base).alias("website_url"),
            F.when(ok, home["brand_name"]).alias("brand_name"),
            _when_ok(ok, F.col("products"), schemas.PRODUCT).alias("product_catalog"),
            _when_ok(ok, home["heroes"], schemas.PRODUCT).alias("hero_products"),
            F.when(ok, size0(F.col("products"))).otherwise(F.lit(0)).alias("total_products"),
            F.when(ok, F.col("privacy_policy.text")).alias("privacy_policy"),
            F.when(ok, F.col("privacy_policy.url")).alias("privacy_policy_url"),
            F.when(ok, F.col("return_refund_policy.text")).alias("return_refund_policy"),
            F.when(ok, F.col("return_refund_policy.url")).alias("return_refund_policy_url"),
            F.when(ok, F.col("shipping_policy.text")).alias("shipping_policy"),
            F.when(ok, F.col("terms_of_service.text")).alias("terms_of_service"),
            F.when(ok, F.col("about.text")).alias("brand_context"),
            none.alias("brand_description"),
            F.when(ok, F.coalesce("pairs", _no_pairs())).otherwise(_no_pairs()).alias("faqs"),
            _when_ok(ok, inline["socials"], schemas.SOCIAL).alias("social_handles"),
            F.struct(
                _when_ok(ok, reach["emails"], "STRING").alias("emails"),
                _when_ok(ok, reach["phones"], "STRING").alias("phone_numbers"),
                F.when(ok, reach["address"]).alias("address"),
                none.alias("support_hours"),
            ).alias("contact_info"),
            F.when(ok, home["links"]).otherwise(F.array().cast(_LINK_FACTS)).alias("important_links"),
            none.alias("currency"),
            none.alias("country"),
            none.alias("language"),
            ok.alias("is_platform_store"),
            run_ts.alias("extraction_timestamp"),
            ok.alias("extraction_success"),
            F.when(error.isNull(), F.array().cast("array<string>")).otherwise(F.array(error)).alias("error_messages"),
            F.when(ok, F.col("extraction_duration_seconds")).alias("extraction_duration_seconds"),
        )
    )


def _crawl_fact(path: str) -> str | None:
    """Fact a crawled path belongs to; the lists are fixed, so this runs while planning."""
    words = {
        "privacy": "privacy_policy", "return": "return_refund_policy", "refund": "return_refund_policy",
        "shipping": "shipping_policy", "terms": "terms_of_service", "faq": "faq", "about": "about",
        "story": "about", "contact": "contact",
    }
    return next((fact for word, fact in words.items() if word in path), None)


def industries(stores: DataFrame) -> DataFrame:
    """Industry keywords and industry of each store."""
    words = industry.keywords(F.col("product_catalog"))
    return stores.withColumn("industry_keywords", words).withColumn(
        "industry", industry.of_keywords(F.col("industry_keywords"))
    )
