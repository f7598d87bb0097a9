"""Queries that run the whole extraction over supplier stores."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import rules
from ..operators import stores as tables
from ..plans import extraction
from . import roles
from .sqltext import PAIRS, strip


def _now() -> Column:
    return F.lit("2024-02-01 00:00:00").cast("timestamp")


def _extracted(spark: SparkSession, d: str) -> DataFrame:
    return extraction.extract_stores(
        roles.supplier_pages(spark, d), roles.supplier_feed(spark, d), _now(), roles.MARKERS
    )


def _enriched(spark: SparkSession, d: str) -> DataFrame:
    return extraction.enrich(_extracted(spark, d))


def _flat(stores: DataFrame) -> DataFrame:
    hero = F.get("hero_products", F.lit(0))
    contact = F.col("contact_info")
    return stores.select(
        "website_url",
        "brand_name",
        F.size("product_catalog").alias("n_catalog"),
        F.size("hero_products").alias("n_hero"),
        hero["name"].alias("hero_name"),
        hero["price"].alias("hero_price"),
        hero["product_url"].alias("hero_url"),
        "total_products",
        F.md5("privacy_policy").alias("privacy_md5"),
        F.md5("return_refund_policy").alias("return_md5"),
        F.md5("shipping_policy").alias("shipping_md5"),
        F.md5("terms_of_service").alias("terms_md5"),
        F.md5("brand_context").alias("context_md5"),
        F.size("faqs").alias("n_faqs"),
        F.get("faqs", F.lit(0))["question"].alias("first_question"),
        F.array_join(F.transform("social_handles", lambda s: s["url"]), " ").alias("socials"),
        F.array_join(contact["emails"], " ").alias("emails"),
        F.array_join(contact["phone_numbers"], " ").alias("phones"),
        F.array_join(
            F.transform("important_links", lambda k: F.concat(k["category"], F.lit(":"), k["name"])), "|"
        ).alias("links"),
        "currency",
        "country",
        "is_platform_store",
        "extraction_success",
        F.array_join("error_messages", ";").alias("errors"),
        "extraction_duration_seconds",
        "quality_score",
    )


def store_document(spark: SparkSession, d: str) -> DataFrame:
    return _flat(_extracted(spark, d))


_N = len(roles.DOC_PATHS)


def _policy(first: int, second: int, name: str) -> str:
    """The valid candidate that is tried first."""
    return f"""
    {name} AS (
      SELECT doc_id // {_N} AS k, arg_min({strip('text')}, doc_id % {_N}) AS t FROM documents
      WHERE doc_id % {_N} IN ({first}, {second}) AND lang <> 'de' AND length({strip('text')}) > 100 GROUP BY 1
    )"""


_FACTS = f"""
{PAIRS}, keys AS (
  SELECT s_suppkey AS k FROM supplier UNION SELECT doc_id // {_N} FROM documents UNION SELECT conv_id FROM pairs
  UNION SELECT p_partkey // {roles.BLOCK} FROM part
), items AS (
  SELECT p_partkey // {roles.BLOCK} AS k, p_partkey, p_name, p_size, printf('%.2f', p_retailprice) AS price FROM part
), heroes AS (
  SELECT * FROM items WHERE p_size > {roles.HERO_SIZE}
), hero AS (
  SELECT k, count(*) AS n, count(DISTINCT p_name) AS n_names, min(p_partkey) AS first_key,
    arg_min(p_name, p_partkey) AS name, arg_min(price, p_partkey) AS price FROM heroes GROUP BY k
), catalog AS (
  SELECT k, count(*) AS n, count(DISTINCT p_name) FILTER (WHERE p_name NOT IN (
    SELECT p_name FROM heroes h WHERE h.k = items.k)) AS n_names FROM items GROUP BY k
), faq AS (
  SELECT conv_id AS k, count(*) AS n, arg_min(question, turn) AS question,
    arg_min(question, turn) FILTER (WHERE length(answer) > 0) AS q
  FROM pairs WHERE question <> '' AND answer <> '' GROUP BY conv_id
), times AS (
  SELECT k, max(s) - min(s) AS span, max(c) - min(c) AS crawl_span FROM (
    SELECT s_suppkey AS k, 0 AS s, 0 AS c FROM supplier
    UNION ALL SELECT s_suppkey, NULL, 40 FROM supplier
    UNION ALL SELECT doc_id // {_N}, doc_id % {_N}, CASE WHEN doc_id % {_N} <> 7 THEN doc_id % {_N} END FROM documents
    UNION ALL SELECT conv_id, 30, 30 FROM pairs
  ) GROUP BY k
), {_policy(0, 1, 'privacy')}, {_policy(2, 3, 'returns')}, {_policy(4, 5, 'shipping')},
{_policy(6, 7, 'terms')}, {_policy(8, 9, 'about')},
base AS (
  SELECT keys.k, 'https://shop-' || keys.k || '.example.com' AS url, s.s_name, s.s_nationkey AS nation,
    s.s_acctbal < 2000 AS low, s.s_suppkey IS NOT NULL AND s.s_nationkey <> 24 AS ok
  FROM keys LEFT JOIN supplier s ON keys.k = s.s_suppkey
)
"""

_EVEN = "nation % 2 = 0"
_LINKS_EVEN = "other:Contact us|tracking:Track order|legal:Terms|other:Shop all|blog:News|account:Sign in"
_LINKS_ODD = (
    "other:Shop all|blog:News|account:Sign in|tracking:Track Order|other:Contact Us|about:About Us|{}support:Customer Support"
)
_SCORE = """
least(20, {catalog} * 0.5) + least(10, {hero} * 2) + 5 * ((p.t IS NOT NULL)::INT + (r.t IS NOT NULL)::INT
  + (sh.t IS NOT NULL)::INT + (te.t IS NOT NULL)::INT) + least(10, {faqs}) + CASE WHEN a.t IS NOT NULL THEN 10 ELSE 0 END
  + {social} + 5 + CASE WHEN {phone} THEN 5 ELSE 0 END + {links}
"""
_JOINS = """
FROM base b LEFT JOIN hero h ON b.k = h.k LEFT JOIN catalog c ON b.k = c.k LEFT JOIN faq f ON b.k = f.k
LEFT JOIN times t ON b.k = t.k LEFT JOIN privacy p ON b.k = p.k LEFT JOIN returns r ON b.k = r.k
LEFT JOIN shipping sh ON b.k = sh.k LEFT JOIN terms te ON b.k = te.k LEFT JOIN about a ON b.k = a.k
"""
_FAQS = "coalesce(f.n, 3)"


def _document_sql(enriched: bool) -> str:
    names = "n_names" if enriched else "n"
    catalog, hero = f"coalesce(c.{names}, 0)", f"coalesce(h.{names}, 0)"
    total = f"({catalog} + {hero})" if enriched else "coalesce(c.n, 0)"
    # After enrichment the default "Shop All" link is seen to repeat an address.
    odd = _LINKS_ODD.format("" if enriched else "other:Shop All|")
    emails = (
        "'sales' || b.k || '@shop.co'" if enriched
        else "'Sales' || b.k || '@Shop.co sales' || b.k || '@shop.co hi@example.com'"
    )
    score = _SCORE.format(
        catalog=catalog, hero=hero, faqs=_FAQS, social="4", phone="low",
        links=f"CASE WHEN {_EVEN} THEN 6 ELSE {len(odd.split('|'))} END",
    )

    def clean(x: str) -> str:
        if not enriched:
            return f"md5({x})"
        flat = rf"trim(regexp_replace({x}, '\s+', ' ', 'g'))"
        return f"md5({flat})"

    return f"""
WITH {_FACTS}
SELECT url || '/' AS website_url,
  CASE WHEN ok THEN CASE WHEN low THEN s_name ELSE 'Shop ' || b.k END END AS brand_name,
  CASE WHEN ok THEN {catalog} ELSE 0 END AS n_catalog, CASE WHEN ok THEN {hero} ELSE 0 END AS n_hero,
  CASE WHEN ok THEN h.name END AS hero_name, CASE WHEN ok THEN h.price END AS hero_price,
  CASE WHEN ok THEN url || '/products/p' || h.first_key END AS hero_url,
  CASE WHEN ok THEN {total} ELSE 0 END AS total_products,
  CASE WHEN ok THEN {clean('p.t')} END AS privacy_md5, CASE WHEN ok THEN {clean('r.t')} END AS return_md5,
  CASE WHEN ok THEN md5(sh.t) END AS shipping_md5, CASE WHEN ok THEN md5(te.t) END AS terms_md5,
  CASE WHEN ok THEN md5(a.t) END AS context_md5,
  CASE WHEN ok THEN {_FAQS} ELSE 0 END AS n_faqs,
  CASE WHEN ok THEN coalesce(f.question, '{rules.DEFAULT_FAQS[0][0]}') END AS first_question,
  CASE WHEN ok THEN 'https://instagram.com/shop' || b.k || ' https://youtube.com/tube' || b.k ELSE '' END AS socials,
  CASE WHEN ok THEN {emails} ELSE '' END AS emails,
  CASE WHEN ok AND low THEN printf('(212) 555-%04d', b.k % 10000) ELSE '' END AS phones,
  CASE WHEN NOT ok THEN '' WHEN {_EVEN} THEN '{_LINKS_EVEN}' ELSE '{odd}' END AS links,
  CASE WHEN ok THEN 'USD' END AS currency, CASE WHEN ok THEN 'C' || chr(65 + nation) END AS country,
  CASE WHEN ok THEN nation < 20 ELSE true END AS is_platform_store, ok AS extraction_success,
  CASE WHEN ok THEN '' ELSE 'Failed to fetch homepage' END AS errors,
  CASE WHEN ok THEN CAST(t.span AS DOUBLE) END AS extraction_duration_seconds,
  CASE WHEN ok THEN CAST({score} AS DOUBLE) ELSE 0.0::DOUBLE END AS quality_score
{_JOINS}
"""


STORE_DOCUMENT = _document_sql(False)


def store_enriched(spark: SparkSession, d: str) -> DataFrame:
    return _flat(_enriched(spark, d))


STORE_ENRICHED = _document_sql(True)


def store_crawl(spark: SparkSession, d: str) -> DataFrame:
    """The other extraction profile over the same landed inputs."""
    crawled = extraction.extract_stores_crawl(
        roles.supplier_pages(spark, d), roles.supplier_feed(spark, d), _now(), roles.MARKERS
    )
    reached = crawled.select(
        F.col("website_url"),
        F.col("contact_info.address").alias("address"),
        F.col("privacy_policy_url").alias("privacy_url"),
        F.col("return_refund_policy_url").alias("return_url"),
    )
    return _flat(crawled).drop("currency", "country", "hero_url").join(reached, "website_url")


_CRAWL_SCORE = _SCORE.format(
    catalog="coalesce(c.n, 0)", hero="coalesce(h.n_all, 0)", faqs="coalesce(f.n, 0)", social="6",
    phone="true", links=f"CASE WHEN {_EVEN} THEN 4 ELSE 1 END",
)


def _crawl_policy(first: int, second: int, name: str, least: int = 100) -> str:
    return f"""
    {name} AS (
      SELECT doc_id // {_N} AS k, arg_min({strip('text')}, doc_id % {_N}) AS t,
        ['{"', '".join(roles.DOC_PATHS)}'][min(doc_id % {_N}) + 1] AS path FROM documents
      WHERE doc_id % {_N} IN ({first}, {second}) AND lang <> 'de' AND length({strip('text')}) > {least} GROUP BY 1
    )"""


_CRAWL_FACTS = f"""
{_FACTS.split(', ' + _policy(0, 1, 'privacy'))[0]},
{_crawl_policy(0, 1, 'privacy')}, {_crawl_policy(2, 3, 'returns')}, {_crawl_policy(4, 5, 'shipping')},
{_crawl_policy(6, 6, 'terms')}, {_crawl_policy(8, 9, 'about', 50)},
all_heroes AS (
  SELECT * FROM items WHERE p_size > {roles.HERO_SIZE}
), hero_counts AS (SELECT k, count(*) AS n_all FROM all_heroes GROUP BY k),
base AS (
  SELECT keys.k, 'https://shop-' || keys.k || '.example.com' AS url, s.s_name, s.s_nationkey AS nation,
    s.s_acctbal < 2000 AS low, coalesce(s.s_nationkey < 20, false) AS ok
  FROM keys LEFT JOIN supplier s ON keys.k = s.s_suppkey
)
"""
STORE_CRAWL = f"""
WITH {_CRAWL_FACTS}
SELECT url || '/' AS website_url,
  CASE WHEN ok THEN CASE WHEN low THEN s_name ELSE 'Shop ' || b.k END END AS brand_name,
  CASE WHEN ok THEN coalesce(c.n, 0) ELSE 0 END AS n_catalog,
  CASE WHEN ok THEN coalesce(h.n_all, 0) ELSE 0 END AS n_hero,
  CASE WHEN ok THEN g.name END AS hero_name, CASE WHEN ok AND g.first_key % 2 = 0 THEN g.price END AS hero_price,
  CASE WHEN ok THEN coalesce(c.n, 0) ELSE 0 END AS total_products,
  CASE WHEN ok THEN md5(p.t) END AS privacy_md5, CASE WHEN ok THEN md5(r.t) END AS return_md5,
  CASE WHEN ok THEN md5(sh.t) END AS shipping_md5, CASE WHEN ok THEN md5(te.t) END AS terms_md5,
  CASE WHEN ok THEN md5(a.t) END AS context_md5, CASE WHEN ok THEN b.k || ' Road' END AS address,
  CASE WHEN ok THEN url || p.path END AS privacy_url, CASE WHEN ok THEN url || r.path END AS return_url,
  CASE WHEN ok THEN coalesce(f.n, 0) ELSE 0 END AS n_faqs,
  CASE WHEN ok THEN f.question END AS first_question,
  CASE WHEN ok THEN 'https://instagram.com/shop' || b.k || '">Instagram< https://facebook.com/sharer">Share< '
    || 'https://youtube.com/c/tube' || b.k ELSE '' END AS socials,
  CASE WHEN ok THEN 'info' || b.k || '@shop.co' ELSE '' END AS emails,
  CASE WHEN ok THEN printf('+1 212-555-%04d', b.k % 10000) ELSE '' END AS phones,
  CASE WHEN NOT ok THEN '' WHEN {_EVEN} THEN 'other:Contact us|tracking:Track order|legal:Terms|blog:News'
    ELSE 'blog:News' END AS links,
  ok AS is_platform_store, ok AS extraction_success,
  CASE WHEN ok THEN '' WHEN nation = 24 THEN 'Website not found: ' || url WHEN nation IS NOT NULL THEN 'Not a store of the platform'
    ELSE 'Failed to fetch homepage' END AS errors,
  CASE WHEN ok THEN CAST(t.crawl_span AS DOUBLE) END AS extraction_duration_seconds,
  CASE WHEN ok THEN CAST({_CRAWL_SCORE} AS DOUBLE) ELSE 0.0::DOUBLE END AS quality_score
{_JOINS.replace('LEFT JOIN hero h ON', 'LEFT JOIN hero g ON b.k = g.k LEFT JOIN hero_counts h ON')}
"""


def store_summary(spark: SparkSession, d: str) -> DataFrame:
    return tables.summary(_enriched(spark, d)).select(
        "website_url", "quality_score", "total_products", "hero_products_count", "faqs_count",
        "social_platforms_count", "policies_extracted", "contact_methods",
    )


STORE_SUMMARY = f"""
SELECT website_url, quality_score, total_products, n_hero AS hero_products_count, n_faqs AS faqs_count,
  CASE WHEN extraction_success THEN 2 ELSE 0 END AS social_platforms_count,
  (privacy_md5 IS NOT NULL)::INT + (return_md5 IS NOT NULL)::INT + (shipping_md5 IS NOT NULL)::INT
    + (terms_md5 IS NOT NULL)::INT AS policies_extracted,
  (emails <> '')::INT + (phones <> '')::INT AS contact_methods
FROM ({STORE_ENRICHED})
"""


def section_select(spark: SparkSession, d: str) -> DataFrame:
    wanted = tables.sections(
        _extracted(spark, d), include_faqs=False, include_social=False, max_products=3
    )
    return wanted.select(
        "website_url",
        "brand_name",
        F.array_join(F.transform("products", lambda p: p["name"]), ",").alias("products"),
        F.size("hero_products").alias("n_hero"),
        F.md5("policies.shipping_policy").alias("shipping_md5"),
    )


SECTION_SELECT = f"""
WITH names AS (
  SELECT 'https://shop-' || (p_partkey // {roles.BLOCK}) || '.example.com/' AS website_url,
    string_agg(p_name, ',' ORDER BY p_partkey) AS products
  FROM part WHERE p_partkey % {roles.BLOCK} < 3 GROUP BY 1
)
SELECT s.website_url, brand_name, CASE WHEN extraction_success THEN coalesce(n.products, '') ELSE '' END AS products,
  n_hero, shipping_md5
FROM ({STORE_DOCUMENT}) s LEFT JOIN names n ON s.website_url = n.website_url
"""


def decode_defaults(spark: SparkSession, d: str) -> DataFrame:
    """Lists and contact of failed runs are stored as null and read back as empty."""
    stored = _extracted(spark, d)
    for name in ("product_catalog", "hero_products", "social_handles", "contact_info", "error_messages"):
        stored = stored.withColumn(name, F.when(F.col("extraction_success"), F.col(name)))
    stored = extraction.to_table(stored).withColumn("faqs", F.when(F.size("faqs") > 3, F.col("faqs")))
    stored = stored.withColumn("brand_description", F.concat(F.lit("About "), "website_url"))
    read = tables.with_context(tables.decode_defaults(stored))
    return read.select(
        "website_url",
        F.size("product_catalog").alias("n_catalog"),
        F.size("hero_products").alias("n_hero"),
        F.size("faqs").alias("n_faqs"),
        F.size("social_handles").alias("n_socials"),
        F.size("contact_info.emails").alias("n_emails"),
        F.size("error_messages").alias("n_errors"),
        F.md5("brand_context").alias("context_md5"),
    )


DECODE_DEFAULTS = f"""
SELECT website_url, n_catalog, n_hero, CASE WHEN n_faqs > 3 THEN n_faqs ELSE 0 END AS n_faqs,
  CASE WHEN extraction_success THEN 2 ELSE 0 END AS n_socials, CASE WHEN extraction_success THEN 3 ELSE 0 END AS n_emails,
  0 AS n_errors, coalesce(context_md5, md5('About ' || website_url)) AS context_md5
FROM ({STORE_DOCUMENT})
"""


def export_json(spark: SparkSession, d: str) -> DataFrame:
    """Every field of the exported documents."""
    document = F.col("document")

    def at(path: str) -> Column:
        return F.get_json_object(document, f"$.{path}")

    def n(path: str) -> Column:
        return F.json_array_length(at(path))

    return tables.export_json(extraction.to_table(_enriched(spark, d))).select(
        "website_url",
        at("website_url").alias("exported_url"),
        at("brand_name").alias("brand_name"),
        n("product_catalog").alias("n_catalog"),
        n("hero_products").alias("n_hero"),
        at("hero_products[0].name").alias("hero_name"),
        at("hero_products[0].price").alias("hero_price"),
        at("hero_products[0].product_url").alias("hero_url"),
        at("total_products").cast("int").alias("total_products"),
        F.md5(at("privacy_policy")).alias("privacy_md5"),
        F.md5(at("return_refund_policy")).alias("return_md5"),
        F.md5(at("shipping_policy")).alias("shipping_md5"),
        F.md5(at("terms_of_service")).alias("terms_md5"),
        F.md5(at("brand_context")).alias("context_md5"),
        n("faqs").alias("n_faqs"),
        at("faqs[0].question").alias("first_question"),
        at("faqs[0].category").alias("first_category"),
        at("social_handles[0].url").alias("first_social"),
        at("social_handles[1].url").alias("second_social"),
        at("contact_info.emails[0]").alias("email"),
        at("contact_info.phone_numbers[0]").alias("phone"),
        n("important_links").alias("n_links"),
        at("important_links[0].name").alias("first_link"),
        at("important_links[0].category").alias("first_link_category"),
        at("extraction_timestamp").alias("extraction_timestamp"),
        at("extraction_success").alias("extraction_success"),
        at("error_messages[0]").alias("error"),
        at("quality_score").cast("double").alias("quality_score"),
    )


EXPORT_JSON = f"""
SELECT website_url, website_url AS exported_url, brand_name, n_catalog, n_hero, hero_name, hero_price, hero_url, total_products,
  privacy_md5, return_md5, shipping_md5, terms_md5, context_md5, n_faqs, first_question,
  CASE WHEN NOT extraction_success THEN NULL WHEN first_question = '{rules.DEFAULT_FAQS[0][0]}' THEN '{rules.DEFAULT_FAQS[0][2]}'
    ELSE 'general' END AS first_category,
  nullif(split_part(socials, ' ', 1), '') AS first_social, nullif(split_part(socials, ' ', 2), '') AS second_social,
  nullif(emails, '') AS email, nullif(phones, '') AS phone,
  CASE WHEN links = '' THEN 0 ELSE len(string_split(links, '|')) END AS n_links,
  nullif(split_part(split_part(links, '|', 1), ':', 2), '') AS first_link, nullif(split_part(links, ':', 1), '') AS first_link_category,
  '2024-02-01T00:00:00' AS extraction_timestamp, CAST(extraction_success AS VARCHAR) AS extraction_success,
  nullif(errors, '') AS error, quality_score
FROM ({STORE_ENRICHED})
"""

QUERIES = {
    "store_document": (store_document, STORE_DOCUMENT),
    "store_enriched": (store_enriched, STORE_ENRICHED),
    "store_crawl": (store_crawl, STORE_CRAWL),
    "store_summary": (store_summary, STORE_SUMMARY),
    "section_select": (section_select, SECTION_SELECT),
    "decode_defaults": (decode_defaults, DECODE_DEFAULTS),
    "export_json": (export_json, EXPORT_JSON),
}
