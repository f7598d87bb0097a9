"""Explicit schemas as DDL text. Nothing in the package infers a schema."""

STORE_PAGES = (
    "store_url STRING, path STRING, url STRING, status INT, fetched_at TIMESTAMP, html STRING"
)
PRODUCT_FEED = "store_url STRING, page INT, status INT, body STRING"
FEED_LANDINGS = f"{PRODUCT_FEED}, fetched_at TIMESTAMP"
SEARCH_RESULTS = "brand_name STRING, rank INT, link STRING"

FEED_BODY = (
    "STRUCT<products: ARRAY<STRUCT<title: STRING, body_html: STRING, vendor: STRING,"
    " product_type: STRING, tags: STRING, handle: STRING,"
    " variants: ARRAY<STRUCT<price: STRING, sku: STRING, available: BOOLEAN>>,"
    " images: ARRAY<STRUCT<src: STRING>>>>>"
)
FAQ_BLOCK = (
    "STRUCT<`@type`: STRING, mainEntity: ARRAY<STRUCT<`@type`: STRING, name: STRING,"
    " acceptedAnswer: STRUCT<text: STRING>>>>"
)

PRODUCT = (
    "STRUCT<name: STRING, price: STRING, image_url: STRING, product_url: STRING,"
    " description: STRING, sku: STRING, vendor: STRING, product_type: STRING,"
    " tags: ARRAY<STRING>, available: BOOLEAN>"
)
FAQ = "STRUCT<question: STRING, answer: STRING, category: STRING>"
SOCIAL = "STRUCT<platform: STRING, url: STRING, handle: STRING>"
CONTACT = (
    "STRUCT<emails: ARRAY<STRING>, phone_numbers: ARRAY<STRING>, address: STRING,"
    " support_hours: STRING>"
)
LINK = "STRUCT<name: STRING, url: STRING, category: STRING>"

BRAND_INSIGHTS = f"""
website_url STRING, brand_name STRING,
product_catalog ARRAY<{PRODUCT}>, hero_products ARRAY<{PRODUCT}>, total_products INT,
privacy_policy STRING, privacy_policy_url STRING,
return_refund_policy STRING, return_refund_policy_url STRING,
shipping_policy STRING, terms_of_service STRING,
brand_context STRING, brand_description STRING,
faqs ARRAY<{FAQ}>, social_handles ARRAY<{SOCIAL}>, contact_info {CONTACT},
important_links ARRAY<{LINK}>,
currency STRING, country STRING, language STRING, is_platform_store BOOLEAN,
extraction_timestamp TIMESTAMP, extraction_success BOOLEAN, error_messages ARRAY<STRING>,
extraction_duration_seconds DOUBLE, quality_score DOUBLE,
created_at TIMESTAMP, updated_at TIMESTAMP
"""

COMPETITOR = (
    "STRUCT<website_url: STRING, brand_name: STRING, total_products: INT, has_faqs: BOOLEAN,"
    " social_platforms: INT>"
)
COMPETITOR_ANALYSES = f"""
main_brand_url STRING, main_brand_name STRING, competitors ARRAY<{COMPETITOR}>,
analysis_summary STRING, analysis_timestamp TIMESTAMP, industry_keywords ARRAY<STRING>,
created_at TIMESTAMP
"""
EXTRACTION_LOGS = """
website_url STRING, status STRING, error_message STRING, duration_seconds DOUBLE,
data_points_extracted INT, quality_score DOUBLE, user_ip STRING, user_agent STRING,
`timestamp` TIMESTAMP
"""
INDUSTRY_LEADERS = "industry STRING, top_brands ARRAY<STRING>, last_updated TIMESTAMP"
COMPETITORS = (
    "brand_name STRING, domain STRING, industry STRING, competitor_domains ARRAY<STRING>,"
    " last_updated TIMESTAMP"
)

PAGE_ANCHOR = (
    "STRUCT<idx: INT, href: STRING, text: STRING, first_text: STRING, title: STRING,"
    " aria_label: STRING, img_src: STRING, parent_price: STRING, inner_price: STRING,"
    " in_footer: BOOLEAN, in_header_nav: BOOLEAN>"
)
PAGE_REGION = "STRUCT<start: INT, stop: INT, box: INT>"
FAQ_CANDIDATE = "STRUCT<pattern: INT, pos: INT, question: STRING, answer: STRING>"
PAGE_FACTS = {
    "title": "STRING",
    "og_site_name": "STRING",
    "logo_alt": "STRING",
    "main_text": "STRING",
    "main_text_raw": "STRING",
    "main_text_direct": "STRING",
    "address": "STRING",
    "anchors": f"ARRAY<{PAGE_ANCHOR}>",
    "link_regions": f"ARRAY<{PAGE_REGION}>",
    "jsonld": "ARRAY<STRING>",
    "faq_candidates": f"ARRAY<{FAQ_CANDIDATE}>",
    "faq_items": f"ARRAY<{FAQ_CANDIDATE}>",
}
