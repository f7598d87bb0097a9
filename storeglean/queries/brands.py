"""Queries that find, cache, report and compare competitors."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import rules
from ..functions import urls
from ..operators import bucketed, leaders
from ..plans import competitors, extraction
from ..sources.workspace import scratch
from . import roles
from .sqltext import ladder, q, words_in


def _now():
    return F.lit("2024-02-01 00:00:00").cast("timestamp")


_LEADER_ROWS = ", ".join(
    f"({q(name)}, [{', '.join(q(b) for b in sites)}])" for name, sites in rules.INDUSTRY_LEADERS.items()
)
_FALLBACK = "CASE " + " ".join(
    f"WHEN {words_in('lower(industry)', words)} THEN [{', '.join(q(s) for s in sites)}]"
    for words, sites in rules.FALLBACK_LEADERS
) + " ELSE CAST([] AS VARCHAR[]) END"
_LEADERS = f"""
leaders AS (SELECT * FROM (VALUES {_LEADER_ROWS}) t(name, sites)),
led AS (
  SELECT b.*, CASE WHEN b.industry IS NULL OR b.industry = '' THEN CAST([] AS VARCHAR[]) ELSE coalesce(
      (SELECT sites FROM leaders l WHERE l.name = lower(b.industry)),
      (SELECT arg_min(sites, name) FROM leaders l WHERE l.name LIKE '%' || split_part(lower(b.industry), ' ', 1) || '%'),
      {_FALLBACK}) END AS sites
  FROM brands b
)
"""


def industry_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Leaders for each part by an industry text made from its type."""
    kinds = {"ECONOMY": "Home", "STANDARD": "sports shoes", "LARGE": "cosmetics", "MEDIUM": "skincare goods", "SMALL": "jewel case"}
    industry = None
    for kind, name in kinds.items():
        hit = F.col("p_type") == kind
        industry = F.when(hit, F.lit(name)) if industry is None else industry.when(hit, F.lit(name))
    parts = roles.table(spark, d, "part").select("p_partkey", industry.otherwise(F.lit("toys")).alias("industry"))
    found = leaders.lookup_leaders(parts, leaders.seed_leaders(spark))
    return found.select("p_partkey", "industry", F.array_join("leaders", ",").alias("leaders"))


INDUSTRY_LOOKUP = f"""
WITH brands AS (
  SELECT p_partkey, CASE p_type WHEN 'ECONOMY' THEN 'Home' WHEN 'STANDARD' THEN 'sports shoes' WHEN 'LARGE' THEN 'cosmetics'
    WHEN 'MEDIUM' THEN 'skincare goods' WHEN 'SMALL' THEN 'jewel case' ELSE 'toys' END AS industry
  FROM part
), {_LEADERS}
SELECT p_partkey, industry, array_to_string(sites, ',') AS leaders FROM led
"""


def competitor_rank(spark: SparkSession, d: str) -> DataFrame:
    brands = roles.brands(spark, d)
    cache = brands.where("s_acctbal < 0").select(
        "brand_name", "domain", "industry",
        F.array(F.concat(F.lit("a."), "domain"), F.lit("b.example.com")).alias("competitor_domains"),
        _now().alias("last_updated"),
    )
    found = competitors.find_competitors(
        brands, leaders.seed_leaders(spark), cache, roles.search_results(spark, d), max_results=8
    )
    return found.select(
        "brand_name", "from_cache", F.posexplode("competitor_urls").alias("pos", "competitor_url")
    )


_BRANDS = f"""
brands AS (
  SELECT s_suppkey, s_name AS brand_name, 'shop-' || s_suppkey || '.example.com' AS domain, s_acctbal,
    [{', '.join(q(i) for i in roles.INDUSTRIES)}][s_suppkey % {len(roles.INDUSTRIES)} + 1] AS industry
  FROM supplier
)
"""
_RESULTS = f"""
results AS (
  SELECT p_partkey // {roles.BLOCK} AS s_suppkey, p_partkey % {roles.BLOCK} + 1 AS rank,
    CASE WHEN p_size < 4 THEN 'https://shop-' || (p_partkey // {roles.BLOCK}) || '.example.com'
      ELSE 'https://' || replace(replace(p_name, ' ', '-'), 'red', 'reddit') || '.shop.net/' END AS link
  FROM part
), usable AS (
  SELECT * FROM results WHERE NOT {words_in('lower(link)', rules.EXCLUDED_COMPETITOR_SITES)}
)
"""


def _ranked(limit: int, extra: str = "") -> str:
    """Leaders first, then search results where leaders do not fill the list; each URL once."""
    return f"""
candidates AS (
  SELECT s_suppkey, 'https://' || unnest(sites) AS u, generate_subscripts(sites, 1) AS k FROM led
  UNION ALL
  SELECT l.s_suppkey, r.link AS u, 100 + r.rank AS k FROM led l JOIN usable r ON l.s_suppkey = r.s_suppkey
  WHERE len(l.sites) < {limit}
), firsts AS (SELECT s_suppkey, u, min(k) AS k FROM candidates GROUP BY s_suppkey, u
), ranked AS (
  SELECT s_suppkey, u, row_number() OVER (PARTITION BY s_suppkey ORDER BY k) AS place FROM firsts
), fresh AS (SELECT s_suppkey, u, place - 1 AS pos FROM ranked WHERE place <= {limit})
"""


COMPETITOR_RANK = f"""
WITH {_BRANDS}, {_LEADERS}, {_RESULTS}, {_ranked(8)}
SELECT l.brand_name, false AS from_cache, f.pos, f.u AS competitor_url
FROM fresh f JOIN led l ON f.s_suppkey = l.s_suppkey WHERE l.s_acctbal >= 0
UNION ALL
SELECT brand_name, true, 0, 'https://a.' || domain FROM led WHERE s_acctbal < 0
UNION ALL
SELECT brand_name, true, 1, 'https://b.example.com' FROM led WHERE s_acctbal < 0
"""


def suggested_competitors(spark: SparkSession, d: str) -> DataFrame:
    """Pages as suggestion texts: some name stores, some do not, some brands have no keywords."""
    site = F.regexp_extract(F.replace("url", F.lit("example"), F.lit("shopsite")), "^[a-z]+://[^/?#]*", 0)
    english, french = F.col("url").contains("/en/"), F.col("url").contains("/fr/")
    rows = roles.table(spark, d, "pages").select(
        "page_id",
        F.when(english, F.to_json(F.array(site, F.lit("https://b.org/")))).otherwise(F.lit("None known.")).alias("response"),
        F.concat(F.lit("Look at "), site, F.lit(", https://c.org, https://d.org.")).alias("industry_response"),
        F.when(french, F.array(F.lit("home"))).otherwise(F.array().cast("array<string>")).alias("industry_keywords"),
    )
    found = competitors.suggested_competitors(rows, 2)
    return found.select("page_id", F.array_join("competitor_urls", " ").alias("competitor_urls"))


SUGGESTED_COMPETITORS = """
SELECT page_id, CASE WHEN contains(url, '/en/') THEN site || ' https://b.org'
  WHEN contains(url, '/fr/') THEN site || ' https://c.org' ELSE '' END AS competitor_urls
FROM (SELECT *, regexp_extract(replace(url, 'example', 'shopsite'), '^[a-z]+://[^/?#]*') AS site FROM pages)
"""


def _page_cache(spark: SparkSession, d: str) -> DataFrame:
    """Each page as a cache row of its host, the later page being the newer row."""
    host = urls.host(F.col("url"))
    return roles.table(spark, d, "pages").select(
        urls.brand_from_url(F.col("url")).alias("brand_name"),
        host.alias("domain"),
        F.when(F.col("url").contains("/en/"), F.lit("home")).alias("industry"),
        F.array(F.concat(F.lit("c"), F.col("page_id").cast("string"), F.lit(".com")), F.lit("d.com")).alias("competitor_domains"),
        F.timestamp_seconds("page_id").alias("last_updated"),
    )


def cache_lookup(spark: SparkSession, d: str) -> DataFrame:
    cache = _page_cache(spark, d)
    brands = cache.select("domain").distinct()
    found = competitors.with_cached(brands, cache.where("industry = 'home'"))
    return found.select("domain", F.array_join("cached_domains", ",").alias("cached"))


CACHE_LOOKUP = """
SELECT regexp_extract(url, '://([^/?#]*)', 1) AS domain,
  'c' || max(page_id) FILTER (WHERE contains(url, '/en/')) || '.com,d.com' AS cached
FROM pages GROUP BY 1
"""


def cache_upsert(spark: SparkSession, d: str) -> DataFrame:
    rows = _page_cache(spark, d)
    none = rows.limit(0)
    old = competitors.update_cache(none, rows.where("industry = 'home'"))
    found = rows.where("industry IS NULL").select(
        "brand_name", "domain", "industry", F.lit(False).alias("from_cache"), "last_updated",
        F.transform("competitor_domains", lambda h: F.concat(F.lit("https://"), h, F.lit("/x"))).alias("competitor_urls"),
    )
    merged = competitors.update_cache(old, competitors.cache_rows(found, F.col("last_updated")))
    return merged.select(
        "domain", "brand_name", "industry", F.array_join("competitor_domains", ",").alias("competitor_domains")
    )


def cache_buckets(spark: SparkSession, d: str) -> DataFrame:
    """The same by a cache of buckets that each run changes in place; the first run is repeated."""
    rows, location = _page_cache(spark, d), scratch(spark, "cache")
    known = F.col("industry") == "home"
    for some, run in ((rows.where(known), "1"), (rows.where("industry IS NULL"), "2"), (rows.where(known), "1")):
        cache = competitors.update_cache_buckets(spark, location, some, run, buckets=8)
    return cache.select(
        "domain", "brand_name", "industry", F.array_join("competitor_domains", ",").alias("competitor_domains")
    )


CACHE_UPSERT = """
WITH rows AS (
  SELECT page_id, regexp_extract(url, '://([^/?#]*)', 1) AS domain,
    split_part(replace(regexp_extract(url, '://([^/?#]*)', 1), 'www.', ''), '.', 1) AS label,
    CASE WHEN contains(url, '/en/') THEN 'home' END AS industry
  FROM pages
)
SELECT domain, upper(left(label, 1)) || lower(substr(label, 2)) AS brand_name, industry,
  'c' || page_id || '.com,d.com' AS competitor_domains
FROM rows QUALIFY row_number() OVER (PARTITION BY domain ORDER BY page_id DESC) = 1
"""


def _reports(spark: SparkSession, d: str) -> DataFrame:
    return competitors.report(
        roles.catalog_stores(spark, d),
        leaders.seed_leaders(spark),
        roles.leader_records(spark, d),
        _now(),
        results=roles.search_results(spark, d),
        max_competitors=8,
    )


def competitor_report(spark: SparkSession, d: str) -> DataFrame:
    first = F.get("competitors", F.lit(0))
    return _reports(spark, d).select(
        "main_brand_url",
        "main_brand_name",
        "competitors_found",
        F.array_join("competitor_urls", " ").alias("competitor_urls"),
        F.size("competitors").alias("reported"),
        first["website_url"].alias("first_url"),
        first["brand_name"].alias("first_name"),
        first["total_products"].alias("first_products"),
        first["has_faqs"].alias("first_has_faqs"),
        first["social_platforms"].alias("first_platforms"),
        "analysis_summary",
        F.array_join("industry_keywords", ",").alias("industry_keywords"),
    )


_LOOKED = f"""
others AS (
  SELECT f.s_suppkey, f.u, row_number() OVER (PARTITION BY f.s_suppkey ORDER BY f.pos) - 1 AS pos
  FROM fresh f JOIN brands b ON f.s_suppkey = b.s_suppkey WHERE f.u <> b.base
), sites AS (
  SELECT [{', '.join(q(s) for s in roles.LEADER_SITES)}][p_partkey % {len(roles.LEADER_SITES)} + 1] AS site,
    count(*) AS n, max(p_size) AS top
  FROM part GROUP BY 1
), known AS (
  SELECT 'https://' || site AS u, upper(site) AS name, CAST(n AS INT) AS total, top > 49 AS has_faqs,
    CAST(n % 4 AS INT) AS platforms
  FROM sites
), looked AS (
  SELECT o.s_suppkey, o.pos, k.* FROM others o JOIN known k ON o.u = k.u

"""
_TYPE = "CASE p_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in roles.TYPE_NAMES.items()) + " ELSE '' END"
_REPORT = f"""
kinds AS (
  SELECT p_partkey // {roles.BLOCK} AS s_suppkey, lower({_TYPE}) AS kind,
    row_number() OVER (PARTITION BY p_partkey // {roles.BLOCK} ORDER BY min(p_partkey)) AS k
  FROM part WHERE {_TYPE} <> '' GROUP BY p_partkey // {roles.BLOCK}, lower({_TYPE})
), types AS (
  SELECT s_suppkey, string_agg(kind, ',' ORDER BY k) AS saved,
    string_agg(kind, ' ' ORDER BY k) AS words
  FROM kinds GROUP BY s_suppkey
), brands AS (
  SELECT s.s_suppkey, s_name AS brand_name, 'https://shop-' || s.s_suppkey || '.example.com' AS base,
    {ladder('words', rules.INDUSTRY_FROM_KEYWORDS)} AS industry, coalesce(saved, '') AS saved
  FROM supplier s LEFT JOIN types t ON s.s_suppkey = t.s_suppkey
), {_LEADERS}, {_RESULTS}, {_ranked(8)}, {_LOOKED}), firsts_known AS (
  SELECT * FROM looked QUALIFY row_number() OVER (PARTITION BY s_suppkey ORDER BY pos) = 1
), report AS (
  SELECT b.s_suppkey, b.base, b.brand_name, b.saved,
    (SELECT count(*) FROM part p WHERE p.p_partkey // {roles.BLOCK} = b.s_suppkey) AS total,
    (SELECT count(*) FROM others o WHERE o.s_suppkey = b.s_suppkey) AS found,
    coalesce((SELECT string_agg(u, ' ' ORDER BY pos) FROM others o WHERE o.s_suppkey = b.s_suppkey), '') AS urls,
    (SELECT count(*) FROM looked k WHERE k.s_suppkey = b.s_suppkey) AS reported,
    coalesce((SELECT string_agg('- ' || name, chr(10) ORDER BY pos) FROM looked k WHERE k.s_suppkey = b.s_suppkey), '') AS lines
  FROM brands b
)
"""
COMPETITOR_REPORT = f"""
WITH {_REPORT}
SELECT r.base || '/' AS main_brand_url, r.brand_name AS main_brand_name, CAST(found AS INT) AS competitors_found,
  urls AS competitor_urls, CAST(reported AS INT) AS reported, f.u AS first_url, f.name AS first_name,
  f.total AS first_products, f.has_faqs AS first_has_faqs, f.platforms AS first_platforms,
  'Found ' || found || ' competitors' AS analysis_summary, saved AS industry_keywords
FROM report r LEFT JOIN firsts_known f ON r.s_suppkey = f.s_suppkey
"""


def comparison_text(spark: SparkSession, d: str) -> DataFrame:
    reports = _reports(spark, d)
    text = competitors.comparison_text(
        F.col("main_brand_name"), F.col("main_brand_url"), F.col("total_products"), F.col("competitors")
    )
    return reports.select("main_brand_url", text.alias("comparison"))


COMPARISON_TEXT = f"""
WITH {_REPORT}
SELECT base || '/' AS main_brand_url, 'Main Brand: ' || brand_name || chr(10) || 'Website: ' || base || '/' || chr(10)
  || 'Products: ' || total || CASE WHEN reported > 0
    THEN chr(10) || chr(10) || 'Found ' || reported || ' Competitors' || chr(10) || lines ELSE '' END AS comparison
FROM report
"""


def analyses_saved(spark: SparkSession, d: str) -> DataFrame:
    """The rows for the analysis table: brands with a competitor."""
    saved = competitors.analyses_to_save(_reports(spark, d))
    return saved.select(
        "main_brand_url",
        "main_brand_name",
        F.array_join(F.transform("competitors", lambda c: c["website_url"]), " ").alias("reported_urls"),
        "analysis_summary",
        F.date_format("analysis_timestamp", "yyyy-MM-dd HH:mm:ss").alias("analysed"),
        (F.col("created_at") == F.col("analysis_timestamp")).alias("created_then"),
        F.array_join("industry_keywords", ",").alias("industry_keywords"),
    )


ANALYSES_SAVED = f"""
WITH {_REPORT}
SELECT base || '/' AS main_brand_url, brand_name AS main_brand_name,
  coalesce((SELECT string_agg(k.u, ' ' ORDER BY pos) FROM looked k WHERE k.s_suppkey = report.s_suppkey), '') AS reported_urls,
  'Found ' || found || ' competitors' AS analysis_summary, '2024-02-01 00:00:00' AS analysed, true AS created_then,
  saved AS industry_keywords
FROM report WHERE found > 0
"""


def competitor_pipeline(spark: SparkSession, d: str) -> DataFrame:
    """The job from landed pages to saved analyses and the cache, for a third of the stores first, then for all, then again."""
    location = scratch(spark, "competitor-job")
    feed = roles.supplier_feed(spark, d, roles.shown_type())
    extracted = extraction.extract_stores(roles.supplier_pages(spark, d), feed, _now(), roles.MARKERS)
    extraction.to_table(extraction.enrich(extracted)).write.parquet(f"{location}/stores")
    stores = spark.read.parquet(f"{location}/stores")
    third = F.regexp_extract("website_url", "shop-([0-9]+)", 1).cast("long") % 3 == 0
    for rows, run, day in ((stores.where(third), "first", 1), (stores, "second", 2), (stores, "second", 2)):
        competitors.pipeline(
            spark, location, rows, leaders.seed_leaders(spark), roles.leader_records(spark, d),
            F.lit(f"2024-02-0{day} 00:00:00").cast("timestamp"), run, roles.search_results(spark, d), 8, buckets=8,
        )
    cache = bucketed.read(spark, f"{location}/competitors").select(
        F.concat(F.lit("https://"), "domain", F.lit("/")).alias("main_brand_url"),
        F.array_join("competitor_domains", " ").alias("cached"),
        F.dayofmonth("last_updated").alias("cached_on"),
    )
    saved = spark.read.parquet(f"{location}/competitor_analyses")
    return saved.join(cache, "main_brand_url", "left").select(
        F.col("run_id").cast("string").alias("run_id"),
        "main_brand_url",
        "main_brand_name",
        F.array_join(F.transform("competitors", lambda c: c["website_url"]), " ").alias("reported_urls"),
        "analysis_summary",
        F.dayofmonth("analysis_timestamp").alias("analysed_on"),
        F.array_join("industry_keywords", ",").alias("industry_keywords"),
        "cached",
        "cached_on",
    )


COMPETITOR_PIPELINE = f"""
WITH heroes AS (
  SELECT DISTINCT p_partkey // {roles.BLOCK} AS k, p_name FROM part WHERE p_size > {roles.HERO_SIZE}
), first_parts AS (
  SELECT p_partkey // {roles.BLOCK} AS k, p_partkey, p_name, lower({_TYPE}) AS kind FROM part
  QUALIFY row_number() OVER (PARTITION BY p_partkey // {roles.BLOCK}, p_name ORDER BY p_partkey) = 1
), items AS (
  SELECT * FROM first_parts f WHERE NOT EXISTS (SELECT 1 FROM heroes h WHERE h.k = f.k AND h.p_name = f.p_name)
), kinds AS (
  SELECT k, kind, min(p_partkey) AS place FROM items WHERE kind <> '' GROUP BY k, kind
), types AS (
  SELECT k, string_agg(kind, ',' ORDER BY place) AS saved, string_agg(kind, ' ' ORDER BY place) AS words FROM kinds GROUP BY k
), texts AS (SELECT k, string_agg(p_name, ' ' ORDER BY p_partkey) AS text FROM items GROUP BY k), named AS (
  SELECT x.k, saved, coalesce(words, {ladder('text', rules.KEYWORD_FROM_NAMES)}) AS words FROM texts x LEFT JOIN types t ON x.k = t.k
), brands AS (
  SELECT s_suppkey, s_acctbal < 2000 AS low, CASE WHEN s_acctbal < 2000 THEN s_name ELSE 'Shop ' || s_suppkey END AS brand_name,
    'https://shop-' || s_suppkey || '.example.com' AS base, {ladder('words', rules.INDUSTRY_FROM_KEYWORDS)} AS industry,
    coalesce(saved, '') AS saved
  FROM supplier LEFT JOIN named ON k = s_suppkey WHERE s_nationkey <> 24
), {_LEADERS}, {_RESULTS}, {_ranked(8).replace("WHERE len(l.sites)", "WHERE l.low AND len(l.sites)")}, {_LOOKED}), report AS (
  SELECT b.*, (SELECT count(*) FROM others o WHERE o.s_suppkey = b.s_suppkey) AS found,
    coalesce((SELECT string_agg(k.u, ' ' ORDER BY pos) FROM looked k WHERE k.s_suppkey = b.s_suppkey), '') AS reported_urls,
    (SELECT string_agg(regexp_extract(u, '://([^/]*)', 1), ' ' ORDER BY pos) FROM fresh f WHERE f.s_suppkey = b.s_suppkey) AS cached
  FROM brands b
)
SELECT run_id, base || '/' AS main_brand_url, brand_name AS main_brand_name, reported_urls,
  'Found ' || found || ' competitors' AS analysis_summary, CASE run_id WHEN 'first' THEN 1 ELSE 2 END AS analysed_on,
  saved AS industry_keywords, cached, CASE WHEN s_suppkey % 3 = 0 THEN 1 ELSE 2 END AS cached_on
FROM report, (VALUES ('first'), ('second')) r(run_id) WHERE found > 0 AND (run_id = 'second' OR s_suppkey % 3 = 0)
"""


def competitive_position(spark: SparkSession, d: str) -> DataFrame:
    """Line items per supplier as product counts; the next three suppliers are competitors."""
    counts = roles.table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.count("*").alias("total_products"))
    main = counts.withColumnRenamed("l_suppkey", "main_brand_url")
    named = roles.table(spark, d, "supplier").select(
        F.col("s_suppkey").alias("main_brand_url"),
        F.explode(F.sequence(F.col("s_suppkey") + 1, F.col("s_suppkey") + 3)).alias("l_suppkey"),
    )
    return competitors.position(main, named.join(counts, "l_suppkey"))


COMPETITIVE_POSITION = """
WITH counts AS (SELECT l_suppkey AS s, count(*) AS n FROM lineitem GROUP BY l_suppkey),
means AS (
  SELECT p.s_suppkey AS s, avg(c.n) AS m FROM supplier p JOIN counts c ON c.s BETWEEN p.s_suppkey + 1 AND p.s_suppkey + 3
  GROUP BY p.s_suppkey
)
SELECT c.s AS main_brand_url, c.n AS total_products, m AS average_competitors,
  CASE WHEN m IS NULL THEN NULL WHEN c.n > m THEN 'above average' ELSE 'below average' END AS position
FROM counts c LEFT JOIN means ON c.s = means.s
"""

QUERIES = {
    "industry_lookup": (industry_lookup, INDUSTRY_LOOKUP),
    "competitor_rank": (competitor_rank, COMPETITOR_RANK),
    "suggested_competitors": (suggested_competitors, SUGGESTED_COMPETITORS),
    "cache_lookup": (cache_lookup, CACHE_LOOKUP),
    "cache_upsert": (cache_upsert, CACHE_UPSERT),
    "cache_buckets": (cache_buckets, CACHE_UPSERT),
    "competitor_report": (competitor_report, COMPETITOR_REPORT),
    "competitor_pipeline": (competitor_pipeline, COMPETITOR_PIPELINE),
    "comparison_text": (comparison_text, COMPARISON_TEXT),
    "analyses_saved": (analyses_saved, ANALYSES_SAVED),
    "competitive_position": (competitive_position, COMPETITIVE_POSITION),
}
