"""Competitors of many brands at once: find, cache, report, compare."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import rules
from ..functions import industry, lists, urls
from ..functions.arrays import let, size0
from ..functions.text import blank_to_null
from ..operators import bucketed
from ..operators.joins import lookup_join
from ..operators.keyed import top_n
from ..operators.leaders import lookup_leaders
from ..sources.landed import search_candidates
from ..sources.workspace import remove, scratch


def _no_urls() -> Column:
    return F.array().cast("array<string>")


def _as_urls(hosts: Column) -> Column:
    return F.transform(
        hosts, lambda h: F.when(h.contains("://"), h).otherwise(F.concat(F.lit("https://"), h))
    )


def search_links(results: DataFrame, n: int) -> DataFrame:
    """The first `n` different usable links per brand in rank order.

    Links are made distinct and cut to the first `n` before they are gathered, so that repeated
    landings of a search cannot make a brand's list grow.
    """
    links = search_candidates(results).groupBy("brand_name", "link").agg(F.min("rank").alias("place"))
    first = top_n(links, ["brand_name"], [F.col("place"), F.col("link")], n)
    gathered = first.groupBy("brand_name").agg(
        F.array_sort(F.collect_list(F.struct("rank", "link"))).alias("_found")
    )
    return gathered.select("brand_name", F.transform("_found", lambda r: r["link"]).alias("search_urls"))


def with_cached(brands: DataFrame, cache: DataFrame) -> DataFrame:
    """Add the cached competitor hosts of each brand's domain."""
    cached = cache.groupBy("domain").agg(
        F.max_by("competitor_domains", "last_updated").alias("cached_domains")
    )
    return lookup_join(brands, cached, ["domain"], "left")


def fresh_competitors(
    brands: DataFrame, leaders: DataFrame, results: DataFrame | None = None, max_results: int = rules.COMPETITORS_DEFAULT
) -> DataFrame:
    """Add `competitor_urls` from a search: industry leaders come first, then search results where leaders alone do not fill
    the list; each URL counts once."""
    found = lookup_leaders(brands, leaders).withColumn("_leaders", _as_urls(F.col("leaders"))).drop("leaders")
    if results is not None:
        # Links may repeat leaders, of which there are fewer than `max_results`.
        found = lookup_join(found, search_links(results, 2 * max_results), ["brand_name"], "left")
    else:
        found = found.withColumn("search_urls", F.lit(None).cast("array<string>"))
    more = F.when(F.size("_leaders") < max_results, F.coalesce("search_urls", _no_urls())).otherwise(_no_urls())
    urls_ = F.filter(F.array_distinct(F.concat("_leaders", more)), lambda u: F.coalesce(u != "", F.lit(False)))
    return (
        found.withColumn("from_cache", F.lit(False))
        .withColumn("competitor_urls", F.slice(urls_, 1, max_results))
        .drop("_leaders", "search_urls")
    )


def find_competitors(
    brands: DataFrame,
    leaders: DataFrame,
    cache: DataFrame | None = None,
    results: DataFrame | None = None,
    max_results: int = rules.COMPETITORS_DEFAULT,
) -> DataFrame:
    """Add `from_cache` and `competitor_urls` to rows of (brand_name, domain, industry).

    A cached list ends the search; only brands without one are searched for. `brands` is read for both parts and should be
    narrow.
    """
    if cache is None:
        return fresh_competitors(brands, leaders, results, max_results)
    looked, hit = with_cached(brands, cache), size0(F.col("cached_domains")) > 0
    known = looked.where(hit).withColumns(
        {"from_cache": F.lit(True), "competitor_urls": F.slice(_as_urls(F.col("cached_domains")), 1, max_results)}
    )
    searched = fresh_competitors(looked.where(~hit).drop("cached_domains"), leaders, results, max_results)
    return known.drop("cached_domains").unionByName(searched)


def suggested_competitors(rows: DataFrame, max_results: int = rules.COMPETITORS_DEFAULT) -> DataFrame:
    """Add `competitor_urls` from landed suggestion texts.

    `response` is about the brand. Where it names no store, `industry_response` counts, provided
    that the brand has any `industry_keywords`.
    """
    defaults = F.when(
        size0(F.col("industry_keywords")) > 0,
        F.coalesce(lists.industry_default_urls(F.col("industry_response"), max_results), _no_urls()),
    ).otherwise(_no_urls())
    chosen = let(
        lists.competitor_urls(F.col("response")),
        lambda found: F.when(size0(found) > 0, found).otherwise(defaults),
    )
    return rows.withColumn("competitor_urls", F.slice(chosen, 1, max_results))


def cache_rows(found: DataFrame, at: Column) -> DataFrame:
    """Rows for the competitor cache, URLs reduced to hosts."""
    return found.where(
        ~F.col("from_cache") & (F.size("competitor_urls") > 0) & blank_to_null(F.col("domain")).isNotNull()
    ).select(
        "brand_name",
        "domain",
        "industry",
        F.transform("competitor_urls", urls.bare_host).alias("competitor_domains"),
        at.alias("last_updated"),
    )


def update_cache(cache: DataFrame, rows: DataFrame) -> DataFrame:
    """New state of the cache: the newest row of each domain."""
    both = cache.unionByName(rows)
    rest = [c for c in both.columns if c != "domain"]
    newest = F.max_by(F.struct(*rest), F.struct("last_updated", "brand_name"))
    return both.groupBy("domain").agg(newest.alias("_row")).select("domain", "_row.*").select(*both.columns)


def update_cache_buckets(
    spark: SparkSession, location: str, rows: DataFrame, run_id: str, buckets: int = bucketed.BUCKETS
) -> DataFrame:
    """`update_cache` into a table of buckets at `location`; the new state of the cache."""
    return bucketed.merge(spark, location, rows, run_id, "domain", update_cache, buckets)


def mini_rows(stores: DataFrame) -> DataFrame:
    """What a report says about one competitor."""
    return stores.select(
        "website_url",
        "brand_name",
        "total_products",
        (size0(F.col("faqs")) > 0).alias("has_faqs"),
        size0(F.col("social_handles")).alias("social_platforms"),
    )


def main_rows(stores: DataFrame) -> DataFrame:
    """What a search for competitors and a report need of the main brands."""
    catalog = F.col("product_catalog")
    main = stores.select(
        F.col("website_url").alias("main_brand_url"),
        F.coalesce("brand_name", F.lit("")).alias("main_brand_name"),
        industry.product_types(catalog).alias("industry_keywords"),
        industry.of_keywords(industry.keywords(catalog)).alias("industry"),
        urls.netloc(F.col("website_url")).alias("domain"),
        "total_products",
    )
    return main.withColumn("brand_name", F.coalesce(blank_to_null(F.col("main_brand_name")), "domain"))


def report(
    stores: DataFrame,
    leaders: DataFrame,
    known: DataFrame,
    run_ts: Column,
    cache: DataFrame | None = None,
    results: DataFrame | None = None,
    max_competitors: int = rules.COMPETITORS_DEFAULT,
    reported: int | None = None,
) -> DataFrame:
    """One competitor analysis per store, with up to `max_competitors` URLs and the records of the first `reported` of
    them (all by default).

    `stores` are the main brands, `known` the records that competitors are looked up in (often
    the same table).
    """
    found = find_competitors(main_rows(stores), leaders, cache, results, max_competitors)
    return reports_of(found, known, run_ts, max_competitors, reported)


def reports_of(
    found: DataFrame, known: DataFrame, run_ts: Column, max_competitors: int = rules.COMPETITORS_DEFAULT, reported: int | None = None
) -> DataFrame:
    """The analyses of main brands whose competitors are found.

    A URL that very many brands name is one hot key on the brand side of a many-to-one join, which the adaptive skew join
    splits; the rows go on to another grouping.
    """
    others = F.filter(
        "competitor_urls", lambda u: urls.canonical(u) != F.col("main_brand_url")
    )
    kept = ["main_brand_name", "competitor_urls", "industry_keywords", "total_products"]
    shown = F.slice("competitor_urls", 1, reported) if reported else F.col("competitor_urls")
    looked_up = (
        found.withColumn("competitor_urls", F.slice(others, 1, max_competitors))
        .select(
            "main_brand_url",
            F.struct(*kept).alias("main"),
            F.posexplode_outer(shown).alias("pos", "competitor_url"),
        )
        .withColumn("_key", urls.canonical(F.col("competitor_url")))
    )
    facts = mini_rows(known).select(F.col("website_url").alias("_key"), F.struct("*").alias("other"))
    competitor = F.struct(
        F.col("competitor_url").alias("website_url"),
        *[F.col(f"other.{n}").alias(n) for n in ("brand_name", "total_products", "has_faqs", "social_platforms")],
    )
    # A row for each reported competitor of a main brand is gathered here.
    row = F.when(F.col("other").isNotNull(), F.struct("pos", competitor.alias("row")))
    gathered = lookup_join(looked_up, facts, ["_key"], "left").groupBy("main_brand_url").agg(
        F.max("main").alias("main"), F.array_sort(F.collect_list(row)).alias("_rows")
    )
    count = F.size("main.competitor_urls")
    return gathered.select(
        "main_brand_url",
        "main.main_brand_name",
        "main.total_products",
        count.alias("competitors_found"),
        "main.competitor_urls",
        F.transform("_rows", lambda r: r["row"]).alias("competitors"),
        F.format_string("Found %d competitors", count).alias("analysis_summary"),
        run_ts.alias("analysis_timestamp"),
        "main.industry_keywords",
    )


def analyses_to_save(reports: DataFrame) -> DataFrame:
    """Rows for the append-only analysis table: only brands with any competitor."""
    return reports.where(F.size("competitor_urls") > 0).select(
        "main_brand_url", "main_brand_name", "competitors", "analysis_summary", "analysis_timestamp",
        "industry_keywords", F.col("analysis_timestamp").alias("created_at"),
    )


def pipeline(
    spark: SparkSession,
    location: str,
    stores: DataFrame,
    leaders: DataFrame,
    known: DataFrame,
    run_ts: Column,
    run_id: str,
    results: DataFrame | None = None,
    max_competitors: int = rules.COMPETITORS_DEFAULT,
    buckets: int = bucketed.BUCKETS,
) -> DataFrame:
    """A run of the whole competitor job on extracted records; returns the analyses that it has saved.

    Main brands with a list in the cache at `location`/competitors take it, leaders and search results are looked up for the
    others only. Their analyses are the run's part of `location`/competitor_analyses, and what was searched for goes into the
    cache. Each step is computed once, from what the step before wrote. A repeated run sees the cache as it was before the
    run and replaces its own part, so that it leaves the same.
    """
    cache_at, work = f"{location}/competitors", scratch(spark, "competitors")

    def once(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{work}/{name}")
        return spark.read.schema(df.schema).parquet(f"{work}/{name}")

    main = once(main_rows(stores), "main")
    found = once(find_competitors(main, leaders, bucketed.read_before(spark, cache_at, run_id), results, max_competitors), "found")
    rows = analyses_to_save(reports_of(found, known, run_ts, max_competitors)).withColumn("run_id", F.lit(run_id))
    saved_at = f"{location}/competitor_analyses"
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_id").parquet(saved_at)
    update_cache_buckets(spark, cache_at, cache_rows(found, run_ts), run_id, buckets)
    remove(spark, work)
    return spark.read.schema(rows.schema).parquet(saved_at).where(F.col("run_id") == run_id)


def comparison_text(
    brand_name: Column, website_url: Column, total_products: Column, competitors: Column
) -> Column:
    """Short text about a brand and its competitors, one line each."""
    n = size0(competitors)
    lines = F.transform(
        competitors,
        lambda c: F.concat(F.lit("- "), F.coalesce(c["brand_name"], c["website_url"], F.lit("Unknown"))),
    )
    found = F.concat(F.format_string("\nFound %d Competitors\n", n), F.array_join(lines, "\n"))
    return F.concat_ws(
        "\n",
        F.concat(F.lit("Main Brand: "), F.coalesce(blank_to_null(brand_name), F.lit("Unknown"))),
        F.concat(F.lit("Website: "), website_url),
        F.concat(F.lit("Products: "), total_products.cast("string")),
        F.when(n > 0, found),
    )


def position(main: DataFrame, competitors: DataFrame, key: str = "main_brand_url") -> DataFrame:
    """Product count of each brand against the mean of its competitors.

    `main` has (key, total_products), `competitors` has (key, total_products) with a row per
    competitor. Equal counts as below; without competitors there is no position.
    """
    means = competitors.groupBy(key).agg(F.avg("total_products").alias("average_competitors"))
    above = F.col("total_products") > F.col("average_competitors")
    return main.join(means, key, "left").select(
        key,
        "total_products",
        "average_competitors",
        F.when(F.col("average_competitors").isNull(), None)
        .when(above, F.lit("above average"))
        .otherwise(F.lit("below average"))
        .alias("position"),
    )
