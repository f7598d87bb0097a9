"""Landed inputs: pages and product feeds that a crawler has written, and search results."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import rules, schemas
from ..functions import urls


def read_store_pages(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.STORE_PAGES).parquet(path)


def read_product_feed(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.PRODUCT_FEED).parquet(path)


def read_feed_landings(spark: SparkSession, path: str) -> DataFrame:
    """Feed pages with the time of their landing, of which the newest counts; it is null in files that do not have it."""
    return spark.read.schema(schemas.FEED_LANDINGS).parquet(path)


def read_search_results(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.SEARCH_RESULTS).parquet(path)


def ok_pages(pages: DataFrame) -> DataFrame:
    return pages.where(F.col("status") == 200)


def search_candidates(results: DataFrame, limits: rules.Limits = rules.KEEP_ALL) -> DataFrame:
    """Usable links among the results of each search."""
    if limits.search_results is not None:
        results = results.where(F.col("rank") <= limits.search_results)
    return results.where(urls.is_competitor_candidate(F.col("link"), rules.EXCLUDED_COMPETITOR_SITES))
