"""Queries over the table of store records and the run history."""

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scoring
from ..operators import stores
from ..sources.workspace import scratch
from . import roles
from .sqltext import LATEST, RUNS

_SPLIT = "2024-01-16 00:00:00"
_RUN_TS = "2024-02-01 00:00:00"


def upsert_latest(spark: SparkSession, d: str) -> DataFrame:
    runs = roles.runs(spark, d).select(
        "website_url", "event_id", "extraction_timestamp", "extraction_success", "quality_score"
    )
    early, late = F.col("extraction_timestamp") < F.lit(_SPLIT).cast("timestamp_ntz"), F.lit(_RUN_TS).cast("timestamp_ntz")
    order = ["extraction_timestamp", "event_id"]
    none = runs.limit(0).withColumn("created_at", late).withColumn("updated_at", late)
    existing = stores.upsert(none, runs.where(early), F.lit(_SPLIT).cast("timestamp_ntz"), order=order)
    merged = stores.upsert(existing, runs.where(~early), late, order=order)
    return merged.select(
        "website_url", "event_id", "extraction_timestamp", "extraction_success", "quality_score",
        "created_at", "updated_at",
    )


UPSERT_LATEST = f"""
WITH {RUNS}, {LATEST}, spans AS (
  SELECT website_url, min(extraction_timestamp) AS first_ts, max(extraction_timestamp) AS last_ts
  FROM runs GROUP BY website_url
)
SELECT l.website_url, l.event_id, l.extraction_timestamp, l.extraction_success, l.quality_score,
  CASE WHEN s.first_ts < TIMESTAMP '{_SPLIT}' THEN TIMESTAMP '{_SPLIT}' ELSE TIMESTAMP '{_RUN_TS}' END AS created_at,
  CASE WHEN s.last_ts >= TIMESTAMP '{_SPLIT}' THEN TIMESTAMP '{_RUN_TS}' ELSE TIMESTAMP '{_SPLIT}' END AS updated_at
FROM latest l JOIN spans s ON l.website_url = s.website_url
"""


def upsert_buckets(spark: SparkSession, d: str) -> DataFrame:
    """The same by a table of buckets that each run changes in place; the second run is repeated."""
    runs = roles.runs(spark, d).select(
        "website_url", "event_id", "extraction_timestamp", "extraction_success", "quality_score"
    )
    early, order = F.col("extraction_timestamp") < F.lit(_SPLIT).cast("timestamp_ntz"), ["extraction_timestamp", "event_id"]
    location = scratch(spark, "stores")
    for rows, at in ((runs.where(early), _SPLIT), (runs.where(~early), _RUN_TS), (runs.where(~early), _RUN_TS)):
        state = stores.upsert_buckets(spark, location, rows, F.lit(at).cast("timestamp_ntz"), at, order=order, buckets=8)
    return state.select(
        "website_url", "event_id", "extraction_timestamp", "extraction_success", "quality_score", "created_at", "updated_at"
    )


def append_once(spark: SparkSession, d: str) -> DataFrame:
    """The run log as three jobs append it by kind of result; the first is repeated, and one ran before with fewer rows."""
    log = stores.run_log(roles.runs(spark, d), F.col("extraction_timestamp").cast("timestamp"))
    location = scratch(spark, "logs")
    prefix = f"t{location.rpartition('-')[2]}_"
    stores.create_tables(spark, location, prefix)
    failed, name = F.col("status") == "failed", f"{prefix}extraction_logs"
    for rows, run in ((failed, "failed"), (~failed & (F.col("quality_score") > 50), "good"), (~failed, "good"), (failed, "failed")):
        stores.append(log.where(rows), name, run)
    added = spark.read.schema(spark.table(name).schema).parquet(f"{location}/extraction_logs")
    for table in ("competitor_analyses", "extraction_logs", "industry_leaders", "competitors"):
        spark.sql(f"DROP TABLE {prefix}{table}")  # the files stay
    return added.select("run_id", "website_url", "status", "error_message", "duration_seconds", "quality_score", F.col("timestamp").cast("timestamp_ntz").alias("timestamp"))


APPEND_ONCE = f"""
WITH {RUNS}
SELECT CASE WHEN extraction_success THEN 'good' ELSE 'failed' END AS run_id, website_url,
  CASE WHEN extraction_success THEN 'success' ELSE 'failed' END AS status, error_message,
  extraction_duration_seconds AS duration_seconds, quality_score, extraction_timestamp AS timestamp
FROM runs
"""


def run_log(spark: SparkSession, d: str) -> DataFrame:
    log = stores.run_log(roles.runs(spark, d), F.col("extraction_timestamp"))
    return log.select("website_url", "status", "error_message", "duration_seconds", "quality_score", "timestamp")


RUN_LOG = f"""
WITH {RUNS}
SELECT website_url, CASE WHEN extraction_success THEN 'success' ELSE 'failed' END AS status, error_message,
  extraction_duration_seconds AS duration_seconds, quality_score, extraction_timestamp AS timestamp
FROM runs
"""

_SHOWN = ["website_url", "extraction_timestamp", "extraction_success", "quality_score"]


def lookup_store(spark: SparkSession, d: str) -> DataFrame:
    return stores.lookup(roles.latest_runs(spark, d), "Store-8.example.com").select(*_SHOWN)


LOOKUP_STORE = f"""
WITH {RUNS}, {LATEST} SELECT {', '.join(_SHOWN)} FROM latest WHERE website_url = 'https://store-8.example.com/'
"""


def lookup_bucket(spark: SparkSession, d: str) -> DataFrame:
    """The same in a table of buckets, of which one is read."""
    location = scratch(spark, "stores")
    stores.upsert_buckets(spark, location, roles.latest_runs(spark, d), F.col("extraction_timestamp"), "1", buckets=8)
    return stores.lookup_bucket(spark, location, "Store-8.example.com").select(*_SHOWN)


def search_stores(spark: SparkSession, d: str) -> DataFrame:
    found = stores.search(
        roles.named_stores(spark, d),
        brand_name="CUSTOMER#0000000_",
        country="NATION_1",
        min_quality_score=5.0,
        start_date=dt.datetime(2024, 1, 5),
        end_date=dt.datetime(2024, 1, 31),
    )
    return found.select("brand_name", "country", *_SHOWN)


def search_stores_any(spark: SparkSession, d: str) -> DataFrame:
    """No condition set: a score of zero counts as not given."""
    found = stores.search(roles.named_stores(spark, d), min_quality_score=0.0, limit=25)
    return found.select("brand_name", "country", *_SHOWN)


_NAMED = """
named AS (
  SELECT l.*, c.c_name AS brand_name, n.n_name AS country FROM latest l
  LEFT JOIN customer c ON c.c_custkey = l.user_id LEFT JOIN nation n ON n.n_nationkey = c.c_nationkey
)
"""
SEARCH_STORES = f"""
WITH {RUNS}, {LATEST}, {_NAMED}
SELECT brand_name, country, {', '.join(_SHOWN)} FROM named
WHERE brand_name ILIKE '%CUSTOMER#0000000_%' AND country = 'NATION_1' AND quality_score >= 5.0
  AND extraction_timestamp BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-31'
ORDER BY extraction_timestamp DESC, website_url LIMIT 20
"""
SEARCH_STORES_ANY = f"""
WITH {RUNS}, {LATEST}, {_NAMED}
SELECT brand_name, country, {', '.join(_SHOWN)} FROM named ORDER BY extraction_timestamp DESC, website_url LIMIT 25
"""


def recent_stores(spark: SparkSession, d: str) -> DataFrame:
    return stores.recent(roles.latest_runs(spark, d)).select(*_SHOWN)


RECENT_STORES = f"""
WITH {RUNS}, {LATEST} SELECT {', '.join(_SHOWN)} FROM latest ORDER BY extraction_timestamp DESC, website_url LIMIT 10
"""


def run_statistics(spark: SparkSession, d: str) -> DataFrame:
    runs = roles.runs(spark, d)
    newest = runs.agg(F.max("extraction_timestamp").alias("as_of")).scalar()
    return stores.statistics(runs, newest)


RUN_STATISTICS = f"""
WITH {RUNS}
SELECT count(*) AS total_extractions, count(*) FILTER (WHERE extraction_success) AS successful_extractions,
  count(*) FILTER (WHERE extraction_success) * 100.0::DOUBLE / count(*) AS success_rate,
  round(avg(quality_score), 2) AS average_quality_score,
  round(avg(extraction_duration_seconds), 2) AS average_extraction_time_seconds,
  count(*) FILTER (WHERE extraction_timestamp >= (SELECT max(ts) FROM events) - INTERVAL 1 DAY) AS extractions_last_24h
FROM runs
"""


def top_countries(spark: SparkSession, d: str) -> DataFrame:
    nations = roles.table(spark, d, "nation").where("n_regionkey <> 1").select(
        F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("country")
    )
    counted = roles.table(spark, d, "customer").select("c_nationkey").join(nations, "c_nationkey", "left")
    return stores.top_countries(counted)


TOP_COUNTRIES = """
SELECT n_name AS country, count(*) AS count FROM customer
LEFT JOIN (SELECT * FROM nation WHERE n_regionkey <> 1) ON n_nationkey = c_nationkey
GROUP BY n_name ORDER BY count DESC, country NULLS LAST LIMIT 5
"""


def quality_score(spark: SparkSession, d: str) -> DataFrame:
    """Event counts per user stand in for the facts of a store."""

    def n(kind: str):
        return F.count_if(F.col("event_type") == kind)

    counts = roles.table(spark, d, "events").groupBy("user_id").agg(
        n("view").alias("products"),
        n("click").alias("heroes"),
        F.least(n("error"), F.lit(4)).alias("policies"),
        n("signup").alias("faqs"),
        n("purchase").alias("socials"),
        F.max("value").alias("top"),
        F.min("value").alias("low"),
    )
    score = scoring.score_from_counts(
        F.col("products"), F.col("heroes"), F.col("policies"), F.col("faqs"), F.col("top") > 60,
        F.col("socials"), F.col("low") > 0.05, F.col("top") > 90, F.col("faqs"),
    )
    return counts.select("user_id", score.alias("quality_score"))


QUALITY_SCORE = """
WITH counts AS (
  SELECT user_id, count(*) FILTER (WHERE event_type = 'view') AS products,
    count(*) FILTER (WHERE event_type = 'click') AS heroes,
    least(count(*) FILTER (WHERE event_type = 'error'), 4) AS policies,
    count(*) FILTER (WHERE event_type = 'signup') AS faqs,
    count(*) FILTER (WHERE event_type = 'purchase') AS socials, max(value) AS top, min(value) AS low
  FROM events GROUP BY user_id
)
SELECT user_id, CAST(least(20, products * 0.5) + least(10, heroes * 2) + policies * 5 + least(10, faqs)
  + CASE WHEN top > 60 THEN 10 ELSE 0 END + least(10, socials * 2) + CASE WHEN low > 0.05 THEN 5 ELSE 0 END
  + CASE WHEN top > 90 THEN 5 ELSE 0 END + least(10, faqs) AS DOUBLE) AS quality_score
FROM counts
"""

QUERIES = {
    "upsert_latest": (upsert_latest, UPSERT_LATEST),
    "upsert_buckets": (upsert_buckets, UPSERT_LATEST),
    "append_once": (append_once, APPEND_ONCE),
    "run_log": (run_log, RUN_LOG),
    "lookup_store": (lookup_store, LOOKUP_STORE),
    "lookup_bucket": (lookup_bucket, LOOKUP_STORE),
    "search_stores": (search_stores, SEARCH_STORES),
    "search_stores_any": (search_stores_any, SEARCH_STORES_ANY),
    "recent_stores": (recent_stores, RECENT_STORES),
    "run_statistics": (run_statistics, RUN_STATISTICS),
    "top_countries": (top_countries, TOP_COUNTRIES),
    "quality_score": (quality_score, QUALITY_SCORE),
}
