"""The table of store records: upsert, log, look-ups, searches, statistics, export."""

import datetime as dt
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..functions import faq, urls
from ..functions.arrays import or_empty, size0
from ..functions.scoring import policies_present
from ..functions.text import blank_to_null
from . import bucketed
from .keyed import most_recent

# ---- writing


def upsert(
    existing: DataFrame,
    incoming: DataFrame,
    run_ts: Column,
    key: str = "website_url",
    order: list[str] | None = None,
) -> DataFrame:
    """New state of the table: the incoming row of a store replaces the stored one.

    `created_at` stays that of the first row; `updated_at` becomes `run_ts` for every store
    that came in. Several incoming rows of one store count as one update with the newest.
    """
    stamped = incoming.withColumn("created_at", run_ts).withColumn("updated_at", run_ts)
    both = existing.withColumn("_new", F.lit(0)).unionByName(
        stamped.withColumn("_new", F.lit(1)), allowMissingColumns=True
    )
    rest = [c for c in both.columns if c not in (key, "_new", "created_at")]
    newest = F.max_by(F.struct(*rest), F.struct("_new", *(order or ["extraction_timestamp"])))
    return (
        both.groupBy(key)
        .agg(newest.alias("_row"), F.min("created_at").alias("created_at"))
        .select(key, "_row.*", "created_at")
    )


_APPENDED = {"competitor_analyses": schemas.COMPETITOR_ANALYSES, "extraction_logs": schemas.EXTRACTION_LOGS}
_LOOKED_UP = {"industry_leaders": schemas.INDUSTRY_LEADERS, "competitors": schemas.COMPETITORS}


def create_tables(spark: SparkSession, location: str, prefix: str = "") -> None:
    """Create the tables that are appended to or looked up, where absent; their names begin with `prefix`.

    A table that is appended to has a partition for each run, which a repetition of the run replaces as a whole.
    """
    for name, ddl in _APPENDED.items():
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {prefix}{name} ({ddl}, run_id STRING) USING parquet"
            f" OPTIONS (partitionOverwriteMode 'dynamic') PARTITIONED BY (run_id) LOCATION '{location}/{name}'"
        )
    for name, ddl in _LOOKED_UP.items():
        spark.sql(f"CREATE TABLE IF NOT EXISTS {prefix}{name} ({ddl}) USING parquet LOCATION '{location}/{name}'")


def publish(spark: SparkSession, df: DataFrame, location: str, run_id: str, name: str = "brand_insights"):
    """Write a new state of a table beside the old ones, then point the view `name` at it.

    The state being read is never overwritten, so a lost executor or a failed job leaves the
    published table as it was. Old states can be removed once nothing reads them.
    """
    path = f"{location}/{name}/run={run_id}"
    df.write.mode("errorifexists").parquet(path)
    columns = ", ".join(f"`{c}`" for c in df.columns)
    spark.sql(f"CREATE OR REPLACE VIEW {name} AS SELECT {columns} FROM parquet.`{path}`")
    return spark.table(name)


def append(df: DataFrame, table: str, run_id: str | None = None) -> None:
    """Add rows to a table of `create_tables` as those of a run. The rows that a run of that id has added before, whole or
    in part, are replaced when the job commits; without an id the run is a new one."""
    columns = df.sparkSession.table(table).columns
    marked = df.withColumn("run_id", F.lit(run_id or uuid.uuid4().hex))
    marked.select(*columns).write.mode("overwrite").insertInto(table)


def run_log(records: DataFrame, at: Column) -> DataFrame:
    """One log row per record: status, first error, duration, score."""
    return records.select(
        "website_url",
        F.when(F.col("extraction_success"), F.lit("success")).otherwise(F.lit("failed")).alias("status"),
        F.get("error_messages", F.lit(0)).alias("error_message"),
        F.col("extraction_duration_seconds").alias("duration_seconds"),
        F.lit(None).cast("int").alias("data_points_extracted"),
        "quality_score",
        F.lit(None).cast("string").alias("user_ip"),
        F.lit(None).cast("string").alias("user_agent"),
        at.alias("timestamp"),
    )


def upsert_buckets(
    spark: SparkSession, location: str, incoming: DataFrame, run_ts: Column, run_id: str,
    key: str = "website_url", order: list[str] | None = None, buckets: int = bucketed.BUCKETS,
) -> DataFrame:
    """`upsert` into a table of buckets at `location`: only buckets with an incoming store are read and written, and a run
    that is repeated changes nothing. The new state of the table."""

    def combine(stored: DataFrame, rows: DataFrame) -> DataFrame:
        times = [c for c in ("created_at", "updated_at") if c not in stored.columns]
        return upsert(stored.withColumns({c: run_ts for c in times}), rows, run_ts, key, order)

    return bucketed.merge(spark, location, incoming, run_id, key, combine, buckets)


def seconds_between(start: Column, stop: Column) -> Column:
    return (F.unix_micros(stop) - F.unix_micros(start)) / F.lit(1e6)


# ---- reading


def lookup(stores: DataFrame, url: str) -> DataFrame:
    """The record of one store; any spelling of its address finds it."""
    return stores.where(F.col("website_url") == urls.canonical(F.lit(url)))


def lookup_bucket(spark: SparkSession, location: str, url: str) -> DataFrame:
    """The record of one store in a table of buckets: one bucket is read."""
    key = spark.range(1).select(urls.canonical(F.lit(url)).alias("key")).first()["key"]
    return bucketed.lookup(spark, location, "website_url", key)


def recent(stores: DataFrame, n: int = 10) -> DataFrame:
    return most_recent(stores, "extraction_timestamp", "website_url", n)


def search(
    stores: DataFrame,
    brand_name: str | None = None,
    country: str | None = None,
    min_quality_score: float | None = None,
    start_date: dt.datetime | None = None,
    end_date: dt.datetime | None = None,
    limit: int = 20,
) -> DataFrame:
    """Newest records that meet every condition given; `%` and `_` in a name are wildcards."""
    if brand_name:
        stores = stores.where(F.col("brand_name").ilike(f"%{brand_name}%"))
    if country:
        stores = stores.where(F.col("country") == country)
    if min_quality_score:
        stores = stores.where(F.col("quality_score") >= min_quality_score)
    kind = stores.schema["extraction_timestamp"].dataType
    if start_date:
        stores = stores.where(F.col("extraction_timestamp") >= F.lit(str(start_date)).cast(kind))
    if end_date:
        stores = stores.where(F.col("extraction_timestamp") <= F.lit(str(end_date)).cast(kind))
    return most_recent(stores, "extraction_timestamp", "website_url", limit)


def statistics(stores: DataFrame, as_of: Column) -> DataFrame:
    """One row of totals in one pass; `as_of` is the end of the last 24 hours."""
    ok = F.count_if(F.col("extraction_success"))
    return stores.agg(
        F.count("*").alias("total_extractions"),
        ok.alias("successful_extractions"),
        F.coalesce(F.try_divide(ok * F.lit(100.0), F.count("*")), F.lit(0.0)).alias("success_rate"),
        F.round(F.coalesce(F.avg("quality_score"), F.lit(0.0)), 2).alias("average_quality_score"),
        F.round(F.coalesce(F.avg("extraction_duration_seconds"), F.lit(0.0)), 2).alias(
            "average_extraction_time_seconds"
        ),
        F.count_if(F.col("extraction_timestamp") >= as_of - F.expr("INTERVAL 1 DAY")).alias(
            "extractions_last_24h"
        ),
    )


def top_countries(stores: DataFrame, n: int = 5) -> DataFrame:
    """Most frequent countries; stores without one form a group."""
    return (
        stores.groupBy("country")
        .agg(F.count("*").alias("count"))
        .orderBy(F.desc("count"), F.asc_nulls_last("country"))
        .limit(n)
    )


def decode_defaults(stores: DataFrame) -> DataFrame:
    """Stored rows as documents: absent lists become empty, the context falls back."""
    contact = F.col("contact_info")
    return stores.withColumns(
        {
            "product_catalog": or_empty(F.col("product_catalog"), schemas.PRODUCT),
            "hero_products": or_empty(F.col("hero_products"), schemas.PRODUCT),
            "faqs": or_empty(F.col("faqs"), schemas.FAQ),
            "social_handles": or_empty(F.col("social_handles"), schemas.SOCIAL),
            "important_links": or_empty(F.col("important_links"), schemas.LINK),
            "error_messages": or_empty(F.col("error_messages"), "STRING"),
            "contact_info": F.struct(
                or_empty(contact["emails"], "STRING").alias("emails"),
                or_empty(contact["phone_numbers"], "STRING").alias("phone_numbers"),
                contact["address"].alias("address"),
                contact["support_hours"].alias("support_hours"),
            ),
        }
    )


def with_context(stores: DataFrame) -> DataFrame:
    text = F.coalesce(blank_to_null(F.col("brand_context")), blank_to_null(F.col("brand_description")))
    return stores.withColumn("brand_context", text)


def summary(stores: DataFrame) -> DataFrame:
    """Counts of what each record holds."""
    contact = F.col("contact_info")
    methods = (
        (size0(contact["emails"]) > 0).cast("int")
        + (size0(contact["phone_numbers"]) > 0).cast("int")
        + F.coalesce(F.length(contact["address"]) > 0, F.lit(False)).cast("int")
    )
    return stores.select(
        "brand_name",
        "website_url",
        "extraction_timestamp",
        "extraction_success",
        "quality_score",
        "total_products",
        size0(F.col("hero_products")).alias("hero_products_count"),
        size0(F.col("faqs")).alias("faqs_count"),
        size0(F.col("social_handles")).alias("social_platforms_count"),
        policies_present().alias("policies_extracted"),
        methods.alias("contact_methods"),
        "extraction_duration_seconds",
        F.col("error_messages").alias("errors"),
    )


def sections(
    stores: DataFrame,
    include_products: bool = True,
    include_policies: bool = True,
    include_faqs: bool = True,
    include_social: bool = True,
    max_products: int | None = None,
) -> DataFrame:
    """Only the wanted parts of each record; the scan reads no other columns."""
    columns = [F.col("website_url"), F.col("brand_name"), F.col("extraction_timestamp")]
    if include_products:
        catalog = F.col("product_catalog")
        catalog = F.slice(catalog, 1, max_products) if max_products else catalog
        columns += [catalog.alias("products"), F.col("hero_products")]
    if include_policies:
        names = ["privacy_policy", "return_refund_policy", "shipping_policy", "terms_of_service"]
        columns.append(F.struct(*names).alias("policies"))
    if include_faqs:
        columns.append(F.col("faqs"))
    if include_social:
        columns += [F.col("social_handles"), F.col("contact_info")]
    return stores.select(*columns)


def iso(ts: Column) -> Column:
    """ISO-8601 text; the fraction is left out when it is zero."""
    micros = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    return F.regexp_replace(micros, r"\.000000$", "")


def export_json(stores: DataFrame) -> DataFrame:
    """One JSON document per store, in the shape the stores are served in."""
    faqs = F.transform(
        "faqs",
        lambda q: F.struct(
            q["question"].alias("question"),
            q["answer"].alias("answer"),
            faq.or_general(q["category"]).alias("category"),
        ),
    )
    fields = [
        "website_url", "brand_name", "product_catalog", "hero_products", "total_products",
        "privacy_policy", "return_refund_policy", "shipping_policy", "terms_of_service",
        "brand_context",
    ]
    document = F.struct(
        *fields,
        faqs.alias("faqs"),
        "social_handles",
        "contact_info",
        "important_links",
        iso(F.col("extraction_timestamp")).alias("extraction_timestamp"),
        "extraction_success",
        "error_messages",
        "quality_score",
    )
    return stores.select("website_url", F.to_json(document).alias("document"))


