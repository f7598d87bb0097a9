"""What the plans look like, and that hot keys do not land in one task."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from storeglean.operators import keyed, products, stores

DIRECTORY = "/root/testdata/sf0.001"
given = pytest.mark.skipif(not Path(DIRECTORY).exists(), reason="given tables are not here")

PARSES = {
    "page_features", "brand_name", "main_text", "direct_text", "link_categories", "important_links", "pad_defaults",
    "hero_links", "faq_jsonld", "faq_elements", "faq_items", "store_document", "store_enriched", "store_crawl",
    "store_summary", "section_select", "decode_defaults", "export_json",
}


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@given
def test_python_runs_in_the_parser_only(spark):
    for name, (query, _) in entry.BASE.items():
        text = plan(query(spark, DIRECTORY))
        assert ("MapInArrow" in text) == (name in PARSES), name
        for word in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython", "FlatMapGroups"):
            assert word not in text, (name, word)


@given
def test_scans_read_only_what_is_needed(spark):
    text = plan(entry.queries()["page_scan"](spark, DIRECTORY))
    assert "html" not in text and "Exchange" not in text
    text = plan(entry.queries()["top_countries"](spark, DIRECTORY))
    assert "c_acctbal" not in text
    text = plan(entry.queries()["run_statistics"](spark, DIRECTORY))
    assert text.count("SinglePartition") == 2  # the totals and the newest time stamp


def test_path_filter_reaches_the_scan(spark, tmp_path):
    from storeglean import schemas
    from storeglean.plans import extraction
    from storeglean.sources import landed

    location = str(tmp_path / "pages")
    spark.createDataFrame([], schemas.STORE_PAGES).write.parquet(location)
    feed = spark.createDataFrame([], schemas.PRODUCT_FEED)
    text = plan(extraction.extract_stores(landed.read_store_pages(spark, location), feed, F.current_timestamp(), ["kit"]))
    assert "In(path" in text.replace("PushedFilters: [", "")
    # One shuffle of page facts, two of the feed (by page, by store) and one of the keys of stores; the joins use them.
    assert text.count("Exchange hashpartitioning(store_url") == 4


def test_enrichment_has_no_shuffle(spark):
    from storeglean import schemas
    from storeglean.plans import extraction

    rows = spark.createDataFrame([], schemas.BRAND_INSIGHTS)
    assert "Exchange" not in plan(extraction.enrich(rows))


def hot(spark):
    """One store holds a third of all rows."""
    return spark.range(9000).select(
        F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("s"), F.col("id") % 50)).alias("store"),
        F.concat(F.lit("n"), F.col("id") % 70).alias("name"),
        F.col("id").alias("pos"),
    )


def test_groups_are_reduced_before_the_shuffle(spark):
    for df in (
        keyed.top_n(hot(spark), ["store"], [F.col("pos")], 5),
        keyed.keep_first(hot(spark), ["store"], ["pos"]),
        products.dedup_products(hot(spark)),
    ):
        text = plan(df)
        after = text[: text.index("Exchange")].count("WindowGroupLimit") + text[: text.index("Exchange")].count("Aggregate")
        before = text[text.index("Exchange") :].count("WindowGroupLimit") + text[text.index("Exchange") :].count("Aggregate")
        assert after >= 1 and before >= 1


def test_keyed_against_plain_python(spark):
    rows = [(r["store"], r["name"], r["pos"]) for r in hot(spark).collect()]
    firsts = {}
    for store, name, pos in sorted(rows, key=lambda r: r[2]):
        firsts.setdefault((store, name), pos)
    found = {(r["store"], r["name"]): r["pos"] for r in products.dedup_products(hot(spark)).collect()}
    assert found == firsts
    top = keyed.top_n(hot(spark), ["store"], [F.col("pos")], 5).where("store = 'hot'").orderBy("rank")
    assert [r["pos"] for r in top.collect()] == [0, 3, 6, 9, 12]
    assert keyed.top_n(hot(spark), ["store"], [F.col("pos")], 1001).where("store = 'hot'").count() == 1001


def test_hot_key_of_a_many_to_one_join_is_split(spark):
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20000",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20000",
    }
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        wide = hot(spark).unionByName(hot(spark)).withColumn("name", F.when(F.col("store") == "hot", F.lit("n1")).otherwise(F.col("name")))
        wide = wide.withColumn("note", F.sha2(F.col("pos").cast("string"), 256)).repartition(16)
        lists = wide.select("store", "name").distinct().withColumn("category", F.explode(F.expr("array('x', 'y')")))
        out = products.by_list(wide, lists)
        assert len(out.collect()) == 2 * wide.count()
        assert "skew=true" in plan(out)
    finally:
        for k in settings:
            spark.conf.unset(k)


def test_upsert_moves_each_table_once(spark):
    rows = spark.range(10).select(
        F.col("id").cast("string").alias("website_url"),
        F.current_timestamp().alias("extraction_timestamp"),
        F.current_timestamp().alias("created_at"),
        F.current_timestamp().alias("updated_at"),
    )
    text = plan(stores.upsert(rows, rows.drop("created_at", "updated_at"), F.current_timestamp()))
    assert text.count("Exchange hashpartitioning(website_url") == 1
