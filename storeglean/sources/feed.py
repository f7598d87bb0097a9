"""Product feed: JSON pages of products per store."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import rules, schemas
from ..functions.arrays import cut
from ..functions.text import has_text
from ..operators.keyed import top_n


def tag_list(tags: Column) -> Column:
    """Tags from "a, b" text or from a JSON list that arrives as text."""
    listed = F.from_json(tags, "array<string>")
    return (
        F.when(tags.startswith("["), F.coalesce(listed, F.array().cast("array<string>")))
        .when(has_text(tags), F.split(tags, ", "))
        .otherwise(F.array().cast("array<string>"))
    )


def product(p: Column, base: Column) -> Column:
    """One feed element as a product; price and stock come from its first variant."""
    variant, image = F.get(p["variants"], F.lit(0)), F.get(p["images"], F.lit(0))
    return F.struct(
        F.coalesce(p["title"], F.lit("")).alias("name"),
        variant["price"].alias("price"),
        image["src"].alias("image_url"),
        F.concat(base, F.lit("/products/"), F.coalesce(p["handle"], F.lit(""))).alias("product_url"),
        F.coalesce(p["body_html"], F.lit("")).alias("description"),
        variant["sku"].alias("sku"),
        p["vendor"].alias("vendor"),
        p["product_type"].alias("product_type"),
        tag_list(p["tags"]).alias("tags"),
        F.coalesce(variant["available"], F.lit(True)).alias("available"),
    )


def _landed(feed: DataFrame) -> DataFrame:
    """Feed pages that were answered, `raw` being their products; it is null on pages that do not parse."""
    at = F.unix_micros(F.col("fetched_at").cast("timestamp")) if "fetched_at" in feed.columns else F.lit(0)
    raw = F.from_json("body", schemas.FEED_BODY)["products"]
    return feed.where((F.col("status") == 200) & (F.col("page") >= 1)).select(
        "store_url", "page", F.coalesce(at, F.lit(0)).alias("_at"), F.xxhash64("body").alias("_tie"), raw.alias("raw")
    )


def _newest(landed: DataFrame, products: str) -> DataFrame:
    """The newest landing of each feed page that was delivered, `products` being null where it was not. Those sort last
    instead of being left out before: that filter would parse every body a second time."""
    order = [F.desc(F.col(products).isNotNull()), F.desc("_at"), F.asc("_tie")]
    return top_n(landed, ["store_url", "page"], order, 1).where(F.col(products).isNotNull())


def newest_landings(feed: DataFrame) -> DataFrame:
    """(store_url, page, raw): the newest landing of each feed page, by `fetched_at` where the feed has it; an empty one is
    newest too. Of landings of one time the one with the least hash of its body counts. Map tasks send one landing of a page."""
    return _newest(_landed(feed), "raw").select("store_url", "page", "raw")


def _paged(pages: DataFrame, page_size: int, max_pages: int | None) -> DataFrame:
    """The feed pages that count, with `start`, the number of products before. pages: one row each, with n, its products.

    Paging begins at page 1 and goes on as long as pages are there and full; the last page read may be a shorter one.
    """
    in_order = Window.partitionBy("store_url").orderBy("page")
    before = in_order.rowsBetween(Window.unboundedPreceding, -1)
    run = pages.where(F.col("n") > 0).withColumns(
        {
            "_ended": F.coalesce(F.max((F.col("n") < page_size).cast("int")).over(before), F.lit(0)),
            "_gapless": F.col("page") == F.row_number().over(in_order),  # false from the first gap on
            "start": F.coalesce(F.sum("n").over(before), F.lit(0)),
        }
    )
    read = run.where(F.col("_gapless") & (F.col("_ended") == 0)).drop("_gapless", "_ended")
    return read if max_pages is None else read.where(F.col("page") <= max_pages)


def pages_read(
    feed: DataFrame, page_size: int = rules.FEED_PAGE_SIZE, max_pages: int | None = None
) -> DataFrame:
    """(store_url, page, n, start): the feed pages that count, how many products they have, and how many come before.
    Found on narrow rows: no products are moved for it."""
    sizes = _landed(feed).select(
        "store_url", "page", "_at", "_tie", F.when(F.col("raw").isNotNull(), F.size("raw")).alias("n")
    )
    return _paged(_newest(sizes, "n").select("store_url", "page", "n"), page_size, max_pages)


def _items(limits: rules.Limits) -> Column:
    return F.transform(cut(F.col("raw"), limits.catalog), lambda p: product(p, F.col("store_url")))


def store_catalogs(
    feed: DataFrame, page_size: int = rules.FEED_PAGE_SIZE, limits: rules.Limits = rules.KEEP_ALL
) -> DataFrame:
    """One row per store: `product_count` and the products in feed order, for records that hold a store's catalog.
    `feed_products` is the form without such rows."""
    pages = newest_landings(feed).select("store_url", "page", F.size("raw").alias("n"), _items(limits).alias("items"))
    per_store = _paged(pages, page_size, limits.feed_pages).groupBy("store_url").agg(
        F.sum("n").cast("int").alias("product_count"), F.array_sort(F.collect_list(F.struct("page", "items"))).alias("read")
    )
    products = F.flatten(F.transform("read", lambda p: p["items"]))
    return per_store.select("store_url", "product_count", cut(products, limits.catalog).alias("products"))


def feed_products(
    feed: DataFrame, page_size: int = rules.FEED_PAGE_SIZE, limits: rules.Limits = rules.KEEP_ALL
) -> DataFrame:
    """One row per product that belongs to the catalog, with its position in the store's feed. No row or group holds more
    than the products of one page."""
    read = pages_read(feed, page_size, limits.feed_pages)
    rows = newest_landings(feed).join(read, ["store_url", "page"])
    each = rows.select("store_url", "start", F.posexplode(_items(limits)).alias("_at", "product"))
    placed = each.select("store_url", (F.col("start") + F.col("_at")).cast("int").alias("pos"), "product.*")
    return placed if limits.catalog is None else placed.where(F.col("pos") < limits.catalog)


def first_page_products(feed: DataFrame, limits: rules.Limits = rules.KEEP_ALL) -> DataFrame:
    """Other form: only the newest landing of the first feed page counts."""
    first = newest_landings(feed.where("page = 1")).where(F.size("raw") > 0)
    return first.select("store_url", _items(limits).alias("products"))


def feed_has_products(feed: DataFrame) -> DataFrame:
    """Stores whose feed parses and has a product list."""
    body = F.from_json("body", schemas.FEED_BODY)
    return (
        feed.where((F.col("status") == 200) & body["products"].isNotNull()).select("store_url").distinct()
    )
