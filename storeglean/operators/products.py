"""Product tables: de-duplication, featured products, categories."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.lists import category_lists
from ..functions.text import blank_to_null, strip
from .joins import lookup_join
from .keyed import keep_first


def dedup_products(products: DataFrame, store: str = "store", name: str = "name", pos: str = "pos"):
    """First product of each name in a store; case and outer white space do not count."""
    keyed = products.withColumn("_key", strip(F.lower(F.col(name))))
    return keep_first(keyed, [store, "_key"], [pos]).drop("_key")


def without_featured(catalog: DataFrame, hero: DataFrame, store: str = "store", name: str = "name"):
    """Catalog rows whose name is not the name of a featured product of the store.

    Names are compared in lower case but untrimmed. The catalog is expected to be
    de-duplicated, so that no (store, name) key is large.
    """
    names = hero.select(F.col(store), F.lower(F.col(name)).alias("_key")).distinct()
    return catalog.withColumn("_key", F.lower(F.col(name))).join(names, [store, "_key"], "left_anti").drop("_key")


def by_type(products: DataFrame, product_type: str = "product_type") -> DataFrame:
    """Each product with its category: its own type, or Other. Long form, no shuffle."""
    return products.withColumn(
        "category", F.coalesce(blank_to_null(F.col(product_type)), F.lit("Other"))
    )


def category_sizes(products: DataFrame, store: str = "store", product_type: str = "product_type"):
    return by_type(products, product_type).groupBy(store, "category").agg(F.count("*").alias("products"))


def by_list(products: DataFrame, lists: DataFrame, store: str = "store", name: str = "name"):
    """Products of each named category; a product may be in several.

    `lists` has (store, category, name), an inverted index from names to categories: an equality join finds them, and the
    rows of a name that many products share are split by the adaptive skew join. A name that a category has twice counts once.
    """
    index = lists.select(store, name, "category").distinct()
    return lookup_join(products, index, [store, name])


def categorize(
    products: DataFrame,
    responses: DataFrame,
    store: str = "store",
    name: str = "name",
    product_type: str = "product_type",
) -> DataFrame:
    """Products by the category lists of their store, or by type where there is no valid list.

    `responses` has one (store, response) row per store. A product may be in several categories
    or, with a valid list, in none. The lists never go to the products' rows: a flag for each store tells
    which way its products go, and names are looked up in the lists in long form.
    """
    parsed = responses.select(store, category_lists(F.col("response")).alias("_lists")).where(F.col("_lists").isNotNull())
    listed = lookup_join(products, parsed.select(store, F.lit(True).alias("_listed")), [store], "left")
    by_name = parsed.select(store, F.explode("_lists").alias("category", "_names")).select(
        store, "category", F.explode("_names").alias(name)
    )
    named = by_list(listed.where("_listed").drop("_listed"), by_name, store, name)
    typed = by_type(listed.where("_listed is null").drop("_listed"), product_type)
    return named.unionByName(typed)


# ---- products grouped by category

CHUNK = 500  # products of a chunk


def positions(rows: DataFrame, group: list[str], pos: str, out: str, width: int = CHUNK) -> DataFrame:
    """Add `out`: the gapless position from 0 of each row in its group, in the order of `pos`.

    `pos` is a whole number that differs among the rows of a group. A group is cut into stretches of `width` values of
    `pos`, which hold as many rows at most; a row's position is that in its stretch and the number of rows in the stretches
    before. So a group of any size meets in no task: only the counts of its stretches do.
    """
    dealt = rows.withColumn("_stretch", F.floor(F.col(pos) / width))
    counts = dealt.groupBy(*group, "_stretch").agg(F.count("*").alias("_held"))
    before = Window.partitionBy(*group).orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1)
    firsts = counts.select(*group, "_stretch", F.coalesce(F.sum("_held").over(before), F.lit(0)).alias("_first"))
    inside = F.row_number().over(Window.partitionBy(*group, "_stretch").orderBy(pos)) - 1
    placed = dealt.withColumn("_inside", inside).join(firsts, [*group, "_stretch"])
    return placed.withColumn(out, (F.col("_first") + F.col("_inside")).cast("long")).select(*rows.columns, out)


def grouped(
    categorized: DataFrame, store: str = "store", name: str = "name", pos: str = "pos", chunk: int = CHUNK
) -> DataFrame:
    """The products of each category of a store, in feed order, as lists of `chunk` products at most.

    One row per (store, category, chunk): chunk counts from 0, `first` is the position of its first product in the category,
    `products` are (pos, name). All chunks but the last of a category are full. `pos` is a product's place in its store.
    """
    placed = positions(categorized.where(F.col(store).isNotNull()), [store, "category"], pos, "_place", chunk)
    dealt = placed.withColumn("chunk", F.floor(F.col("_place") / chunk))
    item = F.struct(F.col(pos).alias("pos"), F.col(name).alias("name"))
    return (
        dealt.groupBy(store, "category", "chunk")
        .agg(F.array_sort(F.collect_list(item)).alias("products"))
        .select(store, "category", "chunk", (F.col("chunk") * chunk).alias("first"), "products")
    )
