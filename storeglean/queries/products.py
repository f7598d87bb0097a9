"""Queries over product feeds and product tables."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import rules
from ..functions import industry
from ..operators import products
from ..operators.keyed import top_n
from ..sources import feed as feeds
from . import roles
from .sqltext import ladder


def product_feed(spark: SparkSession, d: str) -> DataFrame:
    rows = feeds.feed_products(roles.large_feed(spark, d))
    return rows.withColumn("tags", F.array_join("tags", "|"))


_FEED_COLUMNS = f"""
  p_name AS name, CASE WHEN p_type <> 'PROMO' THEN printf('%.2f', p_retailprice) END AS price,
  CASE WHEN p_size > 5 THEN '/i/' || p_partkey || '.png' END AS image_url,
  store_url || '/products/' || replace(p_name, ' ', '-') || '-' || p_partkey AS product_url,
  '<p>' || p_name || '</p>' AS description, CASE WHEN p_type <> 'PROMO' THEN 'S' || p_partkey END AS sku,
  p_brand AS vendor, p_type AS product_type,
  CASE WHEN p_type = 'ECONOMY' THEN '' ELSE replace(p_name, ' ', '|') END AS tags,
  CASE WHEN p_type IN ('PROMO', 'LARGE') THEN true ELSE p_size > 10 END AS available
"""
PRODUCT_FEED = f"""
SELECT store_url, p_partkey % {roles.FEED_BLOCK} AS pos, {_FEED_COLUMNS}
FROM (SELECT *, 'https://shop-' || (p_partkey // {roles.FEED_BLOCK}) || '.example.com' AS store_url FROM part)
"""


def product_feed_first_page(spark: SparkSession, d: str) -> DataFrame:
    found = feeds.first_page_products(roles.large_feed(spark, d)).select(
        "store_url", F.posexplode("products").alias("pos", "p")
    )
    return found.select("store_url", "pos", "p.name", "p.price", "p.product_url")


PRODUCT_FEED_FIRST_PAGE = f"""
SELECT store_url, p_partkey % {roles.FEED_BLOCK} AS pos, p_name AS name,
  CASE WHEN p_type <> 'PROMO' THEN printf('%.2f', p_retailprice) END AS price,
  store_url || '/products/' || replace(p_name, ' ', '-') || '-' || p_partkey AS product_url
FROM (SELECT *, 'https://shop-' || (p_partkey // {roles.FEED_BLOCK}) || '.example.com' AS store_url FROM part)
WHERE p_partkey % {roles.FEED_BLOCK} < {rules.FEED_PAGE_SIZE}
"""


def _parts(spark: SparkSession, d: str) -> DataFrame:
    return roles.table(spark, d, "part").select(
        F.col("p_brand").alias("store"),
        F.when(F.col("p_size") > 25, F.concat(F.lit(" "), F.initcap("p_name"), F.lit("\t")))
        .otherwise(F.col("p_name"))
        .alias("name"),
        F.col("p_partkey").alias("pos"),
        F.col("p_retailprice").alias("price"),
    )


_PARTS = """
parts AS (
  SELECT p_brand AS store, p_partkey AS pos, p_retailprice AS price,
    CASE WHEN p_size > 25 THEN ' ' || upper(left(p_name, 1)) || substr(p_name, 2, strpos(p_name, ' ') - 1)
      || upper(substr(p_name, strpos(p_name, ' ') + 1, 1)) || substr(p_name, strpos(p_name, ' ') + 2) || chr(9)
      ELSE p_name END AS name
  FROM part
), deduped AS (
  SELECT * FROM parts
  QUALIFY row_number() OVER (PARTITION BY store, regexp_replace(lower(name), '^\\s+|\\s+$', '', 'g') ORDER BY pos) = 1
)
"""


def dedup_products(spark: SparkSession, d: str) -> DataFrame:
    return products.dedup_products(_parts(spark, d))


DEDUP_PRODUCTS = f"WITH {_PARTS} SELECT * FROM deduped"


_HEROES = 5  # the featured products of a store, in the role of `part`


def catalog_minus_hero(spark: SparkSession, d: str) -> DataFrame:
    parts = _parts(spark, d)
    hero = top_n(parts, ["store"], [F.col("pos")], _HEROES).select("store", "name")
    rest = products.without_featured(products.dedup_products(parts), hero)
    heroes = hero.groupBy("store").agg(F.count_distinct(F.trim(F.lower("name"))).alias("heroes"))
    return (
        heroes.join(
            rest.groupBy("store").agg(F.count("*").alias("catalog"), F.min("pos").alias("first_pos")), "store", "left"
        )
        .withColumn("catalog", F.coalesce("catalog", F.lit(0)))
        .withColumn("total_products", F.col("catalog") + F.col("heroes"))
    )


CATALOG_MINUS_HERO = f"""
WITH {_PARTS}, hero AS (
  SELECT store, name FROM parts QUALIFY row_number() OVER (PARTITION BY store ORDER BY pos) <= {_HEROES}
), rest AS (
  SELECT * FROM deduped d WHERE NOT EXISTS (
    SELECT 1 FROM hero h WHERE h.store = d.store AND lower(h.name) = lower(d.name))
), heroes AS (SELECT store, count(DISTINCT trim(lower(name))) AS heroes FROM hero GROUP BY store)
SELECT h.store, count(r.pos) AS catalog, min(pos) AS first_pos, any_value(heroes) AS heroes,
  count(r.pos) + any_value(heroes) AS total_products
FROM heroes h LEFT JOIN rest r ON r.store = h.store GROUP BY h.store
"""


def _typed(spark: SparkSession, d: str) -> DataFrame:
    kind = F.when(F.col("p_type") == "PROMO", F.lit("")).when(F.col("p_type") != "SMALL", F.col("p_type"))
    return roles.table(spark, d, "part").select(
        F.col("p_brand").alias("store"), "p_partkey", F.col("p_name").alias("name"), kind.alias("product_type")
    )


def categorize_by_type(spark: SparkSession, d: str) -> DataFrame:
    return products.by_type(_typed(spark, d)).select("store", "p_partkey", "category")


CATEGORIZE_BY_TYPE = """
SELECT p_brand AS store, p_partkey, CASE WHEN p_type IN ('PROMO', 'SMALL') THEN 'Other' ELSE p_type END AS category
FROM part
"""


def category_sizes(spark: SparkSession, d: str) -> DataFrame:
    return products.category_sizes(_typed(spark, d))


CATEGORY_SIZES = f"SELECT store, category, count(*) AS products FROM ({CATEGORIZE_BY_TYPE}) GROUP BY store, category"


def categorize_by_list(spark: SparkSession, d: str) -> DataFrame:
    parts = _typed(spark, d)
    words = F.split("name", " ")
    lists = parts.select("store", "name", F.explode(words).alias("category"))
    return products.by_list(parts, lists).select("store", "category", "p_partkey", "name")


CATEGORIZE_BY_LIST = """
SELECT p_brand AS store, unnest(string_split(p_name, ' ')) AS category, p_partkey, p_name AS name FROM part
"""


def categorize_by_response(spark: SparkSession, d: str) -> DataFrame:
    """Blocks of 20 parts with a category list in JSON; some lists are broken."""
    parts = roles.table(spark, d, "part").select(
        F.floor(F.col("p_partkey") / roles.BLOCK).alias("store"), "p_partkey", F.col("p_name").alias("name"),
        F.when(F.col("p_type") != "PROMO", F.col("p_type")).alias("product_type"),
    )
    names = parts.groupBy("store").agg(F.collect_set("name").alias("names"), F.min("product_type").alias("least"))
    listed = F.to_json(
        F.create_map(
            F.lit("Small"), F.filter("names", lambda n: n.startswith("small")),
            F.lit("Rings"), F.filter("names", lambda n: n.endswith("ring")),
            F.lit("Reds"), F.filter("names", lambda n: n.startswith("red")),
        )
    )
    responses = names.select(
        "store",
        F.when(F.array_contains("names", F.lit("hot bolt")), F.lit("Sorry, no list."))
        .when(F.array_contains("names", F.lit("old gear")), F.concat(F.lit("```json\n"), listed, F.lit("\n```")))
        .otherwise(listed)
        .alias("response"),
    )
    return products.categorize(parts, responses).select("store", "category", "p_partkey", "name")


CATEGORIZE_BY_RESPONSE = f"""
WITH parts AS (SELECT p_partkey // {roles.BLOCK} AS store, p_partkey, p_name AS name, p_type FROM part),
broken AS (SELECT DISTINCT store FROM parts WHERE name = 'hot bolt'),
marks AS (
  SELECT store, p_partkey, name, unnest([
    CASE WHEN starts_with(name, 'small') THEN 'Small' END, CASE WHEN ends_with(name, 'ring') THEN 'Rings' END,
    CASE WHEN starts_with(name, 'red') THEN 'Reds' END]) AS category
  FROM parts WHERE store NOT IN (SELECT store FROM broken)
)
SELECT store, category, p_partkey, name FROM marks WHERE category IS NOT NULL
UNION ALL
SELECT store, CASE WHEN p_type = 'PROMO' THEN 'Other' ELSE p_type END, p_partkey, name FROM parts
WHERE store IN (SELECT store FROM broken)
"""


def category_lists(spark: SparkSession, d: str) -> DataFrame:
    """The parts of each brand by type, in lists of at most 100."""
    rows = products.by_type(_typed(spark, d).withColumnRenamed("p_partkey", "pos"))
    found = products.grouped(rows, chunk=_CHUNK)
    names = F.array_join(F.transform("products", lambda p: p["name"]), "|")
    return found.select(
        "store", "category", "chunk", "first", F.size("products").alias("held"), F.get("products", F.lit(0))["pos"].alias("first_pos"),
        F.element_at("products", -1)["pos"].alias("last_pos"), F.md5(F.encode(names, "UTF-8")).alias("names_md5"),
    )


_CHUNK = 100
CATEGORY_LISTS = f"""
WITH placed AS (
  SELECT p_brand AS store, p_partkey AS pos, p_name AS name, CASE WHEN p_type IN ('PROMO', 'SMALL') THEN 'Other' ELSE p_type END AS category
  FROM part
), numbered AS (
  SELECT *, (row_number() OVER (PARTITION BY store, category ORDER BY pos) - 1) // {_CHUNK} AS chunk FROM placed
)
SELECT store, category, chunk, chunk * {_CHUNK} AS first, CAST(count(*) AS INT) AS held, min(pos) AS first_pos,
  max(pos) AS last_pos, md5(string_agg(name, '|' ORDER BY pos)) AS names_md5
FROM numbered GROUP BY store, category, chunk
"""


def product_type_keywords(spark: SparkSession, d: str) -> DataFrame:
    """The types of each block of 20 parts, all of them: as keywords of a search, and as they are saved."""
    parts = roles.table(spark, d, "part").select(
        F.floor(F.col("p_partkey") / roles.BLOCK).alias("store"), "p_partkey", roles.shown_type().alias("product_type")
    )
    catalogs = parts.groupBy("store").agg(
        F.array_sort(F.collect_list(F.struct("p_partkey", "product_type"))).alias("catalog")
    )
    types = F.array_join(industry.product_types(F.col("catalog")), ",")
    return catalogs.select("store", types.alias("keywords"), types.alias("saved"))


_SHOWN_TYPE = "CASE p_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in roles.TYPE_NAMES.items()) + " ELSE '' END"
PRODUCT_TYPE_KEYWORDS = f"""
WITH firsts AS (
  SELECT p_partkey // {roles.BLOCK} AS store, lower({_SHOWN_TYPE}) AS kind, p_partkey FROM part
), kinds AS (
  SELECT store, kind, row_number() OVER (PARTITION BY store ORDER BY min(p_partkey)) AS k
  FROM firsts WHERE kind <> '' GROUP BY store, kind
)
SELECT s.store, coalesce(string_agg(kind, ',' ORDER BY k), '') AS keywords,
  coalesce(string_agg(kind, ',' ORDER BY k), '') AS saved
FROM (SELECT DISTINCT store FROM firsts) s LEFT JOIN kinds ON kinds.store = s.store GROUP BY s.store
"""

_SWAPS = {"ring": "rod", "gear": "dress", "anvil": "serum", "bolt": "bag", "gizmo": "lipstick"}


def industry_from_names(spark: SparkSession, d: str) -> DataFrame:
    """Industry of each block of 20 parts; large parts go by other names."""
    name = F.col("p_name")
    for old, new in _SWAPS.items():
        name = F.replace(name, F.lit(old), F.lit(new))
    renamed = F.when(F.col("p_size") > 47, name).otherwise(F.replace(F.col("p_name"), F.lit("ring"), F.lit("rod")))
    item = F.struct(
        F.initcap(renamed).alias("name"),
        F.when(F.col("p_size") < 2, roles.shown_type()).alias("product_type"),
    )
    catalogs = (
        roles.table(spark, d, "part")
        .groupBy(F.floor(F.col("p_partkey") / roles.BLOCK).alias("block"))
        .agg(F.array_sort(F.collect_list(F.struct("p_partkey", item.alias("item")))).alias("rows"))
        .select("block", F.transform("rows", lambda r: r["item"]).alias("catalog"))
        .select("block", "catalog", industry.keywords(F.col("catalog")).alias("keywords"))
    )
    return catalogs.select(
        "block",
        F.array_join("keywords", ",").alias("keywords"),
        industry.of_keywords(F.col("keywords")).alias("industry"),
    )


_RENAMED = "p_name"
for _old, _new in _SWAPS.items():
    _RENAMED = f"replace({_RENAMED}, '{_old}', '{_new}')"
INDUSTRY_FROM_NAMES = f"""
WITH items AS (
  SELECT p_partkey // {roles.BLOCK} AS block, p_partkey,
    CASE WHEN p_size > 47 THEN {_RENAMED} ELSE replace(p_name, 'ring', 'rod') END AS name,
    CASE WHEN p_size < 2 THEN lower({_SHOWN_TYPE}) ELSE '' END AS kind
  FROM part
), kinds AS (
  SELECT block, kind, row_number() OVER (PARTITION BY block ORDER BY min(p_partkey)) AS k
  FROM items WHERE kind <> '' GROUP BY block, kind
), types AS (
  SELECT block, string_agg(kind, ',' ORDER BY k) AS types FROM kinds GROUP BY block
), texts AS (SELECT block, string_agg(name, ' ' ORDER BY p_partkey) AS text FROM items GROUP BY block),
words AS (
  SELECT x.block, coalesce(types, {ladder('text', rules.KEYWORD_FROM_NAMES)}, '') AS keywords
  FROM texts x LEFT JOIN types t ON x.block = t.block
)
SELECT block, keywords, {ladder("replace(keywords, ',', ' ')", rules.INDUSTRY_FROM_KEYWORDS)} AS industry FROM words
"""

QUERIES = {
    "product_feed": (product_feed, PRODUCT_FEED),
    "product_feed_first_page": (product_feed_first_page, PRODUCT_FEED_FIRST_PAGE),
    "dedup_products": (dedup_products, DEDUP_PRODUCTS),
    "catalog_minus_hero": (catalog_minus_hero, CATALOG_MINUS_HERO),
    "categorize_by_type": (categorize_by_type, CATEGORIZE_BY_TYPE),
    "category_sizes": (category_sizes, CATEGORY_SIZES),
    "categorize_by_list": (categorize_by_list, CATEGORIZE_BY_LIST),
    "category_lists": (category_lists, CATEGORY_LISTS),
    "categorize_by_response": (categorize_by_response, CATEGORIZE_BY_RESPONSE),
    "product_type_keywords": (product_type_keywords, PRODUCT_TYPE_KEYWORDS),
    "industry_from_names": (industry_from_names, INDUSTRY_FROM_NAMES),
}
