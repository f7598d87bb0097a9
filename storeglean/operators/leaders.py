"""Industry leaders: the seeded dimension and its look-up."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import rules
from ..functions.industry import fallback_leaders
from ..functions.text import blank_to_null
from .joins import lookup_join


def seed_leaders(spark: SparkSession, at: Column | None = None) -> DataFrame:
    """The fixed dimension: one row per industry."""
    rows = ", ".join(
        f"('{industry}', array({', '.join(repr(b) for b in brands)}))"
        for industry, brands in rules.INDUSTRY_LEADERS.items()
    )
    table = spark.sql(f"SELECT * FROM VALUES {rows} AS t(industry, top_brands)")
    stamp = at if at is not None else F.current_timestamp()
    return table.withColumn("last_updated", stamp)


#: Longest run of letters that the index of names has; longer words are found by their first letters and then compared.
GRAM = 3


def name_index(leaders: DataFrame) -> DataFrame:
    """(gram, name): each run of up to GRAM characters of each industry's name, so that rows grow with the names' length."""
    n = F.length("industry")

    def runs(k: int) -> Column:
        starts = F.when(n >= k, F.sequence(F.lit(1), n - (k - 1))).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.substring("industry", i, F.lit(k)))

    grams = F.array_distinct(F.concat(*[runs(k) for k in range(1, GRAM + 1)]))
    return leaders.select(F.explode(grams).alias("gram"), F.col("industry").alias("name"))


def containing(words: DataFrame, leaders: DataFrame) -> DataFrame:
    """(word, name): for each different `word` the first name, in their order, of an industry that contains it. Only names that
    share the first letters of a word are compared with it."""
    asked = words.where(blank_to_null(F.col("word")).isNotNull()).select("word").distinct()
    near = asked.withColumn("gram", F.left("word", F.lit(GRAM))).join(name_index(leaders), "gram")
    return near.where(F.contains("name", "word")).groupBy("word").agg(F.min("name").alias("name"))


def lookup_leaders(brands: DataFrame, leaders: DataFrame) -> DataFrame:
    """Add `leaders` (hosts) to rows with an `industry`.

    Tried in order: the industry by name; the first (by name) industry that contains the first
    word of it; the static word list. It is done once for each different industry text; names move without
    their lists. The joins to the rows and to the lists are many-to-one.
    """
    able = leaders.where(F.size("top_brands") > 0)
    low = F.lower("industry")
    asked = (
        brands.where(blank_to_null(F.col("industry")).isNotNull())
        .select("industry")
        .distinct()
        .select("industry", low.alias("_low"), blank_to_null(F.get(F.split(F.trim(low), r"\s+"), F.lit(0))).alias("word"))
    )
    names = lookup_join(asked, containing(asked.select("word"), able), ["word"], "left")
    exact = able.select(F.col("industry").alias("_low"), F.col("top_brands").alias("_exact"))
    part = able.select(F.col("industry").alias("name"), F.col("top_brands").alias("_part"))
    found = lookup_join(lookup_join(names, exact, ["_low"], "left"), part, ["name"], "left")
    table = found.select("industry", F.coalesce("_exact", "_part", fallback_leaders(F.col("industry"))).alias("leaders"))
    # No industry, no look-up.
    none = F.array().cast("array<string>")
    return lookup_join(brands, table, ["industry"], "left").withColumn("leaders", F.coalesce("leaders", none))
