"""First, latest and top rows per key.

All of these reduce inside each map task before the shuffle: the aggregates by partial
aggregation, `top_n` by the partial group limit that Spark plans for `row_number <= n`. A key
that holds a third of the table therefore sends at most one row (or n rows) per task.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

def keep_first(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key by `order`."""
    rest = [c for c in df.columns if c not in keys]
    best = F.min_by(F.struct(*rest), F.struct(*order))
    return df.groupBy(*keys).agg(best.alias("_row")).select(*keys, "_row.*").select(*df.columns)


def top_n(df: DataFrame, keys: list[str], order: list[Column], n: int, rank: str = "rank") -> DataFrame:
    """The first `n` rows of each key, numbered from 1. Map tasks cut their part for n up to Spark's
    `spark.sql.optimizer.windowGroupLimitThreshold`."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= n)


def first_valid(
    df: DataFrame, keys: list[str], priority: list[str], valid: Column
) -> DataFrame:
    """Of the candidates that are valid, the one tried first."""
    return keep_first(df.where(valid), keys, priority)


def most_recent(df: DataFrame, time: str, tie: str, n: int) -> DataFrame:
    """Newest `n` rows of the whole table; ties in key order."""
    return df.orderBy(F.desc(time), F.asc(tie)).limit(n)
