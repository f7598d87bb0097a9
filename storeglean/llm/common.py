"""Helpers that the training-data operators share."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from storeglean.sources.workspace import remove as discard
from storeglean.sources.workspace import scratch, shared_dir

__all__ = ["discard", "fresh", "hash32", "kept", "least_by_hash", "once", "ranked", "scratch", "shared_dir", "stored", "table"]

HASH_SPACE = 1 << 32


def table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{directory}/{name}.parquet")


def kept(df: DataFrame) -> DataFrame:
    """The rows, computed once and read from the shared folder from now on; cuts the lineage."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, what: str) -> tuple[DataFrame, str]:
    """The rows, written as Parquet in the shared folder and read again, and the path for `discard`."""
    path = scratch(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def once(function):
    """A Python function whose lists are taken apart: Spark filters empty lists out before it does so, and would call a
    function that it takes to be repeatable a second time, in a worker of its own, for that filter."""
    return function.asNondeterministic()


def fresh(df: DataFrame, name: str) -> str:
    """A column name like `name` that no column of `df` has, upper and lower case alike."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def hash32(*columns: Column) -> Column:
    """A hash of the columns, spread evenly over 0 to 2^32 - 1."""
    return F.shiftrightunsigned(F.xxhash64(*columns), 32)


def least_by_hash(df: DataFrame, key: list[str], rows: int) -> DataFrame:
    """The first `rows` rows by a hash of `key`, then `key`. Far larger tables are cut to the rows under a hash that twice as
    many are expected under, so that a task does not send `rows` rows of its own to where the first ones are chosen."""
    hashed, n, about = hash32(*map(F.col, key)), df.count(), 2 * rows + 1000
    if n > about:
        under = df.where(hashed < HASH_SPACE * about // n)
        if under.count() >= rows:  # else a few keys have most rows
            df = under
    return df.orderBy(hashed, *key).limit(rows)


def ranked(df: DataFrame, group: list[str], key: list[str], out: str, rows_per_bucket: int = 50_000) -> DataFrame:
    """Adds `out`: the gapless rank from 0 of each row within its `group`, ordered by a hash of `key`, then `key`.

    A group may hold any share of the rows: it is cut into buckets along the hash, each bucket is ranked by itself,
    and the counts of the buckets before it are added. Rows that are equal in all of `key` share a bucket; their
    order among each other is arbitrary. `df` is read three times and should be narrow or stored.
    """
    bucket, first, held = (fresh(df, n) for n in ("_bucket", "_first", "_held"))
    buckets = max(1, math.ceil(df.count() / rows_per_bucket))
    dealt = df.withColumn(bucket, F.shiftright(hash32(*[F.col(k) for k in key]) * buckets, 32).cast("int"))
    before = Window.partitionBy(*group).orderBy(bucket)
    sizes = (
        dealt.groupBy(*group, bucket)
        .agg(F.count(F.lit(1)).alias(held))
        .select(*group, bucket, (F.sum(held).over(before) - F.col(held)).alias(first))
    )
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in [*group, bucket]]
    place = Window.partitionBy(*group, bucket).orderBy(hash32(*[F.col(k) for k in key]), *key)
    inner = dealt.withColumn(out, F.row_number().over(place) - 1)
    on = same[0]
    for s in same[1:]:
        on = on & s
    return inner.alias("a").join(sizes.alias("b"), on).select(
        *[F.col(f"a.{c}") for c in df.columns], (F.col(f"a.{out}") + F.col(f"b.{first}")).cast("long").alias(out)
    )
