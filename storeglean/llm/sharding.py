"""Sharding by rendezvous hashing: every record key goes to the shard that scores highest for it.

A shard's score for a key is `weight / -ln(u)`, u being a hash of key and shard in (0, 1). A key's score for one shard
does not depend on the others, so a new shard only takes rows into itself and a removed one only gives its own away.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from storeglean.llm.common import fresh, hash32, ranked, table

SHARDS = 16


def uniform(key: list[Column], shard: int) -> Column:
    """A hash of key and shard in (0, 1). The key is hashed as text, so an int and a long of one value agree."""
    return (hash32(*[k.cast("string") for k in key], F.lit(shard)) + 0.5) / F.lit(float(1 << 32))


def choose(key: list[Column], weights: list[float]) -> Column:
    """The shard, numbered from 0, of largest `weight / -ln(u)`; shards of weight 0 take nothing; ties go to the lower."""
    if not any(w > 0 for w in weights) or any(w < 0 for w in weights):
        raise ValueError("weights must not be negative, and one at least must be above 0")
    scored = [
        F.struct((F.lit(float(w)) / -F.ln(uniform(key, i))).alias("score"), F.lit(-i).alias("shard"))
        for i, w in enumerate(weights)
        if w > 0
    ]
    best = scored[0] if len(scored) == 1 else F.greatest(*scored)
    return (-best["shard"]).cast("int")


def assign(df: DataFrame, key: list[str], weights: list[float], out: str = "shard") -> DataFrame:
    """Adds `out`, the shard of each row. No shuffle.

    Equal keys share a shard, repeated rows too; a null key is a key like any other. An empty table stays empty.
    A column that is called like `out` already is replaced.
    """
    return df.withColumn(out, choose([F.col(k) for k in key], weights))


def moved(df: DataFrame, key: list[str], before: list[float], after: list[float]) -> DataFrame:
    """Rows and moved rows for each pair of old and new shard."""
    names = [F.col(k) for k in key]
    return (
        df.select(choose(names, before).alias("from_shard"), choose(names, after).alias("to_shard"))
        .groupBy("from_shard", "to_shard")
        .agg(F.count(F.lit(1)).alias("n_rows"))
    )


def write(df: DataFrame, key: list[str], weights: list[float], path: str, files_per_shard: int = 1) -> None:
    """Writes one folder per shard. A shard is spread over `files_per_shard` tasks by a hash of the key."""
    shard = fresh(df, "shard")
    slice_ = fresh(df, "slice")
    dealt = assign(df, key, weights, shard).withColumn(
        slice_, F.pmod(hash32(*[F.col(k) for k in key]), F.lit(files_per_shard))
    )
    (
        dealt.repartition(len(weights) * files_per_shard, shard, slice_)
        .drop(slice_)
        .write.partitionBy(shard)
        .mode("overwrite")
        .parquet(path)
    )


def layout(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """Where each document lies: shard and gapless slot, and its shard if there were one more.

    A null text has size 1 and the checksum of no bytes. Null, repeated and negative ids are keys like any other. Other
    columns, whatever they are called, are not read.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    base = docs.select(
        "doc_id",
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).cast("long").alias("text_crc32"),
        F.lit("key").alias("law"),
    )
    key = [F.col("doc_id")]
    placed = base.withColumn("shard", choose(key, [1.0] * shards)).withColumn(
        "grown_shard", choose(key, [1.0] * (shards + 1))
    )
    order = ["doc_id", "text_crc32", "size"]
    return ranked(placed, ["shard"], order, "slot").select(
        "doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"
    )


def op1_sharding(spark: SparkSession, directory: str) -> DataFrame:
    """All documents in 16 shards by their key."""
    return layout(table(spark, directory, "documents"))


QUERIES = {"op1_sharding": (op1_sharding, None)}
