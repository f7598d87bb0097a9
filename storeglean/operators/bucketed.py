"""Keyed tables that a run changes without writing them anew.

A table is a folder. A row's bucket is a hash of its key; `data/run=<run>/bucket=<n>` holds the rows of the buckets that a
run touched, and `manifest/<version>-<run>` says for each bucket which run's files are its rows. A run reads the buckets
of its incoming keys, merges, writes these buckets to a folder of its own and then a new manifest. What an older manifest
names is never changed, so readers see the state before or after a run; what a failed run left is not named by any.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass
from urllib.parse import quote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..sources.workspace import names_in, remove

#: Buckets of a new table. A bucket is the least that an upsert rewrites: some 100 MB each are a good size.
BUCKETS = 256
_MANIFEST = "bucket int, run string, buckets int, rows_schema string"


@dataclass
class State:
    """A version of a table: the run that wrote each bucket, how many buckets there are, and the columns."""

    version: int
    runs: dict[int, str]
    buckets: int
    schema: StructType


def bucket_of(key: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def _versions(spark: SparkSession, location: str) -> list[tuple[int, str, str]]:
    """(version, run, path) of each manifest that was written whole."""
    found = []
    for name in names_in(spark, f"{location}/manifest"):
        number, _, run = name.partition("-")
        path = f"{location}/manifest/{name}"
        if number.isdigit() and "_SUCCESS" in names_in(spark, path):
            found.append((int(number), run, path))
    return sorted(found)


def _run_name(run_id: str) -> str:
    """A run's id as a name of a folder, and so that it cannot leave its own."""
    if not run_id:
        raise ValueError("run_id: a name is needed")
    return quote(run_id, safe="").replace("%", "_").replace(".", "_")


def state(spark: SparkSession, location: str, path: str | None = None) -> State | None:
    """The newest version of a table (or that of one manifest), None where there is none yet. It has a row for each bucket."""
    versions = _versions(spark, location)
    if not versions:
        return None
    rows = spark.read.schema(_MANIFEST).parquet(path or versions[-1][2]).collect()
    runs = {r["bucket"]: r["run"] for r in rows if r["run"] is not None}
    return State(versions[-1][0], runs, rows[0]["buckets"], StructType.fromJson(json.loads(rows[0]["rows_schema"])))


def _rows(spark: SparkSession, location: str, held: State, buckets: list[int]) -> DataFrame:
    """The rows of some buckets; only their folders are listed and read."""
    paths = [f"{location}/data/run={held.runs[b]}/bucket={b}" for b in sorted(buckets) if b in held.runs]
    if not paths:
        return spark.createDataFrame([], held.schema)
    return spark.read.schema(held.schema).parquet(*paths)


def read(spark: SparkSession, location: str) -> DataFrame:
    """The newest state of the table. Columns that came in later are null in older rows."""
    held = state(spark, location)
    if held is None:
        raise ValueError(f"no table at {location}")
    return _rows(spark, location, held, list(held.runs))


def read_before(spark: SparkSession, location: str, run_id: str) -> DataFrame | None:
    """The state before a run if it is in the table already, else the newest one; None where there is none."""
    versions, run = _versions(spark, location), _run_name(run_id)
    earlier = versions[: next((i for i, v in enumerate(versions) if v[1] == run), len(versions))]
    if not earlier:
        return None
    held = state(spark, location, earlier[-1][2])
    return _rows(spark, location, held, list(held.runs))


def lookup(spark: SparkSession, location: str, key: str, value: str) -> DataFrame:
    """The rows of one key: one bucket is read, in which the statistics of the files, sorted by key, leave out the rest."""
    held = state(spark, location)
    if held is None:
        raise ValueError(f"no table at {location}")
    kind = held.schema[key].dataType
    bucket = spark.range(1).select(bucket_of(F.lit(value).cast(kind), held.buckets).alias("b")).first()["b"]
    return _rows(spark, location, held, [bucket]).where(F.col(key) == F.lit(value).cast(kind))


def merge(
    spark: SparkSession,
    location: str,
    incoming: DataFrame,
    run_id: str,
    key: str,
    combine: Callable[[DataFrame, DataFrame], DataFrame],
    buckets: int = BUCKETS,
) -> DataFrame:
    """The table after a run: for each bucket with an incoming key, its rows become combine(stored rows, incoming rows).

    `combine` must work key by key and give one row per key. Stored rows start out with the columns that `combine` gives for
    no stored rows. Incoming rows without a key take no part. A run whose id is in the table already changes nothing; a run
    that failed can be repeated. One run at a time: a manifest that another run wrote meanwhile stops this one. `buckets`
    counts for a new table only. Incoming rows are computed once, into a folder of the run that goes when it is done; the
    touched bucket numbers come to the driver, `buckets` at most.
    """
    run = _run_name(run_id)
    if "bucket" in map(str.lower, incoming.columns):
        raise ValueError("a column called bucket cannot be stored")
    versions = _versions(spark, location)
    if any(r == run for _, r, _ in versions):
        return read(spark, location)
    held = state(spark, location)
    count = held.buckets if held else buckets
    staged = f"{location}/staged/run={run}"
    incoming.where(F.col(key).isNotNull()).write.mode("overwrite").parquet(staged)
    given = spark.read.schema(incoming.schema).parquet(staged)
    marked = bucket_of(F.col(key), count)
    touched = sorted(r["b"] for r in given.select(marked.alias("b")).distinct().collect())
    if held is None:
        columns = combine(given.limit(0), given.limit(0)).schema
        held = State(0, {}, count, columns)
    merged = combine(_rows(spark, location, held, touched), given)
    path = f"{location}/data/run={run}"
    if touched:
        laid = merged.withColumn("bucket", marked).repartition(min(count, len(touched)), "bucket")
        laid.sortWithinPartitions("bucket", key).write.mode("overwrite").partitionBy("bucket").parquet(path)
    after = held.runs | {b: run for b in touched}
    if [v for v in _versions(spark, location)] != versions:
        raise RuntimeError("another run changed the table meanwhile; repeat this one")
    rows = [(b, after.get(b), count, merged.schema.json()) for b in range(count)]
    manifest = spark.createDataFrame(rows, _MANIFEST).coalesce(1)
    manifest.write.mode("overwrite").parquet(f"{location}/manifest/{held.version + 1:012d}-{run}")
    remove(spark, staged)
    return read(spark, location)


def vacuum(spark: SparkSession, location: str, keep: int = 2) -> list[str]:
    """Removes the files of runs that none of the newest `keep` versions names; their names. No run may be at work. Manifests
    stay, as they tell which runs are done."""
    versions = _versions(spark, location)
    named = set()
    for *_, path in versions[-keep:]:
        named |= set(state(spark, location, path).runs.values())
    gone = [n for n in names_in(spark, f"{location}/data") if n.startswith("run=") and n.removeprefix("run=") not in named]
    for name in gone:
        remove(spark, f"{location}/data/{name}")
    return gone
