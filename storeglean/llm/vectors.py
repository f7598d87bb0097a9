"""What the operators on vectors share: usable rows, matrices from Arrow columns, and tiles of queries and rows."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storeglean.llm.common import hash32


def finite(vector: str) -> Column:
    """Whether a vector is there and has neither null nor non-finite components."""
    value = F.forall(F.col(vector), lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return F.coalesce(value, F.lit(False))


def matrix(column: pa.ChunkedArray | pa.Array, kind: type, width: int | None = None) -> np.ndarray:
    """A list column as a matrix, a row each; shorter rows end in zeros. No row may be null."""
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if isinstance(lists, pa.ChunkedArray):  # an empty one
        lists = pa.concat_arrays(lists.chunks) if lists.num_chunks else pa.array([], lists.type)
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(kind, copy=False)
    sizes = np.diff(lists.offsets.to_numpy())
    width = max(int(sizes.max(initial=0)), width or 0)
    if (sizes == width).all():
        return flat.reshape(len(sizes), width)
    out = np.zeros((len(sizes), width), kind)
    row = np.repeat(np.arange(len(sizes)), sizes)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def common_width(*columns: pa.ChunkedArray) -> int:
    """The length of the longest list of several columns."""
    return max((int(np.diff(c.offsets.to_numpy()).max(initial=0)) for col in columns for c in col.chunks), default=0)


def parts_of(n: int, size: int) -> int:
    """The number of parts of some `size` rows each, one at least."""
    return max(1, math.ceil(n / size))


def part(parts: int, *key: str) -> Column:
    """The part, from 0, that a row is in by a hash of its key."""
    return F.shiftright(hash32(*[F.col(k) for k in key]) * parts, 32).cast("int")


def tiles(left: DataFrame, left_part: Column, left_parts: int, right: DataFrame, right_part: Column, right_parts: int):
    """The two sides, cogrouped so that each part of one meets each part of the other in a group of its own.

    A group is as large as two parts, whatever the tables hold; a side is sent once for each part of the other.
    """
    # named anew, as both may come from one table
    a = left.toDF(*left.columns).withColumns({"_left": left_part, "_right": F.explode(F.sequence(F.lit(0), F.lit(right_parts - 1)))})
    b = right.toDF(*right.columns).withColumns({"_right": right_part, "_left": F.explode(F.sequence(F.lit(0), F.lit(left_parts - 1)))})
    return a.groupBy("_left", "_right").cogroup(b.groupBy("_left", "_right"))


def first_places(key: np.ndarray, k: int) -> np.ndarray:
    """In each row the places of the k largest of different keys, largest first."""
    n = key.shape[1]
    if n > k:
        top = np.argpartition(key, n - k, axis=1)[:, n - k :]
        return np.take_along_axis(top, np.argsort(-np.take_along_axis(key, top, 1), axis=1), 1)
    return np.argsort(-key, axis=1)
