"""First-seen rules on arrays that are already nested in a row.

The arrays are those of one page or of one store's record, so these rules need no shuffle at all.
"""

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate `value` once per row and use it several times in `body`."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def cut(arr: Column, n: int | None) -> Column:
    """The first `n` elements; all of them for None."""
    return arr if n is None else F.slice(arr, 1, n)


def keep_first_by(arr: Column, key: Callable[[Column], Column]) -> Column:
    """Drop elements whose key is null or was seen before; order is kept.

    Keys are sorted with their places and compared with the one before, so the time grows as that of a sort.
    """

    def firsts(s: Column) -> Column:
        places = F.filter(s, lambda k, i: k["key"].isNotNull() & ((i == 0) | ~F.get(s, i - 1)["key"].eqNullSafe(k["key"])))
        return F.sort_array(F.transform(places, lambda k: k["at"]))

    def kept(items: Column) -> Column:
        keyed = F.sort_array(F.transform(items, lambda x, i: F.struct(key(x).alias("key"), i.alias("at"))))
        return F.transform(let(keyed, firsts), lambda i: F.get(items, i))

    return let(arr, kept)


def without(arr: Column, key: Callable[[Column], Column], others: Column) -> Column:
    """The elements whose key is none of `others` (keys); of elements with one key the first, and none without a key."""

    def kept(items: Column) -> Column:
        before = F.transform(others, lambda k: F.struct(k.alias("key"), F.lit(-1).alias("at")))
        own = F.transform(items, lambda x, i: F.struct(key(x).alias("key"), i.alias("at")))
        first = F.filter(keep_first_by(F.concat(before, own), lambda k: k["key"]), lambda k: k["at"] >= 0)
        return F.transform(first, lambda k: F.get(items, k["at"]))

    return let(arr, kept)


def empty(ddl: str) -> Column:
    """Empty array of the given element type."""
    return F.from_json(F.lit("[]"), f"ARRAY<{ddl}>")


def or_empty(arr: Column, ddl: str) -> Column:
    return F.coalesce(arr, empty(ddl))


def size0(arr: Column) -> Column:
    """Number of elements, zero for null."""
    return F.coalesce(F.greatest(F.size(arr), F.lit(0)), F.lit(0))
