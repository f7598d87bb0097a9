"""Many-to-one joins in which one key may hold a large share of the rows."""

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def lookup_join(rows: DataFrame, table: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join `rows` to `table`, which has one row per key.

    The adaptive skew join splits a hot key only between two shuffles made for the join itself.
    A table that was just grouped by the same keys would be joined as it lies, and a hot key
    would stay in one task. The extra key, a hash of the others, makes Spark shuffle the (small)
    grouped table once more, so that any hot key of `rows` can be split. Small tables are still
    broadcast by their size, in which case `rows` is not moved at all. Rows without a key match
    nothing; their mark comes from the whole row, so that they do not meet in one task either.
    """
    mark = F.xxhash64(*keys)
    keyless = reduce(lambda a, b: a | b, [F.col(k).isNull() for k in keys])
    plain = [c for c, kind in rows.dtypes if "map<" not in kind and "variant" not in kind]
    marked = rows.withColumn("_mark", F.when(keyless, F.xxhash64(*plain)).otherwise(mark))
    return marked.join(table.withColumn("_mark", mark), [*keys, "_mark"], how).drop("_mark")
