"""Projection, selection, joins, aggregation, ordering, limits and partitioning.

All of them only declare a plan; NULL and NaN rules are those of standard SQL
and are stated where a choice was made.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType

#: How join types may be written, and Spark's name for them.
JOIN_TYPES = {"inner": "inner", "left": "left", "right": "right", "full": "full", "cross": "cross", "semi": "left_semi", "anti": "left_anti"}


def project(df: DataFrame, *exprs: Column | str) -> DataFrame:
    return df.select(*exprs)


def select(df: DataFrame, *predicates: Column) -> DataFrame:
    """Rows for which every predicate is true; unknown counts as false."""
    return df.filter(reduce(Column.__and__, predicates)) if predicates else df


def aggregate(df: DataFrame, keys: Sequence[Column | str], aggs: Sequence[Column], having: Column | None = None) -> DataFrame:
    """Groups by ``keys`` (NULLs are one group) or, without keys, one row over all rows.

    Without ``aggs`` the distinct keys. ``having`` is over the output's columns.
    """
    if not aggs:
        out = df.select(*keys).distinct()
    elif keys:
        out = df.groupBy(*keys).agg(*aggs)
    else:
        out = df.agg(*aggs)
    return out if having is None else out.filter(having)


def two_phase(df: DataFrame, keys: Sequence[str], sums: dict[str, str], salt: int = 16) -> DataFrame:
    """SUM, COUNT and AVG of columns in two declared phases, for keys so hot that one task can't merge their partial rows.

    ``sums`` maps each column to the prefix of its outputs. Counts are summed and
    averages come from sums and counts, so the result equals one phase.
    """
    # the row's number, not its contents: equal rows are dealt out too
    spread = F.pmod(F.monotonically_increasing_id(), F.lit(salt)).alias("_salt")
    part = df.select(*dict.fromkeys([*keys, *sums])).groupBy(*keys, spread).agg(*(a for c, p in sums.items() for a in (F.sum(c).alias(f"{p}_sum"), F.count(c).alias(f"{p}_count"))))
    total = part.groupBy(*keys).agg(*(F.sum(f"{p}_{x}").alias(f"{p}_{x}") for p in sums.values() for x in ("sum", "count")))
    return total.withColumns({f"{p}_avg": F.try_divide(F.col(f"{p}_sum").cast("double"), F.col(f"{p}_count")) for p in sums.values()})


def join(left: DataFrame, right: DataFrame, on: Sequence[tuple[str, str]] = (), how: str = "inner", null_safe: bool = False) -> DataFrame:
    """Equi-join on pairs of column names; without pairs every row matches every row.

    NULL keys match nothing unless ``null_safe``. The output has the left
    columns, then the right ones; a key with one name on both sides comes once.
    Outer joins keep unmatched rows, without pairs those of a side whose other
    side is empty.
    """
    kind = JOIN_TYPES[how.lower()]
    if not on:
        return left.crossJoin(right) if kind in ("inner", "cross") else left.join(right, F.lit(True), kind)
    if kind == "cross":
        kind = "inner"
    if not null_safe and all(a == b for a, b in on):
        return left.join(right, [a for a, _ in on], kind)
    shared = [a for a, b in on if a == b]
    hidden = {a: f"__right_{i}" for i, a in enumerate(shared)}
    other = right.withColumnsRenamed(hidden)
    pairs = [left[a].eqNullSafe(other[hidden.get(b, b)]) if null_safe else left[a] == other[hidden.get(b, b)] for a, b in on]
    out = left.join(other, reduce(Column.__and__, pairs), kind)
    if kind in ("left_semi", "left_anti") or not shared:
        return out
    mine = [F.coalesce(left[c], other[hidden[c]]).alias(c) if c in hidden else left[c] for c in left.columns]
    return out.select(*mine, *(other[c] for c in right.columns if c not in hidden))


def order(df: DataFrame, *keys: tuple[Column | str, bool]) -> DataFrame:
    """Sorts by (key, ascending). NULLs come last either way, NaN just before them."""
    return df.orderBy(*(k for key, asc in keys for k in sort_keys(df, key, asc)))


def sort_keys(df: DataFrame, key: Column | str, ascending: bool = True) -> list[Column]:
    column = F.col(key) if isinstance(key, str) else key
    if ascending:
        return [column.asc_nulls_last()]
    floats = isinstance(df.select(column.alias("k")).schema[0].dataType, (FloatType, DoubleType))
    last = [F.when(column.isNull(), 2).when(F.isnan(column), 1).otherwise(0)] if floats else []
    return [*last, column.desc_nulls_last()]


def limit(df: DataFrame, n: int) -> DataFrame:
    """Any ``n`` rows, or the first ones of ``order``; ``first_rows`` is for those of a table as it is stored."""
    return df.limit(n)


def first_rows(df: DataFrame, n: int) -> DataFrame:
    """The first ``n`` rows of a Parquet scan as they are stored: files by path, rows by their place in the file.

    Spark's own limit takes the rows of whichever tasks come first, and it deals
    files to tasks by size. ``df`` has to be the scan itself, which alone knows these places.
    """
    stored = df.metadataColumn("_metadata")
    path, place = stored.getField("file_path"), stored.getField("row_index")
    # the plus sign isn't escaped in paths, but stands for a blank to url_decode
    path = F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B")))
    # n rows of the same file come before any later one, so those need no comparing
    return df.filter(place < n).orderBy(path, place).limit(n)


def top_k(df: DataFrame, k: int, *keys: tuple[Column | str, bool]) -> DataFrame:
    """The first ``k`` rows in the given order; Spark keeps only ``k`` rows a task."""
    return order(df, *keys).limit(k)


def round_robin(df: DataFrame, n: int) -> DataFrame:
    return df.repartition(n)


def hash_partition(df: DataFrame, n: int, *keys: str) -> DataFrame:
    return df.repartition(n, *keys)


def answers(shards: Sequence[DataFrame], query) -> list[DataFrame]:
    """The same query on every shard, an answer each."""
    return [query(s) for s in shards]


def per_shard(shards: Sequence[DataFrame], query, shard: str | None = None) -> DataFrame:
    """The same query on every shard, the answers one under the other; a column ``shard``, if named, has the shard's number."""
    got = answers(shards, query)
    return reduce(DataFrame.unionByName, got if shard is None else [x.withColumn(shard, F.lit(i)) for i, x in enumerate(got)])
