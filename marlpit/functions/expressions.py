"""The expression vocabulary: literals with fixed widths, integer division, casts by SQL type name."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Type names accepted by ``cast_to`` and the Spark types they mean.
TYPE_NAMES = {
    "TINYINT": "tinyint",
    "SMALLINT": "smallint",
    "INT": "int",
    "INTEGER": "bigint",
    "BIGINT": "bigint",
    "FLOAT": "float",
    "DOUBLE": "double",
    "VARCHAR": "string",
    "BOOLEAN": "boolean",
}


def lit(value: bool | int | float | str | None) -> Column:
    """A literal; whole numbers are bigint and fractions double."""
    if isinstance(value, int) and not isinstance(value, bool):
        return F.lit(value).cast("bigint")
    return F.lit(value)


def int_div(a: Column, b: Column) -> Column:
    """Division of whole numbers, cut towards zero; NULL when ``b`` is 0."""
    return F.call_function("div", a, F.nullif(b, F.lit(0).cast("bigint")))


def float_div(a: Column, b: Column) -> Column:
    """Division in double; NULL when ``b`` is 0."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def cast_to(column: Column, type_name: str) -> Column:
    """CAST by type name. Fractions are cut off, not rounded."""
    try:
        return column.cast(TYPE_NAMES[type_name.upper()])
    except KeyError:
        raise ValueError(f"Unknown type: {type_name}") from None


def columns_with_prefix(columns: list[str], prefix: str) -> list[Column]:
    return [F.col(c) for c in columns if c.startswith(prefix)]


def user_aggregate(fold: Callable[[pd.Series], object], returns: str) -> Callable[[Column], Column]:
    """An aggregate of the user's own: ``fold`` turns a group's values, as one Series, into a value of type ``returns``.

    A group's values meet in one task, so built-in aggregates, which are
    combined before the shuffle, are to be preferred where they can say it.
    """
    return F.pandas_udf(fold, returns, F.PandasUDFType.GROUPED_AGG)
