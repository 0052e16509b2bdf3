"""Plan text, for people and for tests."""

from __future__ import annotations

import contextlib
import io

from pyspark.sql import DataFrame


def plan_text(df: DataFrame, mode: str = "formatted") -> str:
    """What ``df.explain(mode)`` prints: simple, extended, cost, codegen or formatted."""
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain(mode)
    return out.getvalue()


def explain_rows(df: DataFrame, mode: str = "simple") -> DataFrame:
    """The plan as a table of one row and one column ``plan``."""
    return df.sparkSession.createDataFrame([(plan_text(df, mode),)], "plan string")


def exchanges(df: DataFrame) -> int:
    """The shuffles in the physical plan as first planned."""
    return plan_text(df, "simple").count("Exchange ") - plan_text(df, "simple").count("BroadcastExchange ")
