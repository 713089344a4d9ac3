"""Small helpers on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame


def beside(df: DataFrame, one: DataFrame) -> DataFrame:
    """``df`` with the columns of a one-row table, as scalar subqueries; null where that has no row."""
    return df.select("*", *(one.select(c).scalar().alias(c) for c in one.columns))
