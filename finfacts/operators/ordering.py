"""Final orders of result rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import Keys, fiscal_sort


def fiscal_order(df: DataFrame, keys: Keys = (), period: str = "period") -> DataFrame:
    """Rows by fiscal year; labels without one come last, as text."""
    return df.orderBy(*keys, *fiscal_sort(period))


def chart_order(df: DataFrame, keys: Keys = (), period: str = "period") -> DataFrame:
    """Rows by the period text."""
    return df.orderBy(*keys, F.col(period).cast("string"))
