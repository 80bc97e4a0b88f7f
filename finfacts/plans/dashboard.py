"""The ratio dashboard: facts or sheets to every ratio of every company and period."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators.filters import DASHBOARD_COLUMNS, period_contains_years, period_overlaps, valid_facts
from ..operators.frames import Keys
from ..operators.pivot import enrich, pivot_facts, pivot_wide
from ..operators.ratios import ratio_columns, yoy_columns


def dashboard_of_pivot(pivoted: DataFrame, keys: Keys, profile: str,
                       years: tuple[int, int] | None = None) -> DataFrame:
    """All ratios and both growth columns of a pivoted frame."""
    if years and profile == "server":
        pivoted = period_contains_years(pivoted, *years)
    out = enrich(pivoted, profile).withColumns(
        yoy_columns(keys, "label" if profile == "server" else "fiscal")
    )
    exprs = ratio_columns(profile)
    out = out.select(*keys, *[exprs[c].alias(c) if c in exprs else c for c in DASHBOARD_COLUMNS])
    return period_overlaps(out, *years) if years and profile == "sheet" else out


def ratio_dashboard(df: DataFrame, keys: Keys = ("company",), profile: str = "server",
                    years: tuple[int, int] | None = None, period: str = "period",
                    metric: str = "metric", value: str = "value") -> DataFrame:
    """Every ratio per (keys, period).

    ``server``: valid facts, largest value per metric family, periods ordered as text, range first.
    ``sheet``: free labels, cells added up, fiscal order, range last.
    One scan and two exchanges: the pivot's on (keys, period) and the growth window's on keys.
    """
    if profile == "server":
        pivoted = pivot_facts(valid_facts(df), keys, "max", period, metric, value)
    else:
        pivoted = pivot_facts(df, keys, "sum", period, metric, value)
    return dashboard_of_pivot(pivoted, keys, profile, years)


def wide_dashboard(df: DataFrame, period_col: str, keys: Keys = (),
                   years: tuple[int, int] | None = None) -> DataFrame:
    """The sheet dashboard of a wide sheet."""
    return dashboard_of_pivot(pivot_wide(df, period_col, keys), keys, "sheet", years)
