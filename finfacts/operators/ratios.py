"""Ratio formulas on the enriched period frame, in a ``server`` and a ``sheet`` profile."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import js_round, safe_div
from .frames import Keys, keyed, timeline
from .filters import period_contains_years, period_overlaps, valid_facts


def _pct(num: Column, den: Column, digits: int = 2) -> Column:
    return js_round(safe_div(F.lit(100.0) * num, den), digits)


def _days(num: Column, den: Column, digits: int) -> Column:
    return js_round(safe_div(F.lit(365.0) * num, den), digits)


def ratio_columns(profile: str = "server") -> dict[str, Column]:
    """Every ratio as a Column over an enriched frame, by output name."""
    c = F.col
    sheet = profile == "sheet"
    net_base = F.coalesce(c("total_income"), c("revenue")) if sheet else c("revenue")
    held = (lambda name: c(name)) if sheet else (lambda name: F.coalesce(c(name), F.lit(0.0)))
    day_digits = 2 if sheet else 1
    eps = safe_div(c("net_income"), c("shares"))
    pe = safe_div(c("share_price") * c("shares"), c("net_income"))
    if sheet:
        eps = F.coalesce(c("reported_eps"), eps)
        pe = F.coalesce(pe, safe_div(c("share_price"), c("reported_eps")))
    return {
        "gross_profit": js_round(c("gross_profit_base"), 2),
        "gross_margin_pct": _pct(c("gross_profit_base"), c("revenue")),
        "operating_margin_pct": _pct(c("op_for_margin"), c("revenue")),
        "ebitda_amount": c("ebitda_amount"),
        "ebitda_margin_pct": _pct(c("ebitda_amount"), c("revenue")),
        "net_profit_margin_pct": _pct(c("net_income"), net_base),
        "roe_pct": _pct(c("net_income"), c("equity")),
        "roa_pct": _pct(c("net_income"), c("total_assets")),
        "roce_pct": _pct(c("ebit"), c("capital_employed")),
        "current_ratio": js_round(safe_div(c("current_assets"), c("current_liabilities")), 3),
        "quick_ratio": js_round(
            safe_div(c("current_assets") - F.coalesce(c("inventory"), F.lit(0.0)), c("current_liabilities")), 3
        ),
        "debt_to_equity": js_round(safe_div(c("total_debt"), c("equity")), 3),
        "interest_coverage": js_round(safe_div(c("ebit"), c("interest_expense")), 3),
        "asset_turnover": js_round(safe_div(c("revenue"), c("total_assets")), 3),
        "inventory_days": _days(held("inventory"), c("cogs"), day_digits),
        "receivable_days": _days(held("receivables"), c("revenue"), day_digits),
        "payable_days": _days(held("payables"), c("cogs"), day_digits),
        "eps": js_round(eps, 4),
        "pe_ratio": js_round(pe, 2),
    }


def ratios(df: DataFrame, keys: Keys = (), profile: str = "server", names: list[str] | None = None) -> DataFrame:
    """Selected ratios (all by default) of an enriched frame in one projection."""
    columns = ratio_columns(profile)
    picked = names or list(columns)
    return df.select(*keys, "period", *[columns[n].alias(n) for n in picked])


def yoy_columns(keys: Keys = (), order: str = "fiscal") -> dict[str, Column]:
    """Growth on the previous period: revenue on its own base, net income on the absolute base."""
    w = timeline(keys) if order == "fiscal" else keyed(keys).orderBy("period")
    prev_rev, prev_net = F.lag("revenue").over(w), F.lag("net_income").over(w)
    base = F.abs(prev_net)
    if order == "fiscal":
        base = F.when(base > 1e-9, base)
    return {
        "yoy_revenue_growth_pct": _pct(F.col("revenue") - prev_rev, prev_rev),
        "yoy_net_income_growth_pct": _pct(F.col("net_income") - prev_net, base),
    }


def yoy(df: DataFrame, keys: Keys = (), order: str = "fiscal", years: tuple[int, int] | None = None,
        range_first: bool | None = None) -> DataFrame:
    """Add both growth columns to a period frame.

    ``order="label"`` sorts periods as text and applies the year range before the growth is taken;
    ``order="fiscal"`` sorts by fiscal year and applies it after.  ``range_first`` overrides that.
    """
    if range_first is None:
        range_first = order == "label"
    keep = period_contains_years if order == "label" else period_overlaps
    if years and range_first:
        df = keep(df, *years)
    out = df.withColumns(yoy_columns(keys, order))
    return keep(out, *years) if years and not range_first else out


def profit_margin(df: DataFrame, keys: Keys = ()) -> DataFrame:
    """Largest of net income, operating income and EBITDA as % of revenue of valid facts, where revenue is above 0."""
    revenue = F.max(F.when(F.col("metric") == "revenue", F.col("value"))).alias("_revenue")
    profit = F.max(
        F.when(F.col("metric").isin("net_income", "operating_income", "ebitda"), F.col("value"))
    ).alias("_profit")
    out = valid_facts(df).groupBy(*keys, "period").agg(revenue, profit).where(F.col("_revenue") > 0)
    return out.select(*keys, "period", _pct(F.col("_profit"), F.col("_revenue")).alias("profit_margin_pct"))
