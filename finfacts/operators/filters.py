"""Row filters and projections over facts, sheets and ratio rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import lines, periods
from ..functions.rules import VALID_LEVELS
from .frames import Keys, sort_struct, top_n

# Columns shown per ratio kind; "all" is the whole dashboard.
KIND_COLUMNS: dict[str, tuple[str, ...]] = {
    "gross_profit": ("period", "gross_profit"),
    "gross_margin": ("period", "gross_margin_pct"),
    "operating_margin": ("period", "operating_margin_pct"),
    "ebitda_margin": ("period", "ebitda_margin_pct"),
    "ebitda_absolute": ("period", "ebitda_amount"),
    "net_margin": ("period", "net_profit_margin_pct"),
    "yoy": ("period", "revenue", "net_income", "yoy_revenue_growth_pct", "yoy_net_income_growth_pct"),
    "roe": ("period", "roe_pct"),
    "roa": ("period", "roa_pct"),
    "roce": ("period", "roce_pct"),
    "current_ratio": ("period", "current_ratio"),
    "quick_ratio": ("period", "quick_ratio"),
    "debt_to_equity": ("period", "debt_to_equity"),
    "interest_coverage": ("period", "interest_coverage"),
    "asset_turnover": ("period", "asset_turnover"),
    "inventory_days": ("period", "inventory_days"),
    "receivable_days": ("period", "receivable_days"),
    "payable_days": ("period", "payable_days"),
    "eps": ("period", "eps"),
    "pe": ("period", "pe_ratio"),
}
DASHBOARD_COLUMNS = (
    "period", "revenue", "net_income", "ebitda_amount", "gross_margin_pct", "operating_margin_pct",
    "ebitda_margin_pct", "net_profit_margin_pct", "roe_pct", "roa_pct", "roce_pct", "current_ratio", "quick_ratio",
    "debt_to_equity", "interest_coverage", "asset_turnover", "inventory_days", "receivable_days", "payable_days",
    "eps", "pe_ratio", "yoy_revenue_growth_pct", "yoy_net_income_growth_pct", "gross_profit",
)
UNGATED_METHODS = ("pdf_image_fallback", "pdf_row_parser")


def valid_facts(df: DataFrame) -> DataFrame:
    """Facts fit for queries: level consolidated, standalone or line, and marked valid."""
    return df.where(F.col("level").isin(*VALID_LEVELS) & F.col("is_valid"))


def metric_series(df: DataFrame, metrics: Sequence[str], alias: str = "value", keys: Keys = (),
                  ordered: bool = True) -> DataFrame:
    """Period and value of a metric family over valid facts, by period unless ``ordered`` is off."""
    out = valid_facts(df).where(F.col("metric").isin(*metrics)).select(*keys, "period", F.col("value").alias(alias))
    return out.orderBy(*keys, "period") if ordered else out


def consolidated_metric(df: DataFrame, metric: str = "revenue", company: str | None = None) -> DataFrame:
    """Valid consolidated facts of one metric, of one company if named."""
    out = df.where((F.col("metric") == metric) & (F.col("level") == "consolidated") & F.col("is_valid"))
    return out if company is None else out.where(F.col("company") == company)


def period_contains_years(df: DataFrame, lo: int, hi: int, period: str = "period") -> DataFrame:
    return df.where(periods.contains_years(period, lo, hi))


def period_overlaps(df: DataFrame, lo: int, hi: int, period: str = "period") -> DataFrame:
    return df.where(periods.overlaps_years(period, lo, hi))


def single_period(df: DataFrame, year: int, keys: Keys = (), period: str = "period") -> DataFrame:
    """Per key, the row of the first period in fiscal order whose label holds the year."""
    hits = df.where(F.col(period).contains(str(year)))
    row = F.min_by(F.struct(*hits.columns), F.struct(*sort_struct(period))).alias("_row")
    return hits.groupBy(*keys).agg(row).where(F.col("_row").isNotNull()).select("_row.*")


def report_year_gate(df: DataFrame, file_name: str = "source_file") -> DataFrame:
    """Keep whole-number periods from 1990 to 2030.

    When the file name holds a year Y only Y-3 to Y+1 stay, except rows of the noisier
    extraction methods.
    """
    year = F.trim("period").try_cast("int")
    report = F.nullif(F.regexp_extract(file_name, r"((?:19|20)[0-9]{2})", 1), F.lit("")).cast("int")
    near = report.isNull() | year.between(report - 3, report + 1)
    return df.where(year.between(1990, 2030) & (near | F.col("extraction_method").isin(*UNGATED_METHODS)))


def amounts_only(df: DataFrame, cell: str, value: str, metric: str = "metric") -> DataFrame:
    """Rows whose cell is a statement amount."""
    return df.where(lines.valid_amount(cell, value, metric))


def kind_columns(kinds: Sequence[str]) -> list[str]:
    """Columns of the requested ratio kinds, each once, in request order."""
    if "all" in kinds:
        return list(DASHBOARD_COLUMNS)
    return list(dict.fromkeys(c for k in kinds for c in KIND_COLUMNS[k]))


def select_kinds(df: DataFrame, kinds: Sequence[str], keys: Keys = ()) -> DataFrame:
    return df.select(*keys, *kind_columns(kinds))


def latest_facts(df: DataFrame, n: int, tie: Sequence[str]) -> DataFrame:
    """Default listing of valid facts, newest period label first; ``tie`` columns fix the order of equals."""
    listing = ("period", "metric", "value", "currency", "company")
    order = [F.col("period").desc(), *[F.col(c).asc() for c in tie]]
    return valid_facts(df).orderBy(*order).limit(n).select(*listing)


def sample_rows(df: DataFrame, n: int, order: Sequence[str]) -> DataFrame:
    """The first ``n`` rows by the ``order`` columns, for a first look."""
    return df.orderBy(*order).limit(n)


def last_periods(df: DataFrame, keys: Keys, n: int, period: str = "period") -> DataFrame:
    """The last ``n`` periods of each key in fiscal order."""
    key = periods.fiscal_key(period)
    return top_n(df, keys, [key.desc_nulls_first(), F.col(period).desc()], n)
