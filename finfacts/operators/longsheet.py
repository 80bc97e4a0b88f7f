"""Yearly series out of year/metric/value sheets whose ``raw`` text may hold a whole statement line."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import labels
from ..functions.lines import parse_wide_line
from ..functions.numbers import js_round, safe_div
from .frames import Keys, keyed, with_totals

# Which predicate and which field of the wide line give a metric, and which source is tried first.
METRICS = {
    "revenue": (labels.is_operating_revenue, "revenue", "wide"),
    "net_profit": (labels.is_net_profit, "net_profit", "wide"),
    "expenses": (labels.is_total_expenses, "total_expenses", "long"),
    "other_income": (labels.is_other_income_label, "other_income", "long"),
    "total_income": (labels.is_total_income, "total_income", "long"),
}
MIN_WIDE_LINES = 2


def pick_series(df: DataFrame, test: Column, keys: Keys = (), seq: str | None = None) -> DataFrame:
    """Year and value of the rows of one metric whose year and value are numbers."""
    year, value = F.col("year").try_cast("double"), F.col("value").try_cast("double")
    extra = [seq] if seq else []
    rows = df.where(test).select(*keys, year.cast("int").alias("year"), value.alias("value"), *extra)
    return rows.where(F.col("year").isNotNull() & F.col("value").isNotNull())


def wide_lines(df: DataFrame, keys: Keys = (), raw: str = "raw", seq: str = "seq") -> DataFrame:
    """Amounts read from the raw lines, the first readable line per (keys, year)."""
    rows = df.select(*keys, parse_wide_line(raw).alias("_w"), seq).where(F.col("_w").isNotNull())
    first = F.min_by("_w", seq).alias("_w")
    return rows.groupBy(*keys, F.col("_w.year").alias("_year")).agg(first).select(*keys, "_w.*")


def metric_trend(df: DataFrame, metric: str, keys: Keys = (), raw: str = "raw", seq: str = "seq",
                 min_wide_lines: int = MIN_WIDE_LINES) -> DataFrame:
    """Yearly values of a metric.

    Revenue and net profit come from the wide lines when a series has ``min_wide_lines`` of them, else from
    the metric rows.  Expenses, other and total income come from the metric rows when there is one,
    else from the wide lines.
    """
    test, field, prefer = METRICS[metric]
    wide = wide_lines(df, keys, raw, seq).select(
        *keys, "year", F.col(field).alias("value"), F.lit("wide").alias("origin")
    )
    picked = pick_series(df, test("metric"), keys).withColumn("origin", F.lit("long"))
    both = wide.unionByName(picked)
    # Two counts for each key; the rows themselves are not brought together.
    counted = with_totals(both, keys, {
        "_wide": F.count(F.when(F.col("origin") == "wide", 1)), "_long": F.count(F.when(F.col("origin") == "long", 1))})
    n_wide, n_long = F.col("_wide"), F.col("_long")
    if prefer == "wide":
        chosen = F.when(n_wide >= min_wide_lines, "wide").otherwise("long")
    else:
        chosen = F.when(n_long >= 1, "long").when(n_wide >= min_wide_lines, "wide")
    return counted.where(F.col("origin") == chosen).drop("_wide", "_long")


def _enough(lines: DataFrame, keys: Keys) -> DataFrame:
    n = F.count(F.lit(1)).over(keyed(keys))
    return lines.withColumn("_n", n).where(F.col("_n") >= MIN_WIDE_LINES).drop("_n")


def revenue_vs_expenses(df: DataFrame, keys: Keys = (), raw: str = "raw", seq: str = "seq") -> DataFrame:
    """Revenue beside total expenses per year, from the wide lines of series that have two or more."""
    return _enough(wide_lines(df, keys, raw, seq), keys).select(*keys, "year", "revenue", "total_expenses")


def income_shares(df: DataFrame, keys: Keys = (), raw: str = "raw", seq: str = "seq") -> DataFrame:
    """Other income as % of revenue and expenses as % of total income per year, NULL for a zero base."""
    c = F.col
    return _enough(wide_lines(df, keys, raw, seq), keys).select(
        *keys,
        "year",
        js_round(safe_div(c("other_income") * 100.0, c("revenue")), 2).alias("other_income_pct"),
        js_round(safe_div(c("total_expenses") * 100.0, c("total_income")), 2).alias("expense_pct"),
    )


def _share(df: DataFrame, part: Column, whole: Column, keys: Keys, seq: str, names: tuple[str, str, str]) -> DataFrame:
    part_rows = pick_series(df, part, keys, seq)
    last = part_rows.groupBy(*keys, "year").agg(F.max_by("value", seq).alias(names[0]))
    base = pick_series(df, whole, keys, seq).where(F.col("value") != 0).withColumnRenamed("value", names[1])
    out = base.join(last, [*keys, "year"], "inner")
    pct = js_round(safe_div(F.col(names[0]) * 100.0, F.col(names[1])), 2)
    return out.select(*keys, "year", names[0], names[1], pct.alias(names[2]))


def other_income_share(df: DataFrame, keys: Keys = (), seq: str = "seq") -> DataFrame:
    """Other income as % of operating revenue per year; the last other-income row of a year counts."""
    return _share(df, labels.is_other_income_label("metric"), labels.is_operating_revenue("metric"), keys, seq,
                  ("other_income", "revenue", "other_income_pct"))


def expense_share(df: DataFrame, keys: Keys = (), seq: str = "seq") -> DataFrame:
    """Total expenses as % of total income per year; the last expense row of a year counts."""
    return _share(df, labels.is_total_expenses("metric"), labels.is_total_income("metric"), keys, seq,
                  ("total_expenses", "total_income", "expense_pct"))


def patch_ebitda(df: DataFrame, sheet: DataFrame, col: Column, keys: Keys = (), period_col: str = "period",
                 seq: str = "seq") -> DataFrame:
    """Fill the EBITDA amount from a sheet column by period: exact label first, then ignoring case.

    Only keys without a single EBITDA amount are patched.  The sheet is reduced to its first row per
    label and per folded label before it joins, so the join is one to one.
    """
    label = F.trim(F.col(period_col).cast("string"))
    rows = sheet.select(*keys, label.alias("_label"), F.lower(label).alias("_fold"), col.alias("_cell"), seq)
    exact = rows.groupBy(*keys, "_label").agg(F.min_by("_cell", seq).alias("_exact"))
    exact = exact.withColumn("_hit", F.lit(True))
    folded = rows.groupBy(*keys, "_fold").agg(F.min_by("_cell", seq).alias("_folded"))
    has_any = F.count("ebitda_amount").over(keyed(keys)) > 0
    out = df.withColumns(
        {"_label": F.trim("period"), "_fold": F.lower(F.trim("period")), "_has": has_any}
    )
    out = out.join(exact, [*keys, "_label"], "left").join(folded, [*keys, "_fold"], "left")
    found = F.when(F.col("_hit"), F.col("_exact")).otherwise(F.col("_folded"))
    patched = F.when(F.col("_has"), F.col("ebitda_amount")).otherwise(F.coalesce(found, F.col("ebitda_amount")))
    return out.withColumn("ebitda_amount", patched).select(*df.columns)
