"""One row per period: pivots of long facts and wide sheets, and the figures derived from them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import labels
from ..functions import rules as R
from ..functions.numbers import exact_sum, parse_sheet_number
from ..schema import SLOTS
from ..stored import written
from .filters import valid_facts
from .frames import Keys, keyed, rows_with


def numeric_cell(df: DataFrame, name: str) -> Column:
    """A column as double: numbers as they are, text parsed like a sheet cell."""
    if isinstance(df.schema[name].dataType, T.NumericType):
        return F.col(name).cast("double")
    return parse_sheet_number(F.col(name))


def pivot_facts(df: DataFrame, keys: Keys = (), agg: str = "max", period: str = "period", metric: str = "metric",
                value: str = "value") -> DataFrame:
    """Facts to one row per (keys, period).

    ``agg="max"`` takes the largest value of each of 17 metric families by exact metric name.
    ``agg="sum"`` classifies free labels into 22 slots, parses the cells and adds them by slot; what is left, a row
    per slot, becomes columns in a second, small aggregation.  The parsed cells are written once for that (starts Spark
    jobs), since both the labels and the sums read them.
    """
    if agg == "max":
        slots = [
            F.max(F.when(F.col(metric).isin(*names), F.col(value))).alias(slot)
            for slot, names in R.FACT_FAMILIES.items()
        ]
        return df.groupBy(*keys, F.col(period).alias("period")).agg(*slots)
    cells = df.select(
        *keys,
        F.trim(F.col(period).cast("string")).alias("period"),
        F.col(metric).alias("_label"),
        numeric_cell(df, value).alias("_value"),
    )
    by_slot = of_known_label(written(cells, "cells"), "_label", "_slot").groupBy(*keys, "period", "_slot").agg(
        exact_sum("_value").alias("_sum"), F.count("_value").alias("_n"))
    sums = [F.max(F.when(F.col("_slot") == s, F.col("_sum"))).alias(s) for s in SLOTS]
    out = by_slot.groupBy(*keys, "period").agg(*sums, F.sum("_n").alias("_used"))
    # A period without one readable figure is no row.
    return out.where((F.col("period") != "") & (F.col("_used") > 0)).drop("_used")


def of_known_label(df: DataFrame, label: str, slot: str) -> DataFrame:
    """The rows whose label has a pivot slot, with that slot.

    The dozens of patterns run once per distinct label and not once per row; the labels are told apart by a
    partial aggregation.  The dictionary is written first (starts a Spark job), so that Spark picks the join by its size
    before it moves a row, and splits frequent labels where it is too large to be sent around.
    """
    words = df.select(F.col(label).alias("_known")).distinct()
    named = rows_with(words, ["_known"], {"_found": labels.classify_metric("_known")}, ["_found"])
    return df.join(written(named, "labels"), F.col(label) == F.col("_known")).drop("_known").withColumnRenamed("_found", slot)


def header_slot(name: str) -> str | None:
    """Pivot slot of a column name."""
    return R.name_result(" ".join(name.strip().lower().split()), R.SLOT_RULES)


def header_strength(name: str) -> int:
    """How surely a column name means EBITDA, 0 to 4."""
    return int(R.name_result(name.strip().lower(), R.EBITDA_STRENGTH_RULES, "0"))


def best_ebitda_header(names: list[str]) -> str | None:
    """The first column name with the highest EBITDA strength, if that is at least 2."""
    best = max(names, key=header_strength, default=None)
    return best if best is not None and header_strength(best) >= 2 else None


def add_present(parts: list[Column]) -> Column:
    """Sum of the non-null parts, NULL when all are missing."""
    total = reduce(lambda a, b: a + b, [F.coalesce(p, F.lit(0.0)) for p in parts])
    return F.when(reduce(lambda a, b: a | b, [p.isNotNull() for p in parts]), total)


def pivot_wide(df: DataFrame, period_col: str, keys: Keys = ()) -> DataFrame:
    """A wide sheet to the same frame: headers are classified, columns of one slot and rows of one period add up.

    A sheet (key) without any EBITDA value takes the column whose header comes closest to EBITDA.
    """
    headers = [c for c in df.columns if c != period_col and c not in keys]
    by_slot: dict[str, list[str]] = {}
    for h in headers:
        slot = header_slot(h)
        if slot:
            by_slot.setdefault(slot, []).append(h)
    parsed = {
        slot: add_present([numeric_cell(df, f"{h}") for h in names]) for slot, names in by_slot.items()
    }
    fallback = best_ebitda_header(headers)
    cells = df.select(
        *keys,
        F.trim(F.col(period_col).cast("string")).alias("period"),
        *[expr.alias(slot) for slot, expr in parsed.items()],
        *([numeric_cell(df, fallback).alias("_fallback")] if fallback else []),
    ).where(F.col("period") != "")
    sums = [exact_sum(slot).alias(slot) for slot in parsed]
    if fallback:
        sums.append(exact_sum("_fallback").alias("_fallback"))
    out = cells.groupBy(*keys, "period").agg(*sums)
    if fallback:
        own = F.col("ebitda") if "ebitda" in parsed else F.lit(None).cast("double")
        has_own = F.count(own).over(keyed(keys)) > 0
        out = out.withColumn("ebitda", F.when(has_own, own).otherwise(F.col("_fallback")))
    present = set(out.columns)
    slots = [F.col(s) if s in present else F.lit(None).cast("double").alias(s) for s in SLOTS]
    return out.select(*keys, "period", *slots)


def _slot(df: DataFrame, name: str) -> Column:
    return F.col(name) if name in df.columns else F.lit(None).cast("double")


def enrich(df: DataFrame, profile: str = "server") -> DataFrame:
    """Add the derived figures the ratios use.

    ``op_for_margin`` is operating income, else revenue less expenses; ``ebit`` is EBITDA, else operating
    income.  The ``sheet`` profile also derives EBITDA from profit before tax, interest and depreciation and
    falls back to a reported gross profit; capital employed needs both figures there, while the ``server``
    profile reads missing current liabilities as 0.
    """
    op_for_margin = F.coalesce("operating_income", F.col("revenue") - F.col("expenses"))
    if profile == "server":
        return df.withColumns(
            {
                "ebitda_amount": F.col("ebitda"),
                "op_for_margin": op_for_margin,
                "ebit": F.coalesce("ebitda", "operating_income"),
                "gross_profit_base": F.col("revenue") - F.col("cogs"),
                "capital_employed": F.col("total_assets") - F.coalesce("current_liabilities", F.lit(0.0)),
            }
        )
    derived = _slot(df, "pbt") + _slot(df, "interest_expense") + _slot(df, "depreciation_charge")
    ebitda = F.coalesce(F.col("ebitda"), derived)
    return df.withColumns(
        {
            "ebitda_amount": ebitda,
            "op_for_margin": op_for_margin,
            "ebit": F.coalesce(ebitda, F.col("operating_income")),
            "gross_profit_base": F.coalesce(F.col("revenue") - F.col("cogs"), _slot(df, "reported_gross_profit")),
            "capital_employed": F.col("total_assets") - F.col("current_liabilities"),
        }
    )


def compare_metrics(df: DataFrame, keys: Keys = ()) -> DataFrame:
    """Largest revenue and largest expenses (COGS included) per period, of valid facts."""
    return valid_facts(df).groupBy(*keys, "period").agg(
        F.max(F.when(F.col("metric") == "revenue", F.col("value"))).alias("revenue"),
        F.max(F.when(F.col("metric").isin("expenses", "cogs"), F.col("value"))).alias("expenses"),
    )
