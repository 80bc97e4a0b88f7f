"""Metric labels: sheet slots, long-sheet and dashboard predicates, statement rows, line classes, token roles."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import rules as R
from .numbers import ColumnOrName, as_col


def squeeze(text: ColumnOrName) -> Column:
    """Lower case, trimmed, runs of blanks made one space; the pattern runs only on texts that hold more than single spaces."""
    return F.lower(F.trim(R.once(as_col(text), _blanks_squeezed)))


def _blanks_squeezed(text: Column) -> Column:
    return F.when(_holds(text, ("  ", "\t", "\n", "\x0b", "\f", "\r")), F.regexp_replace(text, r"\s+", " ")).otherwise(text)


def clean_metric_label(label: ColumnOrName) -> Column:
    """A label without byte-order mark, enclosing quotes or a trailing fiscal year."""
    text = F.trim(F.regexp_replace(F.regexp_replace(as_col(label), "^﻿", ""), " ", " "))
    text = F.regexp_replace(text, r"""^"\s*(.*?)\s*"$|^'\s*(.*?)\s*'$""", "$1$2")
    return F.trim(F.regexp_replace(text, r"(?i)\s*\(?\s*FY\s*(19|20)[0-9]{2}\s*\)?$", ""))


def classify_metric(label: ColumnOrName, clean: bool = True) -> Column:
    """Pivot slot of a sheet label, NULL when no rule knows it."""
    text = clean_metric_label(label) if clean else as_col(label)
    return R.first_match(squeeze(text), R.SLOT_RULES)


def ebitda_strength(header: ColumnOrName) -> Column:
    """0 to 4: how surely a header names EBITDA."""
    return R.first_match(F.lower(F.trim(as_col(header))), R.EBITDA_STRENGTH_RULES, "0").cast("int")


def rescue_points(header: ColumnOrName) -> Column:
    """Points of a header for the EBITDA rescue, before the row bonus."""
    text = squeeze(F.regexp_replace(as_col(header), " ", " "))

    def points_of(low: Column) -> Column:
        return reduce(lambda a, b: a + b, [F.when(R.match_any(low, [alt]), points).otherwise(0) for points, alt in R.RESCUE_POINTS])

    return R.once(text, points_of)


def metric_slug(label: ColumnOrName) -> Column:
    return F.regexp_replace(F.lower(F.trim(F.coalesce(as_col(label), F.lit("")))), r"\s+", "_")


def is_operating_revenue(label: ColumnOrName) -> Column:
    return R.match_any(metric_slug(label), R.LONG_OPERATING_REVENUE)


def _lower(label: ColumnOrName) -> Column:
    return F.lower(F.coalesce(as_col(label), F.lit("")))


def is_net_profit(label: ColumnOrName) -> Column:
    return R.match_any(_lower(label), R.LONG_NET_PROFIT)


def is_total_expenses(label: ColumnOrName) -> Column:
    return R.match_any(_lower(label), R.LONG_TOTAL_EXPENSES)


def is_total_income(label: ColumnOrName) -> Column:
    return R.match_any(_lower(label), R.LONG_TOTAL_INCOME)


def is_other_income_label(label: ColumnOrName) -> Column:
    return R.match_any(_lower(label), R.LONG_OTHER_INCOME)


def dashboard_class(label: ColumnOrName) -> Column:
    """``other_income``, ``expense``, ``core_revenue`` or NULL; EBITDA counts as expense."""
    return R.first_match(F.trim(_lower(label)), R.DASHBOARD_CLASSES)


def is_core_revenue(label: ColumnOrName) -> Column:
    return F.coalesce(dashboard_class(label) == "core_revenue", F.lit(False))


def is_expense(label: ColumnOrName) -> Column:
    return F.coalesce(dashboard_class(label) == "expense", F.lit(False))


def is_other_income(label: ColumnOrName) -> Column:
    return F.coalesce(dashboard_class(label) == "other_income", F.lit(False))


def metric_from_row(text: ColumnOrName) -> Column:
    """Metric family of a statement row by its words, NULL for rejected or unknown rows."""
    return R.once(squeeze(text), metric_from_squeezed)


def metric_from_squeezed(low: Column) -> Column:
    """:func:`metric_from_row` of a text that is lower case with single blanks already."""
    found = F.coalesce(R.first_match(low, R.ROW_METRIC_RULES), R.first_match(low, R.ROW_ALIAS_RULES))
    return F.when(~R.match_any(low, R.ROW_REJECT), found)


def clean_label(text: ColumnOrName) -> Column:
    """Lower case letters and single spaces only, text in parentheses dropped."""
    low = F.regexp_replace(F.lower(F.coalesce(as_col(text), F.lit(""))), r"\(.*?\)", "")
    return F.trim(F.regexp_replace(low, "[^a-z]+", " "))


def is_revenue_row(text: ColumnOrName) -> Column:
    return R.match_any(clean_label(text), R.REVENUE_ROW)


def revenue_priority(text: ColumnOrName) -> Column:
    """Rank of the first revenue phrase a row holds, 999 when it holds none."""
    low = F.lower(F.coalesce(as_col(text), F.lit("")))
    chain = None
    for rank, phrase in enumerate(R.REVENUE_PRIORITY):
        test = low.contains(phrase)
        chain = F.when(test, rank) if chain is None else chain.when(test, rank)
    return chain.otherwise(R.REVENUE_NO_PRIORITY)


def revenue_boost(first_cell: ColumnOrName, row_text: ColumnOrName) -> Column:
    """1 when the row text starts with a revenue phrase or its first cell holds one."""
    low, first = squeeze(row_text), F.lower(F.trim(F.coalesce(as_col(first_cell), F.lit(""))))
    tests = [low.startswith(k) | first.contains(k) for k in R.REVENUE_KEYS]
    return F.when(reduce(lambda a, b: a | b, tests), 1).otherwise(0)


def line_class(text: ColumnOrName) -> Column:
    """``revenue``, ``expense``, ``profit`` or ``other`` for one statement line."""
    return R.first_match(squeeze(F.coalesce(as_col(text), F.lit(""))), R.LINE_CLASS_RULES, "other")


def token_role(text: ColumnOrName) -> Column:
    """``YEAR``, ``VALUE``, ``METRIC`` or ``O`` for one token."""
    low = F.trim(F.regexp_replace(F.lower(F.trim(F.coalesce(as_col(text), F.lit("")))), "₹", ""))
    compact = F.regexp_replace(low, r"[,\s]", "")
    return (
        F.when(low.rlike(r"fy\s*20[0-9]{2}|^20[0-9]{2}$|^fy\s*[0-9]{2}$"), "YEAR")
        .when(compact.rlike(r"^[0-9().\-]+$") & compact.rlike(r"[0-9]{3}"), "VALUE")
        .when(R.match_any(low, R.TOKEN_METRIC_WORDS), "METRIC")
        .otherwise("O")
    )


def clean_line(text: ColumnOrName) -> Column:
    """A line without rupee marks, blanks squeezed; patterns run only on lines that hold what they look for."""
    out = F.replace(as_col(text), F.lit("₹"), F.lit(""))
    out = R.once(out, lambda t: F.when(
        _holds(t, ("rs", "Rs", "RS", "rS")), F.regexp_replace(F.regexp_replace(t, r"(?i)rs\.\s*", ""), r"(?i)\brs\b\s*", "")
    ).otherwise(t))
    return F.trim(R.once(out, _blanks_squeezed))


def _holds(text: Column, words: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, [text.contains(w) for w in words])


def fix_typos(text: ColumnOrName) -> Column:
    """Lower case with the known misspellings put right."""
    out = F.lower(as_col(text))
    for wrong, right in R.TYPOS:
        out = F.regexp_replace(out, wrong, right)
    return out
