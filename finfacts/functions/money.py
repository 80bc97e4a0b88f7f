"""Currencies and units."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import rules as R
from .numbers import ColumnOrName, as_col


def currency_of(text: ColumnOrName, style: str = "statement") -> Column:
    """Currency named by a text.  ``statement`` falls back to USD, ``line`` to NULL."""
    low = F.lower(F.coalesce(as_col(text), F.lit("")))
    if style == "statement":
        return R.first_match(low, R.STATEMENT_CURRENCY_RULES, "USD")
    return R.first_match(low, R.LINE_CURRENCY_RULES)


def currency_symbol(code: ColumnOrName) -> Column:
    """Display symbol of a currency code; unknown codes stay as they are."""
    upper, chain = F.upper(as_col(code)), None
    for iso, symbol in R.CURRENCY_SYMBOLS.items():
        chain = F.when(upper == iso, symbol) if chain is None else chain.when(upper == iso, symbol)
    return chain.otherwise(as_col(code))


def symbol_of_headers(joined_headers: ColumnOrName, first_currency: ColumnOrName) -> Column:
    """Symbol from the joined header text, else from the first currency cell, else the rupee sign."""
    code = F.upper(F.coalesce(as_col(first_currency), F.lit("")))
    by_cell = (
        F.when(code.isin("USD", "EUR", "GBP", "INR"), currency_symbol(code))
        .when(code.isin("RS", "RS."), "₹")
        .when(F.length(code).between(1, 4), code)
        .otherwise("₹")
    )
    return F.coalesce(R.first_match(F.lower(as_col(joined_headers)), R.HEADER_SYMBOL_RULES), by_cell)


def unit_of(text: ColumnOrName) -> Column:
    """Unit named by a table's context, crore when none is."""
    return R.first_match(F.lower(F.coalesce(as_col(text), F.lit(""))), R.UNIT_RULES, "INR_CRORE")


def to_crore(value: ColumnOrName, unit: ColumnOrName) -> Column:
    low, factor = F.lower(as_col(unit)), None
    for name, ratio in R.CRORE_FACTORS.items():
        factor = F.when(low == name, ratio) if factor is None else factor.when(low == name, ratio)
    return as_col(value) * factor.otherwise(1.0)


def unit_multiplier(text: ColumnOrName) -> Column:
    """Factor that turns an amount of the named unit into single currency units."""

    def factor_in(low: Column) -> Column:
        chain = None
        for factor, words in R.UNIT_MULTIPLIERS:
            test = R.match_any(low, words)
            chain = F.when(test, factor) if chain is None else chain.when(test, factor)
        return chain.otherwise(1.0)

    return R.once(F.lower(F.coalesce(as_col(text), F.lit(""))), factor_in)
