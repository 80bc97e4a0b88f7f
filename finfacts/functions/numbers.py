"""Rounding, safe division, exact sums and number parsing."""

from __future__ import annotations

from pyspark.sql import Column, WindowSpec
from pyspark.sql import functions as F

ColumnOrName = Column | str


def as_col(c: ColumnOrName) -> Column:
    return F.col(c) if isinstance(c, str) else c


#: Doubles from here on have no fraction.
WHOLE = 4503599627370496.0
#: Doubles from here on are added as doubles; they have no six decimals to keep.
HUGE = 1e24


def zero() -> Column:
    return F.lit(0.0)


def js_round(value: ColumnOrName, digits: int = 0) -> Column:
    """Round half up on doubles: ``floor(x * 10^n + 0.5) / 10^n``."""
    scale = float(10**digits)
    scaled = as_col(value) * F.lit(scale)
    # From 2^52 on a double is whole already; floor gives a bigint, which cannot hold the largest ones.
    return F.when(F.abs(scaled) < WHOLE, F.floor(scaled + F.lit(0.5)).cast("double") / F.lit(scale)).otherwise(as_col(value))


def round_digits(metric: str) -> int:
    """Digits kept for a ratio column: 4 for EPS, 3 for ratios and turnover, else 2."""
    if metric == "eps":
        return 4
    if metric.endswith("_pct") or "margin" in metric or metric.startswith("yoy_"):
        return 2
    if "ratio" in metric or "turnover" in metric:
        return 3
    return 2


def round_for(metric: str, value: ColumnOrName) -> Column:
    return js_round(value, round_digits(metric))


def safe_div(num: ColumnOrName, den: ColumnOrName) -> Column:
    """``num / den`` on doubles, NULL when the divisor is zero or missing."""
    return F.try_divide(as_col(num), as_col(den))


def number_or_zero(c: ColumnOrName) -> Column:
    """Numeric reading of a cell, 0 when missing or unreadable."""
    return F.coalesce(as_col(c).try_cast("double"), F.lit(0.0))


def exact_addends(c: ColumnOrName) -> tuple[Column, Column, Column]:
    """What :func:`exact_total` puts together once each is summed: the value as a decimal, what that leaves, and huge values."""
    col = as_col(c).cast("double")
    small = F.when(F.abs(col) < HUGE, col)
    whole = small.cast("decimal(32,6)")
    rest = ((small - whole.cast("double")) * 1e6).cast("decimal(32,6)")
    return whole, rest, F.when(~(F.abs(col) < HUGE), col)


def exact_total(whole: Column, rest: Column, huge: Column) -> Column:
    """The sums of :func:`exact_addends` as one double."""
    exact = whole.cast("double") + rest.cast("double") / 1e6
    return F.when(huge.isNull(), exact).otherwise(huge + F.coalesce(exact, zero()))


def exact_sum(c: ColumnOrName, over: WindowSpec | None = None) -> Column:
    """Sum whose result does not depend on partition order: added as decimals, returned as double.

    What six decimals leave of an addend is added up apart, to twelve decimals.  Values of 1e24 and more, infinity and
    NaN are added as doubles.  With ``over`` it is a sum over a window.
    """
    sums = [F.sum(p) for p in exact_addends(c)]
    return exact_total(*[s if over is None else s.over(over) for s in sums])


def exact_mean(c: ColumnOrName, over: WindowSpec | None = None) -> Column:
    """Mean of the non-null values, order independent like :func:`exact_sum`."""
    col = as_col(c)
    n = F.count(col)
    return safe_div(exact_sum(col, over), (n if over is None else n.over(over)).cast("double"))


# Marks stripped from amounts, and the shape of a numeric prefix.
CURRENCY_MARKS = "₹$€£¥"
LEADING_NUMBER = r"^[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?"


def leading_double(text: Column) -> Column:
    """Longest numeric prefix of a text as double, NULL when there is none."""
    return F.regexp_extract(text, LEADING_NUMBER, 0).try_cast("double")


def parse_ledger_number(cell: ColumnOrName) -> Column:
    """Statement amounts: ``(x)`` is negative, everything but digits, dots and minus signs is dropped.

    What is left must be one number, otherwise NULL.
    """
    text = F.trim(as_col(cell).cast("string"))
    text = F.regexp_replace(text, r"(?s)^\((.*)\)$", "-$1")
    return F.regexp_replace(text, r"[^0-9.\-]", "").try_cast("double")


def parse_sheet_number(cell: ColumnOrName) -> Column:
    """Spreadsheet cells: ``(x)`` is negative, marks, blanks, ``Rs.`` and commas dropped, then the numeric prefix.

    A cell with no numeric prefix is read from its digits alone.
    """
    text = F.regexp_replace(as_col(cell).cast("string"), r"(?s)^[\s\u00a0]*\((.*)\)[\s\u00a0]*$", "-$1")
    text = F.regexp_replace(text, f"[{CURRENCY_MARKS},\\s\\u00a0]", "")
    text = F.regexp_replace(F.regexp_replace(text, r"(?i)^(-?)rs\.?", "$1"), "^--", "")
    return F.coalesce(leading_double(text), leading_double(F.regexp_replace(text, r"[^0-9.\-]", "")))


def parse_dashboard_number(cell: ColumnOrName) -> Column:
    """Dashboard cells: commas, marks and blanks dropped, numeric prefix, 0 when unreadable."""
    text = F.regexp_replace(as_col(cell).cast("string"), f"[,{CURRENCY_MARKS}\\s]", "")
    return F.coalesce(leading_double(text), F.lit(0.0))


def parse_plain_number(cell: ColumnOrName) -> Column:
    """Numeric prefix after dropping commas, NULL when there is none."""
    return leading_double(F.ltrim(F.regexp_replace(as_col(cell).cast("string"), ",", "")))


def parse_digits_number(cell: ColumnOrName) -> Column:
    """Keep digits, dots and minus signs only, then the numeric prefix."""
    return leading_double(F.regexp_replace(as_col(cell).cast("string"), r"[^0-9.\-]", ""))


_STYLES = {
    "ledger": parse_ledger_number,
    "sheet": parse_sheet_number,
    "dashboard": parse_dashboard_number,
    "plain": parse_plain_number,
    "digits": parse_digits_number,
}


def parse_number(cell: ColumnOrName, style: str = "sheet") -> Column:
    """Parse an amount in one of the styles ``ledger``, ``sheet``, ``dashboard``, ``plain`` or ``digits``."""
    return _STYLES[style](cell)


def coerce_cell(cell: ColumnOrName) -> Column:
    """A sheet cell as a number if all of it is one once marks, commas, ``Rs.`` and blanks are gone, else NULL."""
    text = F.regexp_replace(F.trim(as_col(cell).cast("string")), f"[,{CURRENCY_MARKS}]", "")
    text = F.regexp_replace(F.regexp_replace(text, r"(?i)^rs\.?\s*", ""), r"\s+", "")
    return F.when(text.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"), text.try_cast("double"))
