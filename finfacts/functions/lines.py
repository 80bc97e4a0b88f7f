"""Numbers inside free text lines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import rules as R
from .money import unit_multiplier
from .numbers import ColumnOrName, as_col


def line_year(text: ColumnOrName) -> Column:
    """First 20xx year of a line."""
    return F.nullif(F.regexp_extract(as_col(text), r"(20[0-9]{2})", 1), F.lit("")).cast("int")


def line_integers(text: ColumnOrName) -> Column:
    """All integers of a line in order, commas dropped (array of bigint)."""
    found = F.regexp_extract_all(as_col(text), F.lit(r"([0-9][0-9,]*)"), F.lit(1))
    return F.filter(
        F.transform(found, lambda n: F.regexp_replace(n, ",", "").try_cast("bigint")), lambda n: n.isNotNull()
    )


def value_of_integers(numbers: ColumnOrName, scale: ColumnOrName) -> Column:
    """Amount among a line's integers: the largest that is no year, 1000 or more, or any when scaled."""
    n, factor = as_col(numbers), as_col(scale)
    amount = F.array_max(F.filter(n, lambda x: ~x.between(1900, 2100)))
    best = F.coalesce(amount, F.array_max(n))
    scaled = F.rint(best.cast("double") * factor).cast("bigint")
    return F.when(factor != 1.0, scaled).when(best >= 1000, best)


def line_value(text: ColumnOrName) -> Column:
    """Amount of a line: largest number that is no year, at least 1000, or scaled when a unit is named."""
    return value_of_integers(line_integers(text), unit_multiplier(text))


def tokens_without_year(numbers: ColumnOrName, year: ColumnOrName) -> Column:
    """Integers in order, without the first one that equals ``year``."""
    n = as_col(numbers)
    at = F.coalesce(F.array_position(n, as_col(year).cast("bigint")), F.lit(0)).cast("int")
    return F.filter(n, lambda x, i: i != at - 1)


def amount_tokens(text: ColumnOrName, year: ColumnOrName) -> Column:
    """Integers of a line in order, without the first one that equals ``year``."""
    return tokens_without_year(line_integers(text), year)


def first_large(tokens: ColumnOrName, minimum: int = 1000) -> Column:
    """First amount of at least ``minimum`` when the line holds three or more of them."""
    large = F.filter(as_col(tokens), lambda n: n >= minimum)
    return F.when(F.size(large) >= 3, F.element_at(large, 1))


def parse_wide_line(raw: ColumnOrName) -> Column:
    """Struct of a ``year n n n n [n] [eps]`` line, NULL when the line has another shape.

    Five amounts are revenue, other income, total income, expenses and profit; with four, total
    income is the sum of the first two.  A last amount under 500 is EPS.
    """
    text = F.trim(as_col(raw))
    year = F.nullif(F.regexp_extract(text, r"^([0-9]{4})\s+\S", 1), F.lit("")).cast("int")
    tokens = F.split(F.regexp_replace(text, r"^[0-9]{4}\s+", ""), r"\s+")
    clean = F.transform(tokens, lambda t: F.regexp_replace(t, ",", ""))
    amounts = F.transform(F.filter(clean, lambda t: t.rlike(r"^[0-9]+(\.[0-9]+)?$")), lambda t: t.cast("double"))
    has_eps = F.element_at(amounts, -1) < 500
    kept = F.when(has_eps, F.slice(amounts, 1, F.size(amounts) - 1)).otherwise(amounts)

    def nth(i: int) -> Column:
        return F.get(kept, i - 1)

    five = F.size(kept) >= 5
    return F.when(
        year.between(1990, 2100) & (F.size(amounts) >= 4) & (F.size(kept) >= 4),
        F.struct(
            year.alias("year"),
            nth(1).alias("revenue"),
            nth(2).alias("other_income"),
            F.when(five, nth(3)).otherwise(nth(1) + nth(2)).alias("total_income"),
            F.when(five, nth(4)).otherwise(nth(3)).alias("total_expenses"),
            F.when(five, nth(5)).otherwise(nth(4)).alias("net_profit"),
            F.when(has_eps, F.element_at(amounts, -1)).alias("eps"),
        ),
    )


def plain_amount(cell: ColumnOrName) -> Column:
    """True when a cell's text is an amount and no share, ratio or word."""
    text = F.lower(F.trim(F.coalesce(as_col(cell), F.lit(""))))
    letters = F.regexp_replace(text, r"[,\s₹$€£()\-+]", "").rlike("[a-z]")
    return ~R.match_any(text, R.NOT_AN_AMOUNT) & ~letters


def large_enough(value: ColumnOrName, metric: ColumnOrName) -> Column:
    """1000 or more; EPS only has to be above 0."""
    v = as_col(value)
    return F.when(as_col(metric) == "eps", v > 0).otherwise(v >= 1000)


def valid_amount(cell: ColumnOrName, value: ColumnOrName, metric: ColumnOrName) -> Column:
    """True when a cell holds an amount of a statement: no share, ratio or word; 1000 or more (EPS: above 0)."""
    return F.coalesce(plain_amount(cell) & large_enough(value, metric), F.lit(False))
