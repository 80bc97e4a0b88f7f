"""Fiscal period labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numbers import ColumnOrName, as_col
from .rules import once


def _group(text: Column, pattern: str, group: int = 1) -> Column:
    """A regex group of the first match, NULL without any; no group here can be empty.  The text is searched once."""
    return F.get(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), F.lit(0))


def fiscal_key(label: ColumnOrName) -> Column:
    """Sort key of a period label: year after ``FY``, else a stand-alone year, else a leading integer, else NULL."""
    text = F.trim(as_col(label))
    return F.coalesce(
        _group(text, r"(?i)FY\s*((?:19|20)[0-9]{2})"),
        _group(text, r"\b((?:19|20)[0-9]{2})\b"),
        _group(text, r"^([+-]?[0-9]+)"),
    ).try_cast("int")


def period_of(token: ColumnOrName) -> Column:
    """Year a period token ends in: ``FY2021-22`` is 2022, a bare year is itself, ``2021/22`` is 2022."""
    text = F.trim(as_col(token))

    def span_end(pattern: str) -> Column:
        century = F.substring(_group(text, pattern, 1), 1, 2)
        return once(_group(text, pattern, 2), lambda end: F.when(F.length(end) == 2, F.concat(century, end)).otherwise(end))

    return F.coalesce(
        span_end(r"(?i)fy\s*([0-9]{4})[^0-9]+([0-9]{2,4})"),
        _group(text, r"\b((?:19|20)[0-9]{2})\b"),
        span_end(r"([0-9]{4})[^0-9]+([0-9]{2,4})"),
    )


#: Every form :func:`header_year` reads holds one of these; \b is left out, so it may hold them and name no year.
MAY_NAME_YEAR = r"(?i)fy\s*[0-9]{2}|(?:19|20)[0-9]{2}|[0-9]{2}-[0-9]{2}|[0-9]{4}[^0-9]+[0-9]{2}"


def header_year(cell: ColumnOrName) -> Column:
    """Year named by a table header cell: 20xx, ``FY23``, ``22-23``, then :func:`period_of`."""
    low = F.lower(F.trim(as_col(cell)))
    return F.coalesce(
        _group(low, r"\b(20[0-9]{2})\b"),
        F.concat(F.lit("20"), _group(low, r"\bfy\s?([0-9]{2})\b")),
        F.concat(F.lit("20"), _group(low, r"\b[0-9]{2}-([0-9]{2})\b")),
        period_of(cell),
    )


def period_of_fy_cell(cell: ColumnOrName) -> Column:
    """Year of a first-column cell: after ``FY``, else a stand-alone year, else :func:`period_of`."""
    text = F.trim(as_col(cell))
    return F.coalesce(
        _group(text, r"(?i)fy\s*((?:19|20)[0-9]{2})"), _group(text, r"\b((?:19|20)[0-9]{2})\b"), period_of(cell)
    )


def fy_label(label: ColumnOrName) -> Column:
    """``FY `` in front of a bare four-digit year."""
    text = F.trim(as_col(label))
    return F.when(text.rlike(r"^[0-9]{4}$"), F.concat(F.lit("FY "), text)).otherwise(text)


def valid_year(year: ColumnOrName, lo: int = 2000, hi: int = 2100) -> Column:
    """True for an integer year inside the bounds; never NULL."""
    return F.coalesce(F.trim(as_col(year).cast("string")).try_cast("int").between(lo, hi), F.lit(False))


def contains_years(label: ColumnOrName, lo: int, hi: int) -> Column:
    """True when the label text holds any year of the inclusive range."""
    lo, hi = sorted((lo, hi))
    return as_col(label).rlike("|".join(str(y) for y in range(lo, hi + 1)))


def overlaps_years(label: ColumnOrName, lo: int, hi: int) -> Column:
    """True when a stand-alone year of the label is in range; labels without one compare their fiscal key."""
    years = F.regexp_extract_all(as_col(label), F.lit(r"\b((?:19|20)[0-9]{2})\b"), F.lit(1))
    by_key = F.coalesce(fiscal_key(label).between(lo, hi), F.lit(False))
    return F.when(F.size(years) > 0, F.exists(years, lambda y: y.cast("int").between(lo, hi))).otherwise(by_key)


def year_range(text: ColumnOrName) -> Column:
    """Struct ``lo, hi`` of the year range a question names (``a-b``, between a and b, from a to b); NULLs if none."""
    low = F.lower(as_col(text))
    forms = (
        r"\b([0-9]{4})\s*[-–—]\s*([0-9]{4})\b",
        r"\bbetween\s+([0-9]{4})\s+and\s+([0-9]{4})\b",
        r"\bfrom\s+([0-9]{4})\s+(?:to|through|until)\s+([0-9]{4})\b",
    )
    a = F.coalesce(*[_group(low, f, 1) for f in forms]).cast("int")
    b = F.coalesce(*[_group(low, f, 2) for f in forms]).cast("int")
    return F.struct(F.least(a, b).alias("lo"), F.greatest(a, b).alias("hi"))
