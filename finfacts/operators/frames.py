"""Shared pieces: period order, keyed windows, top-n per key."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.numbers import ColumnOrName, as_col
from ..functions.periods import fiscal_key

Keys = Sequence[str]


def fiscal_sort(label: ColumnOrName = "period") -> list[Column]:
    """Order of period labels: fiscal key, labels without one last, then the text."""
    return [fiscal_key(label).asc_nulls_last(), as_col(label).asc()]


def keyed(keys: Keys) -> WindowSpec:
    """One window partition per series.

    Use it only on frames with one row per (keys, period) or per (keys, group): their
    partitions are as long as a company's history, never as long as its raw facts.
    """
    return W.partitionBy(*keys) if keys else W.partitionBy(F.lit(1))


def timeline(keys: Keys, period: str = "period") -> WindowSpec:
    """The series of each key in fiscal order."""
    return keyed(keys).orderBy(*fiscal_sort(period))


def same_keys(left: DataFrame, right: DataFrame, keys: Keys) -> tuple[DataFrame, Column]:
    """``right`` with its keys renamed, and the condition that they equal those of ``left``; NULL equals NULL."""
    other = right.withColumnsRenamed({k: f"_right_{k}" for k in keys})
    return other, reduce(and_, [left[k].eqNullSafe(other[f"_right_{k}"]) for k in keys])


def with_keys(left: DataFrame, right: DataFrame, keys: Keys, how: str = "left") -> DataFrame:
    """``left`` joined to ``right`` on the keys, NULL keys included."""
    other, same = same_keys(left, right, keys)
    return left.join(other, same, how).drop(*[f"_right_{k}" for k in keys])


def without_keys(left: DataFrame, right: DataFrame, keys: Keys) -> DataFrame:
    """The rows of ``left`` whose keys ``right`` does not hold, NULL keys included."""
    other, same = same_keys(left, right, keys)
    return left.join(other, same, "left_anti")


def with_totals(df: DataFrame, keys: Keys, totals: dict[str, Column]) -> DataFrame:
    """``df`` with aggregates over its keys; without keys they are one scalar subquery, so no task sees all rows."""
    if keys:
        return with_keys(df, df.groupBy(*keys).agg(*[c.alias(n) for n, c in totals.items()]), keys)
    one = df.agg(F.struct(*[c.alias(n) for n, c in totals.items()]).alias("_t")).scalar()
    return df.withColumn("_totals", one).select("*", *[F.col("_totals")[n].alias(n) for n in totals]).drop("_totals")


def with_spread(df: DataFrame, keys: Keys, totals: Callable[[WindowSpec | None], dict[str, Column]]) -> DataFrame:
    """``df`` with aggregates over its series: windows of the keys, or one scalar subquery without keys.

    ``totals`` gets the window the aggregates are taken over, None for plain aggregates.
    """
    return df.withColumns(totals(keyed(keys))) if keys else with_totals(df, (), totals(None))


def over(agg: Column, window: WindowSpec | None) -> Column:
    """The aggregate over a window, or as it is."""
    return agg if window is None else agg.over(window)


def top_n(df: DataFrame, keys: Keys, order: Sequence[Column], n: int | None, rank: str | None = None) -> DataFrame:
    """The first ``n`` rows per key in the given total order; all of them when ``n`` is None.

    Without keys this is a distributed top-k; with keys the rank filter lets Spark cut each
    partition to ``n`` rows per key before the shuffle, so a hot key sends few rows.
    """
    if n is None:
        return df
    if not keys and rank is None:
        return df.orderBy(*order).limit(n)
    if not keys:
        df = df.orderBy(*order).limit(n)
    name = rank or "_rank"
    out = df.withColumn(name, F.row_number().over(keyed(keys).orderBy(*order))).where(F.col(name) <= n)
    return out if rank else out.drop(name)


def first_by(values: Sequence[ColumnOrName], order: Sequence[Column]) -> Column:
    """Aggregate: the values of the row that comes first in ``order`` (a struct); partial on the map side."""
    return F.min_by(F.struct(*[as_col(v) for v in values]), F.struct(*order))


def last_by(values: Sequence[ColumnOrName], order: Sequence[Column]) -> Column:
    """Aggregate: the values of the row that comes last in ``order`` (a struct)."""
    return F.max_by(F.struct(*[as_col(v) for v in values]), F.struct(*order))


def sort_struct(label: ColumnOrName = "period") -> list[Column]:
    """Fiscal order as plain columns for ``min_by``/``max_by``: labels without a key sort last."""
    return [F.coalesce(fiscal_key(label), F.lit(2147483647)), as_col(label)]


def settled(df: DataFrame) -> DataFrame:
    """``df`` with its computed columns worked out once per row.

    Spark merges projections, and a column that a later array expression reads inside its loop would be worked out again for
    every element.  The generator keeps the two apart.
    """
    return df.select(F.inline(F.array(F.struct(*df.columns))))


def rows_with(df: DataFrame, kept: Sequence[str], computed: dict[str, Column], required: Sequence[str]) -> DataFrame:
    """``kept`` columns plus ``computed`` ones, for the rows whose ``required`` computed columns are not NULL.

    A plain filter on a computed column is pushed below it and computes it again at every step on the way
    down.  Here the values are built once into a struct and rows without them are left out by the generator.
    """
    item = F.struct(*[c.alias(n) for n, c in computed.items()])
    full = F.filter(F.array(item), lambda s: reduce(and_, [s[n].isNotNull() for n in required]))
    return df.select(*kept, F.inline(full))
