"""Group totals, shares, summaries and selections."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import labels
from ..functions import rules as R
from ..functions.numbers import (
    exact_mean,
    exact_sum,
    js_round,
    number_or_zero,
    parse_dashboard_number,
    parse_digits_number,
    round_for,
    safe_div,
    zero,
)
from ..functions.periods import valid_year
from .filters import valid_facts
from .frames import Keys, first_by, keyed, last_by, sort_struct, top_n, with_keys, with_totals
from .pivot import enrich, pivot_facts
from .quantiles import median
from .ratios import ratio_columns


def _order(by: str, value: str, order: str) -> list[Column]:
    """Total order of group rows: by value down or up, or chronologically by the group label."""
    if order == "time":
        return [F.col(by).asc()]
    return [F.col(value).asc() if order == "asc" else F.col(value).desc(), F.col(by).asc()]


# --- plain groups -----------------------------------------------------------------------------


def group_sum(df: DataFrame, by: str, value: str, keys: Keys = (), order: str = "desc", n: int | None = None) -> DataFrame:
    """Total per group, missing and unreadable cells as 0; with ``n`` the first ones by value or in time order."""
    out = df.groupBy(*keys, by).agg(exact_sum(number_or_zero(value)).alias("total"))
    return top_n(out, keys, _order(by, "total", order), n)


def group_avg(df: DataFrame, by: str, value: str, keys: Keys = (), n: int | None = None) -> DataFrame:
    """Mean per group over all its rows (missing counts as 0), rounded to a whole number."""
    out = df.groupBy(*keys, by).agg(js_round(exact_mean(number_or_zero(value)), 0).alias("average"))
    return top_n(out, keys, _order(by, "average", "desc"), n)


def group_count(df: DataFrame, by: str, keys: Keys = (), n: int | None = None) -> DataFrame:
    """Rows per group, most first."""
    out = df.groupBy(*keys, by).agg(F.count(F.lit(1)).alias("rows"))
    return top_n(out, keys, _order(by, "rows", "desc"), n)


def grand_total(df: DataFrame, value: str, keys: Keys = ()) -> DataFrame:
    """Total of one column.  Refused on year/metric/value sheets, whose rows mix different metrics."""
    names = {c.lower() for c in df.columns}
    if {"year", "metric", "value"} <= names and value.lower() == "value":
        raise ValueError("a total over mixed metrics means nothing; filter one metric first")
    return df.groupBy(*keys).agg(exact_sum(number_or_zero(value)).alias("total"))


def profit_breakdown(df: DataFrame, by: str, revenue: str, expense: str, keys: Keys = (),
                     n: int | None = None) -> DataFrame:
    """Revenue, expense and profit per group, highest profit first (all groups by default)."""
    out = df.groupBy(*keys, by).agg(
        exact_sum(number_or_zero(revenue)).alias("revenue"), exact_sum(number_or_zero(expense)).alias("expense")
    ).withColumn("profit", F.col("revenue") - F.col("expense"))
    return out if n is None else top_n(out, keys, _order(by, "profit", "desc"), n)


def margin_pct(profit: Column, revenue: Column) -> Column:
    """Profit as % of revenue, 0 when there is no revenue."""
    return F.coalesce(safe_div(profit, revenue) * 100.0, zero())


def compare_revenue_expense(df: DataFrame, by: str, revenue: str, expense: str, keys: Keys = (),
                            time_like: bool = False, n: int | None = None) -> DataFrame:
    """The profit breakdown with its margin, in time order for a time-like group, else by revenue."""
    out = profit_breakdown(df, by, revenue, expense, keys, n=None)
    out = out.withColumn("margin_pct", js_round(margin_pct(F.col("profit"), F.col("revenue")), 2))
    return top_n(out, keys, _order(by, "revenue", "time" if time_like else "desc"), n)


def margin_by_group(df: DataFrame, by: str, revenue: str, profit: str, keys: Keys = (),
                    time_like: bool = False, n: int | None = None) -> DataFrame:
    """Margin of the group totals, plus average and best margin over all groups; ``n`` cuts the rows, not the groups."""
    out = df.groupBy(*keys, by).agg(
        exact_sum(number_or_zero(revenue)).alias("revenue"), exact_sum(number_or_zero(profit)).alias("profit")
    )
    pct = F.coalesce(js_round(safe_div(F.col("profit") * 100.0, F.col("revenue")), 2), zero())
    out = with_totals(out.withColumn("margin_pct", pct), keys, {
        "average_margin_pct": js_round(exact_mean("margin_pct"), 2),
        "best_margin_pct": F.max("margin_pct"),
        "best_group": F.min_by(F.col(by), F.struct(-F.col("margin_pct"), F.col(by))),
    })
    return top_n(out, keys, _order(by, "margin_pct", "time" if time_like else "desc"), n)


# --- dashboard groups -------------------------------------------------------------------------


def folded(col: str) -> Column:
    """Group key with case and outer blanks ignored; missing is ``Unknown``."""
    return F.trim(F.coalesce(F.col(col).cast("string"), F.lit("Unknown")))


def _two_totals(df: DataFrame, keys: Keys, by: str, first: Column, second: Column, seq: str) -> DataFrame:
    """Totals of two measures per case-folded group, labelled with the group's first spelling."""
    name = folded(by)
    return (
        df.groupBy(*keys, F.lower(name).alias("_fold"))
        .agg(
            F.min_by(name, F.col(seq)).alias("name"),
            exact_sum(first).alias("value1"),
            exact_sum(second).alias("value2"),
        )
        .drop("_fold")
    )


def split_facts(df: DataFrame, by: str, keys: Keys = (), second: str = "expense", metric: str = "metric",
                value: str = "value", seq: str = "seq") -> DataFrame:
    """Core revenue against expenses or other income per group of a long sheet."""
    df = df.withColumn("_class", labels.dashboard_class(metric))
    amount = number_or_zero(value)

    def part(kind: str) -> Column:
        return F.when(F.col("_class") == kind, amount).otherwise(zero())

    return _two_totals(df, keys, by, part("core_revenue"), part(second), seq)


def _header_sum(df: DataFrame, by: str, keys: Keys, kind: str, skip: Sequence[str]) -> Column:
    names = [
        c
        for c in df.columns
        if c not in (by, *keys, *skip) and R.name_result(c.strip().lower(), R.DASHBOARD_CLASSES) == kind
    ]
    total = zero()
    for name in names:
        total = total + parse_dashboard_number(F.col(f"`{name}`"))
    return total


def split_wide(df: DataFrame, by: str, keys: Keys = (), second: str = "expense", seq: str = "seq") -> DataFrame:
    """The same over a wide sheet: headers are classified once, their cells added per row."""
    first = _header_sum(df, by, keys, "core_revenue", (seq,))
    return _two_totals(df, keys, by, first, _header_sum(df, by, keys, second, (seq,)), seq)


def sum_two(df: DataFrame, by: str, v1: str, v2: str, keys: Keys = (), seq: str = "seq") -> DataFrame:
    """Totals of two columns per case-folded group."""
    return _two_totals(df, keys, by, number_or_zero(v1), number_or_zero(v2), seq)


def kpis(groups: DataFrame, keys: Keys = ()) -> DataFrame:
    """Headline figures of a two-value group frame (name, value1, value2).

    Totals, mean, maximum and count of the groups; second as % of first; growth of the first value
    from the first to the last period and margin left after the second.
    """
    early, late = first_by(["value1"], sort_struct("name")), last_by(["value1"], sort_struct("name"))
    out = groups.groupBy(*keys).agg(
        exact_sum("value1").alias("_t1"),
        exact_sum("value2").alias("_t2"),
        F.max("value1").alias("_max"),
        F.count(F.lit(1)).alias("groups"),
        early["value1"].alias("_first"),
        late["value1"].alias("_last"),
    )
    c = F.col
    has_first, has_total = c("_first") > 0, c("_t1") > 0
    return out.select(
        *keys,
        js_round("_t1").alias("total1"),
        js_round("_t2").alias("total2"),
        js_round(safe_div(c("_t1"), c("groups").cast("double"))).alias("average1"),
        js_round("_max").alias("max1"),
        "groups",
        F.when(has_total, js_round(c("_t2") / c("_t1") * 100.0, 1)).otherwise(zero()).alias("rate_pct"),
        F.when(has_first, js_round((c("_last") - c("_first")) / c("_first") * 100.0, 1))
        .otherwise(zero())
        .alias("growth_pct"),
        F.when(has_total, js_round((c("_t1") - c("_t2")) / c("_t1") * 100.0, 1)).otherwise(zero()).alias("margin_pct"),
    )


def top_groups(groups: DataFrame, n: int, keys: Keys = (), rank: str | None = None) -> DataFrame:
    """The groups with the largest sum of both values, values rounded to whole numbers."""
    order = [(F.col("value1") + F.col("value2")).desc(), F.col("name").asc()]
    out = top_n(groups, keys, order, n, rank)
    return out.withColumns({"value1": js_round("value1"), "value2": js_round("value2")})


def top_share(groups: DataFrame, n: int, pool: int, keys: Keys = ()) -> DataFrame:
    """Share of each of the top ``n`` groups within them, and row total as % of the largest row of the pool."""
    w = keyed(keys)
    top = top_groups(groups, pool, keys, rank="rank")
    total = F.col("value1") + F.col("value2")
    top = top.withColumn("_largest", F.greatest(F.max(total).over(w), F.lit(1.0))).where(F.col("rank") <= n)
    pie = exact_sum("value1", w)
    share = F.when(pie > 0, js_round(F.col("value1") / pie * 100.0)).otherwise(zero())
    scale = F.when(total > 0, js_round(total / F.col("_largest") * 100.0, 2)).otherwise(zero())
    return top.withColumns({"share_pct": share, "scale_pct": scale}).drop("_largest")


def top_bottom(groups: DataFrame, k: int, pool: int, keys: Keys = ()) -> DataFrame:
    """First ``k`` and last ``k`` of the top groups, the last ones worst first, each with its rank."""
    top = top_groups(groups, pool, keys, rank="rank")
    top = top.withColumn("_n", F.count(F.lit(1)).over(keyed(keys)))
    side = F.explode(
        F.filter(
            F.array(F.when(F.col("rank") <= k, "top"), F.when(F.col("rank") > F.col("_n") - k, "bottom")),
            lambda s: s.isNotNull(),
        )
    )
    return top.withColumn("side", side).withColumn(
        "place", F.when(F.col("side") == "top", F.col("rank")).otherwise(F.col("_n") - F.col("rank") + 1)
    ).drop("_n")


def time_series(groups: DataFrame, keys: Keys = (), n: int | None = None) -> DataFrame:
    """The two-value series by the first four-digit number of the label; with ``n`` the last ones."""
    stamp = F.coalesce(
        F.nullif(F.regexp_extract("name", r"([0-9]{4})", 1), F.lit("")), F.col("name")
    )
    out = top_n(groups.withColumn("_stamp", stamp), keys, [F.col("_stamp").desc(), F.col("name").desc()], n)
    return out.drop("_stamp").withColumns({"value1": js_round("value1"), "value2": js_round("value2")})


def one_answer(df: DataFrame, by: str, value: str, keys: Keys = (), low: bool = False) -> DataFrame:
    """The single best or worst group by total."""
    return group_sum(df, by, value, keys, "asc" if low else "desc", 1)


def sales_column(columns: Sequence[str]) -> str | None:
    """The first column whose name speaks of sales."""
    return next((c for c in columns if any(w in c.lower() for w in R.SALES_HEADER_WORDS)), None)


def sales_total(df: DataFrame, keys: Keys = ()) -> DataFrame:
    """Total of the sales-like column, digits of its cells kept."""
    name = sales_column([c for c in df.columns if c not in keys])
    amount = zero() if name is None else F.coalesce(parse_digits_number(F.col(f"`{name}`")), zero())
    return df.groupBy(*keys).agg(exact_sum(amount).alias("total_sales"))


def sheet_size(df: DataFrame, keys: Keys = ()) -> DataFrame:
    """Rows and columns of a sheet."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"), F.lit(len(df.columns)).alias("columns"))


# --- ratio series -----------------------------------------------------------------------------


def summarise(df: DataFrame, metric: str, how: str, keys: Keys = (), period: str = "period") -> DataFrame:
    """Average, median, highest, lowest or sum of a ratio over the periods that have it.

    Sums are only allowed for flow amounts.  Ties of highest and lowest go to the first period.
    """
    rows = df.where(F.col(metric).isNotNull())
    if how in ("highest", "lowest"):
        size = -F.col(metric) if how == "highest" else F.col(metric)
        best = F.min_by(F.struct(F.col(period), F.col(metric)), F.struct(size, *sort_struct(period))).alias("_b")
        out = rows.groupBy(*keys).agg(best).where(F.col("_b").isNotNull())
        return out.select(*keys, F.col("_b")[period].alias("period"), round_for(metric, F.col("_b")[metric]).alias(
            "value"))
    if how == "median":
        return median(rows, keys, metric).select(*keys, F.lit("Median").alias("period"),
                                                 round_for(metric, "median").alias("value"))
    if how == "average":
        agg, label = exact_mean(metric), "Average"
    elif how == "sum":
        if metric not in R.SUMMABLE_METRICS:
            raise ValueError(f"{metric} is a ratio; adding it over periods means nothing")
        agg, label = exact_sum(metric), "Total"
    else:
        raise ValueError(f"unknown summary {how!r}")
    return rows.groupBy(*keys).agg(round_for(metric, agg).alias("value")).select(
        *keys, F.lit(label).alias("period"), "value"
    )


def pooled_totals(df: DataFrame, keys: Keys = ()) -> DataFrame:
    """Total revenue and net income, average ROE and net margin over the pivoted periods of valid facts."""
    rows = enrich(pivot_facts(valid_facts(df), keys, "max"))
    c = ratio_columns("server")
    return (
        rows.withColumns({"_roe": c["roe_pct"], "_npm": c["net_profit_margin_pct"]})
        .groupBy(*keys)
        .agg(
            js_round(exact_sum("revenue"), 2).alias("revenue_total"),
            js_round(exact_sum("net_income"), 2).alias("net_income_total"),
            js_round(exact_mean("_roe"), 2).alias("roe_pct_avg"),
            js_round(exact_mean("_npm"), 2).alias("net_profit_margin_pct_avg"),
        )
    )


def extreme_period(df: DataFrame, metric: str = "revenue", high: bool = True, keys: Keys = ()) -> DataFrame:
    """Period with the largest or smallest yearly maximum of a metric over valid facts; ties by label."""
    rows = valid_facts(df).where(F.col("metric") == metric)
    per = rows.groupBy(*keys, "period").agg(F.max("value").alias("value")).where(F.col("value").isNotNull())
    size = -F.col("value") if high else F.col("value")
    best = F.min_by(F.struct("period", "value"), F.struct(size, F.col("period"))).alias("_b")
    return per.groupBy(*keys).agg(best).where(F.col("_b").isNotNull()).select(*keys, "_b.*")


def distinct_metrics(df: DataFrame, metric: str = "metric", keys: Keys = (), seq: str | None = None) -> DataFrame:
    """Distinct labels; with ``seq`` also the position each was first seen at."""
    label = F.trim(F.col(metric)).alias("metric")
    rows = df.select(*keys, label, *([seq] if seq else [])).where(F.col("metric") != "")
    if seq:
        return rows.groupBy(*keys, "metric").agg(F.min(seq).alias("first_seen"))
    return rows.distinct()


# --- choosing among facts ---------------------------------------------------------------------


def best_fact(df: DataFrame, keys: Keys = ("company",), tie: Sequence[str] = ("source_page", "id")) -> DataFrame:
    """One fact per (keys, metric, period): consolidated before others, then the largest value.

    Only valid facts of the years 2000 to 2100 with a value compete; a missing level is not consolidated.  Equal ones are told apart by ``tie``.  An
    aggregate, not a window: a hot key is reduced before the shuffle.
    """
    rows = df.where(F.col("is_valid") & valid_year("period") & F.col("value").isNotNull())
    order = F.struct(
        (~F.coalesce(F.col("level") == "consolidated", F.lit(False))).cast("int").alias("_not_consolidated"),
        (-F.col("value")).alias("_size"),
        *[F.col(c) for c in tie],
    )
    best = F.min_by(F.struct(*rows.columns), order).alias("_best")
    return rows.groupBy(*keys, "metric", "period").agg(best).select("_best.*")


def max_per_period(df: DataFrame, keys: Keys = ()) -> DataFrame:
    """Largest value per trimmed period."""
    return df.groupBy(*keys, F.trim("period").alias("period")).agg(F.max("value").alias("value"))


def last_per_period(df: DataFrame, order_col: str, keys: Keys = (), ordered: bool = True) -> DataFrame:
    """The last row of each period; whole-number labels first in numeric order, then the others as text.

    Where all rows of a period have no ``order_col``, there is no last one and its columns are NULL.
    """
    rows = df.where(F.col("period").isNotNull())
    group = [*keys, "period"]
    rest = [c for c in rows.columns if c not in group]
    # One max_by a column instead of one over whole rows: numbers are aggregated in place, without a sort of all rows by group.
    last = [F.max(order_col).alias("_at"), *[F.max_by(c, order_col).alias(c) for c in rest if c != order_col]]
    out = rows.groupBy(*group).agg(*last)
    there = F.col("_at").isNotNull()
    picked = {order_col: F.col("_at")} | {k: F.when(there, F.col(k)) for k in group}
    out = out.select(*[picked.get(c, F.col(c)).alias(c) for c in rows.columns])
    if not ordered:
        return out
    # The order is worked out once a row; as expressions it would be worked out anew for each comparison of the sort.
    number = F.trim("period").try_cast("int")
    return out.withColumns({"_text": number.isNull(), "_number": number}).orderBy(*keys, "_text", "_number", "period").drop("_text", "_number")


def dedup_rows(df: DataFrame, order_col: str, keys: Keys = ()) -> DataFrame:
    """Rows with a whole year from 2000 and a value of 0 or more, one per (keys, year, metric, whole value).

    The first row of each group by ``order_col`` stays.
    """
    year = F.col("year").try_cast("int")
    value = F.col("value").try_cast("double").try_cast("bigint")
    rows = df.withColumns({"year": year, "value": value}).where((F.col("year") >= 2000) & (F.col("value") >= 0))
    group = [*keys, "year", "metric", "value"]
    first = F.min_by(F.struct(*rows.columns), F.col(order_col)).alias("_first")
    return rows.groupBy(*group).agg(first).select("_first.*")


def main_currency(df: DataFrame, keys: Keys) -> DataFrame:
    """The most frequent currency of each document that names one as ``_main``, ties by name."""
    counts = df.where(F.col("currency") != "").groupBy(*keys, "currency").agg(F.count(F.lit(1)).alias("_n"))
    return counts.groupBy(*keys).agg(
        F.min_by("currency", F.struct((-F.col("_n")).alias("n"), F.col("currency"))).alias("_main")
    )


def fill_currency(df: DataFrame, keys: Keys) -> DataFrame:
    """Missing currencies filled with the most frequent one of the document, ties by name.

    The counts are reduced per (document, currency) first, so only one row per document joins back.
    """
    known = F.nullif(F.col("currency"), F.lit(""))
    return with_keys(df, main_currency(df, keys), keys).withColumn("currency", F.coalesce(known, F.col("_main"))).drop("_main")


# --- summary over years -----------------------------------------------------------------------


def financial_summary(df: DataFrame, by: str, revenue: str, expense: str, keys: Keys = ()) -> DataFrame:
    """Totals, overall margin, average growth and best-scored year of a wide sheet."""
    from .series import best_year_score

    yearly = profit_breakdown(df, by, revenue, expense, keys, n=None).withColumnRenamed(by, "period")
    return best_year_score(yearly, keys)
