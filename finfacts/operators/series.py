"""Growth, trends, extremes and checks over period series.

Input frames hold one row per (keys, period): a pivot, a dashboard or group totals.
Windows are partitioned by the keys, so a partition is one company's history.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.numbers import exact_mean, exact_sum, js_round, number_or_zero, round_for, safe_div, zero
from ..functions.periods import fiscal_key
from .frames import Keys, first_by, fiscal_sort, keyed, last_by, over, sort_struct, top_n, with_spread
from .scan import with_previous, with_running_total

# Smallest change that is a direction, by kind of figure.
TOLERANCE = {"percent": 0.05, "times": 0.015, "eps": 0.005, "number": 1.0}
ANOMALY_Z = 1.5
STABLE_PCT = 2.0
TREND_SHARE = 0.6


def _pct_change(now: Column, before: Column) -> Column:
    """% change on a base above 0, else NULL."""
    return F.when(before > 0, (now - before) / before * 100.0)


def growth_rate(df: DataFrame, by: str, value: str, keys: Keys = ()) -> DataFrame:
    """Total per group and its % change on the previous group, 1 digit; 0 for the first and after a zero."""
    out = df.groupBy(*keys, by).agg(exact_sum(number_or_zero(value)).alias("total"))
    out = with_previous(out, {"_before": "total"}, keys, by)
    before = F.col("_before")
    growth = F.coalesce(js_round(safe_div(F.col("total") - before, before) * 100.0, 1), zero())
    return out.withColumn("growth_pct", growth).drop("_before")


def running_total(df: DataFrame, col: str, keys: Keys = ()) -> DataFrame:
    """Cumulative sum of a flow amount in fiscal order; missing periods add nothing."""
    rows = with_running_total(df, F.coalesce(F.col(col), zero()), "_total", keys)
    return rows.select(*keys, "period", round_for(col, "_total").alias("running_total"))


def cagr(df: DataFrame, col: str, keys: Keys = ()) -> DataFrame:
    """Compound growth between the first and last positive value; the span comes from the fiscal years."""
    rows = df.where(F.col(col) > 0).withColumn("_key", fiscal_key("period"))
    out = rows.groupBy(*keys).agg(
        first_by(["period", col], sort_struct()).alias("_a"),
        last_by(["period", col], sort_struct()).alias("_b"),
        (F.max("_key") - F.min("_key")).alias("years"),
    ).where(F.col("years") > 0)
    ratio = F.col("_b")[col] / F.col("_a")[col]
    rate = (F.pow(ratio, 1.0 / F.col("years")) - 1.0) * 100.0
    return out.select(
        *keys,
        js_round(rate, 2).alias("cagr_pct"),
        "years",
        F.col("_a")["period"].alias("from_period"),
        F.col("_b")["period"].alias("to_period"),
    )


def two_year_change(df: DataFrame, col: str = "value", keys: Keys = (), year_a: int | None = None,
                    year_b: int | None = None, year: str = "year") -> DataFrame:
    """% change of a yearly series between two years, by default its first and last one."""

    def at(which: int | None, pick) -> Column:
        if which is None:
            return pick(F.struct(F.col(year), F.col(col)), F.col(year))
        hit = F.when(F.col(year) == which, F.struct(F.col(year), F.col(col)))
        return F.max(hit)

    out = df.groupBy(*keys).agg(at(year_a, F.min_by).alias("_a"), at(year_b, F.max_by).alias("_b"))
    va, vb = F.col("_a")[col], F.col("_b")[col]
    return out.where((va != 0) & vb.isNotNull()).select(
        *keys,
        F.col("_a")[year].alias("year_a"),
        va.alias("value_a"),
        F.col("_b")[year].alias("year_b"),
        vb.alias("value_b"),
        js_round((vb - va) / va * 100.0, 2).alias("change_pct"),
    )


def _steps(df: DataFrame, col: str, keys: Keys) -> DataFrame:
    """The series without gaps, each value beside the one before it."""
    return with_previous(df.where(F.col(col).isNotNull()), {"_prev": col}, keys)


def _ends(col: str) -> list[Column]:
    return [
        first_by([col], sort_struct())[col].alias("_first"),
        last_by([col], sort_struct())[col].alias("_last"),
        F.count(F.lit(1)).alias("periods"),
    ]


def trend_class(df: DataFrame, col: str, keys: Keys = ()) -> DataFrame:
    """``upward``, ``downward`` or ``stable`` when 60 % of the points agree, else by the end points.

    A step under 2 % is stable; a step from 0 is measured against 1.
    """
    now, before = F.col(col), F.col("_prev")
    change = (now - before) / F.when(before == 0, 1.0).otherwise(before) * 100.0
    steady = F.abs(change) < STABLE_PCT
    step = F.when(before.isNull(), None).when(steady, "stable").when(now > before, "up").when(now < before, "down")
    rows = _steps(df, col, keys).withColumn("_step", step)

    def n(kind: str) -> Column:
        return F.count(F.when(F.col("_step") == kind, 1)).alias(kind)

    out = rows.groupBy(*keys).agg(*_ends(col), n("up"), n("down"), n("stable"))
    need = F.col("periods") * TREND_SHARE
    delta = F.col("_last") - F.col("_first")
    trend = (
        F.when(F.col("periods") < 2, "insufficient")
        .when(F.col("up") >= need, "upward")
        .when(F.col("down") >= need, "downward")
        .when(F.col("stable") >= need, "stable")
        .when(delta > 0, "mixed-positive")
        .when(delta < 0, "mixed-negative")
        .otherwise("stable")
    )
    return out.select(*keys, "periods", "up", "down", "stable", trend.alias("trend"))


def direction_counts(df: DataFrame, col: str, keys: Keys = ()) -> DataFrame:
    """Rises, falls, the trend they make, and rises as a share of all steps."""
    now, before = F.col(col), F.col("_prev")
    out = _steps(df, col, keys).groupBy(*keys).agg(
        F.count(F.when(now > before, 1)).alias("rises"),
        F.count(F.when(now < before, 1)).alias("falls"),
        F.count(F.lit(1)).alias("periods"),
    )
    trend = (
        F.when(F.col("rises") > F.col("falls"), "upward").when(F.col("falls") > F.col("rises"), "downward")
    ).otherwise("stable")
    share = js_round(safe_div(F.col("rises").cast("double"), (F.col("periods") - 1).cast("double")), 4)
    return out.select(*keys, "rises", "falls", trend.alias("trend"), share.alias("consistency"))


def anomalies(df: DataFrame, col: str, keys: Keys = (), z: float = ANOMALY_Z, min_points: int = 3) -> DataFrame:
    """Points more than ``z`` population deviations from their series' mean, above or below it.

    Mean and deviation are taken from exact sums of the values and of the squared distances.
    """
    rows = df.where(F.col(col).isNotNull())
    rows = with_spread(rows, keys, lambda w: {"_n": over(F.count(F.lit(1)), w), "_mean": exact_mean(col, w)})
    gap = F.col(col) - F.col("_mean")
    rows = with_spread(rows, keys, lambda w: {"_sd": F.sqrt(over(F.avg(gap * gap), w))})
    score = F.abs(safe_div(gap, F.col("_sd")))
    return rows.where((F.col("_n") >= min_points) & (score > z)).select(
        *keys,
        "period",
        F.col(col).alias("value"),
        js_round(score, 1).alias("z_score"),
        F.when(gap > 0, "above").otherwise("below").alias("side"),
    )


def _yearly_scores(df: DataFrame, keys: Keys) -> DataFrame:
    """Per period: margin, growth on the period before, and the weighted score with their key's total revenue."""
    margin = F.coalesce(safe_div(F.col("profit"), F.col("revenue")) * 100.0, zero())
    out = with_previous(df, {"_before": "revenue"}, keys)
    out = out.withColumns({"_growth": _pct_change(F.col("revenue"), F.col("_before")), "_margin": margin}).drop("_before")
    out = with_spread(out, keys, lambda w: {"_total": exact_sum("revenue", w)})
    score = (
        F.col("profit") * 0.5
        + F.col("_margin") * F.col("_total") / 100.0 * 0.3
        + F.coalesce(F.col("_growth"), zero()) * F.col("_total") / 100.0 * 0.2
    )
    return out.withColumn("_score", score)


def best_year_score(df: DataFrame, keys: Keys = ()) -> DataFrame:
    """Totals, overall margin, average growth, and the year with the best mix of profit, margin and growth.

    Needs period, revenue, expense and profit.  The earlier year wins a tie.
    """
    rows = _yearly_scores(df, keys)
    best = F.min_by(F.struct("period", "profit", "_margin"), F.struct(-F.col("_score"), *sort_struct())).alias("_b")
    out = rows.groupBy(*keys).agg(
        exact_sum("revenue").alias("total_revenue"),
        exact_sum("expense").alias("total_expense"),
        exact_mean("_growth").alias("_avg"),
        best,
    )
    profit = F.col("total_revenue") - F.col("total_expense")
    margin = F.when(F.col("total_revenue") > 0, profit / F.col("total_revenue") * 100.0).otherwise(zero())
    return out.select(
        *keys,
        "total_revenue",
        "total_expense",
        profit.alias("total_profit"),
        js_round(margin, 1).alias("overall_margin_pct"),
        js_round(F.coalesce("_avg", zero()), 1).alias("average_growth_pct"),
        F.col("_b.period").alias("best_year"),
        F.col("_b.profit").alias("best_year_profit"),
        js_round(F.col("_b._margin"), 1).alias("best_year_margin_pct"),
    )


def average_growth(df: DataFrame, col: str, keys: Keys = (), over: str = "positive_bases") -> DataFrame:
    """Mean % change over the steps with a positive base; ``over="all_steps"`` divides by every step."""
    growth = _pct_change(F.col(col), F.col("_prev"))
    out = _steps(df, col, keys).groupBy(*keys).agg(
        exact_sum(growth).alias("_sum"), F.count(growth).alias("_n"), (F.count(F.lit(1)) - 1).alias("_steps")
    )
    base = F.col("_n") if over == "positive_bases" else F.col("_steps")
    mean = safe_div(F.coalesce("_sum", zero()), base.cast("double"))
    if over == "positive_bases":
        mean = F.coalesce(mean, zero())
    return out.select(*keys, js_round(mean, 1).alias("average_growth_pct"))


def latest_growth(df: DataFrame, col: str, keys: Keys = ()) -> DataFrame:
    """% change of the last period on the one before it; NULL for a single period or a zero base."""
    rows = _steps(df, col, keys)
    last = last_by(["period", col, "_prev"], sort_struct()).alias("_l")
    out = rows.groupBy(*keys).agg(last)
    pct = safe_div(F.col("_l")[col] - F.col("_l._prev"), F.col("_l._prev")) * 100.0
    return out.select(*keys, F.col("_l.period").alias("period"), js_round(pct, 1).alias("growth_pct"))


def period_changes(df: DataFrame, col: str, n: int, keys: Keys = ()) -> DataFrame:
    """Absolute and % change of each of the last ``n`` periods on the one before, the first of them left out."""
    newest = [fiscal_key("period").desc_nulls_first(), F.col("period").desc()]
    rows = top_n(df, keys, newest, n)
    rows = with_previous(rows, {"_prev": col}, keys).where(F.col("_prev").isNotNull())
    change = F.col(col) - F.col("_prev")
    pct = F.coalesce(js_round(_pct_change(F.col(col), F.col("_prev")), 1), zero())
    return rows.select(*keys, "period", change.alias("change"), pct.alias("change_pct"))


def superlative_year(df: DataFrame, col: str, keys: Keys = (), period: str = "period") -> DataFrame:
    """Best and worst period of a series, the earlier one on ties."""
    rows = df.where(F.col(col).isNotNull())
    pair = F.struct(F.col(period).alias("p"), F.col(col).alias("v"))
    out = rows.groupBy(*keys).agg(
        F.min_by(pair, F.struct(-F.col(col), *sort_struct(period))).alias("_b"),
        F.min_by(pair, F.struct(F.col(col), *sort_struct(period))).alias("_w"),
    )
    return out.where(F.col("_b").isNotNull()).select(
        *keys,
        F.col("_b.p").alias("best_period"),
        F.col("_b.v").alias("best_value"),
        F.col("_w.p").alias("worst_period"),
        F.col("_w.v").alias("worst_value"),
    )


def series_summary(df: DataFrame, col: str, keys: Keys = (), kind: str = "number") -> DataFrame:
    """First and last point, their difference and direction, and the peak (first one on ties)."""
    rows = df.where(F.col(col).isNotNull())
    pair = [F.col("period").alias("p"), F.col(col).alias("v")]
    out = rows.groupBy(*keys).agg(
        first_by(pair, sort_struct()).alias("_a"),
        last_by(pair, sort_struct()).alias("_z"),
        F.min_by(F.struct(*pair), F.struct(-F.col(col), *sort_struct())).alias("_p"),
    ).where(F.col("_a").isNotNull())
    delta = F.col("_z.v") - F.col("_a.v")
    direction = (
        F.when(F.abs(delta) < TOLERANCE[kind], "flat").when(delta > 0, "up").otherwise("down")
    )
    return out.select(
        *keys,
        F.col("_a.p").alias("first_period"),
        F.col("_a.v").alias("first_value"),
        F.col("_z.p").alias("last_period"),
        F.col("_z.v").alias("last_value"),
        js_round(delta, 4).alias("delta"),
        direction.alias("direction"),
        F.col("_p.p").alias("peak_period"),
        F.col("_p.v").alias("peak_value"),
    )


def dip_years(df: DataFrame, col: str, keys: Keys = (), year: str = "period") -> DataFrame:
    """Periods below the one before them (joined by commas) and the end-to-end % on the absolute first value."""
    rows = _steps(df, col, keys)
    order = fiscal_key(year)
    dip = F.when(F.col(col) < F.col("_prev"), F.struct(order.alias("k"), F.col(year).cast("string").alias("p")))
    out = rows.groupBy(*keys).agg(*_ends(col), F.array_sort(F.collect_list(dip)).alias("_dips"))
    base = F.abs(F.col("_first"))
    pct = js_round(safe_div((F.col("_last") - F.col("_first")) * 100.0, base), 2)
    return out.select(
        *keys,
        F.concat_ws(",", F.transform("_dips", lambda d: d["p"])).alias("dip_periods"),
        F.size("_dips").alias("dips"),
        pct.alias("change_pct"),
    )


def best_margin_period(df: DataFrame, keys: Keys = ()) -> DataFrame:
    """Period with the best margin of value1 over value2, the average margin, and average and peak second share."""
    v1, v2 = F.col("value1"), F.col("value2")
    margin = F.when(v1 > 0, (v1 - v2) / v1).otherwise(zero())
    name = F.col("period")
    out = df.withColumn("_m", margin).groupBy(*keys).agg(
        exact_mean("value1").alias("_a1"),
        exact_mean("value2").alias("_a2"),
        F.min_by(F.struct(name, F.col("_m")), F.struct(-F.col("_m"), *sort_struct())).alias("_b"),
        F.min_by(F.struct(name, v1, v2), F.struct(-v2, *sort_struct())).alias("_p"),
    )
    a1, a2, p1, p2 = F.col("_a1"), F.col("_a2"), F.col("_p.value1"), F.col("_p.value2")
    return out.select(
        *keys,
        F.col("_b.period").alias("best_period"),
        js_round(F.col("_b._m") * 100.0, 1).alias("best_margin_pct"),
        F.when(a1 > 0, js_round((a1 - a2) / a1 * 100.0, 1)).otherwise(zero()).alias("average_margin_pct"),
        F.when(a1 > 0, js_round(a2 / a1 * 100.0, 1)).otherwise(zero()).alias("average_share_pct"),
        F.col("_p.period").alias("peak_share_period"),
        F.when(p1 > 0, js_round(p2 / p1 * 100.0, 1)).otherwise(zero()).alias("peak_share_pct"),
    )


# Thresholds of the advice flags, in %.
GROWTH_WEAK = 5.0
SHARE_LARGE = 15.0
MARGIN_LOW = 20.0
MARGIN_HIGH = 40.0


def advice_flags(kpi: DataFrame, keys: Keys = ()) -> DataFrame:
    """Threshold flags over the figures of ``kpis``."""
    c = F.col
    return kpi.select(
        *keys,
        (c("growth_pct") < GROWTH_WEAK).alias("weak_growth"),
        (c("rate_pct") > SHARE_LARGE).alias("large_other_income"),
        (c("margin_pct") < MARGIN_LOW).alias("low_margin"),
        (c("margin_pct") > MARGIN_HIGH).alias("high_margin"),
        (c("total2") == 0).alias("no_second_series"),
    )


# Column names that hold ratios, for which the size checks make no sense.
RATIO_COLUMNS = (
    "gross_profit", "roe_pct", "roa_pct", "roce_pct", "current_ratio", "quick_ratio", "debt_to_equity",
    "interest_coverage", "asset_turnover", "eps", "pe_ratio", "operating_margin_pct", "ebitda_margin_pct",
    "gross_margin_pct", "net_profit_margin_pct",
)
SMALLEST_AMOUNT = 1000.0
COLLAPSE_SHARE = 0.1


def is_ratio_column(name: str) -> bool:
    low = name.lower()
    return (
        "margin" in low or "_pct" in low or low.endswith(("_days", "_ratio")) or low.startswith("yoy_")
        or low in RATIO_COLUMNS
    )


def check_series(df: DataFrame, col: str = "value", keys: Keys = (), metric: str | None = None) -> DataFrame:
    """Rows that make a series implausible, with the reason; empty where the column, or ``metric`` it holds, is a ratio.

    Reasons: missing period, repeated period, amount under 1000, drop below a tenth of the value before.
    """
    if is_ratio_column(metric or col):
        return df.select(*keys, "period", F.col(col).alias("value"), F.lit("").alias("violation")).limit(0)
    period = F.nullif(F.col("period"), F.lit(""))
    per_period = keyed([*keys, "period"])
    repeated = F.count(F.lit(1)).over(per_period) > 1
    before = F.last(F.col(col), ignorenulls=True).over(
        keyed(keys).orderBy(*fiscal_sort(), F.col(col)).rowsBetween(W.unboundedPreceding, -1)
    )
    value = F.col(col)
    out = df.withColumns({"_repeated": repeated, "_before": before})
    found = F.filter(
        F.array(
            F.when(period.isNull(), "missing period"),
            F.when(period.isNotNull() & F.col("_repeated"), "repeated period"),
            F.when(value < SMALLEST_AMOUNT, "amount under 1000"),
            F.when((F.col("_before") > 0) & (value < F.col("_before") * COLLAPSE_SHARE), "collapse"),
        ),
        lambda v: v.isNotNull(),
    )
    return out.select(*keys, "period", value.alias("value"), F.explode(found).alias("violation"))


def next_period(df: DataFrame, keys: Keys = ()) -> DataFrame:
    """The year after the latest one a period label names."""
    year = F.nullif(F.regexp_extract("period", r"(20[0-9]{2})", 1), F.lit("")).cast("int")
    return df.groupBy(*keys).agg((F.max(year) + 1).alias("next_period"))
