"""Queries over a company's revenue series: growth, direction, extremes and outliers."""

from __future__ import annotations

from finfacts.operators import filters as P
from finfacts.operators import series as S
from finfacts.operators.aggregate import max_per_period

from . import fixtures as fx
from .registry import query
from .sqltext import fiscal_key_sql, fiscal_order_sql, rnd, xsum

KEY = ("company",)
ORDER = fiscal_order_sql("period")
BACK = f"{fiscal_key_sql('period')} DESC NULLS FIRST, period DESC"
SERIES = (
    "ser AS (SELECT company, trim(period) AS period, max(value) AS value FROM fx_facts WHERE metric = 'revenue' "
    "AND level IN ('consolidated', 'standalone', 'line') AND is_valid GROUP BY ALL)"
)
STEPS = f"steps AS (SELECT *, lag(value) OVER (PARTITION BY company ORDER BY {ORDER}) AS prev FROM ser)"


def series(spark, sf):
    rows = P.valid_facts(fx.facts(spark, sf))
    return max_per_period(rows.where(rows.metric == "revenue"), KEY)


def sql(body: str, *ctes: str) -> str:
    return fx.with_views("facts", body, SERIES, STEPS, *ctes)


_TREND = (
    "classed AS (SELECT *, CASE WHEN prev IS NULL THEN NULL WHEN abs((value - prev) / CASE WHEN prev = 0 THEN 1 ELSE prev "
    "END * 100e0) < 2 THEN 'stable' WHEN value > prev THEN 'up' WHEN value < prev THEN 'down' END AS step FROM steps)",
    "counted AS (SELECT company, count(*) AS periods, count(*) FILTER (step = 'up') AS up, count(*) FILTER "
    f"(step = 'down') AS down, count(*) FILTER (step = 'stable') AS stable, first(value ORDER BY {ORDER}) AS a, "
    f"first(value ORDER BY {BACK}) AS b FROM classed GROUP BY company)",
)


@query(
    "w6_trend_class",
    sql(
        "SELECT company, periods, up, down, stable, CASE WHEN periods < 2 THEN 'insufficient' WHEN up >= periods * 0.6e0 "
        "THEN 'upward' WHEN down >= periods * 0.6e0 THEN 'downward' WHEN stable >= periods * 0.6e0 THEN 'stable' "
        "WHEN b - a > 0 THEN 'mixed-positive' WHEN b - a < 0 THEN 'mixed-negative' ELSE 'stable' END AS trend FROM counted",
        *_TREND,
    ),
)
def trend_class(spark, sf):
    return S.trend_class(series(spark, sf), "value", KEY)


@query(
    "w7_direction_counts",
    sql(
        "SELECT company, rises, falls, CASE WHEN rises > falls THEN 'upward' WHEN falls > rises THEN 'downward' "
        f"ELSE 'stable' END AS trend, {rnd('rises / nullif(n - 1, 0)', 4)} AS consistency FROM (SELECT company, "
        "count(*) FILTER (value > prev) AS rises, count(*) FILTER (value < prev) AS falls, count(*) AS n FROM steps "
        "GROUP BY company)"
    ),
)
def direction_counts(spark, sf):
    return S.direction_counts(series(spark, sf), "value", KEY)


@query(
    "w8_anomalies",
    sql(
        f"SELECT company, period, value, {rnd('abs(gap / nullif(sd, 0))', 1)} AS z_score, CASE WHEN gap > 0 THEN 'above' "
        "ELSE 'below' END AS side FROM (SELECT *, value - mean AS gap, sqrt(avg((value - mean) * (value - mean)) OVER "
        "(PARTITION BY company)) AS sd FROM (SELECT *, count(*) OVER (PARTITION BY company) AS n, CAST(sum(CAST(value AS "
        "DECIMAL(32,6))) OVER (PARTITION BY company) AS DOUBLE) / count(*) OVER (PARTITION BY company) AS mean FROM ser)) "
        "WHERE n >= 3 AND abs(gap / nullif(sd, 0)) > 1.5e0"
    ),
)
def anomalies(spark, sf):
    return S.anomalies(series(spark, sf), "value", KEY)


_G = "CASE WHEN prev > 0 THEN (value - prev) / prev * 100e0 END"
for _over, _base in (("positive_bases", "count(g)"), ("all_steps", "count(*) - 1")):
    _mean = f"coalesce({xsum('g')}, 0) / nullif({_base}, 0)"
    if _over == "positive_bases":
        _mean = f"coalesce({_mean}, 0)"

    @query(
        f"w10_average_growth_{_over}",
        sql(
            f"SELECT company, {rnd(_mean, 1)} AS average_growth_pct FROM (SELECT company, {_G} AS g FROM steps) "
            "GROUP BY company"
        ),
    )
    def average_growth(spark, sf, _over=_over):
        return S.average_growth(series(spark, sf), "value", KEY, _over)


@query(
    "w11_latest_growth",
    sql(
        f"SELECT company, period, {rnd('(value - prev) / nullif(prev, 0) * 100e0', 1)} AS growth_pct FROM (SELECT *, "
        f"row_number() OVER (PARTITION BY company ORDER BY {BACK}) AS rn FROM steps) WHERE rn = 1"
    ),
)
def latest_growth(spark, sf):
    return S.latest_growth(series(spark, sf), "value", KEY)


@query(
    "w12_period_changes",
    sql(
        "SELECT company, period, value - prev AS change, coalesce(CASE WHEN prev > 0 THEN "
        f"{rnd('(value - prev) / prev * 100e0', 1)} END, 0) AS change_pct FROM (SELECT *, lag(value) OVER (PARTITION BY "
        f"company ORDER BY {ORDER}) AS prev FROM (SELECT company, period, value, row_number() OVER (PARTITION BY company "
        f"ORDER BY {BACK}) AS rn FROM ser) WHERE rn <= 6) WHERE prev IS NOT NULL"
    ),
)
def period_changes(spark, sf):
    return S.period_changes(series(spark, sf), "value", 6, KEY)


@query(
    "w13_superlative_year",
    sql(
        f"SELECT company, first(period ORDER BY value DESC, {ORDER}) AS best_period, max(value) AS best_value, "
        f"first(period ORDER BY value ASC, {ORDER}) AS worst_period, min(value) AS worst_value FROM ser GROUP BY company"
    ),
)
def superlative_year(spark, sf):
    return S.superlative_year(series(spark, sf), "value", KEY)


@query(
    "w14_series_summary",
    sql(
        f"SELECT company, first_period, first_value, last_period, last_value, {rnd('last_value - first_value', 4)} AS delta, "
        "CASE WHEN abs(last_value - first_value) < 1 THEN 'flat' WHEN last_value > first_value THEN 'up' ELSE 'down' END "
        "AS direction, peak_period, peak_value FROM (SELECT company, "
        f"first(period ORDER BY {ORDER}) AS first_period, first(value ORDER BY {ORDER}) AS first_value, "
        f"first(period ORDER BY {BACK}) AS last_period, first(value ORDER BY {BACK}) AS last_value, "
        f"first(period ORDER BY value DESC, {ORDER}) AS peak_period, max(value) AS peak_value FROM ser GROUP BY company)"
    ),
)
def series_summary(spark, sf):
    return S.series_summary(series(spark, sf), "value", KEY)


@query(
    "w15_dip_years",
    sql(
        f"SELECT company, coalesce(string_agg(period, ',' ORDER BY {ORDER}) FILTER (value < prev), '') AS dip_periods, "
        f"count(*) FILTER (value < prev) AS dips, {rnd('(b - a) * 100e0 / nullif(abs(a), 0)', 2)} AS change_pct FROM "
        f"(SELECT *, first_value(value) OVER (PARTITION BY company ORDER BY {ORDER}) AS a, first_value(value) OVER "
        f"(PARTITION BY company ORDER BY {BACK}) AS b FROM steps) GROUP BY company, a, b"
    ),
)
def dip_years(spark, sf):
    return S.dip_years(series(spark, sf), "value", KEY)


_SCORED = (
    "yearly AS (SELECT company, trim(period) AS period, max(value) FILTER (metric = 'revenue') AS revenue, "
    "max(value) FILTER (metric = 'expenses') AS expense FROM fx_facts WHERE metric IN ('revenue', 'expenses') GROUP BY ALL)",
    f"stepped AS (SELECT *, revenue - expense AS profit, lag(revenue) OVER (PARTITION BY company ORDER BY {ORDER}) AS prev, "
    "CAST(sum(CAST(revenue AS DECIMAL(32,6))) OVER (PARTITION BY company) AS DOUBLE) AS total FROM yearly)",
    "scored AS (SELECT *, CASE WHEN prev > 0 THEN (revenue - prev) / prev * 100e0 END AS growth, "
    "coalesce(profit / nullif(revenue, 0) * 100e0, 0) AS margin FROM stepped)",
    "ranked AS (SELECT *, profit * 0.5e0 + margin * total / 100e0 * 0.3e0 + coalesce(growth, 0) * total / 100e0 * 0.2e0 "
    "AS score FROM scored)",
)


@query(
    "w9_best_year_score",
    fx.with_views(
        "facts",
        f"SELECT company, total_revenue, total_expense, total_revenue - total_expense AS total_profit, CASE WHEN "
        f"total_revenue > 0 THEN {rnd('(total_revenue - total_expense) / total_revenue * 100e0', 1)} ELSE 0 END "
        f"AS overall_margin_pct, {rnd('coalesce(avg_growth, 0)', 1)} AS average_growth_pct, best_year, best_year_profit, "
        f"{rnd('m', 1)} AS best_year_margin_pct FROM (SELECT company, {xsum('revenue')} AS total_revenue, "
        f"{xsum('expense')} AS total_expense, {xsum('growth')} / nullif(count(growth), 0) AS avg_growth, "
        f"first(period ORDER BY score DESC, {ORDER}) AS best_year, first(profit ORDER BY score DESC, {ORDER}) "
        f"AS best_year_profit, first(margin ORDER BY score DESC, {ORDER}) AS m FROM ranked GROUP BY company)",
        *_SCORED,
    ),
)
def best_year_score(spark, sf):
    from pyspark.sql import functions as F

    rows = fx.facts(spark, sf).where(F.col("metric").isin("revenue", "expenses"))
    yearly = rows.groupBy("company", F.trim("period").alias("period")).agg(
        F.max(F.when(F.col("metric") == "revenue", F.col("value"))).alias("revenue"),
        F.max(F.when(F.col("metric") == "expenses", F.col("value"))).alias("expense"),
    )
    return S.best_year_score(yearly.withColumn("profit", F.col("revenue") - F.col("expense")), KEY)


@query(
    "c12_next_period",
    sql(
        "SELECT company, max(CAST(nullif(regexp_extract(period, '(20[0-9]{2})', 1), '') AS INTEGER)) + 1 AS next_period "
        "FROM ser GROUP BY company"
    ),
)
def next_period(spark, sf):
    return S.next_period(series(spark, sf), KEY)


