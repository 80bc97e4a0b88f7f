"""Queries over a generic sales sheet and the dashboard groups of long and wide sheets."""

from __future__ import annotations

from pyspark.sql import functions as F

from finfacts.functions.rules import DASHBOARD_CLASSES
from finfacts.operators import aggregate as A
from finfacts.operators import quantiles as Q
from finfacts.operators import series as S
from finfacts.sources.sheets import coerce_cells

from . import fixtures as fx
from .registry import query
from .sqltext import case_sql, coerce_sql, dashboard_number_sql, fiscal_key_sql, fiscal_order_sql, rnd, xavg, xsum

KEY = ("company",)

# --- generic groups over order lines ------------------------------------------------------------

SHEET = (
    f"sheet AS (SELECT seq, trim(region) AS area, region, year, coalesce({coerce_sql('amount')}, 0e0) AS amount, "
    f"coalesce({coerce_sql('cost')}, 0e0) AS cost FROM fx_sales)"
)


def sheet(spark, sf):
    rows = coerce_cells(fx.sales(spark, sf), ["amount", "cost"])
    return rows.select(
        "seq", F.trim("region").alias("area"), "region", "year", F.col("amount_num").alias("amount"),
        F.col("cost_num").alias("cost"),
    )


def sales_sql(body: str, *ctes: str) -> str:
    return fx.with_views("sales", body, SHEET, *ctes)


for _order, _sql in (("desc", "total DESC, area"), ("asc", "total ASC, area"), ("time", "area")):

    @query(
        f"g1_group_sum_{_order}",
        sales_sql(f"SELECT area, {xsum('amount')} AS total FROM sheet GROUP BY area ORDER BY {_sql} LIMIT 10"),
    )
    def group_sum(spark, sf, _order=_order):
        return A.group_sum(sheet(spark, sf), "area", "amount", order=_order, n=10)


@query(
    "g1_group_sum_per_year",
    sales_sql(
        "SELECT year, area, total FROM (SELECT year, area, total, row_number() OVER (PARTITION BY year ORDER BY "
        f"total DESC, area) AS rn FROM (SELECT year, area, {xsum('amount')} AS total FROM sheet GROUP BY ALL)) WHERE rn <= 10"
    ),
)
def group_sum_per_year(spark, sf):
    return A.group_sum(sheet(spark, sf), "area", "amount", ("year",), n=10)


@query(
    "g2_group_avg",
    sales_sql(
        f"SELECT area, {rnd(xsum('amount') + ' / count(*)')} AS average FROM sheet GROUP BY area "
        "ORDER BY average DESC, area LIMIT 10"
    ),
)
def group_avg(spark, sf):
    return A.group_avg(sheet(spark, sf), "area", "amount", n=10)


@query(
    "g3_group_count",
    sales_sql("SELECT area, count(*) AS rows FROM sheet GROUP BY area ORDER BY rows DESC, area LIMIT 10"),
)
def group_count(spark, sf):
    return A.group_count(sheet(spark, sf), "area", n=10)


@query("g4_grand_total", sales_sql(f"SELECT {xsum('amount')} AS total FROM sheet"))
def grand_total(spark, sf):
    return A.grand_total(sheet(spark, sf), "amount")


PROFIT = (
    f"prof AS (SELECT area, {xsum('amount')} AS revenue, {xsum('cost')} AS expense, {xsum('amount')} - {xsum('cost')} "
    "AS profit FROM sheet GROUP BY area)"
)


@query("g5_profit_breakdown", sales_sql("SELECT * FROM prof ORDER BY profit DESC, area LIMIT 10", PROFIT))
def profit_breakdown(spark, sf):
    return A.profit_breakdown(sheet(spark, sf), "area", "amount", "cost", n=10)


MARGIN = rnd("coalesce(profit / nullif(revenue, 0) * 100e0, 0)", 2)


@query(
    "g6_compare_revenue_expense",
    sales_sql(f"SELECT *, {MARGIN} AS margin_pct FROM prof ORDER BY revenue DESC, area LIMIT 10", PROFIT),
)
def compare(spark, sf):
    return A.compare_revenue_expense(sheet(spark, sf), "area", "amount", "cost", n=10)


@query(
    "g6_compare_revenue_expense_by_year",
    sales_sql(
        f"SELECT *, {MARGIN} AS margin_pct FROM prof ORDER BY year LIMIT 10",
        PROFIT.replace("SELECT area", "SELECT year").replace("GROUP BY area", "GROUP BY year"),
    ),
)
def compare_by_year(spark, sf):
    return A.compare_revenue_expense(sheet(spark, sf), "year", "amount", "cost", time_like=True, n=10)


@query(
    "g7_margin_by_group",
    sales_sql(
        f"SELECT *, (SELECT {rnd(xavg('margin_pct'), 2)} FROM shown) AS average_margin_pct, (SELECT max(margin_pct) FROM shown) "
        "AS best_margin_pct, (SELECT min(area) FROM shown WHERE margin_pct = (SELECT max(margin_pct) FROM shown)) AS best_group "
        "FROM shown ORDER BY margin_pct DESC, area LIMIT 10",
        f"shown AS (SELECT area, {xsum('amount')} AS revenue, {xsum('cost')} AS profit, "
        f"coalesce({rnd(xsum('cost') + ' * 100e0 / nullif(' + xsum('amount') + ', 0)', 2)}, 0) AS margin_pct "
        "FROM sheet GROUP BY area)",
    ),
)
def margin_by_group(spark, sf):
    return A.margin_by_group(sheet(spark, sf), "area", "amount", "cost", n=10)


_GROWTH = "CASE WHEN prev > 0 THEN (revenue - prev) / prev * 100e0 END"
SUMMARY = (
    f"yearly AS (SELECT year AS period, {xsum('amount')} AS revenue, {xsum('cost')} AS expense FROM sheet GROUP BY year)",
    "stepped AS (SELECT *, revenue - expense AS profit, lag(revenue) OVER (ORDER BY period) AS prev, "
    "CAST(sum(CAST(revenue AS DECIMAL(32,6))) OVER () AS DOUBLE) AS total FROM yearly)",
    f"scored AS (SELECT *, {_GROWTH} AS growth, coalesce(profit / nullif(revenue, 0) * 100e0, 0) AS margin FROM stepped)",
    "ranked AS (SELECT *, profit * 0.5e0 + margin * total / 100e0 * 0.3e0 + coalesce(growth, 0) * total / 100e0 * 0.2e0 "
    "AS score FROM scored)",
)


@query(
    "g8_financial_summary",
    sales_sql(
        f"SELECT {xsum('revenue')} AS total_revenue, {xsum('expense')} AS total_expense, "
        f"{xsum('revenue')} - {xsum('expense')} AS total_profit, "
        f"{rnd(f'({xsum('revenue')} - {xsum('expense')}) / {xsum('revenue')} * 100e0', 1)} AS overall_margin_pct, "
        f"{rnd(f'coalesce({xavg('growth')}, 0)', 1)} AS average_growth_pct, "
        "first(period ORDER BY score DESC, period) AS best_year, first(profit ORDER BY score DESC, period) "
        f"AS best_year_profit, {rnd('first(margin ORDER BY score DESC, period)', 1)} AS best_year_margin_pct FROM ranked",
        *SUMMARY,
    ),
)
def financial_summary(spark, sf):
    return A.financial_summary(sheet(spark, sf), "year", "amount", "cost")


@query(
    "w2_growth_rate",
    sales_sql(
        f"SELECT year, total, coalesce({rnd('(total - prev) / nullif(prev, 0) * 100e0', 1)}, 0) AS growth_pct FROM "
        f"(SELECT year, total, lag(total) OVER (ORDER BY year) AS prev FROM (SELECT year, {xsum('amount')} AS total "
        "FROM sheet GROUP BY year))"
    ),
)
def growth_rate(spark, sf):
    return S.growth_rate(sheet(spark, sf), "year", "amount")


for _low in (False, True):

    @query(
        f"l5_one_answer_{'lowest' if _low else 'highest'}",
        sales_sql(
            f"SELECT area, {xsum('amount')} AS total FROM sheet GROUP BY area ORDER BY total "
            f"{'ASC' if _low else 'DESC'}, area LIMIT 1"
        ),
    )
    def one_answer(spark, sf, _low=_low):
        return A.one_answer(sheet(spark, sf), "area", "amount", low=_low)


@query(
    "g26_sales_total",
    fx.with_views(
        "sales",
        "SELECT CAST(sum(CAST(coalesce(try_cast(regexp_extract(regexp_replace(amount, '[^0-9.\\-]', '', 'g'), "
        "'^[+-]?(?:[0-9]+\\.?[0-9]*|\\.[0-9]+)') AS DOUBLE), 0e0) AS DECIMAL(32,6))) AS DOUBLE) AS total_sales "
        "FROM fx_sales",
    ),
)
def sales_total(spark, sf):
    return A.sales_total(fx.sales(spark, sf))


@query("g27_sheet_size", fx.with_views("sales", "SELECT count(*) AS rows, 5 AS columns FROM fx_sales"))
def sheet_size(spark, sf):
    return A.sheet_size(fx.sales(spark, sf))


# --- dashboard groups ---------------------------------------------------------------------------


def two_sql(source: str, by: str, first: str, second: str, keys: str = "", where: str = "") -> str:
    """Two totals per case-folded group."""
    name = f"trim(coalesce({by}, 'Unknown'))"
    k = f"{keys}, " if keys else ""
    return (
        f"SELECT {k}first({name} ORDER BY seq) AS name, {xsum(first)} AS value1, {xsum(second)} AS value2 "
        f"FROM {source} {where} GROUP BY {k}lower({name})"
    )


GROUPS = "grp AS (" + two_sql("sheet", "region", "amount", "cost") + ")"


@query("g11_sum_two", sales_sql("SELECT * FROM grp", GROUPS))
def sum_two(spark, sf):
    return A.sum_two(sheet(spark, sf), "region", "amount", "cost")


def groups(spark, sf):
    return A.sum_two(sheet(spark, sf), "region", "amount", "cost")


TOP = (
    "top15 AS (SELECT name, " + rnd("value1") + " AS value1, " + rnd("value2") + " AS value2, rank FROM (SELECT *, "
    "row_number() OVER (ORDER BY value1 + value2 DESC, name) AS rank FROM grp) WHERE rank <= 15)"
)


@query("l2_top_groups", sales_sql("SELECT name, value1, value2 FROM top15", GROUPS, TOP))
def top_groups(spark, sf):
    return A.top_groups(groups(spark, sf), 15)


@query(
    "g13_top_share",
    sales_sql(
        "SELECT name, value1, value2, rank, CASE WHEN pie > 0 THEN " + rnd("value1 / pie * 100e0")
        + " ELSE 0 END AS share_pct, CASE WHEN value1 + value2 > 0 THEN "
        + rnd("(value1 + value2) / largest * 100e0", 2)
        + " ELSE 0 END AS scale_pct FROM (SELECT *, CAST(sum(value1) OVER () AS DOUBLE) AS pie, (SELECT "
        "greatest(max(value1 + value2), 1e0) FROM top15) AS largest FROM top15 WHERE rank <= 5)",
        GROUPS, TOP,
    ),
)
def top_share(spark, sf):
    return A.top_share(groups(spark, sf), 5, 15)


@query(
    "l4_top_bottom",
    sales_sql(
        "SELECT name, value1, value2, rank, 'top' AS side, rank AS place FROM top15 WHERE rank <= 5 UNION ALL "
        "SELECT name, value1, value2, rank, 'bottom' AS side, n - rank + 1 AS place FROM (SELECT *, count(*) OVER () AS n "
        "FROM top15) WHERE rank > n - 5",
        GROUPS, TOP,
    ),
)
def top_bottom(spark, sf):
    return A.top_bottom(groups(spark, sf), 5, 15)


def kpi_sql(k: str = "", g: str = "") -> str:
    return (
        "SELECT " + k + rnd("t1") + " AS total1, " + rnd("t2") + " AS total2, " + rnd("t1 / n") + " AS average1, "
        + rnd("mx") + " AS max1, n AS groups, CASE WHEN t1 > 0 THEN " + rnd("t2 / t1 * 100e0", 1)
        + " ELSE 0 END AS rate_pct, CASE WHEN a > 0 THEN " + rnd("(b - a) / a * 100e0", 1)
        + " ELSE 0 END AS growth_pct, CASE WHEN t1 > 0 THEN " + rnd("(t1 - t2) / t1 * 100e0", 1)
        + " ELSE 0 END AS margin_pct FROM (SELECT " + k + xsum("value1") + " AS t1, " + xsum("value2") + " AS t2, "
        "max(value1) AS mx, count(*) AS n, first(value1 ORDER BY " + fiscal_order_sql("name") + ") AS a, "
        "first(value1 ORDER BY " + fiscal_key_sql("name") + " DESC NULLS FIRST, name DESC) AS b FROM grp " + g + ")"
    )


@query("g12_kpis", sales_sql(kpi_sql(), GROUPS))
def kpis(spark, sf):
    return A.kpis(groups(spark, sf))


# Order lines of a customer: many values per key, one key can hold any share of them.
LINES = "SELECT l_returnflag AS flag, CAST(l_quantity AS DOUBLE) * 10 + l_linenumber AS v, l_extendedprice AS price FROM lineitem"


def order_lines(spark, sf):
    return fx.table(spark, sf, "lineitem").select(
        F.col("l_returnflag").alias("flag"),
        (F.col("l_quantity") * 10 + F.col("l_linenumber")).alias("v"),
        F.col("l_extendedprice").alias("price"),
    )


@query(
    "g14_index_quartiles",
    "SELECT flag, min_value, q1, q2, q3, max_value, q3 - q1 AS iqr FROM (SELECT flag, s[1] AS min_value, "
    "s[CAST(floor(len(s) * 0.25) AS BIGINT) + 1] AS q1, s[CAST(floor(len(s) * 0.5) AS BIGINT) + 1] AS q2, "
    "s[CAST(floor(len(s) * 0.75) AS BIGINT) + 1] AS q3, s[len(s)] AS max_value FROM "
    f"(SELECT flag, list_sort(list(v)) AS s FROM ({LINES}) GROUP BY flag))",
)
def index_quartiles(spark, sf):
    return Q.index_quartiles(order_lines(spark, sf), ("flag",), "v")


@query(
    "g14_index_quartiles_of_groups",
    sales_sql(
        "SELECT min_value, q1, q2, q3, max_value, q3 - q1 AS iqr FROM (SELECT s[1] AS min_value, "
        "s[CAST(floor(len(s) * 0.25) AS BIGINT) + 1] AS q1, s[CAST(floor(len(s) * 0.5) AS BIGINT) + 1] AS q2, "
        "s[CAST(floor(len(s) * 0.75) AS BIGINT) + 1] AS q3, s[len(s)] AS max_value FROM "
        "(SELECT list_sort(list(value1)) AS s FROM grp))",
        GROUPS,
    ),
)
def index_quartiles_of_groups(spark, sf):
    return Q.index_quartiles(groups(spark, sf), (), "value1")


@query(
    "g15_median_of_groups",
    sales_sql(f"SELECT {rnd('median(value1)')} AS median FROM grp", GROUPS),
)
def median_of_groups(spark, sf):
    return Q.median_of_groups(groups(spark, sf))


@query("g15_median_of_lines", f"SELECT flag, {rnd('median(price)')} AS median FROM ({LINES}) GROUP BY flag")
def median_of_lines(spark, sf):
    return Q.median_of_groups(order_lines(spark, sf), ("flag",), "price")


# --- long and wide sheets -----------------------------------------------------------------------

_CLASS = case_sql("trim(lower(coalesce(metric, '')))", DASHBOARD_CLASSES)
LONG_CLASSED = (
    f"classed AS (SELECT company, seq, year, {_CLASS} AS kind, coalesce(try_cast(value AS DOUBLE), 0e0) AS v FROM fx_long)"
)
PERIODS = (
    "grp AS (" + two_sql("classed", "year", "CASE WHEN kind = 'core_revenue' THEN v ELSE 0e0 END",
                         "CASE WHEN kind = 'other_income' THEN v ELSE 0e0 END", "company") + ")"
)
PERIODS_EXPENSE = PERIODS.replace("'other_income'", "'expense'")


def periods(spark, sf, second="other_income"):
    return A.split_facts(fx.long_sheet(spark, sf), "year", KEY, second)


@query("g9_split_facts_other_income", fx.with_views("long", "SELECT * FROM grp", LONG_CLASSED, PERIODS))
def split_facts_other_income(spark, sf):
    return periods(spark, sf)


@query("g9_split_facts_expense", fx.with_views("long", "SELECT * FROM grp", LONG_CLASSED, PERIODS_EXPENSE))
def split_facts_expense(spark, sf):
    return periods(spark, sf, "expense")


_WIDE_CLASS = {
    "core_revenue": ["Revenue from Operations", "Sales Returns Revenue"],
    "expense": ["Total Expenses"],
    "other_income": ["Other Income"],
}


def _wide_sum(kind: str) -> str:
    return " + ".join(["0e0", *[dashboard_number_sql(f'"{h}"') for h in _WIDE_CLASS[kind]]])


for _kind in ("expense", "other_income"):

    @query(
        f"g10_split_wide_{_kind}",
        fx.with_views("wide", two_sql("fx_wide", '"Year"', _wide_sum("core_revenue"), _wide_sum(_kind), "company")),
    )
    def split_wide(spark, sf, _kind=_kind):
        return A.split_wide(fx.wide(spark, sf), "Year", KEY, _kind)


@query("g12_kpis_per_company", fx.with_views("long", kpi_sql("company, ", "GROUP BY company"), LONG_CLASSED, PERIODS))
def kpis_per_company(spark, sf):
    return A.kpis(periods(spark, sf), KEY)


@query(
    "l3_time_series",
    fx.with_views(
        "long",
        "SELECT company, name, " + rnd("value1") + " AS value1, " + rnd("value2") + " AS value2 FROM grp",
        LONG_CLASSED, PERIODS_EXPENSE,
    ),
)
def time_series(spark, sf):
    return A.time_series(periods(spark, sf, "expense"), KEY)


@query(
    "w17_advice_flags",
    fx.with_views(
        "long",
        "SELECT company, growth_pct < 5 AS weak_growth, rate_pct > 15 AS large_other_income, margin_pct < 20 AS low_margin, "
        "margin_pct > 40 AS high_margin, total2 = 0 AS no_second_series FROM ("
        + kpi_sql("company, ", "GROUP BY company") + ")",
        LONG_CLASSED, PERIODS,
    ),
)
def advice_flags(spark, sf):
    return S.advice_flags(A.kpis(periods(spark, sf), KEY), KEY)


_BEST = f"m DESC, {fiscal_order_sql('name')}"
_PEAK = f"value2 DESC, {fiscal_order_sql('name')}"


@query(
    "w16_best_margin_period",
    fx.with_views(
        "long",
        "SELECT company, best_period, " + rnd("bm * 100e0", 1) + " AS best_margin_pct, CASE WHEN a1 > 0 THEN "
        + rnd("(a1 - a2) / a1 * 100e0", 1) + " ELSE 0 END AS average_margin_pct, CASE WHEN a1 > 0 THEN "
        + rnd("a2 / a1 * 100e0", 1) + " ELSE 0 END AS average_share_pct, peak_share_period, CASE WHEN p1 > 0 THEN "
        + rnd("p2 / p1 * 100e0", 1) + " ELSE 0 END AS peak_share_pct FROM (SELECT company, "
        f"first(name ORDER BY {_BEST}) AS best_period, first(m ORDER BY {_BEST}) AS bm, {xavg('value1')} AS a1, "
        f"{xavg('value2')} AS a2, first(name ORDER BY {_PEAK}) AS peak_share_period, first(value1 ORDER BY {_PEAK}) AS p1, "
        f"first(value2 ORDER BY {_PEAK}) AS p2 FROM (SELECT *, CASE WHEN value1 > 0 THEN (value1 - value2) / value1 "
        "ELSE 0 END AS m FROM grp) GROUP BY company)",
        LONG_CLASSED, PERIODS_EXPENSE,
    ),
)
def best_margin_period(spark, sf):
    return S.best_margin_period(periods(spark, sf, "expense").withColumnRenamed("name", "period"), KEY)
