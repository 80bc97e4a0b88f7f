"""Queries over the long fact table: hygiene, series, pivot, ratios of the server profile, selection, storage forms."""

from __future__ import annotations

from pyspark.sql import functions as F

from finfacts.functions import lines, periods
from finfacts.functions.rules import FACT_FAMILIES
from finfacts.operators import aggregate as A
from finfacts.operators import filters as P
from finfacts.operators import ordering as L
from finfacts.operators import pivot as V
from finfacts.operators import ratios as R
from finfacts.operators import series as S
from finfacts.plans.answers import answer_series
from finfacts.plans.dashboard import ratio_dashboard
from finfacts.sources import facts as SF

from . import fixtures as fx
from .registry import query
from .sqltext import any_sql, fiscal_key_sql, fiscal_order_sql, ledger_number_sql, pct, rnd, xavg, xsum

KEY = ("company",)
FACT_COLS = "id, company, statement_type, metric, period, value, unit, level, currency, source_file, source_page, is_valid, extraction_method, confidence"
COLS = [c.strip() for c in FACT_COLS.split(",")]
VALID = "level IN ('consolidated', 'standalone', 'line') AND is_valid"


def facts(spark, sf):
    return fx.facts(spark, sf).select(*COLS, "raw")


# --- hygiene and series -------------------------------------------------------------------------


@query("p1_valid_facts", fx.with_views("facts", f"SELECT {FACT_COLS} FROM fx_facts WHERE {VALID}"))
def valid_facts(spark, sf):
    return P.valid_facts(facts(spark, sf)).select(*COLS)


FAMILIES = {
    "revenue": ("revenue",),
    "expenses": ("expenses", "cogs"),
    "profit": ("net_income", "operating_income", "ebitda"),
}
for _name, _metrics in FAMILIES.items():
    _in = ", ".join(f"'{m}'" for m in _metrics)

    @query(
        f"p2_metric_series_{_name}",
        fx.with_views(
            "facts", f"SELECT company, period, value AS {_name} FROM fx_facts WHERE {VALID} AND metric IN ({_in})"
        ),
    )
    def metric_series(spark, sf, _name=_name, _metrics=_metrics):
        return P.metric_series(facts(spark, sf), _metrics, _name, KEY)


@query(
    "p3_consolidated_metric",
    fx.with_views(
        "facts",
        "SELECT company, period, value FROM fx_facts WHERE metric = 'revenue' AND level = 'consolidated' AND is_valid",
    ),
)
def consolidated_metric(spark, sf):
    return P.consolidated_metric(facts(spark, sf), "revenue").select("company", "period", "value")


@query(
    "p4_period_contains_years",
    fx.with_views(
        "facts",
        "SELECT id, period, value FROM fx_facts WHERE period LIKE '%2016%' OR period LIKE '%2017%' "
        "OR period LIKE '%2018%'",
    ),
)
def period_contains_years(spark, sf):
    return P.period_contains_years(facts(spark, sf), 2018, 2016).select("id", "period", "value")


@query(
    "p5_period_overlaps",
    fx.with_views(
        "facts",
        "SELECT id, period, value FROM fx_facts WHERE CASE WHEN "
        "len(regexp_extract_all(period, '\\b((?:19|20)[0-9]{2})\\b', 1)) > 0 "
        "THEN len(list_filter(regexp_extract_all(period, '\\b((?:19|20)[0-9]{2})\\b', 1), "
        "lambda y: CAST(y AS INTEGER) BETWEEN 2017 AND 2019)) > 0 "
        f"ELSE coalesce({fiscal_key_sql('period')} BETWEEN 2017 AND 2019, FALSE) END",
    ),
)
def period_overlaps(spark, sf):
    return P.period_overlaps(facts(spark, sf), 2017, 2019).select("id", "period", "value")


@query(
    "p7_valid_year",
    fx.with_views(
        "facts",
        "SELECT id, period, coalesce(try_cast(trim(period) AS INTEGER) BETWEEN 2000 AND 2100, FALSE) AS is_year "
        "FROM fx_facts",
    ),
)
def valid_year(spark, sf):
    return facts(spark, sf).select("id", "period", periods.valid_year("period").alias("is_year"))


_REPORT = "try_cast(nullif(regexp_extract(source_file, '((?:19|20)[0-9]{2})', 1), '') AS INTEGER)"


@query(
    "p8_report_year_gate",
    fx.with_views(
        "facts",
        f"SELECT id, period, source_file, extraction_method FROM fx_facts "
        f"WHERE try_cast(trim(period) AS INTEGER) BETWEEN 1990 AND 2030 AND ({_REPORT} IS NULL OR "
        f"try_cast(trim(period) AS INTEGER) BETWEEN {_REPORT} - 3 AND {_REPORT} + 1 "
        f"OR extraction_method IN ('pdf_image_fallback', 'pdf_row_parser'))",
    ),
)
def report_year_gate(spark, sf):
    return P.report_year_gate(facts(spark, sf)).select("id", "period", "source_file", "extraction_method")


_NOT_AMOUNT = any_sql("lower(trim(cell))", ["%", "ratio", "margin", "per share", "eps", "growth"])


@query(
    "p9_valid_amount",
    fx.with_views(
        "statement",
        f"SELECT id, cell FROM (SELECT id, cell, {ledger_number_sql('cell')} AS v FROM fx_statement) "
        f"WHERE NOT {_NOT_AMOUNT} AND v >= 1000 "
        "AND NOT regexp_matches(regexp_replace(lower(trim(cell)), '[,\\s₹$€£()\\-+]', '', 'g'), '[a-z]')",
    ),
)
def valid_amount(spark, sf):
    from finfacts.functions.numbers import parse_ledger_number

    rows = fx.statement(spark, sf).withColumns({"v": parse_ledger_number("cell"), "metric": F.lit("revenue")})
    return rows.where(lines.valid_amount("cell", "v", "metric")).select("id", "cell")


@query(
    "p11_latest_facts",
    fx.with_views(
        "facts",
        f"SELECT period, metric, value, currency, company FROM fx_facts WHERE {VALID} "
        "ORDER BY period DESC, id ASC LIMIT 100",
    ),
)
def latest_facts(spark, sf):
    return P.latest_facts(facts(spark, sf), 100, tie=("id",))


# --- pivot and ratios ---------------------------------------------------------------------------

_SLOTS = ", ".join(
    f"max(CASE WHEN metric IN ({', '.join(repr(n) for n in names)}) THEN value END) AS {slot}"
    for slot, names in FACT_FAMILIES.items()
)
PIVOT = f"piv AS (SELECT company, period, {_SLOTS} FROM fx_facts WHERE {VALID} GROUP BY company, period)"
ENRICHED = """enr AS (SELECT *, coalesce(operating_income, revenue - expenses) AS op_for_margin,
  coalesce(ebitda, operating_income) AS ebit FROM piv)"""
PREV = "lag({c}) OVER (PARTITION BY company ORDER BY period)"
RATIO_SQL = {
    "gross_profit": rnd("revenue - cogs", 2),
    "gross_margin_pct": pct("revenue - cogs", "revenue"),
    "operating_margin_pct": pct("op_for_margin", "revenue"),
    "ebitda_amount": "ebitda",
    "ebitda_margin_pct": pct("ebitda", "revenue"),
    "net_profit_margin_pct": pct("net_income", "revenue"),
    "roe_pct": pct("net_income", "equity"),
    "roa_pct": pct("net_income", "total_assets"),
    "roce_pct": pct("ebit", "(total_assets - coalesce(current_liabilities, 0))"),
    "current_ratio": rnd("current_assets / nullif(current_liabilities, 0)", 3),
    "quick_ratio": rnd("(current_assets - coalesce(inventory, 0)) / nullif(current_liabilities, 0)", 3),
    "debt_to_equity": rnd("total_debt / nullif(equity, 0)", 3),
    "interest_coverage": rnd("ebit / nullif(interest_expense, 0)", 3),
    "asset_turnover": rnd("revenue / nullif(total_assets, 0)", 3),
    "inventory_days": rnd("365e0 * coalesce(inventory, 0) / nullif(cogs, 0)", 1),
    "receivable_days": rnd("365e0 * coalesce(receivables, 0) / nullif(revenue, 0)", 1),
    "payable_days": rnd("365e0 * coalesce(payables, 0) / nullif(cogs, 0)", 1),
    "eps": rnd("net_income / nullif(shares, 0)", 4),
    "pe_ratio": rnd("share_price * shares / nullif(net_income, 0)", 2),
}
YOY_SQL = {
    "yoy_revenue_growth_pct": pct(f"revenue - {PREV.format(c='revenue')}", PREV.format(c="revenue")),
    "yoy_net_income_growth_pct": pct(f"net_income - {PREV.format(c='net_income')}",
                                     f"abs({PREV.format(c='net_income')})"),
}


def pivoted(spark, sf):
    return V.pivot_facts(P.valid_facts(facts(spark, sf)), KEY, "max")


def enriched(spark, sf):
    return V.enrich(pivoted(spark, sf), "server")


@query("a1_pivot_facts_max", fx.with_views("facts", "SELECT * FROM piv", PIVOT))
def pivot_facts_max(spark, sf):
    return pivoted(spark, sf)


@query(
    "a4_enrich_server",
    fx.with_views(
        "facts",
        "SELECT company, period, op_for_margin, ebit, ebitda AS ebitda_amount, revenue - cogs AS gross_profit_base, "
        "total_assets - coalesce(current_liabilities, 0) AS capital_employed FROM enr",
        PIVOT, ENRICHED,
    ),
)
def enrich_server(spark, sf):
    return enriched(spark, sf).select(
        "company", "period", "op_for_margin", "ebit", "ebitda_amount", "gross_profit_base", "capital_employed"
    )


@query(
    "a5_compare_metrics",
    fx.with_views(
        "facts",
        "SELECT company, period, max(CASE WHEN metric = 'revenue' THEN value END) AS revenue, "
        "max(CASE WHEN metric IN ('expenses', 'cogs') THEN value END) AS expenses "
        f"FROM fx_facts WHERE {VALID} GROUP BY ALL",
    ),
)
def compare_metrics(spark, sf):
    return V.compare_metrics(facts(spark, sf), KEY)


for _i, (_name, _sql) in enumerate(RATIO_SQL.items(), start=1):

    @query(
        f"r{_i}_{_name}",
        fx.with_views("facts", f"SELECT company, period, {_sql} AS {_name} FROM enr", PIVOT, ENRICHED),
    )
    def one_ratio(spark, sf, _name=_name):
        return R.ratios(enriched(spark, sf), KEY, "server", [_name])


@query(
    "r20_profit_margin_pct",
    fx.with_views(
        "facts",
        "SELECT company, period, "
        + pct("max(CASE WHEN metric IN ('net_income', 'operating_income', 'ebitda') THEN value END)",
              "max(CASE WHEN metric = 'revenue' THEN value END)")
        + f" AS profit_margin_pct FROM fx_facts WHERE {VALID} GROUP BY ALL "
        "HAVING max(CASE WHEN metric = 'revenue' THEN value END) > 0",
    ),
)
def profit_margin_pct(spark, sf):
    return R.profit_margin(facts(spark, sf), KEY)


_DASH = {**{c: c for c in P.DASHBOARD_COLUMNS}, **RATIO_SQL, **YOY_SQL}
_DASH_SELECT = ", ".join(f"{_DASH[c]} AS {c}" for c in P.DASHBOARD_COLUMNS)


@query(
    "r21_ratio_dashboard_server",
    fx.with_views("facts", f"SELECT company, {_DASH_SELECT} FROM enr", PIVOT, ENRICHED),
)
def dashboard_server(spark, sf):
    return ratio_dashboard(facts(spark, sf), KEY, "server")


@query(
    "r21_ratio_dashboard_server_range",
    fx.with_views(
        "facts",
        f"SELECT company, {_DASH_SELECT} FROM enr WHERE period LIKE '%2017%' OR period LIKE '%2018%' "
        "OR period LIKE '%2019%'",
        PIVOT, ENRICHED,
    ),
)
def dashboard_server_range(spark, sf):
    return ratio_dashboard(facts(spark, sf), KEY, "server", (2017, 2019))


@query(
    "r21_ratio_dashboard_all_companies",
    fx.with_views(
        "facts", f"SELECT {_DASH_SELECT.replace('PARTITION BY company ', '')} FROM enr",
        PIVOT.replace("SELECT company, period,", "SELECT period,").replace("GROUP BY company, period", "GROUP BY period"),
        ENRICHED,
    ),
)
def dashboard_all(spark, sf):
    return ratio_dashboard(facts(spark, sf), (), "server")


@query(
    "w1_yoy_server",
    fx.with_views(
        "facts",
        f"SELECT company, period, revenue, net_income, {', '.join(f'{e} AS {n}' for n, e in YOY_SQL.items())} "
        "FROM enr",
        PIVOT, ENRICHED,
    ),
)
def yoy_server(spark, sf):
    return R.yoy(pivoted(spark, sf).select("company", "period", "revenue", "net_income"), KEY, "label")


@query(
    "p10_select_kinds",
    fx.with_views(
        "facts",
        f"SELECT company, period, {RATIO_SQL['gross_profit']} AS gross_profit, {RATIO_SQL['gross_margin_pct']} "
        f"AS gross_margin_pct, {RATIO_SQL['roe_pct']} AS roe_pct FROM enr",
        PIVOT, ENRICHED,
    ),
)
def select_kinds(spark, sf):
    return P.select_kinds(ratio_dashboard(facts(spark, sf), KEY), ("gross_profit", "gross_margin", "roe"), KEY)


@query(
    "l6_chart_order",
    fx.with_views("facts", f"SELECT company, period, {RATIO_SQL['roe_pct']} AS roe_pct FROM enr", PIVOT, ENRICHED),
)
def chart_order(spark, sf):
    return L.chart_order(R.ratios(enriched(spark, sf), KEY, names=["roe_pct"]), KEY)


@query(
    "l1_fiscal_order",
    fx.with_views("facts", "SELECT company, period, revenue FROM piv", PIVOT),
)
def fiscal_order(spark, sf):
    return L.fiscal_order(pivoted(spark, sf).select("company", "period", "revenue"), KEY)


# --- pooled figures and selection ---------------------------------------------------------------


@query(
    "g17_pooled_totals",
    fx.with_views(
        "facts",
        f"SELECT company, {rnd(xsum('revenue'), 2)} AS revenue_total, {rnd(xsum('net_income'), 2)} AS net_income_total, "
        f"{rnd(xavg('roe'), 2)} AS roe_pct_avg, {rnd(xavg('npm'), 2)} AS net_profit_margin_pct_avg "
        f"FROM (SELECT *, {RATIO_SQL['roe_pct']} AS roe, {RATIO_SQL['net_profit_margin_pct']} AS npm FROM enr) "
        "GROUP BY company",
        PIVOT, ENRICHED,
    ),
)
def pooled_totals(spark, sf):
    return A.pooled_totals(facts(spark, sf), KEY)


for _high in (True, False):
    _dir = "DESC" if _high else "ASC"

    @query(
        f"g18_extreme_period_{'highest' if _high else 'lowest'}",
        fx.with_views(
            "facts",
            "SELECT company, period, value FROM (SELECT company, period, max(value) AS value, row_number() OVER "
            f"(PARTITION BY company ORDER BY max(value) {_dir}, period) AS rn FROM fx_facts "
            f"WHERE metric = 'revenue' AND {VALID} GROUP BY company, period) WHERE rn = 1",
        ),
    )
    def extreme_period(spark, sf, _high=_high):
        return A.extreme_period(facts(spark, sf), "revenue", _high, KEY)


@query("g19_distinct_metrics", fx.with_views("facts", "SELECT DISTINCT trim(metric) AS metric FROM fx_facts"))
def distinct_metrics(spark, sf):
    return A.distinct_metrics(facts(spark, sf))


@query(
    "g20_best_fact",
    fx.with_views(
        "facts",
        f"SELECT {FACT_COLS} FROM (SELECT *, row_number() OVER (PARTITION BY company, metric, period ORDER BY "
        "CASE WHEN level = 'consolidated' THEN 0 ELSE 1 END, value DESC, source_page, id) AS rn FROM fx_facts "
        "WHERE is_valid AND try_cast(trim(period) AS INTEGER) BETWEEN 2000 AND 2100) WHERE rn = 1",
    ),
)
def best_fact(spark, sf):
    return A.best_fact(facts(spark, sf).select(*COLS), KEY)


@query(
    "g21_max_per_period",
    fx.with_views(
        "facts",
        "SELECT company, trim(period) AS period, max(value) AS value FROM fx_facts WHERE metric = 'revenue' "
        "AND level = 'consolidated' AND is_valid GROUP BY ALL",
    ),
)
def max_per_period(spark, sf):
    return A.max_per_period(P.consolidated_metric(facts(spark, sf)), KEY)


@query(
    "g22_last_per_period",
    fx.with_views(
        "facts",
        "SELECT company, metric, period, id, value FROM (SELECT *, row_number() OVER (PARTITION BY company, metric, period "
        "ORDER BY id DESC) AS rn FROM fx_facts WHERE period IS NOT NULL) WHERE rn = 1",
    ),
)
def last_per_period(spark, sf):
    rows = facts(spark, sf).select("company", "metric", "period", "id", "value")
    return A.last_per_period(rows, "id", ("company", "metric"))


@query(
    "g24_fill_currency",
    fx.with_views(
        "facts",
        "SELECT id, company, coalesce(nullif(currency, ''), main) AS currency FROM fx_facts LEFT JOIN ("
        "SELECT company AS mc, currency AS main FROM (SELECT company, currency, row_number() OVER (PARTITION BY company "
        "ORDER BY count(*) DESC, currency) AS rn FROM fx_facts WHERE nullif(currency, '') IS NOT NULL "
        "GROUP BY company, currency) WHERE rn = 1) ON company = mc",
    ),
)
def fill_currency(spark, sf):
    return A.fill_currency(facts(spark, sf).select("id", "company", "currency"), KEY)


_PREV_VALUE = (
    "last_value(value IGNORE NULLS) OVER (PARTITION BY company, metric ORDER BY "
    f"{fiscal_order_sql('period')}, value ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
)


@query(
    "w18_check_series",
    fx.with_views(
        "facts",
        "SELECT company, metric, period, value, violation FROM (SELECT company, metric, period, value, unnest(list_filter(["
        "CASE WHEN nullif(period, '') IS NULL THEN 'missing period' END, "
        "CASE WHEN nullif(period, '') IS NOT NULL AND n > 1 THEN 'repeated period' END, "
        "CASE WHEN value < 1000 THEN 'amount under 1000' END, "
        "CASE WHEN prev > 0 AND value < prev * 0.1e0 THEN 'collapse' END], lambda v: v IS NOT NULL)) AS violation FROM ("
        f"SELECT company, metric, period, value, count(*) OVER (PARTITION BY company, metric, period) AS n, {_PREV_VALUE} AS prev "
        f"FROM fx_facts WHERE {VALID}))",
    ),
)
def check_series(spark, sf):
    rows = P.valid_facts(facts(spark, sf))
    return S.check_series(rows.select("company", "metric", "period", "value"), "value", ("company", "metric"))


_IN_ORDER = f"PARTITION BY company ORDER BY {fiscal_order_sql('period')}, value ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"


@query(
    "ask_revenue_series",
    fx.with_views(
        "facts",
        "SELECT company, period, value, nullif(array_to_string(list_sort(list_filter([CASE WHEN nullif(period, '') IS NULL THEN "
        "'missing period' END, CASE WHEN value < 1000 THEN 'amount under 1000' END, CASE WHEN prev > 0 AND value < prev * 0.1e0 "
        "THEN 'collapse' END], lambda v: v IS NOT NULL)), ', '), '') AS problems FROM (SELECT *, last_value(value IGNORE NULLS) OVER "
        f"({_IN_ORDER}) AS prev FROM lasts)",
        "lasts AS (SELECT company, period, value FROM (SELECT *, row_number() OVER (PARTITION BY company, period ORDER BY id DESC) AS rn "
        f"FROM fx_facts WHERE metric IN ('revenue', 'net_income') AND value IS NOT NULL AND period IS NOT NULL AND {VALID}) WHERE rn = 1)",
    ),
)
def ask_series(spark, sf):
    return answer_series(facts(spark, sf), ("revenue", "net_income"), KEY, ordered=False)


# --- storage forms ------------------------------------------------------------------------------


@query("s1_read_facts", fx.with_views("facts", f"SELECT {FACT_COLS} FROM fx_facts"))
def read_facts(spark, sf):
    return SF.conform_facts(facts(spark, sf))


@query(
    "s6_replace_facts",
    fx.with_views(
        "facts",
        "SELECT company, source_file, id, value FROM fx_facts f WHERE NOT EXISTS (SELECT 1 FROM fx_facts g "
        "WHERE g.metric = 'revenue' AND g.level = 'consolidated' AND g.company = f.company "
        "AND g.source_file = f.source_file) UNION ALL SELECT company, source_file, id, value * 2 FROM fx_facts "
        "WHERE metric = 'revenue' AND level = 'consolidated'",
    ),
)
def replace_facts(spark, sf):
    stored = facts(spark, sf).select("company", "source_file", "id", "value", "metric", "level")
    fresh = stored.where((F.col("metric") == "revenue") & (F.col("level") == "consolidated"))
    fresh = fresh.withColumn("value", F.col("value") * 2)
    return SF.replace_facts(stored, fresh).select("company", "source_file", "id", "value")


@query(
    "s8_candidates_to_facts",
    fx.with_views(
        "facts",
        "SELECT id, 'group of ' || company AS company, 'annual.pdf' AS source_file, metric, period, value FROM fx_facts",
    ),
)
def candidates_to_facts(spark, sf):
    rows = facts(spark, sf).select("id", "metric", "period", "value", "raw", F.col("company").alias("owner"))
    named = SF.candidates_to_facts(rows, F.concat(F.lit("group of "), F.col("owner")), "annual.pdf")
    return named.select("id", "company", "source_file", "metric", "period", "value")


@query(
    "s10_upgrade_facts",
    fx.with_views(
        "facts",
        "SELECT id, company, coalesce(CASE WHEN id % 3 = 0 THEN NULL ELSE unit END, 'INR_CRORE') AS unit, "
        "coalesce(CASE WHEN id % 7 = 0 THEN NULL ELSE level END, 'segment') AS level, "
        "'income_statement' AS statement_type, TRUE AS is_valid, 1 AS source_page, 'rule' AS extraction_method, "
        "CAST(NULL AS DOUBLE) AS confidence, value FROM fx_facts",
    ),
)
def upgrade_facts(spark, sf):
    old = facts(spark, sf).select(
        "id", "company", "metric", "period", "value",
        F.when(F.col("id") % 3 != 0, F.col("unit")).alias("unit"),
        F.when(F.col("id") % 7 != 0, F.col("level")).alias("level"),
    )
    return SF.upgrade_facts(old).select(
        "id", "company", "unit", "level", "statement_type", "is_valid", "source_page", "extraction_method",
        "confidence", "value",
    )


@query(
    "s11_preview_facts",
    fx.with_views(
        "facts",
        "SELECT try_cast(trim(period) AS INTEGER) AS year, metric, CAST(trunc(value) AS BIGINT) AS value, coalesce(raw, '') AS raw, "
        "coalesce(nullif(currency, ''), 'INR') AS currency FROM fx_facts WHERE period IS NOT NULL AND value IS NOT NULL "
        "ORDER BY id LIMIT 200",
    ),
)
def preview_facts(spark, sf):
    return SF.preview_facts(facts(spark, sf), "INR", 200, ("id",))


@query("s12_cap_rows", fx.with_views("facts", f"SELECT {FACT_COLS} FROM fx_facts ORDER BY id LIMIT 200"))
def cap_rows(spark, sf):
    return SF.conform_facts(SF.cap_rows(facts(spark, sf), 200, ("id",)))


@query("p12_sample_rows", fx.with_views("facts", f"SELECT {FACT_COLS} FROM fx_facts ORDER BY id LIMIT 10"))
def sample_rows(spark, sf):
    return SF.conform_facts(P.sample_rows(facts(spark, sf), 10, ("id",)))
