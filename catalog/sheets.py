"""Queries over printed statements, wide sheets and long ingest sheets: the sheet profile of pivot and ratios."""

from __future__ import annotations

from pyspark.sql import functions as F

from finfacts.functions.numbers import parse_sheet_number
from finfacts.functions.rules import SLOT_RULES
from finfacts.operators import aggregate as A
from finfacts.operators import filters as P
from finfacts.operators import longsheet as N
from finfacts.operators import pivot as V
from finfacts.operators import ratios as R
from finfacts.operators import series as S
from finfacts.plans.dashboard import ratio_dashboard, wide_dashboard
from finfacts.schema import SLOTS
from finfacts.sources import sheets as SS

from . import fixtures as fx
from .registry import query
from .sqltext import (
    case_sql,
    coerce_sql,
    fiscal_key_sql,
    fiscal_order_sql,
    pct,
    rnd,
    sheet_number_sql,
    squeeze_sql,
    xavg,
    xsum,
)

KEY = ("company",)

# --- the sheet pivot ----------------------------------------------------------------------------

_CLEAN = (
    "trim(regexp_replace(regexp_replace(regexp_replace(trim(label), '^\"\\s*(.*?)\\s*\"$', '\\1'), "
    "'^''\\s*(.*?)\\s*''$', '\\1'), '(?i)\\s*\\(?\\s*FY\\s*(19|20)[0-9]{2}\\s*\\)?$', ''))"
)
CELLS = f"""cells AS (SELECT company, period, {case_sql('norm', SLOT_RULES)} AS slot, v FROM (
  SELECT company, trim(period) AS period, {squeeze_sql(_CLEAN)} AS norm, {sheet_number_sql('cell')} AS v
  FROM fx_statement))"""
_SUMS = ", ".join(f"{xsum(f'CASE WHEN slot = {s!r} THEN v END')} AS {s}" for s in SLOTS)
SHEET_PIVOT = f"""piv AS (SELECT company, period, {_SUMS} FROM cells WHERE slot IS NOT NULL AND v IS NOT NULL
  AND period <> '' GROUP BY company, period)"""
SHEET_ENRICHED = """enr AS (SELECT *, coalesce(ebitda_amount, operating_income) AS ebit,
  total_assets - current_liabilities AS ce FROM (SELECT *, coalesce(operating_income, revenue - expenses) AS op,
  coalesce(ebitda, pbt + interest_expense + depreciation_charge) AS ebitda_amount,
  coalesce(revenue - cogs, reported_gross_profit) AS gp FROM piv))"""
SHEET_RATIOS = {
    "gross_profit": rnd("gp", 2),
    "gross_margin_pct": pct("gp", "revenue"),
    "operating_margin_pct": pct("op", "revenue"),
    "ebitda_amount": "ebitda_amount",
    "ebitda_margin_pct": pct("ebitda_amount", "revenue"),
    "net_profit_margin_pct": pct("net_income", "coalesce(total_income, revenue)"),
    "roe_pct": pct("net_income", "equity"),
    "roa_pct": pct("net_income", "total_assets"),
    "roce_pct": pct("ebit", "ce"),
    "current_ratio": rnd("current_assets / nullif(current_liabilities, 0)", 3),
    "quick_ratio": rnd("(current_assets - coalesce(inventory, 0)) / nullif(current_liabilities, 0)", 3),
    "debt_to_equity": rnd("total_debt / nullif(equity, 0)", 3),
    "interest_coverage": rnd("ebit / nullif(interest_expense, 0)", 3),
    "asset_turnover": rnd("revenue / nullif(total_assets, 0)", 3),
    "inventory_days": rnd("365e0 * inventory / nullif(cogs, 0)", 2),
    "receivable_days": rnd("365e0 * receivables / nullif(revenue, 0)", 2),
    "payable_days": rnd("365e0 * payables / nullif(cogs, 0)", 2),
    "eps": rnd("coalesce(reported_eps, net_income / nullif(shares, 0))", 4),
    "pe_ratio": rnd("coalesce(share_price * shares / nullif(net_income, 0), share_price / nullif(reported_eps, 0))", 2),
}


def _prev(col: str) -> str:
    return f"lag({col}) OVER (PARTITION BY company ORDER BY {fiscal_order_sql('period')})"


_PR, _PN = _prev("revenue"), _prev("net_income")
SHEET_YOY = {
    "yoy_revenue_growth_pct": pct(f"revenue - {_PR}", _PR),
    "yoy_net_income_growth_pct": pct(f"net_income - {_PN}", f"CASE WHEN abs({_PN}) > 1e-9 THEN abs({_PN}) END"),
}
_ALL = {**{c: c for c in P.DASHBOARD_COLUMNS}, **SHEET_RATIOS, **SHEET_YOY}
SHEET_SELECT = ", ".join(f"{_ALL[c]} AS {c}" for c in P.DASHBOARD_COLUMNS)
DASH = f"dash AS (SELECT company, {SHEET_SELECT} FROM enr)"
SHEET_CTES = (CELLS, SHEET_PIVOT, SHEET_ENRICHED, DASH)


def sheet_pivot(spark, sf):
    return V.pivot_facts(fx.statement(spark, sf), KEY, "sum", metric="label", value="cell")


def sheet_enriched(spark, sf):
    return V.enrich(sheet_pivot(spark, sf), "sheet")


def sheet_dash(spark, sf, years=None):
    return ratio_dashboard(fx.statement(spark, sf), KEY, "sheet", years, metric="label", value="cell")


@query("a2_pivot_facts_sum", fx.with_views("statement", "SELECT * FROM piv", CELLS, SHEET_PIVOT))
def pivot_facts_sum(spark, sf):
    return sheet_pivot(spark, sf)


@query(
    "a4_enrich_sheet",
    fx.with_views(
        "statement",
        "SELECT company, period, op AS op_for_margin, ebit, ebitda_amount, gp AS gross_profit_base, "
        "ce AS capital_employed FROM enr",
        *SHEET_CTES[:3],
    ),
)
def enrich_sheet(spark, sf):
    return sheet_enriched(spark, sf).select(
        "company", "period", "op_for_margin", "ebit", "ebitda_amount", "gross_profit_base", "capital_employed"
    )


for _i, (_name, _sql) in enumerate(SHEET_RATIOS.items(), start=1):

    @query(
        f"r{_i}_{_name}_sheet",
        fx.with_views("statement", f"SELECT company, period, {_sql} AS {_name} FROM enr", *SHEET_CTES[:3]),
    )
    def one_ratio(spark, sf, _name=_name):
        return R.ratios(sheet_enriched(spark, sf), KEY, "sheet", [_name])


@query("r21_ratio_dashboard_sheet", fx.with_views("statement", "SELECT * FROM dash", *SHEET_CTES))
def dashboard_sheet(spark, sf):
    return sheet_dash(spark, sf)


_YEARS = (
    "CASE WHEN len(regexp_extract_all(period, '\\b((?:19|20)[0-9]{2})\\b', 1)) > 0 THEN "
    "len(list_filter(regexp_extract_all(period, '\\b((?:19|20)[0-9]{2})\\b', 1), "
    "lambda y: CAST(y AS INTEGER) BETWEEN 2016 AND 2018)) > 0 "
    f"ELSE coalesce({fiscal_key_sql('period')} BETWEEN 2016 AND 2018, FALSE) END"
)


@query(
    "r21_ratio_dashboard_sheet_range",
    fx.with_views("statement", f"SELECT * FROM dash WHERE {_YEARS}", *SHEET_CTES),
)
def dashboard_sheet_range(spark, sf):
    return sheet_dash(spark, sf, (2016, 2018))


@query(
    "w1_yoy_sheet",
    fx.with_views(
        "statement",
        "SELECT company, period, revenue, net_income, yoy_revenue_growth_pct, yoy_net_income_growth_pct FROM dash",
        *SHEET_CTES,
    ),
)
def yoy_sheet(spark, sf):
    return R.yoy(sheet_pivot(spark, sf).select("company", "period", "revenue", "net_income"), KEY, "fiscal")


@query(
    "p6_single_period",
    fx.with_views(
        "statement",
        "SELECT company, period, gross_margin_pct, roe_pct FROM (SELECT *, row_number() OVER (PARTITION BY company "
        f"ORDER BY {fiscal_order_sql('period')}) AS rn FROM dash WHERE contains(period, '2018')) WHERE rn = 1",
        *SHEET_CTES,
    ),
)
def single_period(spark, sf):
    rows = sheet_dash(spark, sf).select("company", "period", "gross_margin_pct", "roe_pct")
    return P.single_period(rows, 2018, KEY)


# --- summaries of ratio series ------------------------------------------------------------------

for _how, _metric in (("average", "roe_pct"), ("sum", "net_income"), ("median", "gross_margin_pct"),
                      ("highest", "current_ratio"), ("lowest", "eps")):
    _d = {"roe_pct": 2, "net_income": 2, "gross_margin_pct": 2, "current_ratio": 3, "eps": 4}[_metric]
    if _how in ("highest", "lowest"):
        _dir = "DESC" if _how == "highest" else "ASC"
        _body = (
            f"SELECT company, period, {rnd(_metric, _d)} AS value FROM (SELECT *, row_number() OVER (PARTITION BY company "
            f"ORDER BY {_metric} {_dir}, {fiscal_order_sql('period')}) AS rn FROM dash WHERE {_metric} IS NOT NULL) "
            "WHERE rn = 1"
        )
    else:
        _agg = {"average": xavg(_metric), "sum": xsum(_metric), "median": f"median({_metric})"}[_how]
        _label = {"average": "Average", "sum": "Total", "median": "Median"}[_how]
        _body = (
            f"SELECT company, '{_label}' AS period, {rnd(_agg, _d)} AS value FROM dash WHERE {_metric} IS NOT NULL "
            "GROUP BY company"
        )

    @query(f"g16_summarise_{_how}", fx.with_views("statement", _body, *SHEET_CTES))
    def summarise(spark, sf, _how=_how, _metric=_metric):
        return A.summarise(sheet_dash(spark, sf), _metric, _how, KEY)


@query(
    "g16_summarise_median_all",
    fx.with_views(
        "statement",
        f"SELECT 'Median' AS period, {rnd('median(roa_pct)', 2)} AS value FROM dash WHERE roa_pct IS NOT NULL",
        *SHEET_CTES,
    ),
)
def summarise_median_all(spark, sf):
    return A.summarise(sheet_dash(spark, sf), "roa_pct", "median", ())


@query(
    "w3_running_total",
    fx.with_views(
        "statement",
        "SELECT company, period, "
        + rnd("CAST(sum(CAST(coalesce(revenue, 0) AS DECIMAL(32,6))) OVER (PARTITION BY company ORDER BY "
              f"{fiscal_order_sql('period')} ROWS UNBOUNDED PRECEDING) AS DOUBLE)", 2)
        + " AS running_total FROM dash",
        *SHEET_CTES,
    ),
)
def running_total(spark, sf):
    return S.running_total(sheet_dash(spark, sf).select("company", "period", "revenue"), "revenue", KEY)


_FIRST = f"ORDER BY {fiscal_order_sql('period')}"
_LAST = f"ORDER BY {fiscal_key_sql('period')} DESC NULLS FIRST, period DESC"


@query(
    "w4_cagr",
    fx.with_views(
        "statement",
        f"SELECT company, {rnd('(pow(b / a, 1e0 / years) - 1e0) * 100e0', 2)} AS cagr_pct, years, from_period, to_period "
        f"FROM (SELECT company, max({fiscal_key_sql('period')}) - min({fiscal_key_sql('period')}) AS years, "
        f"first(revenue {_FIRST}) AS a, first(revenue {_LAST}) AS b, first(period {_FIRST}) AS from_period, "
        f"first(period {_LAST}) AS to_period FROM dash WHERE revenue > 0 GROUP BY company) WHERE years > 0",
        *SHEET_CTES,
    ),
)
def cagr(spark, sf):
    return S.cagr(sheet_dash(spark, sf).select("company", "period", "revenue"), "revenue", KEY)


# --- wide sheets --------------------------------------------------------------------------------

_W = {h: sheet_number_sql(f'"{h}"') for h in fx.WIDE_CELLS}


def _present(parts: list[str]) -> str:
    total = " + ".join(f"coalesce({p}, 0e0)" for p in parts)
    return f"CASE WHEN {' OR '.join(f'{p} IS NOT NULL' for p in parts)} THEN {total} END"


_WIDE_SLOTS = {
    "revenue": [_W["Revenue from Operations"], _W["Sales Returns Revenue"]],
    "expenses": [_W["Total Expenses"]],
    "cogs": [_W["Cost of Goods Sold"]],
    "interest_expense": [_W["Finance Costs"]],
    "net_income": [_W["Net Profit"]],
    "operating_income": [_W["EBIT"]],
    "ebitda": [_W["EBIT"]],
}
WIDE_PIVOT = "piv AS (SELECT company, trim(\"Year\") AS period, " + ", ".join(
    (f"{xsum(_present(_WIDE_SLOTS[s]))} AS {s}" if s in _WIDE_SLOTS else f"CAST(NULL AS DOUBLE) AS {s}") for s in SLOTS
) + " FROM fx_wide GROUP BY 1, 2)"


def wide_sheet(spark, sf):
    return fx.wide(spark, sf).drop("seq")


@query("a3_pivot_wide", fx.with_views("wide", "SELECT * FROM piv", WIDE_PIVOT))
def pivot_wide(spark, sf):
    return V.pivot_wide(wide_sheet(spark, sf), "Year", KEY)


@query("a3_wide_dashboard", fx.with_views("wide", "SELECT * FROM dash", WIDE_PIVOT, SHEET_ENRICHED, DASH))
def wide_dash(spark, sf):
    return wide_dashboard(wide_sheet(spark, sf), "Year", KEY)


@query(
    "j3_patch_ebitda",
    fx.with_views(
        "statement wide",
        "SELECT d.company, d.period, d.revenue, CASE WHEN count(d.ebitda_amount) OVER (PARTITION BY d.company) > 0 "
        f"THEN d.ebitda_amount ELSE coalesce(w.v, d.ebitda_amount) END AS ebitda_amount FROM ebit d LEFT JOIN ("
        f"SELECT company, upper(trim(\"Year\")) AS label, first({_W['EBIT']} ORDER BY seq) AS v FROM fx_wide "
        "GROUP BY 1, 2) w ON d.company = w.company AND upper(d.period) = w.label",
        *SHEET_CTES,
        "ebit AS (SELECT company, lower(period) AS period, revenue, CASE WHEN company LIKE '%1' THEN ebitda_amount END "
        "AS ebitda_amount FROM dash)",
    ),
)
def patch_ebitda(spark, sf):
    rows = sheet_dash(spark, sf).select(
        "company", F.lower("period").alias("period"), "revenue",
        F.when(F.col("company").endswith("1"), F.col("ebitda_amount")).alias("ebitda_amount"),
    )
    sheet = fx.wide(spark, sf)
    return N.patch_ebitda(rows, sheet, parse_sheet_number(F.col("EBIT")), KEY, "Year")


@query(
    "s4_coerce_cells",
    fx.with_views(
        "sales",
        f"SELECT seq, {coerce_sql('amount')} AS amount_num, {coerce_sql('cost')} AS cost_num, "
        f"{coerce_sql('region')} AS region_num FROM fx_sales",
    ),
)
def coerce_cells(spark, sf):
    rows = SS.coerce_cells(fx.sales(spark, sf), ["amount", "cost", "region"])
    return rows.select("seq", "amount_num", "cost_num", "region_num")


# --- long ingest sheets -------------------------------------------------------------------------


@query(
    "s5_to_long_sheet",
    fx.with_views(
        "long",
        "SELECT seq, coalesce(try_cast(year AS INTEGER), 0) AS year, metric, coalesce(try_cast(value AS DOUBLE), 0e0) "
        "AS value, raw, coalesce(currency, 'USD') AS currency FROM fx_long",
    ),
)
def to_long_sheet(spark, sf):
    return SS.to_long_sheet(fx.long_sheet(spark, sf), "USD", ("seq",))


def _slug(col: str) -> str:
    return f"regexp_replace(lower(trim({col})), '\\s+', '_', 'g')"


_M = "lower(metric)"
TESTS = {
    "revenue": f"(contains({_slug('metric')}, 'revenue') AND NOT contains({_slug('metric')}, 'total_income') AND "
               f"(contains({_slug('metric')}, 'revenue_from') OR NOT contains({_slug('metric')}, 'other')))",
    "net_profit": f"({_M} LIKE '%net profit%' OR {_M} LIKE '%net\\_profit%' ESCAPE '\\' OR {_M} LIKE '%profit after tax%' "
                  f"OR regexp_matches({_M}, '\\bpat\\b') OR {_M} LIKE '%net income%' OR trim({_M}) = 'profit')",
    "expenses": f"({_M} LIKE '%total expense%' OR {_M} LIKE '%total\\_expense%' ESCAPE '\\' "
                f"OR {_M} IN ('expenses', 'expense'))",
    "other_income": f"(contains({_M}, 'other income') OR contains({_M}, 'other_income'))",
    "total_income": f"(contains({_M}, 'total income') OR contains({_M}, 'total_income'))",
}


def picked_sql(metric: str) -> str:
    return (
        "SELECT company, seq, CAST(try_cast(year AS DOUBLE) AS INTEGER) AS year, try_cast(value AS DOUBLE) AS value "
        f"FROM fx_long WHERE {TESTS[metric]} AND try_cast(year AS DOUBLE) IS NOT NULL "
        "AND try_cast(value AS DOUBLE) IS NOT NULL"
    )


# The raw line, read from its shape: 5 amounts, 5 and EPS, or 4 amounts.
WIDE_LINES = """wide_tokens AS (
  SELECT company, seq, CAST(regexp_extract(trim(raw), '^([0-9]{4})\\s+\\S', 1) AS INTEGER) AS year,
    [CAST(replace(t, ',', '') AS DOUBLE) FOR t IN string_split_regex(trim(raw), '\\s+')[2:]
     IF regexp_full_match(replace(t, ',', ''), '[0-9]+(\\.[0-9]+)?')] AS nums
  FROM fx_long WHERE regexp_matches(trim(raw), '^[0-9]{4}\\s+\\S')),
wide_kept AS (SELECT company, seq, year, nums, CASE WHEN nums[-1] < 500 THEN nums[:-2] ELSE nums END AS kept,
  CASE WHEN nums[-1] < 500 THEN nums[-1] END AS eps FROM wide_tokens
  WHERE year BETWEEN 1990 AND 2100 AND len(nums) >= 4),
wide_first AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY company, year ORDER BY seq) AS rn
  FROM wide_kept WHERE len(kept) >= 4) WHERE rn = 1),
wide_rows AS (SELECT company, year, kept[1] AS revenue, kept[2] AS other_income,
  CASE WHEN len(kept) >= 5 THEN kept[3] ELSE kept[1] + kept[2] END AS total_income,
  CASE WHEN len(kept) >= 5 THEN kept[4] ELSE kept[3] END AS total_expenses,
  CASE WHEN len(kept) >= 5 THEN kept[5] ELSE kept[4] END AS net_profit, eps FROM wide_first)"""
ENOUGH = "(SELECT *, count(*) OVER (PARTITION BY company) AS n FROM wide_rows)"


@query("n1_pick_series", fx.with_views("long", f"SELECT company, year, value FROM ({picked_sql('revenue')})"))
def pick_series(spark, sf):
    from finfacts.functions.labels import is_operating_revenue

    return N.pick_series(fx.long_sheet(spark, sf), is_operating_revenue("metric"), KEY)


@query("n2_wide_lines", fx.with_views("long", "SELECT * FROM wide_rows", WIDE_LINES))
def wide_lines(spark, sf):
    return N.wide_lines(fx.long_sheet(spark, sf), KEY)


for _metric, (_test, _field, _prefer) in N.METRICS.items():
    _both = (
        f"both_rows AS (SELECT company, year, {_field} AS value, 'wide' AS origin FROM wide_rows UNION ALL "
        f"SELECT company, year, value, 'long' AS origin FROM ({picked_sql(_metric)}))"
    )
    _counts = (
        "counted AS (SELECT *, count(*) FILTER (origin = 'wide') OVER (PARTITION BY company) AS nw, "
        "count(*) FILTER (origin = 'long') OVER (PARTITION BY company) AS nl FROM both_rows)"
    )
    _rule = (
        "origin = CASE WHEN nw >= 2 THEN 'wide' ELSE 'long' END"
        if _prefer == "wide"
        else "origin = CASE WHEN nl >= 1 THEN 'long' WHEN nw >= 2 THEN 'wide' END"
    )

    @query(
        f"n3_metric_trend_{_metric}",
        fx.with_views("long", f"SELECT company, year, value, origin FROM counted WHERE {_rule}", WIDE_LINES, _both, _counts),
    )
    def metric_trend(spark, sf, _metric=_metric):
        return N.metric_trend(fx.long_sheet(spark, sf), _metric, KEY)


@query(
    "n4_revenue_vs_expenses",
    fx.with_views("long", f"SELECT company, year, revenue, total_expenses FROM {ENOUGH} WHERE n >= 2", WIDE_LINES),
)
def revenue_vs_expenses(spark, sf):
    return N.revenue_vs_expenses(fx.long_sheet(spark, sf), KEY)


@query(
    "n5_income_shares",
    fx.with_views(
        "long",
        f"SELECT company, year, {rnd('other_income * 100e0 / nullif(revenue, 0)', 2)} AS other_income_pct, "
        f"{rnd('total_expenses * 100e0 / nullif(total_income, 0)', 2)} AS expense_pct FROM {ENOUGH} WHERE n >= 2",
        WIDE_LINES,
    ),
)
def income_shares(spark, sf):
    return N.income_shares(fx.long_sheet(spark, sf), KEY)


def _share_sql(part: str, whole: str, pname: str, wname: str, rname: str) -> str:
    ratio = rnd(f"p.value * 100e0 / b.value", 2)
    return (
        f"SELECT b.company, b.year, p.value AS {pname}, b.value AS {wname}, {ratio} AS {rname} FROM "
        f"({picked_sql(whole)}) b JOIN (SELECT company, year, first(value ORDER BY seq DESC) AS value FROM "
        f"({picked_sql(part)}) GROUP BY 1, 2) p ON b.company = p.company AND b.year = p.year WHERE b.value <> 0"
    )


@query(
    "j1_other_income_share",
    fx.with_views("long", _share_sql("other_income", "revenue", "other_income", "revenue", "other_income_pct")),
)
def other_income_share(spark, sf):
    return N.other_income_share(fx.long_sheet(spark, sf), KEY)


@query(
    "j2_expense_share",
    fx.with_views("long", _share_sql("expenses", "total_income", "total_expenses", "total_income", "expense_pct")),
)
def expense_share(spark, sf):
    return N.expense_share(fx.long_sheet(spark, sf), KEY)


@query(
    "g19_distinct_metrics_in_order",
    fx.with_views("long", "SELECT trim(metric) AS metric, min(seq) AS first_seen FROM fx_long GROUP BY 1"),
)
def distinct_in_order(spark, sf):
    return A.distinct_metrics(fx.long_sheet(spark, sf), seq="seq")


@query(
    "g23_dedup_rows",
    fx.with_views(
        "long",
        "SELECT company, year, metric, value, raw FROM (SELECT company, CAST(year AS INTEGER) AS year, metric, "
        "CAST(trunc(try_cast(value AS DOUBLE)) AS BIGINT) AS value, raw, row_number() OVER (PARTITION BY company, year, "
        "metric, CAST(trunc(try_cast(value AS DOUBLE)) AS BIGINT) ORDER BY seq) AS rn FROM fx_long "
        "WHERE try_cast(value AS DOUBLE) IS NOT NULL) WHERE rn = 1 AND value >= 0 AND year >= 2000",
    ),
)
def dedup_rows(spark, sf):
    rows = fx.long_sheet(spark, sf)
    return A.dedup_rows(rows, "seq", KEY).select("company", "year", "metric", "value", "raw")


for _ya, _yb in ((None, None), (2016, 2019)):
    _pick = (
        "first(year ORDER BY year) AS year_a, first(value ORDER BY year) AS value_a, "
        "first(year ORDER BY year DESC) AS year_b, first(value ORDER BY year DESC) AS value_b"
        if _ya is None
        else f"max(CASE WHEN year = {_ya} THEN year END) AS year_a, max(CASE WHEN year = {_ya} THEN value END) AS value_a, "
             f"max(CASE WHEN year = {_yb} THEN year END) AS year_b, max(CASE WHEN year = {_yb} THEN value END) AS value_b"
    )

    @query(
        f"w5_two_year_change{'' if _ya is None else '_named'}",
        fx.with_views(
            "long",
            f"SELECT company, year_a, value_a, year_b, value_b, {rnd('(value_b - value_a) / value_a * 100e0', 2)} "
            f"AS change_pct FROM (SELECT company, {_pick} FROM (SELECT company, year, revenue AS value FROM wide_rows) "
            "GROUP BY company) WHERE value_a <> 0 AND value_b IS NOT NULL",
            WIDE_LINES,
        ),
    )
    def two_year_change(spark, sf, _ya=_ya, _yb=_yb):
        rows = N.wide_lines(fx.long_sheet(spark, sf), KEY).select("company", "year", F.col("revenue").alias("value"))
        return S.two_year_change(rows, "value", KEY, _ya, _yb)


