"""Queries for the scalar functions, over printed statement cells, labels and lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from finfacts.functions import labels as C
from finfacts.functions import lines, money, numbers, periods
from finfacts.functions import rules as R

from . import fixtures as fx
from .registry import query
from .sheets import _CLEAN, WIDE_LINES
from .sqltext import (
    any_sql,
    case_sql,
    coerce_sql,
    dashboard_number_sql,
    fiscal_key_sql,
    header_year_sql,
    leading_sql,
    ledger_number_sql,
    period_of_sql,
    rnd,
    sheet_number_sql,
    squeeze_sql,
)
from .tokens import CLEAN, INTS, MULT, fill, line_cur_sql

OTHER = "'other'"


@query(
    "c1_classify_metric",
    fx.with_views(
        "statement",
        f"SELECT id, label, {case_sql('norm', R.SLOT_RULES)} AS slot FROM (SELECT id, label, {squeeze_sql(_CLEAN)} AS norm "
        "FROM fx_statement)",
    ),
)
def classify_metric(spark, sf):
    rows = fx.statement(spark, sf).withColumn("_l", C.squeeze(C.clean_metric_label("label")))
    return rows.select("id", "label", R.first_match(F.col("_l"), R.SLOT_RULES).alias("slot"))


@query(
    "c2_ebitda_strength",
    fx.with_views(
        "statement",
        f"SELECT id, label, CAST({case_sql('lower(trim(label))', R.EBITDA_STRENGTH_RULES, chr(39) + '0' + chr(39))} "
        "AS INTEGER) AS strength FROM fx_statement",
    ),
)
def ebitda_strength(spark, sf):
    return fx.statement(spark, sf).select("id", "label", C.ebitda_strength("label").alias("strength"))


_SLUG = "regexp_replace(lower(trim(label)), '\\s+', '_', 'g')"
_LOWER = "lower(label)"


@query(
    "c3_long_sheet_labels",
    fx.with_views(
        "statement",
        f"SELECT id, {any_sql(_SLUG, R.LONG_OPERATING_REVENUE)} AS is_revenue, {any_sql(_LOWER, R.LONG_NET_PROFIT)} AS "
        f"is_profit, {any_sql(_LOWER, R.LONG_TOTAL_EXPENSES)} AS is_expenses, {any_sql(_LOWER, R.LONG_TOTAL_INCOME)} AS "
        f"is_total_income, {any_sql(_LOWER, R.LONG_OTHER_INCOME)} AS is_other_income FROM fx_statement",
    ),
)
def long_sheet_labels(spark, sf):
    return fx.statement(spark, sf).select(
        "id", C.is_operating_revenue("label").alias("is_revenue"), C.is_net_profit("label").alias("is_profit"),
        C.is_total_expenses("label").alias("is_expenses"), C.is_total_income("label").alias("is_total_income"),
        C.is_other_income_label("label").alias("is_other_income"),
    )


@query(
    "c4_dashboard_labels",
    fx.with_views(
        "statement",
        "SELECT id, coalesce(k = 'core_revenue', FALSE) AS is_core_revenue, coalesce(k = 'expense', FALSE) AS is_expense, "
        f"coalesce(k = 'other_income', FALSE) AS is_other FROM (SELECT id, {case_sql('trim(lower(label))', R.DASHBOARD_CLASSES)} "
        "AS k FROM fx_statement)",
    ),
)
def dashboard_labels(spark, sf):
    return fx.statement(spark, sf).select(
        "id", C.is_core_revenue("label").alias("is_core_revenue"), C.is_expense("label").alias("is_expense"),
        C.is_other_income("label").alias("is_other"),
    )


@query(
    "c5_metric_from_row",
    fx.with_views(
        "lines",
        f"SELECT id, CASE WHEN NOT {any_sql('l', R.ROW_REJECT)} THEN coalesce({case_sql('l', R.ROW_METRIC_RULES)}, "
        f"{case_sql('l', R.ROW_ALIAS_RULES)}) END AS metric FROM (SELECT id, {squeeze_sql('text')} AS l FROM fx_lines)",
    ),
)
def metric_from_row(spark, sf):
    return fx.text_lines(spark, sf).select("id", C.metric_from_row("text").alias("metric"))


_CLEAN_LABEL = (
    "trim(regexp_replace(regexp_replace(regexp_replace(lower(text), '\\(.*?\\)', '', 'g'), '[^a-z\\s]', ' ', 'g'), '\\s+', ' ', 'g'))"
)
_PRIORITY = (
    "CASE " + " ".join(f"WHEN contains(lower(text), '{p}') THEN {i}" for i, p in enumerate(R.REVENUE_PRIORITY)) + " ELSE 999 END"
)


@query(
    "c6_revenue_rows",
    fx.with_views(
        "lines",
        f"SELECT id, {any_sql('c', R.REVENUE_ROW)} AS is_revenue, {_PRIORITY} AS priority, CASE WHEN "
        + " OR ".join(f"starts_with(l, '{k}') OR contains(lower(trim(text)), '{k}')" for k in R.REVENUE_KEYS)
        + f" THEN 1 ELSE 0 END AS boost FROM (SELECT id, text, {_CLEAN_LABEL} AS c, {squeeze_sql('text')} AS l FROM fx_lines)",
    ),
)
def revenue_rows(spark, sf):
    rows = fx.text_lines(spark, sf)
    return rows.select(
        "id", C.is_revenue_row("text").alias("is_revenue"), C.revenue_priority("text").alias("priority"),
        C.revenue_boost("text", "text").alias("boost"),
    )


@query(
    "c7_line_class",
    fx.with_views(
        "lines",
        f"SELECT id, {case_sql('l', R.LINE_CLASS_RULES, OTHER)} AS line_class FROM (SELECT id, {squeeze_sql('text')} AS l "
        "FROM fx_lines)",
    ),
)
def line_class(spark, sf):
    return fx.text_lines(spark, sf).select("id", C.line_class("text").alias("line_class"))


@query(
    "c7_line_class_of_documents",
    f"SELECT doc_id, {case_sql('l', R.LINE_CLASS_RULES, OTHER)} AS line_class FROM (SELECT doc_id, {squeeze_sql('text')} AS l "
    "FROM documents)",
)
def line_class_of_documents(spark, sf):
    return fx.table(spark, sf, "documents").select("doc_id", C.line_class("text").alias("line_class"))


_SYMBOL = "CASE code " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in R.CURRENCY_SYMBOLS.items()) + " ELSE code END"


@query(
    "c9_currency_of",
    fx.with_views(
        "lines",
        f"SELECT id, statement_code, line_code, {_SYMBOL.replace('code', 'line_code')} AS symbol FROM (SELECT id, "
        f"{case_sql('lower(text)', R.STATEMENT_CURRENCY_RULES, chr(39) + 'USD' + chr(39))} AS statement_code, "
        f"{line_cur_sql('text')} AS line_code FROM fx_lines)",
    ),
)
def currency_of(spark, sf):
    rows = fx.text_lines(spark, sf).select(
        "id", money.currency_of("text").alias("statement_code"), money.currency_of("text", "line").alias("line_code")
    )
    return rows.withColumn("symbol", money.currency_symbol("line_code"))


@query(
    "c10_units",
    fx.with_views(
        "lines",
        f"SELECT id, unit, CASE unit WHEN 'INR_LAKH' THEN yr * 0.01e0 WHEN 'INR_MILLION' THEN yr * 0.1e0 WHEN 'INR_BILLION' "
        f"THEN yr * 100e0 ELSE CAST(yr AS DOUBLE) END AS crore, multiplier FROM (SELECT id, yr, "
        f"{case_sql('lower(text)', R.UNIT_RULES, chr(39) + 'INR_CRORE' + chr(39))} AS unit, {fill(MULT, t='text')} AS multiplier "
        "FROM fx_lines)",
    ),
)
def units(spark, sf):
    rows = fx.text_lines(spark, sf).withColumn("unit", money.unit_of("text"))
    return rows.select(
        "id", "unit", money.to_crore(F.col("yr").cast("double"), "unit").alias("crore"),
        money.unit_multiplier("text").alias("multiplier"),
    )


_PLAIN = leading_sql("ltrim(replace(cell, ',', ''))")
_DIGITS = leading_sql("regexp_replace(cell, '[^0-9.\\-]', '', 'g')")


@query(
    "c11_parse_number",
    fx.with_views(
        "statement",
        f"SELECT id, cell, {ledger_number_sql('cell')} AS ledger, {sheet_number_sql('cell')} AS sheet, "
        f"{dashboard_number_sql('cell')} AS dashboard, {_PLAIN} AS plain, {_DIGITS} AS digits, {coerce_sql('cell')} AS coerced "
        "FROM fx_statement",
    ),
)
def parse_number(spark, sf):
    styles = ("ledger", "sheet", "dashboard", "plain", "digits")
    return fx.statement(spark, sf).select(
        "id", "cell", *[numbers.parse_number("cell", s).alias(s) for s in styles], numbers.coerce_cell("cell").alias("coerced")
    )


# Period tokens of every form, one per fact.
_TOKEN = (
    "CASE id % 80 WHEN 0 THEN 'FY' || CAST(yr - 1 AS STRING) || '-' || CAST(yr % 100 AS STRING) WHEN 10 THEN 'FY' || "
    "CAST(yr % 100 AS STRING) WHEN 20 THEN CAST(yr % 100 AS STRING) || '-' || CAST(yr % 100 + 1 AS STRING) WHEN 30 THEN "
    "'Mar ' || CAST(yr AS STRING) WHEN 40 THEN CAST(yr AS STRING) WHEN 50 THEN CAST(yr - 1 AS STRING) || '/' || "
    "CAST(yr AS STRING) WHEN 60 THEN 'Q4' ELSE ' fy ' || CAST(yr AS STRING) END"
)


@query(
    "c12_period_labels",
    fx.with_views(
        "facts",
        f"SELECT id, token, {period_of_sql('trim(token)')} AS period_of, {header_year_sql('trim(token)')} AS header_year, "
        f"{fiscal_key_sql('token')} AS fiscal_key, CASE WHEN regexp_full_match(trim(token), '[0-9]{{4}}') THEN 'FY ' || trim(token) "
        f"ELSE trim(token) END AS fy_label FROM (SELECT id, {_TOKEN} AS token FROM fx_facts)",
    ),
)
def period_labels(spark, sf):
    rows = fx.facts(spark, sf).select("id", F.expr(_TOKEN).alias("token"))
    return rows.select(
        "id", "token", periods.period_of("token").alias("period_of"), periods.header_year("token").alias("header_year"),
        periods.fiscal_key("token").alias("fiscal_key"), periods.fy_label("token").alias("fy_label"),
    )


@query(
    "c13_clean_text",
    fx.with_views(
        "lines",
        f"SELECT id, {_CLEAN_LABEL} AS clean_label, {fill(CLEAN, t='text')} AS clean_line, "
        "regexp_replace(lower(trim(text)), '\\s+', '_', 'g') AS slug FROM fx_lines",
    ),
)
def clean_text(spark, sf):
    return fx.text_lines(spark, sf).select(
        "id", C.clean_label("text").alias("clean_label"), C.clean_line("text").alias("clean_line"), C.metric_slug("text").alias("slug")
    )


_READ = (
    f"ints AS (SELECT id, text, CAST(nullif(regexp_extract(text, '(20[0-9]{{2}})', 1), '') AS INTEGER) AS y, {fill(INTS, t='text')} "
    f"AS k, {fill(MULT, t='text')} AS mult FROM fx_lines)",
    "amts AS (SELECT *, list_filter(k, lambda n: NOT n BETWEEN 1900 AND 2100) AS a, coalesce(list_position(k, y), 0) AS yp FROM ints)",
    "best AS (SELECT *, CASE WHEN len(a) > 0 THEN list_max(a) ELSE list_max(k) END AS b, CASE WHEN yp > 0 THEN k[:yp - 1] || "
    "k[yp + 1:] ELSE k END AS toks FROM amts)",
)


@query(
    "c15_line_year_value",
    fx.with_views(
        "lines",
        "SELECT id, y AS year, CASE WHEN mult <> 1 THEN CAST(round_even(b * mult, 0) AS BIGINT) WHEN b >= 1000 THEN b END AS value "
        "FROM best",
        *_READ,
    ),
)
def line_year_value(spark, sf):
    return fx.text_lines(spark, sf).select("id", lines.line_year("text").alias("year"), lines.line_value("text").alias("value"))


@query(
    "c16_amount_tokens",
    fx.with_views(
        "lines",
        "SELECT id, array_to_string(toks, ' ') AS tokens, CASE WHEN len(list_filter(toks, lambda n: n >= 1000)) >= 3 THEN "
        "list_filter(toks, lambda n: n >= 1000)[1] END AS first_large FROM best",
        *_READ,
    ),
)
def amount_tokens(spark, sf):
    rows = fx.text_lines(spark, sf).withColumn("_t", lines.amount_tokens("text", lines.line_year("text")))
    return rows.select(
        "id", F.array_join(F.transform("_t", lambda n: n.cast("string")), " ").alias("tokens"),
        lines.first_large("_t").alias("first_large"),
    )


@query(
    "c17_parse_wide_line",
    fx.with_views(
        "long",
        "SELECT company, seq, year, kept[1] AS revenue, kept[2] AS other_income, CASE WHEN len(kept) >= 5 THEN kept[3] ELSE "
        "kept[1] + kept[2] END AS total_income, CASE WHEN len(kept) >= 5 THEN kept[4] ELSE kept[3] END AS total_expenses, "
        "CASE WHEN len(kept) >= 5 THEN kept[5] ELSE kept[4] END AS net_profit, eps FROM wide_kept WHERE len(kept) >= 4",
        WIDE_LINES,
    ),
)
def parse_wide_line(spark, sf):
    rows = fx.long_sheet(spark, sf).select("company", "seq", lines.parse_wide_line("raw").alias("_w"))
    return rows.where(F.col("_w").isNotNull()).select("company", "seq", "_w.*")


@query(
    "c19_js_round",
    fx.with_views(
        "facts",
        f"SELECT id, {rnd('value / 7')} AS whole, {rnd('value / 7', 2)} AS cents, {rnd('value / 7', 4)} AS eps, "
        f"{rnd('value / 7', 3)} AS current_ratio FROM fx_facts",
    ),
)
def js_round(spark, sf):
    v = F.col("value") / 7
    return fx.facts(spark, sf).select(
        "id", numbers.js_round(v).alias("whole"), numbers.js_round(v, 2).alias("cents"), numbers.round_for("eps", v).alias("eps"),
        numbers.round_for("current_ratio", v).alias("current_ratio"),
    )
