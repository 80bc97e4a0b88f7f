"""Queries over table grids and text lines.

The grids are made of known cells, so most oracles rebuild what a reader should find from those cells
instead of repeating the array work.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from finfacts.functions.rules import ROW_METRIC_RULES
from finfacts.operators import documents as D
from finfacts.plans.extraction import extract_facts, table_candidates
from finfacts.sources.grids import grids_from_json, grids_to_json

from . import fixtures as fx
from .registry import query
from .sqltext import case_sql, header_year_sql, ledger_number_sql, squeeze_sql

DOC = ("company", "source_file")
#: The year that tables which name none count back from in these queries.
BASE_YEAR = 2023
TABLE_COLS = ["company", "source_file", "page_number", "table_index"]


@query(
    "d1_explode_grid",
    fx.with_views(
        "cells",
        "SELECT company, source_file, page_number, table_index, row, col, cell FROM fx_cells",
    ),
)
def explode_grid(spark, sf):
    return D.explode_grid(fx.grids(spark, sf), DOC)


@query(
    "s7_grids_as_json",
    fx.with_views(
        "cells",
        "SELECT company, source_file, page_number, table_index, row, col, cell FROM fx_cells",
    ),
)
def grids_as_json(spark, sf):
    stored = grids_to_json(fx.grids(spark, sf))
    return D.explode_grid(grids_from_json(stored), DOC)


_TEXTS = (
    "texts AS (SELECT company, ck, source_file, page_number, table_index, lower(string_agg(cell, ' ' ORDER BY row, col) "
    "FILTER (cell <> '')) AS t FROM fx_cells GROUP BY ALL)"
)


@query(
    "d2_income_table",
    fx.with_views(
        "cells",
        "SELECT company, source_file, page_number, table_index FROM (SELECT *, row_number() OVER (PARTITION BY company "
        "ORDER BY page_number, table_index) AS rn FROM texts WHERE regexp_matches(t, 'revenue|income') AND "
        "regexp_matches(t, 'profit|expenses')) WHERE rn = 1",
        _TEXTS,
    ),
)
def income_table(spark, sf):
    return D.income_table(fx.grids(spark, sf), DOC).select(*TABLE_COLS)


# What a reader should find: each amount of the statement with its row label, year and unit.
FOUND = (
    "amounts AS (SELECT company, ck, source_file, page_number, table_index, CASE WHEN ck % 3 = 0 THEN col ELSE row END "
    "AS item, CASE WHEN ck % 3 = 0 THEN row ELSE col END AS n, cell FROM fx_cells WHERE table_index = 1)",
    f"labelled AS (SELECT a.company, a.ck, a.source_file, a.page_number, a.n, a.item, lab.cell AS label, a.cell, yr.cell "
    f"AS year_cell, {ledger_number_sql('a.cell')} AS v FROM amounts a JOIN amounts lab ON a.ck = lab.ck AND a.item = lab.item "
    "AND lab.n = 0 JOIN amounts yr ON a.ck = yr.ck AND a.n = yr.n AND yr.item = 0 WHERE a.item > 0 AND a.n > 0)",
    "sized AS (SELECT *, max(n) OVER (PARTITION BY ck) AS years, CASE WHEN ck % 5 = 0 THEN NULL WHEN ck % 4 = 2 THEN "
    "substr(year_cell, 3, 2) || right(year_cell, 2) ELSE right(year_cell, 4) END AS named FROM labelled)",
)
_YEAR_OK = "try_cast(year AS INTEGER) BETWEEN 2000 AND 2100"
COLUMNAR = (
    # Every cell that names a year, alone or joined with its right neighbour.
    "heads AS (SELECT company, ck, source_file, table_index, row, col, coalesce(y, CASE WHEN nxt IS NOT NULL THEN yj END) AS year FROM "
    f"(SELECT *, {header_year_sql('trim(cell)')} AS y, {header_year_sql('trim(cell) || trim(nxt)')} AS yj FROM (SELECT *, "
    "lead(cell) OVER (PARTITION BY ck, table_index, row ORDER BY col) AS nxt FROM fx_cells) "
    "WHERE trim(cell) <> ''))",
    "best_head AS (SELECT ck, table_index, row AS header_row FROM (SELECT ck, table_index, row, row_number() OVER (PARTITION BY "
    "ck, table_index ORDER BY count(*) DESC, row) AS rn FROM heads WHERE year IS NOT NULL GROUP BY ck, table_index, row) "
    "WHERE rn = 1)",
    # Tables without any count back from the latest year they name, else from 2023.
    "widths AS (SELECT ck, company, source_file, table_index, max(col) AS w, max(list_max(list_transform(regexp_extract_all("
    "cell, '\\b(20[0-9]{2})\\b', 1), lambda y: CAST(y AS INTEGER)))) AS named FROM fx_cells GROUP BY ALL)",
    "year_cols AS (SELECT h.company, h.ck, h.source_file, h.table_index, h.row AS header_row, h.col, h.year, false AS counted, false AS assumed FROM heads h JOIN "
    f"best_head b ON h.ck = b.ck AND h.table_index = b.table_index AND h.row = b.header_row WHERE {_YEAR_OK} UNION ALL SELECT "
    "company, ck, source_file, table_index, 0, unnest(range(1, w + 1)) AS col, CAST(coalesce(named, 2023) - unnest(range(1, w + 1)) + 1 AS STRING), "
    "true, named IS NULL FROM widths WHERE (ck, table_index) NOT IN (SELECT (ck, table_index) FROM best_head))",
    # Cells under a year; outside the statements by column no row with amounts has words.
    "amounted AS (SELECT c.company, c.ck, c.source_file, c.page_number, c.table_index, c.row, y.year AS period, y.assumed, CASE WHEN c.ck % 3 <> 0 "
    f"AND c.table_index = 1 THEN c.row END AS item, {ledger_number_sql('c.cell')} AS v FROM fx_cells c JOIN year_cols y ON c.ck = y.ck AND "
    "c.table_index = y.table_index AND c.col = y.col WHERE c.row <> y.header_row AND trim(c.cell) <> '' AND NOT regexp_matches(c.cell, '[A-Za-z%]'))",
    "chosen AS (SELECT *, count(*) FILTER (v >= 1000) OVER (PARTITION BY ck, table_index, row) AS n_ok, ck % 7 = 1 AND item IS NOT NULL AS whole "
    "FROM amounted)",
    "picked AS (SELECT ck AS pk, table_index AS pt, coalesce(min(CASE WHEN item IN (2, 3) AND n_ok >= 2 THEN row END), "
    "min(CASE WHEN n_ok >= 2 THEN row END)) AS best FROM chosen GROUP BY ALL)",
)
_D4_OTHER = {1: "other_income", 4: "cogs", 5: "finance_costs", 7: "expenses", 8: "pbt", 9: "net_profit", 10: "eps"}
_D4_CASE = "CASE item " + " ".join(f"WHEN {i} THEN '{m}'" for i, m in _D4_OTHER.items()) + " END"
_VALUE = "CASE WHEN whole THEN v * 0.01e0 ELSE v END"


def candidate_sql(metric: str, value: str, level: str, valid: str, method: str, confidence: str) -> str:
    """The columns of a candidate."""
    return (
        f"company, source_file, 'income_statement' AS statement_type, {metric} AS metric, period, {value} AS value, 'INR_CRORE' AS unit, "
        f"{level} AS level, 'USD' AS currency, page_number AS source_page, {valid} AS is_valid, {method} AS extraction_method, "
        f"{confidence} AS confidence, '' AS raw"
    )


_LEVEL = "CASE WHEN whole THEN 'consolidated' ELSE 'standalone' END"
_METHOD = "CASE WHEN assumed THEN 'assumed_years' ELSE 'rule' END"
CANDIDATES = (
    "columnar AS (SELECT ck, table_index, "
    + candidate_sql("'revenue'", _VALUE, _LEVEL, f"{_VALUE} >= 1000 AND NOT assumed", _METHOD, "CASE WHEN whole THEN 0.95e0 ELSE 0.8e0 END")
    + " FROM chosen JOIN picked ON ck = pk AND table_index = pt WHERE v >= 1000 AND row = best UNION ALL SELECT ck, table_index, "
    + candidate_sql(_D4_CASE, _VALUE, _LEVEL, f"{_VALUE} >= 1000 AND NOT assumed", _METHOD, "CASE WHEN whole THEN 0.9e0 ELSE 0.7e0 END")
    + f" FROM chosen WHERE {_D4_CASE} IS NOT NULL AND CASE WHEN item = 10 THEN v > 0 ELSE v >= 1000 END)",
)


@query(
    "d3_year_columns",
    fx.with_views(
        "cells",
        "SELECT company, source_file, table_index, header_row, col, year, CASE WHEN assumed THEN 'assumed' WHEN counted THEN 'named' ELSE 'header' END "
        "AS years_from FROM year_cols",
        *COLUMNAR[:4],
    ),
)
def year_columns(spark, sf):
    out = D.year_columns(fx.grids(spark, sf), BASE_YEAR).select(
        "company", "source_file", "table_index", F.col("header_row").cast("int").alias("header_row"), "years_from", F.explode("years").alias("_y")
    )
    return out.select("company", "source_file", "table_index", "header_row", "years_from", "_y.*")


CANDIDATE_COLS = ("company, source_file, statement_type, metric, period, value, unit, level, currency, source_page, is_valid, extraction_method, "
                  "confidence, raw")


@query("d4_columnar_facts", fx.with_views("cells", f"SELECT {CANDIDATE_COLS} FROM columnar", *COLUMNAR, *CANDIDATES))
def columnar_facts(spark, sf):
    return D.columnar_facts(fx.grids(spark, sf), DOC, BASE_YEAR)


@query(
    "d4_columnar_other_metrics",
    fx.with_views(
        "cells",
        "SELECT company, source_file, metric, period, value, level, is_valid, confidence FROM columnar WHERE metric <> 'revenue'",
        *COLUMNAR, *CANDIDATES,
    ),
)
def columnar_other_metrics(spark, sf):
    out = columnar_facts(spark, sf).where(F.col("metric") != "revenue")
    return out.select("company", "source_file", "metric", "period", "value", "level", "is_valid", "confidence")


@query(
    "d4_columnar_revenue",
    fx.with_views(
        "cells", "SELECT company, source_file, metric, period, value, is_valid FROM columnar WHERE metric = 'revenue'", *COLUMNAR, *CANDIDATES
    ),
)
def columnar_revenue(spark, sf):
    out = columnar_facts(spark, sf).where(F.col("metric") == "revenue")
    return out.select("company", "source_file", "metric", "period", "value", "is_valid")


_D5_CASE = "CASE item WHEN 2 THEN 'revenue' " + " ".join(f"WHEN {i} THEN '{m}'" for i, m in _D4_OTHER.items()) + " END"


@query(
    "d5_transposed_facts",
    fx.with_views(
        "cells",
        f"SELECT company, source_file, {_D5_CASE} AS metric, named AS period, v AS value, "
        "CASE WHEN item = 10 THEN v > 0 ELSE v >= 1000 END AS is_valid, CASE WHEN item = 10 THEN 0.75e0 ELSE 0.8e0 END "
        "AS confidence FROM (SELECT *, count(DISTINCT CASE WHEN regexp_matches(year_cell, '(?i)fy\\s*(19|20)[0-9]{2}|"
        "^(19|20)[0-9]{2}$') THEN n END) OVER (PARTITION BY ck) AS fy_rows FROM sized WHERE ck % 3 = 0) "
        f"WHERE fy_rows >= 2 AND named IS NOT NULL AND {_D5_CASE} IS NOT NULL AND CASE WHEN item = 10 THEN v > 0 "
        "ELSE v >= 1000 END",
        *FOUND,
    ),
)
def transposed_facts(spark, sf):
    out = D.transposed_facts(fx.grids(spark, sf), DOC)
    return out.select("company", "source_file", "metric", "period", "value", "is_valid", "confidence")


# Statements by row need two rows that start with a year; the others are read by column.
ROUTED = (
    "by_year AS (SELECT ck, count(DISTINCT CASE WHEN regexp_matches(year_cell, '(?i)fy\\s*(19|20)[0-9]{2}|^(19|20)[0-9]{2}$') THEN n END) >= 2 "
    "AND ck % 3 = 0 AS transposed FROM sized GROUP BY ck)",
)
_SIZE_OK = "CASE WHEN item = 10 THEN v > 0 ELSE v >= 1000 END"
TABLE_FACTS = (
    f"table_facts AS (SELECT {CANDIDATE_COLS} FROM columnar WHERE table_index = 1 AND ck IN (SELECT ck FROM by_year WHERE NOT transposed) "
    "UNION ALL SELECT "
    + candidate_sql(_D5_CASE, "v", "'standalone'", _SIZE_OK, "'rule'", "CASE WHEN item = 10 THEN 0.75e0 ELSE 0.8e0 END").replace("period,", "named AS period,", 1)
    + f" FROM sized WHERE ck IN (SELECT ck FROM by_year WHERE transposed) AND named IS NOT NULL AND {_D5_CASE} IS NOT NULL AND {_SIZE_OK})",
)
READ = (*FOUND, *COLUMNAR, *CANDIDATES, *ROUTED, *TABLE_FACTS)


@query(
    "d8_route_tables",
    fx.with_views(
        "cells",
        "SELECT company, source_file, page_number, table_index, CASE WHEN transposed THEN 'transposed' ELSE 'columnar' END AS path FROM "
        "(SELECT DISTINCT company, ck, source_file, page_number, table_index FROM fx_cells WHERE table_index = 1) JOIN by_year USING (ck) "
        "WHERE transposed OR ck IN (SELECT ck FROM year_cols WHERE table_index = 1)",
        *FOUND, *COLUMNAR[:4], *ROUTED,
    ),
)
def route_tables(spark, sf):
    return D.route_tables(fx.grids(spark, sf), DOC, BASE_YEAR).select(*TABLE_COLS, "path")


@query("d8_table_candidates", fx.with_views("cells", f"SELECT {CANDIDATE_COLS} FROM table_facts", *READ))
def all_candidates(spark, sf):
    return table_candidates(fx.grids(spark, sf), DOC, BASE_YEAR)


# --- one line per year ----------------------------------------------------------------------------

# A table of statement lines per company: year, then 1 to 6 amounts.
_LINE = (
    "CAST(yr AS STRING) || ' results ' || CAST(CAST(floor(rev) AS BIGINT) AS STRING) "
    "|| CASE WHEN ck % 6 >= 1 THEN ' ' || CAST(CAST(floor(cogs) AS BIGINT) AS STRING) ELSE '' END "
    "|| CASE WHEN ck % 6 >= 2 THEN ' ' || CAST(CAST(floor(tax * 3) AS BIGINT) AS STRING) ELSE '' END "
    "|| CASE WHEN ck % 6 >= 3 THEN ' ' || CAST(CAST(floor(disc * 2) AS BIGINT) AS STRING) ELSE '' END "
    "|| CASE WHEN ck % 6 >= 4 THEN ' ' || CAST(CAST(floor(ext) AS BIGINT) AS STRING) ELSE '' END || ' 12'"
)
_ROW_NUMS = (
    f"row_lines AS (SELECT company, ck, yr, {_LINE} AS raw FROM fx_base)",
    "row_nums AS (SELECT *, list_filter(list_transform(regexp_extract_all(raw, '[0-9][0-9,]*'), lambda t: CAST(replace(t, "
    "',', '') AS BIGINT)), lambda x: x <> yr AND x > 1000) AS k FROM row_lines)",
    "row_items AS (SELECT company, yr, raw, 'revenue' AS metric, k[1] AS v FROM row_nums UNION ALL SELECT company, yr, raw, "
    "'expenses', CASE len(k) WHEN 0 THEN NULL WHEN 1 THEN NULL WHEN 2 THEN NULL WHEN 3 THEN k[2] WHEN 4 THEN k[2] "
    "ELSE k[-2] END FROM row_nums UNION ALL SELECT company, yr, raw, 'net_income', CASE len(k) WHEN 0 THEN NULL WHEN 1 "
    "THEN NULL WHEN 2 THEN CASE WHEN k[2] <> k[1] THEN k[2] END WHEN 3 THEN k[3] WHEN 4 THEN k[3] ELSE k[-1] END "
    "FROM row_nums)",
)


@query(
    "d6_row_facts",
    fx.with_views(
        "base",
        "SELECT company, metric, CAST(yr AS STRING) AS period, CAST(v AS DOUBLE) AS value, raw FROM row_items "
        "WHERE v IS NOT NULL",
        *_ROW_NUMS,
    ),
)
def row_facts(spark, sf):
    # Five years to a page, so a grid does not grow with a company's history.
    page = F.floor(F.col("yr") / 5).cast("int").alias("page_number")
    rows = fx.base(spark, sf).select("company", page, F.struct("yr", F.expr(_LINE).alias("line")).alias("_l"))
    grids = rows.groupBy("company", "page_number").agg(F.array_sort(F.collect_list("_l")).alias("_g")).select(
        "company", F.lit("lines.pdf").alias("source_file"), "page_number", F.lit(0).alias("table_index"),
        F.transform("_g", lambda r: F.array(r["line"])).alias("rows"),
    )
    return D.row_facts(grids, DOC).select("company", "metric", "period", "value", "raw")


# --- text -----------------------------------------------------------------------------------------

_LOW = squeeze_sql("text")
TEXT_FOUND = (
    f"low AS (SELECT company, text, {_LOW} AS l FROM fx_lines)",
    "kept AS (SELECT * FROM low WHERE NOT regexp_matches(l, 'margin|%|ratio|growth|comprehensive income|exceptional') "
    "AND regexp_matches(l, '[0-9]{3}') AND regexp_matches(l, '(revenue|income|sales|profit|ebitda|expenses).*[0-9]'))",
    f"read AS (SELECT company, {case_sql('l', ROW_METRIC_RULES)} AS metric, list_max(list_transform(regexp_extract_all(l, "
    "'\\b(20[0-9]{2})\\b', 1), lambda y: CAST(y AS INTEGER))) AS year, list_max(list_filter(list_transform("
    "regexp_extract_all(text, '[0-9,]{3,}'), lambda t: try_cast(replace(t, ',', '') AS DOUBLE)), lambda v: v IS NOT NULL "
    "AND NOT v BETWEEN 1900 AND 2100 AND v >= 10000)) AS v FROM kept)",
)


def pages_of_lines(spark, sf):
    """One text per page of a company: forty printed lines or so."""
    page = F.floor(F.col("id") / 40).alias("page_number")
    rows = fx.text_lines(spark, sf).groupBy("company", page).agg(F.collect_list("text").alias("_t"))
    return rows.select("company", "page_number", F.array_join("_t", "\n").alias("text"))


@query(
    "d7_text_facts",
    fx.with_views(
        "lines",
        "SELECT company, metric, year, max(v) AS value FROM read WHERE metric IS NOT NULL AND year IS NOT NULL "
        "AND v IS NOT NULL GROUP BY ALL",
        *TEXT_FOUND,
    ),
)
def text_facts(spark, sf):
    return D.text_facts(pages_of_lines(spark, sf), ("company",))


_YEAR_OF = "try_cast(period AS INTEGER)"


def _outside(source: str, amount: str, method: str, confidence: float) -> str:
    """Revenue of another source as candidates."""
    row = candidate_sql("'revenue'", amount, "'consolidated'", "true", f"'{method}'", f"{confidence}e0").replace("page_number AS", "1 AS")
    row = row.replace("company, source_file,", "company, 'report.pdf' AS source_file,").replace("period,", "CAST(year AS STRING) AS period,", 1)
    return f"SELECT {row} FROM {source} WHERE {amount} > 1000 AND year BETWEEN 2000 AND 2100"


UNION = (
    f"external AS ({_outside('(SELECT company, yr AS year, CAST(rev AS DOUBLE) AS amount FROM fx_base WHERE rev > cogs)', 'amount', 'ai_extracted', 0.6)})",
    "texts_read AS (SELECT company, year, max(v) AS amount FROM read WHERE metric = 'revenue' AND year IS NOT NULL AND v IS NOT NULL GROUP BY ALL)",
    f"text_facts AS ({_outside('texts_read', 'amount', 'text_fallback', 0.4)})",
    f"spans AS (SELECT company, min({_YEAR_OF}) AS lo, max({_YEAR_OF}) AS hi FROM table_facts WHERE metric = 'revenue' AND is_valid AND "
    f"{_YEAR_OF} BETWEEN 2000 AND 2100 GROUP BY company)",
    f"outer_spans AS (SELECT company, min({_YEAR_OF}) AS xlo, max({_YEAR_OF}) AS xhi FROM external GROUP BY company)",
)


def _spread(external: bool) -> str:
    lo, hi = ("least(lo, xlo)", "greatest(hi, xhi)") if external else ("lo", "hi")
    return (
        "gates AS (SELECT company, weak, coalesce(CASE WHEN weak THEN " + f"{hi} - {lo}" + " ELSE hi - lo END < 1, true) AS single FROM (SELECT *, "
        "coalesce(hi - lo < 2, true) AS weak FROM (SELECT DISTINCT company FROM fx_base) LEFT JOIN spans USING (company) LEFT JOIN outer_spans "
        "USING (company)))"
    )


@query(
    "u1_union_candidates",
    fx.with_views(
        "cells lines",
        f"SELECT {CANDIDATE_COLS} FROM table_facts UNION ALL SELECT {CANDIDATE_COLS} FROM external WHERE company IN (SELECT company FROM gates WHERE "
        f"weak) UNION ALL SELECT {CANDIDATE_COLS} FROM text_facts WHERE company IN (SELECT company FROM gates WHERE single)",
        *READ, *TEXT_FOUND, *UNION, _spread(True),
    ),
)
def union_candidates(spark, sf):
    texts = D.text_facts(pages_of_lines(spark, sf).withColumn("source_file", F.lit("report.pdf")), DOC)
    external = fx.base(spark, sf).where("rev > cogs").select(
        "company", F.lit("report.pdf").alias("source_file"), F.col("yr").cast("string").alias("year"),
        F.col("rev").alias("revenue"),
    )
    return D.union_candidates(table_candidates(fx.grids(spark, sf), DOC, BASE_YEAR), texts, external, DOC)


@query(
    "u1_extract_facts",
    fx.with_views(
        "cells lines",
        f"SELECT {CANDIDATE_COLS} FROM (SELECT *, row_number() OVER (PARTITION BY company, source_file, metric, period ORDER BY level <> 'consolidated', "
        f"value DESC, source_page, extraction_method) AS rn FROM (SELECT {CANDIDATE_COLS} FROM table_facts UNION ALL SELECT {CANDIDATE_COLS} FROM "
        f"text_facts WHERE company IN (SELECT company FROM gates WHERE single)) WHERE is_valid AND {_YEAR_OF} BETWEEN 2000 AND 2100) WHERE rn = 1",
        *READ, *TEXT_FOUND, *UNION, _spread(False),
    ),
)
def extracted(spark, sf):
    texts = pages_of_lines(spark, sf).withColumn("source_file", F.lit("report.pdf"))
    return extract_facts(fx.grids(spark, sf), texts, None, DOC, BASE_YEAR)
