"""Views of the given tables that look like financial statements.

Each view is built twice from the same column expressions: as a DataFrame for the queries and as
a common table expression for the oracles.  A customer plays the company, so the views grow with
the tables; the order year plus 20 plays the fiscal year.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def r2(expr: str) -> str:
    return f"(floor(({expr}) * 100 + 0.5) / 100)"


# ---- one row of sums per (company, year) -------------------------------------------------------

EXT = "CAST(l_extendedprice AS DECIMAL(18,2))"
DISC = "CAST(l_discount AS DECIMAL(6,2))"
TAX = "CAST(l_tax AS DECIMAL(6,2))"
BASE_SUMS = {
    "ext": f"CAST(sum({EXT}) AS DOUBLE)",
    "rev": f"CAST(sum({EXT} * (1 - {DISC})) AS DOUBLE)",
    "cogs": "CAST(sum(CAST(l_quantity AS DECIMAL(10,0)) * CAST(p_retailprice AS DECIMAL(12,2))) AS DOUBLE)",
    "tax": f"CAST(sum({EXT} * {TAX}) AS DOUBLE)",
    "disc": f"CAST(sum({EXT} * {DISC}) AS DOUBLE)",
    "recv": f"CAST(sum(CASE WHEN o_orderstatus = 'O' THEN {EXT} END) AS DOUBLE)",
    "inv": f"CAST(sum(CASE WHEN l_returnflag = 'R' THEN {EXT} END) AS DOUBLE)",
    "orders": "sum(CASE WHEN l_linenumber = 1 THEN 1 ELSE 0 END)",
}
BASE_SQL = f"""fx_base AS (
  SELECT c_name AS company, CAST(o_custkey AS BIGINT) AS ck, CAST(year(o_orderdate) + 20 AS BIGINT) AS yr,
    {', '.join(f'{e} AS {n}' for n, e in BASE_SUMS.items())}
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey
    JOIN customer ON o_custkey = c_custkey
  GROUP BY 1, 2, 3)"""


def base(spark: SparkSession, sf: str) -> DataFrame:
    """Sums per (customer, year), dealt out by company: aggregated before the customer's name is joined on.

    Amounts travel as decimals, made once a line.  Lines meet their part first and their order last, where the lines of an order lie together and add up before they move on.  What a company's rows grow into
    needs no further exchange by company.
    """
    lines = table(spark, sf, "lineitem").select(
        "l_orderkey", "l_partkey", "l_linenumber", F.expr("CAST(l_quantity AS DECIMAL(10,0))").alias("l_quantity"),
        F.expr(EXT).alias("l_extendedprice"), F.expr(DISC).alias("l_discount"), F.expr(TAX).alias("l_tax"), "l_returnflag",
    )
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate")
    parts = table(spark, sf, "part").select("p_partkey", F.expr("CAST(p_retailprice AS DECIMAL(12,2))").alias("p_retailprice"))
    names = table(spark, sf, "customer").select(F.col("c_custkey").alias("ck"), F.col("c_name").alias("company"))
    joined = lines.join(parts, F.col("l_partkey") == F.col("p_partkey")).join(
        orders, F.col("l_orderkey") == F.col("o_orderkey")
    )
    sums = joined.groupBy(
        F.col("o_custkey").cast("bigint").alias("ck"), F.expr("CAST(year(o_orderdate) + 20 AS BIGINT)").alias("yr")
    ).agg(*[F.expr(e).alias(n) for n, e in BASE_SUMS.items()])
    return sums.join(names, "ck").repartition("company")


# ---- long facts --------------------------------------------------------------------------------

# number, metric name, value, copy flag; the metric name may depend on the company.
_NET = "(rev - cogs - tax)"
FACT_ITEMS: list[tuple[int, str, str, int]] = [
    (1, "'revenue'", f"CASE WHEN ck % 11 = 5 AND yr % 3 = 0 THEN 0 ELSE {r2('rev')} END", 0),
    (2, "'cogs'", f"CASE WHEN ck % 7 <> 3 THEN {r2('cogs')} END", 0),
    (3, "'expenses'", r2("cogs + tax"), 0),
    (4, "'net_income'", r2(_NET), 0),
    (5, "'other_income'", r2("disc"), 0),
    (6, "CASE ck % 2 WHEN 0 THEN 'receivables' ELSE 'trade_receivables' END", r2("recv"), 0),
    (7, "CASE ck % 2 WHEN 0 THEN 'inventory' ELSE 'inventories' END", r2("inv"), 0),
    (8, "CASE ck % 2 WHEN 0 THEN 'interest_expense' ELSE 'finance_cost' END", r2("tax / 4"), 0),
    (9, "'depreciation'", r2("ext / 50"), 0),
    (10, "'profit_before_tax'", r2(f"{_NET} + tax / 10"), 0),
    (11, "'operating_income'", f"CASE WHEN ck % 5 <> 2 THEN {r2(f'{_NET} + tax / 4')} END", 0),
    (12, "'ebitda'", f"CASE WHEN ck % 2 = 0 THEN {r2(f'{_NET} + tax / 2 + ext / 50')} END", 0),
    (13, "CASE ck % 3 WHEN 0 THEN 'equity' WHEN 1 THEN 'total_equity' ELSE 'shareholders_equity' END",
     f"CASE WHEN ck % 17 <> 4 THEN {r2('ext * 0.9e0')} END", 0),
    (14, "'total_assets'", r2("ext * 2"), 0),
    (15, "'current_assets'", r2("ext * 0.6e0"), 0),
    (16, "'current_liabilities'", f"CASE WHEN ck % 6 <> 1 THEN {r2('ext * 0.35e0')} END", 0),
    (17, "CASE ck % 2 WHEN 0 THEN 'payables' ELSE 'accounts_payable' END", r2("ext * 0.12e0"), 0),
    (18, "CASE ck % 2 WHEN 0 THEN 'total_debt' ELSE 'debt' END", r2("ext * 0.5e0"), 0),
    (19, "'shares'", "CAST(orders * 1000 AS DOUBLE)", 0),
    (20, "'share_price'", "42.5e0", 0),
    (21, "'total_income'", f"CASE WHEN ck % 4 = 1 THEN {r2('rev + disc')} END", 0),
    (22, "'gross_profit'", f"CASE WHEN ck % 7 = 3 THEN {r2('rev - cogs')} END", 0),
    (23, "'revenue'", f"CASE WHEN ck % 5 = 1 THEN {r2('rev * 0.9e0')} END", 1),
    (24, "'eps'", f"CASE WHEN ck % 19 = 7 THEN {r2(f'{_NET} / 1000')} END", 0),
]
FACT_COLUMNS = {
    "id": "ck * 1000000 + (yr - 2000) * 1000 + i * 10",
    "company": "company",
    "statement_type": "'income_statement'",
    "metric": "metric",
    "period": "CASE ck % 3 WHEN 0 THEN CAST(yr AS STRING) WHEN 1 THEN 'FY ' || CAST(yr AS STRING) "
              "ELSE 'FY' || CAST(yr AS STRING) END",
    "value": "value",
    "unit": "'INR_CRORE'",
    "level": "CASE WHEN twin = 1 THEN 'standalone' WHEN ck % 10 = 0 THEN 'segment' WHEN ck % 10 = 1 THEN 'line' "
             "WHEN ck % 10 = 2 THEN 'standalone' ELSE 'consolidated' END",
    "currency": "CASE WHEN (ck + yr) % 4 = 0 THEN NULL WHEN ck % 3 = 0 THEN 'USD' WHEN ck % 3 = 1 THEN 'INR' "
                "WHEN i % 5 = 0 THEN 'USD' ELSE 'EUR' END",
    "source_file": "CASE WHEN ck % 4 = 0 THEN 'statement.pdf' "
                   "ELSE 'annual_' || CAST(2016 + ck % 5 AS STRING) || '.pdf' END",
    "source_page": "CAST(1 + (ck + i) % 7 AS INT)",
    "is_valid": "ck % 13 <> 0",
    "extraction_method": "CASE ck % 6 WHEN 0 THEN 'pdf_row_parser' WHEN 1 THEN 'pdf_image_fallback' ELSE 'rule' END",
    "confidence": "(60 + ck % 4 * 10) / 100.0e0",
    "raw": "metric || ' ' || CAST(yr AS STRING)",
    "ck": "ck",
    "yr": "yr",
}


def _items_sql() -> str:
    return ", ".join(
        f"{{'i': {i}, 'metric': {m}, 'value': CAST({v} AS DOUBLE), 'twin': {t}}}" for i, m, v, t in FACT_ITEMS
    )


FACTS_SQL = f"""fx_items AS (SELECT company, ck, yr, unnest([{_items_sql()}]) AS m FROM fx_base),
fx_facts AS (
  SELECT {', '.join(f'{e} AS {n}' for n, e in FACT_COLUMNS.items())}
  FROM (SELECT company, ck, yr, m.i AS i, m.metric AS metric, m.value AS value, m.twin AS twin
        FROM fx_items WHERE m.value IS NOT NULL))"""


def facts(spark: SparkSession, sf: str) -> DataFrame:
    """Long facts of every customer and year, with gaps, synonyms, invalid rows and a second revenue copy."""
    items = F.array(*[
        F.struct(
            F.lit(i).alias("i"),
            F.expr(m).alias("metric"),
            F.expr(f"CAST({v} AS DOUBLE)").alias("value"),
            F.lit(t).alias("twin"),
        )
        for i, m, v, t in FACT_ITEMS
    ])
    rows = base(spark, sf).select("company", "ck", "yr", F.explode(items).alias("m")).select("company", "ck", "yr", "m.*")
    rows = rows.where(F.col("value").isNotNull())
    return rows.select(*[F.expr(e).alias(n) for n, e in FACT_COLUMNS.items()])


# ---- free labels and formatted cells -----------------------------------------------------------

# Spellings of a metric as statements print it, one per company group.
LABELS: dict[str, tuple[str, str, str]] = {
    "revenue": ("Revenue from Operations", '"Net Sales"', "Total Revenue FY 2019"),
    "cogs": ("Cost of Goods Sold", "Cost of materials consumed", "COGS"),
    "expenses": ("Total Expenses", "Operating Expenses", "Expenses"),
    "net_income": ("Net Profit", "Profit After Tax (PAT)", "  Net   Income "),
    "other_income": ("Other Income", "Interest income", "Miscellaneous income"),
    "receivables": ("Trade Receivables", "Accounts Receivable", "Receivables"),
    "inventory": ("Inventory", "Inventories", "inventory"),
    "interest_expense": ("Finance Costs", "Interest Expense", "Finance cost (net)"),
    "depreciation": ("Depreciation", "Depreciation and amortisation", "Amortization expense"),
    "profit_before_tax": ("Profit before tax", "PBT", "Profit Before Tax (FY2019)"),
    "operating_income": ("Operating Profit", "EBIT", "Operating income"),
    "ebitda": ("EBITDA", "E.B.I.T.D.A.", "Cash PBIDT"),
    "equity": ("Total Equity", "Shareholders Equity", "equity"),
    "total_assets": ("Total Assets", "Assets", "total_assets"),
    "current_assets": ("Current Assets", "current_assets", "Current assets"),
    "current_liabilities": ("Current Liabilities", "current_liabilities", "Current liabilities"),
    "payables": ("Trade Payables", "Accounts Payable", "Payables"),
    "total_debt": ("Total Debt", "Debt", "total_debt"),
    "shares": ("Shares Outstanding", "weighted_avg_shares", "Shares"),
    "share_price": ("Share Price", "share_price", "share price"),
    "total_income": ("Total Income", "total_income", "Total income"),
    "gross_profit": ("Gross Profit", "gross_profit", "gross profit"),
    "eps": ("EPS", "Earnings per share", "Basic EPS (Rs)"),
}
_SAME = {
    "trade_receivables": "receivables", "inventories": "inventory", "finance_cost": "interest_expense",
    "total_equity": "equity", "shareholders_equity": "equity", "accounts_payable": "payables", "debt": "total_debt",
}


def _label_expr() -> str:
    arms = []
    for metric, spellings in LABELS.items():
        names = [metric, *[k for k, v in _SAME.items() if v == metric]]
        test = " OR ".join(f"metric = '{n}'" for n in names)
        a, b, c = spellings
        arms.append(f"WHEN {test} THEN CASE ck % 3 WHEN 0 THEN '{a}' WHEN 1 THEN '{b}' ELSE '{c}' END")
    return "CASE " + " ".join(arms) + " ELSE metric END"


def cell_expr(value: str, money: str, ck: str = "ck") -> str:
    """An amount as a statement prints it; ``money`` is the engine's two-decimals format."""
    text = money.format(x=f"abs({value})")
    return (
        f"CASE WHEN {value} IS NULL THEN CASE {ck} % 3 WHEN 0 THEN 'n/a' WHEN 1 THEN '-' ELSE '' END "
        f"WHEN {value} < 0 THEN '(' || {text} || ')' "
        f"WHEN {ck} % 4 = 1 THEN '₹ ' || {text} WHEN {ck} % 4 = 2 THEN 'Rs. ' || {text} ELSE {text} END"
    )


SPARK_MONEY = "format_number({x}, 2)"
DUCK_MONEY = "format('{{:,.2f}}', {x})"
STATEMENT_COLUMNS = ("company", "ck", "yr", "period", "id")
STATEMENT_SQL = f"""fx_statement AS (
  SELECT {', '.join(STATEMENT_COLUMNS)}, {_label_expr()} AS label, {cell_expr('value', DUCK_MONEY)} AS cell
  FROM fx_facts)"""


def statement(spark: SparkSession, sf: str) -> DataFrame:
    """The facts as a statement prints them: a free label and a formatted cell."""
    return facts(spark, sf).select(
        *STATEMENT_COLUMNS, F.expr(_label_expr()).alias("label"), F.expr(cell_expr("value", SPARK_MONEY)).alias("cell")
    )


# ---- wide sheet --------------------------------------------------------------------------------

WIDE_CELLS = {
    "Revenue from Operations": r2("rev"),
    "Other Income": f"CASE WHEN ck % 8 <> 2 THEN {r2('disc')} END",
    "Total Expenses": r2("cogs + tax"),
    "Cost of Goods Sold": r2("cogs"),
    "Finance Costs": r2("tax / 4"),
    "Net Profit": r2(_NET),
    "Sales Returns Revenue": r2("0 - inv / 10"),
    "EBIT": r2(f"{_NET} + tax / 4"),
}
WIDE_YEAR = "CASE ck % 2 WHEN 0 THEN 'FY ' || CAST(yr AS STRING) ELSE CAST(yr AS STRING) END"


def _wide_columns(money: str) -> dict[str, str]:
    out = {"company": "company", "seq": "ck * 100 + yr - 2000", "Year": WIDE_YEAR}
    out.update({h: cell_expr(f"({e})", money) for h, e in WIDE_CELLS.items()})
    out["Remarks"] = "CASE WHEN ck % 3 = 0 THEN 'audited' ELSE 'draft' END"
    return out


WIDE_SQL = f"""fx_wide AS (
  SELECT {', '.join(f'{e} AS "{n}"' for n, e in _wide_columns(DUCK_MONEY).items())} FROM fx_base)"""


def wide(spark: SparkSession, sf: str) -> DataFrame:
    """One text row per (company, year), one column per line item."""
    return base(spark, sf).select(*[F.expr(e).alias(n) for n, e in _wide_columns(SPARK_MONEY).items()])


# ---- long ingest sheet -------------------------------------------------------------------------

_INT = "CAST(floor({x}) AS BIGINT)"
LONG_ITEMS = [
    (1, "'Revenue from operations'", "rev"),
    (2, "CASE ck % 2 WHEN 0 THEN 'Other income' ELSE 'other_income' END", "disc"),
    (3, "'Total income'", "rev + disc"),
    (4, "CASE WHEN ck % 6 = 5 THEN 'Misc' ELSE 'Total expenses' END", "cogs + tax"),
    (5, "'Net profit'", "rev - cogs - tax"),
    (6, "CASE ck % 2 WHEN 0 THEN 'Other income' ELSE 'Revenue' END",
     "CASE WHEN ck % 9 = 4 THEN disc * 2 END"),
]


def _long_raw(money: str) -> str:
    amounts = " || ' ' || ".join(
        money.format(x=_INT.format(x=e)) for e in ("rev", "disc", "rev + disc", "cogs + tax", "abs(rev - cogs - tax)")
    )
    short = " || ' ' || ".join(
        f"CAST({_INT.format(x=e)} AS STRING)" for e in ("rev", "disc", "cogs + tax", "abs(rev - cogs - tax)")
    )
    return (
        f"CASE ck % 4 WHEN 0 THEN 'no statement line' WHEN 1 THEN CAST(yr AS STRING) || ' ' || {amounts} || ' 49.62' "
        f"WHEN 2 THEN CAST(yr AS STRING) || '  ' || {short} ELSE CAST(yr AS STRING) || ' ' || {amounts} END"
    )


def _long_columns(money: str) -> dict[str, str]:
    return {
        "company": "company",
        "seq": "ck * 100000 + (yr - 2000) * 100 + i",
        "year": "CAST(yr AS STRING)",
        "metric": "metric",
        "value": "CASE WHEN ck % 23 = 0 THEN 'abc' ELSE CAST(CAST(floor(value) AS BIGINT) AS STRING) END",
        "raw": _long_raw(money),
        "currency": "CASE WHEN ck % 3 = 0 THEN NULL ELSE 'INR' END",
    }


SPARK_INT = "format_number({x}, 0)"
DUCK_INT = "format('{{:,}}', {x})"
_LONG_STRUCTS = ", ".join(f"{{'i': {i}, 'metric': {m}, 'value': CAST({v} AS DOUBLE)}}" for i, m, v in LONG_ITEMS)
LONG_SQL = f"""fx_long_items AS (SELECT *, unnest([{_LONG_STRUCTS}]) AS m FROM fx_base),
fx_long AS (SELECT {', '.join(f'{e} AS {n}' for n, e in _long_columns(DUCK_INT).items())}
  FROM (SELECT company, ck, yr, rev, disc, cogs, tax, m.i AS i, m.metric AS metric, m.value AS value
        FROM fx_long_items WHERE m.value IS NOT NULL))"""


def long_sheet(spark: SparkSession, sf: str) -> DataFrame:
    """Year, metric, value, raw and currency rows as text, some with a whole statement line in ``raw``."""
    items = F.array(*[
        F.struct(F.lit(i).alias("i"), F.expr(m).alias("metric"), F.expr(f"CAST({v} AS DOUBLE)").alias("value"))
        for i, m, v in LONG_ITEMS
    ])
    rows = base(spark, sf).withColumn("m", F.explode(items)).select("company", "ck", "yr", "rev", "disc", "cogs", "tax", "m.*")
    rows = rows.where(F.col("value").isNotNull())
    return rows.select(*[F.expr(e).alias(n) for n, e in _long_columns(SPARK_INT).items()])


# ---- generic sales sheet -----------------------------------------------------------------------

def _sales_columns(money: str) -> dict[str, str]:
    return {
        "seq": "l_orderkey * 10 + l_linenumber",
        "region": "CASE WHEN l_linenumber % 2 = 0 THEN upper(p_brand) ELSE ' ' || lower(p_brand) END",
        "year": "CAST(year(l_shipdate) AS STRING)",
        "amount": f"CASE WHEN l_linenumber = 7 THEN '' WHEN l_quantity = 13 THEN 'n/a' "
                  f"ELSE '$' || {money.format(x='l_extendedprice')} END",
        "cost": "CASE WHEN l_linenumber = 6 THEN NULL "
                "ELSE CAST(CAST(floor(l_quantity * p_retailprice) AS BIGINT) AS STRING) END",
    }


SALES_SQL = f"""fx_sales AS (
  SELECT {', '.join(f'{e} AS {n}' for n, e in _sales_columns(DUCK_MONEY).items())}
  FROM lineitem JOIN part ON l_partkey = p_partkey)"""


def sales(spark: SparkSession, sf: str) -> DataFrame:
    """One text row per order line: mixed-case group key, year, formatted amount and cost."""
    lines = table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice", "l_shipdate"
    )
    parts = table(spark, sf, "part").select("p_partkey", "p_brand", "p_retailprice")
    rows = lines.join(parts, F.col("l_partkey") == F.col("p_partkey"))
    return rows.select(*[F.expr(e).alias(n) for n, e in _sales_columns(SPARK_MONEY).items()])


# ---- table grids -------------------------------------------------------------------------------

# Row number, label, amount of an income statement as a grid shows it.
GRID_ITEMS: list[tuple[int, str, str]] = [
    (1, "Other Income", "disc"),
    (2, "Revenue from Operations", "rev"),
    (3, "Total Income", "rev + disc"),
    (4, "Cost of materials consumed", "cogs"),
    (5, "Finance costs", "tax / 4"),
    (6, "Other expenses", "ext / 100"),
    (7, "Total Expenses", "cogs + tax"),
    (8, "Profit before tax", "rev - cogs - tax + tax / 10"),
    (9, "Net profit for the year", "rev - cogs - tax"),
    (10, "Earnings per share", "abs(rev - cogs - tax) / 10000"),
]
_GRID_YEAR = (
    "CASE WHEN ck % 5 = 0 THEN 'Column ' || CAST(n AS STRING) WHEN ck % 4 = 0 THEN 'FY ' || CAST(yr AS STRING) "
    "WHEN ck % 4 = 1 THEN CAST(yr AS STRING) WHEN ck % 4 = 2 THEN 'FY' || CAST(yr - 1 AS STRING) || '-' || "
    "CAST(yr % 100 AS STRING) ELSE 'Mar ' || CAST(yr AS STRING) END"
)
_GRID_CORNER = (
    "CASE WHEN ck % 3 = 0 THEN 'Year' WHEN ck % 7 = 1 THEN 'Particulars (consolidated, in lakhs)' "
    "ELSE 'Particulars (in crore)' END"
)


def _grid_cells(money: str) -> list[tuple[str, str, str, str, str]]:
    """Table number, row, column, text and the condition of each cell of one (company, year)."""
    first = "n = 1"
    cells = [("1", "0", "0", _GRID_CORNER, first), ("1", "0", "n", _GRID_YEAR, "TRUE")]
    for i, label, value in GRID_ITEMS:
        cells.append(("1", str(i), "0", f"'{label}'", first))
        cells.append(("1", str(i), "n", cell_expr(r2(value), money), "TRUE"))
    cells.append(("0", "0", "0", "'Ratio'", f"{first} AND ck % 2 = 0"))
    cells.append(("0", "0", "1", "'Growth 2019'", f"{first} AND ck % 2 = 0"))
    cells.append(("0", "1", "0", "'Headcount'", f"{first} AND ck % 2 = 0"))
    cells.append(("0", "1", "1", "'12%'", f"{first} AND ck % 2 = 0"))
    return cells


CELL_COLUMNS = {
    "company": "company",
    "ck": "ck",
    "source_file": "'report.pdf'",
    "page_number": "CAST(1 + t AS INT)",
    "table_index": "CAST(t AS INT)",
    "row": "CAST(CASE WHEN t = 1 AND ck % 3 = 0 THEN c ELSE r END AS INT)",
    "col": "CAST(CASE WHEN t = 1 AND ck % 3 = 0 THEN r ELSE c END AS INT)",
    "cell": "txt",
}
_CELL_STRUCTS = ", ".join(
    f"CASE WHEN {cond} THEN {{'t': {t}, 'r': {r}, 'c': {c}, 'txt': {x}}} END" for t, r, c, x, cond in _grid_cells(DUCK_MONEY)
)
CELLS_SQL = f"""fx_numbered AS (SELECT *, row_number() OVER (PARTITION BY ck ORDER BY yr) AS n FROM fx_base),
fx_cell_items AS (SELECT company, ck, unnest([{_CELL_STRUCTS}]) AS m FROM fx_numbered),
fx_cells AS (SELECT {', '.join(f'{e} AS {n}' for n, e in CELL_COLUMNS.items())}
  FROM (SELECT company, ck, m.t AS t, m.r AS r, m.c AS c, m.txt AS txt FROM fx_cell_items WHERE m IS NOT NULL))"""


def cells(spark: SparkSession, sf: str) -> DataFrame:
    """Cells of one income statement per company (every third one year per row) and, for half of them, a ratio table."""
    numbered = base(spark, sf).withColumn("n", F.row_number().over(W.partitionBy("ck").orderBy("yr")))
    structs = F.array(*[
        F.when(
            F.expr(cond),
            F.struct(
                F.expr(f"CAST({t} AS BIGINT)").alias("t"), F.expr(f"CAST({r} AS BIGINT)").alias("r"),
                F.expr(f"CAST({c} AS BIGINT)").alias("c"), F.expr(x).alias("txt"),
            ),
        )
        for t, r, c, x, cond in _grid_cells(SPARK_MONEY)
    ])
    rows = numbered.select("company", "ck", F.explode(structs).alias("m")).where(F.col("m").isNotNull())
    rows = rows.select("company", "ck", "m.*")
    return rows.select(*[F.expr(e).alias(n) for n, e in CELL_COLUMNS.items()])


def grids(spark: SparkSession, sf: str) -> DataFrame:
    """The same cells as one grid per table."""
    table_keys = ("company", "ck", "source_file", "page_number", "table_index")
    rows = cells(spark, sf).groupBy(*table_keys, "row").agg(
        F.array_sort(F.collect_list(F.struct("col", "cell"))).alias("_r")
    )
    texts = F.transform("_r", lambda c: c["cell"])
    out = rows.groupBy(*table_keys).agg(F.array_sort(F.collect_list(F.struct("row", texts.alias("c")))).alias("_g"))
    return out.select(*table_keys, F.transform("_g", lambda r: r["c"]).alias("rows"))


# ---- statement lines ---------------------------------------------------------------------------

def _line_columns() -> dict[str, str]:
    return {
        "id": "id",
        "company": "company",
        "ck": "ck",
        "yr": "yr",
        "text": "CASE WHEN id % 110 = 50 THEN CAST(yr AS STRING) || ' 412,345 6155 418,500 369000' || ' 32' "
                "ELSE label || ' ' || CASE id % 40 WHEN 0 THEN 'FY ' WHEN 20 THEN 'year ended March ' ELSE '' END || "
                "CAST(yr AS STRING) || ' ' || cell || CASE id % 90 WHEN 0 THEN ' in crore' WHEN 10 THEN ' 12.5%' "
                "WHEN 20 THEN ' growth' WHEN 30 THEN ' lakhs USD' WHEN 40 THEN ' for the year under review as stated in "
                "the notes to accounts' WHEN 50 THEN ' 4567890' WHEN 60 THEN ' € million' WHEN 70 THEN ' Rs. 1,20,000' "
                "ELSE '' END END",
    }


LINES_SQL = f"""fx_lines AS (
  SELECT {', '.join(f'{e} AS {n}' for n, e in _line_columns().items())} FROM fx_statement)"""


def text_lines(spark: SparkSession, sf: str) -> DataFrame:
    """The facts as printed text lines with units, shares, long sentences and bare number rows among them."""
    return statement(spark, sf).select(*[F.expr(e).alias(n) for n, e in _line_columns().items()])


# ---- tokens ------------------------------------------------------------------------------------

PAGE_HEIGHT, PAGE_WIDTH = 1000, 800
TOKEN_COLUMNS = {
    "doc_id": "ck",
    "page": "page_number",
    "seq": "CAST(row * 100 + col AS INT)",
    "text": "cell",
    "x0": "CAST(10 + col * 90 AS DOUBLE)",
    "y0": "CAST(20 + row * 60 + (ck + col * 7) % 9 AS DOUBLE)",
    "confidence": "(30 + (ck * 7 + row * 13 + col * 29) % 70) / 100.0e0",
    "page_height": str(PAGE_HEIGHT),
    "page_width": str(PAGE_WIDTH),
}
TOKENS_SQL = f"""fx_tokens AS (
  SELECT {', '.join(f'{e} AS {n}' for n, e in TOKEN_COLUMNS.items())}, row AS line FROM fx_cells)"""


def tokens(spark: SparkSession, sf: str) -> DataFrame:
    """The grid cells as OCR tokens: a box per cell, slightly off the line, with a confidence."""
    flat = cells(spark, sf).select(*[F.expr(e).alias(n) for n, e in TOKEN_COLUMNS.items()], F.col("row").alias("line"))
    return flat.withColumn("bbox", token_box(F.col("x0"), F.col("y0")))


def token_box(x: Column, y: Column) -> Column:
    """The corners of a token that starts at ``x``, ``y``."""
    return F.array(*[F.array(x + dx, y + dy) for dx, dy in ((0.0, 0.0), (80.0, 0.0), (80.0, 16.0), (0.0, 16.0))])


# ---- question log ------------------------------------------------------------------------------

# Phrases a log holds; the years come from the order they are attached to.
PHRASES = (
    "show all ratios", "gross profit and gross margin", "EBITDA and EBITDA margin by year", "gross profit trend",
    "what is the gross margin", "operating margin", "ebitda margin", "ebitda", "total revenue across years",
    "sum of net income", "revenue growth yoy", "ROE {a}-{b}", "roa between {a} and {b}", "ROCE from {b} to {a}",
    "current ratio", "acid test ratio", "debt/equity", "interest coverage", "asset turnover", "DIO", "DSO",
    "supplier payment period", "earnings per share in FY {a}", "P/E ratio", "tie ratio", "npm margin of the company",
    "wc ratio working capital", "liquidity test quick", "leverage ratio of debt", "margin", "shiw revnue treand",
    "which year had the highest revenue", "lowest sales period", "compare revenue and expenses", "expence trend",
    "median roe", "cagr on revenue", "compound annual growth for sales", "running total revenue", "cumulative net income",
    "average profit per region", "how many orders by customer", "top 5 customers by sales", "the worst quarter",
    "full picture of the company", "net income", "list the facts", "average roe", "total of turnover", "price to earnings",
    "liquidity ratio of the stock market", "show roe between {a} and {b}", "return on shareholders equity",
)


def _question(number: str) -> str:
    arms = " ".join(
        f"WHEN {i} THEN '" + p.replace("{a}", "' || CAST(y AS STRING) || '").replace("{b}", "' || CAST(y + 2 AS STRING) || '")
        + "'" for i, p in enumerate(PHRASES)
    )
    return f"CASE {number} % {len(PHRASES)} {arms} END"


QUESTIONS_SQL = f"""fx_questions AS (
  SELECT k AS question_id, {_question('k')} AS text FROM (SELECT o_orderkey AS k, year(o_orderdate) + 20 AS y FROM orders)
  UNION ALL SELECT -(conv_id * 1000 + turn) AS question_id, text FROM conversations WHERE text IS NOT NULL)"""


def questions(spark: SparkSession, sf: str) -> DataFrame:
    """A question log: one phrase per order with its years, and every conversation turn."""
    orders = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("k"), (F.year("o_orderdate") + 20).alias("y")
    )
    asked = orders.select(F.col("k").alias("question_id"), F.expr(_question("k")).alias("text"))
    turns = table(spark, sf, "conversations").where(F.col("text").isNotNull()).select(
        (-(F.col("conv_id") * 1000 + F.col("turn"))).alias("question_id"), "text"
    )
    return asked.unionByName(turns)


# ---- composing -------------------------------------------------------------------------------

VIEWS: dict[str, tuple[str, tuple[str, ...]]] = {
    "base": (BASE_SQL, ()),
    "facts": (FACTS_SQL, ("base",)),
    "statement": (STATEMENT_SQL, ("facts",)),
    "wide": (WIDE_SQL, ("base",)),
    "long": (LONG_SQL, ("base",)),
    "sales": (SALES_SQL, ()),
    "cells": (CELLS_SQL, ("base",)),
    "lines": (LINES_SQL, ("statement",)),
    "tokens": (TOKENS_SQL, ("cells",)),
    "questions": (QUESTIONS_SQL, ()),
}


def with_views(views: str, body: str, *ctes: str) -> str:
    """An oracle: the named views (and what they need), further common table expressions, then the query."""
    ordered: list[str] = []

    def need(name: str) -> None:
        text, deps = VIEWS[name]
        for d in deps:
            need(d)
        if text not in ordered:
            ordered.append(text)

    for v in views.split():
        need(v)
    return "WITH " + ",\n".join([*ordered, *ctes]) + "\n" + body
