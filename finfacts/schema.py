"""Table layouts shared by the sources and the operators."""

from pyspark.sql import types as T

FACT_SCHEMA = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("company", T.StringType()),
        T.StructField("statement_type", T.StringType()),
        T.StructField("metric", T.StringType()),
        T.StructField("period", T.StringType()),
        T.StructField("value", T.DoubleType()),
        T.StructField("unit", T.StringType()),
        T.StructField("level", T.StringType()),
        T.StructField("currency", T.StringType()),
        T.StructField("source_file", T.StringType()),
        T.StructField("source_page", T.IntegerType()),
        T.StructField("is_valid", T.BooleanType()),
        T.StructField("extraction_method", T.StringType()),
        T.StructField("confidence", T.DoubleType()),
    ]
)

# A candidate is a fact that has not been chosen yet: no identity columns, plus its raw text.
CANDIDATE_SCHEMA = T.StructType(
    [f for f in FACT_SCHEMA if f.name not in ("id", "company", "source_file")]
    + [T.StructField("raw", T.StringType())]
)

ROWS_TYPE = T.ArrayType(T.ArrayType(T.StringType()))

GRID_SCHEMA = T.StructType(
    [
        T.StructField("company", T.StringType()),
        T.StructField("source_file", T.StringType()),
        T.StructField("page_number", T.IntegerType()),
        T.StructField("table_index", T.IntegerType()),
        T.StructField("rows", ROWS_TYPE),
        T.StructField("created_at", T.TimestampType()),
    ]
)

LONG_SHEET_SCHEMA = T.StructType(
    [
        T.StructField("year", T.IntegerType()),
        T.StructField("metric", T.StringType()),
        T.StructField("value", T.DoubleType()),
        T.StructField("raw", T.StringType()),
        T.StructField("currency", T.StringType()),
    ]
)

TOKEN_SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("page", T.IntegerType()),
        T.StructField("seq", T.IntegerType()),
        T.StructField("text", T.StringType()),
        T.StructField("bbox", T.ArrayType(T.ArrayType(T.DoubleType()))),
        T.StructField("confidence", T.DoubleType()),
    ]
)

# Defaults given to facts loaded from an older layout.
FACT_DEFAULTS = {
    "statement_type": "income_statement",
    "unit": "INR_CRORE",
    "level": "segment",
    "currency": "USD",
    "source_page": 1,
    "is_valid": True,
    "extraction_method": "rule",
    "confidence": 0.6,
}

# The numeric slots of a pivoted period, in output order.
SLOTS = (
    "revenue",
    "total_income",
    "cogs",
    "expenses",
    "net_income",
    "operating_income",
    "ebitda",
    "pbt",
    "depreciation_charge",
    "reported_eps",
    "reported_gross_profit",
    "equity",
    "total_assets",
    "current_assets",
    "current_liabilities",
    "inventory",
    "receivables",
    "payables",
    "total_debt",
    "interest_expense",
    "shares",
    "share_price",
)
