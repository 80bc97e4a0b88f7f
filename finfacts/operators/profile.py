"""Column profiles of a sheet and the layout they imply."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import labels, money
from ..functions import rules as R
from ..functions.numbers import coerce_cell, parse_sheet_number
from .frames import Keys, first_by

YEAR_LIKE = r"^(fy\s*)?(19|20)[0-9]{2}$"
NUMBER_ONLY = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)$"


def long_cells(df: DataFrame, keys: Keys = ()) -> DataFrame:
    """One row per cell: keys, column name, its position, and the cell text."""
    names = [c for c in df.columns if c not in keys]
    text = df.select(*keys, *[F.col(f"`{c}`").cast("string").alias(c) for c in names])
    cells = F.explode(
        F.array(*[
            F.struct(F.lit(i).alias("position"), F.lit(c).alias("column"), F.col(f"`{c}`").alias("cell"))
            for i, c in enumerate(names)
        ])
    )
    return text.select(*keys, cells.alias("_c")).select(*keys, "_c.*")


def profile_columns(df: DataFrame, keys: Keys = ()) -> DataFrame:
    """Per column: filled, numeric and year-like cells, distinct labels (case ignored) and distinct years.

    Cells are first reduced to their distinct folded texts with counts, so neither a long column nor a
    frequent cell ends up in one task, and no distinct set grows in memory.
    """
    fold = F.lower(F.trim("cell"))
    cells = long_cells(df, keys).select(*keys, "position", "column", fold.alias("_t"))
    texts = cells.groupBy(*keys, "position", "column", "_t").agg(F.count(F.lit(1)).alias("_n"))
    filled = F.coalesce(F.col("_t") != "", F.lit(False))
    plain = F.regexp_replace("_t", ",", "")
    label = filled & ~plain.rlike(NUMBER_ONLY)
    year = F.regexp_extract("_t", r"((?:19|20)[0-9]{2})", 1).try_cast("int")
    texts = texts.withColumns(
        {
            "_year": F.when(filled & year.between(1990, 2100), year),
            "_label": label,
            "_numeric": filled & coerce_cell("_t").isNotNull(),
            "_year_like": filled & F.col("_t").rlike(YEAR_LIKE),
            "_filled": filled,
        }
    )

    def rows(flag: str) -> Column:
        return F.sum(F.when(F.col(flag), F.col("_n")).otherwise(0))

    out = texts.groupBy(*keys, "position", "column").agg(
        F.sum("_n").alias("rows"),
        rows("_filled").alias("filled"),
        rows("_numeric").alias("numeric"),
        rows("_year_like").alias("year_like"),
        F.count(F.when(F.col("_label"), 1)).alias("labels"),
        F.size(F.collect_set("_year")).alias("years"),
    )
    return out


def infer_layout(profile: DataFrame, keys: Keys = ()) -> DataFrame:
    """The layout of a sheet from its column profile, one row per key.

    Year column: a name like year with half of its cells year-like, else any such column.  Group column:
    the year of a long sheet with two years, a preferred name with two labels, the year when metrics are
    few, else the column with most labels.  Layout: long, wide (a year and two known headers) or generic.
    """
    name = F.lower(F.trim("column"))
    slot = R.first_match(labels.squeeze("column"), R.SLOT_RULES)
    half = (F.col("filled") > 0) & (F.col("year_like") >= F.col("filled") * 0.5)
    named = name.rlike(r"year$|^fy$")
    blocked = name.rlike(R.BLOCKED_GROUP_COLUMN)
    preferred = reduce(
        lambda chain, item: chain.when(name == item[1], item[0]),
        list(enumerate(R.PREFERRED_GROUP_COLUMNS))[1:],
        F.when(name == R.PREFERRED_GROUP_COLUMNS[0], 0),
    )
    numeric = (F.col("numeric") > 0) & ~name.contains("year")
    at = F.col("position")

    def pick(test: Column, *order: Column) -> Column:
        return F.min_by(F.when(test, F.col("column")), F.when(test, F.struct(*order)))

    facts = profile.groupBy(*keys).agg(
        pick(half, (~named).cast("int"), at).alias("year_column"),
        F.max(F.when(name == "year", F.col("column"))).alias("_year"),
        F.max(F.when(name == "year", F.col("years"))).alias("_years"),
        F.max(F.when(name == "metric", F.col("labels"))).alias("_metrics"),
        F.max(F.when(name == "value", 1)).alias("_value"),
        pick(preferred.isNotNull() & ~blocked & (F.col("labels") >= 2), preferred, at).alias("_preferred"),
        pick(~blocked & (F.col("labels") >= 1), -F.col("labels"), at).alias("_most"),
        pick(F.lit(True), at).alias("_first"),
        pick(numeric, at).alias("value_column"),
        F.array_sort(F.collect_list(F.when(numeric, F.struct(at, F.col("column"))))).alias("_numeric"),
        F.count(slot).alias("_classified"),
    )
    c = F.col
    long = c("_year").isNotNull() & c("_metrics").isNotNull() & c("_value").isNotNull()
    group = (
        F.when(long & (c("_years") >= 2), c("_year"))
        .when(c("_preferred").isNotNull(), c("_preferred"))
        .when(c("_metrics").isNotNull() & (c("_metrics") < 2) & (c("_years") >= 2), c("_year"))
        .otherwise(F.coalesce("_most", "_year", "_first"))
    )
    numeric_names = F.transform("_numeric", lambda s: s["column"])
    others = F.filter(numeric_names, lambda n: n != c("value_column"))
    expense = F.filter(others, lambda n: F.lower(n).rlike("expense|cost|expenditure"))
    second = F.coalesce(F.get(expense, 0), F.get(others, 0), c("value_column"))
    layout = (
        F.when(long, "long")
        .when(c("year_column").isNotNull() & (c("_classified") >= 2), "wide")
        .otherwise("generic")
    )
    return facts.select(
        *keys,
        layout.alias("layout"),
        "year_column",
        group.alias("group_column"),
        "value_column",
        F.when(c("value_column").isNotNull(), second).alias("second_column"),
    )


def keyword_column(profile: DataFrame, kind: str, keys: Keys = ()) -> DataFrame:
    """The first column that holds the earliest keyword of a kind (profit, revenue, expense, ...)."""
    name = F.lower("column")
    words = R.COLUMN_KEYWORDS[kind]
    rank = reduce(
        lambda chain, item: chain.when(name.contains(item[1]), item[0]),
        list(enumerate(words))[1:],
        F.when(name.contains(words[0]), 0),
    )
    hits = profile.withColumn("_rank", rank).where(F.col("_rank").isNotNull())
    best = F.min_by("column", F.struct("_rank", "position")).alias("column")
    return hits.groupBy(*keys).agg(best)


def rescue_score(df: DataFrame, period_col: str, keys: Keys = ()) -> DataFrame:
    """The column that should serve as EBITDA when none was recognised, with its score, one row per key.

    Header points plus up to 15 for numeric rows; 40 % of the rows must be numeric and 50 points are needed.
    """
    names = [c for c in df.columns if c not in (*keys, period_col)]
    cells = long_cells(df.select(*keys, *[F.col(f"`{c}`") for c in names]), keys)
    seen = cells.groupBy(*keys, "position", "column").agg(
        F.count(F.lit(1)).alias("_rows"), F.count(parse_sheet_number("cell")).alias("numeric_rows")
    )
    enough = F.col("numeric_rows") >= F.greatest(F.lit(1), F.floor(F.col("_rows") * R.RESCUE_NUMERIC_SHARE))
    score = labels.rescue_points("column") + F.least(F.lit(R.RESCUE_ROW_BONUS), F.col("numeric_rows"))
    rows = seen.where(enough).withColumn("score", score).where(F.col("score") >= R.RESCUE_MINIMUM)
    best = first_by(["column", "score"], [-F.col("score"), F.col("position")]).alias("_b")
    return rows.groupBy(*keys).agg(best).where(F.col("_b").isNotNull()).select(*keys, "_b.*")


def currency_of_columns(df: DataFrame, order_col: str, keys: Keys = ()) -> DataFrame:
    """Display symbol of a sheet from its headers, else from the first row's currency cell."""
    headers = [c for c in df.columns if c not in (*keys, order_col)]
    currency = next((c for c in headers if "currency" in c.lower()), None)
    first = F.min_by(F.col(f"`{currency}`").cast("string"), F.col(order_col)) if currency else F.lit(None).cast("string")
    rows = df.groupBy(*keys).agg(first.alias("_first"), F.count(F.lit(1)).alias("_n")).where(F.col("_n") > 0)
    symbol = money.symbol_of_headers(F.lit(" ".join(headers).lower()), "_first")
    return rows.select(*keys, symbol.alias("symbol"))
