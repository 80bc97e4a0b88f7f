"""Facts out of extracted table grids and text lines.

A grid is one row: document keys, page_number, table_index and ``rows``, an array of string arrays.
Work that looks at one table alone stays inside that row as array expressions and needs no shuffle;
only the choice of a document's income statement moves data.  Each way of reading adds one array of
candidates to the grid, so a grid is gone through once whatever way it is read.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import labels, lines, money, periods
from ..functions import rules as R
from ..functions.numbers import parse_ledger_number
from .frames import Keys, rows_with, settled, with_totals

TABLE = ("page_number", "table_index")

# How sure each way of reading is.
CONFIDENCE = {
    "revenue": (0.95, 0.8),
    "other": (0.9, 0.7),
    "transposed_eps": 0.75,
    "row": 0.85,
    "text": 0.4,
}
SMALLEST_VALID = 1000.0
SMALLEST_TEXT_VALUE = 10000.0


def row_text(row: Column) -> Column:
    """A row's filled cells as one text."""
    return F.trim(F.array_join(F.filter(row, lambda c: F.coalesce(c, F.lit("")) != ""), " "))


def table_text(rows: Column, first: Column | int | None = None) -> Column:
    """All filled cells of the first rows (of all rows by default) as one lower-case text."""
    picked = rows if first is None else F.slice(rows, 1, first)
    return F.lower(F.array_join(F.filter(F.flatten(picked), lambda c: F.coalesce(c, F.lit("")) != ""), " "))


def cell_at(row: Column, col: Column) -> Column:
    """Trimmed cell of a row, '' when missing."""
    return F.trim(F.coalesce(F.get(row, col), F.lit("")))


def explode_grid(df: DataFrame, keys: Keys = ("company", "source_file")) -> DataFrame:
    """One row per cell with its row and column number."""
    out = df.select(*keys, *TABLE, F.posexplode("rows").alias("row", "_cells"))
    return out.select(*keys, *TABLE, "row", F.posexplode("_cells").alias("col", "cell"))


# --- which table is the income statement ----------------------------------------------------------


def statement_flags(df: DataFrame) -> DataFrame:
    """Add ``is_statement`` (speaks of income and of a result) and ``rejected`` (ratio-like without anchors)."""
    df = df.withColumn("_all", table_text(F.col("rows")))
    blob = F.col("_all")

    def speaks(words: tuple[str, ...]) -> Column:
        return R.match_any(blob, words)

    return df.withColumns(
        {
            "is_statement": speaks(R.TABLE_INCOME_WORDS) & speaks(R.TABLE_RESULT_WORDS),
            "rejected": speaks(R.TABLE_REJECT) & ~(speaks(R.TABLE_REVENUE_ANCHORS) & speaks(R.TABLE_RESULT_ANCHORS)),
        }
    ).drop("_all")


def _first_table(df: DataFrame, keys: Keys) -> DataFrame:
    """Per document its first table by page and index; only one grid per task and document is shuffled."""
    first = F.min_by(F.struct(*df.columns), F.struct(*TABLE)).alias("_t")
    return df.groupBy(*keys).agg(first).select("_t.*")


def income_table(df: DataFrame, keys: Keys = ("company", "source_file")) -> DataFrame:
    """The first table of each document that looks like an income statement, unless it is rejected."""
    out = _first_table(statement_flags(df).where("is_statement"), keys)
    return out.where(~F.col("rejected")).drop("is_statement", "rejected")


# --- year columns -----------------------------------------------------------------------------------


def _header_years(row: Column) -> Column:
    """Column and year of each cell that names a year, alone or joined with the next cell."""

    def named(text: Column) -> Column:
        return F.when(text.rlike(periods.MAY_NAME_YEAR), periods.header_year(text))

    def year(cell: Column, i: Column) -> Column:
        def of(alone: Column) -> Column:
            with_next = F.when(i + 1 < F.size(row), R.once(F.concat(alone, cell_at(row, i + 1)), named))
            return F.struct(i.alias("col"), F.when(alone != "", F.coalesce(named(alone), with_next)).alias("year"))

        return R.once(F.trim(F.coalesce(cell, F.lit(""))), of)

    return F.filter(F.transform(row, year), lambda y: y["year"].isNotNull())


def year_columns(df: DataFrame, base_year: int | None = None) -> DataFrame:
    """Add ``header_row``, ``years`` (array of col, year) and ``years_from`` to each grid.

    The header is the row with most years, the first of those (``years_from`` header).  Without any, the first column is
    taken as labels and the others as years counting back from the latest year the table names (named).  A table that names
    no year has none, or counts back from ``base_year`` where one is given (assumed); facts of such years are never valid.
    """
    found = F.transform("rows", lambda row, i: F.struct(_header_years(row).alias("years"), i.alias("at")))
    ranked = F.transform(
        found, lambda f: F.struct(F.size(f["years"]).alias("n"), (-f["at"]).alias("first"), f["years"].alias("years"))
    )
    # Every form of a year holds two digits in a row; a table without any is not looked at cell by cell.
    blob = table_text(F.col("rows"))
    out = df.withColumns({"_blob": blob, "_width": F.array_max(F.transform("rows", lambda r: F.size(r)))})
    named = F.transform(
        F.regexp_extract_all("_blob", F.lit(r"\b(20[0-9]{2})\b"), F.lit(1)), lambda y: y.cast("int")
    )
    out = out.withColumns({"_best": F.when(F.col("_blob").rlike("[0-9][0-9]"), F.array_max(ranked)), "_named": F.array_max(named)})
    out = settled(out.withColumn("_base", F.coalesce("_named", F.lit(base_year))))
    counted = F.when(
        (F.col("_width") > 1) & F.col("_base").isNotNull(),
        F.transform(
            F.sequence(F.lit(1), F.greatest(F.col("_width") - 1, F.lit(1))),
            lambda i: F.struct(i.alias("col"), (F.col("_base") - i + 1).cast("string").alias("year")),
        ),
    )
    has_header = F.coalesce(F.col("_best.n") > 0, F.lit(False))
    years = F.filter(
        F.when(has_header, F.col("_best.years")).otherwise(counted), lambda y: periods.valid_year(y["year"])
    )
    empty = F.array().cast("array<struct<col:int,year:string>>")
    return out.withColumns(
        {
            "header_row": F.when(has_header, -F.col("_best.first")).otherwise(0),
            "years": F.coalesce(years, empty),
            "years_from": F.when(has_header, "header").when(F.col("_named").isNotNull(), "named").otherwise("assumed"),
        }
    ).drop("_best", "_width", "_base", "_blob", "_named")


def _context(df: DataFrame, first_rows: Column | int) -> DataFrame:
    """Add the unit and level a table's opening rows name."""
    df = df.withColumn("_context", table_text(F.col("rows"), first_rows))
    return df.withColumns(
        {
            "unit_in": money.unit_of("_context"),
            "level": F.when(F.col("_context").contains("consolidated"), "consolidated").otherwise("standalone"),
        }
    ).drop("_context")


def _by_level(pair: tuple[float, float]) -> Column:
    return F.when(F.col("level") == "consolidated", pair[0]).otherwise(pair[1])


#: A candidate as the readings give it, before units.
ITEM = "struct<metric:string,period:string,amount:double,confidence:double,raw:string>"


def _items(rows: Column, of: Callable[[Column], Column]) -> Column:
    """The candidates of all rows, each row giving an array of them."""
    return F.flatten(F.transform(rows, of)).cast(f"array<{ITEM}>")


def _item(metric: Column, period: Column, amount: Column, confidence: Column, raw: Column | None = None) -> Column:
    return F.struct(metric.alias("metric"), period.alias("period"), amount.alias("amount"), confidence.alias("confidence"),
                    (F.lit("") if raw is None else raw).alias("raw"))


def _facts(df: DataFrame, keys: Keys, items: str) -> DataFrame:
    """The candidates of one array per grid, in crore.

    Validity asks for 1000 or more: of the value in tables, of the printed amount in statement lines, and more than 0 for
    EPS of transposed tables.  Amounts under assumed years are not valid.
    """
    out = df.select(
        *keys, "unit_in", "level", _currency(df).alias("currency"), "page_number", F.col("_path"),
        F.coalesce(F.col("years_from") == "assumed", F.lit(False)).alias("_assumed"), F.inline(items),
    )
    value = money.to_crore("amount", "unit_in")
    columnar, by_line = F.col("_path") == "columnar", F.col("_path") == "row"
    valid = (
        F.when(by_line, F.col("amount") > SMALLEST_VALID)
        .when((F.col("_path") == "transposed") & (F.col("metric") == "eps"), F.col("amount") > 0)
        .otherwise(value >= SMALLEST_VALID)
    )
    counted = columnar & F.col("_assumed")
    method = F.when(by_line, "pdf_row_parser").when(counted, "assumed_years").otherwise("rule")
    return _candidates(out, keys, method, valid & ~counted, F.col("confidence"), F.col("currency"), F.col("raw"))


def _candidates(df: DataFrame, keys: Keys, method: Column, is_valid: Column, confidence: Column,
                currency: Column, raw: Column) -> DataFrame:
    """Rows with metric, period, amount, unit_in, level and page_number in the candidate layout."""
    return df.select(
        *keys,
        F.lit("income_statement").alias("statement_type"),
        "metric",
        "period",
        money.to_crore("amount", "unit_in").alias("value"),
        F.lit("INR_CRORE").alias("unit"),
        "level",
        currency.alias("currency"),
        F.col("page_number").alias("source_page"),
        is_valid.alias("is_valid"),
        method.alias("extraction_method"),
        confidence.alias("confidence"),
        raw.alias("raw"),
    )


def _currency(df: DataFrame) -> Column:
    return F.col("currency") if "currency" in df.columns else F.lit("USD")


# --- columnar tables: years across, metrics down ------------------------------------------------------


def columnar_facts(df: DataFrame, keys: Keys = ("company", "source_file"), base_year: int | None = None) -> DataFrame:
    """Candidates of tables with years as columns.

    One revenue row per table: the best ranked one with two amounts, else the first row with two
    amounts.  Every other row that names a metric gives its amounts too.
    """
    grids = df if "years" in df.columns else year_columns(df, base_year)
    grids = _context(grids.where(F.size("years") > 0), _columnar_opening())
    return _facts(_with_columnar(grids.withColumn("_path", F.lit("columnar")), F.col("rows")), keys, "_columnar")


def _columnar_opening() -> Column:
    return F.greatest(F.lit(3), F.col("header_row") + 1)


def _with_columnar(df: DataFrame, rows: Column) -> DataFrame:
    """Add ``_columnar``, the candidates of ``rows`` under the grid's years; each step reads the fields of the one before."""
    lines_ = F.filter(
        F.transform(rows, lambda r, i: F.struct(i.alias("row"), r.alias("cells"), row_text(r).alias("text"))),
        lambda x: (x["row"] != F.col("header_row")) & (x["text"] != ""),
    )
    df = settled(df.withColumn("_lines", lines_))

    def picked(cells: Column) -> Column:
        return F.transform("years", lambda y: F.struct(y["year"].alias("year"), cell_at(cells, y["col"]).alias("cell")))

    def amounts(cells: Column) -> Column:
        return F.transform(
            F.filter(picked(cells), lambda p: (p["cell"] != "") & lines.plain_amount(p["cell"])),
            lambda p: F.struct(p["year"].alias("year"), parse_ledger_number(p["cell"]).alias("amount")),
        )

    read = F.transform("_lines", lambda x: F.struct(
        x["row"].alias("row"), F.get(x["cells"], F.lit(0)).alias("first"), x["text"].alias("text"), labels.squeeze(x["text"]).alias("low"),
        amounts(x["cells"]).alias("amounts")))
    # A row without amounts gives nothing, so its words are not looked at.
    df = settled(df.withColumn("_lines", F.filter(read, lambda x: F.size(x["amounts"]) > 0)))
    df = df.withColumn("_lines", F.transform("_lines", lambda x: F.struct(
        x["row"].alias("row"), x["first"].alias("first"), x["text"].alias("text"), x["low"].alias("low"), x["amounts"].alias("amounts"),
        labels.is_revenue_row(x["text"]).alias("is_revenue"), labels.metric_from_squeezed(x["low"]).alias("named"),
        R.match_any(x["low"], ["comprehensive income", "exceptional"]).alias("banned"),
        F.filter(x["amounts"], lambda a: a["amount"] >= SMALLEST_VALID).alias("large"))))
    df = settled(df)

    def candidate(x: Column) -> Column:
        return (
            x["is_revenue"] & ~x["banned"] & ~x["low"].contains("%") & ~x["low"].contains("amount (k in crore)")
            & (F.size(x["large"]) >= 2)
        )

    def scored(x: Column) -> Column:
        score = labels.revenue_priority(x["text"]) * 10 - labels.revenue_boost(x["first"], x["text"])
        return F.struct(score.alias("score"), x["row"].alias("row"))

    best = F.array_min(F.transform(F.filter("_lines", candidate), scored))["row"]
    fallback = F.array_min(F.transform(F.filter("_lines", lambda x: F.size(x["large"]) >= 2), lambda x: x["row"]))
    df = df.withColumn("_revenue_row", F.coalesce(best, fallback))
    df = df.withColumn("_lines", F.transform("_lines", lambda x: F.struct(
        x["row"].alias("row"), x["amounts"].alias("amounts"), x["large"].alias("large"),
        F.when(~x["banned"] & ~x["is_revenue"], F.nullif(x["named"], F.lit("revenue"))).alias("other"))))
    df = settled(df)
    none = F.array().cast(f"array<{ITEM}>")

    def facts(x: Column) -> Column:
        revenue = F.transform(x["large"], lambda a: _item(F.lit("revenue"), a["year"], a["amount"], _by_level(CONFIDENCE["revenue"])))
        other = F.transform(
            F.filter(x["amounts"], lambda a: lines.large_enough(a["amount"], x["other"])),
            lambda a: _item(x["other"], a["year"], a["amount"], _by_level(CONFIDENCE["other"])))
        return F.concat(F.when(x["row"] == F.col("_revenue_row"), revenue).otherwise(none), F.when(x["other"].isNotNull(), other).otherwise(none))

    return df.withColumn("_columnar", _items(F.col("_lines"), facts)).drop("_lines", "_revenue_row")


# --- transposed tables: years down, metrics across ----------------------------------------------------


def transposed_header(df: DataFrame) -> DataFrame:
    """Add ``label_row``: the row that starts with Year, Period or FY, if the table runs one year per row.

    It needs four columns and two rows that start with a year; otherwise NULL.
    """

    def heads(row: Column) -> Column:
        first = labels.squeeze(cell_at(row, F.lit(0)))
        return first.isin("year", "period", "fy") | first.startswith("year ")

    at = F.array_position(F.transform("rows", heads), F.lit(True)).cast("int") - 1
    out = df.withColumn("_at", F.when(at >= 0, at))
    dated = F.size(
        F.filter(
            "rows",
            lambda r, i: (i != F.col("_at")) & cell_at(r, F.lit(0)).rlike(r"(?i)fy\s*(19|20)[0-9]{2}|^(19|20)[0-9]{2}$"),
        )
    )
    wide = F.size(F.get("rows", F.col("_at"))) >= 4
    return out.withColumn("label_row", F.when(F.col("_at").isNotNull() & wide & (dated >= 2), F.col("_at"))).drop("_at")


def transposed_facts(df: DataFrame, keys: Keys = ("company", "source_file")) -> DataFrame:
    """Candidates of tables with one year per row; of several revenue columns the best ranked one counts."""
    grids = df if "label_row" in df.columns else transposed_header(df)
    grids = _context(grids.where(F.col("label_row").isNotNull()), _transposed_opening())
    grids = grids.withColumns({"_path": F.lit("transposed"), "years_from": F.lit("header")})
    return _facts(_with_transposed(grids, F.col("rows")), keys, "_transposed")


def _transposed_opening() -> Column:
    return F.greatest(F.lit(3), F.col("label_row") + 1)


def _with_transposed(df: DataFrame, rows: Column) -> DataFrame:
    """Add ``_transposed``, the candidates of ``rows`` under the labels of the grid's label row."""
    cols = F.transform(
        F.get(rows, F.col("label_row")),
        lambda h, j: F.struct(
            j.alias("col"),
            F.trim(F.regexp_replace(h, r"\s+", " ")).alias("label"),
            labels.metric_from_row(h).alias("metric"),
        ),
    )
    cols = F.filter(
        cols,
        lambda c: (c["col"] > 0) & c["metric"].isNotNull() & ~F.lower(c["label"]).isin("", "%", "₹", "rs.", "rs"),
    )
    df = df.withColumn("_cols", cols)
    ranked = F.transform(
        F.filter("_cols", lambda c: c["metric"] == "revenue"),
        lambda c: F.struct(labels.revenue_priority(c["label"]).alias("rank"), c["col"].alias("col")),
    )
    df = df.withColumn("_revenue_col", F.array_min(ranked)["col"])
    df = settled(df)
    df = df.withColumn("_cols", F.filter("_cols", lambda c: (c["metric"] != "revenue") | (c["col"] == F.col("_revenue_col"))))
    dated = F.transform(rows, lambda r, i: F.struct(i.alias("row"), periods.period_of_fy_cell(cell_at(r, F.lit(0))).alias("period"), r.alias("cells")))
    df = settled(df.withColumn("_rows", F.filter(dated, lambda x: (x["row"] != F.col("label_row")) & periods.valid_year(x["period"]))))

    def cells(x: Column) -> Column:
        read = F.transform("_cols", lambda c: F.struct(c["metric"].alias("metric"), x["period"].alias("period"), cell_at(x["cells"], c["col"]).alias("cell")))
        return F.transform(read, lambda c: F.struct(c["metric"].alias("metric"), c["period"].alias("period"), c["cell"].alias("cell"), parse_ledger_number(c["cell"]).alias("amount")))

    df = settled(df.withColumn("_cells", F.flatten(F.transform("_rows", cells))))
    kept = F.filter("_cells", lambda c: lines.valid_amount(c["cell"], c["amount"], c["metric"]))

    def sure(c: Column) -> Column:
        return F.when(c["metric"] == "eps", CONFIDENCE["transposed_eps"]).otherwise(_by_level(CONFIDENCE["revenue"]))

    items = F.transform(kept, lambda c: _item(c["metric"], c["period"], c["amount"], sure(c)))
    return df.withColumn("_transposed", items.cast(f"array<{ITEM}>")).drop("_cols", "_revenue_col", "_rows", "_cells")


# --- one line per year ------------------------------------------------------------------------------


def _plain_row(row: Column) -> Column:
    return F.array_join(F.transform(row, lambda c: F.coalesce(c, F.lit(""))), " ")


def row_mode(rows: Column) -> Column:
    """True when a row speaks of FY or of one or two years."""

    def dated(text: Column) -> Column:
        many = F.size(F.regexp_extract_all(text, F.lit(r"\b(20[0-9]{2})\b"), F.lit(1))) >= 3
        return F.upper(text).contains("FY") | (~many & text.rlike("20[0-2][0-9]"))

    return F.exists(rows, lambda row: R.once(_plain_row(row), dated))


def _dated_line(text: Column) -> Column:
    """True when a line names a valid year."""
    return R.once(lines.line_year(text).cast("string"), periods.valid_year)


def _row_items(text: Column) -> Column:
    """Metric and amount of a dated line by how many amounts above 1000 it holds.

    Inside a loop over rows Spark works a repeated expression out again at every place, so each step is bound once.
    """

    def item(metric: str, amount: Column) -> Column:
        return F.struct(F.lit(metric).alias("metric"), amount.cast("double").alias("amount"))

    def by_position(large: Column) -> Column:
        n = F.size(large)

        def at(i: int) -> Column:
            return F.get(large, n + i) if i < 0 else F.get(large, F.lit(i))

        expenses = F.when(n == 3, at(1)).when(n == 4, at(-3)).when(n >= 5, at(-2))
        profit = (
            F.when((n == 2) & (at(1) != at(0)), at(1)).when(n == 3, at(2)).when(n == 4, at(-2)).when(n >= 5, at(-1))
        )
        items = F.array(item("revenue", at(0)), item("expenses", expenses), item("net_income", profit))
        return F.filter(items, lambda i: i["amount"].isNotNull())

    def of_line(line: Column) -> Column:
        large = R.once(lines.line_year(line).cast("bigint"), lambda year: F.filter(
            lines.line_integers(line), lambda n: (n != year) & (n > 1000)))
        return R.once(large, by_position)

    return R.once(text, of_line)


def row_facts(df: DataFrame, keys: Keys = ("company", "source_file")) -> DataFrame:
    """Candidates of tables whose rows are statement lines: year, revenue, expenses, profit by position."""
    grids = _context(df.where(row_mode(F.col("rows"))), _row_opening(F.col("rows")))
    grids = grids.withColumns({"_path": F.lit("row"), "years_from": F.lit("header")})
    return _facts(_with_lines(grids, F.col("rows")), keys, "_by_line")


def _row_opening(rows: Column) -> Column:
    """Unit and level stand above the first line with a year, or in it."""
    line = F.array_position(F.transform(rows, lambda r: _dated_line(_plain_row(r))), F.lit(True))
    return F.when(line > 0, line.cast("int")).otherwise(F.size(rows))


def _with_lines(df: DataFrame, rows: Column) -> DataFrame:
    """Add ``_by_line``, the candidates of ``rows`` as statement lines."""
    read = F.transform(F.transform(rows, _plain_row), lambda t: F.struct(t.alias("raw"), lines.line_year(t).cast("string").alias("period")))
    df = settled(df.withColumn("_read", F.filter(read, lambda x: periods.valid_year(x["period"]))))

    def items(x: Column) -> Column:
        return F.transform(_row_items(x["raw"]), lambda i: _item(i["metric"], x["period"], i["amount"], F.lit(CONFIDENCE["row"]), x["raw"]))

    return df.withColumn("_by_line", _items(F.col("_read"), items)).drop("_read")


# --- text lines -------------------------------------------------------------------------------------


def text_facts(df: DataFrame, keys: Keys = ("company", "source_file"), text: str = "text",
               max_words: int | None = None, near: int | None = None) -> DataFrame:
    """Largest amount per (keys, metric, year) that a text line states after a statement word.

    ``max_words`` leaves longer lines out, ``near`` asks for a digit within so many characters of the word.
    """
    clean = F.regexp_replace(text, r"\(cid:[0-9]+\)", " ")
    rows = df.select(*keys, F.explode(F.split(clean, r"\r\n|\r|\n")).alias("_line"))
    rows = rows.withColumn("_low", labels.squeeze("_line")).where(F.col("_low").rlike("[0-9]{3}"))
    rows = rows.where(~R.match_any(F.col("_low"), R.TEXT_NOISE))
    gap = ".*" if near is None else f".{{0,{near}}}"
    rows = rows.where(F.col("_low").rlike(f"(?:{'|'.join(R.TEXT_KEYWORDS)}){gap}[0-9]"))
    if max_words is not None:
        rows = rows.where(F.size(F.split("_low", " ")) <= max_words)
    years = F.transform(
        F.regexp_extract_all("_low", F.lit(r"\b(20[0-9]{2})\b"), F.lit(1)), lambda y: y.cast("int")
    )
    tokens = F.regexp_extract_all("_line", F.lit(r"([0-9,]{3,})"), F.lit(1))
    amounts = F.filter(
        F.transform(tokens, lambda t: F.regexp_replace(t, ",", "").try_cast("double")),
        lambda v: v.isNotNull() & ~v.between(1900, 2100) & (v >= SMALLEST_TEXT_VALUE),
    )
    found = {
        "metric": R.first_match(F.col("_low"), R.ROW_METRIC_RULES),
        "year": F.array_max(years),
        "value": F.array_max(amounts),
    }
    rows = rows_with(rows, list(keys), found, tuple(found))
    return rows.groupBy(*keys, "metric", "year").agg(F.max("value").alias("value"))


# --- which way each table is read ---------------------------------------------------------------------


def route_tables(df: DataFrame, keys: Keys = ("company", "source_file"), base_year: int | None = None) -> DataFrame:
    """The tables to read, each with its ``path``: transposed, columnar or row.

    A document's income statement goes the first way that fits.  A document without one gives its
    first table that reads as statement lines.  Tables that name no year are columnar only with a ``base_year``.
    """
    flagged = statement_flags(df)
    line_rows = F.exists(
        "rows", lambda r: R.once(_plain_row(r), lambda text: _dated_line(text) & (F.size(_row_items(text)) > 0))
    )
    by_rows = row_mode(F.col("rows")) & line_rows
    flagged = settled(flagged.withColumn("_by_rows", by_rows))
    usable = flagged.where(F.col("is_statement") | F.col("_by_rows"))
    order = F.struct((~F.col("is_statement")).cast("int").alias("other"), *[F.col(c) for c in TABLE])
    first = F.min_by(F.struct(*usable.columns), order).alias("_t")
    chosen = usable.groupBy(*keys).agg(first).select("_t.*")
    chosen = year_columns(transposed_header(chosen), base_year)
    statement = F.col("is_statement") & ~F.col("rejected")
    path = (
        F.when(~F.col("is_statement"), "row")
        .when(statement & F.col("label_row").isNotNull(), "transposed")
        .when(statement & (F.size("years") > 0), "columnar")
        .when(statement & F.col("_by_rows"), "row")
    )
    return chosen.withColumn("path", path).where(F.col("path").isNotNull()).drop("is_statement", "rejected", "_by_rows")


def routed_facts(routed: DataFrame, keys: Keys = ("company", "source_file")) -> DataFrame:
    """Candidates of tables that :func:`route_tables` chose, each read its own way, in one pass over the grids."""
    opening = F.when(F.col("path") == "transposed", _transposed_opening()).when(F.col("path") == "columnar", _columnar_opening()).otherwise(
        _row_opening(F.col("rows")))
    grids = _context(routed, opening).withColumn("_path", F.col("path"))

    def of(path: str) -> Column:
        # The rows where the grid goes this way, else none, so that no other reading looks at them.
        return F.when(F.col("path") == path, F.col("rows")).otherwise(F.array().cast("array<array<string>>"))

    grids = _with_lines(_with_transposed(_with_columnar(grids, of("columnar")), of("transposed")), of("row"))
    return _facts(grids.withColumn("_all", F.concat("_columnar", F.coalesce("_transposed", F.array().cast(f"array<{ITEM}>")), "_by_line")), keys, "_all")


def union_candidates(tables: DataFrame, texts: DataFrame | None = None, external: DataFrame | None = None,
                     keys: Keys = ("company", "source_file"), currency: str = "USD") -> DataFrame:
    """Candidates of all sources in one frame.

    ``external`` (keys, year, revenue) adds revenue above 1000 of valid years to documents whose tables give
    fewer than two revenue years or years less than two apart.  ``texts`` (keys, metric, year, value) only
    helps documents that have fewer than two revenue years otherwise.
    """

    def outside(df: DataFrame, amount: str, method: str, confidence: float) -> DataFrame:
        rows = df.where((F.col(amount) > 1000) & periods.valid_year("year"))
        rows = rows.select(
            *keys, F.lit("revenue").alias("metric"), F.col("year").cast("string").alias("period"),
            F.col(amount).cast("double").alias("amount"), F.lit("INR_CRORE").alias("unit_in"),
            F.lit("consolidated").alias("level"), F.lit(1).alias("page_number"),
        )
        return _candidates(rows, keys, F.lit(method), F.lit(True), F.lit(confidence), F.lit(currency), F.lit(""))

    if external is None and texts is None:
        return tables
    parts = [tables.withColumn("_source", F.lit("table"))]
    if external is not None:
        parts.append(outside(external, "revenue", "ai_extracted", 0.6).withColumn("_source", F.lit("external")))
    if texts is not None:
        rows = outside(texts.where(F.col("metric") == "revenue"), "value", "text_fallback", CONFIDENCE["text"])
        parts.append(rows.withColumn("_source", F.lit("text")))
    good = (F.col("metric") == "revenue") & F.col("is_valid") & periods.valid_year("period")

    def year(source: str) -> Column:
        return F.when(good & (F.col("_source") == source), F.col("period").try_cast("int"))

    # The years that each source gives a document, in one pass over all candidates.
    pool = with_totals(reduce(DataFrame.unionByName, parts), keys, {
        "_lo": F.min(year("table")), "_hi": F.max(year("table")), "_xlo": F.min(year("external")), "_xhi": F.max(year("external"))})
    weak = F.coalesce(F.col("_hi") - F.col("_lo") < 2, F.lit(True))
    lo = F.when(weak, F.least("_lo", "_xlo")).otherwise(F.col("_lo"))
    hi = F.when(weak, F.greatest("_hi", "_xhi")).otherwise(F.col("_hi"))
    single = F.coalesce(hi - lo < 1, F.lit(True))
    source = F.col("_source")
    kept = pool.where((source == "table") | ((source == "external") & weak) | ((source == "text") & single))
    return kept.select(*tables.columns)
