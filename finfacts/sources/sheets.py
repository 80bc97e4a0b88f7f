"""CSV and JSON sheets, their typed cells, and the long ingest sheet."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.numbers import coerce_cell
from ..functions.rules import FINANCE_HEADER_WORDS


def unique_headers(headers: Sequence[str | None]) -> list[str]:
    """Trimmed headers; a blank one becomes ``Column_i``, the n-th repeat of a name gets ``_n``."""
    seen: dict[str, int] = {}
    out = []
    for i, header in enumerate(headers, start=1):
        name = (header or "").strip() or f"Column_{i}"
        seen[name] = seen.get(name, 0) + 1
        out.append(name if seen[name] == 1 else f"{name}_{seen[name]}")
    return out


def require_finance(headers: Sequence[str]) -> None:
    """Reject a sheet without one header that speaks of finance."""
    if not any(word in h.lower() for h in headers for word in FINANCE_HEADER_WORDS):
        raise ValueError("no column looks financial: " + ", ".join(headers))


def drop_empty_rows(df: DataFrame) -> DataFrame:
    """Rows in which at least one cell holds text."""
    filled = [F.trim(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))) != "" for c in df.columns]
    test = filled[0]
    for f in filled[1:]:
        test = test | f
    return df.where(test)


def read_csv_sheet(spark: SparkSession, path: str, headers: Sequence[str | None] | None = None) -> DataFrame:
    """A CSV sheet as text columns: short rows padded, cells beyond the header and empty rows dropped, names cleaned.

    The header is the first line of each file, of which the driver reads one; with ``headers`` no file has a header line.
    """
    first = headers
    if first is None:
        head = spark.read.option("mode", "PERMISSIVE").csv(path, header=False).limit(1).collect()
        if not head:
            raise ValueError(f"{path} is empty")
        first = list(head[0])
    names = unique_headers(first)
    require_finance(names)
    schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
    rows = spark.read.schema(schema).option("mode", "PERMISSIVE").option("enforceSchema", True).csv(path, header=headers is None)
    return drop_empty_rows(rows)


def read_json_sheet(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """A JSON sheet, one row for each object: a file is an array of objects, or with ``lines`` one object a line.

    A file that is an array is read by one task; lines are the form for large sheets.
    """
    rows = spark.read.option("multiLine", not lines).json(path)
    if not rows.columns or "_corrupt_record" in rows.columns:
        raise ValueError(f"{path} is not an array of objects")
    require_finance(rows.columns)
    return rows


def coerce_cells(df: DataFrame, cols: Sequence[str], suffix: str = "_num") -> DataFrame:
    """Add a double twin per column: the cell as a number once marks, commas and ``Rs.`` are gone, else NULL."""
    return df.withColumns({c + suffix: coerce_cell(F.col(f"`{c}`")) for c in cols})


def to_long_sheet(df: DataFrame, currency_hint: str | None = None, keep: Sequence[str] = ()) -> DataFrame:
    """Year, metric, value, raw and currency of extracted rows; unreadable numbers are 0."""
    return df.select(
        *keep,
        F.coalesce(F.col("year").try_cast("int"), F.lit(0)).alias("year"),
        F.coalesce(F.col("metric").cast("string"), F.lit("")).alias("metric"),
        F.coalesce(F.col("value").try_cast("double"), F.lit(0.0)).alias("value"),
        F.coalesce(F.col("raw").cast("string"), F.lit("")).alias("raw"),
        F.coalesce(F.col("currency"), F.lit(currency_hint), F.lit("")).alias("currency"),
    )
