"""The long fact table: load, upgrade, replace, preview, export."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.frames import same_keys, with_keys, without_keys
from ..schema import FACT_DEFAULTS, FACT_SCHEMA

PARTITIONS = ("company", "source_file")


def read_facts(spark: SparkSession, path: str | None = None, jdbc: dict[str, str] | None = None,
               bounds: tuple[str, int, int, int] | None = None) -> DataFrame:
    """Facts from Parquet, or over JDBC with the options Spark takes (``url``, ``dbtable``, ...).

    ``bounds`` is (column, lower, upper, partitions) and splits a JDBC read over that many tasks.
    """
    if path is not None:
        return conform_facts(spark.read.schema(FACT_SCHEMA).parquet(path))
    if jdbc is None:
        raise ValueError("read_facts needs a path or jdbc options")
    reader = spark.read.format("jdbc").options(**jdbc)
    if bounds:
        column, lower, upper, parts = bounds
        reader = reader.options(
            partitionColumn=column, lowerBound=str(lower), upperBound=str(upper), numPartitions=str(parts)
        )
    return conform_facts(reader.load())


def conform_facts(df: DataFrame) -> DataFrame:
    """The fact columns in order and with their types; missing ones are NULL."""
    have = set(df.columns)
    return df.select(
        *[
            (F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in FACT_SCHEMA
        ]
    )


def upgrade_facts(df: DataFrame) -> DataFrame:
    """Facts of an older layout: missing columns added, gaps filled with the defaults."""
    gaps = ("unit", "level", "statement_type", "is_valid", "source_page", "extraction_method")
    out = conform_facts(df)
    return out.withColumns({c: F.coalesce(c, F.lit(FACT_DEFAULTS[c])) for c in gaps})


def replace_facts(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """``existing`` without the (company, source_file) pairs that ``incoming`` brings anew, plus ``incoming``."""
    pairs = incoming.select(*PARTITIONS).distinct()
    return without_keys(existing, pairs, PARTITIONS).unionByName(incoming, allowMissingColumns=True)


def _written_before(spark: SparkSession, path: str) -> DataFrame | None:
    """What a store of :func:`write_facts` holds, None where there is none yet."""
    try:
        return spark.read.option("mergeSchema", True).parquet(path)
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def write_facts(df: DataFrame, path: str, files_per_source: int = 1, buckets: int = 64) -> None:
    """Replace the stored facts of every (company, source_file) in ``df``; the others stay.

    Rows are filed by a bucket of their source, so the number of folders stays bounded however many sources there are.  The
    buckets that ``df`` has rows in are written anew, with what they hold of other sources, by dynamic partition overwrite:
    running it twice leaves the same table.  One job at a time may write a store, and a store keeps its number of buckets.
    Each of up to ``buckets * files_per_source`` tasks files its own rows, so that a large source is not written by a single task and
    rows are not shuffled.  What other sources have in these buckets is read only where there are any.
    """
    bucket = F.pmod(F.xxhash64(*PARTITIONS), F.lit(buckets)).cast("int")
    rows = df.withColumn("bucket", bucket)
    before = _written_before(df.sparkSession, path)
    if before is not None:
        touched = [r["bucket"] for r in rows.select("bucket").distinct().collect()]
        stored = before.where(F.col("bucket").isin(touched))
        stay = without_keys(stored.select(*PARTITIONS).distinct(), df.select(*PARTITIONS).distinct(), PARTITIONS)
        if not stay.isEmpty():
            stay, same = same_keys(stored, stay, PARTITIONS)
            rows = rows.unionByName(stored.join(stay, same, "left_semi"), allowMissingColumns=True)
    (
        rows.coalesce(buckets * files_per_source)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("bucket")
        .parquet(path)
    )


def append_versions(df: DataFrame, path: str, buckets: int = 64) -> None:
    """Add the rows of ``df``, which carry the ``version`` of their source, to the store; nothing is overwritten.

    Rows are filed by a bucket of the company, so the number of folders stays bounded.
    """
    bucket = F.pmod(F.xxhash64("company"), F.lit(buckets))
    df.withColumn("bucket", bucket).write.mode("append").partitionBy("bucket").parquet(path)


def latest_versions(stored: DataFrame) -> DataFrame:
    """The rows of the highest version of each (company, source_file), in whatever number of parts it arrived."""
    top = stored.groupBy(*PARTITIONS).agg(F.max("version").alias("_top"))
    joined = with_keys(stored, top, PARTITIONS, "inner")
    return joined.where(F.col("version") == F.col("_top")).drop("_top", "bucket")


def candidates_to_facts(df: DataFrame, company: str | Column, source_file: str | Column) -> DataFrame:
    """Chosen candidates as facts of a company and file; the raw text is dropped."""

    def fixed(v: str | Column) -> Column:
        return F.lit(v) if isinstance(v, str) else v

    return df.withColumns({"company": fixed(company), "source_file": fixed(source_file)}).drop("raw")


def preview_facts(df: DataFrame, currency: str, n: int, order: Sequence[str]) -> DataFrame:
    """The first ``n`` rows by the ``order`` columns as year, metric, whole value, raw and currency (the document's where missing)."""
    raw = F.coalesce(F.col("raw"), F.lit("")) if "raw" in df.columns else F.lit("")
    return (
        df.where(F.col("period").isNotNull() & F.col("value").isNotNull())
        .orderBy(*order)
        .limit(n)
        .select(
            F.trim("period").try_cast("int").alias("year"),
            "metric",
            F.col("value").cast("bigint").alias("value"),
            raw.alias("raw"),
            F.coalesce(F.nullif(F.col("currency"), F.lit("")), F.lit(currency)).alias("currency"),
        )
    )


def cap_rows(df: DataFrame, n: int, order: Sequence[str]) -> DataFrame:
    """Row cap of an interactive result: the first ``n`` rows by the ``order`` columns."""
    return df.orderBy(*order).limit(n)


def export_csv(df: DataFrame, path: str) -> None:
    """A result as CSV files with a header."""
    df.write.mode("overwrite").option("header", True).csv(path)
