"""A store of source versions with a commit log.

Every batch has a folder of its own under ``data`` and, once that is whole, one entry per (source, version) under ``commits``.
Readers take from the log which batches make the newest whole version of each source and read only those folders, so neither
older versions nor folders of batches that never committed are scanned.  Writing a batch again replaces it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.frames import same_keys, without_keys
from .facts import PARTITIONS

#: The log's columns: how many batches the version is made of, and which batch this is.
COMMITS = "company string, source_file string, version int, parts int, batch long"


def commit_batch(df: DataFrame, path: str, batch: int, parts: int | str = 1) -> None:
    """Store the rows of ``df``, which carry the ``version`` of their source, as batch ``batch`` and enter it in the log.

    ``parts`` is the number of batches that make a version, or the column that holds it; a version counts once they are all in.
    Data come first and the entry last, so a batch that dies in between does not exist for readers; a retry replaces both.
    """
    number = F.col(parts) if isinstance(parts, str) else F.lit(parts)
    rows = df.withColumns({"version": F.col("version").cast("int"), "parts": number.cast("int")})
    rows.write.mode("overwrite").parquet(f"{path}/data/batch={int(batch)}")
    stored = df.sparkSession.read.schema(rows.schema).parquet(f"{path}/data/batch={int(batch)}")
    entries = stored.groupBy(*PARTITIONS, "version").agg(F.max("parts").alias("parts"))
    entries.write.mode("overwrite").parquet(f"{path}/commits/batch={int(batch)}")


def committed(spark: SparkSession, path: str) -> DataFrame:
    """The log: one row per (source, version, batch)."""
    return spark.read.schema(COMMITS).parquet(f"{path}/commits")


def live_batches(log: DataFrame) -> DataFrame:
    """The entries of the newest whole version of each source."""
    key = [*PARTITIONS, "version"]
    whole = log.groupBy(*key).agg(F.count_distinct("batch").alias("_have"), F.max("parts").alias("_parts")).where("_have >= _parts")
    top = whole.groupBy(*PARTITIONS).agg(F.max("version").alias("version"))
    other, same = same_keys(log, top, key)
    return log.join(other, same, "left_semi")


def read_committed(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """The rows of the newest whole version of each source; ``batch`` says where a row came from.

    Batches without live entries are left out by their folder; the query starts Spark jobs that look for these and for mixed ones.
    """
    live = live_batches(committed(spark, path)).select(*PARTITIONS, "version", "batch").distinct()
    reader = spark.read.schema(f"{schema}, batch long") if schema else spark.read
    data = reader.parquet(f"{path}/data")
    folders = [r["batch"] for r in live.select("batch").distinct().collect()]
    data = data.where(F.col("batch").isin(folders)) if folders else data.limit(0)
    key = [*PARTITIONS, "version", "batch"]
    # Only batches that also hold rows without a live entry are gone through row by row.
    dead = without_keys(data.select(*key).distinct(), live, key).select("batch").distinct()
    mixed = [r["batch"] for r in dead.collect()]
    if not mixed:
        return data.drop("parts")
    whole, part = data.where(~F.col("batch").isin(mixed)), data.where(F.col("batch").isin(mixed))
    other, same = same_keys(part, live, key)
    return whole.unionByName(part.join(other, same, "left_semi")).drop("parts")
