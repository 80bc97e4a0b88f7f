"""Extracted table grids, stored as JSON text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import ROWS_TYPE


def grids_to_json(df: DataFrame) -> DataFrame:
    """Grid rows as JSON text in ``raw_json``, with the time of writing when none is given."""
    out = df.withColumn("raw_json", F.to_json("rows")).drop("rows")
    if "created_at" not in out.columns:
        out = out.withColumn("created_at", F.current_timestamp())
    return out


def grids_from_json(df: DataFrame) -> DataFrame:
    return df.withColumn("rows", F.from_json("raw_json", ROWS_TYPE)).drop("raw_json")


def write_grids(df: DataFrame, path: str) -> None:
    """Append grids to the grid table."""
    grids_to_json(df).write.mode("append").parquet(path)


def read_grids(spark: SparkSession, path: str) -> DataFrame:
    return grids_from_json(spark.read.parquet(path))
