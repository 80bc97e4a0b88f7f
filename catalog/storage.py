"""Queries that write tables and sheets to storage and read them back."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from finfacts.operators.documents import explode_grid
from finfacts.operators.frames import with_keys
from finfacts.sources import facts as SF
from finfacts.sources import grids as SG
from finfacts.sources import sheets as SS
from finfacts.sources import versions as SV
from finfacts.stored import written

from . import fixtures as fx
from .facts import FACT_COLS, facts
from .registry import query


def folder(spark: SparkSession, name: str) -> str:
    """A new folder under the one that driver and executors share; a local session may do without a setting."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        own = tempfile.mkdtemp(prefix="finfacts-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        root = f"file://{own}"
    return f"{root}/finfacts-{name}-{uuid.uuid4().hex}"


@query("s1_read_stored_facts", fx.with_views("facts", f"SELECT {FACT_COLS} FROM fx_facts"))
def read_stored_facts(spark, sf):
    path = folder(spark, "facts")
    SF.write_facts(SF.conform_facts(facts(spark, sf)), path)
    return SF.conform_facts(SF.read_facts(spark, path))


@query(
    "s6_write_facts_twice",
    fx.with_views(
        "facts",
        "SELECT company, source_file, id, CASE WHEN company < 'F' THEN value * 2 ELSE value END AS value FROM fx_facts",
    ),
)
def write_facts_twice(spark, sf):
    path = folder(spark, "replaced")
    rows = written(SF.conform_facts(facts(spark, sf)), "rows")
    SF.write_facts(rows, path)
    fresh = rows.where("company < 'F'").withColumn("value", F.col("value") * 2)
    for _ in range(2):
        SF.write_facts(fresh, path, files_per_source=2)
    return SF.read_facts(spark, path).select("company", "source_file", "id", "value")


@query(
    "s6_latest_versions",
    fx.with_views(
        "facts",
        "SELECT company, source_file, id, CASE WHEN company < 'F' THEN value * 2 ELSE value END AS value FROM fx_facts",
    ),
)
def latest_versions(spark, sf):
    path = folder(spark, "versions")
    rows = SF.conform_facts(facts(spark, sf))
    SF.append_versions(rows.withColumn("version", F.lit(1)), path)
    # The second version comes from the stored first one, so the facts are worked out once.
    first = spark.read.parquet(path).where("version = 1").drop("bucket")
    fresh = first.where("company < 'F'").withColumns({"value": F.col("value") * 2, "version": F.lit(2)})
    for part in range(2):  # a version that arrives in two parts
        SF.append_versions(fresh.where(F.col("id") % 2 == part), path)
    return SF.latest_versions(spark.read.parquet(path)).select("company", "source_file", "id", "value")


@query(
    "s6_committed_versions",
    fx.with_views(
        "facts",
        "SELECT company, source_file, id, CASE WHEN company < 'F' THEN value * 2 ELSE value END AS value FROM fx_facts",
    ),
)
def committed_versions(spark, sf):
    """A first version, a second one in two batches of which one is retried, and half of a third."""
    path = folder(spark, "committed")
    rows = SF.conform_facts(facts(spark, sf))
    SV.commit_batch(rows.withColumn("version", F.lit(1)), path, 0)
    # Later versions come from the stored first one, so the facts are worked out once.
    rows = spark.read.parquet(f"{path}/data/batch=0").drop("version", "parts")
    fresh = rows.where("company < 'F'").withColumns({"value": F.col("value") * 2, "version": F.lit(2)})
    # A company whose lines are all even or all odd has its second version in one batch.
    sides = fresh.groupBy("company", "source_file").agg(F.count_distinct(F.col("id") % 2).alias("sides"))
    fresh = written(with_keys(fresh, sides, ("company", "source_file")), "fresh")
    for batch, side in ((1, 0), (2, 1), (1, 0)):
        SV.commit_batch(fresh.where(F.col("id") % 2 == side), path, batch, "sides")
    SV.commit_batch(rows.where("company < 'C'").withColumns({"value": F.lit(0.0), "version": F.lit(3)}), path, 3, parts=2)
    return SV.read_committed(spark, path).select("company", "source_file", "id", "value")


@query(
    "s7_stored_grids",
    fx.with_views("cells", "SELECT company, source_file, page_number, table_index, row, col, cell FROM fx_cells"),
)
def stored_grids(spark, sf):
    path = folder(spark, "grids")
    SG.write_grids(fx.grids(spark, sf), path)
    return explode_grid(SG.read_grids(spark, path), ("company", "source_file"))


# Rows of a sheet: every tenth is short, every tenth has cells too many, every tenth is followed by a blank row.
SHEET_ROW = "coalesce(nullif(trim(region), ''), '-')"


@query(
    "s2_read_csv_sheet",
    fx.with_views(
        "sales",
        f"SELECT CAST(seq AS VARCHAR) AS \"Seq\", {SHEET_ROW} AS \"Region\", CASE WHEN seq % 10 = 0 THEN '' ELSE "
        "CAST(year AS VARCHAR) END AS \"Sales Year\", CASE WHEN seq % 10 = 0 THEN '' ELSE 'x' END AS \"Column_4\" FROM fx_sales",
    ),
)
def read_csv_sheet(spark, sf):
    path = folder(spark, "sheet")
    rows = fx.sales(spark, sf).select("seq", F.expr(SHEET_ROW).alias("region"), F.col("year").cast("string").alias("year"))
    quoted = F.concat(F.lit('"'), F.regexp_replace("region", '"', '""'), F.lit('"'))
    line = F.when(F.col("seq") % 10 == 0, F.concat_ws(",", "seq", quoted)).otherwise(F.concat_ws(",", "seq", quoted, "year", F.lit("x")))
    line = F.when(F.col("seq") % 10 == 1, F.concat(line, F.lit(",more,cells"))).otherwise(line)
    lines = F.when(F.col("seq") % 10 == 2, F.array(line, F.lit(",,,"), F.lit(""))).otherwise(F.array(line))
    rows.select(F.explode(lines).alias("value")).write.text(path)
    read = SS.read_csv_sheet(spark, path, headers=["Seq", "Region", " Sales Year", ""])
    return read.select(*[F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(c) for c in read.columns])


@query(
    "s3_read_json_sheet",
    fx.with_views("sales", f"SELECT seq, {SHEET_ROW} AS region, CAST(year AS VARCHAR) AS sales_year FROM fx_sales"),
)
def read_json_sheet(spark, sf):
    path = folder(spark, "json")
    fx.sales(spark, sf).select("seq", F.expr(SHEET_ROW).alias("region"), F.col("year").cast("string").alias("sales_year")).write.json(path)
    read = SS.read_json_sheet(spark, path, lines=True)
    return read.select(F.col("seq").cast("long").alias("seq"), "region", "sales_year")


@query("s9_export_csv", fx.with_views("facts", "SELECT CAST(id AS VARCHAR) AS id, company, metric, period FROM fx_facts WHERE period IS NOT NULL"))
def export_csv(spark, sf):
    path = folder(spark, "export")
    SF.export_csv(facts(spark, sf).where("period IS NOT NULL").select("id", "company", "metric", "period"), path)
    return spark.read.csv(path, header=True).select("id", "company", "metric", "period")
