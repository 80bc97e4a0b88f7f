"""Reading, writing and replacing on disk."""

import json

import pytest
from pyspark.sql import functions as F

from finfacts.schema import FACT_SCHEMA
from finfacts.sources import facts as SF
from finfacts.sources import grids as SG
from finfacts.sources import sheets as SS
from finfacts.sources import versions as SV
from finfacts.streaming import append_each_batch, commit_each_batch


def fact_rows(spark, rows):
    base = dict.fromkeys(FACT_SCHEMA.fieldNames())
    return spark.createDataFrame([{**base, **r} for r in rows], FACT_SCHEMA)


def stored(spark, path):
    rows = SF.read_facts(spark, path).select("company", "source_file", "metric", "value").collect()
    return sorted(tuple(r) for r in rows)


A1 = {"id": 1, "company": "a", "source_file": "x.pdf", "metric": "revenue", "period": "2020", "value": 1.0}
A2 = {"id": 2, "company": "a", "source_file": "y.pdf", "metric": "revenue", "period": "2020", "value": 2.0}
B1 = {"id": 3, "company": "b", "source_file": "x.pdf", "metric": "revenue", "period": "2020", "value": 3.0}


def test_replace_is_idempotent_and_leaves_other_sources(spark, tmp_path):
    path = str(tmp_path / "facts")
    SF.write_facts(fact_rows(spark, [A1, A2, B1]), path)
    fresh = fact_rows(spark, [{**A1, "value": 9.0}])
    for _ in range(2):
        SF.write_facts(fresh, path, files_per_source=2)
    assert stored(spark, path) == [("a", "x.pdf", "revenue", 9.0), ("a", "y.pdf", "revenue", 2.0), ("b", "x.pdf", "revenue", 3.0)]


def test_folders_of_a_store_are_bounded_and_every_source_is_replaced_alone(spark, tmp_path):
    path = str(tmp_path / "facts")
    many = [{**A1, "id": i, "company": f"c{i}", "value": float(i)} for i in range(300)] + [{**A1, "company": ""}, {**A1, "company": None}]
    SF.write_facts(fact_rows(spark, many), path)
    fresh = [{**A1, "id": i, "company": f"c{i}", "value": -1.0} for i in range(0, 300, 3)] + [{**A1, "company": None, "value": -1.0}]
    SF.write_facts(fact_rows(spark, fresh), path)
    assert len(list((tmp_path / "facts").glob("bucket=*"))) <= 64
    got = {r["company"]: r["value"] for r in SF.read_facts(spark, path).collect()}
    assert got == {f"c{i}": -1.0 if i % 3 == 0 else float(i) for i in range(300)} | {"": 1.0, None: -1.0}


def test_stream_keeps_every_part_of_the_latest_version(spark, tmp_path):
    source, path = str(tmp_path / "in"), str(tmp_path / "facts")
    parts = [([A1, B1], 1), ([{**A1, "value": 7.0}], 2), ([{**A1, "id": 9, "metric": "expenses", "value": 8.0}], 2)]
    for rows, version in parts:
        fact_rows(spark, rows).withColumn("version", F.lit(version)).coalesce(1).write.mode("append").parquet(source)
    schema = spark.read.parquet(source).schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
    query = (stream.writeStream.foreachBatch(append_each_batch(path)).option("checkpointLocation", str(tmp_path / "cp"))
             .trigger(availableNow=True).start())
    query.awaitTermination(120)
    rows = SF.latest_versions(spark.read.parquet(path)).select("company", "source_file", "metric", "value").collect()
    assert sorted(tuple(r) for r in rows) == [
        ("a", "x.pdf", "expenses", 8.0), ("a", "x.pdf", "revenue", 7.0), ("b", "x.pdf", "revenue", 3.0)]


def test_readers_follow_the_commit_log(spark, tmp_path):
    path = str(tmp_path / "log")

    def commit(rows, version, batch, parts=1):
        SV.commit_batch(fact_rows(spark, rows).withColumn("version", F.lit(version)), path, batch, parts)

    def read():
        return sorted((r["company"], r["metric"], r["value"]) for r in SV.read_committed(spark, path).where("source_file = 'x.pdf'").collect())

    commit([A1, B1, {**A1, "source_file": None}], 1, 0)
    assert read() == [("a", "revenue", 1.0), ("b", "revenue", 3.0)]
    commit([{**A1, "value": 7.0}], 2, 1, 2)
    assert read()[0] == ("a", "revenue", 1.0)  # half a version is not read
    # Data whose batch never got into the log do not exist either.
    fact_rows(spark, [{**B1, "value": 99.0}]).withColumns({"version": F.lit(9), "parts": F.lit(1)}).write.parquet(f"{path}/data/batch=77")
    for _ in range(2):
        commit([{**A1, "metric": "expenses", "value": 8.0}], 2, 2, 2)
    assert read() == [("a", "expenses", 8.0), ("a", "revenue", 7.0), ("b", "revenue", 3.0)]
    commit([{**A1, "value": 10.0}, {**B1, "value": 11.0}], 3, 3)
    assert read() == [("a", "revenue", 10.0), ("b", "revenue", 11.0)]
    plan = SV.read_committed(spark, path)._jdf.queryExecution().executedPlan().toString()
    # Live: batch 3, and batch 0 for the source without a name; no other folder is read.
    assert "batch#" in plan and "IN (0,3)" in plan.replace("IN (3,0)", "IN (0,3)")
    assert SV.read_committed(spark, path).where("source_file is null").count() == 1


def test_stream_commits_versions(spark, tmp_path):
    source, path = str(tmp_path / "in"), str(tmp_path / "log")
    for rows, version, parts in [([A1, B1], 1, 1), ([{**A1, "value": 7.0}], 2, 2), ([{**A1, "metric": "expenses", "value": 8.0}], 2, 2), ([{**B1, "value": 0.0}], 2, 2)]:
        fact_rows(spark, rows).withColumns({"version": F.lit(version), "pieces": F.lit(parts)}).coalesce(1).write.mode("append").parquet(source)
    schema = spark.read.parquet(source).schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
    (stream.writeStream.foreachBatch(commit_each_batch(path, "pieces")).option("checkpointLocation", str(tmp_path / "cp"))
     .trigger(availableNow=True).start().awaitTermination(120))
    rows = SV.read_committed(spark, path).select("company", "metric", "value").collect()
    assert sorted(tuple(r) for r in rows) == [("a", "expenses", 8.0), ("a", "revenue", 7.0), ("b", "revenue", 3.0)]


def test_null_sources_are_replaced(spark):
    old = fact_rows(spark, [{**A1, "source_file": None}, B1])
    new = fact_rows(spark, [{**A1, "source_file": None, "value": 5.0}])
    got = sorted((r["company"], r["value"]) for r in SF.replace_facts(old, new).collect())
    assert got == [("a", 5.0), ("b", 3.0)]


def test_csv_sheet(spark, tmp_path):
    file = tmp_path / "s.csv"
    file.write_text("Year,Sales,,Sales\n2020,\"1,200\",x,5\n,,,\n2021,7\n")
    df = SS.read_csv_sheet(spark, str(file))
    assert df.columns == ["Year", "Sales", "Column_3", "Sales_2"]
    rows = SS.coerce_cells(df, ["Sales"]).orderBy("Year").collect()
    assert [(r["Year"], r["Sales_num"], r["Sales_2"]) for r in rows] == [("2020", 1200.0, "5"), ("2021", 7.0, None)]
    other = tmp_path / "o.csv"
    other.write_text("colour,shape\nred,round\n")
    with pytest.raises(ValueError):
        SS.read_csv_sheet(spark, str(other))


def test_json_sheet(spark, tmp_path):
    file = tmp_path / "s.json"
    file.write_text(json.dumps([{"year": 2020, "revenue": 5}, {"year": 2021, "revenue": 6}]))
    assert SS.read_json_sheet(spark, str(file)).agg(F.sum("revenue")).first()[0] == 11


def test_grids_and_export(spark, tmp_path):
    grid = spark.createDataFrame([("a", "x.pdf", 1, 0, [["A", "B"], ["1", None]])],
                                 "company string, source_file string, page_number int, table_index int, rows array<array<string>>")
    SG.write_grids(grid, str(tmp_path / "g"))
    assert SG.read_grids(spark, str(tmp_path / "g")).first()["rows"] == [["A", "B"], ["1", None]]
    SF.export_csv(fact_rows(spark, [A1]).select("company", "value"), str(tmp_path / "e"))
    assert spark.read.csv(str(tmp_path / "e"), header=True).first()["value"] == "1.0"
