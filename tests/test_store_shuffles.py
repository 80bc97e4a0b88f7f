"""Stores are written and read without moving rows that nobody has to compare."""

from pyspark.sql import functions as F

from finfacts.schema import FACT_SCHEMA
from finfacts.sources import facts as SF
from finfacts.sources import versions as SV


def rows(spark, *found):
    base = dict.fromkeys(FACT_SCHEMA.fieldNames())
    return spark.createDataFrame([{**base, "company": c, "source_file": f, "id": i, "value": v} for c, f, i, v in found], FACT_SCHEMA)


def read(df):
    return sorted((tuple(r) for r in df.select("company", "source_file", "id", "value").collect()), key=repr)


def test_a_store_is_written_without_a_shuffle_of_rows(spark, tmp_path, monkeypatch):
    path, seen, write = str(tmp_path / "facts"), [], SF.F.xxhash64
    monkeypatch.setattr(SF.F, "xxhash64", lambda *c: seen.append(c) or write(*c))
    first = [("a", "x", 1, 1.0), ("a", "x", 1, 1.0), ("a", None, 2, 2.0), (None, "x", 3, 3.0), ("b", "x", 4, 4.0)]
    SF.write_facts(rows(spark, *first), path)
    for _ in range(2):
        SF.write_facts(rows(spark, ("a", "x", 5, 9.0), (None, "x", 6, 8.0)), path, files_per_source=3, buckets=64)
    assert read(SF.read_facts(spark, path)) == sorted([("a", "x", 5, 9.0), (None, "x", 6, 8.0), ("a", None, 2, 2.0), ("b", "x", 4, 4.0)], key=repr)
    # Only buckets are hashed; rows are not dealt out by their fields.
    assert set(seen) == {("company", "source_file")}


def test_whole_batches_are_read_without_a_join(spark, tmp_path):
    path = str(tmp_path / "log")

    def commit(batch, version, *found, parts=1):
        SV.commit_batch(rows(spark, *found).withColumn("version", F.lit(version)), path, batch, parts)

    commit(0, 1, ("a", "x", 1, 1.0), (None, "x", 2, 2.0), (None, "x", 2, 2.0))
    df = SV.read_committed(spark, path)
    assert "Join" not in df._jdf.queryExecution().executedPlan().toString()
    assert read(df) == [("a", "x", 1, 1.0), (None, "x", 2, 2.0), (None, "x", 2, 2.0)]
    commit(1, 2, (None, "x", 3, 7.0))
    # Rows that a retry left without an entry do not exist.
    rows(spark, ("a", "x", 1, 1.0), ("z", "x", 9, 9.0)).withColumns({"version": F.lit(1), "parts": F.lit(1)}).write.mode("append").parquet(f"{path}/data/batch=0")
    assert read(SV.read_committed(spark, path)) == [("a", "x", 1, 1.0), ("a", "x", 1, 1.0), (None, "x", 3, 7.0)]
