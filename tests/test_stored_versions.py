"""Queries that store several versions work the facts out once; later versions come from the stored first one."""

import pytest

from catalog import storage

ROWS = [("A", "x.pdf", 1, 1.5), ("A", "x.pdf", 2, 2.0), ("A", "x.pdf", 2, 2.0), ("B", "x.pdf", 3, 7.0), ("D", None, 4, 1.0), ("E", "e.pdf", 6, None),
        ("G", "y.pdf", 5, 3.0), ("G", None, 8, 4.0), (None, "x.pdf", 7, 9.0)]


@pytest.mark.parametrize("name, module, step", [("latest_versions", storage.SF, "append_versions"), ("committed_versions", storage.SV, "commit_batch")])
def test_facts_are_worked_out_once(spark, tmp_path, monkeypatch, name, module, step):
    given = str(tmp_path / "given")
    spark.createDataFrame(ROWS, "company string, source_file string, id long, value double").write.parquet(given)
    monkeypatch.setattr(storage, "facts", lambda spark, sf: spark.read.parquet(given))
    read, write = [], getattr(module, step)

    def seen(df, *rest, **more):
        read.append(any("/given/" in f for f in df.inputFiles()))
        write(df, *rest, **more)

    monkeypatch.setattr(module, step, seen)
    found = sorted(map(tuple, getattr(storage, name)(spark, "").collect()), key=repr)
    assert found == sorted([(c, f, i, v if c is None or v is None or c > "F" else 2 * v) for c, f, i, v in ROWS], key=repr)
    assert read[0] and len(read) > 2 and not any(read[1:])
