"""What the driver gets from a job comes as Arrow columns, not as a Python row each."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from finfacts.llm import jaccard
from finfacts.llm.shared import bitmap, ship_package


def test_sketch_and_bitmap_make_no_python_rows(spark, monkeypatch):
    ship_package(spark)
    docs = spark.createDataFrame([(i, f"one two three four five {i % 2} {i}") for i in range(40)], "doc_id long, text string")
    frame = type(docs)
    for name in ("toPandas", "collect"):
        monkeypatch.setattr(frame, name, lambda self, name=name: pytest.fail(f"{name} makes a Python row for each cell"))
    sketch = jaccard.frequency_sketch(docs, 4)
    repeated = np.concatenate(list(jaccard.shingle_sets(["one two three four five"], 4)))
    cells = (repeated >> np.uint64(64 - jaccard.SKETCH_BITS)).astype(np.int64)
    assert sketch.dtype == np.uint8 and (sketch[cells] == 5).all()  # 40 documents: 2 ** 5 at least
    bits = bitmap(spark.range(0, 1000, 7).select(F.col("id").alias("cell")), 1024)
    flags = np.unpackbits(bits.view(np.uint8), bitorder="little")
    assert np.flatnonzero(flags).tolist() == list(range(0, 1000, 7))
    assert not bitmap(spark.range(0).select(F.col("id").alias("cell")), 64).any()
