"""What the operators share: the folder for intermediate tables, ordered offsets and document words."""

from __future__ import annotations

import gc
import os
import shutil
import sys
import tempfile
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..stored import shared_dir, written  # noqa: F401

#: A word is a run of characters other than space and the five ASCII controls from tab to carriage return.
WORD = r"[^\x20\x09-\x0D]+"

#: Cells for each key, and at most, of a bitmap that parts rows.
CELLS_PER_KEY, MOST_CELLS = 32, 1 << 29


def ship_package(spark: SparkSession) -> None:
    """Sends this package to the executors, as --py-files does, once for each context."""
    context = spark.sparkContext
    if getattr(context, "_finfacts_shipped", False):
        return
    top = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    archive = shutil.make_archive(os.path.join(tempfile.mkdtemp(), "finfacts_package"), "zip", top, "finfacts")
    context.addPyFile(archive)
    context._finfacts_shipped = True


def give_token_memory_back() -> None:
    """Empties what a worker process remembers of earlier tokenizing; for tasks that hold much else."""
    tokens = sys.modules.get("finfacts.llm.tokens")
    if tokens is not None:
        tokens.word_ids.cache_clear()
        gc.collect()


def tasks_for(rows: int, rows_per_task: int) -> int:
    return max(1, -(-rows // rows_per_task))


def with_offsets(df: DataFrame, group: tuple[str, ...], order: tuple[Column, ...], measure: Column, name: str, label: str) -> DataFrame:
    """Adds name, the sum of measure over all rows of the group that come before in the given order.

    The rows are range-partitioned by group and order, so a group of any size spreads over many tasks; each task sums its own rows
    and only one total for each (task, group) is summed up across tasks. The table is written first, which fixes the ranges.
    """
    keys = [F.col(c) for c in group]
    ranged = written(
        df.withColumn("_measure", measure).repartitionByRange(*[k.asc_nulls_last() for k in keys], *order)
        .withColumn("_range", F.spark_partition_id()), label)
    totals = ranged.groupBy("_range", *group).agg(F.sum("_measure").alias("_total"))
    earlier = Window.partitionBy(*group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select("_range", *group, F.coalesce(F.sum("_total").over(earlier), F.lit(0)).alias("_base"))
    before = Window.partitionBy("_range", *group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    summed = ranged.withColumn("_before", F.coalesce(F.sum("_measure").over(before), F.lit(0)))
    return joined_null_safe(summed, bases, ("_range", *group), "left").withColumn(
        name, F.col("_before") + F.col("_base")).drop("_measure", "_range", "_before", "_base")


def joined_null_safe(left: DataFrame, right: DataFrame, keys: tuple[str, ...], how: str) -> DataFrame:
    """left joined to right on keys, where null equals null; the keys of right are dropped."""
    renamed = right.select(*[F.col(c).alias(f"_r_{c}") if c in keys else F.col(c) for c in right.columns])
    condition = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_r_{c}")) for c in keys])
    return left.join(renamed, condition, how).drop(*[f"_r_{c}" for c in keys])


def bitmap(cells: DataFrame, size: int) -> np.ndarray:
    """The distinct values of the column cell, 0 to size - 1, as bits of 64-bit words: size bits, however many rows there are.

    Words are put together before they leave Spark; the driver gets size / 64 rows at most.
    """
    words = cells.groupBy(F.expr("shiftright(cell, 6)").alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(cell & 63 as int)))").alias("bits"))
    # As Arrow columns, which take the driver no more than their bytes.
    found = words.toArrow()
    bits = np.zeros(size // 64 + 1, np.int64)
    bits[found["word"].to_numpy()] = found["bits"].to_numpy()
    return bits


def marked(bits: np.ndarray, cells: np.ndarray) -> np.ndarray:
    return (bits[cells >> 6] >> (cells & 63)) & 1 == 1


def free_name(df: DataFrame, name: str) -> str:
    """name, with more underscores in front where df has such a column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def split_by(docs: DataFrame, key: Column, listed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows of docs whose key is surely not in the one column of listed, and those whose key may be.

    A bitmap of the listed keys parts the rows where they are read, so the first ones, with all their text, need not move.
    """
    name = listed.columns[0]
    cells = min(MOST_CELLS, max(1024, CELLS_PER_KEY * listed.count()))
    bits = bitmap(listed.select(F.pmod(F.xxhash64(name), F.lit(cells)).alias("cell")), cells)
    filled = docs.sparkSession.sparkContext.broadcast(bits)
    flagged = docs.withColumn(free_name(docs, "_cell"), F.pmod(F.xxhash64(key), F.lit(cells)))

    def part(wanted: bool) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                hit = marked(filled.value, batch.column(batch.num_columns - 1).to_numpy())
                kept = batch.filter(pa.array(hit == wanted))
                yield pa.RecordBatch.from_arrays(kept.columns[:-1], names=kept.schema.names[:-1])

        return flagged.mapInArrow(run, docs.schema)

    return part(False), part(True)


def without_listed(docs: DataFrame, key: Column, listed: DataFrame) -> DataFrame:
    """The rows of docs whose key is not in the one column of listed; only rows that may be listed are shuffled."""
    name = listed.columns[0]
    clear, rest = split_by(docs, key, listed)
    own, other = free_name(docs, "_key"), free_name(docs, "_listed")
    checked = rest.withColumn(own, key).join(listed.withColumnRenamed(name, other), F.col(own) == F.col(other), "left_anti").drop(own)
    return clear.unionAll(checked)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
