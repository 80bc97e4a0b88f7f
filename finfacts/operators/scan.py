"""Running totals and neighbours over one order of all rows, for frames without keys.

A window without keys is one task.  Here the rows are cut into blocks at labels that a bounded sample names; a window only sees
one block, every block adds one row of totals, and the totals of the blocks before it are added back to each row.  The cuts only
steer the work: results are the same whatever they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.numbers import ColumnOrName, as_col, exact_addends, exact_total
from ..functions.periods import fiscal_key
from .frames import Keys, fiscal_sort, timeline

#: Labels that the cuts are taken from, however many rows there are.
SAMPLE = 4096
#: Most blocks; their totals are the only rows that one task sees together.
MOST_BLOCKS = 1000


def _place(period: ColumnOrName) -> Column:
    """The fiscal order as one comparable value."""
    return F.struct(
        F.coalesce(fiscal_key(period), F.lit(2147483647)).alias("key"), as_col(period).cast("string").alias("label")
    )


def _cuts(df: DataFrame, period: str, sample: int) -> list[tuple[int, str | None]]:
    """Labels between blocks: evenly spaced ones of the labels with the smallest hashes.  Starts a job."""
    names = df.select(_place(period).alias("_p")).select("_p.*")
    found = names.orderBy(F.xxhash64("key", "label"), "key", "label").limit(sample).collect()
    ordered = sorted({(r["key"], r["label"]) for r in found}, key=lambda r: (r[0], r[1] is not None, r[1] or ""))
    blocks = min(MOST_BLOCKS, max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))), len(ordered) or 1)
    return [ordered[len(ordered) * i // blocks] for i in range(1, blocks)]


def in_blocks(df: DataFrame, period: str, sample: int = SAMPLE) -> DataFrame:
    """``df`` with ``_block``, a number that grows along the fiscal order; rows of one label share a block."""
    cuts = [
        F.struct(F.lit(k).alias("key"), F.lit(label).cast("string").alias("label")) for k, label in _cuts(df, period, sample)
    ]
    if not cuts:
        return df.withColumn("_block", F.lit(0))
    return df.withColumn("_place", _place(period)).withColumn(
        "_block", F.size(F.filter(F.array(*cuts), lambda c: c <= F.col("_place")))
    ).drop("_place")


def _with_block_rows(rows: DataFrame, blocks: DataFrame) -> DataFrame:
    """``rows`` beside the one row of their block."""
    return rows.join(blocks.withColumnRenamed("_block", "_own"), F.col("_block") == F.col("_own"), "left").drop("_own", "_block")


def with_running_total(df: DataFrame, col: ColumnOrName, name: str, keys: Keys = (), period: str = "period") -> DataFrame:
    """``df`` with the exact sum of ``col`` over its series up to each row in fiscal order."""
    upto = (W.unboundedPreceding, W.currentRow)
    parts = exact_addends(col)
    if keys:
        w = timeline(keys, period).rowsBetween(*upto)
        return df.withColumn(name, exact_total(*[F.sum(p).over(w) for p in parts]))
    names = [f"_part{i}" for i in range(len(parts))]
    rows = in_blocks(df.withColumns(dict(zip(names, parts, strict=True))), period)
    totals = rows.groupBy("_block").agg(*[F.sum(n).alias(n) for n in names])
    before = W.orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    carries = totals.select("_block", *[F.sum(n).over(before).alias(f"{n}_carry") for n in names])
    inside = W.partitionBy("_block").orderBy(*fiscal_sort(period)).rowsBetween(*upto)
    rows = rows.withColumns({n: F.sum(n).over(inside) for n in names})
    rows = _with_block_rows(rows, carries)

    def added(n: str) -> Column:
        own, carry = F.col(n), F.col(f"{n}_carry")
        return F.when(own.isNull(), carry).when(carry.isNull(), own).otherwise(own + carry)

    return rows.withColumn(name, exact_total(*[added(n) for n in names])).drop(*names, *[f"{n}_carry" for n in names])


def with_previous(df: DataFrame, columns: dict[str, str], keys: Keys = (), period: str = "period") -> DataFrame:
    """``df`` with values of the row before in fiscal order; ``columns`` maps new names to the columns they repeat."""
    if keys:
        w = timeline(keys, period)
        return df.withColumns({n: F.lag(c).over(w) for n, c in columns.items()})
    rows = in_blocks(df, period)
    inside = W.partitionBy("_block").orderBy(*fiscal_sort(period))
    last = F.max_by(F.struct(*[F.col(c).alias(n) for n, c in columns.items()]), _place(period)).alias("_last")
    ends = rows.groupBy("_block").agg(last)
    ends = ends.select("_block", F.lag("_last").over(W.orderBy("_block")).alias("_ahead"))
    rows = rows.withColumn("_first", F.row_number().over(inside) == 1).withColumns(
        {n: F.lag(c).over(inside) for n, c in columns.items()}
    )
    rows = _with_block_rows(rows, ends)
    return rows.withColumns(
        {n: F.when(F.col("_first"), F.col("_ahead")[n]).otherwise(F.col(n)) for n in columns}
    ).drop("_first", "_ahead")

