"""Exact order statistics that never sort one key in one task.

A key may own most of the rows.  Values at given ranks come from histograms that are refined around
the ranks (:func:`order_statistics`).  Ranks of all values (:func:`ranked`) are counted inside
buckets between approximate percentiles; the cut points only steer the work, the ranks are exact
whatever they are.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.numbers import js_round
from .frames import Keys, keyed, with_keys, with_totals

#: Least number of buckets; a session with more shuffle tasks has more buckets.
CUTS = 64


def ranked(df: DataFrame, keys: Keys, value: str) -> DataFrame:
    """Distinct values per key with the 0-based index range ``lo..hi`` they fill and the key's row count ``n``."""
    rows = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).alias("_v"))
    counts = rows.groupBy(*keys, "_v").agg(F.count(F.lit(1)).alias("_c"))
    buckets = max(CUTS, 2 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    points = F.array(*[F.lit(i / buckets) for i in range(1, buckets)])
    cut = with_totals(counts, keys, {"_cuts": F.percentile_approx("_v", points, 10 * buckets)}).withColumn(
        "_bucket", F.size(F.filter("_cuts", lambda c: c < F.col("_v")))
    ).drop("_cuts")
    sizes = cut.groupBy(*keys, "_bucket").agg(F.sum("_c").alias("_size"))
    # One row per key and bucket, however many rows a key has.
    over_buckets = keyed(keys).orderBy("_bucket")
    sizes = sizes.select(
        *keys,
        "_bucket",
        (F.sum("_size").over(over_buckets) - F.col("_size")).alias("_before"),
        F.sum("_size").over(keyed(keys)).alias("n"),
    )
    inside = W.partitionBy(*keys, "_bucket").orderBy("_v")
    out = with_keys(cut, sizes, [*keys, "_bucket"], "inner").withColumn(
        "hi", F.col("_before") + F.sum("_c").over(inside) - 1
    )
    return out.select(*keys, F.col("_v").alias("value"), (F.col("hi") - F.col("_c") + 1).alias("lo"), "hi", "n")


#: Pieces a bucket is cut into in one round, and the buckets of the first round for each doubling of the value.
PIECES = 1 << 16
PER_DOUBLING = 1 << 10


def _rounds(kind: T.DataType) -> int:
    """Rounds after which a bucket holds one value: the first tells 10 bits apart, every other one 16."""
    bits = {T.FloatType: 24, T.DoubleType: 53, T.ByteType: 7, T.ShortType: 15, T.IntegerType: 31, T.LongType: 63}
    width = math.ceil(kind.precision * math.log2(10)) if isinstance(kind, T.DecimalType) else bits[type(kind)]
    return max(0, math.ceil((width - 6) / 16))


def _first_digit(value: Column) -> Column:
    """Bucket of a value, never falling as the value grows: its sign and its logarithm.  Infinities and NaN have buckets of their own."""
    x = value.cast("double")
    size = F.floor(F.log2(F.abs(x)) * PER_DOUBLING) + 1200 * PER_DOUBLING
    far = F.lit(4096 * PER_DOUBLING).cast("long")
    return (
        F.when(F.isnan(x), far * 2)
        .when(x == float("inf"), far)
        .when(x == float("-inf"), -far)
        .when(x == 0.0, F.lit(0).cast("long"))
        .otherwise(F.signum(x).cast("long") * size)
    )


def _gap(kind: T.DataType, high: Column, low: Column) -> Column:
    """``high - low`` as a double; whole numbers are taken apart as decimals, which hold any difference of two."""
    if isinstance(kind, T.IntegralType):
        high, low = high.cast("decimal(20,0)"), low.cast("decimal(20,0)")
    return (high - low).cast("double")


def _beside(df: DataFrame, keys: Keys, marks: DataFrame) -> DataFrame:
    """``df`` with the column ``_marks`` of a frame of one row per key; without keys it is a scalar subquery."""
    if keys:
        return with_keys(df, marks, keys, "inner")
    return df.withColumn("_marks", marks.select("_marks").scalar())


def order_statistics(df: DataFrame, keys: Keys, value: str, ranks: dict[str, Callable[[Column], Column]]) -> DataFrame:
    """Values at given ranks per key, exact, one column per rank.

    ``ranks`` maps a name to the 0-based rank as a function of the key's row count.  Every round is one partial aggregate:
    how many rows fall in each piece of the bucket that holds a rank, and the smallest and largest value there.  The first
    round cuts by logarithm, the others cut the bucket evenly, until it holds one value only.  Rows are neither sorted nor
    grouped by value, so what is shuffled is as large as the histograms, however many rows a key has.  NULL values do not
    count, NULL keys are keys, NaN is the largest value; a rank outside the key's rows gives NULL.
    """
    kind = df.schema[value].dataType
    rows = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).alias("_v"))
    sizes = [F.count(F.lit(1)).alias("_c"), F.min("_v").alias("_least"), F.max("_v").alias("_most")]
    pieces = rows.groupBy(*keys, _first_digit(F.col("_v")).alias("_piece")).agg(*sizes)
    # One row per key and piece of the histogram, however many rows a key has.
    n = F.sum("_c").over(keyed(keys))
    pieces = pieces.withColumn("_before", F.sum("_c").over(keyed(keys).orderBy("_piece")) - F.col("_c")).withColumn("_n", n)
    wanted = F.array(*[F.struct(F.lit(name).alias("_stat"), rank(F.col("_n")).cast("long").alias("_rank")) for name, rank in ranks.items()])
    found = pieces.select("*", F.inline(wanted))
    at = [*keys, "_stat"]
    for _ in range(_rounds(kind)):
        marks = _located(found).groupBy(*keys).agg(F.collect_list(F.struct("_stat", "_rank", "_low", "_high")).alias("_marks"))
        inside = F.filter("_marks", lambda m: F.col("_v").between(m["_low"], m["_high"]))
        near = _beside(rows, keys, marks).select(*keys, "_v", F.inline(inside))
        share = _gap(kind, F.col("_v"), F.col("_low")) / _gap(kind, F.col("_high"), F.col("_low"))
        piece = F.when(F.col("_low") < F.col("_high"), F.floor(share * PIECES)).otherwise(0).alias("_piece")
        pieces = near.groupBy(*at, "_rank", piece).agg(*sizes)
        found = pieces.withColumn("_before", F.sum("_c").over(W.partitionBy(*at).orderBy("_piece")) - F.col("_c"))
    last = _located(found)
    return last.groupBy(*keys).agg(*[F.max(F.when(F.col("_stat") == name, F.col("_low"))).alias(name) for name in ranks])


def _located(found: DataFrame) -> DataFrame:
    """The piece that holds each rank, its bounds, and the rank inside it."""
    held = found.where(F.col("_rank").between(F.col("_before"), F.col("_before") + F.col("_c") - 1))
    return held.withColumns({"_rank": F.col("_rank") - F.col("_before"), "_low": F.col("_least"), "_high": F.col("_most")})


def index_quartiles(df: DataFrame, keys: Keys, value: str) -> DataFrame:
    """Minimum, quartiles by index ``floor(n * q)``, maximum and interquartile range per key."""
    out = order_statistics(df, keys, value, {
        "min_value": lambda n: F.lit(0),
        "q1": lambda n: F.floor(n * 0.25),
        "q2": lambda n: F.floor(n * 0.5),
        "q3": lambda n: F.floor(n * 0.75),
        "max_value": lambda n: n - 1,
    })
    return out.withColumn("iqr", F.col("q3") - F.col("q1"))


def median(df: DataFrame, keys: Keys, value: str) -> DataFrame:
    """Exact median per key: the middle value, or the mean of the middle two."""
    out = order_statistics(df, keys, value, {
        "_lower": lambda n: F.floor((n - 1) / 2), "_upper": lambda n: F.floor(n / 2),
    })
    return out.select(*keys, ((F.col("_lower") + F.col("_upper")) / 2).alias("median"))


def median_of_groups(groups: DataFrame, keys: Keys = (), value: str = "value1") -> DataFrame:
    """Median of group values, the mean of two middle ones rounded to a whole number."""
    return median(groups, keys, value).withColumn("median", js_round("median"))
