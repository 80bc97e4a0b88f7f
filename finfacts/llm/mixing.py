"""Sources mixed to target weights by systematic sampling.

Each document of a source is expected target / source_size times. The expected copies are summed up within the source, one offset is
added, and a document is taken once for every whole number that the sum passes in its place. Documents are in order of size, so every
stretch of similar sizes is taken at the same rate and the words taken come near the target.
"""

from __future__ import annotations

from random import Random

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from finfacts.llm.shared import WORD, free_name, joined_null_safe, split_by, with_offsets, written

#: Weights of the sources in order, repeated.
WEIGHTS = (1, 2, 3)
#: A source gives at most so many times its size.
MOST_COPIES = 3
#: Seed of the random offset of the sampling, so that reruns agree.
SEED = 20


def word_count(text: Column) -> Column:
    return F.when(text.isNull(), F.lit(0)).otherwise(F.regexp_count(text, F.lit(WORD))).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_COPIES) -> DataFrame:
    """source, source_size, target of every source; sizes has a row for each document.

    Sources weigh by their place in order of code points, null last. A source that would get more than most times its size is held
    there and the rest shared again by weight: in order of what holds first, the held ones are a prefix.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    # One row for each source from here on; their order needs one task.
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(place, F.lit(len(weights))) + 1).cast("int"))
    limit = F.col("source_size").cast("double") * most
    held_first = Window.orderBy(F.col("limit") / F.col("weight"), F.col("source").asc_nulls_last())
    before = held_first.rowsBetween(Window.unboundedPreceding, -1)
    onwards = held_first.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.partitionBy()
    level = (F.sum("source_size").over(everything) - F.coalesce(F.sum("limit").over(before), F.lit(0.0))) / F.sum("weight").over(onwards)
    levelled = totals.withColumn("weight", weight).withColumn("limit", limit).withColumn("level", level)
    held = F.col("limit") <= F.col("level") * F.col("weight")
    # Levels fall from the first source that is not held on.
    free = F.max(F.when(~held, F.col("level"))).over(everything)
    return levelled.withColumn("share", free).select(
        "source", "source_size",
        F.coalesce(F.when(held, F.col("limit")).otherwise(F.col("share") * F.col("weight")), F.lit(0.0)).alias("target"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_COPIES, seed: int = SEED) -> DataFrame:
    """doc_id, size, source_size, target, taken and copies for every row of docs.

    A null or empty text has size 0; null is a source of its own, the last in order. Where all sizes of a source are 0 its target is 0 and
    nothing is taken. Rows with one doc_id are documents of their own, in order of size. An empty table gives no rows.
    """
    offset = Random(seed).random()
    sizes = written(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), word_count(F.col("text")).alias("size")), "sizes")
    targets = written(source_targets(sizes, weights, most), "targets")
    placed = with_offsets(sizes, ("source",), (F.col("size").asc(), F.col("doc_id").asc_nulls_first()), F.lit(1).cast("long"), "before", "ranked")
    expected = F.when(F.col("source_size") > 0, F.least(F.lit(float(most)), F.col("target") / F.col("source_size"))).otherwise(0.0)
    passed = F.floor((F.col("before") + 1) * F.col("expected") + offset) - F.floor(F.col("before") * F.col("expected") + offset)
    return joined_null_safe(placed, targets, ("source",), "left").withColumn("expected", expected).withColumn(
        "copies", F.least(F.lit(most), passed).cast("int")).select(
        "doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).cast("long").alias("taken"), "copies")


def mixed_documents(docs: DataFrame) -> DataFrame:
    """docs with each row as often as the mix takes it: left out, once, or up to MOST_COPIES times. All columns stay.

    Rows that repeat a doc_id share the copies of all of them, in order of a hash of their texts, the first ones one more where the copies
    do not divide. Only rows of documents that may have a copy move. An empty table gives no rows.
    """
    copies, rows, place, copy, own = (free_name(docs, n) for n in ("_copies", "_rows", "_place", "_copy", "_doc_id"))
    taken = written(mix(docs).groupBy(F.col("doc_id").alias(own)).agg(F.sum("copies").alias(copies), F.count(F.lit(1)).alias(rows)).where(F.col(copies) > 0), "taken")
    _, maybe = split_by(docs, F.col("doc_id").cast("long"), taken.select(own))
    single = maybe.join(taken, F.col("doc_id").cast("long").eqNullSafe(F.col(own))).drop(own)
    in_order = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.xxhash64("text"), "text"))
    repeated = single.where(F.col(rows) > 1).withColumn(place, in_order).withColumn(
        copies, F.floor(F.col(copies) / F.col(rows)) + F.when(F.col(place) <= F.col(copies) % F.col(rows), 1).otherwise(0)).drop(place)
    counted = single.where(F.col(rows) == 1).unionByName(repeated)
    return counted.where(F.col(copies) > 0).withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(copies).cast("int")))).drop(copies, rows, copy)


def oracle() -> str:
    """The same mix in SQL."""
    offset = f"{Random(SEED).random()!r}::DOUBLE"
    weights = ", ".join(f"{w}.0::DOUBLE" for w in WEIGHTS)
    return f"""
WITH d AS (SELECT doc_id, source, CASE WHEN text IS NULL THEN 0 ELSE len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) END AS size FROM documents),
t AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY 1),
w AS (SELECT *, [{weights}][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(WEIGHTS)}] AS weight, {MOST_COPIES}.0::DOUBLE * source_size AS cap FROM t),
l AS (SELECT *, ((SELECT sum(source_size) FROM t) - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
      / sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
g AS (SELECT source, source_size, coalesce(CASE WHEN cap <= level * weight THEN cap
      ELSE (SELECT max(level) FROM l WHERE cap > level * weight) * weight END, 0.0) AS target FROM l),
r AS (SELECT d.doc_id, d.size, g.source_size, g.target, row_number() OVER (PARTITION BY d.source ORDER BY d.size, d.doc_id) - 1 AS before,
      CASE WHEN g.source_size > 0 THEN least({MOST_COPIES}.0::DOUBLE, g.target / g.source_size) ELSE 0.0::DOUBLE END AS expected
      FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source),
c AS (SELECT *, CAST(least({MOST_COPIES}, floor((before + 1) * expected + {offset}) - floor(before * expected + {offset})) AS INTEGER) AS copies FROM r)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, CAST(target AS DOUBLE) AS target, CAST(copies * size AS BIGINT) AS taken, copies FROM c
"""
