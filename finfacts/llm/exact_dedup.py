"""Exact deduplication in two passes with a Bloom filter.

Pass one marks the cells that more than one document hits. Pass two looks every document up: one with a cell of its own is unique and
passes straight through; only the others are shuffled and grouped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from finfacts.llm.shared import bitmap, free_name, marked, split_by, tasks_for, without_listed, written

#: Cells of the filter for each document, and cells that a document hits.
CELLS_PER_DOC = 32
HITS = 2
#: Largest filter, in bits: 64 MB in every task. More documents are filtered slice by slice of the hash space, each with its own filter.
MOST_CELLS = 1 << 29


def signatures(docs: DataFrame, normalised: Column) -> DataFrame:
    """doc_id and text_sha256 of the normalised text in UTF-8; null counts as empty."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.sha2(F.coalesce(normalised, F.lit("")).cast("binary"), 256).alias("text_sha256"))


def _cell(k: int, cells: int) -> Column:
    return F.pmod(F.xxhash64("text_sha256", F.lit(k)), F.lit(cells))


def repeated_cells(rows: DataFrame, cells: int) -> np.ndarray:
    """A bitmap of the cells that two or more rows hit, cells bits long whatever the number of rows.

    Counts are summed where the rows are before anything moves.
    """
    hits = rows.select(F.explode(F.array_distinct(F.array(*[_cell(k, cells) for k in range(HITS)]))).alias("cell"))
    often = hits.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return bitmap(often, cells)


def possibly_repeated(rows: DataFrame, cells: int) -> DataFrame:
    """Adds maybe: false where some cell of the row is hit by no other row, so that no other row has its text."""
    filled = rows.sparkSession.sparkContext.broadcast(repeated_cells(rows, cells))

    def look_up(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bits = filled.value
        for frame in frames:
            maybe = np.ones(len(frame), bool)
            for k in range(HITS):
                maybe &= marked(bits, frame[f"c{k}"].to_numpy(np.int64))
            yield pd.DataFrame({"row_id": frame.row_id, "text_sha256": frame.text_sha256, "maybe": maybe})

    probe = rows.select("row_id", "text_sha256", *[_cell(k, cells).alias(f"c{k}") for k in range(HITS)])
    return probe.mapInPandas(look_up, "row_id struct<id:bigint>, text_sha256 string, maybe boolean")


def exact_duplicates(docs: DataFrame, normalised: Column | None = None, cells_per_doc: int = CELLS_PER_DOC, most_cells: int = MOST_CELLS) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row of docs.

    Texts are equal when their normalised forms (by default the text itself) are; null counts as empty. Of equal texts the largest doc_id
    stays. A null doc_id counts as smaller than any other, so keep_id is null only where all ids of the group are. Rows that repeat in
    doc_id and text are counted each and share one decision. An empty table gives no rows. Other columns of docs are not read.
    """
    table = written(signatures(docs, F.col("text") if normalised is None else normalised), "signatures")
    rows = table.count()
    slices = tasks_for(max(rows, 1) * cells_per_doc, most_cells)
    cells = min(most_cells, max(64, -(-rows * cells_per_doc // slices)))
    if slices > 1:
        table = written(table.withColumn("slice", F.pmod(F.xxhash64("text_sha256", F.lit(-1)), F.lit(slices))), "signature-slices", ("slice",))
    judged = None
    for k in range(slices):
        part = table.where(F.col("slice") == k).drop("slice") if slices > 1 else table
        part = _filtered(part, cells)
        judged = part if judged is None else judged.unionAll(part)
    return _groups(written(judged, "filtered"))


def _filtered(rows: DataFrame, cells: int) -> DataFrame:
    # A struct keeps a null id an integer on its way through pandas.
    boxed = rows.select(F.struct(F.col("doc_id").alias("id")).alias("row_id"), "text_sha256")
    return possibly_repeated(boxed, cells).select(F.col("row_id.id").alias("doc_id"), "text_sha256", "maybe")


def _groups(judged: DataFrame) -> DataFrame:
    unique = judged.where("not maybe").select(
        "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "text_sha256")
    maybe = judged.where("maybe")
    # A large group is a skewed key of the join. The sizes are written first, as adaptive execution splits a skewed key only where
    # both sides of a join come straight from a shuffle.
    sizes = written(maybe.groupBy("text_sha256").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")), "group-sizes")
    grouped = maybe.join(sizes, "text_sha256").select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")
    return unique.unionAll(grouped)


def drop_exact_duplicates(docs: DataFrame) -> DataFrame:
    """docs with one row of each text, the largest doc_id; rows that repeat that doc_id are cut to one. All columns stay."""
    key = F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256))
    judged = written(exact_duplicates(docs), "judged").withColumn("key", F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), "text_sha256"))
    single = without_listed(docs, key, judged.where("not kept").select("key").distinct())
    repeats = written(judged.where("kept and group_size > 1").groupBy("key").count().where("count > 1").select("key"), "repeats")
    if not repeats.head(1):
        return single
    once, more = split_by(single, key, repeats)
    own = free_name(docs, "_key")
    return once.unionAll(more.withColumn(own, key).dropDuplicates([own]).drop(own))


#: The same groups in SQL.
ORACLE = """
WITH d AS (SELECT doc_id, sha256(coalesce(text, '')) AS text_sha256 FROM documents),
g AS (SELECT text_sha256, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY 1)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, d.text_sha256
FROM d JOIN g ON d.text_sha256 = g.text_sha256
"""
