"""A corpus made ready for training: scored, deduplicated, mixed and packed, each stage on all that the one before kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from finfacts.llm.exact_dedup import drop_exact_duplicates
from finfacts.llm.jaccard import one_of_each_group
from finfacts.llm.mixing import mixed_documents
from finfacts.llm.packing import pack_documents
from finfacts.llm.quality import accepted_documents
from finfacts.llm.queries import vocabulary
from finfacts.llm.shared import documents, ship_package, table, written


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject.

    Null and empty texts are scored like others; rows that repeat a doc_id are scored each; labels of a null doc_id are not used. An
    empty table stays empty, and further columns stay as they are.
    """
    return accepted_documents(docs, table(spark, sf_dir, "labels"))


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text, the one of largest doc_id.

    Null counts as the empty text; of rows equal in doc_id and text one stays; a row without doc_id gives way to any other. An empty
    table stays empty, and further columns stay as they are.
    """
    ship_package(spark)
    return drop_exact_duplicates(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by shingles of five words at a similarity of 0.8, the one of smallest doc_id.

    Rows without words or without doc_id stay; texts that share a doc_id are told apart. An empty table stays empty, and further columns
    stay as they are.
    """
    ship_package(spark)
    return one_of_each_group(docs, k=5, percent=80)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's target takes them; a document taken twice is two rows.

    A null source is a source of its own; texts without words have size 0 and are taken as their source is; rows that repeat a doc_id
    share its copies. An empty table stays empty, and further columns stay as they are.
    """
    ship_package(spark)
    return mixed_documents(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their places in sequences of 2048 tokens.

    Null and empty texts are one closing token; very long texts are cut; rows that repeat a doc_id, or lack one, are packed each. An
    empty table gives no rows.
    """
    ship_package(spark)
    return pack_documents(docs, vocabulary(), end=0, capacity=2048)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality_stage),
    ("exact_duplicates", exact_stage),
    ("near_duplicates", near_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

#: The classifier and the packer are not SQL; tests hold run() against the stages' brute-force versions.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each one's result written as Parquet and read again by the next."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
