"""Answers: a metric's checked series out of facts, and facts out of two readings of scanned pages."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import tokens as T
from ..operators.aggregate import dedup_rows, last_per_period
from ..operators.filters import period_contains_years, valid_facts
from ..operators.frames import Keys, with_keys
from ..operators.ordering import chart_order
from ..operators.series import check_series


def answer_series(df: DataFrame, metrics: Sequence[str], keys: Keys = ("company",), years: tuple[int, int] | None = None,
                  order_col: str = "id", ordered: bool = True) -> DataFrame:
    """The series a question on a metric is answered with: period, value and the reasons that make a value implausible.

    Valid facts of the metric, within the years, the last one of each period by ``order_col``; NULL where nothing is wrong.
    """
    rows = valid_facts(df).where(F.col("metric").isin(*metrics) & F.col("value").isNotNull()).select(*keys, "period", order_col, "value")
    if years:
        rows = period_contains_years(rows, *years)
    last = last_per_period(rows, order_col, keys, ordered=False)
    reasons = check_series(last, "value", keys).groupBy(*keys, "period").agg(
        F.array_join(F.array_sort(F.collect_set("violation")), ", ").alias("problems"))
    out = with_keys(last, reasons, (*keys, "period")).select(*keys, "period", "value", "problems")
    return chart_order(out, keys) if ordered else out


def image_facts(tokens: DataFrame, doc: Keys = ("doc_id",), page: Keys = ("doc_id", "page"), method: str = "method",
                height: str = "page_height") -> DataFrame:
    """Facts of scanned documents of which there are two readings, told apart by ``method``.

    Weak tokens are dropped and lines merged within each reading, lines become facts, the better reading of each
    document is kept, and of equal facts the one of the first line.
    """
    keys = (*page, method)
    lines = T.merge_tokens(T.confident_tokens(tokens, keys=keys), keys, height)
    numbered = lines.withColumn("line", F.struct(*page[len(doc):], "line"))
    facts = T.line_facts(numbered, (*doc, method))
    return dedup_rows(T.pick_method(facts, doc, method), "line", doc)

