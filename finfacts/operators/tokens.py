"""Facts out of OCR tokens: lines, roles, amounts, and the choice between two readings."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DoubleType, IntegerType, StringType, StructField, StructType

from ..functions import labels, lines, money
from ..functions.boxes import bbox_xyxy
from ..functions.numbers import exact_mean, js_round, safe_div
from ..functions.rules import TOKEN_LABELS
from ..stored import written
from .aggregate import main_currency
from .frames import Keys, rows_with, same_keys, with_keys

# Geometry and confidence limits.
LINE_GAP_MIN = 12.0
LINE_GAP_SHARE = 0.025
TOKEN_FLOOR = 0.5
TOKEN_RETRY_FLOOR = 0.4
MIN_TOKENS = 2
ROLE_FLOOR = 0.5
LABEL_FLOOR = 0.6
LABEL_SURE = 0.75
LINE_SURE = 0.6
CONFIDENCE_HIGH = 0.65
CONFIDENCE_MEDIUM = 0.45
SWITCH_MARGIN = 3.0

PAGE = ("doc_id", "page")
LINE_FIELDS = (StructField("line", IntegerType()), StructField("text", StringType()), StructField("weakest", DoubleType()))


def confident_tokens(df: DataFrame, floor: float = TOKEN_FLOOR, keys: Keys = PAGE) -> DataFrame:
    """Filled tokens at or above the floor; a page with fewer than two of them is retried at 0.4."""
    sure = F.coalesce("confidence", F.lit(1.0))
    rows = df.where((F.trim("text") != "") & (sure >= min(floor, TOKEN_RETRY_FLOOR)))
    if floor <= TOKEN_RETRY_FLOOR:
        return rows
    # Only the tokens between the floors have to meet their page's count.
    poor = rows.groupBy(*keys).agg(F.count(F.when(sure >= floor, 1)).alias("_sure")).where(F.col("_sure") < MIN_TOKENS)
    doubtful = rows.where(sure < floor)
    other, same = same_keys(doubtful, poor, keys) if keys else (poor, F.lit(True))
    return rows.where(sure >= floor).unionByName(doubtful.join(other, same, "left_semi"))


def token_lines(df: DataFrame, keys: Keys = PAGE, height: str = "page_height") -> DataFrame:
    """Tokens grouped into text lines: line number, text, and the weakest token confidence.

    Tokens are sorted by centre; one joins the open line while it lies within max(12, 2.5 % of the page
    height) of that line's mean centre.  The sort spills and the fold over it holds one line, so a page may
    have any number of tokens.
    """
    box = bbox_xyxy("bbox")
    tokens = df.where(F.trim(F.coalesce("text", F.lit(""))) != "").withColumn("_box", box)
    tokens = tokens.select(
        *keys,
        "seq",
        F.trim("text").alias("text"),
        F.coalesce("confidence", F.lit(1.0)).alias("confidence"),
        ((F.col("_box.x0") + F.col("_box.x1")) / 2).alias("_cx"),
        ((F.col("_box.y0") + F.col("_box.y1")) / 2).alias("_cy"),
        F.greatest(F.lit(LINE_GAP_MIN), F.col(height).cast("double") * LINE_GAP_SHARE).alias("_gap"),
    )
    dealt = tokens.repartition(*keys) if keys else tokens.repartition(1)
    schema = StructType([*[df.schema[k] for k in keys], *LINE_FIELDS])
    return dealt.sortWithinPartitions(*keys, "_cy", "_cx", "seq").mapInArrow(line_fold(len(keys), to_arrow_schema(schema)), schema)


def line_fold(keys: int, schema: pa.Schema) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The lines of tokens that come sorted by page and centre; each is given out as soon as it closes.

    Rows hold the page's keys, seq, text, confidence, centre across and down, and the gap.  A token joins the open line while it lies
    within the gap of the mean centre of that line's tokens; one without a box is a line of its own.  Only the open line is held.
    """

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        page, number, total, held = None, 0, None, []
        lines: list[tuple] = []

        def close() -> None:
            if held:
                held.sort(key=lambda t: (t[0] is not None, t[0] or 0.0, t[1] is not None, t[1] or 0))
                lines.append((*page, number, " ".join(t[2] for t in held), min(t[3] for t in held)))
                held.clear()

        def given() -> pa.RecordBatch:
            columns = zip(*lines, strict=True) if lines else [[]] * len(schema)
            batch = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)
            lines.clear()
            return batch

        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns]
            owners = zip(*columns[:keys], strict=True) if keys else iter([()] * batch.num_rows)
            for owner, seq, text, confidence, cx, cy, gap in zip(owners, *columns[keys:], strict=True):
                if owner != page:
                    close()
                    page, number, total = owner, 1, cy
                elif cy is None or total is None or abs(cy - total / len(held)) > gap:
                    close()
                    number, total = number + 1, cy
                else:
                    total += cy
                held.append((cx, seq, text, confidence))
            yield given()
        close()
        yield given()

    return fold


def merge_tokens(df: DataFrame, keys: Keys = PAGE, height: str = "page_height") -> DataFrame:
    """The text lines of each page."""
    return token_lines(df, keys, height).drop("weakest")


def token_labels(df: DataFrame, predictions: DataFrame | None = None, keys: Keys = PAGE) -> DataFrame:
    """Role of each token: the model's label when its confidence is 0.5 or more, else the rule's."""
    rule = labels.token_role("text")
    if predictions is None:
        return df.withColumn("role", rule)
    given = predictions.select(
        *keys, "seq", F.col("label").alias("_label"), F.col("confidence").alias("_sure")
    )
    out = with_keys(df, given, [*keys, "seq"])
    return out.withColumn("role", F.when(F.col("_sure") >= ROLE_FLOOR, F.col("_label")).otherwise(rule)).drop(
        "_label", "_sure"
    )


def confidence_summary(df: DataFrame, keys: Keys = PAGE, height: str = "page_height") -> DataFrame:
    """Mean token confidence, its grade, and the number of lines whose weakest token is 0.6 or more."""
    mean = df.groupBy(*keys).agg(exact_mean(F.coalesce("confidence", F.lit(0.0))).alias("_mean"))
    sure = token_lines(df, keys, height).groupBy(*keys).agg(
        F.count(F.when(F.col("weakest") >= LINE_SURE, 1)).alias("_sure")
    )
    grade = (
        F.when(F.col("_mean") >= CONFIDENCE_HIGH, "High")
        .when(F.col("_mean") >= CONFIDENCE_MEDIUM, "Medium")
        .otherwise("Low")
    )
    return with_keys(mean, sure, keys).select(
        *keys,
        js_round("_mean", 4).alias("avg_confidence"),
        grade.alias("grade"),
        F.coalesce("_sure", F.lit(0)).alias("high_confidence_rows"),
    )


def line_facts(df: DataFrame, keys: Keys = ("doc_id",), predictions: DataFrame | None = None,
               text: str = "text", line: str = "line") -> DataFrame:
    """Year, metric, value, currency and cleaned text of every line that states a year and an amount.

    ``predictions`` (keys, line, label, confidence) are a model's classes; from 0.6 they replace the rules.
    An unclassified line with several large amounts is taken as revenue unless the model is sure it is not.
    Missing currencies become the document's most frequent one; the facts are written once for that (starts Spark jobs),
    so no line is read a second time to count currencies.
    """
    rows = df.select(*keys, line, text)
    if predictions is None:
        rows = rows.withColumns({"_label": F.lit(None).cast("string"), "_sure": F.lit(0.0)})
    else:
        given = predictions.select(*keys, line, F.col("label").alias("_label"), F.col("confidence").alias("_sure"))
        rows = with_keys(rows, given, [*keys, line])
    # Cleaned after the join, which so moves each text once.
    rows = rows.withColumn("raw", labels.clean_line(text))
    sure = F.coalesce("_sure", F.lit(0.0))
    # Each step reads columns of the step before, so no text is scanned twice for the same thing.
    rows = rows.withColumns(
        {
            "year": lines.line_year("raw"),
            "_ints": lines.line_integers("raw"),
            "_scale": money.unit_multiplier("raw"),
            "currency": F.coalesce(money.currency_of(text, "line"), money.currency_of("raw", "line")),
            "_class": F.when(sure >= LABEL_FLOOR, F.col("_label")).otherwise(labels.line_class("raw")),
            "_plain": F.regexp_extract_all("raw", F.lit("([0-9]+)"), F.lit(1)),
        }
    )
    rows = rows.withColumns(
        {
            "_value": lines.value_of_integers("_ints", "_scale"),
            "_wide": lines.first_large(lines.tokens_without_year("_ints", "year")),
            "_big": F.filter(F.transform("_plain", lambda n: n.try_cast("bigint")), lambda n: n > 1000),
        }
    )
    big = F.col("_big")
    open_line = (F.col("_class") == "other") & ~(
        F.coalesce(F.col("_label") != "other", F.lit(False)) & (sure >= LABEL_SURE)
    )
    by_wide = open_line & F.col("_wide").isNotNull()
    by_big = open_line & F.col("_wide").isNull() & (F.size(big) >= 2)
    value = (
        F.when((F.col("_class") == "revenue") & F.col("_wide").isNotNull(), F.col("_wide"))
        .when(by_wide, F.col("_wide"))
        .when(by_big, F.array_max(big))
        .otherwise(F.col("_value"))
    )
    metric = F.when(by_wide | by_big, "revenue").otherwise(F.col("_class"))
    found = {"year": F.col("year"), "metric": metric, "value": value, "currency": F.col("currency"), "raw": F.col("raw")}
    facts = written(rows_with(rows, [*keys, line], found, ("year", "value")), "line_facts")
    # Only lines without a currency have to meet their document's.
    known = F.coalesce(F.col("currency") != "", F.lit(False))
    missing = with_keys(facts.where(~known), main_currency(facts, keys), keys).withColumn("currency", F.col("_main")).drop("_main")
    return facts.where(known).unionByName(missing)


def quality_score(df: DataFrame, keys: Keys = ("doc_id",), method: str = "method") -> DataFrame:
    """Score of each reading of a document: 2 per row, 20 x share of filled fields, 1 per distinct (year,
    metric) and -2 per repeat.

    Pairs are counted per distinct pair first, so the count of distinct ones needs no set in memory.
    """
    metric = F.lower(F.trim(F.coalesce("metric", F.lit(""))))
    rows = df.select(*keys, method, "year", "value", metric.alias("_metric"))
    pairs = rows.groupBy(*keys, method, "year", "_metric").agg(
        F.count(F.lit(1)).alias("_n"),
        F.count(F.when(F.coalesce("value", F.lit(0.0)) != 0, 1)).alias("_values"),
    )
    pair = F.col("year").isNotNull() & (F.col("_metric") != "")
    n = F.col("_n")
    out = pairs.groupBy(*keys, method).agg(
        F.sum(n).alias("rows"),
        F.sum(F.when(F.col("year").between(1990, 2035), n).otherwise(0)).alias("_years"),
        F.sum("_values").alias("_values"),
        F.sum(F.when(F.col("_metric") != "", n).otherwise(0)).alias("_metrics"),
        F.count(F.when(pair, 1)).alias("_unique"),
        F.sum(F.when(pair, n).otherwise(0)).alias("_pairs"),
    )
    share = safe_div((F.col("_years") + F.col("_values") + F.col("_metrics")).cast("double"), 3.0 * F.col("rows"))
    score = 2.0 * F.col("rows") + 20.0 * share + F.col("_unique") - 2.0 * (F.col("_pairs") - F.col("_unique"))
    return out.select(*keys, method, "rows", js_round(score, 3).alias("score"))


def pick_method(df: DataFrame, keys: Keys = ("doc_id",), method: str = "method", baseline: str = "baseline",
                other: str = "layout") -> DataFrame:
    """The rows of the better reading: the baseline unless the other scores 3 more or the baseline is empty.

    The rows are written once (starts Spark jobs), since both the scores and the choice read them.
    """
    df = written(df, "readings")
    scores = quality_score(df, keys, method)
    best = scores.groupBy(*keys).agg(
        F.max(F.when(F.col(method) == baseline, F.col("score"))).alias("_b"),
        F.max(F.when(F.col(method) == other, F.col("score"))).alias("_o"),
    )
    takes_other = F.col("_o").isNotNull() & (F.col("_b").isNull() | (F.col("_o") >= F.col("_b") + SWITCH_MARGIN))
    chosen = best.select(*keys, F.when(takes_other, other).otherwise(baseline).alias(method))
    chosen, same = same_keys(df, chosen, [*keys, method])
    return df.join(chosen, same, "left_semi")


def check_token_samples(df: DataFrame, words: str = "words", tags: str = "labels", boxes: str = "bboxes") -> DataFrame:
    """Training samples whose word, label and box counts differ or that use an unknown label, with the reason."""
    uneven = (F.size(words) != F.size(tags)) | (F.size(words) != F.size(boxes))
    unknown = F.exists(tags, lambda t: ~t.isin(*TOKEN_LABELS))
    reason = F.when(uneven, "counts differ").when(unknown, "unknown label")
    return df.withColumn("problem", reason).where(F.col("problem").isNotNull())

