"""Running totals without keys, large amounts, and lines of pages of any size."""

import math
import random
import time

from pyspark.sql import functions as F

from finfacts.operators import aggregate as A
from finfacts.operators import scan
from finfacts.operators import series as S
from finfacts.operators import tokens as T
from finfacts.operators.learn import forecast_frame
from finfacts.plans import answers  # noqa: F401  (the plans import with the operators)

TOKENS = "doc_id string, page int, seq int, text string, confidence double, bbox array<array<double>>, page_height int"


def tokens_of(spark, rows):
    return spark.createDataFrame([(d, p, s, t, c, [[x, y], [x + 8.0, y + 10.0]] if y is not None else None, 400) for d, p, s, t, c, x, y in rows], TOKENS)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_running_totals_without_keys_equal_those_of_one_window(spark):
    rng = random.Random(4)
    rows = [(f"FY {1990 + i % 40} {i}" if i % 3 else (f"label {i}" if i % 2 else None if i == 0 else f"{i}"), rng.choice([None, 0.1, -2.5, 1e20, 3e26]) if i % 50 else 1e27) for i in range(800)]
    df = spark.createDataFrame(rows, "period string, revenue double")
    one = df.withColumn("company", F.lit(1))
    for sample in (4096, 50):
        got = scan.with_running_total(df, "revenue", "total")
        blocks = scan.in_blocks(df, "period", sample).groupBy("_block").count().count()
        assert blocks > 1
        want = scan.with_running_total(one, "revenue", "total", ("company",)).drop("company")
        # Amounts of 1e24 and more are added as doubles, whose last digits depend on where blocks end.
        got, want = ({r["period"]: r["total"] for r in f.collect()} for f in (got, want))
        assert got.keys() == want.keys() and all(math.isclose(got[p], want[p], rel_tol=1e-13) for p in want)
        small = scan.with_running_total(df.where("revenue < 1e24"), "revenue", "total")
        exact = scan.with_running_total(one.where("revenue < 1e24"), "revenue", "total", ("company",)).drop("company")
        assert sorted(map(repr, small.collect())) == sorted(map(repr, exact.collect()))
    got = scan.with_previous(df, {"before": "revenue"})
    want = scan.with_previous(one, {"before": "revenue"}, ("company",)).drop("company")
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))
    for frame in (S.running_total(df, "revenue"), S.growth_rate(df, "period", "revenue"), S.trend_class(df, "revenue")):
        assert "partition by literal" not in plan_of(frame) and "windowspecdefinition(1," not in plan_of(frame)
    empty = df.limit(0)
    assert S.running_total(empty, "revenue").count() == 0 and S.growth_rate(empty, "period", "revenue").count() == 0


def test_large_amounts_are_added(spark):
    df = spark.createDataFrame([("c", f"20{i:02d}", 1e27, 1.0, 1e27) for i in range(10, 16)], "company string, period string, revenue double, expense double, profit double")
    for keys in ((), ("company",)):
        totals = [r["running_total"] for r in S.running_total(df, "revenue", keys).orderBy("period").collect()]
        assert totals == [1e27 * i for i in range(1, 7)] or all(abs(t / (1e27 * i) - 1) < 1e-12 for i, t in enumerate(totals, 1))
        assert S.anomalies(df, "revenue", keys).count() == 0
        assert S.best_year_score(df, keys).first()["total_revenue"] > 5.9e27
        groups = df.select(*keys, F.col("period").alias("name"), F.col("revenue").alias("value1"), F.col("expense").alias("value2"))
        assert [r["share_pct"] for r in A.top_share(groups, 6, 6, keys).collect()] == [17.0] * 6
    assert forecast_frame(df.withColumnRenamed("revenue", "value"), ("company",), 4).count() == 2


def test_lines_close_when_the_mean_is_too_far(spark):
    # The gap is 12: 100, 110 and 114 share a line (means 100, 105), 121 is 13 from 108 and opens the next, 132 joins it.
    rows = [("d", 1, i, t, 0.9 - i / 10, x, y) for i, (t, x, y) in enumerate([("b", 50.0, 100.0), ("a", 5.0, 110.0), ("c", 90.0, 114.0), ("e", 60.0, 121.0), ("d", 2.0, 132.0), (" ", 1.0, 133.0)])]
    rows += [(None, None, 1, "null", None, 3.0, 9.0), (None, None, 2, "page", 0.7, 30.0, 9.0), ("d", 2, 1, "no box", 0.5, 1.0, None), ("d", 2, 2, "box", 0.6, 1.0, 5.0)]
    got = sorted((tuple(r) for r in T.token_lines(tokens_of(spark, rows)).collect()), key=repr)
    assert got == sorted([("d", 1, 1, "a b c", 0.7), ("d", 1, 2, "d e", 0.5), (None, None, 1, "null page", 0.7), ("d", 2, 1, "no box box", 0.5)], key=repr)  # a missing box lies at 0
    summary = {(r["doc_id"], r["page"]): r["high_confidence_rows"] for r in T.confidence_summary(tokens_of(spark, rows)).collect()}
    assert summary == {("d", 1): 1, ("d", 2): 0, (None, None): 1}
    assert T.merge_tokens(tokens_of(spark, [])).count() == 0


def test_a_page_of_many_close_tokens_takes_linear_time(spark):
    def took(n):
        frame = spark.range(n).select(
            F.lit("d").alias("doc_id"), F.lit(1).alias("page"), F.col("id").cast("int").alias("seq"), F.lit("t").alias("text"), F.lit(0.9).alias("confidence"),
            F.array(F.array(F.lit(1.0), F.col("id") / 10.0), F.array(F.lit(2.0), F.col("id") / 10.0)).alias("bbox"), F.lit(400).alias("page_height"))
        began = time.time()
        rows = T.token_lines(frame).agg(F.sum(F.size(F.split("text", " "))), F.count("*")).first()
        assert rows[0] == n and rows[1] > n / 400
        return time.time() - began

    took(1000)
    assert took(100_000) < 15


def test_null_pages_and_documents_stay(spark):
    rows = [(None, None, 1, "x", 0.45, 1.0, 5.0), ("d", None, 1, "y", 0.9, 1.0, 5.0), ("d", None, 2, "z", 0.9, 9.0, 5.0), ("d", None, 3, "w", 0.45, 20.0, 5.0)]
    kept = {(r["doc_id"], r["text"]) for r in T.confident_tokens(tokens_of(spark, rows)).collect()}
    assert kept == {(None, "x"), ("d", "y"), ("d", "z")}
    predictions = spark.createDataFrame([(None, None, 1, "METRIC", 0.9)], "doc_id string, page int, seq int, label string, confidence double")
    assert {(r["doc_id"], r["role"]) for r in T.token_labels(tokens_of(spark, rows), predictions).where("text = 'x'").collect()} == {(None, "METRIC")}
    readings = spark.createDataFrame([(None, "baseline", 2020, "revenue", 5.0), (None, "layout", None, "", None), ("d", "layout", 2020, "revenue", 1.0)],
                                     "doc_id string, method string, year int, metric string, value double")
    assert {(r["doc_id"], r["method"]) for r in T.pick_method(readings).collect()} == {(None, "baseline"), ("d", "layout")}
    lines = spark.createDataFrame([(None, 1, "turnover in 2021 was 5,000,000"), (None, None, "2020 something 7,000,000")], "doc_id string, line int, text string")
    classes = spark.createDataFrame([(None, None, "profit", 0.9)], "doc_id string, line int, label string, confidence double")
    assert {(r["line"], r["metric"]) for r in T.line_facts(lines, predictions=classes).collect()} >= {(None, "profit")}
