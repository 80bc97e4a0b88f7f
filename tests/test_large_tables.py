"""Steps that must not grow faster than the tables, nor work a row out twice."""

import pytest
from pyspark.sql import functions as F

from catalog import fixtures as fx
from finfacts.functions import labels as L
from finfacts.functions import rules as R
from finfacts.operators import aggregate as A
from finfacts.operators import learn as M
from finfacts.session import tuned

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_last_per_period_aggregates_in_place_and_sorts_by_columns(spark):
    rows = [("a", "2020", 1, 1.0), ("a", "2020", 3, None), ("a", "FY 19", 2, 2.0), ("a", " 2019", 5, 5.0), (None, "2020", 4, 4.0),
            (None, "2020", None, 9.0), ("b", "2020", None, 7.0), ("b", None, 6, 6.0)]
    df = spark.createDataFrame(rows, "company string, period string, id long, value double")
    out = A.last_per_period(df, "id", ("company",))
    assert [tuple(r) for r in out.collect()] == [
        (None, "2020", 4, 4.0), (None, None, None, None), ("a", " 2019", 5, 5.0), ("a", "2020", 3, None), ("a", "FY 19", 2, 2.0)]
    text = plan(out)
    assert "SortAggregate" not in text and "Sort [company" in text
    assert "try_cast" not in text[text.index("Sort ["):].splitlines()[0].lower() and "trim" not in text[text.index("Sort ["):].splitlines()[0]


def test_facts_of_a_company_need_no_exchange_of_their_own(spark):
    facts = fx.facts(spark, SF).select("company", "metric", "period", "id", "value")
    text = plan(A.last_per_period(facts, "id", ("company", "metric"), ordered=False))
    assert "Exchange" not in text[:text.index("Generate")]


def test_shards_work_a_label_out_once(spark):
    rows = spark.createDataFrame([("Net profit 5", 1), (" Net profit 5", 2), (None, 3), ("Rent", 4)], "text string, id int")
    lines = rows.select("id", F.concat("text", F.lit("")).alias("text")).withColumn("label", L.line_class("text"))
    out = M.training_frame(lines.where("id < 9"), lines.where("id > 0"))
    assert sorted(map(tuple, out.collect())) == [("Net profit 5", "profit")] * 4 + [("Rent", "other")]
    assert out._jdf.queryExecution().optimizedPlan().toString().count("earnings per share") == 2


@pytest.mark.parametrize("pattern", [r"\bpat\b", r"\bsales\b"])
def test_single_words_are_searched_only_where_they_stand(spark, pattern):
    texts = ["pat", "spat", "a pat.", "1pat", "pa t", "sales", "resales", "", None, "sales2", "net-sales x"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert "contains" in str(R.match(F.col("t"), pattern)).lower()
    got = df.select(R.match(F.col("t"), pattern).alias("a"), F.col("t").rlike(pattern).alias("b")).collect()
    assert [r["a"] for r in got] == [r["b"] for r in got]


def test_squeeze_keeps_its_meaning(spark):
    texts = ["  A  b ", "a\tb", "\na\r\n b", "a\x0bb\f", "one two", "", None, " \t "]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = df.select(L.squeeze("t").alias("a"), F.lower(F.trim(F.regexp_replace("t", r"\s+", " "))).alias("b")).collect()
    assert [r["a"] for r in got] == [r["b"] for r in got]


def test_shuffle_files_go_with_the_query_that_wrote_them(spark):
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "true"
    df = tuned(spark).range(1000).groupBy((F.col("id") % 10).alias("k")).count()
    assert [len(df.collect()), df.count(), len(df.collect())] == [10, 10, 10]
