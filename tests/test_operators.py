"""Small hand-made frames: gaps, zeros, single periods, skewed keys, and invariants."""

import random

import pytest
from pyspark.sql import functions as F

from finfacts.operators import aggregate as A
from finfacts.operators import documents as D
from finfacts.operators import learn as M
from finfacts.operators import pivot as V
from finfacts.operators import quantiles as Q
from finfacts.operators.pivot import pivot_facts
from finfacts.operators import series as S
from finfacts.operators import tokens as T
from finfacts.plans.dashboard import ratio_dashboard
from finfacts.plans.extraction import extract_facts

FACT = "company string, metric string, period string, value double, level string, is_valid boolean"


def facts(spark, rows):
    return spark.createDataFrame([(*r, "line", True) for r in rows], FACT)


def rows_of(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_dashboard_gaps_and_zero_base(spark):
    rows = [("a", "revenue", "2019", 0.0), ("a", "net_income", "2019", -5.0), ("a", "revenue", "2020", 10.0),
            ("a", "net_income", "2020", 5.0), ("b", "cogs", "2020", 4.0)]
    got = {(r["company"], r["period"]): r for r in ratio_dashboard(facts(spark, rows)).collect()}
    assert got["a", "2019"]["net_profit_margin_pct"] is None
    assert got["a", "2020"]["yoy_revenue_growth_pct"] is None
    assert got["a", "2020"]["yoy_net_income_growth_pct"] == 200.0
    assert got["b", "2020"]["receivable_days"] is None and got["b", "2020"]["inventory_days"] == 0.0


def test_profiles_differ_where_they_should(spark):
    rows = [("a", "revenue", "2020", 100.0), ("a", "net_income", "2020", 10.0), ("a", "total_income", "2020", 200.0),
            ("a", "total_assets", "2020", 50.0), ("a", "operating_income", "2020", 5.0), ("a", "cogs", "2020", 0.0)]
    server = ratio_dashboard(facts(spark, rows), profile="server").first()
    sheet = ratio_dashboard(facts(spark, rows), profile="sheet").first()
    assert (server["net_profit_margin_pct"], sheet["net_profit_margin_pct"]) == (10.0, 5.0)
    assert (server["roce_pct"], sheet["roce_pct"]) == (10.0, None)
    assert server["receivable_days"] == 0.0 and sheet["receivable_days"] is None


def test_pivot_ignores_row_order_and_keys_of_one_company(spark):
    rows = [("a", m, str(2010 + i), float(i * 7 % 5 + 1000)) for i in range(9) for m in ("revenue", "cogs", "equity")]
    mixed = rows[:]
    random.Random(3).shuffle(mixed)
    want = V.pivot_facts(facts(spark, rows), ("company",), "sum").collect()
    assert sorted(want) == sorted(V.pivot_facts(facts(spark, mixed), ("company",), "sum").collect())
    alone = V.pivot_facts(facts(spark, rows), (), "sum").collect()
    assert sorted(tuple(r)[1:] for r in want) == sorted(tuple(r) for r in alone)


def test_wide_sheet_falls_back_to_nearest_ebitda(spark):
    df = spark.createDataFrame([("2019", "10", "3"), ("2020", "12", "(4)")], "Year string, Sales string, EBIT string")
    assert rows_of(V.pivot_wide(df, "Year"), "period", "revenue", "ebitda") == [("2019", 10.0, 3.0), ("2020", 12.0, -4.0)]


def test_group_average_counts_missing_as_zero(spark):
    df = spark.createDataFrame([("x", 10.0), ("x", None), ("y", 4.0)], "g string, v double")
    assert rows_of(A.group_avg(df, "g", "v"), "g", "average") == [("x", 5.0), ("y", 4.0)]


def test_folded_groups_keep_first_spelling(spark):
    df = spark.createDataFrame([(2, "NORTH", 1.0, 0.0), (1, " north", 2.0, 1.0)], "seq int, g string, a double, b double")
    assert rows_of(A.sum_two(df, "g", "a", "b"), "name", "value1", "value2") == [("north", 3.0, 1.0)]


def test_total_over_mixed_metrics_is_refused(spark):
    df = spark.createDataFrame([(2020, "revenue", 1.0)], "year int, metric string, value double")
    with pytest.raises(ValueError):
        A.grand_total(df, "value")
    with pytest.raises(ValueError):
        A.summarise(df.withColumnRenamed("value", "roe_pct"), "roe_pct", "sum")


def test_order_statistics_match_brute_force_on_a_skewed_key(spark):
    rng = random.Random(7)
    rows = [("hot", float(rng.randint(0, 50))) for _ in range(5000)] + [(f"k{i % 40}", rng.random()) for i in range(4000)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(6)
    groups = {}
    for k, v in rows:
        groups.setdefault(k, []).append(v)
    got = {r["k"]: r for r in Q.index_quartiles(df, ("k",), "v").collect()}
    mid = {r["k"]: r["median"] for r in Q.median(df, ("k",), "v").collect()}
    for k, values in groups.items():
        s, n = sorted(values), len(values)
        assert (got[k]["q1"], got[k]["q2"], got[k]["q3"]) == (s[n // 4], s[n // 2], s[int(n * 0.75)])
        assert mid[k] == (s[(n - 1) // 2] + s[n // 2]) / 2


def test_series_edge_cases(spark):
    one = spark.createDataFrame([("a", "2020", 5.0)], "company string, period string, value double")
    assert S.trend_class(one, "value", ("company",)).first()["trend"] == "insufficient"
    assert S.latest_growth(one, "value", ("company",)).first()["growth_pct"] is None
    assert S.cagr(one, "value", ("company",)).count() == 0
    flat = spark.createDataFrame([("a", str(y), 5.0) for y in range(2015, 2021)], "company string, period string, value double")
    assert S.anomalies(flat, "value", ("company",)).count() == 0
    assert S.trend_class(flat, "value", ("company",)).first()["trend"] == "stable"


def test_check_series_reasons(spark):
    df = spark.createDataFrame([("2019", 50000.0), ("2020", 4000.0), ("2020", 4100.0), ("2021", 10.0), (None, 9000.0)],
                               "period string, value double")
    got = {(r["period"], r["violation"]) for r in S.check_series(df, "value").collect()}
    assert ("2020", "repeated period") in got and ("2020", "collapse") in got
    assert ("2021", "amount under 1000") in got and (None, "missing period") in got
    assert S.check_series(df.withColumnRenamed("value", "roe_pct"), "roe_pct").count() == 0


def test_tokens_follow_the_running_mean(spark):
    def token(seq, x, y, text):
        return (1, 1, seq, text, [[x, y], [x + 10, y], [x + 10, y], [x, y]], 0.9, 400)

    # Gaps of 8 chain, but the fourth lies 16 from the open line's mean of 8 and starts a new one.
    rows = [token(1, 50.0, 8.0, "b"), token(2, 0.0, 0.0, "a"), token(3, 90.0, 16.0, "c"), token(4, 0.0, 24.0, "d"),
            token(5, 0.0, 100.0, "e")]
    df = spark.createDataFrame(
        rows, "doc_id int, page int, seq int, text string, bbox array<array<double>>, confidence double, page_height int")
    assert rows_of(T.merge_tokens(df), "line", "text") == [(1, "a b c"), (2, "d"), (3, "e")]


def test_token_floor_retry(spark):
    df = spark.createDataFrame([(1, 1, "a", 0.9), (1, 1, "b", 0.2), (1, 2, "c", 0.9), (1, 2, "d", 0.45), (2, 1, "e", 0.6), (2, 1, "f", 0.7), (2, 1, "g", 0.45)],
                               "doc_id int, page int, text string, confidence double")
    assert rows_of(T.confident_tokens(df), "text") == [("a",), ("c",), ("d",), ("e",), ("f",)]


def test_line_pipeline_golden_rows(spark):
    texts = ["FY 2023 Revenue ₹578,910", "FY 2022 Total Income 510,000", "FY 2023 Finance Cost 355,000"]
    df = spark.createDataFrame([(1, i, t) for i, t in enumerate(texts)], "doc_id int, line int, text string")
    got = T.line_facts(df).orderBy("line").collect()
    assert [(r["year"], r["metric"], r["value"], r["currency"]) for r in got] == [
        (2023, "revenue", 578910, "INR"), (2022, "revenue", 510000, "INR"), (2023, "expense", 355000, "INR")]


def test_model_label_outranks_the_number_rule(spark):
    text = "2020 412345 6155 418500 369000"
    df = spark.createDataFrame([(1, 1, text), (1, 2, text)], "doc_id int, line int, text string")
    sure = spark.createDataFrame([(1, 1, "expense", 0.85), (1, 2, "other", 0.2)], "doc_id int, line int, label string, confidence double")
    got = {r["line"]: r["metric"] for r in T.line_facts(df, predictions=sure).collect()}
    assert got == {1: "expense", 2: "revenue"}


GRID = "company string, source_file string, page_number int, table_index int, rows array<array<string>>"


def test_grid_gives_back_its_facts(spark):
    # A year split over two cells belongs to the first of them.
    columnar = [["Particulars", "FY 2021", "202", "3"], ["Revenue from operations", "12,000", "15,000", ""],
                ["Total Expenses", "9,000", "(11,000)", ""], ["Net profit margin", "12%", "13%", ""],
                ["Profit after tax", "3,000", "4,000", ""]]
    transposed = [["Year", "Revenue", "Other Income", "EPS"], ["FY2020", "5,000", "1,200", "3.5"], ["FY2021", "6,000", "1,300", "4.5"],
                  ["Total profit", "", "", ""]]
    df = spark.createDataFrame([("a", "f", 1, 0, columnar), ("b", "f", 1, 0, transposed)], GRID)
    paths = {r["company"]: r["path"] for r in D.route_tables(df).collect()}
    assert paths == {"a": "columnar", "b": "transposed"}
    got = rows_of(extract_facts(df), "company", "metric", "period", "value")
    assert ("a", "revenue", "2021", 12000.0) in got and ("a", "revenue", "2023", 15000.0) in got
    assert ("a", "net_profit", "2021", 3000.0) in got and ("b", "eps", "2020", 3.5) in got
    assert ("b", "revenue", "2021", 6000.0) in got and ("b", "other_income", "2020", 1200.0) in got


def test_text_helps_only_short_documents(spark):
    pool = D.row_facts(spark.createDataFrame(
        [("a", "f", 1, 0, [["2019 results 5000 3000 2000"], ["2020 results 6000 3500 2500"]]), ("b", "f", 1, 0, [["2019 sums 7000 100"]])], GRID))
    texts = spark.createDataFrame([("a", "f", "revenue", 2018, 20000.0), ("b", "f", "revenue", 2018, 30000.0)],
                                  "company string, source_file string, metric string, year int, value double")
    got = D.union_candidates(pool, texts).where("extraction_method = 'text_fallback'")
    assert rows_of(got, "company", "period", "value") == [("b", "2018", 30000.0)]


def test_split_is_stable_and_stratified(spark):
    df = spark.createDataFrame([(f"t{i}", "profit" if i % 4 == 0 else "other") for i in range(800)], "text string, label string")
    train, held = M.stratified_split(df)
    counts = {r["label"]: r["n"] for r in held.groupBy("label").agg(F.count("*").alias("n")).collect()}
    assert counts == {"profit": 40, "other": 120} and train.count() == 640
    assert sorted(held.collect()) == sorted(M.stratified_split(df.repartition(5))[1].collect())


def test_unknown_label_fails_the_job(spark):
    bad = spark.createDataFrame([("x", "gain")], "text string, label string")
    with pytest.raises(Exception, match="unknown label"):
        M.training_frame(bad).collect()


def test_header_below_the_first_rows_names_the_years(spark):
    rows = [["Particulars", "", ""]] + [[f"note {i}", "x", "y"] for i in range(8)] + [["Particulars", "FY 2021", "FY 2022"], ["Revenue from operations", "50,000", "60,000"], ["Profit", "5,000", "6,000"]]
    grid = spark.createDataFrame([("a", "x.pdf", 1, 0, rows)], "company string, source_file string, page_number int, table_index int, rows array<array<string>>")
    got = {(r["metric"], r["period"]): r["value"] for r in D.columnar_facts(grid).where("metric = 'revenue'").collect()}
    assert got == {("revenue", "2021"): 50000.0, ("revenue", "2022"): 60000.0}


def test_missing_levels_and_values_never_win(spark):
    rows = [("a", "revenue", "2020", 50.0, "consolidated", True, 1, 1), ("a", "revenue", "2020", 90.0, None, True, 1, 2), ("a", "revenue", "2020", None, "consolidated", True, 1, 3)]
    df = spark.createDataFrame(rows, FACT + ", source_page int, id int")
    assert A.best_fact(df).first()["value"] == 50.0
    yearly = facts(spark, [("a", "revenue", "2019", None), ("a", "revenue", "2020", 7.0)])
    assert A.extreme_period(yearly, high=False, keys=("company",)).first()["period"] == "2020"


def test_null_keys_keep_their_rows(spark):
    df = spark.createDataFrame([(None, 1.0), (None, 3.0), ("k", 5.0)], "k string, v double")
    assert rows_of(Q.median(df, ("k",), "v").fillna("-", ["k"]), "k", "median") == [("-", 2.0), ("k", 5.0)]
    lines = spark.createDataFrame([(f"t{i}", None if i % 2 else "revenue") for i in range(40)], "text string, label string")
    train, held = M.stratified_split(lines)
    assert train.count() + held.count() == 40 and {r["label"] for r in held.collect()} == {None, "revenue"}
    money = spark.createDataFrame([(None, "EUR"), (None, ""), ("d", "USD")], "doc string, currency string")
    assert rows_of(A.fill_currency(money, ("doc",)).where("doc is null"), "currency") == [("EUR",), ("EUR",)]


def test_external_revenue_helps_weak_tables_only(spark):
    schema = "company string, source_file string, statement_type string, metric string, period string, value double, unit string, level string, currency string, source_page int, is_valid boolean, extraction_method string, confidence double, raw string"
    tables = spark.createDataFrame([(c, "x", "s", "revenue", y, 5000.0, "INR_CRORE", "standalone", "USD", 1, True, "rule", 0.8, "") for c, y in (("strong", "2019"), ("strong", "2021"), ("weak", "2020"), ("weak", "2021"))], schema)
    external = spark.createDataFrame([(c, "x", y, 9000.0) for c in ("strong", "weak", "none") for y in ("2018", "2020")], "company string, source_file string, year string, revenue double")
    got = D.union_candidates(tables, None, external).where("extraction_method = 'ai_extracted'")
    assert rows_of(got, "company", "period") == [("none", "2018"), ("none", "2020"), ("weak", "2018"), ("weak", "2020")]


def test_margins_count_every_group(spark):
    df = spark.createDataFrame([(f"g{i}", 100.0, float(i)) for i in range(12)], "g string, revenue double, profit double")
    got = A.margin_by_group(df, "g", "revenue", "profit", n=2).collect()
    assert [r["g"] for r in got] == ["g11", "g10"] and {r["average_margin_pct"] for r in got} == {5.5} and got[0]["best_group"] == "g11"


def test_plausibility_looks_at_the_checked_column(spark):
    df = spark.createDataFrame([("2020", 5000.0, 1.0), ("2021", 10.0, 2.0)], "period string, value double, eps double")
    assert {r["violation"] for r in S.check_series(df, "value").collect()} == {"amount under 1000", "collapse"}


def test_sheet_pivot_by_distinct_labels(spark):
    rows = [("a", " 2020 ", "Revenue", "1,000"), ("a", "2020", "Net Sales", "5"), ("a", "2020", "no such label", "7"), ("a", "2020", None, "8"),
            (None, "2021", "revenue", "(3)"), ("a", "2022", "Revenue", "none"), ("a", "", "Revenue", "9"), ("a", None, "Revenue", "9"), ("a", "2023", "unknown", "9")]
    df = spark.createDataFrame(rows, "company string, period string, metric string, value string")
    out = pivot_facts(df, ("company",), "sum")
    known = labels_of(df)
    want = sum(v for label, v in (("Revenue", 1000.0), ("Net Sales", 5.0)) if known[label] == "revenue")
    assert rows_of(out.fillna("-", ["company"]), "company", "period", "revenue") == [("-", "2021", -3.0), ("a", "2020", want)]
    assert pivot_facts(df.where("false"), ("company",), "sum").count() == 0


def labels_of(df):
    from finfacts.functions.labels import classify_metric

    return {r["metric"]: r["slot"] for r in df.select("metric", classify_metric("metric").alias("slot")).collect()}


def test_catalog_queries_tune_a_plain_session(spark):
    import catalog

    before = spark.conf.get("spark.sql.codegen.hugeMethodLimit")
    try:
        spark.conf.set("spark.sql.codegen.hugeMethodLimit", 65535)
        catalog.QUERIES["c13_clean_text"](spark, "/root/testdata/sf0.001")
        assert int(spark.conf.get("spark.sql.codegen.hugeMethodLimit")) == 8000
    finally:
        spark.conf.set("spark.sql.codegen.hugeMethodLimit", before)


def _reads(df, name):
    return df._jdf.queryExecution().optimizedPlan().toString().count(name)


def test_lines_are_read_once(spark):
    """Readings, line facts and the split work out their lines once: their plans hold no second copy of the source."""
    from catalog import tokens as C

    sf = "/root/testdata/sf0.001"
    assert _reads(C.readings(spark, sf), "l_extendedprice#") <= _reads(C.fx.text_lines(spark, sf), "l_extendedprice#")
    rows = spark.createDataFrame([(1, 1, "FY 2023 Revenue ₹578,910"), (1, 2, "FY 2022 Total Income 510,000")], "doc_id int, line int, text string")
    assert _reads(T.line_facts(rows), "LogicalRDD") == 0
    labelled = spark.createDataFrame([(i, f"t{i}", "profit") for i in range(10)], "id int, text string, label string")
    train, held = M.stratified_split(labelled)
    assert _reads(train, "LogicalRDD") == _reads(held, "LogicalRDD") == 0
    assert (train.count(), held.count()) == (8, 2)
