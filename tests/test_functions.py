"""Literal expectations for the scalar functions."""

from pyspark.sql import functions as F

from finfacts.functions import boxes, labels, lines, money, numbers, periods
from finfacts.operators import questions as K


def column(spark, values, expr, type_="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {type_}")
    return [r[0] for r in rows.orderBy("i").select(expr(F.col("v"))).collect()]


def test_line_value_and_year(spark):
    texts = ["FY 2023 Revenue 578,910", "Revenue 5 crore", "FY 2022 Total Income 510,000", "Revenue 900"]
    assert column(spark, texts, lines.line_value) == [578910, 50000000, 510000, None]
    assert column(spark, texts, lines.line_year) == [2023, None, 2022, None]


def test_wide_line_takes_first_large(spark):
    text = ["2020 412345 6155 418500 369000"]
    got = column(spark, text, lambda c: lines.first_large(lines.amount_tokens(c, lines.line_year(c))))
    assert got == [412345]


def test_parse_wide_line_layouts(spark):
    raw = ["2019 385672 5328 391000 347000 32500 49.62", "2020 412,345 6,155 369,000 43,000", "2019 1 2 3", "x"]
    got = column(spark, raw, lines.parse_wide_line)
    assert tuple(got[0]) == (2019, 385672.0, 5328.0, 391000.0, 347000.0, 32500.0, 49.62)
    assert tuple(got[1]) == (2020, 412345.0, 6155.0, 418500.0, 369000.0, 43000.0, None)
    assert got[2] is None and got[3] is None


def test_units_and_currency(spark):
    assert column(spark, ["in crore", "5 lakh", "x"], money.unit_multiplier) == [1e7, 1e5, 1.0]
    assert column(spark, ["₹5", "12 EUR", "x"], money.currency_of) == ["INR", "EUR", "USD"]
    assert column(spark, ["₹5", "$12", "x"], lambda c: money.currency_of(c, "line")) == ["INR", "USD", None]


def test_sheet_numbers(spark):
    cells = ["₹ 1,234.50", "(1,234)", "Rs. 99", "12.5%", "n/a", "-", "about 7", None, "(-5)"]
    assert column(spark, cells, numbers.parse_sheet_number) == [1234.5, -1234.0, 99.0, 12.5, None, None, 7.0, None, 5.0]


def test_ledger_numbers(spark):
    cells = ["(1,234)", "₹ 1,234 Cr", "12-34", "1.2.3", "", "-7"]
    assert column(spark, cells, numbers.parse_ledger_number) == [-1234.0, 1234.0, None, None, None, -7.0]


def test_js_round_is_half_up(spark):
    assert column(spark, [2.5, -2.5, 1.005], lambda c: numbers.js_round(c, 0), "double") == [3.0, -2.0, 1.0]


def test_period_labels(spark):
    tokens = ["FY2021-22", "FY 2021", "2021/22", "Mar 2023", "x", "21-22"]
    assert column(spark, tokens, periods.period_of) == ["2022", "2021", "2021", "2023", None, None]
    assert column(spark, ["FY23", "22-23", "2022-23", "FY2021-22"], periods.header_year) == ["2023", "2023", "2022", "2022"]
    assert column(spark, ["FY 2021", "2020", "17 x", "abc"], periods.fiscal_key) == [2021, 2020, 17, None]


def test_year_overlap(spark):
    assert column(spark, ["FY 2021"], lambda c: periods.overlaps_years(c, 2020, 2022)) == [True]
    assert column(spark, ["FY 2021"], lambda c: periods.overlaps_years(c, 2022, 2023)) == [False]


def test_year_range(spark):
    texts = ["ROE 2020-2023", "profit between 2019 and 2021", "from 2022 to 2020", "FY 2024 ROE"]
    got = column(spark, texts, periods.year_range)
    assert [tuple(r) for r in got] == [(2020, 2023), (2019, 2021), (2020, 2022), (None, None)]


def test_slot_rules_keep_their_order(spark):
    names = ["Net Profit", "net_profit", "Profit before tax", "Other Income", "Total Income", "Revenue from Operations",
             "Total Tax Expenses", "E.B.I.T.D.A.", "EBIT", "Basic EPS", '"Revenue FY 2019"', "Accumulated depreciation"]
    want = ["net_income", "net_income", "pbt", None, "total_income", "revenue", None, "ebitda", "operating_income",
            "reported_eps", "revenue", None]
    assert column(spark, names, labels.classify_metric) == want


def test_line_class(spark):
    texts = ["FY 2023 Revenue 578,910", "FY 2022 Total Income 510,000", "FY 2023 Finance Cost 355,000", "Other income 5",
             "Profit for the year 9", "hello"]
    assert column(spark, texts, labels.line_class) == ["revenue", "revenue", "expense", "other", "profit", "other"]


def test_token_role(spark):
    words = ["FY 2023", "2021", "12,345", "12", "Revenue", "the"]
    assert column(spark, words, labels.token_role) == ["YEAR", "YEAR", "VALUE", "O", "METRIC", "O"]


def test_box_scaling(spark):
    quad = [[[10.0, 20.0], [790.0, 20.0], [790.0, 620.0], [10.0, 620.0]], []]
    got = column(spark, quad, lambda c: boxes.bbox_norm(boxes.bbox_xyxy(c), F.lit(800), F.lit(600)), "array<array<double>>")
    assert tuple(got[0]) == (12, 33, 987, 1000) and tuple(got[1]) == (0, 0, 0, 0)


def test_question_tags(spark):
    texts = ["total revenue across years", "roe trend", "cagr on revenue", "compound annual growth for sales",
             "running total revenue", "cumulative net income", "gross profit and gross margin", "show me everything"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    flags = {r["i"]: r for r in K.tag_intents(rows).collect()}
    assert flags[0]["wants_sum"] and not flags[1]["wants_sum"]
    assert flags[2]["wants_cagr"] and flags[3]["wants_cagr"] and not flags[0]["wants_cagr"]
    assert flags[4]["wants_running_total"] and flags[5]["wants_running_total"]
    kinds = {r["i"]: r["kinds"] for r in K.tag_formula_kinds(rows).collect()}
    assert kinds[1] == ["roe"] and kinds[6] == ["gross_profit", "gross_margin"] and kinds[7] is None


def test_sums_keep_small_and_huge_addends(spark):
    def total(values):
        rows = spark.createDataFrame([(float(v),) for v in values], "v double")
        return rows.agg(numbers.exact_sum("v").alias("s")).first()["s"]

    assert abs(total([4e-7] * 10) - 4e-6) < 1e-18
    assert total([1e30, 1.0]) == 1e30 and total([float("inf"), 1.0]) == float("inf")
    assert total([0.1] * 10) == 1.0 and total([-2.5, 2.5]) == 0.0
    assert spark.createDataFrame([(None,)], "v double").agg(numbers.exact_sum("v").alias("s")).first()["s"] is None


def test_rounding_does_not_saturate(spark):
    got = column(spark, [2e17, 1.005, -0.5, 1e300, None], lambda c: numbers.js_round(c, 2), "double")
    assert got == [2e17, 1.0, -0.5, 1e300, None]


def test_period_keys_of_any_length(spark):
    assert column(spark, ["12345678901", "7", "FY 2021", "x"], periods.fiscal_key) == [None, 7, 2021, None]


# Expected classes of labels, written down from the statements they stand for and not from the rules.
SLOTS = {
    "Net Profit": "net_income", "Operating Profit": "operating_income", "Gross Profit": "reported_gross_profit", "Profit before tax": "pbt",
    "Finance Costs": "interest_expense", "Interest expense": "interest_expense", "Depreciation": "depreciation_charge", "Cost of materials": "cogs",
    "Total income": "total_income", "Revenue": "revenue", "Turnover": "revenue", "Revenue from operations": "revenue", "Other revenue": None,
    "Cost of goods sold": "cogs", "Total Expenses": "expenses", "PBT": "pbt", "Profit after tax": "net_income", "PAT": "net_income", "Profit": "net_income",
    "EBITDA": "ebitda", "E.B.I.T.D.A": "ebitda", "EBIDTA": "ebitda", "EBDITA": "ebitda", "P B D T": "ebitda", "PBIDT": "ebitda", "OIBDA": "ebitda",
    "Earnings before interest, depreciation and amortisation": "ebitda", "EBIT": "operating_income", "Operating income": "operating_income",
    "Shareholders equity": "equity", "Total assets": "total_assets", "Current assets": "current_assets", "Current liabilities": "current_liabilities",
    "Inventories": "inventory", "Trade receivables": "receivables", "Accounts payable": "payables", "Total debt": "total_debt", "Debt": "total_debt",
    "Finance cost of leases": "interest_expense", "Amortization of software": "depreciation_charge", "Accumulated depreciation": None, "EPS": "reported_eps",
    "Earnings per share": "reported_eps", "Shares outstanding": "shares", "Share price": "share_price", "Weather": None,
}
STRENGTH = {"EBITDA": 4, "Reported E B I T D A": 4, "EBITA": 3, "EBIDTA": 3, "EBDITA": 3, "EDITDA": 3, "EBIT": 2, "PBDT": 2, "PBIDT": 2, "OIBDA": 2, "Debit": 0, "Sales": 0}
LINE_CLASSES = {
    "Other income": "other", "Earnings per share": "other", "Share capital": "other", "Interest income": "revenue", "Dividend income": "revenue",
    "Profit before tax": "profit", "EBITDA": "profit", "PAT": "profit", "Operating income": "profit", "Finance cost": "expense", "Depreciation": "expense",
    "Employee benefit": "expense", "Tax expense": "expense", "Revenue from operations": "revenue", "Total income": "revenue", "Net sales": "revenue",
    "Turnover": "revenue", "Rental income": "revenue", "Sales": "revenue", "Hello": "other",
}
SERVER_QUESTIONS = {
    "what is the p/earnings ratio": "pe", "p/e please": "pe", "price to earnings": "pe", "all metrics": "all", "gross profit": "gross_profit", "gross margin": "gross_margin",
    "operating margin": "operating_margin", "ebitda margin": "ebitda_margin", "average net margin": "net_margin_average", "net profit margin": "net_margin",
    "total revenue": "revenue_total", "sum of net income": "net_income_total", "yoy": "yoy", "revenue growth": "yoy", "average roe": "roe_average", "return on equity": "roe",
    "roa": "roa", "roce": "roce", "current ratio": "current_ratio", "acid test": "quick_ratio", "debt to equity": "debt_to_equity", "gearing of debt": "debt_to_equity",
    "interest coverage": "interest_coverage", "asset turnover": "asset_turnover", "inventory days": "inventory_days", "dso": "receivable_days",
    "days payable": "payable_days", "eps": "eps", "weather": None,
}


def test_labels_mean_what_they_say(spark):
    assert dict(zip(SLOTS, column(spark, list(SLOTS), labels.classify_metric), strict=True)) == SLOTS
    assert dict(zip(STRENGTH, column(spark, list(STRENGTH), labels.ebitda_strength), strict=True)) == STRENGTH
    assert dict(zip(LINE_CLASSES, column(spark, list(LINE_CLASSES), labels.line_class), strict=True)) == LINE_CLASSES


def test_questions_mean_what_they_say(spark):
    rows = spark.createDataFrame(list(enumerate(SERVER_QUESTIONS)), "i int, question string")
    got = {r["question"]: r["kinds"] and r["kinds"][0] for r in K.tag_formula_kinds(rows, "question", "server").collect()}
    assert got == SERVER_QUESTIONS


def test_a_text_is_cleaned_once_for_all_rules(spark):
    df = spark.createDataFrame([("  Net   Profit 5 crore ",), (None,)], "text string").select(
        labels.line_class("text").alias("line"), labels.metric_from_row("text").alias("row"), money.unit_multiplier("text").alias("unit"))
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace") <= 2 and plan.count("lower(") <= 3
    assert [r["line"] for r in df.collect()] == ["profit", "other"]
    assert [r["unit"] for r in df.collect()] == [1e7, 1.0]
