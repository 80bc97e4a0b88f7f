"""Tokens and lines that need no partner are not moved to look for one."""

from finfacts.operators import tokens as T


def test_only_doubtful_tokens_meet_their_page(spark):
    rows = [(1, 1, "a", 0.9), (1, 1, "b", 0.45), (2, 1, "c", 0.9), (2, 1, "d", 0.6), (2, 1, "e", 0.45), (None, 1, "f", 0.45), (None, 1, "g", 0.41),
            (None, 1, "g", 0.41), (3, None, "h", None), (3, None, " ", 0.9), (3, None, "i", 0.3), (3, None, "j", 0.4)]
    df = spark.createDataFrame(rows, "doc_id int, page int, text string, confidence double")
    out = T.confident_tokens(df)
    assert sorted(r["text"] for r in out.collect()) == ["a", "b", "c", "d", "f", "g", "g", "h", "j"]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.startswith("Union") and plan.count("Join") == 1
    assert sorted(r["text"] for r in T.confident_tokens(df, keys=()).collect()) == ["a", "c", "d", "h"]


def test_a_text_moves_once_to_its_prediction_and_only_lines_without_currency_to_their_document(spark, monkeypatch):
    rows = [(1, 1, "Net sales 2020 5,000 USD"), (1, 2, "Net sales 2021 6,000"), (1, 2, "Net sales 2021 6,000"), (2, 1, "Rent 2020 7000"),
            (None, 1, "Net sales 2020 ₹ 8,000"), (None, 2, "Net sales 2021  9,000")]
    df = spark.createDataFrame(rows, "doc_id int, line int, text string")
    given = df.selectExpr("doc_id", "line", "'profit' AS label", "0.9D AS confidence").distinct()
    seen, write = [], T.written
    monkeypatch.setattr(T, "written", lambda df, label: seen.append(df) or write(df, label))
    out = T.line_facts(df, predictions=given)
    got = sorted(((r["doc_id"], r["line"], r["metric"], r["currency"], r["raw"]) for r in out.collect()), key=repr)
    assert got == sorted([
        (1, 1, "profit", "USD", "Net sales 2020 5,000 USD"), (1, 2, "profit", "USD", "Net sales 2021 6,000"), (1, 2, "profit", "USD", "Net sales 2021 6,000"),
        (2, 1, "profit", None, "Rent 2020 7000"), (None, 1, "profit", "INR", "Net sales 2020 8,000"), (None, 2, "profit", "INR", "Net sales 2021 9,000")], key=repr)
    below = seen[0]._jdf.queryExecution().optimizedPlan().toString().split("Join", 1)[1]
    assert "regexp" not in below and "replace(" not in below
    assert out._jdf.queryExecution().optimizedPlan().toString().startswith("Union")
