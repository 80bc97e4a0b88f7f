"""The sheet pivot works its cells out once."""

from finfacts.operators.pivot import pivot_facts


def test_sheet_cells_are_worked_out_once(spark):
    """The labels' dictionary and the sums read stored cells, not the sheet; the join does not move the cells."""
    rows = [("a", "2020", "Revenue", "1,000"), ("a", "2020", "Net Sales", "5"), (None, "2021", "revenue", "(3)"), ("a", "2021", None, "8")]
    sheet = spark.createDataFrame(rows, "company string, period string, metric string, value string")
    out = pivot_facts(sheet, ("company",), "sum")
    plan = out._jdf.queryExecution()
    assert "LogicalRDD" not in plan.optimizedPlan().toString()
    assert "SortMergeJoin" not in plan.executedPlan().toString()
    assert sorted((r["company"] or "-", r["period"], r["revenue"]) for r in out.collect()) == [("-", "2021", -3.0), ("a", "2020", 1005.0)]
