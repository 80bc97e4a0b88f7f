"""Boxes of tokens are worked out where the page is together."""

from catalog import tokens as tokens_catalog

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_token_boxes_are_not_shuffled(spark):
    out = tokens_catalog.check_token_samples(spark, SF)
    assert "collect_list(bbox" not in plan(out)
