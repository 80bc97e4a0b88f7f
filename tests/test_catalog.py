"""Registered queries against their oracles at the smallest scale (all of them with CATALOG_ALL=1)."""

import math
import os

import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
QUERIES, ORACLES = entry.queries(), entry.oracle_sql()
SAMPLE = (
    "r21_ratio_dashboard_server", "r21_ratio_dashboard_sheet", "a3_wide_dashboard", "g7_margin_by_group", "g8_financial_summary",
    "g13_top_share", "g20_best_fact", "g24_fill_currency", "w6_trend_class", "w8_anomalies", "w18_check_series", "n2_wide_lines",
    "j3_patch_ebitda", "s6_replace_facts", "i2_infer_layout_wide", "d3_year_columns", "d5_transposed_facts", "d9_merge_tokens",
    "d13_pick_method", "m4_classification_report", "m5_forecast_frame", "k1_tag_formula_kinds_sheet",
)
NAMES = sorted(ORACLES) if os.environ.get("CATALOG_ALL") else SAMPLE


def norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else v + 0.0
    return v


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(norm(r[i]) for i in order) for r in rows), key=str)


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_oracle(spark, duck, name):
    df = QUERIES[name](spark, SF)
    cursor = duck.execute(ORACLES[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(columns) == sorted(df.columns)
    assert table(df.columns, [tuple(r) for r in df.collect()]) == table(columns, cursor.fetchall())


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0


def test_every_oracle_belongs_to_a_query():
    assert set(ORACLES) <= set(QUERIES)
