"""Order statistics against sorted lists: wide and dense values, every number type, hot and NULL keys."""

import math
import random
import re
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from finfacts.operators import quantiles as Q

RANKS = {
    "first": lambda n: F.lit(0), "low": lambda n: F.floor(n * 0.1), "middle": lambda n: F.floor(n / 2),
    "high": lambda n: F.floor(n * 0.9), "last": lambda n: n - 1, "outside": lambda n: n,
}


def by_sorting(values, order=None):
    s, n = sorted(values, key=order), len(values)
    return (s[0], s[math.floor(n * 0.1)], s[n // 2], s[math.floor(n * 0.9)], s[-1], None)


def plain(x):
    return f"{x:.6f}" if isinstance(x, Decimal) else repr(x)


def check(spark, rows, kind, order=None):
    df = spark.createDataFrame(rows, f"k string, v {kind}").repartition(5)
    groups = {}
    for k, v in rows:
        if v is not None:
            groups.setdefault(k, []).append(v)
    got = {r["k"]: tuple(r[name] for name in RANKS) for r in Q.order_statistics(df, ("k",), "v", RANKS).collect()}
    # As text, in which NaN equals NaN.
    text = {k: [plain(x) for x in row] for k, row in got.items()}
    assert text == {k: [plain(x) for x in by_sorting(groups[k], order)] for k in got}
    assert set(got) == set(groups)


def test_doubles_of_all_sizes(spark):
    rng = random.Random(3)
    wide = [rng.choice((-1, 1)) * 10.0 ** rng.uniform(-320, 308) for _ in range(800)]
    dense = [math.nextafter(1.0, 2.0, steps=rng.randint(0, 400)) for _ in range(800)]
    odd = [math.inf, -math.inf, math.nan, 0.0, 5e-324, -5e-324, 1.7976931348623157e308] * 20
    rows = [("wide", v) for v in wide] + [(None, v) for v in dense] + [("odd", v) for v in odd] + [("one", 2.5), ("none", None)]
    check(spark, rows, "double", lambda v: (math.isnan(v), v))


@pytest.mark.parametrize("kind, low, high", [("bigint", -2**63, 2**63 - 1), ("bigint", 2**62, 2**62 + 300), ("int", -2**31, 2**31 - 1), ("smallint", -9, 9)])
def test_whole_numbers(spark, kind, low, high):
    rng = random.Random(4)
    check(spark, [(rng.choice(("hot", "hot", "hot", "k", None)), rng.randint(low, high)) for _ in range(1500)] + [("hot", low), ("k", high)], kind)


def test_decimals_that_a_double_cannot_tell_apart(spark):
    rng = random.Random(5)
    base = Decimal("123456789012345678901234")
    check(spark, [("k", base + Decimal(rng.randint(0, 5000)) / 1000000) for _ in range(1000)], "decimal(30,6)")


def test_no_keys_and_no_rows(spark):
    df = spark.createDataFrame([(float(i % 7),) for i in range(100)], "v double")
    assert tuple(Q.index_quartiles(df, (), "v").first()) == (0.0, 1.0, 3.0, 5.0, 6.0, 4.0)
    assert Q.median(df, (), "v").first()["median"] == 3.0
    empty = df.where("v > 100")
    assert Q.median(empty, (), "v").first()["median"] is None
    assert Q.median(empty.selectExpr("v", "'k' AS k"), ("k",), "v").count() == 0


def test_rows_are_not_grouped_or_sorted_by_value(spark):
    df = spark.createDataFrame([("k", float(i)) for i in range(50)], "k string, v double")
    plan = Q.median(df, ("k",), "v")._jdf.queryExecution().optimizedPlan().toString()
    assert not re.search(r"(Aggregate|Sort|Window) \[[^\]]*_v#", plan)
