"""Steps of a loop over rows are bound once."""

from pyspark.sql import functions as F

from finfacts.functions import periods
from finfacts.operators import documents as D


def test_a_dated_line_is_searched_once(spark):
    text = str(D._row_items(F.col("t")))
    assert text.count("[0-9][0-9,]*") == 1
    assert text.count("(20[0-9]{2})") == 1


def test_row_items_by_position(spark):
    lines = ["FY 2021 5,000 3,000 2,000", "2020 5000 700", "no year 5000", "2019 4000 4000", "2018 9000 8000 7000 6000 5000"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(lines)], "i int, t string")
    got = {r["i"]: [(x["metric"], x["amount"]) for x in r["x"]] for r in rows.select("i", D._row_items(F.col("t")).alias("x")).collect()}
    assert got[0] == [("revenue", 5000.0), ("expenses", 3000.0), ("net_income", 2000.0)]
    assert got[1] == [("revenue", 5000.0)]
    assert got[2] == []
    assert got[3] == [("revenue", 4000.0)]
    assert got[4] == [("revenue", 9000.0), ("expenses", 6000.0), ("net_income", 5000.0)]


def test_header_year_searches_each_form_once(spark):
    assert str(periods.header_year(F.col("t"))).count("[0-9]{2}-([0-9]{2})") == 1


def test_cells_that_may_name_a_year_hold_all_that_do(spark):
    cells = ["FY23", "fy 23", "22-23", "2022-23", "FY2021-22", "Mar 2019", "1998/1999", "1234,56", "12,345.67", "Fy  2020 to 21", "", None, "1899"]
    rows = spark.createDataFrame([(c,) for c in cells], "c string")
    got = rows.select(periods.header_year("c").alias("y"), F.col("c").rlike(periods.MAY_NAME_YEAR).alias("may")).collect()
    assert all(r["may"] for r in got if r["y"] is not None)
    assert [r["y"] for r in got] == ["2023", "2023", "2023", "2022", "2022", "2019", "1998", "1256", None, "2020", None, None, None]
