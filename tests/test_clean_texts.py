"""Texts are cleaned with patterns only where they hold what a pattern looks for."""

import re

from pyspark.sql import functions as F

from finfacts.functions import labels as C

TEXTS = ["Net  Profit (FY 2019)", "a(b)c(d", "  Others\t\n2019 ", "RS. 5 rs 6 Rrs.s 7", "Rs.\n1,20,000", "first₹years", "₹ 412,345 6155", "É(x)é z", "(", "",
         "Rs", "x\x0by\fz\r", "r₹s. 9", None]


def test_one_pattern_per_step_of_a_label(spark):
    text = str(C.clean_label(F.col("t")))
    assert text.count("regexp_replace") == 2
    assert str(C.clean_line(F.col("t"))).count("₹") == 1 and "regexp_replace(t, ₹" not in str(C.clean_line(F.col("t")))


def test_cleaned_as_step_by_step(spark):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "i int, t string")
    got = rows.select("i", C.clean_label("t").alias("label"), C.clean_line("t").alias("line")).orderBy("i").collect()
    blank = r"[ \t\n\x0b\f\r]"
    for text, row in zip(TEXTS, got, strict=True):
        label = re.sub(r"\(.*?\)", "", (text or "").lower())
        label = re.sub(f"{blank}+", " ", re.sub(r"[^a-z \t\n\x0b\f\r]", " ", label)).strip(" ")
        line = None
        if text is not None:
            line = re.sub(rf"(?i)\brs\b{blank}*", "", re.sub(rf"(?i)rs\.{blank}*", "", text.replace("₹", "")))
            line = re.sub(f"{blank}+", " ", line).strip(" ")
        assert (row["label"], row["line"]) == (label, line)
