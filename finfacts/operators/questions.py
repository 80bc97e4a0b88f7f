"""Tags for logs of questions: which ratio, intent or series each one asks for."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import question_rules as Q
from ..functions import rules as R
from ..functions.labels import fix_typos
from ..functions.periods import year_range

KINDS = {"sheet": Q.SHEET_KINDS, "server": Q.SERVER_KINDS}


def tag_formula_kinds(df: DataFrame, text: str = "text", profile: str = "sheet", out: str = "kinds") -> DataFrame:
    """Add the array of ratio kinds a question asks for; NULL when it asks for none."""
    low = fix_typos(text) if profile == "sheet" else F.lower(text)
    staged = df.withColumn("_low", low)
    return staged.withColumn(out, F.split(R.first_match(F.col("_low"), KINDS[profile]), ",")).drop("_low")


def tag_intents(df: DataFrame, text: str = "text") -> DataFrame:
    """Add one boolean per intent."""
    staged = df.withColumn("_low", fix_typos(text))
    flags = {name: R.match_any(F.col("_low"), words) for name, words in Q.INTENTS.items()}
    return staged.withColumns(flags).drop("_low")


def tag_fact_question(df: DataFrame, text: str = "text", out: str = "route") -> DataFrame:
    """Add the series a fact question is answered from: ``formula``, one of the fact routes, or ``latest``."""
    staged = df.withColumn("_low", F.lower(text))
    formula = R.first_match(F.col("_low"), Q.SERVER_KINDS)
    route = F.when(formula.isNotNull(), "formula").otherwise(R.first_match(F.col("_low"), Q.FACT_ROUTES, "latest"))
    return staged.withColumn(out, route).drop("_low")


def tag_year_range(df: DataFrame, text: str = "text") -> DataFrame:
    """Add the inclusive year range a question names."""
    staged = df.withColumn("_range", year_range(text))
    return staged.withColumns({"year_lo": F.col("_range.lo"), "year_hi": F.col("_range.hi")}).drop("_range")
