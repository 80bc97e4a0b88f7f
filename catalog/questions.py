"""Queries over a question log: phrases tied to orders, and every conversation turn."""

from __future__ import annotations

from pyspark.sql import functions as F

from finfacts.functions import labels
from finfacts.functions import question_rules as Q
from finfacts.functions.rules import TYPOS
from finfacts.operators import questions as K

from . import fixtures as fx
from .registry import query
from .sqltext import any_sql, case_sql

_FIXED = "lower(text)"
for _wrong, _right in TYPOS:
    _FIXED = f"regexp_replace({_FIXED}, '{_wrong}', '{_right}', 'g')"
LOW = f"low AS (SELECT question_id, text, lower(text) AS plain, {_FIXED} AS fixed FROM fx_questions)"


@query("c14_fix_typos", fx.with_views("questions", "SELECT question_id, fixed AS text FROM low", LOW))
def fix_typos(spark, sf):
    return fx.questions(spark, sf).select("question_id", labels.fix_typos("text").alias("text"))


for _profile, _rules in K.KINDS.items():
    _source = "fixed" if _profile == "sheet" else "plain"

    @query(
        f"k1_tag_formula_kinds_{_profile}",
        fx.with_views("questions", f"SELECT question_id, {case_sql(_source, _rules)} AS kinds FROM low", LOW),
    )
    def tag_formula_kinds(spark, sf, _profile=_profile):
        out = K.tag_formula_kinds(fx.questions(spark, sf), "text", _profile)
        return out.select("question_id", F.array_join("kinds", ",").alias("kinds"))


@query(
    "k2_tag_intents",
    fx.with_views(
        "questions",
        "SELECT question_id, " + ", ".join(f"{any_sql('fixed', words)} AS {n}" for n, words in Q.INTENTS.items()) + " FROM low",
        LOW,
    ),
)
def tag_intents(spark, sf):
    return K.tag_intents(fx.questions(spark, sf)).drop("text")


@query(
    "k3_tag_fact_question",
    fx.with_views(
        "questions",
        f"SELECT question_id, CASE WHEN {case_sql('plain', Q.SERVER_KINDS)} IS NOT NULL THEN 'formula' ELSE "
        f"{case_sql('plain', Q.FACT_ROUTES, chr(39) + 'latest' + chr(39))} END AS route FROM low",
        LOW,
    ),
)
def tag_fact_question(spark, sf):
    return K.tag_fact_question(fx.questions(spark, sf)).select("question_id", "route")


def _pick(group: int) -> str:
    forms = (
        "\\b([0-9]{4})\\s*[-–—]\\s*([0-9]{4})\\b",
        "\\bbetween\\s+([0-9]{4})\\s+and\\s+([0-9]{4})\\b",
        "\\bfrom\\s+([0-9]{4})\\s+(?:to|through|until)\\s+([0-9]{4})\\b",
    )
    return "CAST(coalesce(" + ", ".join(f"nullif(regexp_extract(plain, '{f}', {group}), '')" for f in forms) + ") AS INTEGER)"


@query(
    "c18_year_range",
    fx.with_views(
        "questions",
        f"SELECT question_id, least({_pick(1)}, {_pick(2)}) AS year_lo, greatest({_pick(1)}, {_pick(2)}) AS year_hi FROM low",
        LOW,
    ),
)
def year_range(spark, sf):
    return K.tag_year_range(fx.questions(spark, sf)).select("question_id", "year_lo", "year_hi")
