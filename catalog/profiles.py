"""Queries that profile sheets and infer their layout."""

from __future__ import annotations

from finfacts.functions.rules import (
    BLOCKED_GROUP_COLUMN,
    COLUMN_KEYWORDS,
    PREFERRED_GROUP_COLUMNS,
    RESCUE_POINTS,
    SLOT_RULES,
)
from finfacts.operators import profile as I

from . import fixtures as fx
from .registry import query
from .sqltext import any_sql, case_sql, coerce_sql, sheet_number_sql, squeeze_sql

KEY = ("company",)
SHEETS = {
    "sales": ("fx_sales", ["seq", "region", "year", "amount", "cost"], ""),
    "long": ("fx_long", ["seq", "year", "metric", "value", "raw", "currency"], "company"),
    "wide": ("fx_wide", ["seq", "Year", *fx.WIDE_CELLS, "Remarks"], "company"),
}


def frame(spark, sf, name):
    build = {"sales": fx.sales, "long": fx.long_sheet, "wide": fx.wide}[name]
    return build(spark, sf)


def profile_ctes(name: str) -> tuple[str, ...]:
    source, columns, key = SHEETS[name]
    k = f"{key}, " if key else ""
    cells = " UNION ALL ".join(
        f"SELECT {k}{i} AS position, '{c}' AS \"column\", lower(trim(CAST(\"{c}\" AS STRING))) AS t FROM {source}"
        for i, c in enumerate(columns)
    )
    return (
        f"cells AS ({cells})",
        f"prof AS (SELECT {k}position, \"column\", count(*) AS rows, count(*) FILTER (t <> '') AS filled, count(*) FILTER (t <> '' "
        f"AND {coerce_sql('t')} IS NOT NULL) AS numeric, count(*) FILTER (regexp_full_match(t, '(fy\\s*)?(19|20)[0-9]{{2}}')) "
        "AS year_like, count(DISTINCT t) FILTER (t <> '' AND NOT regexp_full_match(replace(t, ',', ''), "
        "'[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)')) AS labels, count(DISTINCT CASE WHEN "
        "try_cast(regexp_extract(t, '((?:19|20)[0-9]{2})', 1) AS INTEGER) BETWEEN 1990 AND 2100 THEN "
        f"regexp_extract(t, '((?:19|20)[0-9]{{2}})', 1) END) AS years FROM cells GROUP BY {k}position, \"column\")",
    )


for _name, (_source, _columns, _key) in SHEETS.items():
    _view = _name

    @query(f"i1_profile_columns_{_name}", fx.with_views(_view, "SELECT * FROM prof", *profile_ctes(_name)))
    def profile_columns(spark, sf, _name=_name, _key=_key):
        return I.profile_columns(frame(spark, sf, _name), (_key,) if _key else ())

    _k = f"{_key}, " if _key else ""
    _g = f"GROUP BY {_key}" if _key else ""
    _pref = "CASE lower(trim(\"column\")) " + " ".join(
        f"WHEN '{c}' THEN {i}" for i, c in enumerate(PREFERRED_GROUP_COLUMNS)
    ) + " END"
    _flags = (
        f"flags AS (SELECT *, lower(trim(\"column\")) AS name, filled > 0 AND year_like >= filled * 0.5 AS half, "
        f"regexp_matches(lower(trim(\"column\")), 'year$|^fy$') AS named, regexp_matches(lower(trim(\"column\")), "
        f"'{BLOCKED_GROUP_COLUMN}') AS blocked, {_pref} AS pref, numeric > 0 AND NOT contains(lower(trim(\"column\")), 'year') "
        f"AS num, {case_sql(squeeze_sql(chr(34) + 'column' + chr(34)), SLOT_RULES)} AS slot FROM prof)"
    )
    _picked = (
        f"picked AS (SELECT {_k}first(\"column\" ORDER BY named DESC, position) FILTER (half) AS year_column, "
        "max(\"column\") FILTER (name = 'year') AS y, max(years) FILTER (name = 'year') AS yn, max(labels) FILTER (name = 'metric') "
        "AS m, count(*) FILTER (name = 'value') AS v, first(\"column\" ORDER BY pref, position) FILTER (pref IS NOT NULL AND NOT "
        "blocked AND labels >= 2) AS preferred, first(\"column\" ORDER BY labels DESC, position) FILTER (NOT blocked AND labels >= 1) "
        "AS most, first(\"column\" ORDER BY position) AS head, list(\"column\" ORDER BY position) FILTER (num) AS nums, "
        f"count(slot) AS slots FROM flags {_g})"
    )

    @query(
        f"i2_infer_layout_{_name}",
        fx.with_views(
            _view,
            f"SELECT {_k}CASE WHEN y IS NOT NULL AND m IS NOT NULL AND v > 0 THEN 'long' WHEN year_column IS NOT NULL AND slots >= 2 "
            "THEN 'wide' ELSE 'generic' END AS layout, year_column, CASE WHEN y IS NOT NULL AND m IS NOT NULL AND v > 0 AND yn >= 2 "
            "THEN y WHEN preferred IS NOT NULL THEN preferred WHEN m < 2 AND yn >= 2 THEN y ELSE coalesce(most, y, head) END AS "
            "group_column, nums[1] AS value_column, coalesce(list_filter(nums[2:], lambda c: regexp_matches(lower(c), "
            "'expense|cost|expenditure'))[1], nums[2], nums[1]) AS second_column FROM picked",
            *profile_ctes(_name), _flags, _picked,
        ),
    )
    def infer_layout(spark, sf, _name=_name, _key=_key):
        keys = (_key,) if _key else ()
        return I.infer_layout(I.profile_columns(frame(spark, sf, _name), keys), keys)


_RANK = "CASE " + " ".join(
    f"WHEN contains(lower(\"column\"), '{w}') THEN {i}" for i, w in enumerate(COLUMN_KEYWORDS["profit"])
) + " END"


@query(
    "i2_keyword_column",
    fx.with_views(
        "wide",
        f"SELECT company, first(\"column\" ORDER BY r, position) AS \"column\" FROM (SELECT *, {_RANK} AS r FROM prof) "
        "WHERE r IS NOT NULL GROUP BY company",
        *profile_ctes("wide"),
    ),
)
def keyword_column(spark, sf):
    return I.keyword_column(I.profile_columns(fx.wide(spark, sf), KEY), "profit", KEY)


_POINTS = " + ".join(
    f"CASE WHEN {any_sql('c', [alt])} THEN {points} ELSE 0 END" for points, alt in RESCUE_POINTS
)
_WIDE_COLUMNS = ["seq", *fx.WIDE_CELLS, "Remarks"]


@query(
    "c2_rescue_score",
    fx.with_views(
        "wide",
        "SELECT company, first(\"column\" ORDER BY score DESC, position) AS \"column\", max(score) AS score FROM (SELECT *, "
        f"{_POINTS} + least(15, numeric_rows) AS score FROM (SELECT *, {squeeze_sql(chr(34) + 'column' + chr(34))} AS c FROM seen) "
        "WHERE numeric_rows >= greatest(1, floor(n * 0.4))) WHERE score >= 50 GROUP BY company",
        "seen AS (" + " UNION ALL ".join(
            f"SELECT company, {i} AS position, '{c}' AS \"column\", count(*) AS n, count({sheet_number_sql(f'CAST({chr(34)}{c}{chr(34)} AS STRING)')}) "
            "AS numeric_rows FROM fx_wide GROUP BY company"
            for i, c in enumerate(_WIDE_COLUMNS)
        ) + ")",
    ),
)
def rescue_score(spark, sf):
    return I.rescue_score(fx.wide(spark, sf), "Year", KEY)


@query(
    "c9_currency_of_columns",
    fx.with_views(
        "long",
        "SELECT company, CASE upper(coalesce(c, '')) WHEN 'USD' THEN '$' WHEN 'EUR' THEN '€' WHEN 'GBP' THEN '£' ELSE '₹' END "
        "AS symbol FROM (SELECT company, first(currency ORDER BY seq) AS c FROM fx_long GROUP BY company)",
    ),
)
def currency_of_columns(spark, sf):
    return I.currency_of_columns(fx.long_sheet(spark, sf), "seq", KEY)
