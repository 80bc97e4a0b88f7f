"""Small helpers that write DuckDB text for the oracles."""

from __future__ import annotations

from finfacts.functions.rules import Alternative, Rule, is_literal


def rnd(expr: str, digits: int = 0) -> str:
    """Half-up rounding on doubles."""
    scale = f"{10**digits}e0"
    return f"(floor(CAST({expr} AS DOUBLE) * {scale} + 0.5e0) / {scale})"


def div(num: str, den: str) -> str:
    return f"(({num}) / nullif({den}, 0))"


def pct(num: str, den: str, digits: int = 2) -> str:
    return rnd(f"100e0 * ({num}) / nullif({den}, 0)", digits)


def xsum(expr: str) -> str:
    """Order-independent sum."""
    whole = f"CAST({expr} AS DECIMAL(32,6))"
    rest = f"CAST((CAST({expr} AS DOUBLE) - CAST({whole} AS DOUBLE)) * 1e6 AS DECIMAL(32,6))"
    return f"(CAST(sum({whole}) AS DOUBLE) + CAST(sum({rest}) AS DOUBLE) / 1e6)"


def xavg(expr: str) -> str:
    return f"({xsum(expr)} / nullif(count({expr}), 0))"


def quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def match_sql(col: str, pattern: str) -> str:
    if pattern.startswith("!"):
        return f"NOT {match_sql(col, pattern[1:])}"
    if pattern.startswith("~"):
        return match_sql(f"regexp_replace({col}, '[^a-z]', '', 'g')", pattern[1:])
    if is_literal(pattern):
        return f"contains({col}, {quote(pattern)})"
    return f"regexp_matches({col}, {quote(pattern)})"


def any_sql(col: str, alternatives: list[Alternative]) -> str:
    tests = []
    for alt in alternatives:
        parts = (alt,) if isinstance(alt, str) else alt
        tests.append("(" + " AND ".join(match_sql(col, p) for p in parts) + ")")
    return "(" + " OR ".join(tests) + ")"


def case_sql(col: str, rules: list[Rule], default: str = "NULL") -> str:
    arms = " ".join(f"WHEN {any_sql(col, list(alts))} THEN {quote(result)}" for result, alts in rules)
    return f"(CASE {arms} ELSE {default} END)"


def squeeze_sql(col: str) -> str:
    return f"lower(trim(regexp_replace({col}, '\\s+', ' ', 'g')))"


def fiscal_key_sql(col: str) -> str:
    return (
        f"try_cast(coalesce(nullif(regexp_extract(trim({col}), '(?i)FY\\s*((?:19|20)[0-9]{{2}})', 1), ''), "
        f"nullif(regexp_extract(trim({col}), '\\b((?:19|20)[0-9]{{2}})\\b', 1), ''), "
        f"nullif(regexp_extract(trim({col}), '^([+-]?[0-9]+)', 1), '')) AS INTEGER)"
    )


def fiscal_order_sql(col: str = "period") -> str:
    return f"{fiscal_key_sql(col)} ASC NULLS LAST, {col} ASC"


LEADING = r"^[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?"


def leading_sql(text: str) -> str:
    return f"try_cast(regexp_extract({text}, '{LEADING}') AS DOUBLE)"


def coerce_sql(col: str) -> str:
    """A sheet cell that is a number once marks are gone."""
    body = (
        f"regexp_replace(regexp_replace(regexp_replace(trim({col}), '[,₹$€£¥]', '', 'g'), '(?i)^rs\\.?\\s*', ''), "
        f"'\\s+', '', 'g')"
    )
    return (
        f"(CASE WHEN regexp_full_match({body}, '[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?') "
        f"THEN try_cast({body} AS DOUBLE) END)"
    )


def sheet_number_sql(col: str) -> str:
    text = f"trim({col})"
    body = f"regexp_replace({text}, '^\\((.*)\\)$', '\\1')"
    body = f"replace(regexp_replace(regexp_replace({body}, '[₹$€£¥\\s]', '', 'g'), '(?i)^rs\\.?', ''), ',', '')"
    number = f"coalesce({leading_sql(body)}, {leading_sql(f'''regexp_replace({body}, '[^0-9.\\-]', '', 'g')''')})"
    return (
        f"(CASE WHEN lower({text}) IN ('', '-', '—', 'na', 'n/a') THEN NULL "
        f"WHEN starts_with({text}, '(') AND ends_with({text}, ')') THEN -{number} ELSE {number} END)"
    )


def ledger_number_sql(col: str) -> str:
    text = f"regexp_replace(trim({col}), '^\\((.*)\\)$', '-\\1')"
    return f"try_cast(regexp_replace({text}, '[^0-9.\\-]', '', 'g') AS DOUBLE)"


def dashboard_number_sql(col: str) -> str:
    text = f"regexp_replace({col}, '[,₹$€£¥\\s]', '', 'g')"
    return f"coalesce({leading_sql(text)}, 0e0)"


def _group_sql(text: str, pattern: str, group: int = 1) -> str:
    return f"nullif(regexp_extract({text}, '{pattern}', {group}), '')"


def period_of_sql(text: str) -> str:
    """Year a period token ends in."""

    def span(pattern: str) -> str:
        a, b = _group_sql(text, pattern, 1), _group_sql(text, pattern, 2)
        return f"(CASE WHEN length({b}) = 2 THEN substr({a}, 1, 2) || {b} ELSE {b} END)"

    return (
        f"coalesce({span('(?i)fy\\s*([0-9]{4})[^0-9]+([0-9]{2,4})')}, {_group_sql(text, '\\b((?:19|20)[0-9]{2})\\b')}, "
        f"{span('([0-9]{4})[^0-9]+([0-9]{2,4})')})"
    )


def header_year_sql(text: str) -> str:
    low = f"lower({text})"
    return (
        f"coalesce({_group_sql(low, '\\b(20[0-9]{2})\\b')}, '20' || {_group_sql(low, '\\bfy\\s?([0-9]{2})\\b')}, "
        f"'20' || {_group_sql(low, '\\b[0-9]{2}-([0-9]{2})\\b')}, {period_of_sql(text)})"
    )
