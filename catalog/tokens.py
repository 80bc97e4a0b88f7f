"""Queries over OCR tokens: boxes, roles, lines, readings and their scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from finfacts.functions.boxes import bbox_norm, bbox_xyxy
from finfacts.functions.labels import line_class, token_role
from finfacts.functions.rules import LINE_CLASS_RULES, TOKEN_METRIC_WORDS, UNIT_MULTIPLIERS
from finfacts.operators import tokens as T
from finfacts.plans.answers import image_facts
from finfacts.plans.extraction import token_facts
from finfacts.stored import written

from . import fixtures as fx
from .registry import query
from .sqltext import any_sql, case_sql, rnd, squeeze_sql, xavg

DOC = ("doc_id",)
PAGE = ("doc_id", "page")


@query(
    "c20_boxes",
    fx.with_views(
        "tokens",
        "SELECT doc_id, page, seq, x0, y0, x0 + 80 AS x1, y0 + 16 AS y1, "
        + ", ".join(
            f"least(greatest(CAST(trunc(({e}) * 1000e0 / {size}) AS INTEGER), 0), 1000) AS {n}"
            for n, e, size in (("n0", "x0", "page_width"), ("m0", "y0", "page_height"), ("n1", "x0 + 80", "page_width"),
                               ("m1", "y0 + 16", "page_height"))
        )
        + " FROM fx_tokens",
    ),
)
def boxes(spark, sf):
    rows = fx.tokens(spark, sf).withColumn("_b", bbox_xyxy("bbox"))
    rows = rows.withColumn("_n", bbox_norm("_b", "page_width", "page_height"))
    return rows.select(
        *PAGE, "seq", F.col("_b.x0").alias("x0"), F.col("_b.y0").alias("y0"), F.col("_b.x1").alias("x1"),
        F.col("_b.y1").alias("y1"), F.col("_n.x0").alias("n0"), F.col("_n.y0").alias("m0"), F.col("_n.x1").alias("n1"),
        F.col("_n.y1").alias("m1"),
    )


_T = "trim(replace(lower(trim(text)), '₹', ''))"
_COMPACT = f"regexp_replace({_T}, '[,\\s]', '', 'g')"
ROLE = (
    f"(CASE WHEN regexp_matches({_T}, 'fy\\s*20[0-9]{{2}}') OR regexp_full_match({_T}, '20[0-9]{{2}}') OR "
    f"regexp_full_match({_T}, 'fy\\s*[0-9]{{2}}') THEN 'YEAR' WHEN regexp_full_match({_COMPACT}, '[0-9().\\-]+') AND "
    f"regexp_matches({_COMPACT}, '[0-9]{{3}}') THEN 'VALUE' WHEN regexp_matches({_T}, '{'|'.join(TOKEN_METRIC_WORDS)}') THEN 'METRIC' "
    "ELSE 'O' END)"
)


@query("c8_token_role", fx.with_views("tokens", f"SELECT doc_id, page, seq, text, {ROLE} AS role FROM fx_tokens"))
def roles(spark, sf):
    return fx.tokens(spark, sf).select(*PAGE, "seq", "text", token_role("text").alias("role"))


@query(
    "c8_token_labels",
    fx.with_views(
        "tokens",
        f"SELECT doc_id, page, seq, CASE WHEN (seq % 10) / 10e0 >= 0.5e0 THEN 'METRIC' ELSE {ROLE} END "
        "AS role FROM fx_tokens",
    ),
)
def token_labels(spark, sf):
    rows = fx.tokens(spark, sf)
    given = rows.select(
        *PAGE, "seq", F.lit("METRIC").alias("label"), ((F.col("seq") % 10) / 10).alias("confidence")
    )
    return T.token_labels(rows, given).select(*PAGE, "seq", "role")


SURE = (
    "sure AS (SELECT *, count(*) FILTER (confidence >= 0.5e0) OVER (PARTITION BY doc_id, page) AS n FROM fx_tokens "
    "WHERE trim(text) <> '')",
    "kept AS (SELECT * FROM sure WHERE confidence >= 0.5e0 OR (n < 2 AND confidence >= 0.4e0))",
)


@query("d10_confident_tokens", fx.with_views("tokens", "SELECT doc_id, page, seq, text, confidence FROM kept", *SURE))
def confident_tokens(spark, sf):
    return T.confident_tokens(fx.tokens(spark, sf)).select(*PAGE, "seq", "text", "confidence")


# The tokens lie within a few points of their line and lines are 60 apart, so the true line number is known.
MERGED = (
    "merged AS (SELECT doc_id, page, dense_rank() OVER (PARTITION BY doc_id, page ORDER BY line) AS line, text, weakest FROM "
    "(SELECT doc_id, page, line, string_agg(trim(text), ' ' ORDER BY x0) AS text, min(confidence) AS weakest "
    "FROM {source} WHERE trim(text) <> '' GROUP BY ALL))"
)


@query(
    "d9_merge_tokens",
    fx.with_views("tokens", "SELECT doc_id, page, line, text FROM merged", MERGED.format(source="fx_tokens")),
)
def merge_tokens(spark, sf):
    return T.merge_tokens(fx.tokens(spark, sf))


@query(
    "g25_confidence_summary",
    fx.with_views(
        "tokens",
        f"SELECT doc_id, page, {rnd('m', 4)} AS avg_confidence, CASE WHEN m >= 0.65e0 THEN 'High' WHEN m >= 0.45e0 THEN "
        "'Medium' ELSE 'Low' END AS grade, coalesce(hi, 0) AS high_confidence_rows FROM (SELECT doc_id, page, "
        f"{xavg('confidence')} AS m FROM fx_tokens GROUP BY ALL) LEFT JOIN (SELECT doc_id, page, count(*) FILTER "
        "(weakest >= 0.6e0) AS hi FROM merged GROUP BY ALL) USING (doc_id, page)",
        MERGED.format(source="fx_tokens"),
    ),
)
def confidence_summary(spark, sf):
    return T.confidence_summary(fx.tokens(spark, sf))


# --- reading lines --------------------------------------------------------------------------------

CLEAN = (
    "trim(regexp_replace(regexp_replace(regexp_replace(replace({t}, '₹', ''), '(?i)rs\\.\\s*', '', 'g'), "
    "'(?i)\\brs\\b\\s*', '', 'g'), '\\s+', ' ', 'g'))"
)
INTS = (
    "list_filter(list_transform(regexp_extract_all({t}, '[0-9][0-9,]*'), lambda t: try_cast(replace(t, ',', '') AS BIGINT)), "
    "lambda n: n IS NOT NULL)"
)
MULT = "(CASE " + " ".join(
    f"WHEN {any_sql('lower({t})', list(words))} THEN {factor:.1f}e0" for factor, words in UNIT_MULTIPLIERS
) + " ELSE 1e0 END)"


def line_cur_sql(t: str) -> str:
    low = f"lower({t})"
    return (
        f"(CASE WHEN contains({t}, '₹') OR contains({low}, 'inr') OR regexp_matches({low}, '\\brs\\b') OR "
        f"contains({low}, 'rupee') THEN 'INR' WHEN contains({t}, '$') OR contains({low}, 'usd') THEN 'USD' WHEN "
        f"contains({t}, '€') OR contains({low}, 'eur') THEN 'EUR' END)"
    )


def fill(template: str, **kw: str) -> str:
    for k, v in kw.items():
        template = template.replace("{" + k + "}", v)
    return template


LINE_READ = (
    f"l1 AS (SELECT doc_id, line, text, {fill(CLEAN, t='text')} AS raw FROM src)",
    f"l2 AS (SELECT *, CAST(nullif(regexp_extract(raw, '(20[0-9]{{2}})', 1), '') AS INTEGER) AS year, {fill(INTS, t='raw')} "
    f"AS ints, {fill(MULT, t='raw')} AS mult, {squeeze_sql('raw')} AS sq, coalesce({line_cur_sql('text')}, "
    f"{line_cur_sql('raw')}) AS cur FROM l1)",
    f"l3 AS (SELECT *, list_filter(ints, lambda n: NOT n BETWEEN 1900 AND 2100) AS amts, {case_sql('sq', LINE_CLASS_RULES, chr(39) + 'other' + chr(39))} "
    "AS cls, coalesce(list_position(ints, year), 0) AS yp FROM l2 WHERE year IS NOT NULL)",
    "l4 AS (SELECT *, CASE WHEN len(amts) > 0 THEN list_max(amts) ELSE list_max(ints) END AS best, "
    "list_filter(CASE WHEN yp > 0 THEN ints[:yp - 1] || ints[yp + 1:] ELSE ints END, lambda n: n >= 1000) AS large, "
    "list_filter(list_transform(regexp_extract_all(raw, '[0-9]+'), lambda t: try_cast(t AS BIGINT)), lambda n: n > 1000) AS big "
    "FROM l3)",
    "l5 AS (SELECT *, CASE WHEN mult <> 1 THEN CAST(round_even(best * mult, 0) AS BIGINT) WHEN best >= 1000 THEN best END AS v, "
    "CASE WHEN len(large) >= 3 THEN large[1] END AS wide FROM l4)",
    "l6 AS (SELECT doc_id, line, year, raw, cur, CASE WHEN cls = 'other' AND (wide IS NOT NULL OR len(big) >= 2) THEN 'revenue' "
    "ELSE cls END AS metric, CASE WHEN cls IN ('revenue', 'other') AND wide IS NOT NULL THEN wide WHEN cls = 'other' AND "
    "len(big) >= 2 THEN list_max(big) ELSE v END AS value FROM l5)",
    "l7 AS (SELECT * FROM l6 WHERE value IS NOT NULL)",
    "cur1 AS (SELECT doc_id, cur AS main FROM (SELECT doc_id, cur, row_number() OVER (PARTITION BY doc_id ORDER BY count(*) "
    "DESC, cur) AS rn FROM l7 WHERE cur IS NOT NULL GROUP BY doc_id, cur) WHERE rn = 1)",
    "facts_read AS (SELECT doc_id, line, year, metric, value, coalesce(cur, main) AS currency, raw FROM l7 LEFT JOIN cur1 "
    "USING (doc_id))",
)


@query(
    "d11_line_facts",
    fx.with_views("lines", "SELECT * FROM facts_read", "src AS (SELECT ck AS doc_id, id AS line, text FROM fx_lines)", *LINE_READ),
)
def line_facts(spark, sf):
    rows = fx.text_lines(spark, sf).select(F.col("ck").alias("doc_id"), F.col("id").alias("line"), "text")
    return T.line_facts(rows, DOC)


_RULE_CLASS = case_sql("sq", LINE_CLASS_RULES, "'other'")
# A model that calls every line profit, as sure as the last two digits of its number say.
PREDICTED = tuple(t.replace(f"{_RULE_CLASS} AS cls", f"CASE WHEN line % 100 >= 60 THEN 'profit' ELSE {_RULE_CLASS} END AS cls") for t in LINE_READ)


@query(
    "d11_line_facts_with_predictions",
    fx.with_views("lines", "SELECT * FROM facts_read", "src AS (SELECT ck AS doc_id, id AS line, text FROM fx_lines)", *PREDICTED),
)
def line_facts_predicted(spark, sf):
    # The lines are built once, for the reader and for the model's classes.
    rows = written(fx.text_lines(spark, sf).select(F.col("ck").alias("doc_id"), F.col("id").alias("line"), "text"), "lines")
    given = rows.select(
        "doc_id", "line", F.lit("profit").alias("label"), (F.col("line") % 100 / 100).alias("confidence")
    )
    return T.line_facts(rows, DOC, given)


@query(
    "d11_token_facts",
    fx.with_views(
        "tokens",
        "SELECT doc_id, line, year, metric, value, currency, raw FROM facts_read",
        *SURE,
        MERGED.format(source="kept"),
        "src AS (SELECT doc_id, line, text FROM merged)",
        *LINE_READ,
    ),
)
def token_page_facts(spark, sf):
    return token_facts(fx.tokens(spark, sf))


# Two readings of a document: all lines, and those whose id the other reader caught (with one repeat).
def readings(spark, sf):
    lines = fx.text_lines(spark, sf).select(
        F.col("ck").alias("doc_id"), "id", F.col("yr").cast("int").alias("year"), F.col("ck").alias("_k"),
        F.when(F.col("id") % 70 != 0, line_class("text")).alias("metric"),
        F.when(F.col("id") % 50 != 0, F.col("id").cast("double")).alias("value"),
    )
    caught = F.array(
        F.when(F.expr("_k % 8 <> 3 AND id % 30 <> 0"), F.lit("baseline")),
        F.when(F.expr("_k % 8 <> 5 AND (id % 20 = 0 OR _k % 2 = 0)"), F.lit("layout")),
    )
    # One pass: each line goes to the readings that caught it.
    return lines.select("doc_id", "id", "year", "metric", "value", F.explode(F.array_compact(caught)).alias("method"))


READINGS = (
    "rd0 AS (SELECT ck AS doc_id, id, CAST(yr AS INTEGER) AS year, CASE WHEN id % 70 <> 0 THEN cls END AS metric, "
    "CASE WHEN id % 50 <> 0 THEN CAST(id AS DOUBLE) END AS value FROM (SELECT *, "
    f"{case_sql('sq', LINE_CLASS_RULES, chr(39) + 'other' + chr(39))} AS cls FROM (SELECT *, {squeeze_sql('text')} AS sq FROM fx_lines)))",
    "rd AS (SELECT *, 'baseline' AS method FROM rd0 WHERE doc_id % 8 <> 3 AND id % 30 <> 0 UNION ALL SELECT *, 'layout' FROM rd0 "
    "WHERE doc_id % 8 <> 5 AND (id % 20 = 0 OR doc_id % 2 = 0))",
    "scores AS (SELECT doc_id, method, count(*) AS rows, "
    + rnd(
        "2e0 * count(*) + 20e0 * ((count(*) FILTER (year BETWEEN 1990 AND 2035) + count(*) FILTER (coalesce(value, 0) <> 0) + "
        "count(*) FILTER (m <> '')) / (3e0 * count(*))) + count(DISTINCT (year, m)) FILTER (m <> '') - 2e0 * (count(*) FILTER "
        "(m <> '') - count(DISTINCT (year, m)) FILTER (m <> ''))",
        3,
    )
    + " AS score FROM (SELECT *, lower(trim(coalesce(metric, ''))) AS m FROM rd) GROUP BY ALL)",
)


def score_sql(source: str) -> str:
    """Quality of each reading: rows, filled fields, distinct (year, metric) pairs and repeats."""
    pairs = "count(DISTINCT (year, m)) FILTER (m <> '' AND year IS NOT NULL)"
    filled = "(count(*) FILTER (year BETWEEN 1990 AND 2035) + count(*) FILTER (coalesce(value, 0) <> 0) + count(*) FILTER (m <> ''))"
    score = f"2e0 * count(*) + 20e0 * ({filled} / (3e0 * count(*))) + {pairs} - 2e0 * (count(*) FILTER (m <> '' AND year IS NOT NULL) - {pairs})"
    return f"SELECT key, {rnd(score, 3)} AS score FROM (SELECT doc_id AS key, *, lower(trim(coalesce(metric, ''))) AS m FROM {source}) GROUP BY key"


# A reading of a document is a document of its own up to the choice between the two.
IMAGES = (
    "both_read AS (SELECT *, 'baseline' AS method FROM fx_tokens UNION ALL SELECT * REPLACE (least(1e0, confidence + 0.1e0) AS confidence), 'layout' FROM "
    "fx_tokens WHERE seq % 7 <> 0)",
    "sure_read AS (SELECT *, count(*) FILTER (confidence >= 0.5e0) OVER (PARTITION BY doc_id, page, method) AS n FROM both_read WHERE trim(text) <> '')",
    "lines_read AS (SELECT doc_id, page, method, dense_rank() OVER (PARTITION BY doc_id, page, method ORDER BY line) AS line, text FROM (SELECT doc_id, page, "
    "method, line, string_agg(trim(text), ' ' ORDER BY x0) AS text FROM sure_read WHERE confidence >= 0.5e0 OR (n < 2 AND confidence >= 0.4e0) GROUP BY ALL))",
    "src AS (SELECT {'d': doc_id, 'm': method} AS doc_id, {'page': page, 'line': line} AS line, text FROM lines_read)",
)
CHOSEN = (
    f"marks AS ({score_sql('facts_read')})",
    "sides AS (SELECT key.d AS d, max(score) FILTER (key.m = 'baseline') AS b, max(score) FILTER (key.m = 'layout') AS o FROM marks GROUP BY ALL)",
    "better AS (SELECT {'d': d, 'm': CASE WHEN o IS NOT NULL AND (b IS NULL OR o >= b + 3) THEN 'layout' ELSE 'baseline' END} AS doc_id FROM sides)",
    "ranked AS (SELECT *, row_number() OVER (PARTITION BY doc_id.d, year, metric, value ORDER BY line) AS rn FROM facts_read WHERE doc_id IN (SELECT doc_id "
    "FROM better) AND year >= 2000 AND value >= 0)",
)


@query(
    "image_facts_of_two_readings",
    fx.with_views(
        "tokens",
        "SELECT doc_id.d AS doc_id, doc_id.m AS method, line.page AS page, line.line AS line, year, metric, value, currency, raw FROM ranked WHERE rn = 1",
        *IMAGES, *LINE_READ, *CHOSEN,
    ),
)
def image_facts_of_two_readings(spark, sf):
    """All tokens, and those that a second reader caught, more surely."""
    tokens = fx.tokens(spark, sf)
    # One pass: each token goes to the readings that caught it.
    caught = F.array_compact(F.array(F.lit("baseline"), F.when(F.col("seq") % 7 != 0, F.lit("layout"))))
    both = tokens.withColumn("method", F.explode(caught)).withColumn("confidence", F.when(
        F.col("method") == "layout", F.least(F.lit(1.0), F.col("confidence") + 0.1)).otherwise(F.col("confidence")))
    rows = image_facts(both)
    return rows.select("doc_id", "method", F.col("line.page").alias("page"), F.col("line.line").alias("line"), "year", "metric", "value", "currency", "raw")


@query("d12_quality_score", fx.with_views("lines", "SELECT doc_id, method, rows, score FROM scores", *READINGS))
def quality_score(spark, sf):
    return T.quality_score(readings(spark, sf), DOC)


@query(
    "d13_pick_method",
    fx.with_views(
        "lines",
        "SELECT rd.doc_id, rd.id, rd.method, rd.year, rd.metric, rd.value FROM rd JOIN (SELECT doc_id, CASE WHEN o IS NOT NULL "
        "AND (b IS NULL OR o >= b + 3) THEN 'layout' ELSE 'baseline' END AS method FROM (SELECT doc_id, max(score) FILTER "
        "(method = 'baseline') AS b, max(score) FILTER (method = 'layout') AS o FROM scores GROUP BY doc_id)) p "
        "ON rd.doc_id = p.doc_id AND rd.method = p.method",
        *READINGS,
    ),
)
def pick_method(spark, sf):
    return T.pick_method(readings(spark, sf), DOC).select("doc_id", "id", "method", "year", "metric", "value")


@query(
    "m7_check_token_samples",
    fx.with_views(
        "tokens",
        "SELECT doc_id, page, CASE WHEN n % 5 = 0 THEN 'counts differ' ELSE 'unknown label' END AS problem FROM (SELECT doc_id, "
        "page, count(*) AS n FROM fx_tokens GROUP BY ALL) WHERE n % 5 = 0 OR n % 7 = 0",
    ),
)
def check_token_samples(spark, sf):
    rows = fx.tokens(spark, sf).withColumn("label", token_role("text"))
    # A token travels with its corner; the four corners of its box are eight numbers, worked out where the page is together.
    pages = rows.groupBy(*PAGE).agg(F.collect_list(F.struct("text", "label", "x0", "y0")).alias("_t"), F.count(F.lit(1)).alias("n"))
    samples = pages.select(
        *PAGE, F.filter(F.transform("_t", lambda t: t["text"]), lambda w: w.isNotNull()).alias("words"),
        F.transform("_t", lambda t: t["label"]).alias("labels"),
        F.transform("_t", lambda t: fx.token_box(t["x0"], t["y0"])).alias("bboxes"), "n",
    )
    samples = samples.withColumn("labels", F.when(F.col("n") % 5 == 0, F.slice("labels", 2, F.size("labels") - 1)).when(
        F.col("n") % 7 == 0, F.transform("labels", lambda t, i: F.when(i == 0, "B-NAME").otherwise(t))
    ).otherwise(F.col("labels")))
    return T.check_token_samples(samples).select(*PAGE, "problem")
