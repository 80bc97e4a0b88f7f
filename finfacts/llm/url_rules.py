"""URL rules by a sort-merge range join.

The canonical key of a rule is its host with the labels reversed, and its path: net/es/ becomes "net" and "/es/". Everything that starts
with a rule's key lies in one interval behind it, so in key order the rules that hold at a point are a stack of nested intervals. A url
has a point for its host and for every parent domain; points and rules are sorted together and swept once.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Parts into which the urls of one domain are dealt; every part has all rules of the domain.
PARTS = 64
#: Verdict where no rule fits.
DEFAULT = "allow"

#: The rules of the registered query: verdict, host, path.
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)


def rules_table(spark: SparkSession, rules: tuple[tuple[str, str, str], ...] = RULES) -> DataFrame:
    return spark.createDataFrame(list(rules), "verdict string, host string, path string")


def _lower(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty for null or no ://."""
    return F.coalesce(_lower(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    """After the host up to ?, # or the end; empty for null or no ://."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _reversed(host: Column) -> Column:
    return F.concat_ws(".", F.reverse(F.split(host, r"\.")))


def judged(pages: DataFrame, rules: DataFrame, default: str = DEFAULT, parts: int = PARTS) -> DataFrame:
    """page_id, host, path, rule, verdict for every row of pages (columns page_id and url are read).

    A rule fits its host and all subdomains where the path starts with the rule's; the longest rule (host and path) wins, of equally long
    ones that with the longer host, then block before allow. rule is the winner's host and path, null where none fits. A null url, or one
    without ://, has host and path empty; only a rule with an empty host fits it. Rows that repeat are judged each. An empty table gives
    no rows; without rules every verdict is the default. Rules with a null in any column are left out.
    """
    urls = pages.select(F.col("page_id").cast("long").alias("page_id"), host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), "url")
    labels = F.split("host", r"\.")
    # Rows that repeat in page_id and url are one point and are multiplied again at the end.
    distinct = urls.groupBy("page_id", "url", "host", "path").agg(F.count(F.lit(1)).alias("copies"))
    part = F.pmod(F.xxhash64("page_id", "url"), F.lit(parts)).cast("int")
    clean = rules.select("verdict", _lower(F.col("host")).alias("host"), "path").dropna().groupBy("host", "path").agg(F.max("verdict").alias("verdict"))
    # No rule fits a domain with more labels than the longest rule has.
    deepest = clean.agg(F.max(F.size(F.split("host", r"\."))).alias("n")).first()["n"] or 0
    # "" is the parent of all hosts; its point is there for every url.
    domains = F.array_union(F.array(F.lit("")), F.transform(
        F.sequence(F.lit(1), F.least(F.size(labels), F.lit(max(1, deepest)))), lambda n: F.concat_ws(".", F.reverse(F.slice(labels, F.size(labels) - n + 1, n)))))
    points = distinct.select(
        F.explode(domains).alias("domain"), part.alias("part"), F.col("path").alias("key"), F.lit(1).alias("kind"), "page_id", "url", "copies",
        F.lit(None).cast("string").alias("rule"), F.lit(None).cast("string").alias("verdict"))
    starts = clean.select(
        _reversed(F.col("host")).alias("domain"), F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), F.col("path").alias("key"),
        F.lit(0).alias("kind"), F.lit(None).cast("long").alias("page_id"), F.lit(None).cast("string").alias("url"),
        F.lit(None).cast("long").alias("copies"), F.concat("host", "path").alias("rule"), "verdict")
    sorted_keys = points.unionByName(starts).repartition("domain", "part").sortWithinPartitions("domain", "part", "key", "kind")

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place: tuple = ()
        stack: list[tuple[str, str, str]] = []
        for batch in batches:
            kinds = batch.column(3).to_pylist()
            won: list[tuple] = []
            keys = zip(*(batch.column(i).to_pylist() for i in (0, 1, 2)), kinds, *(batch.column(i).to_pylist() for i in (7, 8)), strict=True)
            for domain, part_, key, kind, rule, verdict in keys:
                if (domain, part_) != place:
                    place, stack = (domain, part_), []
                while stack and not key.startswith(stack[-1][0]):
                    stack.pop()
                if kind == 0:
                    stack.append((key, rule, verdict))
                else:
                    won.append((*stack[-1][1:], len(domain)) if stack else (None, None, None))
            pages_ = batch.filter(pa.array([k == 1 for k in kinds], pa.bool_()))
            rule, verdict, length = zip(*won, strict=True) if won else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [*pages_.columns[4:7], pa.array(rule, pa.string()), pa.array(verdict, pa.string()), pa.array(length, pa.int32())],
                names=["page_id", "url", "copies", "rule", "verdict", "host_length"])

    matches = sorted_keys.mapInArrow(sweep, "page_id long, url string, copies long, rule string, verdict string, host_length int")
    best = matches.groupBy("page_id", "url", "copies").agg(F.max(F.when(F.col("rule").isNotNull(), F.struct(
        F.length("rule").alias("length"), "host_length", "verdict", "rule"))).alias("best"))
    each = best.select("page_id", "url", "best", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("_copy"))
    return each.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), F.col("best.rule").alias("rule"),
                       F.coalesce("best.verdict", F.lit(default)).alias("verdict"))


def oracle(rules: tuple[tuple[str, str, str], ...] = RULES, default: str = DEFAULT) -> str:
    """The same verdicts by comparing every url with every rule."""
    values = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in rules)
    return f"""
WITH r(verdict, host, path) AS (VALUES {values}),
u AS (SELECT page_id, url, translate(regexp_extract(coalesce(url, ''), '^.*?://([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
      regexp_extract(coalesce(url, ''), '^.*?://[^/?#]*([^?#]*)', 1, 's') AS path FROM pages),
m AS (SELECT u.page_id, u.url, r.host || r.path AS rule, r.verdict,
      row_number() OVER (PARTITION BY u.page_id, u.url ORDER BY length(r.host || r.path) DESC, length(r.host) DESC, r.verdict DESC) AS place
      FROM u JOIN r ON (u.host = r.host OR ends_with(u.host, '.' || r.host)) AND starts_with(u.path, r.path))
SELECT u.page_id, u.host, u.path, m.rule, coalesce(m.verdict, '{default}') AS verdict
FROM u LEFT JOIN m ON u.page_id = m.page_id AND u.url = m.url AND m.place = 1
"""
