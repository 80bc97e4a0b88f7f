"""Quality scores of documents from a kernel ridge on document statistics.

Random Fourier features approximate a Gaussian kernel over standardised statistics of the text. Every task sums its share of the normal
equations over the labelled rows, the sums are added up in a tree, and the ridge weights solve them. Labelled rows kept out of the fit
then map the raw scores to probabilities by isotonic regression.
"""

from __future__ import annotations

import pickle
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from finfacts.llm.shared import give_token_memory_back, written

#: Fourier features, kernel width in standard deviations for each root of the number of statistics, ridge and seed.
FEATURES, WIDTH, RIDGE, SEED = 512, 1.0, 3e-3, 9
#: Bins of the raw score in which the calibration rows are summed.
BINS = 400
#: Score from which a document is predicted good.
THRESHOLD = 0.3
#: Folds of doc_id; fold 0 is held out, fold 4 calibrates, the others are fitted.
FOLDS, HELD_OUT, CALIBRATE = 5, 0, 4

#: Rows of a batch that are worked on together.
ROWS_TOGETHER = 500

STATISTICS = (
    "log_chars", "log_words", "mean_word", "sd_word", "long_words", "short_words", "upper", "capitals", "letters", "digits", "stops",
    "commas", "symbols", "pipes", "bangs", "marked_words", "distinct_words", "top_word", "repeats", "distinct_pairs", "word_entropy",
    "lines", "line_words", "short_lines", "repeated_lines", "compression", "other_script", "sentence", "white")


def statistics(text: str | None) -> list[float]:
    """Numbers that describe a text of any length, all of it; an empty text gives zeros."""
    if not text or not (words := text.split()):
        return [0.0] * len(STATISTICS)
    n, chars = len(words), len(text)
    raw = text.encode()
    kinds = np.bincount(_KIND[np.frombuffer(raw, np.uint8)], minlength=10) / len(raw)
    lengths = np.fromiter(map(len, words), np.int64, n)
    counts = Counter(words)
    often = np.fromiter(counts.values(), np.float64, len(counts)) / n
    pairs = len(set(zip(words, words[1:], strict=False))) / max(1, n - 1)
    repeats = sum(a == b for a, b in zip(words, words[1:], strict=False)) / max(1, n - 1)
    lines = [x for x in text.split("\n") if x]
    in_line = np.fromiter((x.count(" ") + 1 for x in lines), np.int64, len(lines))
    marks = sum(w[-1] in _MARKS for w in words) / n
    ends = sum(w[-1] in ".!?" for w in words)
    capitals = sum(w[0].isupper() for w in words) / n
    return [
        np.log1p(chars), np.log1p(n), lengths.mean(), lengths.std(), float((lengths > 12).mean()), float((lengths < 3).mean()),
        kinds[1], capitals, kinds[2], kinds[3], kinds[4], kinds[5], kinds[6], kinds[7], kinds[8], marks,
        len(counts) / n, often.max(), repeats, pairs, float(-(often * np.log(often)).sum()) / np.log(n + 1),
        len(lines) / n, np.log1p(in_line.mean()), float((in_line < 4).mean()), 1 - len(set(lines)) / len(lines),
        len(zlib.compress(raw, 1)) / len(raw), kinds[9], np.log1p(n / (ends + 1)), kinds[0],
    ]


_MARKS = frozenset("%$&#*|~^")
_KIND = np.full(256, 6)
for _chars, _kind in ((range(0x80, 0x100), 9), (b" \t\n\r\f\v", 0), (range(65, 91), 1), (range(97, 123), 2), (range(48, 58), 3), (b".", 4), (b",", 5), (b"|", 7), (b"!?", 8)):
    for _c in _chars:
        _KIND[_c] = _kind


def fold(doc_id: Column) -> Column:
    return F.pmod(F.crc32(doc_id.cast("long").cast("string").cast("binary")), F.lit(FOLDS)).cast("int")


@dataclass(frozen=True)
class Model:
    mean: np.ndarray
    scale: np.ndarray
    directions: np.ndarray
    phases: np.ndarray
    weights: np.ndarray
    knots: np.ndarray
    levels: np.ndarray

    def features(self, statistics: np.ndarray) -> np.ndarray:
        z = np.clip((statistics - self.mean) / self.scale, -6, 6)
        waves = np.sqrt(2 / self.directions.shape[1]) * np.cos(z @ self.directions + self.phases)
        return np.hstack([np.ones((len(z), 1)), waves])

    def raw(self, statistics: np.ndarray) -> np.ndarray:
        return self.features(statistics) @ self.weights

    def score(self, statistics: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.raw(statistics), self.knots, self.levels), 0, 1)


def document_statistics(docs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """The columns to keep (by default doc_id) and the statistics of the whole text of every row; written, as fit and scores both use them."""
    keep = keep or ["doc_id"]
    read = docs.select(*dict.fromkeys([*keep, "text"]))
    at = read.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_token_memory_back()
        for batch in batches:
            # Some rows at a time, so that few texts are held twice.
            for first in range(0, batch.num_rows, ROWS_TOGETHER):
                part = batch.slice(first, ROWS_TOGETHER)
                rows = [statistics(t.as_py()) for t in part.column(at)]
                yield pa.RecordBatch.from_arrays([*part.columns[:len(keep)], pa.array(rows, pa.list_(pa.float64()))], names=[*keep, "_statistics"])

    schema = StructType([*docs.select(*keep).schema.fields, StructField("_statistics", ArrayType(DoubleType()))])
    return written(read.mapInArrow(run, schema), "statistics")


def _summed(rows: DataFrame, part: Callable[[np.ndarray, np.ndarray], list[np.ndarray]]) -> list[np.ndarray] | None:
    """The sums of the arrays that part gives for the (X, y) of each batch of rows (_statistics, y); None without rows.

    Every task sums its own rows into arrays of fixed size; these are added up in two rounds of groups, so that neither a task nor the
    driver gets more than a few of them.
    """

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            x = batch.column(0).flatten().to_numpy().reshape(-1, len(STATISTICS))
            y = batch.column(1).to_numpy()
            for first in range(0, len(y), 4 * ROWS_TOGETHER):
                found = part(x[first:first + 4 * ROWS_TOGETHER], y[first:first + 4 * ROWS_TOGETHER])
                total = found if total is None else [a + b for a, b in zip(total, found, strict=True)]
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(total)], pa.binary())], names=["body"])

    def add(group: pa.Table) -> pa.Table:
        total = None
        for body in group.column("body"):
            found = pickle.loads(body.as_buffer())
            total = found if total is None else [a + b for a, b in zip(total, found, strict=True)]
        return pa.table({"body": pa.array([pickle.dumps(total)], pa.binary())})

    tasks = max(1, rows.rdd.getNumPartitions())
    sums = rows.mapInArrow(own, "body binary").withColumn("slot", F.spark_partition_id() % max(1, round(tasks ** 0.5)))
    sums = sums.groupBy("slot").applyInArrow(add, "body binary").withColumn("slot", F.spark_partition_id() % 4).groupBy("slot").applyInArrow(add, "body binary")
    parts = [pickle.loads(r["body"]) for r in sums.collect()]
    return [sum(arrays) for arrays in zip(*parts, strict=True)] if parts else None


def isotonic(values: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The non-decreasing sequence nearest to values in weighted squares (pool adjacent violators)."""
    blocks: list[list[float]] = []
    for v, w in zip(values.tolist(), weights.tolist(), strict=True):
        blocks.append([v, w, 1])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            b, a = blocks.pop(), blocks.pop()
            blocks.append([(a[0] * a[1] + b[0] * b[1]) / (a[1] + b[1]), a[1] + b[1], a[2] + b[2]])
    return np.concatenate([np.full(int(n), v) for v, _, n in blocks]) if blocks else np.zeros(0)


def fit(table: DataFrame, labels: DataFrame) -> Model:
    """The model of table's statistics and the quality of labels, of every labelled row outside the held-out fold.

    Rows without a label, and labels that are null or repeat a doc_id with another value, take no part. With no usable rows every score
    is 0.5; with one class only, its share.
    """
    clean = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(
        F.max("quality").alias("quality"), F.min("quality").alias("_least")).where("quality = _least")
    rows = written(table.join(clean, "doc_id").where(fold(F.col("doc_id")) != HELD_OUT).select(
        "_statistics", F.col("quality").cast("double").alias("y"), fold(F.col("doc_id")).alias("fold")), "labelled")
    rng = np.random.default_rng(SEED)
    d = len(STATISTICS)
    directions = rng.normal(size=(d, FEATURES)) / (WIDTH * np.sqrt(d))
    phases = rng.uniform(0, 2 * np.pi, FEATURES)
    fitted = rows.where(F.col("fold") != CALIBRATE).select("_statistics", "y")
    first = _summed(fitted, lambda x, y: [x.sum(0), (x * x).sum(0), np.array([len(y), y.sum()], np.float64)])
    if first is None:
        return Model(np.zeros(d), np.ones(d), directions, phases, np.zeros(FEATURES + 1), np.zeros(1), np.full(1, 0.5))
    n = first[2][0]
    mean = first[0] / n
    scale = np.sqrt(np.maximum(first[1] / n - mean ** 2, 0))
    blank = Model(mean, np.where(scale > 1e-9, scale, 1), directions, phases, np.zeros(FEATURES + 1), np.zeros(1), np.zeros(1))
    # Both classes weigh the same in the fit; calibration brings their shares back.
    share = min(max(first[2][1] / n, 1e-6), 1 - 1e-6)

    def equations(x: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
        f = blank.features(x)
        w = np.where(y > 0, 0.5 / share, 0.5 / (1 - share))
        return [(f * w[:, None]).T @ f, (f * w[:, None]).T @ (2 * y - 1)]

    gram, right = _summed(fitted, equations)
    weights = np.linalg.solve(gram / n + RIDGE * np.diag([1e-6] + [1 / FEATURES] * FEATURES), right / n)
    raw = Model(blank.mean, blank.scale, directions, phases, weights, np.zeros(1), np.zeros(1))
    edges = np.linspace(-2, 2, BINS + 1)

    def binned(x: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
        r = np.clip(raw.raw(x), -2, 2)
        at = np.clip(np.searchsorted(edges, r, "right") - 1, 0, BINS - 1)
        return [np.bincount(at, minlength=BINS).astype(float), np.bincount(at, y, BINS), np.bincount(at, r, BINS)]

    bins = _summed(rows.where(F.col("fold") == CALIBRATE).select("_statistics", "y"), binned)
    if bins is None:
        return Model(blank.mean, blank.scale, directions, phases, weights, np.array([-2.0, 2.0]), np.array([0.0, 1.0]))
    count, good, total = bins
    used = count > 0
    levels = isotonic(good[used] / count[used], count[used])
    centres = total[used] / count[used]
    # One knot for each level, at the mean score of its rows, and the ends of the scale, so that scores keep their order.
    values, at = np.unique(levels, return_inverse=True)
    weight = np.bincount(at, count[used])
    centre = np.bincount(at, centres * count[used]) / weight
    # A level is drawn in by one row of the overall share, so that a pure level is not taken for certain.
    drawn = (values * weight + share) / (weight + 1)
    knots = np.concatenate([[min(-2.0, centre[0] - 1e-3)], centre, [max(2.0, centre[-1] + 1e-3)]])
    return Model(blank.mean, blank.scale, directions, phases, weights, knots, np.maximum.accumulate(np.concatenate([[0.5 * drawn[0]], drawn, [1 - 0.5 * (1 - drawn[-1])]])))


def quality_scores(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs.

    Scores depend on the text alone; a null or empty text is scored like any other, as is a row with a null doc_id (not held out). Equal
    texts score the same. An empty table gives no rows; without labels every score is 0.5.
    """
    table = document_statistics(docs)
    model = docs.sparkSession.sparkContext.broadcast(fit(table, labels))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.column(1).flatten().to_numpy().reshape(-1, len(STATISTICS))
            scores = np.concatenate([model.value.score(rows[k:k + 4 * ROWS_TOGETHER]) for k in range(0, max(1, len(rows)), 4 * ROWS_TOGETHER)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], names=["doc_id", "score"])

    scored = table.select(F.col("doc_id").cast("long").alias("doc_id"), "_statistics").mapInArrow(score, "doc_id long, score double")
    return scored.select("doc_id", F.coalesce(fold(F.col("doc_id")) == HELD_OUT, F.lit(False)).alias("held_out"), "score",
                         (F.col("score") >= threshold).cast("int").alias("predicted"))


def accepted_documents(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """docs without those the classifier rejects. All columns stay; rows that share a doc_id are judged each by its own text."""
    table = document_statistics(docs, docs.columns)
    model = docs.sparkSession.sparkContext.broadcast(fit(table.select(F.col("doc_id").cast("long").alias("doc_id"), "_statistics"), labels))

    def accept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.column(batch.num_columns - 1).flatten().to_numpy().reshape(-1, len(STATISTICS))
            good = np.concatenate([model.value.score(rows[k:k + 4 * ROWS_TOGETHER]) for k in range(0, max(1, len(rows)), 4 * ROWS_TOGETHER)])
            kept = batch.filter(pa.array(good >= threshold))
            yield pa.RecordBatch.from_arrays(kept.columns[:-1], names=kept.schema.names[:-1])

    return table.mapInArrow(accept, docs.schema)
