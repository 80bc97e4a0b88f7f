"""Periodic runs of words, found in a dictionary of basic factors, and texts with the repeats taken out.

For every power of two L, equal factors of L words have one name, made of the names of their halves. Where the next occurrence of a
factor is at most 2 L words on, and so is the next of the factors behind it, always at one distance, the occurrences are arithmetic
progressions and the distance is proposed as a period. Every run with period q is proposed where L is q or more at the latest: within a
run such a factor comes again after q words and not before. Proposals are extended word by word as far as the period holds, and those
that several lengths propose count once.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from finfacts.llm.tokens import chunks

#: Bytes of text whose words get names together; one longer text has names of its own.
TOGETHER = 3_000_000
RUNS = "doc_id long, runs array<struct<start: long, length: long, period: long>>, collapsed string"


def periodic_runs(words: np.ndarray, bounds: np.ndarray, least_length: int, least_repeats: int) -> np.ndarray:
    """(start, length, period) of every run of the documents whose words lie between bounds, as rows sorted by start, then period.

    A run has its smallest period, cannot be extended by a word, and has least_length words and least_repeats periods or more, of which
    there must be 4 or more for all to be found.
    """
    if least_repeats < 4:
        raise ValueError("runs of fewer than 4 periods are not all proposed")
    sizes = np.diff(bounds)
    most = int(sizes.max(initial=0))
    document = np.repeat(np.arange(len(sizes)), sizes)
    end = np.repeat(bounds[1:], sizes)
    names = np.full(len(words), -1, np.int64)
    at = np.arange(len(words))
    keys = document * (int(words.max(initial=0)) + 1) + words
    found, width = [], 1
    while len(at):
        # Names of the factors of width words; a factor that its document has once is left out of this length and of all longer ones.
        order = np.argsort(keys, kind="stable")
        at, keys = at[order], keys[order]
        new = np.concatenate([[True], keys[1:] != keys[:-1]])
        again = ~new
        again[:-1] |= ~new[1:]
        names[at] = np.where(again, np.cumsum(new) - 1, -1)
        nexts = np.where(new[1:], 0, at[1:] - at[:-1])
        near = (nexts > 0) & (nexts <= 2 * width)
        by_place = np.argsort(at[:-1][near], kind="stable")
        found.append(_proposed(at[:-1][near][by_place], nexts[near][by_place], width))
        at = np.sort(at[again])
        if least_repeats * (width + 1) > most:  # the next length serves periods of more than width words
            break
        at = at[(at + 2 * width <= end[at])]
        at = at[names[at + width] >= 0]
        keys = names[at] * (len(words) + 1) + names[at + width]
        longer = np.full(len(words), -1, np.int64)
        names, width = longer, 2 * width
    proposed = np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 3), np.int64)
    runs = np.unique(_extended(words, proposed, np.repeat(bounds[:-1], sizes), end), axis=0)
    return runs[runs[:, 1] >= np.maximum(least_length, least_repeats * runs[:, 2])]


def _proposed(places: np.ndarray, distances: np.ndarray, width: int) -> np.ndarray:
    """Stretches of places one after the other with one distance, longer than that: every one of their factors goes on in steps of it."""
    if not len(places):
        return np.zeros((0, 3), np.int64)
    cut = np.flatnonzero((np.diff(places) != 1) | (np.diff(distances) != 0)) + 1
    first, last = np.concatenate([[0], cut]), np.concatenate([cut, [len(places)]])
    count, distance = last - first, distances[first]
    long = count > distance
    return np.stack([places[first], count + distance + width - 1, distance], 1)[long]


def _extended(words: np.ndarray, runs: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The runs made longer, to the left and right, as long as words a period apart are equal."""
    start, period = runs[:, 0].copy(), runs[:, 2]
    stop = start + runs[:, 1]
    low, high = begin[start], end[start]
    for place, step in ((start, -1), (stop, 1)):
        going = np.arange(len(runs))
        while len(going):
            here = place[going]
            if step < 0:
                going = going[here > low[going]]
                same = words[place[going] - 1] == words[place[going] - 1 + period[going]]
            else:
                going = going[here < high[going]]
                same = words[place[going]] == words[place[going] - period[going]]
            going = going[same]
            place[going] += step
    return np.stack([start, stop - start, period], 1)


def planted_repeats(doc_id: int | None, n: int) -> np.ndarray | None:
    """For a tenth of the documents, the word that each place takes over so that the text ends in a run; None for the others."""
    if doc_id is None or not n:
        return None
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    places = np.arange(n)
    places[a:] = a + np.arange(n - a) % p
    return places


def collapse_runs(docs: DataFrame, least_length: int = 6, least_repeats: int = 4,
                  rewrite: Callable[[int | None, int], np.ndarray | None] | None = None) -> DataFrame:
    """doc_id, runs (start, length, period in words, by start, then period) and collapsed of every row of docs (doc_id and text are read).

    A run is a stretch of words with smallest period q, least_length words and least_repeats * q words or more, that no word beside it
    extends. collapsed is the words that no run holds after its first q words, joined by one space. Words are runs of characters other
    than ASCII white space. Null and empty texts have no runs and collapse to nothing; very long texts are searched whole; rows that
    repeat a doc_id, or lack one, are each worked out. rewrite may give, for a document and its number of words, the places whose words
    are read instead. An empty table gives no rows; further columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pc.fill_null(batch.column(1), "")
            for first, last in chunks(texts, TOGETHER):
                yield part(batch.column(0).slice(first, last - first), texts.slice(first, last - first))

    def part(ids: pa.Array, texts: pa.Array) -> pa.RecordBatch:
        split = pc.ascii_split_whitespace(texts.cast(pa.large_string()))
        offsets = split.offsets.to_numpy()
        tokens = split.flatten()
        real = pc.greater(pc.binary_length(tokens), 0).to_numpy(zero_copy_only=False)
        bounds = np.concatenate([[0], np.cumsum(real)])[offsets - offsets[0]]
        coded = tokens.filter(pa.array(real)).dictionary_encode()
        words = coded.indices.to_numpy().astype(np.int64)
        if rewrite is not None:
            for doc_id, a, b in zip(ids.to_pylist(), bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                places = rewrite(doc_id, b - a)
                if places is not None:
                    words[a:b] = words[a:b][places]
        runs = periodic_runs(words, bounds, least_length, least_repeats)
        change = np.zeros(len(words) + 1, np.int64)
        np.add.at(change, runs[:, 0] + runs[:, 2], 1)
        np.add.at(change, runs[:, 0] + runs[:, 1], -1)
        kept = np.cumsum(change[:-1]) == 0
        kept_bounds = np.concatenate([[0], np.cumsum(kept)])[bounds]
        left = coded.dictionary.take(pa.array(words[kept]))
        collapsed = pc.binary_join(pa.LargeListArray.from_arrays(pa.array(kept_bounds, pa.int64()), left), pa.scalar(" ", pa.large_string()))
        owner = np.searchsorted(bounds, runs[:, 0], "right") - 1
        run_bounds = np.searchsorted(owner, np.arange(len(ids) + 1))
        structs = pa.StructArray.from_arrays([
            pa.array(runs[:, 0] - bounds[owner]), pa.array(runs[:, 1]), pa.array(runs[:, 2])], names=["start", "length", "period"])
        lists = pa.ListArray.from_arrays(pa.array(run_bounds, pa.int32()), structs)
        return pa.RecordBatch.from_arrays([ids, lists, collapsed.cast(pa.string())], names=["doc_id", "runs", "collapsed"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, RUNS)


def run_digests(docs: DataFrame) -> DataFrame:
    """Number of runs, the run with most periods, and digests of all runs and of the collapsed text, with runs planted by doc_id."""
    found = collapse_runs(docs, rewrite=planted_repeats)

    def better(a, b):
        more = a["length"] * b["period"] - b["length"] * a["period"]
        return F.when(more != 0, more > 0).when(a["start"] != b["start"], a["start"] < b["start"]).otherwise(a["period"] < b["period"])

    best = F.aggregate("runs", F.try_element_at("runs", F.lit(1)), lambda b, r: F.when(better(r, b), r).otherwise(b))
    lines = F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n")))
    return found.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("best.start").alias("start"), F.col("best.length").alias("length"),
        F.col("best.period").alias("period"), F.expr("best.length * 1000 div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
