"""Documents packed into sequences of a fixed number of tokens by bounded-space online best fit."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from finfacts.llm.shared import tasks_for, written
from finfacts.llm.tokens import chunks, word_ids

#: Bins open at a time; the fullest closes when a further one is needed.
OPEN_BINS = 4096
#: Pieces looked at together, longest first, before they go to the packer one by one.
WINDOW = 8192
#: Pieces of one packing task.
PIECES_PER_TASK = 250_000

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PLACED = PIECES + ", bin long, offset long"


class BestFit:
    """Open bins by their free space. A bit of free is set where some open bin has just that much space."""

    def __init__(self, capacity: int, open_bins: int) -> None:
        self.capacity, self.open_bins = capacity, open_bins
        self.free = 0
        self.bins: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.open = self.made = 0

    def _take(self, space: int) -> int:
        found = self.bins[space].pop()
        if not self.bins[space]:
            self.free &= ~(1 << space)
        return found

    def place(self, length: int) -> tuple[int, int]:
        """(bin, offset) of a piece: the open bin with least space that holds it, else a new bin."""
        if fits := self.free >> length:
            space = length + (fits & -fits).bit_length() - 1
            found = self._take(space)
        else:
            if self.open == self.open_bins:
                self._take((self.free & -self.free).bit_length() - 1)
                self.open -= 1
            space, found = self.capacity, self.made
            self.made += 1
            self.open += 1
        rest = space - length
        if rest:
            self.bins[rest].append(found)
            self.free |= 1 << rest
        else:
            self.open -= 1
        return found, self.capacity - space


def token_pieces(docs: DataFrame, path: str, end: int, capacity: int) -> DataFrame:
    """Pieces of at most capacity ids of every text closed by end; only longer documents are cut."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = word_ids(path)
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for first, last in chunks(batch.column(1)):
                flat, lengths = words.encode(batch.column(1).slice(first, last - first), end)
                data = memoryview(flat.astype("<u4").tobytes())
                counts = -(-lengths // capacity)
                owner = np.repeat(np.arange(last - first), counts)
                piece = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
                start = piece * capacity
                length = np.minimum(capacity, lengths[owner] - start)
                at = (np.cumsum(lengths) - lengths)[owner] + start
                yield pa.RecordBatch.from_arrays([
                    pa.array([ids[first + i] for i in owner], pa.int64()), pa.array(piece, pa.int32()), pa.array(start, pa.int64()),
                    pa.array(length, pa.int64()),
                    pa.array([zlib.crc32(data[4 * a:4 * (a + n)]) for a, n in zip(at, length, strict=True)], pa.int64()),
                ], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, PIECES)


def best_fit(pieces: DataFrame, capacity: int, open_bins: int = OPEN_BINS, pieces_per_task: int = PIECES_PER_TASK) -> DataFrame:
    """Adds sequence_id and offset to pieces (a written table with the columns of PIECES).

    Each task packs its own share of the pieces, dealt by a hash of the piece, so tasks and reruns give the same sequences.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        packer = BestFit(capacity, open_bins)
        waiting: list[pd.DataFrame] = []

        def placed(frame: pd.DataFrame) -> pd.DataFrame:
            frame = frame.sort_values("length", ascending=False, kind="stable")
            places = np.array([packer.place(n) for n in frame.length.tolist()], np.int64).reshape(-1, 2)
            return frame.assign(bin=places[:, 0], offset=places[:, 1])

        for frame in frames:
            waiting.append(frame)
            while sum(map(len, waiting)) >= WINDOW:
                whole = pd.concat(waiting)
                yield placed(whole.iloc[:WINDOW])
                waiting = [whole.iloc[WINDOW:]]
        if waiting and sum(map(len, waiting)):
            yield placed(pd.concat(waiting))

    spark = pieces.sparkSession
    tasks = tasks_for(pieces.count(), pieces_per_task)
    order = ("_deal", "doc_id", "piece", "start", "length", "ids_crc32")
    dealt = (pieces.withColumn("_deal", F.xxhash64("doc_id", "piece", "length", "ids_crc32"))
             .repartition(tasks, "_deal").sortWithinPartitions(*order).drop("_deal"))
    # doc_id may be null, which pandas would turn into a double.
    nulls = dealt.select(F.coalesce("doc_id", F.lit(0)).alias("doc_id"), *PIECE_COLUMNS[1:], F.col("doc_id").isNull().alias("_no_id"))
    packed = nulls.mapInPandas(run, PLACED.replace(", bin", ", _no_id boolean, bin"))
    return packed.select(
        F.when(~F.col("_no_id"), F.col("doc_id")).alias("doc_id"), *PIECE_COLUMNS[1:],
        (F.spark_partition_id().cast("long") * F.lit(1 << 33) + F.col("bin")).alias("sequence_id"), "offset")


PIECE_COLUMNS = ("doc_id", "piece", "start", "length", "ids_crc32")


def pack_documents(docs: DataFrame, path: str, end: int = 0, capacity: int = 2048) -> DataFrame:
    """One row for each piece of each document with its place: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A null or empty text is the end id alone. Rows that repeat are packed each. A null doc_id stays null. An empty table gives no rows.
    Other columns of docs are not read.
    """
    return best_fit(written(token_pieces(docs, path, end, capacity), "pieces"), capacity)
