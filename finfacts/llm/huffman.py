"""Token-id files under one canonical, length-limited Huffman code.

The code is built from the counts of all ids. A file holds blocks of whole documents; the bits of a block stand on their own, and a
checkpoint every CHECKPOINT ids gives the bit at which decoding may start, so a block is decoded at all its checkpoints at once by
looking up code windows in one table.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from finfacts.llm.shared import tasks_for, written
from finfacts.llm.tokens import chunks, word_ids

#: Ids between two checkpoints.
CHECKPOINT = 64
#: Ids after which a block is closed; it always ends with a document.
BLOCK_IDS = 1 << 16
#: Longest code word in bits, raised only if the ids in use need more.
MAX_BITS = 16
#: Ids packed together, and ids of the blocks decoded together.
PACK_IDS, DECODE_IDS = 1 << 18, 1 << 19
#: Documents of one file.
DOCS_PER_FILE = 50_000

IDS = "doc_id long, n_tokens long, ids binary, id array<int>, count array<long>"
ENCODED = "file int, doc_id long, n_tokens long, bits binary, checkpoints array<int>"
BLOCKS = "file int, block int, n_tokens long, doc_ids array<long>, lengths array<long>, checkpoints array<long>, first_bytes array<long>, bits binary"


@dataclass(frozen=True)
class Code:
    """Code word and its length by id; the symbol and length by window of max_bits bits."""

    lengths: np.ndarray
    words: np.ndarray
    symbols: np.ndarray
    steps: np.ndarray
    max_bits: int


def code_lengths(counts: np.ndarray, max_bits: int) -> np.ndarray:
    """Lengths of an optimal prefix code with words of at most max_bits bits (package-merge); 0 for ids that never occur."""
    used = np.flatnonzero(counts)
    lengths = np.zeros(len(counts), np.uint8)
    if len(used) == 1:
        lengths[used] = 1
    if len(used) < 2:
        return lengths
    order = used[np.argsort(counts[used], kind="stable")]
    weights = counts[order].astype(np.float64)
    levels: list[np.ndarray] = []  # for each level, which entries of the merged list are single ids
    packages = np.zeros(0)
    for _ in range(max_bits):
        merged = np.concatenate([weights, packages])
        by = np.argsort(merged, kind="stable")
        levels.append(by < len(weights))
        merged = merged[by]
        even = len(merged) // 2 * 2
        packages = merged[0:even:2] + merged[1:even:2]
    take = 2 * (len(used) - 1)
    own = np.zeros(len(used), np.int64)
    for single in reversed(levels):
        n = int(single[:take].sum())
        own[:n] += 1
        take = 2 * (take - n)
    lengths[order] = own
    return lengths


def canonical(lengths: np.ndarray) -> Code:
    """Words in order of (length, id), so the lengths alone define the code."""
    lengths = np.asarray(lengths, np.uint8)
    max_bits = max(1, int(lengths.max(initial=0)))
    used = np.flatnonzero(lengths)
    order = used[np.lexsort((used, lengths[used]))]
    spans = np.left_shift(np.int64(1), max_bits - lengths[order].astype(np.int64))
    firsts = np.cumsum(spans) - spans
    words = np.zeros(len(lengths), np.uint32)
    words[order] = firsts >> (max_bits - lengths[order].astype(np.int64))
    symbols, steps = np.zeros(1 << max_bits, np.uint32), np.zeros(1 << max_bits, np.uint8)
    symbols[: spans.sum()] = np.repeat(order, spans)
    steps[: spans.sum()] = np.repeat(lengths[order], spans)
    return Code(lengths, words, symbols, steps, max_bits)


def pack_bits(ids: np.ndarray, lengths: np.ndarray, code: Code) -> tuple[list[bytes], list[np.ndarray]]:
    """The bits of documents of the given numbers of ids, each filled up to whole bytes, and the bit offset of every CHECKPOINT-th id."""
    sizes = code.lengths[ids].astype(np.int64)
    ends = np.cumsum(sizes)
    last = np.cumsum(lengths)
    total = np.diff(np.concatenate([[0], ends])[last], prepend=0)
    spans = (total + 7) // 8
    first = np.cumsum(spans) - spans
    # Every document starts at a whole byte: its bits move on by what the documents before were filled up.
    starts = ends - sizes + np.repeat(8 * first - (np.cumsum(total) - total), lengths)
    # A word of up to 32 bits that starts within 16-bit cell c reaches into c, c + 1 and c + 2 at most.
    wide = code.words[ids].astype(np.uint64) << (48 - (starts & 15) - sizes).astype(np.uint64)
    cells = np.zeros(int(spans.sum()) // 2 + 4)
    for k in range(3 if code.max_bits > 17 else 2):
        part = (wide >> np.uint64(32 - 16 * k)) & np.uint64(0xFFFF)
        cells += np.bincount((starts >> 4) + k, part, len(cells))
    data = cells.astype(">u2").tobytes()
    inside = starts - np.repeat(8 * first, lengths)
    marks = [inside[b - n:b:CHECKPOINT] for b, n in zip(last.tolist(), lengths.tolist(), strict=True)]
    return [data[f:f + n] for f, n in zip(first.tolist(), spans.tolist(), strict=True)], marks


def unpack_bits(bits: np.ndarray, checkpoints: np.ndarray, sizes: np.ndarray, code: Code) -> np.ndarray:
    """The ids at all checkpoints, each followed by sizes - 1 further ids; one table look-up per id, all checkpoints side by side."""
    padded = np.concatenate([bits, np.zeros(8, np.uint8)]).astype(np.uint32)
    four = (padded[:-3] << 24) | (padded[1:-2] << 16) | (padded[2:-1] << 8) | padded[3:]  # the 32 bits from each byte on
    by = np.argsort(-sizes, kind="stable")
    at, left = checkpoints[by].astype(np.int64), sizes[by]
    firsts = (np.cumsum(sizes) - sizes)[by]
    out = np.zeros(int(sizes.sum()), np.uint32)
    mask, rest = np.uint32((1 << code.max_bits) - 1), np.int64(32 - code.max_bits)
    active = np.searchsorted(-left, -np.arange(int(left[0]) if len(left) else 0), "left")
    for k, n in enumerate(active.tolist()):
        here = at[:n]
        window = (four[here >> 3] >> (rest - (here & 7)).astype(np.uint32)) & mask
        out[firsts[:n] + k] = code.symbols[window]
        here += code.steps[window]
    return out


def checkpoint_sizes(lengths: np.ndarray) -> np.ndarray:
    """Ids after each checkpoint, for documents of the given numbers of ids."""
    lanes = -(-lengths // CHECKPOINT)
    sizes = np.full(int(lanes.sum()), CHECKPOINT, np.int64)
    ends = np.cumsum(lanes) - 1
    sizes[ends[lanes > 0]] = (lengths - (lanes - 1) * CHECKPOINT)[lanes > 0]
    return sizes


def token_ids(docs: DataFrame, path: str, end: int) -> DataFrame:
    """Ids of every text, closed by end, and in rows of their own the counts of ids of each task; tokenized once and written."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = word_ids(path)
        kind = np.dtype("<u2") if words.vocabulary <= 1 << 16 else np.dtype("<u4")
        counts = np.zeros(words.vocabulary, np.int64)
        for batch in batches:
            for first, last in chunks(batch.column(1)):
                flat, lengths = words.encode(batch.column(1).slice(first, last - first), end)
                counts += np.bincount(flat, minlength=len(counts))
                cuts = np.concatenate([[0], np.cumsum(lengths)]) * kind.itemsize
                data = flat.astype(kind).tobytes()
                n = last - first
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(first, n).cast(pa.int64()), pa.array(lengths, pa.int64()),
                    pa.array([data[a:b] for a, b in zip(cuts, cuts[1:])], pa.binary()),
                    pa.nulls(n, pa.list_(pa.int32())), pa.nulls(n, pa.list_(pa.int64())),
                ], names=["doc_id", "n_tokens", "ids", "id", "count"])
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([
            pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()),
            pa.array([used], pa.list_(pa.int32())), pa.array([counts[used]], pa.list_(pa.int64())),
        ], names=["doc_id", "n_tokens", "ids", "id", "count"])

    return written(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, IDS), "token-ids")


def global_code(ids: DataFrame, max_bits: int = MAX_BITS) -> Code:
    """The code of all ids; what comes to the driver is one count for each id of the vocabulary."""
    rows = (ids.where("ids is null").select(F.explode(F.arrays_zip("id", "count")).alias("x"))
            .groupBy("x.id").agg(F.sum("x.count").alias("n")).collect())
    counts = np.zeros(1 + max((r["id"] for r in rows), default=0), np.int64)
    for r in rows:
        counts[r["id"]] = r["n"]
    bits = max(max_bits, int(max(1, (counts > 0).sum()) - 1).bit_length())
    return canonical(code_lengths(counts, bits))


def write_blocks(ids: DataFrame, code: Code, path_label: str = "token-blocks") -> DataFrame:
    """The token files: blocks of whole documents in ascending doc_id (null first; equal ones by length and bits).

    file numbers the files in that order and block the blocks of a file. A file holds a range of doc_id between approximate quantiles, so
    equal ids are in one file; null ids have file 0.
    """

    texts = ids.where("ids is not null")
    files = tasks_for(texts.count(), DOCS_PER_FILE)
    # A file is cut finer than DOCS_PER_FILE where the session asks for more shuffle tasks.
    files = max(files, int(ids.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    cuts = np.array(texts.approxQuantile("doc_id", [k / files for k in range(1, files)], 0.1 / files) if files > 1 else [])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits: list[bytes] = []
            checkpoints: list[np.ndarray] = []
            counts, data = batch.column(1).to_numpy(), batch.column(2).to_pylist()
            first = 0
            while first < len(data):
                # Documents are packed some at a time; a longer one alone.
                after = max(first + 1, int(np.searchsorted(np.cumsum(counts[first:]), PACK_IDS, "right")) + first)
                kind = "<u2" if len(data[first]) == 2 * counts[first] else "<u4"
                got, places = pack_bits(np.frombuffer(b"".join(data[first:after]), kind), counts[first:after], code)
                bits += got
                checkpoints += places
                first = after
            known = batch.column(0).is_valid().to_numpy(zero_copy_only=False)
            file = np.where(known, 1 + np.searchsorted(cuts, batch.column(0).fill_null(0).to_numpy(), "right"), 0)
            yield pa.RecordBatch.from_arrays([
                pa.array(file, pa.int32()), batch.column(0), batch.column(1), pa.array(bits, pa.binary()), pa.array(checkpoints, pa.list_(pa.int32())),
            ], names=["file", "doc_id", "n_tokens", "bits", "checkpoints"])

    def block_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, block, size, rows = -1, 0, 0, []

        def close() -> pa.RecordBatch:
            ids_, lengths, bits, places = zip(*rows, strict=True)
            firsts = np.cumsum([0, *map(len, bits)])[:-1]
            return pa.RecordBatch.from_arrays([
                pa.array([file], pa.int32()), pa.array([block], pa.int32()), pa.array([size], pa.int64()), pa.array([list(ids_)], pa.list_(pa.int64())),
                pa.array([list(lengths)], pa.list_(pa.int64())),
                pa.array([np.concatenate([8 * f + np.asarray(p, np.int64) for f, p in zip(firsts, places, strict=True)])], pa.list_(pa.int64())),
                pa.array([firsts], pa.list_(pa.int64())), pa.array([b"".join(bits)], pa.binary()),
            ], names=["file", "block", "n_tokens", "doc_ids", "lengths", "checkpoints", "first_bytes", "bits"])

        for batch in batches:
            for own, *row in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                if rows and (size >= BLOCK_IDS or own != file):
                    yield close()
                    block, size, rows = block + 1, 0, []
                if own != file:
                    file, block = own, 0
                rows.append(row)
                size += row[1]
        if rows:
            yield close()

    encoded = texts.select("doc_id", "n_tokens", "ids").mapInArrow(encode, ENCODED)
    placed = encoded.repartition(files, "file").sortWithinPartitions("file", "doc_id", "n_tokens", "bits")
    return written(placed.mapInArrow(block_up, BLOCKS), path_label)


def write_lengths(spark: SparkSession, code: Code, path_label: str = "token-code") -> DataFrame:
    """The table beside the blocks that defines their code: id and length of each id in use."""
    used = np.flatnonzero(code.lengths)
    rows = list(zip(used.tolist(), code.lengths[used].tolist(), strict=True))
    return written(spark.createDataFrame(rows, "id int, length int").coalesce(1), path_label)


def read_lengths(lengths: DataFrame) -> Code:
    rows = lengths.select("id", "length").collect()
    known = np.zeros(1 + max((r["id"] for r in rows), default=0), np.uint8)
    for r in rows:
        known[r["id"]] = r["length"]
    return canonical(known)


def read_blocks(blocks: DataFrame, lengths: DataFrame) -> DataFrame:
    """Every document decoded from the files and their table of code lengths: doc_id, start, n_tokens, ids_crc32."""
    code = read_lengths(lengths)
    files = blocks.groupBy("file").agg(F.sum("n_tokens").alias("file_tokens"))
    # One row for each file; their order needs one task.
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    bases = files.select("file", F.coalesce(F.sum("file_tokens").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = (blocks.select("file", "block", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)).alias("within"))
              .join(bases, "file").select("file", "block", (F.col("base") + F.col("within")).alias("start")))

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.column(6).to_numpy()
            first = 0
            while first < len(sizes):
                # Blocks are decoded some at a time, so that many checkpoints stand side by side.
                after = max(first + 1, int(np.searchsorted(np.cumsum(sizes[first:]), DECODE_IDS, "right")) + first)
                yield decode_some(batch.slice(first, after - first))
                first = after

    def decode_some(rows: pa.RecordBatch) -> pa.RecordBatch:
        blobs = rows.column(5).to_pylist()
        offsets = np.cumsum([0, *map(len, blobs)])[:-1]
        docs_in = rows.column(2).value_lengths().to_numpy()
        lengths = rows.column(3).flatten().to_numpy()
        places = rows.column(4).flatten().to_numpy() + 8 * np.repeat(offsets, rows.column(4).value_lengths().to_numpy())
        flat = unpack_bits(np.frombuffer(b"".join(blobs), np.uint8), places, checkpoint_sizes(lengths), code)
        ends = np.cumsum(lengths)
        before = np.cumsum(rows.column(6).to_numpy()) - rows.column(6).to_numpy()
        data = memoryview(flat.astype("<u4", copy=False).tobytes())
        owner = pa.array(np.repeat(np.arange(len(blobs)), docs_in))
        return pa.RecordBatch.from_arrays([
            rows.column(0).take(owner), rows.column(1).take(owner), rows.column(2).flatten(),
            pa.array(ends - lengths - np.repeat(before, docs_in), pa.int64()), pa.array(lengths, pa.int64()),
            pa.array([zlib.crc32(data[4 * (e - k):4 * e]) for e, k in zip(ends.tolist(), lengths.tolist(), strict=True)], pa.int64()),
        ], names=["file", "block", "doc_id", "inside", "n_tokens", "ids_crc32"])

    decoded = blocks.select("file", "block", "doc_ids", "lengths", "checkpoints", "bits", "n_tokens").mapInArrow(
        decode, "file int, block int, doc_id long, inside long, n_tokens long, ids_crc32 long")
    return decoded.join(starts, ["file", "block"]).select(
        "doc_id", (F.col("start") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32")


def huffman_round_trip(docs: DataFrame, path: str, end: int = 1) -> DataFrame:
    """Writes the token files of docs and reads them back.

    A null or empty text is the end id alone. Rows with one doc_id are documents of their own, in order of length and bits; a null
    doc_id comes first. An empty table gives no rows. Other columns of docs are not read.
    """
    ids = token_ids(docs, path, end)
    code = global_code(ids)
    return read_blocks(write_blocks(ids, code), write_lengths(docs.sparkSession, code))
