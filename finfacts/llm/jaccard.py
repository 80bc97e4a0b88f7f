"""Near duplicates by an exact n-gram Jaccard join with adaptive multi-match prefixes.

The shingles of a document are put in one global order, rare ones first. Two sets with similarity t or more share at least l shingles
within their l-prefixes (the n - ceil(t n) + l first ones). Every document picks its own l: lengthening the prefix costs more look-ups,
but a partner must then share l of them. Documents are linked in two rounds. The first compares each document with one leader of each
of its lists, which joins large groups of copies without going through their pairs; the second compares across the groups that are
left, all of them, so no link between groups is missed. A bitmap of each set bounds the overlap before any set is looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from finfacts.llm.shared import bitmap, give_token_memory_back, marked, split_by, without_listed, written

#: Longest lengthening of a prefix, and what verifying a candidate costs against reading one posting.
MOST_MATCHES = 8
VERIFY_COST = 6.0
#: log2 of the cells of the frequency sketch. Its size is fixed: it only sets the order of shingles, never a result.
SKETCH_BITS = 21
#: Shingles a task counts together for the sketch, and the least count it reports.
COUNT_TOGETHER, LEAST_COUNT = 2_000_000, 2
#: 64-bit words of the bitmap of a set.
BITMAP_WORDS = 16
#: Cells for each document that may have a partner, and at most, of the bitmap that picks them.
CELLS_PER_NODE, MOST_CELLS = 32, 1 << 29
#: log2 of the cells of one segment of the bitmap of repeated tokens.
SEGMENT_BITS = 20
#: Members of a list that meet one leader in a turn, most turns, and pairs for each posting that are left to the last round.
SHORT_LIST, MOST_TURNS, PAIRS_PER_POSTING = 8, 2, 2
#: Bytes of text hashed at a time.
PIECE_BYTES = 1 << 18

_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0xFF51AFD7ED558CCD)]
_BLANKS = (b" ", b"\t", b"\n", b"\v", b"\f", b"\r")


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _ODD[0]
    x = (x ^ (x >> np.uint64(29))) * _ODD[1]
    return x ^ (x >> np.uint64(32))


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A number for each byte, A-Z as a-z; powers of an odd number and of its inverse modulo 2**64."""
    codes = np.arange(256)
    codes[65:91] += 32
    base, inverse = int(_ODD[3]), pow(int(_ODD[3]), -1, 1 << 64)
    powers, back = np.full(PIECE_BYTES, base, np.uint64), np.full(PIECE_BYTES, inverse, np.uint64)
    powers[0] = back[0] = 1
    return _mixed(codes.astype(np.uint64) + np.uint64(1)), np.cumprod(powers), np.cumprod(back)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    numbers, powers, back = _tables()
    if n > len(powers):  # one word longer than a piece
        powers, back = np.resize(powers, n), np.resize(back, n)
        powers[PIECE_BYTES:], back[PIECE_BYTES:] = _ODD[3], np.uint64(pow(int(_ODD[3]), -1, 1 << 64))
        powers[PIECE_BYTES - 1:], back[PIECE_BYTES - 1:] = np.multiply.accumulate(powers[PIECE_BYTES - 1:]), np.multiply.accumulate(back[PIECE_BYTES - 1:])
    return numbers, powers, back


def word_hashes(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hash and first byte of every word of raw: runs of bytes other than ASCII white space, A-Z lower-cased.

    A word's hash is its bytes' polynomial, taken from running sums, and its length, mixed.
    """
    codes = np.frombuffer(raw, np.uint8)
    numbers, powers, back = _powers(len(codes))
    word = (codes != 32) & ((codes < 9) | (codes > 13))
    edge = np.flatnonzero(np.diff(word, prepend=False, append=False))
    starts, ends = edge[::2], edge[1::2]
    sums = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum(numbers[codes] * powers[: len(codes)], out=sums[1:])
    own = (sums[ends] - sums[starts]) * back[starts]
    return _mixed(own ^ ((ends - starts).astype(np.uint64) * _ODD[2])), starts


def _pieces(raw: bytes) -> Iterator[bytes]:
    """raw cut at white space into pieces of about PIECE_BYTES; a longer word is a piece of its own."""
    at = 0
    while len(raw) - at > PIECE_BYTES:
        cut = max(raw.rfind(c, at, at + PIECE_BYTES) for c in _BLANKS)
        if cut <= at:
            found = [x for c in _BLANKS if (x := raw.find(c, at + 1)) >= 0]
            cut = min(found, default=len(raw))
        yield raw[at:cut]
        at = cut
    yield raw[at:]


def shingle_sets(texts: list[str | None], k: int) -> Iterator[np.ndarray]:
    """For each text the sorted distinct 64-bit hashes of its k-word shingles; of fewer words, the hash of them all; of none, nothing.

    Words are runs of characters other than ASCII white space, A-Z lower-cased.
    """
    waiting: list[bytes] = []
    size = 0
    for text in texts:
        raw = text.encode() if text else b""
        if waiting and size + len(raw) + 1 > PIECE_BYTES:
            yield from _sets_of(waiting, k)
            waiting, size = [], 0
        waiting.append(raw)
        size += len(raw) + 1
    if waiting:
        yield from _sets_of(waiting, k)


def _sets_of(raws: list[bytes], k: int) -> Iterator[np.ndarray]:
    if len(raws) == 1:
        hashes = np.concatenate([word_hashes(piece)[0] for piece in _pieces(raws[0])])
        bounds = [0, len(hashes)]
    else:
        hashes, starts = word_hashes(b" ".join(raws))
        offsets = np.cumsum([0, *(len(r) + 1 for r in raws)])
        bounds = np.searchsorted(starts, offsets).tolist()
    n = max(0, len(hashes) - k + 1)
    mixed = np.zeros(n, np.uint64)
    for j in range(k):
        mixed = _mixed(mixed + hashes[j:j + n] * _ODD[j % len(_ODD)] + np.uint64(j))
    for first, last in zip(bounds, bounds[1:]):
        if last - first >= k:
            own = np.sort(mixed[first:last - k + 1])
            yield own[np.concatenate([[True], own[1:] != own[:-1]])]
        elif last > first:
            short = np.zeros(1, np.uint64)
            for j, h in enumerate(hashes[first:last]):
                short = _mixed(short * _ODD[1] + h + np.uint64(j + last - first))
            yield short
        else:
            yield hashes[:0]


def frequency_sketch(docs: DataFrame, k: int) -> np.ndarray:
    """log2 of the count of the most frequent shingle of each cell, of 2**SKETCH_BITS cells; 0 where none is known to repeat.

    Tasks report the shingles that repeat among their own documents; the reports are summed by shingle.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_token_memory_back()
        held: list[np.ndarray] = []

        def report() -> pa.RecordBatch:
            shingles, counts = np.unique(np.concatenate(held), return_counts=True)
            often = counts >= LEAST_COUNT
            return pa.RecordBatch.from_arrays([pa.array(shingles[often].view(np.int64)), pa.array(counts[often])], names=["shingle", "n"])

        size = 0
        for batch in batches:
            for shingles in shingle_sets(batch.column(0).to_pylist(), k):
                held.append(shingles)
                size += len(held[-1])
                if size > COUNT_TOGETHER:
                    yield report()
                    held, size = [], 0
        if held:
            yield report()

    counted = docs.select("text").mapInArrow(count, "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n"))
    cells = counted.groupBy(F.shiftrightunsigned("shingle", 64 - SKETCH_BITS).cast("int").alias("cell")).agg(
        F.max(F.floor(F.log2("n"))).cast("byte").alias("level"))
    # As Arrow columns: a Python row for each cell would take the driver a hundred times their bytes.
    found = cells.toArrow()
    sketch = np.zeros(1 << SKETCH_BITS, np.uint8)
    sketch[found["cell"].to_numpy()] = found["level"].to_numpy()
    return sketch


def need(n: int | np.ndarray, percent: int):
    """Least overlap with any partner of a set of n: ceil(percent * n / 100)."""
    return -(-percent * n // 100)


def chosen_matches(levels: np.ndarray, base: int) -> int:
    """The l of least estimated cost: postings read, and candidates that share l of them; levels are log2 counts in prefix order."""
    counts = np.exp2(levels[: base + MOST_MATCHES - 1].astype(np.float64)) - 1
    read = np.cumsum(counts)
    most = max(1, min(MOST_MATCHES, len(counts) - base + 1))
    reads = read[base - 1: base - 1 + most]
    return 1 + int(np.argmin(reads * (1 + VERIFY_COST / np.arange(1, most + 1))))


PREFIXES = "doc_id long, text_hash long, n int, signature long, signature2 long, matches int, prefix array<long>, bitmap array<long>, wide array<long>"
#: What tells sets apart: 128 bits of hash and the size.
SET = ("signature", "signature2", "n")


def prefixes(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """Set size, signature of the set, l, the l-prefix in order and the bitmap of every document, and a number of its row, node; written.

    A set too large for that bitmap has a wide one too, of as many bits as elements or up to twice as many.
    """
    sketch = docs.sparkSession.sparkContext.broadcast(frequency_sketch(docs, k))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        levels_of = sketch.value
        for batch in batches:
            rows: list[tuple] = []
            for shingles in shingle_sets(batch.column(1).to_pylist(), k):
                n = len(shingles)
                if not n:
                    rows.append((0, 0, 0, 0, [], [], []))
                    continue
                levels = levels_of[(shingles >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)]
                order = np.argsort(levels, kind="stable")
                base = n - int(need(n, percent)) + 1
                own = chosen_matches(levels[order], base)
                size = max(64 * BITMAP_WORDS, 1 << (n - 1).bit_length())
                bits = np.bincount((_mixed(shingles) >> np.uint64(32)).astype(np.int64) % size, minlength=size) & 1
                wide = np.packbits(bits.astype(np.uint8)).view(np.int64)
                narrow = np.bitwise_xor.reduce(wide.reshape(-1, BITMAP_WORDS), axis=0)
                signature = np.frombuffer(xxhash.xxh3_128_digest(shingles.tobytes()), np.int64)
                rows.append((n, signature[0], signature[1], own, shingles[order[: base + own - 1]].view(np.int64), narrow, wide if len(wide) > BITMAP_WORDS else []))
            n, signature, signature2, own, prefix, narrow, wide = zip(*rows, strict=True) if rows else [()] * 7
            yield pa.RecordBatch.from_arrays([
                batch.column(0), batch.column(2), pa.array(n, pa.int32()), pa.array(signature, pa.int64()), pa.array(signature2, pa.int64()), pa.array(own, pa.int32()),
                pa.array(prefix, pa.list_(pa.int64())), pa.array(narrow, pa.list_(pa.int64())), pa.array(wide, pa.list_(pa.int64())),
            ], names=["doc_id", "text_hash", "n", "signature", "signature2", "matches", "prefix", "bitmap", "wide"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("text_hash"))
    return written(texts.mapInArrow(run, PREFIXES).withColumn("node", F.monotonically_increasing_id()), "prefixes")


def repeated_tokens(table: DataFrame, tokens: int) -> tuple[int, np.ndarray]:
    """The shift and the bitmap of cells that two prefix tokens or more fall in; a token alone in its cell is in one document only.

    Tasks deal their cells out by segment of the bitmap, so the cells of a segment meet in one task; a task's share is bounded by the
    number of segments, which grows with the tokens, and the bitmap by MOST_CELLS.
    """
    bits = min(MOST_CELLS.bit_length() - 1, max(SEGMENT_BITS, int(8 * tokens).bit_length() - 1))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = np.sort(batch.column(0).flatten().to_numpy().view(np.uint64) >> np.uint64(64 - bits)).astype(np.uint32)
            segments = cells >> np.uint32(SEGMENT_BITS)
            cuts = np.concatenate([[0], np.flatnonzero(np.diff(segments)) + 1, [len(cells)]]) if len(cells) else [0]
            yield pa.RecordBatch.from_arrays([
                pa.array([int(segments[c]) for c in cuts[:-1]], pa.int32()),
                pa.array([cells[x:y].tobytes() for x, y in zip(cuts, cuts[1:])], pa.binary()),
            ], names=["segment", "cells"])

    def meet(group: pa.Table) -> pa.Table:
        cells = np.sort(np.frombuffer(b"".join(group.column("cells").to_pylist()), np.uint32))
        often = cells[1:][cells[1:] == cells[:-1]] & np.uint32((1 << SEGMENT_BITS) - 1)
        flags = np.zeros(1 << SEGMENT_BITS, bool)
        flags[often] = True
        return pa.table({"segment": group.column("segment")[:1], "bits": pa.array([np.packbits(flags, bitorder="little").tobytes()], pa.binary())})

    dealt = table.select("prefix").mapInArrow(deal, "segment int, cells binary")
    rows = dealt.groupBy("segment").applyInArrow(meet, "segment int, bits binary").collect()
    bitmap_ = np.zeros((1 << bits) // 64 + 1, np.int64)
    step = (1 << SEGMENT_BITS) // 64
    for row in rows:
        bitmap_[row["segment"] * step:(row["segment"] + 1) * step] = np.frombuffer(row["bits"], np.int64)
    return 64 - bits, bitmap_


def _lists(tokens: DataFrame) -> DataFrame:
    """token, weight, size and leader (smallest node) of every list of nodes that share a token, one for each set of nodes.

    A passage that the same documents hold gives one list for each of its tokens; the smallest of these tokens stands for all, and weight
    is their number. Sets of nodes are told apart by size, smallest node and a 64-bit sum of their hashes.
    """
    by_token = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("size"), F.min("node").alias("leader"), F.bit_xor(F.xxhash64("node")).alias("nodes")).where("size > 1")
    return by_token.groupBy("size", "leader", "nodes").agg(F.min("token").alias("token"), F.count(F.lit(1)).alias("weight")).drop("nodes")


def _node_cells(nodes: DataFrame) -> tuple[Column, np.ndarray]:
    """The cell of a node, and the bitmap of the nodes' cells."""
    cells = min(MOST_CELLS, max(1024, CELLS_PER_NODE * nodes.count()))
    cell = F.pmod(F.xxhash64(F.col("node")), F.lit(cells)).alias("cell")
    return cell, bitmap(nodes.select(cell), cells)


def _postings(table: DataFrame, nodes: DataFrame) -> DataFrame:
    """node and token of the prefix tokens that may stand in two documents.

    A bitmap leaves out documents that are no node, that is copies of one. A copy that it lets through needlessly is one more node with
    the same set, which does no harm.
    """
    tokens = table.agg(F.sum(F.size("prefix"))).first()[0] or 0
    shift, bits = repeated_tokens(table, tokens)
    cell, node_bits = _node_cells(nodes)
    filled = table.sparkSession.sparkContext.broadcast((bits, node_bits))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token_bits, own_bits = filled.value
        for batch in batches:
            batch = batch.filter(pa.array(marked(own_bits, batch.column(2).to_numpy())))
            lists = batch.column(1)
            sizes = lists.value_lengths().to_numpy()
            flat = lists.flatten().to_numpy()
            owner = np.repeat(np.arange(len(sizes)), sizes)
            maybe = marked(token_bits, (flat.view(np.uint64) >> np.uint64(shift)).astype(np.int64))
            owner, flat = owner[maybe], flat[maybe]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(owner)), pa.array(flat, pa.int64())], names=["node", "token"])

    return table.select("node", "prefix", cell).mapInArrow(run, "node long, token long")


def _overlap_bound(a: str, b: str) -> Column:
    """Twice the largest overlap that the bitmaps allow: elements in one set only differ in at least as many bits."""
    apart = reduce(lambda x, y: x + y, [F.bit_count(F.col(f"{a}.b{i}").bitwiseXOR(F.col(f"{b}.b{i}"))) for i in range(BITMAP_WORDS)])
    return F.col(f"{a}.n") + F.col(f"{b}.n") - apart


def _may_link(a: str, b: str, percent: int) -> Column:
    """Sizes and bitmaps leave room for a link: 100 * overlap >= percent * (n_a + n_b - overlap)."""
    n = F.col(f"{a}.n") + F.col(f"{b}.n")
    return (100 * F.least(F.col(f"{a}.n"), F.col(f"{b}.n")) >= percent * F.greatest(F.col(f"{a}.n"), F.col(f"{b}.n"))) & (
        (100 + percent) * _overlap_bound(a, b) >= 2 * percent * n)


def _narrowed(pairs: DataFrame, wides: DataFrame, percent: int) -> DataFrame:
    """The pairs whose wide bitmaps leave room for a link; wides has node, n and wide of the large sets.

    The wider of two is folded to the size of the other: its halves, one over the other, are the bitmap of half the size.
    """
    one, two = (wides.select(F.col("node").alias(x), F.col("n").alias(f"n{x}"), F.col("wide").alias(f"w{x}")) for x in "ab")
    both = pairs.join(one, "a", "left").join(two, "b", "left")

    def xor(x: Column, y: Column) -> Column:
        return F.zip_with(x, y, lambda p, q: p.bitwiseXOR(q))

    def folded(x: Column, y: Column) -> Column:
        half = (F.size(x) / 2).cast("int")
        return F.when(F.size(x) > F.size(y), xor(F.slice(x, 1, half), F.slice(x, half + 1, half))).otherwise(x)

    a, b = F.col("wa"), F.col("wb")
    apart = F.aggregate(xor(folded(a, b), folded(b, a)), F.lit(0), lambda s, w: s + F.bit_count(w))
    n = F.col("na") + F.col("nb")
    return both.where(F.coalesce((100 + percent) * (n - apart) >= 2 * percent * n, F.lit(True))).select("a", "b")


def _linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets link; sets has node and shingles."""
    both = (pairs.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa")), "a")
            .join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb")), "b"))
    common = F.size(F.array_intersect("sa", "sb"))
    return both.where(100 * common >= percent * (F.size("sa") + F.size("sb") - common)).select("a", "b")


def _verified(docs: DataFrame, pairs: DataFrame, table: DataFrame, wides: DataFrame, k: int, percent: int, label: str) -> DataFrame:
    """The pairs whose sets link, written; table has the documents of the nodes."""
    pairs = written(_narrowed(pairs, wides, percent), "pairs")
    nodes = pairs.select(F.col("a").alias("node")).unionAll(pairs.select(F.col("b").alias("node"))).distinct()
    nodes = written(table.select("node", "doc_id", "signature", "signature2").join(nodes, "node"), "pair-nodes")
    if not nodes.head(1):
        return pairs
    sets = written(_candidate_sets(docs, nodes, k), "sets")
    return written(_linked(pairs, sets, percent), label)


def _candidate_sets(docs: DataFrame, nodes: DataFrame, k: int) -> DataFrame:
    """node and shingles of the documents that stand in candidate pairs; sets are built again from the text, whole.

    A bitmap of their doc_ids picks the documents where they are read, so no text moves; the set's signature tells apart texts that share
    a doc_id, and those that the bitmap lets through needlessly go.
    """
    cell, node_bits = _node_cells(nodes.select(F.col("doc_id").alias("node")))
    filled = docs.sparkSession.sparkContext.broadcast(node_bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = filled.value
        for batch in batches:
            batch = batch.filter(pa.array(marked(bits, batch.column(2).to_numpy())))
            sets = [x.view(np.int64) for x in shingle_sets(batch.column(1).to_pylist(), k)]
            signatures = np.array([np.frombuffer(xxhash.xxh3_128_digest(x.tobytes()), np.int64) for x in sets], np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array(signatures[:, 0]), pa.array(signatures[:, 1]), pa.array(sets, pa.list_(pa.int64()))],
                names=["_doc_id", "_signature", "_signature2", "shingles"])

    texts = docs.select(F.col("doc_id").cast("long").alias("node"), "text").where("node is not null").select("node", "text", cell)
    sets = texts.mapInArrow(run, "_doc_id long, _signature long, _signature2 long, shingles array<long>")
    same = (F.col("doc_id") == F.col("_doc_id")) & (F.col("signature") == F.col("_signature")) & (F.col("signature2") == F.col("_signature2"))
    return sets.join(nodes, same).select("node", "shingles").dropDuplicates(["node"])


def components(links: DataFrame, label: str) -> DataFrame:
    """node and component, the smallest node it reaches, of every node of the links (a, b).

    Large-star and small-star steps in turn: each joins neighbours to the smallest of them, so a component of any shape becomes a star
    in a number of steps that grows with the logarithm of its length. Each step is written.
    """
    edges = written(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), label)
    state = None
    while True:
        now = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.col("a").cast("decimal(20)") - F.col("b"))).first()
        if now == state or now[0] == 0:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionAll(
                edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
        state = now
        ways = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = ways.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = ways.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (large.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
                 .unionAll(low.select("a", F.col("m").alias("b"))).distinct())
        edges = written(small, label)


def _mixed_lists(listed: DataFrame, groups: DataFrame) -> DataFrame:
    """token, size, largest group and apart, the number of pairs across groups, of the lists that hold several groups; written."""
    rows = listed.where("size > 2").select("token", "node").join(groups, "node", "left").select("token", F.coalesce("component", "node").alias("component"))
    by_group = rows.groupBy("token", "component").agg(F.count(F.lit(1)).alias("members"))
    return written(by_group.groupBy("token").agg(
        F.max_by("component", F.struct("members", "component")).alias("largest"), F.count(F.lit(1)).alias("groups"), F.sum("members").alias("size"),
        ((F.sum("members") * F.sum("members") - F.sum(F.col("members") * F.col("members"))) / 2).alias("apart")).where("groups > 1").drop("groups"), "mixed")


def similar_components(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of docs (columns doc_id and text are read).

    Documents link when 100 * |intersection| >= percent * |union| of their sets of k-word shingles; a document of fewer words is one
    shingle; one without words or text has an empty set and stays alone. component_id is the smallest doc_id reachable by links.
    Rows that repeat a doc_id are linked each by its own text. Rows with a null doc_id take no part in links: their component is
    null. An empty table gives no rows.
    """
    return _grouped(docs, k, percent).select("doc_id", F.col("n").cast("long").alias("n_shingles"), "component_id")


def _grouped(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """doc_id, text_hash, n, component_id and chosen, whether the row's set is the one that stands for its component, of every row."""
    table = prefixes(docs, k, percent)
    some = table.where("n > 0 and doc_id is not null")
    # Equal sets are one node, a row of theirs.
    classes = written(some.groupBy(*SET).agg(F.min("node").alias("node"), F.min("doc_id").alias("first")), "classes")
    tokens = written(_postings(some, classes.select("node")), "tokens")
    # Written before it is joined: a frequent token is a skewed key, which adaptive execution splits only between two plain shuffles.
    shared = written(_lists(tokens), "shared")
    # A bitmap leaves out most postings, whose token no list is named after, where they are.
    _, named_after = split_by(tokens, F.col("token"), shared.select("token"))
    listed = written(named_after.join(shared, "token"), "listed")
    marks = written(some.join(listed.select("node").distinct(), "node", "left_semi").select("node", "n", "matches", *[
        F.col("bitmap")[i].alias(f"b{i}") for i in range(BITMAP_WORDS)]), "marks")

    def marked_as(name: str) -> DataFrame:
        return marks.select(F.struct(*[c for c in marks.columns]).alias(name))

    def checked(pairs: DataFrame) -> DataFrame:
        return (pairs.distinct().join(marked_as("x"), F.col("a") == F.col("x.node")).join(marked_as("y"), F.col("b") == F.col("y.node"))
                .where(_may_link("x", "y", percent)).select("a", "b"))

    # First round: every document and the leader of each of its lists, each pair once.
    first = checked(listed.where("node <> leader").select(F.col("node").alias("a"), F.col("leader").alias("b")))
    wides = some.where("size(wide) > 0").select("node", "n", "wide")
    wides = written(wides.join(marks.select("node"), "node", "left_semi"), "wide-bitmaps")
    links = _verified(docs, first, some, wides, k, percent, "first-links")
    groups = components(links, "first-groups")

    # Rounds of leaders picked anew: every list is dealt into short ones, whose members meet one of them.
    for turn in range(MOST_TURNS):
        mixed = _mixed_lists(listed, groups)
        # Lists of a few groups are left to the last round: as many pairs as postings, or so, is no growth.
        left = mixed.agg(F.sum("apart"), F.sum("size")).first()
        if not left[0] or left[0] <= PAIRS_PER_POSTING * left[1]:
            break
        rows = written(listed.select("node", "token").join(mixed.select("token", "size"), "token").join(groups, "node", "left").select(
            "token", F.pmod(F.xxhash64("node", F.lit(turn)), F.ceil(F.col("size") / SHORT_LIST)).alias("part"), "node",
            F.coalesce("component", "node").alias("component")), "short-lists")
        heads = rows.groupBy("token", "part").agg(F.max_by(F.struct("node", "component"), F.xxhash64("node", F.lit(-1 - turn))).alias("head"))
        met = rows.join(heads, ["token", "part"]).where(F.col("component") != F.col("head.component"))
        new = _verified(docs, checked(met.select(F.least("node", "head.node").alias("a"), F.greatest("node", "head.node").alias("b"))), some, wides, k, percent, "turn-links")
        if not new.head(1):
            break
        links = links.unionAll(new)
        groups = components(links, "turn-groups")

    # Last round: lists that still hold several groups. A pair with the list's leader has been decided, so a list of two has too.
    mixed = _mixed_lists(listed, groups).select("token", "largest")
    rest = listed.drop("size").join(mixed, "token").join(groups, "node", "left").withColumn("component", F.coalesce("component", "node"))
    rest = written(rest.where("node <> leader").drop("leader").join(marks, "node"), "mixed-lists")
    outside, whole = rest.where("component <> largest"), rest
    # A pair of two outsiders comes up from both sides and is kept once.
    once = (F.col("y.component") == F.col("y.largest")) | (F.col("x.node") < F.col("y.node"))
    matched = F.least("x.matches", "y.matches")
    across = (outside.alias("x").join(whole.alias("y"), (F.col("x.token") == F.col("y.token")) & (F.col("x.component") != F.col("y.component"))
                                      & once & _may_link("x", "y", percent))
              .groupBy(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b"))
              .agg(F.sum("x.weight").alias("common"), F.min(matched).alias("l")).where("common >= l").select("a", "b"))
    second = _verified(docs, written(across, "second-pairs"), some, wides, k, percent, "second-links")
    final = components(links.unionAll(second), "groups")

    named = written(classes.join(final, "node", "left").withColumn("component", F.coalesce("component", "node")), "named")
    least = named.groupBy("component").agg(F.min(F.struct("first", "node")).alias("least"))
    labels = written(named.join(least, "component").select(*[F.col(c).alias(f"_{c}") for c in SET], F.col("least.first").alias("component_id"), (
        F.col("node") == F.col("least.node")).alias("chosen")), "labels")
    same = [F.col(c) == F.col(f"_{c}") for c in SET] + [F.col("n") > 0, F.col("doc_id").isNotNull()]
    found = table.join(labels, reduce(lambda x, y: x & y, same), "left")
    return found.select("doc_id", "text_hash", "n", F.coalesce("component_id", "doc_id").alias("component_id"), F.coalesce("chosen", F.lit(True)).alias("chosen"))


def one_of_each_group(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """docs with one document of each group of near duplicates, the one of smallest doc_id; of texts that share it, one. All columns stay.

    Rows with a null doc_id, and those without words, stay. Rows equal in doc_id and text stay or go together.
    """
    gone = _grouped(docs, k, percent).where((F.col("doc_id") != F.col("component_id")) | ~F.col("chosen"))
    keys = gone.select(F.struct("doc_id", "text_hash").alias("key")).distinct()
    return without_listed(docs, F.struct(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash")), written(keys, "dropped"))
