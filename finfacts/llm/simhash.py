"""SimHash near duplicates by pivot distance tables.

A fingerprint is compared by its Hamming distances to references. Two fingerprints that differ in at most d bits have distances to any
reference that differ by at most d, so a pair whose largest difference over all references is greater is discarded unseen; survivors
are verified bit by bit. The references are rows of a Hadamard matrix, on all 64 bits and on each of m segments of them: d bits touch at
most d segments, so on the references of the other m - d segments all distances agree. Distances to the Hadamard rows of a segment tell
its bits and the other way round, so that agreement is equality of the segment's bits, and Spark groups by it; within a group the whole
references discard pairs. m grows with the number of different fingerprints, so groups of chance stay small at any size.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from finfacts.llm.jaccard import components
from finfacts.llm.shared import give_token_memory_back, written

#: Shingles whose hashes are added up at a time.
TOGETHER = 1 << 15
#: References on the whole fingerprint that discard pairs within a group.
REFERENCES = 16
#: Fingerprints of a group, or of a block of a larger one, that one step of a task compares.
BLOCK = 2048
#: What a compared pair costs against writing and reading one row of a group.
PAIR_COST = 0.01
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
SEED = 42


def fingerprint(text: str | None, k: int = 4) -> int:
    """The 64 bits that are set in over half of the hashes of the k-word shingles of a text; 0 for no words."""
    words = (text or "").encode().translate(LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = max(1, len(words) - k + 1)
    starts, ends = starts[:n].tolist(), ends[min(k, len(words)) - 1:].tolist()
    ones = np.zeros(64, np.int64)
    digest = xxhash.xxh64_intdigest
    for at in range(0, n, TOGETHER):
        hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(starts[at:at + TOGETHER], ends[at:at + TOGETHER])], "<u8")
        ones += np.unpackbits(hashes.view(np.uint8), bitorder="little").reshape(-1, 64).sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, k: int) -> DataFrame:
    """doc_id and fingerprint (a signed long) of every row, written."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_token_memory_back()
        for batch in batches:
            own = np.array([fingerprint(t, k) for t in batch.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(own.view(np.int64))], names=["doc_id", "fingerprint"])

    return written(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, fingerprint long"), "fingerprints")


def references(count: int = REFERENCES) -> np.ndarray:
    """Rows of the Hadamard matrix of 64: any two are 32 bits apart."""
    rows = (np.arange(count) * 64 // count + 3) % 64
    parity = np.bitwise_count(rows[:, None] & np.arange(64)) & 1
    return np.packbits(parity.astype(np.uint8), axis=1, bitorder="little").view("<u8")[:, 0]


def distance_table(prints: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Hamming distances of fingerprints to references, a row for each reference."""
    return np.bitwise_count(prints[None, :] ^ pivots[:, None]).astype(np.int8)


def survivors(table: np.ndarray, one: np.ndarray, two: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of columns of the table that no reference discards."""
    for row in table:
        close = np.abs(row[one] - row[two]) <= most
        one, two = one[close], two[close]
        if not len(one):
            break
    return one, two


def segment_count(prints: int, most: int) -> int:
    """The number of segments for which groups and the pairs in them are estimated to cost least."""

    def cost(m: int) -> float:
        groups = comb(m, most)
        return groups * (1 + PAIR_COST * prints / 2 ** (64 * (m - most) / m))

    return min(range(most + 1, 3 * most + 2), key=cost)


def segment_masks(m: int, most: int) -> list[int]:
    """For every choice of m - most of m segments, the bits in them."""
    cuts = [64 * i // m for i in range(m + 1)]
    segments = [(1 << b) - (1 << a) for a, b in zip(cuts, cuts[1:])]
    return [sum(segments[i] for i in chosen) for chosen in combinations(range(m), m - most)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def linked_in(prints: np.ndarray, sides: np.ndarray, most: int, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that join what linked pairs of one group join, each new link between two parts not joined yet.

    With sides 0 and 1 only pairs of different sides are looked at, with sides 2 all.
    """
    order = np.argsort(prints, kind="stable")
    prints, sides = prints[order], sides[order]
    table = distance_table(prints, pivots)
    part = np.arange(len(prints))
    one, two = [], []
    for i in range(len(prints) - 1):
        apart = part[i + 1:] != part[i]
        if sides[i] < 2:
            apart &= sides[i + 1:] != sides[i]
        near = np.flatnonzero(apart & (np.abs(table[0, i + 1:] - table[0, i]) <= most)) + i + 1
        if len(near):
            _, near = survivors(table[1:], np.full(len(near), i), near, most)
            near = near[np.bitwise_count(prints[near] ^ prints[i]) <= most]
        if len(near):
            _, firsts = np.unique(part[near], return_index=True)
            one.append(np.full(len(firsts), prints[i]))
            two.append(prints[near[firsts]])
            part[np.isin(part, part[near])] = part[i]
    empty = [np.zeros(0, np.uint64)]
    return np.concatenate(one or empty), np.concatenate(two or empty)


#: Up to this size groups are compared together, by rows so many places apart.
SMALL = 48


def _small_groups(keys: np.ndarray, prints: np.ndarray, most: int, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Linked pairs within small groups; rows come sorted by key."""
    table = distance_table(prints, pivots)
    found = []
    for step in range(1, SMALL):
        one = np.flatnonzero(keys[step:] == keys[:-step])
        if not len(one):
            break
        one, two = survivors(table, one, one + step, most)
        close = np.bitwise_count(prints[one] ^ prints[two]) <= most
        found.append(np.stack([prints[one[close]], prints[two[close]]]))
    both = np.concatenate(found, axis=1) if found else np.zeros((2, 0), np.uint64)
    return both[0], both[1]


def _compare(grouped: DataFrame, most: int) -> DataFrame:
    """Links (a, b) of rows (key, side, fingerprint) that come dealt and sorted by key; groups hold two blocks at most."""
    pivots = references()

    def links(keys: np.ndarray, sides: np.ndarray, prints: np.ndarray) -> pa.RecordBatch:
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(keys)) + 1, [len(keys)]])
        sizes = np.diff(cuts)
        small = np.repeat((sizes <= SMALL) & (sides[cuts[:-1]] == 2), sizes)
        ones, twos = _small_groups(keys[small], prints[small], most, pivots)
        ones, twos = [ones], [twos]
        for a, b in zip(cuts[:-1], cuts[1:]):
            if not small[a]:
                x, y = linked_in(prints[a:b], sides[a:b], most, pivots)
                ones.append(x)
                twos.append(y)
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).view(np.int64)) for x in (ones, twos)], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(0, np.int64), np.zeros(0, np.int8), np.zeros(0, np.uint64)]
        for batch in batches:
            new = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2).to_numpy().view(np.uint64)
            held = [np.concatenate(x) for x in zip(held, new, strict=True)]
            keys = held[0]
            done = int(np.searchsorted(keys, keys[-1])) if len(keys) else 0  # the last group may go on in the next batch
            if done:
                yield links(*(x[:done] for x in held))
                held = [x[done:] for x in held]
        if len(held[0]):
            yield links(*held)

    return grouped.mapInArrow(run, "a long, b long")


def near_links(prints: DataFrame, most: int, block: int = BLOCK, segments: int | None = None) -> DataFrame:
    """Links (a, b) that join all fingerprints that pairs at most so many bits apart join; prints has distinct ones in its one column.

    A group of more than a block is dealt into blocks of fingerprints at one distance from a reference; each pair of blocks whose
    distances differ by no more than most is compared in a step of its own, so no task holds more than two blocks of a group.
    """
    m = segments or segment_count(prints.count(), most)
    masks = segment_masks(m, most)
    choices = F.array(*[F.xxhash64(F.lit(i), F.col("fingerprint").bitwiseAND(F.lit(_signed(x)))) for i, x in enumerate(masks)])
    rows = prints.select(F.explode(choices).alias("key"), "fingerprint")
    sizes = rows.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    hot = written(sizes.where(F.col("size") > block), "hot-groups")
    usual = _compare(rows.withColumn("side", F.lit(2).cast("byte")).select("key", "side", "fingerprint")
                     .repartition("key").sortWithinPartitions("key"), most) if not hot.head(1) else None
    if usual is not None:
        return written(usual.distinct(), "links")
    marked = written(rows.join(hot, "key", "left"), "grouped")
    usual = _compare(marked.where("size is null").select("key", F.lit(2).cast("byte").alias("side"), "fingerprint")
                     .repartition("key").sortWithinPartitions("key"), most)
    pivot = F.lit(_signed(int(references()[0])))
    placed = marked.where("size is not null").select("key", "fingerprint", F.bit_count(F.col("fingerprint").bitwiseXOR(pivot)).alias("distance"))
    counts = placed.groupBy("key", "distance").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("parts"))
    placed = placed.join(counts, ["key", "distance"]).select(
        "key", "fingerprint", "distance", F.pmod(F.xxhash64("fingerprint"), F.col("parts")).cast("int").alias("part"))
    placed = written(placed, "blocks")
    blocks = counts.select("key", "distance", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    other = blocks.select(F.col("key").alias("key2"), F.col("distance").alias("distance2"), F.col("part").alias("part2"))
    after = (F.col("distance2") > F.col("distance")) | ((F.col("distance2") == F.col("distance")) & (F.col("part2") >= F.col("part")))
    meets = written(blocks.join(other, (F.col("key") == F.col("key2")) & F.col("distance2").between(F.col("distance"), F.col("distance") + most) & after), "block-pairs")
    pair = F.xxhash64("key", "distance", "part", "distance2", "part2").alias("pair")
    alone = (F.col("distance") == F.col("distance2")) & (F.col("part") == F.col("part2"))
    first = meets.select("key", "distance", "part", pair, F.when(alone, 2).otherwise(0).cast("byte").alias("side"))
    second = meets.where(~alone).select("key", F.col("distance2").alias("distance"), F.col("part2").alias("part"), pair, F.lit(1).cast("byte").alias("side"))
    dealt = placed.join(first.unionAll(second), ["key", "distance", "part"]).select(F.col("pair").alias("key"), "side", "fingerprint")
    return written(usual.unionAll(_compare(dealt.repartition("key").sortWithinPartitions("key"), most)).distinct(), "links")


def simhash_components(docs: DataFrame, k: int = 4, most: int = 4) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits) and component_id of every row of docs (columns doc_id and text are read).

    Fingerprints link where at most so many bits differ; component_id is the smallest doc_id reachable by links. Null and empty texts
    and texts without words have fingerprint 0 and link like others; texts of fewer than k words are one shingle; very long texts are
    hashed whole. Rows that repeat a doc_id are linked each by its own text. Rows with a null doc_id link nothing, and their component
    is null. An empty table gives no rows; further columns are not read.
    """
    table = fingerprints(docs, k)
    distinct = written(table.where("doc_id is not null").groupBy("fingerprint").agg(F.min("doc_id").alias("first")), "distinct-fingerprints")
    groups = components(near_links(distinct.select("fingerprint"), most), "fingerprint-groups")
    named = distinct.join(groups.withColumnRenamed("node", "fingerprint"), "fingerprint", "left").withColumn("component", F.coalesce("component", "fingerprint"))
    named = written(named, "grouped-fingerprints")
    least = named.groupBy("component").agg(F.min("first").alias("component_id"))
    labels = written(named.join(least, "component").select(F.col("fingerprint").alias("_fingerprint"), "component_id"), "fingerprint-labels")
    found = table.join(labels, (F.col("fingerprint") == F.col("_fingerprint")) & F.col("doc_id").isNotNull(), "left")
    return found.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")
