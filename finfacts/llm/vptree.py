"""Nearest vectors by largest inner product, from vantage-point trees.

Within a shard of the vectors one more coordinate, sqrt(M^2 - |x|^2) with M the longest norm, makes all norms equal, so the largest inner
product is the smallest distance and the triangle inequality holds. A tree splits its points at the median distance from a vantage point;
a branch is left out where that distance cannot be overcome within the best distance so far divided by a factor. Factor one is exact.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from finfacts.llm.shared import tasks_for, written

#: Vectors of a shard, of a leaf, and queries that go through a tree together.
SHARD, LEAF, BLOCK = 8192, 128, 512
#: Blocks of queries that one task takes through one tree.
BLOCKS_PER_TASK = 64
#: How much the triangle bound is tightened: 1 is exact, more leaves out more.
FACTOR = 1.5


@dataclass
class Node:
    """A leaf (points) or a split: vantage point, distance of the split, inside and outside."""

    points: np.ndarray | None
    vantage: np.ndarray | None = None
    radius: float = 0.0
    inside: Node | None = None
    outside: Node | None = None


@dataclass
class Tree:
    ids: np.ndarray
    vectors: np.ndarray
    longest: float
    root: Node


def build(ids: np.ndarray, vectors: np.ndarray, leaf: int = LEAF) -> Tree:
    """Vantage points are the points farthest from the mean of their branch; equal distances stay on one side."""
    order = np.argsort(ids, kind="stable")
    ids, vectors = ids[order], vectors[order]
    norms = (vectors * vectors).sum(1)
    longest = float(norms.max(initial=0.0))
    lifted = np.hstack([vectors, np.sqrt(np.maximum(longest - norms, 0))[:, None]])

    def split(points: np.ndarray) -> Node:
        if len(points) <= leaf:
            return Node(points)
        own = lifted[points]
        vantage = own[np.argmax(((own - own.mean(0)) ** 2).sum(1))]
        distance = np.sqrt(((own - vantage) ** 2).sum(1))
        radius = float(np.median(distance))
        near = distance <= radius
        if near.all():
            near = distance < radius
        if near.all() or not near.any():
            return Node(points)  # all at one distance: copies of one vector stay together
        return Node(None, vantage, radius, split(points[near]), split(points[~near]))

    return Tree(ids, vectors, longest, split(np.arange(len(ids))))


def search(tree: Tree, query_ids: np.ndarray, queries: np.ndarray, k: int, factor: float) -> tuple[np.ndarray, np.ndarray]:
    """Ids and inner products of the k best points of each query, best first, ties to the smaller id; -inf beyond the points found."""
    count = len(queries)
    best_ids = np.full((count, k), np.iinfo(np.int64).max)
    best = np.full((count, k), -np.inf)
    norms = (queries * queries).sum(1)
    lifted = np.hstack([queries, np.zeros((count, 1))])

    def reach(who: np.ndarray) -> np.ndarray:
        """How far the k-th best point of each query is."""
        return np.sqrt(np.maximum(norms[who] + tree.longest - 2 * best[who, -1], 0)) / factor

    def visit(node: Node, who: np.ndarray) -> None:
        if not len(who):
            return
        if node.points is not None:
            # Products by einsum: summed alike for equal vectors, wherever they stand.
            products = np.einsum("qd,pd->qp", queries[who], tree.vectors[node.points])
            found = tree.ids[node.points]
            products[query_ids[who][:, None] == found[None, :]] = -np.inf
            all_ids = np.hstack([best_ids[who], np.where(np.isneginf(products), np.iinfo(np.int64).max, np.broadcast_to(found, products.shape))])
            all_products = np.hstack([best[who], products])
            order = np.lexsort((all_ids, -all_products), axis=1)[:, :k]
            best_ids[who], best[who] = np.take_along_axis(all_ids, order, 1), np.take_along_axis(all_products, order, 1)
            return
        distance = np.sqrt(((lifted[who] - node.vantage) ** 2).sum(1))
        gap = distance - node.radius
        first_in = gap <= 0
        visit(node.inside, who[first_in])
        visit(node.outside, who[~first_in])
        # Rounding must not leave out a point at the very distance of the k-th.
        slack = 1e-9 * (1 + distance)
        visit(node.outside, who[first_in & (-gap <= reach(who) + slack)])
        visit(node.inside, who[~first_in & (gap <= reach(who) + slack)])

    visit(tree.root, np.arange(count))
    return best_ids, best


def clean_vectors(vectors: DataFrame) -> DataFrame:
    """vec_id and embedding (doubles) of the rows that take part, one for each vec_id."""
    doubles = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    usable = doubles.where("vec_id is not null and embedding is not null and size(embedding) > 0").where(
        F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists("embedding", lambda x: x != 0))
    one = usable.groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    return one


def nearest(vectors: DataFrame, every: int, k: int, factor: float = FACTOR, shard: int = SHARD) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest vectors found of every vector whose vec_id is divisible by every.

    score is the inner product of the vectors as given, in double precision. Vectors that are null, empty, zero or hold null or
    non-finite components take no part, nor does a row without vec_id, nor, where lengths differ, any of another length than most have.
    Rows that repeat a vec_id are one vector, the smallest. A query is not its own candidate; with fewer than k candidates all are
    returned. An empty table gives no rows.
    """
    table = written(clean_vectors(vectors), "vectors")
    lengths = table.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if lengths is None:
        return table.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    table = table.where(F.size("embedding") == lengths["d"])
    rows = table.count()
    shards = tasks_for(rows, shard)
    asked = table.where(F.col("vec_id") % every == 0)
    blocks = tasks_for(asked.count(), BLOCK)
    slots = tasks_for(blocks, BLOCKS_PER_TASK)

    def plant(group: pa.Table) -> pa.Table:
        tree = build(group.column("vec_id").to_numpy(), _matrix(group.column("embedding")))
        return pa.table({"shard": group.column("shard")[:1], "body": pa.array([pickle.dumps(tree)], pa.binary())})

    def bundle(group: pa.Table) -> pa.Table:
        body = pickle.dumps((group.column("vec_id").to_numpy(), _matrix(group.column("embedding"))))
        return pa.table({"block": group.column("block")[:1], "body": pa.array([body], pa.binary())})

    trees = table.withColumn("shard", F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("int")).groupBy("shard").applyInArrow(plant, "shard int, body binary")
    bundles = asked.withColumn("block", F.pmod(F.xxhash64("vec_id", F.lit(7)), F.lit(blocks)).cast("int")).groupBy("block").applyInArrow(bundle, "block int, body binary")
    # Every tree is sent to each slot, every block of queries to its slot of each shard; in a slot the tree comes first.
    sent = trees.select("shard", F.explode(F.sequence(F.lit(0), F.lit(slots - 1))).alias("slot"), F.lit(-1).alias("block"), "body").unionByName(
        written(bundles, "query-blocks").select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), (F.col("block") % slots).alias("slot"), "block", "body"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = None
        for batch in batches:
            for block, body in zip(batch.column(2).to_pylist(), batch.column(3), strict=True):
                loaded = pickle.loads(body.as_buffer())
                if block < 0:
                    tree = loaded
                    continue
                ids, queries = loaded
                found, products = search(tree, ids, queries, k, factor)
                real = ~np.isneginf(products)
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.repeat(ids, k)[real.ravel()]), pa.array(found[real]), pa.array(products[real])], names=["query_id", "vec_id", "score"])

    found = sent.repartition(max(shards * slots, 1), "shard", "slot").sortWithinPartitions("shard", "slot", "block").mapInArrow(run, "query_id long, vec_id long, score double")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    whole = column.combine_chunks()
    if isinstance(whole, pa.ChunkedArray):
        whole = whole.chunk(0)
    return whole.flatten().to_numpy().reshape(len(whole), -1)
