"""Approximate search by angle: a forest of random-projection trees over unit vectors.

A tree halves its nodes level by level: the vectors of a node are projected on the tree's
direction of that level (the difference of two drawn vectors) and cut at their median.  Vectors
that lie on the cut go to both sides by a hash of their row, so equal vectors never fill a leaf.

*Build*: one pass per level; tasks project, Spark's mergeable quantile sketches give the medians
of all nodes and trees at once.  The model holds the directions and one number per node, at most
``MAX_NODES``; beyond that leaves grow.  *Index*: a narrow table (tree, leaf, row_index), sorted,
so a search reads only some leaves.  *Search*: per tree the leaf of the query and those whose
cuts are nearest to it; their vectors are compared exactly.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchlake import vocab as V

TREES = 50
LEAF_ROWS = 32
MAX_NODES = 4_000_000
#: Leaves that a search takes from a tree for every ``LEAF_ROWS`` results asked.
PROBES = 2
#: Relative error of the medians: 1 / ACCURACY of a node's rows.
ACCURACY = 1_000


@dataclass
class Forest:
    """``directions`` (trees, levels, dimension), and per level the cuts (trees, nodes)."""

    directions: np.ndarray
    cuts: list[np.ndarray]

    @property
    def depth(self) -> int:
        return len(self.cuts)

    def project(self, x: np.ndarray, level: int) -> np.ndarray:
        """(rows, trees); rounded, so that equal vectors lie on the same cut everywhere."""
        return np.round(x @ self.directions[:, level].T, 6)

    def nodes(self, x: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Node of every row in every tree after all levels."""
        node = np.zeros((len(x), len(self.directions)), np.int64)
        tree = np.arange(node.shape[1])
        for level, cut in enumerate(self.cuts):
            value, at = self.project(x, level), cut[tree, node]
            node = 2 * node + ((value > at) | (value == at) & _coin(rows, tree, level))
        return node

    def probe(self, x: np.ndarray, leaves: int) -> np.ndarray:
        """Up to ``leaves`` leaves per row and tree: (row, tree, leaf) triples.

        Far sides cost the squared distance to the cut; the cheapest ways go on.
        """
        tree = np.arange(len(self.directions))[None, :, None]
        node = np.zeros((len(x), tree.shape[1], 1), np.int64)
        cost = np.zeros(node.shape)
        for level, cut in enumerate(self.cuts):
            away = self.project(x, level)[:, :, None] - cut[tree, node]
            near = (away > 0).astype(np.int64)
            node = np.concatenate([2 * node + near, 2 * node + 1 - near], 2)
            cost = np.concatenate([cost, cost + away ** 2], 2)
            if node.shape[2] > leaves:
                best = np.argsort(cost, axis=2, kind="stable")[:, :, :leaves]
                node, cost = np.take_along_axis(node, best, 2), np.take_along_axis(cost, best, 2)
        row = np.arange(len(x))[:, None, None]
        return np.stack(np.broadcast_arrays(row, tree, node), -1).reshape(-1, 3)


def _coin(rows: np.ndarray, tree: np.ndarray, level: int) -> np.ndarray:
    h = rows.astype(np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15) \
        + (tree.astype(np.uint64) * np.uint64(64) + np.uint64(level + 1)) * np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return (h >> np.uint64(40)) & np.uint64(1) == 1


def unit_matrix(column: pa.Array) -> np.ndarray:
    """Rows of an array column as float64 vectors of length one (zero stays zero)."""
    n = len(column)
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1)
    length = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(length > 0, length, 1)


def fit_forest(vectors: DataFrame, trees: int = TREES, leaf_rows: int = LEAF_ROWS,
               max_nodes: int = MAX_NODES, seed: int = V.SAMPLE_SEED) -> Forest:
    """Trees over all rows of (row_index, embedding).

    Directions are differences of 2 * trees * levels rows drawn by a hash of their number.
    """
    rows = vectors.where(F.col("embedding").isNotNull()).select("row_index", "embedding")
    n = rows.count()
    depth = max(0, min(math.ceil(math.log2(max(n, 1) / leaf_rows)), int(math.log2(max_nodes / trees))))
    wanted = 2 * trees * depth
    drawn = rows.orderBy(F.xxhash64("row_index", F.lit(seed)), "row_index").limit(wanted).toArrow() \
        if wanted else None
    forest = Forest(np.zeros((trees, depth, 0)), [])
    if not depth:
        return forest
    sample = unit_matrix(drawn["embedding"].combine_chunks())
    one, two = np.random.default_rng(seed).integers(0, len(sample), (2, trees * depth))
    two = np.where(one == two, (two + 1) % len(sample), two)
    forest.directions = (sample[one] - sample[two]).reshape(trees, depth, -1)
    for level in range(depth):
        def project(batches: Iterator[pa.RecordBatch], forest=forest, level=level):
            for batch in batches:
                if batch.num_rows:
                    x, number = unit_matrix(batch["embedding"]), batch["row_index"].to_numpy()
                    node = forest.nodes(x, number)
                    tree = np.broadcast_to(np.arange(trees), node.shape)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(tree.ravel().astype(np.int32)), pa.array(node.ravel()),
                         pa.array(forest.project(x, level).ravel())], ["tree", "node", "value"])

        medians = rows.mapInArrow(project, "tree int, node long, value double") \
            .groupBy("tree", "node").agg(F.percentile_approx("value", 0.5, ACCURACY).alias("cut")) \
            .toArrow()
        cut = np.zeros((trees, 2 ** level))
        cut[medians["tree"].to_numpy(), medians["node"].to_numpy()] = medians["cut"].to_numpy()
        forest = Forest(forest.directions, [*forest.cuts, cut])
    return forest


def forest_index(forest: Forest, vectors: DataFrame) -> DataFrame:
    """(tree, leaf, row_index) of every vector; write it with ``write_forest_index``."""
    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                number = batch["row_index"].to_numpy()
                node = forest.nodes(unit_matrix(batch["embedding"]), number)
                tree = np.broadcast_to(np.arange(node.shape[1], dtype=np.int32), node.shape)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(tree.ravel()), pa.array(node.ravel()),
                     pa.array(np.repeat(number, node.shape[1]))], ["tree", "leaf", "row_index"])

    return vectors.where(F.col("embedding").isNotNull()) \
        .select(F.col("row_index").cast("long"), "embedding") \
        .mapInArrow(place, "tree int, leaf long, row_index long")


def write_forest_index(index: DataFrame, path: str) -> None:
    """Sorted by tree and leaf, so min/max statistics skip other leaves."""
    index.repartitionByRange("tree", "leaf", "row_index").sortWithinPartitions("tree", "leaf") \
        .write.mode("overwrite").parquet(path)


def forest_candidates(index: DataFrame, forest: Forest, queries: DataFrame, k: int,
                      probes: int | None = None) -> DataFrame:
    """(profile_id, row_index): rows of the leaves nearest to every query.

    By default as many leaves that ``PROBES`` * k rows lie in them, tree by tree.
    """
    leaves = probes or max(PROBES, math.ceil(PROBES * k / LEAF_ROWS))

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                row, tree, leaf = forest.probe(unit_matrix(part["embedding"]), leaves).T
                yield pa.RecordBatch.from_arrays(
                    [part["profile_id"].take(pa.array(row)), pa.array(tree.astype(np.int32)),
                     pa.array(leaf)], ["profile_id", "tree", "leaf"])

    wanted = queries.select(F.col("profile_id").cast("string"), "embedding").mapInArrow(
        probe, "profile_id string, tree int, leaf long")
    return index.join(wanted, ["tree", "leaf"]).select("profile_id", "row_index").distinct()
