"""Merkle manifest of a dataset as postorder append logs.

Every row is a leaf; the leaves of a tree ascend, and every 8 consecutive nodes of a level (at
its end fewer, even one) have one parent, until one node remains.  There is a tree for every
group of rows, and a tree over the roots of these.

1. Leaves are digested, range-partitioned by (tree, key) and numbered from counts of partitions.
2. Builders take aligned blocks of 8 ** LEVELS nodes and append every node when it is complete:
   a node stands behind its subtree.  Their tops are the nodes of the next round, so a tree of n
   leaves takes log(n) / log(8 ** LEVELS) rounds, each 512 times smaller.
3. A node's place in the log follows from the sizes of the subtrees before it (``position``), so
   siblings are read from a block's log without a search.  Paths above a block are found once
   per block, from the last round down.

No block has more than 512 nodes and no group of rows is ever held whole, so neither a group
with a third of all rows nor very many equal rows grow a task.

Nulls and repeats: null fields are digested as ``-``.  A null group is a tree of its own, the
first one; null keys come first.  Rows of equal keys are ordered by their digests, equal rows are
leaves each.  An empty table gives no rows.  Columns that are not digested are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence
from functools import lru_cache, reduce
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchlake.llm.common import stored

ARITY = 8
#: Levels that one builder completes above its nodes.
LEVELS = 3
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def height(n: int) -> int:
    """Levels above ``n`` nodes until one remains."""
    levels = 0
    while n > 1:
        n, levels = -(-n // ARITY), levels + 1
    return levels


def position(level: int, index: int, leaves: int, top: int | None = None) -> int:
    """Place of a node in the postorder log of a tree of ``leaves`` leaves.

    When the node completes, ``end`` leaves are there; all nodes up to its level that cover them
    stand before it, of higher levels those that were complete one leaf earlier.  ``top`` is the
    highest level of the log.
    """
    end = min((index + 1) * ARITY ** level, leaves)
    top = height(leaves) if top is None else top
    return sum(-(-end // ARITY ** i) for i in range(level + 1)) + sum(
        (end - 1) // ARITY ** i for i in range(level + 1, top + 1)) - 1


def append_log(leaves: Sequence[str], top: int) -> list[str]:
    """Digests of all nodes up to level ``top`` in the order in which they complete."""
    log: list[str] = []
    waiting: list[list[str]] = [[] for _ in range(top + 2)]

    def complete(level: int, digest: str) -> None:
        log.append(digest)
        if level < top:
            waiting[level + 1].append(digest)
            if len(waiting[level + 1]) == ARITY:
                close(level + 1)

    def close(level: int) -> None:
        digest = hashlib.sha256("".join(waiting[level]).encode()).hexdigest()
        waiting[level].clear()
        complete(level, digest)

    for leaf in leaves:
        complete(0, leaf)
    for level in range(1, top + 1):
        if waiting[level]:
            close(level)
    return log


@lru_cache(maxsize=4_096)
def _sibling_places(leaves: int, top: int, index: int) -> tuple[int, ...]:
    """Places of the siblings of a leaf and its ancestors in the log of a block."""
    places = []
    for level in range(top):
        own = index // ARITY ** level
        first, n = own - own % ARITY, -(-leaves // ARITY ** level)
        places += [position(level, k, leaves, top)
                   for k in range(first, min(first + ARITY, n)) if k != own]
    return tuple(places)


def fold(leaf: str, index: int, leaves: int, siblings: list[str]) -> tuple[str, int]:
    """Root of a tree from a leaf and the siblings on its way; and the number of siblings used."""
    used = 0
    for level in range(height(leaves)):
        own = index // ARITY ** level
        at, n = own % ARITY, -(-leaves // ARITY ** level)
        more = min(ARITY, n - own + at) - 1
        run = siblings[used:used + more]
        leaf = hashlib.sha256("".join([*run[:at], leaf, *run[at:]]).encode()).hexdigest()
        used += more
    return leaf, used


def leaf_digest(fields: Sequence[Column]) -> Column:
    """SHA-256 of the fields: ``-`` for null, else the UTF-8 byte count, ``:`` and the value."""
    written = [c.cast("string") for c in fields]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c),
                                        F.lit("-")) for c in written]), 256)


def _numbered(rows: DataFrame, order: list[Column]) -> DataFrame:
    """``rows`` with ``at``, their place in their ``tree`` from 0, and ``n``, its rows.

    ``order`` must tell all rows apart, so that equal keys spread over partitions.
    """
    keys = [F.col("tree"), *order]
    placed = stored(rows.repartitionByRange(*keys).sortWithinPartitions(*keys).select(
        "*", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().alias("_seq")),
        "merkle-order")
    heads = placed.groupBy("tree", "_part").agg(F.count(F.lit(1)).alias("_rows"),
                                                F.min("_seq").alias("_first"))
    tree = Window.partitionBy("tree")
    before = tree.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    # at most one row per partition and per tree, written so that Spark knows its size
    offsets = stored(heads.select(
        "tree", "_part", F.sum("_rows").over(tree).alias("n"),
        (F.coalesce(F.sum("_rows").over(before), F.lit(0)) - F.col("_first")).alias("_offset")),
        "merkle-offsets")
    return placed.join(offsets, ["tree", "_part"]) \
        .withColumn("at", F.col("_offset") + F.col("_seq")).drop("_part", "_seq", "_offset")


LOG = "tree string, block long, n long, top string, nodes binary"


def _blocks(nodes: DataFrame, size: int) -> DataFrame:
    return nodes.withColumn("block", F.expr(f"at div {size}"))


def build_rounds(nodes: DataFrame, levels: int = LEVELS) -> list[DataFrame]:
    """Logs of all rounds, on shared files, from (tree, at, n, hash).

    A log has all nodes of its block if the tree has no other, else ``levels`` levels of them.
    """
    size, rounds = ARITY ** levels, []

    def build(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("at")
        n = rows["n"][0].as_py()
        log = append_log(rows["hash"].to_pylist(), levels if n > size else height(n))
        nodes = pa.array([bytes.fromhex("".join(log))], pa.binary())
        return rows.select(["tree", "block", "n"]).slice(0, 1) \
            .append_column("top", pa.array([log[-1]])).append_column("nodes", nodes)

    most = nodes.agg(F.max("n")).first()[0] or 0
    while True:
        log = stored(_blocks(nodes.select("tree", "at", "n", "hash"), size)
                     .groupBy("tree", "block").applyInArrow(build, LOG), f"merkle-log-{len(rounds)}")
        rounds.append(log)
        if most <= size:
            return rounds
        most = -(-most // size)
        nodes = _tops(log, size).withColumn("hash", F.col("top"))


def _tops(log: DataFrame, size: int) -> DataFrame:
    """Blocks of trees that have several, as nodes (tree, at, n, top) of the next round."""
    return log.where(f"n > {size}").select(
        "tree", F.col("block").alias("at"), F.expr(f"(n + {size - 1}) div {size}").alias("n"), "top")


def tree_roots(rounds: list[DataFrame], levels: int = LEVELS) -> DataFrame:
    """(tree, hash) of all trees: the tops of blocks that are alone in their round."""
    alone = [log.where(f"n <= {ARITY ** levels}").select("tree", F.col("top").alias("hash"))
             for log in rounds]
    return reduce(DataFrame.unionByName, alone)


def _with_paths(nodes: DataFrame, log: DataFrame, above: DataFrame | None,
                levels: int) -> DataFrame:
    """``nodes`` (tree, at, n, more) with ``path``, the digests of all siblings up to the root of
    their tree, and ``root``.  ``above`` has path and root of the blocks of ``log``."""
    size = ARITY ** levels
    alone = log.where(f"n <= {size}").withColumns({"path": F.lit(b""), "root": F.col("top")})
    log = alone if above is None else alone.unionByName(log.where(f"n > {size}").join(
        above.select("tree", F.col("at").alias("block"), "path", "root"), ["tree", "block"]))
    placed = _blocks(nodes, size)
    names = [c for c in placed.columns if c != "block"]

    def extract(rows: pa.Table, block: pa.Table) -> pa.Table:
        data, path = block["nodes"][0].as_py(), block["path"][0].as_py()
        n, first = rows["n"][0].as_py(), rows["block"][0].as_py() * size
        top = levels if n > size else height(n)
        paths = [b"".join([data[32 * k:32 * k + 32] for k in
                           _sibling_places(min(size, n - first), top, at - first)] + [path])
                 for at in rows["at"].to_pylist()]
        return rows.select(names).append_column("path", pa.array(paths, pa.binary())) \
            .append_column("root", pa.array(block["root"].to_pylist() * rows.num_rows))

    schema = ", ".join(f"`{c}` {placed.schema[c].dataType.simpleString()}" for c in names)
    return placed.groupBy("tree", "block").cogroup(
        log.select("tree", "block", "nodes", "path", "root").groupBy("tree", "block")) \
        .applyInArrow(extract, f"{schema}, path binary, root string")


def with_paths(nodes: DataFrame, rounds: list[DataFrame], levels: int = LEVELS) -> DataFrame:
    """``nodes`` with the path to the root of their tree and that root."""
    above = None
    for lower, log in zip(reversed(rounds[:-1]), reversed(rounds[1:]), strict=True):
        members = _tops(lower, ARITY ** levels).drop("top")
        above = stored(_with_paths(members, log, above, levels), "merkle-paths")
    return _with_paths(nodes, rounds[0], above, levels)


class Manifest(NamedTuple):
    """Leaves (tree, at, n, key, leaf, claimed) and logs of the trees and of the tree over them."""

    leaves: DataFrame
    rounds: list[DataFrame]
    trees: DataFrame
    top_rounds: list[DataFrame]
    levels: int


def build_manifest(docs: DataFrame, key: str = "doc_id", group: str = "lang",
                   fields: Sequence[str] = FIELDS,
                   claimed: dict[str, Column] | None = None, levels: int = LEVELS) -> Manifest:
    """Manifest of ``docs``; ``claimed`` replaces fields in a second digest, to be checked."""
    claimed = claimed or {}
    leaves = stored(docs.select(
        # null first, then by bytes
        F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit("")).alias("tree"),
        F.col(key).alias("key"), leaf_digest([F.col(c) for c in fields]).alias("hash"),
        leaf_digest([claimed.get(c, F.col(c)) for c in fields]).alias("claimed"),
        F.monotonically_increasing_id().alias("_row")), "merkle-leaves")
    nodes = _numbered(leaves, [F.col("key").asc_nulls_first(), F.col("hash"), F.col("_row")]) \
        .drop("_row")
    rounds = build_rounds(nodes, levels)
    trees = _numbered(tree_roots(rounds, levels).select(
        F.lit("").alias("tree"), F.col("tree").alias("name"), "hash"), [F.col("name")])
    return Manifest(nodes, rounds, trees, build_rounds(trees, levels), levels)


def proofs(manifest: Manifest) -> DataFrame:
    """Per leaf: key, leaf, claimed, place (at of n), subroot, place of its tree, root, proof.

    ``proof`` are the digests of all siblings, 32 bytes each, level by level from left to right.
    """
    top = stored(with_paths(manifest.trees, manifest.top_rounds, manifest.levels).select(
        F.col("name").alias("tree"), F.col("at").alias("tree_at"), F.col("n").alias("trees"),
        F.col("path").alias("tree_path"), F.col("root").alias("whole")), "merkle-trees")
    found = with_paths(manifest.leaves, manifest.rounds, manifest.levels).join(top, "tree")
    return found.select("key", F.col("hash").alias("leaf"), "claimed", "at", "n",
                        F.col("root").alias("subroot"), "tree_at", "trees",
                        F.col("whole").alias("root"), F.concat("path", "tree_path").alias("proof"))


def check_proofs(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """Per leaf of ``proofs``: key, leaf, subroot, root, proof_sha256, folded_root, verified.

    ``folded_root`` follows from the claimed digest and the proof; it equals the root if the
    claimed row is the one that the manifest was built from.
    """
    def check(batches):
        for batch in batches:
            shas, roots = [], []
            for claimed, at, n, tree_at, trees, proof in zip(*(
                    batch[c].to_pylist() for c in ("claimed", "at", "n", "tree_at", "trees", "proof"))):
                text = proof.hex()
                siblings = [text[k:k + 64] for k in range(0, len(text), 64)]
                shas.append(hashlib.sha256(text.encode()).hexdigest())
                subroot, used = fold(claimed, at, n, siblings)
                roots.append(fold(subroot, tree_at, trees, siblings[used:])[0])
            yield pa.RecordBatch.from_arrays(
                [batch["key"], batch["leaf"], batch["subroot"], batch["root"],
                 pa.array(shas, pa.string()), pa.array(roots, pa.string())],
                ["key", "leaf", "subroot", "root", "proof_sha256", "folded_root"])

    kind = found.schema["key"].dataType.simpleString()
    return found.mapInArrow(
        check, f"key {kind}, leaf string, subroot string, root string, proof_sha256 string, "
               "folded_root string") \
        .select(F.col("key").alias(key), "leaf", "subroot", "root", "proof_sha256", "folded_root",
                (F.col("folded_root") == F.col("root")).alias("verified"))


def lower_case_third(text: str = "text", key: str = "doc_id") -> Column:
    """The text, its A-Z lower-cased where 3 divides crc32 of the id; nulls stay."""
    capitals = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    chosen = F.crc32(F.col(key).cast("string").cast("binary")) % 3 == 0
    return F.when(chosen, F.translate(text, capitals, capitals.lower())).otherwise(F.col(text))
