"""Forest of random-projection trees: balanced leaves, probing order, recall."""

from __future__ import annotations

import numpy as np
import pytest

from matchlake.operators import forest as T
from matchlake.operators import retrieval as E


def table(spark, x):
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(x)]
    return spark.createDataFrame(rows, "row_index long, embedding array<float>").repartition(4)


@pytest.fixture(scope="module")
def clustered(spark):
    draw = np.random.default_rng(5)
    centres = draw.normal(size=(40, 32))
    x = centres[draw.integers(0, 40, 3_000)] + 0.6 * draw.normal(size=(3_000, 32))
    # a third of all rows are one vector
    x[2_000:] = x[1_999]
    return table(spark, x)


@pytest.fixture(scope="module")
def fitted(clustered):
    return T.fit_forest(clustered, trees=20)


def test_every_row_is_in_one_leaf_of_a_tree_and_leaves_are_even(clustered, fitted):
    leaves = T.forest_index(fitted, clustered).groupBy("tree", "leaf").count().toPandas()
    assert fitted.depth == 7
    assert (leaves.groupby("tree")["count"].sum() == 3_000).all()
    assert leaves["count"].max() < 6 * 3_000 / 2 ** 7


def test_probes_are_the_cheapest_leaves():
    draw = np.random.default_rng(6)
    directions = draw.normal(size=(3, 4, 8))
    forest = T.Forest(directions, [draw.normal(size=(3, 2 ** level)) for level in range(4)])
    x = draw.normal(size=(5, 8))
    found = {}
    for row, tree, leaf in forest.probe(x, 16).tolist():
        found.setdefault((row, tree), []).append(leaf)
    for (row, tree), leaves in found.items():
        costs = []
        for leaf in range(16):
            cost, node = 0.0, 0
            for level in range(4):
                side = leaf >> (3 - level) & 1
                away = round(float(directions[tree, level] @ x[row]), 6) - forest.cuts[level][tree, node]
                cost += away ** 2 * (side != (away > 0))
                node = 2 * node + side
            costs.append((round(cost, 9), leaf))
        assert sorted(leaves) == list(range(16))
        assert leaves[0] == min(costs)[1] == forest.nodes(x[row:row + 1], np.array([row]))[0, tree]


@pytest.mark.parametrize("k", [20, 200])
def test_recall(spark, clustered, fitted, tmp_path, k):
    path = str(tmp_path / "index")
    T.write_forest_index(T.forest_index(fitted, clustered), path)
    queries = clustered.where("row_index % 100 = 0").selectExpr(
        "cast(row_index AS string) AS profile_id", "embedding")
    r = E.ann_recall(clustered, spark.read.parquet(path), fitted, queries, [k]).first()
    assert r["queries"] == 30 and r["recall"] >= 0.9
    assert r["share"] < 0.75


def test_small_and_empty_tables(spark):
    few = table(spark, np.eye(5))
    forest = T.fit_forest(few)
    assert forest.depth == 0
    queries = few.limit(1).selectExpr("'q' AS profile_id", "embedding")
    assert E.topk_ann(few, T.forest_index(forest, few), forest, queries, 9).count() == 5
    none = few.limit(0)
    forest = T.fit_forest(none)
    assert E.topk_ann(none, T.forest_index(forest, none), forest, queries, 9).count() == 0
    missing = spark.createDataFrame([(1, None)], "row_index long, embedding array<float>")
    assert T.forest_index(T.fit_forest(missing), missing).count() == 0
