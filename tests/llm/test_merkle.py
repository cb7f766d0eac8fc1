"""Merkle manifest against a plain recursion over all rows."""

from __future__ import annotations

import hashlib
import random
import zlib

import pytest

from matchlake.llm import merkle, queries

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, tree string, at long"


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(r, text):
    return sha(*("-" if v is None else f"{len(str(v).encode())}:{v}"
                 for v in (r["doc_id"], r["source"], r["lang"], r["n_chars"], text)))


def climb(nodes):
    """Root, and for every node the siblings on its way with their side."""
    ways = [[] for _ in nodes]
    under = [[k] for k in range(len(nodes))]
    while len(nodes) > 1:
        above, groups = [], []
        for a in range(0, len(nodes), 8):
            run = nodes[a:a + 8]
            for k in range(len(run)):
                for leaf in under[a + k]:
                    ways[leaf].append((run[:k], run[k + 1:]))
            above.append(sha(*run))
            groups.append(sum(under[a:a + 8], []))
        nodes, under = above, groups
    return nodes[0], ways


def brute(rows):
    """(doc_id, leaf) → all columns, for rows that differ in them."""
    langs = {}
    for r in rows:
        langs.setdefault(r["lang"], []).append(r)
    names = sorted(langs, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for name in names:
        order = sorted(langs[name], key=lambda r: (
            r["doc_id"] is not None, r["doc_id"] or 0, leaf_of(r, r["text"])))
        trees[name] = (order, *climb([leaf_of(r, r["text"]) for r in order]))
    root, tops = climb([trees[name][1] for name in names])
    out = []
    for name, top in zip(names, tops):
        order, subroot, ways = trees[name]
        for r, way in zip(order, ways):
            text = r["text"]
            if text is not None and r["doc_id"] is not None and \
                    zlib.crc32(str(r["doc_id"]).encode()) % 3 == 0:
                text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
            node = leaf_of(r, text)
            for left, right in way + top:
                node = sha(*left, node, *right)
            out.append((r["doc_id"], leaf_of(r, r["text"]), subroot, root,
                        sha(*(x for left, right in way + top for x in left + right)),
                        node, node == root))
    return sorted(out, key=str)


def columns(rows):
    return sorted(((r["doc_id"], r["leaf"], r["subroot"], r["root"], r["proof_sha256"],
                    r["folded_root"], r["verified"]) for r in rows), key=str)


def checked(docs, levels=merkle.LEVELS):
    changed = {"text": merkle.lower_case_third()}
    return merkle.check_proofs(merkle.proofs(
        merkle.build_manifest(docs, claimed=changed, levels=levels)))


def test_query_equals_recursion(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").collect()
    found = columns(queries.QUERIES["op13_manifest"](spark, SF).collect())
    assert found == brute(rows)
    assert 0 < sum(r[-1] for r in found) < len(rows)


@pytest.mark.parametrize("n", [1, 2, 7, 8, 9, 63, 64, 65, 511, 512, 513, 600, 4_097])
def test_positions_are_places_in_postorder(n):
    leaves = [sha(str(k)) for k in range(n)]
    log = merkle.append_log(leaves, merkle.height(n))
    level, nodes = 0, leaves
    while True:
        assert all(log[merkle.position(level, k, n)] == d for k, d in enumerate(nodes))
        if len(nodes) == 1:
            break
        nodes = [sha(*nodes[a:a + 8]) for a in range(0, len(nodes), 8)]
        level += 1
    assert len(log) == merkle.position(level, 0, n) + 1


@pytest.mark.parametrize("levels", [1, 2])
def test_many_rounds(spark, levels):
    """Small blocks: several rounds in trees of different depth, and in the tree over them."""
    draw = random.Random(levels)
    rows = [(k, f"Text {k}", draw.choice(["a", "a", "a", "b", None, *map(str, range(20))]), "s", k, "t", 0)
            for k in range(700)]
    docs = spark.createDataFrame(rows, SCHEMA)
    assert columns(checked(docs, levels).collect()) == brute(docs.collect())


def test_nulls_repeats_and_long_texts(spark):
    rows = [(None, "A", "x", "s", 1, "t", 1), (None, "A", None, None, None, "t", 1), (3, None, "x", "", None, "t", 1),
            (3, None, "x", "", 5, "t", 1), (4, "", "", "s", 0, "t", 1), (5, "É漢🙂 B" * 300_000, "ü", "s", 3, "t", 1),
            (6, "-", "z", "s", -9, "t", 1)]
    docs = spark.createDataFrame(rows, SCHEMA)
    assert columns(checked(docs).collect()) == brute(docs.collect())
    assert checked(docs.limit(0)).collect() == []


def test_equal_rows_are_leaves_each(spark):
    docs = spark.createDataFrame([(7, "same", "x", "s", 4, "t", 1)] * 1_300, SCHEMA)
    found = columns(checked(docs).collect())
    assert found == brute(docs.collect()) and all(r[-1] for r in found)
