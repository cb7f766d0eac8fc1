"""Components by contraction, the mates of a hot bucket, and scratch tables that go."""

import os
import random

import pytest
from matchlake.llm import common, near_dedup
from matchlake.llm.common import stored, tidied
from matchlake.llm.components import components
from pyspark.sql import functions as F


def _brute(links):
    best = {x: x for link in links for x in link}
    changed = True
    while changed:
        changed = False
        for a, b in links:
            low = min(best[a], best[b])
            changed |= best[a] != low or best[b] != low
            best[a] = best[b] = low
    return best


def test_components_of_chains_stars_and_repeated_links(spark):
    draw = random.Random(3)
    links = [(i, i + 1) for i in range(40)] + [(99, i) for i in range(60, 80)] \
        + [(i, 200 - i) for i in range(150, 160)] * 2 + [(300, 300)] \
        + [(draw.randrange(400, 460), draw.randrange(400, 460)) for _ in range(35)]
    links = [(b, a) if draw.random() < 0.5 else (a, b) for a, b in links]
    found = components(spark.createDataFrame(links, "a long, b long"))
    assert {r["id"]: r["comp"] for r in found.collect()} == _brute(links)
    assert found.count() == len(_brute(links))


def test_buckets_of_a_cluster_agree_on_few_mates(spark):
    n, tables = 200, 10
    draw = random.Random(5)
    # in every table a third of the copies has a key of its own
    key = lambda i, j: j if draw.random() < 0.67 else 1_000 + i * tables + j
    rows = [(i, [key(i, j) for j in range(7)], [key(i, j) for j in range(tables)])
            for i in range(n)]
    classes = spark.createDataFrame(rows, "rep long, a array<long>, b array<long>")
    mates = near_dedup._mates(classes)
    tried = mates.where("rep <> p0").select("rep", "p0").distinct().count()
    assert 0 < tried < 10 * n  # some 30 for each copy if every bucket draws its own
    least = mates.groupBy("key").agg(F.countDistinct("p0").alias("n"), F.count("*").alias("m"))
    assert least.where("n <> 1 OR m < 2").count() == 0


def test_scratch_tables_go_when_nothing_reads_them(spark):
    def folder(df):
        return os.path.dirname(df.inputFiles()[0].removeprefix("file://"))

    with tidied(spark) as keep:
        gone, kept = stored(spark.range(3), "gone"), stored(spark.range(4), "kept")
        keep(kept)
        paths = folder(gone), folder(kept)
    assert [os.path.exists(p) for p in paths] == [False, True]
    assert kept.count() == 4


def test_near_dedup_leaves_no_sets_behind(spark):
    words = [f"w{i}" for i in range(60)]
    texts = [" ".join(words[:59] + [f"x{i}"]) for i in range(6)] + ["a b c d", "a b c d", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = near_dedup.near_components(docs)
    left = {os.path.basename(os.path.dirname(f)).rsplit("-", 1)[0] for f in found.inputFiles()}
    assert {r["doc_id"]: r["component_id"] for r in found.collect()} == {
        **{i: 0 for i in range(6)}, 6: 6, 7: 6, 8: 8}
    root = os.path.dirname(os.path.dirname(found.inputFiles()[0].removeprefix("file://")))
    assert left and not any(name.startswith(("mates-", "near-sets-", "near-tried-"))
                            and os.path.getmtime(f"{root}/{name}") > os.path.getmtime(
                                os.path.dirname(found.inputFiles()[0].removeprefix("file://")))
                            for name in os.listdir(root))


@pytest.mark.parametrize("limit, shuffled", [(200_000, False), (2, True)])
def test_texts_stay_where_they_are_if_few_rows_go(spark, monkeypatch, limit, shuffled):
    monkeypatch.setattr(common, "FEW_ROWS", limit)
    threshold = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(threshold)
    spark.conf.set(threshold, "-1")
    try:
        docs = spark.createDataFrame([(i if i else None, "t") for i in range(50)],
                                     "doc_id long, text string")
        gone = stored(docs.where("doc_id IS NULL OR doc_id < 9").selectExpr(
            "doc_id", "1L AS rows"), "gone")
        left = common.without_rows(docs, gone, 1_000_000, {"doc_id": F.col("doc_id")})
        plan = left._jdf.queryExecution().executedPlan().toString()
        assert ("SortMergeJoin" in plan) == shuffled
        assert sorted(r["doc_id"] for r in left.collect()) == list(range(9, 50))
    finally:
        spark.conf.set(threshold, before)
