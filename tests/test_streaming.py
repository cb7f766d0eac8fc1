"""Paced source and keyed state of streams."""

from __future__ import annotations

import time

import pytest
from pyspark.sql import functions as F

from matchlake import vocab as V
from matchlake.operators.ingest import clean_batch, dedupe_first, stream_batch_log
from matchlake.streaming import ingest as SI
from matchlake.streaming.paced import PACED, paced_stream, run_to_end


@pytest.fixture
def posts(spark, tmp_path):
    """230 postings in several files of uneven size; keys return within and across batches."""
    rows = spark.range(230).select(
        F.col("id").alias("row_index"), *[F.lit("x").alias(c) for c in V.RAW_FIELDS
                                          if c not in ("description", "title")],
        F.expr("CASE WHEN id % 3 = 0 THEN 'hot' ELSE concat('t', id % 70) END").alias("title"),
        F.expr("CASE WHEN id % 3 = 0 THEN '' ELSE concat('line\n\"', id % 70) END").alias("description"))
    path = str(tmp_path / "posts")
    rows.repartitionByRange(3, "row_index").sortWithinPartitions("row_index") \
        .write.option("maxRecordsPerFile", 37).parquet(path)
    return path, spark.read.parquet(path)


def collect_batches(spark, path, df, batch_rows, folder, **limits):
    def store(batch, number):
        batch.withColumn("b", F.lit(number)).write.mode("overwrite").parquet(f"{folder}/out/{number}")

    stream = paced_stream(spark, path, df.schema, batch_rows, **limits)
    return stream.writeStream.foreachBatch(store).trigger(**PACED) \
        .option("checkpointLocation", f"{folder}/state").start()


def test_batches_have_exactly_so_many_rows_in_order(spark, posts, tmp_path):
    path, df = posts
    run_to_end(collect_batches(spark, path, df, 50, tmp_path))
    found = spark.read.parquet(f"{tmp_path}/out/*")
    assert {r["b"]: r["n"] for r in found.groupBy("b").agg(F.count("*").alias("n")).collect()} == {
        0: 50, 1: 50, 2: 50, 3: 50, 4: 30}
    assert found.where("b <> row_index div 50").count() == 0
    assert sorted(found.drop("b").collect()) == sorted(df.collect())


def test_a_restarted_query_goes_on_after_its_last_batch(spark, posts, tmp_path):
    path, df = posts
    run_to_end(collect_batches(spark, path, df, 50, tmp_path, max_batches=2))
    assert spark.read.parquet(f"{tmp_path}/out/*").count() == 100
    run_to_end(collect_batches(spark, path, df, 50, tmp_path, max_batches=4))
    found = spark.read.parquet(f"{tmp_path}/out/*")
    assert found.count() == 200 == found.select("row_index").distinct().count()
    assert found.where("b <> row_index div 50").count() == 0


def test_pause_between_batches(spark, posts, tmp_path):
    path, df = posts
    starts = []
    stream = paced_stream(spark, path, df.schema, 100, pause_seconds=1.2)
    begun = time.time()
    run_to_end(stream.writeStream.foreachBatch(lambda b, n: starts.append(time.time()))
               .option("checkpointLocation", f"{tmp_path}/state").trigger(**PACED).start())
    assert len(starts) == 3 and starts[2] - starts[0] >= 2.4 and starts[0] >= begun


def test_first_row_of_a_key_wins_within_and_across_batches(spark, posts, tmp_path):
    path, df = posts
    log, out = f"{tmp_path}/log", f"{tmp_path}/streamed"
    stream = paced_stream(spark, path, df.schema, 40)
    run_to_end(SI.stream_log(stream, out, log, f"{tmp_path}/keys", trigger=PACED))
    cleaned = clean_batch(df)
    columns = cleaned.columns
    assert sorted(spark.read.parquet(out).select(columns).collect()) == sorted(
        dedupe_first(clean_batch(df)).select(columns).collect())
    names = ["batch_id", "incoming_records", "kept_records", "duplicate_records",
             "cumulative_unique_records"]
    assert sorted(SI.read_stream_log(spark, log).select(names).collect()) == sorted(
        stream_batch_log(cleaned, batch_rows=40).select(names).collect())


def test_append_sink_and_event_time(spark, posts, tmp_path):
    path, df = posts
    run_to_end(SI.stream_dedupe(paced_stream(spark, path, df.schema, 64), f"{tmp_path}/a",
                                f"{tmp_path}/sa", trigger=PACED))
    assert sorted(r[0] for r in spark.read.parquet(f"{tmp_path}/a").select("row_index").collect()) == sorted(
        r[0] for r in dedupe_first(clean_batch(df)).select("row_index").collect())
    timed = paced_stream(spark, path, df.schema, 64).withColumn(
        "at", F.timestamp_seconds(F.col("row_index") * 60))
    run_to_end(SI.stream_dedupe(timed, f"{tmp_path}/b", f"{tmp_path}/sb", trigger=PACED,
                                event_time="at", delay="30 days"))
    found = spark.read.parquet(f"{tmp_path}/b").groupBy("dedupe_key").count()
    assert found.where("count > 1").count() == 0
    assert found.count() == clean_batch(df).select("dedupe_key").distinct().count()


def test_merge_table_over_fifty_rounds(spark, tmp_path):
    """Counters equal one big count, bytes grow with the input, a repeated batch changes nothing."""
    from matchlake.streaming import feedback as SF

    path = str(tmp_path / "counts")
    rows = [(n % 7, f"l{n % 3}", 1) for n in range(400)]
    counts = SF.label_table(spark, path, least_rows=40)
    for number in range(50):
        batch = spark.createDataFrame(rows[8 * number:8 * number + 8],
                                      "profile_id long, feedback_label string, cnt long")
        counts.add(batch, number)
        if number in (20, 33):
            counts.add(batch, number)
            counts = SF.label_table(spark, path, least_rows=40)  # as after a restart
    found = {(r["profile_id"], r["feedback_label"]): r["cnt"] for r in counts.read().collect()}
    want = {}
    for user, label, one in rows:
        want[user, label] = want.get((user, label), 0) + one
    assert found == want
    written = spark.read.parquet(f"{path}/base/*").count() + spark.read.parquet(f"{path}/delta/*").count()
    assert written <= 2 * len(rows) and 0 < len(counts._complete("base")) < 15


def test_latest_label_stays(spark, tmp_path):
    from matchlake.streaming import feedback as SF

    labels = SF.last_label_table(spark, str(tmp_path / "labels"), least_rows=2)
    for number, (label, seq) in enumerate([("Skip", 1), ("Accept", 9), ("Reject", 4)]):
        labels.add(spark.createDataFrame([("p", "t", "c", "l", label, seq)], labels.schema), number)
    assert [r["feedback_label"] for r in labels.read().collect()] == ["Accept"]
    assert SF.last_label_table(spark, str(tmp_path / "none")).read().count() == 0


def test_a_trigger_takes_many_batches_and_logs_each(spark, posts, tmp_path):
    """Two triggers of three batches each say what six triggers of one batch say."""
    path, df = posts
    triggers = []
    for name, together in (("one", 1), ("three", 3)):
        stream = paced_stream(spark, path, df.schema, 40 * together, position="_at")
        query = SI.stream_log(stream, f"{tmp_path}/{name}/out", f"{tmp_path}/{name}/log",
                              f"{tmp_path}/{name}/keys", trigger=PACED, position="_at", batch_rows=40)
        run_to_end(query)
        triggers.append(len(list((tmp_path / name / "out").glob("batch=*"))))
    assert triggers == [6, 2]
    cleaned = clean_batch(df)
    logs = [sorted(SI.read_stream_log(spark, f"{tmp_path}/{n}/log").select(
        "batch_id", "incoming_records", "kept_records", "cumulative_unique_records").collect())
        for n in ("one", "three")]
    assert logs[0] == logs[1] == sorted(stream_batch_log(cleaned, batch_rows=40).select(
        "batch_id", "incoming_records", "kept_records", "cumulative_unique_records").collect())
    for n in ("one", "three"):
        assert sorted(spark.read.parquet(f"{tmp_path}/{n}/out").select(cleaned.columns).collect()) == sorted(
            dedupe_first(cleaned).select(cleaned.columns).collect())


def test_python_sees_a_partition_not_a_key(spark, tmp_path):
    """A trigger's rows pass Python once, reduced to one a key; a copy counts but is not written."""
    rows = spark.range(3000).select(
        F.col("id").alias("row_index"), *[F.lit("x").alias(c) for c in V.RAW_FIELDS if c != "title"],
        F.expr("concat('t', id % 1000)").alias("title"))
    path = str(tmp_path / "posts")
    rows.coalesce(1).sortWithinPartitions(F.desc("row_index")).write.parquet(path)
    stream = paced_stream(spark, path, rows.schema, 2000, position="_position")
    query = SI.stream_log(stream, f"{tmp_path}/out", f"{tmp_path}/log", f"{tmp_path}/keys", trigger=PACED,
                          position="_position", batch_rows=500)
    run_to_end(query)
    plan = query._jsq.explainInternal(True)
    assert "StreamingDeduplicate" in plan and "FlatMapGroupsInPandas" not in plan
    # batches of 500 rows fall from 2999, so the first 1000 rows that come are the first of their keys
    kept = spark.read.parquet(f"{tmp_path}/out")
    assert sorted(r[0] for r in kept.select("row_index").collect()) == list(range(2000, 3000))
    log = SI.read_stream_log(spark, f"{tmp_path}/log").orderBy("batch_id").select(
        "batch_id", "incoming_records", "kept_records", "duplicate_records", "cumulative_unique_records")
    assert [tuple(r) for r in log.collect()] == [
        (1, 500, 500, 0, 500), (2, 500, 500, 0, 1000), *[(n, 500, 0, 500, 1000) for n in (3, 4, 5, 6)]]
    states = list((tmp_path / "keys" / "state" / "0").glob("*/2.delta"))
    assert states  # the second trigger meets the keys of the first in the store


def test_rows_without_order_or_key_are_told_apart():
    import numpy as np
    import pyarrow as pa

    keys = pa.array(["a", None, "a", None, "b"])
    found = SI._first_places(keys, np.array([1, 0, 0, 0, 3]), np.array([0, 9, 5, 2, 1]))
    assert found.tolist() == [2, 3, 4]
    chunks = pa.chunked_array([["b", "a"], ["c", "a", None], [], ["b", None]], pa.string())
    assert SI._first_places(chunks, np.zeros(7, int), np.arange(7)[::-1]).tolist() == [2, 3, 5, 6]


def test_a_trigger_is_read_by_many_tasks_and_no_row_group_twice(spark, tmp_path):
    from matchlake.streaming.paced import PacedReader

    path = str(tmp_path / "rows")
    df = spark.range(0, 10_000, 1, 2).select(F.col("id").alias("row_index"), F.expr("repeat('x', 500)").alias("t"))
    df.write.option("parquet.block.size", 100_000).option("parquet.page.size.row.check.min", 10) \
        .option("parquet.enable.dictionary", False).option("compression", "none").parquet(path)
    reader = PacedReader(df.schema, {"path": path, "batch_rows": "8000", "slice_rows": "1500"})
    groups = [0, *reader.ends]
    assert len(groups) > 20 and max(b - a for a, b in zip(groups, groups[1:])) < 1000
    for start, end in ((0, 8000), (8000, 10_000), (77, 4100)):
        slices = reader.partitions({"row": start}, {"row": end})
        places = [(s.base + s.first, s.base + s.last) for s in slices]
        assert [a for a, _ in places] == [start, *[b for _, b in places[:-1]]] and places[-1][1] == end
        assert all(b - a <= 1500 for a, b in places) and len(places) >= (end - start) // 1500
        assert all(b in groups for _, b in places[:-1])
        rows = [r for s in slices for batch in reader.read(s) for r in batch.column("row_index").to_pylist()]
        assert rows == list(range(start, end))
    # a larger group is cut
    cut = PacedReader(df.schema, {"path": path, "batch_rows": "8000", "slice_rows": "7"})
    assert [s.last - s.first for s in cut.partitions({"row": 0}, {"row": 21})] == [7, 7, 7]
    stream = paced_stream(spark, path, df.schema, 8000)
    assert stream._jdf.queryExecution().analyzed().isStreaming()
