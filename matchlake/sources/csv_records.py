"""CSV with line breaks inside quotes, read by many tasks per file.

A line's effect on the quote state is a function of the state before it: outside or inside a
quoted field.  Functions compose, so no task has to know what comes before its split.

1. Every split composes the functions of its lines and counts its records for both states.
2. A prefix over the splits of a file gives the true state and the first record number of each.
3. Every split is read again from its true state and cut into records.  Single lines go through
   untouched; the lines of a longer record are joined.
4. A record that crosses into later splits is put together from their first lines; this is one
   more scan, taken only if there is such a record.

Records are parsed by Spark's own CSV parser, line ends inside quotes stay as they are.  Only one row per split leaves the first scan.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from matchlake.operators.order import scratch_path, with_file_position

#: Up to so many splits (some 100 MB) their states are broadcast; beyond, lines are shuffled.
BROADCAST_SPLITS = 1_000_000
SPLIT = ("_file", "_block")


# --- quote states -----------------------------------------------------------------------

def _closes(piece: str) -> str:
    """A quote that is not doubled ends a quoted field; what follows up to a comma is plain."""
    return f"instr(replace({piece}, '\"\"', ''), '\"') > 0"


def quote_states(value: str) -> tuple[Column, Column]:
    """State (1: inside quotes) after a line that starts outside and inside of quotes."""
    outside = f"CASE WHEN startswith(p, '\"') AND NOT {_closes('substring(p, 2)')} THEN 1 ELSE 0 END"
    inside = f"CASE WHEN {_closes('p')} THEN 0 ELSE 1 END"
    both = F.expr(f"""CASE WHEN instr({value}, '"') > 0 THEN aggregate(split({value}, ','),
        named_struct('a', 0, 'b', 1), (s, p) -> named_struct(
            'a', CASE WHEN s.a = 1 THEN {inside} ELSE {outside} END,
            'b', CASE WHEN s.b = 1 THEN {inside} ELSE {outside} END))
        ELSE named_struct('a', 0, 'b', 1) END""")
    return both["a"], both["b"]


def states_after(start: int, from_out: np.ndarray, from_in: np.ndarray) -> np.ndarray:
    """State after every line, from its effect on both states and the state before the first.

    The last line that forgets the state before it counts, and the lines that turn it over since.
    """
    turns = np.cumsum((from_out == 1) & (from_in == 0))
    at = np.maximum.accumulate(np.where(from_out == from_in, np.arange(len(turns)), -1))
    since = turns - np.where(at >= 0, turns[at], 0)
    return np.where(at >= 0, from_out[at], start) ^ (since & 1)


def _segments(*keys: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of rows with equal keys, in their order."""
    n = len(keys[0])
    change = np.zeros(max(n - 1, 0), bool)
    for key in keys:
        change |= key[1:] != key[:-1]
    cuts = [0, *(np.flatnonzero(change) + 1).tolist(), n]
    return ((a, b) for a, b in zip(cuts, cuts[1:]) if b > a)


def _compose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per split: state after it and records that start in it, for both states before."""
    done: list[tuple] = []
    split, ends, starts = None, [0, 1], [0, 0]

    def close():
        if split is not None:
            done.append((*split, *map(int, ends), *map(int, starts)))

    for batch in batches:
        file = batch["_file"].dictionary_encode()
        names, codes = file.dictionary.to_pylist(), file.indices.to_numpy()
        blocks, empty = batch["_block"].to_numpy(), batch["_empty"].to_numpy(zero_copy_only=False)
        one, two = batch["_out"].to_numpy(), batch["_in"].to_numpy()
        for a, b in _segments(codes, blocks):
            key = (names[codes[a]], int(blocks[a]))
            if key != split:
                close()
                split, ends, starts = key, [0, 1], [0, 0]
            for s in (0, 1):
                after = states_after(ends[s], one[a:b], two[a:b])
                before = np.append(ends[s], after[:-1])
                starts[s] += int(((before == 0) & ~empty[a:b]).sum())
                ends[s] = after[-1]
    close()
    columns = list(zip(*done)) or [()] * 6
    yield pa.RecordBatch.from_arrays(
        [pa.array(columns[0], pa.string()), *(pa.array(c, pa.int64()) for c in columns[1:])],
        [*SPLIT, "end_out", "end_in", "starts_out", "starts_in"])


def split_states(lines: DataFrame) -> DataFrame:
    """One row per split: its number, state before and after it, records, first record number.

    ``owner`` is the split in which the record that reaches into this one starts.
    """
    composed = lines.select(*SPLIT, "_empty", "_out", "_in").mapInArrow(
        _compose, "_file string, _block long, end_out long, end_in long, starts_out long, "
                  "starts_in long")
    path = scratch_path(lines.sparkSession, "csv-splits")
    composed.write.parquet(path)
    splits = lines.sparkSession.read.schema(composed.schema).parquet(path)
    order = Window.partitionBy("_file").orderBy("_block")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    forgets, turns = F.expr("end_out = end_in"), F.expr("int(end_out = 1 AND end_in = 0)")
    cut = splits.withColumn("_turns", F.sum(turns).over(order)) \
        .withColumn("_last", F.last(F.when(forgets, F.struct("end_out", "_turns")), True).over(before)) \
        .withColumn("_before", F.coalesce(F.lag("_turns").over(order), F.lit(0))) \
        .withColumn("start", F.expr(
            "if(_last IS NULL, _before % 2, (_last.end_out + _before - _last._turns) % 2)")) \
        .withColumn("end", F.expr("if(start = 0, end_out, end_in)")) \
        .withColumn("records", F.expr("if(start = 0, starts_out, starts_in)")) \
        .withColumn("_inside", F.coalesce(F.sum("records").over(before), F.lit(0)))
    files = cut.groupBy("_file").agg((F.sum("records") - 1).alias("_rows"))
    bases = files.select("_file", F.coalesce(F.sum("_rows").over(
        Window.orderBy("_file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_base"))
    # the first record of a file is its header and has the number -1 in it
    numbered = cut.join(bases, "_file").select(
        *SPLIT, "start", "end", "records", "_base",
        (F.col("_inside") - 1).alias("first"), F.when(F.col("records") > 0, F.col("_block")).alias("_own"))
    return numbered.withColumn("owner", F.last("_own", True).over(before)) \
        .withColumn("split", F.xxhash64(*SPLIT)).drop("_own")


# --- records ----------------------------------------------------------------------------

RECORD = "split long, number long, part long, value string"
WHOLE, TAIL, HEAD = 0, 1, 2


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records of splits from their true state: whole ones, an open last one, lines of an earlier.

    ``number`` is the place of the record in its file, from -1 for the header.
    """
    split, state, number, pieces, kind = None, 0, 0, [], WHOLE
    for batch in batches:
        splits, values = batch["split"].to_numpy(), batch["value"]
        empty = batch["_empty"].to_numpy(zero_copy_only=False)
        one, two = batch["_out"].to_numpy(), batch["_in"].to_numpy()
        starts, firsts = batch["start"].to_numpy(), batch["first"].to_numpy()
        rows: list[tuple] = []
        for a, b in _segments(splits):
            if splits[a] != split:
                if pieces:
                    rows.append((split, number, TAIL if kind == WHOLE else HEAD, "\n".join(pieces)))
                split, state, number, pieces = int(splits[a]), int(starts[a]), int(firsts[a]) - 1, []
                kind = HEAD if state else WHOLE
            after = states_after(state, one[a:b], two[a:b])
            before = np.append(state, after[:-1])
            opens = (before == 0) & ~empty[a:b]
            numbers = number + np.cumsum(opens)
            single = opens & (after == 0)
            if single.any():
                yield pa.RecordBatch.from_arrays(
                    [pa.array(splits[a:b][single]), pa.array(numbers[single]),
                     pa.array(np.zeros(int(single.sum()), np.int64)),
                     values.slice(a, b - a).filter(pa.array(single))],
                    ["split", "number", "part", "value"])
            for k in np.flatnonzero(~single & ((before == 1) | opens)).tolist():
                if before[k] == 0:
                    kind, pieces = WHOLE, []
                pieces.append(values[a + k].as_py())
                if after[k] == 0:
                    rows.append((split, int(numbers[k]), kind, "\n".join(pieces)))
                    pieces = []
            state, number = int(after[-1]), int(numbers[-1])
        if rows:
            yield _rows(rows)
    if pieces:
        yield _rows([(split, number, TAIL if kind == WHOLE else HEAD, "\n".join(pieces))])


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows))
    return pa.RecordBatch.from_arrays(
        [*(pa.array(c, pa.int64()) for c in columns[:3]), pa.array(columns[3], pa.string())],
        ["split", "number", "part", "value"])


def csv_records(spark: SparkSession, path: str) -> DataFrame:
    """(row_index, value): the text of every record but the headers, in file order from 0."""
    text = with_file_position(spark.read.option("lineSep", "\n").text(path)) \
        .withColumn("value", F.expr("if(startswith(value, '﻿'), substring(value, 2), value)"))
    out, inside = quote_states("value")
    lines = text.withColumns({"_out": out, "_in": inside, "_empty": F.expr("value IN ('', '\r')")})
    states = split_states(lines)
    # one row per split, written so that Spark knows its size
    kept = scratch_path(spark, "csv-states")
    states.write.parquet(kept)
    states = spark.read.schema(states.schema).parquet(kept)
    facts = states.agg(F.count(F.lit(1)).alias("n"), F.max("start").alias("crossing"),
                       F.max("end").alias("open")).first()
    known = states.select(*SPLIT, "split", "start", "first")
    if facts["n"] <= BROADCAST_SPLITS:
        placed = lines.join(F.broadcast(known), list(SPLIT))
    else:
        placed = lines.join(known, list(SPLIT)).repartition("split") \
            .sortWithinPartitions("split", "_at")
    parts = placed.select("split", "start", "first", "_out", "_in", "_empty", "value") \
        .mapInArrow(_cut, RECORD)
    bases = states.select("split", "_base", "_file", "owner", "_block")
    if facts["n"] <= BROADCAST_SPLITS:
        bases = F.broadcast(bases)
    found = parts.where(f"part = {WHOLE}").join(bases, "split") \
        .select((F.col("_base") + F.col("number")).alias("row_index"), "number", "value")
    if facts["crossing"] or facts["open"]:
        # at most two parts of a split; a record is as long as its file says
        crossing = parts.where(f"part <> {WHOLE}").join(bases, "split").groupBy(
            "_file", F.expr(f"if(part = {HEAD}, owner, _block)").alias("owner")).agg(
            F.max(F.expr(f"if(part = {TAIL}, number, NULL)")).alias("number"), F.first("_base").alias("_base"),
            F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_block", "value"))),
                                     lambda p: p["value"]), "\n").alias("value"))
        found = found.unionByName(crossing.select(
            (F.col("_base") + F.col("number")).alias("row_index"), "number", "value"))
    return found.where("number >= 0").select(
        "row_index", F.expr("if(endswith(value, '\r'), substring(value, 1, length(value) - 1), value)")
        .alias("value"))


def read_csv_records(spark: SparkSession, path: str) -> DataFrame:
    """CSV with a header as strings and a ``row_index`` in file order; records may span lines."""
    options = {"quote": '"', "escape": '"', "multiLine": "true"}
    # only the header of the first file is read
    names = spark.read.csv(path, header=True, inferSchema=False, **options).columns
    schema = ", ".join("`{}` string".format(n.replace("`", "``")) for n in names)
    row = F.from_csv("value", F.lit(schema), options)
    return csv_records(spark, path).select(row.alias("_row"), "row_index").select("_row.*", "row_index")
