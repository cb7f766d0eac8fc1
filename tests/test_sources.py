"""Sources at size: CSV records across lines and splits."""

from __future__ import annotations

import csv
import random

import numpy as np
import pytest

from matchlake.sources import csv_records, readers


def spark_rows(spark, path, names):
    """The same files by Spark's own reader, one task per file, in file order."""
    df = readers.number_rows(readers.with_file_position(spark.read.csv(
        path, header=True, multiLine=True, quote='"', escape='"', inferSchema=False)))
    return sorted(tuple(r[c] for c in ("row_index", *names)) for r in df.collect())


@pytest.fixture
def small_splits(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield spark
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


PIECES = ["", " ", "plain", 'say "hi"', "a,b", "line\nbreak", "\n", "\n\n", 'q"\n"', '"', "é漢\n,", "x" * 40,
          '",', '\n"', "'", "tail\r\nreturn"]


def write_files(folder, ends, files=3, rows=120, long_field=0):
    draw = random.Random(ends)
    for k in range(files):
        with open(f"{folder}/part-{k}.csv", "w", newline="", encoding="utf-8") as out:
            writer = csv.writer(out, lineterminator=ends)
            writer.writerow(["a", "b c", "d"])
            for n in range(rows):
                row = [str(n), *("".join(draw.choice(PIECES) for _ in range(draw.randint(0, 5)))
                                 for _ in range(2))]
                if long_field and n % 40 == 7:
                    row[1] = 'z"\n,' * long_field
                writer.writerow(row)
            if k == 1:
                out.write(ends * 2 + 'half,"quoted"junk,5" wide,more' + ends + "few" + ends)
    return str(folder)


@pytest.mark.parametrize("ends", ["\n", "\r\n"])
def test_csv_records_equal_the_unsplit_reader(small_splits, tmp_path, ends):
    """Fields of several splits, commas, doubled quotes, blank lines and loose quotes."""
    path = write_files(tmp_path, ends, long_field=900)
    df = readers.read_csv(small_splits, path)
    assert df.columns == ["a", "b c", "d", "row_index"]
    found = sorted(tuple(r[c] for c in ("row_index", "a", "b c", "d")) for r in df.collect())
    assert [r[0] for r in found] == list(range(3 * 120 + 2))
    if ends == "\r\n":  # Spark's reader turns the separator of a file into \n inside of quotes too
        found = [(n, *(v and v.replace(ends, "\n") for v in r)) for n, *r in found]
    assert found == spark_rows(small_splits, path, ("a", "b c", "d"))


def test_one_file_is_read_by_many_tasks(small_splits, tmp_path):
    path = write_files(tmp_path, "\n", files=1)
    lines = readers.with_file_position(small_splits.read.option("lineSep", "\n").text(path))
    assert lines.select("_block").distinct().count() > 5
    assert csv_records.csv_records(small_splits, path).count() == 120


def test_beyond_the_broadcast_bound(small_splits, tmp_path, monkeypatch):
    path = write_files(tmp_path, "\n", long_field=300)
    monkeypatch.setattr(csv_records, "BROADCAST_SPLITS", 0)
    found = sorted(tuple(r[c] for c in ("row_index", "a", "b c", "d"))
                   for r in readers.read_csv(small_splits, path).collect())
    assert found == spark_rows(small_splits, path, ("a", "b c", "d"))


def test_header_only_and_empty_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text("x,y\n")
    (tmp_path / "b.csv").write_text("x,y\n1,2")
    (tmp_path / "c.csv").write_text("")
    assert [tuple(r) for r in readers.read_csv(spark, str(tmp_path)).collect()] == [("1", "2", 0)]


def test_quote_states(spark):
    """A line's effect on both states against a walk over its characters."""
    def walk(line, inside):
        quoted, plain, at, fresh = inside, False, 0, not inside
        while at < len(line):
            c = line[at]
            if quoted:
                if c == '"':
                    if line[at + 1:at + 2] == '"':
                        at += 1
                    else:
                        quoted, plain = False, True
            elif c == ",":
                plain, fresh = False, True
                at += 1
                continue
            elif c == '"' and fresh and not plain:
                quoted = True
            fresh = False
            at += 1
        return int(quoted)

    draw = random.Random(1)
    lines = ["".join(draw.choice('",a ') for _ in range(draw.randint(0, 9))) for _ in range(400)]
    out, inside = csv_records.quote_states("value")
    for r in spark.createDataFrame([(x,) for x in lines], "value string").select(
            "value", out.alias("o"), inside.alias("i")).collect():
        assert (r["o"], r["i"]) == (walk(r["value"], False), walk(r["value"], True)), r["value"]


def test_states_after_composes():
    draw = np.random.default_rng(3)
    one, two = draw.integers(0, 2, 500), draw.integers(0, 2, 500)
    for start in (0, 1):
        state, want = start, []
        for a, b in zip(one, two):
            state = int(b if state else a)
            want.append(state)
        assert csv_records.states_after(start, one, two).tolist() == want
