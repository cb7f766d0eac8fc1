"""Streaming source that hands out exactly so many rows a batch from Parquet files.

    spark.dataSource.register(PacedParquet)
    spark.readStream.format("paced_parquet").schema(...).option("path", folder) \\
        .option("batch_rows", 500).option("max_batches", 10).load()

Offsets are row numbers along the files in the order of their names.  A batch ends after
``batch_rows`` rows wherever files end; after ``max_batches`` nothing more comes, and
``pause_seconds`` pass after every batch.  The driver
reads footers only; executors read the row groups of their slices, ``slice_rows`` rows a task.
Slices end where row groups end, so that none is read twice; only larger ones are cut.
A column named by ``position`` is not read but holds the row numbers.
"""

from __future__ import annotations

import time
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import LongType, StructField, StructType

SLICE_ROWS = 65_536
#: Fewer rows are not worth a task of their own.
LEAST_SLICE_ROWS = 1_024


def _open(path: str) -> tuple[fs.FileSystem, str]:
    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri(path if "://" in path else "file://" + path[len("file:"):])
    return fs.LocalFileSystem(), path


class Slice(InputPartition):
    """Rows [first, last) of a file that begins with row number ``base`` of all."""

    def __init__(self, path: str, first: int, last: int, base: int):
        self.path, self.first, self.last, self.base = path, first, last, base


class PacedReader(DataSourceStreamReader):
    def __init__(self, schema: StructType, options: dict):
        self.names = schema.names
        self.position = options.get("position")
        self.batch_rows = int(options["batch_rows"])
        self.slice_rows = int(options.get("slice_rows", SLICE_ROWS))
        if self.batch_rows < 1 or self.slice_rows < 1:
            raise ValueError("batch_rows and slice_rows must be positive")
        system, folder = _open(options["path"])
        found = system.get_file_info(fs.FileSelector(folder, recursive=True))
        self.prefix = options["path"]
        self.files = sorted(f.path for f in found if f.is_file and f.base_name.endswith(".parquet")
                            and not f.base_name.startswith(("_", ".")))
        # row groups: rows up to their end, and their file with the rows before it
        self.ends, self.places, total = [], [], 0
        for file in self.files:
            with system.open_input_file(file) as opened:
                footer, base = pq.ParquetFile(opened).metadata, total
            for group in range(footer.num_row_groups):
                total += footer.row_group(group).num_rows
                self.ends.append(total)
                self.places.append((file, base))
        batches = options.get("max_batches")
        self.limit = total if batches is None else min(total, int(batches) * self.batch_rows)
        self.pause = float(options.get("pause_seconds", 0))
        self.at: int | None = None

    def initialOffset(self) -> dict:
        return {"row": 0}

    def latestOffset(self) -> dict:
        # called when the last batch has ended
        if self.at and self.at < self.limit:
            time.sleep(self.pause)
        self.at = min((self.at or 0) + self.batch_rows, self.limit)
        return {"row": self.at}

    def partitions(self, start: dict, end: dict) -> list[Slice]:
        if self.at is None:  # a restarted query plans its last batch first
            self.at = end["row"]
        slices, at = [], start["row"]
        while at < end["row"]:
            k = bisect_right(self.ends, at)
            (file, base), limit = self.places[k], min(end["row"], at + self.slice_rows)
            to = min(limit, self.ends[k])
            while to == self.ends[k] and k + 1 < len(self.ends) and self.places[k + 1][0] == file \
                    and min(end["row"], self.ends[k + 1]) <= limit:
                k += 1
                to = min(limit, self.ends[k])
            slices.append(Slice(file, at - base, to - base, base))
            at = to
        return slices

    def read(self, partition: Slice) -> Iterator[pa.RecordBatch]:
        system, _ = _open(self.prefix)
        with system.open_input_file(partition.path) as opened:
            file, base = pq.ParquetFile(opened), 0
            for group in range(file.num_row_groups):
                rows = file.metadata.row_group(group).num_rows
                first, last = max(partition.first - base, 0), min(partition.last - base, rows)
                if first < last:
                    stored = [n for n in self.names if n != self.position]
                    table = file.read_row_group(group, columns=stored)
                    if self.position:
                        at = partition.base + base
                        table = table.append_column(self.position, pa.array(
                            np.arange(at, at + rows, dtype=np.int64)))
                    yield from table.select(self.names).slice(first, last - first).to_batches()
                base += rows


class PacedParquet(DataSource):
    @classmethod
    def name(cls) -> str:
        return "paced_parquet"

    def schema(self) -> StructType:
        raise ValueError("paced_parquet needs a schema")

    def streamReader(self, schema: StructType) -> PacedReader:
        return PacedReader(schema, dict(self.options))


def paced_stream(spark: SparkSession, path: str, schema: StructType, batch_rows: int,
                 max_batches: int | None = None, pause_seconds: float = 0,
                 position: str | None = None) -> DataFrame:
    """Stream over Parquet files, ``batch_rows`` rows a batch, ``max_batches`` batches at most.

    ``position`` names a further column with the row numbers.  A batch is cut into slices for all
    cores, as far as ``SLICE_ROWS`` and the row groups allow.
    """
    cores = max(spark.sparkContext.defaultParallelism, 1)
    spark.dataSource.register(PacedParquet)
    if position is not None:
        schema = StructType([*schema.fields, StructField(position, LongType())])
    reader = spark.readStream.format("paced_parquet").schema(schema).option("path", path) \
        .option("batch_rows", batch_rows).option("pause_seconds", pause_seconds) \
        .option("slice_rows", min(max(-(-batch_rows // cores), LEAST_SLICE_ROWS), SLICE_ROWS))
    if position is not None:
        reader = reader.option("position", position)
    if max_batches is not None:
        reader = reader.option("max_batches", max_batches)
    return reader.load()


#: Trigger of a paced stream: the source sets the pace, one batch after the other.
PACED = {"processingTime": "0 seconds"}


def run_to_end(query: StreamingQuery) -> None:
    """Wait until the source has nothing more, then stop."""
    try:
        query.processAllAvailable()
    finally:
        query.stop()
