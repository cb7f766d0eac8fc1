"""Streaming ingest: mapping, cleaning, global de-duplication and the batch log."""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import LongType, MapType, StringType, StructField, StructType

from matchlake import vocab as V
from matchlake.functions.rawjson import is_object
from matchlake.functions.text import strip
from matchlake.operators.ingest import clean_batch
from matchlake.operators.order import running_sum
from matchlake.operators.records import map_records
from matchlake.sources.readers import ensure_columns


#: So many batches that wait are taken at once: a trigger costs some seconds whatever its size.
BACKLOG = 100


def batch_number(position: str, batch_rows: int) -> Column:
    """Number of the batch a row belongs to, by its place in the stream."""
    return F.floor(F.col(position) / batch_rows).cast("long")


def read_stream(spark: SparkSession, path: str, fmt: str, schema=None,
                files_per_trigger: int | None = None, bytes_per_trigger: str | None = None
                ) -> DataFrame:
    """File stream; the options bound the size of a micro-batch."""
    reader = spark.readStream.format(fmt)
    if schema is not None:
        reader = reader.schema(schema)
    if fmt == "csv":
        reader = reader.option("header", True).option("multiLine", True).option("escape", '"')
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    if bytes_per_trigger:
        reader = reader.option("maxBytesPerTrigger", bytes_per_trigger)
    return reader.load(path)


def map_ndjson(lines: DataFrame) -> DataFrame:
    """Raw JSON lines of a stream to postings.

    A stream has no line numbers, so a record without an id gets the hash of its
    text instead of its line.
    """
    objects = lines.withColumn("value", strip(F.col("value"))) \
        .where((F.col("value") != "") & is_object(F.col("value")))
    return map_records(objects.withColumn("line_no", F.xxhash64("value"))).drop("line_no")


def postings_stream(spark: SparkSession, path: str, schema=None, **limits) -> DataFrame:
    """``.json`` input is mapped from raw records, other input is CSV."""
    if path.lower().rstrip("/*").endswith((".json", ".ndjson")):
        return map_ndjson(read_stream(spark, path, "text", **limits))
    fields = ", ".join(f"{c} string" for c in V.RAW_FIELDS)
    raw = read_stream(spark, path, "csv", schema or fields, **limits)
    return raw.na.fill("")


def _first_places(keys, batches: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Of every key the place of its row with the smallest (batch, place), in ascending order."""
    codes = keys.dictionary_encode(null_encoding="encode")
    codes = (codes.combine_chunks() if isinstance(codes, pa.ChunkedArray) else codes).indices.to_numpy()
    at = np.lexsort((places, batches, codes))
    return np.sort(at[np.flatnonzero(np.diff(codes[at], prepend=-1))])


def first_of_key(stream: DataFrame, key: str, order: str | None, batch: Column | None = None
                 ) -> DataFrame:
    """The first row of every new key, and how many rows came: the columns of ``stream`` and two more.

    ``_of_batch`` numbers the batches that a trigger takes at once, all are 0 without ``batch``.  Rows
    without ``_of_rows`` are the rows of smallest ``order`` in the first batch of their key, if no
    earlier trigger had the key.  Other rows have no posting: ``_of_rows`` counts rows by batch.

    A trigger's rows are dealt by key and reduced to one row a key, an Arrow batch at a time; only
    these meet the keys of earlier triggers, which Spark keeps in its state store by their hash
    partition.  Counts pass the store under a name of their own, one for each task of a trigger.
    """
    at = F.col(order).cast("long") if order in stream.columns else F.lit(0).cast("long")
    rows = stream.withColumns({"_of_key": F.col(key), "_of_order": at, "_of_batch": F.lit(0).cast("long")
                               if batch is None else batch}).repartition("_of_key")
    out = StructType([*(StructField(f.name, f.dataType) for f in rows.drop("_of_order").schema),
                      StructField("_of_rows", MapType(LongType(), LongType())), StructField("_of_task", StringType())])

    def first(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def numbers(column) -> np.ndarray:
            return column.fill_null(np.iinfo(np.int64).min).to_numpy()  # NULL sorts first

        incoming, kept = Counter(), []
        for part in parts:
            if part.num_rows:
                incoming.update(part["_of_batch"].to_pylist())
                kept.append(part.take(pa.array(_first_places(
                    part["_of_key"], numbers(part["_of_batch"]), numbers(part["_of_order"])))))
        if not kept:
            return
        stays = np.zeros(sum(part.num_rows for part in kept), bool)
        narrow = pa.Table.from_batches([part.select(["_of_key", "_of_batch", "_of_order"]) for part in kept])
        stays[_first_places(narrow["_of_key"], numbers(narrow["_of_batch"]), numbers(narrow["_of_order"]))] = True
        schema = to_arrow_schema(out)
        for part in kept:
            rest, stays = stays[part.num_rows:], stays[:part.num_rows]
            found, stays = part.filter(pa.array(stays)), rest
            yield pa.RecordBatch.from_arrays(
                [found[f.name].cast(f.type) if f.name in found.schema.names else pa.nulls(found.num_rows, f.type)
                 for f in schema], schema=schema)
        own = {"_of_rows": [*incoming.items()], "_of_task": uuid.uuid4().hex}
        yield pa.RecordBatch.from_arrays([pa.array([own.get(f.name)], f.type) for f in schema], schema=schema)

    return rows.mapInArrow(first, out).dropDuplicates(["_of_key", "_of_task"]).drop("_of_key", "_of_task")


def unique_postings(stream: DataFrame, event_time: str | None = None,
                    delay: str = "1 day", order: str = "row_index", position: str | None = None,
                    batch_rows: int = V.STREAM_BATCH_ROWS) -> DataFrame:
    """Cleaned postings, the first of every key over the whole stream.

    With a ``position`` column a trigger may hold many batches of ``batch_rows`` rows; then the
    first batch of a key decides before ``order`` does.

    Keys are kept for ever, as the batch result requires.  With an ``event_time``
    column the state is bounded: copies arriving more than ``delay`` apart are not
    recognised then, and any copy of a batch may be the one that stays.
    """
    keep = tuple(c for c in (order, event_time, position) if c)
    cleaned = clean_batch(ensure_columns(stream, V.RAW_FIELDS), keep)
    if event_time is not None:
        return cleaned.withWatermark(event_time, delay) \
            .dropDuplicatesWithinWatermark(["dedupe_key"])
    batch = batch_number(position, batch_rows) if position else None
    rows = first_of_key(cleaned, "dedupe_key", order, batch).where("_of_rows IS NULL") \
        .select(*cleaned.columns)
    return rows.drop(position) if position else rows


def stream_dedupe(stream: DataFrame, output: str, checkpoint: str,
                  trigger: dict | None = None, **options) -> StreamingQuery:
    """Append unique postings to a parquet table, exactly once."""
    return unique_postings(stream, **options).writeStream.format("parquet") \
        .option("path", output).option("checkpointLocation", checkpoint) \
        .outputMode("append").trigger(**(trigger or {"availableNow": True})).start()


def stream_log(stream: DataFrame, output: str, log: str, checkpoint: str,
               order: str = "row_index", trigger: dict | None = None, position: str | None = None,
               batch_rows: int = V.STREAM_BATCH_ROWS) -> StreamingQuery:
    """First-wins de-duplication that writes every batch's postings and log row.

    Of equal keys of a batch the row of smallest ``order`` stays, unless an earlier batch has the
    key.  A trigger is one batch; with a ``position`` column it may hold many of ``batch_rows``
    rows, each with its own log row.  The postings and log rows of a trigger go under its number
    and are overwritten if it is run again, so both are complete however many there are.
    ``order`` may be missing: then any row of the batch stays.
    """
    cleaned = clean_batch(ensure_columns(stream, V.RAW_FIELDS), tuple(c for c in (order, position) if c))
    batch_of = batch_number(position, batch_rows) if position else None

    def store(found: DataFrame, number: int) -> None:
        found.persist()  # the state is read once for both tables
        try:
            first = found.where("_of_rows IS NULL")
            first.select(*cleaned.columns).drop(*([position] if position else [])) \
                .write.mode("overwrite").parquet(f"{output}/batch={number}")
            counts = found.select(F.explode("_of_rows").alias("batch", "incoming"), F.lit(0).alias("kept")) \
                .unionByName(first.select(F.col("_of_batch").alias("batch"), F.lit(0).cast("long").alias("incoming"),
                                          F.lit(1).alias("kept")))
            # without positions a trigger has its row even if nothing came
            totals = (counts.groupBy((F.col("batch") + 1).alias("batch_id")) if position else counts.groupBy()) \
                .agg(F.coalesce(F.sum("incoming"), F.lit(0)).alias("incoming_records"),
                     F.coalesce(F.sum("kept"), F.lit(0)).alias("kept_records"))
            number_of = F.col("batch_id") if position else F.lit(number + 1).cast("long")
            totals.select(number_of.alias("batch_id"), "incoming_records", "kept_records",
                          (F.col("incoming_records") - F.col("kept_records")).alias("duplicate_records")) \
                .coalesce(1).write.mode("overwrite").parquet(f"{log}/batch={number}")
        finally:
            found.unpersist()

    return first_of_key(cleaned, "dedupe_key", order, batch_of).writeStream.foreachBatch(store) \
        .option("checkpointLocation", checkpoint) \
        .trigger(**(trigger or {"availableNow": True})).start()


def read_stream_log(spark: SparkSession, log: str) -> DataFrame:
    """Log rows with the running number of unique postings."""
    rows = spark.read.parquet(f"{log}/batch=*")  # the same columns in every batch
    return running_sum(rows, "batch_id", {"cumulative_unique_records": "kept_records"})
