"""Small helpers of the training-data operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from matchlake.operators.order import scratch_path

#: A group counts as hot from this share of all rows on, so there are at most so many hot groups.
HOT_GROUPS = 2_000
#: A narrow table of at most so many rows is broadcast, so that texts stay where they are.
FEW_ROWS = 200_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once into the shared folder and read it back: later steps do not repeat it."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    written = df.sparkSession.read.schema(df.schema).parquet(path)
    if (tables := _written.get()) is not None:
        tables.append((written, path))
    return written


#: What ``stored`` has written inside ``tidied``: tables and their paths.
_written: ContextVar[list[tuple[DataFrame, str]] | None] = ContextVar("written", default=None)


@contextmanager
def tidied(spark: SparkSession) -> Iterator[Callable[[DataFrame], None]]:
    """Tables that ``stored`` writes inside go at the end, but for those given to what it yields.

    A table that a returned DataFrame reads must be given: it is read after the end.
    """
    tables: list[tuple[DataFrame, str]] = []
    kept: list[DataFrame] = []
    before = _written.set(tables)
    try:
        yield kept.append
    finally:
        _written.reset(before)
        for table_, path in tables:
            if not any(table_ is k for k in kept):
                folder = spark._jvm.org.apache.hadoop.fs.Path(path)
                folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
            elif (outer := _written.get()) is not None:
                outer.append((table_, path))


BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


@contextmanager
def batches_of(spark: SparkSession, rows: int) -> Iterator[None]:
    """What is computed inside gives Python so many rows at a time; the setting stays as it was."""
    before = spark.conf.get(BATCH_ROWS, None)
    spark.conf.set(BATCH_ROWS, str(rows))
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(BATCH_ROWS)
        else:
            spark.conf.set(BATCH_ROWS, before)


def whole_text(name: str = "text") -> Column:
    """The text column; null counts as empty."""
    return F.coalesce(F.col(name), F.lit(""))


def id_remainder(name: str, divisor: int) -> Column:
    """crc32 of the id written as text, modulo ``divisor``; it deals documents into folds."""
    return F.crc32(F.col(name).cast("string").cast("binary")) % divisor


def with_groups(rows: DataFrame, groups: DataFrame, on: list[str], size: str,
                total: int) -> DataFrame:
    """``rows`` with the columns of their group (null without one), for groups of any size.

    ``groups`` has one row per key and the number of its rows in ``size``.  Groups with a share
    of 1 / HOT_GROUPS of all ``total`` rows or more, HOT_GROUPS at most, are broadcast.
    """
    is_hot = F.col(size) * HOT_GROUPS >= total
    hot = F.broadcast(groups.where(is_hot))
    rest = rows.join(hot, on, "left_anti").join(groups.where(~is_hot), on, "left")
    return rows.join(hot, on).unionByName(rest)


def few(table: DataFrame) -> DataFrame:
    """A stored narrow ``table`` to join with texts: broadcast if it has at most FEW_ROWS rows."""
    return F.broadcast(table) if table.count() <= FEW_ROWS else table


def without_rows(docs: DataFrame, gone: DataFrame, total: int, on: dict[str, Column]) -> DataFrame:
    """``docs`` without the rows whose values ``on`` are in ``gone``; nulls are equal.

    ``gone`` has these values once each and the number of their rows in ``rows``.  Values of a
    share of 1 / HOT_GROUPS of all ``total`` rows or more are broadcast, and few others too.
    """
    columns = docs.columns
    rows = docs.select(F.struct(*columns).alias("row"),
                       *[value.alias(f"on_{name}") for name, value in on.items()])
    is_hot = F.col("rows") * HOT_GROUPS >= total
    for part in (F.broadcast(gone.where(is_hot)), few(gone.where(~is_hot))):
        same = F.lit(True)
        for name in on:
            same = same & rows[f"on_{name}"].eqNullSafe(part[name])
        rows = rows.join(part, same, "left_anti")
    return rows.select("row.*")
