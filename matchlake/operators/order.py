"""Order without a single ordered task: row numbers, running sums, top-k, full ranks."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

TOP_K_FAN_IN = 64
GROUP_LIMIT = "spark.sql.optimizer.windowGroupLimitThreshold"


# --- shared storage -------------------------------------------------------------

def shared_dir(spark: SparkSession) -> str:
    """Folder named by ``spark.checkpoint.dir``; a temporary one in local mode only."""
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) \
        or sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if folder is None:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        folder = tempfile.mkdtemp(prefix="matchlake-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(folder)
    return folder


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame) -> DataFrame:
    """Write ``df`` to the checkpoint folder once and cut its lineage."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as a compressed table, whose size Spark then knows."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


# --- row numbers ------------------------------------------------------------------

def number_rows(df: DataFrame, name: str = "row_index") -> DataFrame:
    """0-based position of every row of a file-backed DataFrame, in file order.

    A file split is read by one task in order, so a row's number is its position in
    the split plus the rows of all earlier splits.  Only one count per split is
    collected into a window; rows are not shuffled.  ``df`` must carry the file
    columns added by ``with_file_position``.
    """
    split = ["_file", "_block"]
    counts = df.groupBy(*split).agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))
    per_file = counts.groupBy("_file").agg(F.sum("_n").alias("_rows"))
    before_file = per_file.select("_file", (F.sum("_rows").over(
        Window.orderBy("_file").rowsBetween(Window.unboundedPreceding, -1))).alias("_base"))
    within = Window.partitionBy("_file").orderBy("_block") \
        .rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("_inside", F.coalesce(F.sum("_n").over(within), F.lit(0))) \
        .join(before_file, "_file") \
        .select(*split, "_first", (F.coalesce("_base", F.lit(0)) + F.col("_inside")).alias("_offset"))
    # one row per split, written so that Spark knows its size and broadcasts it only if small
    offsets = stored(offsets, "offsets")
    return df.join(offsets, split) \
        .withColumn(name, F.col("_offset") + F.col("_at") - F.col("_first")) \
        .drop("_file", "_block", "_at", "_first", "_offset")


def with_file_position(df: DataFrame) -> DataFrame:
    return df.select("*", F.col("_metadata.file_path").alias("_file"),
                     F.col("_metadata.file_block_start").alias("_block"),
                     F.monotonically_increasing_id().alias("_at"))


# --- running sums -----------------------------------------------------------------

def running_sum(df: DataFrame, order: str, values: dict[str, str],
                block: int = 65_536) -> DataFrame:
    """Running totals along an integer column, computed block by block.

    ``values`` maps result names to summed columns.  Rows are windowed inside
    blocks of ``block`` consecutive keys; only block totals meet in one window.
    """
    keyed = df.withColumn("_blk", F.floor(F.col(order) / block))
    totals = keyed.groupBy("_blk").agg(
        *[F.sum(v).alias(f"_t_{k}") for k, v in values.items()])
    before = Window.orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select("_blk", *[F.coalesce(F.sum(f"_t_{k}").over(before), F.lit(0))
                                    .alias(f"_b_{k}") for k in values])
    inside = Window.partitionBy("_blk").orderBy(order) \
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = keyed.join(bases, "_blk")
    for name, value in values.items():
        out = out.withColumn(name, F.col(f"_b_{name}") + F.sum(value).over(inside))
    return out.drop("_blk", *[f"_b_{k}" for k in values])


def head_in_order(df: DataFrame, order: str, n: int, block: int = 65_536) -> DataFrame:
    """First ``n`` rows by a unique integer column, without a global sort.

    Row counts per block tell which blocks are taken whole; only the block where the
    n-th row falls is numbered.
    """
    keyed = df.withColumn("_blk", F.floor(F.col(order) / block))
    counts = keyed.groupBy("_blk").agg(F.count(F.lit(1)).alias("_rows"))
    before = Window.orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("_blk", "_rows",
                          F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before")) \
        .where(F.col("_before") < n)
    taken = keyed.join(bases, "_blk")
    whole = taken.where(F.col("_before") + F.col("_rows") <= n)
    edge = taken.where(F.col("_before") + F.col("_rows") > n) \
        .withColumn("_pos", F.row_number().over(Window.partitionBy("_blk").orderBy(order))) \
        .where(F.col("_before") + F.col("_pos") <= n).drop("_pos")
    return whole.unionByName(edge).drop("_blk", "_rows", "_before")


# --- top-k ------------------------------------------------------------------------

def top_k(df: DataFrame, group: Sequence[str], order: Sequence[Column], k: int,
          rank: str = "rank", fan_in: int = TOP_K_FAN_IN) -> DataFrame:
    """First ``k`` rows of every group with their 1-based rank.

    Each task keeps its own k best, the survivors of ``fan_in`` task sets are
    reduced to k each, and only those meet per group, so a group that holds most of
    the rows never reaches one task.  Spark limits before the shuffle only below a threshold; for a
    larger ``k`` the result is computed at once under a higher one, and the session's setting
    stays as it was.
    """
    group, conf = list(group), df.sparkSession.conf
    if int(conf.get(GROUP_LIMIT, "1000")) <= k:
        before = conf.get(GROUP_LIMIT, "1000")
        conf.set(GROUP_LIMIT, str(k + 1))
        try:
            return materialise(top_k(df, group, order, k, rank, fan_in))
        finally:
            conf.set(GROUP_LIMIT, before)
    first = Window.partitionBy(*group, "_set").orderBy(*order)
    last = Window.partitionBy(*group).orderBy(*order)
    survivors = df.withColumn("_set", F.pmod(F.spark_partition_id(), F.lit(fan_in))) \
        .withColumn(rank, F.row_number().over(first)).where(F.col(rank) <= k)
    return survivors.withColumn(rank, F.row_number().over(last)) \
        .where(F.col(rank) <= k).drop("_set")


# --- selection -------------------------------------------------------------------------

def values_at(df: DataFrame, value: str, ranks: Callable[[int], Sequence[int]]) -> list:
    """Values at some 0-based ranks of a column without nulls, ``ranks`` given the row count.

    Equal values are counted first, counts are range-partitioned by value, and only the
    partitions in which the ranks fall are ordered: no task sees all values.
    """
    counts = df.groupBy(F.col(value).alias("v")).agg(F.count(F.lit(1)).alias("n"))
    path = scratch_path(df.sparkSession, "values")
    counts.repartitionByRange("v").withColumn("part", F.spark_partition_id()).write.parquet(path)
    placed = df.sparkSession.read.schema(f"{counts.schema.simpleString()[7:-1].replace(':', ' ')}, "
                                         "part int").parquet(path)
    # one row per partition
    parts = placed.groupBy("part").agg(F.sum("n").alias("n"), F.min("v").alias("low")) \
        .withColumn("upto", F.sum("n").over(Window.orderBy("low"))) \
        .select("part", (F.col("upto") - F.col("n")).alias("before"), "upto")
    total = parts.agg(F.max("upto")).first()[0]
    if not total:
        return []
    wanted = list(ranks(total))
    hit = F.lit(False)
    for r in wanted:
        hit = hit | ((F.col("before") <= r) & (r < F.col("upto")))
    inside = placed.join(F.broadcast(parts.where(hit).select("part", "before")), "part") \
        .withColumn("upto", F.col("before") + F.sum("n").over(Window.partitionBy("part").orderBy("v"))) \
        .withColumn("before", F.col("upto") - F.col("n")).where(hit)
    found = {(r["before"], r["upto"]): r["v"] for r in inside.select("before", "upto", "v").collect()}
    return [next(v for (a, b), v in found.items() if a <= r < b) for r in wanted]


# --- full ranks -------------------------------------------------------------------

def rank_all(df: DataFrame, group: Sequence[str], order: Sequence[Column],
             rank: str = "rank") -> DataFrame:
    """1-based rank of every row inside its group, for groups of any size.

    Rows are written once, so that sampling the ranges does not compute them again, and
    range-partitioned on (group, order); a row's rank is its place in its partition plus the
    rows of its group in earlier partitions.  ``order`` must end in a unique column.
    All columns of ``df`` are written and moved: leave out texts that are not needed.
    """
    group = list(group)
    df = stored(df, "unranked")
    keys = [F.col(g) for g in group] + list(order)
    placed = stored(
        df.repartitionByRange(*keys).sortWithinPartitions(*keys)
        .withColumn("_at", F.monotonically_increasing_id()), "placed") \
        .withColumn("_part", F.shiftright("_at", 33))
    heads = placed.groupBy(*group, "_part").agg(
        F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))
    before = Window.partitionBy(*group).orderBy("_part") \
        .rowsBetween(Window.unboundedPreceding, -1)
    # at most one row per partition and per group; stored, so that placed rows stay where they are
    offsets = stored(heads.select(*group, "_part", "_first", F.coalesce(
        F.sum("_n").over(before), F.lit(0)).alias("_offset")), "offsets")
    return placed.join(offsets, [*group, "_part"]) \
        .withColumn(rank, (F.col("_offset") + F.col("_at") - F.col("_first") + 1).cast("int")) \
        .drop("_at", "_part", "_first", "_offset")
