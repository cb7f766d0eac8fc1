"""Role-balanced sample of postings without replacement.

Order inside every draw is the MD5 of (seed, row number), which is reproducible on
any number of tasks.  The draws depend on each other, but a bucket can lose at most
the rows drawn before it, so the first ``i × cap`` rows of bucket i (and the first
``max_jobs`` rows overall) are all that can matter.

Texts are searched once: draw and bucket flags (a bit mask) are written as a narrow table.
Counts per bucket then tell a threshold of the draw below which so many rows of the bucket lie,
as in priority sampling; rows below the threshold of one of their buckets are kept, and the
dependent draws run on that bounded set.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchlake import vocab as V
from matchlake.functions.text import norm_search, search_term
from matchlake.operators.order import scratch_path
from matchlake.operators.signals import role_flags

BUCKETS = tuple(V.SAMPLE_BUCKETS)


def family_bucket_flags(jobs: DataFrame, text: str = "embedding_text") -> DataFrame:
    """One boolean per sampling bucket."""
    return role_flags(jobs.withColumn("_normal", norm_search(F.col(text))), "_normal",
                      V.SAMPLE_BUCKETS, search_term).drop("_normal")


def bucket_cap(max_jobs: int) -> int:
    return max(1, max_jobs // (len(BUCKETS) + 1))


def _with_order(df: DataFrame, seed: int) -> DataFrame:
    return df.withColumn("_draw", F.md5(F.concat(F.lit(f"{seed}:"),
                                                 F.col("row_index").cast("string"))))


def _bit(i: int):
    return F.col("_mask").bitwiseAND(F.lit(1 << i)) != 0


#: Draws are compared by their first hexadecimal digits.
DIGITS = 12


def _candidates(flagged: DataFrame, max_jobs: int) -> DataFrame:
    """(row_index, _draw, flags) of a bounded set with every row that any draw could take."""
    cap = bucket_cap(max_jobs)
    wanted = [cap * (i + 1) for i in range(len(BUCKETS))] + [max_jobs]
    mask = F.lit(1 << len(BUCKETS))  # the general bucket holds every row
    for i, b in enumerate(BUCKETS):
        mask = mask.bitwiseOR(F.when(F.col(b), 1 << i).otherwise(0))
    path = scratch_path(flagged.sparkSession, "sample-flags")
    flagged.select("row_index", "_draw", mask.alias("_mask"), F.conv(
        F.substring("_draw", 1, DIGITS), 16, 10).cast("long").alias("_at")).write.parquet(path)
    narrow = flagged.sparkSession.read.parquet(path)
    sizes = narrow.agg(*[F.count_if(_bit(i)).alias(str(i)) for i in range(len(wanted))]).first()
    # rows below a threshold are binomial: six standard deviations more than wanted
    shares = [min(1.0, (n + 6 * math.sqrt(n) + 36) / size) if size else 1.0
              for n, size in zip(wanted, sizes)]
    while True:
        below = [_bit(i) & (F.col("_at") <= F.lit(int(s * 16 ** DIGITS))) for i, s in enumerate(shares)]
        found = narrow.agg(*[F.count_if(b).alias(str(i)) for i, b in enumerate(below)]).first()
        short = [i for i, n in enumerate(found) if n < min(wanted[i], sizes[i])]
        if not short:
            break
        shares = [min(1.0, 2 * s) if i in short else s for i, s in enumerate(shares)]
    kept = narrow.where(reduce(Column.__or__, below))
    return kept.select("row_index", "_draw", *[_bit(i).alias(b) for i, b in enumerate(BUCKETS)])


def balanced_sample(jobs: DataFrame, max_jobs: int = V.EMBEDDING_SAMPLE_SIZE,
                    seed: int = V.SAMPLE_SEED) -> DataFrame:
    """(row_index, bucket, sample_position) of the selected postings."""
    flagged = _with_order(family_bucket_flags(jobs), seed)
    cap = bucket_cap(max_jobs)
    df = _candidates(flagged, max_jobs).withColumn("bucket", F.lit(None).cast("string"))
    # windows below hold at most max_jobs + cap × 45 rows, whatever the table size
    for name in BUCKETS:
        open_rows = F.col("bucket").isNull() & F.col(name)
        turn = Window.partitionBy("_open").orderBy("_draw", "row_index")
        df = df.withColumn("_open", open_rows) \
            .withColumn("_turn", F.row_number().over(turn)) \
            .withColumn("bucket", F.when(F.col("_open") & (F.col("_turn") <= cap), F.lit(name))
                        .otherwise(F.col("bucket")))
    taken = F.sum(F.col("bucket").isNotNull().cast("int")).over(Window.partitionBy())
    turn = Window.partitionBy("_open").orderBy("_draw", "row_index")
    df = df.withColumn("_taken", taken).withColumn("_open", F.col("bucket").isNull()) \
        .withColumn("_turn", F.row_number().over(turn)) \
        .withColumn("bucket", F.when(
            F.col("_open") & (F.col("_turn") <= F.lit(max_jobs) - F.col("_taken")),
            F.lit(V.GENERAL_BUCKET)).otherwise(F.col("bucket")))
    chosen = df.where(F.col("bucket").isNotNull())
    position = F.row_number().over(Window.partitionBy().orderBy(
        F.md5(F.concat(F.lit("shuffle:"), F.col("_draw"))), "row_index"))
    return chosen.select("row_index", "bucket", position.alias("sample_position"))


def sampling_summary(sample: DataFrame) -> DataFrame:
    """Selected postings per bucket, 0 for buckets that gave none."""
    spark = sample.sparkSession
    names = spark.createDataFrame([(b,) for b in BUCKETS + (V.GENERAL_BUCKET,)], "bucket string")
    counts = sample.groupBy("bucket").agg(F.count(F.lit(1)).alias("_n"))
    return names.join(counts, "bucket", "left").select(
        "bucket", F.coalesce("_n", F.lit(0)).alias("job_count"))


def anti_selected(jobs: DataFrame, selected: DataFrame) -> DataFrame:
    """Postings that are not selected yet."""
    return jobs.join(selected.select("row_index"), "row_index", "left_anti")
