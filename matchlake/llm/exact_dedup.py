"""Exact de-duplication with an extendible-hash index on shared files (DataFrame functions only).

1. Every row becomes a narrow entry (id, 64-bit hash, SHA-256) on shared files.
2. The directory starts as one bucket and doubles; a bucket with more than ``capacity`` distinct
   hashes is split.  One pass counts the cells of several doublings; later passes read only the
   hashes whose buckets are still overfull, until none is.  It is written as a table of buckets
   (local depth, prefix, owner).
3. Texts are grouped by (hash, text): Spark compares their bytes, and copies meet in the map
   tasks already, so a text that fills a third of the table crosses the shuffle once per task.
   Owner tasks take contiguous ranges of buckets, chain the different texts of one hash, and write
   the pages: one row per text, without the text.
4. A hash with a chain of several texts also has an overflow page with these texts.
5. Every entry goes by the directory to its bucket and to the owner of that bucket, who reads the
   pages of its range with it.  A chain of one text answers by the hash alone, since the text of
   every row is in the index.  Rows of longer chains bring their text and walk the overflow page,
   comparing bytes; so neither the hash nor SHA-256 decides what is equal.  Groups with a share of
   1/2,000 of all rows or more, 2,000 at most, do not go to their owner but are broadcast.

Nulls and repeats: a null text counts as empty.  Of equal texts the rows with the largest id
stay (several, if the id itself is repeated); a null id counts in the group but never wins,
unless all ids of the group are null: then its rows stay.  An empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchlake.llm.common import HOT_GROUPS, stored, whole_text, with_groups, without_rows
from matchlake.operators.order import scratch_path

#: Distinct hashes that a bucket holds before it is split.
CAPACITY = 16_384
#: Buckets hold more where this many would not do, so a directory is always some MB at most.
BUCKETS = 1 << 17
#: Doublings of the directory that a further pass over overfull buckets counts.
DOUBLINGS = 4

Hash = Callable[[Column], Column]


def _prefix(depth: int) -> Column:
    """The first ``depth`` bits of the hash."""
    return F.shiftrightunsigned("h", 64 - depth) if depth else F.lit(0).cast("long")


def directory(hashes: DataFrame, capacity: int = CAPACITY, doublings: int = DOUBLINGS) -> DataFrame:
    """(local_depth, prefix, load) of every bucket; none is overfull, every hash lies in one.

    ``hashes`` has the distinct values ``h``.  64 bits tell all hashes apart, so the rounds end.
    """
    n = hashes.count()
    capacity = max(1, capacity, math.ceil(n / BUCKETS))
    low, high = 0, max(1, math.ceil(math.log2(max(n, 1) / capacity)) + 1)
    buckets: DataFrame | None = None
    while True:
        levels = hashes.groupBy(_prefix(high).alias("cell")).agg(F.count(F.lit(1)).alias("n")) \
            .select("cell", "n", F.explode(F.sequence(F.lit(low), F.lit(high))).alias("local_depth")) \
            .withColumn("prefix", F.expr(f"shiftrightunsigned(cell, {high} - local_depth)"))
        loads = stored(levels.groupBy("local_depth", "prefix").agg(F.sum("n").alias("load")),
                       "hash-loads")
        # a bucket fits, and the bucket it was split from did not
        parent = loads.select((F.col("local_depth") + 1).alias("local_depth"),
                              F.col("prefix").alias("parent"), F.col("load").alias("parent_load"))
        fit = loads.where(F.col("load") <= capacity) \
            .withColumn("parent", F.shiftrightunsigned("prefix", 1)) \
            .join(parent, ["local_depth", "parent"], "left") \
            .where((F.col("parent_load") > capacity) | F.col("parent_load").isNull()) \
            .select("local_depth", "prefix", "load")
        buckets = fit if buckets is None else buckets.unionByName(fit)
        over = loads.where((F.col("local_depth") == high) & (F.col("load") > capacity))
        if over.isEmpty():
            return buckets
        # at most BUCKETS prefixes
        hashes = hashes.withColumn("prefix", _prefix(high)) \
            .join(F.broadcast(over.select("prefix")), "prefix", "left_semi").select("h")
        low, high = high, min(64, high + doublings)


@dataclass(frozen=True)
class Index:
    """Where the files of an index lie, and the number of rows it was built from."""
    directory: str
    pages: str
    overflow: str
    owners: int
    rows: int

    def addressed(self, rows: DataFrame) -> DataFrame:
        """``rows`` with the bucket (local_depth, prefix) of their ``h`` and its owner."""
        buckets = rows.sparkSession.read.parquet(self.directory)
        # 64 values at most; each row tries the prefixes of these lengths, one of which is a bucket
        depths = sorted(r[0] for r in buckets.select("local_depth").distinct().collect())
        if not depths:
            return rows.select("*", *[F.lit(None).cast(t).alias(c) for c, t in (
                ("local_depth", "int"), ("prefix", "long"), ("owner", "int"))]).limit(0)
        tried = F.array(*[F.struct(F.lit(d).alias("local_depth"), _prefix(d).alias("prefix"))
                          for d in depths])
        return rows.withColumn("at", F.explode(tried)).select(*rows.columns, "at.*") \
            .join(F.broadcast(buckets), ["local_depth", "prefix"])

    def found(self, entries: DataFrame, texts: DataFrame) -> DataFrame:
        """``entries`` (doc_id, h, sha) with the keep_id and group_size of their text.

        ``texts`` are the same rows as (doc_id, h, t, sha); it is read for hashes with several texts.
        """
        spark, names = entries.sparkSession, entries.columns
        pages = spark.read.parquet(self.pages)
        single = pages.where("texts = 1")
        is_hot = F.col("group_size") * HOT_GROUPS >= self.rows
        hot = F.broadcast(single.where(is_hot).select("h", "keep_id", "group_size"))
        # owners read the pages of their buckets together with the entries sent to them
        sent = self.addressed(entries.join(hot, "h", "left_anti")) \
            .withColumn("entry", F.struct(*names)) \
            .select("owner", "local_depth", "prefix", "h", "entry")
        kept = single.where(~is_hot).select(
            "owner", "local_depth", "prefix", "h", F.struct("keep_id", "group_size").alias("page"))
        met = Window.partitionBy("owner", "local_depth", "prefix", "h") \
            .orderBy(F.col("page").isNull()).rowsBetween(Window.unboundedPreceding, 0)
        cold = sent.unionByName(kept, allowMissingColumns=True) \
            .repartitionById(self.owners, "owner") \
            .withColumn("page", F.first("page").over(met)) \
            .where("entry IS NOT NULL AND page IS NOT NULL").select("entry.*", "page.*")
        out = entries.join(hot, "h").select(*names, "keep_id", "group_size").unionByName(cold)
        overflow = spark.read.parquet(self.overflow)
        if overflow.isEmpty():
            return out
        chained = texts.join(overflow.select("h").distinct(), "h", "left_semi")
        walked = with_groups(chained, overflow.select("h", "t", "keep_id", "group_size"), ["h", "t"],
                             "group_size", self.rows)
        return out.unionByName(walked.select(*names, "keep_id", "group_size"))


def build_index(texts: DataFrame, hashes: DataFrame, rows: int, capacity: int = CAPACITY) -> Index:
    """The index of ``texts`` (doc_id, h, t) with the distinct ``hashes``, on shared files."""
    spark = texts.sparkSession
    owners = int(spark.conf.get("spark.sql.shuffle.partitions"))
    index = Index(*[scratch_path(spark, f"hash-{part}") for part in (
        "directory", "pages", "overflow")], owners, rows)
    start = F.when(F.col("local_depth") == 0, 0.0).otherwise(
        F.col("prefix") / F.pow(F.lit(2.0), F.col("local_depth")))
    start = F.when(start < 0, start + 1).otherwise(start)  # a prefix of 64 bits has a sign
    directory(hashes, capacity).withColumn(
        "owner", F.least(F.floor(start * owners), F.lit(owners - 1)).cast("int")) \
        .select("local_depth", "prefix", "load", "owner").write.parquet(index.directory)

    groups = texts.groupBy("h", "t").agg(F.max("doc_id").alias("keep_id"),
                                         F.count(F.lit(1)).alias("group_size"))
    chain = Window.partitionBy("owner", "local_depth", "prefix", "h")
    # two texts of one chain may agree in id and size: their order does not matter
    index.addressed(groups.select("h", "keep_id", "group_size")).repartitionById(owners, "owner") \
        .withColumn("chain", F.row_number().over(chain.orderBy("keep_id", "group_size")) - 1) \
        .withColumn("texts", F.count(F.lit(1)).over(chain)) \
        .write.parquet(index.pages)
    chained = spark.read.parquet(index.pages).where("texts > 1").select("h").distinct()
    overflow = groups.limit(0)
    if not chained.isEmpty():
        overflow = texts.join(chained, "h", "left_semi").groupBy("h", "t").agg(
            F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    overflow.write.parquet(index.overflow)
    return index


def _judged(docs: DataFrame, key: str, text: str, capacity: int,
            hashed: Hash = F.xxhash64) -> tuple[DataFrame, int]:
    """Per row of ``docs``: doc_id, h, sha, keep_id, group_size, kept; and the number of rows."""
    texts = docs.select(F.col(key).alias("doc_id"), whole_text(text).alias("t")) \
        .select("doc_id", hashed(F.col("t")).cast("long").alias("h"), "t",
                F.sha2("t", 256).alias("sha"))
    entries = stored(texts.select("doc_id", "h", "sha"), "hash-entries")
    total = entries.count()
    index = build_index(texts.select("doc_id", "h", "t"),
                        stored(entries.select("h").distinct(), "hash-values"), total, capacity)
    keep = F.when(F.col("group_size") == 1, F.col("doc_id")).otherwise(F.col("keep_id"))
    return index.found(entries, texts).select(
        "doc_id", "h", "sha", keep.alias("keep_id"), "group_size",
        ((F.col("group_size") == 1) | F.col("doc_id").eqNullSafe(F.col("keep_id"))).alias("kept")), \
        total


def exact_groups(docs: DataFrame, key: str = "doc_id", text: str = "text",
                 capacity: int = CAPACITY, hashed: Hash = F.xxhash64) -> DataFrame:
    """Per row of ``docs``: key, keep_id, group_size, kept, text_sha256; see the module."""
    return _judged(docs, key, text, capacity, hashed)[0].select(
        F.col("doc_id").alias(key), "keep_id", "group_size", "kept",
        F.col("sha").alias("text_sha256"))


def drop_copies(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without the rows that ``exact_groups`` drops; all columns stay as they are."""
    judged, total = _judged(docs, key, text, CAPACITY)
    gone = judged.where("NOT kept").groupBy("h", "sha", "doc_id") \
        .agg(F.count(F.lit(1)).alias("rows"))
    return without_rows(docs, stored(gone, "hash-gone"), total, {
        "h": F.xxhash64(whole_text(text)), "sha": F.sha2(whole_text(text), 256),
        "doc_id": F.col(key)})
