"""Batch ingest: cleaning, de-duplication and the ingest and stream logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchlake import vocab as V
from matchlake.functions.text import clean_ws, join_forms
from matchlake.operators.order import running_sum
from matchlake.sources.readers import ensure_columns


def dedupe_key(*fields: Column) -> Column:
    """SHA-256 (hex) of the cleaned, lower-cased key fields joined by '|'."""
    return F.sha2(F.concat_ws("|", *[F.lower(clean_ws(c)) for c in fields]), 256)


def clean_batch(df: DataFrame, keep: tuple[str, ...] = ("row_index",)) -> DataFrame:
    """Clean every field, default the location columns, add the key, project."""
    if "raw_location" not in df.columns:
        df = df.withColumn("raw_location", F.col("location"))
    if "location_source" not in df.columns:
        df = df.withColumn("location_source", F.lit("raw_location_field"))
    df = ensure_columns(df, V.RAW_FIELDS)
    order = [c for c in keep if c in df.columns]
    cleaned = df.select(*order, *[
        clean_ws(F.col(c)).alias(c) if c != "job_id" else F.col(c).cast("string").alias(c)
        for c in V.RAW_FIELDS])
    key = F.sha2(F.concat_ws("|", *[F.lower(F.col(c)) for c in V.KEY_FIELDS]), 256)
    return cleaned.withColumn("dedupe_key", key)


def dedupe_first(df: DataFrame, key: str = "dedupe_key", order: str = "row_index") -> DataFrame:
    """One row per key, the first by input order.

    The rank filter lets Spark drop all but one row per key in every map task
    before the shuffle, so a key with a huge number of copies arrives as one row
    per task.
    """
    first = Window.partitionBy(key).orderBy(order)
    return df.withColumn("_rn", F.row_number().over(first)).where(F.col("_rn") == 1).drop("_rn")


def ingest_summary(cleaned: DataFrame) -> DataFrame:
    """Raw, ingested, removed and final row counts."""
    return cleaned.groupBy("dedupe_key").agg(F.count(F.lit(1)).alias("_n")).agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("raw_rows"),
        F.coalesce(F.sum("_n"), F.lit(0)).alias("ingested_rows"),
        F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("duplicate_rows_removed"),
        F.count(F.lit(1)).alias("final_cleaned_rows"))


def stream_batch_log(df: DataFrame, key: str = "dedupe_key", order: str = "row_index",
                     batch_rows: int = V.STREAM_BATCH_ROWS) -> DataFrame:
    """Log of replaying the rows in fixed-size batches with a global first-wins dedupe.

    A key is kept in the batch of its first row, so one minimum per key (combined
    before the shuffle) replaces the set of keys already seen.
    """
    def batch(c: Column) -> Column:
        return (F.floor(c / batch_rows) + 1).cast("bigint")

    incoming = df.groupBy(batch(F.col(order)).alias("batch_id")) \
        .agg(F.count(F.lit(1)).alias("incoming_records"))
    kept = df.groupBy(key).agg(F.min(order).alias("_first")) \
        .groupBy(batch(F.col("_first")).alias("batch_id")) \
        .agg(F.count(F.lit(1)).alias("_kept"))
    log = incoming.join(kept, "batch_id", "left") \
        .withColumn("kept_records", F.coalesce("_kept", F.lit(0)))
    return running_sum(log, "batch_id", {"cumulative_unique_records": "kept_records"}).select(
        "batch_id", "incoming_records", "kept_records",
        (F.col("incoming_records") - F.col("kept_records")).alias("duplicate_records"),
        "cumulative_unique_records")


def anti_seen(batch: DataFrame, seen: DataFrame, key: str = "dedupe_key") -> DataFrame:
    """Rows whose key is not in the state yet."""
    return batch.join(seen.select(key).distinct(), key, "left_anti")


def union_batches(*batches: DataFrame) -> DataFrame:
    """Concatenate batches by column name."""
    out = batches[0]
    for batch in batches[1:]:
        out = out.unionByName(batch, allowMissingColumns=True)
    return out


def embedding_text(df: DataFrame) -> DataFrame:
    """Text to embed per posting; postings without any text are dropped."""
    df = ensure_columns(df, V.EMBEDDING_TEXT_FIELDS)
    parts = [F.nullif(clean_ws(F.col(c)), F.lit("")) for c in V.EMBEDDING_TEXT_FIELDS]
    return df.withColumn("embedding_text", F.concat_ws("\n", *parts)) \
        .where(F.length("embedding_text") > 0)


def metadata_text(df: DataFrame) -> Column:
    """Space-joined non-empty text fields of a posting."""
    fields = ("title", "company", "location", "raw_location", "salary_text",
              "description", "employment_type")
    return join_forms(*[F.col(c) for c in fields])
