"""Sinks for postings, vectors, logs and reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from matchlake import vocab as V


def write_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite") -> str:
    """Write a table in parallel files; CSV files carry a header and quoted line breaks."""
    writer = df.write.mode(mode)
    if fmt == "csv":
        writer = writer.option("header", True).option("quote", '"').option("escape", '"')
    writer.format(fmt).save(path)
    return path


def write_jobs(cleaned: DataFrame, path: str, fmt: str = "parquet") -> str:
    """Cleaned postings in the fixed column order, with their row number if present."""
    keep = [c for c in ("row_index", *V.CLEANED_FIELDS) if c in cleaned.columns]
    return write_table(cleaned.select(*keep), path, fmt)


def write_vectors(vectors: DataFrame, path: str) -> str:
    """Vectors and their index columns in one table, so the two cannot drift apart."""
    keep = [c for c in (*V.EMBEDDING_INDEX_FIELDS, "embedding") if c in vectors.columns]
    return write_table(vectors.select(*keep), path)


def write_reports(reports: dict[str, DataFrame], folder: str, fmt: str = "csv") -> dict[str, str]:
    """Several small reports under one folder."""
    return {name: write_table(df, f"{folder}/{name}", fmt) for name, df in reports.items()}


def read_back(df: DataFrame, path: str, fmt: str = "parquet",
              columns: Sequence[str] | None = None) -> DataFrame:
    """Read a table written by ``write_table`` with the schema of ``df``."""
    reader = df.sparkSession.read.schema(df.schema)
    if fmt == "csv":
        reader = reader.option("header", True).option("quote", '"').option("escape", '"') \
            .option("multiLine", True)
    out = reader.format(fmt).load(path)
    return out.select(*columns) if columns else out
