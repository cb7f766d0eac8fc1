"""Sources: posting files, vectors and candidate tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from matchlake import vocab as V
from matchlake.functions import rawjson as R
from matchlake.functions.location import location_source
from matchlake.functions.salary import salary_number_of, salary_object, salary_text_of
from matchlake.functions.text import strip, text_or_empty
from matchlake.operators.order import head_in_order, number_rows, with_file_position
from matchlake.sources.csv_records import read_csv_records

FORMATS = ("empty", "json_array", "ndjson", "single_json_object_or_unknown", "unknown")


def ensure_columns(df: DataFrame, columns: Sequence[str], default: str = "") -> DataFrame:
    """Add missing text columns with a default."""
    missing = [c for c in columns if c not in df.columns]
    return df.select("*", *[F.lit(default).alias(c) for c in missing]) if missing else df


def _path_exists(spark: SparkSession, path: str) -> bool:
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jpath.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jpath)


def first_existing(spark: SparkSession, *paths: str) -> str:
    """First path that exists (preferred file, then sample)."""
    for path in paths:
        if _path_exists(spark, path):
            return path
    raise FileNotFoundError(f"none of these paths exists: {', '.join(paths)}")


def read_csv(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """CSV with a header as strings and a ``row_index`` in file order.

    ``multi_line`` accepts line breaks inside quotes; files are split either way, see
    ``csv_records``.  Turn it off for files known to have one record per line.
    """
    if multi_line:
        return read_csv_records(spark, path)
    df = spark.read.csv(path, header=True, quote='"', escape='"', inferSchema=False)
    return number_rows(with_file_position(df))


def read_csv_text(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Jobs CSV read literally: every field a string and '' where it is empty."""
    return read_csv(spark, path, multi_line).na.fill("")


def read_csv_na(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Raw jobs CSV: empty fields and the usual NA spellings become ''."""
    # fixed values: spellings of a missing value in CSV
    na = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND",
          "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null"]
    df = read_csv(spark, path, multi_line)
    return df.select(*[F.when(F.col(c).isin(na), "").otherwise(text_or_empty(F.col(c))).alias(c)
                       if c != "row_index" else F.col(c) for c in df.columns])


def load_jobs(df: DataFrame) -> DataFrame:
    """Load-time columns: missing fields, raw location, source and salary readings."""
    df = ensure_columns(df, V.LOADED_FIELDS + ("salary",))
    raw = F.when(strip(text_or_empty(F.col("raw_location"))) == "", F.col("location")) \
        .otherwise(F.col("raw_location"))
    parsed, salary = salary_object(F.col("salary")), F.col("salary")
    return df.withColumns({
        "raw_location": raw,
        "location_source": location_source(F.col("location_source"), F.col("location")),
        "_salary": parsed}) \
        .withColumn("salary_number", salary_number_of(salary, F.col("_salary"))) \
        .withColumn("salary_text", salary_text_of(salary, F.col("_salary"),
                                                  F.col("salary_number"))).drop("_salary")


# --- JSON lines ---------------------------------------------------------------------

def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line_no, value): every line of the text files, numbered from 1."""
    lines = number_rows(with_file_position(spark.read.text(path)), "line_no")
    return lines.select((F.col("line_no") + 1).alias("line_no"), "value")


def json_objects(lines: DataFrame) -> DataFrame:
    """Lines that hold one JSON object; blank, broken and other lines are dropped."""
    return lines.withColumn("value", strip(F.col("value"))) \
        .where((F.col("value") != "") & R.is_object(F.col("value")))


def read_ndjson(spark: SparkSession, path: str) -> DataFrame:
    return json_objects(read_lines(spark, path))


def read_json_array(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """Elements of JSON array files as rows; optionally only the first few."""
    df = spark.read.option("multiLine", True).json(path)
    return df.limit(limit) if limit else df


def ndjson_sample(lines: DataFrame, max_lines: int = 5) -> DataFrame:
    """Records of the first lines, up to the first line that does not parse."""
    first = lines.where(F.col("line_no") <= max_lines) \
        .withColumn("value", strip(F.col("value"))).where(F.col("value") != "")
    checked = first.withColumn("bad", F.try_parse_json("value").isNull())
    limit = checked.where("bad").agg(F.min("line_no").alias("first_bad"))
    # both sides hold at most ``max_lines`` rows and one row
    return checked.join(F.broadcast(limit)) \
        .where(F.col("first_bad").isNull() | (F.col("line_no") < F.col("first_bad"))) \
        .select("line_no", "value")


def file_format(start: Column) -> Column:
    """Kind of file from its first non-blank text."""
    head = F.regexp_replace(text_or_empty(start), r"(?U)^[\s\x1c-\x1f]+", "")
    first_line = F.regexp_extract(head, r"^([^\n\r]*)", 1)
    return F.when(head == "", "empty").when(head.startswith("["), "json_array") \
        .when(head.startswith("{"), F.when(F.try_parse_json(first_line).isNotNull(), "ndjson")
              .otherwise("single_json_object_or_unknown")) \
        .otherwise("unknown")


def detect_formats(spark: SparkSession, path: str) -> DataFrame:
    """(file, format) of every file, from its first non-blank line.

    Files are read as lines, so a large file is judged by small rows; a file
    without any line keeps its name through the file listing.
    """
    listing = spark.read.format("binaryFile").load(path) \
        .select(F.regexp_replace("path", "^file:/+", "/").alias("file"))
    lines = with_file_position(spark.read.text(path)).where(strip(F.col("value")) != "") \
        .withColumn("file", F.regexp_replace("_file", "^file:/+", "/"))
    firsts = lines.groupBy("file").agg(
        F.min_by("value", F.struct("_block", "_at")).alias("start"))
    return listing.join(firsts, "file", "left").select("file", file_format(F.col("start")).alias("format"))


def read_postings(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """``.json`` files are mapped from raw records, everything else is CSV."""
    from matchlake.operators.records import map_records
    if path.lower().endswith(".json"):
        return map_records(read_ndjson(spark, path))
    return read_csv_na(spark, path, multi_line)


def replay_batches(df: DataFrame, batch_rows: int = V.STREAM_BATCH_ROWS,
                   max_batches: int | None = None, order: str = "row_index") -> DataFrame:
    """Fixed-size batches along the row order, optionally only the first few."""
    out = df.withColumn("batch_id", (F.floor(F.col(order) / batch_rows) + 1).cast("bigint"))
    return out.where(F.col("batch_id") <= max_batches) if max_batches is not None else out


# --- vectors ---------------------------------------------------------------------------

def read_vectors(df: DataFrame, row_index: str = "row_index", vector: str = "embedding",
                 dimension: int | None = None) -> DataFrame:
    """(row_index, embedding); a missing or wrongly sized vector is an error."""
    size = F.lit(dimension) if dimension else None
    wrong = F.col(vector).isNull() | F.col(row_index).isNull()
    if size is not None:
        wrong = wrong | (F.size(vector) != size)
    return df.select(
        F.col(row_index).cast("bigint").alias("row_index"),
        F.when(wrong, F.raise_error(F.lit("vector missing or of the wrong size"))
               .cast("array<float>")).otherwise(F.col(vector)).alias("embedding"))


def first_rows(df: DataFrame, n: int, order: str = "row_index") -> DataFrame:
    return head_in_order(df, order, n)
