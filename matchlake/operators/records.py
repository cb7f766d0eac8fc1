"""Raw JSON records to flat postings, and profiles of their keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchlake import vocab as V
from matchlake.functions import rawjson as R
from matchlake.functions.text import string_array
from matchlake.operators.order import head_in_order

# texts of JSON values that count as absent
_FALSY = ("", "0", "false", "{}", "[]")


def map_records(lines: DataFrame, max_chars: int | None = None) -> DataFrame:
    """(line_no, value) lines of raw records to (line_no, posting fields).

    Records without a title or a description are dropped; descriptions stay whole unless
    ``max_chars`` asks for a cap.
    """
    # lines that turn out not to be objects have no title and drop out below
    parsed = lines.where(F.ltrim(F.col("value")).startswith("{")) \
        .select("line_no", R.record_struct(F.col("value")).alias("r")) \
        .withColumn("s", R.schema_org_struct(F.col("r")))
    paths = R.record_paths(F.col("r"), F.col("s"))
    picked = parsed.select(
        "line_no",
        *[R.first_of(paths, names).alias(field) for field, names in V.RAW_PATHS.items()],
        F.get_json_object(F.col("s.jobLocation"), "$.address").alias("_address"),
        F.col("s.jobLocation").alias("_place"),
        *[paths[p].alias(f"_org{i}") for i, p in enumerate(V.ORG_ADDRESS_PATHS)])
    parts = [F.get_json_object("_address", f"$.{p}").alias(f"_part{i}")
             for i, p in enumerate(V.SCHEMA_ADDRESS_PARTS)]
    texts = picked.select("*", *parts)
    names = [*V.RAW_PATHS, "_address", "_place", *[f"_org{i}" for i in range(3)],
             *[f"_part{i}" for i in range(3)]]
    # one projection, so all fields share one exchange with Python
    clean = texts.select("line_no", F.col("_address").startswith("{").alias("_is_address"),
                         (~F.col("_place").isin(list(_FALSY))).alias("_has_place"),
                         *[R.html_clean(F.col(n), max_chars if n == "description" else None)
                           .alias(n) for n in names])

    def joined(prefix: str):
        return F.concat_ws(", ", *[F.nullif(F.col(f"{prefix}{i}"), F.lit(""))
                                   for i in range(3)])

    in_address = F.coalesce(F.nullif(joined("_part"), F.lit("")), F.col("_address"))
    org = joined("_org")
    has_address = F.coalesce(F.col("_is_address"), F.lit(False)) & (in_address != "")
    has_place = F.coalesce(F.col("_has_place"), F.lit(False))

    def tier(address, place, company, none):
        return F.when(has_address, address).when(has_place, place) \
            .when(org != "", company).otherwise(none)

    return clean.where((F.col("title") != "") & (F.col("description") != "")).select(
        "line_no",
        F.coalesce(F.nullif(F.col("job_id"), F.lit("")),
                   F.concat(F.lit("row-"), F.col("line_no").cast("string"))).alias("job_id"),
        "title",
        F.coalesce(F.nullif(F.col("company"), F.lit("")), F.lit("Unknown")).alias("company"),
        tier(in_address, F.col("_place"), org, F.lit("Unknown")).alias("location"),
        tier(F.col("_address"), F.col("_place"), org, F.lit("")).alias("raw_location"),
        tier(F.lit("job_posting_location"), F.lit("job_posting_location"),
             F.lit("company_location_if_only_available"),
             F.lit("unknown")).alias("location_source"),
        F.coalesce(F.nullif(F.col("salary"), F.lit("")), F.lit("Unknown")).alias("salary"),
        "description", "apply_link")


def snapshot(mapped: DataFrame, limit: int) -> DataFrame:
    """First valid records in line order."""
    return head_in_order(mapped, "line_no", limit)


def snapshot_counts(lines: DataFrame, kept: DataFrame,
                    limit: int = V.SNAPSHOT_MAX_RECORDS) -> DataFrame:
    """(records_scanned, valid_records): lines read until the limit was reached."""
    total = lines.agg(F.count(F.lit(1)).alias("lines"))
    valid = kept.agg(F.count(F.lit(1)).alias("valid_records"),
                     F.max("line_no").alias("last_line"))
    # both sides are one-row aggregates
    return valid.join(F.broadcast(total)).select(
        F.when(F.col("valid_records") >= limit, F.col("last_line"))
        .otherwise(F.col("lines")).alias("records_scanned"), "valid_records")


# --- key profile --------------------------------------------------------------------------

def key_profile(records: DataFrame, value: str = "value", depth: int = 3) -> DataFrame:
    """(key, records): dotted keys of JSON objects and how many records have them.

    The root and ``depth`` further levels are read; an array stands for its first
    element and uses up one level.  A record is unfolded level by level inside its
    row, so the table is scanned once.
    """
    def unfold(e):
        def child(kv):
            path = F.when(e["path"] == "", kv["key"]).otherwise(
                F.concat_ws(".", e["path"], kv["key"]))
            return F.struct(path.alias("path"), kv["value"].alias("node"),
                            F.lit(True).alias("named"))
        return F.when(e["node"].startswith("{"), F.transform(
            F.map_entries(F.from_json(e["node"], "map<string,string>")), child)) \
            .when(e["node"].startswith("["), F.array(F.struct(
                e["path"].alias("path"), F.get_json_object(e["node"], "$[0]").alias("node"),
                F.lit(False).alias("named"))))

    df = records.select(F.array(F.struct(
        F.lit("").alias("path"), F.col(value).alias("node"), F.lit(False).alias("named"))
    ).alias("_level0"))
    for i in range(depth + 1):
        df = df.withColumn(f"_level{i + 1}", F.flatten(F.array_compact(
            F.transform(f"_level{i}", unfold))))
    every = F.concat(*[F.col(f"_level{i + 1}") for i in range(depth + 1)])
    keys = F.array_distinct(F.transform(F.filter(every, lambda e: e["named"]),
                                        lambda e: e["path"]))
    return df.select(F.explode(keys).alias("key")).groupBy("key") \
        .agg(F.count(F.lit(1)).alias("records"))


def candidate_fields(keys: DataFrame) -> DataFrame:
    """(label, matches): dotted keys whose last step is a known alias of a field."""
    labels = keys.sparkSession.range(1).select(F.explode(string_array(
        V.CANDIDATE_FIELD_NAMES)).alias("label"))
    hits = keys.select(F.explode(R.candidate_label(F.col("key"))).alias("label"), "key") \
        .groupBy("label").agg(F.array_join(F.array_sort(F.collect_set("key")), ", ").alias("matches"))
    return labels.join(hits, "label", "left").select(
        "label", F.coalesce("matches", F.lit("no obvious match found")).alias("matches"))


def previews(records: DataFrame, value: str = "value", fields: int = 10,
             max_length: int = 120) -> DataFrame:
    """(line_no, position, key, preview) of the first fields of every record."""
    pairs = F.slice(F.map_entries(F.from_json(value, "map<string,string>")), 1, fields)
    return records.select("line_no", F.posexplode(pairs).alias("position", "entry")).select(
        "line_no", "position", F.col("entry.key").alias("key"),
        R.json_preview(F.col("entry.value"), max_length).alias("preview"))
