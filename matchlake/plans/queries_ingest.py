"""Queries over sources, sinks, raw records, cleaning, de-duplication and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matchlake import vocab as V
from matchlake.functions import location as L
from matchlake.functions import rawjson as R
from matchlake.functions import text as T
from matchlake.functions.vectors import norm
from matchlake.operators import ingest as I
from matchlake.operators import records as M
from matchlake.operators.order import head_in_order, scratch_path
from matchlake.plans import fixtures as X
from matchlake.plans import sql as S
from matchlake.plans.catalog import ANSWERS, query
from matchlake.sources import readers, writers
from matchlake.streaming import ingest as SI
from matchlake.streaming.paced import PACED, paced_stream, run_to_end

CSV_FIELDS = ("job_id", "title", "company", "location", "salary", "description", "apply_link")


def _csv(spark: SparkSession, sf_dir: str) -> str:
    """Postings as CSV files in document order."""
    path = scratch_path(spark, "jobs-csv")
    ordered = X.jobs(spark, sf_dir).repartitionByRange("row_index") \
        .sortWithinPartitions("row_index").select(*CSV_FIELDS)
    return writers.write_table(ordered, path, "csv")


@query("src_csv_text", S.with_(*S.JOB_CTES, select=(
    "SELECT row_number() OVER (ORDER BY row_index) - 1 AS row_index, job_id, title, location, "
    "location AS raw_location, CASE WHEN location IN ('', 'Unknown') THEN 'unknown' ELSE "
    "'ambiguous_location' END AS location_source, salary_text, salary_number, employment_type, "
    "md5(description) AS description_md5 FROM jobs")))
def src_csv_text(spark, sf):
    df = readers.load_jobs(readers.read_csv_text(spark, _csv(spark, sf)))
    return df.select("row_index", "job_id", "title", "location", "raw_location",
                     "location_source", "salary_text", "salary_number", "employment_type",
                     F.md5("description").alias("description_md5"))


@query("src_csv_na", S.with_(*S.JOB_CTES, select=(
    "SELECT row_number() OVER (ORDER BY row_index) - 1 AS row_index, job_id, title, location, "
    "salary, md5(description) AS description_md5 FROM jobs")))
def src_csv_na(spark, sf):
    return readers.read_csv_na(spark, _csv(spark, sf)).select(
        "row_index", "job_id", "title", "location", "salary",
        F.md5("description").alias("description_md5"))


def _raw_files(spark: SparkSession, sf_dir: str) -> str:
    path = scratch_path(spark, "raw")
    X.raw_records(spark, sf_dir).repartitionByRange("line_no").sortWithinPartitions("line_no") \
        .select("value").write.text(path)
    return path


_VALID = "doc_id % 31 <> 0 AND doc_id % 37 <> 0 AND doc_id % 41 <> 0"
_RAW_ID = ("CASE WHEN doc_id % 4 <> 0 THEN 'src-' || doc_id WHEN doc_id % 8 <> 0 THEN "
           "'oid-' || doc_id END")


@query("src_ndjson", f"SELECT doc_id + 1 AS line_no, coalesce({_RAW_ID}, '') AS id "
                     f"FROM documents WHERE {_VALID}")
def src_ndjson(spark, sf):
    lines = readers.read_ndjson(spark, _raw_files(spark, sf))
    return lines.select("line_no", F.coalesce(R.json_first_value(
        F.col("value"), V.RAW_PATHS["job_id"]), F.lit("")).alias("id"))


@query("src_json_array", "SELECT doc_id, md5(text) AS text_md5 FROM documents")
def src_json_array(spark, sf):
    path = scratch_path(spark, "arrays")
    # one array file per hundred documents
    arrays = X.documents(spark, sf).groupBy(F.floor(F.col("doc_id") / 100).alias("part")).agg(
        F.to_json(F.collect_list(F.struct("doc_id", "text"))).alias("value"))
    arrays.select("value").write.option("maxRecordsPerFile", 1).text(path)
    return readers.read_json_array(spark, path).select("doc_id", F.md5("text").alias("text_md5"))


@query("src_ndjson_sample", "SELECT doc_id + 1 AS line_no, coalesce(" + _RAW_ID + ", '') AS id "
       "FROM documents WHERE doc_id + 1 <= 5 AND doc_id % 31 <> 0 AND doc_id < (SELECT "
       "coalesce(min(doc_id), 9) FROM documents WHERE doc_id % 37 = 0 AND doc_id % 31 <> 0 "
       "AND doc_id < 5)")
def src_ndjson_sample(spark, sf):
    sample = readers.ndjson_sample(readers.read_lines(spark, _raw_files(spark, sf)))
    return sample.select("line_no", F.coalesce(R.json_first_value(
        F.col("value"), V.RAW_PATHS["job_id"]), F.lit("")).alias("id"))


_KINDS = ("empty", "json_array", "ndjson", "single_json_object_or_unknown", "unknown")


@query("src_detect_format", "SELECT DISTINCT k.kind AS expected, k.kind AS format FROM "
       f"documents, (SELECT unnest({S.lst(_KINDS)}) AS kind, unnest([0, 1, 2, 3, 4]) AS n) k "
       "WHERE doc_id % 5 = k.n")
def src_detect_format(spark, sf):
    path = scratch_path(spark, "kinds")
    n = F.col("doc_id") % 5
    body = F.to_json(F.struct("doc_id"))
    value = F.when(n == 0, "  ").when(n == 1, F.concat(F.lit(" ["), body, F.lit("]"))) \
        .when(n == 2, body).when(n == 3, "{").otherwise("plain text")
    kind = F.element_at(T.string_array(_KINDS), (n + 1).cast("int"))
    X.documents(spark, sf).select(kind.alias("kind"), value.alias("value")) \
        .write.partitionBy("kind").text(path)
    found = readers.detect_formats(spark, path + "/*/*.txt")
    return found.select(F.regexp_extract("file", "kind=([^/]+)/", 1).alias("expected"),
                        "format").distinct()


# a record needs a title; an object without a name is a title of its own, "{}"
_TITLED = "(doc_id % 29 <> 0 OR doc_id % 3 = 1)"
_TITLE = f"CASE WHEN doc_id % 29 = 0 THEN '{{}}' ELSE {X.JOB_COLUMNS['title']} END"


@query("src_dispatch", "SELECT 'csv' AS kind, count(*) AS postings FROM documents UNION ALL "
       f"SELECT 'json', count(*) FROM documents WHERE {_VALID} AND {_TITLED}")
def src_dispatch(spark, sf):
    json_path = scratch_path(spark, "raw") + ".json"
    X.raw_records(spark, sf).select("value").write.text(json_path)
    both = [readers.read_postings(spark, p).select(F.lit(k).alias("kind"))
            for k, p in (("csv", _csv(spark, sf)), ("json", json_path))]
    return both[0].unionByName(both[1]).groupBy("kind").agg(F.count("*").alias("postings"))


@query("src_fallback", "SELECT lang, count(*) AS n FROM documents GROUP BY lang")
def src_fallback(spark, sf):
    path = readers.first_existing(spark, f"{sf}/preferred.parquet", f"{sf}/documents.parquet")
    return spark.read.parquet(path).groupBy("lang").agg(F.count("*").alias("n"))


@query("src_microbatch", "SELECT CAST(floor(doc_id / 500) + 1 AS BIGINT) AS batch_id, "
       "count(*) AS n, min(doc_id) AS first_row FROM documents GROUP BY 1")
def src_microbatch(spark, sf):
    return readers.replay_batches(X.jobs(spark, sf)).groupBy("batch_id").agg(
        F.count("*").alias("n"), F.min("row_index").alias("first_row"))


@query("src_vectors", "SELECT vec_id AS row_index, len(embedding) AS dimension, "
       "round(sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * "
       "CAST(x AS DOUBLE)))), 6) AS length FROM embeddings")
def src_vectors(spark, sf):
    v = readers.read_vectors(X.table(spark, sf, "embeddings"), "vec_id", "embedding", 64)
    return v.select("row_index", F.size("embedding").cast("bigint").alias("dimension"),
                    F.round(norm(F.col("embedding")), 6).alias("length"))


# --- raw records ----------------------------------------------------------------------

@query("json_path", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS VARCHAR) AS k, "
       "json_extract_string(props, '$.k.x') AS missing FROM events")
def json_path(spark, sf):
    return X.table(spark, sf, "events").select(
        "event_id", R.json_path(F.col("props"), "k").alias("k"),
        R.json_path(F.col("props"), "k.x").alias("missing"))


@query("json_first_value", f"SELECT doc_id + 1 AS line_no, {_RAW_ID} AS id, CASE WHEN {_TITLED} "
       f"THEN {_TITLE} END AS title "
       f"FROM documents WHERE {_VALID}")
def json_first_value(spark, sf):
    lines = readers.json_objects(X.raw_records(spark, sf))
    return lines.select("line_no", *[R.json_first_value(F.col("value"), V.RAW_PATHS[p]).alias(n)
                                     for n, p in (("id", "job_id"), ("title", "title"))])


_PLAIN = ("replace(replace(replace(replace(html, '&quot;', '\"'), '&copy;', '©'), '&middot;', "
          "'·'), '&amp;', '&')")
_CLEAN = f"trim(regexp_replace(regexp_replace({_PLAIN}, '<[^>]+>', ' ', 'g'), '{S.BL}', ' ', 'g'))"


@query("html_clean", f"SELECT page_id, md5({_CLEAN}) AS text_md5, length({_CLEAN}) AS n_chars, "
       f"rtrim(substr({_CLEAN}, 1, 200)) AS excerpt FROM pages")
def html_clean(spark, sf):
    pages = X.spread(X.table(spark, sf, "pages"), "page_id").select(
        "page_id", R.html_clean(F.col("html")).alias("t"),
        R.html_clean(F.col("html"), 200).alias("excerpt"))
    return pages.select("page_id", F.md5("t").alias("text_md5"),
                        F.length("t").cast("bigint").alias("n_chars"), "excerpt")


def _mapped(spark, sf, whole: bool = True) -> DataFrame:
    """Mapped raw records, with whole or capped descriptions."""
    return M.map_records(X.raw_records(spark, sf), None if whole else V.DESCRIPTION_MAX_CHARS)


# the mapped text drops tags, also those that only appear once entities are decoded
_BODY = (f"trim(regexp_replace(regexp_replace(' R&D <team>  ' || text, '<[^>]+>', ' ', 'g'), "
         f"'{S.BL}', ' ', 'g'))")
_PLACE = X.JOB_COLUMNS["location"]
_ADDRESS = f"array_to_string(list_filter([{_PLACE}, 'Reg', CASE WHEN doc_id % 8 = 0 THEN 'US' END], lambda x: x <> ''), ', ')"
MAPPED = (
    "mapped AS (SELECT doc_id + 1 AS line_no, "
    f"coalesce({_RAW_ID}, 'row-' || (doc_id + 1)) AS job_id, {_TITLE} AS title, "
    "CASE WHEN doc_id % 5 <> 0 THEN source WHEN doc_id % 10 <> 0 THEN 'Org ' || source ELSE "
    "'Unknown' END AS company, "
    f"CASE WHEN doc_id % 4 = 0 THEN {_ADDRESS} WHEN doc_id % 4 = 2 THEN 'Austin, US' ELSE "
    "'Unknown' END AS location, "
    "CASE WHEN doc_id % 4 = 0 THEN '{\"addressLocality\":\"' || " + _PLACE +
    " || '\",\"addressRegion\":\"Reg\"' || CASE WHEN doc_id % 8 = 0 THEN "
    "',\"addressCountry\":\"US\"' ELSE '' END || '}' WHEN doc_id % 4 = 2 THEN 'Austin, US' "
    "ELSE '' END AS raw_location, "
    "CASE WHEN doc_id % 4 = 0 THEN 'job_posting_location' WHEN doc_id % 4 = 2 THEN "
    "'company_location_if_only_available' ELSE 'unknown' END AS location_source, "
    "CASE WHEN doc_id % 4 = 1 THEN '{\"value\":' || doc_id || ',\"period\":\"year\"}' ELSE "
    f"'Unknown' END AS salary, {_BODY} AS description, "
    "CASE WHEN doc_id % 2 = 0 THEN 'https://x.example/' || doc_id ELSE '' END AS apply_link "
    f"FROM documents WHERE {_VALID} AND {_TITLED})")


def _mapped_query(name: str, columns: list[str]) -> None:
    sql = S.with_(MAPPED, select=f"SELECT line_no, {', '.join(columns)} FROM mapped")

    @query(name, sql)
    def run(spark, sf):
        return _mapped(spark, sf).select("line_no", *columns)


_mapped_query("map_job_id", ["job_id"])
_mapped_query("map_title", ["title"])
_mapped_query("map_company", ["company"])
_mapped_query("map_location", ["location", "raw_location", "location_source"])
_mapped_query("map_salary", ["salary"])
_mapped_query("map_apply_link", ["apply_link"])


@query("map_description", S.with_(MAPPED, select=(
    "SELECT line_no, md5(rtrim(substr(description, 1, 3000))) AS description_md5 FROM mapped")))
def map_description(spark, sf):
    # the stored description is at most 3,000 characters
    return _mapped(spark, sf, whole=False).select(
        "line_no", F.md5("description").alias("description_md5"))


@query("map_record", S.with_(MAPPED, select=(
    "SELECT * EXCLUDE (description), md5(description) AS description_md5 FROM mapped")))
def map_record(spark, sf):
    return _mapped(spark, sf).withColumn("description_md5", F.md5("description")) \
        .drop("description")


@query("snapshot_limit", S.with_(MAPPED, select=(
    "SELECT line_no, job_id FROM mapped QUALIFY row_number() OVER (ORDER BY line_no) <= 50000")))
def snapshot_limit(spark, sf):
    # the snapshot holds the first 50,000 valid records
    return M.snapshot(_mapped(spark, sf), V.SNAPSHOT_MAX_RECORDS).select("line_no", "job_id")


@query("snapshot_counts", S.with_(MAPPED, select=(
    "SELECT CASE WHEN count(*) >= 50000 THEN max(line_no) ELSE (SELECT count(*) FROM "
    "documents) END AS records_scanned, count(*) AS valid_records FROM (SELECT line_no FROM "
    "mapped ORDER BY line_no LIMIT 50000)")))
def snapshot_counts(spark, sf):
    return M.snapshot_counts(X.raw_records(spark, sf), M.snapshot(_mapped(spark, sf), V.SNAPSHOT_MAX_RECORDS))


_HAS = {  # key → which documents have it
    "idInSource": "doc_id % 4 <> 0", "_id": "TRUE", "_id.$oid": "doc_id % 8 <> 0",
    "position": "doc_id % 3 = 1", "position.name": "doc_id % 3 = 1 AND doc_id % 29 <> 0",
    "name": "doc_id % 3 = 2 AND doc_id % 29 <> 0", "text": "doc_id % 3 = 0",
    "html": "doc_id % 3 = 2", "salary": "doc_id % 4 = 1", "orgCompany": "TRUE",
    "orgCompany.name": "doc_id % 5 <> 0", "orgAddress": "doc_id % 4 = 2",
    "orgAddress.city": "doc_id % 4 = 2", "orgAddress.state": "doc_id % 4 = 2",
    "orgAddress.country": "doc_id % 4 = 2", "url": "doc_id % 2 = 0", "json": "TRUE",
    "json.schemaOrg": "TRUE", "json.schemaOrg.title": "doc_id % 3 = 0 AND doc_id % 29 <> 0",
    "json.schemaOrg.description": "doc_id % 3 = 1",
    "json.schemaOrg.hiringOrganization": "doc_id % 10 <> 0",
    "json.schemaOrg.hiringOrganization.name": "doc_id % 10 <> 0",
    "json.schemaOrg.jobLocation": "TRUE", "json.schemaOrg.jobLocation.address": "doc_id % 4 = 0",
    "json.schemaOrg.baseSalary": "doc_id % 4 = 1",
    "json.schemaOrg.baseSalary.value": "doc_id % 4 = 1",
    "json.schemaOrg.baseSalary.period": "doc_id % 4 = 1",
    "tags": "TRUE", "tags.tag": "TRUE", "tags.inner": "TRUE",
}
_KEYS = " UNION ALL ".join(
    f"SELECT {S.q(k)} AS key, count(*) AS records FROM documents WHERE {_VALID} AND ({c})"
    for k, c in _HAS.items())


@query("json_key_profile", f"SELECT * FROM ({_KEYS}) WHERE records > 0")
def json_key_profile(spark, sf):
    return M.key_profile(readers.json_objects(X.raw_records(spark, sf)))


def _label_sql() -> str:
    rows = []
    for label, names in V.CANDIDATE_FIELD_NAMES.items():
        rows.append(
            f"SELECT {S.q(label)} AS label, coalesce((SELECT string_agg(key, ', ' ORDER BY key) "
            f"FROM keys WHERE records > 0 AND {S.inn(chr(39).join(['lower(string_split(key, ', '.', ')[-1])']), names)}), "
            "'no obvious match found') AS matches")
    return " UNION ALL ".join(rows)


@query("json_candidate_fields", S.with_(f"keys AS ({_KEYS})", select=_label_sql()))
def json_candidate_fields(spark, sf):
    return M.candidate_fields(M.key_profile(readers.json_objects(X.raw_records(spark, sf))))


@query("json_preview", "SELECT event_id + 1 AS line_no, 0 AS position, 'k' AS key, "
       "json_extract_string(props, '$.k') AS preview FROM events")
def json_preview(spark, sf):
    lines = X.table(spark, sf, "events").select((F.col("event_id") + 1).alias("line_no"),
                                                F.col("props").alias("value"))
    return M.previews(lines)


@query("json_preview_text", "SELECT doc_id, CASE WHEN length(text) > 120 THEN "
       "substr(replace(text, chr(10), ' '), 1, 117) || '...' ELSE replace(text, chr(10), ' ') "
       "END AS preview FROM documents")
def json_preview_text(spark, sf):
    return X.documents(spark, sf).select("doc_id", R.json_preview(F.col("text")).alias("preview"))


# --- cleaning and de-duplication -----------------------------------------------------------

def _document_batch(spark, sf) -> DataFrame:
    """Postings whose description is the bare text, so that copies have equal keys."""
    return X.documents(spark, sf).select(
        F.col("doc_id").alias("row_index"), F.col("doc_id").cast("string").alias("job_id"),
        F.lit("  Data   Analyst ").alias("title"), F.lit("ACME").alias("company"),
        F.lit("Austin TX").alias("location"), F.lit("$1").alias("salary"),
        F.col("text").alias("description"), F.lit("").alias("apply_link"))


KEYED = ("keyed AS (SELECT doc_id AS row_index, text, sha256(lower('Data Analyst|ACME|Austin "
         f"TX|' || {S.ws('text')})) AS dedupe_key FROM documents)")
FIRSTS = ("firsts AS (SELECT * FROM keyed QUALIFY row_number() OVER (PARTITION BY dedupe_key "
          "ORDER BY row_index) = 1)")


@query("clean_ws", f"SELECT doc_id, md5({S.ws('text')}) AS text_md5, length({S.ws('text')}) AS "
       "n FROM documents")
def clean_ws(spark, sf):
    df = X.documents(spark, sf).select("doc_id", T.clean_ws(F.col("text")).alias("t"))
    return df.select("doc_id", F.md5("t").alias("text_md5"), F.length("t").cast("bigint").alias("n"))


@query("clean_batch", S.with_(KEYED, select=(
    "SELECT row_index, CAST(row_index AS VARCHAR) AS job_id, 'Data Analyst' AS title, 'ACME' AS "
    "company, 'Austin TX' AS location, 'Austin TX' AS raw_location, 'raw_location_field' AS "
    f"location_source, '$1' AS salary, md5({S.ws('text')}) AS description_md5, '' AS apply_link, "
    "dedupe_key FROM keyed")))
def clean_batch(spark, sf):
    return I.clean_batch(_document_batch(spark, sf)) \
        .withColumn("description_md5", F.md5("description")).drop("description")


@query("dedupe_key", S.with_(KEYED, select="SELECT row_index, dedupe_key FROM keyed"))
def dedupe_key(spark, sf):
    return _document_batch(spark, sf).select(
        "row_index", I.dedupe_key(*[F.col(c) for c in V.KEY_FIELDS]).alias("dedupe_key"))


@query("dedupe_first", S.with_(KEYED, FIRSTS, select="SELECT row_index, dedupe_key FROM firsts"))
def dedupe_first(spark, sf):
    return I.dedupe_first(I.clean_batch(_document_batch(spark, sf))) \
        .select("row_index", "dedupe_key")


@query("ingest_summary", S.with_(KEYED, FIRSTS, select=(
    "SELECT count(*) AS raw_rows, count(*) AS ingested_rows, count(*) - (SELECT count(*) FROM "
    "firsts) AS duplicate_rows_removed, (SELECT count(*) FROM firsts) AS final_cleaned_rows "
    "FROM keyed")))
def ingest_summary(spark, sf):
    return I.ingest_summary(I.clean_batch(_document_batch(spark, sf)))


@query("stream_batch_log", S.with_(KEYED, FIRSTS, select=(
    "SELECT b.batch_id, b.n AS incoming_records, coalesce(k.n, 0) AS kept_records, b.n - "
    "coalesce(k.n, 0) AS duplicate_records, CAST(sum(coalesce(k.n, 0)) OVER (ORDER BY "
    "b.batch_id) AS BIGINT) AS cumulative_unique_records FROM (SELECT CAST(floor(row_index / "
    "500) + 1 AS BIGINT) AS batch_id, count(*) AS n FROM keyed GROUP BY 1) b LEFT JOIN (SELECT "
    "CAST(floor(row_index / 500) + 1 AS BIGINT) AS batch_id, count(*) AS n FROM firsts GROUP BY "
    "1) k USING (batch_id)")))
def stream_batch_log(spark, sf):
    return I.stream_batch_log(I.clean_batch(_document_batch(spark, sf)))


@query("anti_seen", S.with_(KEYED, select=(
    "SELECT row_index FROM keyed WHERE doc_parity = 1 AND dedupe_key NOT IN (SELECT dedupe_key "
    "FROM keyed WHERE doc_parity = 0)").replace("doc_parity", "(row_index // 500) % 2")))
def anti_seen(spark, sf):
    cleaned = I.clean_batch(_document_batch(spark, sf))
    late = F.floor(F.col("row_index") / 500) % 2 == 1
    return I.anti_seen(cleaned.where(late), cleaned.where(~late)).select("row_index")


@query("union_batches", "SELECT doc_id AS row_index, md5(text) AS text_md5 FROM documents")
def union_batches(spark, sf):
    batch = readers.replay_batches(_document_batch(spark, sf))
    odd = batch.where(F.col("batch_id") % 2 == 1)
    even = batch.where(F.col("batch_id") % 2 == 0).drop("apply_link")
    return I.union_batches(odd, even).select("row_index", F.md5("description").alias("text_md5"))


@query("limit_head", "SELECT doc_id FROM documents ORDER BY doc_id LIMIT 20")
def limit_head(spark, sf):
    return head_in_order(X.documents(spark, sf).select("doc_id"), "doc_id", 20)


# --- load-time columns ------------------------------------------------------------------------

@query("location_source", S.with_(*S.JOB_CTES, select=(
    "SELECT row_index, location_source FROM jobs")))
def location_source(spark, sf):
    return X.jobs(spark, sf).select("row_index", L.location_source(
        F.col("location_source"), F.col("location")).alias("location_source"))


@query("location_confidence", S.with_(*S.SIGNAL_CTES, select=(
    "SELECT row_index, location_confidence FROM sig")))
def location_confidence(spark, sf):
    source = L.location_source(F.col("location_source"), F.col("location"))
    return X.jobs(spark, sf).select("row_index", L.location_confidence(
        source, F.col("location")).alias("location_confidence"))


@query("analytics_location", S.with_(S.JOBS0, select=(
    f"SELECT row_index, {S.analytics_location('location')} AS place FROM jobs0")))
def analytics_location(spark, sf):
    return X.jobs(spark, sf).select("row_index", L.analytics_location(
        F.col("location")).alias("place"))


@query("safe_numeric", "SELECT doc_id, TRY_CAST(v AS DOUBLE) AS n FROM (SELECT doc_id, "
       + X.case("doc_id", X.EMPLOYEES) + " AS v FROM documents)")
def safe_numeric(spark, sf):
    return X.jobs(spark, sf).select(F.col("row_index").alias("doc_id"), T.safe_number(
        F.col("employee_count")).alias("n"))


_EMBED = f"array_to_string(list_filter([{', '.join(S.ws(c) for c in V.EMBEDDING_TEXT_FIELDS)}], lambda x: x <> ''), chr(10))"


@query("embedding_text", S.with_(S.JOBS0, select=(
    f"SELECT row_index, md5({_EMBED}) AS text_md5 FROM jobs0")))
def embedding_text(spark, sf):
    return I.embedding_text(X.jobs(spark, sf)).select(
        "row_index", F.md5("embedding_text").alias("text_md5"))


@query("metadata_text", S.with_(*S.JOB_CTES, select=(
    "SELECT row_index, md5(array_to_string(list_filter([title, company, location, raw_location, "
    "salary_text, description, employment_type], lambda x: x <> ''), ' ')) AS text_md5 FROM jobs")))
def metadata_text(spark, sf):
    df = readers.load_jobs(X.jobs(spark, sf))
    return df.select("row_index", F.md5(I.metadata_text(df)).alias("text_md5"))


# --- sinks ---------------------------------------------------------------------------------------

@query("sink_jobs", S.with_(KEYED, FIRSTS, select=(
    f"SELECT row_index, md5({S.ws('text')}) AS description_md5, dedupe_key FROM firsts")))
def sink_jobs(spark, sf):
    cleaned = I.dedupe_first(I.clean_batch(_document_batch(spark, sf)))
    path = writers.write_jobs(cleaned, scratch_path(spark, "cleaned"))
    return spark.read.parquet(path).select(
        "row_index", F.md5("description").alias("description_md5"), "dedupe_key")


def _ordered(spark, sf) -> tuple[str, DataFrame]:
    """The postings as one table in their order, and the table."""
    path = scratch_path(spark, "incoming")
    rows = _document_batch(spark, sf)
    # small row groups: a batch is read by many tasks, and no group twice
    rows.repartitionByRange("row_index").sortWithinPartitions("row_index") \
        .write.option("parquet.block.size", 4 << 20).parquet(path)
    return path, rows


def _run_stream(spark, sf):
    """The stored postings and the log of a stream of 500-row batches, a backlog of them at a time."""
    path, rows = _ordered(spark, sf)
    stream = paced_stream(spark, path, rows.schema, V.STREAM_BATCH_ROWS * SI.BACKLOG, position="_position")
    out, log = scratch_path(spark, "streamed"), scratch_path(spark, "log")
    run_to_end(SI.stream_log(stream, out, log, scratch_path(spark, "state"), trigger=PACED,
                             position="_position", batch_rows=V.STREAM_BATCH_ROWS))
    return out, log


@query("stream_dedupe", S.with_(KEYED, FIRSTS, select="SELECT row_index, dedupe_key FROM firsts"))
def stream_dedupe(spark, sf):
    out, _ = _run_stream(spark, sf)
    return spark.read.parquet(out).select("row_index", "dedupe_key")


@query("sink_stream", S.with_(KEYED, FIRSTS, select=(
    f"SELECT row_index, dedupe_key, md5({S.ws('text')}) AS description_md5 FROM firsts")))
def sink_stream(spark, sf):
    """Append sink with keyed state; batches of 700 rows, a backlog of them at a time."""
    path, rows = _ordered(spark, sf)
    out = scratch_path(spark, "streamed")
    stream = paced_stream(spark, path, rows.schema, 700 * SI.BACKLOG, position="_position")
    run_to_end(SI.stream_dedupe(stream, out, scratch_path(spark, "state"), trigger=PACED,
                                position="_position", batch_rows=700))
    return spark.read.parquet(out).select("row_index", "dedupe_key",
                                          F.md5("description").alias("description_md5"))


_LOG_ROWS = ANSWERS["stream_batch_log"]


@query("stream_log", _LOG_ROWS)
def stream_log(spark, sf):
    return SI.read_stream_log(spark, _run_stream(spark, sf)[1])


@query("sink_stream_log", _LOG_ROWS)
def sink_stream_log(spark, sf):
    log = SI.read_stream_log(spark, _run_stream(spark, sf)[1])
    path = writers.write_table(log, scratch_path(spark, "log"), "csv")
    return writers.read_back(log, path, "csv")


@query("stream_map_ndjson", S.with_(MAPPED, select=(
    "SELECT CASE WHEN job_id LIKE 'row-%' THEN 'unnamed' ELSE job_id END AS job_id, title, company, "
    "location, location_source, md5(description) AS description_md5 FROM mapped")))
def stream_map_ndjson(spark, sf):
    stream = SI.map_ndjson(SI.read_stream(spark, _raw_files(spark, sf), "text"))
    out = scratch_path(spark, "mapped")
    stream.writeStream.format("parquet").option("path", out) \
        .option("checkpointLocation", scratch_path(spark, "state")) \
        .trigger(availableNow=True).start().awaitTermination()
    # records without an id are named after their line, which a stream does not know
    name = F.when(F.col("job_id").startswith("row-"), "unnamed").otherwise(F.col("job_id"))
    return spark.read.parquet(out).select(
        name.alias("job_id"), "title", "company", "location", "location_source",
        F.md5("description").alias("description_md5"))


@query("stream_limits", "SELECT CAST(doc_id // 100 + 1 AS BIGINT) AS batch_id, count(*) AS n_rows, "
       "min(doc_id) AS first_row FROM documents WHERE doc_id < 300 GROUP BY 1")
def stream_limits(spark, sf):
    """Batches of exactly 100 rows, three at most, a pause between them."""
    path, rows = _ordered(spark, sf)
    out = scratch_path(spark, "limited")

    def store(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch_id", F.lit(number + 1).cast("long")) \
            .write.mode("overwrite").parquet(f"{out}/{number}")

    stream = paced_stream(spark, path, rows.schema, 100, max_batches=3, pause_seconds=0.2)
    run_to_end(stream.writeStream.foreachBatch(store).trigger(**PACED)
               .option("checkpointLocation", scratch_path(spark, "state")).start())
    return spark.read.parquet(f"{out}/*").groupBy("batch_id").agg(
        F.count("*").alias("n_rows"), F.min("row_index").alias("first_row"))
