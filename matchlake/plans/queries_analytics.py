"""Queries over batch analytics and coverage."""

from __future__ import annotations

from pyspark.sql import functions as F

from matchlake import vocab as V
from matchlake.functions.text import plain_term
from matchlake.functions.vectors import round2
from matchlake.operators import analytics as A
from matchlake.operators.order import scratch_path, stored
from matchlake.operators.profiles import embedded_subset
from matchlake.plans import fixtures as X
from matchlake.plans import sql as S
from matchlake.plans.catalog import query
from matchlake.plans.queries_signals import coverage_ctes
from matchlake.sources import readers, writers

_TEXT = "lower(title || ' ' || description)"
_SKILLS = " UNION ALL ".join(
    f"SELECT {S.q(skill)} AS skill, count(*) FILTER ({S.any_term('t', aliases, plain_term)}) AS job_count "
    "FROM texts" for skill, aliases in V.ANALYTICS_SKILLS.items())
_TEXTS = f"texts AS MATERIALIZED (SELECT {_TEXT} AS t FROM jobs0)"


@query("skill_counts", S.with_(S.JOBS0, _TEXTS, select=(
    f"SELECT * FROM ({_SKILLS}) ORDER BY job_count DESC, skill LIMIT 15")))
def skill_counts(spark, sf):
    return A.skill_counts(X.jobs(spark, sf))


@query("skill_counts_all", S.with_(S.JOBS0, _TEXTS, select=_SKILLS))
def skill_counts_all(spark, sf):
    return A.skill_counts(X.jobs(spark, sf), None)


_ANNUAL = f"pay AS MATERIALIZED (SELECT CAST({S.annual('salary_text')} AS DOUBLE) AS a FROM jobs)"
_BANDS = ("SELECT b.band_order, b.band, count(p.band) AS job_count FROM (SELECT unnest([0, 1, 2, 3, 4, 5]) "
          f"AS band_order, unnest({S.lst(V.SALARY_BAND_ORDER)}) AS band) b LEFT JOIN ({{}}) p USING (band) "
          "GROUP BY ALL")


@query("salary_histogram", S.with_(*S.JOB_CTES, _ANNUAL, select=_BANDS.format(
    f"SELECT {S.band('a')} AS band FROM pay")))
def salary_histogram(spark, sf):
    return A.salary_histogram(readers.load_jobs(X.jobs(spark, sf)))


@query("join_band_dim", _BANDS.format(f"SELECT {S.band('o_totalprice / 2')} AS band FROM orders"))
def join_band_dim(spark, sf):
    from matchlake.functions.salary import salary_band
    bands = X.table(spark, sf, "orders").groupBy(salary_band(F.col("o_totalprice") / 2).alias("band"))
    return A.join_band_dim(bands.agg(F.count("*").alias("job_count")))


@query("salary_stats", S.with_(*S.JOB_CTES, _ANNUAL, select=(
    "SELECT count(a) AS known_salary_count, count(*) - count(a) AS unknown_salary_count, median(a) AS "
    "median_salary, round(avg(a), 4) AS mean_salary, min(a) AS min_salary, max(a) AS max_salary FROM pay")))
def salary_stats(spark, sf):
    return A.salary_stats(readers.load_jobs(X.jobs(spark, sf))) \
        .withColumn("mean_salary", F.round("mean_salary", 4))


@query("location_demand", S.with_(S.JOBS0, select=(
    f"SELECT {S.analytics_location('location')} AS location, count(*) AS job_count FROM jobs0 GROUP BY 1 "
    "ORDER BY job_count DESC, location LIMIT 15").replace("SELECT CASE", "SELECT CASE", 1)))
def location_demand(spark, sf):
    return A.location_demand(X.jobs(spark, sf))


@query("dataset_totals", S.with_(S.JOBS0, select=(
    "SELECT count(*) AS total_jobs, count(DISTINCT nullif(company, '')) AS unique_companies, count(DISTINCT "
    f"{S.analytics_location('location')}) AS unique_locations FROM jobs0")))
def dataset_totals(spark, sf):
    return A.dataset_totals(X.jobs(spark, sf))


# --- coverage --------------------------------------------------------------------------------

_INDEX = "SELECT vec_id AS row_index FROM embeddings UNION ALL SELECT vec_id FROM embeddings WHERE label = 0"


def _index(spark, sf):
    """Embedding index; the vectors of one label are listed twice."""
    v = X.table(spark, sf, "embeddings")
    ids = v.select(F.col("vec_id").alias("row_index"))
    return ids.unionByName(v.where(F.col("label") == 0).select(F.col("vec_id").alias("row_index")))


def _summary_sql(source: str, dataset: str) -> str:
    return " UNION ALL ".join(
        f"SELECT {S.q(dataset)} AS dataset, {S.q(m)} AS metric, count(*) FILTER (\"{m}\") AS count, count(*) AS "
        f"total_jobs, round_even(CASE WHEN count(*) = 0 THEN 0.0 ELSE count(*) FILTER (\"{m}\") / count(*) END "
        f"* 10000, 0) / 10000 AS share FROM {source}" for m in V.COVERAGE_METRICS)


_SUBSET = f"sub AS MATERIALIZED (SELECT cov.* FROM cov JOIN ({_INDEX}) i USING (row_index))"
_SUMMARY = f"{_summary_sql('cov', V.FULL_DATASET)} UNION ALL {_summary_sql('sub', V.SUBSET_DATASET)}"


def _summary(spark, sf, chars):
    # texts are read once; both summaries count the same narrow table
    flagged = stored(A.coverage_flags(X.jobs(spark, sf), chars).select(
        "row_index", *[f"`{m}`" for m in V.COVERAGE_METRICS]), "coverage")
    subset = embedded_subset(flagged, _index(spark, sf))
    return A.coverage_summary(flagged, V.FULL_DATASET).unionByName(
        A.coverage_summary(subset, V.SUBSET_DATASET))


@query("coverage_summary", S.with_(*coverage_ctes(None), _SUBSET, select=_SUMMARY))
def coverage_summary(spark, sf):
    return _summary(spark, sf, None)


@query("coverage_summary_scan", S.with_(*coverage_ctes(V.COVERAGE_SCAN_CHARS), _SUBSET, select=_SUMMARY))
def coverage_summary_scan(spark, sf):
    # the published coverage table is defined on the first 1,200 characters of a description
    return _summary(spark, sf, V.COVERAGE_SCAN_CHARS)


@query("join_embedded_subset", S.with_(S.JOBS0, select=(
    f"SELECT row_index, title FROM jobs0 JOIN ({_INDEX}) i USING (row_index)")))
def join_embedded_subset(spark, sf):
    return embedded_subset(X.jobs(spark, sf), _index(spark, sf)).select("row_index", "title")


@query("join_coverage", S.with_(*coverage_ctes(None), _SUBSET, f"summary AS ({_SUMMARY})", select=(
    "SELECT f.metric, f.count AS full_count, e.count AS embedded_count, CASE WHEN f.count = 0 THEN 0.0 ELSE "
    "e.count / f.count END AS coverage FROM summary f JOIN summary e USING (metric) WHERE f.dataset = "
    f"{S.q(V.FULL_DATASET)} AND e.dataset = {S.q(V.SUBSET_DATASET)} AND {S.inn('metric', V.COMPARISON_METRICS)}")))
def join_coverage(spark, sf):
    return A.join_coverage(_summary(spark, sf, None))


_GROUPED = " UNION ALL ".join(
    f"SELECT {S.q(g)} AS role_group, title FROM cov WHERE \"{g}\"" for g in V.COVERAGE_GROUPS)


@query("top_titles_by_group", S.with_(
    *coverage_ctes(None), f"grouped AS MATERIALIZED ({_GROUPED})",
    "counts AS (SELECT role_group, title, count(*) AS job_count FROM grouped GROUP BY ALL)",
    "best AS (SELECT *, row_number() OVER (PARTITION BY role_group ORDER BY job_count DESC, title) AS rank FROM "
    "counts)", select=(
        f"SELECT g.role_group, coalesce(m.matches, 0) AS matches, b.title, b.job_count, CAST(b.rank AS INTEGER) AS "
        f"rank FROM (SELECT unnest({S.lst(V.COVERAGE_GROUPS)}) AS role_group) g LEFT JOIN (SELECT role_group, "
        "count(*) AS matches FROM grouped GROUP BY 1) m USING (role_group) LEFT JOIN best b ON b.role_group = "
        "g.role_group AND b.rank <= 20")))
def top_titles_by_group(spark, sf):
    return A.top_titles_by_group(A.coverage_flags(X.jobs(spark, sf), None))


@query("sink_coverage", S.with_(*coverage_ctes(None), _SUBSET, select=_SUMMARY))
def sink_coverage(spark, sf):
    out = _summary(spark, sf, None)
    return writers.read_back(out, writers.write_table(out, scratch_path(spark, "coverage"), "csv"), "csv")


@query("sink_analytics_export", S.with_(*S.JOB_CTES, _TEXTS.replace("jobs0", "jobs"), _ANNUAL, select=(
    f"SELECT 'skills' AS report, skill AS name, job_count FROM (SELECT * FROM ({_SKILLS}) ORDER BY job_count "
    "DESC, skill LIMIT 15) UNION ALL SELECT 'bands', band, job_count FROM ("
    + _BANDS.format(f"SELECT {S.band('a')} AS band FROM pay")
    + ") UNION ALL SELECT 'locations', location, job_count FROM (SELECT "
    f"{S.analytics_location('location')} AS location, count(*) AS job_count FROM jobs GROUP BY 1 ORDER BY "
    "job_count DESC, location LIMIT 15)")))
def sink_analytics_export(spark, sf):
    jobs = readers.load_jobs(X.jobs(spark, sf))
    reports = {"skills": A.skill_counts(jobs), "bands": A.salary_histogram(jobs),
               "locations": A.location_demand(jobs)}
    paths = writers.write_reports(reports, scratch_path(spark, "analytics"))
    names = {"skills": "skill", "bands": "band", "locations": "location"}
    parts = [writers.read_back(df, paths[k], "csv").select(
        F.lit(k).alias("report"), F.col(names[k]).alias("name"), "job_count")
        for k, df in reports.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("math", "SELECT o_orderkey, round(log2(o_totalprice), 6) AS log2, round(pow(2.0, o_orderkey % 5), 6) AS "
       "power, least(35, 5 * (o_orderkey % 11)) AS capped, greatest(-60, -10 * (o_orderkey % 11)) AS floored, "
       "round_even(o_totalprice / 7 * 100, 0) / 100 AS rounded FROM orders")
def math(spark, sf):
    n = F.col("o_orderkey")
    return X.table(spark, sf, "orders").select(
        "o_orderkey", F.round(F.log2("o_totalprice"), 6).alias("log2"),
        F.round(F.pow(F.lit(2.0), n % 5), 6).alias("power"),
        F.least(F.lit(35).cast("bigint"), 5 * (n % 11)).alias("capped"),
        F.greatest(F.lit(-60).cast("bigint"), -10 * (n % 11)).alias("floored"),
        round2(F.col("o_totalprice") / 7).alias("rounded"))
