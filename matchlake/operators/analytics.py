"""Aggregates over all postings: skills, salaries, locations and coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchlake import vocab as V
from matchlake.functions.location import analytics_location
from matchlake.functions.salary import salary_annual, salary_band
from matchlake.functions.text import (TermIndex, any_term, contains_one, coverage_form,
                                      coverage_term, join_forms, pad_or_blank, plain_term, strip,
                                      text_or_empty)
from matchlake.operators.order import scratch_path, top_k, values_at
from matchlake.operators.signals import role_flags


# --- batch analytics ------------------------------------------------------------------

def skill_counts(jobs: DataFrame, limit: int | None = 15) -> DataFrame:
    """(skill, job_count): postings that mention each skill, most first.

    One pass finds all aliases; only the 29 conditional counts leave a task.
    """
    text = F.lower(F.concat(text_or_empty(F.col("title")), F.lit(" "),
                            text_or_empty(F.col("description"))))
    index = TermIndex(*V.ANALYTICS_SKILLS.values(), form=plain_term)
    hits = jobs.select(index.hits(text).alias("_hits"))
    counts = hits.agg(*[F.count_if(any_term(F.col("_hits"), aliases, plain_term)).alias(skill)
                        for skill, aliases in V.ANALYTICS_SKILLS.items()])
    rows = counts.select(F.explode(F.array(*[F.struct(
        F.lit(s).alias("skill"), F.col(f"`{s}`").alias("job_count"))
        for s in V.ANALYTICS_SKILLS])).alias("r")).select("r.*")
    return rows.orderBy(F.desc("job_count"), "skill").limit(limit) if limit else rows


def _salary_column(jobs: DataFrame) -> Column:
    return F.col("salary_text" if "salary_text" in jobs.columns else "salary")


def band_dimension(df: DataFrame) -> DataFrame:
    return df.sparkSession.createDataFrame(
        [(i, b) for i, b in enumerate(V.SALARY_BAND_ORDER)], "band_order int, band string")


def join_band_dim(counts: DataFrame) -> DataFrame:
    """All six bands in order, 0 where none was counted."""
    return band_dimension(counts).join(counts, "band", "left").select(
        "band_order", "band", F.coalesce("job_count", F.lit(0)).alias("job_count"))


def salary_histogram(jobs: DataFrame) -> DataFrame:
    bands = jobs.select(salary_annual(_salary_column(jobs)).alias("_annual")) \
        .select(salary_band(F.col("_annual")).alias("band"))
    return join_band_dim(bands.groupBy("band").agg(F.count(F.lit(1)).alias("job_count")))


def salary_stats(jobs: DataFrame) -> DataFrame:
    """Known and unknown counts and the statistics of known annual salaries.

    The exact median comes from counts by value and the partitions around the middle.  Salaries
    are read once and written as one narrow column.
    """
    annual, path = jobs.select(salary_annual(_salary_column(jobs)).alias("a")), \
        scratch_path(jobs.sparkSession, "salaries")
    annual.write.parquet(path)
    annual = jobs.sparkSession.read.schema(annual.schema).parquet(path)
    middle = values_at(annual.where("a IS NOT NULL"), "a", lambda n: ((n - 1) // 2, n // 2))
    return annual.agg(
        F.count("a").alias("known_salary_count"),
        F.count_if(F.col("a").isNull()).alias("unknown_salary_count"),
        F.lit(sum(map(float, middle)) / 2 if middle else None).cast("double").alias("median_salary"),
        F.avg("a").alias("mean_salary"), F.min("a").alias("min_salary"), F.max("a").alias("max_salary"))


def location_demand(jobs: DataFrame, limit: int = 15) -> DataFrame:
    """Most frequent locations, ties by name."""
    return jobs.groupBy(analytics_location(F.col("location")).alias("location")) \
        .agg(F.count(F.lit(1)).alias("job_count")) \
        .orderBy(F.desc("job_count"), "location").limit(limit)


def dataset_totals(jobs: DataFrame, approximate: bool = False) -> DataFrame:
    """Postings, distinct non-empty companies, distinct cleaned locations."""
    company = F.nullif(F.col("company"), F.lit(""))
    place = analytics_location(F.col("location"))
    if approximate:
        return jobs.agg(F.count(F.lit(1)).alias("total_jobs"),
                        F.approx_count_distinct(company).alias("unique_companies"),
                        F.approx_count_distinct(place).alias("unique_locations"))
    # counting group keys keeps every distinct set spread over the tasks
    both = jobs.select(company.alias("company"), place.alias("place"))
    totals = both.groupBy("company", "place").agg(F.count(F.lit(1)).alias("n"))
    return totals.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total_jobs"),
                      F.count_distinct("company").alias("unique_companies"),
                      F.count_distinct("place").alias("unique_locations"))


# --- coverage -----------------------------------------------------------------------------

def search_text(description_chars: int | None = None) -> Column:
    """Title, company, location and all (or the start) of the description."""
    description = text_or_empty(F.col("description"))
    if description_chars is not None:
        description = F.substring(description, 1, description_chars)
    return F.concat_ws(" ", *[text_or_empty(F.col(c)) for c in ("title", "company", "location")],
                       description)


def has_known_salary(c: Column) -> Column:
    text = F.lower(strip(text_or_empty(c)))
    return ~text.isin("", "unknown") & text.rlike("[0-9]")


def coverage_us(location: Column) -> Column:
    return contains_one(location, (" us ", " usa ", " united states "))


def coverage_remote(search: Column) -> Column:
    return contains_one(search, (" remote ", " work from home "))


def coverage_california(location: Column, combined: Column) -> Column:
    return combined.contains(" california ") | location.contains(" ca us ") \
        | location.contains(" ca usa ") | contains_one(combined, V.COVERAGE_BAY_AREA_TERMS)


def coverage_flags(jobs: DataFrame, description_chars: int | None = None) -> DataFrame:
    """Postings with one boolean per coverage metric (named by the metric)."""
    # each text is normalised once; forms of joined texts are joins of forms
    df = jobs.withColumns({"_place_f": coverage_form(text_or_empty(F.col("location"))),
                           "_search_f": coverage_form(search_text(description_chars))}).withColumns({
        "_place": pad_or_blank(F.col("_place_f")), "_search_n": pad_or_blank(F.col("_search_f")),
        "_combined": pad_or_blank(join_forms(F.col("_place_f"), F.col("_search_f")))})
    df = df.withColumns({
        "total jobs": F.lit(True),
        "jobs with known salary": has_known_salary(F.col("salary")),
        "US jobs": coverage_us(F.col("_place")),
        "remote jobs": coverage_remote(F.col("_search_n")),
        "California / Bay Area jobs": coverage_california(F.col("_place"), F.col("_combined"))})
    return role_flags(df, "_search_n", V.COVERAGE_GROUPS, coverage_term) \
        .drop("_place_f", "_search_f", "_place", "_search_n", "_combined")


def coverage_summary(flagged: DataFrame, dataset: str) -> DataFrame:
    """(dataset, metric, count, total_jobs, share) of one dataset."""
    counts = flagged.agg(*[F.count_if(F.col(f"`{m}`")).alias(m) for m in V.COVERAGE_METRICS])
    rows = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(f"`{m}`").alias("count"))
                     for m in V.COVERAGE_METRICS])
    long = counts.select(F.col("`total jobs`").alias("total_jobs"), F.explode(rows).alias("r"))
    share = F.coalesce(F.try_divide(F.col("r.count").cast("double"), F.col("total_jobs")),
                       F.lit(0.0))
    return long.select(F.lit(dataset).alias("dataset"), "r.metric", "r.count", "total_jobs",
                       (F.rint(share * 10_000) / 10_000).alias("share"))


def join_coverage(summary: DataFrame) -> DataFrame:
    """Full dataset against the embedded subset for the compared metrics."""
    def side(dataset: str, name: str) -> Column:
        return F.max(F.when(F.col("dataset") == dataset, F.col("count"))).alias(name)

    both = summary.where(F.col("metric").isin(list(V.COMPARISON_METRICS))).groupBy("metric") \
        .agg(side(V.FULL_DATASET, "full_count"), side(V.SUBSET_DATASET, "embedded_count")) \
        .where(F.col("embedded_count").isNotNull())
    return both.withColumn("coverage", F.coalesce(
        F.try_divide(F.col("embedded_count").cast("double"), F.col("full_count")), F.lit(0.0)))


def top_titles_by_group(flagged: DataFrame, n: int = 20) -> DataFrame:
    """(role_group, matches, title, job_count): most frequent titles per group.

    A group without matches is listed once without a title.
    """
    names = F.array_compact(F.array(*[F.when(F.col(f"`{g}`"), F.lit(g))
                                      for g in V.COVERAGE_GROUPS]))
    counts = flagged.select(F.coalesce("title", F.lit("Unknown")).alias("title"),
                            F.explode(names).alias("role_group")) \
        .groupBy("role_group", "title").agg(F.count(F.lit(1)).alias("job_count"))
    totals = counts.groupBy("role_group").agg(F.sum("job_count").alias("matches"))
    best = top_k(counts, ["role_group"], [F.desc("job_count"), F.asc("title")], n)
    groups = flagged.sparkSession.createDataFrame([(g,) for g in V.COVERAGE_GROUPS],
                                                  "role_group string")
    return groups.join(totals, "role_group", "left").join(best, "role_group", "left") \
        .select("role_group", F.coalesce("matches", F.lit(0)).alias("matches"), "title",
                "job_count", "rank")
