"""Ranking of scored postings, the displayed selection and its exports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchlake import vocab as V
from matchlake.functions.text import strip, text_or_empty
from matchlake.functions.vectors import round2
from matchlake.operators.order import rank_all, top_k

JOB_KEY = ("title", "company", "location")
RANK_ORDER = ("passes_all_active_constraints", "final_score", "role_fit_score", "score",
              "embedding_similarity", "salary_number")
RERANK_ORDER = ("passes_all_active_constraints", "adjusted_final_score", "role_fit_score",
                "final_score")


def _order(columns: Sequence[str], *last: str) -> list[Column]:
    return [F.desc(c) for c in columns] + [F.asc(c) for c in ("title", *last)]


def rank_jobs(scored: DataFrame, k: int | None = None) -> DataFrame:
    """Rank postings per profile; all of them, or only the best ``k``."""
    order = _order(RANK_ORDER, "row_index")
    if k is None:
        return rank_all(scored, ["profile_id"], order)
    return top_k(scored, ["profile_id"], order, k)


# what later steps read of a ranked posting besides its rank; texts stay behind
RANKED_COLUMNS = tuple(dict.fromkeys((
    "profile_id", "row_index", *RANK_ORDER, *JOB_KEY, "location_strictness",
    "passes_location_filter", "role_family_inferred", "company_size_inferred",
    "employment_type_inferred", "matched_skills", "required_years_min", "is_non_us_location",
    "is_defense_military_clearance", "is_contract_or_temp")))


def rank_narrow(scored: DataFrame) -> DataFrame:
    """Full ranks of rows without texts, for feedback and the displayed selection."""
    return rank_jobs(scored.select(*RANKED_COLUMNS))


def rerank(adjusted: DataFrame, k: int | None = None) -> DataFrame:
    """Rank again by the feedback-adjusted score; ties keep the baseline order."""
    base = adjusted.withColumnRenamed("rank", "baseline_rank")
    order = _order(RERANK_ORDER, "baseline_rank")
    if k is None:
        return rank_all(base, ["profile_id"], order)
    return top_k(base, ["profile_id"], order, k)


def display_select(ranked: DataFrame, n: int = V.DISPLAY_ROWS) -> DataFrame:
    """The first ``n`` postings shown per profile.

    A Strict location preference removes failing places.  Postings that pass every
    active constraint are shown alone when there are any, so the first ``n`` of the
    passing and of all postings are enough to decide.
    """
    shown = ranked.where((F.col("location_strictness") != "Strict")
                         | F.col("passes_location_filter"))
    best = top_k(shown, ["profile_id", "passes_all_active_constraints"],
                 [F.asc("rank")], n, "_place")
    any_pass = best.groupBy("profile_id").agg(
        F.max("passes_all_active_constraints").alias("_any_pass"))
    # a profile without a passing posting only has failing ones to show
    return best.join(any_pass, "profile_id") \
        .where(F.col("passes_all_active_constraints") == F.col("_any_pass")) \
        .drop("_place", "_any_pass")


def precision_at_k(ranked: DataFrame, k: int = 10) -> DataFrame:
    """Share of the first ``k`` postings that pass all active constraints."""
    return ranked.where(F.col("rank") <= k).groupBy("profile_id").agg(
        F.avg(F.col("passes_all_active_constraints").cast("int")).alias("precision"))


def score_averages(baseline_top: DataFrame, adjusted_top: DataFrame) -> DataFrame:
    """Mean baseline and mean adjusted score of the displayed postings per profile."""
    before = baseline_top.groupBy("profile_id").agg(F.avg("final_score").alias("baseline_avg"))
    after = adjusted_top.groupBy("profile_id").agg(
        F.avg("adjusted_final_score").alias("adjusted_avg"))
    return before.join(after, "profile_id")


# --- exports ------------------------------------------------------------------------

def existing(df: DataFrame, columns: Sequence[str]) -> list[str]:
    return [c for c in columns if c in df.columns]


def user_export(jobs: DataFrame, keys: Sequence[str] = ("profile_id",)) -> DataFrame:
    """Download table: the export columns that exist, a link and a short explanation."""
    if "apply_url" not in jobs.columns:
        link = next((c for c in ("apply_link", "url", "link") if c in jobs.columns), None)
        jobs = jobs.withColumn("apply_url", F.col(link) if link else F.lit(""))
    if "match_explanation" not in jobs.columns:
        skills = strip(text_or_empty(F.col("matched_skills")))
        family = strip(text_or_empty(F.col("role_family_inferred")))
        parts = F.concat_ws(
            "; ",
            F.when(skills != "", F.concat(F.lit("Matched skills: "), skills)),
            F.when(~F.lower(family).isin("", "unknown"),
                   F.concat(F.lit("Role family: "), family)),
            F.when(F.col("passes_all_active_constraints"), "Active constraints: passed")
            .otherwise("Active constraints: did not pass"))
        jobs = jobs.withColumn("match_explanation", parts)
    return jobs.select(*existing(jobs, keys), *existing(jobs, V.USER_EXPORT_COLUMNS))


def debug_export(jobs: DataFrame, keys: Sequence[str] = ("profile_id",)) -> DataFrame:
    """The debug columns that exist."""
    return jobs.select(*existing(jobs, keys), *existing(jobs, V.DEBUG_COLUMNS))


def display_table(jobs: DataFrame, keys: Sequence[str] = ("profile_id",)) -> DataFrame:
    """Table shown to users: display names, 'Unknown' for missing values."""
    score = round2(F.coalesce(F.col("adjusted_final_score"), F.col("final_score")))
    jobs = jobs.withColumn("match_score", score)
    shown = []
    for column, title in V.DISPLAY_COLUMNS.items():
        if column not in jobs.columns:
            continue
        value = F.col(column)
        if column != "match_score":
            text = value.cast("string")
            missing = text.isNull() | F.lower(strip(text)).isin("", "nan", "none", "unknown")
            value = F.when(missing, "Unknown").otherwise(text)
        shown.append(value.alias(title))
    return jobs.select(*existing(jobs, keys), *shown)
