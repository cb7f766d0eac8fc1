"""Profiles: one row per person, and their pairing with postings."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import asdict, dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from matchlake import vocab as V
from matchlake.functions import location as L
from matchlake.functions.text import (TermIndex, any_term, dictionary_sql, location_form,
                                      norm_search, split_target_roles, sql_string,
                                      string_array)
from matchlake.operators.order import rank_all, scratch_path
from matchlake.operators.signals import job_signals

# profiles that travel to the tasks inside the plan; more are handled in blocks
PROFILES_PER_PASS = 64

PROFILE_SCHEMA = (
    "profile_id string, target_role string, skills array<string>, "
    "preferred_location string, minimum_salary int, dealbreakers array<string>, "
    "role_fit_strictness string, location_strictness string, seniority_preference string, "
    "max_required_years int, avoid_contract boolean, avoid_unpaid boolean, "
    "avoid_internship boolean, avoid_defense boolean, visa_sponsorship string, "
    "company_preference string, company_size_preference string, salary_strictness string")


@dataclass
class Profile:
    profile_id: str
    target_role: str = ""
    skills: list[str] = field(default_factory=list)
    preferred_location: str = ""
    minimum_salary: int = 0
    dealbreakers: list[str] = field(default_factory=list)
    role_fit_strictness: str = "Balanced"
    location_strictness: str = "Balanced"
    seniority_preference: str = V.NO_PREFERENCE
    max_required_years: int | None = None
    avoid_contract: bool = False
    avoid_unpaid: bool = False
    avoid_internship: bool = False
    avoid_defense: bool = False
    visa_sponsorship: str = V.NO_PREFERENCE
    company_preference: str = V.NO_PREFERENCE
    company_size_preference: str = V.NO_PREFERENCE
    salary_strictness: str = "Soft"


def profiles_frame(spark: SparkSession, profiles: Iterable[Profile]) -> DataFrame:
    names = [p.split()[0] for p in PROFILE_SCHEMA.split(", ")]
    rows = [tuple(asdict(p)[n] for n in names) for p in profiles]
    return spark.createDataFrame(rows, PROFILE_SCHEMA)


def target_role_family(role: Column) -> Column:
    """Family of a target role; platform roles first, then dictionary order."""
    hits = TermIndex(*V.ROLE_TARGET_TERMS.values()).hits(norm_search(role))
    family = F.when(any_term(hits, V.ROLE_TARGET_TERMS["mlops_infra"]), "mlops_infra")
    for name, terms in V.ROLE_TARGET_TERMS.items():
        family = family.when(any_term(hits, terms), name)
    return family.otherwise("general")


def seniority_flags(preference: Column) -> dict[str, Column]:
    return {"avoid_senior_roles": preference.isin(list(V.AVOIDS_SENIOR)),
            "avoid_junior_roles": preference.isin(list(V.AVOIDS_JUNIOR)),
            "avoid_manager_roles": preference.isin(list(V.AVOIDS_SENIOR))}


def internship_active(flag: Column, preference: Column) -> Column:
    return flag | preference.isin(list(V.AVOIDS_INTERNSHIP))


def _dictionary_of(column: str, table: dict[str, tuple[str, ...]]) -> Column:
    """(term, form) array that belongs to a column's value, empty for other values."""
    arms = " ".join(f"WHEN {column} = {sql_string(name)} THEN {dictionary_sql(sorted(terms))}"
                    for name, terms in table.items())
    return F.expr(f"CASE {arms} ELSE {dictionary_sql(())} END")


def prepare_profiles(profiles: DataFrame) -> DataFrame:
    """Profile columns plus what the rules derive from them, prefixed ``p_``."""
    c = {n: F.col(n) for n in profiles.columns}
    preference = location_form(c["preferred_location"])
    raw = F.transform(c["dealbreakers"], lambda d: F.lower(F.trim(d)))
    grouped = V.SENIOR_DEALBREAKERS + V.DEFENSE_DEALBREAKERS + V.YEARS_DEALBREAKERS
    roles = split_target_roles(c["target_role"])
    derived = {
        "roles": roles,
        "ml_role": F.exists(roles, lambda r: r.isin(list(V.ML_ROLE_HINTS))
                            | r.contains("machine learning")),
        "family": target_role_family(c["target_role"]),
        "place": preference,
        "wants_us": L.is_us_preference(c["preferred_location"]),
        "wants_remote": preference.contains("remote"),
        "wants_bay_area": preference.contains("bay area"),
        "wants_california": preference.contains("california")
        | F.concat(F.lit(" "), preference, F.lit(" ")).contains(" ca "),
        "ends_senior": F.arrays_overlap(raw, string_array(V.SENIOR_DEALBREAKERS)),
        "ends_defense": F.arrays_overlap(raw, string_array(V.DEFENSE_DEALBREAKERS)),
        "ends_years": F.arrays_overlap(raw, string_array(V.YEARS_DEALBREAKERS)),
        "ends_other": F.filter(raw, lambda d: ~d.isin(list(grouped))),
        "no_internship": internship_active(c["avoid_internship"], c["seniority_preference"]),
        "bonus_terms": _dictionary_of("company_preference", V.COMPANY_PREFERENCE_BONUS),
        "penalty_terms": _dictionary_of("company_preference", V.COMPANY_PREFERENCE_PENALTY),
    }
    out = profiles.select("profile_id", *[v.alias(f"p_{k}") for k, v in c.items()
                                          if k != "profile_id"],
                          *[v.alias(f"p_{k}") for k, v in derived.items()])
    any_place = F.col("p_wants_us") | F.col("p_wants_remote") | F.col("p_wants_bay_area") \
        | F.col("p_wants_california")
    reasons = F.array_compact(F.array(
        F.when(F.col("p_wants_us"), "US preference"),
        F.when(F.col("p_wants_remote"), "remote preference"),
        F.when(F.col("p_wants_bay_area"), "Bay Area preference"),
        F.when(F.col("p_wants_california"), "California preference"),
        F.when(~any_place, "text location preference")))
    return out.withColumns({
        "p_named_place": any_place,
        "p_place_reasons": F.array_join(reasons, " / "),
        "p_positive": _dictionary_of("p_family", V.ROLE_POSITIVE_TERMS),
        "p_negative": _dictionary_of("p_family", V.ROLE_NEGATIVE_TERMS)})


def _inline(prepared: DataFrame) -> Column:
    """Profiles as one constant array; the caller bounds their number."""
    texts = [r[0] for r in prepared.select(F.to_json(F.struct("*"))).collect()]
    array_type = f"array<{prepared.schema.simpleString()}>"
    return F.from_json(F.lit("[" + ",".join(texts) + "]"), array_type)


def _with_profiles(jobs: DataFrame, prepared: DataFrame) -> DataFrame:
    names = [F.col(f"_p.{c}").alias(c) for c in prepared.columns]
    return jobs.select("*", F.explode(_inline(prepared)).alias("_p")) \
        .select(*jobs.columns, *names)


def join_profiles(jobs: DataFrame, profiles: DataFrame,
                  per_pass: int = PROFILES_PER_PASS) -> DataFrame:
    """Every posting with every profile, for ranking without retrieval.

    Profiles are part of the plan, so postings are neither shuffled nor joined.  More
    profiles than ``per_pass`` are taken in blocks of that size.
    """
    prepared = prepare_profiles(profiles)
    if len(profiles.select("profile_id").take(per_pass + 1)) <= per_pass:
        return _with_profiles(jobs, prepared)
    numbered = rank_all(profiles, [], [F.col("profile_id")], "_no")
    blocks = (profiles.count() + per_pass - 1) // per_pass
    out = None
    for b in range(blocks):
        block = prepare_profiles(numbered.where(
            F.floor((F.col("_no") - 1) / per_pass) == b).drop("_no"))
        part = _with_profiles(jobs, block)
        out = part if out is None else out.unionByName(part)
    return out


def join_candidates(jobs: DataFrame, candidates: DataFrame) -> DataFrame:
    """Postings of the retrieved candidates with their similarity.

    Candidates without a posting are dropped; Spark broadcasts the candidates when
    their size allows and merges otherwise.
    """
    return jobs.join(candidates, "row_index")


def pair_candidates(jobs: DataFrame, candidates: DataFrame, profiles: DataFrame) -> DataFrame:
    """(posting, profile, similarity) rows for candidates (profile_id, row_index, …)."""
    return join_candidates(jobs, candidates).join(prepare_profiles(profiles), "profile_id")


def retrieved_pairs(jobs: DataFrame, candidates: DataFrame, profiles: DataFrame) -> DataFrame:
    """Pairs of candidates (profile_id, row_index, …) with the signals of their postings.

    Candidates are written once; rules run only on postings that somebody retrieved.
    """
    path = scratch_path(jobs.sparkSession, "candidates")
    candidates.write.parquet(path)
    candidates = jobs.sparkSession.read.schema(candidates.schema).parquet(path)
    wanted = jobs.join(candidates.select("row_index").distinct(), "row_index", "left_semi")
    return pair_candidates(job_signals(wanted), candidates, profiles)


def embedded_subset(jobs: DataFrame, index: DataFrame) -> DataFrame:
    """Postings listed in an embedding index; a repeated id repeats its posting."""
    ids = index.select(F.col("row_index").try_cast("bigint").alias("row_index")) \
        .where(F.col("row_index").isNotNull())
    return jobs.join(ids, "row_index")
