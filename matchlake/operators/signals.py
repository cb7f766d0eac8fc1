"""Profile-independent signal columns of postings.

Each posting field is normalised once; the texts the rules look at are joins of
those normal forms, and every text is searched for all its dictionaries in one pass.
The result is the natural table to store: scoring for any number of profiles starts
from it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchlake import vocab as V
from matchlake.functions.cache import once_per_jvm
from matchlake.functions import location as L
from matchlake.functions import requirements as Q
from matchlake.functions.text import (TermIndex, any_term, apart, apart_term, join_forms,
                                      matched_terms, pad, search_form, string_array)
from matchlake.sources.readers import ensure_columns, load_jobs

METADATA_TERMS = TermIndex(
    V.CONTRACT_TERMS, V.UNPAID_TERMS, V.DEFENSE_TERMS, V.DEFENSE_COMPANIES,
    V.SPONSORSHIP_POSITIVE_TERMS, V.SPONSORSHIP_NEGATIVE_TERMS, V.TINY_COMPANY_SIGNALS,
    V.LARGE_COMPANY_SIGNALS, *V.INFERRED_FAMILY_TERMS.values())
PLACE_TERMS = TermIndex(V.REMOTE_TERMS, V.HYBRID_TERMS, V.ONSITE_TERMS, V.BAY_AREA_TERMS)
TITLE_TERMS = TermIndex(V.JUNIOR_TERMS, V.MANAGER_TERMS, V.TRAINING_TITLE_TERMS,
                        V.GENERIC_SOFTWARE_TITLES, *V.ROLE_POSITIVE_TERMS.values())
CONTENT_TERMS = TermIndex(*V.ROLE_POSITIVE_TERMS.values(), *V.ROLE_NEGATIVE_TERMS.values())
PREFERENCE_TERMS = TermIndex(*V.COMPANY_PREFERENCE_BONUS.values(),
                             *V.COMPANY_PREFERENCE_PENALTY.values())
COMPANY_TERMS = TermIndex(V.DEFENSE_COMPANIES)
ALL_TERMS = TermIndex(*(i.terms for i in (METADATA_TERMS, PLACE_TERMS, TITLE_TERMS, CONTENT_TERMS,
                                          PREFERENCE_TERMS, COMPANY_TERMS)))
# a term that begins before the description ends within so many characters of it
_TERM_CHARS = max(len(apart_term(t)) for t in ALL_TERMS.terms) + 2

CONSTRAINT_COLUMNS = (
    "required_years_min", "years_requirement_text", "employment_type_inferred",
    "is_contract_or_temp", "is_unpaid_or_commission", "contract_temp_text",
    "unpaid_commission_text", "is_senior_staff_principal", "is_junior_entry_level",
    "is_manager_director", "is_defense_military_clearance", "defense_match_text",
    "company_size_inferred", "company_size_confidence", "company_size_match_text",
    "is_tiny_startup", "is_small_company", "is_medium_company", "is_large_company",
    "is_enterprise_company", "has_visa_sponsorship_signal", "has_no_sponsorship_signal",
    "raw_location", "location_source", "location_confidence", "is_us_location",
    "is_remote", "is_us_remote_location", "has_explicit_non_us_location_signal",
    "is_hybrid", "is_california", "is_bay_area", "is_california_or_bay_area",
    "is_non_us_location", "location_matched_phrases", "role_family_inferred",
    "constraint_matched_phrases")
# working columns that scoring reads again
SCORING_INPUTS = ("_n_title", "_n_desc", "_title_hits", "_content_hits", "_preference_hits",
                  "_senior", "_plain")


@once_per_jvm
def _forms() -> dict[str, Column]:
    fields = {"title": "_n_title", "company": "_n_company", "location": "_n_location",
              "raw_location": "_n_raw", "salary_text": "_n_salary",
              "description": "_n_desc", "employment_type": "_n_type"}
    return {n: search_form(F.col(c)) for c, n in fields.items()}


def normal_forms(df: DataFrame) -> DataFrame:
    """Add the normal form of every field as ``_n_…`` columns."""
    return df.withColumns(_forms())


@once_per_jvm
def _texts() -> dict[str, Column]:
    n = {k: F.col(k) for k in ("_n_title", "_n_company", "_n_location", "_n_raw",
                               "_n_salary", "_n_desc", "_n_type")}
    return {
        "_metadata": pad(join_forms(*n.values())),
        "_place_text": pad(join_forms(n["_n_title"], n["_n_location"], n["_n_raw"],
                                      n["_n_desc"])),
        "_country_text": pad(join_forms(n["_n_location"], n["_n_raw"])),
        "_only_text": pad(join_forms(n["_n_location"], n["_n_raw"], n["_n_salary"])),
        "_country": L.place(F.concat_ws(" ", "location", "raw_location")),
        "_only": L.place(F.concat_ws(" ", "location", "raw_location", "salary_text")),
    }


@once_per_jvm
def _apart() -> dict[str, Column]:
    return {f"_a_{n[3:]}": apart(F.col(n)) for n in _forms()}


@once_per_jvm
def _found() -> dict[str, Column]:
    """Terms of all dictionaries that any of the searched texts has; each text then tries only these.

    The texts leave out fields, so terms across the places where they join fields are found in
    these fields and the head of the description.
    """
    title, company, place, raw, salary, desc, kind = (F.col(f"_a_{n}") for n in (
        "title", "company", "location", "raw", "salary", "desc", "type"))
    head = F.left(desc, F.lit(_TERM_CHARS))
    return {"_found": ALL_TERMS.hits_apart(pad(join_forms(
        title, company, place, raw, salary, desc, kind, title, company, head, title, head,
        title, place, raw, head)))}


@once_per_jvm
def _hits() -> dict[str, Column]:
    title, company, place, raw, salary, desc, kind = (F.col(f"_a_{n}") for n in (
        "title", "company", "location", "raw", "salary", "desc", "type"))

    def among(index: TermIndex, *fields: Column) -> Column:
        # a field by itself may be NULL
        text = join_forms(*fields) if len(fields) > 1 else fields[0]
        return index.hits_among(pad(text), F.col("_found"))

    return {
        "_hits": among(METADATA_TERMS, title, company, place, raw, salary, desc, kind),
        "_place_hits": among(PLACE_TERMS, title, place, raw, desc),
        "_only_hits": among(PLACE_TERMS, place, raw, salary),
        "_title_hits": among(TITLE_TERMS, title),
        "_content_hits": among(CONTENT_TERMS, title, desc),
        "_preference_hits": among(PREFERENCE_TERMS, title, company, desc),
        "_company_hits": among(COMPANY_TERMS, company),
        "_senior": Q.senior_title_terms(F.col("title")),
        "_years": Q.years_required(F.col("description")),
        "_plain": F.lower(F.concat_ws(" ", "title", "description")),
    }


def _working_columns(jobs: DataFrame) -> DataFrame:
    counts = [F.col(c) for c in V.EMPLOYEE_COUNT_FIELDS if c in jobs.columns]
    return normal_forms(jobs).withColumns(_texts()).withColumns(_apart()) \
        .withColumns(_found()) \
        .withColumns(_hits() | {"_count": Q.employee_count(counts)})


@once_per_jvm
def _lists() -> dict[str, Column]:
    hits = F.col("_hits")
    return {
        "_contract": matched_terms(hits, V.CONTRACT_TERMS),
        "_unpaid": matched_terms(hits, V.UNPAID_TERMS),
        "_junior": matched_terms(F.col("_title_hits"), V.JUNIOR_TERMS),
        "_manager": matched_terms(F.col("_title_hits"), V.MANAGER_TERMS),
        "_defense": Q.defense_matches(F.col("_company_hits"), hits),
        "_visa": matched_terms(hits, V.SPONSORSHIP_POSITIVE_TERMS),
        "_no_visa": matched_terms(hits, V.SPONSORSHIP_NEGATIVE_TERMS),
        "_size": Q.company_size(F.col("_count"), F.col("_metadata"), hits),
        "role_family_inferred": Q.role_family(hits),
    } | L.location_signals(
        F.col("_place_hits"), F.col("_only_hits"), F.col("_place_text"),
        F.col("_country_text"), F.col("_country"), F.col("_only"),
        F.col("location"), F.col("location_source"))


@once_per_jvm
def _flags() -> dict[str, Column]:
    size = F.lower(F.col("_size.size"))
    found = {name: F.size(name) > 0 for name in
             ("_contract", "_unpaid", "_senior", "_junior", "_manager", "_defense",
              "_visa", "_no_visa")}
    years_text = F.coalesce(F.col("_years.phrase"), F.lit("Unknown"))
    phrases = {
        "years_requirement": F.when(F.col("_years").isNull(), string_array([]))
        .otherwise(F.array(F.col("_years.phrase"))),
        "contract_or_temp": F.col("_contract"), "unpaid_or_commission": F.col("_unpaid"),
        "senior_staff_principal": F.col("_senior"), "junior_entry_level": F.col("_junior"),
        "manager_director": F.col("_manager"),
        "defense_military_clearance": F.col("_defense"),
        "visa_sponsorship": F.col("_visa"), "no_sponsorship": F.col("_no_visa"),
    }
    return {
        "required_years_min": F.col("_years.years"),
        "years_requirement_text": years_text,
        "employment_type_inferred": Q.employment_type(
            found["_unpaid"], found["_contract"], F.col("_metadata")),
        "is_contract_or_temp": found["_contract"],
        "is_unpaid_or_commission": found["_unpaid"],
        "contract_temp_text": F.array_join("_contract", ", "),
        "unpaid_commission_text": F.array_join("_unpaid", ", "),
        "is_senior_staff_principal": found["_senior"],
        "is_junior_entry_level": found["_junior"],
        "is_manager_director": found["_manager"],
        "is_defense_military_clearance": found["_defense"],
        "defense_match_text": F.array_join("_defense", ", "),
        "company_size_inferred": F.col("_size.size"),
        "company_size_confidence": F.col("_size.confidence"),
        "company_size_match_text": F.col("_size.match_text"),
        "is_tiny_startup": size == "tiny", "is_small_company": size == "small",
        "is_medium_company": size == "medium", "is_large_company": size == "large",
        "is_enterprise_company": size == "enterprise",
        "has_visa_sponsorship_signal": found["_visa"],
        "has_no_sponsorship_signal": found["_no_visa"],
        "is_california_or_bay_area": F.col("is_california") | F.col("is_bay_area"),
        "constraint_matched_phrases": F.create_map(
            *[x for k, v in phrases.items() for x in (F.lit(k), v)]),}


def job_signals(jobs: DataFrame) -> DataFrame:
    """Loaded postings plus the constraint columns and the scoring inputs."""
    jobs = ensure_columns(jobs, ("title", "company", "location", "description"))
    if "salary_number" not in jobs.columns:
        jobs = load_jobs(jobs)
    jobs = ensure_columns(jobs, ("employment_type",))
    w = _working_columns(jobs)
    w = w.withColumns(_lists()).withColumns(_flags())
    own = [c for c in jobs.columns if c not in CONSTRAINT_COLUMNS]
    return w.select(*own, *CONSTRAINT_COLUMNS, "is_explicit_remote_location", *SCORING_INPUTS)


def role_flags(df: DataFrame, normal_text: str, groups: dict[str, tuple[str, ...]],
               form) -> DataFrame:
    """One boolean per dictionary group, from one pass over the text."""
    index = TermIndex(*groups.values(), form=form)
    return df.withColumn("_group_hits", index.hits(F.col(normal_text))).withColumns(
        {name: any_term(F.col("_group_hits"), terms, form) for name, terms in groups.items()}
    ).drop("_group_hits")
