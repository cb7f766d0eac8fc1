"""Scores and filters of a posting for a profile.

All rules are column expressions over a frame of (posting signals, ``p_`` profile
columns).  A rule gives points and an array of reasons; reasons are joined at the end.
Reasons that list terms list them sorted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchlake import vocab as V
from matchlake.functions.cache import once_per_jvm
from matchlake.functions.text import (BLANKS, WORD_END, WORD_START, dictionary_sql,
                                      join_forms, let, location_form, matched_from,
                                      matched_terms, pad, string_array)
from matchlake.functions.vectors import round2

FEEDBACK_DEFAULTS = ("feedback_label", "feedback_adjustment_score",
                     "feedback_adjustment_reason", "adjusted_final_score")


def _c(name: str) -> Column:
    return F.col(name)


def _signed(points: Column) -> Column:
    return points.cast("string")


def _joined(terms: Column, limit: int | None = None) -> Column:
    return F.array_join(F.slice(terms, 1, limit) if limit else terms, ", ")


def result(*rules: tuple[Column, Column, Column]) -> Column:
    """Struct (points, reasons) of the rules whose condition holds, in order."""
    points = F.lit(0)
    for condition, value, _ in rules:
        points = points + F.when(condition, value).otherwise(0)
    reasons = F.array_compact(F.array(*[F.when(c, r) for c, _, r in rules]))
    return F.struct(points.cast("int").alias("points"), reasons.alias("reasons"))


def first_result(cases: list[tuple[Column, int, Column | str]]) -> Column:
    """Struct (points, reasons) of the first case that holds; no reason for ''."""
    chosen = F.when(F.lit(False), _outcome(0, ""))
    for condition, points, reason in cases:
        chosen = chosen.when(condition, _outcome(points, reason))
    return chosen.otherwise(_outcome(0, ""))


def _outcome(points: int, reason: Column | str) -> Column:
    text = reason if isinstance(reason, Column) else F.lit(reason)
    reasons = string_array([]) if isinstance(reason, str) and reason == "" else F.array(text)
    return F.struct(F.lit(points).alias("points"), reasons.alias("reasons"))


# --- what the rules look at ------------------------------------------------------------

@once_per_jvm
def _pair_texts() -> dict[str, Column]:
    return {
        "_title_text": pad(_c("_n_title")),
        "_content_text": pad(join_forms(_c("_n_title"), _c("_n_desc"))),
        "_breaker_text": F.concat(pad(_c("_n_title")), F.lit(" "), pad(_c("_n_desc")))}


@once_per_jvm
def _pair_terms() -> dict[str, Column]:
    title, roles = _c("_title_text"), _c("p_roles")
    defense = F.expr(dictionary_sql(sorted(V.DEFENSE_TERMS)))
    none = string_array([])
    return {
        "_role_titled": F.filter(roles, lambda r: F.contains(title, r)),
        "_role_related": F.filter(roles, lambda r: F.exists(
            F.filter(F.split(r, f"[{BLANKS}]+"), lambda w: (F.length(w) > 2)
                     & ~w.isin(list(V.GENERIC_ROLE_WORDS))),
            lambda w: F.contains(title, w))),
        # ``let``: a text used once would be joined again for every term
        "_ml_terms": F.when(_c("p_ml_role"), F.array_sort(F.transform(
            let(_c("_content_text"), lambda text: F.filter(
                string_array(V.ML_RELEVANCE_TERMS), lambda t: F.contains(text, t))),
            lambda t: F.trim(t)))).otherwise(none),
        "_fit_title": matched_from(_c("_title_hits"), _c("p_positive")),
        "_fit_found": matched_from(_c("_content_hits"), _c("p_positive")),
        "_fit_negative": matched_from(_c("_content_hits"), _c("p_negative")),
        "_training": matched_terms(_c("_title_hits"), V.TRAINING_TITLE_TERMS),
        "_generic": matched_terms(_c("_title_hits"), V.GENERIC_SOFTWARE_TITLES),
        "_skills": F.filter(_c("p_skills"), lambda s: F.contains(_c("_plain"), s)),
        "_location_check": location_pass(),
        "_defense_found": F.when(_c("p_ends_defense"), F.transform(
            let(_c("_breaker_text"), lambda text: F.filter(
                defense, lambda d: F.contains(text, d["form"]))),
            lambda d: d["term"])).otherwise(none),
        "_other_found": F.when(F.size("p_ends_other") > 0, let(_c("_breaker_text"), lambda text: F.filter(
            _c("p_ends_other"), lambda d: F.contains(text, d)))).otherwise(_c("p_ends_other")),
        "_bonus_found": matched_from(_c("_preference_hits"), _c("p_bonus_terms")),
        "_penalty_found": matched_from(_c("_preference_hits"), _c("p_penalty_terms"))}


def score_inputs(pairs: DataFrame) -> DataFrame:
    """Texts and term lists of a pair, as columns so that each is computed once."""
    return pairs.withColumns(_pair_texts()).withColumns(_pair_terms()) \
        .withColumn("_fit_content", F.array_except("_fit_found", "_fit_title"))


# --- role ------------------------------------------------------------------------------

@once_per_jvm
def target_role_score() -> Column:
    ml = _c("_ml_terms")
    bonus = F.least(F.lit(35), 5 * F.size(ml))
    given = F.size("p_roles") > 0
    titled, partial = F.size("_role_titled") > 0, F.size("_role_related") > 0
    head = "Target role relevance: "
    return result(
        (given & titled, F.lit(40), F.concat(
            F.lit(head + "+40 title match: "), _joined(_c("_role_titled")))),
        (given & ~titled & partial, F.lit(20), F.concat(
            F.lit(head + "+20 related title terms: "), _joined(_c("_role_related")))),
        (given & ~titled & ~partial, F.lit(0), F.lit(head + "+0 not directly found in title")),
        (F.size(ml) > 0, bonus, F.concat(
            F.lit(head + "+"), _signed(bonus), F.lit(" ML/applied science terms: "),
            _joined(ml, 6))),
        (_c("p_ml_role") & (F.size(ml) == 0) & ~titled, F.lit(-25),
         F.lit(head + "-25 no ML/applied science evidence found")))


@once_per_jvm
def role_fit_score() -> Column:
    family = _c("p_family")
    special = family.isin(list(V.SPECIALIST_FAMILIES))
    in_title, content = _c("_fit_title"), _c("_fit_content")
    negative, training, generic = _c("_fit_negative"), _c("_training"), _c("_generic")
    title_bonus = F.least(F.lit(50), 25 + 5 * F.size(in_title))
    content_bonus = F.least(F.lit(35), 7 * F.size(content))
    penalty = F.least(F.lit(60), 30 + 10 * (F.size(negative) - 1))
    titled = F.size(in_title) > 0
    scored = result(
        (titled, title_bonus, F.concat(F.lit("Role fit: +"), _signed(title_bonus), F.lit(" "),
                                       family, F.lit(" title terms: "), _joined(in_title, 5))),
        (F.size(content) > 0, content_bonus, F.concat(
            F.lit("Role fit: +"), _signed(content_bonus), F.lit(" "), family,
            F.lit(" content terms: "), _joined(content, 6))),
        (F.size(negative) > 0, -penalty, F.concat(
            F.lit("Role fit: -"), _signed(penalty), F.lit(" weak/unrelated terms: "),
            _joined(negative, 6))),
        (special & (F.size(training) > 0), F.lit(-120), F.concat(
            F.lit("Role fit: -120 course/training/evaluator title: "), _joined(training, 5))),
        (special & (F.size(generic) > 0) & ~titled, F.lit(-70), F.concat(
            F.lit("Role fit: -70 generic software title without target-role evidence: "),
            _joined(generic, 5))),
        (F.size("_fit_found") == 0, F.lit(-35),
         F.concat(F.lit("Role fit: -35 no clear "), family, F.lit(" evidence"))))
    return F.when(family == "general", _outcome(
        0, "Role fit: +0 no specialized role family detected")).otherwise(scored)


def role_fit_penalty(score: Column, strictness: Column) -> Column:
    tail = " role fit strictness penalty: "
    return first_result([
        ((strictness == "Balanced") & (score < 10), 20,
         f"-20{tail}weak match for target role"),
        ((strictness == "Strict") & (score < 0), 60, f"-60{tail}poor match for target role"),
        ((strictness == "Strict") & (score < 15), 40, f"-40{tail}weak match for target role")])


# --- skills, location, salary, dealbreakers -----------------------------------------------

def skill_score(matched: Column) -> Column:
    points = F.least(F.lit(40), 10 * F.size(matched))
    some = F.size(matched) > 0
    return result(
        (some, points, F.concat(F.lit("Matched skills: +"), _signed(points),
                                F.lit(" overlap: "), _joined(matched))),
        (~some & (F.size("p_skills") > 0), F.lit(0),
         F.lit("Matched skills: +0 no listed skills found in posting")))


@once_per_jvm
def location_pass() -> Column:
    """Struct (passed, reason) of the location preference."""
    strict = _c("p_location_strictness") == "Strict"
    non_us, us_remote = _c("is_non_us_location"), _c("is_us_remote_location")
    near = F.contains(location_form(F.concat_ws(" ", "raw_location", "location")),
                      _c("p_place"))
    matched = F.when(_c("p_named_place"),
                     (_c("p_wants_us") & _c("is_us_location"))
                     | (_c("p_wants_remote") & _c("is_remote"))
                     | (_c("p_wants_bay_area") & _c("is_bay_area"))
                     | (_c("p_wants_california") & _c("is_california"))).otherwise(near)
    why = _c("p_place_reasons")

    def outcome(passed: bool, *text) -> Column:
        return F.struct(F.lit(passed).alias("passed"), F.concat(
            *[t if isinstance(t, Column) else F.lit(t) for t in text]).alias("reason"))

    excluded = outcome(False, "FAIL: strict location filter excludes clear non-US location for ",
                       why, ".")
    allowed = outcome(True, "PASS: strict US preference allowed explicit US-remote location.")
    return (
        F.when(_c("p_preferred_location") == "", outcome(True, "No location preference entered."))
        .when(strict & _c("p_wants_us") & non_us & us_remote, allowed)
        .when(strict & _c("p_wants_us") & non_us, excluded)
        .when(matched, outcome(True, "PASS: matched ", why, "."))
        .when(strict & _c("p_wants_us") & us_remote, allowed)
        .when((_c("location_source") == "unknown") & ~non_us,
              outcome(True, "PASS: location unknown, not failed automatically."))
        .when(strict & non_us, excluded)
        .when(_c("p_location_strictness") == "Flexible",
              outcome(True, "PASS: Flexible location strictness allows broader exploration."))
        .otherwise(outcome(False, "FAIL: did not match ", why, ".")))


def location_score(check: Column) -> Column:
    """Points of the location preference, given the ``location_pass`` struct."""
    passed = check["passed"]

    def text(what: str) -> Column:
        return F.concat(F.lit(f"Location preference: {what}. "), check["reason"])

    strict = _c("p_location_strictness") == "Strict"
    return first_result([
        (_c("p_preferred_location") == "", 0, ""),
        (_c("p_wants_remote") & _c("is_remote"), 25, text("+25 remote match")),
        (_c("p_wants_bay_area") & _c("is_bay_area"), 25, text("+25 Bay Area match")),
        (_c("p_place").contains("california") & _c("is_california"), 20,
         text("+20 California match")),
        (_c("p_wants_us") & _c("is_us_location"), 15, text("+15 US match")),
        (passed & (_c("location_confidence") == "low"), 0,
         text("+0 low-confidence/unknown location")),
        (passed, 10, text("+10 location allowed")),
        (strict, -45, text("-45 strict location mismatch")),
        (F.lit(True), -20, text("-20 location mismatch"))])


@once_per_jvm
def salary_fit_score() -> Column:
    wanted = _c("p_minimum_salary")
    met = _c("salary_number") >= wanted
    return first_result([
        ((wanted > 0) & met, 15, "Salary fit: +15 appears to meet minimum"),
        (wanted > 0, 0, "Salary fit: +0 unknown or below minimum")])


@once_per_jvm
def dealbreaker_score() -> Column:
    senior, defense, other = _c("_senior"), _c("_defense_found"), _c("_other_found")
    text = F.lower("description")
    # fixed value: phrasings of five to nine years
    many_years = text.contains("years") & text.rlike(
        rf"(?=(?:[5-9]\+?[{BLANKS}]*|(?:five|six|seven)[{BLANKS}]+)years{WORD_END}){WORD_START}")
    penalty = 25 * F.size(other)
    head = "Dealbreaker penalty: -"
    return result(
        (_c("p_ends_senior") & (F.size(senior) > 0), F.lit(-60),
         F.concat(F.lit(head + "60 seniority in title: "), _joined(senior))),
        (F.size(defense) > 0, F.lit(-60),
         F.concat(F.lit(head + "60 defense/military terms: "), _joined(defense))),
        (_c("p_ends_years") & many_years, F.lit(-35),
         F.lit(head + "35 5+ years or more mentioned")),
        (F.size(other) > 0, -penalty,
         F.concat(F.lit(head), _signed(penalty), F.lit(" found: "), _joined(other))))


# --- advanced preferences ---------------------------------------------------------------------

@once_per_jvm
def seniority_score() -> Column:
    choice = _c("p_seniority_preference")
    senior, junior = _c("is_senior_staff_principal"), _c("is_junior_entry_level")
    above = senior | _c("is_manager_director")
    title = _c("_title_text")
    entry = junior | title.contains(" analyst ") | title.contains(" associate ") \
        | title.contains(" early career ") | F.lower("title").rlike(
            rf"{WORD_START}(?:ii?|1|2){WORD_END}")
    head = "Seniority preference: "

    def case(name: str, condition: Column, points: int, text: str):
        return (choice == name) & condition, points, f"{head}{points:+d} {text}"

    always = F.lit(True)
    return first_result([
        case(V.ENTRY_ONLY, above, -90, "excludes senior/manager roles"),
        case(V.ENTRY_ONLY, entry, 25, "entry-level/new grad signal"),
        case(V.ENTRY_ONLY, always, -15, "no clear entry-level signal"),
        case(V.JUNIOR_TO_MID, above, -70, "senior/manager role"),
        case(V.JUNIOR_TO_MID, entry, 15, "junior/mid-level signal"),
        case(V.JUNIOR_TO_MID, always, 5, "no seniority conflict"),
        case(V.MID_TO_SENIOR, junior, -80, "junior/entry-level role"),
        case(V.MID_TO_SENIOR, always, 5, "mid/senior-compatible role"),
        case(V.SENIOR_PREFERRED, senior, 25, "senior/staff/principal signal"),
        case(V.SENIOR_PREFERRED, junior, -45, "junior/entry-level role"),
        case(V.SENIOR_PREFERRED, always, -5, "no senior+ signal"),
        case(V.EXCLUDE_SENIOR, above, -120, "excluded senior/manager role"),
        case(V.EXCLUDE_JUNIOR, junior, -100, "excluded junior/entry-level role")])


@once_per_jvm
def company_size_score() -> Column:
    choice = _c("p_company_size_preference")
    tiny, small = _c("is_tiny_startup"), _c("is_small_company")
    medium = _c("is_medium_company")
    large = _c("is_large_company") | _c("is_enterprise_company")
    size = F.coalesce(F.nullif(_c("company_size_match_text"), F.lit("")),
                      _c("company_size_inferred"))

    def case(name: str, condition: Column, points: int, text: str, shown: bool = True):
        reason = f"Company size: {points:+d} {text}"
        return ((choice == name) & condition, points,
                F.concat(F.lit(reason + ": "), size) if shown else reason)

    return first_result([
        case(V.PREFER_SMALL, tiny | small, 12, "small-company signal"),
        case(V.PREFER_SMALL, large, -8, "larger-company signal", False),
        case(V.PREFER_MEDIUM, medium, 12, "medium-company signal"),
        case(V.PREFER_MEDIUM, tiny, -10, "tiny-startup signal", False),
        case(V.PREFER_LARGE, large, 18, "large/enterprise signal"),
        case(V.PREFER_LARGE, tiny | small, -15, "tiny/small signal"),
        case(V.EXCLUDE_TINY, tiny, -100, "excluded tiny startup"),
        case(V.LARGE_ONLY, large, 15, "large/enterprise signal"),
        case(V.LARGE_ONLY, tiny | small, -120, "not large-company compatible")])


@once_per_jvm
def advanced_score() -> Column:
    phrases = _c("constraint_matched_phrases")

    def found(kind: str) -> Column:
        return F.try_element_at(phrases, F.lit(kind))

    def listed(text: str, terms: Column, limit: int | None = None) -> Column:
        return F.concat(F.lit(f"Advanced filter: {text}: "), _joined(terms, limit))

    contract, unpaid = found("contract_or_temp"), found("unpaid_or_commission")
    defense = found("defense_military_clearance")
    visa, no_visa = found("visa_sponsorship"), found("no_sponsorship")
    years, limit = _c("required_years_min"), _c("p_max_required_years")
    needs_visa = _c("p_visa_sponsorship") == "Sponsorship required"
    likes_visa = _c("p_visa_sponsorship") == "Prefer sponsor-friendly"
    bonus, penalty = _c("_bonus_found"), _c("_penalty_found")
    wanted, salary = _c("p_minimum_salary"), _c("salary_number")
    strictness = _c("p_salary_strictness")
    below = (wanted > 0) & (salary > 0) & (salary < wanted)
    below_points = F.when(strictness == "Medium", 25).when(strictness == "Strict", 80).otherwise(10)
    seniority, size = seniority_score(), company_size_score()
    early = result(
        ((years > limit), F.lit(-45), F.concat(
            F.lit("Advanced filter: -45 requires "), years.cast("string"),
            F.lit("+ years over "), limit.cast("string"), F.lit("-year maximum"))),
        (_c("p_avoid_contract") & _c("is_contract_or_temp"), F.lit(-80),
         listed("-80 contract/temp terms", contract)),
        (_c("p_avoid_unpaid") & _c("is_unpaid_or_commission"), F.lit(-90),
         listed("-90 unpaid/commission-only terms", unpaid)),
        (_c("p_avoid_defense") & _c("is_defense_military_clearance"), F.lit(-55),
         listed("-55 defense/military terms", defense)))
    late = result(
        (needs_visa & (F.size(visa) > 0), F.lit(10),
         listed("+10 sponsor-friendly terms", visa, 4)),
        (needs_visa & (F.size(no_visa) > 0), F.lit(-50),
         listed("-50 sponsorship-negative terms", no_visa, 3)),
        (needs_visa & (F.size(contract) > 0), F.lit(-20),
         listed("-20 contract/temp less sponsor-friendly", contract, 3)),
        (likes_visa & (F.size(visa) > 0), F.lit(8),
         listed("+8 sponsor-friendly terms", visa, 4)),
        (F.size(bonus) > 0, F.lit(12), listed("+12 company preference match", bonus, 5)),
        (F.size(penalty) > 0, F.lit(-25), listed("-25 company preference mismatch", penalty, 5)),
        (below, -below_points, F.concat(
            F.lit("Advanced filter: -"), _signed(below_points),
            F.lit(" salary below minimum with "), strictness, F.lit(" strictness"))),
        ((wanted > 0) & ~(salary > 0) & (strictness == "Medium"), F.lit(-10),
         F.lit("Advanced filter: -10 salary unknown with Medium strictness")))
    parts = [seniority, early, size, late]
    points = parts[0]["points"]
    for p in parts[1:]:
        points = points + p["points"]
    return F.struct(points.alias("points"),
                    F.concat(*[p["reasons"] for p in parts]).alias("reasons"))


# --- filters --------------------------------------------------------------------------------------

def _active_filters() -> dict[str, Column]:
    return {
        "max_required_years": _c("p_max_required_years").isNotNull(),
        "minimum_salary": _c("p_minimum_salary") > 0,
        "avoid_contract_temp": _c("p_avoid_contract"),
        "avoid_unpaid_commission": _c("p_avoid_unpaid"),
        "seniority_preference": _c("p_seniority_preference") != V.NO_PREFERENCE,
        "avoid_internship": _c("p_no_internship"),
        "avoid_defense_military": _c("p_avoid_defense"),
        "company_size_preference": _c("p_company_size_preference").isin(
            V.EXCLUDE_TINY, V.LARGE_ONLY),
        "strict_location": _c("p_location_strictness") == "Strict",
        "strict_role_fit": _c("p_role_fit_strictness") == "Strict",
    }


@once_per_jvm
def constraint_passes() -> dict[str, Column]:
    """The pass columns; unknown years and salaries pass."""
    choice, size = _c("p_seniority_preference"), _c("p_company_size_preference")
    avoids_senior = choice.isin(list(V.AVOIDS_SENIOR))
    small = _c("is_tiny_startup") | _c("is_small_company")
    passes = {
        "passes_years_filter": F.coalesce(
            _c("required_years_min") <= _c("p_max_required_years"), F.lit(True)),
        "passes_contract_filter": ~(_c("p_avoid_contract") & _c("is_contract_or_temp")),
        "passes_unpaid_filter": ~(_c("p_avoid_unpaid") & _c("is_unpaid_or_commission")),
        "passes_seniority_filter": ~(
            (avoids_senior & (_c("is_senior_staff_principal") | _c("is_manager_director")))
            | (choice.isin(list(V.AVOIDS_JUNIOR)) & _c("is_junior_entry_level"))),
        "passes_manager_filter": ~(avoids_senior & _c("is_manager_director")),
        "passes_internship_filter": ~(
            _c("p_no_internship") & (F.lower("employment_type_inferred") == "internship")),
        "passes_salary_filter": ~(
            (_c("p_minimum_salary") > 0) & (_c("p_salary_strictness") == "Strict")
            & (_c("salary_number") > 0) & (_c("salary_number") < _c("p_minimum_salary"))),
        "passes_defense_filter": ~(
            _c("p_avoid_defense") & _c("is_defense_military_clearance")),
        "passes_company_size_filter": ~(
            ((size == V.EXCLUDE_TINY) & _c("is_tiny_startup"))
            | ((size == V.LARGE_ONLY) & small)),
        "passes_role_fit_filter": ~(
            (_c("p_role_fit_strictness") == "Strict") & (_c("role_fit_score") < 0)),
    }
    every = (_c("p_location_strictness") != "Strict") | _c("passes_location_filter")
    for passed in passes.values():
        every = every & passed
    names = F.array_join(F.array_compact(F.array(
        *[F.when(on, F.lit(name)) for name, on in _active_filters().items()])), ", ")
    return passes | {
        "passes_all_active_constraints": every,
        "active_constraint_filters": F.when(names == "", "None").otherwise(names),
        "active_constraint_penalty": F.when(every, 0).otherwise(V.CONSTRAINT_PENALTY)}


def _list_text(terms: Column) -> Column:
    quoted = F.transform(terms, lambda t: F.concat(F.lit("'"), t, F.lit("'")))
    return F.concat(F.lit("["), F.array_join(quoted, ", "), F.lit("]"))


def _float_text(number: Column) -> Column:
    return F.concat(number.cast("bigint").cast("string"), F.lit(".0"))


def constraint_checks(scored: DataFrame) -> DataFrame:
    """One row per active check: (profile_id, row_index, filter, status, detail)."""
    phrases = _c("constraint_matched_phrases")

    def terms(kind: str) -> Column:
        return _list_text(F.try_element_at(phrases, F.lit(kind)))

    choice = _c("p_seniority_preference")
    salary = F.when(_c("salary_number") > 0, _float_text(_c("salary_number"))) \
        .otherwise("Unknown")
    years = F.coalesce(_float_text(_c("required_years_min")), F.lit("Unknown"))
    on = _active_filters()
    checks = [
        ("Maximum required years", on["max_required_years"], _c("passes_years_filter"),
         F.concat(F.lit("required="), years, F.lit(", max="),
                  _float_text(_c("p_max_required_years")))),
        ("Minimum salary", on["minimum_salary"], _c("passes_salary_filter"),
         F.concat(F.lit("salary="), salary, F.lit(", min="),
                  _float_text(_c("p_minimum_salary")), F.lit(", strictness="),
                  _c("p_salary_strictness"))),
        ("Avoid contract/temp", _c("p_avoid_contract"), ~_c("is_contract_or_temp"),
         terms("contract_or_temp")),
        ("Avoid unpaid/commission-only", _c("p_avoid_unpaid"), ~_c("is_unpaid_or_commission"),
         terms("unpaid_or_commission")),
        ("Avoid senior/staff/principal", choice.isin(list(V.AVOIDS_SENIOR)),
         ~_c("is_senior_staff_principal"), terms("senior_staff_principal")),
        ("Avoid junior", choice.isin(list(V.AVOIDS_JUNIOR)), ~_c("is_junior_entry_level"),
         terms("junior_entry_level")),
        ("Avoid internship roles", _c("p_no_internship"),
         F.lower("employment_type_inferred") != "internship", _c("employment_type_inferred")),
        ("Avoid manager/director", choice.isin(list(V.AVOIDS_SENIOR)),
         ~_c("is_manager_director"), terms("manager_director")),
        ("Strict location", on["strict_location"], _c("passes_location_filter"),
         _c("location_filter_reason")),
        ("Strict role fit", on["strict_role_fit"], _c("passes_role_fit_filter"),
         F.concat(F.lit("role_fit_score="), _c("role_fit_score").cast("string"))),
        ("Avoid defense/military", _c("p_avoid_defense"),
         ~_c("is_defense_military_clearance"), terms("defense_military_clearance")),
        ("Company size preference", on["company_size_preference"],
         _c("passes_company_size_filter"), _c("company_size_match_text")),
    ]
    rows = F.array_compact(F.array(*[F.when(active, F.struct(
        F.lit(name).alias("filter"),
        F.when(passed, "PASS").otherwise("FAIL").alias("status"), detail.alias("detail")))
        for name, active, passed, detail in checks]))
    return scored.select("profile_id", "row_index", F.explode(rows).alias("check")) \
        .select("profile_id", "row_index", "check.*")


# --- everything together ------------------------------------------------------------------------------

@once_per_jvm
def _part_columns() -> dict[str, Column]:
    return {"_role": target_role_score(), "_skill": skill_score(_c("_skills")),
            "_location": location_score(_c("_location_check")),
            "_salary": salary_fit_score(), "_dealbreaker": dealbreaker_score(),
            "_advanced": advanced_score(), "_fit": role_fit_score()}


def score_parts(pairs: DataFrame) -> DataFrame:
    """Add the (points, reasons) struct of every rule as ``_…`` columns."""
    return score_inputs(pairs).withColumns(_part_columns())


INPUTS = ("_title_text", "_content_text", "_breaker_text", "_role_titled", "_role_related",
          "_ml_terms", "_fit_title", "_fit_found", "_fit_negative", "_fit_content",
          "_training", "_generic", "_skills", "_location_check", "_defense_found",
          "_other_found", "_bonus_found", "_penalty_found")
RULE_PARTS = ("_role", "_skill", "_location", "_salary", "_dealbreaker", "_advanced")


def embedding_bonus(similarity: Column) -> Column:
    """Points for the similarity; without one the bonus is 0."""
    return round2(F.coalesce(similarity, F.lit(0.0)) * V.EMBEDDING_BONUS_SCALE)


@once_per_jvm
def _totals() -> dict[str, Column]:
    points = F.lit(0)
    for part in RULE_PARTS:
        points = points + _c(part)["points"]
    similarity = F.coalesce(_c("embedding_similarity").cast("double"), F.lit(0.0))
    return {
        "score": points.cast("int"),
        "_rules": F.array_join(F.concat(*[_c(p)["reasons"] for p in RULE_PARTS]), "; "),
        "matched_skills": F.array_join("_skills", ", "),
        "role_fit_score": _c("_fit")["points"],
        "role_fit_reason": F.array_join(_c("_fit")["reasons"], "; "),
        "passes_location_filter": _c("_location_check")["passed"],
        "location_filter_reason": _c("_location_check")["reason"],
        "embedding_similarity": similarity,
        "embedding_bonus": embedding_bonus(similarity)}


@once_per_jvm
def _settings() -> dict[str, Column]:
    return {
        "role_fit_strictness_penalty": _c("_strict")["points"],
        "role_fit_strictness_reason": F.array_join(_c("_strict")["reasons"], "; "),
        "seniority_preference": _c("p_seniority_preference"),
        "preferred_location": _c("p_preferred_location"),
        "location_strictness": _c("p_location_strictness"),
        "company_size_preference": _c("p_company_size_preference"),
        "salary_minimum": _c("p_minimum_salary"),
        "salary_strictness": _c("p_salary_strictness"),
        "max_required_years_setting": F.coalesce(
            _c("p_max_required_years").cast("string"), F.lit("No limit"))}


def score_pairs(pairs: DataFrame, retrieved: bool = False) -> DataFrame:
    """Score, filter and explain every (posting, profile) row.

    ``embedding_similarity`` is used when present (missing values count as 0).
    """
    if "embedding_similarity" not in pairs.columns:
        pairs = pairs.withColumn("embedding_similarity", F.lit(0.0))
    df = score_parts(pairs).withColumns(_totals()).withColumn("_strict", role_fit_penalty(
        _c("role_fit_score"), _c("p_role_fit_strictness")))
    df = df.withColumns(constraint_passes() | _settings())
    final = round2(_c("score") + _c("role_fit_score") + _c("embedding_bonus")
                   - _c("role_fit_strictness_penalty") - _c("active_constraint_penalty"))
    return df.withColumn("final_score", final).withColumns({
        "explanation": final_explanation(retrieved),
        "feedback_label": F.lit("Skip"), "feedback_adjustment_score": F.lit(0),
        "feedback_adjustment_reason": F.lit(""),
        "adjusted_final_score": _c("final_score")}) \
        .drop("_strict", "_rules", "_fit", *RULE_PARTS, *INPUTS)


@once_per_jvm
def final_explanation(retrieved: bool) -> Column:
    rules = F.when(_c("_rules") == "", "No preferences entered yet, so this job keeps a "
                                       "neutral score.").otherwise(_c("_rules"))
    strict = _c("role_fit_strictness_reason")
    opening = ("Retrieved by semantic similarity, then ranked by title, skill, location, "
               "salary, and dealbreaker rules. ") if retrieved else ""
    return F.concat(
        F.lit(opening),
        F.format_string("Embedding similarity contribution: +%.2f (similarity %.3f). ",
                        _c("embedding_bonus"), _c("embedding_similarity")),
        _c("role_fit_reason"), F.lit(". "),
        F.when(strict != "", F.concat(strict, F.lit(". "))).otherwise(""),
        F.when(_c("active_constraint_penalty") > 0,
               "Active constraint penalty: -500 failed one or more active filters. ")
        .otherwise(""), rules)
