"""Queries over text primitives, profile texts and the signal columns of postings."""

from __future__ import annotations

from pyspark.sql import functions as F

from matchlake import vocab as V
from matchlake.functions import documents as D
from matchlake.functions import location as L
from matchlake.functions import requirements as Q
from matchlake.functions import salary as P
from matchlake.functions import text as T
from matchlake.operators import analytics as A
from matchlake.operators import profiles as O
from matchlake.operators import sampling as B
from matchlake.operators.ingest import embedding_text
from matchlake.operators.signals import CONSTRAINT_COLUMNS
from matchlake.plans import fixtures as X
from matchlake.plans import sql as S
from matchlake.plans.catalog import query
from matchlake.sources.readers import load_jobs

PROFILE_CTE = "profiles AS (SELECT " + ", ".join(
    f"{sql} AS {name}" for name, sql in X.PROFILE_COLUMNS.items()) + " FROM customer)"


# --- text ------------------------------------------------------------------------------

def _norm(name: str, fn, sql) -> None:
    @query(name, f"SELECT doc_id, md5({sql('text')}) AS text_md5 FROM documents")
    def run(spark, sf):
        return X.documents(spark, sf).select("doc_id", F.md5(fn(F.col("text"))).alias("text_md5"))


_norm("norm_location", T.norm_location, S.nloc)
_norm("norm_search", T.norm_search, S.nsearch)
_norm("norm_coverage", T.norm_coverage, S.ncov)


@query("contains_phrase", S.with_(S.JOBS0, select=(
    f"SELECT row_index, contains({S.nsearch('description')}, 'power bi') AS constant_phrase, "
    f"contains({S.nsearch('description')}, trim({S.nsearch('company')})) AS column_phrase "
    "FROM jobs0")))
def contains_phrase(spark, sf):
    return X.jobs(spark, sf).select(
        "row_index", T.contains_phrase(F.col("description"), "Power-BI").alias("constant_phrase"),
        T.contains_phrase(F.col("description"), F.col("company")).alias("column_phrase"))


@query("find_terms", S.with_(S.JOBS0, select=(
    "SELECT row_index, array_to_string(" + S.terms(S.nsearch("description"), V.CONTRACT_TERMS
    + V.SPONSORSHIP_POSITIVE_TERMS + V.DEFENSE_TERMS) + ", '|') AS terms FROM jobs0")))
def find_terms(spark, sf):
    words = V.CONTRACT_TERMS + V.SPONSORSHIP_POSITIVE_TERMS + V.DEFENSE_TERMS
    return X.jobs(spark, sf).select("row_index", F.array_join(
        T.find_terms(F.col("description"), words), "|").alias("terms"))


@query("match_any", S.with_(S.JOBS0, select=(
    "SELECT row_index, " + S.any_term(S.nsearch("description"), V.SAMPLE_BUCKETS["data_analytics_bi"])
    + " AS matches FROM jobs0")))
def match_any(spark, sf):
    return X.jobs(spark, sf).select("row_index", T.match_any(
        T.norm_search(F.col("description")), V.SAMPLE_BUCKETS["data_analytics_bi"]).alias("matches"))


@query("extract_skills", S.with_(S.JOBS0, select=(
    "SELECT row_index, array_to_string(" + S.terms(
        f"lower({S.ws('description')})", V.SKILL_VOCABULARY, lambda t: t.lower(), order=False)
    + ", ',') AS skills FROM jobs0")))
def extract_skills(spark, sf):
    return X.jobs(spark, sf).select("row_index", F.array_join(
        T.extract_skills(F.col("description"), V.SKILL_VOCABULARY), ",").alias("skills"))


@query("years_required", S.with_(*S.SIGNAL_CTES, select=(
    "SELECT row_index, required_years_min AS years, years_requirement_text AS phrase, "
    "coalesce(required_years_min, 0) AS years_or_zero FROM sig")))
def years_required(spark, sf):
    years = Q.years_required(F.col("description"))
    return X.jobs(spark, sf).withColumn("y", years).select(
        "row_index", F.col("y.years").alias("years"),
        F.coalesce("y.phrase", F.lit("Unknown")).alias("phrase"),
        F.coalesce("y.years", F.lit(0)).alias("years_or_zero"))


_DROPPED = V.TITLE_STOP_WORDS + V.GENERIC_ROLE_WORDS + V.FEEDBACK_IGNORED_TERMS
TITLE_TERMS = (f"list_filter(regexp_extract_all(lower({{}}), '[a-z][a-z+#.]{{{{2,}}}}'), lambda w: "
               f"NOT list_contains({S.lst(_DROPPED)}, w))[1:8]")


@query("title_terms", S.with_(S.JOBS0, select=(
    f"SELECT row_index, array_to_string({TITLE_TERMS.format('title')}, ',') AS terms FROM jobs0")))
def title_terms(spark, sf):
    return X.jobs(spark, sf).select("row_index", F.array_join(
        T.title_terms(F.col("title"), _DROPPED), ",").alias("terms"))


@query("comma_values", S.with_(PROFILE_CTE, select=(
    "SELECT profile_id, array_to_string(list_filter(list_transform(string_split(skills_text, "
    "','), lambda p: trim(lower(p))), lambda p: p <> '' AND NOT list_contains("
    f"{S.lst(V.FEEDBACK_IGNORED_TERMS)}, p)), '|') AS parts FROM profiles")))
def comma_values(spark, sf):
    return X.profile_table(spark, sf).select("profile_id", F.array_join(T.comma_values(
        F.col("skills_text"), V.FEEDBACK_IGNORED_TERMS), "|").alias("parts"))


# --- profile texts -------------------------------------------------------------------------

@query("split_keywords", S.with_(PROFILE_CTE, select=(
    f"SELECT profile_id, array_to_string({S.keywords('skills_text')}, '|') AS skills, "
    f"array_to_string({S.roles('target_role')}, '|') AS roles FROM profiles")))
def split_keywords(spark, sf):
    return X.profile_table(spark, sf).select(
        "profile_id", F.array_join(T.split_keywords(F.col("skills_text")), "|").alias("skills"),
        F.array_join(T.split_target_roles(F.col("target_role")), "|").alias("roles"))


_BOTH = f"list_concat({S.keywords('skills_text')}, ['SQL', 'Rust', 'python'])"


@query("combine_skills", S.with_(PROFILE_CTE, select=(
    f"SELECT profile_id, array_to_string(list_filter({_BOTH}, lambda s, i: "
    f"list_position(list_transform({_BOTH}, lambda x: lower(x)), lower(s)) = i), ', ') AS skills "
    "FROM profiles")))
def combine_skills(spark, sf):
    return X.profile_table(spark, sf).select("profile_id", F.array_join(T.combine_skills(
        F.col("skills_text"), T.string_array(["SQL", "Rust", "python"])), ", ").alias("skills"))


_TIDY = ("list_filter(list_transform(regexp_split_to_array(skills_text, '[,;\\n.]+'), lambda r: "
         "array_to_string(list_filter(regexp_split_to_array(trim(regexp_replace(r, "
         "'[^a-zA-Z0-9+#/ -]+', ' ', 'g')), ' +'), lambda w: w <> '' AND lower(w) NOT IN "
         "('certified', 'some')), ' ')), lambda p: p <> '')")
_NAMES = " ".join(f"WHEN {S.q(k)} THEN {S.q(v)}" for k, v in V.SKILL_DISPLAY_NAMES.items())
_TITLED = ("array_to_string(list_transform(regexp_extract_all({0}, '[a-z]+|[^a-z]+'), lambda r: "
           "upper(r[1]) || r[2:]), '')")
_KEYS = f"list_transform({_TIDY}, lambda p: lower(p))"


@query("skill_display", S.with_(PROFILE_CTE, select=(
    f"SELECT profile_id, coalesce(array_to_string(list_transform(list_filter({_KEYS}, lambda s, i: "
    f"list_position({_KEYS}, s) = i), lambda k: CASE k {_NAMES} ELSE {_TITLED.format('k')} END), "
    "', '), '') AS skills FROM profiles")))
def skill_display(spark, sf):
    return X.profile_table(spark, sf).select("profile_id", T.skill_display(
        F.col("skills_text"), V.SKILL_DISPLAY_NAMES, V.SKILL_NOISE_WORDS).alias("skills"))


@query("target_role_family", S.with_(PROFILE_CTE, select=(
    f"SELECT profile_id, {S.family('target_role')} AS family FROM profiles")))
def target_role_family(spark, sf):
    return X.profile_table(spark, sf).select(
        "profile_id", O.target_role_family(F.col("target_role")).alias("family"))


@query("is_us_pref", S.with_(PROFILE_CTE, select=(
    f"SELECT profile_id, {S.us_preference('preferred_location')} AS wants_us FROM profiles")))
def is_us_pref(spark, sf):
    return X.profile_table(spark, sf).select(
        "profile_id", L.is_us_preference(F.col("preferred_location")).alias("wants_us"))


@query("seniority_flags", S.with_(PROFILE_CTE, select=(
    f"SELECT profile_id, {S.inn('seniority_preference', V.AVOIDS_SENIOR)} AS avoid_senior_roles, "
    f"{S.inn('seniority_preference', V.AVOIDS_JUNIOR)} AS avoid_junior_roles, "
    f"{S.inn('seniority_preference', V.AVOIDS_SENIOR)} AS avoid_manager_roles FROM profiles")))
def seniority_flags(spark, sf):
    return X.profile_table(spark, sf).select("profile_id", *[
        v.alias(k) for k, v in O.seniority_flags(F.col("seniority_preference")).items()])


@query("pref_flags", S.with_(PROFILE_CTE, select=(
    "SELECT profile_id, avoid_contract, avoid_unpaid, avoid_internship OR "
    f"{S.inn('seniority_preference', V.AVOIDS_INTERNSHIP)} AS no_internship FROM profiles")))
def pref_flags(spark, sf):
    return X.profile_table(spark, sf).select(
        "profile_id", "avoid_contract", "avoid_unpaid", O.internship_active(
            F.col("avoid_internship"), F.col("seniority_preference")).alias("no_internship"))


@query("profile_text", S.with_(PROFILE_CTE, select=(
    "SELECT profile_id, array_to_string(list_filter([CASE WHEN target_role <> '' THEN 'Target "
    "role: ' || target_role END, CASE WHEN skills_text <> '' THEN 'Skills: ' || skills_text END, "
    "CASE WHEN dealbreakers_text <> '' THEN 'Resume excerpt: ' || dealbreakers_text END], "
    "lambda x: x IS NOT NULL), chr(10)) AS text FROM profiles")))
def profile_text(spark, sf):
    return X.profile_table(spark, sf).select("profile_id", F.coalesce(D.profile_text(
        F.col("target_role"), F.col("skills_text"), F.col("dealbreakers_text")),
        F.lit("")).alias("text"))


# --- salary ------------------------------------------------------------------------------------

@query("salary_text", S.with_(*S.JOB_CTES, select="SELECT row_index, salary_text FROM jobs"))
def salary_text(spark, sf):
    return X.jobs(spark, sf).select("row_index", P.salary_text(F.col("salary")).alias("salary_text"))


@query("salary_number", S.with_(*S.JOB_CTES, select="SELECT row_index, salary_number FROM jobs"))
def salary_number(spark, sf):
    return X.jobs(spark, sf).select(
        "row_index", P.salary_number(F.col("salary")).alias("salary_number"))


@query("salary_annual", S.with_(S.JOBS0, select=(
    f"SELECT row_index, CAST({S.annual('salary')} AS DOUBLE) AS annual FROM jobs0")))
def salary_annual(spark, sf):
    return X.jobs(spark, sf).select("row_index", P.salary_annual(F.col("salary")).alias("annual"))


@query("salary_band", "SELECT p_partkey, " + S.band("p_retailprice * 100") + " AS band FROM part")
def salary_band(spark, sf):
    return X.table(spark, sf, "part").select(
        "p_partkey", P.salary_band(F.col("p_retailprice") * 100).alias("band"))


# --- location and requirement signals ---------------------------------------------------------------

def _both_places(fn):
    return fn(L.place(F.col("location")))


@query("loc_country", S.with_(S.JOBS0, select=(
    f"SELECT row_index, {S.looks_us('location')} AS is_us, {S.looks_non_us('location')} AS is_non_us, "
    f"{S.has(S.nloc('location'), V.CANADA_TERMS)} AS is_canadian, "
    f"{S.explicit_non_us('location')} AS explicit_non_us FROM jobs0")))
def loc_country(spark, sf):
    return X.jobs(spark, sf).select(
        "row_index", _both_places(L.looks_us).alias("is_us"),
        _both_places(L.looks_non_us).alias("is_non_us"),
        _both_places(L.looks_canadian).alias("is_canadian"),
        _both_places(L.explicit_non_us).alias("explicit_non_us"))


for _name, _fn, _sql in (
        ("loc_is_us", L.looks_us, S.looks_us("text")),
        ("loc_is_non_us", L.looks_non_us, S.looks_non_us("text")),
        ("loc_is_canadian", L.looks_canadian, S.has(S.nloc("text"), V.CANADA_TERMS)),
        ("loc_explicit_non_us", L.explicit_non_us, S.explicit_non_us("text"))):
    def _register(name=_name, fn=_fn, sql=_sql):
        @query(name, f"SELECT doc_id, {sql} AS flag FROM (SELECT doc_id, "
               f"{X.case('doc_id', X.LOCATIONS)} || ', ' || lang || '/' || source AS text FROM documents)")
        def run(spark, sf):
            df = X.documents(spark, sf).selectExpr(
                "doc_id", f"{X.case('doc_id', X.LOCATIONS)} || ', ' || lang || '/' || source AS text")
            return df.select("doc_id", fn(L.place(F.col("text"))).alias("flag"))
    _register()


@query("loc_us_remote", S.with_(*S.SIGNAL_CTES, select=(
    "SELECT row_index, is_us_remote_location AS us_remote FROM sig")))
def loc_us_remote(spark, sf):
    text = F.concat_ws(" ", "title", "location", "location", "description")
    return X.jobs(spark, sf).select("row_index", L.us_remote(T.norm_search(text)).alias("us_remote"))


@query("loc_remote_text", S.with_(S.JOBS0, select=(
    f"SELECT row_index, list_has_any({S.words('description')}, ['remote', 'wfh']) OR "
    f"contains({S.nloc('description')}, 'work from home') AS remote FROM jobs0")))
def loc_remote_text(spark, sf):
    return X.jobs(spark, sf).select("row_index", L.remote_text(F.col("description")).alias("remote"))


@query("loc_bay_area_text", S.with_(S.JOBS0, select=(
    f"SELECT row_index, {S.has(S.nloc(chr(39).join(['location || ', ' ', ' || description'])), V.BAY_AREA_TERMS)} "
    "AS bay_area FROM jobs0")))
def loc_bay_area_text(spark, sf):
    return X.jobs(spark, sf).select("row_index", L.bay_area_text(
        F.concat_ws(" ", "location", "description")).alias("bay_area"))


_PHRASES = {"remote": "remote_l", "hybrid": "hybrid_l", "onsite": "onsite_l", "bay_area": "bay_l"}
_LOCATION = ("raw_location", "location_source", "location_confidence", "is_us_location",
             "is_remote", "is_us_remote_location", "has_explicit_non_us_location_signal",
             "is_explicit_remote_location", "is_hybrid", "is_california", "is_bay_area",
             "is_non_us_location")


@query("location_signals", S.with_(*S.SIGNAL_CTES, select=(
    f"SELECT row_index, {', '.join(_LOCATION)}, "
    + ", ".join(f"array_to_string({c}, '|') AS phrases_{k}" for k, c in _PHRASES.items())
    + ", CASE WHEN us_text THEN 'US/location state signal' ELSE '' END AS phrases_us, CASE WHEN "
    "non_us THEN 'non-US country/location signal' ELSE '' END AS phrases_non_us, CASE WHEN cal "
    "THEN 'California/CA' ELSE '' END AS phrases_california FROM sig")))
def location_signals(spark, sf):
    phrases = F.col("location_matched_phrases")
    return X.signals(spark, sf).select("row_index", *_LOCATION, *[
        F.array_join(F.try_element_at(phrases, F.lit(k)), "|").alias(f"phrases_{k}")
        for k in (*_PHRASES, "us", "non_us", "california")])


def _signal_query(name: str, columns: list[str]) -> None:
    @query(name, S.with_(*S.SIGNAL_CTES, select=f"SELECT row_index, {', '.join(columns)} FROM sig"))
    def run(spark, sf):
        return X.signals(spark, sf).select("row_index", *columns)


_signal_query("employment_type", ["employment_type_inferred"])
_signal_query("role_family", ["role_family_inferred"])
_signal_query("defense_matches", ["defense_match_text", "is_defense_military_clearance"])
_signal_query("company_size", ["company_size_inferred", "company_size_confidence",
                               "company_size_match_text"])


@query("employee_bucket", "SELECT p_partkey, " + S.size_bucket("p_retailprice * (p_size - 1)")
       + " AS bucket FROM part")
def employee_bucket(spark, sf):
    return X.table(spark, sf, "part").select("p_partkey", Q.employee_bucket(
        F.col("p_retailprice") * (F.col("p_size") - 1)).alias("bucket"))


@query("employee_count", S.with_(S.JOBS0, select=(
    "SELECT row_index, CASE WHEN TRY_CAST(employee_count AS DOUBLE) > 0 THEN "
    "TRY_CAST(employee_count AS DOUBLE) WHEN row_index % 7 > 0 THEN CAST(row_index % 7 AS DOUBLE) "
    "END AS n FROM jobs0")))
def employee_count(spark, sf):
    df = X.jobs(spark, sf).withColumn("employees", (F.col("row_index") % 7).cast("string"))
    return df.select("row_index", Q.employee_count(
        [F.col("employee_count"), F.col("employees")])["count"].alias("n"))


_FLAT = [c for c in CONSTRAINT_COLUMNS if not c.endswith("_phrases")]
_KINDS = {"contract_or_temp": "contract", "unpaid_or_commission": "unpaid",
          "senior_staff_principal": "senior", "junior_entry_level": "junior",
          "manager_director": "manager", "defense_military_clearance": "defense",
          "visa_sponsorship": "visa", "no_sponsorship": "no_visa"}


@query("job_constraints", S.with_(*S.SIGNAL_CTES, select=(
    f"SELECT row_index, {', '.join(_FLAT)}, salary_number, salary_text, "
    + ", ".join(f"array_to_string({c}, '|') AS phrases_{k}" for k, c in _KINDS.items())
    + ", coalesce(yr.p, '') AS phrases_years_requirement FROM sig")))
def job_constraints(spark, sf):
    phrases = F.col("constraint_matched_phrases")
    return X.signals(spark, sf).select(
        "row_index", *_FLAT, "salary_number", "salary_text",
        *[F.array_join(F.try_element_at(phrases, F.lit(k)), "|").alias(f"phrases_{k}")
          for k in (*_KINDS, "years_requirement")])


# --- coverage flags -----------------------------------------------------------------------------------

def coverage_ctes(chars: int | None, jobs: str = "jobs0") -> tuple[str, ...]:
    """CTE ``cov`` with one boolean per metric; the description whole or cut."""
    description = f"substr(description, 1, {chars})" if chars else "description"
    search = f"title || ' ' || company || ' ' || location || ' ' || {description}"
    groups = ", ".join(f"{S.any_term('st', t, T.coverage_term)} AS \"{g}\""
                       for g, t in V.COVERAGE_GROUPS.items())
    return (S.JOBS0,
            f"cov0 AS (SELECT *, {S.ncov('location')} AS lt, {S.ncov(search)} AS st, "
            f"{S.ncov(chr(39).join(['location || ', ' ', ' || ']) + search)} AS ct FROM {jobs})",
            "cov AS MATERIALIZED (SELECT *, TRUE AS \"total jobs\", lower(trim(salary)) NOT IN "
            "('', 'unknown') AND regexp_matches(salary, '[0-9]') AS \"jobs with known salary\", "
            f"{S.has('lt', (' us ', ' usa ', ' united states '))} AS \"US jobs\", "
            f"{S.has('st', (' remote ', ' work from home '))} AS \"remote jobs\", "
            "contains(ct, ' california ') OR contains(lt, ' ca us ') OR contains(lt, ' ca usa ') "
            f"OR {S.has('ct', V.COVERAGE_BAY_AREA_TERMS)} AS \"California / Bay Area jobs\", "
            f"{groups} FROM cov0)")


def _coverage_query(name: str, metric: str) -> None:
    @query(name, S.with_(*coverage_ctes(None), select=f'SELECT row_index, "{metric}" AS flag FROM cov'))
    def run(spark, sf):
        flagged = A.coverage_flags(X.jobs(spark, sf), None)
        return flagged.select("row_index", F.col(f"`{metric}`").alias("flag"))


_coverage_query("has_known_salary", "jobs with known salary")
_coverage_query("cov_is_us", "US jobs")
_coverage_query("cov_is_remote", "remote jobs")
_coverage_query("cov_is_ca_bay", "California / Bay Area jobs")
_GROUP_NAMES = {g: f"group_{i}" for i, g in enumerate(V.COVERAGE_GROUPS)}


@query("role_group_flags", S.with_(*coverage_ctes(None), select="SELECT row_index, " + ", ".join(
    f'"{g}" AS {n}' for g, n in _GROUP_NAMES.items()) + " FROM cov"))
def role_group_flags(spark, sf):
    return A.coverage_flags(X.jobs(spark, sf), None).select(
        "row_index", *[F.col(f"`{g}`").alias(n) for g, n in _GROUP_NAMES.items()])


@query("search_text", S.with_(S.JOBS0, select=(
    "SELECT row_index, md5(title || ' ' || company || ' ' || location || ' ' || "
    "substr(description, 1, 1200)) AS scan_md5, md5(title || ' ' || company || ' ' || location "
    "|| ' ' || description) AS whole_md5 FROM jobs0")))
def search_text(spark, sf):
    # the coverage report is defined on the first 1,200 characters; the whole text is offered too
    return X.jobs(spark, sf).select("row_index", F.md5(A.search_text(V.COVERAGE_SCAN_CHARS)).alias("scan_md5"),
                                    F.md5(A.search_text()).alias("whole_md5"))


def bucket_cte() -> str:
    text = S.nsearch("concat_ws(' ', title, company, location, description)")
    flags = ", ".join(f"{S.any_term('bt', t)} AS {b}" for b, t in V.SAMPLE_BUCKETS.items())
    return (f"buckets AS MATERIALIZED (SELECT row_index, md5('{V.SAMPLE_SEED}:' || row_index) AS draw, "
            f"{flags} FROM (SELECT row_index, {text} AS bt FROM jobs0))")


@query("family_bucket_flags", S.with_(S.JOBS0, bucket_cte(), select=(
    f"SELECT row_index, {', '.join(V.SAMPLE_BUCKETS)} FROM buckets")))
def family_bucket_flags(spark, sf):
    return B.family_bucket_flags(embedding_text(X.jobs(spark, sf))) \
        .select("row_index", *B.BUCKETS)


@query("load_jobs", S.with_(*S.JOB_CTES, select=(
    "SELECT row_index, raw_location, location_source, salary_text, salary_number FROM jobs")))
def load_time_columns(spark, sf):
    return load_jobs(X.jobs(spark, sf)).select(
        "row_index", "raw_location", "location_source", "salary_text", "salary_number")
