"""SQL building blocks of the reference answers (run by the checker, not by Spark).

They state the same rules a second time, in plain SQL, over the same tables.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from matchlake import vocab as V
from matchlake.functions.text import coverage_term, plain_term, search_term
from matchlake.plans import fixtures as X

BL = (r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}"
      r"\x{205f}\x{3000}]+")


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def lst(values: Iterable[str]) -> str:
    values = list(values)
    return "[" + ", ".join(q(v) for v in values) + "]" if values else "CAST([] AS VARCHAR[])"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^{BL}|{BL}$', '', 'g')"


def ws(x: str) -> str:
    return f"trim(regexp_replace(coalesce({x}, ''), '{BL}', ' ', 'g'))"


def nloc(x: str) -> str:
    return f"trim(regexp_replace(lower({x}), '[^a-z0-9]+', ' ', 'g'))"


def nsearch(x: str) -> str:
    return f"(' ' || trim(regexp_replace(lower({x}), '[^a-z0-9+#.]+', ' ', 'g')) || ' ')"


def ncov_bare(x: str) -> str:
    return f"trim(regexp_replace(lower({x}), '[^a-z0-9+#.-]+', ' ', 'g'))"


def ncov(x: str) -> str:
    return f"(CASE WHEN {ncov_bare(x)} = '' THEN ' ' ELSE ' ' || {ncov_bare(x)} || ' ' END)"


def _re(term: str) -> str:
    return "".join("\\" + c if c in ".+*?()[]{}|^$\\" else c for c in term)


def bounded(text: str, form: str) -> str:
    return (f"(contains({text}, {q(form)}) AND regexp_matches({text}, "
            f"'(^|[^a-z0-9]){_re(form)}($|[^a-z0-9])'))")


def terms(text: str, words: Iterable[str], form: Callable[[str], str] = search_term,
          order: bool = True) -> str:
    words = sorted(words) if order else list(words)
    if not words:
        return "CAST([] AS VARCHAR[])"
    cases = ", ".join(f"CASE WHEN {bounded(text, form(w))} THEN {q(w)} END" for w in words)
    return f"list_filter([{cases}], lambda x: x IS NOT NULL)"


def any_term(text: str, words: Iterable[str], form=search_term) -> str:
    return "(" + " OR ".join(bounded(text, form(w)) for w in words) + ")"


def has(text: str, needles: Iterable[str]) -> str:
    return "(" + " OR ".join(f"contains({text}, {q(n)})" for n in needles) + ")"


def inn(x: str, values: Iterable[str]) -> str:
    return f"({x} IN ({', '.join(q(v) for v in values)}))"


def join(x: str, sep: str = ", ") -> str:
    return f"coalesce(array_to_string({x}, '{sep}'), '')"


def compact(*items: str) -> str:
    return f"list_filter([{', '.join(items)}], lambda x: x IS NOT NULL)"


def with_(*ctes: str, select: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n" + select


# --- postings --------------------------------------------------------------------------

JOBS0 = "jobs0 AS (SELECT " + ", ".join(
    f"{sql} AS {name}" for name, sql in X.JOB_COLUMNS.items()) + " FROM documents)"


def nums(x: str) -> str:
    return (f"list_filter(list_transform(regexp_extract_all({x}, "
            f"'[0-9][0-9,]*(?:[.][0-9]+)?'), lambda v: "
            f"TRY_CAST(replace(v, ',', '') AS DOUBLE)), lambda v: v >= 1000)")


def biggest(x: str) -> str:
    return f"coalesce(CAST(trunc(list_max({nums(x)})) AS BIGINT), 0)"


def _field(f: str) -> str:
    v = f"json_extract_string(sj, '$.{f}')"
    n = f"TRY_CAST(replace({v}, ',', '') AS DOUBLE)"
    return (f"nullif(CASE WHEN coalesce({v}, '') = '' THEN 0 WHEN {n} IS NOT NULL "
            f"THEN CAST(trunc({n}) AS BIGINT) ELSE {biggest(v)} END, 0)")


JOBS = ("jobs1 AS (SELECT *, (trim(salary) LIKE '{%}' AND json_valid(salary)) AS is_obj, "
        "CASE WHEN trim(salary) LIKE '{%}' AND json_valid(salary) THEN salary ELSE '{}' END "
        "AS sj FROM jobs0),\n"
        "jobs2 AS (SELECT * REPLACE (CASE WHEN trim(raw_location) = '' THEN location ELSE "
        "raw_location END AS raw_location, CASE WHEN trim(location_source) <> '' THEN "
        "trim(location_source) WHEN trim(location) = '' OR lower(trim(location)) = 'unknown' "
        "THEN 'unknown' ELSE 'ambiguous_location' END AS location_source), "
        f"CASE WHEN is_obj THEN coalesce({_field('value')}, {_field('minValue')}, "
        f"{_field('maxValue')}, {biggest('salary')}) ELSE {biggest('salary')} END "
        "AS salary_number FROM jobs1),\n"
        "jobs AS (SELECT *, CASE WHEN is_obj THEN CASE WHEN "
        "coalesce(json_extract_string(sj, '$.text'), '') <> '' THEN "
        "trim(json_extract_string(sj, '$.text')) WHEN salary_number <> 0 THEN "
        "format('{:,}', salary_number) ELSE 'Unknown' END WHEN trim(salary) = '' THEN "
        "'Unknown' ELSE trim(salary) END AS salary_text FROM jobs2)")
JOB_CTES = (JOBS0, JOBS)


def annual(x: str) -> str:
    """Annual salary of text ``x`` (a column); its JSON form is read in place."""
    obj = f"(trim({x}) LIKE '{{%}}' AND json_valid({x}))"
    sj = f"(CASE WHEN {obj} THEN {x} ELSE '{{}}' END)"

    def num(f: str) -> str:
        return f"TRY_CAST(json_extract_string({sj}, '$.{f}') AS DOUBLE)"

    period = f"lower(trim(coalesce(json_extract_string({sj}, '$.period'), '')))"
    text = (f"trim(CASE WHEN {obj} THEN coalesce(json_extract_string({sj}, '$.text'), '') "
            f"ELSE {x} END)")
    words = "|".join(V.NON_ANNUAL_WORDS)
    return (f"CASE WHEN {period} <> '' AND NOT {inn(period, V.ANNUAL_PERIODS)} THEN NULL "
            f"WHEN {num('minValue')} IS NOT NULL AND {num('maxValue')} IS NOT NULL THEN "
            f"({num('minValue')} + {num('maxValue')}) / 2 "
            f"WHEN {num('value')} >= 1000 THEN {num('value')} "
            f"WHEN {text} = '' OR {inn(f'lower({text})', V.NO_SALARY_TEXTS)} THEN NULL "
            f"WHEN regexp_matches(lower({text}), '\\b(?:{words})\\b') THEN NULL "
            f"WHEN len({nums(text)}) >= 2 THEN ({nums(text)}[1] + {nums(text)}[2]) / 2 "
            f"ELSE {nums(text)}[1] END")


def band(a: str) -> str:
    arms = " ".join(f"WHEN {a} < {limit} THEN {q(name)}" for name, limit in V.SALARY_BANDS)
    return f"CASE WHEN {a} IS NULL THEN {q(V.SALARY_BAND_UNKNOWN)} {arms} ELSE {q(V.SALARY_BAND_TOP)} END"


def analytics_location(x: str) -> str:
    return (f"CASE WHEN {ws(x)} = '' OR {inn(f'lower({ws(x)})', V.MISSING_LOCATION_TEXTS)} "
            f"THEN 'Unknown' WHEN {inn(nloc(ws(x)), V.US_ONLY_NAMES)} THEN 'US unspecified' "
            f"ELSE {ws(x)} END")


# --- places -----------------------------------------------------------------------------

ABBR = tuple(a.lower() for a in V.US_STATES.values())


def words(x: str) -> str:
    return f"string_split({nloc(x)}, ' ')"


def names_us(x: str) -> str:
    return f"(list_has_any({words(x)}, ['us', 'usa']) OR contains({nloc(x)}, 'united states'))"


def names_state(x: str) -> str:
    return f"({has(nloc(x), V.US_STATES)} OR list_has_any({words(x)}, {lst(ABBR)}))"


def currency(x: str) -> str:
    return f"(contains(lower({x}), '£') OR {has(nloc(x), V.NON_US_CURRENCY_WORDS)})"


def code(x: str) -> str:
    return (f"list_filter(list_transform(regexp_split_to_array({x}, '[,/|]'), lambda p: "
            f"{nloc('p')}), lambda p: list_contains({lst(V.NON_US_CODES)}, p))[1]")


def last_code(x: str) -> str:
    return f"CASE WHEN {inn(f'{words(x)}[-1]', V.NON_US_CODES)} THEN {words(x)}[-1] END"


_FOREIGN = V.NON_US_TERMS + V.CANADA_TERMS


def looks_non_us(x: str) -> str:
    return (f"(NOT {names_us(x)} AND ({currency(x)} OR {has(nloc(x), _FOREIGN)} OR "
            f"{code(x)} IS NOT NULL OR {last_code(x)} IS NOT NULL))")


def looks_us(x: str) -> str:
    return f"(NOT {looks_non_us(x)} AND ({names_us(x)} OR {names_state(x)}))"


def explicit_non_us(x: str) -> str:
    c = f"coalesce({code(x)}, {last_code(x)})"
    context = f"({names_us(x)} OR {names_state(x)})"
    return (f"CASE WHEN {currency(x)} THEN TRUE WHEN {has(nloc(x), _FOREIGN)} THEN "
            f"NOT {context} WHEN {inn(c, V.AMBIGUOUS_CODES)} THEN NOT {context} "
            f"ELSE {c} IS NOT NULL END")


def us_preference(x: str) -> str:
    return (f"(contains(lower({x}), 'us only') OR contains(lower({x}), 'u.s. only') OR "
            f"list_contains({words(x)}, 'nyc') OR contains({nloc(x)}, 'new york city') OR "
            f"{inn(nloc(x), V.US_ONLY_NAMES)} OR "
            f"list_has_any({words(x)}, {lst(('us', 'usa') + ABBR)}) OR "
            f"{has(nloc(x), V.US_STATES)})")


# --- years and sizes -----------------------------------------------------------------------

_EXP = r"(?:\s+of\s+experience)?"
_PHRASES = (r"\b(?:minimum|at least)\s+(\d{1,2})\s*\+?\s*(?:years|yrs)\b" + _EXP,
            r"\b(\d{1,2})\s*-\s*\d{1,2}\s*(?:years|yrs)\b" + _EXP,
            r"\b(\d{1,2})\s*\+?\s*(?:years|yrs)\b" + _EXP,
            r"\b(\d{1,2})\s+or\s+more\s+(?:years|yrs)\b" + _EXP)


def years(x: str) -> str:
    lists = []
    for i, p in enumerate(_PHRASES):
        lists.append(
            f"list_filter(list_transform(list_filter(regexp_extract_all({x}, "
            f"'(?s){p}.{{0,12}}'), lambda m: NOT contains(m, 'ago')), lambda m: "
            f"{{'y': CAST(regexp_extract(m, '{p}', 1) AS INTEGER), 'o': {i}, "
            f"'p': regexp_extract(m, '{p}')}}), lambda s: s.y <= 15)")
    for i, (w, n) in enumerate(V.YEAR_WORDS.items(), len(_PHRASES)):
        p = rf"\b(?:minimum|at least)?\s*{w}\s+(?:years|yrs)\b{_EXP}"
        m = f"regexp_extract({x}, '(?s){p}.{{0,12}}')"
        lists.append(f"CASE WHEN {m} <> '' AND NOT contains({m}, 'ago') THEN "
                     f"[{{'y': {n}, 'o': {i}, 'p': regexp_extract({m}, '{p}')}}] ELSE [] END")
    return "list_min(flatten([" + ",\n".join(lists) + "]))"


def size_bucket(n: str) -> str:
    return (f"CASE WHEN {n} < 50 THEN 'tiny' WHEN {n} < 100 THEN 'small' WHEN {n} < 1000 "
            f"THEN 'medium' WHEN {n} < 10000 THEN 'large' ELSE 'enterprise' END")


def safe_number(x: str) -> str:
    return f"TRY_CAST(trim({x}) AS DOUBLE)"


# --- signals ---------------------------------------------------------------------------------

def _family() -> str:
    counts = [f"len({terms('meta', t)})" for t in V.INFERRED_FAMILY_TERMS.values()]
    top = f"greatest({', '.join(counts)})"
    arms = " ".join(f"WHEN {c} = {top} THEN {q(f)}"
                    for f, c in zip(V.INFERRED_FAMILY_TERMS, counts))
    return f"CASE WHEN {top} = 0 THEN 'unknown' {arms} END"


_BELOW = r"\b(?:under|fewer than|less than)\s+{}\s+employees\b"
_COUNT = r"\b(\d{2,6})\+?\s+employees\b"
_SMALL = "list_has_any(tiny, {})".format(lst(
    t for t in V.TINY_COMPANY_SIGNALS if "50" in t or "startup" in t or "seed" in t))
SIGNAL_CTES = JOB_CTES + (
    "s0 AS MATERIALIZED (SELECT *, "
    + nsearch("concat_ws(' ', title, company, location, raw_location, salary_text, description, employment_type)") + " AS meta, "
    + nsearch("concat_ws(' ', title, location, raw_location, description)") + " AS place, "
    + nsearch("concat_ws(' ', location, raw_location)") + " AS country, "
    + nsearch("concat_ws(' ', location, raw_location, salary_text)") + " AS only_text, "
    "location || ' ' || raw_location AS country_raw, "
    "location || ' ' || raw_location || ' ' || salary_text AS only_raw, "
    + nsearch("title") + " AS n_title, " + nsearch("description") + " AS n_desc, "
    + nsearch("title || ' ' || description") + " AS content, "
    + nsearch("title || ' ' || company || ' ' || description") + " AS pref_text, "
    "lower(title || ' ' || description) AS plain, lower(description) AS low_desc, "
    f"CASE WHEN {safe_number('employee_count')} > 0 THEN {safe_number('employee_count')} END AS n_emp "
    "FROM jobs)",
    "s1 AS MATERIALIZED (SELECT *, "
    + terms("meta", V.CONTRACT_TERMS) + " AS contract, "
    + terms("meta", V.UNPAID_TERMS) + " AS unpaid, "
    + "list_sort(" + compact(*[
        f"CASE WHEN regexp_matches(lower(title), '\\b{t}\\.?\\b') THEN {q(t)} END"
        for t in V.SENIOR_TERMS]) + ") AS senior, "
    + terms("n_title", V.JUNIOR_TERMS) + " AS junior, "
    + terms("n_title", V.MANAGER_TERMS) + " AS manager, "
    + terms(nsearch("company"), V.DEFENSE_COMPANIES) + " AS dc, "
    + terms("meta", V.DEFENSE_COMPANIES) + " AS dm, "
    + terms("meta", V.DEFENSE_TERMS) + " AS dk, "
    + terms("meta", V.SPONSORSHIP_POSITIVE_TERMS) + " AS visa, "
    + terms("meta", V.SPONSORSHIP_NEGATIVE_TERMS) + " AS no_visa, "
    + terms("meta", V.TINY_COMPANY_SIGNALS) + " AS tiny, "
    + terms("meta", V.LARGE_COMPANY_SIGNALS) + " AS large, "
    + terms("place", V.REMOTE_TERMS) + " AS remote_l, "
    + terms("place", V.HYBRID_TERMS) + " AS hybrid_l, "
    + terms("place", V.ONSITE_TERMS) + " AS onsite_l, "
    + terms("place", V.BAY_AREA_TERMS) + " AS bay_l, "
    f"({years('low_desc')}) AS yr, {_family()} AS role_family_inferred, "
    f"{looks_us('country_raw')} AS us_text, {looks_non_us('only_raw')} AS non_us, "
    f"{explicit_non_us('only_raw')} AS has_explicit_non_us_location_signal, "
    "(contains(place, ' california ') OR contains(country, ' ca us ') OR "
    "contains(country, ' ca usa ')) AS cal FROM s0)",
    "s2 AS MATERIALIZED (SELECT *, list_concat(dc, list_concat(list_filter(dm, lambda x: "
    "NOT list_contains(dc, x)), dk)) AS defense, len(remote_l) > 0 AS is_remote, "
    "us_text AND NOT non_us AS is_us_location, "
    + has("place", sorted({search_term(t) for t in V.US_REMOTE_TERMS}))
    + " AS is_us_remote_location, "
    + any_term("only_text", V.REMOTE_TERMS) + " AS is_explicit_remote_location, "
    "len(hybrid_l) > 0 AS is_hybrid, len(bay_l) > 0 AS is_bay_area, "
    "cal OR len(bay_l) > 0 AS is_california, "
    "CASE WHEN location = '' OR lower(location) = 'unknown' OR location_source = 'unknown' "
    "THEN 'low' WHEN location_source = 'job_posting_location' THEN 'high' WHEN "
    "location_source IN ('raw_location_field', 'description_inferred') THEN 'medium' WHEN "
    "location_source IN ('company_location_if_only_available', 'ambiguous_location') THEN "
    "'low' ELSE 'medium' END AS location_confidence, "
    f"CASE WHEN n_emp IS NOT NULL THEN {size_bucket('n_emp')} "
    f"WHEN regexp_matches(meta, '{_BELOW.format('50')}') THEN 'tiny' "
    f"WHEN regexp_matches(meta, '{_BELOW.format('100')}') THEN 'small' "
    f"WHEN regexp_matches(meta, '{_COUNT}') THEN "
    + size_bucket(f"CAST(regexp_extract(meta, '{_COUNT}', 1) AS DOUBLE)")
    + f" WHEN len(tiny) > 0 THEN CASE WHEN {_SMALL} THEN 'tiny' ELSE 'small' END "
    f"WHEN len(large) > 0 THEN CASE WHEN list_has_any(large, {lst(V.ENTERPRISE_SIGNALS)}) "
    "THEN 'enterprise' ELSE 'large' END ELSE 'Unknown' END AS company_size_inferred, "
    f"CASE WHEN n_emp IS NOT NULL THEN 'high' WHEN regexp_matches(meta, "
    f"'{_BELOW.format('(?:50|100)')}') THEN 'low' WHEN regexp_matches(meta, '{_COUNT}') "
    "THEN 'medium' ELSE 'low' END AS company_size_confidence, "
    f"CASE WHEN n_emp IS NOT NULL THEN employee_count "
    f"WHEN regexp_matches(meta, '{_BELOW.format('50')}') THEN regexp_extract(meta, '{_BELOW.format('50')}') "
    f"WHEN regexp_matches(meta, '{_BELOW.format('100')}') THEN regexp_extract(meta, '{_BELOW.format('100')}') "
    f"WHEN regexp_matches(meta, '{_COUNT}') THEN regexp_extract(meta, '{_COUNT}') "
    f"WHEN len(tiny) > 0 THEN {join('tiny')} ELSE {join('large')} END AS company_size_match_text, "
    "CASE WHEN len(unpaid) > 0 THEN 'unpaid_or_commission' WHEN len(contract) > 0 THEN "
    "'contract_or_temp' WHEN contains(meta, ' internship ') OR contains(meta, ' intern ') "
    "THEN 'internship' WHEN contains(meta, ' part time ') THEN 'part_time' WHEN "
    "contains(meta, ' full time ') THEN 'full_time' ELSE 'Unknown' END "
    "AS employment_type_inferred FROM s1)",
    "sig AS MATERIALIZED (SELECT *, yr.y AS required_years_min, "
    "coalesce(yr.p, 'Unknown') AS years_requirement_text, "
    "len(contract) > 0 AS is_contract_or_temp, len(unpaid) > 0 AS is_unpaid_or_commission, "
    f"{join('contract')} AS contract_temp_text, {join('unpaid')} AS unpaid_commission_text, "
    "len(senior) > 0 AS is_senior_staff_principal, len(junior) > 0 AS is_junior_entry_level, "
    "len(manager) > 0 AS is_manager_director, "
    f"len(defense) > 0 AS is_defense_military_clearance, {join('defense')} AS defense_match_text, "
    "company_size_inferred = 'tiny' AS is_tiny_startup, company_size_inferred = 'small' AS "
    "is_small_company, company_size_inferred = 'medium' AS is_medium_company, "
    "company_size_inferred = 'large' AS is_large_company, company_size_inferred = "
    "'enterprise' AS is_enterprise_company, len(visa) > 0 AS has_visa_sponsorship_signal, "
    "len(no_visa) > 0 AS has_no_sponsorship_signal, is_california OR is_bay_area AS "
    "is_california_or_bay_area, "
    "NOT lower(trim(location)) IN ('', 'unknown') AND NOT is_us_location AND NOT "
    f"{inn(nloc('country_raw'), V.REMOTE_ONLY_LOCATIONS)} AND "
    "(has_explicit_non_us_location_signal OR non_us OR NOT is_remote) AS is_non_us_location "
    "FROM s2)",
)


# --- profiles ---------------------------------------------------------------------------------

def keywords(x: str, seps: str = "[,;\\n]+") -> str:
    return (f"list_filter(list_transform(regexp_split_to_array(lower({x}), '{seps}'), "
            f"lambda p: trim(p)), lambda p: p <> '')")


def roles(x: str) -> str:
    return keywords(x, "[,;/\\n]+")


def family(x: str) -> str:
    arms = " ".join(f"WHEN {any_term(nsearch(x), t)} THEN {q(f)}"
                    for f, t in V.ROLE_TARGET_TERMS.items())
    return (f"CASE WHEN {any_term(nsearch(x), V.ROLE_TARGET_TERMS['mlops_infra'])} "
            f"THEN 'mlops_infra' {arms} ELSE 'general' END")


def _profile_rows() -> str:
    rows = []
    for p in X.DEMO_PROFILES:
        years_max = "NULL" if p.max_required_years is None else str(p.max_required_years)
        rows.append(
            f"SELECT {q(p.profile_id)} AS profile_id, {q(p.target_role)} AS target_role, "
            f"{lst(p.skills)} AS skills, {q(p.preferred_location)} AS pref, "
            f"{p.minimum_salary} AS min_salary, {lst(p.dealbreakers)} AS breakers, "
            f"{q(p.role_fit_strictness)} AS fit_strict, {q(p.location_strictness)} AS loc_strict, "
            f"{q(p.seniority_preference)} AS seniority, CAST({years_max} AS INTEGER) AS max_years, "
            f"{p.avoid_contract} AS no_contract, {p.avoid_unpaid} AS no_unpaid, "
            f"{p.avoid_internship} OR {inn(q(p.seniority_preference), V.AVOIDS_INTERNSHIP)} AS no_intern, "
            f"{p.avoid_defense} AS no_defense, {q(p.visa_sponsorship)} AS visa_pref, "
            f"{q(p.company_preference)} AS company_pref, {q(p.company_size_preference)} AS size_pref, "
            f"{q(p.salary_strictness)} AS pay_strict")
    return " UNION ALL ".join(rows)


def profile_cte(rows: str) -> str:
    """Profiles with what the rules derive from them."""
    return (
        f"prof AS (SELECT *, {roles('target_role')} AS roles, {family('target_role')} AS family, "
        f"{nloc('pref')} AS np, {us_preference('pref')} AS wants_us, "
        f"contains({nloc('pref')}, 'remote') AS wants_remote, "
        f"contains({nloc('pref')}, 'bay area') AS wants_bay, "
        f"contains({nloc('pref')}, 'california') OR contains(' ' || {nloc('pref')} || ' ', ' ca ') "
        f"AS wants_cal FROM ({rows}))")


PROFILES = profile_cte(_profile_rows())


def _by_family(text: str, table: dict) -> str:
    arms = " ".join(f"WHEN family = {q(f)} THEN {terms(text, t)}" for f, t in table.items())
    return f"CASE {arms} ELSE CAST([] AS VARCHAR[]) END"


def _by_company(table: dict) -> str:
    arms = " ".join(f"WHEN company_pref = {q(f)} THEN {terms('pref_text', t)}"
                    for f, t in table.items())
    return f"CASE {arms} ELSE CAST([] AS VARCHAR[]) END"


def rule(*parts: tuple[str, str, str]) -> str:
    """Struct (points, reasons) of the parts whose condition holds."""
    total = " + ".join(f"(CASE WHEN {c} THEN {v} ELSE 0 END)" for c, v, _ in parts)
    texts = compact(*[f"CASE WHEN {c} THEN {r} END" for c, _, r in parts])
    return f"{{'points': {total}, 'reasons': {texts}}}"


def first(*parts: tuple[str, int, str]) -> str:
    p = " ".join(f"WHEN {c} THEN {v}" for c, v, _ in parts)
    r = " ".join(f"WHEN {c} THEN {t if t == 'NULL' else f'[{t}]'}" for c, _, t in parts)
    return (f"{{'points': CASE {p} ELSE 0 END, 'reasons': "
            f"coalesce(CASE {r} ELSE NULL END, CAST([] AS VARCHAR[]))}}")


def _l(x: str, n: int | None = None) -> str:
    return join(f"{x}[1:{n}]" if n else x)


_TR = "Target role relevance: "
_ROLE = rule(
    ("len(roles) > 0 AND len(r_title) > 0", "40", f"'{_TR}+40 title match: ' || {_l('r_title')}"),
    ("len(roles) > 0 AND len(r_title) = 0 AND len(r_rel) > 0", "20",
     f"'{_TR}+20 related title terms: ' || {_l('r_rel')}"),
    ("len(roles) > 0 AND len(r_title) = 0 AND len(r_rel) = 0", "0",
     f"'{_TR}+0 not directly found in title'"),
    ("len(ml) > 0", "least(35, 5 * len(ml))",
     f"'{_TR}+' || least(35, 5 * len(ml)) || ' ML/applied science terms: ' || {_l('ml', 6)}"),
    ("ml_role AND len(ml) = 0 AND len(r_title) = 0", "-25",
     f"'{_TR}-25 no ML/applied science evidence found'"))
_SKILL = rule(
    ("len(sk) > 0", "least(40, 10 * len(sk))",
     f"'Matched skills: +' || least(40, 10 * len(sk)) || ' overlap: ' || {_l('sk')}"),
    ("len(sk) = 0 AND len(skills) > 0", "0",
     "'Matched skills: +0 no listed skills found in posting'"))
_SPECIAL = inn("family", V.SPECIALIST_FAMILIES)
_FIT = ("CASE WHEN family = 'general' THEN {'points': 0, 'reasons': "
        "['Role fit: +0 no specialized role family detected']} ELSE " + rule(
            ("len(f_title) > 0", "least(50, 25 + 5 * len(f_title))",
             "'Role fit: +' || least(50, 25 + 5 * len(f_title)) || ' ' || family || "
             f"' title terms: ' || {_l('f_title', 5)}"),
            ("len(f_content) > 0", "least(35, 7 * len(f_content))",
             "'Role fit: +' || least(35, 7 * len(f_content)) || ' ' || family || "
             f"' content terms: ' || {_l('f_content', 6)}"),
            ("len(f_neg) > 0", "-least(60, 30 + 10 * (len(f_neg) - 1))",
             "'Role fit: -' || least(60, 30 + 10 * (len(f_neg) - 1)) || "
             f"' weak/unrelated terms: ' || {_l('f_neg', 6)}"),
            (f"{_SPECIAL} AND len(training) > 0", "-120",
             f"'Role fit: -120 course/training/evaluator title: ' || {_l('training', 5)}"),
            (f"{_SPECIAL} AND len(generic) > 0 AND len(f_title) = 0", "-70",
             "'Role fit: -70 generic software title without target-role evidence: ' || "
             f"{_l('generic', 5)}"),
            ("len(f_found) = 0", "-35",
             "'Role fit: -35 no clear ' || family || ' evidence'")) + " END")
_WHY = join(compact("CASE WHEN wants_us THEN 'US preference' END",
                    "CASE WHEN wants_remote THEN 'remote preference' END",
                    "CASE WHEN wants_bay THEN 'Bay Area preference' END",
                    "CASE WHEN wants_cal THEN 'California preference' END",
                    "CASE WHEN NOT (wants_us OR wants_remote OR wants_bay OR wants_cal) "
                    "THEN 'text location preference' END"), " / ")
_MATCH = ("CASE WHEN wants_us OR wants_remote OR wants_bay OR wants_cal THEN "
          "(wants_us AND is_us_location) OR (wants_remote AND is_remote) OR (wants_bay AND "
          "is_bay_area) OR (wants_cal AND is_california) ELSE "
          f"contains({nloc(chr(39).join(['raw_location || ', ' ', ' || location']))}, np) END")
_EXCL = (f"{{'ok': FALSE, 'why': 'FAIL: strict location filter excludes clear non-US location "
         f"for ' || {_WHY} || '.'}}")
_ALLOW = ("{'ok': TRUE, 'why': 'PASS: strict US preference allowed explicit US-remote "
          "location.'}")
_LOCPASS = (
    "CASE WHEN pref = '' THEN {'ok': TRUE, 'why': 'No location preference entered.'} "
    "WHEN loc_strict = 'Strict' AND wants_us AND is_non_us_location AND is_us_remote_location "
    f"THEN {_ALLOW} WHEN loc_strict = 'Strict' AND wants_us AND is_non_us_location THEN {_EXCL} "
    f"WHEN {_MATCH} THEN {{'ok': TRUE, 'why': 'PASS: matched ' || {_WHY} || '.'}} "
    f"WHEN loc_strict = 'Strict' AND wants_us AND is_us_remote_location THEN {_ALLOW} "
    "WHEN location_source = 'unknown' AND NOT is_non_us_location THEN {'ok': TRUE, 'why': "
    "'PASS: location unknown, not failed automatically.'} "
    f"WHEN loc_strict = 'Strict' AND is_non_us_location THEN {_EXCL} "
    "WHEN loc_strict = 'Flexible' THEN {'ok': TRUE, 'why': 'PASS: Flexible location strictness "
    "allows broader exploration.'} "
    f"ELSE {{'ok': FALSE, 'why': 'FAIL: did not match ' || {_WHY} || '.'}} END")


def _lp(text: str) -> str:
    return f"'Location preference: {text}. ' || lc.why"


_LOC = first(
    ("pref = ''", 0, "NULL"), ("wants_remote AND is_remote", 25, _lp("+25 remote match")),
    ("wants_bay AND is_bay_area", 25, _lp("+25 Bay Area match")),
    ("contains(np, 'california') AND is_california", 20, _lp("+20 California match")),
    ("wants_us AND is_us_location", 15, _lp("+15 US match")),
    ("lc.ok AND location_confidence = 'low'", 0, _lp("+0 low-confidence/unknown location")),
    ("lc.ok", 10, _lp("+10 location allowed")),
    ("loc_strict = 'Strict'", -45, _lp("-45 strict location mismatch")),
    ("TRUE", -20, _lp("-20 location mismatch")))
_SAL = first(("min_salary > 0 AND salary_number >= min_salary", 15,
              "'Salary fit: +15 appears to meet minimum'"),
             ("min_salary > 0", 0, "'Salary fit: +0 unknown or below minimum'"))
_GROUPED = V.SENIOR_DEALBREAKERS + V.DEFENSE_DEALBREAKERS + V.YEARS_DEALBREAKERS
_DB = rule(
    (f"list_has_any(breakers, {lst(V.SENIOR_DEALBREAKERS)}) AND len(senior) > 0", "-60",
     f"'Dealbreaker penalty: -60 seniority in title: ' || {_l('senior')}"),
    ("len(db_def) > 0", "-60",
     f"'Dealbreaker penalty: -60 defense/military terms: ' || {_l('db_def')}"),
    (f"list_has_any(breakers, {lst(V.YEARS_DEALBREAKERS)}) AND regexp_matches(low_desc, "
     "'\\b[5-9]\\+?\\s*years\\b|\\bfive\\s+years\\b|\\bsix\\s+years\\b|\\bseven\\s+years\\b')",
     "-35", "'Dealbreaker penalty: -35 5+ years or more mentioned'"),
    ("len(db_other) > 0", "-25 * len(db_other)",
     f"'Dealbreaker penalty: -' || (25 * len(db_other)) || ' found: ' || {_l('db_other')}"))
_ABOVE = "(is_senior_staff_principal OR is_manager_director)"
_ENTRY = ("(is_junior_entry_level OR contains(n_title, ' analyst ') OR contains(n_title, "
          "' associate ') OR contains(n_title, ' early career ') OR "
          "regexp_matches(lower(title), '\\b(?:i|ii|1|2)\\b'))")


def _sen(name: str, cond: str, points: int, text: str) -> tuple[str, int, str]:
    return (f"seniority = {q(name)} AND {cond}", points,
            f"'Seniority preference: {points:+d} {text}'")


_SEN = first(
    _sen(V.ENTRY_ONLY, _ABOVE, -90, "excludes senior/manager roles"),
    _sen(V.ENTRY_ONLY, _ENTRY, 25, "entry-level/new grad signal"),
    _sen(V.ENTRY_ONLY, "TRUE", -15, "no clear entry-level signal"),
    _sen(V.JUNIOR_TO_MID, _ABOVE, -70, "senior/manager role"),
    _sen(V.JUNIOR_TO_MID, _ENTRY, 15, "junior/mid-level signal"),
    _sen(V.JUNIOR_TO_MID, "TRUE", 5, "no seniority conflict"),
    _sen(V.MID_TO_SENIOR, "is_junior_entry_level", -80, "junior/entry-level role"),
    _sen(V.MID_TO_SENIOR, "TRUE", 5, "mid/senior-compatible role"),
    _sen(V.SENIOR_PREFERRED, "is_senior_staff_principal", 25, "senior/staff/principal signal"),
    _sen(V.SENIOR_PREFERRED, "is_junior_entry_level", -45, "junior/entry-level role"),
    _sen(V.SENIOR_PREFERRED, "TRUE", -5, "no senior+ signal"),
    _sen(V.EXCLUDE_SENIOR, _ABOVE, -120, "excluded senior/manager role"),
    _sen(V.EXCLUDE_JUNIOR, "is_junior_entry_level", -100, "excluded junior/entry-level role"))
_SHOWN = "coalesce(nullif(company_size_match_text, ''), company_size_inferred)"
_BIG = "(is_large_company OR is_enterprise_company)"
_LITTLE = "(is_tiny_startup OR is_small_company)"


def _siz(name: str, cond: str, points: int, text: str, shown: bool = True):
    tail = f" || {_SHOWN}" if shown else ""
    return (f"size_pref = {q(name)} AND {cond}", points,
            f"'Company size: {points:+d} {text}{': ' if shown else ''}'{tail}")


_SIZE = first(
    _siz(V.PREFER_SMALL, _LITTLE, 12, "small-company signal"),
    _siz(V.PREFER_SMALL, _BIG, -8, "larger-company signal", False),
    _siz(V.PREFER_MEDIUM, "is_medium_company", 12, "medium-company signal"),
    _siz(V.PREFER_MEDIUM, "is_tiny_startup", -10, "tiny-startup signal", False),
    _siz(V.PREFER_LARGE, _BIG, 18, "large/enterprise signal"),
    _siz(V.PREFER_LARGE, _LITTLE, -15, "tiny/small signal"),
    _siz(V.EXCLUDE_TINY, "is_tiny_startup", -100, "excluded tiny startup"),
    _siz(V.LARGE_ONLY, _BIG, 15, "large/enterprise signal"),
    _siz(V.LARGE_ONLY, _LITTLE, -120, "not large-company compatible"))


def _adv(text: str, terms_: str, n: int | None = None) -> str:
    return f"'Advanced filter: {text}: ' || {_l(terms_, n)}"


_PAY = "CASE pay_strict WHEN 'Medium' THEN 25 WHEN 'Strict' THEN 80 ELSE 10 END"
_EARLY = rule(
    ("required_years_min > max_years", "-45",
     "'Advanced filter: -45 requires ' || required_years_min || '+ years over ' || max_years || "
     "'-year maximum'"),
    ("no_contract AND is_contract_or_temp", "-80", _adv("-80 contract/temp terms", "contract")),
    ("no_unpaid AND is_unpaid_or_commission", "-90",
     _adv("-90 unpaid/commission-only terms", "unpaid")),
    ("no_defense AND is_defense_military_clearance", "-55",
     _adv("-55 defense/military terms", "defense")))
_LATE = rule(
    ("visa_pref = 'Sponsorship required' AND len(visa) > 0", "10",
     _adv("+10 sponsor-friendly terms", "visa", 4)),
    ("visa_pref = 'Sponsorship required' AND len(no_visa) > 0", "-50",
     _adv("-50 sponsorship-negative terms", "no_visa", 3)),
    ("visa_pref = 'Sponsorship required' AND len(contract) > 0", "-20",
     _adv("-20 contract/temp less sponsor-friendly", "contract", 3)),
    ("visa_pref = 'Prefer sponsor-friendly' AND len(visa) > 0", "8",
     _adv("+8 sponsor-friendly terms", "visa", 4)),
    ("len(bonus) > 0", "12", _adv("+12 company preference match", "bonus", 5)),
    ("len(malus) > 0", "-25", _adv("-25 company preference mismatch", "malus", 5)),
    ("min_salary > 0 AND salary_number > 0 AND salary_number < min_salary", f"-({_PAY})",
     f"'Advanced filter: -' || ({_PAY}) || ' salary below minimum with ' || pay_strict || ' strictness'"),
    ("min_salary > 0 AND salary_number <= 0 AND pay_strict = 'Medium'", "-10",
     "'Advanced filter: -10 salary unknown with Medium strictness'"))
_AVOID = inn("seniority", V.AVOIDS_SENIOR)
_PASSES = {
    "passes_years_filter": "coalesce(required_years_min <= max_years, TRUE)",
    "passes_contract_filter": "NOT (no_contract AND is_contract_or_temp)",
    "passes_unpaid_filter": "NOT (no_unpaid AND is_unpaid_or_commission)",
    "passes_seniority_filter": f"NOT (({_AVOID} AND {_ABOVE}) OR "
    f"({inn('seniority', V.AVOIDS_JUNIOR)} AND is_junior_entry_level))",
    "passes_manager_filter": f"NOT ({_AVOID} AND is_manager_director)",
    "passes_internship_filter": "NOT (no_intern AND employment_type_inferred = 'internship')",
    "passes_salary_filter": "NOT (min_salary > 0 AND pay_strict = 'Strict' AND "
    "salary_number > 0 AND salary_number < min_salary)",
    "passes_defense_filter": "NOT (no_defense AND is_defense_military_clearance)",
    "passes_company_size_filter": f"NOT ((size_pref = {q(V.EXCLUDE_TINY)} AND is_tiny_startup) "
    f"OR (size_pref = {q(V.LARGE_ONLY)} AND {_LITTLE}))",
    "passes_role_fit_filter": "NOT (fit_strict = 'Strict' AND role_fit_score < 0)",
}
_ALL = "(loc_strict <> 'Strict' OR lc.ok) AND " + " AND ".join(_PASSES.values())
_ACTIVE = join(compact(
    "CASE WHEN max_years IS NOT NULL THEN 'max_required_years' END",
    "CASE WHEN min_salary > 0 THEN 'minimum_salary' END",
    "CASE WHEN no_contract THEN 'avoid_contract_temp' END",
    "CASE WHEN no_unpaid THEN 'avoid_unpaid_commission' END",
    f"CASE WHEN seniority <> {q(V.NO_PREFERENCE)} THEN 'seniority_preference' END",
    "CASE WHEN no_intern THEN 'avoid_internship' END",
    "CASE WHEN no_defense THEN 'avoid_defense_military' END",
    f"CASE WHEN {inn('size_pref', (V.EXCLUDE_TINY, V.LARGE_ONLY))} THEN 'company_size_preference' END",
    "CASE WHEN loc_strict = 'Strict' THEN 'strict_location' END",
    "CASE WHEN fit_strict = 'Strict' THEN 'strict_role_fit' END"))
_SFIT = first(
    ("fit_strict = 'Balanced' AND role_fit_score < 10", 20,
     "'-20 role fit strictness penalty: weak match for target role'"),
    ("fit_strict = 'Strict' AND role_fit_score < 0", 60,
     "'-60 role fit strictness penalty: poor match for target role'"),
    ("fit_strict = 'Strict' AND role_fit_score < 15", 40,
     "'-40 role fit strictness penalty: weak match for target role'"))
PAIR_CTES = SIGNAL_CTES + (PROFILES,
    "pr0 AS MATERIALIZED (SELECT sig.*, prof.* FROM sig, prof)",
    "pr1 AS MATERIALIZED (SELECT *, list_filter(roles, lambda r: contains(n_title, r)) AS r_title, "
    "list_filter(roles, lambda r: len(list_filter(string_split(r, ' '), lambda w: length(w) > 2 "
    f"AND NOT list_contains({lst(V.GENERIC_ROLE_WORDS)}, w) AND contains(n_title, w))) > 0) AS r_rel, "
    f"len(list_filter(roles, lambda r: list_contains({lst(V.ML_ROLE_HINTS)}, r) OR "
    "contains(r, 'machine learning'))) > 0 AS ml_role, "
    "list_filter(skills, lambda s: contains(plain, s)) AS sk, "
    f"{_by_family('n_title', V.ROLE_POSITIVE_TERMS)} AS f_title, "
    f"{_by_family('content', V.ROLE_POSITIVE_TERMS)} AS f_found, "
    f"{_by_family('content', V.ROLE_NEGATIVE_TERMS)} AS f_neg, "
    f"{terms('n_title', V.TRAINING_TITLE_TERMS)} AS training, "
    f"{terms('n_title', V.GENERIC_SOFTWARE_TITLES)} AS generic, "
    f"CASE WHEN list_has_any(breakers, {lst(V.DEFENSE_DEALBREAKERS)}) THEN " + compact(*[
        f"CASE WHEN contains(n_title || ' ' || n_desc, {q(search_term(t))}) THEN {q(t)} END"
        for t in sorted(V.DEFENSE_TERMS)]) + " ELSE CAST([] AS VARCHAR[]) END AS db_def, "
    f"list_filter(breakers, lambda b: NOT list_contains({lst(_GROUPED)}, b) AND "
    "contains(n_title || ' ' || n_desc, b)) AS db_other, "
    f"{_by_company(V.COMPANY_PREFERENCE_BONUS)} AS bonus, "
    f"{_by_company(V.COMPANY_PREFERENCE_PENALTY)} AS malus, {_LOCPASS} AS lc FROM pr0)",
    "pr2 AS (SELECT *, list_filter(f_found, lambda t: NOT list_contains(f_title, t)) AS f_content, "
    "CASE WHEN ml_role THEN list_sort(list_transform(list_filter("
    f"{lst(V.ML_RELEVANCE_TERMS)}, lambda t: contains(content, t)), lambda t: trim(t))) ELSE "
    "CAST([] AS VARCHAR[]) END AS ml FROM pr1)",
    f"pr3 AS MATERIALIZED (SELECT *, {_ROLE} AS role_p, {_SKILL} AS skill_p, {_LOC} AS loc_p, "
    f"{_SAL} AS sal_p, {_DB} AS db_p, {_SEN} AS sen_p, {_EARLY} AS early_p, {_SIZE} AS size_p, "
    f"{_LATE} AS late_p, {_FIT} AS fit_p FROM pr2)",
    "pr4 AS (SELECT *, sen_p.points + early_p.points + size_p.points + late_p.points AS adv_points, "
    "list_concat(list_concat(sen_p.reasons, early_p.reasons), list_concat(size_p.reasons, "
    "late_p.reasons)) AS adv_reasons, fit_p.points AS role_fit_score FROM pr3)",
    "pr5 AS (SELECT *, role_p.points + skill_p.points + loc_p.points + sal_p.points + "
    f"db_p.points + adv_points AS score, {join('sk')} AS matched_skills, lc.ok AS "
    "passes_location_filter, lc.why AS location_filter_reason, "
    + ", ".join(f"{v} AS {k}" for k, v in _PASSES.items()) + f", {_ALL} AS "
    "passes_all_active_constraints, "
    f"CASE WHEN {_ACTIVE} = '' THEN 'None' ELSE {_ACTIVE} END AS active_constraint_filters, "
    f"CASE WHEN {_ALL} THEN 0 ELSE 500 END AS active_constraint_penalty, {_SFIT} AS sf_p, "
    f"{join('fit_p.reasons', '; ')} AS role_fit_reason FROM pr4)",
)


def scored_ctes(similarity: str = "0.0", source: str = "pr5") -> tuple[str, ...]:
    """CTEs up to ``scored``; ``source`` must give the similarity expression."""
    bonus = f"(round_even(CAST({similarity} AS DOUBLE) * 30 * 100, 0) / 100)"
    rules = ("list_concat(list_concat(list_concat(role_p.reasons, skill_p.reasons), "
             "list_concat(loc_p.reasons, sal_p.reasons)), list_concat(db_p.reasons, adv_reasons))")
    return PAIR_CTES + (
        f"sc0 AS MATERIALIZED (SELECT *, CAST({similarity} AS DOUBLE) AS embedding_similarity, "
        f"{bonus} AS embedding_bonus, sf_p.points AS role_fit_strictness_penalty, "
        f"{join('sf_p.reasons', '; ')} AS role_fit_strictness_reason, {rules} AS all_reasons "
        f"FROM {source})",
        "scored AS MATERIALIZED (SELECT *, round_even((score + role_fit_score + embedding_bonus - "
        "role_fit_strictness_penalty - active_constraint_penalty) * 100, 0) / 100 AS final_score, "
        "printf('Embedding similarity contribution: +%.2f (similarity %.3f). ', embedding_bonus, "
        "embedding_similarity) || role_fit_reason || '. ' || CASE WHEN "
        "role_fit_strictness_reason <> '' THEN role_fit_strictness_reason || '. ' ELSE '' END || "
        "CASE WHEN active_constraint_penalty > 0 THEN 'Active constraint penalty: -500 failed one "
        "or more active filters. ' ELSE '' END || CASE WHEN len(all_reasons) = 0 THEN "
        "'No preferences entered yet, so this job keeps a neutral score.' ELSE "
        f"{join('all_reasons', '; ')} END AS explanation FROM sc0)")


RANK = ("row_number() OVER (PARTITION BY profile_id ORDER BY passes_all_active_constraints DESC, "
        "final_score DESC, role_fit_score DESC, score DESC, embedding_similarity DESC, "
        "salary_number DESC, title, row_index)")
