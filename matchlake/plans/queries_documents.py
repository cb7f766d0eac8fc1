"""Queries over candidate documents with headed sections."""

from __future__ import annotations

from pyspark.sql import functions as F

from matchlake import vocab as V
from matchlake.functions import documents as D
from matchlake.operators import documents as W
from matchlake.operators.order import materialise
from matchlake.operators.ranking import RANK_ORDER, display_select, rank_jobs
from matchlake.plans import fixtures as X
from matchlake.plans import sql as S
from matchlake.plans.catalog import query

LINES = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]"
RESUMES = (f"res AS MATERIALIZED (SELECT doc_id, {X.RESUME_TEXT} AS text, {X.case('doc_id', X.SKILL_TEXTS)} AS "
           f"skills_text, {X.case('doc_id', X.ROLES)} AS target_role FROM documents)")
LINE_CTES = (RESUMES, (
    "raw AS (SELECT doc_id, unnest(l) AS line0, unnest(range(len(l))) AS n FROM (SELECT doc_id, "
    f"regexp_split_to_array(text, '{LINES}') AS l FROM res))"),
    f"lines AS MATERIALIZED (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY n) - 1 AS line_no, "
    f"{S.ws('line0')} AS line FROM raw WHERE {S.ws('line0')} <> '')",
    f"plain AS MATERIALIZED (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY n) - 1 AS line_no, "
    f"{S.strip('line0')} AS line FROM raw WHERE {S.strip('line0')} <> '')")


@query("doc_lines", S.with_(*LINE_CTES, select=(
    "SELECT doc_id, CAST(line_no AS INTEGER) AS line_no, line FROM lines")))
def doc_lines(spark, sf):
    return W.doc_lines(X.resumes(spark, sf))


_NORM = "trim(regexp_replace(lower(line), '[^a-z ]+', '', 'g'))"
_HEAD = "CASE " + " ".join(
    f"WHEN {_NORM} = '{h.lower()}' OR starts_with({_NORM}, '{h.lower()} ') THEN '{h}'"
    for h in sorted(V.PREVIEW_HEADINGS, key=len, reverse=True)) + " END"
SECTION_CTES = LINE_CTES + (
    f"headed AS (SELECT *, {_HEAD} AS heading FROM plain)",
    "filled AS (SELECT *, last_value(heading IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line_no) AS "
    "section FROM headed)",
    "bodies AS (SELECT doc_id, line_no, section, CASE WHEN heading IS NULL THEN line ELSE "
    "trim(regexp_replace(line, '(?i)^\\s*' || heading || '\\s*:?\\s*', '')) END AS part, heading FROM filled "
    "WHERE section IS NOT NULL)",
    "sections AS MATERIALIZED (SELECT doc_id, section, coalesce(string_agg(part, chr(10) ORDER BY line_no) "
    "FILTER (heading IS NULL OR part <> ''), '') AS body FROM bodies GROUP BY ALL)")


@query("doc_sections", S.with_(*SECTION_CTES, select="SELECT * FROM sections"))
def doc_sections(spark, sf):
    return W.doc_sections(X.resumes(spark, sf))


def _first(headings) -> str:
    arms = ", ".join(f"nullif(max(body) FILTER (section = '{h}'), '')" for h in headings)
    return f"coalesce({arms}, '')"


@query("doc_section_first", S.with_(*SECTION_CTES, select=(
    f"SELECT doc_id, {_first(V.SUMMARY_HEADINGS)} AS summary, {_first(V.SKILLS_HEADINGS)} AS skills, "
    f"{_first(V.EXPERIENCE_HEADINGS)} AS experience FROM (SELECT doc_id, section, body FROM sections UNION ALL "
    "SELECT doc_id, '', '' FROM res) GROUP BY doc_id")))
def doc_section_first(spark, sf):
    df = X.resumes(spark, sf).select("doc_id", D.headed_sections(F.col("text")).alias("m"))
    return df.select("doc_id", *[D.first_section(F.col("m"), h).alias(n) for n, h in (
        ("summary", V.SUMMARY_HEADINGS), ("skills", V.SKILLS_HEADINGS),
        ("experience", V.EXPERIENCE_HEADINGS))])


def _heading(x: str) -> str:
    return (f"trim(regexp_replace(regexp_replace(lower(rtrim({S.strip(x)}, ':')), '[^a-z0-9 /+-]+', '', 'g'), "
            "'\\s+', ' ', 'g'))")


_KNOWN = S.inn(_heading("line"), V.SEMANTIC_SECTIONS + V.SEMANTIC_EXCLUDED)
_INLINE = (f"CASE WHEN contains(line, ':') AND {S.inn(_heading(chr(39).join(['split_part(line, ', ':', ', 1)'])), V.SEMANTIC_SECTIONS + V.SEMANTIC_EXCLUDED)} "
           f"THEN {_heading(chr(39).join(['split_part(line, ', ':', ', 1)']))} END")
_IS = f"({_KNOWN} OR (length(line) <= 40 AND line LIKE '%:'))"
_NEG = ("regexp_matches(regexp_replace(lower({0}), '^[^a-z0-9]+', ''), '^(?:" + "|".join(V.NEGATIVE_LINE_STARTS)
        + ")')")
_REST = "trim(regexp_replace({0}, '^[^:]*:', ''))"
HEADING_CTES = LINE_CTES + (
    f"hd AS MATERIALIZED (SELECT *, {_INLINE} AS inl, CASE WHEN {_IS} THEN {_heading('line')} END AS own, {_IS} "
    f"AS is_heading, {_NEG.format('line')} AS is_negative FROM lines)",)


@query("doc_headings", S.with_(*HEADING_CTES, select=(
    "SELECT doc_id, CAST(line_no AS INTEGER) AS line_no, coalesce(inl, own, '') AS heading, is_heading, "
    f"coalesce(inl, '') AS inline_section, CASE WHEN inl IS NOT NULL THEN {_REST.format('line')} ELSE line END "
    "AS inline_content, is_negative FROM hd")))
def doc_headings(spark, sf):
    return W.doc_headings(X.resumes(spark, sf))


@query("doc_negative_line", S.with_(*LINE_CTES, select=(
    f"SELECT doc_id, count(*) FILTER ({_NEG.format('line')}) AS n FROM lines GROUP BY doc_id")))
def doc_negative_line(spark, sf):
    return W.doc_lines(X.resumes(spark, sf)).groupBy("doc_id").agg(
        F.count_if(D.negative_line(F.col("line"))).alias("n"))


_REL = S.lst(V.SEMANTIC_SECTIONS)
SEMANTIC = HEADING_CTES + (
    "act AS (SELECT *, coalesce(last_value(coalesce(inl, own) IGNORE NULLS) OVER w, '') AS active, "
    f"coalesce(bool_or(list_contains({_REL}, coalesce(inl, own))) OVER w, FALSE) AS found FROM hd WINDOW w AS "
    "(PARTITION BY doc_id ORDER BY line_no))",
    f"keep AS (SELECT doc_id, line_no, CASE WHEN inl IS NOT NULL THEN {_REST.format('line')} ELSE line END AS t "
    f"FROM act WHERE CASE WHEN inl IS NOT NULL THEN list_contains({_REL}, inl) AND {_REST.format('line')} <> '' "
    f"AND NOT {_NEG.format(_REST.format('line'))} WHEN own IS NOT NULL THEN FALSE WHEN is_negative THEN FALSE WHEN "
    f"list_contains({S.lst(V.SEMANTIC_EXCLUDED)}, active) THEN FALSE WHEN found AND NOT list_contains({_REL}, "
    "active) THEN FALSE ELSE TRUE END)")


@query("doc_semantic_text", S.with_(*SEMANTIC, select=(
    "SELECT r.doc_id, coalesce((SELECT string_agg(t, chr(10) ORDER BY line_no) FROM keep k WHERE k.doc_id = "
    "r.doc_id), '') AS text FROM res r")))
def doc_semantic_text(spark, sf):
    return X.resumes(spark, sf).select("doc_id", D.semantic_text(F.col("text")).alias("text"))


_PERSONA = r"regexp_matches(line, '(?i)^persona(?:\s+\d+)?\b')"
_EV_KNOWN = V.EVIDENCE_SECTIONS
EVIDENCE = LINE_CTES + (
    "e0 AS (SELECT *, CASE WHEN contains(line, ':') AND "
    f"{S.inn(chr(39).join(['lower(trim(split_part(line, ', ':', ', 1)))']), _EV_KNOWN)} THEN lower(trim(split_part(line, ':', "
    f"1))) END AS inl, CASE WHEN {S.inn(chr(39).join(['lower(trim(rtrim(line, ', ':', ')))']), _EV_KNOWN)} THEN "
    f"lower(trim(rtrim(line, ':'))) END AS own FROM lines WHERE NOT {_PERSONA})",
    "e1 AS (SELECT *, coalesce(last_value(coalesce(inl, own) IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY "
    "line_no), '') AS active FROM e0)",
    f"ev AS MATERIALIZED (SELECT doc_id, line_no, CASE WHEN inl IS NOT NULL THEN {_REST.format('line')} ELSE line END AS t FROM e1 "
    f"WHERE NOT list_contains({S.lst(V.EVIDENCE_EXCLUDED)}, active) AND CASE WHEN inl IS NOT NULL THEN "
    f"{_REST.format('line')} <> '' ELSE own IS NULL END)",
    "evt AS MATERIALIZED (SELECT r.*, coalesce((SELECT string_agg(t, chr(10) ORDER BY line_no) FROM ev k WHERE "
    "k.doc_id = r.doc_id), '') AS evidence FROM res r)")


@query("doc_evidence_text", S.with_(*EVIDENCE, select="SELECT doc_id, evidence FROM evt"))
def doc_evidence_text(spark, sf):
    return X.resumes(spark, sf).select("doc_id", D.evidence_text(F.col("text")).alias("evidence"))


_FOUND = S.compact(*[f"CASE WHEN contains({S.nsearch('evidence')}, {S.q(t)}) THEN {S.q(t)} END"
                     for t in V.SUPPORTED_SKILL_TERMS])
SUPPORTED = EVIDENCE + (
    f"sup AS MATERIALIZED (SELECT *, list_sort(list_distinct(list_concat({S.keywords('skills_text')}, {_FOUND}))) "
    "AS supported FROM evt)",)


@query("doc_supported_skills", S.with_(*SUPPORTED, select=(
    "SELECT doc_id, array_to_string(supported, ', ') AS skills FROM sup")))
def doc_supported_skills(spark, sf):
    return X.resumes(spark, sf).select("doc_id", F.array_join(D.supported_skills(
        F.col("skills_text"), D.evidence_text(F.col("text"))), ", ").alias("skills"))


@query("doc_name", S.with_(*LINE_CTES, select=(
    "SELECT doc_id, substr(line, 1, 80) AS name FROM lines WHERE line_no = 0")))
def doc_name(spark, sf):
    return X.resumes(spark, sf).select("doc_id", D.candidate_name(F.col("text")).alias("name"))


@query("doc_name_clean", S.with_(*LINE_CTES, select=(
    f"SELECT doc_id, CASE WHEN {_PERSONA} AND len(regexp_split_to_array(line, '\\s+(?:—|–|-)\\s+')) >= 2 THEN "
    "regexp_split_to_array(line, '\\s+(?:—|–|-)\\s+')[2] ELSE line END AS name FROM (SELECT doc_id, substr(line, "
    "1, 80) AS line FROM lines WHERE line_no = 0)")))
def doc_name_clean(spark, sf):
    return X.resumes(spark, sf).select("doc_id", D.clean_name(
        D.candidate_name(F.col("text"))).alias("name"))


# the background search stops in the middle of a walk over lines; unit tests compare it with a walk
@query("doc_background")
def doc_background(spark, sf):
    return X.resumes(spark, sf).select("doc_id", D.background(F.col("text")).alias("background"))


@query("doc_preview")
def doc_preview(spark, sf):
    df = X.resumes(spark, sf).select("doc_id", D.tidy(F.col("text")).alias("tidy")).select(
        "doc_id", D.cut_preview(F.col("tidy"), 8_000).alias("cleaned"),
        D.cut_preview(F.col("tidy")).alias("preview"))
    df = df.withColumn("m", D.headed_sections(F.col("cleaned")))
    return df.select("doc_id", "preview", F.explode(
        D.preview_sections(F.col("m"), F.col("cleaned"))).alias("title", "body"))


def _pairs(spark, sf, value: str):
    """Every document with all postings displayed for each of its profiles.

    A document stands for a candidate of every demo profile; the displayed postings are a short
    list of each, so they are broadcast.
    """
    # ranked without the descriptions, which only the few displayed postings need
    ranked = rank_jobs(X.scored(spark, sf).select(
        "profile_id", "row_index", *RANK_ORDER, "title", "location_strictness", "passes_location_filter",
        "matched_skills", "role_family_inferred"))
    shown = materialise(display_select(ranked))
    shown = X.jobs(spark, sf).select("row_index", "description") \
        .join(F.broadcast(shown), "row_index").select(
            "profile_id", "row_index", "title", "description", "matched_skills", "role_family_inferred")
    return W.pair_documents(W.candidate_documents(X.resumes(spark, sf)), materialise(shown),
                            values=[value])


_PAIR_KEYS = ("profile_id", "doc_id", "row_index")


@query("doc_evidence_lines")
def doc_evidence_lines(spark, sf):
    return _pairs(spark, sf, "evidence_lines").select(*_PAIR_KEYS, F.array_join("evidence_lines", "\n").alias("lines"))


@query("pair_keywords")
def pair_keywords(spark, sf):
    return _pairs(spark, sf, "job_keywords").select(*_PAIR_KEYS, F.array_join("job_keywords", ", ").alias("keywords"))


@query("pair_infra_skills")
def pair_infra_skills(spark, sf):
    return _pairs(spark, sf, "infra_skills").select(*_PAIR_KEYS, F.array_join("infra_skills", ", ").alias("skills"))
