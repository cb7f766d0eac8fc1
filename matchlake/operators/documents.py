"""Document tables: lines, sections and candidate evidence for many documents."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchlake import vocab as V
from matchlake.functions import documents as D
from matchlake.functions.text import extract_skills, skill_name, split_keywords
from matchlake.operators.order import materialise, scratch_path


def doc_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, line_no, line): cleaned non-empty lines."""
    return docs.select(doc_id, F.posexplode(D.lines(F.col(text))).alias("line_no", "line"))


def doc_sections(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, section, body): text under every known heading."""
    return docs.select(doc_id, F.explode(D.headed_sections(F.col(text)))
                       .alias("section", "body"))


def doc_headings(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Heading and constraint flags of every line."""
    lines = doc_lines(docs, doc_id, text)
    inline = D.inline_heading(F.col("line"))
    return lines.select(
        doc_id, "line_no",
        F.coalesce(D.line_heading(F.col("line")), F.lit("")).alias("heading"),
        D.is_heading(F.col("line")).alias("is_heading"),
        F.coalesce(inline, F.lit("")).alias("inline_section"),
        F.when(inline.isNotNull(), F.trim(F.regexp_replace("line", "^[^:]*:", "")))
        .otherwise(F.col("line")).alias("inline_content"),
        D.negative_line(F.col("line")).alias("is_negative"))


def relevant_skills(skills_text: Column, supported: Column) -> Column:
    """Display names of the supported skills, typed ones first."""
    keys = F.array_distinct(F.concat(split_keywords(skills_text), supported))
    return F.transform(F.filter(keys, lambda k: F.array_contains(supported, k)),
                       lambda k: skill_name(k, V.SKILL_DISPLAY_NAMES))


def candidate_documents(docs: DataFrame, text: str = "text",
                        skills: str = "skills_text") -> DataFrame:
    """Add name, background, evidence and supported skills of every document."""
    return docs.withColumn("evidence_text", D.evidence_text(F.col(text))).withColumns({
        "candidate_name": D.clean_name(D.candidate_name(F.col(text))),
        "background": D.background(F.col(text)),
        "semantic_text": D.semantic_text(F.col(text)),
        "extracted_skills": extract_skills(F.col(text), V.SKILL_VOCABULARY),
        "supported_skills": D.supported_skills(F.col(skills), F.col("evidence_text"))}) \
        .withColumn("relevant_skills", relevant_skills(F.col(skills), F.col("supported_skills")))


PAIR_VALUES = ("job_keywords", "infra_skills", "evidence_lines")


def _own_parts(candidates: DataFrame, values: Sequence[str]) -> DataFrame:
    """What pairs need of a document for some ``values``, written once as a narrow table."""
    columns = [F.col("doc_id"), F.col("relevant_skills")]
    if "infra_skills" in values:
        columns += [D.infra_skills(F.col("relevant_skills")).alias("infra"),
                    (D.infra_context(F.col("target_role")) | D.infra_context(F.col("text")))
                    .alias("doc_context"), D.edges(F.lower("target_role")).alias("role_edges"),
                    D.edges(F.lower("text")).alias("text_edges")]
    if "evidence_lines" in values:
        columns.append(D.action_lines(F.col("text"), F.col("candidate_name"), F.col("background"),
                                      F.col("relevant_skills")).alias("actions"))
    own = candidates.select(columns)
    path = scratch_path(candidates.sparkSession, "documents-of-pairs")
    own.write.parquet(path)
    return candidates.sparkSession.read.schema(own.schema).parquet(path)


def _posting_parts(own: DataFrame, postings: DataFrame) -> DataFrame:
    """What pairs need of a posting: named skills, context, and the edges of its texts.

    ``postings`` are few; each is searched once for every distinct skill of all documents.
    """
    skills = own.select(F.explode(F.transform("relevant_skills", F.lower)).alias("skill")).distinct()
    keys = [c for c in ("profile_id", "row_index") if c in postings.columns]
    low = postings.select(*keys, F.lower("description").alias("low"),
                          split_keywords(F.col("matched_skills")).alias("matched"))
    named = skills.join(low, F.contains("low", F.col("skill"))
                        | F.array_contains("matched", F.col("skill"))) \
        .groupBy(*keys).agg(F.collect_set("skill").alias("named"))
    texts = [F.col(c) for c in ("title", "description", "matched_skills", "role_family_inferred")]
    return postings.join(named, keys, "left").select(
        *keys, F.coalesce("named", F.array().cast("array<string>")).alias("named"),
        ((F.lower("role_family_inferred") == "mlops_infra") | D.infra_context(*texts))
        .alias("job_context"), D.edges(F.lower(F.concat_ws(" ", *texts))).alias("job_edges"))


def pair_documents(candidates: DataFrame, postings: DataFrame, pairs: DataFrame | None = None,
                   values: Sequence[str] = PAIR_VALUES) -> DataFrame:
    """Some of PAIR_VALUES for (document, posting) pairs.

    ``postings`` are displayed ones, few enough to be broadcast.  ``pairs`` has (doc_id,
    row_index); without it every document meets all postings.  Postings that differ by profile
    have a profile_id, and so have their pairs.  Skills, action lines and context are taken from
    a document once and from a posting once; a pair only compares short lists.
    """
    own = _own_parts(candidates, values)
    parts = _posting_parts(own, postings)
    if pairs is None:
        keys = [c for c in parts.columns if c in ("profile_id", "row_index")]
        df = own.join(F.broadcast(materialise(parts)), F.lit(True))
    else:
        keys = [c for c in ("profile_id", "row_index") if c in pairs.columns]
        df = pairs.join(own, "doc_id").join(parts, keys)
    df = df.withColumn("job_keywords", D.pair_keywords(F.col("relevant_skills"), F.col("named")))
    if "infra_skills" in values:
        across = D.infra_context(F.col("role_edges"), F.col("job_edges"), F.col("text_edges"))
        df = df.withColumn("infra_skills", F.when(
            F.col("job_context") | F.col("doc_context") | across, F.col("infra"))
            .otherwise(F.array().cast("array<string>")))
    if "evidence_lines" in values:
        df = df.withColumn("evidence_lines", D.evidence_lines(F.col("actions"), F.col("job_keywords")))
    return df.select(*keys, "doc_id", *values)
