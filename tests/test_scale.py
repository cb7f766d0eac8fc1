"""What full ranks, feedback and document queries move and compute, on rows made here."""

import glob
import html
import re

import pytest
from pyspark.sql import Column
from pyspark.sql import functions as F

from matchlake import vocab as V
from matchlake.functions import documents as D
from matchlake.functions import rawjson as R
from matchlake.functions.text import BLANKS, BOUND_LEFT, TermIndex, strip
from matchlake.operators import feedback as K
from matchlake.operators import ranking as N
from matchlake.operators.order import rank_all, shared_dir
from matchlake.operators.profiles import Profile, join_profiles, profiles_frame
from matchlake.operators.scoring import score_pairs
from matchlake.operators.signals import job_signals


@pytest.fixture(scope="module")
def scored(spark):
    """Sixty postings with a long text each, scored for two profiles."""
    jobs = spark.range(60).selectExpr(
        "id AS row_index", "concat('Data Analyst ', id % 7) AS title", "'Acme' AS company",
        "'Remote' AS location", "concat('$', 60000 + id * 100) AS salary",
        "repeat(concat('needle-', id, ' Python and SQL. '), 200) AS description")
    people = profiles_frame(spark, [Profile("p1", "data analyst", ["sql"]), Profile("p2")])
    return score_pairs(join_profiles(job_signals(jobs), people))


def written(spark, name):
    return set(glob.glob(f"{shared_dir(spark)}/{name}-*"))


def test_ranks_for_feedback_carry_no_text(spark, scored):
    before = {n: written(spark, n) for n in ("unranked", "placed")}
    ranked = N.rank_narrow(scored)
    for name, old in before.items():
        (path,) = written(spark, name) - old
        assert not {"description", "_plain", "_n_desc", "explanation"} & set(
            spark.read.parquet(path).columns)
    order = ("passes_all_active_constraints", "final_score", "role_fit_score", "score",
             "embedding_similarity", "salary_number")
    full = rank_all(scored, ["profile_id"], [F.desc(c) for c in order]
                    + [F.asc("title"), F.asc("row_index")])
    columns = ["profile_id", "row_index", "rank", "final_score"]
    assert sorted(ranked.select(columns).collect()) == sorted(full.select(columns).collect())


def test_preferences_meet_postings_without_a_shuffle_by_profile(spark, scored, capsys):
    ranked = N.rank_narrow(scored)
    prefs = spark.createDataFrame([("p1", "accepted_skills", "sql", 2)],
                                  "profile_id string, kind string, term string, cnt long")
    out = K.feedback_adjustment(ranked, prefs.groupBy("profile_id", "kind", "term").agg(
        F.sum("cnt").alias("cnt")))
    out.explain()
    plan = capsys.readouterr().out
    assert "SortMergeJoin" not in plan and "hashpartitioning(profile_id" not in plan
    points = {(r.profile_id, r.feedback_adjustment_score) for r in out.collect()}
    assert points == {("p1", 8), ("p2", 0)}


# --- documents ------------------------------------------------------------------------

def step_by_step_preview(text: Column) -> Column:
    """Headings set apart one after the other, each with a pass over the text."""
    t = F.regexp_replace(F.col("text"), r"\r\n?", "\n")
    t = F.regexp_replace(F.regexp_replace(t, r"[ \t]+", " "), r"(?U)\n\s*\n+", "\n\n")
    for name in V.PREVIEW_HEADINGS:
        t = F.regexp_replace(t, rf"(?iU)(?<!\n)(\b{name}\b\s*:?)", "\n\n$1")
    kept = F.transform(D.raw_lines(t), lambda x: F.regexp_replace(
        x, rf"^[{BLANKS}]+|[{BLANKS}]+\z", ""))
    return F.array_join(F.filter(kept, lambda x: x != ""), "\n")


def test_preview_is_one_pass_and_equal_to_one_pass_per_heading(spark, capsys):
    words = ["Skills", "technical SKILLS", "work Experience:", "professional experience", "ſkills",
             "Experience", "skillset", "reprofile", "Profile", "\n", " ", " \n \n", ":", "x", "é",
             "Education\n", "projects", "Summary Objective", "certificationſ"]
    texts = spark.range(400).select(F.concat_ws(" ", *[
        F.element_at(F.array(*map(F.lit, words)), F.expr(f"cast(pmod(hash(id, {i}), {len(words)}) + 1 as int)"))
        for i in range(12)]).alias("text"))
    both = texts.select("text", D.tidy(F.col("text")).alias("a"), step_by_step_preview(F.col("text")).alias("b"))
    assert both.where("a <> b OR a IS NULL OR b IS NULL").collect() == []
    texts.select(D.tidy(F.col("text")).alias("t")).explain()
    assert capsys.readouterr().out.lower().count("regexp_replace") <= 5


def test_a_line_is_normalised_once_for_its_heading(spark, capsys):
    texts = spark.createDataFrame([("Skills: a\nb\nWork experience\nc",)], "text string")
    sections = texts.select(D.headed_sections(F.col("text")).alias("m"))
    assert sections.first().m == {"Skills": "a\nb", "Work Experience": "c"}
    texts.select(D.preview_heading(F.col("text")).alias("h")).explain()
    assert capsys.readouterr().out.lower().count("regexp_replace") == 1


def test_strip_removes_every_kind_of_blank(spark):
    blanks = [chr(i) for i in range(0x3001) if re.match(f"[{BLANKS}]", chr(i))]
    rows = spark.createDataFrame([(b + "a" + b + "é " + b,) for b in blanks] + [("  ",), (None,)], "t string")
    got = rows.select("t", strip(F.col("t")).alias("s")).collect()
    assert all(r.s == (None if r.t is None else f"a{r.t[0]}é" if "a" in r.t else "") for r in got)


# --- raw records ------------------------------------------------------------------------

def test_only_character_references_travel_to_python(spark, capsys):
    texts = ["a &amp; b", "&lt;p&gt;x", "R&amp;D &copy 2", "& alone", "&&amp;;", "&#65;&#x42;&#0;c", "&notit; &amp",
             "&unknown; é&eacute;\U0001F600&#128512;", "plain", "", None, "&", "x&", "&" + "q" * 40 + ";", "&ampx=1"]
    rows = spark.createDataFrame([(t,) for t in texts], "text string")
    got = {r.text: r.clean for r in rows.select("text", R.html_clean(F.col("text")).alias("clean")).collect()}
    assert got == {t: re.sub(f"[{BLANKS}]+", " ", re.sub("<[^>]+>", " ", html.unescape(t or ""))).strip(" ")
                   for t in texts}
    rows.select(R.html_clean(F.col("text")).alias("clean")).explain()
    assert "regexp_extract_all" in capsys.readouterr().out.split("ArrowEvalPython")[1].split("\n")[0]


# --- terms ------------------------------------------------------------------------------

def test_terms_are_tried_by_classes_of_first_characters(spark):
    terms = [f"{c}{d} x" for c in "abcdefghijklmnop" for d in "qrst"] + ["c", "c++", "c#", ".net", "a-b"]
    index = TermIndex(terms, form=str)
    assert "(?=[" in index.pattern.split(BOUND_LEFT)[1][5:]
    texts = [" ".join(terms), "aq xx bq x", "c+++ c## .net x.net a-b-c pt x", "", "zq x"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    for r in rows.select("t", index.hits(F.col("t")).alias("h")).collect():
        want = {t for t in terms if re.search(rf"(?<![a-z0-9]){re.escape(t)}(?![a-z0-9])", r.t)}
        assert set(r.h) == want


def test_terms_are_found_by_words(spark):
    """no pass of a tree of terms over every description."""
    from matchlake.functions.text import TermIndex, search_form
    from matchlake.operators.signals import _working_columns, ensure_columns, load_jobs
    rows = spark.createDataFrame(
        [(1, "Full", "Time Inc.", "time to code in C++. Node.js, no.net, machine. learning"),
         (2, "machine", "", "learning c+ x.net .NET c++x full  time"), (3, None, None, None), (4, "", "", "c++")],
        "row_index long, title string, company string, description string")
    terms = ["c++", ".net", "node.js", "machine learning", "full time", "time", "c"]
    index = TermIndex(terms)
    text = search_form(F.concat_ws(" ", "title", "description"))
    found = rows.select("row_index", text.alias("t")).select("row_index", F.sort_array(index.hits(F.col("t"))), F.sort_array(
        index._hits_of_any(F.concat(F.lit(" "), F.col("t"), F.lit(" "))))).orderBy("row_index").collect()
    assert [(r[0], r[1]) for r in found] == [(r[0], r[2]) for r in found]
    assert [r[1] for r in found] == [["c", "c++", "full time", "node.js", "time"],
                                     [".net", "c", "full time", "machine learning", "time"], [], ["c", "c++"]]
    jobs = ensure_columns(load_jobs(ensure_columns(rows, ("location",))), ("employment_type",))
    hits = _working_columns(jobs).select("_hits", "_place_hits", "_content_hits", "_preference_hits")
    assert "regexp_extract_all" not in hits._jdf.queryExecution().optimizedPlan().toString()


def test_terms_across_fields_are_found(spark):
    """A term may begin in the title and end in the description, with other fields between them."""
    from matchlake.operators.signals import _working_columns, ensure_columns, load_jobs
    rows = spark.createDataFrame([(1, "Machine", "Acme", "Paris", "learning, from home"),
                                  (2, "Work", "", "", "from home"), (3, "Work", "", "Oslo", "from home")],
                                 "row_index long, title string, company string, location string, description string")
    jobs = ensure_columns(load_jobs(rows), ("employment_type",))
    found = {r[0]: r for r in _working_columns(jobs).select("row_index", "_content_hits", "_place_hits").collect()}
    assert "machine learning" in found[1][1]
    assert "work from home" in found[2][2] and "work from home" not in found[3][2]


def test_years_are_tried_behind_a_number(spark):
    from matchlake.functions.requirements import years_required
    texts = ["5 years", "4 + yrs of experience", "five  years here", "years", "2 or more years", "at least 3 yrs",
             "7 years ago", "ten yrs", "12-\n15 years", "yeyrsars", "fiveyears", ""]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = [r[0] for r in rows.orderBy("i").select(years_required(F.col("t"))["years"]).collect()]
    assert got == [5, 4, 5, None, 2, 3, None, 10, 12, None, None, None]


def test_terms_of_a_missing_field_are_null(spark):
    from matchlake.operators.signals import _working_columns, ensure_columns, load_jobs
    rows = spark.createDataFrame([(1, "Analyst", None, "text"), (2, "Analyst", "Acme", None)],
                                 "row_index long, title string, company string, description string")
    jobs = ensure_columns(load_jobs(ensure_columns(rows, ("location",))), ("employment_type",))
    jobs = jobs.withColumn("company", F.when(F.col("row_index") == 2, "Lockheed Martin"))
    found = [r[0] for r in _working_columns(jobs).orderBy("row_index").select("_company_hits").collect()]
    assert found == [None, ["lockheed martin"]]


def test_coverage_normalises_each_text_once(spark):
    """the combined text is a join of forms."""
    from matchlake.operators.analytics import coverage_flags
    rows = spark.createDataFrame([(1, "A", "B", "San - Francisco, CA US", "$5", "Remote. San Jose!"), (2, "A", "B", "", "", "")],
                                 "row_index long, title string, company string, location string, salary string, description string")
    flagged = coverage_flags(rows)
    plan = flagged._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace(") == 2
    got = flagged.orderBy("row_index").select("US jobs", "remote jobs", "California / Bay Area jobs").collect()
    # "." and "-" belong to words, so "remote." is another word
    assert [tuple(r) for r in got] == [(True, False, True), (False, False, False)]


def test_adjusted_postings_are_scored_once(spark, tmp_path, monkeypatch):
    """F16: feedback is joined with the postings that are adjusted."""
    from matchlake.plans import fixtures as X
    from matchlake.plans.queries_matching import feedback_adjustment
    spark.createDataFrame([(i, f"Python and SQL {i}", "en", "web", 16) for i in range(12)],
                          "doc_id long, text string, lang string, source string, n_chars long") \
        .write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, i % 2, 0) for i in range(8)], "doc_id long, quality int, toxic int") \
        .write.parquet(f"{tmp_path}/labels.parquet")
    calls, inner = [], X.score_pairs
    monkeypatch.setattr(X, "score_pairs", lambda *a: (calls.append(1), inner(*a))[1])
    assert feedback_adjustment(spark, str(tmp_path)).count() == 48 and len(calls) == 1
