"""Queries over scoring, filters, ranking, retrieval, sampling and feedback."""

from __future__ import annotations

from pyspark.sql import functions as F

from matchlake import vocab as V
from matchlake.functions import location as L
from matchlake.functions.vectors import cosine_similarity, l2_normalize, round2
from matchlake.operators import feedback as K
from matchlake.operators import forest as T
from matchlake.operators import ranking as N
from matchlake.operators import retrieval as E
from matchlake.operators import sampling as B
from matchlake.operators import scoring as C
from matchlake.operators.ingest import embedding_text
from matchlake.operators.order import scratch_path, stored
from matchlake.operators.profile_topk import topk_for_profiles
from matchlake.operators.profiles import (join_candidates, join_profiles, retrieved_pairs,
                                          prepare_profiles)
from matchlake.plans import fixtures as X
from matchlake.plans import sql as S
from matchlake.plans.catalog import query
from matchlake.plans.queries_signals import TITLE_TERMS, bucket_cte
from matchlake.sources import writers
from matchlake.streaming import feedback as SF
from matchlake.streaming.paced import PACED, paced_stream, run_to_end

KEYS = ("profile_id", "row_index")


# --- score parts -----------------------------------------------------------------------

def _part(name: str, spark_part: str, points: str, reasons: str) -> None:
    sql = S.with_(*S.PAIR_CTES, select=(
        f"SELECT profile_id, row_index, CAST({points} AS INTEGER) AS points, "
        f"{S.join(reasons, '; ')} AS reason FROM pr5"))

    @query(name, sql)
    def run(spark, sf):
        return C.score_parts(X.pairs(spark, sf)).select(
            *KEYS, F.col(f"{spark_part}.points").alias("points"),
            F.array_join(f"{spark_part}.reasons", "; ").alias("reason"))


_part("target_role_score", "_role", "role_p.points", "role_p.reasons")
_part("role_fit_score", "_fit", "fit_p.points", "fit_p.reasons")
_part("location_score", "_location", "loc_p.points", "loc_p.reasons")
_part("dealbreaker_score", "_dealbreaker", "db_p.points", "db_p.reasons")
_part("salary_fit_score", "_salary", "sal_p.points", "sal_p.reasons")
_part("advanced_score", "_advanced", "adv_points", "adv_reasons")


@query("matched_skills", S.with_(*S.PAIR_CTES, select=(
    "SELECT profile_id, row_index, matched_skills, CAST(skill_p.points AS INTEGER) AS points FROM pr5")))
def matched_skills(spark, sf):
    return C.score_parts(X.pairs(spark, sf)).select(
        *KEYS, F.array_join("_skills", ", ").alias("matched_skills"),
        F.col("_skill.points").alias("points"))


@query("location_pass", S.with_(*S.PAIR_CTES, select=(
    "SELECT profile_id, row_index, passes_location_filter, location_filter_reason FROM pr5")))
def location_pass(spark, sf):
    return C.score_inputs(X.pairs(spark, sf)).select(
        *KEYS, F.col("_location_check.passed").alias("passes_location_filter"),
        F.col("_location_check.reason").alias("location_filter_reason"))


@query("seniority_score", S.with_(*S.PAIR_CTES, select=(
    "SELECT profile_id, row_index, CAST(sen_p.points AS INTEGER) AS points FROM pr5")))
def seniority_score(spark, sf):
    df = C.score_inputs(X.pairs(spark, sf)).withColumn("_s", C.seniority_score())
    return df.select(*KEYS, F.col("_s.points").alias("points"))


@query("role_fit_penalty", S.with_(*S.PAIR_CTES, select=(
    "SELECT profile_id, row_index, CAST(sf_p.points AS INTEGER) AS points, "
    f"{S.join('sf_p.reasons', '; ')} AS reason FROM pr5")))
def role_fit_penalty(spark, sf):
    df = C.score_parts(X.pairs(spark, sf)).withColumn("_p", C.role_fit_penalty(
        F.col("_fit.points"), F.col("p_role_fit_strictness")))
    return df.select(*KEYS, F.col("_p.points").alias("points"),
                     F.array_join("_p.reasons", "; ").alias("reason"))


_PREF = X.case("doc_id + 3", X.PLACES)
_OLD = ("CASE WHEN pref = '' THEN 0 WHEN nl IN ('', 'unknown') THEN -5 WHEN contains(np, 'remote') "
        "AND remote THEN 25 WHEN contains(np, 'bay area') AND bay THEN 25 WHEN (contains("
        "lower(pref), 'us only') OR contains(lower(pref), 'u.s. only')) THEN CASE WHEN us THEN 10 "
        "ELSE -35 END WHEN wants AND NOT us THEN -35 WHEN contains(nl, np) THEN 20 WHEN "
        f"list_has_any(list_concat(string_split(np, ' '), " + S.compact(*[
            f"CASE WHEN contains(np, {S.q(n)}) THEN {S.q(a.lower())} END" for n, a in V.US_STATES.items()])
        + "), string_split(nl, ' ')) THEN 20 WHEN contains(np, 'remote') OR contains(np, 'bay "
        "area') THEN -15 ELSE -10 END")


@query("location_score_legacy", (
    f"SELECT doc_id, CAST({_OLD} AS INTEGER) AS points FROM (SELECT doc_id, pref, {S.nloc('pref')} AS np, "
    f"{S.nloc('loc')} AS nl, list_has_any({S.words('whole')}, ['remote', 'wfh']) OR contains("
    f"{S.nloc('whole')}, 'work from home') AS remote, {S.has(S.nloc('whole'), V.BAY_AREA_TERMS)} AS bay, "
    f"{S.looks_us('loc')} AS us, {S.us_preference('pref')} AS wants FROM (SELECT doc_id, {_PREF} AS pref, "
    f"{X.case('doc_id', X.LOCATIONS)} AS loc, {X.case('doc_id', X.LOCATIONS)} || ' ' || text AS whole "
    "FROM documents))"))
def location_score_legacy(spark, sf):
    df = X.documents(spark, sf).selectExpr(
        "doc_id", f"{_PREF} AS pref", f"{X.case('doc_id', X.LOCATIONS)} AS loc", "text")
    scored = L.location_score_legacy(F.col("pref"), F.col("loc"), F.col("text"))
    return df.select("doc_id", scored["points"].alias("points"))


# --- whole scores ----------------------------------------------------------------------------

def _scored(name: str, columns: list[str], cast: dict[str, str] | None = None) -> None:
    cast = cast or {}
    shown = ", ".join(f"CAST({c} AS {cast[c]}) AS {c}" if c in cast else c for c in columns)

    @query(name, S.with_(*S.scored_ctes(), select=f"SELECT profile_id, row_index, {shown} FROM scored"))
    def run(spark, sf):
        return X.scored(spark, sf).select(*KEYS, *columns)


_INT = {"score": "INTEGER", "role_fit_strictness_penalty": "INTEGER", "role_fit_score": "INTEGER",
        "active_constraint_penalty": "INTEGER"}
_scored("rule_score", ["score"], _INT)
_scored("final_score", ["score", "role_fit_score", "role_fit_strictness_penalty",
                        "active_constraint_penalty", "final_score"], _INT)
_scored("final_explanation", ["explanation"])
_scored("constraint_passes", [*S._PASSES, "passes_all_active_constraints",
                              "active_constraint_filters", "active_constraint_penalty"], _INT)
_scored("join_profiles", ["title", "passes_all_active_constraints"])

_QUOTED = "'[' || coalesce(array_to_string(list_transform({}, lambda t: '''' || t || ''''), ', '), '') || ']'"
_AVOID = S.inn("seniority", V.AVOIDS_SENIOR)
_CHECKS = [
    ("Maximum required years", "max_years IS NOT NULL", "passes_years_filter",
     "'required=' || coalesce(required_years_min || '.0', 'Unknown') || ', max=' || max_years || '.0'"),
    ("Minimum salary", "min_salary > 0", "passes_salary_filter",
     "'salary=' || CASE WHEN salary_number > 0 THEN salary_number || '.0' ELSE 'Unknown' END || "
     "', min=' || min_salary || '.0, strictness=' || pay_strict"),
    ("Avoid contract/temp", "no_contract", "NOT is_contract_or_temp", _QUOTED.format("contract")),
    ("Avoid unpaid/commission-only", "no_unpaid", "NOT is_unpaid_or_commission", _QUOTED.format("unpaid")),
    ("Avoid senior/staff/principal", _AVOID, "NOT is_senior_staff_principal", _QUOTED.format("senior")),
    ("Avoid junior", S.inn("seniority", V.AVOIDS_JUNIOR), "NOT is_junior_entry_level",
     _QUOTED.format("junior")),
    ("Avoid internship roles", "no_intern", "employment_type_inferred <> 'internship'",
     "employment_type_inferred"),
    ("Avoid manager/director", _AVOID, "NOT is_manager_director", _QUOTED.format("manager")),
    ("Strict location", "loc_strict = 'Strict'", "passes_location_filter", "location_filter_reason"),
    ("Strict role fit", "fit_strict = 'Strict'", "passes_role_fit_filter",
     "'role_fit_score=' || role_fit_score"),
    ("Avoid defense/military", "no_defense", "NOT is_defense_military_clearance", _QUOTED.format("defense")),
    ("Company size preference", S.inn("size_pref", (V.EXCLUDE_TINY, V.LARGE_ONLY)),
     "passes_company_size_filter", "company_size_match_text"),
]


@query("constraint_checks", S.with_(*S.scored_ctes(), select=" UNION ALL ".join(
    f"SELECT profile_id, row_index, {S.q(n)} AS filter, CASE WHEN {p} THEN 'PASS' ELSE 'FAIL' END AS "
    f"status, {d} AS detail FROM scored WHERE {a}" for n, a, p, d in _CHECKS)))
def constraint_checks(spark, sf):
    return C.constraint_checks(X.scored(spark, sf))


# --- ranking ------------------------------------------------------------------------------------

RANKED = S.scored_ctes() + (f"ranked AS MATERIALIZED (SELECT *, {S.RANK} AS rank FROM scored)",)
SHOWN = ("shown AS MATERIALIZED (SELECT * FROM (SELECT *, bool_or(passes_all_active_constraints) OVER "
         "(PARTITION BY profile_id) AS any_pass FROM ranked WHERE loc_strict <> 'Strict' OR "
         "passes_location_filter) WHERE passes_all_active_constraints = any_pass QUALIFY "
         "row_number() OVER (PARTITION BY profile_id ORDER BY rank) <= 10)")


@query("rank_jobs", S.with_(*RANKED, select=(
    "SELECT profile_id, row_index, CAST(rank AS INTEGER) AS rank, final_score FROM ranked")))
def rank_jobs(spark, sf):
    return N.rank_jobs(X.scored(spark, sf).select(
        *KEYS, "title", "salary_number", *N.RANK_ORDER[:-1])).select(*KEYS, "rank", "final_score")


@query("rank_top_k", S.with_(*RANKED, select=(
    "SELECT profile_id, row_index, CAST(rank AS INTEGER) AS rank FROM ranked WHERE rank <= 25")))
def rank_top_k(spark, sf):
    return N.rank_jobs(X.scored(spark, sf), 25).select(*KEYS, "rank")



def _ranked(spark, sf):
    return N.rank_narrow(X.scored(spark, sf))


def _shown(spark, sf):
    """Keys and ranks of the displayed postings, ranked without texts."""
    narrow = X.scored(spark, sf).select(*KEYS, "title", "salary_number", *N.RANK_ORDER[:-1],
                                        "location_strictness", "passes_location_filter")
    return N.display_select(N.rank_jobs(narrow)).select(*KEYS, "rank")


def _displayed(spark, sf):
    """The displayed postings with all columns: only they are scored and explained in full."""
    return C.score_pairs(retrieved_pairs(X.jobs(spark, sf), _shown(spark, sf), X.demo_profiles(spark)))


@query("display_select", S.with_(*RANKED, SHOWN, select=(
    "SELECT profile_id, row_index, CAST(rank AS INTEGER) AS rank FROM shown")))
def display_select(spark, sf):
    return _shown(spark, sf)


@query("precision_at_k", S.with_(*RANKED, select=(
    "SELECT profile_id, avg(CAST(passes_all_active_constraints AS INTEGER)) AS precision FROM ranked "
    "WHERE rank <= 10 GROUP BY profile_id")))
def precision_at_k(spark, sf):
    return N.precision_at_k(N.rank_jobs(X.scored(spark, sf), 10))


_SHOW = {
    "Rank": "CAST(rank AS VARCHAR)", "Job Title": "title", "Company": "company",
    "Location": "location", "Salary": "salary_text",
    "Required Years": "CAST(required_years_min AS VARCHAR)",
    "Employment Type": "employment_type_inferred", "Company Size": "company_size_inferred",
    "Matched Skills": "matched_skills"}


@query("display_unknowns", S.with_(*RANKED, SHOWN, select="SELECT profile_id, " + ", ".join(
    f"CASE WHEN {e} IS NULL OR lower(trim({e})) IN ('', 'nan', 'none', 'unknown') THEN 'Unknown' ELSE "
    f"{e} END AS \"{n}\"" for n, e in _SHOW.items()) + ", final_score AS \"Match Score\" FROM shown"))
def display_unknowns(spark, sf):
    return N.display_table(_displayed(spark, sf))


_EXPLAIN = ("coalesce(array_to_string(list_filter([CASE WHEN matched_skills <> '' THEN 'Matched "
            "skills: ' || matched_skills END, CASE WHEN role_family_inferred <> 'unknown' THEN 'Role "
            "family: ' || role_family_inferred END, CASE WHEN passes_all_active_constraints THEN "
            "'Active constraints: passed' ELSE 'Active constraints: did not pass' END], lambda x: x "
            "IS NOT NULL), '; '), '')")


@query("sink_user_export", S.with_(*RANKED, SHOWN, select=(
    "SELECT profile_id, CAST(rank AS INTEGER) AS rank, title, company, location, salary_text, "
    "md5(description) AS description_md5, apply_link AS apply_url, final_score, matched_skills, "
    f"{_EXPLAIN} AS match_explanation FROM shown")))
def sink_user_export(spark, sf):
    out = N.user_export(_displayed(spark, sf))
    path = writers.write_table(out, scratch_path(spark, "export"), "csv")
    back = writers.read_back(out, path, "csv").na.fill("")
    return back.withColumn("description_md5", F.md5("description")).drop("description")


_DEBUG_SQL = {
    "preferred_location": "pref", "location_strictness": "loc_strict",
    "seniority_preference": "seniority", "salary_minimum": "min_salary",
    "salary_strictness": "pay_strict", "company_size_preference": "size_pref",
    "max_required_years_setting": "coalesce(CAST(max_years AS VARCHAR), 'No limit')",
    "feedback_label": "'Skip'", "feedback_adjustment_score": "0",
    "adjusted_final_score": "final_score", "rank": "CAST(rank AS INTEGER)",
    "role_fit_score": "CAST(role_fit_score AS INTEGER)"}


@query("sink_debug_export", S.with_(*RANKED, select="SELECT profile_id, row_index, " + ", ".join(
    f"{_DEBUG_SQL.get(c, c)} AS {c}" for c in V.DEBUG_COLUMNS) + " FROM ranked"))
def sink_debug_export(spark, sf):
    scored = X.scored(spark, sf)
    order = [c for c in N.RANK_ORDER if c not in V.DEBUG_COLUMNS]
    out = N.debug_export(N.rank_jobs(N.debug_export(scored, (*KEYS, *order))), KEYS)
    path = writers.write_table(out, scratch_path(spark, "debug"))
    return spark.read.parquet(path)


# --- vectors and retrieval ------------------------------------------------------------------------

_D = "CAST({} AS DOUBLE[])"
_Q = ("q AS (SELECT 'q' || label AS profile_id, arg_min(embedding, vec_id) AS qv FROM embeddings "
      "GROUP BY label)")
_SIM = f"round(list_cosine_similarity({_D.format('e.embedding')}, {_D.format('q.qv')}), 9)"
_SIMS = (f"sims AS (SELECT q.profile_id, e.vec_id AS row_index, {_SIM} AS embedding_similarity FROM "
         "embeddings e, q)")


def _topk_sql(k: int, extra: str = "") -> str:
    return (f"SELECT profile_id, row_index, embedding_similarity, CAST(rank AS INTEGER) AS rank{extra} "
            "FROM (SELECT *, row_number() OVER (PARTITION BY profile_id ORDER BY embedding_similarity "
            f"DESC, row_index) AS rank FROM sims) WHERE rank <= {k}")


@query("cosine_similarity", S.with_(_Q, select=(
    f"SELECT q.profile_id, e.vec_id AS row_index, round({_SIM}, 6) AS similarity FROM embeddings e, q "
    "WHERE q.profile_id = 'q' || e.label")))
def cosine_similarity_query(spark, sf):
    queries = X.query_vectors(spark, sf).withColumnRenamed("embedding", "_q")
    rows = X.table(spark, sf, "embeddings").withColumn(
        "profile_id", F.concat(F.lit("q"), F.col("label").cast("string")))
    return rows.join(queries, "profile_id").select(
        "profile_id", F.col("vec_id").alias("row_index"),
        F.round(cosine_similarity(F.col("embedding"), F.col("_q")), 6).alias("similarity"))


@query("l2_normalize", (
    "SELECT vec_id, round(sum(x / n), 4) AS total FROM (SELECT vec_id, unnest(list_transform("
    "embedding, lambda x: CAST(x AS DOUBLE) * 3)) AS x, sqrt(list_sum(list_transform(embedding, "
    "lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE) * 9))) AS n FROM embeddings) GROUP BY vec_id"))
def l2_normalize_query(spark, sf):
    tripled = F.transform("embedding", lambda x: x.cast("double") * 3)
    unit = l2_normalize(tripled)
    total = F.aggregate(unit, F.lit(0.0), lambda a, x: a + x.cast("double"))
    return X.table(spark, sf, "embeddings").select("vec_id", F.round(total, 4).alias("total"))


@query("topk_bruteforce", S.with_(
    "q AS (SELECT 'q' AS profile_id, arg_min(embedding, vec_id) AS qv FROM embeddings)", _SIMS,
    select=_topk_sql(500).replace("SELECT profile_id, row_index", "SELECT row_index", 1)))
def topk_bruteforce(spark, sf):
    v = X.vectors(spark, sf)
    first = v.agg(F.min_by("embedding", "row_index")).collect()[0][0]
    return E.topk_bruteforce(v, [float(x) for x in first])


@query("topk_profiles", S.with_(_Q, _SIMS, select=_topk_sql(500)))
def topk_profiles(spark, sf):
    return E.topk_exact(X.vectors(spark, sf), X.query_vectors(spark, sf))


def _ann(spark, sf):
    v = X.vectors(spark, sf)
    forest = T.fit_forest(v)
    path = scratch_path(spark, "forest")
    T.write_forest_index(T.forest_index(forest, v), path)
    return v, spark.read.parquet(path), forest


def _searches(spark, sf):
    """Every hundredth vector as a query."""
    return X.vectors(spark, sf).where("row_index % 100 = 0").select(
        F.col("row_index").cast("string").alias("profile_id"), "embedding")


@query("topk_ann")
def topk_ann(spark, sf):
    return E.topk_ann(*_ann(spark, sf), _searches(spark, sf), 20)


@query("ann_recall", "SELECT k, count(*) AS queries, TRUE AS enough FROM embeddings, (SELECT "
       "unnest([20, 500]) AS k) WHERE vec_id % 100 = 0 GROUP BY k")
def ann_recall(spark, sf):
    """Recall of the approximate search at 20 and 500 results: 0.9 or more is enough."""
    found = E.ann_recall(*_ann(spark, sf), _searches(spark, sf), (20, 500))
    return found.select("k", "queries", (F.col("recall") >= 0.9).alias("enough"))


# every hundredth vector finds 20 in its leaves; more than the table holds is left to the exact search,
# which gives all rows for the query of every label
@query("topk_fallback", S.with_(_Q, _SIMS, select=(
    "SELECT *, 1000000 AS k, least(1000000, (SELECT count(*) FROM embeddings)) AS n FROM ("
    + _topk_sql(1_000_000, ", 'bruteforce' AS retrieval_method") + ") UNION ALL SELECT CAST(vec_id AS VARCHAR), "
    "vec_id, CAST(1.0 AS DOUBLE), 1, 'ann', 20, least(20, (SELECT count(*) FROM embeddings)) FROM embeddings "
    "WHERE vec_id % 100 = 0")))
def topk_fallback(spark, sf):
    """All rows of the exact search; of each approximate search its best row and the number found."""
    v, index, forest = _ann(spark, sf)
    shared = ["profile_id", "retrieval_method"]
    exact = E.topk_fallback(v, X.query_vectors(spark, sf), 1_000_000, index, forest)
    found = exact.groupBy(*shared).agg(F.count("*").alias("n"))
    near = E.topk_fallback(v, _searches(spark, sf), 20, index, forest).groupBy(*shared).agg(
        F.count("*").alias("n"), F.min_by("row_index", "rank").alias("row_index"),
        F.max("embedding_similarity").alias("embedding_similarity"), F.min("rank").alias("rank"))
    columns = ("profile_id", "row_index", "embedding_similarity", "rank", "retrieval_method")
    return exact.join(found, shared).select(*columns, F.lit(1_000_000).alias("k"), "n").unionByName(
        near.select(*columns, F.lit(20).alias("k"), "n"))


@query("embedding_bonus_candidates", S.with_(_Q, _SIMS, select=(
    "SELECT profile_id, row_index, round_even(coalesce(embedding_similarity, 0) * 30 * 100, 0) / 100 AS "
    f"bonus FROM ({_topk_sql(V.RETRIEVAL_TOP_K)})")))
def embedding_bonus_candidates(spark, sf):
    """The bonus of all that retrieval hands on."""
    top = E.topk_exact(X.vectors(spark, sf), X.query_vectors(spark, sf))
    return top.select("profile_id", "row_index", C.embedding_bonus(
        F.col("embedding_similarity")).alias("bonus"))


@query("embed_text")
def embed_text(spark, sf):
    texts = embedding_text(X.jobs(spark, sf)).select("row_index", "embedding_text")
    return E.embed_text(texts).select("row_index", F.size("embedding").alias("dimension"),
                                      F.round(cosine_similarity(F.col("embedding"), F.col("embedding")), 6)
                                      .alias("self_similarity"))


@query("sink_vectors", "SELECT vec_id AS row_index, 'T' || label AS title, round(list_sum("
       "list_transform(embedding, lambda x: CAST(x AS DOUBLE))), 5) AS total FROM embeddings")
def sink_vectors(spark, sf):
    v = X.table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("row_index"), F.concat(F.lit("T"), F.col("label").cast("string"))
        .alias("title"), "embedding")
    back = spark.read.parquet(writers.write_vectors(v, scratch_path(spark, "vectors")))
    total = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double"))
    return back.select("row_index", "title", F.round(total, 5).alias("total"))


# profile pN searches with the vector of label N - 1
_PQ = ("q AS (SELECT 'p' || (label + 1) AS profile_id, arg_min(embedding, vec_id) AS qv FROM embeddings "
       "GROUP BY label)")
_CAND = f"cand AS ({_topk_sql(500)})"


def _candidates(spark, sf):
    queries = X.query_vectors(spark, sf).withColumn("profile_id", F.concat(
        F.lit("p"), (F.substring("profile_id", 2, 9).cast("int") + 1).cast("string")))
    return E.topk_exact(X.vectors(spark, sf), queries).drop("rank")


@query("embedding_bonus", S.with_(_PQ, _SIMS, _CAND, select=(
    "SELECT profile_id, row_index, round_even(coalesce(embedding_similarity, 0) * 30 * 100, 0) / 100 AS "
    "bonus FROM cand FULL JOIN (SELECT doc_id AS row_index, 'p' || (doc_id % 4 + 1) AS profile_id FROM "
    "labels) judged USING (profile_id, row_index)")))
def embedding_bonus(spark, sf):
    """The bonus of all that retrieval hands on and of judged postings, 0 without a similarity."""
    judged = X.table(spark, sf, "labels").selectExpr(
        "doc_id AS row_index", "concat('p', CAST(doc_id % 4 + 1 AS STRING)) AS profile_id")
    return _candidates(spark, sf).join(judged, ["profile_id", "row_index"], "full").select(
        *KEYS, C.embedding_bonus(F.col("embedding_similarity")).alias("bonus"))


@query("join_candidates", S.with_(S.JOBS0, _PQ, _SIMS, _CAND, select=(
    "SELECT c.profile_id, c.row_index, j.title, c.embedding_similarity FROM cand c JOIN jobs0 j USING "
    "(row_index)")))
def join_candidates_query(spark, sf):
    return join_candidates(X.jobs(spark, sf), _candidates(spark, sf)).select(
        *KEYS, "title", "embedding_similarity")


@query("range_filter_index", S.with_(_Q, _SIMS, f"cand AS ({_topk_sql(500)})", select=(
    "SELECT profile_id, row_index FROM cand WHERE row_index IN (SELECT doc_id FROM documents)")))
def range_filter_index(spark, sf):
    top = E.topk_exact(X.vectors(spark, sf), X.query_vectors(spark, sf))
    return join_candidates(X.documents(spark, sf).select(F.col("doc_id").alias("row_index")), top) \
        .select(*KEYS)


@query("match_profiles", S.with_(*S.scored_ctes(
    "sim", "(SELECT pr5.*, cand.embedding_similarity AS sim FROM pr5 JOIN cand USING (profile_id, "
    "row_index))"), select=f"SELECT profile_id, row_index, CAST({S.RANK} AS INTEGER) AS rank, "
    "embedding_bonus, final_score FROM scored").replace(
        "sc0 AS MATERIALIZED", f"{_PQ},\n{_SIMS},\n{_CAND},\nsc0 AS MATERIALIZED", 1))
def match_profiles(spark, sf):
    """Retrieval, then rules, then ranking of at most 500 candidates per profile."""
    pairs = retrieved_pairs(X.jobs(spark, sf), _candidates(spark, sf), X.demo_profiles(spark))
    return N.rank_jobs(C.score_pairs(pairs, retrieved=True), V.RETRIEVAL_TOP_K).select(
        *KEYS, "rank", "embedding_bonus", "final_score")


# --- very many profiles ---------------------------------------------------------------------------

_CUSTOMERS = X.PROFILE_COLUMNS | X.CUSTOMER_SETTINGS
_SETTING_SQL = {
    "skills": S.keywords("skills_text"), "pref": "preferred_location", "min_salary": "minimum_salary",
    "breakers": S.keywords("dealbreakers_text"), "fit_strict": "role_fit_strictness",
    "loc_strict": "location_strictness", "seniority": "seniority_preference",
    "max_years": "max_required_years", "no_contract": "avoid_contract", "no_unpaid": "avoid_unpaid",
    "no_intern": f"avoid_internship OR {S.inn('seniority_preference', V.AVOIDS_INTERNSHIP)}",
    "no_defense": "avoid_defense", "visa_pref": "visa_sponsorship", "company_pref": "company_preference",
    "size_pref": "company_size_preference", "pay_strict": "salary_strictness"}
# the reference answer scores every posting for every distinct setting
_CUSTOMER_CTES = (
    "cust AS MATERIALIZED (SELECT *, dense_rank() OVER (ORDER BY " + ", ".join(
        c for c in _CUSTOMERS if c != "profile_id") + ") AS class FROM (SELECT " + ", ".join(
        f"{e} AS {n}" for n, e in _CUSTOMERS.items()) + " FROM customer))",
    S.profile_cte("SELECT DISTINCT class AS profile_id, target_role, " + ", ".join(
        f"{e} AS {n}" for n, e in _SETTING_SQL.items()) + " FROM cust"))


@query("topk_many_profiles", S.with_(
    *_CUSTOMER_CTES, *[c for c in S.scored_ctes() if not c.startswith("prof AS")],
    f"best AS (SELECT *, {S.RANK} AS rank FROM scored QUALIFY rank <= 10)", select=(
        "SELECT c.profile_id, b.row_index, CAST(b.rank AS INTEGER) AS rank, b.final_score, b.title, "
        "md5(b.explanation) AS explanation_md5 FROM cust c JOIN best b ON b.profile_id = c.class")))
def topk_many_profiles(spark, sf):
    """The ten best of all postings for the profile of every customer."""
    return topk_for_profiles(X.jobs(spark, sf), X.customer_profiles(spark, sf)).select(
        *KEYS, "rank", "final_score", "title", F.md5("explanation").alias("explanation_md5"))


# --- sampling -----------------------------------------------------------------------------------------

def _sample_sql(max_jobs: int) -> tuple[str, ...]:
    cap = B.bucket_cap(max_jobs)
    ctes, taken = [], []
    for name in B.BUCKETS:
        seen = " UNION ALL ".join(f"SELECT row_index FROM pick_{t}" for t in taken)
        where = f" AND row_index NOT IN ({seen})" if seen else ""
        ctes.append(f"pick_{name} AS MATERIALIZED (SELECT row_index, draw FROM buckets WHERE {name}"
                    f"{where} ORDER BY draw, row_index LIMIT {cap})")
        taken.append(name)
    picked = " UNION ALL ".join(f"SELECT row_index, draw, '{t}' AS bucket FROM pick_{t}" for t in taken)
    ctes.append(f"picked AS MATERIALIZED ({picked})")
    ctes.append("sample AS MATERIALIZED (SELECT * FROM picked UNION ALL (SELECT row_index, draw, "
                f"'{V.GENERAL_BUCKET}' FROM (SELECT *, row_number() OVER (ORDER BY draw, row_index) AS n "
                "FROM buckets WHERE row_index NOT IN (SELECT row_index FROM picked)) WHERE n <= "
                f"{max_jobs} - (SELECT count(*) FROM picked)))")
    return (S.JOBS0, bucket_cte(), *ctes)


SAMPLE_JOBS = 300


@query("balanced_sample", S.with_(*_sample_sql(SAMPLE_JOBS), select=(
    "SELECT row_index, bucket, CAST(row_number() OVER (ORDER BY md5('shuffle:' || draw), row_index) AS "
    "INTEGER) AS sample_position FROM sample")))
def balanced_sample(spark, sf):
    return B.balanced_sample(embedding_text(X.jobs(spark, sf)), SAMPLE_JOBS)


@query("balanced_sample_default", S.with_(*_sample_sql(V.EMBEDDING_SAMPLE_SIZE), select=(
    "SELECT row_index, bucket, CAST(row_number() OVER (ORDER BY md5('shuffle:' || draw), row_index) AS "
    "INTEGER) AS sample_position FROM sample")))
def balanced_sample_default(spark, sf):
    """The sample of the operator's own size."""
    return B.balanced_sample(embedding_text(X.jobs(spark, sf)))


@query("sampling_summary", S.with_(*_sample_sql(SAMPLE_JOBS), select=(
    f"SELECT b.bucket, count(s.row_index) AS job_count FROM (SELECT unnest({S.lst(B.BUCKETS + (V.GENERAL_BUCKET,))}) "
    "AS bucket) b LEFT JOIN sample s USING (bucket) GROUP BY b.bucket")))
def sampling_summary(spark, sf):
    return B.sampling_summary(B.balanced_sample(embedding_text(X.jobs(spark, sf)), SAMPLE_JOBS))


@query("anti_selected", S.with_(*_sample_sql(SAMPLE_JOBS), select=(
    "SELECT row_index FROM buckets WHERE row_index NOT IN (SELECT row_index FROM sample)")))
def anti_selected(spark, sf):
    jobs = embedding_text(X.jobs(spark, sf))
    return B.anti_selected(jobs, B.balanced_sample(jobs, SAMPLE_JOBS)).select("row_index")


# --- feedback --------------------------------------------------------------------------------------------

FEEDBACK = (
    f"given AS (SELECT doc_id AS row_index, {X.FEEDBACK_LABEL} AS feedback_label, 'p' || (doc_id % 4 + 1) "
    "AS profile_id FROM labels)",
    "fb AS MATERIALIZED (SELECT s.*, g.feedback_label, CAST(s.row_index % 3 + 1 AS INTEGER) AS "
    "feedback_round, s.row_index AS seq, CASE g.feedback_label WHEN 'Accept' THEN 1 WHEN 'Reject' THEN "
    "-1 ELSE 0 END AS reward FROM scored s JOIN given g USING (row_index, profile_id))")
_SKILL_LIST = ("list_filter(list_transform(string_split(matched_skills, ','), lambda p: lower(trim(p))), "
               f"lambda p: p <> '' AND NOT list_contains({S.lst(V.FEEDBACK_IGNORED_TERMS)}, p))")
_LIKED = "CASE WHEN reward > 0 THEN 'accepted' ELSE 'rejected' END"


def _prefs(protected: str | None = None) -> tuple[str, ...]:
    guard = f" AND NOT (reward < 0 AND role_family_inferred = '{protected}')" if protected else ""
    rows = [
        f"SELECT profile_id, {_LIKED} || '_role_family' AS kind, role_family_inferred AS term FROM fb "
        f"WHERE reward <> 0 AND role_family_inferred <> 'unknown'{guard}",
        f"SELECT profile_id, {_LIKED} || '_company_size', lower(company_size_inferred) FROM fb WHERE "
        "reward <> 0 AND lower(company_size_inferred) <> 'unknown'",
        "SELECT profile_id, 'rejected_employment_type', lower(employment_type_inferred) FROM fb WHERE "
        "reward < 0 AND lower(employment_type_inferred) NOT IN ('unknown', 'full_time')",
        "SELECT profile_id, 'rejected_hard_constraints', 'non_us_location' FROM fb WHERE reward < 0 AND "
        "(is_non_us_location OR NOT passes_location_filter)",
        "SELECT profile_id, 'rejected_hard_constraints', 'security_clearance_or_defense' FROM fb WHERE "
        "reward < 0 AND is_defense_military_clearance",
        "SELECT profile_id, 'rejected_hard_constraints', 'contract_or_temp' FROM fb WHERE reward < 0 AND "
        "is_contract_or_temp",
        f"SELECT profile_id, {_LIKED} || '_skills', unnest({_SKILL_LIST}) FROM fb WHERE reward <> 0",
        f"SELECT profile_id, {_LIKED} || '_title_terms', unnest({TITLE_TERMS.format('title')}) FROM fb "
        "WHERE reward <> 0"]
    return (f"terms AS ({' UNION ALL '.join(rows)})",
            "prefs AS MATERIALIZED (SELECT profile_id, kind, term, count(*) AS cnt FROM terms GROUP BY ALL)")


FB = S.scored_ctes() + FEEDBACK
FB_RANKED = RANKED + FEEDBACK


@query("feedback_record", S.with_(*FB, select=(
    "SELECT profile_id, feedback_round, title, company, location, role_family_inferred, "
    "company_size_inferred, matched_skills, employment_type_inferred, required_years_min, final_score, "
    "is_non_us_location, passes_location_filter, is_defense_military_clearance, is_contract_or_temp, "
    "passes_all_active_constraints, feedback_label, reward, seq FROM fb")))
def feedback_record(spark, sf):
    return X.feedback(spark, sf)


@query("feedback_simulate", S.with_(*S.scored_ctes(), select=(
    "SELECT profile_id, row_index, CASE WHEN NOT passes_all_active_constraints OR (no_contract AND "
    f"is_contract_or_temp) OR ({S.inn('size_pref', (V.PREFER_LARGE, V.LARGE_ONLY))} AND is_tiny_startup) "
    "OR role_fit_score < 0 THEN 'Reject' WHEN role_fit_score >= 20 AND trim(matched_skills) <> '' THEN "
    "'Accept' ELSE 'Skip' END AS label FROM scored")))
def feedback_simulate(spark, sf):
    return X.scored(spark, sf).select(*KEYS, K.simulate_label().alias("label"))


@query("feedback_prefs", S.with_(*FB, *_prefs("ml_ai"), select="SELECT * FROM prefs"))
def feedback_prefs(spark, sf):
    return K.feedback_prefs(X.feedback(spark, sf), F.lit("ml_ai"))


@query("feedback_summary", S.with_(*FB, *_prefs(), (
    "net AS (SELECT profile_id, term, CAST(sum(cnt * CASE kind WHEN 'accepted_role_family' THEN 10 WHEN "
    "'rejected_role_family' THEN -10 WHEN 'accepted_skills' THEN 4 WHEN 'rejected_skills' THEN -4 WHEN "
    "'accepted_company_size' THEN 5 WHEN 'rejected_company_size' THEN -5 WHEN 'accepted_title_terms' THEN "
    "2 WHEN 'rejected_title_terms' THEN -2 WHEN 'rejected_employment_type' THEN -8 ELSE -15 END) AS "
    "BIGINT) AS net FROM prefs GROUP BY ALL)"), select=(
    "SELECT p.profile_id, coalesce((SELECT string_agg(term, ', ' ORDER BY net DESC, term) FROM (SELECT * "
    "FROM net WHERE net > 0 AND net.profile_id = p.profile_id ORDER BY net DESC, term LIMIT 8)), 'None "
    "yet') AS positive_summary, coalesce((SELECT string_agg(term, ', ' ORDER BY net, term) FROM (SELECT "
    "* FROM net WHERE net < 0 AND net.profile_id = p.profile_id ORDER BY net, term LIMIT 8)), 'None yet') "
    "AS negative_summary FROM (SELECT DISTINCT profile_id FROM prefs) p")))
def feedback_summary(spark, sf):
    return K.feedback_summary(K.feedback_prefs(X.feedback(spark, sf)))


@query("feedback_counts", S.with_(*FB, select=(
    "SELECT profile_id, count(*) FILTER (feedback_label = 'Accept') AS accepted, count(*) FILTER "
    "(feedback_label = 'Reject') AS rejected, count(*) FILTER (feedback_label = 'Skip') AS skipped FROM "
    "fb GROUP BY profile_id")))
def feedback_counts(spark, sf):
    return K.feedback_counts(X.feedback(spark, sf))


_KEY = "profile_id, title, company, location"


@query("first_round_labels", S.with_(*FB, select=(
    f"SELECT {_KEY}, arg_max(feedback_label, seq) AS feedback_label FROM fb WHERE (profile_id, "
    "feedback_round) IN (SELECT (profile_id, min(feedback_round)) FROM fb GROUP BY profile_id) GROUP BY "
    f"{_KEY}")))
def first_round_labels(spark, sf):
    return K.first_round_labels(X.feedback(spark, sf))


_LABELS = f"lab AS (SELECT {_KEY}, arg_max(feedback_label, seq) AS label FROM fb GROUP BY {_KEY})"


@query("join_feedback_label", S.with_(*FB, _LABELS, select=(
    "SELECT s.profile_id, s.row_index, coalesce(l.label, 'Skip') AS feedback_label FROM scored s LEFT "
    "JOIN lab l USING (profile_id, title, company, location)")))
def join_feedback_label(spark, sf):
    return K.join_feedback_label(X.scored(spark, sf).drop("feedback_label"), X.feedback(spark, sf)) \
        .select(*KEYS, "feedback_label")


def _count(kind: str, term: str) -> str:
    return f"coalesce(m['{kind}:' || {term}], 0)"


def _listed(kind: str, terms: str) -> str:
    return f"coalesce(list_sum(list_transform({terms}, lambda t: {_count(kind, 't')})), 0)"


_FAM, _SIZ, _EMP = "role_family_inferred", "lower(company_size_inferred)", "lower(employment_type_inferred)"
_TT = TITLE_TERMS.format("title")
_ADJ = (f"10 * {_count('accepted_role_family', _FAM)} - 10 * {_count('rejected_role_family', _FAM)} + "
        f"4 * {_listed('accepted_skills', _SKILL_LIST)} - 4 * {_listed('rejected_skills', _SKILL_LIST)} + "
        f"5 * {_count('accepted_company_size', _SIZ)} - 5 * {_count('rejected_company_size', _SIZ)} - "
        f"8 * {_count('rejected_employment_type', _EMP)} - CASE WHEN is_non_us_location OR NOT "
        f"passes_location_filter THEN 15 * {_count('rejected_hard_constraints', chr(39) + 'non_us_location' + chr(39))} "
        "ELSE 0 END - CASE WHEN is_defense_military_clearance THEN 15 * "
        f"{_count('rejected_hard_constraints', chr(39) + 'security_clearance_or_defense' + chr(39))} ELSE 0 END "
        "- CASE WHEN is_contract_or_temp THEN 12 * "
        f"{_count('rejected_hard_constraints', chr(39) + 'contract_or_temp' + chr(39))} ELSE 0 END + "
        f"2 * {_listed('accepted_title_terms', _TT)} - 2 * {_listed('rejected_title_terms', _TT)}")
ADJUSTED = (
    "pm AS (SELECT profile_id, map_from_entries(list((kind || ':' || term, cnt))) AS m FROM prefs GROUP BY "
    "profile_id)",
    f"adj0 AS MATERIALIZED (SELECT r.*, coalesce(CAST({_ADJ} AS BIGINT), 0) AS adjustment FROM ranked r "
    "LEFT JOIN pm USING (profile_id))",
    "adj1 AS (SELECT *, round_even((final_score + adjustment) * 100, 0) / 100 AS adjusted_score FROM adj0)",
    _LABELS,
    "rr AS MATERIALIZED (SELECT a.*, coalesce(l.label, 'Skip') AS new_label, row_number() OVER (PARTITION "
    "BY profile_id ORDER BY passes_all_active_constraints DESC, adjusted_score DESC, role_fit_score DESC, "
    "final_score DESC, title, a.rank) AS new_rank FROM adj1 a LEFT JOIN lab l USING (profile_id, title, "
    "company, location))")
RERANK = FB_RANKED + _prefs("ml_ai") + ADJUSTED


def _reranked(spark, sf):
    ranked = _ranked(spark, sf)
    given = X.feedback(spark, sf, ranked)
    return ranked, given, K.feedback_rerank(ranked, given, F.lit("ml_ai"))


@query("feedback_adjustment", S.with_(*RERANK, select=(
    "SELECT profile_id, row_index, adjustment, adjusted_score FROM adj1")))
def feedback_adjustment(spark, sf):
    # scored once: feedback is given on the postings that are adjusted
    scored = stored(X.scored(spark, sf).select(*N.RANKED_COLUMNS), "scored")
    prefs = K.feedback_prefs(X.feedback(spark, sf, scored), F.lit("ml_ai"))
    return K.feedback_adjustment(scored, prefs).select(
        *KEYS, F.col("feedback_adjustment_score").alias("adjustment"),
        F.col("adjusted_final_score").alias("adjusted_score"))


@query("join_feedback_terms", S.with_(*RERANK, select=(
    "SELECT a.profile_id, a.row_index, CAST(sum(p.cnt) AS BIGINT) AS title_count FROM (SELECT profile_id, "
    f"row_index, unnest({_TT}) AS term FROM ranked) a JOIN prefs p ON p.profile_id = a.profile_id AND "
    "p.term = a.term AND p.kind = 'accepted_title_terms' GROUP BY ALL")))
def join_feedback_terms(spark, sf):
    from matchlake.functions.text import title_terms
    prefs = K.feedback_prefs(X.feedback(spark, sf), F.lit("ml_ai")) \
        .where(F.col("kind") == "accepted_title_terms")
    pairs = join_profiles(X.jobs(spark, sf).select("row_index", "title"), X.demo_profiles(spark))
    terms = pairs.select(*KEYS, F.explode(title_terms(F.col("title"), K._DROPPED_TITLE_WORDS))
                         .alias("term"))
    return terms.join(prefs, ["profile_id", "term"]).groupBy(*KEYS) \
        .agg(F.sum("cnt").alias("title_count"))


@query("feedback_rerank", S.with_(*RERANK, select=(
    "SELECT profile_id, row_index, CAST(new_rank AS INTEGER) AS rank, CAST(rank AS INTEGER) AS "
    "baseline_rank, adjusted_score, new_label AS feedback_label FROM rr")))
def feedback_rerank(spark, sf):
    _, _, reranked = _reranked(spark, sf)
    return reranked.select(*KEYS, "rank", "baseline_rank", F.col("adjusted_final_score")
                           .alias("adjusted_score"), "feedback_label")


_LOOK = (f"lb AS (SELECT {_KEY}, max(rank) AS rank_before FROM ranked GROUP BY {_KEY})",
         f"la AS (SELECT {_KEY}, max(new_rank) AS rank_after, arg_max(adjusted_score, new_rank) AS score "
         f"FROM rr GROUP BY {_KEY})",
         "imp AS MATERIALIZED (SELECT * FROM (SELECT profile_id, title, company, location, feedback_label, "
         "seq FROM fb WHERE feedback_label IN ('Accept', 'Reject')) JOIN lb USING (profile_id, title, "
         "company, location) JOIN la USING (profile_id, title, company, location))")


@query("join_impact", S.with_(*RERANK, *_LOOK, select=(
    "SELECT profile_id, seq, feedback_label, CAST(rank_before AS INTEGER) AS rank_before, CAST(rank_after "
    "AS INTEGER) AS rank_after, score FROM imp")))
def join_impact(spark, sf):
    ranked, given, reranked = _reranked(spark, sf)
    return K.join_impact(given, ranked, reranked).select(
        "profile_id", "seq", "feedback_label", "rank_before", "rank_after",
        F.col("adjusted_final_score").alias("score"))


def _avg(label: str, column: str) -> str:
    return f"avg({column}) FILTER (feedback_label = '{label}')"


@query("feedback_impact", S.with_(*RERANK, *_LOOK, select=(
    "SELECT profile_id, " + ", ".join(
        f"{_avg(label, 'rank_before')} AS {n}_avg_rank_before, {_avg(label, 'rank_after')} AS "
        f"{n}_avg_rank_after, {_avg(label, 'score')} AS {n}_avg_adjusted_score"
        for label, n in (("Accept", "accepted"), ("Reject", "rejected")))
    + ", count(*) FILTER (feedback_label = 'Accept' AND rank_after < rank_before) AS accepted_promoted, "
    "count(*) FILTER (feedback_label = 'Reject' AND rank_after > rank_before) AS rejected_demoted FROM imp "
    "GROUP BY profile_id")))
def feedback_impact(spark, sf):
    ranked, given, reranked = _reranked(spark, sf)
    return K.feedback_impact(K.join_impact(given, ranked, reranked))


SHOWN_AFTER = SHOWN.replace("shown AS", "shown_after AS").replace("FROM ranked", "FROM rr") \
    .replace("ORDER BY rank", "ORDER BY new_rank")
_FIRST = (f"fr AS (SELECT {_KEY}, arg_max(feedback_label, seq) AS label FROM fb WHERE (profile_id, "
          "feedback_round) IN (SELECT (profile_id, min(feedback_round)) FROM fb GROUP BY profile_id) GROUP "
          f"BY {_KEY})")


def _judged(name: str, source: str, rank: str) -> str:
    return (f"{name} AS (SELECT profile_id, pos, rel, row_number() OVER (PARTITION BY profile_id ORDER BY "
            f"rel DESC) AS ideal FROM (SELECT s.profile_id, row_number() OVER (PARTITION BY s.profile_id "
            f"ORDER BY s.{rank}) AS pos, CASE fr.label WHEN 'Accept' THEN 2 WHEN 'Skip' THEN 1 ELSE 0 END "
            f"AS rel FROM {source} s LEFT JOIN fr USING (profile_id, title, company, location)))")


def _ndcg(name: str) -> str:
    return (f"{name}_n AS (SELECT profile_id, sum((pow(2, rel) - 1) / log2(pos + 1)) AS dcg, sum((pow(2, "
            f"rel) - 1) / log2(ideal + 1)) AS ideal_dcg FROM {name} GROUP BY profile_id)")


def _value(x: str) -> str:
    return f"CASE WHEN {x}.ideal_dcg = 0 THEN 0.0 ELSE {x}.dcg / {x}.ideal_dcg END"


@query("join_ndcg_labels", S.with_(*FB_RANKED, SHOWN, _FIRST, _judged("j", "shown", "rank"), select=(
    "SELECT profile_id, CAST(rel AS INTEGER) AS relevance, count(*) AS n FROM j GROUP BY ALL")))
def join_ndcg_labels(spark, sf):
    ranked = _ranked(spark, sf)
    judged = K.join_ndcg_labels(N.display_select(ranked), K.first_round_labels(
        X.feedback(spark, sf, ranked)))
    return judged.groupBy("profile_id", "relevance").agg(F.count("*").alias("n"))


def _events_judged() -> str:
    return ("ev AS (SELECT CAST(user_id AS VARCHAR) AS profile_id, CASE event_type WHEN 'purchase' THEN 2 "
            "WHEN 'error' THEN 0 ELSE 1 END AS rel, row_number() OVER (PARTITION BY user_id ORDER BY "
            "event_id) AS pos FROM events QUALIFY pos <= 10), "
            "j AS (SELECT *, row_number() OVER (PARTITION BY profile_id ORDER BY rel DESC) AS ideal FROM ev)")


def _judged_events(spark, sf):
    """Events per user in order, as judged list positions."""
    labels = {"purchase": "Accept", "error": "Reject"}
    label = F.when(F.col("event_type") == "purchase", labels["purchase"]) \
        .when(F.col("event_type") == "error", labels["error"]).otherwise("Skip")
    return X.table(spark, sf, "events").select(
        F.col("user_id").cast("string").alias("profile_id"), F.col("event_id").alias("rank"),
        K.relevance(label).alias("relevance"))


@query("dcg", S.with_(_events_judged(), _ndcg("j"), select=(
    "SELECT profile_id, round(dcg, 6) AS dcg, round(ideal_dcg, 6) AS ideal_dcg FROM j_n")))
def dcg(spark, sf):
    return K.ndcg(_judged_events(spark, sf)).select(
        "profile_id", F.round("dcg", 6).alias("dcg"), F.round("ideal_dcg", 6).alias("ideal_dcg"))


@query("ndcg", S.with_(_events_judged(), _ndcg("j"), select=(
    f"SELECT profile_id, round({_value('j_n')}, 6) AS ndcg FROM j_n")))
def ndcg(spark, sf):
    return K.ndcg(_judged_events(spark, sf)).select("profile_id", F.round("ndcg", 6).alias("ndcg"))


@query("feedback_ndcg", S.with_(
    *RERANK, SHOWN, SHOWN_AFTER, _FIRST, _judged("b", "shown", "rank"), _ndcg("b"),
    _judged("a", "shown_after", "new_rank"), _ndcg("a"), select=(
        f"SELECT profile_id, round({_value('b_n')}, 6) AS ndcg_before, round({_value('a_n')}, 6) AS "
        f"ndcg_after, round({_value('a_n')} - {_value('b_n')}, 6) AS ndcg_delta FROM b_n JOIN a_n USING "
        "(profile_id)")))
def feedback_ndcg(spark, sf):
    ranked, given, reranked = _reranked(spark, sf)
    out = K.feedback_ndcg(N.display_select(ranked), N.display_select(reranked),
                          K.first_round_labels(given))
    return out.select("profile_id", *[F.round(c, 6).alias(c)
                                      for c in ("ndcg_before", "ndcg_after", "ndcg_delta")])


@query("score_averages", S.with_(*RERANK, SHOWN, SHOWN_AFTER, select=(
    "SELECT profile_id, round(b, 6) AS baseline_avg, round(a, 6) AS adjusted_avg FROM (SELECT profile_id, "
    "avg(final_score) AS b FROM shown GROUP BY profile_id) JOIN (SELECT profile_id, avg(adjusted_score) AS "
    "a FROM shown_after GROUP BY profile_id) USING (profile_id)")))
def score_averages(spark, sf):
    ranked, _, reranked = _reranked(spark, sf)
    out = N.score_averages(N.display_select(ranked), N.display_select(reranked))
    return out.select("profile_id", *[F.round(c, 6).alias(c) for c in ("baseline_avg", "adjusted_avg")])


@query("feedback_reset", S.with_(*FB, select=(
    "SELECT f.profile_id, f.seq FROM fb f JOIN (SELECT profile_id, max(seq) AS last FROM fb WHERE "
    "feedback_round = 2 AND feedback_label = 'Skip' GROUP BY profile_id) r USING (profile_id) WHERE f.seq > "
    "r.last UNION ALL SELECT profile_id, seq FROM fb WHERE profile_id NOT IN (SELECT profile_id FROM fb "
    "WHERE feedback_round = 2 AND feedback_label = 'Skip')")))
def feedback_reset(spark, sf):
    feedback = X.feedback(spark, sf)
    resets = feedback.where((F.col("feedback_round") == 2) & (F.col("feedback_label") == "Skip"))
    return K.after_reset(feedback, resets.select("profile_id", "seq")).select("profile_id", "seq")


@query("stream_feedback", "SELECT user_id AS profile_id, CASE event_type WHEN 'purchase' THEN 'Accept' "
       "WHEN 'error' THEN 'Reject' ELSE 'Skip' END AS feedback_label, count(*) AS cnt FROM events GROUP BY ALL")
def stream_feedback(spark, sf):
    """Counts of labels per user, kept over twelve batches of the events."""
    events = X.table(spark, sf, "events")
    counts = SF.label_table(spark, scratch_path(spark, "counters"))
    run_to_end(SF.stream_labels(_in_rounds(spark, events, "event_id", 12), counts,
                                scratch_path(spark, "state"), PACED))
    return counts.read()


def _last_state(spark, path):
    states = spark.read.parquet(path)  # one folder per batch; progress reports may be dropped
    last = states.agg(F.max("state").alias("state"))
    return states.join(last, "state", "left_semi").drop("state")


def _in_rounds(spark, rows, order: str, rounds: int):
    """``rows`` as a stream of so many batches of equal size, in their order."""
    path = scratch_path(spark, "rounds-of")
    rows.repartitionByRange(order).sortWithinPartitions(order).write.parquet(path)
    n = spark.read.schema(rows.schema).parquet(path).count()
    return paced_stream(spark, path, rows.schema, max(1, -(-n // rounds)))


@query("stream_preferences", S.with_(*FB, *_prefs("ml_ai"), select="SELECT * FROM prefs"))
def stream_preferences(spark, sf):
    """Running (profile, kind, term) counters over twelve rounds; the last equal those of the batch."""
    counts = SF.preference_table(spark, scratch_path(spark, "preferences"), least_rows=500)
    run_to_end(SF.stream_preferences(_in_rounds(spark, X.feedback(spark, sf).select(*K.LEARNED_FROM),
                                                "seq", 12), counts,
                                     scratch_path(spark, "state"), F.lit("ml_ai"), PACED))
    return counts.read().select("profile_id", "kind", "term", "cnt")


@query("stream_rerank", S.with_(*RERANK, select=(
    "SELECT profile_id, row_index, CAST(new_rank AS INTEGER) AS rank, CAST(rank AS INTEGER) AS "
    "baseline_rank, adjusted_score, new_label AS feedback_label FROM rr")))
def stream_rerank(spark, sf):
    """The baseline ranked again in each of five rounds with all feedback so far; the last round."""
    baseline = stored(_ranked(spark, sf), "baseline")
    rounds, kept = scratch_path(spark, "rounds"), scratch_path(spark, "learned")

    def publish(ranked, number: int) -> None:
        ranked.select(*KEYS, "rank", "baseline_rank", F.col("adjusted_final_score").alias("adjusted_score"),
                      "feedback_label").write.mode("overwrite").parquet(f"{rounds}/state={number}")

    stream = _in_rounds(spark, X.feedback(spark, sf, baseline).select(*K.LEARNED_FROM), "seq", 5)
    run_to_end(SF.stream_rerank(
        stream, baseline, SF.preference_table(spark, f"{kept}/terms"),
        SF.last_label_table(spark, f"{kept}/labels"), scratch_path(spark, "state"), publish,
        F.lit("ml_ai"), trigger=PACED))
    return _last_state(spark, rounds)


@query("prepared_profiles", S.with_(S.PROFILES, select=(
    "SELECT profile_id, family, wants_us, wants_remote, wants_bay, wants_cal, jobs FROM prof, (SELECT "
    "count(*) AS jobs FROM documents)")))
def prepared_profiles(spark, sf):
    prepared = prepare_profiles(X.demo_profiles(spark)).select(
        "profile_id", F.col("p_family").alias("family"), F.col("p_wants_us").alias("wants_us"),
        F.col("p_wants_remote").alias("wants_remote"), F.col("p_wants_bay_area").alias("wants_bay"),
        F.col("p_wants_california").alias("wants_cal"))
    pairs = join_profiles(X.jobs(spark, sf).select("row_index"), X.demo_profiles(spark))
    counts = pairs.groupBy("profile_id").agg(F.count("*").alias("jobs"))
    return prepared.join(counts, "profile_id")
