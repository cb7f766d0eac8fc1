"""Registered queries against their SQL answers on the smallest data set."""

import os
import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from matchlake.operators.order import top_k, values_at
from matchlake.operators.scoring import embedding_bonus

SF_DIR = "/root/testdata/sf0.001"
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()
CHECKED = ("src_ndjson", "map_record", "json_key_profile", "dedupe_first", "stream_batch_log",
           "stream_log", "job_constraints", "coverage_summary", "final_explanation", "rank_jobs",
           "display_select", "topk_profiles", "embedding_bonus", "stream_feedback", "balanced_sample", "feedback_rerank",
           "doc_sections", "doc_semantic_text")


def rows_of(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(round(r[i], 6) if isinstance(r[i], float) else r[i] for i in order)
                   for r in rows), key=repr)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF_DIR}/{t}.parquet'")
    return con


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="test tables are not here")
@pytest.mark.parametrize("name", CHECKED)
def test_query(spark, duck, name):
    df = entry.queries()[name](spark, SF_DIR)
    answer = duck.execute(entry.oracle_sql()[name])
    columns = [d[0] for d in answer.description]
    assert sorted(df.columns) == sorted(columns)
    assert rows_of(df.collect(), df.columns) == rows_of(answer.fetchall(), columns)


def test_every_answer_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_top_k_limits_before_the_shuffle(spark, capsys):
    rows = spark.range(20_000).selectExpr("id % 3 AS g", "id")
    top_k(rows, ["g"], [F.col("id").desc()], 500).explain()
    plan = capsys.readouterr().out
    assert plan.rindex("WindowGroupLimit") > plan.rindex("Exchange")
    setting = spark.conf.get("spark.sql.optimizer.windowGroupLimitThreshold")
    best = top_k(rows, ["g"], [F.col("id").desc()], 5_000)
    assert spark.conf.get("spark.sql.optimizer.windowGroupLimitThreshold") == setting
    assert best.count() == 15_000
    assert {r.id for r in best.where("rank = 5000").collect()} == {5_000, 5_001, 5_002}


def test_values_at_ranks(spark):
    values = [7, 7, 7, -2, 9, 9, 100, 3, 3, 3, 3]
    rows = spark.createDataFrame([(v,) for v in values], "a int")
    assert values_at(rows, "a", lambda n: range(n)) == sorted(values)
    assert values_at(rows.limit(0), "a", lambda n: [0]) == []
    many = spark.range(5_000).selectExpr("cast(hash(id) AS double) AS a")
    want = sorted(r[0] for r in many.collect())
    assert values_at(many, "a", lambda n: (0, n // 3, n - 1)) == [want[0], want[1_666], want[-1]]


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="test tables are not here")
@pytest.mark.parametrize("streamed, batch", [("stream_preferences", "feedback_prefs"),
                                             ("stream_rerank", "feedback_rerank")])
def test_feedback_stream_equals_batch(spark, duck, streamed, batch):
    df = entry.queries()[streamed](spark, SF_DIR)
    given = entry.queries()[batch](spark, SF_DIR)
    assert sorted(df.columns) == sorted(given.columns)
    found = rows_of(df.collect(), df.columns)
    assert found and found == rows_of(given.collect(), given.columns)
    assert entry.oracle_sql()[streamed] == entry.oracle_sql()[batch]


def test_bonus_of_all_retrieved_candidates(spark, tmp_path):
    draw = np.random.default_rng(3)
    rows = [(i, i % 2, [float(x) for x in draw.normal(size=8)]) for i in range(700)]
    spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>") \
        .write.parquet(str(tmp_path / "embeddings.parquet"))
    name = "embedding_bonus_candidates"
    found = entry.queries()[name](spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    answer = con.execute(entry.oracle_sql()[name])
    columns = [d[0] for d in answer.description]
    got = rows_of(found.collect(), found.columns)
    assert len(got) == 1_000 and got == rows_of(answer.fetchall(), columns)
    # the cut by hand: similarity of every vector with each query
    all_vectors = np.array([r[2] for r in rows], np.float32).astype(np.float64)
    unit = all_vectors / np.linalg.norm(all_vectors, axis=1)[:, None]
    for q in range(2):
        best = set(np.argsort(-(unit @ unit[q]), kind="stable")[:500].tolist())
        assert {r["row_index"] for r in found.where(f"profile_id = 'q{q}'").collect()} == best


def test_bonus_without_a_similarity(spark):
    rows = spark.createDataFrame([(None,), (0.5,)], "s double").select(embedding_bonus(F.col("s")))
    assert [r[0] for r in rows.collect()] == [0.0, 15.0]


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="test tables are not here")
def test_documents_are_paired_with_all_displayed_postings(spark, tmp_path):
    documents = spark.read.parquet(f"{SF_DIR}/documents.parquet").where("doc_id < 120")
    documents.write.parquet(str(tmp_path / "documents.parquet"))
    sf = str(tmp_path)
    shown = {(r.profile_id, r.row_index) for r in entry.queries()["display_select"](spark, sf).collect()}
    assert len({p for p, _ in shown}) == 4
    want = sorted((p, d.doc_id, i) for d in documents.collect() for p, i in shown)
    for name in ("pair_keywords", "pair_infra_skills", "doc_evidence_lines"):
        pairs = entry.queries()[name](spark, sf).collect()
        assert sorted((r.profile_id, r.doc_id, r.row_index) for r in pairs) == want


# fixed values: the words that the rules of pairs look for
INFRA_TERMS = ("aws", "azure", "cloud", "cloud infrastructure", "airflow", "data pipeline", "databricks",
               "docker", "feature pipeline", "gcp", "kafka", "kubernetes", "microservices",
               "ml infrastructure", "ml platform", "mlflow", "mlops", "model deployment",
               "model serving", "production ml", "spark", "tensorflow serving", "terraform")
CONTEXT_TERMS = ("ai infrastructure", "machine learning infrastructure", "machine learning platform",
                 "ml infrastructure", "ml platform", "mlops", "model deployment", "model serving",
                 "production machine learning", "production ml")


def test_values_of_pairs_equal_a_walk_over_each_pair(spark):
    """Keywords, infrastructure skills and evidence lines of every pair, one pair at a time."""
    from matchlake.functions import documents as D
    from matchlake.operators import documents as W
    from matchlake.plans import fixtures as X

    docs = W.candidate_documents(X.resumes(spark, SF_DIR).where("doc_id < 60"))
    postings = [
        ("p1", 1, "Platform Engineer", "We use SPARK, python and Kafka.", "python, sql", "mlops_infra"),
        ("p1", 2, "platform lead", "tableau and r", "", "unknown"),
        ("p2", 1, "", "", "", ""), ("p2", 3, "Nurse", "night shift in production", "sql", "serving"),
        ("p2", 4, "Analyst", "model deployment with docker " + "x " * 200, "docker", "data")]
    shown = spark.createDataFrame(postings, "profile_id string, row_index long, title string, "
                                            "description string, matched_skills string, "
                                            "role_family_inferred string")
    found = {(r.profile_id, r.row_index, r.doc_id): r for r in W.pair_documents(docs, shown).collect()}
    rows = docs.withColumn("actions", D.action_lines(
        F.col("text"), F.col("candidate_name"), F.col("background"), F.col("relevant_skills"))).collect()
    assert len(found) == len(rows) * len(postings)
    infra = 0
    for d in rows:
        for profile, number, title, description, matched, family in postings:
            keys = {p.strip().lower() for p in re.split("[,;\\n]+", matched)}
            words = [s for s in d.relevant_skills if s.lower() in description.lower()
                     or s.lower() in keys][:10] or d.relevant_skills[:10]
            context = " ".join([d.target_role, title, description, matched, family, d.text]).lower()
            ml = family.lower() == "mlops_infra" or any(t in context for t in CONTEXT_TERMS)
            r = found[profile, number, d.doc_id]
            assert r.job_keywords == words
            assert r.infra_skills == [s for s in d.relevant_skills if ml and s.lower() in INFRA_TERMS]
            assert r.evidence_lines == [x for x in d.actions if any(
                w.lower() in x.lower() for w in words)][:4]
            infra += bool(r.infra_skills)
    assert infra and any(r.evidence_lines for r in found.values())
    # a term across two texts
    docs = docs.limit(1).withColumn("target_role", F.lit("lead of machine learning")) \
        .withColumn("text", F.lit("nothing here")).withColumn("relevant_skills", F.array(F.lit("Docker")))
    across = {r.row_index: r.infra_skills for r in W.pair_documents(docs, shown.where("profile_id = 'p1'")
                                                                    .where("row_index = 2")).collect()}
    assert across == {2: ["Docker"]}
