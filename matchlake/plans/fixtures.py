"""Inputs of the registered queries, derived from the given tables.

Postings, profiles, candidate documents and feedback are projections of the tables:
every row of the source gives one row here, so the work of a query grows with its
table.  The expressions are plain SQL that Spark and other engines read alike.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matchlake import vocab as V
from matchlake.functions.text import split_keywords
from matchlake.operators.profiles import (PROFILE_SCHEMA, Profile, join_profiles,
                                          profiles_frame, retrieved_pairs)
from matchlake.operators.signals import job_signals
from matchlake.operators.scoring import score_pairs

TITLES = ("Senior Data Scientist", "Junior Data Analyst", "Machine Learning Engineer",
          "Java Developer", "Online Course Instructor", "Engineering Manager",
          "MLOps Platform Engineer", "Research Scientist", "Business Intelligence Analyst",
          "Night Shift Data Coordinator", "Data Engineering Intern",
          "Staff Software Engineer")
LOCATIONS = ("San Francisco, CA, US", "Remote - US", "Sacramento CA",
             "Toronto, Ontario, CA", "London, UK", "Unknown", "", "Austin TX", "Remote",
             "Berlin, DE", "New York NY", "Milwaukee, WI", "Indianapolis, IN")
SALARIES = ("$92000", "Unknown", "", '{"value": "120000"}',
            '{"minValue": 90000, "maxValue": 130000, "period": "year"}',
            "$80,000 - $100,000", "$25 per hour", "70000-90000",
            '{"minValue": 20, "maxValue": 30, "period": "hour"}', "Competitive salary",
            "210000", '{"text": "$175,500 yearly"}')
PHRASES = ("Requires 3+ years of experience with Python and SQL.",
           "Minimum 5 years of experience. Kubernetes, Docker, AWS.",
           "Tableau and Power BI dashboards; 2-4 years.", "Contract role, hourly rate.",
           "Volunteer, unpaid position.", "Active security clearance required.",
           "Visa sponsorship available for H-1B.",
           "No sponsorship. Must be authorized to work.",
           "Early-stage startup with a small team.", "Fortune 500 global company.",
           "Fewer than 50 employees.", "About 2500 employees worldwide.",
           "Hybrid schedule, on-site two days.", "Deep learning with PyTorch and NLP.",
           "Full time role in the Bay Area.", "Spark, Kafka and model serving.",
           "Reporting and accounting, founded five years ago.",
           "At least four years in sales.", "Work from home, remote user support.")
SOURCES = ("", "job_posting_location", "company_location_if_only_available",
           "raw_location_field", "")
EMPLOYEES = ("", "12", "", "75", "", "640", "unknown", "5200", "", "25000", "", "-3", "")
COMPANIES = ("", "Lockheed Martin", "", "Northstar Health", "")


def case(column: str, values: tuple[str, ...]) -> str:
    """SQL CASE that deals ``values`` out by a column's remainder."""
    arms = " ".join("WHEN {} THEN '{}'".format(i, v.replace("'", "''"))
                    for i, v in enumerate(values))
    return f"CASE CAST(({column}) % {len(values)} AS INT) {arms} END"


JOB_COLUMNS = {
    "row_index": "doc_id", "job_id": "CAST(doc_id AS STRING)",
    "title": case("doc_id", TITLES),
    "company": f"coalesce(nullif({case('doc_id', COMPANIES)}, ''), source)",
    "location": case("doc_id", LOCATIONS), "raw_location": "''",
    "location_source": case("doc_id", SOURCES), "salary": case("doc_id", SALARIES),
    "description": f"concat(text, ' ', {case('doc_id', PHRASES)})",
    "apply_link": "concat('https://jobs.example.com/', CAST(doc_id AS STRING))",
    "employment_type": "''", "employee_count": case("doc_id", EMPLOYEES),
}

ROLES = ("machine learning engineer", "data analyst / bi analyst", "mlops engineer", "",
         "research scientist; applied scientist", "ml platform engineer", "gardener")
PLACES = ("remote us", "san francisco bay area", "US only", "", "California", "Berlin",
          "New York City", "canada", "in or me")
SKILL_TEXTS = ("Python, SQL; PyTorch", "sql, tableau, power bi", "Kubernetes, docker, spark",
               "", "r, A/B testing. certified python\nsome etl", "SQL, sql, nlp")
BREAKERS = ("senior, defense", "commission only", "5+ years", "", "staff; military\nnavy")
PROFILE_COLUMNS = {
    "profile_id": "CAST(c_custkey AS STRING)",
    "target_role": case("c_custkey", ROLES),
    "preferred_location": case("c_custkey", PLACES),
    "skills_text": case("c_custkey", SKILL_TEXTS),
    "dealbreakers_text": case("c_custkey", BREAKERS),
    "seniority_preference": case("c_custkey", (
        V.NO_PREFERENCE, V.ENTRY_ONLY, V.JUNIOR_TO_MID, V.MID_TO_SENIOR,
        V.SENIOR_PREFERRED, V.EXCLUDE_SENIOR, V.EXCLUDE_JUNIOR)),
    "avoid_contract": "(c_custkey % 2 = 0)", "avoid_unpaid": "(c_custkey % 3 = 0)",
    "avoid_internship": "(c_custkey % 5 = 0)",
}

#: Whole settings of a profile, one per customer.
CUSTOMER_SETTINGS = {
    "minimum_salary": "CAST(c_custkey % 3 * 60000 AS INT)",
    "role_fit_strictness": case("c_custkey", ("Balanced", "Strict", "Flexible")),
    "location_strictness": case("c_custkey + 1", ("Balanced", "Strict", "Flexible")),
    "max_required_years": "CAST(nullif(c_custkey % 9, 8) AS INT)",
    "avoid_defense": "(c_custkey % 7 = 1)", "avoid_internship": "(c_custkey % 6 = 5)",
    "visa_sponsorship": case("c_custkey", (
        V.NO_PREFERENCE, "Sponsorship required", "Prefer sponsor-friendly")),
    "company_preference": case("c_custkey + 2", (
        "Prefer tech", V.NO_PREFERENCE, "Avoid tiny startups")),
    "company_size_preference": case("c_custkey", (
        V.NO_PREFERENCE, V.EXCLUDE_TINY, V.LARGE_ONLY, V.PREFER_SMALL, V.PREFER_MEDIUM,
        V.PREFER_LARGE)),
    "salary_strictness": case("c_custkey", ("Soft", "Medium", "Strict")),
    "dealbreakers_text": case("c_custkey % 3 + 2 * (c_custkey % 2)", BREAKERS)}

RESUME_HEAD = ("Persona 1 - Jordan Lee", "Alex Kim", "  Sam   Rivera  ",
               "Persona — Casey Doe — Analyst")
RESUME_PARTS = (
    "Summary: Data analyst with 3 years in experience.\nSkills\nPython, SQL, Spark\n",
    "Background: MS degree student at a university.\nTarget Role: mlops engineer\n"
    "Experience:\nBuilt dashboards with SQL and Tableau\nNo senior roles\n",
    "Profile\nCurious engineer.\nTechnical Skills: Docker, Kubernetes, Airflow\n"
    "Preferences\nRemote only\nProjects\nDesigned a model serving platform on AWS\n",
    "Dealbreakers: no 5+ years\nWork Experience\nLed Kafka and Spark migrations\n"
    "Education:\nBachelor of Science\n",
    "Contact me:\nAn opening line about A/B testing.\nSalary: 100000\nskills: sql\n")
RESUME_TEXT = (f"concat({case('doc_id', RESUME_HEAD)}, chr(10), "
               f"{case('doc_id', RESUME_PARTS)}, text, chr(10), "
               f"{case('doc_id + 2', RESUME_PARTS)})")

DEMO_PROFILES = (
    Profile("p1", "machine learning engineer", ["python", "sql", "pytorch"], "remote us",
            100_000, ["senior", "defense"], seniority_preference=V.JUNIOR_TO_MID,
            max_required_years=3, salary_strictness="Medium",
            visa_sponsorship="Sponsorship required", company_preference="Prefer tech"),
    Profile("p2", "data analyst / bi analyst", ["sql", "tableau", "power bi"],
            "san francisco bay area", 80_000, ["commission only"],
            location_strictness="Strict", avoid_contract=True, avoid_unpaid=True,
            company_size_preference=V.EXCLUDE_TINY,
            company_preference="Avoid tiny startups"),
    Profile("p3", "mlops engineer", ["kubernetes", "docker", "spark"], "US only", 150_000,
            ["5+ years"], role_fit_strictness="Strict",
            seniority_preference=V.SENIOR_PREFERRED, company_size_preference=V.LARGE_ONLY,
            salary_strictness="Strict", location_strictness="Strict", avoid_defense=True,
            visa_sponsorship="Prefer sponsor-friendly"),
    Profile("p4"),
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, key: str) -> DataFrame:
    """Use all cores for a table that is stored in fewer splits than there are cores."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if df.rdd.getNumPartitions() < cores else df


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents"), "doc_id")


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Postings, one per document."""
    return documents(spark, sf_dir).selectExpr(
        *[f"{sql} AS {name}" for name, sql in JOB_COLUMNS.items()])


def signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return job_signals(jobs(spark, sf_dir))


def demo_profiles(spark: SparkSession) -> DataFrame:
    return profiles_frame(spark, DEMO_PROFILES)


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every posting with the demo profiles."""
    return join_profiles(signals(spark, sf_dir), demo_profiles(spark))


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_pairs(pairs(spark, sf_dir))


def profile_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Profiles as typed, one per customer."""
    return table(spark, sf_dir, "customer").selectExpr(
        *[f"{sql} AS {name}" for name, sql in PROFILE_COLUMNS.items()])


def customer_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Profiles with all settings, one per customer."""
    columns = PROFILE_COLUMNS | CUSTOMER_SETTINGS
    rows = table(spark, sf_dir, "customer").selectExpr(
        *[f"{sql} AS {name}" for name, sql in columns.items()])
    return rows.withColumns({"skills": split_keywords(F.col("skills_text")),
                             "dealbreakers": split_keywords(F.col("dealbreakers_text"))}) \
        .select(*[p.split()[0] for p in PROFILE_SCHEMA.split(", ")])


def resumes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidate documents with headed sections, one per document."""
    return documents(spark, sf_dir).selectExpr(
        "doc_id", f"{RESUME_TEXT} AS text", f"{case('doc_id', SKILL_TEXTS)} AS skills_text",
        f"{case('doc_id', ROLES)} AS target_role")


# --- raw JSON records -------------------------------------------------------------------

def raw_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(line_no, value): one raw JSON line per document; some blank, broken or arrays."""
    n = F.col("doc_id")

    def some(modulus: int, rest: int, value):
        return F.when(n % modulus == rest, value)

    title, place = F.expr(JOB_COLUMNS["title"]), F.expr(JOB_COLUMNS["location"])
    text = F.concat(F.lit("<p>R&amp;D &lt;team&gt;</p> "), F.col("text"))
    name = F.when(n % 29 != 0, title)
    record = F.struct(
        F.when(n % 4 != 0, F.concat(F.lit("src-"), n.cast("string"))).alias("idInSource"),
        F.struct(F.when(n % 8 != 0, F.concat(F.lit("oid-"), n.cast("string")))
                 .alias("$oid")).alias("_id"),
        F.when(n % 3 == 1, F.struct(name.alias("name"))).alias("position"),
        some(3, 2, name).alias("name"),
        some(3, 0, text).alias("text"), some(3, 2, text).alias("html"),
        some(4, 1, F.lit("")).alias("salary"),
        F.struct(F.when(n % 5 != 0, F.col("source")).alias("name")).alias("orgCompany"),
        some(4, 2, F.struct(F.lit("Austin").alias("city"), F.lit("").alias("state"),
                            F.lit("US").alias("country"))).alias("orgAddress"),
        some(2, 0, F.concat(F.lit("https://x.example/"), n.cast("string"))).alias("url"),
        F.struct(F.struct(
            some(3, 0, name).alias("title"), some(3, 1, text).alias("description"),
            F.when(n % 10 != 0, F.struct(F.concat(F.lit("Org "), F.col("source"))
                                         .alias("name"))).alias("hiringOrganization"),
            F.struct(F.when(n % 4 == 0, F.struct(
                place.alias("addressLocality"), F.lit("Reg").alias("addressRegion"),
                F.when(n % 8 == 0, F.lit("US")).alias("addressCountry")))
                .alias("address")).alias("jobLocation"),
            some(4, 1, F.struct(n.alias("value"), F.lit("year").alias("period")))
            .alias("baseSalary")).alias("schemaOrg")).alias("json"),
        F.array(F.struct(F.lit(1).alias("tag"), F.array(F.struct(F.lit(2).alias("deep")))
                         .alias("inner"))).alias("tags"))
    line = F.when(n % 31 == 0, "  ").when(n % 37 == 0, "{broken") \
        .when(n % 41 == 0, "[1, 2]").otherwise(F.to_json(record))
    return documents(spark, sf_dir).select((n + 1).alias("line_no"), line.alias("value"))


# --- vectors and feedback ---------------------------------------------------------------------

def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "embeddings"), "vec_id") \
        .select(F.col("vec_id").alias("row_index"), "embedding")


def query_vectors(spark: SparkSession, sf_dir: str, per_label: bool = True) -> DataFrame:
    """One query per label: the vector with the lowest id of that label."""
    rows = table(spark, sf_dir, "embeddings")
    return rows.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("embedding")) \
        .select(F.concat(F.lit("q"), F.col("label").cast("string")).alias("profile_id"),
                "embedding")


FEEDBACK_LABEL = ("CASE WHEN toxic = 1 THEN 'Reject' WHEN quality = 1 THEN 'Accept' "
                  "ELSE 'Skip' END")


def feedback(spark: SparkSession, sf_dir: str, shown: DataFrame | None = None) -> DataFrame:
    """Feedback on scored postings: one record per labelled document and profile.

    ``shown`` are postings that have been scored already, as in a running session.  Without it
    only labelled postings are scored, each for the profile that labelled it.
    """
    from matchlake.operators.feedback import feedback_records
    labels = table(spark, sf_dir, "labels").selectExpr(
        "doc_id AS row_index", f"{FEEDBACK_LABEL} AS given",
        "concat('p', CAST(doc_id % 4 + 1 AS STRING)) AS profile_id")
    judged = shown.join(labels, ["row_index", "profile_id"]) if shown is not None else \
        score_pairs(retrieved_pairs(jobs(spark, sf_dir), labels, demo_profiles(spark)))
    return feedback_records(judged, F.col("given"), (F.col("row_index") % 3 + 1).cast("int"),
                            F.col("row_index"))
