"""Feedback: records, learned preferences, adjusted ranking and its metrics.

Preferences are a long table (profile_id, kind, term, cnt) per profile.  Applied to
ranked postings they are folded into one map per profile, whose size depends on the
vocabulary of titles and skills, not on the number of postings or feedback records.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchlake import vocab as V
from matchlake.functions.text import comma_values, strip, text_or_empty, title_terms
from matchlake.functions.vectors import round2
from matchlake.operators.order import stored, top_k
from matchlake.operators.ranking import JOB_KEY, rerank

RECORD_FIELDS = (
    "profile_id", "feedback_round", "title", "company", "location", "role_family_inferred",
    "company_size_inferred", "matched_skills", "employment_type_inferred",
    "required_years_min", "final_score", "is_non_us_location", "passes_location_filter",
    "is_defense_military_clearance", "is_contract_or_temp",
    "passes_all_active_constraints", "feedback_label", "reward", "seq")
_DROPPED_TITLE_WORDS = V.TITLE_STOP_WORDS + V.GENERIC_ROLE_WORDS + V.FEEDBACK_IGNORED_TERMS


def reward(label: Column) -> Column:
    value = F.lit(0)
    for name, points in V.REWARDS.items():
        value = F.when(label == name, points).otherwise(value)
    return value


def feedback_records(jobs: DataFrame, label: Column, round_no: Column, seq: Column) -> DataFrame:
    """Feedback records of shown postings; ``seq`` gives their order."""
    return jobs.withColumns({"feedback_label": label, "feedback_round": round_no, "seq": seq}) \
        .withColumn("reward", reward(F.col("feedback_label"))).select(*RECORD_FIELDS)


def simulate_label() -> Column:
    """Rule label of a ranked posting for its profile."""
    fit = F.col("role_fit_score")
    large = F.col("company_size_preference").isin(V.PREFER_LARGE, V.LARGE_ONLY)
    passes = F.col("passes_all_active_constraints")
    return F.when(~passes, "Reject") \
        .when(F.col("p_avoid_contract") & F.col("is_contract_or_temp"), "Reject") \
        .when(large & F.col("is_tiny_startup"), "Reject") \
        .when(fit < 0, "Reject") \
        .when((fit >= 20) & (strip(F.col("matched_skills")) != ""), "Accept") \
        .otherwise("Skip")


def after_reset(feedback: DataFrame, resets: DataFrame) -> DataFrame:
    """Records given after the last reset of their profile (profile_id, seq)."""
    last = resets.groupBy("profile_id").agg(F.max("seq").alias("_reset"))
    return feedback.join(last, "profile_id", "left") \
        .where(F.col("_reset").isNull() | (F.col("seq") > F.col("_reset"))).drop("_reset")


# --- learned preferences ---------------------------------------------------------------

def _terms(c: str) -> Column:
    return F.lower(strip(text_or_empty(F.col(c))))


def feedback_terms(feedback: DataFrame, protected: Column | None = None) -> DataFrame:
    """(profile_id, kind, term): one row per counted term of the non-neutral records."""
    liked = F.when(F.col("reward") > 0, "accepted").otherwise("rejected")
    disliked = F.col("reward") < 0
    shielded = (disliked & (F.col("_family") == protected)) if protected is not None \
        else F.lit(False)

    def entry(kind: Column | str, term: Column | str, condition: Column) -> Column:
        kind = kind if isinstance(kind, Column) else F.lit(kind)
        term = term if isinstance(term, Column) else F.lit(term)
        return F.when(condition, F.array(F.struct(kind.alias("kind"), term.alias("term"))))

    def entries(kind: str, terms: Column) -> Column:
        return F.transform(terms, lambda t: F.struct(
            F.concat(liked, F.lit(kind)).alias("kind"), t.alias("term")))

    df = feedback.where(F.col("reward") != 0).withColumns({
        "_family": _terms("role_family_inferred"), "_size": _terms("company_size_inferred"),
        "_type": _terms("employment_type_inferred")})
    counted_type = disliked & ~F.col("_type").isin("", "unknown", *V.FEEDBACK_IGNORED_TERMS)
    away = F.coalesce(F.col("is_non_us_location"), F.lit(False)) \
        | ~F.coalesce(F.col("passes_location_filter"), F.lit(True))
    hard = "rejected_hard_constraints"
    every = F.flatten(F.array_compact(F.array(
        entry(F.concat(liked, F.lit("_role_family")), F.col("_family"),
              ~F.col("_family").isin("", "unknown") & ~F.coalesce(shielded, F.lit(False))),
        entry(F.concat(liked, F.lit("_company_size")), F.col("_size"),
              ~F.col("_size").isin("", "unknown")),
        entry("rejected_employment_type", F.col("_type"), counted_type),
        entry(hard, "non_us_location", disliked & away),
        entry(hard, "security_clearance_or_defense",
              disliked & F.col("is_defense_military_clearance")),
        entry(hard, "contract_or_temp", disliked & F.col("is_contract_or_temp")),
        entries("_skills", comma_values(F.col("matched_skills"), V.FEEDBACK_IGNORED_TERMS)),
        entries("_title_terms", title_terms(F.col("title"), _DROPPED_TITLE_WORDS)))))
    return df.select("profile_id", F.explode(every).alias("t")).select("profile_id", "t.*")


#: What counters and labels are made of.
LEARNED_FROM = ("profile_id", *JOB_KEY, "feedback_label", "reward", "seq", "role_family_inferred",
                "company_size_inferred", "employment_type_inferred", "is_non_us_location",
                "passes_location_filter", "is_defense_military_clearance", "is_contract_or_temp",
                "matched_skills")


def feedback_prefs(feedback: DataFrame, protected: Column | None = None) -> DataFrame:
    """Counters (profile_id, kind, term, cnt)."""
    return feedback_terms(feedback, protected).groupBy("profile_id", "kind", "term") \
        .agg(F.count(F.lit(1)).alias("cnt"))


def preference_maps(prefs: DataFrame) -> DataFrame:
    """One map "kind:term" → count per profile."""
    return prefs.groupBy("profile_id").agg(F.map_from_entries(F.collect_list(F.struct(
        F.concat_ws(":", "kind", "term"), "cnt"))).alias("_prefs"))


def adjustment(prefs: Column) -> Column:
    """Struct (points, reasons) of the learned preferences for one posting."""
    def count(kind: str, term: Column | str) -> Column:
        key = F.concat(F.lit(kind + ":"), term) if isinstance(term, Column) \
            else F.lit(f"{kind}:{term}")
        return F.coalesce(F.try_element_at(prefs, key), F.lit(0))

    family, size = _terms("role_family_inferred"), _terms("company_size_inferred")
    kind = _terms("employment_type_inferred")
    skills = comma_values(F.col("matched_skills"), V.FEEDBACK_IGNORED_TERMS)
    titles = title_terms(F.col("title"), _DROPPED_TITLE_WORDS)
    away = F.col("is_non_us_location") | ~F.col("passes_location_filter")
    points, reasons = F.lit(0).cast("bigint"), []

    def add(sign: int, value: Column, text: str, detail: Column | None = None) -> None:
        nonlocal points
        points = points + sign * value
        head = F.concat(F.lit("+" if sign > 0 else "-"), value.cast("string"),
                        F.lit(f" {text}"))
        reasons.append(F.when(value > 0, head if detail is None
                              else F.concat(head, F.lit(": "), detail)))

    def single(sign: int, weight: int, name: str, term: Column, text: str) -> None:
        add(sign, F.when(term != "", weight * count(name, term)).otherwise(0), text, term)

    def listed(sign: int, weight: int, name: str, terms: Column, text: str) -> None:
        hit = F.filter(terms, lambda t: count(name, t) > 0)
        total = F.aggregate(hit, F.lit(0).cast("bigint"), lambda a, t: a + count(name, t))
        add(sign, weight * total, text, F.array_join(F.slice(hit, 1, 5), ", "))

    def hard(weight: int, name: str, flag: Column, text: str) -> None:
        add(-1, F.when(flag, weight * count("rejected_hard_constraints", name)).otherwise(0),
            f"rejected hard constraint: {text}")

    # fixed values: weights of the learned preferences
    single(1, 10, "accepted_role_family", family, "accepted role family")
    single(-1, 10, "rejected_role_family", family, "rejected role family")
    listed(1, 4, "accepted_skills", skills, "accepted skills")
    listed(-1, 4, "rejected_skills", skills, "rejected skills")
    single(1, 5, "accepted_company_size", size, "accepted company size")
    single(-1, 5, "rejected_company_size", size, "rejected company size")
    single(-1, 8, "rejected_employment_type", kind, "rejected employment type")
    hard(15, "non_us_location", away, "non-US/location mismatch")
    hard(15, "security_clearance_or_defense", F.col("is_defense_military_clearance"),
         "security/defense")
    hard(12, "contract_or_temp", F.col("is_contract_or_temp"), "contract/temp")
    listed(1, 2, "accepted_title_terms", titles, "accepted title terms")
    listed(-1, 2, "rejected_title_terms", titles, "rejected title terms")
    return F.struct(points.alias("points"),
                    F.array_join(F.array_compact(F.array(*reasons)), "; ").alias("reasons"))


def feedback_adjustment(ranked: DataFrame, prefs: DataFrame) -> DataFrame:
    """Ranked postings with adjustment, reason and adjusted score.

    The maps are stored, one row per profile: few are broadcast then, and postings are not
    dealt to as many tasks as there are profiles.
    """
    df = ranked.join(stored(preference_maps(prefs), "preferences"), "profile_id", "left") \
        .withColumn("_a", adjustment(F.col("_prefs")))
    return df.withColumns({
        "feedback_adjustment_score": F.coalesce(F.col("_a.points"), F.lit(0)),
        "feedback_adjustment_reason": F.coalesce(F.col("_a.reasons"), F.lit("")),
        "adjusted_final_score": round2(
            F.col("final_score") + F.coalesce(F.col("_a.points"), F.lit(0)))}) \
        .drop("_prefs", "_a")


def last_labels(feedback: DataFrame) -> DataFrame:
    """Latest label per (profile, posting key)."""
    return feedback.groupBy("profile_id", *JOB_KEY).agg(
        F.max_by("feedback_label", "seq").alias("_label"))


def with_labels(ranked: DataFrame, labels: DataFrame) -> DataFrame:
    """Ranked postings with the label of ``last_labels``, 'Skip' without one."""
    return ranked.join(labels, ["profile_id", *JOB_KEY], "left") \
        .withColumn("feedback_label", F.coalesce("_label", F.lit("Skip"))).drop("_label")


def join_feedback_label(ranked: DataFrame, feedback: DataFrame) -> DataFrame:
    """Give every ranked posting its latest feedback label, 'Skip' when it has none."""
    return with_labels(ranked, last_labels(feedback))


def feedback_rerank(ranked: DataFrame, feedback: DataFrame, protected: Column | None = None,
                    k: int | None = None) -> DataFrame:
    """Baseline ranking adjusted by all feedback, labelled and ranked again."""
    return rerank_learned(ranked, feedback_prefs(feedback, protected), last_labels(feedback), k)


def rerank_learned(ranked: DataFrame, prefs: DataFrame, labels: DataFrame,
                   k: int | None = None) -> DataFrame:
    """Baseline ranking adjusted by counters, labelled and ranked again."""
    return rerank(with_labels(feedback_adjustment(ranked, prefs), labels), k)


# --- summaries --------------------------------------------------------------------------------

def net_scores(prefs: DataFrame) -> DataFrame:
    """Weighted net score per (profile, term)."""
    # fixed values: summary weights; a contract weighs 15 here and 12 in the ranking
    weights = {"accepted_role_family": 10, "rejected_role_family": -10,
               "accepted_skills": 4, "rejected_skills": -4,
               "accepted_company_size": 5, "rejected_company_size": -5,
               "accepted_title_terms": 2, "rejected_title_terms": -2,
               "rejected_employment_type": -8, "rejected_hard_constraints": -15}
    table = F.create_map(*[x for k, w in weights.items() for x in (F.lit(k), F.lit(w))])
    return prefs.groupBy("profile_id", "term").agg(
        F.sum(F.try_element_at(table, F.col("kind")) * F.col("cnt")).alias("net"))


def feedback_summary(prefs: DataFrame, n: int = 8) -> DataFrame:
    """Top positive and bottom negative terms per profile, ties by term."""
    net = net_scores(prefs)

    def side(order: Column, keep: Column, name: str) -> DataFrame:
        best = top_k(net.where(keep), ["profile_id"], [order, F.asc("term")], n)
        lists = best.groupBy("profile_id").agg(F.array_sort(F.collect_list(
            F.struct("rank", "term"))).alias("l"))
        return lists.select("profile_id", F.array_join(
            F.transform("l", lambda x: x["term"]), ", ").alias(name))

    people = prefs.select("profile_id").distinct()
    return people.join(side(F.desc("net"), F.col("net") > 0, "positive"), "profile_id", "left") \
        .join(side(F.asc("net"), F.col("net") < 0, "negative"), "profile_id", "left") \
        .select("profile_id", F.coalesce("positive", F.lit("None yet")).alias("positive_summary"),
                F.coalesce("negative", F.lit("None yet")).alias("negative_summary"))


def feedback_counts(feedback: DataFrame) -> DataFrame:
    return feedback.groupBy("profile_id").agg(
        *[F.count_if(F.col("feedback_label") == label).alias(name) for label, name in
          (("Accept", "accepted"), ("Reject", "rejected"), ("Skip", "skipped"))])


def first_round_labels(feedback: DataFrame) -> DataFrame:
    """Last label per posting key among the records of the profile's first round."""
    first = feedback.groupBy("profile_id").agg(F.min("feedback_round").alias("_first"))
    return last_labels(feedback.join(first, "profile_id")
                       .where(F.col("feedback_round") == F.col("_first"))) \
        .withColumnRenamed("_label", "feedback_label")


def lookup(ranked: DataFrame, *columns: str) -> DataFrame:
    """One row per posting key: the last ranked posting of equal key."""
    return ranked.groupBy("profile_id", *JOB_KEY).agg(
        *[F.max_by(c, "rank").alias(c) if c != "rank" else F.max("rank").alias("rank")
          for c in columns])


def join_impact(feedback: DataFrame, baseline: DataFrame, adjusted: DataFrame) -> DataFrame:
    """Accept and Reject records with rank before, rank after and adjusted score."""
    keys = ["profile_id", *JOB_KEY]
    before = lookup(baseline, "rank").withColumnRenamed("rank", "rank_before")
    after = lookup(adjusted, "rank", "adjusted_final_score") \
        .withColumnRenamed("rank", "rank_after")
    judged = feedback.where(F.col("feedback_label").isin("Accept", "Reject")) \
        .select(*keys, "feedback_label", "seq")
    return judged.join(before, keys).join(after, keys)


def feedback_impact(impact: DataFrame) -> DataFrame:
    """Rank shift and scores of accepted and rejected postings per profile."""
    columns = []
    for label, name in (("Accept", "accepted"), ("Reject", "rejected")):
        own = F.col("feedback_label") == label
        columns += [
            F.avg(F.when(own, F.col("rank_before"))).alias(f"{name}_avg_rank_before"),
            F.avg(F.when(own, F.col("rank_after"))).alias(f"{name}_avg_rank_after"),
            F.avg(F.when(own, F.col("adjusted_final_score")))
            .alias(f"{name}_avg_adjusted_score")]
    accepted, rejected = F.col("feedback_label") == "Accept", F.col("feedback_label") == "Reject"
    return impact.groupBy("profile_id").agg(
        *columns,
        F.count_if(accepted & (F.col("rank_after") < F.col("rank_before")))
        .alias("accepted_promoted"),
        F.count_if(rejected & (F.col("rank_after") > F.col("rank_before")))
        .alias("rejected_demoted"))


# --- ranking quality ---------------------------------------------------------------------------

def relevance(label: Column) -> Column:
    value = F.lit(0)
    for name, gain in V.RELEVANCE.items():
        value = F.when(label == name, gain).otherwise(value)
    return value


def join_ndcg_labels(shown: DataFrame, labels: DataFrame) -> DataFrame:
    """Shown postings with the relevance of their first-round label, 0 without one."""
    named = labels.withColumnRenamed("feedback_label", "_label")
    return shown.join(named, ["profile_id", *JOB_KEY], "left") \
        .withColumn("relevance", relevance(F.col("_label"))).drop("_label")


def _dcg(relevance_list: Column) -> Column:
    gains = F.transform(relevance_list, lambda r, i: (F.pow(F.lit(2.0), r) - 1)
                        / F.log2((i + 2).cast("double")))
    return F.aggregate(gains, F.lit(0.0), lambda a, g: a + g)


def ndcg(judged: DataFrame, position: str = "rank", k: int = 10) -> DataFrame:
    """(profile_id, dcg, ideal_dcg, ndcg) of the first ``k`` postings by position.

    The ideal order sorts the relevance of those same postings.
    """
    first = top_k(judged.select("profile_id", F.col(position).alias("_pos"), "relevance"),
                  ["profile_id"], [F.asc("_pos")], k, "_place")
    lists = first.groupBy("profile_id").agg(F.array_sort(F.collect_list(
        F.struct("_place", "relevance"))).alias("l"))
    rel = F.transform("l", lambda x: x["relevance"])
    return lists.select("profile_id", _dcg(rel).alias("dcg"),
                        _dcg(F.sort_array(rel, asc=False)).alias("ideal_dcg")) \
        .withColumn("ndcg", F.when(F.col("ideal_dcg") == 0, 0.0)
                    .otherwise(F.try_divide("dcg", "ideal_dcg")))


def feedback_ndcg(before: DataFrame, after: DataFrame, labels: DataFrame,
                  k: int = 10) -> DataFrame:
    """NDCG@k of the shown postings before and after feedback; NULL without labels."""
    b = ndcg(join_ndcg_labels(before, labels), k=k).select("profile_id", F.col("ndcg").alias("b"))
    a = ndcg(join_ndcg_labels(after, labels), k=k).select("profile_id", F.col("ndcg").alias("a"))
    judged = labels.select("profile_id").distinct().withColumn("_has", F.lit(True))
    both = b.join(a, "profile_id").join(judged, "profile_id", "left")
    has = F.col("_has").isNotNull()
    return both.select("profile_id", F.when(has, F.col("b")).alias("ndcg_before"),
                       F.when(has, F.col("a")).alias("ndcg_after"),
                       F.when(has, F.col("a") - F.col("b")).alias("ndcg_delta"))
