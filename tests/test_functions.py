"""Hand-checked results of the column functions."""

import re

from pyspark.sql import functions as F

from matchlake import vocab as V
from matchlake.functions import documents as D
from matchlake.functions import rawjson as R
from matchlake.functions import salary as P
from matchlake.functions import text as T
from matchlake.functions.requirements import years_required
from matchlake.operators.order import head_in_order, rank_all, running_sum, top_k


def column(spark, values, fn):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[0] for r in df.orderBy("i").select(fn(F.col("v"))).collect()]


def test_terms_match_a_search_per_term(spark):
    words = V.CONTRACT_TERMS + V.DEFENSE_TERMS + V.GENERIC_SOFTWARE_TITLES
    texts = ["Contract duration: 6 months, W2 contract", "sub-contractors only", "asp.net developer",
             ".NET developer, TS/SCI clearance required", "u.s. citizenship required!", "", "temporary temp."]
    expected = []
    for text in texts:
        normal = f" {re.sub(r'[^a-z0-9+#.]+', ' ', text.lower()).strip()} "
        expected.append(sorted(w for w in set(words) if re.search(
            rf"(?<![a-z0-9]){re.escape(T.search_term(w))}(?![a-z0-9])", normal)))
    assert column(spark, texts, lambda c: T.find_terms(c, set(words))) == expected


def test_white_space_is_unicode(spark):
    assert column(spark, ["a \t b\x1c c ", None], T.clean_ws) == ["a b c", ""]


def test_salary_readings(spark):
    values = ["$92000", "{'text': '$80,000', 'value': None}", '{"value": "120000"}',
              '{"minValue": 20, "maxValue": 30, "period": "hour"}', "{broken}", "", "45,000.50 - 60000"]
    assert column(spark, values, P.salary_number) == [92000, 80000, 120000, 20, 0, 0, 60000]
    assert column(spark, values, P.salary_text) == [
        "$92000", "$80,000", "120,000", "20", "{broken}", "Unknown", "45,000.50 - 60000"]
    assert column(spark, values, P.salary_annual) == [
        92000.0, 80000.0, 120000.0, None, None, None, 52500.25]


def test_years(spark):
    values = ["Minimum 5 years of experience", "3-5 years", "built 10 years ago, needs 7+ yrs",
              "at least four years", "20 years", "two or more years", "4 or more years", ""]
    got = column(spark, values, lambda c: years_required(c)["years"])
    assert got == [5, 3, 7, 4, None, None, 4, None]


def test_html_and_json_paths(spark):
    assert column(spark, ["<b>R&amp;D</b>&nbsp;x", None], R.html_clean) == ["R&D x", ""]
    record = '{"a": {"b": ""}, "c": 0, "d": "x"}'
    assert column(spark, [record], lambda c: R.json_first_value(c, ["a.b", "c", "d"])) == ["0"]


def test_title_case_and_display(spark):
    assert column(spark, ["sql, a/b testing; certified 3d max\nsome"], lambda c: T.skill_display(
        c, V.SKILL_DISPLAY_NAMES, V.SKILL_NOISE_WORDS)) == ["SQL, A/B Testing, 3D Max"]


def test_background_and_names(spark):
    text = "Persona 1 - Jo\nBackground: MS student\nmore\nand more\nnot this\nSkills\nSQL"
    assert column(spark, [text, ""], D.background) == [
        "MS student more and more", V.BACKGROUND_FALLBACK]
    assert column(spark, ["Persona 2 — Jo Doe — Dev", "Amy", ""], D.clean_name) == [
        "Jo Doe", "Amy", V.NAME_FALLBACK]


def test_preview_breaks_before_headings(spark):
    out = column(spark, ["Amy  Roe Skills: SQL\nEducation BSc"], D.preview)[0]
    assert out == "Amy Roe\nSkills: SQL\nEducation BSc"


def test_ordered_helpers_agree_with_plain_windows(spark):
    df = spark.range(1000).select("id", (F.col("id") % 3).alias("g"), (F.col("id") * 7919 % 1000).alias("v"))
    ranks = {(r.g, r.id): r.rank for r in rank_all(df, ["g"], [F.desc("v"), F.asc("id")]).collect()}
    rows = sorted(df.collect(), key=lambda r: (-r.v, r.id))
    seen = {}
    for r in rows:
        seen[r.g] = seen.get(r.g, 0) + 1
        assert ranks[(r.g, r.id)] == seen[r.g]
    best = top_k(df, ["g"], [F.desc("v"), F.asc("id")], 5).collect()
    assert {(r.g, r.id): r.rank for r in best} == {k: v for k, v in ranks.items() if v <= 5}
    assert sorted(r.id for r in head_in_order(df, "id", 130, 64).collect()) == list(range(130))
    total = running_sum(df, "id", {"t": "v"}, 64).orderBy("id").collect()
    running = 0
    for r in total:
        running += r.v
        assert r.t == running


def test_salary_object_with_wide_blanks(spark):
    wide = " " * 30
    values = [f"{{'text': 'x',{wide}'minValue':{wide}None, 'value':{wide}120000}}",
              f"{{'text':{wide}'$80,000', 'value':{wide}None{wide}}}",
              f'{{"value": 130000, "open": [{wide}True,{wide}False,{wide}None ]}}']
    assert column(spark, values, lambda c: P.salary_object(c)["value"]) == ["120000", None, "130000"]
    assert column(spark, values, P.salary_number) == [120000, 80000, 130000]


def test_runs_of_blanks_are_one_blank_and_single_blanks_stay(spark):
    import random

    draw = random.Random(3)
    rows = [(None,), (" ",), (" a\tb ",), ("a\x1c b",), *[
        ("".join(draw.choices(T.BLANK_CHARS + "    ab\U0001f600​", k=draw.randint(0, 12))),) for _ in range(3000)]]
    df = spark.createDataFrame(rows, "t string")
    plain = F.trim(F.regexp_replace(T.text_or_empty(F.col("t")), T.WHITESPACE, " "))
    assert df.where(T.clean_ws(F.col("t")) != plain).count() == 0
    # a single blank is not replaced by itself
    assert df.select(F.regexp_count(F.lit("a b c  d\n"), F.lit(T._BLANK_RUNS))).first()[0] == 2


def test_the_length_of_a_vector_is_found_once(spark):
    import time

    from matchlake.functions.vectors import l2_normalize

    df = spark.range(300).select(F.transform(F.sequence(F.lit(0), F.lit(2047)), lambda i: (
        (i * (F.col("id") + 3)) % 17 - 8).cast("float")).alias("v"))
    unit = df.select("v", l2_normalize(F.col("v")).alias("u"))
    began = time.time()
    rows = unit.collect()
    assert time.time() - began < 30  # 2,048 lengths a row took minutes
    for r in rows[::50]:
        length = sum(x * x for x in r["v"]) ** 0.5
        assert all(abs(x / length - u) < 1e-6 for x, u in zip(r["v"], r["u"], strict=True))
    odd = spark.createDataFrame([(None,), ([],), ([0.0, 0.0],), ([3.0, 4.0],), ([3.0, None],)], "v array<float>")
    assert [r[0] for r in odd.select(l2_normalize(F.col("v"))).collect()][:4] == [
        None, [], [0.0, 0.0], [0.6000000238418579, 0.800000011920929]]


def test_search_form_equals_its_plain_pattern(spark):
    import random

    draw = random.Random(5)
    rows = [("".join(draw.choices("abzAZ09+#. \t  -,/é ​\U0001f600'\"", k=draw.randint(0, 14))),) for _ in range(3000)]
    df = spark.createDataFrame(rows, "t string")
    plain = F.trim(F.regexp_replace(F.lower("t"), r"[^a-z0-9+#.]+", " "))
    assert df.where(T.search_form(F.col("t")) != plain).count() == 0
