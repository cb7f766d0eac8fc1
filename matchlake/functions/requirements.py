"""Requirements read from a posting: years of experience, type, company size."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from matchlake import vocab as V
from matchlake.functions.text import (BLANK_CHARS, BLANKS, WORD_END, WORD_START, any_term, matched_terms,
                                      safe_number, search_term, string_array)

_UNIT = rf"[{BLANKS}]*(?:years|yrs){WORD_END}(?:[{BLANKS}]+of[{BLANKS}]+experience)?"
_COUNT = rf"(?=[0-9]){WORD_START}([0-9]{{1,2}})"
# fixed values: the phrasings that state a number of years, in order of preference
_YEAR_PHRASES = (
    rf"(?=[ma]){WORD_START}(?:minimum|at least)[{BLANKS}]+([0-9]{{1,2}})[{BLANKS}]*\+?{_UNIT}",
    rf"{_COUNT}[{BLANKS}]*-[{BLANKS}]*[0-9]{{1,2}}{_UNIT}",
    rf"{_COUNT}[{BLANKS}]*\+?{_UNIT}",
    rf"{_COUNT}[{BLANKS}]+or[{BLANKS}]+more[{BLANKS}]{_UNIT}",
)
MAX_YEARS = 15
_LONGEST_WORD = max(map(len, (*V.YEAR_WORDS, "more")))


def _as_options(found: Column, phrase: str, order: int) -> Column:
    return F.transform(found, lambda m, i: F.struct(
        F.regexp_extract(m, "^" + phrase, 1).try_cast("int").alias("years"),
        F.lit(order).alias("phrasing"), i.alias("place"),
        F.regexp_extract(m, f"^({phrase})", 1).alias("phrase")))


def years_required(description: Column) -> Column:
    """Struct (years, phrasing, place, phrase) of the smallest required number of years.

    NULL when none is stated.  Equal years keep the phrase of the earlier phrasing,
    then the earlier place.  Each match is captured with the twelve characters behind
    it, to rule out "5 years ago".  The phrasings are only tried on texts that can
    match one of them.
    """
    text = F.lower(description)
    counted, spelled = [], []
    for order, phrase in enumerate(_YEAR_PHRASES):
        found = F.regexp_extract_all(
            text, F.lit(f"(?s)(?=({phrase}.{{0,12}})){phrase}"), 1)
        options = _as_options(F.filter(found, lambda m: ~m.contains("ago")), phrase, order)
        counted.append(F.filter(options, lambda o: o["years"] <= MAX_YEARS))
    for order, (word, years) in enumerate(V.YEAR_WORDS.items(), len(_YEAR_PHRASES)):
        phrase = rf"\b(?:minimum|at least)?\s*{word}\s+(?:years|yrs)\b(?:\s+of\s+experience)?"
        found = F.regexp_extract(text, f"(?sU)(?=({phrase}.{{0,12}})){phrase}", 1)
        spelled.append(F.when(text.contains(word) & (found != "") & ~found.contains("ago"), F.array(F.struct(
            F.lit(years).alias("years"), F.lit(order).alias("phrasing"),
            F.lit(0).alias("place"),
            F.regexp_extract(found, f"(?sU)^({phrase})", 1).alias("phrase")))))
    # what stands before each "years" or "yrs"; the phrasings have a number there
    before = F.split(F.replace(text, F.lit("yrs"), F.lit("years")), "years")
    ends = F.transform(F.slice(before, 1, F.size(before) - 1), lambda t: F.right(
        F.rtrim(t, F.lit(BLANK_CHARS)), F.lit(_LONGEST_WORD)))
    has_count = F.exists(ends, lambda e: e.rlike(r"(?:[0-9+]|more)$"))
    has_word = F.exists(ends, lambda e: e.rlike(rf"(?:{'|'.join(V.YEAR_WORDS)})$"))
    return F.when(text.contains("years") | text.contains("yrs"),
                  F.array_min(F.flatten(F.array_compact(F.array(
                      F.when(has_count, F.flatten(F.array(*counted))),
                      F.when(has_word, F.flatten(F.array_compact(F.array(*spelled)))))))))


def employment_type(unpaid: Column, contract: Column, padded: Column) -> Column:
    return F.when(unpaid, "unpaid_or_commission").when(contract, "contract_or_temp") \
        .when(padded.contains(" internship ") | padded.contains(" intern "), "internship") \
        .when(padded.contains(" part time "), "part_time") \
        .when(padded.contains(" full time "), "full_time").otherwise("Unknown")


def role_family(hits: Column) -> Column:
    """Family with most dictionary hits; the earlier family wins a tie."""
    counts = [F.struct(F.size(F.array_intersect(
        string_array(map(search_term, terms)), hits)).alias("n"),
        F.lit(-i).alias("i"), F.lit(family).alias("family"))
        for i, (family, terms) in enumerate(V.INFERRED_FAMILY_TERMS.items())]
    best = F.array_max(F.array(*counts))
    return F.when(best["n"] > 0, best["family"]).otherwise("unknown")


def senior_title_terms(title: Column) -> Column:
    """Seniority words of a title, bounded as words, sorted."""
    words = F.regexp_extract_all(
        F.lower(title), F.lit(rf"{WORD_START}({'|'.join(V.SENIOR_TERMS)})"
                              rf"(?:\.(?=[\p{{L}}\p{{N}}_])|{WORD_END})"), 1)
    return F.array_sort(F.array_distinct(words))


def defense_matches(company_hits: Column, hits: Column) -> Column:
    """Company names in the company, then in the text, then keywords."""
    return F.array_distinct(F.concat(
        matched_terms(company_hits, V.DEFENSE_COMPANIES),
        matched_terms(hits, V.DEFENSE_COMPANIES), matched_terms(hits, V.DEFENSE_TERMS)))


def employee_bucket(n: Column) -> Column:
    return F.when(n < 50, "tiny").when(n < 100, "small").when(n < 1_000, "medium") \
        .when(n < 10_000, "large").otherwise("enterprise")


def employee_count(columns: list[Column]) -> Column:
    """First positive number among the count columns, as (count, text)."""
    if not columns:
        return F.lit(None).cast("struct<count:double,text:string>")
    return F.coalesce(*[F.when(safe_number(c) > 0, F.struct(
        safe_number(c).alias("count"), c.cast("string").alias("text"))) for c in columns])


def company_size(count: Column, padded: Column, hits: Column) -> Column:
    """(size, confidence, match_text) from a count column, else from phrases."""
    def pick(size, confidence: str, text) -> Column:
        return F.struct(size.alias("size") if isinstance(size, Column) else F.lit(size).alias("size"),
                        F.lit(confidence).alias("confidence"),
                        (text if isinstance(text, Column) else F.lit(text)).alias("match_text"))

    below = r"\b((?:under|fewer than|less than)\s+{}\s+employees)\b"
    under_50 = F.regexp_extract(padded, below.format("50"), 1)
    under_100 = F.regexp_extract(padded, below.format("100"), 1)
    stated = F.regexp_extract(padded, r"\b(\d{2,6}\+?\s+employees)\b", 1)
    number = F.regexp_extract(stated, r"^(\d+)", 1).try_cast("double")
    tiny = matched_terms(hits, V.TINY_COMPANY_SIGNALS)
    large = matched_terms(hits, V.LARGE_COMPANY_SIGNALS)
    very_small = F.exists(tiny, lambda t: t.contains("50") | t.contains("startup")
                          | t.contains("seed"))
    has_count = padded.contains(" employees")
    return (
        F.when(count.isNotNull(), pick(employee_bucket(count["count"]), "high", count["text"]))
        .when(has_count & (under_50 != ""), pick("tiny", "low", under_50))
        .when(has_count & (under_100 != ""), pick("small", "low", under_100))
        .when(has_count & (stated != ""), pick(employee_bucket(number), "medium", stated))
        .when(F.size(tiny) > 0, pick(F.when(very_small, "tiny").otherwise("small"), "low",
                                     F.array_join(tiny, ", ")))
        .when(F.size(large) > 0, pick(
            F.when(any_term(large, V.ENTERPRISE_SIGNALS, form=str), "enterprise")
            .otherwise("large"), "low", F.array_join(large, ", ")))
        .otherwise(pick("Unknown", "low", "")))
