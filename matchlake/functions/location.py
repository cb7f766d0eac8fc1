"""Location reading: country, remote, California and confidence rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from matchlake import vocab as V
from matchlake.functions.text import (contains_any, contains_one, location_form, pad, search_form,
                                      search_term, string_array, strip, text_or_empty)

_FOREIGN = V.NON_US_TERMS + V.CANADA_TERMS
_ABBREVIATIONS = tuple(a.lower() for a in V.US_STATES.values())


def location_source(label: Column, location: Column) -> Column:
    label, location = strip(text_or_empty(label)), strip(text_or_empty(location))
    return F.when(label != "", label) \
        .when((location == "") | (F.lower(location) == "unknown"), "unknown") \
        .otherwise("ambiguous_location")


def location_confidence(source: Column, location: Column) -> Column:
    return F.when((location == "") | (F.lower(location) == "unknown")
                  | (source == "unknown"), "low") \
        .when(source == "job_posting_location", "high") \
        .when(source.isin("raw_location_field", "description_inferred"), "medium") \
        .when(source.isin("company_location_if_only_available", "ambiguous_location"), "low") \
        .otherwise("medium")


def analytics_location(c: Column) -> Column:
    from matchlake.functions.text import clean_ws
    cleaned = clean_ws(c)
    return F.when((cleaned == "") | F.lower(cleaned).isin(list(V.MISSING_LOCATION_TEXTS)),
                  "Unknown") \
        .when(location_form(cleaned).isin(list(V.US_ONLY_NAMES)), "US unspecified") \
        .otherwise(cleaned)


# The functions below take a struct made by ``place`` so that a text is
# normalised and split once per row.

def place(c: Column) -> Column:
    text = text_or_empty(c)
    normal = location_form(text)
    parts = F.filter(F.transform(F.split(text, r"[,/|]"), location_form), lambda p: p != "")
    words = F.filter(F.split(normal, " "), lambda w: w != "")
    return F.struct(
        normal.alias("normal"), words.alias("words"),
        F.element_at(F.concat(string_array([""]), words), -1).alias("last"),
        F.get(F.filter(parts, lambda p: p.isin(list(V.NON_US_CODES))), 0).alias("code"),
        F.lower(text).contains(V.NON_US_CURRENCY_SIGN).alias("foreign_sign"))


def _names_us(p: Column) -> Column:
    return F.arrays_overlap(p["words"], string_array(["us", "usa"])) \
        | p["normal"].contains("united states")


def _names_state(p: Column) -> Column:
    return contains_any(p["normal"], V.US_STATES) \
        | F.arrays_overlap(p["words"], string_array(_ABBREVIATIONS))


def _foreign_currency(p: Column) -> Column:
    return p["foreign_sign"] | contains_any(p["normal"], V.NON_US_CURRENCY_WORDS)


def looks_non_us(p: Column) -> Column:
    return ~_names_us(p) & (_foreign_currency(p) | contains_any(p["normal"], _FOREIGN)
                            | p["code"].isNotNull() | p["last"].isin(list(V.NON_US_CODES)))


def looks_us(p: Column) -> Column:
    return ~looks_non_us(p) & (_names_us(p) | _names_state(p))


def looks_canadian(p: Column) -> Column:
    return contains_any(p["normal"], V.CANADA_TERMS)


def explicit_non_us(p: Column) -> Column:
    us_context = _names_us(p) | _names_state(p)
    code = F.coalesce(p["code"], F.when(p["last"].isin(list(V.NON_US_CODES)), p["last"]))
    return F.when(_foreign_currency(p), True) \
        .when(contains_any(p["normal"], _FOREIGN), ~us_context) \
        .when(code.isin(list(V.AMBIGUOUS_CODES)), ~us_context) \
        .otherwise(code.isNotNull())


def us_remote(padded_search: Column) -> Column:
    return contains_one(padded_search, dict.fromkeys(search_term(t) for t in V.US_REMOTE_TERMS))


def remote_text(c: Column) -> Column:
    normal = location_form(text_or_empty(c))
    words = F.split(normal, " ")
    return F.array_contains(words, "remote") | normal.contains("work from home") \
        | F.array_contains(words, "wfh")


def bay_area_text(c: Column) -> Column:
    return contains_any(location_form(text_or_empty(c)), V.BAY_AREA_TERMS)


def is_us_preference(c: Column) -> Column:
    """Does a preferred-location text mean the United States?"""
    raw, normal = F.lower(text_or_empty(c)), location_form(text_or_empty(c))
    words = F.split(normal, " ")
    return raw.contains("us only") | raw.contains("u.s. only") \
        | F.array_contains(words, "nyc") | normal.contains("new york city") \
        | normal.isin(list(V.US_ONLY_NAMES)) \
        | F.arrays_overlap(words, string_array(("us", "usa") + _ABBREVIATIONS)) \
        | contains_any(normal, V.US_STATES)


def preferred_location_terms(c: Column) -> Column:
    """Words of the preference plus the abbreviation of every state it names."""
    normal = location_form(text_or_empty(c))
    states = F.filter(
        F.expr("array(" + ", ".join(f"named_struct('name', '{n}', 'short', '{a.lower()}')"
                                    for n, a in V.US_STATES.items()) + ")"),
        lambda s: F.contains(normal, s["name"]))
    return F.array_union(F.filter(F.split(normal, " "), lambda w: w != ""),
                         F.transform(states, lambda s: s["short"]))


def location_score_legacy(preferred: Column, location: Column, context: Column) -> Column:
    """Earlier location score: word overlap with the preference, as (points, reason)."""
    raw, wanted = F.lower(preferred), location_form(preferred)
    normal = location_form(location)
    whole = F.concat_ws(" ", location, context)
    us = looks_us(place(location))
    words = F.split(normal, " ")
    remote_or_bay = wanted.contains("remote") | wanted.contains("bay area")

    def outcome(points: int, reason: str) -> Column:
        text = f"Location preference: {points:+d} {reason}" if reason else ""
        return F.struct(F.lit(points).alias("points"), F.lit(text).alias("reason"))

    return (
        F.when(preferred == "", outcome(0, ""))
        .when(normal.isin("", "unknown"), outcome(-5, "location unknown"))
        .when(wanted.contains("remote") & remote_text(whole), outcome(25, "remote match"))
        .when(wanted.contains("bay area") & bay_area_text(whole),
              outcome(25, "Bay Area match"))
        .when((raw.contains("us only") | raw.contains("u.s. only")) & us,
              outcome(10, "US-only preference satisfied"))
        .when(raw.contains("us only") | raw.contains("u.s. only"),
              outcome(-35, "US-only preference but job appears non-US"))
        .when(is_us_preference(preferred) & ~us,
              outcome(-35, "US preference but job appears non-US"))
        .when((wanted != "") & F.contains(normal, wanted),
              outcome(20, "preferred location match"))
        .when(F.arrays_overlap(preferred_location_terms(preferred), words),
              outcome(20, "preferred location/state match"))
        .when(remote_or_bay, outcome(-15, "not remote or Bay Area"))
        .otherwise(outcome(-10, "differs from preference")))


def location_signals(search_hits: Column, only_hits: Column, padded_search: Column,
                     padded_country: Column, country: Column, only: Column,
                     location: Column, source: Column) -> dict[str, Column]:
    """The location columns of one posting.

    ``search_*`` cover title, location and description; ``only_*`` the location
    fields and salary; ``country`` the location fields alone.
    """
    from matchlake.functions.text import any_term, matched_terms
    remote = any_term(search_hits, V.REMOTE_TERMS)
    bay_area = any_term(search_hits, V.BAY_AREA_TERMS)
    california = padded_search.contains(" california ") \
        | padded_country.contains(" ca us ") | padded_country.contains(" ca usa ")
    non_us, us_text = looks_non_us(only), looks_us(country)
    explicit = explicit_non_us(only)
    us = us_text & ~non_us
    unknown = F.lower(strip(location)).isin("", "unknown")

    def phrase(flag: Column, text: str) -> Column:
        return F.when(flag, string_array([text])).otherwise(string_array([]))

    phrases = {
        "remote": matched_terms(search_hits, V.REMOTE_TERMS),
        "hybrid": matched_terms(search_hits, V.HYBRID_TERMS),
        "onsite": matched_terms(search_hits, V.ONSITE_TERMS),
        "us": phrase(us_text, "US/location state signal"),
        "non_us": phrase(non_us, "non-US country/location signal"),
        "california": phrase(california, "California/CA"),
        "bay_area": matched_terms(search_hits, V.BAY_AREA_TERMS),
    }
    return {
        "location_confidence": location_confidence(source, location),
        "is_us_location": us,
        "is_remote": remote,
        "is_us_remote_location": us_remote(padded_search),
        "has_explicit_non_us_location_signal": explicit,
        "is_explicit_remote_location": any_term(only_hits, V.REMOTE_TERMS),
        "is_hybrid": any_term(search_hits, V.HYBRID_TERMS),
        "is_california": california | bay_area,
        "is_bay_area": bay_area,
        "is_non_us_location": ~unknown & ~us
        & ~country["normal"].isin(list(V.REMOTE_ONLY_LOCATIONS))
        & (explicit | non_us | ~remote),
        "location_matched_phrases": F.create_map(
            *[x for k, v in phrases.items() for x in (F.lit(k), v)]),
    }
