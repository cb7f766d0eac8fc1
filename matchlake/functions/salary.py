"""Salary readings from free text, JSON objects or Python-style dict literals."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from matchlake import vocab as V
from matchlake.functions.text import (WORD_END, WORD_START, let, safe_number, strip,
                                      text_or_empty)

_NUMBER = "([0-9][0-9,]*(?:[.][0-9]+)?)"
_SCHEMA = ("value string, minValue string, maxValue string, text string, "
           "period string, _bad string")


def salary_object(c: Column) -> Column:
    """Struct of the object's fields, or NULL when the text is not an object."""
    t = strip(text_or_empty(c))
    # None/True/False of a dict literal are not JSON; quotes of either kind are
    fixed = F.regexp_replace(t, r"([:,\[]\s*)None(?=\s*[,}\]])", "$1null")
    fixed = F.regexp_replace(fixed, r"([:,\[]\s*)True(?=\s*[,}\]])", "$1true")
    fixed = F.regexp_replace(fixed, r"([:,\[]\s*)False(?=\s*[,}\]])", "$1false")
    parsed = F.from_json(fixed, _SCHEMA, {"columnNameOfCorruptRecord": "_bad"})
    return F.when(t.startswith("{") & t.endswith("}") & parsed["_bad"].isNull(), parsed)


def numbers_in(c: Column, at_least: float = 1_000.0) -> Column:
    """Numbers of at least 1,000 found in a text, in order, as doubles."""
    found = F.transform(F.regexp_extract_all(c, F.lit(_NUMBER), 1),
                        lambda x: F.replace(x, F.lit(","), F.lit("")).try_cast("double"))
    return F.filter(found, lambda x: x >= at_least)


def _largest(c: Column) -> Column:
    whole = F.transform(numbers_in(c), lambda x: x.try_cast("bigint"))
    return F.coalesce(F.array_max(whole), F.lit(0).cast("bigint"))


def _field_number(c: Column) -> Column:
    direct = safe_number(F.replace(c, F.lit(","), F.lit(""))).try_cast("bigint")
    return F.when(F.coalesce(c, F.lit("")) == "", F.lit(0).cast("bigint")) \
        .otherwise(F.coalesce(direct, _largest(c)))


def salary_number_of(c: Column, parsed: Column) -> Column:
    fields = [F.nullif(_field_number(parsed[f]), F.lit(0).cast("bigint"))
              for f in ("value", "minValue", "maxValue")]
    return F.when(parsed.isNotNull(), F.coalesce(*fields, _largest(text_or_empty(c)))) \
        .otherwise(_largest(text_or_empty(c)))


def salary_text_of(c: Column, parsed: Column, number: Column) -> Column:
    plain = strip(text_or_empty(c))
    from_object = F.when(F.coalesce(parsed["text"], F.lit("")) != "", strip(parsed["text"])) \
        .when(number != 0, F.format_number(number, 0)).otherwise("Unknown")
    return F.when(parsed.isNotNull(), from_object) \
        .otherwise(F.when(plain == "", F.lit("Unknown")).otherwise(plain))


def salary_number(c: Column) -> Column:
    """Scoring salary: first non-zero object field, else the largest number, else 0."""
    return let(salary_object(c), lambda o: salary_number_of(c, o))


def salary_text(c: Column) -> Column:
    """Salary as shown to users."""
    return let(salary_object(c), lambda o: let(
        salary_number_of(c, o), lambda n: salary_text_of(c, o, n)))


def salary_annual(c: Column) -> Column:
    """Annual estimate for analytics; hourly, monthly … values are NULL."""
    raw = text_or_empty(c)
    words = WORD_START + "(?:" + "|".join(V.NON_ANNUAL_WORDS) + ")" + WORD_END

    def from_text(text: Column) -> Column:
        return F.when(F.lower(text).isin("", *V.NO_SALARY_TEXTS)
                      | F.lower(text).rlike(words), None).otherwise(
            let(numbers_in(text), lambda found: F.when(
                F.size(found) >= 2, (F.get(found, 0) + F.get(found, 1)) / 2)
                .otherwise(F.get(found, 0))))

    def from_object(o: Column) -> Column:
        period = F.lower(strip(F.coalesce(o["period"], F.lit(""))))
        low, high = safe_number(o["minValue"]), safe_number(o["maxValue"])
        value = safe_number(o["value"])
        return F.when((period != "") & ~period.isin(list(V.ANNUAL_PERIODS)),
                      F.lit(None).cast("double")) \
            .when(low.isNotNull() & high.isNotNull(), (low + high) / 2) \
            .when(value >= 1_000, value) \
            .otherwise(let(strip(F.coalesce(o["text"], F.lit(""))), from_text))

    return let(salary_object(c), lambda o: F.when(o.isNotNull(), from_object(o))
               .otherwise(let(strip(raw), from_text)))


def salary_band(annual: Column) -> Column:
    band = F.when(annual.isNull(), V.SALARY_BAND_UNKNOWN)
    for name, limit in V.SALARY_BANDS:
        band = band.when(annual < limit, name)
    return band.otherwise(V.SALARY_BAND_TOP)
