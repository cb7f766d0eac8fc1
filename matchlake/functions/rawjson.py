"""Reading fields of raw posting records kept as JSON text."""

from __future__ import annotations

import html
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from matchlake import vocab as V
from matchlake.functions.text import WHITESPACE, clean_ws


def _json_path(path: str) -> str:
    return "$" + "".join(f"['{step}']" for step in path.split("."))


def json_path(record: Column, path: str) -> Column:
    """Value at a dotted path as text; NULL when a step is missing."""
    return F.get_json_object(record, _json_path(path))


def json_first_value(record: Column, paths: Sequence[str]) -> Column:
    """First value on the paths that is neither null nor ''."""
    return F.coalesce(*[F.nullif(json_path(record, p), F.lit("")) for p in paths])


# what html.unescape takes for a reference; each is decoded without regard to its surroundings
REFERENCE = r"&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\t\n\f <&#;]{1,32};?)"


@F.pandas_udf(ArrayType(StringType()))
def _decode(references: pd.Series) -> pd.Series:
    return references.map(lambda found: [html.unescape(r) for r in found], na_action="ignore")


# Declared non-deterministic so that filters on decoded text are not moved in front of
# it, which would decode and parse every record a second time.
_unescape = _decode.asNondeterministic()


def html_clean(text: Column, max_chars: int | None = None) -> Column:
    """Entities decoded, tags to blanks, white space collapsed, optional cut."""
    # only the references travel to Python, not the texts around them
    references = _unescape(F.when(text.contains("&"), F.regexp_extract_all(
        text, F.lit(f"({REFERENCE})"), 1)))
    pieces = F.arrays_zip(F.split(text, REFERENCE).alias("text"), references.alias("decoded"))
    decoded = F.array_join(F.transform(pieces, lambda p: F.concat(
        p["text"], F.coalesce(p["decoded"], F.lit("")))), "")
    plain = F.coalesce(decoded, text, F.lit(""))
    plain = clean_ws(F.regexp_replace(plain, "<[^>]+>", " "))
    if max_chars:
        plain = F.regexp_replace(F.substring(plain, 1, max_chars), WHITESPACE + r"\z", "")
    return plain


# The paths of one posting are read from three parses of nested text rather than one
# parse per path: the record, its ``json.schemaOrg`` object and the small sub-objects.
_STRICT = {"columnNameOfCorruptRecord": "_bad", "allowSingleQuotes": "false"}
_RECORD = ("idInSource string, _id string, name string, url string, text string, "
           "html string, salary string, position string, orgCompany string, "
           "orgAddress string, json string, _bad string")
_SCHEMA_ORG = ("title string, description string, url string, baseSalary string, "
               "estimatedSalary string, hiringOrganization string, jobLocation string")


def record_struct(line: Column) -> Column:
    """Top-level fields of a line that is one JSON object, else NULL."""
    parsed = F.from_json(line, _RECORD, _STRICT)
    return F.when(F.ltrim(line).startswith("{") & parsed["_bad"].isNull(), parsed)


def schema_org_struct(record: Column) -> Column:
    return F.from_json(F.get_json_object(record["json"], "$.schemaOrg"), _SCHEMA_ORG, _STRICT)


def record_paths(record: Column, schema_org: Column) -> dict[str, Column]:
    """Every path the posting mapping reads, by its dotted name."""
    top = ("idInSource", "name", "url", "text", "html", "salary", "position")
    paths = {name: record[name] for name in top}
    for name in ("title", "description", "url", "baseSalary", "estimatedSalary"):
        paths[f"json.schemaOrg.{name}"] = schema_org[name]
    nested = {"_id.$oid": record["_id"], "position.name": record["position"],
              "orgCompany.name": record["orgCompany"],
              "json.schemaOrg.hiringOrganization.name": schema_org["hiringOrganization"]}
    nested |= {p: record["orgAddress"] for p in V.ORG_ADDRESS_PATHS}
    for path, source in nested.items():
        paths[path] = F.get_json_object(source, _json_path(path.rsplit(".", 1)[1]))
    return paths


def first_of(paths: dict[str, Column], names: Sequence[str]) -> Column:
    return F.coalesce(*[F.nullif(paths[n], F.lit("")) for n in names])


def is_object(record: Column) -> Column:
    """True for a line that parses as one JSON object."""
    return F.coalesce(F.schema_of_variant(F.try_parse_json(record)).startswith("OBJECT"),
                      F.lit(False))


def json_preview(value: Column, max_length: int = 120) -> Column:
    one_line = F.replace(value, F.lit("\n"), F.lit(" "))
    return F.when(F.length(one_line) > max_length, F.concat(
        F.substring(one_line, 1, max_length - 3), F.lit("..."))).otherwise(one_line)


def candidate_label(key: Column) -> Column:
    """Labels of the field-alias lists that contain the key's last step."""
    leaf = F.lower(F.substring_index(key, ".", -1))
    return F.array_compact(F.array(*[F.when(leaf.isin(list(names)), F.lit(label))
                                     for label, names in V.CANDIDATE_FIELD_NAMES.items()]))
