"""License scan with ordered signature rules.

1. A text is lower-cased (A-Z) and split into words of digits, a-z and characters from U+0080
   on; all rules match whole words of the words joined by blanks.
2. A rule is a license name or its identifier in a sentence form, as a regular expression, with
   a priority: identifiers and full titles with a version first, titles without one next, hints
   last.  ``RULES`` has several hundred of them: every row of ``LICENSES`` in every form of
   ``FORMS`` that suits it.
3. Keywords gate the rules: those of a form are looked for in the text first, then those of a
   license, and only rules whose words all occur are tried.
4. Of overlapping detections one that lies inside a detection of a higher priority, or inside a
   longer one of its own, is suppressed.  Detections that only overlap in part both stay.

Base phrases (``BASE``) are counted at every place and their labels are never suppressed.  A
document's score is the highest confidence of what was found, 0 without any.

Nulls and repeats: every row gives one row under its own id, null and repeated ids as well; a
null or empty text has no words, no labels (an empty string) and the score 0.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterable
from functools import lru_cache
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchlake.llm.common import whole_text
from matchlake.llm.runs import chunks

CHUNK_BYTES = 4 << 20

# fixed values: phrases and labels of the base scan
BASE = (("under the mit license", "mit"), ("apache license version 2", "apache-2"),
        ("cc by nc", "cc-by-nc"))


class License(NamedTuple):
    """A license: its label, a keyword its names need, and expressions of its names.

    ``title`` is the long name, ``short`` the identifier, which begins with a plain word; both
    are matched on joined words.
    ``version`` is an expression of the version after the title, empty if it has none.
    """

    label: str
    keyword: str
    title: str
    short: str
    version: str = ""


# names as their stewards write them, lower-cased, punctuation as blanks
LICENSES = (
    License("mit", "mit", r"(?:mit|expat|x11)(?: expat| x11)?(?: style)?", r"mit"),
    License("mit-0", "attribution", r"mit no attribution", r"mit 0"),
    License("apache-1.1", "apache", r"apache(?: software)?", r"apache 1 1", r"1 1"),
    License("apache-2", "apache", r"apache(?: software)?", r"apache 2(?: 0)?", r"2(?: 0)?"),
    License("bsd-0-clause", "zero", r"zero clause bsd", r"0bsd"),
    License("bsd-2-clause", "bsd", r"(?:bsd 2 clause|2 clause bsd|two clause bsd|simplified bsd|freebsd)", r"bsd 2 clause"),
    License("bsd-3-clause", "bsd", r"(?:bsd 3 clause|3 clause bsd|three clause bsd|new bsd|modified bsd)", r"bsd 3 clause"),
    License("bsd-4-clause", "bsd", r"(?:bsd 4 clause|4 clause bsd|four clause bsd|original bsd)", r"bsd 4 clause"),
    License("isc", "isc", r"(?:isc|internet systems consortium)", r"isc"),
    License("zlib", "zlib", r"zlib(?: libpng)?", r"zlib"),
    License("boost-1", "boost", r"boost software", r"bsl 1 0", r"1(?: 0)?"),
    License("unlicense", "unlicense", r"unlicense", r"unlicense"),
    License("wtfpl", "want", r"do what the fuck you want to(?: public)?", r"wtfpl"),
    License("python-2", "python", r"python(?: software foundation)?", r"psf 2(?: 0)?", r"2(?: 0)?"),
    License("artistic-1", "artistic", r"(?:perl )?artistic", r"artistic 1 0", r"1(?: 0)?"),
    License("artistic-2", "artistic", r"(?:perl )?artistic", r"artistic 2 0", r"2(?: 0)?"),
    License("gpl-1", "general", r"(?:gnu )?general public", r"gpl ?(?:v ?)?1(?: 0)?(?: only| or later)?", r"1(?: 0)?"),
    License("gpl-2", "general", r"(?:gnu )?general public", r"gpl ?(?:v ?)?2(?: 0)?(?: only| or later)?", r"2(?: 0)?"),
    License("gpl-3", "general", r"(?:gnu )?general public", r"gpl ?(?:v ?)?3(?: 0)?(?: only| or later)?", r"3(?: 0)?"),
    License("lgpl-2", "general", r"(?:gnu )?(?:lesser|library) general public", r"lgpl ?(?:v ?)?2(?: 0)?(?: only| or later)?", r"2(?: 0)?"),
    License("lgpl-2.1", "general", r"(?:gnu )?(?:lesser|library) general public", r"lgpl ?(?:v ?)?2 1(?: only| or later)?", r"2 1"),
    License("lgpl-3", "general", r"(?:gnu )?(?:lesser|library) general public", r"lgpl ?(?:v ?)?3(?: 0)?(?: only| or later)?", r"3(?: 0)?"),
    License("agpl-1", "affero", r"(?:gnu )?affero general public", r"agpl ?(?:v ?)?1(?: 0)?(?: only| or later)?", r"1(?: 0)?"),
    License("agpl-3", "affero", r"(?:gnu )?affero general public", r"agpl ?(?:v ?)?3(?: 0)?(?: only| or later)?", r"3(?: 0)?"),
    License("gfdl-1.1", "documentation", r"(?:gnu )?free documentation", r"gfdl 1 1(?: only| or later)?", r"1 1"),
    License("gfdl-1.2", "documentation", r"(?:gnu )?free documentation", r"gfdl 1 2(?: only| or later)?", r"1 2"),
    License("gfdl-1.3", "documentation", r"(?:gnu )?free documentation", r"gfdl 1 3(?: only| or later)?", r"1 3"),
    License("mpl-1.1", "mozilla", r"mozilla public", r"mpl 1 1", r"1 1"),
    License("mpl-2", "mozilla", r"mozilla public", r"mpl 2(?: 0)?", r"2(?: 0)?"),
    License("epl-1", "eclipse", r"eclipse public", r"epl 1(?: 0)?", r"1(?: 0)?"),
    License("epl-2", "eclipse", r"eclipse public", r"epl 2(?: 0)?", r"2(?: 0)?"),
    License("cddl-1", "development", r"common development and distribution", r"cddl 1(?: 0)?", r"1(?: 0)?"),
    License("cddl-1.1", "development", r"common development and distribution", r"cddl 1 1", r"1 1"),
    License("cpl-1", "common", r"common public", r"cpl 1(?: 0)?", r"1(?: 0)?"),
    License("eupl-1.1", "european", r"european union public", r"eupl 1 1", r"1 1"),
    License("eupl-1.2", "european", r"european union public", r"eupl 1 2", r"1 2"),
    License("ms-pl", "microsoft", r"microsoft public", r"ms pl"),
    License("ms-rl", "microsoft", r"microsoft reciprocal", r"ms rl"),
    License("osl-3", "open", r"open software", r"osl 3(?: 0)?", r"3(?: 0)?"),
    License("afl-3", "academic", r"academic free", r"afl 3(?: 0)?", r"3(?: 0)?"),
    License("ofl-1.1", "sil", r"sil open font", r"ofl 1 1", r"1 1"),
    License("odbl-1", "database", r"open (?:data commons open )?database", r"odbl 1(?: 0)?", r"1(?: 0)?"),
    License("odc-by-1", "commons", r"open data commons attribution", r"odc by 1(?: 0)?", r"1(?: 0)?"),
    License("pddl-1", "domain", r"open data commons public domain dedication", r"pddl 1(?: 0)?", r"1(?: 0)?"),
    License("busl-1.1", "business", r"business source", r"busl 1 1", r"1 1"),
    License("sspl-1", "server", r"server side public", r"sspl 1(?: 0)?", r"1(?: 0)?"),
    License("elastic-2", "elastic", r"elastic", r"elastic 2(?: 0)?", r"2(?: 0)?"),
    License("cc0-1", "cc0", r"(?:creative commons )?cc0", r"cc0(?: 1 0)?", r"1(?: 0)?"),
    License("cc-by", "creative", r"creative commons attribution", r"cc by", r"[1-4](?: [05])?"),
    License("cc-by-sa", "creative", r"creative commons attribution share ?alike", r"cc by sa", r"[1-4](?: [05])?"),
    License("cc-by-nd", "creative", r"creative commons attribution no ?deriv(?:ative)?s", r"cc by nd", r"[1-4](?: [05])?"),
    License("cc-by-nc", "creative", r"creative commons attribution non ?commercial", r"cc by nc", r"[1-4](?: [05])?"),
    License("cc-by-nc-sa", "creative", r"creative commons attribution non ?commercial share ?alike", r"cc by nc sa", r"[1-4](?: [05])?"),
    License("cc-by-nc-nd", "creative", r"creative commons attribution non ?commercial no ?deriv(?:ative)?s", r"cc by nc nd", r"[1-4](?: [05])?"),
)

_GRANT = (r"(?:licen[sc]ed|released|distributed|published|available|provided|shared|covered|"
          r"redistribut(?:ed|able)|modify it|use|used|usable)")
_UNDER = r"(?:under|by|subject to|according to)(?: the)?(?: terms(?: and conditions)? of(?: the)?)?"
_WORD = r"licen[sc]e(?: agreement)?"


class Form(NamedTuple):
    """A sentence around a license: keywords that it needs, expression, priority, confidence."""

    name: str
    keywords: tuple[str, ...]
    expression: str
    priority: int
    confidence: float


# {title}, {short} and {version} are filled in from a row of LICENSES; forms with {version} need one
FORMS = (
    Form("identifier line", ("spdx",), r"spdx licen[sc]e identifier {short}", 0, 1.0),
    Form("grant of a titled version", ("licen",),
         rf"{_GRANT} {_UNDER} {{title}} {_WORD}(?: as published by [^ ]+(?: [^ ]+){{{{0,4}}}}?)? "
         r"(?:either )?(?:v|ver|version|versions)? ?{version}(?: of the licen[sc]e)?", 1, 1.0),
    Form("titled version", ("licen",),
         rf"{{title}} {_WORD} (?:v|ver|version)? ?{{version}}", 2, 0.9),
    Form("version before the word", ("licen",),
         rf"{{title}} (?:v|ver|version)? ?{{version}} (?:[^ ]+ )?{_WORD}", 2, 0.9),
    Form("grant by identifier", ("under",), rf"{_GRANT} {_UNDER} {{short}}(?: {_WORD})?", 2, 0.9),
    Form("grant of a title", ("licen",), rf"{_GRANT} {_UNDER} {{title}} {_WORD}", 3, 0.9),
    Form("field", ("licen",), rf"{_WORD} (?:is |type )?{{short}}", 4, 0.8),
    Form("identifier with the word", ("licen",), rf"{{short}} {_WORD}", 4, 0.8),
    Form("title", ("licen",), rf"{{title}} {_WORD}", 5, 0.6),
)


class Rule(NamedTuple):
    label: str
    form: str
    keywords: tuple[str, ...]
    expression: str
    priority: int
    confidence: float


def _rule(one: License, form: Form) -> Rule | None:
    """The rule of a license in a form, if the form suits it."""
    named, versioned = "{title}" in form.expression, "{version}" in form.expression
    # a title shared by several versions names none of them
    if versioned and not one.version or named and not versioned and one.version:
        return None
    stem = one.keyword if named else re.match("[a-z0-9]+", one.short)[0]
    return Rule(one.label, form.name, (*form.keywords, stem), form.expression.format(
        title=one.title, short=one.short, version=one.version), form.priority, form.confidence)


#: Titles without a version, for families whose rows all have one.
FAMILIES = (
    ("gpl", "general", r"(?:gnu )?general public"), ("lgpl", "general", r"(?:gnu )?(?:lesser|library) general public"),
    ("agpl", "affero", r"(?:gnu )?affero general public"), ("gfdl", "documentation", r"(?:gnu )?free documentation"),
    ("apache", "apache", r"apache(?: software)?"), ("mpl", "mozilla", r"mozilla public"),
    ("epl", "eclipse", r"eclipse public"),
    ("cddl", "development", r"common development and distribution"), ("eupl", "european", r"european union public"))

RULES: tuple[Rule, ...] = tuple(sorted((
    *(rule for one in LICENSES for form in FORMS if (rule := _rule(one, form))),
    *(Rule(label, form.name, (*form.keywords, word), form.expression.format(title=title), 6, 0.5)
      for label, word, title in FAMILIES for form in FORMS
      if "{title}" in form.expression and "{version}" not in form.expression),
    *(Rule(label, "short grant", ("under", "creative"), rf"{_GRANT} {_UNDER} {title}(?: international| unported)?",
           2, 0.9) for label, _, title, _, _ in LICENSES if label.startswith("cc-")),
    Rule("public-domain", "dedication", ("domain",), r"(?:dedicated|released|placed|is) (?:in|into|to) the public domain", 3, 0.8),
    Rule("proprietary", "reserved rights", ("rights",), r"all rights reserved(?: worldwide)?", 6, 0.4),
    Rule("proprietary", "confidential", ("proprietary",), r"(?:proprietary and confidential|confidential and proprietary)", 5, 0.6),
    Rule("bsd-3-clause", "clause", ("endorse",), r"neither the names? of .{1,120}? may be used to endorse or promote products", 1, 0.9),
    Rule("bsd-2-clause", "clause", ("redistributions",), r"redistributions in binary form must reproduce the above copyright notice", 5, 0.7),
    Rule("mit", "clause", ("sublicense",), r"permission is hereby granted free of charge to any person obtaining a copy", 1, 0.9),
    Rule("isc", "clause", ("permission",), r"permission to use copy modify and or distribute this software for any purpose with or without fee", 1, 0.9),
    Rule("zlib", "clause", ("misrepresented",), r"the origin of this software must not be misrepresented", 1, 0.9),
    Rule("gpl", "clause", ("free", "redistribute"), r"this program is free software you can redistribute it", 6, 0.5),
), key=lambda r: (r.priority, r.label, r.form, r.expression)))


class Detection(NamedTuple):
    """Words [start, end) of a document, found by a rule."""

    start: int
    end: int
    label: str
    form: str
    priority: int
    confidence: float


def suppress(found: Iterable[Detection]) -> list[Detection]:
    """Detections that lie in no other of a higher priority, nor in a longer one of their own.

    Of equal stretches of one priority the first label, then form, stays.
    """
    order = sorted(found, key=lambda d: (d.priority, d.start, -d.end, d.label, d.form))
    kept: list[Detection] = []
    above_starts: list[int] = []
    above_reach: list[int] = []
    at = 0
    while at < len(order):
        level, reach = order[at].priority, -1
        fresh = []
        while at < len(order) and order[at].priority == level:
            one = order[at]
            k = bisect_right(above_starts, one.start)
            if one.end > reach and not (k and above_reach[k - 1] >= one.end):
                fresh.append(one)
            reach = max(reach, one.end)
            at += 1
        kept += fresh
        spans = sorted((d.start, d.end) for d in kept)
        above_starts = [s for s, _ in spans]
        above_reach, high = [], -1
        for _, end in spans:
            high = max(high, end)
            above_reach.append(high)
    return sorted(kept)


#: A-Z to a-z; all other bytes below 0x80 that are neither digits nor letters to blanks.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32
              for b in range(256))


def words_of(text: str) -> list[bytes]:
    """Words of the lower-cased text."""
    return text.encode().translate(_FOLD).split()


class _Scanner:
    """Compiled rules, and the keywords by which they are chosen."""

    def __init__(self, rules: tuple[Rule, ...]):
        self.rules = [(tuple(w.encode() for w in r.keywords),
                       re.compile(f"(?= ({r.expression}) )".encode()), r) for r in rules]
        self.stems = sorted({w for keywords, _, _ in self.rules for w in keywords})
        # every rule has a word of ``doors``: texts without any of them are left after these looks
        self.doors = sorted({keywords[0] for keywords, _, _ in self.rules})

    def scan(self, joined: bytes) -> list[Detection]:
        """All detections in words that are joined by, and stand between, single blanks."""
        if not any(w in joined for w in self.doors):
            return []
        there = {w for w in self.stems if w in joined}
        hits = []
        for keywords, expression, rule in self.rules:
            if there.issuperset(keywords):
                hits += [(m.start(1), m.end(1), rule) for m in expression.finditer(joined)]
        return [Detection(joined.count(b" ", 0, a) - 1, joined.count(b" ", 0, b),
                          r.label, r.form, r.priority, r.confidence) for a, b, r in hits]


@lru_cache(maxsize=4)
def scanner(rules: tuple[Rule, ...] = RULES) -> _Scanner:
    return _Scanner(rules)


def places(joined: bytes, phrases=BASE) -> list[tuple[int, str]]:
    """(first word, label) of every place where a base phrase stands, in order."""
    found = []
    for phrase, label in phrases:
        sought, at = f" {phrase} ".encode(), -1
        while (at := joined.find(sought, at + 1)) >= 0:
            found.append((joined.count(b" ", 0, at), label))
    return sorted(found)


BASE_TYPE = pa.list_(pa.struct([("word", pa.int64()), ("label", pa.string())]))
FOUND_TYPE = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("label", pa.string()),
                                 ("form", pa.string()), ("confidence", pa.float64())]))
SCHEMA = ("n_words long, base array<struct<word:long,label:string>>, found array<struct<start:long,"
          "end:long,label:string,form:string,confidence:double>>")


def scan_licenses(docs: DataFrame, key: str = "doc_id", text: str = "text",
                  rules: tuple[Rule, ...] = RULES, phrases=BASE) -> DataFrame:
    """Per row of ``docs``: key, n_words, base places and detections, see the module.

    ``base`` has (word, label) of every base phrase, ``found`` the detections that stay, by
    their words [start, end), with label, form and confidence.
    """
    def scan(batches):
        rule_set = scanner(rules)
        for batch in batches:
            for part in chunks(batch, "_text", CHUNK_BYTES):
                n, base, found = [], [], []
                for t in part["_text"].to_pylist():
                    words = words_of(t)
                    joined = b" %b " % b" ".join(words)
                    n.append(len(words))
                    base.append([{"word": w, "label": label} for w, label in places(joined, phrases)])
                    found.append([{"start": d.start, "end": d.end, "label": d.label, "form": d.form,
                                   "confidence": d.confidence}
                                  for d in suppress(rule_set.scan(joined))])
                yield pa.RecordBatch.from_arrays(
                    [part["_key"], pa.array(n, pa.int64()), pa.array(base, BASE_TYPE),
                     pa.array(found, FOUND_TYPE)], ["_key", "n_words", "base", "found"])

    rows = docs.select(F.col(key).alias("_key"), whole_text(text).alias("_text"))
    kind = rows.schema["_key"].dataType.simpleString()
    return rows.mapInArrow(scan, f"_key {kind}, {SCHEMA}").withColumnRenamed("_key", key)


def license_digest(scanned: DataFrame, key: str = "doc_id") -> DataFrame:
    """Digest of ``scan_licenses``: counts and places of base phrases, labels and score.

    ``labels`` are those of base phrases and of detections; the score is the highest confidence,
    1 for a base phrase.
    """
    def joined(labels: str):
        return F.expr(f"array_join(array_sort(array_distinct({labels})), ',')")

    return scanned.select(
        key, "n_words", F.size("base").cast("long").alias("n_base"),
        F.expr("array_min(base.word)").alias("first_word"),
        F.expr("array_max(base.word)").alias("last_word"),
        joined("base.label").alias("base_labels"),
        joined("concat(base.label, found.label)").alias("labels"),
        F.expr("CASE WHEN size(base) > 0 THEN 1.0D "
               "ELSE coalesce(array_max(found.confidence), 0.0D) END").alias("score"))
