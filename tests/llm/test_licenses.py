"""License scan against all rules tried one by one, and base phrases word by word."""

from __future__ import annotations

import random
import re

import pytest

from matchlake.llm import licenses, queries

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, base string, found string, n_words int"


def words(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)


def base_of(text):
    w, found = words(text), []
    for phrase, label in licenses.BASE:
        sought = phrase.split()
        found += [(i, label) for i in range(len(w)) if w[i:i + len(sought)] == sought]
    at = [i for i, _ in found]
    return (len(w), len(found), min(at, default=None), max(at, default=None),
            ",".join(sorted({label for _, label in found})))


def slow_detections(text):
    """Every rule on the whole text, without keywords; suppression by comparing all pairs."""
    joined = f" {' '.join(words(text))} ".encode()
    found = []
    for r in licenses.RULES:
        for m in re.finditer(f"(?= ({r.expression}) )".encode(), joined):
            found.append((joined[:m.start(1)].count(b" ") - 1, joined[:m.end(1)].count(b" "),
                          r.label, r.form, r.priority))
    kept = []
    for d in set(found):
        inside = any(
            e[0] <= d[0] and d[1] <= e[1] and (
                e[4] < d[4] or e[4] == d[4] and (e[1] - e[0] > d[1] - d[0] or (
                    e[:2] == d[:2] and e[2:4] < d[2:4])))
            for e in set(found))
        if not inside:
            kept.append(d)
    return sorted(d[:4] for d in kept)


CASES = {
    "Released under the MIT License.": "mit",
    "Licensed under the Apache License, Version 2.0": "apache-2",
    "licensed under the GNU General Public License, version 3": "gpl-3",
    "Licensed under CC BY-NC 4.0": "cc-by-nc",
    "Licensed under CC BY-NC-SA 4.0": "cc-by-nc,cc-by-nc-sa",
    "GNU Lesser General Public License v2.1": "lgpl-2.1",
    "// SPDX-License-Identifier: GPL-3.0-or-later": "gpl-3",
    "License: BSD-3-Clause": "bsd-3-clause",
    "under the terms of the Mozilla Public License, v. 2.0": "mpl-2",
    "Creative Commons Attribution 4.0 International License": "cc-by",
    "available under the Creative Commons Attribution-ShareAlike 3.0 license": "cc-by-sa",
    "modify it under the terms of the GNU General Public License as published by the Free "
    "Software Foundation; either version 2 of the License": "gpl-2",
    "a driving license and the general public": "", "permit license committee": ""}


@pytest.mark.parametrize("text, want", CASES.items())
def test_rules(text, want):
    joined = b" %b " % b" ".join(licenses.words_of(text))
    found = {d.label for d in licenses.suppress(licenses.scanner().scan(joined))}
    assert ",".join(sorted(found | {x for _, x in licenses.places(joined)})) == want


def test_hundreds_of_rules_each_with_keywords_it_needs():
    assert len(licenses.RULES) > 300 and len(set(licenses.RULES)) == len(licenses.RULES)
    draw = random.Random(1)
    parts = sorted({w for t in CASES for w in words(t)}) + ["gpl", "v3", "2", "0", "cc0", "isc"]
    for text in [*CASES, *(" ".join(draw.choice(parts) for _ in range(60)) for _ in range(60))]:
        joined = b" %b " % b" ".join(licenses.words_of(text))
        found = [tuple(d[:4]) for d in licenses.suppress(licenses.scanner().scan(joined))]
        assert sorted(found) == slow_detections(text)


def test_suppression():
    make = licenses.Detection
    found = [make(0, 9, "long", "f", 2, 1), make(2, 5, "inner", "f", 2, 1), make(2, 5, "high", "f", 1, 1),
             make(2, 5, "low", "f", 3, 1), make(7, 12, "partly", "f", 3, 1), make(0, 9, "same", "f", 2, 1)]
    assert [d.label for d in licenses.suppress(found)] == ["long", "high", "partly"]


def test_query_equals_words_one_by_one(spark):
    texts = {r["doc_id"]: r["text"] for r in
             spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
    rows = queries.QUERIES["op12_licenses"](spark, SF).collect()
    assert len(rows) == len(texts) and sum(r["n_base"] for r in rows) > 0
    for r in rows:
        base = base_of(texts[r["doc_id"]])
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == base
        labels = {d[2] for d in slow_detections(texts[r["doc_id"]])} | set(
            filter(None, base[4].split(",")))
        assert r["labels"] == ",".join(sorted(labels))
        assert 0 <= r["score"] <= 1 and (r["score"] > 0) == bool(labels)


def test_nulls_repeats_ties_and_long_texts(spark):
    twice = "under the MIT license under the mit LICENSE, cc-by-nc. " + "İ é \x7f漢字 " * 3
    rows = [(None, twice), (None, twice), (2, twice), (2, None), (3, ""), (4, "-- \x00 !"),
            (5, "under the mit " * 40_000 + "license"), (6, "x" * 1_000_000), (7, "cc by nc " * 20_000)]
    docs = spark.createDataFrame([(*r, "b", "f", 1) for r in rows], SCHEMA)
    found = licenses.license_digest(licenses.scan_licenses(docs)).collect()
    short = lambda r: (str(r[0]), *map(str, r[1]))
    got = [(r["doc_id"], (r["n_words"], r["n_base"], r["first_word"], r["last_word"],
                          r["base_labels"])) for r in found]
    assert sorted(got, key=short) == sorted([(i, base_of(t)) for i, t in rows[:-1]] + [
        (7, (60_000, 20_000, 0, 59_997, "cc-by-nc"))], key=short)
    assert licenses.scan_licenses(docs.limit(0)).collect() == []
