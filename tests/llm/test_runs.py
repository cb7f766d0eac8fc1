"""Periodic runs against a search over all periods."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from matchlake.llm import queries, runs

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, runs string, _text string, n_words int"


def brute_runs(words, least=12):
    """(start, length, period) of every run: all stretches that agree one period on."""
    found = {}
    for q in range(1, len(words) // 2 + 1):
        at = 0
        while at + q < len(words):
            start = at
            while at + q < len(words) and words[at] == words[at + q]:
                at += 1
            if at > start and at + q - start >= max(least, 2 * q):
                found.setdefault((start, at + q - start), q)
            at += at == start
    return sorted((s, n, q) for (s, n), q in found.items())


def digest(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(words)
    if doc_id is not None and n:
        h = zlib.crc32(str(doc_id).encode())
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        if h % 10 == 0:
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    found = brute_runs(words)
    gone = {i for s, m, q in found for i in range(s + q, s + m)}
    best = min(found, key=lambda r: (-r[1], r[0], r[2])) if found else (None, None, None)
    lines = "".join(f"{s},{m},{q}\n" for s, m, q in found)
    kept = " ".join(w for i, w in enumerate(words) if i not in gone)
    return (len(found), *best, 1000 * best[1] // best[2] if found else None,
            hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest())


def values(r):
    return (r["n_runs"], r["start"], r["length"], r["period"], r["exponent_milli"],
            r["runs_sha256"], r["collapsed_sha256"])


def test_query_equals_brute_force(spark):
    texts = {r["doc_id"]: r["text"] for r in
             spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
    rows = queries.QUERIES["op11_runs"](spark, SF).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert values(r) == digest(r["doc_id"], texts[r["doc_id"]])
    assert sum(r["n_runs"] > 0 for r in rows) > 10


def random_words(draw):
    n = draw.choice([0, 1, 11, 12, 13, 30, 60, 120])
    size = draw.choice([1, 2, 2, 3, 5, 50])
    words = [draw.randrange(size) for _ in range(n)]
    kind = draw.random()
    if kind < 0.5 and n:
        a = draw.randrange(n)
        p = 1 + (n - a) // draw.randint(3, 10)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    elif kind < 0.7:
        one, two = [0], [0, 1]
        while len(two) < n:
            one, two = two, two + one
        words = two[:n]
    return words


def test_find_runs_in_chunks_of_documents():
    draw = random.Random(1)
    for _ in range(300):
        docs = [random_words(draw) for _ in range(draw.randint(1, 6))]
        want, begin = [], 0
        for words in docs:
            want += [(begin + s, begin + s + n, q) for s, n, q in brute_runs(words)]
            begin += len(words)
        found = runs.find_runs(np.array(sum(docs, []), np.int64),
                               np.repeat(np.arange(len(docs)), list(map(len, docs))))
        assert sorted(zip(*(x.tolist() for x in found))) == sorted(want)


def test_grammar_derives_its_words():
    draw = np.random.default_rng(2)
    ids = np.tile(draw.integers(0, 40, 200), 6)
    top, rounds = runs.grammar(ids, np.zeros(len(ids), np.int64))
    assert top.sum() < 250 and rounds
    for number, at, left, size in rounds:
        for k in range(number[-1] + 1):
            places = at[number == k]
            assert len(places) > 1 and 0 < left[number == k][0] < size[number == k][0]
            one = ids[places[0]:places[0] + size[number == k][0]]
            assert all((ids[p:p + len(one)] == one).all() for p in places)


@pytest.mark.parametrize("words, want", [
    (np.zeros(300_000, np.int64), [(0, 300_000, 1)]),
    (np.tile(np.arange(50_000), 4), [(0, 200_000, 50_000)])])
def test_very_long_texts(words, want):
    found = runs.find_runs(words, np.zeros(len(words), np.int64))
    assert list(zip(*(x.tolist() for x in found))) == want


def test_nulls_repeats_and_clashing_columns(spark):
    loop = "a b c " * 6
    rows = [(None, loop), (None, loop), (3, loop), (3, "x"), (4, None), (5, ""), (6, " \n"),
            (7, "\x1c\x85 é " * 20), (8, loop + "d " + loop), (9, "w " * 20_000)]
    docs = spark.createDataFrame([(*r, "r", "t", 1) for r in rows], SCHEMA)
    found = runs.run_digest(runs.periodic_runs(docs)).collect()
    assert len(found) == len(rows)
    want = [(i, *digest(None, t)) for i, t in rows[:-1]] + [
        (9, 1, 0, 20_000, 1, 20_000_000, hashlib.sha256(b"0,20000,1\n").hexdigest(),
         hashlib.sha256(b"w").hexdigest())]
    assert sorted([(r["doc_id"], *values(r)) for r in found], key=lambda x: str(x)) == \
        sorted(want, key=lambda x: str(x))
    assert runs.with_repeats(docs).where("doc_id IS NULL").first()["text"] == loop
    assert runs.periodic_runs(docs.limit(0)).collect() == []


def test_one_document_larger_than_a_chunk(spark):
    texts = ["q r " * 9, "", None, "s " * 40, "z"]
    docs = spark.createDataFrame([(i, t, "", "", 0) for i, t in enumerate(texts)], SCHEMA)
    found = {r["doc_id"]: r for r in runs.run_digest(runs.periodic_runs(docs, chunk_bytes=50)).collect()}
    assert [found[i]["n_runs"] for i in range(5)] == [1, 0, 0, 1, 0]
