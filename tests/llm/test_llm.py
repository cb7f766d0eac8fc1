"""Operators of the training-data package against brute force, and their edge cases."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import Counter
from functools import lru_cache

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from matchlake.llm import (exact_dedup, fingerprint, forced_bpe, html_text, language, near_dedup,
                           packing, quality, queries, substring_dedup, token_files)
from matchlake.llm.word_tokens import encoder, library

SF = "/root/testdata/sf0.001"
WORDS = public_tokenizers.path("word_bpe_49k.json")
BYTES = public_tokenizers.path("byte_bpe_50k.json")
ODD = ["", " ", "a  b", "a   b", "a \n b\n\n  c", "İstanbul ΑΣ ς", "it's 'll 12½ é", "漢字 かな ٣",
       "<|endoftext|>hi <|startoftext|>", "\x1c a\x0bb\x85c\xa0d", "ab" * 1500, "x" * 4000, "🙂 ok"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, k string, t int"


def documents(spark, texts, lang="en"):
    """A table with repeated texts, a null, and columns that clash with inner names."""
    rows = [(i, t, lang, "s", len(t or ""), "k", 1) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def small(spark):
    return documents(spark, [*ODD, None, *ODD[5:8], "one two three " * 30])


@pytest.fixture(scope="module")
def texts(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect()
    return {r["doc_id"]: r["text"] for r in rows}


cached = lru_cache(library)


def ids_of(path, text):
    return cached(path).encode(text, add_special_tokens=False).ids


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_word_encoder_equals_library(texts):
    cases = ODD + list(texts.values())[:60] + [f"a{chr(c)}b" for c in range(1, 0x400)]
    assert encoder(WORDS)(cases) == [np.array(ids_of(WORDS, t), "<u4").tobytes() for t in cases]


def test_forced_bpe_equals_library(texts):
    draw = random.Random(1)
    cases = ODD + list(texts.values())[:60] + [
        "".join(draw.choice(" \n\tab'sé.1!") for _ in range(12)) for _ in range(2_000)]
    bpe, lib = forced_bpe.coder(BYTES), library(BYTES)
    for t in cases:
        ids = ids_of(BYTES, t)
        assert bpe.encode(t) == ids
        assert bpe.decode(ids) == lib.decode(ids, skip_special_tokens=False)
    assert not bpe.joined[ord("e"), ord(" ")] and bpe.joined[ord("t"), ord("h")]


def test_forced_bpe_of_long_unbroken_runs():
    bpe, draw = forced_bpe.coder(BYTES), random.Random(7)
    for text in ("a" * 3_000, "-=" * 1_500, "".join(draw.choice("abcdeth") for _ in range(4_000)),
                 "é" * 900 + "漢" * 900):
        assert bpe.encode(text) == ids_of(BYTES, text)
    fragment = bytes(draw.choice(b"theandro") for _ in range(120))
    assert bpe._merge(fragment) == bpe._merge_long(fragment)
    n, _, decoded = bpe.digest("x" * 1_000_000)
    assert decoded == "x" * 1_000_000 and 0 < n < 1_000_000


def brute_log_chance(model, word, n):
    """Sum over all segmentations of the word, one by one."""
    text = language.START + word

    def cuts(at):
        if at == len(text):
            return 1.0
        total = 0.0
        for end in range(at + 1, len(text) + 1):
            piece = text[at:end]
            if piece in model.table:
                total += model.table[piece][n] * cuts(end)
            elif end == at + 1:
                total += language.FLOOR * cuts(end)
        return total

    return np.log(cuts(0))


def test_language_chances_sum_over_all_segmentations():
    draw = random.Random(8)
    pieces = {"".join(draw.choice("abc▁") for _ in range(draw.randint(1, 4))) for _ in range(40)}
    model = language.PieceModel(["x", "y", "z"], {
        p: tuple(draw.random() / 40 for _ in range(3)) for p in pieces}, [0.0] * 3)
    for _ in range(60):
        word = "".join(draw.choice("abcd") for _ in range(draw.randint(1, 11)))
        want = [brute_log_chance(model, word, n) for n in range(3)]
        assert np.allclose(model.log_chances(word), want)
        # the expected uses of one word add up to its characters, weighted by piece length
        uses = Counter()
        model.expected(word, 2.0, 1, uses)
        assert np.isclose(sum(v * len(p) for p, v in uses.items()), 2.0 * (len(word) + 1))
    many = ["".join(draw.choice("abcd") for _ in range(draw.randint(1, 9))) for _ in range(800)]
    assert np.allclose(model.log_chances_many(many), [model.log_chances(w) for w in many])
    long = "abcab" * 400
    assert np.isfinite(model.log_chances(long)).all()


def test_forced_bpe_query(spark, small):
    for r in forced_bpe.encoding_digest(small, BYTES).join(small.select("doc_id", "text"),
                                                            "doc_id").collect():
        ids = ids_of(BYTES, r["text"] or "")
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256((r["text"] or "").encode()).hexdigest()


@pytest.mark.parametrize("bits", [False, True])
def test_token_segments_round_trip(bits):
    ids = np.random.default_rng(2).integers(0, 1 << 20, 5_001).astype("<u4")
    data = token_files.pack_ids(ids, block_ids=1_000, bits=bits)
    assert (token_files.unpack_ids(data) == ids).all()
    assert (token_files.unpack_ids(data, 990, 1_020) == ids[990:2_010]).all()
    assert not len(token_files.unpack_ids(token_files.pack_ids(ids[:0])))


def test_token_files(spark, small):
    start = 0
    found = token_files.token_file_digest(small, WORDS).orderBy("doc_id").collect()
    for r, t in zip(found, small.orderBy("doc_id").collect(), strict=True):
        ids = ids_of(WORDS, t["text"] or "") + [1]
        assert (r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) == (
            t["doc_id"], start, len(ids), crc(ids))
        start += len(ids)


def test_tournament_is_first_fit():
    draw = random.Random(3)
    tree, free = packing.Tournament(200, 100), [100] * 200
    for _ in range(200):
        n = draw.randint(1, 100)
        first = next(k for k, f in enumerate(free) if f >= n)
        free[first] -= n
        assert tree.place(n) == first


def test_packing(spark, small):
    texts = {r["doc_id"]: r["text"] or "" for r in small.collect()}
    rows = packing.pack(small, WORDS, capacity=64, group_docs=4).collect()
    for k, t in texts.items():
        ids, at = ids_of(WORDS, t) + [2], 0
        for r in sorted((r for r in rows if r["doc_id"] == k), key=lambda r: r["start"]):
            assert (r["start"], r["doc_tokens"]) == (at, len(ids))
            assert r["ids_crc32"] == crc(ids[at:at + r["length"]])
            at += r["length"]
        assert at == len(ids)
    fill = Counter()
    for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == fill[r["sequence_id"]]
        fill[r["sequence_id"]] += r["length"]
    assert max(fill.values()) <= 64
    assert sum(packing.padded(n, 64) for n in fill.values()) == sum(fill.values())


def test_packing_without_ids(spark):
    """A third of the rows has no id, a third one id: dealt over groups, each row whole."""
    texts = [f"text {i} " * (1 + i % 30) for i in range(240)]
    rows = [(None if i % 3 == 0 else 7 if i % 3 == 1 else i, t) for i, t in enumerate(texts)]
    pieces = packing.pack(spark.createDataFrame(rows, "doc_id long, text string"), WORDS,
                          group_docs=20).collect()
    for key in (None, 7):
        groups = Counter(r["sequence_id"] >> 32 for r in pieces if r["doc_id"] == key)
        assert len(groups) > 8
        lengths = sorted(len(ids_of(WORDS, t)) + 1 for k, t in rows if k == key)
        assert sum(r["length"] for r in pieces if r["doc_id"] == key) == sum(lengths)
        assert sorted(r["doc_tokens"] for r in pieces if r["doc_id"] == key and r["start"] == 0) \
            == lengths


def test_exact_groups(spark):
    rows = documents(spark, ["a", "b", "a", None, "", "a", "c"])
    found = {r["doc_id"]: r for r in exact_dedup.exact_groups(rows, capacity=1).collect()}
    assert [found[i]["keep_id"] for i in range(7)] == [5, 1, 5, 4, 4, 5, 6]
    assert [found[i]["kept"] for i in range(7)] == [False, True, False, False, True, True, True]
    assert found[0]["group_size"] == 3
    left = exact_dedup.drop_copies(rows)
    assert left.columns == rows.columns and left.count() == 4


def directory_of(values, capacity):
    """The shortest prefix of every hash that is not overfull, one bit after another."""
    buckets, waiting = {}, [(0, 0, sorted(v % 2 ** 64 for v in values))]
    while waiting:
        depth, prefix, inside = waiting.pop()
        if len(inside) <= capacity:
            buckets[depth, prefix] = len(inside)
            continue
        for side in (0, 1):
            half = [v for v in inside if v >> 63 - depth & 1 == side]
            if half:
                waiting.append((depth + 1, 2 * prefix + side, half))
    return buckets


def test_directory_doubles_until_buckets_fit(spark):
    even = [r["h"] for r in spark.range(3_000).select(F.xxhash64("id").alias("h")).collect()]
    near = [(1 << 62) + k for k in range(40)] + [-k for k in range(1, 30)]
    for values, capacity in ((even, 300), (even + near, 7), (near, 1), (even[:5], 300)):
        hashes = spark.createDataFrame([(v,) for v in values], "h long")
        found = exact_dedup.directory(hashes, capacity, doublings=16).collect()
        assert {(r["local_depth"], r["prefix"] % 2 ** 64): r["load"] for r in found} == \
            directory_of(values, capacity)
        assert len(found) == len({(r["local_depth"], r["prefix"]) for r in found})


@pytest.mark.parametrize("hashed", [lambda t: F.lit(5), lambda t: F.length(t) - 3, F.xxhash64])
def test_collisions_are_chained_and_told_by_bytes(spark, hashed):
    """All texts in one hash, some in one hash, none; a third of the rows holds one text."""
    draw = random.Random(3)
    texts = ["hot"] * 60 + [draw.choice(["a", "b", "ab", "ba", "abc", "é", "", None, "b "])
                            for _ in range(120)]
    draw.shuffle(texts)
    found = {r["doc_id"]: r for r in exact_dedup.exact_groups(
        documents(spark, texts), capacity=1, hashed=hashed).collect()}
    assert len(found) == len(texts)
    plain = [t or "" for t in texts]
    for i, t in enumerate(plain):
        same = [k for k, u in enumerate(plain) if u == t]
        assert (found[i]["keep_id"], found[i]["group_size"], found[i]["kept"]) == \
            (max(same), len(same), i == max(same))
        assert found[i]["text_sha256"] == hashlib.sha256(t.encode()).hexdigest()


def test_rows_find_their_group_through_the_index(spark):
    """Without the directory there is no answer; the buckets of all pages are in it."""
    rows = documents(spark, [f"text {i % 40}" for i in range(100)]) \
        .select("doc_id", F.xxhash64("text").alias("h"), F.col("text").alias("t"),
                F.sha2("text", 256).alias("sha"))
    entries = rows.select("doc_id", "h", "sha")
    index = exact_dedup.build_index(rows, rows.select("h").distinct(), 100, capacity=3)
    pages = spark.read.parquet(index.pages)
    buckets = spark.read.parquet(index.directory)
    assert pages.count() == 40 and buckets.agg(F.sum("load")).first()[0] == 40
    assert pages.join(buckets, ["local_depth", "prefix", "owner"]).count() == 40
    assert index.found(entries, rows).count() == 100
    lost = exact_dedup.Index(index.directory + "-none", index.pages, index.overflow,
                             index.owners, index.rows)
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        lost.found(entries, rows)


def brute_repeats(texts, window=20):
    words = {i: t.encode().split() for i, t in sorted(texts.items())}
    first = {}
    for i, w in words.items():
        for q in range(len(w) - window + 1):
            first.setdefault(b" ".join(w[q:q + window]), (i, q))
    out = {}
    for i, w in words.items():
        gone = [False] * len(w)
        for q in range(len(w) - window + 1):
            if first[b" ".join(w[q:q + window])] != (i, q):
                gone[q:q + window] = [True] * window
        kept = b" ".join(x for x, g in zip(w, gone) if not g)
        out[i] = (len(w), sum(gone), hashlib.sha256(kept).hexdigest())
    return out


def test_substring_dedup(spark, texts):
    want = brute_repeats(texts)
    for r in queries.QUERIES["op4_substring_dedup"](spark, SF).collect():
        assert (r["n_words"], r["n_removed"], r["kept_sha256"]) == want[r["doc_id"]]


def test_substring_dedup_small(spark):
    draw = random.Random(4)
    vocabulary = ["w%d" % k for k in range(3)]
    texts = {i: " ".join(draw.choice(vocabulary) for _ in range(draw.randint(0, 60)))
             for i in range(30)} | {30: "x " * 500, 31: "", 32: "x " * 19}
    rows = documents(spark, list(texts.values())).unionByName(
        documents(spark, [None]).withColumn("doc_id", F.lit(99).cast("long")))
    found = {r["doc_id"]: r for r in substring_dedup.remove_repeats(rows).collect()}
    for i, (n, gone, sha) in brute_repeats(texts).items():
        r = found[i]
        assert (r["n_words"], r["n_removed"], r["kept_sha256"]) == (n, gone, sha)
        assert hashlib.sha256(r["kept_text"].encode()).hexdigest() == sha
    assert found[99]["n_words"] == 0


def brute_components(texts, near):
    sets = {}
    for i, t in texts.items():
        w = t.encode().lower().split()
        k = near.shingle
        sets[i] = {tuple(w[q:q + k]) for q in range(len(w) - k + 1)} if len(w) >= k else (
            {tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in sets:
        for j in sets:
            if i < j and sets[i] and 100 * len(sets[i] & sets[j]) >= near.percent * len(
                    sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in sets}


def near_copies():
    """A group of very many copies with changes, so that few pairs are near."""
    draw = random.Random(5)
    base = ["w%d" % draw.randint(0, 400) for _ in range(120)]
    out = ["", " \n", "Two words", "two WORDS", "other"]
    for _ in range(150):
        copy = list(base)
        for _ in range(draw.randint(0, 6)):
            copy[draw.randrange(len(copy))] = "v%d" % draw.randint(0, 30)
        out.append(" ".join(copy))
    return out


@pytest.mark.parametrize("near", [near_dedup.QUERY, near_dedup.STAGE])
def test_near_components(spark, near):
    texts = dict(enumerate(near_copies()))
    want = brute_components(texts, near)
    rows = documents(spark, [*texts.values(), None])
    found = {r["doc_id"]: r for r in near_dedup.near_components(rows, near).collect()}
    for i, (n, component) in want.items():
        assert (found[i]["n_shingles"], found[i]["component_id"]) == (n, component)
        assert found[i]["kept"] == (component == i)
    assert found[len(texts)]["kept"]


def test_near_query(spark, texts):
    want = brute_components(texts, near_dedup.QUERY)
    for r in queries.QUERIES["op5_near_dedup"](spark, SF).collect():
        assert (r["n_shingles"], r["component_id"]) == want[r["doc_id"]]


def test_entropy_of_all_windows():
    data = np.frombuffer(("abca" * 9 + "xyz é" * 5).encode(), np.uint8)
    width = fingerprint.WINDOW
    want = []
    for q in range(len(data) - width + 1):
        p = np.bincount(data[q:q + width]) / width
        p = p[p > 0]
        want.append(-(p * np.log2(p)).sum() / np.log2(width) * (fingerprint.LEVELS - 1))
    assert np.abs(fingerprint.entropy_levels(data) - np.array(want)).max() <= 0.51


def test_fingerprints(spark, texts):
    found = {r["doc_id"]: r for r in queries.QUERIES["op3_fingerprint"](spark, SF).collect()}
    order = sorted(found, reverse=True)
    prints = {}
    for a, b in zip(order, order[1:] + order[:1]):
        t, r = texts[a], found[a]
        cut = len(t) // 3
        edited = t[:len(t) - cut] + texts[b][:cut]
        assert r["n_chars"] == len(t)
        assert r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert prints.setdefault(t, r["fingerprint"]) == r["fingerprint"]
        assert 0 <= r["near_next"] <= 1
    assert np.median([r["near_edited"] for r in found.values()]) > 0.5
    assert np.median([r["near_next"] for r in found.values()]) < 0.1


def test_fingerprints_of_odd_texts(spark, small):
    rows = fingerprint.fingerprints(small).collect()
    assert len(rows) == small.count()
    assert fingerprint.fingerprints(documents(spark, ["alone"])).first()["near_next"] == 1.0


def test_quality(spark):
    labels = {r["doc_id"]: r["quality"] for r in
              spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    rows = queries.QUERIES["op1_quality"](spark, "/root/testdata/sf0.01").collect()
    held = [r for r in rows if r["held_out"] and r["doc_id"] in labels]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in rows)
    assert np.mean([r["predicted"] == labels[r["doc_id"]] for r in held]) > 0.95
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in rows)


def test_isotonic_pool():
    x, y = quality.pool(np.arange(5.0), np.array([0, 2, 1, 1, 3.0]), np.full(5, 3.0))
    assert (np.diff(y) > 0).all() and y[0] == 0 and y[-1] == 1


def test_quality_without_labels(spark, small):
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r["score"] for r in quality.score_documents(small, none).collect()} == {0.5}
    one = spark.createDataFrame([(0, 1), (2, 1), (3, None)], "doc_id long, quality int")
    assert {r["score"] for r in quality.score_documents(small, one).collect()} <= {0.5, 1.0}


def test_language(spark):
    sf = "/root/testdata/sf0.01"
    langs = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{sf}/documents.parquet")
             .select("doc_id", "lang").collect()}
    rows = queries.QUERIES["op8_language"](spark, sf).collect()
    held = [r for r in rows if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)
    assert np.mean([r["lang_pred"] == langs[r["doc_id"]] for r in held]) > 0.97


def test_forward_pass_sums_all_segmentations():
    table = {"▁": (0.2,), "a": (0.1,), "b": (0.3,), "▁a": (0.05,), "ab": (0.25,)}
    model = language.PieceModel(["x"], table, [0.0])
    want = 0.2 * 0.1 * 0.3 + 0.05 * 0.3 + 0.2 * 0.25
    assert np.exp(model.log_chances("ab")[0]) == pytest.approx(want)
    assert np.isfinite(model.log_chances("ab" * 400)[0])


def test_language_edges(spark, small):
    path = public_tokenizers.path("piece_bpe_32k.model")
    found = {r["doc_id"]: r for r in language.identify(small, path).collect()}
    assert found[0]["lang_pred"] == found[1]["lang_pred"] == "und"
    assert found[2]["lang_pred"] == "en" and found[2]["score"] == 1.0
    blank = language.identify(small.withColumn("lang", F.lit(None).cast("string")), path)
    assert {r["lang_pred"] for r in blank.collect()} == {"und"}


PAGE = ("<html><head><title>t</title><style>p{}</style></head><body><nav><ul><li><a href=/a>Menu</a>"
        "</ul></nav><div class='ad'>Buy!</div><article><h1>Ti&amp;tle %d</h1><p>Some <b>lon</b>ger "
        "text,\n with  words. More of it.<p>Second<br>block<script>x<y</script></article>"
        "<div id=comments><p>Nice, really.</p></div><footer>&copy; me</footer></body></html>")


def test_main_texts(spark):
    rows = [(i, f"u{i}", PAGE % i, "x") for i in range(40)] + [
        (90, None, None, None), (91, "u", "", ""), (92, "u", "<p>only <i>te</i>xt", ""), (93, "u", "<", "")]
    found = {r["page_id"]: r for r in html_text.main_texts(
        spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()}
    for i in range(40):
        assert found[i]["text"] == (f"Ti&tle {i} Some longer text, with words. More of it. "
                                    "Second block")
        assert found[i]["n_chars"] == len(found[i]["text"])
    assert [found[i]["text"] for i in (90, 91, 92)] == ["", "", "only text"]


def test_decoding_has_no_contradiction():
    page = html_text.parse(PAGE % 1)
    odds = np.random.default_rng(6).normal(size=len(page.tag)) * 3
    kept = html_text.decode(page, odds)
    assert all(kept[page.parent[k]] for k in range(1, len(kept)) if kept[k])


def test_empty_tables(spark):
    none = documents(spark, ["a"]).where("doc_id < 0")
    labels = spark.createDataFrame([], "doc_id long, quality int")
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    pieces = public_tokenizers.path("piece_bpe_32k.model")
    for found in (exact_dedup.exact_groups(none), near_dedup.near_components(none),
                  substring_dedup.remove_repeats(none), packing.pack(none, WORDS),
                  token_files.token_file_digest(none, WORDS), fingerprint.fingerprints(none),
                  forced_bpe.encode_documents(none, BYTES), quality.score_documents(none, labels),
                  language.identify(none, pieces), html_text.main_texts(pages)):
        assert found.count() == 0


def test_pipeline(spark, texts, tmp_path):
    """Every stage on its own input; exact, near and passage stages against brute force."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = {r["doc_id"]: r["quality"] for r in
              spark.read.parquet(f"{SF}/labels.parquet").collect()}
    before = None
    for number, (name, stage) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path / str(number))
        stage(spark, docs, SF).write.parquet(path)
        after = spark.read.parquet(path)
        given = {r["doc_id"]: r["text"] for r in docs.collect()}
        if name != "packing":
            assert after.columns == docs.columns
            left = {r["doc_id"]: r["text"] for r in after.collect()}
        if name == "quality classifier":
            kept = [i in left for i, q in labels.items() if q == 1]
            assert np.mean(kept) > 0.9
        elif name == "exact dedup":
            assert set(left) == {max(i for i, u in given.items() if u == t)
                                 for t in given.values()}
        elif name == "MinHash near-dedup":
            groups = brute_components(given, near_dedup.STAGE)
            assert set(left) == {i for i, (_, c) in groups.items() if c == i}
        elif name == "substring dedup":
            want = brute_repeats(given)
            assert set(left) == {i for i, (n, gone, _) in want.items() if not gone or gone < n}
            for i, t in left.items():
                kept = b" ".join(t.encode().split())
                assert hashlib.sha256(kept).hexdigest() == want[i][2]
        else:
            total = after.groupBy("doc_id").agg(F.sum("length").alias("n"),
                                                F.first("doc_tokens").alias("m"))
            assert total.count() == len(given) and total.where("n <> m").isEmpty()
        docs = after


def test_passages_of_repeated_rows_and_null_ids(spark):
    """Rows are told apart where their ids are not."""
    a, b, c = (" ".join(f"{x}{k}" for k in range(30)) for x in "abc")
    rows = [(7, a), (7, a), (None, b), (None, f"{b} tail"), (3, f"{c}  end"), (3, None), (None, None),
            (8, f"{a} own"), (9, "short"), (9, "short")]
    docs = spark.createDataFrame([(i, t, "en", f"s{n}", -1, "k", n)
                                  for n, (i, t) in enumerate(rows)], SCHEMA).coalesce(1)
    left = corpus_pipeline.repeated_passages(spark, docs, SF)
    assert left.schema.names == docs.schema.names and left.dtypes == docs.dtypes
    found = {r["t"]: (r["doc_id"], r["text"], r["source"], r["n_chars"]) for r in left.collect()}
    want = {n: (i, t, f"s{n}", -1) for n, (i, t) in enumerate(rows)}
    del want[1]
    want[3], want[7] = (None, "tail", "s3", 4), (8, "own", "s7", 3)
    assert found == want


def numbered(spark, rows):
    """Documents with the given (id, text); the column t numbers the rows."""
    return spark.createDataFrame([(i, t, "en", "s", 0, "k", n) for n, (i, t) in enumerate(rows)],
                                 SCHEMA)


def test_drop_copies_by_row(spark):
    rows = [(5, "A"), (9, "A"), (5, "B"), (None, "A"), (None, "A"), (None, "C"), (None, "C"),
            (None, None), (2, ""), (9, "A")]
    left = exact_dedup.drop_copies(numbered(spark, rows))
    assert sorted(r["t"] for r in left.collect()) == [1, 2, 5, 6, 8, 9]


def test_keep_first_by_row(spark):
    a, b, c = (" ".join(f"{x}{k}" for k in range(60)) for x in "abc")
    rows = [(5, a), (9, f"{a} end"), (5, f"{b} end"), (3, b), (9, c), (None, f"{a} other"),
            (None, a), (None, "d " + b), (None, "own words of one"), (None, "Own words of one"),
            (None, "same text"), (None, "same text"), (None, None), (None, ""), (4, None), (4, None),
            (9, c), (5, "alone"), (3, "quite alone")]
    left = near_dedup.keep_first(numbered(spark, rows))
    assert left.dtypes == numbered(spark, rows).dtypes
    found = [r["t"] for r in left.collect()]
    one = [n for n in found if n in (8, 9)], [n for n in found if n in (10, 11)]
    assert [len(x) for x in one] == [1, 1]
    assert sorted(set(found) - set(sum(one, []))) == [0, 3, 4, 12, 13, 14, 15, 16, 17, 18]


def test_fingerprints_without_ids_and_with_repeated_ids(spark):
    """A third of the rows has no id, another third one id: every row has a row."""
    texts = [f"text number {i} of the table " * (1 + i % 4) for i in range(90)] + [None, ""]
    rows = [(None if i % 3 == 0 else 7 if i % 3 == 1 else 100 + i, t) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = fingerprint.fingerprints(docs).collect()
    order = sorted(((k, t or "") for k, t in rows if k is not None), key=lambda r: (-r[0], r[1]))
    want = [(None, t or "", t or "") for k, t in rows if k is None]
    want += [(k, t, order[(n + 1) % len(order)][1]) for n, (k, t) in enumerate(order)]

    def edited(k, t, after):
        cut = len(t) // 3
        return k, len(t), hashlib.sha256((t[:len(t) - cut] + after[:cut]).encode()).hexdigest()

    assert sorted([(r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in found], key=str) == \
        sorted([edited(*w) for w in want], key=str)
    lone = spark.createDataFrame([(None, "a" * 50)] * 3, "doc_id long, text string")
    assert fingerprint.fingerprints(lone).count() == 3


def test_near_dedup_holds_few_rows_at_a_time(spark, monkeypatch):
    """Whole sets and texts reach Python a few hundred rows at a time, whatever the session says."""
    from matchlake.llm import near_dedup
    from matchlake.llm.common import BATCH_ROWS
    seen, inner = [], near_dedup._near_components
    monkeypatch.setattr(near_dedup, "_near_components", lambda docs, *rest: (
        seen.append(int(docs.sparkSession.conf.get(BATCH_ROWS))), inner(docs, *rest))[1])
    before = spark.conf.get(BATCH_ROWS, None)
    docs = spark.createDataFrame([(i, f"one two three four {i % 2}") for i in range(4)], "doc_id long, text string")
    found = near_dedup.near_components(docs).orderBy("doc_id").collect()
    assert [r.component_id for r in found] == [0, 1, 0, 1] and seen == [near_dedup.ROWS]
    assert spark.conf.get(BATCH_ROWS, None) == before
