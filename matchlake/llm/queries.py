"""Registered queries of the training-data operators: name → Spark query, and SQL answers."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from matchlake.llm import (exact_dedup, fingerprint, forced_bpe, html_text, language, licenses,
                           merkle, near_dedup, packing, quality, runs, substring_dedup, token_files)
from matchlake.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ANSWERS: dict[str, str] = {}


def _query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ANSWERS[name] = sql
        return fn
    return register


@_query("op1_quality")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_documents(table(spark, sf_dir, "documents"),
                                   table(spark, sf_dir, "labels"))


@_query("op2_token_files")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.token_file_digest(
        table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=1)


@_query("op3_fingerprint")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprints(table(spark, sf_dir, "documents"))


@_query("op4_substring_dedup")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeats(table(spark, sf_dir, "documents"), with_text=False)


@_query("op5_near_dedup")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_components(table(spark, sf_dir, "documents"))


@_query("op6_packing")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"),
                        public_tokenizers.path("word_bpe_49k.json"), end_id=2)


@_query("op7_exact_dedup", """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
""")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"))


@_query("op8_language")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(table(spark, sf_dir, "documents"),
                             public_tokenizers.path("piece_bpe_32k.model"))


@_query("op9_html_text")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.main_texts(table(spark, sf_dir, "pages"))


@_query("op10_forced_bpe")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forced_bpe.encoding_digest(
        table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@_query("op11_runs")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = runs.with_repeats(table(spark, sf_dir, "documents"))
    return runs.run_digest(runs.periodic_runs(docs))


@_query("op12_licenses")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_digest(licenses.scan_licenses(table(spark, sf_dir, "documents")))


def _field(value: str) -> str:
    return f"coalesce(strlen(CAST({value} AS VARCHAR)) || ':' || {value}, '-')"


def _leaf(text: str) -> str:
    return "sha256(" + " || ".join(map(_field, ("doc_id", "source", "lang", "n_chars", text))) + ")"


# crc32 bit by bit: a code point is xored in, then eight shifts (-1) follow
_CRC32 = """list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(
    string_split(CAST(doc_id AS VARCHAR), ''), lambda c:
    list_prepend(ascii(c)::BIGINT, list_transform(range(8), lambda i: -1::BIGINT))))), lambda c, s:
    CASE WHEN s >= 0 THEN xor(c, s) ELSE xor(c >> 1, 3988292384::BIGINT * (c & 1)) END)"""
_LOWERED = ("CASE WHEN xor(" + _CRC32 + ", 4294967295::BIGINT) % 3 = 0 THEN translate(text, "
            "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE text END")


def _tree(name: str, start: str) -> str:
    """Nodes of trees (tree, level, idx, h, n) from their leaves, then each with its siblings."""
    run = "OVER (PARTITION BY tree, level, idx // 8 ORDER BY idx ROWS BETWEEN"
    return f"""{name} AS ({start} UNION ALL
    SELECT tree, level + 1, idx // 8, sha256(string_agg(h, '' ORDER BY idx)), (n + 7) // 8
    FROM {name} WHERE n > 1 GROUP BY tree, level, idx // 8, n),
{name}_runs AS (SELECT *,
    coalesce(string_agg(h, '') {run} UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS before,
    coalesce(string_agg(h, '') {run} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS after FROM {name})"""


def _climb(name: str, nodes: str, start: str) -> str:
    """From (doc, tree, level, idx, h, proof) to the root: folded digests and siblings."""
    return f"""{name} AS ({start} UNION ALL
    SELECT c.doc, c.tree, c.level + 1, c.idx // 8, sha256(r.before || c.h || r.after),
        c.proof || r.before || r.after
    FROM {name} c JOIN {nodes}_runs r USING (tree, level, idx) WHERE r.n > 1)"""


_MANIFEST = f"""WITH RECURSIVE
leaves AS (SELECT doc_id, coalesce('=' || lang, '') AS tree, {_leaf('text')} AS leaf,
    {_leaf('lowered')} AS claimed FROM (SELECT *, {_LOWERED} AS lowered FROM documents)),
placed AS (SELECT *, row_number() OVER (ORDER BY tree, doc_id NULLS FIRST, leaf) AS doc,
    row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx,
    count(*) OVER (PARTITION BY tree) AS n FROM leaves),
{_tree('nodes', 'SELECT tree, 0 AS level, idx, leaf AS h, n FROM placed')},
roots AS (SELECT tree AS name, h, row_number() OVER (ORDER BY tree) - 1 AS idx,
    count(*) OVER () AS n FROM nodes WHERE n = 1),
{_tree('tops', "SELECT '' AS tree, 0 AS level, idx, h, n FROM roots")},
{_climb('inner_way', 'nodes', "SELECT doc, tree, 0 AS level, idx, claimed AS h, '' AS proof FROM placed")},
{_climb('whole_way', 'tops', "SELECT doc, '' AS tree, 0 AS level, r.idx, w.h, proof FROM inner_way w "
        "JOIN roots r ON r.name = w.tree JOIN nodes t ON t.tree = w.tree AND t.n = 1 AND t.level = w.level")}
SELECT p.doc_id, p.leaf, r.h AS subroot, t.h AS root, sha256(w.proof) AS proof_sha256,
    w.h AS folded_root, w.h = t.h AS verified
FROM placed p JOIN roots r ON r.name = p.tree JOIN tops t ON t.n = 1
JOIN whole_way w ON w.doc = p.doc AND w.level = t.level"""


@_query("op13_manifest", _MANIFEST)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    changed = {"text": merkle.lower_case_third()}
    return merkle.check_proofs(merkle.proofs(merkle.build_manifest(docs, claimed=changed)))
