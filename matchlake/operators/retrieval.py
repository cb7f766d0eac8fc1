"""Retrieval: exact and approximate top-k postings by cosine similarity.

Query vectors are few and travel to the tasks in blocks of bounded size.  The exact
search multiplies each Arrow batch of posting vectors with a block and keeps only the
k best per query and task, so what leaves a task does not grow with the table.  The
approximate search looks into leaves of a forest of random-projection trees.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchlake import vocab as V
from matchlake.functions.text import search_form
from matchlake.functions.vectors import EPSILON, cosine_similarity, l2_normalize
from matchlake.operators.forest import Forest, forest_candidates
from matchlake.operators.order import rank_all, top_k

QUERIES_PER_PASS = 256
# similarities are rounded so that equal vectors tie exactly and row order decides
SIMILARITY_DIGITS = 9


def _blocks(queries: DataFrame, per_pass: int) -> Iterator[DataFrame]:
    """Query rows in blocks of at most ``per_pass``."""
    if len(queries.select("profile_id").take(per_pass + 1)) <= per_pass:
        yield queries
        return
    numbered = rank_all(queries, [], [F.col("profile_id")], "_no")
    for b in range((queries.count() + per_pass - 1) // per_pass):
        yield numbered.where(F.floor((F.col("_no") - 1) / per_pass) == b).drop("_no")


def _per_task_best(ids: list[str], matrix: np.ndarray, k: int) -> Callable:
    lengths = np.linalg.norm(matrix, axis=1) if ids else None

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        if not ids:
            return
        best_rows = np.empty((len(ids), 0), dtype=np.int64)
        best_sims = np.empty((len(ids), 0))
        for batch in batches:
            if batch.empty:
                continue
            x = np.stack(batch["embedding"].to_numpy()).astype(np.float64)
            scale = np.maximum(np.outer(lengths, np.linalg.norm(x, axis=1)), EPSILON)
            sims = np.round(matrix @ x.T / scale, SIMILARITY_DIGITS)
            rows = np.broadcast_to(batch["row_index"].to_numpy(np.int64), sims.shape)
            rows = np.concatenate([best_rows, rows], axis=1)
            sims = np.concatenate([best_sims, sims], axis=1)
            order = np.lexsort((rows, -sims), axis=1)[:, :k]
            best_rows = np.take_along_axis(rows, order, axis=1)
            best_sims = np.take_along_axis(sims, order, axis=1)
        for i, query in enumerate(ids):
            yield pd.DataFrame({"profile_id": query, "row_index": best_rows[i],
                                "embedding_similarity": best_sims[i]})
    return search


def _best_first() -> list[Column]:
    return [F.desc("embedding_similarity"), F.asc("row_index")]


def topk_exact(vectors: DataFrame, queries: DataFrame, k: int = V.RETRIEVAL_TOP_K,
               per_pass: int = QUERIES_PER_PASS) -> DataFrame:
    """Exact top-k per query: (profile_id, row_index, embedding_similarity, rank).

    ``vectors`` has (row_index, embedding), ``queries`` (profile_id, embedding).
    """
    out = None
    for block in _blocks(queries, per_pass):
        rows = block.select(F.col("profile_id").cast("string"), "embedding").collect()
        search = _per_task_best([r[0] for r in rows],
                                np.array([r[1] for r in rows], dtype=np.float64), k)
        part = vectors.select("row_index", "embedding").mapInPandas(
            search, "profile_id string, row_index bigint, embedding_similarity double")
        out = part if out is None else out.unionByName(part)
    return top_k(out, ["profile_id"], _best_first(), k)


def topk_bruteforce(vectors: DataFrame, query: list[float],
                    k: int = V.RETRIEVAL_TOP_K) -> DataFrame:
    """Exact top-k of one query vector, best first."""
    one = vectors.sparkSession.createDataFrame([("query", query)],
                                               "profile_id string, embedding array<float>")
    return topk_exact(vectors, one, k).drop("profile_id")


# --- approximate search --------------------------------------------------------------------

def topk_ann(vectors: DataFrame, index: DataFrame, forest: Forest, queries: DataFrame,
             k: int = V.RETRIEVAL_TOP_K, probes: int | None = None) -> DataFrame:
    """Approximate top-k per query: rows of the nearest leaves, rescored by exact cosine.

    ``index`` is the written ``forest_index`` of ``vectors``.
    """
    named = queries.select(F.col("profile_id").cast("string"), F.col("embedding").alias("_query"))
    sims = forest_candidates(index, forest, queries, k, probes) \
        .join(vectors.select("row_index", "embedding"), "row_index").join(named, "profile_id") \
        .select("profile_id", "row_index", F.round(
            cosine_similarity(F.col("embedding"), F.col("_query")),
            SIMILARITY_DIGITS).alias("embedding_similarity"))
    return top_k(sims, ["profile_id"], _best_first(), k)


def ann_recall(vectors: DataFrame, index: DataFrame, forest: Forest, queries: DataFrame,
               ks: Sequence[int], probes: int | None = None) -> DataFrame:
    """(k, queries, recall, share): mean recall against the exact search.

    A row counts as found if it is at least as similar as the k-th best; ``share`` is the part
    of the table that was looked at.
    """
    out = None
    rows = vectors.count()
    for k in ks:
        exact = topk_exact(vectors, queries, k)
        worst = exact.groupBy("profile_id").agg(F.min("embedding_similarity").alias("_least"),
                                                F.count(F.lit(1)).alias("_n"))
        near = topk_ann(vectors, index, forest, queries, k, probes)
        found = near.join(worst, "profile_id").where("embedding_similarity >= _least") \
            .groupBy("profile_id").agg(F.count(F.lit(1)).alias("_found"))
        looked = forest_candidates(index, forest, queries, k, probes).groupBy("profile_id") \
            .agg(F.count(F.lit(1)).alias("_looked"))
        part = worst.join(found, "profile_id", "left").join(looked, "profile_id", "left").agg(
            F.lit(k).alias("k"), F.count(F.lit(1)).alias("queries"),
            F.avg(F.coalesce(F.col("_found"), F.lit(0)) / F.col("_n")).alias("recall"),
            (F.sum("_looked") / F.lit(max(rows, 1)) / F.count(F.lit(1))).alias("share"))
        out = part if out is None else out.unionByName(part)
    return out


def topk_fallback(vectors: DataFrame, queries: DataFrame, k: int = V.RETRIEVAL_TOP_K,
                  index: DataFrame | None = None, forest: Forest | None = None) -> DataFrame:
    """Approximate search where an index gives k postings, exact search elsewhere.

    Adds ``retrieval_method`` (ann or bruteforce).
    """
    if index is None or forest is None:
        return topk_exact(vectors, queries, k).withColumn("retrieval_method",
                                                          F.lit("bruteforce"))
    approximate = topk_ann(vectors, index, forest, queries, k)
    full = approximate.groupBy("profile_id").agg(F.count(F.lit(1)).alias("_n")) \
        .where(F.col("_n") >= F.lit(k)).select("profile_id")
    named = queries.withColumn("profile_id", F.col("profile_id").cast("string"))
    exact = topk_exact(vectors, named.join(full, "profile_id", "left_anti"), k)
    return approximate.join(full, "profile_id", "left_semi") \
        .withColumn("retrieval_method", F.lit("ann")).unionByName(
            exact.withColumn("retrieval_method", F.lit("bruteforce")))


# --- embedding -----------------------------------------------------------------------------------

def embed_text(df: DataFrame, text: str = "embedding_text", dimension: int = 256,
               predict=None, batch_size: int = 128) -> DataFrame:
    """Add a unit ``embedding`` of a text column.

    ``predict`` is a factory of a function from an array of texts to a matrix, run in
    batches on the executors.  Without one, hashed word counts are used.
    """
    if predict is not None:
        from pyspark.ml.functions import predict_batch_udf
        model = predict_batch_udf(predict, return_type="array<float>", batch_size=batch_size)
        raw = df.withColumn("embedding", model(F.col(text)))
    else:
        words = df.withColumn("_words", F.filter(F.split(search_form(F.col(text)), " "),
                                                 lambda w: w != ""))
        counted = HashingTF(inputCol="_words", outputCol="_tf", numFeatures=dimension) \
            .transform(words)
        raw = counted.withColumn("embedding", vector_to_array("_tf", "float32")) \
            .drop("_words", "_tf")
    return raw.withColumn("embedding", l2_normalize(F.col("embedding")))
