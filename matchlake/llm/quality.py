"""Quality scores: ridge regression on random Fourier features, calibrated by isotonic regression.

A text becomes a vector of document statistics.  Random Fourier features of the standardised
vector approximate a Gaussian kernel; every partition sums its part of the normal equations, the
sums have a fixed size whatever the table's, and the driver solves them.  Labelled rows that were
held back from the fit calibrate the raw score: it is binned, pooled by adjacent violators and
interpolated.

Only rows of the training folds teach (see ``train``); the label, language, source and id of a
row are never part of its score.  Nulls and repeats: a null text counts as empty and is scored
like any other; a label that is null or has no document teaches nothing; several labels of one
document count as their mean; without labels of both kinds every score is their share (0.5 if
there is none).  Rows with a null id are scored and do not teach.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchlake.llm.common import id_remainder, stored, whole_text

N_FEATURES = 256
WIDTH = 4.0
RIDGE = 1e-2
SEED = 20_231
#: Raw scores are pooled in steps of 1 / BINS before calibration.
BINS = 2_000

_CLASSES = {
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "lower": b"abcdefghijklmnopqrstuvwxyz",
    "digit": b"0123456789", "stop": b".,;:", "call": b"!?", "bar": b"|/\\<>[]{}=_",
    "symbol": b"$%&#*@^~+", "quote": b"\"'()-", "blank": b" \t", "line": b"\n\r"}
_MEMBERS = np.zeros((256, len(_CLASSES) + 1))
for _k, _bytes in enumerate(_CLASSES.values()):
    _MEMBERS[list(_bytes), _k] = 1.0
_MEMBERS[128:, -1] = 1.0
STATISTICS = len(_CLASSES) + 1 + 9
_LINE = re.compile(r"[\n\r]+")


def statistics(text: str) -> np.ndarray:
    """Shares of character classes, and sizes and repetition of words and lines."""
    data = text.encode()
    n = max(1, len(data))
    shares = np.bincount(np.frombuffer(data, np.uint8), minlength=256) @ _MEMBERS / n
    words = text.split()
    distinct = set(words)
    lines = [x for x in _LINE.split(text) if x]
    n_words, n_lines = max(1, len(words)), max(1, len(lines))
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    rest = (np.log1p(len(words)), np.log1p(len(lines)), len(text) / n_words,
            lengths.std() if len(words) else 0.0, np.log1p(lengths.max()) if len(words) else 0.0,
            len(distinct) / n_words, len(distinct) / np.sqrt(n_words),
            len(set(lines)) / n_lines, np.log1p(len(text) / n_lines))
    return np.concatenate([np.sqrt(shares), rest])


@dataclass
class Model:
    """Everything that turns statistics into a score; its size is fixed."""
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray | None
    knots: tuple[np.ndarray, np.ndarray] | None
    share: float = 0.5

    def features(self, rows: np.ndarray) -> np.ndarray:
        draw = np.random.default_rng(SEED)
        w = draw.normal(size=(STATISTICS, N_FEATURES)) / WIDTH
        b = draw.uniform(0, 2 * np.pi, N_FEATURES)
        x = np.clip((rows - self.mean) / self.scale, -8, 8)
        z = np.sqrt(2 / N_FEATURES) * np.cos(x @ w + b)
        return np.hstack([z, np.ones((len(rows), 1))])

    def raw(self, rows: np.ndarray) -> np.ndarray:
        return np.clip(self.features(rows) @ self.weights, -0.5, 1.5)

    def score(self, rows: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.full(len(rows), self.share)
        raw = self.raw(rows)
        if self.knots is None:
            return np.clip(raw, 0, 1)
        # a thousandth of the raw score keeps the order inside a step of the calibration
        return 0.999 * np.interp(raw, *self.knots) + 0.001 * (raw + 0.5) / 2


def pool(x: np.ndarray, total: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Isotonic regression of ``total / count`` on ascending ``x``: centres and values of steps."""
    steps: list[list[float]] = []
    for at, y, n in zip(x, total, count):
        steps.append([at * n, y, n])
        while len(steps) > 1 and steps[-2][1] * steps[-1][2] >= steps[-1][1] * steps[-2][2]:
            last = steps.pop()
            steps[-1] = [a + b for a, b in zip(steps[-1], last)]
    return (np.array([s[0] / s[2] for s in steps]), np.array([s[1] / s[2] for s in steps]))


def document_statistics(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Key and statistics of every document."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [statistics(t) for t in batch.column("t").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("k"), pa.array(rows, pa.list_(pa.float64()))], names=["k", "x"])

    return docs.select(F.col(key).cast("long").alias("k"), whole_text(text).alias("t")) \
        .mapInArrow(run, "k long, x array<double>")


def fit(rows: DataFrame) -> Model:
    """``rows``: k, x, y (0 to 1).  A fifth of the rows calibrates, the others fit."""
    rows = stored(rows, "quality-rows")
    calibrates = F.pmod(F.xxhash64("k", F.lit("calibrate")), F.lit(5)) == 0
    fitted = rows.where(~calibrates)
    of = [F.col("x")[i] for i in range(STATISTICS)]
    sums = fitted.agg(F.count(F.lit(1)).alias("n"), F.avg("y").alias("y"),
                      *[F.avg(c).alias(f"m{i}") for i, c in enumerate(of)],
                      *[F.stddev_pop(c).alias(f"s{i}") for i, c in enumerate(of)]).first()
    mean = np.array([sums[f"m{i}"] or 0.0 for i in range(STATISTICS)])
    scale = np.array([sums[f"s{i}"] or 0.0 for i in range(STATISTICS)])
    model = Model(mean, np.where(scale > 1e-9, scale, 1.0), None, None,
                  0.5 if sums["y"] is None else float(sums["y"]))
    if not sums["n"] or sums["y"] in (0.0, 1.0):
        return model

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((N_FEATURES + 1, N_FEATURES + 2))
        for batch in batches:
            if batch.num_rows:
                z = model.features(np.array(batch.column("x").to_pylist()))
                y = batch.column("y").to_numpy(zero_copy_only=False)
                total += z.T @ np.column_stack([z, y])
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(len(total)), pa.int32()),
             pa.array(list(total), pa.list_(pa.float64()))], names=["i", "row"])

    def summed(key: tuple[pa.Scalar, ...], part: pa.Table) -> pa.Table:
        total = np.sum(part.column("row").to_pylist(), axis=0)
        return pa.table({"i": pa.array([key[0].as_py()], pa.int32()),
                         "row": pa.array([total], pa.list_(pa.float64()))})

    schema = "i int, row array<double>"
    # one row per equation, whatever the number of documents
    equations = fitted.mapInArrow(partial, schema).groupBy("i").applyInArrow(summed, schema)
    system = np.array([r["row"] for r in sorted(equations.collect(), key=lambda r: r["i"])])
    left, right = system[:, :-1], system[:, -1]
    ridge = RIDGE * np.eye(len(left))
    ridge[-1, -1] = 1e-9
    model.weights = np.linalg.solve(left + ridge, right)

    def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                raw = model.raw(np.array(batch.column("x").to_pylist()))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.rint(raw * BINS).astype(np.int32)), batch.column("y")],
                    names=["bin", "y"])

    bins = rows.where(calibrates).mapInArrow(binned, "bin int, y double").groupBy("bin") \
        .agg(F.sum("y").alias("y"), F.count(F.lit(1)).alias("n")).orderBy("bin").collect()
    if bins:  # 2 * BINS + 1 at most
        y, n = np.array([[b["y"], b["n"]] for b in bins], dtype=float).T
        model.knots = pool(np.array([b["bin"] / BINS for b in bins]),
                           y, n)
    return model


def train(docs: DataFrame, labels: DataFrame, learns: Column, label: str = "quality",
          key: str = "doc_id", text: str = "text",
          vectors: DataFrame | None = None) -> Model:
    """Fit on the labelled documents for which ``learns`` (a condition on ``k``) holds."""
    known = labels.select(F.col(key).cast("long").alias("k"), F.col(label).cast("double").alias("y")) \
        .where(F.col("k").isNotNull() & F.col("y").isNotNull()) \
        .where(learns).groupBy("k").agg(F.avg("y").alias("y"))
    vectors = document_statistics(docs, key, text) if vectors is None else vectors
    return fit(vectors.join(known, "k"))


def scorer(model: Model):
    """A column function from text to score."""
    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series(model.score(np.array([statistics(t or "") for t in texts]))
                         if len(texts) else [], dtype="float64")
    return score


def score_documents(docs: DataFrame, labels: DataFrame, divisor: int = 3,
                    held: int = 1) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    vectors = stored(document_statistics(docs), "statistics")
    fold = id_remainder("k", divisor)
    model = train(docs, labels, fold != held, vectors=vectors)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                scores = model.score(np.array(batch.column("x").to_pylist()))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("k"), pa.array(scores)], names=["k", "score"])

    return vectors.mapInArrow(run, "k long, score double").select(
        F.col("k").alias("doc_id"), F.coalesce(fold == held, F.lit(False)).alias("held_out"),
        "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, divisor: int = 3, held: int = 1) -> DataFrame:
    """``docs`` without the rows that the classifier rejects; columns stay as they are."""
    model = train(docs, labels, id_remainder("k", divisor) != held)
    return docs.where(scorer(model)(whole_text()) >= 0.5)
