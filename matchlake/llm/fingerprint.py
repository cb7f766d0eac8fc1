"""Document fingerprints: digests of improbable features.

Every 16-byte window of a text has an entropy, computed for all windows at once from running
counts.  Over all documents, a histogram of entropies tells how rare each value is; a window's
rank is the rarity of its entropy, rarest first.  In every run of 16 neighbouring windows the one
of lowest rank gets a vote, and windows with enough votes are the text's features.  Features go,
in text order, into a chain of Bloom filters, each with a fixed number of features.  Two chains are
compared filter by filter: the overlap of bits beyond chance, as a share of the most there could be,
averaged over the filters of the shorter chain.

Edge cases: a text of fewer than four windows' bytes has too few to choose from, and all its
5-byte windows are features; an empty or null text has an empty chain.  Two empty chains have likeness 1, an empty and another 0.  Equal texts have equal
fingerprints.
"""

from __future__ import annotations

import base64
import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchlake.llm.common import stored, whole_text

WINDOW = 16
NEIGHBOURS = 16
VOTES = 4
SHORT_TEXT, SHORT_WINDOW = 4 * WINDOW, 5
#: Entropy is kept in thousandths of the largest one.
LEVELS = 1_001
FILTER_BITS = 2_048
FILTER_FEATURES = 128
HASHES = 5
#: Text of a task that walks documents in order; a task holds two documents, whatever its share.
TASK_BYTES = 32 << 20
MOST_TASKS = 20_000
#: Ranges of ids for each of these tasks.
RANGES = 4

_SCALE = 1 << 20
_COUNTS = np.arange(WINDOW + 1)
_TERM = np.rint(_SCALE * np.where(_COUNTS > 0, _COUNTS * np.log2(np.maximum(_COUNTS, 1)), 0)
                ).astype(np.int64)
_STEP = np.diff(_TERM)  # what the n-th equal byte adds


def entropy_levels(data: np.ndarray) -> np.ndarray:
    """Entropy of every full window, in 0 .. LEVELS - 1.

    ``ahead[i]`` counts the bytes equal to ``data[i]`` in the rest of the window that starts at
    i, ``behind[i]`` in the window that ends at i; sliding on removes one and adds the other.
    """
    n = len(data)
    ahead, behind = np.zeros(n, np.uint8), np.zeros(n, np.uint8)
    for d in range(1, WINDOW):
        same = data[:-d] == data[d:]
        ahead[:-d] += same
        behind[d:] += same
    first = _TERM[np.bincount(data[:WINDOW], minlength=256)].sum()
    change = _STEP[behind[WINDOW:]] - _STEP[ahead[:n - WINDOW]]
    total = first + np.concatenate([[0], np.cumsum(change)])
    bits = math.log2(WINDOW) - total / (WINDOW * _SCALE)
    return np.rint(bits * ((LEVELS - 1) / math.log2(WINDOW))).astype(np.int32)


def select(ranks: np.ndarray) -> np.ndarray:
    """Positions whose rank is the lowest (leftmost) of at least VOTES runs of NEIGHBOURS."""
    best = ranks.astype(np.int64) << 32 | np.arange(len(ranks))
    width, target = 1, min(NEIGHBOURS, len(ranks))
    while width < target:
        step = min(width, target - width)
        best = np.minimum(best[:-step], best[step:])
        width += step
    starts = np.flatnonzero(np.concatenate([[True], best[1:] != best[:-1]]))
    votes = np.diff(np.append(starts, len(best)))
    chosen = best[starts][votes >= min(VOTES, len(best))] & 0xFFFFFFFF
    return chosen if len(chosen) else best[:1] & 0xFFFFFFFF


def hashes_of(windows: np.ndarray) -> np.ndarray:
    """A 64-bit hash of every row of WINDOW bytes."""
    parts = np.ascontiguousarray(windows).view("<u8")
    out = np.full(len(parts), 0x9E3779B97F4A7C15, dtype=np.uint64)
    for column in parts.T:
        out = (out ^ column) * np.uint64(0xFF51AFD7ED558CCD)
        out ^= out >> np.uint64(32)
        out = out * np.uint64(0xC4CEB9FE1A85EC53)
        out ^= out >> np.uint64(29)
    return out


def features(data: bytes, rarity: np.ndarray, levels: np.ndarray | None = None) -> np.ndarray:
    """Hashes of the selected windows in text order."""
    raw = np.frombuffer(data, np.uint8)
    if not len(raw):
        return np.empty(0, np.uint64)
    if len(raw) < SHORT_TEXT:
        width = min(SHORT_WINDOW, len(raw))
        windows = np.lib.stride_tricks.sliding_window_view(raw, width)
        padded = np.zeros((len(windows), WINDOW), np.uint8)
        padded[:, :width] = windows
        return hashes_of(padded) ^ np.uint64(width)
    levels = entropy_levels(raw) if levels is None else levels
    at = select(rarity[levels])
    return hashes_of(np.lib.stride_tricks.sliding_window_view(raw, WINDOW)[at])


def chain(found: np.ndarray) -> np.ndarray:
    """Bloom filters, one row of bits for each FILTER_FEATURES features."""
    if not len(found):
        return np.zeros((0, FILTER_BITS), bool)
    filters = np.zeros((-(-len(found) // FILTER_FEATURES), FILTER_BITS), bool)
    row = np.arange(len(found)) // FILTER_FEATURES
    for k in range(HASHES):  # eleven bits of the hash for each
        filters[row, (found >> np.uint64(11 * k)) & np.uint64(FILTER_BITS - 1)] = True
    return filters


def text_of(filters: np.ndarray) -> str:
    return base64.b64encode(np.packbits(filters, axis=1).tobytes()).decode()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Overlap of bits beyond chance, 0 to 1; the mean over the filters of the shorter chain."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    if len(a) > len(b):
        a, b = b, a
    x, y = a.astype(np.float32), b.astype(np.float32)
    common = x @ y.T
    na, nb = x.sum(axis=1)[:, None], y.sum(axis=1)[None, :]
    chance = na * nb / FILTER_BITS
    most = np.minimum(na, nb)
    score = np.clip((common - chance) / np.maximum(most - chance, 1e-6), 0, 1)
    # a nearly empty filter must not match a full one by its few bits
    score *= np.sqrt(most / np.maximum(na, nb))
    weights = na[:, 0] / na.sum()
    return float(min(1.0, weights @ score.max(axis=1)))


# --- Spark ---------------------------------------------------------------------

def rarity_of(docs: DataFrame, text: str = "text") -> tuple[np.ndarray, int]:
    """Rank of every entropy level over all windows of all documents, 0 is the rarest; windows."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(LEVELS, np.int64)
        for batch in batches:
            for t in batch.column("t").to_pylist():
                raw = np.frombuffer(t.encode(), np.uint8)
                if len(raw) >= WINDOW:
                    total += np.bincount(entropy_levels(raw), minlength=LEVELS)
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(LEVELS), pa.int32()), pa.array(total)], names=["level", "n"])

    rows = docs.select(whole_text(text).alias("t")).mapInArrow(count, "level int, n long") \
        .groupBy("level").agg(F.sum("n").alias("n")).collect()  # LEVELS rows
    counts = np.zeros(LEVELS, np.int64)
    for r in rows:
        counts[r["level"]] = r["n"]
    order = np.argsort(counts, kind="stable")
    ranks = np.empty(LEVELS, np.int32)
    ranks[order] = np.arange(LEVELS)
    return ranks, int(counts.sum())


def with_next(docs: DataFrame, tasks: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Ranges of documents in descending order of their id, each with its follower's row.

    Returns k, t, range, follower: rows of one ``range`` are in one partition, sorted by id
    downwards.  A row with ``follower`` is a copy of the next range's first row.  The ranges'
    ends come from a pass over the ids alone, so the texts cross the shuffle once.  Rows without
    an id are spread over negative ranges by their text; rows of one id are ordered by text.
    """
    rows = docs.select(F.col(key).cast("long").alias("k"), whole_text(text).alias("t"))
    alone = F.array((-1 - F.pmod(F.xxhash64("t"), F.lit(tasks))).cast("int"))
    ids = rows.where("k IS NOT NULL").select("k").repartitionByRange(tasks * RANGES, "k") \
        .groupBy(F.spark_partition_id()).agg(F.max("k").alias("top"))
    tops = np.array(sorted(r["top"] for r in ids.collect()), dtype=np.int64)  # one a partition

    @F.pandas_udf("array<int>")
    def targets(keys: pd.Series) -> pd.Series:
        if not len(tops):
            return pd.Series([[0]] * len(keys))
        at = np.searchsorted(tops, keys.to_numpy())
        first = tops[np.minimum(at, len(tops) - 1)] == keys.to_numpy()
        # the first row of a range also follows the range above it; the very first, the lowest
        return pd.Series([[int(i), (int(i) + 1) % len(tops)] if f else [int(i)]
                          for i, f in zip(at, first)])

    ranges = F.when(F.col("k").isNull(), alone).otherwise(targets(F.coalesce("k", F.lit(0))))
    dealt = rows.select("k", "t", F.posexplode(ranges).alias("p", "range"))
    return dealt.select("k", "t", "range", (F.col("p") == 1).alias("follower")) \
        .repartitionById(tasks, F.pmod("range", F.lit(tasks)).cast("int")) \
        .sortWithinPartitions("range", "follower", F.col("k").desc(), "t")


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document its fingerprint, that of its edited text, and two likenesses.

    The edited text ends with the start of the next document in descending order of ids; rows of
    one id follow each other in order of their texts.  A row without an id has no place in that
    order: it is followed by itself.
    """
    rarity, windows = rarity_of(docs, text)
    # as many tasks as the text needs and the cores can use; ids alone would be dealt to few
    tasks = min(MOST_TASKS, max(docs.sparkSession.sparkContext.defaultParallelism,
                                math.ceil(windows / TASK_BYTES)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        held = first = None  # the row that waits for its next one; the range's first row

        def digest(t: str):
            data = t.encode()
            raw = np.frombuffer(data, np.uint8)
            levels = entropy_levels(raw) if len(raw) >= WINDOW else None
            return chain(features(data, rarity, levels)), levels

        def emit(row, after):
            _, k, t, filters, levels = row
            n = len(t)
            cut = n // 3
            kept = t[:n - cut]
            edited = kept + after[2][:cut]
            data = edited.encode()
            raw = np.frombuffer(data, np.uint8)
            fresh = max(0, len(kept.encode()) - WINDOW + 1)  # windows that are as they were
            if levels is not None and len(raw) >= WINDOW and fresh:
                tail = entropy_levels(raw[fresh:]) if len(raw) - fresh >= WINDOW else levels[:0]
                levels = np.concatenate([levels[:fresh], tail])
            else:
                levels = None
            other = chain(features(data, rarity, levels))
            out.append((k, n, hashlib.sha256(data).hexdigest(), text_of(filters),
                        text_of(other), likeness(filters, other), likeness(filters, after[3])))

        def batch_of() -> pa.RecordBatch:
            columns = list(zip(*out)) or [[] for _ in range(7)]
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(),
                     pa.float64(), pa.float64())
            out.clear()
            return pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, kinds)],
                names=[key, "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
                       "near_edited", "near_next"])

        for batch in batches:
            for k, t, place, follower in zip(*(c.to_pylist() for c in batch.columns)):
                filters, levels = digest(t)
                row = (place, k, t, filters, levels)
                if k is None:
                    emit(row, row)
                    continue
                if held is not None and held[0] == place:
                    emit(held, row)
                held = None if follower else row
                if len(out) >= 512:
                    yield batch_of()
        if held is not None:  # only without any follower: no document at all comes next
            emit(held, held)
        if out:
            yield batch_of()

    return with_next(docs, tasks, key, text).mapInArrow(
        run, f"{key} long, n_chars long, edited_sha256 string, fingerprint string, "
             "edited_fingerprint string, near_edited double, near_next double")
