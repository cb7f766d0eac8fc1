"""Packing of token sequences: first-fit decreasing in randomised groups of documents.

Documents are dealt into groups by a hash of their id and text; a group is packed by itself, so
groups run side by side and a group's size does not grow with the table, also where a third of the
rows has no id or the same one (only rows equal in both always meet).  In a group every document is
cut into full sequences and a remainder; remainders are placed by decreasing length into the
first bin with room, found in a tournament tree over the bins' free space.  Because documents may
be cut anywhere, the emptiest bins then fill the gaps of the others, and the one bin left over is
cut into sequences whose sizes are powers of two, which need no padding.

Nulls and repeats: a null or empty text has the end id alone; rows with a null or
repeated id are documents like any other; repeated rows are packed once each.
Columns other than id and text are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchlake.llm.common import whole_text
from matchlake.llm.word_tokens import encoder

CONTEXT = 4_096
#: Documents of a group on average.
GROUP_DOCS = 1_024

PIECES = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, "
          "sequence_id long, offset long")


class Tournament:
    """Bins of equal capacity; ``place`` finds the first one with room in logarithmic time."""

    def __init__(self, bins: int, capacity: int):
        self.size = 1 << max(0, bins - 1).bit_length()
        self.free = [capacity] * (2 * self.size)

    def place(self, need: int) -> int:
        free, node = self.free, 1
        while node < self.size:
            node *= 2
            if free[node] < need:
                node += 1
        bin_no = node - self.size
        free[node] -= need
        while node > 1:
            node //= 2
            free[node] = max(free[2 * node], free[2 * node + 1])
        return bin_no


Piece = tuple[int, int, int]  # document's place in the group, start, length


def first_fit_decreasing(lengths: list[int], capacity: int = CONTEXT) -> list[list[Piece]]:
    """Bins of whole pieces of at most ``capacity``."""
    bins = [[(d, at, capacity)] for d, n in enumerate(lengths)
            for at in range(0, n - n % capacity, capacity)]
    rest = sorted(((n % capacity, d) for d, n in enumerate(lengths) if n % capacity),
                  key=lambda x: (-x[0], x[1]))
    tree = Tournament(len(rest), capacity)
    open_bins: list[list[Piece]] = []
    for n, d in rest:
        k = tree.place(n)
        if k == len(open_bins):
            open_bins.append([])
        open_bins[k].append((d, lengths[d] - n, n))
    return bins + open_bins


def close_gaps(bins: list[list[Piece]], capacity: int = CONTEXT) -> list[list[Piece]]:
    """Fill the gaps of fuller bins from the emptiest ones; split the last by powers of two."""
    fill = [sum(p[2] for p in b) for b in bins]
    done = [b for b, f in zip(bins, fill) if f == capacity]
    loose = sorted((k for k in range(len(bins)) if fill[k] < capacity),
                   key=lambda k: (-fill[k], k))
    loose_bins, fills = [list(bins[k]) for k in loose], [fill[k] for k in loose]
    i, j = 0, len(loose_bins) - 1
    while i < j:
        room = capacity - fills[i]
        d, at, n = loose_bins[j].pop()
        take = min(room, n)
        loose_bins[i].append((d, at, take))
        if take < n:
            loose_bins[j].append((d, at + take, n - take))
        fills[i] += take
        fills[j] -= take
        if fills[i] == capacity:
            done.append(loose_bins[i])
            i += 1
        if not fills[j]:
            j -= 1
    if i == j and fills[i]:
        left, power = loose_bins[i][::-1], 1 << fills[i].bit_length() - 1
        total = fills[i]
        while total:
            while power > total:
                power //= 2
            out, room = [], power
            while room:
                d, at, n = left.pop()
                take = min(room, n)
                out.append((d, at, take))
                if take < n:
                    left.append((d, at + take, n - take))
                room -= take
            done.append(out)
            total -= power
    return done


def padded(fill: int, capacity: int = CONTEXT) -> int:
    """Tokens that a sequence takes: its own number if that is a power of two."""
    return fill if fill & (fill - 1) == 0 else capacity


def pack(docs: DataFrame, tokenizer: str, end_id: int = 2, capacity: int = CONTEXT,
         group_docs: int = GROUP_DOCS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per piece of a document: where its ids lie, their crc32, and its sequence."""
    groups = max(1, math.ceil(docs.count() / group_docs))
    group = F.pmod(F.xxhash64(F.col(key).cast("long"), whole_text(text), F.lit("packing")), F.lit(groups))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run, end = encoder(tokenizer), np.array([end_id], dtype="<u4").tobytes()
        for batch in batches:
            for at in range(0, batch.num_rows, 1_024):
                part = batch.slice(at, 1_024)
                ids = [x + end for x in run(part.column("t").to_pylist())]
                small = [np.frombuffer(x, "<u4") for x in ids]
                small = [x.astype("<u2").tobytes() if x.max() < 65_536 else x.tobytes()
                         for x in small]
                yield pa.RecordBatch.from_arrays(
                    [part.column("k"), part.column("g"),
                     pa.array([len(x) // 4 for x in ids], pa.int64()),
                     pa.array(small, pa.binary())], names=["k", "g", "n", "ids"])

    def packed(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("k", "ascending"), ("n", "ascending")])
        keys, lengths = rows.column("k").to_pylist(), rows.column("n").to_pylist()
        ids = [np.frombuffer(x, "<u2" if len(x) == 2 * n else "<u4").astype("<u4")
               for x, n in zip(rows.column("ids").to_pylist(), lengths)]
        base = rows.column("g")[0].as_py() << 32
        out: dict[str, list] = {name: [] for name in (
            "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")}
        bins = close_gaps(first_fit_decreasing(lengths, capacity), capacity)
        for number, pieces in enumerate(bins):
            offset = 0
            for d, at, n in pieces:
                values = (keys[d], at, n, zlib.crc32(ids[d][at:at + n].tobytes()), lengths[d],
                          base + number, offset)
                for column, value in zip(out.values(), values):
                    column.append(value)
                offset += n
        return pa.table({name: pa.array(v, pa.int64()) for name, v in out.items()})

    return docs.select(F.col(key).cast("long").alias("k"), group.alias("g"),
                       whole_text(text).alias("t")) \
        .mapInArrow(encode, "k long, g long, n long, ids binary") \
        .groupBy("g").applyInArrow(packed, PIECES)
