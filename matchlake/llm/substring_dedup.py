"""Removal of repeated passages, found through fixed-block anchors.

A window of ``WINDOW`` words that repeats another one contains a whole block of ``BLOCK`` words
that starts at a multiple of ``BLOCK`` in the other's document, for 2 * BLOCK - 1 <= WINDOW.  So:

1. Documents are put into chunks of some megabytes, each one row of a table on shared files.
2. Anchors: a chunk sends the fingerprint of every rolling block, once however often it occurs,
   marked if one occurrence is a non-overlapping reference block.  Owner tasks, each with a range
   of fingerprints, answer with a bitmap which of them occur elsewhere and have a reference block.
3. Extension: windows around the hits are the maximal exact repeats' candidates.  A chunk sends
   the 128-bit hash of each distinct one with its earliest document; owner tasks answer with a
   bitmap which of them come first of all.
4. A chunk marks the words of all candidate windows that are not the first of their kind.

A passage that a third of all documents share is sent once by each chunk, so no owner gets more
than one entry of it from each.  Chunks recompute hashes instead of storing them; answers are one
bit for each entry sent.  All steps are repeatable, so a lost task is simply run again.

Words are runs of other characters than blank, tab and line ends.  A null or empty text has no
words.  A null id counts as the smallest; of rows that repeat an id one counts as the earlier.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from matchlake.llm.common import batches_of, stored, whole_text
from matchlake.llm.word_hashes import BASE, OTHER_BASE, rolling, word_hashes

WINDOW, BLOCK = 20, 10
CHUNK_BYTES = 8 << 20
#: Texts that Spark gives Python at a time, beside the chunk that is being filled.
TEXTS_AT_A_TIME = 512
#: Entries of an owner task on average, and the fewest owners.
OWNER_ENTRIES = 1 << 20
OWNERS = 64

_NO_ID = -(1 << 63)
CHUNKS = "chunk long, n_words long, doc_ids array<long>, sizes array<long>, texts binary, "\
         "others binary"
SENT = "owner int, chunk long, n long, entries binary"
_squeeze, _expand = zstandard.compress, zstandard.decompress


# --- packing of integers ------------------------------------------------------

def _pack(values: np.ndarray) -> bytes:
    """Byte planes of an integer array, compressed."""
    raw = np.ascontiguousarray(values).view(np.uint8).reshape(-1, values.itemsize)
    return _squeeze(np.ascontiguousarray(raw.T).tobytes(), 1)


def _unpack(data: bytes, kind: str) -> np.ndarray:
    size = np.dtype(kind).itemsize
    planes = np.frombuffer(_expand(data), np.uint8).reshape(size, -1)
    return np.ascontiguousarray(planes.T).view(kind).ravel()


def _joined(*parts: bytes) -> bytes:
    sizes = np.array([len(p) for p in parts], "<u4").tobytes()
    return bytes([len(parts)]) + sizes + b"".join(parts)


def _parts(data: bytes) -> list[bytes]:
    sizes = np.frombuffer(data, "<u4", data[0], 1)
    ends = np.cumsum(sizes) + 1 + 4 * data[0]
    return [data[e - s:e] for s, e in zip(sizes, ends)]


def _frozen(values: pa.Array) -> bytes:
    """An array of any type as compressed bytes."""
    batch = pa.RecordBatch.from_arrays([values], names=["c"])
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as out:
        out.write_batch(batch)
    return _squeeze(sink.getvalue().to_pybytes(), 3)


def _thawed(data: bytes) -> pa.Array:
    return pa.ipc.open_stream(_expand(data)).read_next_batch().column(0)


# --- hashes of a chunk --------------------------------------------------------

class Chunk:
    """The documents of one row, and what every step computes from them anew.

    Places are 4 bytes (a chunk has far fewer than 2 ** 31 words) and arrays go as soon as they
    are used, because a task's memory is that of its largest chunk.
    """

    def __init__(self, row: dict):
        self.ids, self.sizes = row["doc_ids"], row["sizes"]
        self.data = _expand(row["texts"])
        self.counts = np.empty(len(self.sizes), np.int64)
        self.hashes = np.empty(row["n_words"], np.uint64)
        done = 0
        for k, text in enumerate(self.texts()):
            words = text.split()
            self.hashes[done:done + len(words)] = word_hashes(words)
            self.counts[k] = len(words)
            done += len(words)
        self.starts = np.cumsum(self.counts) - self.counts
        self.left = np.repeat((self.starts + self.counts).astype(np.int32), self.counts)
        self.left -= np.arange(len(self.hashes), dtype=np.int32)

    def texts(self) -> Iterator[bytes]:
        done = 0
        for size in self.sizes:
            yield self.data[done:done + size]
            done += size

    def _document(self, at: np.ndarray) -> np.ndarray:
        """Documents of positions; one without words shares its start with the next."""
        return np.searchsorted(self.starts, at, side="right") - 1

    def blocks(self) -> None:
        """Distinct rolling blocks in order of their hash, and where each position's is."""
        n = max(0, len(self.hashes) - BLOCK + 1)
        at = np.flatnonzero(self.left[:n] >= BLOCK).astype(np.int32)
        h = rolling(self.hashes, BLOCK, BASE)[at]
        order = np.argsort(h, kind="stable").astype(np.int32)
        h = h[order]
        at = at[order]
        del order
        first = _heads(h)
        starts = np.flatnonzero(first).astype(np.int32)
        self.block_hash = h[starts]
        del h
        reference = (at - self.starts[self._document(at)].astype(np.int32)) % BLOCK == 0
        self.is_reference = np.logical_or.reduceat(reference, starts) if len(at) else first
        self.repeats_here = np.diff(starts, append=np.int32(len(at))) > 1
        self.block_at = at
        self.block_of = np.cumsum(first, dtype=np.int32) - np.int32(1)

    def windows(self, hits: np.ndarray) -> None:
        """Distinct windows around the hits (a flag for each distinct block)."""
        sums = np.zeros(len(self.hashes) + 2, np.int32)
        sums[self.block_at + 1] = (hits | (self.repeats_here & self.is_reference))[self.block_of]
        del self.block_at, self.block_of, self.block_hash, self.is_reference, self.repeats_here
        np.cumsum(sums, out=sums)
        n = max(0, len(self.hashes) - WINDOW + 1)
        reach = WINDOW - BLOCK + 1
        near = sums[reach:reach + n] > sums[:n]
        at = np.flatnonzero((self.left[:n] >= WINDOW) & near).astype(np.int32)
        del sums, near
        h = rolling(self.hashes, WINDOW, BASE)[at]
        order = np.argsort(h, kind="stable").astype(np.int32)
        h = h[order]  # equal hashes stay in order of id and position
        self.window_at = at[order]
        self.window_first = _heads(h)
        self.window_hash = h[self.window_first]

    def window_entries(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Both hashes and the id of the earliest document of every distinct window."""
        at = self.window_at[self.window_first]
        ids = np.array(self.ids, np.int64)[self._document(at)]
        return self.window_hash, rolling(self.hashes, WINDOW, OTHER_BASE)[at], ids

    def removed(self, is_first: np.ndarray) -> np.ndarray:
        """For each word whether a window that is not the first of its kind covers it."""
        repeated = ~self.window_first
        repeated[self.window_first] = ~is_first
        edges = np.zeros(len(self.hashes) + 1, np.int32)
        at = self.window_at[repeated]
        edges[at] += 1  # a position has one window
        edges[at + WINDOW] -= 1
        return np.cumsum(edges[:-1], dtype=np.int32) > 0


def _heads(values: np.ndarray) -> np.ndarray:
    """Where a sorted array has another value than before."""
    return np.concatenate([[True], values[1:] != values[:-1]]) if len(values) else \
        np.empty(0, bool)


def _one_by_one(batch: pa.RecordBatch) -> Iterator[dict]:
    """Rows of a batch as dictionaries, only one of them at a time."""
    return (batch.slice(i, 1).to_pylist()[0] for i in range(batch.num_rows))


def _owner_bounds(hashes: np.ndarray, owners: int) -> np.ndarray:
    """Where each owner's range starts in sorted hashes: equal ranges of the first 32 bits."""
    tops = (np.arange(owners + 1, dtype=np.uint64) << np.uint64(32)) // np.uint64(owners)
    return np.searchsorted(hashes >> np.uint64(32), tops)


def _answers(row: dict, name: str, owners: int, bounds: np.ndarray) -> np.ndarray:
    """The bits that the owners sent back, in order of the hashes."""
    found = {a["owner"]: a["bits"] for a in row[name] or ()}
    out = [np.unpackbits(np.frombuffer(found[o], np.uint8), count=int(b - a)).astype(bool)
           for o, (a, b) in enumerate(zip(bounds[:-1], bounds[1:])) if b > a]
    return np.concatenate(out) if out else np.empty(0, bool)


# --- Spark --------------------------------------------------------------------

def chunks_of(docs: DataFrame, key: str = "doc_id", text: str = "text",
              carried: str | None = None) -> DataFrame:
    """Chunks of whole documents, sorted by id inside; written to shared files.

    The column ``carried`` of ``docs``, if given, is kept beside the texts in the same order.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        held: list[tuple[int, bytes]] = []
        others: list[pa.Array] = []
        size = number = 0

        def flush() -> pa.RecordBatch:
            nonlocal held, others, size, number
            order = sorted(range(len(held)), key=lambda i: held[i][0])
            held = [held[i] for i in order]
            row = {"chunk": part << 32 | number, "n_words": sum(len(t.split()) for _, t in held),
                   "doc_ids": [k for k, _ in held], "sizes": [len(t) for _, t in held],
                   "texts": _squeeze(b"".join(t for _, t in held), 3),
                   "others": _frozen(pa.concat_arrays(others).take(pa.array(order)))
                   if others else None}
            held, others, size, number = [], [], 0, number + 1
            return pa.RecordBatch.from_pylist([row], pa.schema([
                ("chunk", pa.int64()), ("n_words", pa.int64()), ("doc_ids", pa.list_(pa.int64())),
                ("sizes", pa.list_(pa.int64())), ("texts", pa.binary()), ("others", pa.binary())]))

        for batch in batches:
            other = batch.column(2) if carried else None
            more = other.nbytes // max(1, len(other)) if carried else 0
            begin = 0
            for i, (k, t) in enumerate(zip(*(c.to_pylist() for c in batch.columns[:2]))):
                data = t.encode()
                held.append((_NO_ID if k is None else k, data))
                size += len(data) + 64 + more
                if size >= CHUNK_BYTES:
                    if carried:
                        others.append(other[begin:i + 1])
                        begin = i + 1
                    yield flush()
            if carried and begin < len(other):
                others.append(other[begin:])
        if held:
            yield flush()

    columns = [F.col(key).cast("long").alias("k"), whole_text(text).alias("t")]
    if carried:
        columns.append(F.col(carried).alias("c"))
    with batches_of(docs.sparkSession, TEXTS_AT_A_TIME):
        return stored(docs.select(columns).mapInArrow(run, CHUNKS), "chunks")


def _sent(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [[], [], [], []]
    return pa.RecordBatch.from_arrays(
        [pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int64(), pa.int64(), pa.binary()))],
        names=["owner", "chunk", "n", "entries"])


def _by_chunk(bits: DataFrame, name: str) -> DataFrame:
    """All owners' answers to a chunk in one row: a bit for each entry the chunk sent."""
    return bits.groupBy("chunk").agg(F.collect_list(F.struct("owner", "bits")).alias(name))


def _answer(sent: DataFrame, judge) -> DataFrame:
    """``judge`` maps an owner's entries (a list per chunk) to one flag per entry."""
    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("chunk")
        lengths = rows.column("n").to_pylist()
        flags = judge(rows.column("entries").to_pylist())
        ends = np.cumsum(lengths)
        return pa.table({
            "owner": rows.column("owner"), "chunk": rows.column("chunk"),
            "bits": pa.array([np.packbits(flags[e - n:e]).tobytes()
                              for n, e in zip(lengths, ends)], pa.binary())})

    return sent.groupBy("owner").applyInArrow(run, "owner int, chunk long, bits binary")


def _judge_blocks(entries: list[bytes]) -> np.ndarray:
    """Blocks that several chunks have, one of them as a reference block."""
    values, marks = [], []
    for data in entries:
        deltas, bits = _parts(data)
        v = np.cumsum(_unpack(deltas, "<u4").astype(np.uint64))
        values.append(v)
        marks.append(np.unpackbits(np.frombuffer(bits, np.uint8), count=len(v)).astype(bool))
    value, mark = np.concatenate(values), np.concatenate(marks)
    order = np.argsort(value, kind="stable")
    starts = np.flatnonzero(np.concatenate([[True], np.diff(value[order]) != 0]))
    sizes = np.diff(np.append(starts, len(value)))
    good = (sizes > 1) & np.logical_or.reduceat(mark[order], starts)
    flags = np.empty(len(value), bool)
    flags[order] = np.repeat(good, sizes)
    return flags


def _judge_windows(entries: list[bytes]) -> np.ndarray:
    """Windows whose entry has the smallest id of all with the same two hashes."""
    a, b, ids = (np.concatenate(x) for x in zip(*(
        (np.cumsum(_unpack(p, "<u8")), _unpack(q, "<u8"), _unpack(r, "<i8"))
        for p, q, r in map(_parts, entries))))
    order = np.lexsort((ids, b, a))
    a, b = a[order], b[order]
    first = np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
    flags = np.empty(len(a), bool)
    flags[order] = first
    return flags


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text",
                   with_text: bool = True, carried: str | None = None) -> DataFrame:
    """Per row of ``docs``: key, n_words, n_removed, kept_sha256 and, if asked for, kept_text.

    ``carried`` names a column that comes along, for rows that their id does not tell apart; with
    it, a text of which nothing is removed comes back as it was.
    """
    kind = docs.schema[carried].dataType if carried else None
    whole = chunks_of(docs, key, text, carried)
    chunks = whole.drop("others")
    total = chunks.agg(F.sum("n_words")).first()[0] or 0
    owners = max(OWNERS, -(-total // OWNER_ENTRIES))
    bits = max(1, (owners - 1).bit_length())
    shift = np.uint64(max(0, 64 - 30 - bits))  # an owner's range then fits 32 bits

    def send_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in _one_by_one(batch):
                c = Chunk(row)
                c.blocks()
                bounds = _owner_bounds(c.block_hash, owners)
                out = []
                for o, (a, b) in enumerate(zip(bounds[:-1], bounds[1:])):
                    if b > a:
                        base = (np.uint64(o) << np.uint64(32)) // np.uint64(owners) << np.uint64(32)
                        v = (c.block_hash[a:b] >> shift) - (base >> shift)
                        deltas = np.diff(v, prepend=np.uint64(0)).astype("<u4")
                        out.append((o, row["chunk"], int(b - a), _joined(
                            _pack(deltas), np.packbits(c.is_reference[a:b]).tobytes())))
                yield _sent(out)

    hits = stored(_answer(chunks.mapInArrow(send_blocks, SENT), _judge_blocks), "block-hits")
    hit_rows = _by_chunk(hits, "hits")

    def with_windows(row: dict) -> tuple[Chunk, np.ndarray]:
        c = Chunk(row)
        c.blocks()
        c.windows(_answers(row, "hits", owners, _owner_bounds(c.block_hash, owners)))
        return c, _owner_bounds(c.window_hash, owners)

    def send_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in _one_by_one(batch):
                c, bounds = with_windows(row)
                first, second, ids = c.window_entries()
                yield _sent([
                    (o, row["chunk"], int(b - a), _joined(
                        _pack(np.diff(first[a:b], prepend=np.uint64(0))),
                        _pack(second[a:b]), _pack(ids[a:b])))
                    for o, (a, b) in enumerate(zip(bounds[:-1], bounds[1:])) if b > a])

    known = chunks.join(hit_rows, "chunk", "left")
    firsts = stored(_answer(known.mapInArrow(send_windows, SENT), _judge_windows), "window-firsts")

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in _one_by_one(batch):
                c, bounds = with_windows(row)
                gone = c.removed(_answers(row, "firsts", owners, bounds))
                taken, sums, kept = [], [], []
                for start, n, t in zip(c.starts, c.counts, c.texts()):
                    drop = gone[start:start + n]
                    words = t.split()
                    if drop.any():
                        words = [w for w, d in zip(words, drop.tolist()) if not d]
                    rest = b" ".join(words)
                    taken.append(int(drop.sum()))
                    sums.append(hashlib.sha256(rest).hexdigest())
                    if carried and not drop.any():
                        rest = t
                    kept.append(rest.decode() if with_text else None)
                columns = [pa.array([None if k == _NO_ID else k for k in c.ids], pa.int64()),
                           pa.array(c.counts), pa.array(taken, pa.int64()),
                           pa.array(sums, pa.string()), pa.array(kept, pa.string())]
                if carried:
                    columns.append(_thawed(row["others"]))
                yield pa.RecordBatch.from_arrays(columns, names=out.names)

    out = T.StructType().add(key, "long").add("n_words", "long").add("n_removed", "long") \
        .add("kept_sha256", "string").add("kept_text", "string")
    if carried:
        out = out.add(carried, kind)
    rows = (whole if carried else chunks).join(hit_rows, "chunk", "left")
    done = rows.join(_by_chunk(firsts, "firsts"), "chunk", "left").mapInArrow(finish, out)
    return done if with_text else done.drop("kept_text")
