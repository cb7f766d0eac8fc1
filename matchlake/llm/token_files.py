"""Token ids in files of bit-plane shuffled, compressed blocks, in document order.

A segment holds the ids of whole documents.  Its ids are cut into blocks of a fixed size; each
block is transposed into byte planes (or bit planes), each plane is compressed with zstandard,
and an index at the head holds the compressed size of every plane, so a reader decompresses only
the blocks it needs.  Segments are the rows of Parquet files, with their documents' ids and
lengths: Spark's commit protocol then makes lost tasks harmless on any store.

Rows are range-partitioned and sorted by document id; a null id comes first, a null or empty
text has the end id alone, rows that repeat an id follow one another.  Other columns are ignored.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from matchlake.llm.common import whole_text
from matchlake.llm.word_tokens import encoder
from matchlake.operators.order import scratch_path

BLOCK_IDS = 65_536
SEGMENT_IDS = 1 << 20
_HEAD = struct.Struct("<4sBBIQI")  # magic, planes are bits, planes, ids a block, ids, blocks
_MAGIC = b"IDPL"

SEGMENT = ("part int, segment int, start_in_part long, n_ids long, doc_ids array<long>, "
           "lengths array<long>, payload binary")


# --- blocks -------------------------------------------------------------------

def pack_ids(ids: np.ndarray, block_ids: int = BLOCK_IDS, bits: bool = False,
             level: int = 3) -> bytes:
    """The bytes of a segment."""
    squeeze = zstandard.ZstdCompressor(level=level).compress
    planes: list[bytes] = []
    for at in range(0, len(ids), block_ids):
        block = np.ascontiguousarray(ids[at:at + block_ids], dtype="<u4")
        rows = block.view(np.uint8).reshape(-1, 4)
        if bits:
            rows = np.unpackbits(rows, axis=1, bitorder="little")
            planes += [squeeze(np.packbits(plane).tobytes()) for plane in rows.T]
        else:
            planes += [squeeze(plane.tobytes()) for plane in rows.T]
    count = 32 if bits else 4
    head = _HEAD.pack(_MAGIC, bits, count, block_ids, len(ids), len(planes) // count)
    sizes = np.array([len(p) for p in planes], dtype="<u4").tobytes()
    return head + sizes + b"".join(planes)


def unpack_ids(data: bytes, start: int = 0, length: int | None = None) -> np.ndarray:
    """Ids ``start`` to ``start + length`` of a segment; other blocks stay compressed."""
    magic, bits, count, block_ids, n, blocks = _HEAD.unpack_from(data)
    if magic != _MAGIC:
        raise ValueError("not a segment of token ids")
    stop = n if length is None else min(n, start + length)
    if start >= stop:
        return np.empty(0, dtype="<u4")
    sizes = np.frombuffer(data, "<u4", blocks * count, _HEAD.size).astype(np.int64)
    ends = np.cumsum(sizes) + _HEAD.size + 4 * blocks * count
    expand = zstandard.ZstdDecompressor().decompress
    out = []
    first = start // block_ids
    for k in range(first, (stop - 1) // block_ids + 1):
        in_block = min(block_ids, n - k * block_ids)
        planes = [expand(data[ends[i] - sizes[i]:ends[i]])
                  for i in range(k * count, (k + 1) * count)]
        raw = np.stack([np.frombuffer(p, np.uint8) for p in planes])
        if bits:
            raw = np.unpackbits(raw, axis=1, count=in_block)
            rows = np.packbits(raw.T, axis=1, bitorder="little")
        else:
            rows = raw.T
        out.append(np.ascontiguousarray(rows).view("<u4").ravel())
    return np.concatenate(out)[start - first * block_ids:stop - first * block_ids]


# --- files --------------------------------------------------------------------

def write_token_files(docs: DataFrame, tokenizer: str, end_id: int, path: str,
                      key: str = "doc_id", text: str = "text", bits: bool = False) -> None:
    """Encode every text, append ``end_id``, and write segments in ascending key order."""
    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part = encoder(tokenizer), TaskContext.get().partitionId()
        end = np.array([end_id], dtype="<u4").tobytes()
        keys: list = []
        ids: list[bytes] = []
        held, segment, start = 0, 0, 0

        def flush() -> pa.RecordBatch:
            nonlocal held, segment, start, keys, ids
            joined = np.frombuffer(b"".join(ids), "<u4")
            row = {"part": part, "segment": segment, "start_in_part": start,
                   "n_ids": len(joined), "doc_ids": keys, "lengths": [len(x) // 4 for x in ids],
                   "payload": pack_ids(joined, bits=bits)}
            held, segment, start, keys, ids = 0, segment + 1, start + len(joined), [], []
            return pa.RecordBatch.from_pylist([row], pa.schema([
                ("part", pa.int32()), ("segment", pa.int32()), ("start_in_part", pa.int64()),
                ("n_ids", pa.int64()), ("doc_ids", pa.list_(pa.int64())),
                ("lengths", pa.list_(pa.int64())), ("payload", pa.binary())]))

        for batch in batches:
            names = batch.column("k").to_pylist()
            for at in range(0, len(names), 256):
                texts = batch.column("t").slice(at, 256).to_pylist()
                for name, coded in zip(names[at:at + 256], encode(texts)):
                    keys.append(name)
                    ids.append(coded + end)
                    held += len(coded) // 4 + 1
                    if held >= SEGMENT_IDS:
                        yield flush()
        if keys:
            yield flush()

    docs.select(F.col(key).cast("long").alias("k"), whole_text(text).alias("t")) \
        .repartitionByRange("k").sortWithinPartitions("k") \
        .mapInArrow(segments, SEGMENT).write.parquet(path)


def read_token_files(spark, path: str, key: str = "doc_id") -> DataFrame:
    """Per document of the files: key, start, n_tokens, ids (little-endian bytes)."""
    segments = spark.read.schema(SEGMENT).parquet(path)
    parts = segments.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # one row per written partition
    bases = parts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids = unpack_ids(row["payload"])
                ends = np.cumsum(np.array(row["lengths"], dtype=np.int64))
                starts = ends - row["lengths"]
                yield pa.RecordBatch.from_arrays([
                    pa.array(row["doc_ids"], pa.int64()),
                    pa.array(starts + row["start_in_part"] + row["base"], pa.int64()),
                    pa.array(row["lengths"], pa.int64()),
                    pa.array([ids[a:b].tobytes() for a, b in zip(starts, ends)], pa.binary()),
                ], names=[key, "start", "n_tokens", "ids"])

    return segments.join(F.broadcast(bases), "part") \
        .mapInArrow(documents, f"{key} long, start long, n_tokens long, ids binary")


def token_file_digest(docs: DataFrame, tokenizer: str, end_id: int = 1,
                      bits: bool = False) -> DataFrame:
    """Write ``docs`` to token files in the shared folder and describe what is read back."""
    path = scratch_path(docs.sparkSession, "token-files")
    write_token_files(docs, tokenizer, end_id, path, bits=bits)
    return read_token_files(docs.sparkSession, path).select(
        "doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def crc_of(ids: np.ndarray) -> int:
    return zlib.crc32(np.ascontiguousarray(ids, dtype="<u4").tobytes())
