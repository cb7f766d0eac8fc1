"""Byte-pair encoding with forced boundaries, and decoding.

Two bytes that stand side by side inside no token of the vocabulary can never be merged across,
so a cut between them changes nothing.  A 256 x 256 table of such pairs comes from the vocabulary;
pre-tokens are cut by it into fragments, fragments are merged by rank on their own and remembered,
and the ids are concatenated.

Pre-tokens: white space followed by other characters always starts one, so a text is first split
at its single blanks into chunks, whose ids are remembered too.  Texts with characters on whose
class Unicode versions differ are pre-tokenised whole by the library's own pre-tokeniser; the
strings of special tokens are cut out before, as the library does.

A null or empty text has no ids.  Decoding joins the tokens' bytes and replaces what is not UTF-8.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchlake.llm.common import whole_text
from matchlake.llm.word_tokens import library

_PLAIN = re.compile("[\t\n\r\x20-\x7e\xa1-ɏ]*")
#: Fixed value: the pattern of the vocabulary's pre-tokeniser.
_PIECES = regex.compile(
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
_RUNS = re.compile(r"\s*\S+|\s+")
_ID_BITS = 24
_ID_MASK = (1 << _ID_BITS) - 1
_NO_MERGE = 1 << 62
#: Fragments of more bytes are merged with a heap.
LONG = 128
KEPT_CHUNKS = 400_000
#: Longer chunks and fragments are not remembered.
KEPT_LENGTH = 512
KEPT_FRAGMENTS = 200_000


def byte_letters() -> dict[str, int]:
    """The printable character that stands for each byte in the vocabulary file."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


class Remembered:
    """Values of the keys met last: two generations of at most ``most`` keys each."""

    def __init__(self, most: int):
        self.most, self.new, self._old = most, {}, {}

    def find(self, key):
        value = self.new.get(key)
        if value is None:
            value = self._old.get(key)
            if value is not None:
                self.keep(key, value)
        return value

    def keep(self, key, value) -> None:
        if len(self.new) >= self.most:
            self._old, self.new = self.new, {}
        self.new[key] = value


class ForcedBoundaryBPE:
    """Encoder and decoder of one vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        self._letters = byte_letters()
        vocab: dict[str, int] = spec["model"]["vocab"]
        raw = {self._bytes(t): i for t, i in vocab.items()}
        self._tokens = {i: t for t, i in raw.items()}
        self._special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        for content, i in self._special.items():
            raw.pop(self._tokens.get(i), None)
            self._tokens[i] = content.encode()
        self._single = [raw[bytes([b])] for b in range(256)]
        pairs = (m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"])
        # rank and new id in one number, so that the smallest is the next merge
        self._merges = {(vocab[a], vocab[b]): rank << _ID_BITS | vocab[a + b]
                        for rank, (a, b) in enumerate(pairs)}
        self.joined = np.zeros((256, 256), dtype=bool)
        for token in raw:
            b = np.frombuffer(token, np.uint8)
            self.joined[b[:-1], b[1:]] = True
        forced = self.joined.tolist()
        self._cut = [[not x for x in row] for row in forced]
        # ids as decimals joined by commas, by chunk and by what follows a single blank
        self._chunks = Remembered(KEPT_CHUNKS)
        self._words = Remembered(KEPT_CHUNKS)
        #: Whether some chunk met so far does not decode to itself.
        self._changes = False
        self._fragments = Remembered(KEPT_FRAGMENTS)
        self._split = re.compile("|".join(map(re.escape, self._special))) if self._special else None
        self._library = library(path)

    def _bytes(self, token: str) -> bytes:
        return bytes(self._letters[c] for c in token) if all(
            c in self._letters for c in token) else token.encode()

    def _merge(self, fragment: bytes) -> tuple[int, ...]:
        """Merge the pair of lowest rank, leftmost first, until none is left."""
        if len(fragment) > LONG:
            return self._merge_long(fragment)
        ids = [self._single[b] for b in fragment]
        find = self._merges.get
        found = [find(pair, _NO_MERGE) for pair in zip(ids, ids[1:])]
        while found:
            best = min(found)
            if best == _NO_MERGE:
                break
            at = found.index(best)
            ids[at:at + 2] = (best & _ID_MASK,)
            del found[at]
            if at < len(found):
                found[at] = find((ids[at], ids[at + 1]), _NO_MERGE)
            if at:
                found[at - 1] = find((ids[at - 1], ids[at]), _NO_MERGE)
        return tuple(ids)

    def _merge_long(self, fragment: bytes) -> tuple[int, ...]:
        """The same by a heap of pairs and links between neighbours, in n log n steps."""
        ids = [self._single[b] for b in fragment]
        find, n = self._merges.get, len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(best, i) for i, pair in enumerate(zip(ids, ids[1:]))
                if (best := find(pair)) is not None]
        heapify(heap)
        while heap:
            best, i = heappop(heap)
            j = after[i]
            # a pair that has changed since is found again under its new rank
            if ids[i] < 0 or j >= n or find((ids[i], ids[j])) != best:
                continue
            ids[i], ids[j] = best & _ID_MASK, -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
            for a, b in ((before[i], i), (i, k)):
                if a >= 0 and b < n and (new := find((ids[a], ids[b]))) is not None:
                    heappush(heap, (new, a))
        return tuple(i for i in ids if i >= 0)

    def fragments(self, piece: bytes) -> list[bytes]:
        """``piece`` cut wherever a boundary is forced."""
        cut, out, start = self._cut, [], 0
        for k in range(1, len(piece)):
            if cut[piece[k - 1]][piece[k]]:
                out.append(piece[start:k])
                start = k
        out.append(piece[start:])
        return out

    def _piece(self, piece: bytes) -> list[int]:
        out: list[int] = []
        for fragment in self.fragments(piece):
            ids = self._fragments.find(fragment)
            if ids is None:
                ids = self._merge(fragment)
                if len(fragment) <= KEPT_LENGTH:
                    self._fragments.keep(fragment, ids)
            out += ids
        return out

    def _pieces(self, text: str) -> list[bytes]:
        if _PLAIN.fullmatch(text):
            return [p.encode() for p in _PIECES.findall(text)]
        letters = self._letters
        return [bytes(letters[c] for c in p)
                for p, _ in self._library.pre_tokenizer.pre_tokenize_str(text)]

    def encode(self, text: str) -> list[int]:
        joined = self._decimals(text)
        return list(map(int, joined.split(","))) if joined else []

    def digest(self, text: str) -> tuple[int, str, str]:
        """Number of ids, the ids as decimals joined by commas, and the decoded text.

        Chunks are decoded when they are coded; while all of them give their own text, so do
        texts made of them.
        """
        joined = self._decimals(text)
        n = joined.count(",") + 1 if joined else 0
        if not self._changes:
            return n, joined, text
        return n, joined, self.decode(list(map(int, joined.split(","))) if joined else [])

    def _decimals(self, text: str) -> str:
        out: list[str] = []
        at = 0
        for found in self._split.finditer(text) if self._split else ():
            out += self._segment(text[at:found.start()])
            out.append(self._code([self._special[found.group()]], found.group()))
            at = found.end()
        out += self._segment(text[at:] if at else text)
        return ",".join(filter(None, out))

    def _code(self, ids: list[int], text: str) -> str:
        """The ids as decimals joined by commas; ``text`` is what they stand for."""
        self._changes |= self.decode(ids) != text
        return ",".join(map(str, ids))

    def _segment(self, text: str) -> list[str]:
        if not _PLAIN.fullmatch(text):
            return [self._code([i for piece in self._pieces(text) for i in self._piece(piece)], text)]
        if "  " in text:
            return self._remembered(self._chunks, _RUNS.findall(text), "")
        # a pre-token starts at every single blank
        head, *rest = text.split(" ")
        return self._remembered(self._chunks, [head], "") + self._remembered(self._words, rest, " ")

    def _remembered(self, known: Remembered, chunks: list[str], lead: str) -> list[str]:
        """Decimals of every chunk, each after ``lead``."""
        found = list(map(known.new.get, chunks))
        if None in found:
            for k, (chunk, ids) in enumerate(zip(chunks, found)):
                if ids is None:
                    ids = known.find(chunk)
                    if ids is None:
                        piece = lead + chunk
                        if piece.isascii() and chunk.isalpha():  # one pre-token
                            ids = self._code(self._piece(piece.encode()), piece)
                        else:
                            ids = self._code([i for p in self._pieces(piece)
                                              for i in self._piece(p)], piece)
                        if len(chunk) <= KEPT_LENGTH:
                            known.keep(chunk, ids)
                    found[k] = ids
        return found

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self._tokens.__getitem__, ids)).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def coder(path: str) -> ForcedBoundaryBPE:
    return ForcedBoundaryBPE(path)


def encode_documents(docs: DataFrame, tokenizer: str, key: str = "doc_id",
                     text: str = "text") -> DataFrame:
    """Key, ids and the decoded text of every document."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = coder(tokenizer)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                ids = [bpe.encode(t) for t in part.column("t").to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column("k"), pa.array(ids, pa.list_(pa.int32())),
                     pa.array(map(bpe.decode, ids), pa.string())],
                    names=[key, "ids", "decoded"])

    return docs.select(F.col(key).alias("k"), whole_text(text).alias("t")).mapInArrow(
        run, f"{key} long, ids array<int>, decoded string")


def encoding_digest(docs: DataFrame, tokenizer: str, key: str = "doc_id",
                    text: str = "text") -> DataFrame:
    """Per document: n_tokens and the SHA-256 of its ids and of its decoded text.

    The digests are taken where the ids are made, so that ids need not leave the task.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, sha = coder(tokenizer), hashlib.sha256
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                lengths, id_sums, text_sums = [], [], []
                for t in part.column("t").to_pylist():
                    n, decimals, decoded = bpe.digest(t)
                    lengths.append(n)
                    id_sums.append(sha(decimals.encode()).hexdigest())
                    text_sums.append(sha(decoded.encode()).hexdigest())
                yield pa.RecordBatch.from_arrays(
                    [part.column("k"), pa.array(lengths, pa.int64()), pa.array(id_sums),
                     pa.array(text_sums)],
                    names=[key, "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col(key).cast("long").alias("k"), whole_text(text).alias("t")).mapInArrow(
        run, f"{key} long, n_tokens long, ids_sha256 string, decoded_sha256 string")
