"""Language identification by unigram pieces, summed over all segmentations.

A language is a probability for every piece of a fixed public vocabulary.  A word's probability is
the sum over all ways to cut it into pieces, which a forward pass adds up; a text's is the product
over its words.  Piece probabilities start equal and are refined by expectation-maximisation: every
round, tasks run forward and backward over their part of the distinct training words and Spark sums
the expected counts, a table no larger than vocabulary times languages.

Words are runs of letters in lower case.  Training reads at most ``TRAIN_DOCS`` documents of a
language, picked by a hash of the id; all texts are scored whole.  Nulls and repeats: a null text
or one without letters is ``und`` with score 0; documents without a language or an id teach
nothing; repeated rows are scored alike; without any training document all are ``und``.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchlake.llm.common import id_remainder, stored, whole_text
from matchlake.llm.runs import chunks

TRAIN_DOCS = 800
ROUNDS = 3
#: Distinct words whose probabilities a task keeps (about 150 MB).
KEPT_WORDS = 600_000
CHUNK_BYTES = 4 << 20
START = "▁"
#: No piece of a public vocabulary is longer; shorter words never underflow.
LONGEST = 40
#: Fewer words of one length are looked at one by one.
TOGETHER = 16
BASE = np.uint64(0x9E3779B97F4A7C15)
_WORD = re.compile(r"[^\W\d_]+")
#: Probability of a character that is no piece, and of a piece never seen.
FLOOR = 1e-7


def words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def vocabulary(path: str) -> list[str]:
    """The pieces of a sentencepiece file, without control and byte pieces."""
    import sentencepiece
    pieces = sentencepiece.SentencePieceProcessor(model_file=path)
    return [pieces.id_to_piece(i) for i in range(pieces.get_piece_size())
            if not (pieces.is_control(i) or pieces.is_byte(i) or pieces.is_unknown(i))]


@dataclass
class PieceModel:
    """Piece probabilities of every language; its size is vocabulary times languages."""
    languages: list[str]
    table: dict[str, tuple[float, ...]]
    priors: list[float]
    _trie: dict = field(default_factory=dict, repr=False)
    _known: dict = field(default_factory=dict, repr=False)
    _rows: np.ndarray | None = field(default=None, repr=False)
    _table: PieceTable | None = field(default=None, repr=False)

    def __post_init__(self):
        self._rows = np.empty((0, len(self.languages)))

    def __getstate__(self):
        return {"languages": self.languages, "table": self.table, "priors": self.priors,
                "_trie": {}, "_known": {}, "_table": None,
                "_rows": np.empty((0, len(self.languages)))}

    def _root(self) -> dict:
        if not self._trie:
            for piece, chances in self.table.items():
                node = self._trie
                for c in piece:
                    node = node.setdefault(c, {})
                node[""] = (piece, chances)
        return self._trie

    def edges(self, word: str) -> list[list[tuple[int, str, tuple[float, ...]]]]:
        """For every position the pieces that start there: end, piece, probabilities."""
        root, text = self._root(), START + word
        rare = (FLOOR,) * len(self.languages)
        out = []
        for i in range(len(text)):
            node, j, found = root, i, []
            while j < len(text):
                node = node.get(text[j])
                if node is None:
                    break
                j += 1
                hit = node.get("")
                if hit is not None:
                    found.append((j, hit[0], hit[1]))
            if not found or found[0][0] != i + 1:
                found.append((i + 1, text[i], rare))
            out.append(found)
        return out

    def log_chances(self, word: str) -> tuple[float, ...]:
        """Log probability of the word in every language, over all segmentations.

        The forward pass follows the pieces in the trie as it goes; see ``edges``.
        """
        root, text, k = self._root(), START + word, range(len(self.languages))
        size, rare = len(text), (FLOOR,) * len(self.languages)
        forward: list[list[float] | None] = [None] * (size + 1)
        forward[0] = [1.0] * len(k)
        shift = [0.0] * len(k)
        scaled_to = 0
        for i in range(size):
            here = forward[i]
            if i - scaled_to >= 16:  # keep long words from underflow
                scaled_to = i
                for n in k:
                    top = here[n]
                    if 0.0 < top < 1e-60:
                        shift[n] += math.log(top)
                        for later in forward[i:i + LONGEST]:
                            if later is not None:
                                later[n] /= top
            node, alone = root, rare
            for j in range(i, size):
                node = node.get(text[j])
                if node is None:
                    break
                hit = node.get("")
                if hit is None:
                    continue
                if j == i:
                    alone = hit[1]
                    continue
                there = forward[j + 1]
                forward[j + 1] = [h * c for h, c in zip(here, hit[1])] if there is None else \
                    [t + h * c for t, h, c in zip(there, here, hit[1])]
            there = forward[i + 1]
            forward[i + 1] = [h * c for h, c in zip(here, alone)] if there is None else \
                [t + h * c for t, h, c in zip(there, here, alone)]
        return tuple(math.log(max(forward[-1][n], 1e-300)) + shift[n] for n in k)

    def expected(self, word: str, count: float, n: int, into: dict[str, float]) -> None:
        """Add the expected number of uses of every piece, in language ``n``."""
        for at in range(0, len(word), 100):  # in blocks, so that products stay above zero
            self._expected_in(self.edges(word[at:at + 100]), count, n, into)

    @staticmethod
    def _expected_in(edges: list, count: float, n: int, into: dict[str, float]) -> None:
        size = len(edges)
        forward, backward = [0.0] * (size + 1), [0.0] * (size + 1)
        forward[0] = backward[size] = 1.0
        for i, found in enumerate(edges):
            for j, _, chances in found:
                forward[j] += forward[i] * chances[n]
        for i in range(size - 1, -1, -1):
            backward[i] = sum(chances[n] * backward[j] for j, _, chances in edges[i])
        total = forward[size]
        if total > 0.0:
            for i, found in enumerate(edges):
                for j, piece, chances in found:
                    into[piece] += count * forward[i] * chances[n] * backward[j] / total

    def _pieces_at(self) -> "PieceTable":
        if self._table is None:
            self._table = PieceTable(self.table, len(self.languages))
        return self._table

    def log_chances_many(self, new: list[str]) -> np.ndarray:
        """``log_chances`` of many words: words of one length go through together."""
        out = np.empty((len(new), len(self.languages)))
        by_length: dict[int, list[int]] = defaultdict(list)
        for k, word in enumerate(new):
            by_length[len(word)].append(k)
        for length, places in by_length.items():
            if len(places) < TOGETHER or length >= LONGEST:
                for k in places:
                    out[k] = self.log_chances(new[k])
            else:
                out[places] = self._pieces_at().log_chances([new[k] for k in places], length)
        return out

    def learn(self, texts: list[list[str]]) -> None:
        """Keep the log probabilities of all words of some texts."""
        if not self.languages:
            return
        new = set().union(*texts).difference(self._known)
        if len(self._known) + len(new) > KEPT_WORDS:
            self._known.clear()
            new = set().union(*texts)
            self._rows = np.empty((0, len(self.languages)))
        if new:
            self._known.update(zip(new, range(len(self._rows), len(self._rows) + len(new))))
            self._rows = np.concatenate([self._rows, self.log_chances_many(list(new))])

    def predict(self, found: list[str]) -> tuple[str, float]:
        """The likeliest language of learnt words and its posterior probability."""
        if not found or not self.languages:
            return "und", 0.0
        places = np.fromiter(map(self._known.__getitem__, found), np.int64, len(found))
        scores = self._rows[places].sum(axis=0) + self.priors
        best = int(np.argmax(scores))
        return self.languages[best], float(1 / np.exp(scores - scores[best]).sum())


class PieceTable:
    """Pieces by a 64-bit hash of their characters, to look up many substrings at once."""

    def __init__(self, table: dict[str, tuple[float, ...]], languages: int):
        pieces = list(table)
        self.longest = max(map(len, pieces), default=0)
        self.chances = np.array(list(table.values()) + [(FLOOR,) * languages]).reshape(-1, languages)
        self.bits = max(8, (4 * len(pieces)).bit_length())
        self.hashes = np.zeros(1 << self.bits, np.uint64)
        self.numbers = np.full(1 << self.bits, -1, np.int64)
        for number, piece in enumerate(pieces):
            h = 0
            for c in piece:
                h = (h * int(BASE) + ord(c) + 1) & 0xFFFFFFFFFFFFFFFF
            slot = self._slots(np.array([h], np.uint64))[0]
            while self.numbers[slot] >= 0:
                slot = (slot + 1) % len(self.numbers)
            self.hashes[slot], self.numbers[slot] = h, number

    def _slots(self, h: np.ndarray) -> np.ndarray:
        return ((h ^ (h >> np.uint64(29))) * BASE >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, h: np.ndarray) -> np.ndarray:
        """Number of the piece of every hash, -1 without one."""
        slot = self._slots(h)
        found = np.where(self.hashes[slot] == h, self.numbers[slot], -1)
        # a taken slot of another piece: look on
        rest = np.flatnonzero((found < 0) & (self.numbers[slot] >= 0))
        while len(rest):
            slot[rest] = (slot[rest] + 1) % len(self.numbers)
            same = self.hashes[slot[rest]] == h[rest]
            found[rest[same]] = self.numbers[slot[rest[same]]]
            rest = rest[~same & (self.numbers[slot[rest]] >= 0)]
        return found

    def log_chances(self, words: list[str], length: int) -> np.ndarray:
        """Forward pass over words of one length, all of them and all languages at a time."""
        n = length + 1
        codes = np.full((n, len(words)), ord(START), np.uint32)
        codes[1:] = np.frombuffer("".join(words).encode("utf-32-le"), "<u4").reshape(-1, length).T
        codes = codes.astype(np.uint64) + np.uint64(1)
        forward = np.zeros((n + 1, len(words), self.chances.shape[1]))
        forward[0] = 1.0
        h, pieces = np.zeros_like(codes), []
        for m in range(1, min(self.longest, n) + 1):
            h = h[:n - m + 1] * BASE + codes[m - 1:]
            pieces.append(self.find(h.ravel()).reshape(h.shape))
        if not pieces:
            pieces = [np.full(codes.shape, -1)]
        # a character that is no piece has the last row, the floor
        pieces[0] = np.where(pieces[0] < 0, len(self.chances) - 1, pieces[0])
        for i in range(n):
            for m, numbers in enumerate(pieces[:n - i], 1):
                hit = np.flatnonzero(numbers[i] >= 0)
                if len(hit):
                    forward[i + m, hit] += forward[i, hit] * self.chances[numbers[i, hit]]
        return np.log(np.maximum(forward[n], 1e-300))


def train(docs: DataFrame, pieces: list[str], key: str = "doc_id", text: str = "text",
          lang: str = "lang", most: int = TRAIN_DOCS, rounds: int = ROUNDS) -> PieceModel:
    """Piece probabilities of every language of ``docs`` (only rows that may teach)."""
    rows = docs.select(F.col(key).cast("long").alias("k"), whole_text(text).alias("t"),
                       F.col(lang).alias("lang")).where("k IS NOT NULL AND lang IS NOT NULL")
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    languages = sorted(counts)
    if not languages:
        return PieceModel([], {}, [])
    share = F.create_map(*[F.lit(v) for name, n in counts.items()
                           for v in (name, min(1.0, most / n))])
    draw = F.pmod(F.xxhash64("k", F.lit("language")), F.lit(1 << 20)) / float(1 << 20)

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally: Counter = Counter()
        for batch in batches:
            for name, t in zip(batch.column("lang").to_pylist(), batch.column("t").to_pylist()):
                tally.update((name, w) for w in words(t))
        yield pa.RecordBatch.from_arrays(
            [pa.array([x[0] for x in tally], pa.string()), pa.array([x[1] for x in tally], pa.string()),
             pa.array(tally.values(), pa.int64())], names=["lang", "word", "n"])

    sample = stored(rows.where(draw < share[F.col("lang")])
                    .mapInArrow(split, "lang string, word string, n long")
                    .groupBy("lang", "word").agg(F.sum("n").alias("n"))
                    .repartition("lang", "word"), "language-words")
    total = sum(counts.values())
    even = 1.0 / max(1, len(pieces))
    model = PieceModel(languages, {p: (even,) * len(languages) for p in pieces},
                       [math.log(counts[x] / total) for x in languages])
    for _ in range(rounds):
        model = _refine(sample, model)
    return model


def _refine(sample: DataFrame, model: PieceModel) -> PieceModel:
    place = {name: n for n, name in enumerate(model.languages)}

    def expect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, dict[str, float]] = {n: defaultdict(float) for n in place.values()}
        for batch in batches:
            for name, word, count in zip(*(c.to_pylist() for c in batch.columns)):
                model.expected(word, count, place[name], sums[place[name]])
        flat = [(n, p, v) for n, found in sums.items() for p, v in found.items()]
        yield pa.RecordBatch.from_arrays(
            [pa.array([x[0] for x in flat], pa.int32()), pa.array([x[1] for x in flat], pa.string()),
             pa.array([x[2] for x in flat], pa.float64())], names=["n", "piece", "uses"])

    # characters that are no piece keep the floor: rows are vocabulary times languages at most
    uses = sample.mapInArrow(expect, "n int, piece string, uses double") \
        .groupBy("n", "piece").agg(F.sum("uses").alias("uses")).collect()
    weights = np.full((len(model.languages), len(model.table)), 1e-3)
    order = {p: i for i, p in enumerate(model.table)}
    for r in uses:
        if r["piece"] in order:
            weights[r["n"], order[r["piece"]]] += r["uses"]
    chances = np.maximum(weights / weights.sum(axis=1, keepdims=True), FLOOR * 1e-2).T.tolist()
    return PieceModel(model.languages, {p: tuple(c) for p, c in zip(order, chances)}, model.priors)


def identify(docs: DataFrame, vocabulary_path: str, divisor: int = 4, held: int = 2) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every document."""
    fold = id_remainder("doc_id", divisor)
    model = train(docs.where(fold != held), vocabulary(vocabulary_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "t", CHUNK_BYTES):
                texts = [words(t) for t in part["t"].to_pylist()]
                model.learn(texts)
                found = [model.predict(t) for t in texts]
                yield pa.RecordBatch.from_arrays(
                    [part["doc_id"], part["held_out"], pa.array([x[0] for x in found], pa.string()),
                     pa.array([x[1] for x in found], pa.float64())],
                    names=["doc_id", "held_out", "lang_pred", "score"])

    return docs.select("doc_id", F.coalesce(fold == held, F.lit(False)).alias("held_out"),
                       whole_text().alias("t")) \
        .mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")
