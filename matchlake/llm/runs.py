"""Periodic runs of words, found on a Re-Pair grammar of every document.

A run is a stretch of consecutive words with smallest period ``q`` (words ``q`` apart are
identical) and a length of at least max(``least``, 2 q) that no neighbouring word extends.

1. Word ids of a chunk of documents are paired in rounds: a round replaces every pair that is
   more frequent in its document than the pairs beside it, as Re-Pair would replace it before
   them.  A pair that stands once is never looked at again.  What is left of a document is the
   leaf row of a balanced tree.
2. Every nonterminal, and every inner node of these trees, has one boundary.  A run that crosses
   it agrees with itself, one period on, in three words on one side of the boundary, so its
   periods are the distances to the other places of these three words inside the node.  Common
   extensions to both sides by prefix hashes (62 bits) give the stretch.  This is done once for
   a nonterminal, at its first place.
3. A nonterminal's stretches are carried to all places where it was formed, stretches of one
   period that overlap by a period are merged, and of equal stretches the smallest period stays.

Documents without six consecutive words that return have no run and skip the grammar.  A chunk
holds ``CHUNK_BYTES`` of text or one document; work and memory are O(n log n) of its words.

Nulls and repeats: every row gives one row under its own id, null and repeated ids as well; a
null or empty text has no words, no runs and an empty collapsed text.  Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchlake.llm.common import whole_text

CHUNK_BYTES = 2 << 20
LEAST = 12
#: Words on one side of a boundary that must agree: half of the LEAST - 6 equal pairs of a run.
SEED = 3
PRIMES, BASES = (2_147_483_629, 2_147_483_587), (1_000_003_511, 1_700_000_123)


def _unfinished(row: np.ndarray) -> np.ndarray:
    """Place of every element in its stretch of True, counted from 1; 0 elsewhere."""
    at = np.arange(1, len(row) + 1)
    return at - np.maximum.accumulate(np.where(row, 0, at))


def grammar(ids: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, list[tuple[np.ndarray, ...]]]:
    """Re-Pair of every document: word places where a top symbol starts, and the nonterminals.

    Each round gives (number, place, left words, words) of all places of its nonterminals, by
    number and place; nonterminals of one round are numbered from 0.
    """
    top = np.ones(len(ids), bool)
    width = int(ids.max(initial=0)) + 1
    sym = np.unique(doc * width + ids, return_inverse=True)[1].astype(np.int64)
    at, size = np.arange(len(ids)), np.ones(len(ids), np.int64)
    live = np.append(doc[1:] == doc[:-1], False)[:len(ids)]
    draw, fresh, rounds = np.random.default_rng(0), int(sym.max(initial=0)) + 1, []
    while live.any():
        pairs = np.flatnonzero(live)
        kind = np.unique(sym[pairs] * fresh + sym[pairs + 1], return_inverse=True)[1]
        beside = np.append(False, np.diff(pairs) == 1)
        same = beside & np.append(False, kind[1:] == kind[:-1])
        # overlapping places of one pair (a a a) count every second time
        free = _unfinished(same) % 2 == 0
        count = np.bincount(kind[free])
        rank = (count * len(count) + draw.permutation(len(count)))[kind]
        group = np.cumsum(~same) - 1
        first = np.flatnonzero(~same)
        left = np.where(beside[first], rank[first - 1], -1)
        right = np.append(np.where(beside[first[1:]], rank[first[1:]], -1), -1)
        wins = ((rank[first] > left) & (rank[first] > right))[group] & free & (count[kind] > 1)
        chosen = np.bincount(kind[wins], minlength=len(count)) > 1
        wins &= chosen[kind]
        live[pairs[count[kind] < 2]] = False
        if wins.any():
            here = pairs[wins]
            number = np.unique(kind[wins], return_inverse=True)[1]
            order = np.argsort(number, kind="stable")
            rounds.append((number[order], at[here][order], size[here][order],
                           (size[here] + size[here + 1])[order]))
            top[at[here + 1]] = False
            sym[here] = fresh + number
            size[here] += size[here + 1]
            live[here] = live[here + 1]
            fresh += int(number.max()) + 1
            left_over = np.ones(len(sym), bool)
            left_over[here + 1] = False
        else:
            left_over = np.ones(len(sym), bool)
        left_over &= live | np.append(False, live[:-1]) | np.isin(
            np.arange(len(sym)), pairs[wins])
        sym, at, size, live = sym[left_over], at[left_over], size[left_over], live[left_over]
    return top, rounds


class _Extend:
    """Longest common extensions of two places, by prefix hashes modulo two primes."""

    def __init__(self, ids: np.ndarray):
        self.sums, self.powers = [], []
        for prime, base in zip(PRIMES, BASES, strict=True):
            power = np.ones(len(ids) + 1, np.int64)
            done, step = 1, base
            while done < len(power):
                more = min(done, len(power) - done)
                power[done:done + more] = power[:more] * step % prime
                done, step = done + more, step * step % prime
            value = (ids * 1_640_531_527 + 97) % prime * power[:-1] % prime
            self.sums.append(np.append(0, np.cumsum(value)) % prime)
            self.powers.append(power)

    def _equal(self, a, b, n) -> np.ndarray:
        same = np.ones(len(a), bool)
        for total, power, prime in zip(self.sums, self.powers, PRIMES, strict=True):
            one, two = (total[a + n] - total[a]) % prime, (total[b + n] - total[b]) % prime
            same &= one * power[b - a] % prime == two
        return same

    def forward(self, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Equal words from places a and b (a <= b) on, ``most`` at most."""
        n = np.zeros(len(a), np.int64)
        for bit in reversed(range(int(most.max(initial=0)).bit_length())):
            try_ = np.flatnonzero(n + (1 << bit) <= most)
            good = try_[self._equal(a[try_] + n[try_], b[try_] + n[try_], 1 << bit)]
            n[good] += 1 << bit
        return n

    def backward(self, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Equal words before places a and b (a <= b), ``most`` at most."""
        n = np.zeros(len(a), np.int64)
        for bit in reversed(range(int(most.max(initial=0)).bit_length())):
            step = 1 << bit
            try_ = np.flatnonzero(n + step <= most)
            good = try_[self._equal(a[try_] - n[try_] - step, b[try_] - n[try_] - step, step)]
            n[good] += step
        return n


def _nodes(top, rounds, doc) -> tuple[np.ndarray, ...]:
    """(lo, mid, hi) of the first place of every node; then, by node, its places.

    The places of node k are ``places[begin[k]:begin[k + 1]]``.
    """
    lo, mid, hi, places, counts = [], [], [], [], []
    for number, at, left, size in rounds:
        first = np.flatnonzero(np.append(True, number[1:] != number[:-1]))
        lo.append(at[first])
        mid.append(at[first] + left[first])
        hi.append(at[first] + size[first])
        places.append(at)
        counts.append(np.diff(np.append(first, len(number))))
    # balanced trees over the top symbols: node j spans 2 ** (its trailing zeros) on both sides
    starts = np.flatnonzero(top)
    of = doc[starts]
    heads = np.flatnonzero(np.append(True, of[1:] != of[:-1]))
    sizes = np.diff(np.append(heads, len(of)))
    head = np.repeat(heads, sizes)
    j = np.arange(len(of)) - head
    inner = np.flatnonzero(j)
    j, head, most = j[inner], head[inner], np.repeat(sizes, sizes)[inner]
    half = j & -j
    after = np.append(starts, len(doc))
    lo.append(starts[head + j - half])
    mid.append(starts[inner])
    hi.append(after[head + np.minimum(j + half, most)])
    places.append(lo[-1])
    counts.append(np.ones(len(inner), np.int64))
    begin = np.append(0, np.cumsum(np.concatenate(counts)))
    return (*map(np.concatenate, (lo, mid, hi, places)), begin)


def _spans(first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For ranges [first, last): the number of the range and the value, one row per value."""
    n = np.maximum(last - first, 0)
    of = np.repeat(np.arange(len(n)), n)
    return of, np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n) + first[of]


def _crossing(ids, doc, returning, nodes, least) -> tuple[np.ndarray, ...]:
    """(node, start, end, period) of stretches around the boundary of every node."""
    lo, mid, hi = nodes
    n = len(ids)
    gram = np.zeros(n, bool)
    gram[:max(n - 2, 0)] = returning[:-2] & returning[1:-1]
    where = np.flatnonzero(gram)
    width = int(ids.max()) + 1
    pair = np.unique((doc * width + ids)[:-1] * width + ids[1:], return_inverse=True)[1]
    named = np.unique(pair[where] * n + pair[where + 1], return_inverse=True)[1]
    name = np.full(n, -1, np.int64)
    name[where] = named
    index = np.sort(named * n + where)
    found = []
    for seed in (mid, mid - SEED):
        node = np.flatnonzero((hi - lo >= least) & (seed >= lo) & (seed + SEED <= hi))
        node = node[gram[seed[node]]]
        t = seed[node]
        row, slot = _spans(np.searchsorted(index, name[t] * n + lo[node]),
                           np.searchsorted(index, name[t] * n + hi[node] - SEED, "right"))
        other = index[slot] % n
        period = np.abs(other - t[row])
        keep = (period > 0) & (2 * period <= (hi - lo)[node][row])
        node, period = node[row][keep], period[keep]
        at = np.where(other[keep] > t[row][keep], mid[node], mid[node] - period)
        found.append((node, at, period))
    node, at, period = map(np.concatenate, zip(*found, strict=True))
    if not len(node):
        return node, at, at, period
    reach = _Extend(ids)
    more = reach.forward(at, at + period, hi[node] - at - period)
    less = reach.backward(at, at + period, at - lo[node])
    start, end = at - less, at + period + more
    keep = end - start >= np.maximum(least, 2 * period)
    node, start, end, period = node[keep], start[keep], end[keep], period[keep]
    order = np.lexsort((period, end, start, node))
    node, start, end, period = node[order], start[order], end[order], period[order]
    first = np.append(True, (np.diff(node) != 0) | (np.diff(start) != 0) | (np.diff(end) != 0))
    first = first[:len(node)]
    return node[first], start[first], end[first], period[first]


def find_runs(ids: np.ndarray, doc: np.ndarray, least: int = LEAST) -> tuple[np.ndarray, ...]:
    """(start, end, period) of all runs, by start and period; ends are exclusive.

    ``ids`` are word ids and ``doc`` ascending document numbers; runs never cross documents.
    """
    none = (np.zeros(0, np.int64),) * 3
    if len(ids) < least:
        return none
    width = int(ids.max()) + 1
    key = (doc * width + ids)[:-1] * width + ids[1:]
    key[doc[1:] != doc[:-1]] = -1
    _, kind, count = np.unique(key, return_inverse=True, return_counts=True)
    returning = np.append((count[kind] > 1) & (key >= 0), False)
    long = np.unique(doc[_unfinished(returning) >= least // 2 - 1])
    if not len(long):
        return none
    kept = np.flatnonzero(np.isin(doc, long))
    ids, doc, returning = ids[kept], np.searchsorted(long, doc[kept]), returning[kept]
    top, rounds = grammar(ids, doc)
    *nodes, places, begin = _nodes(top, rounds, doc)
    node, start, end, period = _crossing(ids, doc, returning, nodes, least)
    # to all places of the node
    row, slot = _spans(begin[node], begin[node + 1])
    shift = places[slot] - nodes[0][node][row]
    start, end, period = start[row] + shift, end[row] + shift, period[row]
    # stretches of one period that overlap by a period are one
    order = np.lexsort((start, period))
    start, end, period = start[order], end[order], period[order]
    n = len(ids) + 1
    reached = np.maximum.accumulate(period * n + end)
    fresh = np.append(True, (np.diff(period) != 0)
                      | (start[1:] + period[1:] > (reached % n)[:-1]))[:len(start)]
    first = np.flatnonzero(fresh)
    last = np.append(first[1:], len(start)) - 1 if len(first) else first
    start, end, period = start[first], (reached % n)[last], period[first]
    order = np.lexsort((period, end, start))
    start, end, period = start[order], end[order], period[order]
    first = np.append(True, (np.diff(start) != 0) | (np.diff(end) != 0))[:len(start)]
    start, end, period = start[first], end[first], period[first]
    return kept[start], kept[end - 1] + 1, period


RUNS = pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")]))


def _chunk(texts: list[str], least: int) -> tuple[list[int], pa.Array, list[str]]:
    """Numbers of words, runs and collapsed texts of a chunk."""
    words = [t.encode().split() for t in texts]
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    begin = np.append(0, np.cumsum(sizes))
    flat = [w for ws in words for w in ws]
    number = {w: i for i, w in enumerate(set(flat))}
    ids = np.fromiter(map(number.__getitem__, flat), np.int64, len(flat))
    start, end, period = find_runs(ids, np.repeat(np.arange(len(words)), sizes), least)
    step = np.zeros(len(flat) + 1, np.int64)
    np.add.at(step, start + period, 1)
    np.add.at(step, end, -1)
    dropped = np.cumsum(step[:-1]) > 0
    of = np.searchsorted(begin, start, "right") - 1
    texts = []
    touched = set(of.tolist())
    for k, ws in enumerate(words):
        if k in touched:
            gone = dropped[begin[k]:begin[k + 1]].tolist()
            ws = [w for w, g in zip(ws, gone, strict=True) if not g]
        texts.append(b" ".join(ws).decode())
    rows = pa.StructArray.from_arrays(
        [pa.array(start - begin[of]), pa.array(end - start), pa.array(period)],
        ["start", "length", "period"])
    offsets = np.append(0, np.cumsum(np.bincount(of, minlength=len(words)))).astype(np.int32)
    return sizes.tolist(), pa.ListArray.from_arrays(pa.array(offsets), rows), texts


def chunks(batch: pa.RecordBatch, column: str, most: int) -> Iterator[pa.RecordBatch]:
    """Slices of a batch of at most ``most`` bytes of a text column, or of one row."""
    size = np.cumsum(pc.binary_length(batch[column]).fill_null(0).to_numpy(zero_copy_only=False))
    at = 0
    while at < batch.num_rows:
        done = int(size[at - 1]) if at else 0
        to = max(at + 1, int(np.searchsorted(size, done + most, "right")))
        yield batch.slice(at, to - at)
        at = to


def periodic_runs(docs: DataFrame, key: str = "doc_id", text: str = "text",
                  least: int = LEAST, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Per row of ``docs``: key, n_words, runs (start, length, period) and collapsed_text.

    ``runs`` are ordered by start and period.  ``collapsed_text`` are the words, joined by a
    blank, that no run contains after its first ``period`` words.
    """
    if least < 4 * SEED:
        raise ValueError(f"least must be {4 * SEED} or more")

    def scan(batches):
        for batch in batches:
            for part in chunks(batch, "_text", chunk_bytes):
                n, runs, texts = _chunk(part["_text"].to_pylist(), least)
                yield pa.RecordBatch.from_arrays(
                    [part["_key"], pa.array(n, pa.int64()), runs.cast(RUNS), pa.array(texts, pa.string())],
                    ["_key", "n_words", "runs", "collapsed_text"])

    rows = docs.select(F.col(key).alias("_key"), whole_text(text).alias("_text"))
    schema = f"_key {rows.schema['_key'].dataType.simpleString()}, n_words long, " \
             "runs array<struct<start:long,length:long,period:long>>, collapsed_text string"
    return rows.mapInArrow(scan, schema).withColumnRenamed("_key", key)


def run_digest(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """Digest of ``periodic_runs``: number of runs, the longest one, hashes of runs and words.

    Of runs of equal length the one with the smallest start, then period, is given; without a
    run its four columns are null.
    """
    longest = F.expr("array_max(transform(runs, r -> struct(r.length AS length, "
                     "-r.start AS start, -r.period AS period)))")
    lines = F.expr("array_join(transform(runs, r -> concat(r.start, ',', r.length, ',', "
                   "r.period, '\n')), '')")
    best = found.withColumn("best", longest)
    return best.select(
        key, F.size("runs").cast("long").alias("n_runs"), (-F.col("best.start")).alias("start"),
        F.col("best.length").alias("length"), (-F.col("best.period")).alias("period"),
        F.expr("(1000 * best.length) div -best.period").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"),
        F.sha2("collapsed_text", 256).alias("collapsed_sha256"))


def with_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` where a tenth of the rows, by crc32 of the id, end in repeats of a stretch.

    With h = crc32 of the id as text, g = h div 10 and n words, rows of h % 10 = 0 get the word
    a + (i - a) % p at every place i >= a, for a = g % n and p = 1 + (n - a) div (3 + g % 8).
    Rows with a null id stay as they are.
    """
    h, n = f"crc32(cast(cast(`{key}` AS string) AS binary))", "size(w)"
    g = f"({h} div 10)"
    a = f"({g} % {n})"
    place = f"if(i < {a}, i, {a} + (i - {a}) % (1 + ({n} - {a}) div (3 + {g} % 8)))"
    # the words are an array of one element, so that they are split once
    repeated = f"""transform(array(filter(split(`{text}`, '[ \\\\t-\\\\r]+'), w -> w <> '')), w ->
        if({n} = 0, '', array_join(transform(sequence(0, {n} - 1), i ->
            w[cast({place} AS int)]), ' ')))[0]"""
    return docs.withColumn(text, F.expr(
        f"CASE WHEN {h} % 10 = 0 THEN {repeated} ELSE `{text}` END"))
