"""Near-duplicates by MinHash with tensored banding, confirmed on whole shingle sets.

A table key is a pair of keys from two small families of hash collections, so few collections give
many tables: 7 collections of one minhash and 10 of two make 70 tables from 27 minhashes, where
plain banding needs 210.  A pair at the threshold of 0.85 shares a table unless it fails in all
collections of one family: 0.15 ^ 7 + (1 - 0.85 ^ 2) ^ 10, about 4 in a million.

1. Documents with the same set form a class; only its first document goes on.
2. Classes that share a table key are bucket mates.  Rounds compare each with a random mate of
   every bucket, two at most each, and join what is confirmed into components, so a bucket of
   very many near copies shrinks to few components without listing its pairs.  A round draws one
   order of all classes, and a bucket's first is its mate: buckets of one cluster agree on few.
3. The last pass looks at buckets whose classes are still in different components; buckets that
   share a class form a cluster.  Every set is stated by what it adds to and lacks of the shingles
   that most of its cluster has.  Sets that lie near those are linked, by the triangle inequality,
   with the one that lies nearest, without a pair.  Any other link must have several of these
   differences in common, so pairs are taken from a join on the rarest differences of each set, as
   many as a link cannot all miss (prefix filter).  No link is lost, and very many copies with
   changes of their own are not compared with each other: they share no rare difference.

Before sets are compared, pairs must agree in size and in enough minhashes: four bits of each are
kept, and a linked pair differs in more than ``differing`` of them less than once in ten million.
A confirmed link compares the whole sets as 64-bit hashes of their shingles.

Words are runs of other characters than blank, tab and line ends, with A-Z in lower case; a text
of fewer words than a shingle is one shingle.  A null or empty text, or one without words, has an
empty set and is linked with nothing.  Ids are taken as unique; a row with a null id is a component
by itself, without a number.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchlake.llm.common import (
    batches_of,
    few,
    stored,
    tidied,
    whole_text,
    with_groups,
    without_rows,
)
from matchlake.llm.components import components
from matchlake.llm.word_hashes import BASE, mix, rolling, word_hashes

#: A text with a match has words.
_WORD = r"[^ \t\n\r\x0b\f]"
ROUNDS = 2
MATES = 2
#: Parts of the pairs of one set, so that a set of very many pairs is no hot key.
SALTS = 256


@dataclass(frozen=True)
class Near:
    """What counts as near, and the two families of collections that look for it."""
    shingle: int = 3
    percent: int = 85
    first: tuple[int, int] = (1, 7)     # minhashes of a collection, collections
    second: tuple[int, int] = (2, 10)
    differing: int = 15

    @property
    def minhashes(self) -> int:
        return self.first[0] * self.first[1] + self.second[0] * self.second[1]


#: The contract of the query, and the rule for stages: five words, similarity 0.8.
QUERY = Near()
#: Rows that a task holds at a time, in the JVM and in Python, with their texts or whole sets.
ROWS = 512
STAGE = Near(shingle=5, percent=80, first=(1, 8), second=(1, 8), differing=13)


def shingle_set(text: str, size: int) -> np.ndarray:
    """Ascending distinct hashes of the text's shingles."""
    words = text.encode().lower().split()
    if not words:
        return np.empty(0, np.uint64)
    hashes = word_hashes(words)
    if len(words) < size:
        return rolling(hashes, len(words), BASE) ^ np.uint64(len(words))
    return np.unique(rolling(hashes, size, BASE))


def _sketches(sets: list[np.ndarray], near: Near) -> tuple[np.ndarray, ...]:
    """Of sets that are not empty: two set digests, the keys of both families, two sketches."""
    flat = np.concatenate(sets)
    starts = np.cumsum([0] + [len(s) for s in sets[:-1]])
    digests = [np.add.reduceat(mix(flat * m), starts)
               for m in (np.uint64(0xA24BAED4963EE407), np.uint64(0x9FB21C651E98DF25))]
    draw = np.random.default_rng(5_077)
    factors = draw.integers(1, 1 << 63, near.minhashes, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    shifts = draw.integers(0, 1 << 63, near.minhashes, dtype=np.uint64)
    mins = [mix(np.minimum.reduceat((flat ^ s) * f, starts)) for f, s in zip(factors, shifts)]
    keys, at = [], 0
    for width, count in (near.first, near.second):
        family = []
        for _ in range(count):
            key = mins[at].copy()
            for m in mins[at + 1:at + width]:
                key = mix(key * BASE + m)
            family.append(key)
            at += width
        keys.append(np.column_stack(family))
    bits = [np.zeros(len(sets), np.uint64), np.zeros(len(sets), np.uint64)]
    for k, m in enumerate(mins):
        bits[k // 16] |= (m >> np.uint64(60)) << np.uint64(4 * (k % 16))
    return (*digests, *keys, *bits)


_SETS = ("doc_id long, n int, d1 long, d2 long, a array<long>, b array<long>, s1 long, s2 long")


def _documents(docs: DataFrame, key: str, text: str, near: Near) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                sets = [shingle_set(t, near.shingle) for t in part.column("t").to_pylist()]
                sizes = np.array([len(s) for s in sets], np.int32)
                full = np.flatnonzero(sizes)
                columns = [np.zeros((len(sets), *shape), np.uint64) for shape in
                           ((), (), (near.first[1],), (near.second[1],), (), ())]
                if len(full):
                    for column, values in zip(columns, _sketches([sets[i] for i in full], near)):
                        column[full] = values
                d1, d2, a, b, s1, s2 = (c.view(np.int64) for c in columns)
                yield pa.RecordBatch.from_arrays(
                    [part.column("k"), pa.array(sizes), pa.array(d1), pa.array(d2),
                     pa.array(list(a), pa.list_(pa.int64())), pa.array(list(b), pa.list_(pa.int64())),
                     pa.array(s1), pa.array(s2)],
                    names=["doc_id", "n", "d1", "d2", "a", "b", "s1", "s2"])

    rows = docs.select(F.col(key).cast("long").alias("k"), whole_text(text).alias("t"))
    return stored(rows.mapInArrow(run, _SETS), "near-documents")


def _differing(x: str, y: str) -> Column:
    """Minhashes whose four bits differ between the aliases ``x`` and ``y``."""
    def differ(name: str) -> Column:
        d = F.col(f"{x}.{name}").bitwiseXOR(F.col(f"{y}.{name}"))
        d = d.bitwiseOR(F.shiftright(d, 2))
        d = d.bitwiseOR(F.shiftright(d, 1))
        return F.bit_count(d.bitwiseAND(F.lit(0x1111111111111111)))

    return differ("s1") + differ("s2")


def _may_link(x: str, y: str, near: Near) -> Column:
    """Sizes and sketches of the aliases ``x`` and ``y`` allow a link."""
    n, m = F.col(f"{x}.n"), F.col(f"{y}.n")
    return (100 * F.least(n, m) >= near.percent * F.greatest(n, m)) & (
        _differing(x, y) <= near.differing)


def _mates(classes: DataFrame) -> DataFrame:
    """(key, rep, p0, ...) of every class in every table whose key another class has too.

    Classes with the same key of a table have the same key of the second family, so only what
    shares one of those is spread over the tables.  ``p0`` and so on are the mates of the rounds.
    """
    second = classes.select("rep", F.posexplode("b").alias("j", "vb"))
    common = second.groupBy("j", "vb").agg(F.count(F.lit(1)).alias("m")).where("m > 1")
    second = stored(second.join(common.select("j", "vb"), ["j", "vb"]), "near-second")
    keyed = second.join(classes.select("rep", "a"), "rep") \
        .select("rep", "j", "vb", F.posexplode("a").alias("i", "va")) \
        .select(F.xxhash64("i", "va", "j", "vb").alias("key"), "rep")
    shared = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("m"), *[
        F.min_by("rep", F.xxhash64("rep", F.lit(number))).alias(f"p{number}")
        for number in range(ROUNDS)]).where("m > 1").drop("m")
    return stored(keyed.join(shared, "key"), "mates")


def _confirmed(pairs: DataFrame, sets: DataFrame, near: Near) -> DataFrame:
    """The (a, b) of ``pairs`` whose whole sets are near; a hot ``a`` is dealt out by salt."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for x, y in zip(batch.column("xs").to_pylist(), batch.column("ys").to_pylist()):
                p, q = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                common = len(p) + len(q) - len(np.union1d(p, q))
                good.append(100 * common >= near.percent * (len(p) + len(q) - common))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")],
                                             names=["a", "b"]).filter(pa.array(good, pa.bool_()))

    salted = stored(pairs.withColumn("salt", F.pmod(F.xxhash64("b"), F.lit(SALTS))), "near-pairs")
    left = salted.select("a", "salt").distinct().join(
        sets.select(F.col("rep").alias("a"), F.col("shingles").alias("xs")), "a")
    right = salted.join(sets.select(F.col("rep").alias("b"), F.col("shingles").alias("ys")), "b")
    return right.join(left, ["a", "salt"]).select("a", "b", "xs", "ys").mapInArrow(
        run, "a long, b long")


def _shingle_table(docs: DataFrame, ids: DataFrame, key: str, text: str, near: Near) -> DataFrame:
    """The whole shingle sets of the documents in ``ids``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(t, near.shingle).tobytes() for t in batch.column("t").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("rep"), pa.array(sets, pa.binary())],
                                             names=["rep", "shingles"])

    rows = docs.select(F.col(key).cast("long").alias("rep"), whole_text(text).alias("t"))
    return stored(rows.join(few(ids), "rep", "left_semi").mapInArrow(run, "rep long, shingles binary"),
                  "near-sets")


def _lone_shingles(sets: DataFrame) -> DataFrame:
    """(rep, lone): how many shingles of each set no other set of the table has."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rep, data in zip(batch.column("rep").to_pylist(),
                                 batch.column("shingles").to_pylist()):
                flat = np.frombuffer(data, np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(flat), rep)), pa.array(flat)], names=["rep", "s"])

    return sets.mapInArrow(run, "rep long, s long") \
        .groupBy("s").agg(F.count(F.lit(1)).alias("m"), F.min("rep").alias("rep")) \
        .where("m = 1").groupBy("rep").agg(F.count(F.lit(1)).alias("lone"))


def _clusters(mixed: DataFrame) -> DataFrame:
    """(rep, cluster) of the classes in ``mixed`` (key, rep): keys that share a class are together."""
    first = mixed.groupBy("key").agg(F.min("rep").alias("a"))
    edges = mixed.join(first, "key").where("rep <> a").select("a", F.col("rep").alias("b")).distinct()
    return components(stored(edges, "near-edges")).select(F.col("id").alias("rep"), F.col("comp").alias("cluster"))


def _differences(sets: DataFrame, total: int, near: Near) -> DataFrame:
    """(rep, cluster, d, w) of ``sets`` (rep, cluster, shingles), ``total`` rows.

    ``d`` has the shingles that a set adds to or lacks of those that more than half of its cluster
    has; these are at most twice as many as a mean set of the cluster has.  Sets x and y with o
    common differences are near exactly if w(x) + w(y) <= 2 * (100 + percent) * o.
    """
    def shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for cluster, data in zip(batch.column("cluster").to_pylist(),
                                     batch.column("shingles").to_pylist()):
                flat = np.frombuffer(data, np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(flat), cluster)), pa.array(flat)], names=["cluster", "s"])

    def differ(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d, w = [], []
            for data, common in zip(batch.column("shingles").to_pylist(), batch.column("common")):
                own = np.frombuffer(data, np.int64)
                shared = np.empty(0, np.int64) if not common.is_valid else common.values.to_numpy()
                d.append(np.setxor1d(own, shared, assume_unique=True))
                w.append((100 + near.percent) * len(d[-1]) - (100 - near.percent) * len(own))
            yield pa.RecordBatch.from_arrays(
                [batch.column("rep"), batch.column("cluster"), pa.array(d, pa.list_(pa.int64())),
                 pa.array(w, pa.int64())], names=["rep", "cluster", "d", "w"])

    sizes = stored(sets.groupBy("cluster").agg(F.count(F.lit(1)).alias("members")), "near-clusters")
    counts = sets.select("cluster", "shingles").mapInArrow(shingles, "cluster long, s long") \
        .groupBy("cluster", "s").agg(F.count(F.lit(1)).alias("m")).where("m > 1")
    common = with_groups(counts, sizes, ["cluster"], "members", total).where("2 * m > members") \
        .groupBy("cluster").agg(F.collect_list("s").alias("common"))
    common = stored(sizes.join(common, "cluster", "left"), "near-common")
    return stored(with_groups(sets, common, ["cluster"], "members", total)
                  .select("rep", "cluster", "shingles", "common")
                  .mapInArrow(differ, "rep long, cluster long, d array<long>, w long"),
                  "near-differences")


def _placed(differences: DataFrame, total: int) -> DataFrame:
    """``differences`` with the lowest ``w`` of their cluster, ``least``, and its rep, ``star``."""
    best = differences.groupBy("cluster").agg(F.min(F.struct("w", "rep")).alias("best"),
                                              F.count(F.lit(1)).alias("members"))
    best = stored(best.select("cluster", F.col("best.w").alias("least"),
                              F.col("best.rep").alias("star"), "members"), "near-stars")
    return with_groups(differences, best, ["cluster"], "members", total)


def _star_links(placed: DataFrame) -> DataFrame:
    """Links (a, b) that the distances to the majority prove: all of a cluster with its star.

    Two sets with w(x) + w(y) <= 0 are near whatever they share; both are then linked with the star.
    """
    return placed.where("rep <> star AND w + least <= 0") \
        .select(F.col("star").alias("a"), F.col("rep").alias("b"))


def _sharing_pairs(placed: DataFrame, now: DataFrame, near: Near) -> DataFrame:
    """Pairs (a, b) of different components that share a rare difference, once each.

    After the star links a pair that matters has w(x) + w(y) > 0, so it needs common differences.
    ``need`` is the least number for any partner: one outside the star's component if the set
    itself is inside.  Differences are ordered by the number of sets of the cluster that have them;
    two sets with ``need`` in common meet within all but the last ``need - 1`` of each.
    """
    step = 2 * (100 + near.percent)
    partner = F.when(F.col("w") + F.col("least") <= 0, 1 - F.col("least")).otherwise(F.col("least"))
    able = placed.withColumn("need", F.greatest(
        F.lit(1), F.ceil((F.col("w") + partner) / F.lit(step)))).where("need <= size(d)")
    rows = stored(able.select("rep", "cluster", "w", "need", F.explode("d").alias("e")), "near-able")
    often = stored(rows.groupBy("cluster", "e").agg(F.count(F.lit(1)).alias("often"))
                   .where("often > 1"), "near-often")
    of_rep = Window.partitionBy("rep")
    prefix = with_groups(rows, often, ["cluster", "e"], "often", rows.count()) \
        .where("often IS NOT NULL") \
        .withColumn("place", F.row_number().over(of_rep.orderBy("often", "e"))) \
        .withColumn("after", F.count(F.lit(1)).over(of_rep) - F.col("place")) \
        .where("after >= need - 1").select("rep", "cluster", "e", "w", "after")
    known = stored(prefix.join(now.select("rep", "comp", "n", "s1", "s2"), "rep"), "near-prefix")
    # at their first common difference, what follows in both has the rest of what they share
    enough = F.col("x.w") + F.col("y.w") <= step * (1 + F.least("x.after", "y.after"))
    return known.alias("x").join(
        known.alias("y"), (F.col("x.cluster") == F.col("y.cluster")) & (F.col("x.e") == F.col("y.e"))
        & (F.col("x.rep") < F.col("y.rep")) & (F.col("x.comp") != F.col("y.comp")) & enough
        & _may_link("x", "y", near)) \
        .select(F.col("x.rep").alias("a"), F.col("y.rep").alias("b")).distinct()


def near_components(docs: DataFrame, near: Near = QUERY, key: str = "doc_id",
                    text: str = "text") -> DataFrame:
    """Per row of ``docs``: key, n_shingles, component_id and kept."""
    with batches_of(docs.sparkSession, ROWS), tidied(docs.sparkSession) as keep:
        return _near_components(docs, near, key, text, keep)


def _near_components(docs: DataFrame, near: Near, key: str, text: str,
                     keep: Callable[[DataFrame], None]) -> DataFrame:
    documents = _documents(docs, key, text, near)
    classes = stored(
        documents.where("n > 0 AND doc_id IS NOT NULL").groupBy("n", "d1", "d2").agg(
            F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies"),
            *[F.first(c).alias(c) for c in ("a", "b", "s1", "s2")]), "near-classes")
    mates = _mates(classes)
    traits = classes.select("rep", "n", "s1", "s2").join(
        mates.select("rep").distinct(), "rep", "left_semi")
    traits = stored(traits, "near-traits")
    sets = _shingle_table(docs, traits.select("rep"), key, text, near)
    links: DataFrame | None = None
    labels: DataFrame | None = None

    def labelled() -> DataFrame:
        if labels is None:
            return traits.withColumn("comp", F.col("rep"))
        return traits.join(labels.withColumnRenamed("id", "rep"), "rep", "left") \
            .withColumn("comp", F.coalesce("comp", "rep"))

    def linked(pairs: DataFrame) -> bool:
        nonlocal links, labels
        found = stored(pairs, "near-links")
        if found.isEmpty():
            return False
        links = found if links is None else links.unionByName(found)
        labels = components(links)
        return True

    rounds = [stored(mates.select(F.col(f"p{number}").alias("pivot"), "rep")
                     .where("rep <> pivot").distinct(), "near-tried") for number in range(ROUNDS)]
    for tried in rounds:
        now = stored(labelled(), "near-labelled")
        pairs = tried.join(now.alias("y"), "rep") \
            .join(now.select(F.col("rep").alias("pivot"), "n", "s1", "s2", "comp").alias("x"), "pivot") \
            .where((F.col("x.comp") != F.col("y.comp")) & _may_link("x", "y", near)) \
            .select("rep", "pivot", _differing("x", "y").alias("far"))
        nearest = Window.partitionBy("rep").orderBy("far", "pivot")
        pairs = pairs.withColumn("place", F.row_number().over(nearest)).where(f"place <= {MATES}") \
            .select(F.col("pivot").alias("a"), F.col("rep").alias("b"))
        if not linked(_confirmed(pairs, sets, near)):
            break
    now = stored(labelled(), "near-labelled")
    # a bucket is in several components if one of it is not in that of its mate
    comps = now.select("rep", "comp")
    apart = rounds[0].join(comps, "rep").join(
        comps.select(F.col("rep").alias("pivot"), F.col("comp").alias("other")), "pivot") \
        .where("comp <> other").select(F.col("pivot").alias("p0"), "rep")
    keys = mates.join(stored(apart, "near-apart"), ["p0", "rep"], "left_semi").select("key").distinct()
    mixed = stored(mates.select("key", "rep").join(stored(keys, "near-keys"), "key", "left_semi"),
                   "near-mixed")
    lone = _lone_shingles(sets.join(mixed.select("rep").distinct(), "rep", "left_semi"))
    able = now.join(lone, "rep", "left").withColumn("lone", F.coalesce("lone", F.lit(0))) \
        .where(100 * (F.col("n") - F.col("lone")) >= near.percent * F.col("n"))
    known = stored(mixed.join(able.select("rep", "comp"), "rep"), "near-known")
    mixed = known.groupBy("key").agg(F.min("comp").alias("low"), F.max("comp").alias("high")) \
        .where("low < high").select("key")
    clusters = _clusters(stored(known.join(mixed, "key", "left_semi").select("key", "rep"),
                                "near-buckets"))
    grouped = stored(sets.join(clusters, "rep"), "near-grouped")
    total = grouped.count()
    if total:
        placed = stored(_placed(_differences(grouped, total, near), total), "near-placed")
        linked(_star_links(placed))
        now = stored(labelled(), "near-labelled")
        linked(_confirmed(_sharing_pairs(placed, now, near), sets, near))

    for table in (documents, classes, labels):
        keep(table)
    if labels is not None:
        classes = classes.join(labels.withColumnRenamed("id", "rep"), "rep", "left")
    else:
        classes = classes.withColumn("comp", F.col("rep"))
    groups = classes.select("n", "d1", "d2", "copies", F.coalesce("comp", "rep").alias("comp"))
    found = with_groups(documents.select("doc_id", "n", "d1", "d2"), groups, ["n", "d1", "d2"],
                        "copies", documents.count())
    alone = (F.col("n") == 0) | F.col("doc_id").isNull()
    return found.select(
        F.col("doc_id").alias(key), F.col("n").cast("long").alias("n_shingles"),
        F.when(alone, F.col("doc_id")).otherwise(F.col("comp")).alias("component_id"),
        (alone | (F.col("comp") == F.col("doc_id"))).alias("kept"))


def keep_first(docs: DataFrame, near: Near = STAGE, key: str = "doc_id",
               text: str = "text") -> DataFrame:
    """``docs`` with one document of each component; columns stay as they are.

    Ids may be null or repeated here: a document is told by the 64-bit hash of its id and text.
    The smallest id stays, a null id only where all are null.  Rows that repeat the id and the
    text of another stay with it, if the id is not null; of null ids one row stays.
    """
    with tidied(docs.sparkSession) as keep:
        return _keep_first(docs, near, key, text, keep)


def _keep_first(docs: DataFrame, near: Near, key: str, text: str,
                keep: Callable[[DataFrame], None]) -> DataFrame:
    mark = F.xxhash64(F.col(key), whole_text(text))
    rows = docs.select(mark.alias("mark"), F.col(key).alias("id"), whole_text(text).alias("t"))
    marks = stored(rows.select("mark", "id", F.col("t").rlike(_WORD).alias("full"))
                   .groupBy("mark").agg(F.min("id").alias("id"), F.first("full").alias("full"),
                                        F.count(F.lit(1)).alias("rows")), "near-marks")
    total = marks.agg(F.sum("rows")).first()[0] or 0
    # each document once: the texts of repeated rows are merged in the map tasks
    again = stored(marks.where("full AND rows > 1").select("mark", "rows"), "near-again")
    once = rows.select("mark", "t")
    if not again.isEmpty():
        first = without_rows(once, again, total, {"mark": F.col("mark")})
        repeated = with_groups(once, again, ["mark"], "rows", total).where("rows IS NOT NULL") \
            .groupBy("mark").agg(F.min("t").alias("t"))
        once = first.unionByName(repeated)
    found = near_components(once, near, "mark", "t").where("n_shingles > 0") \
        .select("mark", F.col("component_id").alias("component"))
    members = stored(found.join(marks, "mark"), "near-members")
    best = members.groupBy("component").agg(
        F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "mark")).alias("best"),
        F.count(F.lit(1)).alias("size")).where("size > 1") \
        .select("component", F.col("best.mark").alias("best"), "size")
    gone = with_groups(members, stored(best, "near-best"), ["component"], "size", total) \
        .where("mark <> best").select("mark", "rows")
    gone = stored(gone, "near-gone")
    keep(gone)
    left = without_rows(docs, gone, total, {"mark": mark})
    # of documents without an id that are equal in text, one row
    twins = members.where("id IS NULL AND rows > 1").select("mark", "rows")
    if twins.isEmpty():
        return left
    keep(members)
    names = docs.columns
    pairs = with_groups(left.select(mark.alias("mark"), F.struct(*names).alias("row")), twins,
                        ["mark"], "rows", total)
    one = pairs.where("rows IS NOT NULL").groupBy("mark").agg(F.min_by(
        "row", F.xxhash64("row")).alias("row"))
    return pairs.where("rows IS NULL").select("row.*").unionByName(one.select("row.*"))
