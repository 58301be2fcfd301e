"""Near-duplicate detection with a MinHash containment ensemble.

A text lies in one that is not smaller if at least CONTAINMENT of its distinct word shingles occur there, whatever their
sizes. Documents are partitioned by shingle-set size (geometric bounds). For a set of partition p that is looked up in
partition q the containment threshold becomes a Jaccard threshold, from the upper bound of q and the smallest set of p, and
(bands, rows) are tuned for that pair of partitions alone: as many rows as leave a recall of RECALL at the threshold within
HASHES hash functions, from 12 bands for a partition of one size to 36 for one whose sets are up to COPY_RATIO times as large.
Still further apart, the threshold calls for single rows and for more bands than there are shingles: there, a band is a shingle itself. A set of
fewer than SMALL shingles is looked up by its PICKS_SMALL smallest shingle hashes, a larger one by up to PICKS of those below
LIMIT, and least_shared() says how many of them must be found: a recall of 0.97 at the threshold, and 1 for sets of at
most PICKS_SMALL shingles. All candidates are then checked exactly, on the whole shingle sets.

Texts that lie in one at most COPY_RATIO times as large are copies of each other; the classes are the connected parts of
that graph. A text in a still larger one makes a link between the two classes, and joins nothing, since two texts that
quote the same passage aren't copies. Work is by class and not by pair: each document is checked against the one that most
of its buckets have as their smallest; what that leaves is found by the shingles that several classes hold, of which each
set is followed through its rarest only (a set that shares m of k picks shares one of its rarest k - m + 1), with one member
of a class for each shingle, and each text is held against the sets followed where it is read. So a family of n copies costs n checks, and a passage in n texts n links.

Defined results: null texts and texts without words are near copies of nothing; texts with the same shingles are copies of
one another; repeated rows are too. A group's group_id is its smallest doc_id (nulls last). Extra columns are carried
through untouched. An empty table gives an empty result. Very long texts are hashed in blocks and count whole; their sets take
8 bytes a shingle. Sets are known by 64-bit hashes of their shingles, whose chance to collide (2**-64 a pair) is the only
inexact part of the check.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from . import common, textvec

WIDTH = 3
CONTAINMENT = 0.6
COPY_RATIO = 2.0
STEP = 2**0.25
RECALL = 0.9
HASHES = 72
#: Sets below SMALL are looked up by all or PICKS_SMALL of their shingles, larger ones by up to PICKS of the share LIMIT / 2**64.
SMALL, PICKS_SMALL, PICKS, LIMIT = 128, 40, 32, 1 << 61
#: Words of 64 bits in the table of the small sets' shingles: 16 MB, whatever the corpus.
FILTER_WORDS = 1 << 21
#: Members of one task of a hot candidate's checks; more are spread over several tasks.
SPREAD = 2000
#: The recall of the picks that come before a check.
SURE = 0.9999
#: Shingles of the texts that a task holds against one block of sets after the other, and the least bytes of a block.
GATHERED, BLOCK_BYTES = 1 << 21, 1 << 20
#: What a task looks up at once, in shingles or candidates; texts read at once, and about how many of their bytes are hashed at once.
SPAN, TEXTS, CHUNK = 1 << 17, 1 << 10, 1 << 18


def jaccard_threshold(containment: float, upper: int, query: int) -> float:
    """The least Jaccard similarity of a query of that size with a set of at most upper of which it shares containment."""
    return containment / (upper / query + 1 - containment)


@lru_cache(None)
def partition_bounds(p: int) -> tuple[int, int]:
    """Smallest and largest set size of partition p; some small ones hold no size."""
    return math.ceil(round(STEP**p, 9)), math.ceil(round(STEP ** (p + 1), 9)) - 1


@lru_cache(None)
def partition_of(n: int) -> int:
    p = int(math.log(n) / math.log(STEP))
    while partition_bounds(p)[0] > n:
        p -= 1
    while partition_bounds(p + 1)[0] <= n:
        p += 1
    return p


@lru_cache(None)
def banding(p: int, q: int, containment: float, ratio: float, recall: float, hashes: int) -> tuple[int, int]:
    """(bands, rows) for sets of partition p looked up in partition q: the most selective that keep the recall at their threshold."""
    query, upper = partition_bounds(p)[0], partition_bounds(q)[1]
    s = jaccard_threshold(containment, min(upper, max(query, math.floor(query * ratio))), query)
    for rows in range(8, 1, -1):
        bands = math.ceil(math.log(1 - recall) / math.log1p(-(s**rows)))
        if bands * rows <= hashes:
            return bands, rows
    return min(hashes, math.ceil(math.log(1 - recall) / math.log1p(-s))), 1


@lru_cache(None)
def least_shared(k: int, containment: float, recall: float = 0.97) -> int:
    """How many of k sampled shingles a container must hold: the most that a set at the threshold reaches with that probability."""
    below, m = (1 - containment) ** k, 0
    while below <= 1 - recall:
        m += 1
        below += math.comb(k, m) * containment**m * (1 - containment) ** (k - m)
    return max(1, m)


class Settings:
    """The parameters, as they travel to the tasks."""

    def __init__(self, width: int = WIDTH, containment: float = CONTAINMENT, ratio: float = COPY_RATIO, recall: float = RECALL, hashes: int = HASHES):
        self.width, self.containment, self.ratio, self.recall, self.hashes = width, containment, ratio, recall, hashes
        self.known: dict[int, list[tuple[int, int, int]]] = {}  # schemes by partition

    def probes(self, p: int) -> list[int]:
        """The partitions, from p on, that hold sets at most ratio times as large as some set of p."""
        last = partition_of(max(1, int(partition_bounds(p)[1] * self.ratio + 1e-9)))
        return [q for q in range(p, last + 1) if partition_bounds(q)[0] <= partition_bounds(q)[1]]

    def bands(self, p: int, q: int) -> tuple[int, int]:
        return banding(p, q, self.containment, self.ratio, self.recall, self.hashes)

    def schemes(self, n: int) -> list[tuple[int, int, int]]:
        """(tag, bands, rows) of the keys of a set of n shingles, for every partition it is looked up in or found from.

        The bands that fewer rows need in several partitions are the same ones, the first of each being shared.
        """
        own = partition_of(n)
        if own in self.known:
            return self.known[own]
        found: dict[tuple[int, int], int] = {}
        low = partition_of(max(1, math.ceil(partition_bounds(own)[0] / self.ratio - 1e-9)))
        pairs = [(own, q) for q in self.probes(own)] + [(p, own) for p in range(low, own) if partition_bounds(p)[0] <= partition_bounds(p)[1]]
        for p, q in pairs:
            bands, rows = self.bands(p, q)
            tag = own + 1 if p == q and rows > 2 else 0  # many rows only within a partition
            found[tag, rows] = max(bands, found.get((tag, rows), 0))
        self.known[own] = [(tag, bands, rows) for (tag, rows), bands in found.items()]
        return self.known[own]


def _sets(column: pa.Array, width: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    for low in range(0, len(column), TEXTS):
        raw, offsets = textvec.buffers(pc.utf8_lower(column.slice(low, TEXTS)))
        for first, end, data, at in textvec.chunks(raw, offsets, CHUNK):
            yield low + first, low + end, *textvec.shingle_sets(data, at, width)


def _signatures(sets: np.ndarray, at: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """Minimum of each hash function over each document's set; empty sets must have been left out."""
    out = np.empty((len(seeds), len(at) - 1), np.uint64)
    room = np.empty_like(sets)
    for k, seed in enumerate(seeds):
        np.bitwise_xor(sets, seed, out=room)
        np.multiply(room, np.uint64(0xD1342543DE82EF95) + (seed << np.uint64(1)), out=room)
        np.minimum.reduceat(room, at[:-1], out=out[k])
    return out.T.copy()


def _fresh_sets(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, list[int], list[np.ndarray]]]:
    """(rows with words, their set numbers and sizes, places of the sets that this task hasn't seen, those sets) of each run of documents."""
    seen: set[int] = set()
    for batch in batches:
        for first, end, sets, at in _sets(batch.column("text"), width):
            count = np.diff(at)
            full = np.flatnonzero(count)
            if not len(full):
                continue
            nid = textvec.mix(np.add.reduceat(sets, at[:-1][full]) + count[full].astype(np.uint64))
            fresh = []
            for i, x in enumerate(nid.tolist()):
                if x not in seen:
                    seen.add(x)
                    fresh.append(i)
            yield batch.slice(first, end - first).take(pa.array(full)), nid, count[full], fresh, [sets[at[full[i]] : at[full[i] + 1]] for i in fresh]


def _lists(parts: list[np.ndarray]) -> pa.Array:
    return textvec.long_lists(np.concatenate([np.zeros(0, np.uint64), *parts]), np.r_[0, np.cumsum([len(x) for x in parts])])


def _sketch(setting: Settings):
    """(doc_id, h, nid, n, keys, small): the band keys of each set and the shingles of a small one that LIMIT leaves out; nothing again for a set seen before."""
    seeds = textvec.mix(np.arange(1, setting.hashes + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))

    def keys_of(signature: np.ndarray, n: int) -> np.ndarray:
        found = []
        for tag, bands, rows in setting.schemes(n):
            part = signature[: bands * rows].reshape(bands, rows)
            key = np.full(bands, np.uint64(tag * 16 + rows) * np.uint64(0xA0761D6478BD642F)) + np.arange(bands, dtype=np.uint64)
            for r in range(rows):
                key = textvec.mix((key ^ part[:, r]) * np.uint64(0xE7037ED1A0B428DB))
            found.append(key)
        return np.concatenate(found)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = np.zeros(0, np.uint64)
        with np.errstate(over="ignore"):
            for rows, nid, count, fresh, sets in _fresh_sets(batches, setting.width):
                keys, small = [none] * len(nid), [none] * len(nid)
                if fresh:
                    sizes = [len(s) for s in sets]
                    for i, s, signature in zip(fresh, sets, _signatures(np.concatenate(sets), np.r_[0, np.cumsum(sizes)], seeds)):
                        keys[i] = keys_of(signature, len(s))
                        if len(s) < SMALL:
                            small[i] = s[:PICKS_SMALL][s[:PICKS_SMALL] >= LIMIT]
                yield pa.RecordBatch.from_arrays([rows.column("doc_id"), rows.column("h"), pa.array(nid.view(np.int64)), pa.array(count.astype(np.int32)), _lists(keys), _lists(small)], ["doc_id", "h", "nid", "n", "keys", "small"])

    return run


def _in_table(values: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Which values a table of bits lets pass: all that it was made of, and some more."""
    parts = [values[i : i + SPAN] for i in range(0, len(values), SPAN)] or [values]
    word = np.uint64(len(table) - 1)
    return np.concatenate([(table[(x & word).astype(np.int64)] >> ((x >> np.uint64(21)) & np.uint64(63))) & np.uint64(1) > 0 for x in parts])


def _spreader(setting: Settings, known):
    """(nid, n, k, keys) of each set: k picks to look it up by, then all its other shingles below LIMIT or in the small sets' table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = known.value
        for _, nid, _, fresh, sets in _fresh_sets(batches, setting.width):
            keys, counts = [], []
            for s in sets:
                low = int(np.searchsorted(s, np.uint64(LIMIT)))
                k = min(PICKS_SMALL, len(s)) if len(s) < SMALL else min(PICKS, low)
                rest = s[max(k, low) :]
                hit = rest[_in_table(rest, table)]
                keys.append(np.concatenate([s[: max(k, low)], hit]))
                counts.append(k)
            if fresh:
                yield pa.RecordBatch.from_arrays([pa.array(nid[fresh].view(np.int64)), pa.array([len(s) for s in sets], pa.int32()), pa.array(counts, pa.int32()), _lists(keys)], ["nid", "n", "k", "keys"])

    return run


def _set_reader(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            rows = []
            for i, x in enumerate(batch.column("nid").to_pylist()):  # repeated rows give one set a task
                if x not in seen:
                    seen.add(x)
                    rows.append(i)
            batch = batch.take(pa.array(rows, pa.int64()))
            for first, end, sets, at in _sets(batch.column("text"), width):
                yield pa.RecordBatch.from_arrays([batch.column("nid").slice(first, end - first), textvec.blobs(sets, at).cast(pa.binary())], ["nid", "shingles"])

    return run


def _checker(setting: Settings):
    """Over rows sorted by (b, part, role): the set of b, then the sets to hold against it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        target, pivot = None, None
        for batch in batches:
            out: list[tuple[int, int, int, int]] = []
            for b, part, role, a, raw in zip(*(batch.column(c).to_pylist() for c in ("b", "part", "role", "a")), batch.column("shingles")):
                own = np.frombuffer(raw.as_buffer(), np.uint64)
                if role == 0:
                    target, pivot = (b, part), own.copy()
                elif target == (b, part):
                    few, many = (own, pivot) if len(own) <= len(pivot) else (pivot, own)
                    found = many[np.minimum(np.searchsorted(many, few), len(many) - 1)] == few
                    if np.count_nonzero(found) >= setting.containment * len(few) - 1e-9:
                        out.append((a, b, len(own), len(pivot)))
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*out)) or [()] * 4, kinds)], ["a", "b", "na", "nb"])

    return run


def _blocks(size: int) -> int:
    """Into how many blocks so many bytes are dealt, each of which fits a broadcast."""
    return max(1, math.ceil(size / max(common.BROADCAST_BYTES, BLOCK_BYTES)))


def _block(column: str, blocks: int) -> Column:
    return F.pmod(F.xxhash64(column), F.lit(blocks)).cast("int")


def _verify(pairs: DataFrame, docs: DataFrame, members: DataFrame, setting: Settings) -> DataFrame:
    """Those of the pairs (a, b) of which one lies in the other, with their sizes; b should be what many pairs have, or the larger."""
    with common.Scratch(docs.sparkSession) as scratch:
        parts = common.settle(pairs.groupBy("b").agg(F.ceil(F.count(F.lit(1)) / F.lit(SPREAD)).cast("int").alias("parts")), "parts")
        follow = pairs.join(parts, "b").select("a", "b", F.pmod(F.xxhash64("a"), F.col("parts")).cast("int").alias("part"), F.lit(1).alias("role"))
        heads = parts.select(F.col("b").alias("a"), "b", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(0).alias("role"))
        wanted = common.settle(follow.unionByName(heads).withColumn("nid", F.col("a")), "wanted")
        rows = _read_sets(docs, members, wanted, setting).select("b", "part", "role", "a", "shingles")
        n = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        rows = rows.repartition(n, "b", "part").sortWithinPartitions("b", "part", "role")
        return scratch.keep(common.settle(rows.mapInArrow(_checker(setting), "a long, b long, na int, nb int"), "edges"))


def components(edges: DataFrame) -> DataFrame:
    """(v, label): for every end of an edge (a, b) the smallest node of its connected part; links shorten by pointer jumps."""
    both = common.settle(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "links")
    labels = common.settle(both.groupBy(F.col("a").alias("v")).agg(F.least(F.min("b"), F.first("a")).alias("label")), "labels")
    while True:
        near = both.join(labels.select(F.col("v").alias("b"), "label"), "b").groupBy("a").agg(F.min("label").alias("near"))
        low = labels.join(near, labels.v == near.a).select("v", F.col("label").alias("old"), F.least("label", "near").alias("low"))
        low = common.settle(low, "low")
        jump = low.select(F.col("v").alias("u"), F.col("low").alias("far"))
        seen = Observation()
        labels = low.join(jump, low.low == jump.u).select("v", F.col("far").alias("label"), "old")
        labels = labels.observe(seen, F.count(F.when(F.col("label") != F.col("old"), 1)).alias("moved"))
        labels = common.settle(labels, "labels").select("v", "label")
        if not seen.get["moved"]:
            return labels


def _label(df: DataFrame, labels: DataFrame, column: str, out: str) -> DataFrame:
    side = common.maybe_broadcast(labels.select(F.col("v").alias(column), F.col("label").alias("_l")), 48)
    return df.join(side, column, "left").withColumn(out, F.coalesce("_l", column)).drop("_l")


def _read_sets(docs: DataFrame, members: DataFrame, wanted: DataFrame, setting: Settings) -> DataFrame:
    """The rows wanted (nid and others, settled) with their shingles, each set being read from one document that has it.

    No text is shuffled: what is wanted is dealt out by nid to blocks that fit a broadcast, which are read one after the other.
    """
    reps = members.join(wanted, "nid", "left_semi").groupBy("nid").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "h")).alias("r"))
    reps = common.settle(reps.select("nid", F.col("r.doc_id").alias("r_doc"), F.col("r.h").alias("r_h")), "reps")
    blocks = _blocks(64 * max(reps.count(), wanted.count()))
    out = None
    for i in range(blocks):
        own, rows = (F.broadcast(x.filter(_block("nid", blocks) == i)) for x in (reps, wanted))
        texts = docs.join(own, docs.h.eqNullSafe(F.col("r_h")) & docs.doc_id.eqNullSafe(F.col("r_doc"))).select("nid", "text")
        read = texts.mapInArrow(_set_reader(setting.width), "nid long, shingles binary").join(rows, "nid")
        read = read if blocks == 1 else common.settle(read, "sets", "lz4")
        out = out.unionByName(read) if out else read
    return out


def _several(rows: DataFrame, what: str, *more: Column) -> DataFrame:
    """The keys under which several different values of a column stand; found by partial aggregates, as a key may be hot."""
    found = rows.groupBy("key").agg(F.min(what).alias("lo"), F.max(what).alias("hi"), *more)
    return found.filter("lo != hi")


def _bucket_pairs(sketches: DataFrame) -> DataFrame:
    """(a, b): each set that shares band keys, with the set that most of its buckets have as their smallest."""
    rows = sketches.select("nid", F.explode("keys").alias("key"))
    pivots = common.settle(_several(rows, "nid").select("key", F.col("lo").alias("pivot")), "pivots")
    met = rows.join(common.maybe_broadcast(pivots, 64), "key").filter("nid != pivot")
    met = met.groupBy("nid", "pivot").agg(F.count(F.lit(1)).alias("c"))
    best = met.groupBy(F.col("nid").alias("a")).agg(F.max(F.struct("c", (-F.col("pivot")).alias("p"))).alias("best"))
    return common.settle(best.select("a", (-F.col("best.p")).alias("b")), "pairs")


def _filter_table(sketches: DataFrame):
    """The small sets' shingles as a broadcast table of bits, of the same size for every corpus."""
    spark, key = sketches.sparkSession, F.col("key")
    bits = sketches.select(F.explode("small").alias("key")).select(key.bitwiseAND(F.lit(FILTER_WORDS - 1)).alias("word"), F.shiftright(key, 21).bitwiseAND(F.lit(63)).cast("int").alias("bit"))
    bits = bits.groupBy("word").agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("bit"))).alias("bits")).toArrow()  # at most FILTER_WORDS rows
    table = np.zeros(FILTER_WORDS, np.uint64)
    table[bits["word"].to_numpy()] = bits["bits"].to_numpy().view(np.uint64)
    return spark.sparkContext.broadcast(table)


def _class_hits(docs: DataFrame, sketches: DataFrame, labels: DataFrame, setting: Settings) -> DataFrame:
    """(key, nid, n, k, label, pick, df): the picks, and other shingles of small sets, that several classes hold."""
    with common.Scratch(docs.sparkSession) as scratch:
        known = _filter_table(sketches)
        spread = common.settle(docs.mapInArrow(_spreader(setting, known), "nid long, n int, k int, keys array<long>"), "spread", "lz4")
        spread = _label(spread, labels, "nid", "label").select("nid", "n", "k", "label", F.posexplode("keys").alias("at", "key"))
        shared = common.settle(_several(spread, "label", F.count(F.lit(1)).alias("df")).select("key", "df"), "shared")
        pick = F.col("at") < F.col("k")
        hits = spread.filter(pick | (F.col("n") < SMALL)).join(common.maybe_broadcast(shared, 48), "key").select("key", "nid", "n", "k", "label", pick.alias("pick"), "df")
        return scratch.keep(common.settle(hits, "hits"))


def _need(setting: Settings, recall: float = 0.97) -> Column:
    """How many of the k picks of a set of n shingles a container must hold."""
    table = F.array(*[F.lit(least_shared(k, setting.containment, recall)) for k in range(1, PICKS_SMALL + 1)])
    return F.when(F.col("k") == F.col("n"), F.ceil(F.col("n") * setting.containment - 1e-9)).otherwise(F.get(table, F.col("k") - 1)).cast("int")


def _octave_pairs(hits: DataFrame, setting: Settings) -> DataFrame:
    """(a, b): each small set with the set of another class, of about its size, that most of its shared shingles have as their first.

    Copies that have lost each other in the buckets so meet before each of them is looked up in all that they lie in.
    Larger sets lie in few others, so those meet in _class_edges.
    """
    size = F.log2("n")
    rows = hits.filter(F.col("n") < SMALL).select("key", "nid", "label", _need(setting).alias("m"), F.explode(F.array(F.floor(size) * 2, F.floor(size + 0.5) * 2 + 1)).alias("octave"))
    first = rows.groupBy("key", "octave").agg(F.min(F.struct("label", "nid", "m")).alias("first"), F.max("label").alias("hi")).filter("first.label != hi")
    first = common.settle(first.select("key", "octave", F.col("first.nid").alias("b"), F.col("first.label").alias("lb"), F.col("first.m").alias("mb")), "firsts")
    met = rows.join(common.maybe_broadcast(first, 96), ["key", "octave"]).filter("label != lb")
    met = met.groupBy(F.col("nid").alias("a"), "b", "octave").agg(F.count(F.lit(1)).alias("c"), F.least(F.first("m"), F.first("mb")).alias("m")).filter("c >= m")
    best = met.groupBy("a").agg(F.max(F.struct("c", "b")).alias("best")).select("a", F.col("best.b").alias("b"))
    return common.settle(best, "pairs")


def _asks(hits: DataFrame, setting: Settings) -> tuple[DataFrame, DataFrame]:
    """((key, nid, label): the rarest shared shingles of each class, each with its smallest set that is followed through it; (nid, n, label, least, whole, picks) of those sets).

    least says how many of the picks a container must hold: all that the containment asks for where the set is known whole,
    else as many as all but one in ten thousand hold.
    """
    sets = hits.filter("pick").groupBy("nid", "n", "k", "label").agg(F.sort_array(F.collect_set(F.struct("df", "key"))).alias("picks"))  # at most PICKS_SMALL
    sets = common.settle(sets.withColumn("m", _need(setting)).filter(F.size("picks") >= F.col("m")), "picks")
    asks = sets.select("nid", "n", "label", F.explode(F.slice("picks", 1, F.size("picks") - F.col("m") + 1)).alias("x"))
    asks = asks.groupBy(F.col("x.key").alias("key"), "label").agg(F.min(F.struct("n", "nid")).alias("a"))
    asks = common.settle(asks.select("key", "a.nid", "label"), "asks")
    ends = sets.join(asks, "nid", "left_semi").select("nid", "n", "label", _need(setting, SURE).alias("least"), (F.col("k") == F.col("n")).alias("whole"), "picks.key")
    return asks, common.settle(ends.withColumnRenamed("key", "picks"), "ends")


def _container(setting: Settings, blocks, known):
    """(a, b, na, nb, whole, la): each set b of the texts read, with all sets a, of class la, that are followed through one of its shingles and of which it holds enough picks.

    A task holds one block at a time, and what it has gathered of the texts against each of them: the shingles that known lets pass.
    """

    def lie_in(block, nids_b: np.ndarray, size_b: np.ndarray, values: np.ndarray, at_b: np.ndarray) -> Iterator[np.ndarray]:
        keys, starts, asks, nids, labels, sizes, least, whole, at, picks = block
        width = max(1 << 16, min(1 << 23, 1 << (16 * len(keys)).bit_length()))
        known = np.zeros(width, bool)
        known[(keys & np.uint64(width - 1)).astype(np.int64)] = True
        met = [np.flatnonzero(known[(values[i : i + SPAN] & np.uint64(width - 1)).astype(np.int64)]) + i for i in range(0, len(values), SPAN)]
        met = np.concatenate(met)
        place = np.searchsorted(keys, values[met])
        same = keys[np.minimum(place, len(keys) - 1)] == values[met]
        met, place = met[same], place[same]
        owner = np.searchsorted(at_b, met, "right") - 1
        count = np.diff(at)
        for low, high in _spans(owner, starts[place + 1] - starts[place]):
            many = starts[place[low:high] + 1] - starts[place[low:high]]
            pair = np.unique(np.repeat(owner[low:high], many) * len(nids) + _gather(asks, starts[place[low:high]], starts[place[low:high] + 1]))
            b, a = pair // len(nids), pair % len(nids)
            keep = (sizes[a] < size_b[b]) | (sizes[a] == size_b[b]) & (nids[a] < nids_b[b])
            b, a = b[keep], a[keep]
            ok = np.zeros(len(a), bool)
            for first, end in _spans(b, count[a]):
                x, y = a[first:end], b[first:end]
                times = count[x]
                held = _holds(values, np.repeat(at_b[y], times), np.repeat(at_b[y + 1], times), _gather(picks, at[x], at[x + 1]))
                ok[first:end] = np.add.reduceat(held.astype(np.int64), np.r_[0, np.cumsum(times)[:-1]]) >= least[x]
            x, y = a[ok], b[ok]
            far = (whole[x] > 0) & (np.maximum(sizes[x], size_b[y]) > np.minimum(sizes[x], size_b[y]) * setting.ratio + 1e-9)
            once = ~far
            once[np.flatnonzero(far)[np.unique(np.stack([y[far], labels[x[far]]]), axis=1, return_index=True)[1]]] = True  # of a class, one set for each text far larger
            x, y = x[once], y[once]
            yield np.stack([nids[x].view(np.int64), nids_b[y].view(np.int64), sizes[x], size_b[y], whole[x], labels[x]])

    def against(nids: list[np.ndarray], sizes: list[np.ndarray], sets: list[np.ndarray], counts: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        own, size, values, at = np.concatenate(nids), np.concatenate(sizes), np.concatenate(sets), np.r_[0, np.cumsum(np.concatenate(counts))]
        for block in blocks:
            for a, b, na, nb, whole, la in lie_in(block.value, own, size, values, at):
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(na.astype(np.int32)), pa.array(nb.astype(np.int32)), pa.array(whole > 0), pa.array(la)], ["a", "b", "na", "nb", "whole", "la"])
            if len(blocks) > 1:
                block.__dict__.pop("_value", None)  # read again from this machine's copy when it is next wanted

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, room = known.value, 0
        held: tuple[list[np.ndarray], ...] = ([], [], [], [])
        for _, nid, count, fresh, some in _fresh_sets(batches, setting.width):
            if not fresh:
                continue
            values = np.concatenate(some)
            passed = _in_table(values, table)
            counts = np.add.reduceat(passed.astype(np.int64), np.r_[0, np.cumsum(count[fresh])[:-1]])
            for part, x in zip(held, (nid[fresh][counts > 0], count[fresh][counts > 0], values[passed], counts[counts > 0])):
                part.append(x)
            room += len(held[2][-1])
            if room >= GATHERED:
                yield from against(*held)
                held, room = ([], [], [], []), 0
        if room:
            yield from against(*held)

    return run


def _spans(owner: np.ndarray, weight: np.ndarray) -> Iterator[tuple[int, int]]:
    """Spans of rows of about SPAN in weight together, that part no owner's rows; owners stand in order."""
    total, first = np.cumsum(weight), 0
    while first < len(owner):
        end = int(np.searchsorted(total, (total[first - 1] if first else 0) + SPAN, "right"))
        end = int(np.searchsorted(owner, owner[min(max(end, first + 1), len(owner)) - 1], "right"))
        yield first, end
        first = end


def _holds(values: np.ndarray, low: np.ndarray, high: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Whether each value wanted is in its own sorted span values[low:high], which isn't empty."""
    end = high - 1
    for _ in range(int((high - low).max()).bit_length()):
        mid = (low + high) >> 1
        less = values[np.minimum(mid, end)] < wanted
        less &= low < high
        low, high = np.where(less, mid + 1, low), np.where(less, high, np.maximum(mid, low))
    return values[np.minimum(low, end)] == wanted


def _gather(values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """values[start:end] of all the spans, one after the other."""
    n = end - start
    return values[np.repeat(start - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())]


def _class_edges(docs: DataFrame, members: DataFrame, hits: DataFrame, labels: DataFrame, setting: Settings, far: list[DataFrame]) -> DataFrame:
    """(a, b, na, nb): sets of a class that lie in sets of others, but for those added to far.

    Each text is held against the sets followed where it is read: first against their picks, then, for those of which some
    text holds enough and that aren't known whole by their picks, against all their shingles.
    """
    asks, ends = _asks(hits, setting)
    found = _follow(docs, asks, ends, labels, setting, far)
    wanted = common.settle(found.filter("not whole").select(F.col("a").alias("nid"), F.col("na").alias("n"), F.col("la").alias("label")).distinct(), "wanted")
    edges = found.filter("whole")
    if not wanted.isEmpty():
        sets = _read_sets(docs, members, wanted, setting).select("nid", "n", "label", F.ceil(F.col("n") * setting.containment - 1e-9).cast("int").alias("least"), F.lit(True).alias("whole"), F.col("shingles").alias("picks"))
        sets = common.settle(sets, "read", "lz4")
        edges = edges.unionByName(_follow(docs, common.settle(asks.join(wanted, "nid", "left_semi"), "asks"), sets, labels, setting))
    return edges.drop("whole", "la")


def _near(setting: Settings) -> Column:
    return F.greatest("na", "nb") <= F.least("na", "nb") * F.lit(setting.ratio) + 1e-9


def _follow(docs: DataFrame, asks: DataFrame, ends: DataFrame, labels: DataFrame, setting: Settings, far: list[DataFrame] | None = None) -> DataFrame:
    """(a, b, na, nb, whole, la): the sets asked for, with all sets of other classes that hold enough of their picks.

    Of two classes one such pair is given that are copies and one that aren't, and one pair of each set not known whole, since
    the pairs grow much faster than the classes linked and the sets to look at again, which are all that is made of them.

    Those that only link a class to a text that is the first of its class, or alone in it, aren't shuffled: they are added to far, as (la, b, nb), each
    once for each row of b.

    The sets are dealt out by class to blocks that fit a broadcast by their counted size. Each block meets every text, so that their
    number makes no difference to what is found.
    """
    bytes_ = F.octet_length("picks") if dict(ends.dtypes)["picks"] == "binary" else F.size("picks") * 8
    size = ends.agg(F.coalesce(F.sum(bytes_ + 48), F.lit(0)).alias("s")).first().s + 24 * asks.count()
    blocks, table = _blocks(size), np.zeros(min(FILTER_WORDS, max(1 << 10, 1 << (size // 16).bit_length())), np.uint64)
    held = [x for i in range(blocks) if (x := _held(asks.filter(_block("label", blocks) == i), ends.filter(_block("label", blocks) == i), table))]
    kinds = "a long, b long, na int, nb int, whole boolean, la long"
    if not held:
        return docs.sparkSession.createDataFrame([], kinds)
    known = docs.sparkSession.sparkContext.broadcast(table)
    found = common.settle(docs.mapInArrow(_container(setting, held, known), kinds), "found")
    for block in [*held, known]:
        block.destroy()
    found = _label(found, labels, "b", "lb").filter("la != lb")
    if far is not None:
        apart = F.col("whole") & ~_near(setting) & (F.col("lb") == F.col("b"))
        far.append(found.filter(apart).select("la", "b", "nb"))
        found = found.filter(~apart)
    pairs = found.groupBy("la", "whole", F.when(~F.col("whole"), F.col("a")).alias("own"), *[F.when(F.col("whole"), x).alias(k) for k, x in (("lb", F.col("lb")), ("near", _near(setting)))])
    pairs = pairs.agg(*[F.first(c).alias(c) for c in ("a", "b", "na", "nb")])  # all from one row
    return common.settle(pairs.select("a", "b", "na", "nb", "whole", "la"), "found")


def _held(asks: DataFrame, ends: DataFrame, table: np.ndarray):
    """A broadcast block of sets followed: (keys, their spans in asks, places of the sets asked for, then by set: nids, labels, sizes, least, whole, spans in picks, picks).

    Its keys and picks are added to the table of bits.
    """
    sets, rows = ends.toArrow(), asks.select("key", "nid").toArrow()
    if not rows.num_rows:
        return None
    nids, first = np.unique(sets["nid"].to_numpy(), return_index=True)  # repeated rows give a set twice
    sets = sets.take(pa.array(first))
    own = [np.frombuffer(x.as_buffer(), np.uint64) if pa.types.is_binary(x.type) or pa.types.is_large_binary(x.type) else x.values.to_numpy().view(np.uint64) for x in sets["picks"]]
    at = np.r_[0, np.cumsum([len(x) for x in own])].astype(np.int64)
    key, ask = rows["key"].to_numpy().view(np.uint64), np.searchsorted(nids, rows["nid"].to_numpy())
    order = np.argsort(key, kind="stable")
    keys, starts = np.unique(key[order], return_index=True)
    label, n, least, whole = (sets[c].cast(pa.int64()).to_numpy() for c in ("label", "n", "least", "whole"))
    picks = np.concatenate(own)
    for x in (keys, picks):
        np.bitwise_or.at(table, (x & np.uint64(len(table) - 1)).astype(np.int64), np.uint64(1) << ((x >> np.uint64(21)) & np.uint64(63)))
    return asks.sparkSession.sparkContext.broadcast((keys, np.r_[starts, len(key)], ask[order], nids.view(np.uint64), label, n, least, whole, at, picks))


def _far_links(far: DataFrame, links: DataFrame, members: DataFrame, before: DataFrame, labels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(links with those of far that must be made distinct, the rest of far as (small, large, n), distinct as they are).

    The rest are those whose text is the only row of its class, and whose class is none of several that became one: such a
    text is read once and meets all sets of a class at once. Those that are links already are left out.
    """
    several = members.groupBy("nid").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select("nid").union(labels.select("v")).distinct()
    several = common.maybe_broadcast(common.settle(several.select(F.col("nid").alias("b"), F.lit(True).alias("several")), "several"), 48)
    was = labels.join(before.select("v", F.col("label").alias("old")), "v", "left").select("label", F.coalesce("old", "v").alias("la"))
    became = was.groupBy("label").agg(F.min("la").alias("lo"), F.max("la").alias("hi")).filter("lo != hi")
    became = common.settle(was.join(became, "label", "left_semi").select("la", F.lit(True).alias("became")).distinct(), "became")
    rows = far.join(several, "b", "left").join(common.maybe_broadcast(became, 48), "la", "left")
    odd = F.col("several").isNotNull() | F.col("became").isNotNull()
    more = _label(_label(rows.filter(odd).select("la", "b"), labels, "la", "small"), labels, "b", "large").filter("small != large").select("small", "large")
    links = common.settle(links.union(more).distinct(), "links")
    plain = rows.filter(~odd).select(F.col("la").alias("small"), F.col("b").alias("large"), F.col("nb").alias("n"))
    return links, plain.join(common.maybe_broadcast(links, 64), ["small", "large"], "left_anti")


def _classes(docs: DataFrame, setting: Settings) -> tuple[DataFrame, DataFrame, DataFrame]:
    """((doc_id, h, nid, n, label) of every document that has words, (small, large) labels of classes linked, (small, large, n) of the other links, to single texts)."""
    docs = common.need(docs, "doc_id", "text").filter(F.col("text").isNotNull()).select("doc_id", F.xxhash64("text").alias("h"), "text")
    sketches = docs.mapInArrow(_sketch(setting), "doc_id long, h long, nid long, n int, keys array<long>, small array<long>")
    sketches = common.settle(sketches, "sketches", "lz4")
    members = sketches.select("doc_id", "h", "nid", "n")
    near = _near(setting)

    edges = _verify(_bucket_pairs(sketches), docs, members, setting)
    common.release(docs.sparkSession)
    labels = components(edges.filter(near))
    hits = _class_hits(docs, sketches, labels, setting)
    common.release(docs.sparkSession)
    more = _verify(_octave_pairs(hits, setting), docs, members, setting)
    if not more.filter(near).isEmpty():
        edges = edges.unionByName(more)
        labels = components(edges.filter(near))
        hits = _label(hits.drop("label"), labels, "nid", "label")
    common.release(docs.sparkSession)
    far, before = [], labels
    more = _class_edges(docs, members, hits, labels, setting, far)
    edges = edges.unionByName(more)
    if not more.filter(near).isEmpty():
        labels = components(edges.filter(near))
    links = edges.filter(~near).select(F.when(F.col("na") < F.col("nb"), F.col("a")).otherwise(F.col("b")).alias("x"), F.when(F.col("na") < F.col("nb"), F.col("b")).otherwise(F.col("a")).alias("y"))
    links = _label(_label(links, labels, "x", "small"), labels, "y", "large").filter("small != large").select("small", "large")
    far = far[0] if far else docs.sparkSession.createDataFrame([], "la long, b long, nb int")
    return common.settle(_label(members, labels, "nid", "label"), "members"), *_far_links(far, links, members, before, labels)


def _gathered(docs: DataFrame, setting: Settings, listed: bool) -> tuple[DataFrame, DataFrame | None, DataFrame]:
    """((doc_id, h, label, group_id, copies, links) of the documents that have copies or lie in larger ones, links if they are to be listed, (label) of the groups that lie in larger ones).

    Links to single texts are by far the most and grow faster than the input; they are counted where they stand.
    """
    with common.Scratch(docs.sparkSession) as scratch:
        members, links, plain = _classes(docs, setting)
        far = common.settle(plain.groupBy(F.col("small").alias("label")).agg(F.count(F.lit(1)).alias("far"), F.max(F.struct("n", F.col("large").alias("label"))).alias("top")), "far")
        groups = members.groupBy("label").agg(F.min("doc_id").alias("group_id"), F.count(F.lit(1)).alias("copies"))
        groups = groups.join(links.groupBy(F.col("small").alias("label")).agg(F.count(F.lit(1)).alias("links")), "label", "left").join(far, "label", "left")
        groups = groups.withColumn("links", F.coalesce("links", F.lit(0)) + F.coalesce("far", F.lit(0))).drop("far", "top")
        groups = common.settle(groups.filter("copies > 1 or links > 0"), "groups")
        found = members.join(groups, "label").select("doc_id", "h", "label", "group_id", "copies", "links")

        def named(links: DataFrame) -> DataFrame:
            ends = links.select(F.col("small").alias("label")).union(links.select("large")).distinct()
            ends = common.settle(members.join(ends, "label", "left_semi").groupBy("label").agg(F.min("doc_id").alias("id"), F.max("n").alias("n")), "named")
            return links.join(ends.toDF("small", "small_id", "small_n"), "small").join(ends.toDF("large", "large_id", "large_n"), "large")

        inside = named(links).filter(F.struct("small_n", "small") < F.struct("large_n", "large")).select(F.col("small").alias("label"))
        own = members.groupBy("label").agg(F.max("n").alias("n")).join(far, "label")
        inside = inside.union(own.filter(F.struct("n", "label") < F.col("top")).select("label")).distinct()
        pairs = scratch.keep(common.settle(named(links.union(plain.select("small", "large"))), "pairs")) if listed else None
        return scratch.keep(common.settle(found, "found")), pairs, scratch.keep(common.settle(inside, "inside"))


def _grouped(docs: DataFrame, setting: Settings) -> tuple[DataFrame, DataFrame]:
    """((doc_id, h, label, group_id, copies, links) of the documents that have copies or lie in larger ones, links)."""
    return _gathered(docs, setting, True)[:2]


def near_copies(docs: DataFrame, setting: Settings | None = None) -> DataFrame:
    """(doc_id, group_id, copies, links): a row for each document that has copies or lies in a document of another group.

    copies counts the rows of the group, links the other groups in which a text of it lies.
    """
    return _gathered(docs, setting or Settings(), False)[0].select("doc_id", "group_id", "copies", "links")


def near_groups(docs: DataFrame, setting: Settings | None = None) -> DataFrame:
    """(doc_id, group_id, copies) for every document that has a near copy."""
    return near_copies(docs, setting).filter("copies > 1").drop("links")


def group_links(docs: DataFrame, setting: Settings | None = None) -> DataFrame:
    """(group_id, inside): a text of the first group lies in one of the second; a document without copies is a group of its own."""
    return _grouped(docs, setting or Settings())[1].select(F.col("small_id").alias("group_id"), F.col("large_id").alias("inside"))


def drop_near_copies(docs: DataFrame, setting: Settings | None = None) -> DataFrame:
    """The rows of docs with one left of each group, the one of the smallest doc_id, and none of a group that lies in another.

    Only groups whose largest text is larger count there (of equal ones, the greater label), so what a group lies in stays
    or lies in what stays. All columns stay.
    """
    with common.Scratch(docs.sparkSession) as scratch:
        found, _, inside = _gathered(docs, setting or Settings(), False)
        stay = found.join(inside, "label", "left_anti").groupBy("label").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "h")).alias("r")).select("r.doc_id", "r.h")
        h, g_doc, g_h = (common.fresh(docs, c) for c in ("h", "g_doc", "g_h"))
        match = F.col("doc_id").eqNullSafe(F.col(g_doc)) & F.col(h).eqNullSafe(F.col(g_h))
        hashed = docs.withColumn(h, F.xxhash64("text"))

        def side(df: DataFrame) -> DataFrame:
            out = scratch.keep(common.settle(df.select(F.col("doc_id").alias(g_doc), F.col("h").alias(g_h)).distinct(), "side"))
            return common.maybe_broadcast(out, 64)

        alone = hashed.filter(F.col("text").isNull()).unionByName(hashed.filter(F.col("text").isNotNull()).join(side(found), match, "left_anti"))
        chosen = hashed.filter(F.col("text").isNotNull()).join(side(stay), match, "left_semi").dropDuplicates(["doc_id", h])
        return alone.unionByName(chosen).select(*docs.columns)


def opquery(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_copies(spark.read.parquet(f"{sf_dir}/documents.parquet"))
