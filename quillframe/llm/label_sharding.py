"""Sharding by balanced label propagation: linked documents move to one shard, sizes stay even.

Documents that share a line of at least MIN_LINE characters, or their whole text, are linked through it; a line links its
documents with weight 1 / (documents - 1) a pair, so that what everybody has hardly pulls. Documents are numbered in the order
of their strongest line (the one that the fewest share) and a hash of id and text, and shards are dealt out as equal runs of
that order: copies so start together, and the order in which a table is stored makes no difference. In every round
each linked document finds the shard that holds most of its weighted neighbours; those whose turn it is (a hash of
document and round, so that partners don't just swap) ask to move. Requests between two shards in both directions cancel
out and are granted pairwise; what remains is granted while the target has room below its capacity. Larger gains come first, by
powers of two and then by a hash of the document, in groups that are granted whole, so no ranking of documents is needed.
The query goes on until QUIET rounds, in which every document has had its turn, don't add the share PROGRESS to the weight of
the links kept, and gives the shards of the least cut; moves may go on then, as two documents can swap places forever without lowering it.
All is joins and sums over (document, line) pairs: a line of n documents costs n rows and at most one a shard, never n * n.

Defined results: null and empty texts and texts without a shared line have no links and keep the shard dealt to them;
repeated rows are documents of their own, linked to each other by their text; of equal shards the smallest number wins
and equal gains are taken by the hash; null doc_ids are sharded like any other; of a very long text all lines count; extra
columns are ignored; an empty table gives an empty result. No shard ever exceeds ceil(rows / shards * (1 + SLACK)).
"""

from __future__ import annotations

import itertools
import math

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from quillframe.cluster import global_rank

from . import common

SHARDS, SLACK, MIN_LINE, UNIT = 16, 0.05, 20, 1 << 20
#: In so many rounds every document has had its turn: turn_of gives a row the same bit in two rounds running, never in three.
QUIET, PROGRESS = 3, 0.001
#: Requests of equal gain (by powers of two) fall into so many groups, which are granted whole.
SLICES = 64


def linked(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((rid, doc_id) of all rows, numbered 0, 1, 2, ..., and (rid, hub, w) of the lines that several of them share).

    w is the weight of one neighbour in units of 1 / UNIT.
    """
    lines = F.filter(F.split("text", "\n"), lambda x: F.length(F.trim(x)) >= MIN_LINE)
    hubs = F.array_append(F.transform(lines, lambda x: F.xxhash64(F.trim(x))), F.when(F.length("text") > 0, F.xxhash64(F.lit("text"), "text")))
    rows = common.need(docs, "doc_id", "text").select(F.monotonically_increasing_id().alias("at"), "doc_id", F.xxhash64("doc_id", "text").alias("mark"), F.coalesce(F.array_distinct(F.array_compact(hubs)), F.array().cast("array<bigint>")).alias("hubs"))
    rows = common.settle(rows, "rows", "lz4")
    pairs = rows.select("at", F.explode("hubs").alias("hub"))
    sizes = common.settle(pairs.groupBy("hub").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "sizes")
    pairs = common.settle(pairs.join(common.maybe_broadcast(sizes, 64), "hub"), "pairs", "lz4")
    lead = pairs.groupBy("at").agg(F.min(F.struct("n", "hub")).alias("lead")).select("at", F.col("lead.hub").alias("lead"))
    slim = rows.select("at", "doc_id", "mark").join(lead, "at", "left")
    ranked = common.settle(global_rank(slim, ["lead", "mark", "doc_id"], "rid").select("at", "doc_id", (F.col("rid") - 1).alias("rid")), "ranked")
    weight = F.greatest(F.lit(1), F.floor(F.lit(UNIT) / (F.col("n") - 1))).cast("long")
    edges = pairs.join(ranked.select("at", "rid"), "at").select("rid", "hub", weight.alias("w"))
    return ranked.select("rid", "doc_id"), common.settle(edges, "links", "lz4")


def quotas(asked: dict[tuple[int, int], int], sizes: list[int], capacity: int) -> dict[tuple[int, int], int]:
    """How many of the requests from shard a to shard b may be granted: exchanges first, then what room allows."""
    out, rest = {}, dict(asked)
    for (a, b), n in sorted(asked.items()):
        if (b, a) in asked:
            out[a, b] = min(n, asked[b, a])
            rest[a, b] -= out[a, b]
    sizes = list(sizes)
    for (a, b), n in sorted(rest.items(), key=lambda x: (-x[1], x[0])):
        take = max(0, min(n, capacity - sizes[b]))
        out[a, b] = out.get((a, b), 0) + take
        sizes[a] -= take
        sizes[b] += take
    return out


def grants(groups: dict[tuple[int, int], list[tuple[int, int, int]]], sizes: list[int], capacity: int) -> dict[tuple[int, int], list[tuple[int, int, int]]]:
    """The groups (level, slice, requests) granted of each (a, b): the first ones, as far as quota and capacity go."""
    may = quotas({p: sum(g[2] for g in x) for p, x in groups.items()}, sizes, capacity)
    out = {}
    for p, x in groups.items():
        taken, total = [], 0
        for g in x:
            if total + g[2] > may[p]:
                break
            taken.append(g)
            total += g[2]
        if taken:
            out[p] = taken
    while True:  # a group that was too large to go leaves less room where it stayed
        after = list(sizes)
        for (a, b), x in out.items():
            n = sum(g[2] for g in x)
            after[a] -= n
            after[b] += n
        full = [b for b, n in enumerate(after) if n > max(capacity, sizes[b])]
        if not full:
            return out
        for p in [p for p in sorted(out) if p[1] in full]:
            out[p] = out[p][:-1]
        out = {p: x for p, x in out.items() if x}


def turn_of(rid, round_: int):
    """Whose turn it is: a bit of a multiplicative hash, the same in Spark and in Python."""
    return (rid % (1 << 31) * 2654435 + round_ * 40503 * 977) % 65521 % 2


def dealt(rid, count: int, shards: int):
    """The shard that a row starts in: equal runs of the numbers."""
    return F.floor(rid * shards / max(1, count)).cast("int")


def shard(docs: DataFrame, shards: int = SHARDS, slack: float = SLACK, rounds: int | None = None) -> DataFrame:
    """(doc_id, shard) of each row after so many rounds; with None as many as it takes to settle."""
    spark = docs.sparkSession
    with common.Scratch(spark) as scratch:
        rows, edges = linked(docs)
        count = rows.count()
        capacity = math.ceil(count / shards * (1 + slack))
        first = (rows.groupBy(dealt(F.col("rid"), count, shards).alias("s")).count()).collect()  # a row a shard
        sizes = [0] * shards
        for r in first:
            sizes[r.s] = r["count"]
        labels = common.settle(edges.select("rid").distinct().withColumn("shard", dealt(F.col("rid"), count, shards)), "labels")
        most, mark, stay, last, idle = -1, -1, labels, 0, 0
        for k in itertools.count() if rounds is None else range(rounds):
            own = edges.join(labels, "rid")
            at = own.groupBy("hub", "shard").agg(F.count(F.lit(1)).alias("c"))
            votes = own.withColumnRenamed("shard", "mine").join(at, "hub")
            pull = (F.col("c") - (F.col("shard") == F.col("mine")).cast("int")) * F.col("w")
            votes = votes.groupBy("rid", "mine", "shard").agg(F.sum(pull).alias("pull"))
            best = votes.groupBy("rid", "mine").agg(F.max(F.struct(F.col("pull"), (-F.col("shard")).alias("other"))).alias("best"), F.coalesce(F.max(F.when(F.col("shard") == F.col("mine"), F.col("pull"))), F.lit(0)).alias("here"))
            seen = Observation()
            best = best.observe(seen, F.coalesce(F.sum("here"), F.lit(0)).alias("kept"))
            gain = F.col("best.pull") - F.col("here")
            want = best.select("rid", F.col("mine").alias("a"), (-F.col("best.other")).alias("b"), F.floor(F.log2(gain)).cast("int").alias("level"), F.pmod(F.xxhash64("rid", F.lit(k)), F.lit(SLICES)).cast("int").alias("slice"), gain.alias("gain"))
            want = common.settle(want.filter((F.col("a") != F.col("b")) & (F.col("gain") > 0) & (turn_of(F.col("rid"), k) == 0)).drop("gain"), "wishes")
            if rounds is None:
                kept = seen.get["kept"]
                if kept > most:
                    most, stay = kept, labels
                if kept > mark * (1 + PROGRESS):
                    mark, last = kept, k
                elif k - last >= QUIET:
                    labels = stay
                    break
            groups: dict[tuple[int, int], list[tuple[int, int, int]]] = {}
            for r in want.groupBy("a", "b", "level", "slice").agg(F.count(F.lit(1)).alias("n")).collect():  # at most shards ** 2 * levels * SLICES rows
                groups.setdefault((r.a, r.b), []).append((r.level, r.slice, r.n))
            granted = grants({p: sorted(x, key=lambda g: (-g[0], g[1])) for p, x in groups.items()}, sizes, capacity)
            idle = 0 if granted else idle + 1
            if idle == QUIET:  # everybody has had a turn
                break
            if not granted:
                continue
            for (a, b), x in granted.items():
                sizes[a] -= sum(g[2] for g in x)
                sizes[b] += sum(g[2] for g in x)
            ends = spark.createDataFrame([(a, b, *x[-1][:2]) for (a, b), x in granted.items()], "a int, b int, to_level int, to_slice int")
            moves = want.join(F.broadcast(ends), ["a", "b"]).filter("level > to_level or level = to_level and slice <= to_slice").select("rid", F.col("b").alias("to"))
            labels = common.settle(labels.join(moves, "rid", "left").select("rid", F.coalesce("to", "shard").alias("shard")), "labels")
        out = rows.join(labels, "rid", "left").select("doc_id", F.coalesce("shard", dealt(F.col("rid"), count, shards)).alias("shard"))
        return scratch.keep(common.settle(out, "shards"))


def opquery(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(spark.read.parquet(f"{sf_dir}/documents.parquet"))
