"""Exact deduplication by distributed most-significant-byte-first radix partitioning.

Documents are split by successive runs of bytes of their UTF-8 text. After each split a group that holds one document
is done (nothing equals it) and a group whose texts have ended is done (its texts are equal); the rest is split again
by the next, longer run. Equality is decided on the bytes themselves: no digest is taken.

Defined results: null texts equal nothing, not even one another; empty texts equal one another; repeated rows are copies
of one another; the representative of a group is its smallest doc_id (nulls last), then the first row read. Extra columns
are carried through untouched, whatever their names. A very long text is one value whose rest is cut off run by run. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from . import common

FIRST_BYTES = 64
GROWTH = 8
#: Rows of 64 bits in the table that sorts out single texts.
FILTER_WORDS = 1 << 20


def _with_groups(docs: DataFrame, first: int, grp: str) -> DataFrame:
    """docs with the number of the group of their first bytes in the column grp, null where nothing else begins so.

    The groups are broadcast while their counted size allows. Beyond that a broadcast table of bits, of FILTER_WORDS rows
    whatever the corpus, sorts out the texts that begin like no other, so that only candidates' texts are shuffled.
    """
    prefix = F.substring(F.col("text").cast("binary"), 1, first)
    heads = docs.filter(F.col("text").isNotNull()).groupBy(prefix.alias("head")).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    heads = common.settle(heads.select("head").withColumn("g", F.monotonically_increasing_id()), "heads")
    head = common.fresh(docs, "head_")
    side = heads.select(F.col("head").alias(head), F.col("g").alias(grp))
    if heads.count() * (first + 32) <= common.BROADCAST_BYTES:
        return docs.join(F.broadcast(side), prefix == F.col(head), "left").drop(head)
    word, bits = common.fresh(docs, "word_"), common.fresh(docs, "bits_")

    def place(x):
        h = F.xxhash64(x)
        return h.bitwiseAND(F.lit(FILTER_WORDS - 1)), F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftright(h, 32).bitwiseAND(F.lit(63)).cast("int"))

    at, bit = place(F.col("head"))
    table = common.settle(heads.groupBy(at.alias(word)).agg(F.bit_or(bit).alias(bits)), "bits")
    at, bit = place(prefix)
    flagged = docs.join(F.broadcast(table), at == F.col(word), "left")
    hit = F.coalesce(F.col(bits).bitwiseAND(bit) != 0, F.lit(False)) & F.col("text").isNotNull()
    alone = flagged.filter(~hit).drop(word, bits).withColumn(grp, F.lit(None).cast("long"))
    return alone.unionByName(flagged.filter(hit).drop(word, bits).join(side, prefix == F.col(head), "left").drop(head))


def _refine(rows: DataFrame, first: int) -> DataFrame:
    """From rows (rid, doc_id, grp, rest) the documents that have copies, as (rid, doc_id, grp)."""
    spark = rows.sparkSession
    stride, done = first * 4, []
    while True:
        cut = rows.select("rid", "doc_id", "grp", F.substring("rest", 1, stride).alias("run"), (F.length("rest") <= stride).alias("ended"), F.substring(F.col("rest"), stride + 1, 2147483647).alias("rest"))
        groups = cut.groupBy("grp", "ended", "run").agg(F.min("rid").alias("next"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
        seen = Observation()
        split = cut.join(groups, ["grp", "ended", "run"]).select("rid", "doc_id", F.col("next").alias("grp"), "ended", "rest")
        split = split.observe(seen, F.count(F.when(~F.col("ended"), 1)).alias("more"))
        split = common.settle(split, "radix")
        done.append(split.filter("ended").select("rid", "doc_id", "grp"))
        if not seen.get["more"]:
            break
        rows, stride = split.filter(~F.col("ended")), stride * GROWTH
    found = done[0]
    for part in done[1:]:
        found = found.unionByName(part)
    return found


def exact_groups(docs: DataFrame, first_bytes: int = FIRST_BYTES) -> DataFrame:
    """(doc_id, group_id, copies) for every document that has an exact copy; group_id is the smallest doc_id of the group."""
    docs = common.need(docs, "doc_id", "text")
    rows = _with_groups(docs, first_bytes, "grp").filter("grp is not null")
    rows = rows.select("doc_id", "grp", F.substring(F.col("text").cast("binary"), first_bytes + 1, 2147483647).alias("rest"))
    rows = common.settle(rows.withColumn("rid", F.monotonically_increasing_id()), "radix")
    found = _refine(rows, first_bytes)
    groups = found.groupBy("grp").agg(F.min("doc_id").alias("group_id"), F.count(F.lit(1)).alias("copies"))
    return found.join(groups, "grp").select("doc_id", "group_id", "copies")


def drop_exact_copies(docs: DataFrame, first_bytes: int = FIRST_BYTES) -> DataFrame:
    """The rows of docs with one row left of each group of equal texts; all columns stay."""
    columns = docs.columns
    grp, rid = (common.fresh(docs, c) for c in ("grp", "rid"))
    marked = _with_groups(docs, first_bytes, grp)
    single = marked.filter(F.col(grp).isNull())
    active = common.settle(marked.filter(F.col(grp).isNotNull()).withColumn(rid, F.monotonically_increasing_id()), "active")
    rows = active.select(F.col(rid).alias("rid"), "doc_id", F.col(grp).alias("grp"), F.substring(F.col("text").cast("binary"), first_bytes + 1, 2147483647).alias("rest"))
    found = _refine(rows, first_bytes)
    order = F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("rid"))
    stay = found.groupBy("grp").agg(F.min(order).alias("first")).select(F.col("first.rid").alias("rid"))
    extra = common.settle(found.select("rid").join(stay, "rid", "left_anti"), "extra")
    extra = extra.withColumnRenamed("rid", rid) if rid != "rid" else extra
    kept = active.join(common.maybe_broadcast(extra, 32), rid, "left_anti")
    return single.select(*columns).unionByName(kept.select(*columns))


def opquery(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = """
SELECT doc_id, group_id, copies FROM (
  SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS group_id, count(*) OVER (PARTITION BY text) AS copies
  FROM documents WHERE text IS NOT NULL)
WHERE copies > 1
"""
