"""Mixing sources to target weights by Efraimidis-Spirakis weighted sampling without replacement.

Each document draws an exponential key -ln(u) / weight from a hash of its doc_id and a seed; the smallest keys are the
sample. Each source has a token budget. Whole epochs of the source come first (every document, floor(budget / size)
times); what is left of the budget is filled by the documents whose running token sum, in key order, stays within it.

Targets are given as shares by source, or follow from the corpus: shares in proportion to tokens ** alpha, counted over
all documents, which lifts small sources and holds back hot ones. Tokens are estimated as ceil(UTF-8 bytes / 4).

Defined results: null sources form a source of their own; null and empty texts have 0 tokens and a key like any other;
rows that tie in key and doc_id (repeated rows) are chosen together; a source without tokens is taken once; sources
missing from given targets get share 0; null doc_ids all draw the same key; a very long text is a row like any other, taken
only where the rest of its source's budget holds it; an empty table gives an empty result. Extra columns are carried through untouched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

ALPHA = 0.7
BUDGET_RATIO = 1.0
SEED = "mix-1"
BYTES_PER_TOKEN = 4
MARKS = "!#$%&*|"


def tokens_of(text: Column) -> Column:
    return F.coalesce(F.floor((F.octet_length(text) + BYTES_PER_TOKEN - 1) / F.lit(BYTES_PER_TOKEN)), F.lit(0)).cast("bigint")


def weight_of(text: Column) -> Column:
    """Quality weight in [0.05, 1]: falls with the share of mark characters that junk is full of; 1 for null or empty texts."""
    marks = F.length(text) - F.length(F.regexp_replace(text, "[!#$%&*|]+", ""))
    return F.coalesce(F.greatest(F.lit(0.05), 1.0 - 4.0 * marks / F.nullif(F.length(text), F.lit(0))), F.lit(1.0))


def key_of(doc_id: Column, weight: Column, seed: str = SEED) -> Column:
    """-ln(u) / weight, u from 52 bits of an MD5 of the id: the same on every engine and in every run."""
    digest = F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":" + seed)))
    u = (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / F.lit(float(1 << 52))
    return -F.ln(u) / weight


def plan_sources(slim: DataFrame, targets: dict[str, float] | None, alpha: float, ratio: float) -> DataFrame:
    """(source, size, epochs, rest): whole epochs and what is left of the budget, a row a source."""
    sizes = slim.groupBy("source").agg(F.sum("tokens").alias("size"))
    if targets is None:
        shared = sizes.withColumn("raw", F.pow(F.col("size").cast("double"), F.lit(alpha)))
    else:
        table = slim.sparkSession.createDataFrame([(k, float(v)) for k, v in targets.items()], "t_source string, raw double")
        shared = sizes.join(F.broadcast(table), F.col("source").eqNullSafe(F.col("t_source")), "left").withColumn("raw", F.coalesce("raw", F.lit(0.0))).drop("t_source")
    total = shared.agg(F.sum("size").alias("all_tokens"), F.sum("raw").alias("all_raw"))
    budget = F.coalesce(F.round(F.col("all_tokens") * F.lit(ratio) * F.col("raw") / F.nullif(F.col("all_raw"), F.lit(0.0))), F.lit(0.0)).cast("bigint")
    out = shared.crossJoin(F.broadcast(total)).withColumn("budget", budget)
    epochs = F.when(F.col("size") > 0, F.floor(F.col("budget") / F.col("size"))).otherwise(0).cast("bigint")
    return out.select("source", "size", epochs.alias("epochs"), (F.col("budget") - epochs * F.col("size")).alias("rest"))


def _cuts(docs: DataFrame, weight: Column, targets: dict[str, float] | None, alpha: float, ratio: float, seed: str) -> DataFrame:
    """(source, epochs, cut): cut is the last (key, doc_id) of the fractional epoch, null where it takes nothing."""
    slim = docs.select(F.col("source").cast("string").alias("source"), "doc_id", tokens_of(F.col("text")).alias("tokens"), key_of(F.col("doc_id"), weight, seed).alias("k"))
    scratch = common.Scratch(docs.sparkSession)
    slim = common.settle(slim, "mix")
    plan = common.settle(plan_sources(slim, targets, alpha, ratio), "plan")
    run = common.prefix_sums(slim, ["k", "doc_id"], "tokens", "run", within="source", ties_together=True)
    plan_side = common.maybe_broadcast(plan.select(F.col("source").alias("p_source"), "epochs", "rest"), 64, text="p_source")
    inside = run.join(plan_side, F.col("source").eqNullSafe(F.col("p_source"))).filter("run <= rest")
    cut = inside.groupBy("source").agg(F.max(F.struct("k", "doc_id")).alias("cut")).withColumnRenamed("source", "c_source")
    out = plan.join(cut, F.col("source").eqNullSafe(F.col("c_source")), "left").select("source", "epochs", "cut")
    with scratch:
        return scratch.keep(common.settle(out, "cuts"))


def mix(docs: DataFrame, weight: Column | None = None, targets: dict[str, float] | None = None, alpha: float = ALPHA, ratio: float = BUDGET_RATIO, seed: str = SEED, epoch: str | None = None) -> DataFrame:
    """The rows of docs, each as often as the mix takes it; epoch names a column for the number of the pass.

    The texts themselves are never shuffled: a slim table finds each source's cut, and a filter on the rows applies it.
    """
    weight = weight_of(F.col("text")) if weight is None else weight
    cuts = _cuts(docs, weight, targets, alpha, ratio, seed)
    k, src, eps, cut, copies = (common.fresh(docs, c) for c in ("k", "c_source", "c_epochs", "c_cut", "copies"))
    side = common.maybe_broadcast(cuts.select(F.col("source").alias(src), F.col("epochs").alias(eps), F.col("cut").alias(cut)), 96, text=src)
    keyed = docs.withColumn(k, key_of(F.col("doc_id"), weight, seed))
    joined = keyed.join(side, F.col("source").cast("string").eqNullSafe(F.col(src)))
    within = F.coalesce(F.struct(F.col(k).alias("k"), F.col("doc_id").alias("doc_id")) <= F.col(cut), F.lit(False))
    n = (F.col(eps) + within.cast("int")).cast("int")
    out = joined.withColumn(copies, n).filter(F.col(copies) > 0)
    number = epoch or common.fresh(docs, "epoch")
    out = out.withColumn(number, F.explode(F.sequence(F.lit(0), F.col(copies) - 1)))
    return out.select(*docs.columns, *([number] if epoch else []))


def opquery(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return mix(docs, epoch="epoch").select("doc_id", "source", tokens_of(F.col("text")).alias("tokens"), "epoch")


SQL = f"""
WITH slim AS (
  SELECT source, doc_id, CAST((strlen(text) + 3) // 4 AS BIGINT) AS tokens,
    -ln((CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR) || ':{SEED}'), 1, 13) AS BIGINT) + 0.5) / 4503599627370496.0)
      / greatest(0.05, 1.0 - 4.0 * (length(text) - length(regexp_replace(text, '[!#$%&*|]+', '', 'g'))) / length(text)) AS k
  FROM documents),
sizes AS (SELECT source, CAST(sum(tokens) AS BIGINT) AS size, pow(CAST(sum(tokens) AS DOUBLE), {ALPHA}) AS raw FROM slim GROUP BY source),
plan AS (
  SELECT source, size, CAST(round(sum(size) OVER () * {BUDGET_RATIO}::DOUBLE * raw / sum(raw) OVER ()) AS BIGINT) AS budget FROM sizes),
run AS (
  SELECT slim.*, sum(tokens) OVER (PARTITION BY source ORDER BY k, doc_id) AS run FROM slim),
chosen AS (
  SELECT run.source, doc_id, tokens, budget // size + CASE WHEN run <= budget - budget // size * size THEN 1 ELSE 0 END AS copies
  FROM run JOIN plan USING (source))
SELECT doc_id, source, tokens, CAST(unnest(range(copies)) AS INTEGER) AS epoch FROM chosen
"""
