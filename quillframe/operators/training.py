"""Sums that training needs: schedules, masked losses, averages, low-rank merges and decoding signals."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def warmup_cosine(step: Column, total: int, peak: float) -> Column:
    """Linear from 0 over total // 20 steps (1 at least, total - 1 at most), then a half cosine to 0."""
    warm = min(max(1, total // 20), total - 1)
    rise = peak * step / max(warm, 1)
    fall = peak * 0.5 * (1 + F.cos(F.lit(math.pi) * (step - warm) / max(1, total - warm)))
    return F.when(step < warm, rise).otherwise(fall)


def warmup_rate(step: int, total: int, peak: float) -> float:
    """:func:`warmup_cosine` of one step, as a number."""
    warm = min(max(1, total // 20), total - 1)
    if step < warm:
        return peak * step / max(warm, 1)
    return peak * 0.5 * (1 + math.cos(math.pi * (step - warm) / max(1, total - warm)))


def masked_mean(value: str, mask: str) -> Column:
    """sum(value * mask) / max(sum(mask), 1), nulls counting nothing."""
    return F.sum(F.coalesce(F.col(value) * F.col(mask), F.lit(0.0))) / F.greatest(F.sum(F.coalesce(F.col(mask), F.lit(0))), F.lit(1))


def mean_of_means(df: DataFrame, by: list[str], batch: str, value: Column) -> DataFrame:
    """The unweighted mean of the means of the batches."""
    return df.groupBy(*by, batch).agg(F.avg(value).alias("m")).groupBy(*by).agg(F.avg("m").alias("mean"))


def signals(chosen: str, entropy: str) -> tuple[Column, Column, Column]:
    """(least probability, mean log probability, largest entropy); 0, minus infinity and 0 without tokens."""
    logs = F.avg(F.ln(F.greatest(F.col(chosen), F.lit(1e-12))))
    return F.coalesce(F.min(chosen), F.lit(0.0)), F.coalesce(logs, F.lit(float("-inf"))), F.coalesce(F.max(entropy), F.lit(0.0))


def element_mean(df: DataFrame, by: str, vector: str) -> DataFrame:
    """(by, j, mean) over the elements of all vectors of a group."""
    return df.select(by, F.posexplode(vector).alias("j", "_v")).groupBy(by, "j").agg(F.avg("_v").alias("mean"))


def merge_low_rank(w: DataFrame, a: DataFrame, b: DataFrame, scale: float) -> DataFrame:
    """(i, j, w) + scale * sum over k of (i, k, a) * (k, j, b)."""
    delta = a.join(b, "k").groupBy("i", "j").agg(F.sum(F.col("a") * F.col("b")).alias("d"))
    return w.join(delta, ["i", "j"], "left").select("i", "j", (F.col("w") + scale * F.coalesce("d", F.lit(0.0))).alias("w"))


def low_rank_targets(tensors: DataFrame, path: str, value: str, names: list[str]) -> DataFrame:
    """Paths of stacked layer kernels of the names given that aren't all zero."""
    parts = F.split(path, "/")
    fits = (F.element_at(parts, -1) == "kernel") & F.array_contains(parts, "stack") & F.array_contains(parts, "layers") & F.arrays_overlap(parts, F.array(*[F.lit(n) for n in names]))
    return tensors.filter(fits).groupBy(path).agg(F.max(F.abs(value)).alias("_m")).filter("_m > 1e-6").select(path)


def progress_steps(total: int, step: Column) -> Column:
    """Whether a step is one of about fifty to report."""
    return step % max(1, total // 50) == 0
