"""Shifts, masks and windows over ordered sequences, as window frames rather than joins of all pairs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def shift(value: Column, offset: int, by: list[str], order: list[str], fill=0) -> Column:
    """The value offset rows before, fill where there is none."""
    return F.coalesce(F.lag(value, offset).over(W.partitionBy(*by).orderBy(*order)), F.lit(fill)) if offset else value


def recent(by: list[str], position: str, window: int):
    """The frame of the positions at most window - 1 before this one."""
    return W.partitionBy(*by).orderBy(position).rangeBetween(-(window - 1), 0)


def causal(by: list[str], position: str):
    """The frame of all positions up to this one."""
    return W.partitionBy(*by).orderBy(position).rangeBetween(W.unboundedPreceding, 0)


def visible_sums(by: list[str], position: str, sink: str, window: int, values: list[Column]) -> list[Column]:
    """Sums over what a causal window with sinks lets each position see: the recent ones, and all sinks before."""
    older = W.partitionBy(*by).orderBy(position).rangeBetween(W.unboundedPreceding, -window)
    return [(F.sum(x).over(recent(by, position, window)) + F.coalesce(F.sum(F.when(F.col(sink), x)).over(older), F.lit(0))).cast("bigint") for x in values]


def mask_diagonal(mask: Column, offset: int) -> Column:
    """Whether each position sees the one offset places before it, from the rows of a square mask; 0 where there is none."""
    zero = F.lit(0)
    return F.transform(mask, lambda row, i: F.when(i >= offset, F.get(row, i - offset)).otherwise(zero))


def padding_mask(tokens: Column, pad: int = 0) -> Column:
    """1 for each token that isn't padding."""
    return F.transform(tokens, lambda x: (x != pad).cast("int"))


def document_prefix(sink: str, by: list[str]) -> Column:
    """How many sinks a sequence has."""
    return F.sum(F.col(sink).cast("int")).over(W.partitionBy(*by))


def before_end(tokens: Column, end: int) -> Column:
    """The tokens before the first end token."""
    at = F.array_position(tokens, F.lit(end)).cast("int")
    return F.when(at > 0, F.slice(tokens, 1, F.greatest(at - 1, F.lit(0)))).otherwise(tokens)


def left_pad(tokens: Column, width: int, fill: int = 0) -> Column:
    """Padded on the left to a width, cut on the left beyond it."""
    return F.slice(F.concat(F.array_repeat(F.lit(fill), width), tokens), -width, width)


def window_budget(layers: int, kv_heads: int, head_dim: int, d_model: int, sites: int, longest: int, own: int = 0, budget: int = 11 * 1024 * 1024 + 512 * 1024, group: int = 32, least: int = 160) -> int:
    """Positions that a cache budget holds: a multiple of the group between least and longest, and at most the model's own window."""
    kv = kv_heads * head_dim
    each = layers * (2 * kv + 8 * (kv // group)) + sites * (d_model + 4 * (d_model // group))
    window = max(least, min(budget // each // group * group, longest))
    return min(window, own) if own else window
