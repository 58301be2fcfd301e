"""Array kernels as column expressions over array<double>, and Arrow versions where an element meets all others."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def total(a: Column | str) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def dot(a: Column | str, b: Column | str) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def bind(value: Column, fn: Callable[[Column], Column]) -> Column:
    """fn of a value that is computed once a row: as a variable it isn't computed anew for every element of an inner array."""
    return F.get(F.transform(F.array(value), fn), F.lit(0))


def rms_unit(a: Column, epsilon: float = 1e-6) -> Column:
    """x / sqrt(mean(x * x) + epsilon)."""
    norm = F.sqrt(total(F.transform(a, lambda x: x * x)) / F.size(a) + F.lit(epsilon))
    return bind(norm, lambda n: F.transform(a, lambda x: x / n))


def zero_centred_rms(a: Column, scale: Column, epsilon: float = 1e-6) -> Column:
    """(1 + scale) times the unit-RMS vector."""
    return F.zip_with(rms_unit(a, epsilon), scale, lambda x, s: (1.0 + s) * x)


def unit(a: Column, epsilon: float = 1e-12) -> Column:
    """Length 1 (up to epsilon under the root)."""
    return bind(F.sqrt(dot(a, a) + F.lit(epsilon)), lambda n: F.transform(a, lambda x: x / n))


def softmax(a: Column) -> Column:
    powers = bind(F.array_max(a), lambda top: F.transform(a, lambda x: F.exp(x - top)))
    return bind(powers, lambda e: bind(total(e), lambda s: F.transform(e, lambda x: x / s)))


def entropy(p: Column) -> Column:
    """-sum(p ln p), 0 at p = 0."""
    return -total(F.transform(p, lambda x: F.when(x > 0, x * F.ln(x)).otherwise(0.0)))


def argmax(a: Column) -> Column:
    """Place of the first largest element, from 0."""
    return (F.array_position(a, F.array_max(a)) - 1).cast("int")


def sigmoid(x: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-x))


def rope(a: Column, position: Column, theta: float = 10000.0) -> Column:
    """Rotary position embedding, halves rotated against each other."""
    half = (F.size(a) / 2).cast("int")
    angle = lambda i: position * F.pow(F.lit(theta), -(i * 2.0) / F.size(a))
    low, high = F.slice(a, 1, half), F.slice(a, half + 1, half)
    first = F.transform(low, lambda x, i: x * F.cos(angle(i)) - F.get(high, i) * F.sin(angle(i)))
    second = F.transform(high, lambda x, i: x * F.cos(angle(i)) + F.get(low, i) * F.sin(angle(i)))
    return F.concat(first, second)


def absmax_quant(a: Column, bits: int) -> Column:
    """Rounded half to even on the grid of the largest magnitude, and back."""
    top = float((1 << (bits - 1)) - 1)
    peak = F.array_max(F.transform(a, lambda x: F.abs(x)))
    scale = F.when(peak > 0, peak / top).otherwise(1.0)
    return bind(scale, lambda s: F.transform(a, lambda x: F.least(F.lit(top), F.greatest(F.lit(-top - 1), F.rint(x / s))) * s))


def absmax_groups(a: Column, bits: int, group: int) -> Column:
    """:func:`absmax_quant` of every run of group elements, the last one being what remains; 8 bits over the whole for activations."""
    starts = F.sequence(F.lit(1), F.greatest(F.size(a), F.lit(1)), F.lit(group))
    return F.flatten(F.transform(starts, lambda i: absmax_quant(F.slice(a, i, F.lit(group)), bits)))


def nearest_code(x: Column, codebook: list[float]) -> Column:
    """Index of the nearest code of an ascending book, the left one on a tie: the number of midpoints below x."""
    out = F.lit(0)
    for a, b in zip(codebook, codebook[1:]):
        out = out + (x > F.lit((a + b) / 2)).cast("int")
    return out


def pack_codes(codes: Column, bits: int, first: int, count: int) -> Column:
    """count codes from the place first (from 0), least significant first, in one bigint."""
    out = F.lit(0).cast("bigint")
    for i in range(count):
        out = out.bitwiseOR(F.shiftleft(F.get(codes, F.lit(first + i)).cast("bigint"), i * bits))
    return out


def ngram_slots(tokens: Column, order: int, table: int, slots: int) -> Column:
    """Slot of the n-gram that ends at each token in hash table number table (from 0), all in 32 unsigned bits."""
    seed, low = (0x9E3779B9 * (table + 1)) & 0xFFFFFFFF, F.lit(0xFFFFFFFF)

    def one(x: Column, i: Column) -> Column:
        acc = F.lit(seed).cast("bigint")
        for j in range(order):
            token = x.cast("bigint") if j == 0 else F.coalesce(F.get(tokens, i - j).cast("bigint"), F.lit(0).cast("bigint"))
            acc = (acc.bitwiseXOR(token) * F.lit(0x01000193)).bitwiseAND(low)
        return acc.bitwiseXOR(F.shiftrightunsigned(acc, 15)) % slots

    return F.transform(tokens, one)


def walsh(x: np.ndarray) -> np.ndarray:
    """Orthonormal Walsh-Hadamard transform of the last axis, whose length is a power of two."""
    n, step = x.shape[-1], 1
    x = x.astype(np.float64, copy=True)
    while step < n:
        view = x.reshape(*x.shape[:-1], n // (2 * step), 2, step)
        a, b = view[..., 0, :].copy(), view[..., 1, :].copy()
        view[..., 0, :], view[..., 1, :] = a + b, a - b
        step *= 2
    return x / math.sqrt(n)


def map_rows(df: DataFrame, column: str, fn, out: str) -> DataFrame:
    """fn over the matrix of all vectors of each Arrow batch (rows of equal length); the result replaces the column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index(column)
            a = batch.column(at)
            x = a.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(batch.num_rows, -1) if batch.num_rows else np.zeros((0, 1))
            y = fn(x)
            values = pa.array(y.reshape(-1))
            offsets = pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * (y.shape[1] if batch.num_rows else 0))
            columns = [c for i, c in enumerate(batch.columns) if i != at]
            names = [n for i, n in enumerate(batch.schema.names) if i != at]
            yield pa.RecordBatch.from_arrays([*columns, pa.ListArray.from_arrays(offsets, values)], [*names, out])

    rest = [f for f in df.schema.fields if f.name != column]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rest) + f", `{out}` array<double>"
    return df.mapInArrow(run, schema.lstrip(", "))


def hadamard_mlp(x: np.ndarray, d1: np.ndarray, d2: np.ndarray, d3: np.ndarray) -> np.ndarray:
    """Diagonals and Walsh transforms in place of dense layers: pad, d1, H, silu(d2), H, d3, cut."""
    n = len(d1)
    z = np.pad(x, [(0, 0)] * (x.ndim - 1) + [(0, n - x.shape[-1])])
    z = d2 * walsh(d1 * z)
    return (d3 * walsh(z / (1 + np.exp(-z))))[..., : x.shape[-1]]


def sinkhorn(logits: np.ndarray, rounds: int = 20) -> np.ndarray:
    """Rows, then columns, normalised in logarithms, over and over."""

    def lse(a, axis):
        top = a.max(axis, keepdims=True)
        return top + np.log(np.exp(a - top).sum(axis, keepdims=True))

    k = logits.astype(np.float64)
    for _ in range(rounds):
        k = k - lse(k, -1)
        k = k - lse(k, -2)
    return np.exp(k)
