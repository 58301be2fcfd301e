"""Group quantization: name rules, widths by prefix, packing with rotation and codebooks, sizes."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillframe.functions.vectors import walsh

TERNARY = 1.58
WIDTHS = (2, 3, 4)


def canonical_name(name: Column) -> Column:
    """One spelling of a tensor's name, whichever tree it comes from."""
    n = F.regexp_replace(F.regexp_replace(name, r"^layer\d+\.", "attn."), r"^engrams?_?(\d+)[./]?", "engram$1.")
    n = F.replace(F.replace(F.regexp_replace(n, "^stack/", ""), F.lit("layers/block/self_attn/"), F.lit("attn.")), F.lit("mtp_block/self_attn/"), F.lit("mtp."))
    n = F.regexp_replace(F.regexp_replace(n, "/kernel$", ""), "^embedding/embedding$", "embedding")
    return F.replace(F.regexp_replace(n, r"^(engram\d+\.)embedding$", "$1tables"), F.lit("/"), F.lit("."))


def parse_widths(spec: str) -> tuple[dict[str, float], float]:
    """({prefix: width}, default) of "a=2,b=4,default=3"; errors name what is wrong."""
    found: dict[str, float] = {}
    for part in filter(None, (p.strip() for p in (spec or "").split(","))):
        key, gap, value = part.partition("=")
        width = float(value) if gap else float("nan")
        if width not in (*WIDTHS, TERNARY):
            raise ValueError(f"unsupported width in {part!r}")
        found[key.strip()] = width if width == TERNARY else int(width)
    if "default" not in found:
        raise ValueError(f"{spec!r} lacks a default")
    return found, found.pop("default")


def longest_prefix(df: DataFrame, key: str, name: str, widths: dict[str, float], default: float) -> DataFrame:
    """(key, bits): the width of the longest prefix that fits; the rules are literals, tried longest first, so no join is needed."""
    out = F.lit(default)
    for prefix in sorted(widths, key=len):
        out = F.when(F.col(name).startswith(prefix), F.lit(widths[prefix])).otherwise(out)
    return df.select(key, out.alias("bits"))


def distortion(x: Column, back: Column) -> Column:
    """Mean squared error relative to the mean square."""
    return F.avg((back - x) * (back - x)) / F.avg(x * x)


def aligned(size: Column, to: int = 64) -> Column:
    return F.floor((size + (to - 1)) / to) * to


def size_summary(n: str, bits: str, quantized: str, group: int) -> tuple[Column, Column]:
    """(bytes, mean width): packed codes and one half-precision norm a group where quantized, else half precision."""
    packed = F.col(n) * F.col(bits) / 8.0 + F.floor(F.col(n) / group) * 2
    stored = F.sum(F.when(F.col(quantized), packed).otherwise(F.col(n) * 2.0))
    return stored, F.sum(F.when(F.col(quantized), F.col(n) * F.col(bits))) / F.greatest(F.sum(F.when(F.col(quantized), F.col(n)).otherwise(0)), F.lit(1))


@lru_cache(None)
def codebook(bits: float, group: int) -> np.ndarray:
    """Codes of a unit vector's coordinates: the least-squares levels of a Gaussian over sqrt(group), ternary ones in closed form."""
    if bits == TERNARY:
        return np.array([-1.2240064, 0.0, 1.2240064]) / np.sqrt(group)
    x = np.sort(np.random.RandomState(0).randn(400_000))
    sums = np.concatenate(([0.0], np.cumsum(x)))
    n = 1 << int(bits)
    levels = x[((np.arange(n) + 0.5) / n * len(x)).astype(int)]
    for _ in range(200):
        at = np.concatenate(([0], np.searchsorted(x, (levels[1:] + levels[:-1]) / 2, "right"), [len(x)]))
        size = np.diff(at)
        levels = np.where(size > 0, (sums[at[1:]] - sums[at[:-1]]) / np.maximum(size, 1), levels)
    return levels / np.sqrt(group)


def nearest(x: np.ndarray, book: np.ndarray) -> np.ndarray:
    """Index of the nearest code, the left one on a tie."""
    return np.searchsorted((book[1:] + book[:-1]) / 2, x, "left").astype(np.uint8)


def pack_lsb(codes: np.ndarray, bits: int) -> np.ndarray:
    """Rows of codes as one bit stream each, least significant bit first."""
    rows = np.unpackbits(codes[..., None].astype(np.uint8), axis=-1, count=bits, bitorder="little")
    return np.packbits(rows.reshape(len(codes), -1), axis=1, bitorder="little")


def unpack_lsb(packed: np.ndarray, bits: int, count: int) -> np.ndarray:
    """The codes of :func:`pack_lsb`."""
    rows = np.unpackbits(packed, axis=1, count=count * bits, bitorder="little").reshape(len(packed), count, bits)
    return np.packbits(rows, axis=-1, bitorder="little")[..., 0]


def quantize(w: np.ndarray, bits: float, group: int) -> tuple[np.ndarray, np.ndarray]:
    """(packed codes, half-precision norms) of a matrix whose rows are cut in groups, rotated and coded on the unit sphere."""
    if bits not in (*WIDTHS, TERNARY):
        raise ValueError(f"unsupported width {bits}")
    rows, width = w.shape
    padded = np.pad(w, ((0, 0), (0, -width % group))).reshape(rows, -1, group)
    turned = walsh(padded)
    norm = np.linalg.norm(turned, axis=-1)
    codes = nearest(turned / np.maximum(norm, 1e-12)[..., None], codebook(bits, group)).reshape(rows, -1)
    packed = pack_lsb((codes + 3) % 4 if bits == TERNARY else codes, 2 if bits == TERNARY else int(bits))  # ternary crumbs: 3, 0, 1
    return packed, norm.astype(np.float16)


def dequantize(packed: np.ndarray, norms: np.ndarray, width: int, bits: float, group: int) -> np.ndarray:
    """The matrix that :func:`quantize` stands for."""
    count = norms.shape[1] * group
    codes = unpack_lsb(packed, 2 if bits == TERNARY else int(bits), count)
    codes = (codes + 1) % 4 if bits == TERNARY else codes
    units = codebook(bits, group)[codes].reshape(len(packed), -1, group)
    return walsh(units * norms.astype(np.float64)[..., None]).reshape(len(packed), -1)[:, :width]


def relative_distortion(bits: float, group: int = 128, rows: int = 256) -> float:
    w = np.random.RandomState(0).randn(rows, 4 * group)
    back = dequantize(*quantize(w, bits, group), w.shape[1], bits, group)
    return float(((back - w) ** 2).mean() / (w**2).mean())


def noise_scale(bits: float, group: int = 128) -> float:
    """Root of the distortion at a width, interpolated in logarithms between whole ones."""
    b = min(max(float(bits), 2), 4)
    lo, hi = int(np.floor(b)), int(np.ceil(b))
    a, z = np.log(relative_distortion(lo, group)), np.log(relative_distortion(hi, group))
    return float(np.exp(0.5 * (a + (z - a) * (b - lo))))


def leaf_path(keys: Column) -> Column:
    """The path of a leaf as text: its keys joined by slashes."""
    return F.array_join(keys, "/")


def kv_quant(x: np.ndarray, bits: float, group: int = 64) -> np.ndarray:
    """What cached keys or values of any shape become when their last axis is stored in groups; 0 bits leave them as they are."""
    if not bits:
        return x
    flat = x.reshape(-1, x.shape[-1])
    return dequantize(*quantize(flat, bits, group), x.shape[-1], bits, group).reshape(x.shape)


def straight_through(x: Column, quantized: Column, on: Column) -> Column:
    """The quantized value where on is true: forward, x + (quantized - x) is just that, and nothing here goes backward."""
    return F.when(on, quantized).otherwise(x)


def add_noise(w: np.ndarray, scale: float, group: int = 128, seed: int = 0) -> np.ndarray:
    """w with Gaussian noise of scale times the root mean square of each group of the last axis, as quantizing would add."""
    width = w.shape[-1]
    padded = np.pad(w, [(0, 0)] * (w.ndim - 1) + [(0, -width % group)])
    groups = padded.reshape(*padded.shape[:-1], -1, group)
    sigma = np.sqrt((groups**2).mean(-1, keepdims=True)) * scale
    return (groups + sigma * np.random.default_rng(seed).standard_normal(groups.shape)).reshape(padded.shape)[..., :width]


def noisy(tensors: dict[str, np.ndarray], scale: float, group: int = 128, seed: int = 0, prefix: str = "") -> dict[str, np.ndarray]:
    """Matrices whose names begin so, each with noise of its own; everything else as it is."""
    return {n: add_noise(x, scale, group, seed + i) if x.ndim >= 2 and n.startswith(prefix) else x for i, (n, x) in enumerate(sorted(tensors.items()))}


def quantize_rows(df: DataFrame, name: str, row: str, widths: dict[str, float], default: float, group: int = 128) -> DataFrame:
    """A table of matrix rows (a tensor's name and an array) with each row as its width leaves it: a whole tree in one pass, no shuffle."""
    at = df.columns.index(row)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[list[float]] = []
            for n, x in zip(batch.column(name).to_pylist(), batch.column(row)):
                fits = [k for k in widths if n.startswith(k)]
                bits = widths[max(fits, key=len)] if fits else default
                w = x.values.to_numpy(zero_copy_only=False)[None].astype(np.float64)
                rows.append(dequantize(*quantize(w, bits, group), w.shape[1], bits, group)[0].tolist())
            columns = list(batch.columns)
            columns[at] = pa.array(rows, pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names)

    return df.withColumn(row, F.col(row).cast("array<double>")).mapInArrow(run, df.withColumn(row, F.col(row).cast("array<double>")).schema)
