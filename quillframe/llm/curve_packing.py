"""Packing along a space-filling curve: similar documents share training sequences.

Hashed word counts of a document (FEATURES buckets) are projected by a fixed Gaussian matrix to DIMENSIONS numbers, each
is mapped to a grid of 2**BITS steps through a logistic curve of its mean and spread over the corpus, and the cell's
place on the Hilbert curve is the sort key. Documents are range-sorted by (key, doc_id) and laid end to end; every
CAPACITY tokens a new pack begins, so all packs but the last are full and a document may continue in the next pack.
Tokens are white-space words. Only a slim table (id, key, length) is ever shuffled.

Defined results: null and empty texts have no tokens and lie at their place with an empty span; a document longer than a
pack fills several; equal documents lie side by side; repeated rows (of equal doc_id, key and length) each get their own
span, and with apart one repeat of each row comes before the next of any, so that none meets itself in a pack; a very long
text is hashed in blocks; null doc_ids sort first within a key. Extra columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillframe.cluster import global_rank

from . import common, textvec

FEATURES, DIMENSIONS, BITS, CAPACITY, SEED = 4096, 4, 10, 2048, 17


def gaussian(features: int = FEATURES, dimensions: int = DIMENSIONS) -> np.ndarray:
    return np.random.default_rng(SEED).standard_normal((features, dimensions)).astype(np.float32)


def project(data: np.ndarray, at: np.ndarray, matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(projected mean of the hashed words, number of words) of each document."""
    words, word_at = textvec.words(data, at)
    n = np.diff(word_at)
    out = np.zeros((len(n), matrix.shape[1]))
    full = np.flatnonzero(n)
    if len(full):
        bucket = (words >> np.uint64(40)).astype(np.int64) & (len(matrix) - 1)
        for d in range(matrix.shape[1]):
            out[full, d] = np.add.reduceat(matrix[:, d][bucket], word_at[:-1][full], dtype=np.float64)
        out[full] /= n[full, None]
    return out, n


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place on the Hilbert curve of each row of cells (n, dimensions), every coordinate below 2**bits."""
    x = [c.astype(np.int64).copy() for c in cells.T]
    top = 1 << (bits - 1)
    q = top
    while q > 1:
        p = q - 1
        for i in range(len(x)):
            on = (x[i] & q) != 0
            swap = np.where(on, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(on, x[0] ^ p, x[0] ^ swap)
            x[i] = x[i] ^ swap if i else x[0]
        q >>= 1
    for i in range(1, len(x)):
        x[i] = x[i] ^ x[i - 1]
    t, q = np.zeros_like(x[0]), top
    while q > 1:
        t = np.where((x[-1] & q) != 0, t ^ (q - 1), t)
        q >>= 1
    x = [c ^ t for c in x]
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for c in x:
            key = (key << 1) | ((c >> b) & 1)
    return key


def cells_of(x: np.ndarray, mean: np.ndarray, spread: np.ndarray, bits: int) -> np.ndarray:
    z = np.clip((x - mean) / np.where(spread > 0, spread, 1.0), -20, 20)
    return np.minimum((1 << bits) - 1, np.floor((1 << bits) / (1 + np.exp(-1.702 * z)))).astype(np.int64)


def _vectors(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matrix = gaussian()
        for batch in batches:
            raw, offsets = textvec.buffers(batch.column("text"))
            for first, end, data, at in textvec.chunks(raw, offsets):
                x, n = project(data, at, matrix)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(first, end - first), pa.array(n.astype(np.int64)), *[pa.array(c) for c in x.T]], ["doc_id", "tokens", *names])

    names = [f"x{d}" for d in range(DIMENSIONS)]
    return common.need(docs, "doc_id", "text").mapInArrow(run, "doc_id long, tokens long, " + ", ".join(f"{n} double" for n in names))


def keyed(docs: DataFrame) -> DataFrame:
    """(doc_id, tokens, key) of each row; means and spreads are those of all rows."""
    vectors = common.settle(_vectors(docs), "vectors", "lz4")
    names = [f"x{d}" for d in range(DIMENSIONS)]
    stats = vectors.agg(*[F.coalesce(F.avg(n), F.lit(0.0)).alias("m" + n) for n in names], *[F.coalesce(F.stddev_pop(n), F.lit(0.0)).alias("s" + n) for n in names]).first()
    mean, spread = np.array([stats["m" + n] for n in names]), np.array([stats["s" + n] for n in names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.stack([batch.column(n).to_numpy(zero_copy_only=False) for n in names], 1) if batch.num_rows else np.zeros((0, len(names)))
            key = hilbert(cells_of(x, mean, spread, BITS), BITS)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("tokens"), pa.array(key)], ["doc_id", "tokens", "key"])

    return vectors.mapInArrow(run, "doc_id long, tokens long, key long")


def _repeats(rows: DataFrame) -> DataFrame:
    """rows with the column copy: 0, 1, 2, ... among rows that are alike, without a window over them."""
    same = ["key", "doc_id", "tokens"]
    ranked = common.settle(global_rank(rows, same), "ranked")
    first = ranked.groupBy(*same).agg(F.min("rn").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    first = common.settle(first.select(F.col("key").alias("f_key"), F.col("doc_id").alias("f_doc"), F.col("tokens").alias("f_tokens"), "first"), "first")
    match = (F.col("key") == F.col("f_key")) & F.col("doc_id").eqNullSafe(F.col("f_doc")) & (F.col("tokens") == F.col("f_tokens"))
    return ranked.join(common.maybe_broadcast(first, 64), match, "left").select(*same, F.coalesce(F.col("rn") - F.col("first"), F.lit(0)).alias("copy"))


def pack(docs: DataFrame, capacity: int = CAPACITY, apart: bool = False) -> DataFrame:
    """(pack_id, pack_start, doc_id, doc_start, doc_end): words doc_start to doc_end of the document lie in the pack from pack_start on.

    With apart there is a column copy, the number of the repeat, which comes before the place on the curve.
    """
    with common.Scratch(docs.sparkSession) as scratch:
        return scratch.keep(common.settle(_pack(docs, capacity, apart), "packs"))


def _pack(docs: DataFrame, capacity: int, apart: bool) -> DataFrame:
    rows, order, more = keyed(docs), ["key", "doc_id", "tokens"], []
    if apart:
        rows, order, more = _repeats(rows), ["copy", *order], ["copy"]
    laid = common.prefix_sums(rows, order, "tokens", "stop")
    begin, size = F.col("stop") - F.col("tokens"), F.lit(capacity)
    last = F.floor((begin + F.greatest(F.col("tokens"), F.lit(1)) - 1) / size)
    pieces = laid.select("doc_id", *more, "tokens", begin.alias("begin"), F.explode(F.sequence(F.floor(begin / size), last)).alias("pack_id"))
    low = F.greatest(F.col("begin"), F.col("pack_id") * size)
    high = F.least(F.col("begin") + F.col("tokens"), (F.col("pack_id") + 1) * size)
    return pieces.select("pack_id", (low - F.col("pack_id") * size).alias("pack_start"), "doc_id", *more, (low - F.col("begin")).alias("doc_start"), (high - F.col("begin")).alias("doc_end"))


def opquery(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
