"""Quality rules: hashed word and character n-gram logistic regression, calibrated, against a fixed threshold.

The score of a document is a bias plus the mean weight of its word unigrams and bigrams plus the mean weight of its 3-
to 5-byte character n-grams, each looked up in a hashed table. A word that repeats the one before it counts as one and the
same token, so that repetition is seen whatever the word. Weights are fitted on labelled rows of labels.quality with L2
penalty by Adam on the logistic loss; a Platt scaling fitted on rows held out from that makes the score a probability.
Scoring runs in Arrow batches over whole texts; the table is broadcast (4 * 2**BITS bytes twice, whatever the corpus).

A probability of at least THRESHOLD keeps a document, one of at least SURE calls it sure.

Only training is bounded: at most SAMPLE_ROWS labelled documents, chosen by hash of doc_id, and of each the whole text.

Defined results: null and empty texts have no n-grams and score the bias; without both classes among the labels every
document scores 1 (nothing is known against it); a doc_id with several labels counts by its lowest quality; labels
without a document and null labels are ignored. Repeated rows score alike, and a probability equal to a threshold
reaches it. A very long text counts whole, in blocks of fixed room. An empty table gives an empty result. Extra columns are carried through untouched.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, textvec

BITS = 18
SAMPLE_ROWS = 2500
THRESHOLD, SURE = 0.5, 0.9
SEED = "quality-1"
HELD_OUT = 4


def labelled_sample(docs: DataFrame, labels: DataFrame, rows: int, seed: str = SEED) -> DataFrame:
    """(doc_id, text, quality) of at most rows labelled doc_ids, the first ones in the order of a hash of the id."""
    labels = labels.filter("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    some = labels.orderBy(F.md5(F.concat(F.col("doc_id").cast("string"), F.lit(seed))), "doc_id").limit(rows)
    return common.need(docs, "doc_id", "text").join(F.broadcast(some), "doc_id")  # bounded by rows


def _word_hashes(data: np.ndarray, at: np.ndarray, mask: np.uint32) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(buckets, start, end) of the words and of their pairs: a document's own are buckets[start:end]."""
    with np.errstate(over="ignore"):
        words, word_at = textvec.words(data, at)
        again = np.zeros(len(words), bool)
        again[1:] = words[1:] == words[:-1]
        again[word_at[:-1][word_at[:-1] < len(words)]] = False
        words[again] = np.uint64(0x2545F4914F6CDD1D)
        yield (words >> np.uint64(20)).astype(np.uint32) & mask, word_at[:-1], word_at[1:]
        pairs = textvec.mix(words[:-1] * np.uint64(0xD6E8FEB86659FD93) + words[1:]) if len(words) > 1 else words[:0]
        yield (pairs >> np.uint64(20)).astype(np.uint32) & mask, word_at[:-1], np.maximum(word_at[:-1], word_at[1:] - 1)


def _char_hashes(data: np.ndarray, at: np.ndarray, mask: np.uint32, block: int = 4 * textvec.CHUNK) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The same of the runs of 3 to 5 bytes, block by block, so that room doesn't grow with a text."""
    for low in range(0, len(data), block):
        high = min(len(data), low + block)
        with np.errstate(over="ignore"):
            run = data[low : high + 4].astype(np.uint32) + np.uint32(1)
            base = run.copy()
            for n in range(2, 6):
                run = run[:-1] * np.uint32(0x01000193) + base[n - 1 :] if len(run) > 1 else run[:0]
                if n >= 3:
                    bucket = run * np.uint32(0x9E3779B1) + np.uint32(n)
                    bucket ^= bucket >> np.uint32(15)
                    bucket &= mask
                    start, end = (np.clip(x - low, 0, min(high - low, len(bucket))) for x in (at[:-1], np.maximum(at[:-1], at[1:] - (n - 1))))
                    yield bucket, start, end


@dataclass
class Model:
    """Weights for word n-grams and character n-grams, bias, and the calibration p = 1 / (1 + exp(-(slope * score + shift)))."""

    word: np.ndarray
    char: np.ndarray
    bias: float
    slope: float
    shift: float

    def scores(self, data: np.ndarray, at: np.ndarray) -> np.ndarray:
        mask = np.uint32(len(self.word) - 1)
        sums, counts = np.zeros((2, len(at) - 1)), np.zeros((2, len(at) - 1))
        for half, (table, kinds) in enumerate(((self.word, _word_hashes(data, at, mask)), (self.char, _char_hashes(data, at, mask)))):
            for bucket, start, end in kinds:
                total = np.zeros(len(bucket) + 1)
                np.cumsum(table[bucket], dtype=np.float64, out=total[1:])
                sums[half] += total[end] - total[start]
                counts[half] += end - start
        return self.bias + (sums / np.maximum(counts, 1)).sum(0)

    def probability(self, score: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * score + self.shift, -50, 50)))


def _platt(score: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift by damped Newton steps on smoothed targets."""
    pos, neg = y.sum(), len(y) - y.sum()
    target = np.where(y > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    unit = max(float(score.std()), 1e-9)
    x = np.c_[score / unit, np.ones_like(score)]

    def loss(w):
        z = x @ w
        return float(np.sum(np.logaddexp(0, z) - target * z) + 0.01 * w[0] ** 2)

    w = np.array([1.0, 0.0])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -50, 50)))
        hess = (x * (p * (1 - p))[:, None]).T @ x + np.diag([0.02, 1e-6])
        step = np.linalg.solve(hess, x.T @ (p - target) + np.array([0.02 * w[0], 0.0]))
        size = 1.0
        while size > 1e-4 and loss(w - size * step) > loss(w):
            size /= 2
        w = w - size * step
        if np.abs(step).max() < 1e-8:
            break
    return float(max(w[0], 1e-3) / unit), float(w[1])


def features_of(data: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(features, values) of one text: the share of each n-gram among its words' or characters', characters after words."""
    features, values, at, mask = [], [], np.array([0, len(data)]), np.uint32(size - 1)
    for half, kinds in enumerate((_word_hashes(data, at, mask), _char_hashes(data, at, mask))):
        found, n, seen = np.zeros(0, np.int64), np.zeros(0, np.int64), 0
        for bucket, start, end in kinds:
            own, times = np.unique(bucket[start[0] : end[0]], return_counts=True)
            seen += int(end[0] - start[0])
            found, place = np.unique(np.concatenate([found, own.astype(np.int64)]), return_inverse=True)
            n = np.bincount(place, np.concatenate([n, times]), len(found))
        features.append(found + half * size)
        values.append(n / max(1, seen))
    return np.concatenate(features).astype(np.int32), np.concatenate(values).astype(np.float32)


def _spans(at: np.ndarray, most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Runs of rows of about so many entries."""
    first, n = 0, len(at) - 1
    while first < n:
        end = max(first + 1, int(np.searchsorted(at, at[first] + most, "right")) - 1)
        yield first, min(end, n)
        first = end


def fit(f: np.ndarray, v: np.ndarray, at: np.ndarray, quality: np.ndarray, bits: int = BITS, steps: int = 60, rate: float = 0.5, penalty: float = 1e-4) -> Model | None:
    """The model of rows of (features, values, offsets), None without both classes. Every HELD_OUT-th row only calibrates."""
    y = (np.asarray(quality) > 0).astype(float)
    if not len(y) or y.min() == y.max():
        return None
    size = 1 << bits
    held = np.arange(len(y)) % HELD_OUT == 0 if len(y) >= 40 else np.zeros(len(y), bool)
    if y[~held].min() == y[~held].max():
        held[:] = False
    pos = y[~held].mean()
    weight = np.where(held, 0.0, np.where(y > 0, 0.5 / pos, 0.5 / (1 - pos))) / (~held).sum()  # classes count alike
    spans = list(_spans(at))

    def score(w: np.ndarray, bias: float) -> np.ndarray:
        out = np.full(len(y), bias)
        for a, b in spans:
            total = np.zeros(at[b] - at[a] + 1)
            np.cumsum(w[f[at[a] : at[b]]] * v[at[a] : at[b]], dtype=np.float64, out=total[1:])
            out[a:b] += total[at[a + 1 : b + 1] - at[a]] - total[at[a:b] - at[a]]
        return out

    w, first, second, bias = np.zeros(2 * size, np.float32), np.zeros(2 * size), np.zeros(2 * size), 0.0
    for k in range(1, steps + 1):
        p = 1 / (1 + np.exp(-np.clip(score(w, bias), -50, 50)))
        g = weight * (p - y)
        grad = penalty / size * w.astype(np.float64)
        for a, b in spans:
            grad += np.bincount(f[at[a] : at[b]], v[at[a] : at[b]] * np.repeat(g[a:b], np.diff(at[a : b + 1])), 2 * size)
        first = 0.9 * first + 0.1 * grad
        second = 0.99 * second + 0.01 * grad * grad
        w -= (rate * (first / (1 - 0.9**k)) / (np.sqrt(second / (1 - 0.99**k)) + 1e-7)).astype(np.float32)
        bias -= rate * float(g.sum())
    model = Model(w[:size].copy(), w[size:].copy(), bias, 1.0, 0.0)
    use = held if held.any() and 0 < y[held].mean() < 1 else ~np.zeros(len(y), bool)
    model.slope, model.shift = _platt(score(w, bias)[use], y[use])
    return model


def fit_texts(texts: list[str], quality: np.ndarray, bits: int = BITS) -> Model | None:
    rows = [features_of(np.frombuffer(t.encode(), np.uint8), 1 << bits) for t in texts]
    return fit(np.concatenate([r[0] for r in rows]), np.concatenate([r[1] for r in rows]), np.r_[0, np.cumsum([len(r[0]) for r in rows])], quality, bits)


def train(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> Model | None:
    """Texts become features on the executors; the driver gets at most 2 * 2**BITS features of 8 bytes for each of the rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, at = textvec.buffers(batch.column("text"))
            for i in range(batch.num_rows):
                f, v = features_of(raw[at[i] : at[i + 1]], 1 << BITS)
                one = batch.slice(i, 1)
                yield pa.RecordBatch.from_arrays([one.column("doc_id"), one.column("h"), one.column("quality"), pa.array([f.tobytes()], pa.binary()), pa.array([v.tobytes()], pa.binary())], ["doc_id", "h", "quality", "f", "v"])

    sample = labelled_sample(docs, labels, rows).select("doc_id", F.xxhash64("text").alias("h"), "quality", "text")
    found = sample.mapInArrow(run, "doc_id long, h long, quality int, f binary, v binary").toArrow().to_pandas()
    found = found.drop_duplicates(["doc_id", "h"]).sort_values(["doc_id", "h"], kind="stable").sample(frac=1.0, random_state=11)
    if not len(found):
        return None
    f, v = (np.frombuffer(b"".join(found[c]), kind) for c, kind in (("f", np.int32), ("v", np.float32)))
    at = np.r_[0, np.cumsum(found["f"].map(len).to_numpy() // 4)]
    quality = found["quality"].to_numpy()
    del found
    return fit(f, v, at, quality)


def score(docs: DataFrame, model: Model | None, out: str, columns: list[str] | None = None) -> DataFrame:
    """docs (or only the columns named) with the probability of good quality in the column out."""
    columns = columns or docs.columns
    if model is None:
        return docs.select(*columns, F.lit(1.0).alias(out))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    text = common.fresh(docs, "text_")
    rows = docs.select(*columns, F.col("text").alias(text))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            raw, offsets = textvec.buffers(batch.column(batch.num_columns - 1))
            found = np.empty(batch.num_rows)
            for first, end, data, at in textvec.chunks(raw, offsets):
                found[first:end] = known.probability(known.scores(data, at))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(found)], [*columns, out])

    schema = docs.select(*columns).schema.add(out, "double")
    return rows.mapInArrow(run, schema)


def keep(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs whose probability of good quality is at least the threshold; all columns stay."""
    out = common.fresh(docs, "p_quality")
    return score(docs, train(docs, labels), out).filter(F.col(out) >= threshold).drop(out)


def opquery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, p_quality, keep, sure) of the documents that the rules keep."""
    docs = common.need(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id", "text")
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score(docs, model, "p_quality", ["doc_id"]).filter(F.col("p_quality") >= THRESHOLD).withColumn("keep", F.lit(True)).withColumn("sure", F.col("p_quality") >= SURE)
