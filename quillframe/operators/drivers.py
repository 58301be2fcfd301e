"""From examples and a checkpoint to an adapter, and from a checkpoint with or without one to an archive.

Tuning is zeroth-order: the loss is taken at the adapter plus and minus a random direction, and the adapter moves along it by
the difference (simultaneous perturbation). It needs forward passes alone, which run over the examples of a batch
in parallel in Arrow batches; a direction is known from its seed, so only two sums come back from each step.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillframe.cluster import settle
from quillframe.functions.bpe import Pieces
from quillframe.operators import dataset, network
from quillframe.sources import archive, jsonl

TARGETS = (".q", ".k", ".v", ".gate", ".out")


def encoded(spark: SparkSession, path: str, pieces: Pieces, cap: int) -> tuple[DataFrame, int]:
    """((id, ids, mask) of the examples of a JSON-lines file, the width that holds the longest)."""
    rows = jsonl.read_examples(spark, path)
    rows = rows.select(dataset.render_prompt(F.col("system"), F.col("tools"), F.col("query")).alias("p"), dataset.render_target(F.col("reasoning"), F.col("answers")).alias("t"))
    shared = spark.sparkContext.broadcast(pieces)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p, t = (shared.value.batch(batch.column(c).to_pylist()) for c in ("p", "t"))
            yield pa.RecordBatch.from_arrays([pa.array(p, pa.list_(pa.int32())), pa.array(t, pa.list_(pa.int32()))], ["p", "t"])

    tokens = settle(rows.mapInArrow(run, "p array<int>, t array<int>").withColumn("id", F.xxhash64("p", "t")), "tokens")
    longest = tokens.agg(F.max(F.size("p") + F.size("t") + 2)).first()[0]
    if longest is None:
        raise ValueError(f"no usable examples in {path}")
    width = min(cap, 128 * -(-longest // 128))
    ids, mask = dataset.encode_and_mask(F.col("p"), F.col("t"), width)
    return settle(tokens.select("id", ids.alias("ids"), mask.alias("mask")), "encoded"), width


def losses(rows: DataFrame, config: network.Config, params: list[dict[str, np.ndarray]]) -> list[float]:
    """The masked mean loss of rows (ids, mask) under each set of parameters: sums by task, one row back."""
    shared = rows.sparkSession.sparkContext.broadcast([network.Network(config, p) for p in params])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = np.zeros(len(params)), 0.0
        for batch in batches:
            for ids, mask in zip(batch.column("ids"), batch.column("mask")):
                ids, on = (x.values.to_numpy() for x in (ids, mask))
                end = int(np.flatnonzero(ids != network.PAD)[-1]) + 1
                on = on[1:end].astype(bool)
                count += on.sum()
                for i, model in enumerate(shared.value):
                    p = network.softmax(model.logits(ids[: end - 1]))
                    total[i] -= np.log(np.maximum(p[np.arange(end - 1), ids[1:end]], 1e-12))[on].sum()
        yield pa.RecordBatch.from_arrays([pa.array([total.tolist()]), pa.array([count])], ["total", "n"])

    sums = rows.select("ids", "mask").mapInArrow(run, "total array<double>, n double")
    sums = sums.agg(*[F.sum(F.get("total", F.lit(i))).alias(f"t{i}") for i in range(len(params))], F.sum("n").alias("n")).first()
    return [(sums[i] or 0.0) / max(sums.n or 0.0, 1.0) for i in range(len(params))]


def finetune(
    spark: SparkSession, examples: str, checkpoint: str, out: str, pieces: Pieces, *, epochs: int = 3, batch: int = 16, rate: float = 1e-2, rank: int = 16, alpha: float = 32.0,
    cap: int = 1024, hold_out: float = 0.1, reach: float = 1e-2, seed: int = 0, progress: Callable[[str], None] = print,
) -> dict:
    """Fit a low-rank adapter to examples and write it; gives the losses after each epoch, on the last batch and held out."""
    from quillframe.operators.training import warmup_rate

    params, config, _ = network.read_checkpoint(checkpoint)
    params = {k: x.astype(np.float64) for k, x in params.items()}
    rows, width = encoded(spark, examples, pieces, min(cap, config.longest))
    split = settle(dataset.holdout(rows, "id", str(seed), hold_out), "split")
    train, held = split.filter("is_val = 0").drop("is_val"), split.filter("is_val = 1")
    count, n_held = train.count(), held.count()
    progress(f"data {count} examples of width {width}, {n_held} held out")
    names = [n for n in params if n.endswith(TARGETS) and np.abs(params[n]).max() > 1e-6]
    adapter, scale = network.low_rank(params, names, rank, seed), alpha / rank
    steps = -(-count // batch)
    total, report, history, at = epochs * steps, max(1, epochs * steps // 50), [], 0

    def moved(direction: np.random.Generator, size: float) -> dict[str, tuple[np.ndarray, np.ndarray]]:
        return {n: (a + size * direction.standard_normal(a.shape), b + size * direction.standard_normal(b.shape)) for n, (a, b) in adapter.items()}

    for epoch in range(epochs):
        order = settle(dataset.batches(train, "id", batch, f"{seed}-{epoch}"), "batches")
        for step in range(steps):
            part, key = order.filter(F.col("step") == step), (seed, epoch, step)
            up, down = (network.merge(params, moved(np.random.default_rng(key), s), scale) for s in (reach, -reach))
            high, low = losses(part, config, [up, down])
            slope = float(np.clip((high - low) / (2 * reach), -1, 1))  # as long as one unit at most
            adapter = moved(np.random.default_rng(key), -warmup_rate(at, total, rate) * slope)
            at += 1
            if at % report == 0:
                progress(f"step {at}/{total} loss {(high + low) / 2:.4f}")
        val = losses(held, config, [network.merge(params, adapter, scale)])[0] if n_held else None
        history.append({"epoch": epoch + 1, "loss": (high + low) / 2, "val": val})
        progress(f"epoch {epoch + 1}/{epochs} loss {history[-1]['loss']:.4f}" + (f" val {val:.4f}" if n_held else ""))
    network.write_adapter(out, adapter, scale, rank, checkpoint)
    progress(f"adapter {out}")
    return {"history": history, "adapter": out, "examples": count, "width": width}


def build(checkpoint: str, out: str, adapter: str | None = None, bits: dict[str, float] | None = None, default: float = 4, group: int = 64, pieces: Pieces | None = None) -> dict:
    """Write a checkpoint, merged with an adapter if one is given, as an archive in canonical order; gives its place, bytes and tensors."""
    params, _, _ = network.read_checkpoint(checkpoint)
    if adapter:
        pairs, head = network.read_adapter(adapter)
        params = network.merge({k: x.astype(np.float64) for k, x in params.items()}, pairs, head["scale"])
    tensors: list[tuple[str, np.ndarray | bytes]] = [(n, np.atleast_1d(x)) for n, x in network.ordered(params)]
    if pieces:
        tensors.append(("tokenizer", pieces.to_blob()))
    return {"path": out, "bytes": archive.write(tensors, out, bits=bits, default=default, group=group), "tensors": len(tensors)}
