"""Incremental first-wins dedup and conversation state on streams."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def dedup_stream(stream: DataFrame, key: Column, event_time: str, delay: str | None = None) -> DataFrame:
    """The first row of each key to arrive; with a delay the state of a key is dropped once the watermark has passed it."""
    keyed = stream.withColumn("_key", key)
    out = keyed.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(["_key"]) if delay else keyed.dropDuplicates(["_key"])
    return out.drop("_key")


def first_wins(stream: DataFrame, keys: list[str], order: list[str], keep: list[str]) -> DataFrame:
    """(keys, keep, n): the first row of each key by an order, whichever way rows arrive; for the update mode."""
    first = F.min_by(F.struct(*keep), F.struct(*order)).alias("first")
    return stream.groupBy(*keys).agg(first, F.count(F.lit(1)).alias("n")).select(*keys, *[F.col(f"first.{c}").alias(c) for c in keep], "n")


def sessions(stream: DataFrame, by: str, event_time: str, gap: str, delay: str) -> DataFrame:
    """(by, begin, end, n) of sessions that end at a gap; late rows beyond the delay are left out. A gap of exactly that length joins."""
    w = F.session_window(event_time, gap)
    return stream.withWatermark(event_time, delay).groupBy(by, w.alias("w")).agg(F.count(F.lit(1)).alias("n")).select(by, F.col("w.start").alias("begin"), F.col("w.end").alias("end"), "n")


def conversation_state(stream: DataFrame, by: str, kind: str, reset: str, order: list[str]) -> DataFrame:
    """(by, turns, resets): the turns since the last reset and the resets so far, after each batch that touches the conversation.

    The rows of a batch are taken in the order given, whatever way they arrive.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        turns, resets = state.get if state.exists else (0, 0)
        for x in pd.concat(list(frames)).sort_values(order)[kind]:
            turns, resets = (0, resets + 1) if x == reset else (turns + 1, resets)
        state.update((turns, resets))
        yield pd.DataFrame({by: [key[0]], "turns": [turns], "resets": [resets]})

    key_type = dict(stream.dtypes)[by]
    return stream.groupBy(by).applyInPandasWithState(step, f"{by} {key_type}, turns long, resets long", "turns long, resets long", "update", GroupStateTimeout.NoTimeout)


def run_to_table(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Everything that is available now, through the stream and into a table of batches."""
    spark = stream.sparkSession

    def save(batch: DataFrame, number: int) -> None:
        batch.withColumn("_batch", F.lit(number)).write.mode("overwrite").parquet(f"{path}/batch={number}")

    stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(save).start().awaitTermination()
    return spark.read.parquet(f"{path}/batch=*")
