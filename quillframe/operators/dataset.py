"""Preparing training examples: key requirements, first-wins dedup, rendering, masks, buckets, hold-out and batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillframe.cluster import global_rank

PAD, EOS, BOS, UNK = 0, 1, 2, 3
IM_START, IM_END = "<|im_start|>", "<|im_end|>"
TOOLS, CALL, THINK = ("<tools>", "</tools>"), ("<tool_call>", "</tool_call>"), ("<think>", "</think>")
EDGE_SPACE = r"(?U)^\s+|\s+$"


def strip(text: Column) -> Column:
    """White space off both ends, that of Unicode included."""
    return F.regexp_replace(text, EDGE_SPACE, "")


def salvage_array(text: Column) -> Column:
    """The array between the first [ and the last ] as array<variant>; null where that isn't JSON."""
    return F.try_variant_get(F.try_parse_json(F.regexp_extract(text, r"(?s)\[.*\]", 0)), "$", "array<variant>")


def salvaged_examples(df: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """One row for each object of the salvaged array that has both query and answers, whatever their values."""
    rows = df.select(*keep, F.posexplode(salvage_array(F.col(text))).alias("pos", "item"))
    has = lambda key: F.try_variant_get("item", "$." + key, "variant").isNotNull()
    rows = rows.filter(F.schema_of_variant("item").startswith("OBJECT") & has("query") & has("answers"))
    return rows.select(*keep, "pos", F.try_variant_get("item", "$.query", "string").alias("query"), F.to_json(F.try_variant_get("item", "$.answers", "variant")).alias("answers"))


def first_wins(df: DataFrame, keys: list[str], order: list[str], keep: list[str]) -> DataFrame:
    """The first row by the order for each value of the keys: a partial aggregate, no sort of the groups."""
    first = F.min_by(F.struct(*keep), F.struct(*order)).alias("first")
    return df.groupBy(*keys).agg(first, F.count(F.lit(1)).alias("copies")).select(*keys, *[F.col(f"first.{c}").alias(c) for c in keep], "copies")


def dedup_key(query: Column) -> Column:
    return F.lower(strip(query))


def render_prompt(system: Column, tools: Column, query: Column) -> Column:
    """The prompt of an example; a system turn only where there is one."""
    head = F.when(F.coalesce(system, F.lit("")) != "", F.concat(F.lit(IM_START + "system\n"), system, F.lit(IM_END + "\n"))).otherwise("")
    return F.concat(head, F.lit(IM_START + "user\n" + TOOLS[0]), F.coalesce(tools, F.lit("[]")), F.lit(TOOLS[1] + "\n"), query, F.lit(IM_END + "\n" + IM_START + "assistant\n"))


def render_target(reasoning: Column, answers: Column) -> Column:
    """What is to be learnt: the thought, empty or not, and the calls."""
    return F.concat(F.lit(THINK[0]), F.coalesce(reasoning, F.lit("")), F.lit(THINK[1] + "\n" + CALL[0]), F.coalesce(answers, F.lit("[]")), F.lit(CALL[1] + IM_END))


def render_chat(turns: DataFrame) -> DataFrame:
    """(conv_id, n_turns, rendered): the turns of each conversation in order, each between its markers."""
    turn = F.struct("turn", F.concat(F.lit(IM_START), "role", F.lit("\n"), "text", F.lit(IM_END)).alias("part"))
    rows = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("t"))
    return rows.select("conv_id", F.size("t").alias("n_turns"), F.array_join("t.part", "\n").alias("rendered"))


def encode_and_mask(prompt: Column, target: Column, max_len: int) -> tuple[Column, Column]:
    """(ids, mask) of fixed width: begin, prompt, target, end, cut on the right, padded on the right; the mask covers target and end."""
    ids = F.concat(F.array(F.lit(BOS)), prompt, target, F.array(F.lit(EOS)))
    mask = F.concat(F.array_repeat(F.lit(0), F.size(prompt) + 1), F.array_repeat(F.lit(1), F.size(target) + 1))
    pad = lambda a, x: F.slice(F.concat(F.slice(a, 1, max_len), F.array_repeat(F.lit(x), max_len)), 1, max_len)
    return pad(ids, PAD), pad(mask, 0)


def code_points(text: Column) -> Column:
    """Code points as stand-in tokens."""
    return F.when(text == "", F.array().cast("array<int>")).otherwise(F.transform(F.split(text, ""), lambda c: F.ascii(c)))


def length_bucket(length: Column, cap: int, first: int = 128) -> Column:
    """The least first * 2**k that holds min(length, cap), and cap at most."""
    out, size = F.lit(cap), first
    sizes = []
    while size < cap:
        sizes.append(size)
        size *= 2
    for size in reversed(sizes):
        out = F.when(length <= size, F.lit(size)).otherwise(out)
    return out


def holdout(df: DataFrame, key: str, seed: str = "0", share: float = 0.1) -> DataFrame:
    """Adds is_val: exactly min(int(n * share), n - 1) rows, the first in the order of a portable hash of the key."""
    n = df.count()
    size = max(0, min(int(n * share), n - 1))
    ranked = global_rank(df.withColumn("h", F.md5(F.concat(F.col(key).cast("string"), F.lit(":" + seed)))), ["h", key])
    return ranked.withColumn("is_val", (F.col("rn") <= size).cast("int")).drop("h", "rn")


def batches(df: DataFrame, key: str, size: int, seed: str = "0") -> DataFrame:
    """Adds step and slot: seeded order, batches of size rows, a short last one."""
    ranked = global_rank(df.withColumn("h", F.md5(F.concat(F.col(key).cast("string"), F.lit(":" + seed)))), ["h", key])
    return ranked.withColumn("step", F.floor((F.col("rn") - 1) / size)).withColumn("slot", F.pmod(F.col("rn") - 1, F.lit(size))).drop("h", "rn")


def weights_spec(spec: Column) -> tuple[Column, Column]:
    """(repository, file or null) of a path-like name."""
    parts = F.filter(F.split(spec, "/"), lambda p: p != "")
    file = F.array_join(F.slice(parts, 3, F.greatest(F.size(parts), F.lit(1))), "/")
    return F.array_join(F.slice(parts, 1, 2), "/"), F.nullif(file, F.lit(""))


def head_name(checkpoint: Column, suffix: str) -> Column:
    """Base name without extension and step number, with a suffix."""
    base = F.regexp_replace(F.regexp_extract(checkpoint, "([^/]*)$", 1), r"(?<!^)\.[^.]*$", "")
    return F.concat(F.regexp_replace(base, r"_step_[0-9]+$", ""), F.lit("_" + suffix))


def drop_noisy_blocks(lines: DataFrame, stream: str, number: str, text: str, header: str, noisy: str) -> DataFrame:
    """Without the blocks that a noisy header opens; a block lasts until the next header of its stream."""
    from pyspark.sql import Window as W

    head = F.when(F.col(text).rlike(header), F.col(text).rlike(noisy))
    w = W.partitionBy(stream).orderBy(number)
    return lines.withColumn("_n", F.coalesce(F.last(head, ignorenulls=True).over(w), F.lit(False))).filter(~F.col("_n")).drop("_n")
