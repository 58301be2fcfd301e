"""Building datasets by a generator: requests, noisy replies, salvage, dedup and bounded over-generation.

The generator is injected: a function of (request number, prompt) that returns a reply's text. Requests are rows, so they run in
parallel in Arrow batches wherever the tasks are; a request that fails is a row with its error and costs nothing else.
Which examples are kept depends on request numbers and places only, never on which reply came first.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillframe.cluster import prefix_sums, settle
from quillframe.operators import dataset

#: Share asked for beyond the target, and how many times the requests for it may be sent.
SURPLUS, PATIENCE = 1.3, 3
ROLE = "You write training examples for a model that turns requests into calls and passages into records. Reply with JSON only."
PROMPT = """These are the schemas that may be called, as JSON:
{tools}

Write a JSON array of {count} examples that differ from one another. An example is an object with
- "query": what somebody asks for, or a passage that a record is to be read from;
- "reasoning": one line that says where in the query each argument comes from;
- "answers": a list of objects with "name" and "arguments", which use these schemas only and hold only what the query says.
Some need one call, some several, and about {off} of them none: no schema serves those, and their "answers" are empty.
Vary wording, values and schemas. Reply with the array and nothing else."""

Generator = Callable[[int, str], str]


def prompt_of(tools: list | str, count: int, off: int = 3) -> str:
    """The user turn of one request; the tools may be given as JSON text."""
    return PROMPT.format(tools=tools if isinstance(tools, str) else json.dumps(tools, indent=2), count=count, off=off)


def replies(requests: DataFrame, generator: Generator, prompt: str) -> DataFrame:
    """(request, reply, error) of each row (request)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, errors = [], []
            for number in batch.column("request").to_pylist():
                try:
                    texts.append(generator(number, prompt))
                    errors.append(None)
                except Exception as problem:
                    texts.append(None)
                    errors.append(str(problem))
            yield pa.RecordBatch.from_arrays([batch.column("request"), pa.array(texts, pa.string()), pa.array(errors, pa.string())], ["request", "reply", "error"])

    return requests.select("request").mapInArrow(run, "request long, reply string, error string")


def examples_of(found: DataFrame) -> DataFrame:
    """(request, pos, query, answers, key) of the examples in replies; key is what makes two of them the same."""
    rows = dataset.salvaged_examples(found, "reply", ["request"])
    key = F.concat_ws("\x1f", dataset.dedup_key(F.coalesce("query", F.lit(""))), F.coalesce("answers", F.lit("null")))
    return rows.withColumn("key", key)


def distinct_examples(rows: DataFrame) -> DataFrame:
    """The first example of each key in the order of (request, pos)."""
    keep = ["request", "pos", "query", "answers"]
    return dataset.first_wins(rows, ["key"], ["request", "pos"], keep).select(*keep, "key")


def requests_for(target: int, batch: int, width: int) -> tuple[int, int]:
    """(requests of the first round, requests at most) for so many examples."""
    surplus = int(target * SURPLUS)
    return min(width, max(1, math.ceil(surplus / batch))), max(1, surplus // batch * PATIENCE)


def generate_dataset(spark: SparkSession, generator: Generator, tools: list | str, target: int, batch: int = 25, width: int = 64, off: int = 3) -> DataFrame:
    """(request, pos, query, answers, tools): exactly target distinct examples, or all there are when the requests are used up.

    Each round sends what is missing with a surplus, at most width requests at once, and is written before the next begins.
    """
    prompt = prompt_of(tools, batch, off)
    tools_text = tools if isinstance(tools, str) else json.dumps(tools)
    round_, most = requests_for(target, batch, width)
    round_ = min(round_, most)
    sent, have, kept = 0, 0, None
    while round_ > 0:
        requests = spark.range(sent, sent + round_, 1, round_).withColumnRenamed("id", "request")
        fresh = examples_of(replies(requests, generator, prompt).filter("error is null"))
        kept = settle(distinct_examples(fresh if kept is None else kept.unionByName(fresh)), "generated")
        sent, have = sent + round_, kept.count()
        missing = target - have
        round_ = 0 if missing <= 0 else min(width, max(1, math.ceil(missing * SURPLUS / batch)), most - sent)
    out = kept
    if have > target:
        one = prefix_sums(kept.withColumn("one", F.lit(1).cast("long")), ["request", "pos"], "one", "rank")
        out = one.filter(F.col("rank") <= target)
    return out.select("request", "pos", "query", "answers", F.lit(tools_text).alias("tools"))


def augment(seed: DataFrame, generated: DataFrame) -> DataFrame:
    """(query, answers, tools): the examples there were, then those generated; they aren't deduplicated against each other."""
    columns = ["query", "answers", "tools"]
    return seed.select(*columns).unionByName(generated.select(*columns))


def first_tools(seed: DataFrame, order: str) -> str:
    """The catalogue of a seed's tools, as JSON text: the first schema of each name, in the order in which names appear."""
    items = seed.select(order, F.posexplode(F.try_variant_get(F.try_parse_json("tools"), "$", "array<variant>")).alias("pos", "v"))
    named = items.select(order, "pos", F.try_variant_get("v", "$.name", "string").alias("name"), F.to_json("v").alias("tool")).filter("name != ''")
    first = named.groupBy("name").agg(F.min(F.struct(order, "pos", "tool")).alias("x"))
    rows = first.withColumn("rn", F.row_number().over(W.orderBy("x"))).orderBy("rn").select("x.tool").collect()  # a row a tool
    return "[" + ",".join(r.tool for r in rows) + "]"
