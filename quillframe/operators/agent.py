"""Calls: retrieve tools, propose, check, run in a bounded loop, gate by confidence and evidence, extract."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillframe.cluster import BROADCAST_BYTES
from quillframe.functions import schema as s
from quillframe.functions import vectors as v

MAX_STEPS, WIDTH = 8, 5
#: Tools of one block of a catalogue.
BLOCK = 4096


def retrieve(queries: DataFrame, tools: DataFrame, k: int = WIDTH) -> DataFrame:
    """(id, tool, score, rank): the k tools of the largest dot product for each query, ties by tool.

    queries: (id, q), tools: (tool, e), both of unit vectors. The catalogue is taken in blocks of BLOCK tools, each of which is
    one matrix; every query meets each block once, in Arrow batches, and keeps the k best of it, so what is
    ranked afterwards is k rows a query and block. Blocks are broadcast if their counted size allows.
    """
    count, width = tools.count(), tools.select(F.max(F.size("e"))).first()[0] or 0
    blocks = max(1, -(-count // BLOCK))
    packed = tools.groupBy(F.pmod(F.xxhash64("tool"), F.lit(blocks)).alias("block")).agg(F.sort_array(F.collect_list(F.struct("tool", "e"))).alias("t"))
    packed = packed.select("block", F.col("t.tool").alias("names"), F.flatten("t.e").alias("matrix"))
    pairs = queries.select("id", "q").crossJoin(F.broadcast(packed)) if count * width * 8 <= BROADCAST_BYTES else queries.select("id", "q", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block")).join(packed, "block")
    kinds = {f.name: f.dataType for f in [*queries.schema.fields, *tools.schema.fields]}

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, names, scores, kept = [], [], [], {}
            for i in range(batch.num_rows):
                block = batch.column("block")[i].as_py()
                if block not in kept:  # a few blocks at a time
                    kept = {block: (batch.column("names")[i].values, batch.column("matrix")[i].values.to_numpy(zero_copy_only=False))}
                tool, matrix = kept[block]
                score = np.round(matrix.reshape(len(tool), -1) @ batch.column("q")[i].values.to_numpy(zero_copy_only=False), 6)
                top = np.lexsort((np.arange(len(score)), -score))[:k]
                ids.append(batch.column("id").take(pa.array(np.full(len(top), i))))
                names.append(tool.take(pa.array(top)))
                scores.append(score[top])
            if ids:
                yield pa.RecordBatch.from_arrays([pa.concat_arrays(ids), pa.concat_arrays(names), pa.array(np.concatenate(scores))], ["id", "tool", "score"])

    schema = T.StructType([T.StructField("id", kinds["id"]), T.StructField("tool", kinds["tool"]), T.StructField("score", T.DoubleType())])
    w = W.partitionBy("id").orderBy(F.col("score").desc(), "tool")
    return pairs.mapInArrow(best, schema).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def fingerprint(schema: Column) -> Column:
    return F.sha2(schema, 256)


def refresh(index: DataFrame, tools: DataFrame) -> DataFrame:
    """(tool, action) with action keep, embed or drop: only what is new or changed is embedded again."""
    both = index.select("tool", F.col("print").alias("old")).join(tools.select("tool", F.col("print").alias("new")), "tool", "full")
    action = F.when(F.col("new").isNull(), "drop").when(F.col("old").eqNullSafe(F.col("new")), "keep").otherwise("embed")
    return both.select("tool", action.alias("action"))


def gate(head: Column, decoded: Column, threshold: float) -> Column:
    """accept where the smaller confidence reaches the threshold, escalate elsewhere; a null confidence always escalates."""
    least = F.when(head.isNotNull() & decoded.isNotNull(), F.least(head, decoded))
    return F.when(least >= threshold, "accept").otherwise("escalate")


def grounded(arguments: Column, evidence: Column) -> Column:
    """The arguments (map of strings) whose values occur in the evidence."""
    return F.map_filter(arguments, lambda k, x: F.contains(F.lower(evidence), F.lower(x)))


def refused(calls: Column) -> Column:
    return F.coalesce(F.size(calls), F.lit(0)) <= 0


@dataclass(frozen=True)
class Agent:
    """A toolset, a proposer and limits. The proposer maps a DataFrame with an array column "history" of texts to one with a
    column "call" struct<name string, argument string> (null: no call); no model is part of this package."""

    #: By name: column expressions over the argument (in the JVM), or Python tools (see :meth:`with_python_tools`).
    tools: dict[str, Callable[[Column], Column]]
    propose: Callable[[DataFrame], DataFrame]
    schemas: list[dict] = field(default_factory=list)
    max_steps: int = MAX_STEPS

    def execute(self, call: Column) -> Column:
        """The result of a call as text; an unknown tool gives an error."""
        out = F.concat(F.lit('{"error":"unknown tool: '), call["name"], F.lit('"}'))
        for name, fn in self.tools.items():
            out = F.when(call["name"] == name, fn(call["argument"])).otherwise(out)
        return out

    @classmethod
    def with_python_tools(cls, tools: list | str, propose: Callable[[DataFrame], DataFrame], **limits) -> Agent:
        """An agent over Python functions, models, schemas or JSON; calls carry JSON arguments and run in Arrow batches.

        What a function raises is its result, {"error": ...}; a schema without a function is an unknown tool.
        """
        schemas, functions = s.resolve(tools)

        def expression(fn: Callable) -> Callable[[Column], Column]:
            @F.pandas_udf("string")
            def run(arguments: pd.Series) -> pd.Series:
                return arguments.map(lambda x: None if x is None else call_text(fn, x))

            return run

        return cls({name: expression(fn) for name, fn in functions.items()}, propose, schemas, **limits)

    def complete(self, df: DataFrame) -> DataFrame:
        """One turn: df with the column call."""
        return self.propose(df)

    def run(self, df: DataFrame, text: str) -> DataFrame:
        """df with results (of all calls, in order), steps and type: call where the last proposal still was one, else respond.

        Each step is a projection over the row, so the whole loop is one stage without any exchange; a generator of one row
        between steps keeps the optimizer from writing every step into all that follow it.
        """
        state = df.withColumn("history", F.array(F.col(text))).withColumn("results", F.array().cast("array<string>")).withColumn("steps", F.lit(0))
        for _ in range(self.max_steps):
            state = self.propose(state)
            more = F.col("call").isNotNull() & (F.size("results") == F.col("steps"))
            result = self.execute(F.col("call"))
            state = state.withColumn("_q", F.when(more, result)).withColumn("_r", F.explode(F.array("_q"))).drop("_q")
            state = state.withColumn("results", F.when(F.col("_r").isNotNull(), F.array_append("results", F.col("_r"))).otherwise(F.col("results")))
            state = state.withColumn("history", F.when(F.col("_r").isNotNull(), F.array_append("history", F.col("_r"))).otherwise(F.col("history")))
            state = state.withColumn("steps", F.size("results")).drop("_r", "call")
        state = self.propose(state)
        return state.withColumn("type", F.when(F.col("call").isNotNull(), "call").otherwise("respond")).drop("call", "history")

    def extract(self, df: DataFrame, arguments: str) -> DataFrame:
        """df with record: the JSON arguments of the first call in the types of the agent's only schema, and what they break.

        The column holds the arguments of one call, or those of all as an array, of which only the first counts; without
        a call (null or an empty array) the record is null.
        """
        parameters = self.schemas[0]["parameters"]
        if isinstance(df.schema[arguments].dataType, T.ArrayType):
            first = F.get(arguments, F.lit(0))
            df = df.withColumn(arguments, F.when(F.size(arguments) > 0, F.coalesce(first, F.lit("{}"))))
        kind = s.spark_type(parameters)
        rows = df.withColumn("record", F.from_json(arguments, kind))
        record = {k: F.col(f"record.{k}") for k in parameters["properties"]}
        return rows.withColumn("violations", F.when(F.col("record").isNotNull(), s.violations(record, parameters)))


def call_text(fn: Callable, arguments: str | None) -> str:
    """The JSON text of what a function returns for JSON arguments, {"error": ...} of what it raises."""
    try:
        return result_text(fn(**(json.loads(arguments) if arguments else {})))
    except Exception as problem:
        return json.dumps({"error": str(problem)})


def result_text(value: object) -> str:
    """A tool's result as JSON; models by their fields, other objects as text."""

    def plain(x: object) -> object:
        for name in ("model_dump", "dict"):
            if s.is_model(type(x)) and hasattr(x, name):
                return getattr(x, name)()
        return str(x)

    return json.dumps(value, default=plain)


def system_facts(text: Column) -> Column:
    """"k: v; k: v" as a map; a colon inside a value stays."""
    return F.str_to_map(text, F.lit("; "), F.lit(": "))
