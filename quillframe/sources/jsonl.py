"""JSON-lines examples: scan with a required key, salvage of broken lines, and a sink."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FIELDS = "query string, tools string, answers string, function_calls string, reasoning string, system string"


def read_examples(spark: SparkSession, path: str, require: str | None = "query", strict: bool = True) -> DataFrame:
    """Examples, one a line, with the line itself in raw. Blank lines are skipped, and lines without the required key.

    A line that isn't JSON ends the job when strict, and is skipped otherwise. Tools and answers stay JSON text, since
    their keys are data; answers may be given as function_calls.
    """
    lines = spark.read.text(path).withColumnRenamed("value", "raw").filter(F.trim("raw") != "")
    lines = lines.withColumn("v", F.try_parse_json("raw"))
    if strict:
        lines = lines.withColumn("v", F.when(F.col("v").isNull(), F.parse_json(F.raise_error(F.concat(F.lit("not JSON: "), F.substring("raw", 1, 80))).cast("string"))).otherwise(F.col("v")))
    else:
        lines = lines.filter(F.col("v").isNotNull())
    if require:
        lines = lines.filter(F.try_variant_get("v", f"$.{require}", "variant").isNotNull())
    text = lambda k: F.try_variant_get("v", f"$.{k}", "string")
    answers = F.coalesce(text("answers"), text("function_calls"), F.lit("[]"))
    return lines.select("raw", text("query").alias("query"), F.coalesce(text("tools"), F.lit("[]")).alias("tools"), answers.alias("answers"), F.coalesce(text("reasoning"), F.lit("")).alias("reasoning"), F.coalesce(text("system"), F.lit("")).alias("system"))


def read_tools(spark: SparkSession, path: str) -> DataFrame:
    """(name, tool): the schemas of a JSON file that holds an array of them, tool as JSON text."""
    whole = spark.read.text(path, wholetext=True)
    items = whole.select(F.explode(F.try_variant_get(F.parse_json("value"), "$", "array<variant>")).alias("v"))
    return items.select(F.try_variant_get("v", "$.name", "string").alias("name"), F.to_json("v").alias("tool"))


def collect_tools(examples: DataFrame, order: str) -> DataFrame:
    """(name, tool): the first schema of each name over all examples in the order given; nameless ones are dropped."""
    items = examples.select(order, F.posexplode(F.try_variant_get(F.try_parse_json("tools"), "$", "array<variant>")).alias("pos", "v"))
    named = items.select(order, "pos", F.try_variant_get("v", "$.name", "string").alias("name"), F.to_json("v").alias("tool")).filter("name != ''")
    return named.groupBy("name").agg(F.min_by("tool", F.struct(order, "pos")).alias("tool"))


def write_examples(rows: DataFrame, path: str) -> None:
    """One JSON object a line; a column raw is written as it is."""
    line = F.col("raw") if rows.columns == ["raw"] else F.to_json(F.struct(*rows.columns))
    rows.select(line.alias("value")).write.text(path)
