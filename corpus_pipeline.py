"""From raw documents to places in packed training sequences: each stage is one operator over all that the one before kept.

What a stage gives for nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns is what its
operator's docstring says; each stage adds below what that means for the pipeline. Extra columns of documents are carried on
to the packing, which gives only ids and places.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillframe.llm import curve_packing, exact_dedup, mixing, near_dedup, rule_ensemble


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rule ensemble fitted on labels keeps; null and empty texts are scored as empty, without both classes all stay."""
    return rule_ensemble.keep(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text, that of the smallest doc_id; null texts all stay, of empty ones one does."""
    return exact_dedup.drop_exact_copies(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, and none that lies in a document of another group; texts without words stay."""
    return near_dedup.drop_near_copies(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources in their target shares: rows of small ones are repeated, hot ones are sampled; a null source is one of its own."""
    return mixing.mix(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(pack_id, pack_start, doc_id, copy, doc_start, doc_end): where each word run lies; repeats lie an epoch apart, empty texts have empty runs."""
    return curve_packing.pack(docs, apart=True)


STAGES = [("quality classifier", quality), ("exact dedup", exact), ("near dedup", near), ("source mixing", mixed), ("packing", packed)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents; each result is written as Parquet to the shared folder and read again, and what it took is freed."""
    from quillframe.llm.common import Scratch, drop, write_table

    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for number, (_, stage) in enumerate(STAGES):
        with Scratch(spark) as scratch:
            path = write_table(stage(spark, docs, sf_dir), f"stage{number}")
            scratch.kept.add(path)
        docs = spark.read.parquet(path)
        if last:
            drop(spark, last)
        last = path
    return docs
