"""Queries and SQL of the engine's own operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quillframe.plans import agent, bulk, dataset, kernels

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
for _module in (dataset, kernels, agent, bulk):
    QUERIES |= _module.QUERIES
    SQL |= _module.SQL
