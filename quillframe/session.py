"""Session factory with the settings the operators assume."""

from __future__ import annotations

from pyspark.sql import SparkSession


def get_session(master: str | None = None, app: str = "quillframe", **conf: str) -> SparkSession:
    """A session in UTC with adaptive execution and Arrow; keyword settings use ``__`` for dots."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()
