"""What the operators share."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillframe.cluster import BROADCAST_BYTES, Scratch, drop, file_system, fresh, maybe_broadcast, new_path, prefix_sums, release, settle, shared_dir, write_table

__all__ = ["BROADCAST_BYTES", "Scratch", "drop", "file_system", "fresh", "maybe_broadcast", "need", "new_path", "prefix_sums", "release", "settle", "shared_dir", "write_table"]


def need(df: DataFrame, *columns: str) -> DataFrame:
    """Only the named columns; everything else, clashing names included, is left behind."""
    return df.select(*[F.col(c) for c in columns])
