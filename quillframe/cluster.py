"""Written tables in the cluster's shared folder, checked broadcasts, and running sums over the whole of a table."""

from __future__ import annotations

import atexit
import gc
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: A side is broadcast only when its measured size is at most this; beyond it the join shuffles.
BROADCAST_BYTES = 48 << 20

_MADE: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``, or a temporary one where that is unset and all runs on this machine (tests)."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="quillframe-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def file_system(spark: SparkSession, path: str):
    """(Hadoop path, its file system)."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def new_path(spark: SparkSession, name: str) -> str:
    """A new place in the shared folder, emptied when the driver ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    _MADE.append(path)
    return path


def drop(spark: SparkSession, path: str) -> None:
    """Delete a written table."""
    p, fs = file_system(spark, path)
    fs.delete(p, True)
    if path in _MADE:
        _MADE.remove(path)


@atexit.register
def _clean() -> None:
    spark = SparkSession.getActiveSession()
    for path in list(_MADE):
        try:
            if spark is not None:
                drop(spark, path)
        except Exception:  # the session may have ended first
            spark = None
        if spark is None and path.startswith("file:"):
            shutil.rmtree(path.removeprefix("file:").replace("//", "/"), ignore_errors=True)


class Scratch:
    """Tables settled inside a ``with`` block are deleted at its end, but for those passed to keep()."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.before, self.kept = spark, set(_MADE), set()

    def keep(self, df: DataFrame) -> DataFrame:
        """The settled DataFrame, whose table stays."""
        self.kept.add(df._settled)
        return df

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_) -> None:
        for path in set(_MADE) - self.before - self.kept:
            drop(self.spark, path)


def release(spark: SparkSession) -> None:
    """Let the driver collect its garbage, so that the shuffle files of queries that are over are deleted now and not some time later."""
    gc.collect()
    spark._jvm.System.gc()


def write_table(df: DataFrame, name: str, compression: str = "zstd") -> str:
    """Write a DataFrame to the shared folder, so that lineage ends there and lost executors cost a re-read only."""
    path = new_path(df.sparkSession, name)
    df.write.option("compression", compression).parquet(path)
    return path


def settle(df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
    """The same rows, read back from a written table."""
    path = write_table(df, name, compression)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._settled = path
    return out


def maybe_broadcast(df: DataFrame, row_bytes: int, limit: int = BROADCAST_BYTES, text: str | None = None) -> DataFrame:
    """A settled table with a broadcast hint if its size fits the limit, else as it is (a shuffle join).

    The size is rows times row_bytes, the room of the fixed-width columns, plus the measured bytes of the column text.
    """
    words = F.coalesce(F.sum(F.octet_length(text)), F.lit(0)) if text else F.lit(0)
    size = df.agg(F.count(F.lit(1)).alias("n"), words.alias("words")).first()
    return F.broadcast(df) if size.n * row_bytes + size.words <= limit else df


def fresh(df: DataFrame, name: str) -> str:
    """A column name that no column of df has, in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def prefix_sums(df: DataFrame, order: list[str], value: str, out: str, within: str | None = None, ties_together: bool = False) -> DataFrame:
    """Running sum of value in the order given (restarted for each value of within), without a single-task window.

    Rows are range-partitioned and written with their partition number; the sum is the running sum inside the partition
    plus the total of the partitions before, which is one row per partition. With ties_together, rows that tie in
    the order all get the sum with the whole tie in it (equal keys never part in a range partitioning).
    """
    order = ([within] if within else []) + order
    pid, part, local = fresh(df, "pid"), fresh(df, "part_sum"), fresh(df, "local_sum")
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = settle(df.repartitionByRange(n, *[F.col(c).asc_nulls_first() for c in order]).withColumn(pid, F.spark_partition_id()), "ranged")
    keys = [pid] + ([within] if within else [])
    totals = ranged.groupBy(*keys).agg(F.sum(value).alias(part))
    before = (W.partitionBy(within) if within else W.partitionBy()).orderBy(pid).rowsBetween(W.unboundedPreceding, -1)
    totals = settle(totals.withColumn(part, F.coalesce(F.sum(part).over(before), F.lit(0))), "totals")
    totals = totals.select(*[F.col(k).alias("t_" + k) for k in keys], F.col(part).alias("t_" + part))
    run = W.partitionBy(*keys).orderBy(*[F.col(c).asc_nulls_first() for c in order])
    run = run.rangeBetween(W.unboundedPreceding, W.currentRow) if ties_together else run.rowsBetween(W.unboundedPreceding, W.currentRow)
    ranged = ranged.withColumn(local, F.sum(value).over(run))
    match: Column = F.lit(True)
    for k in keys:
        match = match & F.col(k).eqNullSafe(F.col("t_" + k))
    joined = ranged.join(maybe_broadcast(totals, 64), match, "left")
    return joined.withColumn(out, F.col(local) + F.col("t_" + part)).drop(pid, local, *["t_" + k for k in keys], "t_" + part)


def global_rank(df: DataFrame, order: list[str], out: str = "rn") -> DataFrame:
    """1, 2, 3, ... over the whole table in the order given; ties are broken arbitrarily, so the order should be total."""
    one = fresh(df, "one")
    return prefix_sums(df.withColumn(one, F.lit(1).cast("bigint")), order, one, out).drop(one)
