"""Sinks.

* ``append_table``: append to a JDBC table or a Parquet folder (a table is
  created when absent).  Appending twice appends twice.
* ``write_snapshot``: overwrite a Parquet folder (or only the partitions
  present in the frame, with dynamic partition overwrite).  Re-running a
  failed job rewrites the same output, so retries are idempotent.
* ``family_labels``: the label set of every file family, for one table
  partitioned by family.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def append_table(df: DataFrame, target: str, *, jdbc_url: str | None = None,
                 properties: dict | None = None, mode: str = "append") -> None:
    if jdbc_url:
        (df.write.format("jdbc").option("url", jdbc_url).option("dbtable", target)
         .options(**{k: str(v) for k, v in (properties or {}).items()})
         .mode(mode).save())
    else:
        df.write.mode(mode).parquet(target)


def write_snapshot(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """Overwrite ``path``; with ``partition_by`` only the partitions present
    in ``df`` are replaced (``partitionOverwriteMode=dynamic``).

    A partitioned write is preceded by a REBALANCE on the partition columns:
    without it every task writes one file per partition value it holds
    (tasks x days files); with it adaptive execution groups each value's
    rows into partitions of the advisory size, splitting a hot value over
    several tasks and merging small ones."""
    if partition_by:
        df = df.hint("rebalance", *partition_by)
    w = df.write.mode("overwrite")
    if partition_by:
        w = w.option("partitionOverwriteMode", "dynamic").partitionBy(*partition_by)
    w.parquet(path)


def family_labels(volume: DataFrame) -> DataFrame:
    """``(file_family, label)`` of every volume with a family.  Repeated
    pairs are kept as they are in the volume table."""
    return volume.filter(F.col("file_family").isNotNull()).select("file_family", "label")
