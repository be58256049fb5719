"""Bucketed Parquet tables: stored once by the hash of a join key.

A table that several jobs join on one key is written in buckets of that key.  Joins
on the key then need no exchange of this side; the other side is shuffled into as many
partitions as there are buckets, so give at least as many buckets as the session has
shuffle partitions.  Buckets belong to a table's catalogue entry, not to its
files, so a later session opens the same files through ``open_bucketed``.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession


def _name(path: str) -> str:
    return f"mountwait_bucketed_{hashlib.sha256(path.encode()).hexdigest()[:16]}"


def write_bucketed(df: DataFrame, path: str, by: str, buckets: int) -> None:
    """Overwrite ``path`` with ``df`` in ``buckets`` buckets of ``by``, sorted, one file each.

    The exchange before the write deals rows out the way buckets do."""
    spark = df.sparkSession
    spark.sql(f"drop table if exists {_name(path)}")  # the entry of an external table; files stay
    (df.repartition(buckets, by).write.bucketBy(buckets, by).sortBy(by).mode("overwrite")
     .option("path", path).saveAsTable(_name(path)))


def open_bucketed(spark: SparkSession, path: str, by: str, buckets: int) -> DataFrame:
    """The table under ``path`` with its buckets known to the planner.  ``buckets`` must be the
    number it was written with."""
    schema = spark.read.parquet(path).schema
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
    where = path.replace("'", "\\'")
    spark.sql(f"drop table if exists {_name(path)}")
    spark.sql(f"create table {_name(path)} ({columns}) using parquet clustered by (`{by}`) sorted by (`{by}`) "
              f"into {int(buckets)} buckets location '{where}'")
    return spark.table(_name(path))
