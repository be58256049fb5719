"""Incremental copy of a request table in half-open date slices.

Given boundary dates ``d0 < d1 < ... < dn`` slice ``i`` holds the rows with
``d(i-1) <= ts < d(i)``; rows before ``d0`` or from ``dn`` on are not copied.

Resume: finished intervals are recorded in a manifest *after* their data has
been written.  A run copies what is wanted minus what is finished, as an interval
difference by calendar day, and stores the rows by day.  So lists may grow,
shrink, split, merge or overlap between runs: every day is copied once.  A run that
fails half-way leaves its days out of the manifest, and the next run replaces
their partitions whole (dynamic partition overwrite).
"""

from __future__ import annotations

import datetime as _dt
import functools
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mountwait.sources.sinks import write_snapshot

# Fixed value: first slice start of the reference's copy.
DEFAULT_FIRST_DATE = _dt.date(2022, 9, 9)
SLICE_COL = "ds"
MANIFEST = "_slices_done"


def _as_date(d) -> _dt.date:
    if isinstance(d, _dt.datetime):
        return d.date()
    if isinstance(d, _dt.date):
        return d
    return _dt.date.fromisoformat(str(d).strip())


def slice_table(spark: SparkSession, boundaries: Sequence) -> DataFrame:
    """``(slice_start date, slice_end date)`` of consecutive boundaries."""
    ds = sorted({_as_date(d) for d in boundaries})
    rows = list(zip(ds[:-1], ds[1:]))
    schema = T.StructType([T.StructField("slice_start", T.DateType()),
                           T.StructField("slice_end", T.DateType())])
    return spark.createDataFrame(rows, schema)


def day_slices(slices: DataFrame) -> DataFrame:
    """One row per calendar day covered by a slice: ``(day, slice_start, slice_end)``."""
    return slices.select(
        F.explode(F.sequence("slice_start", F.date_sub("slice_end", 1))).alias("day"),
        "slice_start", "slice_end")


def pending_slices(wanted: DataFrame, done: DataFrame) -> DataFrame:
    """``wanted`` minus ``done``: the runs of days of each wanted slice that no
    finished interval covers, as ``(slice_start, slice_end)``.  Works on one row per
    day of the two lists, whatever the data."""
    finished = day_slices(done).select("day").distinct()
    run = F.expr("date_sub(day, cast(row_number() over (partition by slice_start order by day) as int))")
    return (day_slices(wanted).join(finished, "day", "left_anti").withColumn("run", run)
            .groupBy("slice_start", "run").agg(F.min("day").alias("lo"), F.max("day").alias("hi"))
            .select(F.col("lo").alias("slice_start"), F.date_add("hi", 1).alias("slice_end")))


def in_slices(df: DataFrame, ts_col: str, slices: Sequence) -> DataFrame:
    """Rows inside the slices; adjacent ones are merged first, so the scan gets one pair
    of literal bounds per gap between them."""
    runs: list[list] = []
    for lo, hi in sorted((r[0], r[1]) for r in slices):
        if runs and lo <= runs[-1][1]:
            runs[-1][1] = max(hi, runs[-1][1])
        else:
            runs.append([lo, hi])
    kind = df.schema[ts_col].dataType
    at = lambda d: F.lit(str(d)).cast(kind)
    inside = [(F.col(ts_col) >= at(lo)) & (F.col(ts_col) < at(hi)) for lo, hi in runs]
    return df.where(functools.reduce(Column.__or__, inside, F.lit(False)))


def daily_counts(df: DataFrame, ts_col: str) -> DataFrame:
    """Rows per calendar day as one-day slices: one aggregate, one read."""
    return (df.where(F.col(ts_col).isNotNull()).groupBy(F.to_date(ts_col).alias("slice_start"))
            .agg(F.count(F.lit(1)).alias("n_rows"))
            .select("slice_start", F.date_add("slice_start", 1).alias("slice_end"), "n_rows"))


def completed_slices(spark: SparkSession, target: str) -> DataFrame:
    """Slices recorded as completed under ``target`` (empty when none)."""
    schema = T.StructType([T.StructField("slice_start", T.DateType()),
                           T.StructField("slice_end", T.DateType())])
    path = f"{target.rstrip('/')}/{MANIFEST}"
    jvm = spark.sparkContext._jvm
    hpath = jvm.org.apache.hadoop.fs.Path(path)
    fs = hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(hpath):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path)


def copy_by_slices(spark: SparkSession, source: DataFrame, ts_col: str, target: str,
                   boundaries: Sequence) -> DataFrame:
    """Copy the days of ``source`` that ``boundaries`` cover and no earlier run has finished into
    ``target`` (Parquet, partitioned by day).  Returns the intervals copied now; a wanted
    slice that is partly finished comes back as its missing pieces.

    A finished day is not copied again, also if its source has grown since."""
    todo = pending_slices(slice_table(spark, boundaries), completed_slices(spark, target))
    pending = todo.collect()  # at most the slices of the list and the gaps between finished intervals
    if not pending:
        return todo
    todo = spark.createDataFrame(pending, todo.schema)
    rows = in_slices(source, ts_col, pending).withColumn(SLICE_COL, F.date_format(ts_col, "yyyy-MM-dd"))
    write_snapshot(rows, target, partition_by=[SLICE_COL])
    todo.write.mode("append").parquet(f"{target.rstrip('/')}/{MANIFEST}")
    return todo
