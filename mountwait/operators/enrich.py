"""Enrichment update: new values on matched rows, old values elsewhere.

The reference updates rows in place by id.  Here an update is a projection
(``set_where``) when the new values are already on the row (as after an
as-of join), or a left join by a unique key (``enrich``) when they come in a
separate frame.  Either way the result is a new snapshot with every base row
exactly once; writing it with overwrite makes a re-run idempotent.  A table stored by
partition is updated in place by ``update_partitions``, which rewrites only the
partitions that hold a changed key.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mountwait.session import scratch_tables
from mountwait.sources.sinks import write_snapshot


def set_where(df: DataFrame, cond: Column, assignments: Mapping[str, Column]) -> DataFrame:
    """For rows where ``cond`` holds, set each column to its new expression;
    other rows keep their value (null when the column is new).  One
    projection; column order is kept and new columns are appended."""
    hit = F.coalesce(cond, F.lit(False))
    types = df.select(*[e.alias(n) for n, e in assignments.items()]).schema
    new = {}
    for f in types.fields:
        old = F.col(f.name) if f.name in df.columns else F.lit(None)
        new[f.name] = F.when(hit, assignments[f.name]).otherwise(old.cast(f.dataType)).alias(f.name)
    cols = [new.pop(c) if c in new else F.col(c) for c in df.columns]
    return df.select(*cols, *new.values())


def enrich(base: DataFrame, updates: DataFrame, key: str | list[str],
           columns: list[str] | None = None, check_unique: bool = True) -> DataFrame:
    """``UPDATE base SET c = u.c ... FROM updates u WHERE base.key = u.key``.

    ``updates`` must hold at most one row per key: a repeated key raises while the
    result is computed, unless ``check_unique`` is false.  The check is an aggregate
    by the key inside the plan, whose exchange the join needs anyway, so the updates
    are computed once.  Base rows without an update keep their values; columns new to
    ``base`` are null there.
    """
    keys = [key] if isinstance(key, str) else list(key)
    cols = columns or [c for c in updates.columns if c not in keys]
    hit = "_en_hit"
    if check_unique:
        row = F.struct(*[F.col(c).alias(f"_en_{c}") for c in cols])
        many = F.raise_error(F.concat(F.lit("update keys repeat: "), F.to_json(F.struct(*keys))))
        known = F.lit(True)
        for k in keys:
            known = known & F.col(k).isNotNull()  # a null key matches no row
        u = (updates.filter(known).groupBy(*keys).agg(F.first(row).alias("_en"), F.count(F.lit(1)).alias("_en_n"))
             .select(*keys, "_en.*", F.when(F.col("_en_n") > 1, many.cast("boolean")).otherwise(F.lit(True)).alias(hit)))
    else:
        u = updates.select(*keys, *[F.col(c).alias(f"_en_{c}") for c in cols], F.lit(True).alias(hit))
    j = base.join(u, keys, "left")
    assignments = {c: F.col(f"_en_{c}") for c in cols}
    out = set_where(j, F.col(hit), assignments)
    return out.select(*base.columns, *[c for c in cols if c not in base.columns])


def touched_partitions(base: DataFrame, partition_by: str, keys: DataFrame) -> list:
    """Values of the partition column of ``base`` that hold a row with one of ``keys``.

    Reads the key and partition columns only; at most one value per partition
    folder reaches the driver."""
    held = base.join(keys, keys.columns, "left_semi").select(partition_by).distinct()
    return [r[0] for r in held.collect()]


def in_partitions(base: DataFrame, partition_by: str, values: list) -> DataFrame:
    """Rows of the given partitions (a partition filter: other folders are not listed)."""
    some = [v for v in values if v is not None]
    cond = F.col(partition_by).isin(some) if some else F.lit(False)
    return base.where(cond | F.col(partition_by).isNull() if len(some) < len(values) else cond)


def update_partitions(spark: SparkSession, path: str, updates: DataFrame, key: str | list[str],
                      partition_by: str, columns: list[str] | None = None) -> list:
    """``UPDATE`` of the Parquet table under ``path``, partitioned by ``partition_by``, copy on write.

    Only partitions that hold a changed key are read whole and written again
    (dynamic partition overwrite); the others keep their files.  ``updates`` as in
    ``enrich``: at most one row per key, existing columns, not the partition column.
    The updates and the new rows are stored in the shared folder first, as the table is
    both read and written.  A run that fails while writing can be run again.
    Returns the partitions written.
    """
    keys = [key] if isinstance(key, str) else list(key)
    base = spark.read.parquet(path)
    cols = columns or [c for c in updates.columns if c not in keys]
    unknown = [c for c in [*cols, *keys] if c not in base.columns]
    if unknown or partition_by in cols:
        raise ValueError(f"not columns of the table to update: {unknown or [partition_by]}")
    with scratch_tables(spark) as stored:
        new = stored(updates.select(*keys, *cols))
        parts = touched_partitions(base, partition_by, new.select(*keys))
        if parts:
            rows = stored(enrich(in_partitions(base, partition_by, parts), new, keys, cols))
            write_snapshot(rows, path, partition_by=[partition_by])
    return parts
