"""Id-range shards.

Equal strides (``with_shards``): ``[x * step, (x + 1) * step)`` with
``step = ceil((max + 1) / n)``.  The step is rounded up before multiplying, so the
last shard reaches past the largest id and no id is lost.

Equal depth (``with_depth_shards``): the ranges are cut at the quantiles of a
percentile sketch, so that shards hold about as many rows each however the ids are
spread.  Rows of one id stay together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mountwait.functions.search import cuts_below


def id_shard(id_col, n: int, max_id=None) -> Column:
    """Shard number of each id.  ``max_id`` may be an int or a Column (e.g. a
    scalar subquery); the result is ``floor(id / ceil((max_id + 1) / n))``."""
    c = F.col(id_col) if isinstance(id_col, str) else id_col
    mx = F.lit(max_id) if isinstance(max_id, int) else max_id
    step = F.ceil((mx + F.lit(1)) / F.lit(n)).cast("long")
    return F.floor(c / step).cast("int")


def with_shards(df: DataFrame, id_col: str, n: int, max_id: int | None = None,
                name: str = "shard") -> DataFrame:
    """Add the shard column; ``max_id`` defaults to the column's maximum,
    evaluated once as a scalar subquery (not a join)."""
    mx = max_id if max_id is not None else df.select(F.max(id_col)).scalar()
    return df.withColumn(name, id_shard(id_col, n, mx))


def depth_cuts(df: DataFrame, id_col: str, n: int) -> DataFrame:
    """One row: ``cuts``, the n - 1 inner boundaries of equal depth (null for no rows).

    The sketch's rank error is below 1 % of a shard; its partial states merge
    before the one task that finishes them.
    """
    ranks = ", ".join(f"{i / n!r}D" for i in range(1, n))
    cuts = f"percentile_approx(`{id_col}`, array({ranks}), {max(10_000, 100 * n)})" if n > 1 else "array(0L)"
    return df.agg(F.expr(cuts).alias("cuts"))


def with_depth_shards(df: DataFrame, id_col: str, n: int, name: str = "shard") -> DataFrame:
    """Add the number of the equal-depth range that holds the id: ids up to the first cut are in
    shard 0.  The cuts are a scalar subquery, so the ids are read once more.  A null id is
    in shard 0."""
    at = F.expr(cuts_below("_cuts", f"`{id_col}`", 1 << max(1, n.bit_length())) if n > 1 else "0").cast("int")
    return (df.withColumn("_cuts", depth_cuts(df, id_col, n).scalar())
            .withColumn(name, at).drop("_cuts"))


def depth_predicates(df: DataFrame, id_col: str, n: int, quoted: str) -> list[str]:
    """The same ranges as n SQL conditions on the column ``quoted``, for a partitioned JDBC
    scan: at most n - 1 numbers reach the driver.  They cover every row, null ids too."""
    cuts = sorted(set(depth_cuts(df, id_col, n).first().cuts or []))
    if n < 2 or not cuts:
        return ["1 = 1"]
    out = [f"{quoted} <= {cuts[0]} or {quoted} is null"]
    out += [f"{quoted} > {lo} and {quoted} <= {hi}" for lo, hi in zip(cuts, cuts[1:])]
    return out + [f"{quoted} > {cuts[-1]}"]
