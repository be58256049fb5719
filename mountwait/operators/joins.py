"""Joins.

``join_dimension`` joins a large table to a dimension (volumes, suppliers,
customers ...).  No hint is given: adaptive execution broadcasts the
dimension when its measured bytes are under the session's threshold and
keeps a shuffle join, with split skewed partitions, otherwise.
"""

from __future__ import annotations

from pyspark.sql import DataFrame


def join_dimension(fact: DataFrame, dim: DataFrame, on, how: str = "inner") -> DataFrame:
    """Join ``fact`` to ``dim``; the strategy follows the measured bytes."""
    return fact.join(dim, on, how)


def using_join(left: DataFrame, right: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """Equi-join USING one key: a single key column, then the other columns of
    ``left``, then those of ``right``.  Null keys never match; a key repeated
    on either side yields every combination, as SQL does.  Other shared
    column names are an error here rather than at write time."""
    shared = (set(left.columns) & set(right.columns)) - {key}
    if shared:
        raise ValueError(f"columns on both sides besides {key!r}: {sorted(shared)}; rename first")
    return left.join(right, key, how)
