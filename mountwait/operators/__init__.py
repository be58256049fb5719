"""Relational operators: the bounded as-of join, enrichment, joins, aggregates."""

from mountwait.operators.aggregates import (family_key_collisions, family_keys, family_min_id,
                                            library_counts)
from mountwait.operators.asof import asof_within, next_within, prev_within
from mountwait.operators.enrich import enrich, set_where, update_partitions
from mountwait.operators.joins import join_dimension, using_join

__all__ = [
    "asof_within", "next_within", "prev_within",
    "enrich", "set_where", "update_partitions",
    "join_dimension", "using_join",
    "library_counts", "family_min_id", "family_keys", "family_key_collisions",
]
