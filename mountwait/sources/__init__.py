"""Sources and sinks: Parquet and JDBC readers, id shards, writers."""

from mountwait.sources.jdbc import jdbc_bounds, read_jdbc, read_jdbc_query
from mountwait.sources.shards import id_shard, with_depth_shards, with_shards
from mountwait.sources.sinks import append_table, write_snapshot
from mountwait.sources.tables import read_table

__all__ = [
    "read_table", "read_jdbc", "read_jdbc_query", "jdbc_bounds",
    "id_shard", "with_shards", "with_depth_shards",
    "append_table", "write_snapshot",
]
