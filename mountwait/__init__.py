"""mountwait: tape mount-wait analytics for small archived files, on Spark.

Requests (reads, stores, restores) are matched to the next or previous tape
mount inside a bounded time window with a set-based as-of join, and the
waits are written back as an enriched snapshot.  Everything is expressed with
DataFrame operations so that Catalyst plans and partitions the work.
"""

from mountwait.operators.asof import asof_lookups, next_within, prev_within
from mountwait.operators.enrich import enrich
from mountwait.session import build_session, checkpoint_dir, cut_lineage

__all__ = ["build_session", "checkpoint_dir", "cut_lineage",
           "next_within", "prev_within", "asof_lookups", "enrich"]
__version__ = "0.1.0"
