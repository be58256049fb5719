"""Time helpers shared by the as-of join and the wait columns."""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column
from pyspark.sql import functions as F

_US = 1_000_000


def as_duration_us(value) -> int:
    """Normalise a window given as ``timedelta`` or seconds to microseconds."""
    if isinstance(value, _dt.timedelta):
        return int(round(value.total_seconds() * _US))
    return int(round(float(value) * _US))


def epoch_micros(col) -> Column:
    """Microseconds since the epoch of a TIMESTAMP or TIMESTAMP_NTZ column.

    Zone-less columns are read as UTC wall-clock times (the session zone is
    UTC for every job of this package), so the value is the same for both
    timestamp types and comparisons in micros equal comparisons of times.
    """
    c = F.col(col) if isinstance(col, str) else col
    return F.unix_micros(c.cast("timestamp"))
