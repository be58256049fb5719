"""Bitfile ids (BFIDs): site prefix and creation time.

A BFID is a four-letter site code followed by the creation time as ten
decimal digits of epoch seconds, then a serial.  Only BFIDs of the site
below are small-file candidates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

# Fixed values (must equal the source data's conventions).
BFID_SITE = "CDMS"
BFID_SITE_LEN = 4
BFID_EPOCH_DIGITS = 10


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def bfid_site_ok(bfid) -> Column:
    """True when the BFID starts with the site code."""
    return F.substring(_c(bfid), 1, BFID_SITE_LEN) == F.lit(BFID_SITE)


def bfid_epoch(bfid) -> Column:
    """Creation time in epoch seconds (bigint), null when the ten characters
    after the site code are missing or not all digits.

    ``try_cast`` keeps bad rows from failing the task under ANSI mode; the
    explicit digit test also rejects signs and blanks that a cast would take.
    """
    digits = F.substring(_c(bfid), BFID_SITE_LEN + 1, BFID_EPOCH_DIGITS)
    ok = digits.rlike(r"^[0-9]{%d}$" % BFID_EPOCH_DIGITS)
    return F.when(ok, digits.try_cast("bigint"))


def bfid_time(bfid) -> Column:
    """Creation time as a zone-less timestamp (UTC wall clock)."""
    return F.timestamp_seconds(bfid_epoch(bfid)).cast("timestamp_ntz")


def _bad(bfid) -> Column:
    return F.coalesce(bfid_site_ok(bfid), F.lit(False)) & bfid_epoch(bfid).isNull()


def bad_bfids(df, bfid: str = "bfid"):
    """Rows whose BFID carries the site code but no readable creation time
    (short, or not ten digits).  Such rows get no time and so no match; this
    frame lets a job count or keep them instead of failing."""
    return df.filter(_bad(bfid))


def count_bad_bfids(df: DataFrame, bfid: str = "bfid") -> tuple[DataFrame, Observation]:
    """``df`` unchanged, and an observation whose ``get`` gives ``rows`` and ``bad_bfids`` once
    an action has run ``df``: counted by the tasks that compute the rows, no second pass."""
    seen = Observation()
    return df.observe(seen, F.count(F.lit(1)).alias("rows"), F.count_if(_bad(bfid)).alias("bad_bfids")), seen


def require_good_bfids(df, bfid: str = "bfid") -> None:
    """Raise when any row has a site BFID without a readable time (strict mode)."""
    bad = bad_bfids(df, bfid).select(bfid).limit(5).collect()
    if bad:
        raise ValueError(f"unreadable BFIDs, e.g. {[r[0] for r in bad]}")
