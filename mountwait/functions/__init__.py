"""Column expressions (built-in Spark functions only, no UDFs)."""

from mountwait.functions.age import with_age
from mountwait.functions.bfid import bad_bfids, bfid_epoch, bfid_site_ok, bfid_time, count_bad_bfids
from mountwait.functions.family import family_key
from mountwait.functions.timecols import as_duration_us, epoch_micros

__all__ = [
    "with_age",
    "bfid_epoch", "bfid_site_ok", "bfid_time", "bad_bfids", "count_bad_bfids",
    "family_key", "as_duration_us", "epoch_micros",
]
