"""Wait jobs: eligible requests -> bounded as-of join -> enrichment.

Each function returns the whole request table with the result columns set
on matched rows; ineligible and unmatched rows come back unchanged.  A wait
is stored as ``struct<months int, days int, us bigint, total_us bigint>``:
the calendar age (``AGE(mount, request)``) plus the exact difference.

Windows default to the production 100 days; host-volume lookups use
8,640,000 seconds from the file's creation time (the same length).
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mountwait.functions.age import with_age
from mountwait.functions.bfid import bfid_site_ok, bfid_time, require_good_bfids
from mountwait.functions.timecols import epoch_micros
from mountwait.operators.asof import asof_lookups, next_within, prev_within
from mountwait.operators.enrich import set_where
from mountwait.session import cut_lineage

# Lookup windows of the production runs.
DEFAULT_WINDOW = _dt.timedelta(days=100)
HOST_VOLUME_WINDOW = _dt.timedelta(seconds=8_640_000)

_BFID_T = "_bfid_time"


_W = "_wait_"


def with_wait(df: DataFrame, later: Column, earlier: Column) -> tuple[DataFrame, Column]:
    """Add the parts of ``AGE(later, earlier)`` and the exact difference as
    helper columns; return the frame and the wait struct built from them
    (null when either time is null).  Drop the helpers with ``drop_wait``."""
    d = with_age(df, later, earlier, prefix=_W, total=_W + "total")
    st = F.when(later.isNotNull() & earlier.isNotNull(), F.struct(
        F.col(_W + "months").alias("months"), F.col(_W + "days").alias("days"),
        F.col(_W + "us").alias("us"), F.col(_W + "total").alias("total_us")))
    return d, st


def drop_wait(df: DataFrame) -> DataFrame:
    return df.drop(*[_W + x for x in ("months", "days", "us", "total")])


def _nn(*cols: str) -> Column:
    c = F.lit(True)
    for name in cols:
        c = c & F.col(name).isNotNull()
    return c


def _not_done(df: DataFrame, done: str) -> Column:
    """``done`` must be present and false (a null flag is not processed)."""
    if done not in df.columns:
        return F.lit(True)
    return F.col(done).isNotNull() & ~F.col(done)


# ---------------------------------------------------------------- eligibility

def eligible_store(df: DataFrame, done: str = "updated") -> Column:
    """Store requests not yet done, with family, time, pnfsid and id."""
    return (_nn("file_family", "action", "datestamp", "pnfsid", "storageinfo_id")
            & _not_done(df, done) & (F.col("action") == "store"))


def eligible_restore(df: DataFrame, done: str = "updated") -> Column:
    """Restore requests not yet done that succeeded (``errorcode = 0``)."""
    return (_nn("action", "errorcode", "storageinfo_id") & _not_done(df, done)
            & (F.col("action") == "restore") & (F.col("errorcode") == 0))


def eligible_restore_wait(df: DataFrame, done: str = "updated") -> Column:
    return eligible_restore(df, done) & _nn("datestamp", "volume")


def eligible_restore_volume(df: DataFrame, done: str = "updated") -> Column:
    return (eligible_restore(df, done) & _nn("bfid", "file_family")
            & F.coalesce(bfid_site_ok("bfid"), F.lit(False)))


def eligible_read(volume_col: str = "volume") -> Column:
    return _nn("datestamp", "sfbr_id", volume_col)


def eligible_read_volume() -> Column:
    return _nn("bfid", "file_family", "sfbr_id") & F.coalesce(bfid_site_ok("bfid"), F.lit(False))


# ---------------------------------------------------------------- waits

def _mount_cols(mounts: DataFrame, *extra: str) -> DataFrame:
    cols = ["tapemount_id", "volume", "start"] + [c for c in extra if c in mounts.columns]
    return mounts.select(*dict.fromkeys(cols))


def read_waits(reads: DataFrame, mounts: DataFrame, window=DEFAULT_WINDOW,
               volume_col: str = "volume", id_out: str = "next_mount_id",
               wait_out: str = "mount_wait") -> DataFrame:
    """Wait of each read for the next mount of its tape (``volume_col``)."""
    m = _mount_cols(mounts).withColumnRenamed("volume", "_m_volume")
    out = next_within(reads, m, left_by=volume_col, right_by="_m_volume",
                      left_time="datestamp", right_time="start", window=window,
                      tie="tapemount_id", eligible=eligible_read(volume_col), spread="sfbr_id")
    out, wait = with_wait(out, F.col("match.time"), F.col("datestamp"))
    return drop_wait(set_where(out, F.col("match").isNotNull(), {
        id_out: F.col("match.tapemount_id"),
        wait_out: wait,
    })).drop("match")


def read_waits_migrated(reads: DataFrame, mounts: DataFrame, window=DEFAULT_WINDOW) -> DataFrame:
    """Wait of each read for the next mount of the tape its file moved to."""
    return read_waits(reads, mounts, window, volume_col="migrated_volume",
                      id_out="migration_next_mount_id", wait_out="migration_mount_wait")


def previous_mount(reads: DataFrame, mounts: DataFrame, window=DEFAULT_WINDOW,
                   volume_col: str = "migrated_volume") -> DataFrame:
    """Last mount of the read's tape before the read, within the window.

    The latest earlier mount is chosen first and only then is its ``finish``
    tested: when that mount has no finish time the read gets no result (an
    older finished mount is not used).  The wait is ``AGE(finish,
    datestamp)``: negative = idle time since the unmount, positive = the
    tape was still mounted when the read came.
    """
    m = _mount_cols(mounts, "finish").withColumnRenamed("volume", "_m_volume")
    out = prev_within(reads, m, left_by=volume_col, right_by="_m_volume",
                      left_time="datestamp", right_time="start", window=window,
                      tie="tapemount_id", carry=["finish"],
                      eligible=eligible_read(volume_col), spread="sfbr_id")
    hit = F.col("match").isNotNull() & F.col("match.finish").isNotNull()
    out, wait = with_wait(out, F.col("match.finish"), F.col("datestamp"))
    return drop_wait(set_where(out, hit, {
        "previous_mount_100d_id": F.col("match.tapemount_id"),
        "previous_mount_100d_wait": wait,
    })).drop("match")


def read_host_volume(reads: DataFrame, family_mounts: DataFrame, window=HOST_VOLUME_WINDOW,
                     strict: bool = False) -> DataFrame:
    """Simulated host tape of each read: the first mount with writes of the
    file's family after the file was created (time from the BFID).  A site
    BFID without a readable time gets no match; ``strict`` raises instead."""
    if strict:
        require_good_bfids(reads.filter(eligible_read_volume()))
    m = _mount_cols(family_mounts, "file_family").select(
        "tapemount_id", "start", F.col("volume").alias("_m_volume"),
        F.col("file_family").alias("_m_family"))
    r = reads.withColumn(_BFID_T, bfid_time("bfid"))
    out = next_within(r, m, left_by="file_family", right_by="_m_family", left_time=_BFID_T,
                      right_time="start", window=window, tie="tapemount_id",
                      carry=["_m_volume"], eligible=eligible_read_volume(), spread="sfbr_id")
    return set_where(out, F.col("match").isNotNull(),
                     {"volume": F.col("match._m_volume")}).drop("match", _BFID_T)


def store_waits(stores: DataFrame, family_mounts: DataFrame, window=DEFAULT_WINDOW,
                done: str = "updated") -> DataFrame:
    """Wait of each store for the next writing mount of a tape of its family;
    sets the tape, the mount, its time and the wait, and marks ``done``."""
    m = _mount_cols(family_mounts, "file_family").select(
        "tapemount_id", "start", F.col("volume").alias("_m_volume"),
        F.col("file_family").alias("_m_family"))
    out = next_within(stores, m, left_by="file_family", right_by="_m_family",
                      left_time="datestamp", right_time="start", window=window,
                      tie="tapemount_id", carry=["_m_volume"],
                      eligible=eligible_store(stores, done), spread="storageinfo_id")
    out, wait = with_wait(out, F.col("match.time"), F.col("datestamp"))
    return drop_wait(set_where(out, F.col("match").isNotNull(), {
        "volume": F.col("match._m_volume"),
        done: F.lit(True),
        "next_mount_time": F.col("match.time"),
        "next_mount_id": F.col("match.tapemount_id"),
        "mount_wait": wait,
    })).drop("match")


def restore_host_volume(stores: DataFrame, family_mounts: DataFrame,
                        window=HOST_VOLUME_WINDOW,
                        done: str = "updated", mark: str | None = None,
                        strict: bool = False, skip_done: str | None = None) -> DataFrame:
    """Simulated host tape of each successful restore (from the BFID time);
    sets ``volume`` and marks ``done`` (and ``mark``, when given, to tell
    the rows changed by this run).  ``skip_done`` names a further flag that
    must be present and false.  ``strict`` as in ``read_host_volume``."""
    ok = eligible_restore_volume(stores, done)
    if skip_done:
        ok = ok & _not_done(stores, skip_done)
    if strict:
        require_good_bfids(stores.filter(ok))
    m = _mount_cols(family_mounts, "file_family").select(
        "tapemount_id", "start", F.col("volume").alias("_m_volume"),
        F.col("file_family").alias("_m_family"))
    r = stores.withColumn(_BFID_T, bfid_time("bfid"))
    out = next_within(r, m, left_by="file_family", right_by="_m_family", left_time=_BFID_T,
                      right_time="start", window=window, tie="tapemount_id",
                      carry=["_m_volume"], eligible=ok, spread="storageinfo_id")
    sets = {done: F.lit(True), "volume": F.col("match._m_volume")}
    if mark:
        sets[mark] = F.lit(True)
    return set_where(out, F.col("match").isNotNull(), sets).drop("match", _BFID_T)


def restore_waits(stores: DataFrame, mounts: DataFrame, window=DEFAULT_WINDOW,
                  done: str = "updated") -> DataFrame:
    """Wait of each successful restore for the next mount of its tape; sets
    the mount time and the wait (no mount id) and marks ``done``."""
    m = _mount_cols(mounts).withColumnRenamed("volume", "_m_volume")
    out = next_within(stores, m, left_by="volume", right_by="_m_volume",
                      left_time="datestamp", right_time="start", window=window,
                      tie="tapemount_id", eligible=eligible_restore_wait(stores, done),
                      spread="storageinfo_id")
    out, wait = with_wait(out, F.col("match.time"), F.col("datestamp"))
    return drop_wait(set_where(out, F.col("match").isNotNull(), {
        done: F.lit(True),
        "next_mount_time": F.col("match.time"),
        "mount_wait": wait,
    })).drop("match")


def restore_chain(stores: DataFrame, family_mounts: DataFrame, mounts: DataFrame,
                  volume_window=HOST_VOLUME_WINDOW, wait_window=DEFAULT_WINDOW,
                  between=cut_lineage) -> DataFrame:
    """Host volume, then wait, of every restore, each stage with its own
    done-column (``volume_done``, ``wait_done``) so that a restore that just
    received a tape still gets its wait.

    ``between`` is applied to the first stage's result; by default it is
    stored as a reliable checkpoint in the shared checkpoint folder, because
    the second stage reads its input twice (to size its cells, and whole) and
    would otherwise recompute the first stage.  Pass ``None`` to keep one lazy plan."""
    s = stores
    if "volume_done" not in s.columns:
        s = s.withColumn("volume_done", F.lit(False))
    if "wait_done" not in s.columns:
        s = s.withColumn("wait_done", F.lit(False))
    s = restore_host_volume(s, family_mounts, volume_window, done="volume_done", skip_done="updated")
    if between is not None:
        s = between(s)
    return restore_waits(s, mounts, wait_window, done="wait_done")


def _set_wait(out: DataFrame, match: str, field: str, id_out: str, wait_out: str) -> DataFrame:
    """The mount id and the wait until ``field`` of the match, on rows that have it."""
    hit = F.col(match).isNotNull() & F.col(f"{match}.{field}").isNotNull()
    out, wait = with_wait(out, F.col(f"{match}.{field}"), F.col("datestamp"))
    return drop_wait(set_where(out, hit, {id_out: F.col(f"{match}.tapemount_id"), wait_out: wait})).drop(match)


def read_waits_all(reads: DataFrame, mounts: DataFrame, window=DEFAULT_WINDOW,
                   previous_window=DEFAULT_WINDOW) -> DataFrame:
    """The three read lookups in one job: next mount of the read's tape, next
    mount of the tape after migration, and last mount before the read on
    that tape (with the ``finish`` test).  The last two share one pass over the
    rows, in both directions of time; nothing is joined back, so ``sfbr_id`` may
    repeat.  Results equal ``read_waits``, ``read_waits_migrated`` and
    ``previous_mount`` applied in turn."""
    m = _mount_cols(mounts, "finish").withColumnRenamed("volume", "_m_volume")
    steps = [  # match, key column, window, direction, time field, id column, wait column
        ("_lk_nx", "volume", window, "forward", "time", "next_mount_id", "mount_wait"),
        ("_lk_mg", "migrated_volume", window, "forward", "time", "migration_next_mount_id", "migration_mount_wait"),
        ("_lk_pv", "migrated_volume", previous_window, "backward", "finish", "previous_mount_100d_id",
         "previous_mount_100d_wait"),
    ]
    out = asof_lookups(reads, m, right_by="_m_volume", right_time="start", tie="tapemount_id", carry=["finish"],
                       spread="sfbr_id", lookups=[
                           dict(left_by=key, left_time="datestamp", window=win, direction=direction, match=match,
                                eligible=eligible_read(key)) for match, key, win, direction, *_ in steps])
    for match, _, _, _, field, id_out, wait_out in steps:
        out = _set_wait(out, match, field, id_out, wait_out)
    return out


READ_RESULTS = ("next_mount_id", "mount_wait", "migration_next_mount_id", "migration_mount_wait",
                "previous_mount_100d_id", "previous_mount_100d_wait")


def touched_reads(reads: DataFrame, changed: DataFrame, window=DEFAULT_WINDOW, previous_window=DEFAULT_WINDOW,
                  name: str = "touched") -> DataFrame:
    """``reads`` with a flag: some mount in ``changed`` (newly arrived, or given a new finish)
    lies where one of the read's three lookups looks.  Only such reads can have
    another result than before; whether a mount lies there is itself an as-of
    lookup, against the few changed mounts."""
    m = changed.select(F.col("volume").alias("_m_volume"), "start")
    look = [dict(left_by="volume", left_time="datestamp", window=window, match="_ch_nx", eligible=eligible_read("volume"))]
    look += [dict(left_by="migrated_volume", left_time="datestamp", window=win, direction=way, match=match,
                  eligible=eligible_read("migrated_volume"))
             for win, way, match in ((window, "forward", "_ch_mg"), (previous_window, "backward", "_ch_pv"))]
    out = asof_lookups(reads, m, right_by="_m_volume", right_time="start", spread="sfbr_id", lookups=look)
    return out.withColumn(name, F.expr("_ch_nx is not null or _ch_mg is not null or _ch_pv is not null")).drop(
        "_ch_nx", "_ch_mg", "_ch_pv")


def storage_waits_all(stores: DataFrame, family_mounts: DataFrame, mounts: DataFrame,
                      store_window=DEFAULT_WINDOW, volume_window=HOST_VOLUME_WINDOW,
                      wait_window=DEFAULT_WINDOW, between=cut_lineage) -> DataFrame:
    """All store-table stages in one job: wait of every store (``updated``
    as done flag), host tape of every restore (``volume_done``), then wait
    of every restore on that tape (``wait_done``).  A row is a store or a
    restore, so the first two lookups are one pass over the rows, by the time
    that counts for each;
    the restore wait needs the new tape, so it follows as a second stage,
    after ``between`` (a reliable checkpoint by default, see
    ``restore_chain``).  Equal to ``store_waits`` followed by
    ``restore_chain``."""
    s = stores
    for c in ("volume_done", "wait_done"):
        if c not in s.columns:
            s = s.withColumn(c, F.lit(False))
    m = _mount_cols(family_mounts, "file_family").select(
        "tapemount_id", "start", F.col("volume").alias("_m_volume"),
        F.col("file_family").alias("_m_family"))
    is_store = eligible_store(s)
    is_restore = eligible_restore_volume(s, "volume_done") & _not_done(s, "updated")
    r = s.withColumn("_lk_time", F.when(is_store, epoch_micros("datestamp")).when(is_restore, epoch_micros(bfid_time("bfid"))))
    r = r.withColumn("_lk_time", F.timestamp_micros("_lk_time"))
    out = asof_lookups(r, m, right_by="_m_family", right_time="start", tie="tapemount_id", carry=["_m_volume"],
                       spread="storageinfo_id", lookups=[
                           dict(left_by="file_family", left_time="_lk_time", window=store_window,
                                match="_lk_store", eligible=is_store),
                           dict(left_by="file_family", left_time="_lk_time", window=volume_window,
                                match="_lk_vol", eligible=is_restore)])
    out, wait = with_wait(out, F.col("_lk_store.time"), F.col("datestamp"))
    out = drop_wait(set_where(out, F.col("_lk_store").isNotNull(), {
        "volume": F.col("_lk_store._m_volume"),
        "updated": F.lit(True),
        "next_mount_time": F.col("_lk_store.time"),
        "next_mount_id": F.col("_lk_store.tapemount_id"),
        "mount_wait": wait,
    }))
    out = set_where(out, F.col("_lk_vol").isNotNull(), {
        "volume_done": F.lit(True), "volume": F.col("_lk_vol._m_volume"),
    }).drop("_lk_store", "_lk_vol", "_lk_time")
    if between is not None:
        out = between(out)
    return restore_waits(out, mounts, wait_window, done="wait_done")
