"""The registered checks: one DataFrame per operator / job of the blueprint.

Each function takes ``(spark, sf_dir)``, reads whole driver tables through
the adapters of ``sources.testdata`` and returns a DataFrame whose columns
match the DuckDB SQL in ``__spark_entry__.oracle_sql``.  Waits are shown as
``wait_us`` (exact micros) and ``age_months``/``age_days``/``age_us`` (the
calendar age), never as structs.

Windows are shorter than the production 100 days where the driver's data is
too dense for 100 days to leave requests unmatched (values fixed in the
fixture description).
"""

from __future__ import annotations

import datetime as _dt
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mountwait.functions.age import with_age
from mountwait.functions.bfid import bfid_epoch, bfid_site_ok, bfid_time
from mountwait.operators import aggregates as agg
from mountwait.operators.asof import next_within, prev_within
from mountwait.operators.enrich import enrich, update_partitions
from mountwait.operators.joins import join_dimension
from mountwait.functions.timecols import epoch_micros
from mountwait.plans import ingest, jobs, prepare, waits
from mountwait.session import checkpoint_dir, cut_lineage
from mountwait.sources import testdata as td
from mountwait.sources.buckets import open_bucketed, write_bucketed
from mountwait.sources.shards import with_depth_shards, with_shards
from mountwait.sources.sinks import family_labels as _family_labels
from mountwait.sources.sinks import write_snapshot

# Windows of the checks (see FIXTURES.md section 4).
READ_WINDOW = _dt.timedelta(days=1)
FAMILY_WINDOW = _dt.timedelta(minutes=15)
EVENT_WINDOW = _dt.timedelta(days=3)
TIES_WINDOW = _dt.timedelta(days=100)
N_SHARDS = 10
HOT_KEY = 99
BURST_START = "2024-01-01 00:00:00"
BURST_TARGET = 1_000
CHAIN_START_US = 1_704_067_200_000_000  # 2024-01-01, where the events begin
COPY_LISTS = [["1996-01-01", "1996-04-01", "1996-07-01"], ["1996-02-15", "1996-08-01"], ["1996-10-01", "1996-10-08"],
              ["1995-12-01", "1996-02-01", "1996-11-01", "1997-01-01"]]


def _scratch(spark: SparkSession, name: str) -> str:
    """A new folder for a table that a check writes and reads back."""
    return f"{checkpoint_dir(spark).rstrip('/')}/mountwait-check-{name}-{uuid.uuid4().hex}"


def _flat_wait(df: DataFrame, col: str) -> DataFrame:
    return df.select(
        *[c for c in df.columns if c != col],
        F.col(f"{col}.total_us").alias("wait_us"),
        F.col(f"{col}.months").alias("age_months"),
        F.col(f"{col}.days").alias("age_days"),
        F.col(f"{col}.us").alias("age_us"))


# ------------------------------------------------------------------ sources

def scan_table(spark: SparkSession, sf: str) -> DataFrame:
    b = td.billinginfo(spark, sf)
    return b.agg(F.count(F.lit(1)).alias("row_count"), F.count("pnfsid").alias("n_pnfsid"),
                 F.min("datestamp").alias("min_datestamp"),
                 F.max("datestamp").alias("max_datestamp"),
                 F.sum(F.col("billinginfo_id") % 1000003).alias("sum_id_mod"))


def id_range_shards(spark: SparkSession, sf: str) -> DataFrame:
    f = with_shards(td.file(spark, sf), "id", N_SHARDS)
    return f.groupBy("shard").agg(F.count(F.lit(1)).alias("n_rows"),
                                  F.min("id").alias("min_id"), F.max("id").alias("max_id"))


def depth_shards(spark: SparkSession, sf: str) -> DataFrame:
    """Equal-depth shards of a skewed id (nine tenths of the orders in a thousandth of its range): per shard,
    whether it is within 10 % of an even share and lies above the shard before it, and the rows of all."""
    f = td.table(spark, sf, "orders").select(
        F.when(F.col("o_orderkey") % 10 < 9, F.col("o_orderkey")).otherwise(F.col("o_orderkey") * 1000).alias("id"))
    per = with_depth_shards(f, "id", N_SHARDS).groupBy("shard").agg(
        F.count(F.lit(1)).alias("n"), F.min("id").alias("lo"), F.max("id").alias("hi"))
    total = f.agg(F.count(F.lit(1))).scalar()
    before = per.select((F.col("shard") + 1).alias("shard"), F.col("hi").alias("hi_before"))
    return per.join(before, "shard", "left").select(
        "shard", (F.abs(F.col("n") * N_SHARDS - total) * 10 <= total).alias("even"),
        F.coalesce(F.col("lo") > F.col("hi_before"), F.lit(True)).alias("ascending"), total.alias("n_total"))


# ------------------------------------------------------------------ prepared tables

def packaged_files(spark: SparkSession, sf: str) -> DataFrame:
    return prepare.packaged_files(td.file(spark, sf))


def package_reads(spark: SparkSession, sf: str) -> DataFrame:
    return prepare.package_reads(td.billinginfo(spark, sf),
                                 prepare.packaged_files(td.file(spark, sf)))


def package_reads_bucketed(spark: SparkSession, sf: str) -> DataFrame:
    """As ``package_reads``, on packaged files stored in buckets of ``pnfsid``."""
    path, n = _scratch(spark, "bucketed"), int(spark.conf.get("spark.sql.shuffle.partitions"))
    write_bucketed(prepare.packaged_files(td.file(spark, sf)), path, "pnfsid", n)
    return prepare.package_reads(td.billinginfo(spark, sf), open_bucketed(spark, path, "pnfsid", n))


def small_file_reads(spark: SparkSession, sf: str) -> DataFrame:
    pr = prepare.package_reads(td.billinginfo(spark, sf),
                               prepare.packaged_files(td.file(spark, sf)))
    return prepare.small_file_reads(pr, td.volume(spark, sf))


def small_file_stores(spark: SparkSession, sf: str) -> DataFrame:
    s = prepare.small_file_stores(td.stores(spark, sf), prepare.packaged_files(td.file(spark, sf)),
                                  td.volume(spark, sf))
    return s.select("storageinfo_id", "pnfsid", "action", "volume", "file_family")


def filtered_mounts(spark: SparkSession, sf: str) -> DataFrame:
    return prepare.filtered_tape_mounts(td.tape_mounts(spark, sf), td.volume(spark, sf))


def mounts_with_family(spark: SparkSession, sf: str) -> DataFrame:
    return prepare.with_family(prepare.mount_writes(td.tape_mounts(spark, sf)),
                               td.volume(spark, sf), how="inner")


# ------------------------------------------------------------------ aggregates

def library_counts(spark: SparkSession, sf: str) -> DataFrame:
    return agg.library_counts(td.file(spark, sf))


def family_min_id(spark: SparkSession, sf: str) -> DataFrame:
    return agg.family_min_id(td.volume(spark, sf))


def family_labels(spark: SparkSession, sf: str) -> DataFrame:
    return _family_labels(td.volume(spark, sf))


def family_key(spark: SparkSession, sf: str) -> DataFrame:
    return agg.family_keys(td.volume(spark, sf))


def family_key_collisions(spark: SparkSession, sf: str) -> DataFrame:
    return agg.family_key_collisions(td.volume(spark, sf))


# ------------------------------------------------------------------ predicates and scalars

def eligible_stores(spark: SparkSession, sf: str) -> DataFrame:
    s = td.stores(spark, sf)
    return s.select("storageinfo_id", "action",
                    F.coalesce(waits.eligible_store(s), F.lit(False)).alias("eligible_store"))


def eligible_restores(spark: SparkSession, sf: str) -> DataFrame:
    s = td.stores(spark, sf)
    return s.select(
        "storageinfo_id", "action",
        F.coalesce(waits.eligible_restore_wait(s), F.lit(False)).alias("eligible_restore_wait"),
        F.coalesce(waits.eligible_restore_volume(s), F.lit(False)).alias("eligible_restore_volume"))


def bfid_parse(spark: SparkSession, sf: str) -> DataFrame:
    r = td.reads(spark, sf)
    ok = F.coalesce(bfid_site_ok("bfid"), F.lit(False))
    ep = bfid_epoch("bfid")
    return r.select("sfbr_id", "bfid", ok.alias("site_ok"), ep.alias("bfid_epoch"),
                    (ok & ep.isNotNull()).alias("bfid_valid"))


def bfid_window(spark: SparkSession, sf: str) -> DataFrame:
    r = td.reads(spark, sf).filter(bfid_site_ok("bfid") & bfid_epoch("bfid").isNotNull())
    t = bfid_time("bfid")
    return r.select("sfbr_id", t.alias("bfid_time"),
                    (t + F.make_dt_interval(secs=F.lit(waits.HOST_VOLUME_WINDOW.total_seconds())))
                    .alias("window_end"))


def age_parts(spark: SparkSession, sf: str) -> DataFrame:
    """Calendar age of each event since its user's first event (every event, once)."""
    e = td.table(spark, sf, "events").select("event_id", "user_id", "ts")
    o = e.groupBy("user_id").agg(F.min("ts").alias("other_ts"))
    j = with_age(e.join(o, "user_id", "left"), "ts", "other_ts", prefix="age_", total="wait_us")
    return j.select("event_id", "wait_us", "age_months", "age_days", "age_us")


def age_parts_dates(spark: SparkSession, sf: str) -> DataFrame:
    """Calendar age of ship date vs order date, in both directions."""
    li = td.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate")
    o = td.table(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderdate")
    j = li.join(o, "l_orderkey")
    j = with_age(j, "l_shipdate", "o_orderdate", prefix="ship_")
    j = with_age(j, "o_orderdate", "l_shipdate", prefix="back_")
    return j.select("l_orderkey", "l_linenumber", "ship_months", "ship_days", "ship_us",
                    "back_months", "back_days", "back_us")


# ------------------------------------------------------------------ as-of joins

def _event_sides(spark: SparkSession, sf: str):
    ev = td.table(spark, sf, "events")
    req = ev.filter(F.col("event_type") == "view").select("event_id", "user_id", "ts")
    mnt = ev.filter(F.col("event_type") == "purchase").select(
        F.col("event_id").alias("m_event_id"), F.col("user_id").alias("m_user_id"),
        F.col("ts").alias("m_ts"))
    return req, mnt


def asof_next(spark: SparkSession, sf: str) -> DataFrame:
    req, mnt = _event_sides(spark, sf)
    out = next_within(req, mnt, left_by="user_id", right_by="m_user_id", left_time="ts",
                      right_time="m_ts", window=EVENT_WINDOW, tie="m_event_id")
    return out.select("event_id", F.col("match.m_event_id").alias("next_event_id"),
                      F.col("match.time").alias("next_ts"))


def asof_prev(spark: SparkSession, sf: str) -> DataFrame:
    req, mnt = _event_sides(spark, sf)
    out = prev_within(req, mnt, left_by="user_id", right_by="m_user_id", left_time="ts",
                      right_time="m_ts", window=EVENT_WINDOW, tie="m_event_id")
    return out.select("event_id", F.col("match.m_event_id").alias("prev_event_id"),
                      F.col("match.time").alias("prev_ts"))


def asof_next_split(spark: SparkSession, sf: str) -> DataFrame:
    """As ``asof_next``, with a third of all events on one key, whose distinct
    times a small target splits into many cells."""
    req, mnt = _event_sides(spark, sf)
    key = lambda i, u: F.when(F.col(i) % 3 == 0, F.lit(-1)).otherwise(F.col(u)).cast("long")
    out = next_within(req.withColumn("k", key("event_id", "user_id")), mnt.withColumn("mk", key("m_event_id", "m_user_id")),
                      left_by="k", right_by="mk", left_time="ts", right_time="m_ts", window=EVENT_WINDOW,
                      tie="m_event_id", target_cell_rows=20)
    return out.select("event_id", F.col("match.m_event_id").alias("next_event_id"),
                      F.col("match.time").alias("next_ts"))


def asof_next_ties(spark: SparkSession, sf: str) -> DataFrame:
    """Line items by supplier nation -> next order by customer nation within
    100 days; midnight times give many ties, the smallest order key wins."""
    li = td.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey",
                                                "l_suppkey", "l_shipdate")
    sup = td.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("l_suppkey"),
                                                 F.col("s_nationkey").alias("nation"))
    orders = td.table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    cust = td.table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"),
                                                  F.col("c_nationkey").alias("o_nation"))
    left = join_dimension(li, sup, "l_suppkey")
    right = join_dimension(orders, cust, "o_custkey")
    out = next_within(left, right, left_by="nation", right_by="o_nation",
                      left_time="l_shipdate", right_time="o_orderdate", window=TIES_WINDOW,
                      tie="o_orderkey")
    return out.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
                      F.col("match.o_orderkey").alias("next_orderkey"),
                      F.col("match.time").alias("next_orderdate"))


def asof_next_hot_key(spark: SparkSession, sf: str) -> DataFrame:
    """As ``asof_next_ties`` with a third of both sides (order keys divisible
    by 3) moved onto one hot key, to exercise the skew handling."""
    li = td.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey",
                                                "l_suppkey", "l_shipdate")
    sup = td.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("l_suppkey"),
                                                 F.col("s_nationkey").alias("s_nation"))
    orders = td.table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    cust = td.table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"),
                                                  F.col("c_nationkey").alias("c_nation"))
    left = join_dimension(li, sup, "l_suppkey").withColumn(
        "nation", F.when(F.col("l_orderkey") % 3 == 0, F.lit(HOT_KEY)).otherwise(F.col("s_nation")))
    right = join_dimension(orders, cust, "o_custkey").withColumn(
        "o_nation", F.when(F.col("o_orderkey") % 3 == 0, F.lit(HOT_KEY)).otherwise(F.col("c_nation")))
    out = next_within(left, right, left_by="nation", right_by="o_nation",
                      left_time="l_shipdate", right_time="o_orderdate", window=TIES_WINDOW,
                      tie="o_orderkey")
    return out.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
                      F.col("match.o_orderkey").alias("next_orderkey"),
                      F.col("match.time").alias("next_orderdate"))


def asof_next_burst(spark: SparkSession, sf: str) -> DataFrame:
    """Half of all line items and orders (even order keys) fall on one key within 30 seconds, and a
    tenth on one instant of it; a target of 1,000 rows cuts the burst into many cells."""
    def burst(key, micros):
        start = F.lit(BURST_START).cast("timestamp_ntz")
        at = F.when(F.col(key) % 10 == 0, F.lit(15_000_000)).otherwise(micros % 30_000_000)
        return F.col(key) % 2 == 0, start + F.make_dt_interval(secs=at / 1_000_000)
    li = td.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate")
    orders = td.table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    hot, at = burst("l_orderkey", F.col("l_orderkey") * 7919 + F.col("l_linenumber") * 104729)
    left = (li.withColumn("k", F.when(hot, F.lit(-1)).otherwise(F.col("l_suppkey")))
            .withColumn("t", F.when(hot, at).otherwise(F.col("l_shipdate").cast("timestamp_ntz"))))
    hot, at = burst("o_orderkey", F.col("o_orderkey") * 15485863)
    right = orders.select("o_orderkey", F.when(hot, F.lit(-1)).otherwise(F.col("o_custkey")).alias("mk"),
                          F.when(hot, at).otherwise(F.col("o_orderdate").cast("timestamp_ntz")).alias("mt"))
    out = next_within(left, right, left_by="k", right_by="mk", left_time="t", right_time="mt", window=TIES_WINDOW,
                      tie="o_orderkey", target_cell_rows=BURST_TARGET)
    return out.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
                      F.col("match.o_orderkey").alias("next_orderkey"), F.col("match.time").alias("next_time"))


# ------------------------------------------------------------------ wait jobs

def _family_mounts(spark: SparkSession, sf: str) -> DataFrame:
    return prepare.filtered_tape_mounts(td.tape_mounts(spark, sf), td.volume(spark, sf))


def read_waits(spark: SparkSession, sf: str) -> DataFrame:
    out = waits.read_waits(td.reads(spark, sf), td.tape_mounts(spark, sf), READ_WINDOW)
    return _flat_wait(out.select("sfbr_id", "next_mount_id", "mount_wait"), "mount_wait")


def read_waits_migrated(spark: SparkSession, sf: str) -> DataFrame:
    out = waits.read_waits_migrated(td.reads(spark, sf), td.tape_mounts(spark, sf), READ_WINDOW)
    return _flat_wait(out.select("sfbr_id", "migration_next_mount_id", "migration_mount_wait"),
                      "migration_mount_wait")


def previous_mount(spark: SparkSession, sf: str) -> DataFrame:
    out = waits.previous_mount(td.reads(spark, sf), td.tape_mounts(spark, sf), READ_WINDOW)
    return _flat_wait(out.select("sfbr_id", "previous_mount_100d_id", "previous_mount_100d_wait"),
                      "previous_mount_100d_wait")


def _flat_read_waits(out: DataFrame) -> DataFrame:
    out = out.select("sfbr_id", "next_mount_id", "migration_next_mount_id",
                     "previous_mount_100d_id", "mount_wait", "migration_mount_wait",
                     "previous_mount_100d_wait")
    for c, p in [("mount_wait", "next_"), ("migration_mount_wait", "mig_"),
                 ("previous_mount_100d_wait", "prev_")]:
        out = out.select(*[x for x in out.columns if x != c],
                         F.col(f"{c}.total_us").alias(p + "wait_us"),
                         F.col(f"{c}.months").alias(p + "age_months"),
                         F.col(f"{c}.days").alias(p + "age_days"),
                         F.col(f"{c}.us").alias(p + "age_us"))
    return out


def read_waits_all(spark: SparkSession, sf: str) -> DataFrame:
    """The three read lookups in one job (one shuffle of the reads per key)."""
    out = waits.read_waits_all(td.reads(spark, sf), td.tape_mounts(spark, sf), READ_WINDOW,
                               READ_WINDOW)
    return _flat_read_waits(out)


def read_waits_late(spark: SparkSession, sf: str) -> DataFrame:
    """``read_waits_all`` of a table written before a tenth of the mounts had arrived, then brought up to
    date for the reads that those mounts touch."""
    root = _scratch(spark, "late")
    mounts = td.tape_mounts(spark, sf)
    late = F.col("tapemount_id") % 10 == 3
    td.reads(spark, sf).write.parquet(f"{root}/reads")
    for name, rows in (("all", mounts), ("early", mounts.filter(~late)), ("late", mounts.filter(late))):
        rows.write.parquet(f"{root}/{name}")
    jobs.read_waits_job(spark, f"{root}/reads", f"{root}/early", f"{root}/waits", kind="all", window=READ_WINDOW)
    jobs.late_mounts_job(spark, f"{root}/late", f"{root}/all", f"{root}/waits", window=READ_WINDOW)
    return _flat_read_waits(spark.read.parquet(f"{root}/waits"))


def read_waits_chain(spark: SparkSession, sf: str) -> DataFrame:
    """Billing records to waits: reads of packaged files, their simulated host tape, then the three lookups, with
    the production windows; ids may repeat.  The mounts are spread over the years of the billing records."""
    first, spread = 788_918_400_000_000, 80
    moved = F.timestamp_micros(first + (epoch_micros("start") - CHAIN_START_US) * spread).cast("timestamp_ntz")
    mounts = td.tape_mounts(spark, sf).withColumn("finish", moved + (F.col("finish") - F.col("start"))).withColumn("start", moved)
    packaged = prepare.packaged_files(td.file(spark, sf))
    volume = td.volume(spark, sf)
    r = prepare.small_file_reads(prepare.package_reads(td.billinginfo(spark, sf), packaged), volume)
    r = cut_lineage(waits.read_host_volume(r, prepare.filtered_tape_mounts(mounts, volume)))
    out = waits.read_waits_all(r, mounts)
    return out.select("sfbr_id", "pnfsid", "volume", "next_mount_id", "migration_next_mount_id", "previous_mount_100d_id",
                      F.col("mount_wait.total_us").alias("next_wait_us"),
                      F.col("migration_mount_wait.total_us").alias("mig_wait_us"),
                      F.col("previous_mount_100d_wait.total_us").alias("prev_wait_us"))


def read_host_volume(spark: SparkSession, sf: str) -> DataFrame:
    out = waits.read_host_volume(td.reads(spark, sf), _family_mounts(spark, sf), FAMILY_WINDOW)
    return out.select("sfbr_id", "volume")


def store_waits(spark: SparkSession, sf: str) -> DataFrame:
    out = waits.store_waits(td.stores(spark, sf), _family_mounts(spark, sf), FAMILY_WINDOW)
    return _flat_wait(out.select("storageinfo_id", "volume", "updated", "next_mount_time",
                                 "next_mount_id", "mount_wait"), "mount_wait")


def restore_host_volume(spark: SparkSession, sf: str) -> DataFrame:
    out = waits.restore_host_volume(td.stores(spark, sf), _family_mounts(spark, sf),
                                    FAMILY_WINDOW)
    return out.select("storageinfo_id", "updated", "volume")


def restore_waits(spark: SparkSession, sf: str) -> DataFrame:
    out = waits.restore_waits(td.stores(spark, sf), td.tape_mounts(spark, sf), READ_WINDOW)
    return _flat_wait(out.select("storageinfo_id", "updated", "next_mount_time", "mount_wait"),
                      "mount_wait")


def restore_chain(spark: SparkSession, sf: str) -> DataFrame:
    """Host volume, then wait, of every restore, each stage with its own
    done column: a restore that just received a tape also gets its wait."""
    out = waits.restore_chain(td.stores(spark, sf), _family_mounts(spark, sf),
                              td.tape_mounts(spark, sf), FAMILY_WINDOW, READ_WINDOW)
    return _flat_wait(out.select("storageinfo_id", "volume", "volume_done", "wait_done",
                                 "next_mount_time", "mount_wait"), "mount_wait")


def storage_waits_all(spark: SparkSession, sf: str) -> DataFrame:
    """Store waits, restore host tapes and restore waits in one job."""
    out = waits.storage_waits_all(td.stores(spark, sf), _family_mounts(spark, sf),
                                  td.tape_mounts(spark, sf), FAMILY_WINDOW, FAMILY_WINDOW,
                                  READ_WINDOW)
    return _flat_wait(out.select("storageinfo_id", "volume", "updated", "volume_done",
                                 "wait_done", "next_mount_time", "next_mount_id", "mount_wait"),
                      "mount_wait")


def enrich_update(spark: SparkSession, sf: str) -> DataFrame:
    """Apply host-volume results to the store table by id (matched rows get
    the new volume and the done flag, the others keep theirs)."""
    stores = td.stores(spark, sf)
    found = waits.restore_host_volume(stores, _family_mounts(spark, sf), FAMILY_WINDOW,
                                      mark="_changed")
    updates = found.filter(F.col("_changed")).select(
        "storageinfo_id", "volume", F.lit(True).alias("updated"))
    out = enrich(stores, updates, "storageinfo_id")
    return out.select("storageinfo_id", "action", "updated", "volume")


def enrich_in_place(spark: SparkSession, sf: str) -> DataFrame:
    """As ``enrich_update``, on a table stored by day, of which only days with a changed row are rewritten."""
    path = _scratch(spark, "stores")
    stores = td.stores(spark, sf)
    write_snapshot(stores.withColumn("ds", F.to_date("datestamp")), path, partition_by=["ds"])
    found = waits.restore_host_volume(stores, _family_mounts(spark, sf), FAMILY_WINDOW, mark="_changed")
    updates = found.filter("_changed").select("storageinfo_id", "volume", F.lit(True).alias("updated"))
    update_partitions(spark, path, updates, "storageinfo_id", "ds")
    return spark.read.parquet(path).select("storageinfo_id", "action", "updated", "volume")


# ------------------------------------------------------------------ incremental load

def date_slices(spark: SparkSession, sf: str) -> DataFrame:
    b = td.billinginfo(spark, sf)
    return ingest.daily_counts(b, "datestamp")


def date_copy(spark: SparkSession, sf: str) -> DataFrame:
    """The copy itself: four date lists that overlap, nest and merge, one after another; rows and distinct ids per
    copied day."""
    b, target = td.billinginfo(spark, sf), _scratch(spark, "copy")
    for dates in COPY_LISTS:
        ingest.copy_by_slices(spark, b, "datestamp", target, dates)
    return spark.read.parquet(target).groupBy(F.to_date("ds").alias("day")).agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_distinct("billinginfo_id").alias("n_ids"))


SUITE = {
    "scan_table": scan_table,
    "id_range_shards": id_range_shards,
    "depth_shards": depth_shards,
    "packaged_files": packaged_files,
    "package_reads": package_reads,
    "package_reads_bucketed": package_reads_bucketed,
    "small_file_reads": small_file_reads,
    "small_file_stores": small_file_stores,
    "filtered_mounts": filtered_mounts,
    "mounts_with_family": mounts_with_family,
    "library_counts": library_counts,
    "family_min_id": family_min_id,
    "family_labels": family_labels,
    "family_key": family_key,
    "family_key_collisions": family_key_collisions,
    "eligible_stores": eligible_stores,
    "eligible_restores": eligible_restores,
    "bfid_parse": bfid_parse,
    "bfid_window": bfid_window,
    "age_parts": age_parts,
    "age_parts_dates": age_parts_dates,
    "asof_next": asof_next,
    "asof_next_split": asof_next_split,
    "asof_prev": asof_prev,
    "asof_next_ties": asof_next_ties,
    "asof_next_hot_key": asof_next_hot_key,
    "asof_next_burst": asof_next_burst,
    "read_waits": read_waits,
    "read_waits_migrated": read_waits_migrated,
    "previous_mount": previous_mount,
    "read_waits_all": read_waits_all,
    "read_waits_chain": read_waits_chain,
    "read_waits_late": read_waits_late,
    "read_host_volume": read_host_volume,
    "store_waits": store_waits,
    "restore_host_volume": restore_host_volume,
    "restore_waits": restore_waits,
    "restore_chain": restore_chain,
    "storage_waits_all": storage_waits_all,
    "enrich_update": enrich_update,
    "enrich_in_place": enrich_in_place,
    "date_slices": date_slices,
    "date_copy": date_copy,
}
