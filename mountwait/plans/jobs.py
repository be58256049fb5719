"""Batch jobs: read the input tables, run one plan, write one snapshot.

A table is named by a Parquet path, or by a dict for JDBC
(``{"url": ..., "table": ..., "column": ..., "partitions": ..., "lower": ..., "upper": ...,
"equal_depth": ..., "fetch_size": ..., "properties": {...}}``) or for a bucketed Parquet table
(``{"path": ..., "by": ..., "buckets": ...}``).
Parquet outputs are written as new snapshots (overwrite of the target path,
or of the partitions present), so re-running a job after a failure rewrites
the same snapshot; the target must differ from the inputs.  A JDBC target is
appended to (created when absent), with structs as flat columns
(``mount_wait_days``); a repeated append repeats its rows, so a run with
``since`` takes a Parquet target only.

Command line: ``python -m mountwait.plans.jobs <job> key=value ...``; a
value that is JSON (a JDBC table spec, a number, ``true``/``false``) is
parsed, anything else is a string (paths, dates).  Windows are seconds.
"""

from __future__ import annotations

import datetime as _dt
import json
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mountwait.contracts import CONTRACTS, conform
from mountwait.functions.bfid import count_bad_bfids
from mountwait.operators.aggregates import family_min_id, library_counts
from mountwait.plans import ingest, prepare, waits
from mountwait.session import build_session, scratch_tables
from mountwait.sources.buckets import open_bucketed, write_bucketed
from mountwait.sources.jdbc import DEFAULT_FETCH_SIZE, read_jdbc, read_jdbc_grouped
from mountwait.sources.shards import with_shards
from mountwait.sources.sinks import append_table, family_labels, write_snapshot
from mountwait.sources.tables import read_table


def load(spark: SparkSession, src, contract: str | None = None) -> DataFrame:
    if isinstance(src, dict) and "buckets" in src:
        df = open_bucketed(spark, src["path"], src["by"], src["buckets"])
        return conform(df, CONTRACTS[contract]) if contract else df
    if isinstance(src, dict):
        df = read_jdbc(spark, src["url"], src["table"], column=src.get("column"),
                       num_partitions=src.get("partitions"), lower=src.get("lower"),
                       upper=src.get("upper"), properties=src.get("properties"),
                       fetch_size=src.get("fetch_size", DEFAULT_FETCH_SIZE),
                       equal_depth=src.get("equal_depth", False))
        return conform(df, CONTRACTS[contract]) if contract else df
    return read_table(spark, src, contract)


# ------------------------------------------------------------ incremental runs
# Enriched request tables are written partitioned by request day ``ds``.  A
# run with ``since`` recomputes only the request days on or after ``since``
# (whole day partitions, replaced by dynamic partition overwrite) using the
# mounts from ``since - window`` on; older days keep their files.  A request
# older than (last cutoff - window) can no longer change, so
# ``since = last cutoff - window`` gives the same table as a full run.
# (Host-volume lookups start at the file's creation, which precedes its
# requests, so the same ``since`` covers them.)

DAY_COL = "ds"


def _day_start(since) -> _dt.datetime:
    d = since if isinstance(since, (_dt.date, _dt.datetime)) else _dt.datetime.fromisoformat(str(since))
    return _dt.datetime(d.year, d.month, d.day)


def _ts(value: _dt.datetime):
    return F.lit(value.isoformat(sep=" ")).cast("timestamp_ntz")


def pending_requests(requests: DataFrame, since=None, time_col: str = "datestamp") -> DataFrame:
    """Requests of the days on or after ``since`` (all requests when None)."""
    if since is None:
        return requests
    return requests.filter(F.col(time_col) >= _ts(_day_start(since)))


def relevant_mounts(mounts: DataFrame, since=None, window=waits.DEFAULT_WINDOW,
                    time_col: str = "start") -> DataFrame:
    """Mounts that can answer a request of ``since``'s day or later, in either
    direction (the filter reaches the scan)."""
    if since is None:
        return mounts
    w = window if isinstance(window, _dt.timedelta) else _dt.timedelta(seconds=float(window))
    return mounts.filter(F.col(time_col) > _ts(_day_start(since) - w))


def flat(df: DataFrame) -> DataFrame:
    """Every struct column as columns ``<column>_<field>`` (databases store no structs)."""
    cols = []
    for f in df.schema.fields:
        if f.dataType.typeName() == "struct":
            cols += [F.col(f"`{f.name}`.`{n}`").alias(f"{f.name}_{n}") for n in f.dataType.names]
        else:
            cols.append(F.col(f"`{f.name}`"))
    return df.select(*cols)


def write_by_day(out: DataFrame, target, time_col: str = "datestamp", since=None) -> None:
    """Parquet path: day partitions replaced.  JDBC dict: append of flat rows."""
    if isinstance(target, dict):
        if since is not None:
            raise ValueError("a run with since needs a Parquet target: an append would repeat rows of those days")
        save(out, target)
        return
    write_snapshot(out.withColumn(DAY_COL, F.to_date(time_col)), target, partition_by=[DAY_COL])


def save(df: DataFrame, target) -> None:
    """Parquet path: snapshot overwrite.  JDBC dict: append."""
    if isinstance(target, dict):
        append_table(flat(df), target["table"], jdbc_url=target["url"],
                     properties=target.get("properties"))
    else:
        write_snapshot(df, target)


def library_counts_job(spark, file_src) -> DataFrame:
    """Files per library (the caller shows or writes the small result).  On
    a JDBC source the grouping runs in the database (one row per library
    crosses the connection instead of every file)."""
    if isinstance(file_src, dict):
        return read_jdbc_grouped(spark, file_src["url"], file_src["table"], "original_library",
                                 {"n_files": "count"}, properties=file_src.get("properties")
                                 ).select("original_library", F.col("n_files").cast("long"))
    return library_counts(load(spark, file_src, "file"))


def packaged_files_job(spark, file_src, target, shards: int | None = None) -> None:
    """Packaged files; with ``shards`` written partitioned by id range
    (``shard``), so a later id-range read prunes to its partitions.  A bucketed
    target (by ``pnfsid``) spares ``package_reads`` and ``small_file_stores`` the
    exchange of the files."""
    files = prepare.packaged_files(load(spark, file_src, "file"))
    if isinstance(target, dict) and "buckets" in target:
        write_bucketed(files, target["path"], target["by"], int(target["buckets"]))
    elif shards and not isinstance(target, dict):
        write_snapshot(with_shards(files, "id", int(shards)), target, partition_by=["shard"])
    else:
        save(files, target)


def package_reads_job(spark, billing_src, packaged_src, target: str) -> None:
    reads = prepare.package_reads(load(spark, billing_src, "billinginfo"), load(spark, packaged_src))
    save(reads, target)


def filtered_mounts_job(spark, mounts_src, volume_src, target) -> None:
    """Mounts with writes, with the family of the mounted tape."""
    save(prepare.filtered_tape_mounts(load(spark, mounts_src, "tape_mounts"),
                                      load(spark, volume_src, "volume")), target)


def small_file_reads_job(spark, package_reads_src, volume_src, target) -> None:
    """Read requests of packaged files, from the table ``package_reads`` wrote."""
    save(prepare.small_file_reads(load(spark, package_reads_src), load(spark, volume_src, "volume")),
         target)


def small_file_stores_job(spark, storage_src, packaged_src, volume_src, target) -> None:
    """Store and restore requests of packaged files with their family, from
    the request log and the table ``packaged_files`` wrote.  A log without
    the columns ``updated`` and ``volume`` gets them as false and null."""
    requests = load(spark, storage_src, "storageinfo")
    for name, value in (("updated", F.lit(False)), ("volume", F.lit(None).cast("string"))):
        if name not in requests.columns:
            requests = requests.withColumn(name, value)
    save(prepare.small_file_stores(requests, load(spark, packaged_src, "file"),
                                   load(spark, volume_src, "volume")), target)


def family_tables_job(spark, volume_src, target, keep_existing: bool = True) -> DataFrame:
    """Label set of every family, one partition per family.  With
    ``keep_existing`` a family that already has labels under ``target`` is
    left as it is (create-if-absent); otherwise it is replaced.  A JDBC
    target is one table, read first with ``keep_existing`` (it must exist)
    and written anew without."""
    vol = load(spark, volume_src, "volume")
    labels = family_labels(vol)
    if keep_existing:
        have = _existing_families(spark, target)
        if have is not None:
            labels = labels.join(have, "file_family", "left_anti")
    if isinstance(target, dict):
        append_table(labels, target["table"], jdbc_url=target["url"], properties=target.get("properties"),
                     mode="append" if keep_existing else "overwrite")
    else:
        write_snapshot(labels, target, partition_by=["file_family"])
    if isinstance(volume_src, dict):  # derived table: the database groups
        return read_jdbc_grouped(spark, volume_src["url"], volume_src["table"], "file_family",
                                 {"min_id": "min:id"}, properties=volume_src.get("properties")
                                 ).select("file_family", F.col("min_id").cast("long"))
    return family_min_id(vol)


def _existing_families(spark, target):
    if isinstance(target, dict):
        return load(spark, target).select("file_family").distinct()
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(target)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return None
    return spark.read.parquet(target).select("file_family").distinct()


def read_waits_job(spark, reads_src, mounts_src, target: str, kind: str = "next",
                   window=waits.DEFAULT_WINDOW, since=None) -> None:
    """``kind``: ``next`` (own tape), ``migrated`` (tape after migration),
    ``previous`` (last mount before the read) or ``all`` (the three at once,
    one shuffle of the reads)."""
    reads = pending_requests(load(spark, reads_src, "small_file_billinginfo_reads"), since)
    mounts = relevant_mounts(load(spark, mounts_src, "tape_mounts"), since, window)
    if kind == "all":
        out = waits.read_waits_all(reads, mounts, window, previous_window=window)
    else:
        fn = {"next": waits.read_waits, "migrated": waits.read_waits_migrated,
              "previous": waits.previous_mount}[kind]
        out = fn(reads, mounts, window)
    write_by_day(out, target, since=since)


def late_mounts_job(spark, changed_src, mounts_src, target: str, window=waits.DEFAULT_WINDOW) -> list:
    """Bring a table written by ``read_waits`` (kind ``all``, same window) up to date with mounts that
    came late or were given a finish: ``changed_src`` holds them, ``mounts_src`` all mounts.

    Only reads with a changed mount inside one of their lookups are computed again, and
    only the day partitions that hold such reads are written.  The table's days are
    first narrowed to those within the window of a changed mount.  Returns the days written.
    """
    w = window if isinstance(window, _dt.timedelta) else _dt.timedelta(seconds=float(window))
    changed = load(spark, changed_src, "tape_mounts")
    span = changed.agg(F.min("start").alias("lo"), F.max("start").alias("hi")).first()
    if span.lo is None:
        return []
    near = spark.read.parquet(target).where(F.col(DAY_COL).between((span.lo - w).date(), (span.hi + w).date()))
    with scratch_tables(spark) as stored:
        flagged = stored(waits.touched_reads(near, changed, window, window).withColumn(
            DAY_COL, F.to_date(DAY_COL)))
        days = [r[0] for r in flagged.where("touched").select(DAY_COL).distinct().collect()]  # at most the table's days
        if not days:
            return []
        part = flagged.where(F.col(DAY_COL).isin(days))
        again = part.where("touched").drop("touched", *waits.READ_RESULTS)
        mounts = load(spark, mounts_src, "tape_mounts").filter(
            (F.col("start") > _ts(span.lo - 2 * w)) & (F.col("start") < _ts(span.hi + 2 * w)))
        again = waits.read_waits_all(again, mounts, window, previous_window=window)
        rows = stored(part.where("not touched").drop("touched").unionByName(again))
        write_snapshot(rows, target, partition_by=[DAY_COL])
    return days


def read_host_volume_job(spark, reads_src, mounts_src, volume_src, target: str,
                         window=waits.HOST_VOLUME_WINDOW) -> dict:
    """Simulated host tape of each read.  Returns ``rows`` and ``bad_bfids`` (site BFIDs without a
    readable time), counted while the rows are written."""
    fm = prepare.filtered_tape_mounts(load(spark, mounts_src, "tape_mounts"),
                                      load(spark, volume_src, "volume"))
    reads = load(spark, reads_src, "small_file_billinginfo_reads")
    out, seen = count_bad_bfids(waits.read_host_volume(reads, fm, window))
    write_by_day(out, target)
    return seen.get


def reads_job(spark, reads_src, mounts_src, volume_src, target: str,
              volume_window=waits.HOST_VOLUME_WINDOW, wait_window=waits.DEFAULT_WINDOW,
              since=None) -> dict:
    """All read stages in order: simulated host tape (from the file's
    creation), then next mount, next mount after migration and previous
    mount.  The first stage's result is stored in the shared folder until the job ends.
    Returns ``rows`` and ``bad_bfids`` of the reads."""
    mounts = load(spark, mounts_src, "tape_mounts")
    fm = prepare.filtered_tape_mounts(mounts, load(spark, volume_src, "volume"))
    reads = pending_requests(load(spark, reads_src, "small_file_billinginfo_reads"), since)
    with scratch_tables(spark) as stored:
        hosted, seen = count_bad_bfids(waits.read_host_volume(reads, fm, volume_window))
        hosted = stored(hosted)
        out = waits.read_waits_all(hosted, relevant_mounts(mounts, since, wait_window), wait_window,
                                   previous_window=wait_window)
        write_by_day(out, target, since=since)
    return seen.get


def store_waits_job(spark, stores_src, mounts_src, volume_src, target: str,
                    window=waits.DEFAULT_WINDOW, since=None) -> None:
    mounts = relevant_mounts(load(spark, mounts_src, "tape_mounts"), since, window)
    fm = prepare.filtered_tape_mounts(mounts, load(spark, volume_src, "volume"))
    stores = pending_requests(load(spark, stores_src, "storageinfo_sfa"), since)
    write_by_day(waits.store_waits(stores, fm, window), target, since=since)


def restore_job(spark, stores_src, mounts_src, volume_src, target: str,
                volume_window=waits.HOST_VOLUME_WINDOW, wait_window=waits.DEFAULT_WINDOW,
                since=None) -> dict:
    """Host volume, then wait, of every restore; the first stage's result is
    stored in the shared folder until the job ends, so the second stage starts
    from stored data instead of re-running the first.  Returns ``rows`` and
    ``bad_bfids`` of the requests."""
    mounts = relevant_mounts(load(spark, mounts_src, "tape_mounts"), since, wait_window)
    fm = prepare.filtered_tape_mounts(load(spark, mounts_src, "tape_mounts"),
                                      load(spark, volume_src, "volume"))
    stores = pending_requests(load(spark, stores_src, "storageinfo_sfa"), since)
    with scratch_tables(spark) as stored:
        out = waits.restore_chain(stores, fm, mounts, volume_window, wait_window, between=stored)
        out, seen = count_bad_bfids(out)
        write_by_day(out, target, since=since)
    return seen.get


def storage_job(spark, stores_src, mounts_src, volume_src, target: str,
                store_window=waits.DEFAULT_WINDOW, volume_window=waits.HOST_VOLUME_WINDOW,
                wait_window=waits.DEFAULT_WINDOW, since=None) -> dict:
    """Store waits, restore host tapes and restore waits in one job (two
    shuffles of the store table instead of three).  Returns ``rows`` and
    ``bad_bfids`` of the requests."""
    all_mounts = load(spark, mounts_src, "tape_mounts")
    fm = prepare.filtered_tape_mounts(all_mounts, load(spark, volume_src, "volume"))
    stores = pending_requests(load(spark, stores_src, "storageinfo_sfa"), since)
    with scratch_tables(spark) as stored:
        out = waits.storage_waits_all(stores, fm, relevant_mounts(all_mounts, since, wait_window),
                                      store_window, volume_window, wait_window, between=stored)
        out, seen = count_bad_bfids(out)
        write_by_day(out, target, since=since)
    return seen.get


def copy_by_dates_job(spark, billing_src, target: str, dates_file: str) -> DataFrame:
    """Copy the billing table in the date slices listed (one date per line)."""
    dates = [r.value for r in spark.read.text(dates_file).collect() if r.value.strip()]
    dates = [str(ingest.DEFAULT_FIRST_DATE)] + dates
    return ingest.copy_by_slices(spark, load(spark, billing_src, "billinginfo"), "datestamp",
                                 target, dates)


JOBS = {
    "library_counts": library_counts_job,
    "packaged_files": packaged_files_job,
    "package_reads": package_reads_job,
    "filtered_mounts": filtered_mounts_job,
    "small_file_reads": small_file_reads_job,
    "small_file_stores": small_file_stores_job,
    "family_tables": family_tables_job,
    "read_waits": read_waits_job,
    "late_mounts": late_mounts_job,
    "read_host_volume": read_host_volume_job,
    "reads": reads_job,
    "store_waits": store_waits_job,
    "restores": restore_job,
    "storage": storage_job,
    "copy_by_dates": copy_by_dates_job,
}


def _value(text: str):
    try:
        return json.loads(text)
    except ValueError:
        return text


def main(argv: list[str]) -> None:
    if not argv or argv[0] not in JOBS:
        print("jobs:", ", ".join(JOBS))
        raise SystemExit(2)
    kwargs = {k: _value(v) for k, v in (a.split("=", 1) for a in argv[1:])}
    spark = build_session()
    out = JOBS[argv[0]](spark, **kwargs)
    if isinstance(out, DataFrame):
        out.show(truncate=False)
    elif out is not None:
        print(out)


if __name__ == "__main__":
    main(sys.argv[1:])
