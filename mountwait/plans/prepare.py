"""Prepared tables: packaged files, their reads, mounts with families.

All are filters and equi-joins.  Joins against ``volume`` (one row per
tape) become broadcasts where adaptive execution measures few bytes; the joins
between the large tables (billing records x packaged files, store requests x packaged
files) are shuffle joins on ``pnfsid`` whose skewed keys adaptive execution
splits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mountwait.operators.joins import join_dimension, using_join


def packaged_files(files: DataFrame) -> DataFrame:
    """Files that belong to a package (``package_id is not null``).

    The predicate reaches the scan (Parquet row-group / JDBC pushdown)."""
    return files.filter(F.col("package_id").isNotNull())


def package_reads(billinginfo: DataFrame, packaged: DataFrame) -> DataFrame:
    """Every read record of a packaged file, joined USING ``pnfsid``: the key,
    then the billing columns, then the file columns.  A file read many times
    yields one row per read."""
    return using_join(billinginfo, packaged, "pnfsid")


def family_of_labels(volume: DataFrame, keep_null: bool = False) -> DataFrame:
    """Distinct ``(label, file_family)`` pairs; an ``IN (select label ...)``
    test per family equals an equi-join on these pairs."""
    v = volume.select("label", "file_family")
    if not keep_null:
        v = v.filter(F.col("file_family").isNotNull())
    return v.filter(F.col("label").isNotNull()).distinct()


def mount_writes(mounts: DataFrame) -> DataFrame:
    """Mounts that wrote at least one file (``tape_mount_writes``)."""
    return mounts.filter(F.col("writes") > 0)


def with_family(mounts: DataFrame, volume: DataFrame, how: str = "inner") -> DataFrame:
    """Give each mount the family of its tape.  ``inner``: only mounts whose
    tape is in some family's label set (the semi-join of the store lookup);
    ``left``: every mount, family null when unknown."""
    fam = family_of_labels(volume, keep_null=(how == "left")).withColumnRenamed("label", "volume")
    cols = [c for c in mounts.columns if c != "file_family"]
    return join_dimension(mounts.select(*cols), fam, "volume", how)


def filtered_tape_mounts(mounts: DataFrame, volume: DataFrame) -> DataFrame:
    """Mounts with at least one write, with the family of the mounted tape."""
    return with_family(mount_writes(mounts), volume, how="left")


def small_file_reads(package_reads_df: DataFrame, volume: DataFrame) -> DataFrame:
    """Read requests of small (packaged) files, one row per read record.

    ``sfbr_id`` is the billing record id (stable across runs, unlike a
    generated row number); ``file_family`` comes from the tape the file is
    on (``volume`` of the file); ``migrated_volume`` keeps that tape, and
    ``volume`` - the simulated host tape - is left for ``read_host_volume``.
    """
    fam = family_of_labels(volume, keep_null=True).withColumnRenamed("label", "volume")
    r = package_reads_df.select(
        F.col("billinginfo_id").alias("sfbr_id"), "pnfsid", "bfid", "datestamp",
        F.col("volume"))
    r = join_dimension(r, fam, "volume", "left")
    return r.select("sfbr_id", "pnfsid", "bfid", "datestamp", "file_family",
                    F.lit(None).cast("string").alias("volume"),
                    F.col("volume").alias("migrated_volume"))


def small_file_stores(storageinfo: DataFrame, packaged: DataFrame, volume: DataFrame) -> DataFrame:
    """Store/restore requests of small (packaged) files, each once.

    A request keeps its family; where it has none it gets that of the tape
    its file is on (the least tape label, should a file be listed twice).
    """
    tapes = packaged.groupBy("pnfsid").agg(F.min("volume").alias("_tape"))
    fam = family_of_labels(volume, keep_null=True).select(
        F.col("label").alias("_tape"), F.col("file_family").alias("_family"))
    small = storageinfo.join(join_dimension(tapes, fam, "_tape", "left"), "pnfsid")
    own = F.col("file_family") if "file_family" in storageinfo.columns else F.lit(None).cast("string")
    cols = [c for c in storageinfo.columns if c != "file_family"]
    return small.select(*cols, F.coalesce(own, F.col("_family")).alias("file_family"))
