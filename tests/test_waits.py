"""Enrichment and wait jobs on hand-made rows."""

import datetime as dt

from pyspark.sql import functions as F

from mountwait.operators.enrich import enrich, set_where
from mountwait.plans import waits

T0 = dt.datetime(2024, 5, 1, 10, 0, 0)
H = dt.timedelta(hours=1)

MOUNTS = "tapemount_id bigint, volume string, start timestamp_ntz, finish timestamp_ntz, writes bigint"
READS = ("sfbr_id bigint, bfid string, datestamp timestamp_ntz, file_family string, volume string, "
         "migrated_volume string, next_mount_id bigint")


def test_enrich_keeps_unmatched_rows(spark):
    base = spark.createDataFrame([(1, "x", True), (2, "y", False), (3, None, None)],
                                 "id bigint, v string, f boolean")
    upd = spark.createDataFrame([(2, "new", 7)], "id bigint, v string, extra int")
    got = sorted(tuple(r) for r in enrich(base, upd, "id").collect())
    assert got == [(1, "x", True, None), (2, "new", False, 7), (3, None, None, None)]


def test_set_where_null_condition_keeps_old(spark):
    df = spark.createDataFrame([(1, None), (2, True)], "v int, c boolean")
    got = [r.v for r in set_where(df, F.col("c"), {"v": F.lit(9)}).orderBy(F.col("v")).collect()]
    assert got == [1, 9]


def test_read_waits_unmatched_keep_old_values(spark):
    reads = spark.createDataFrame([
        (1, "CDMS1714557600000001", T0, "f", "V1", None, 55),   # old value 55 kept (no mount)
        (2, "CDMS1714557600000002", T0, "f", "V2", None, None),
        (3, "CDMS1714557600000003", None, "f", "V2", None, 66),  # not eligible
    ], READS)
    mounts = spark.createDataFrame([(100, "V2", T0 + H, T0 + 2 * H, 1)], MOUNTS)
    out = {r.sfbr_id: r for r in waits.read_waits(reads, mounts, dt.timedelta(days=1)).collect()}
    assert out[1].next_mount_id == 55 and out[1].mount_wait is None
    assert out[2].next_mount_id == 100
    assert tuple(out[2].mount_wait) == (0, 0, 3600 * 10**6, 3600 * 10**6)
    assert out[3].next_mount_id == 66


def test_previous_mount_null_finish_blocks_older(spark):
    reads = spark.createDataFrame([(1, "CDMS1714557600000001", T0, "f", "V1", "V9", None)], READS)
    mounts = spark.createDataFrame([
        (100, "V9", T0 - 3 * H, T0 - 2 * H, 1),   # older, finished
        (101, "V9", T0 - H, None, 1),             # latest, not finished -> no result
    ], MOUNTS)
    out = waits.previous_mount(reads, mounts, dt.timedelta(days=1)).first()
    assert out.previous_mount_100d_id is None and out.previous_mount_100d_wait is None


def test_previous_mount_negative_wait(spark):
    reads = spark.createDataFrame([(1, "CDMS1714557600000001", T0, "f", "V1", "V9", None)], READS)
    mounts = spark.createDataFrame([(100, "V9", T0 - 3 * H, T0 - 2 * H, 1)], MOUNTS)
    out = waits.previous_mount(reads, mounts, dt.timedelta(days=1)).first()
    assert out.previous_mount_100d_id == 100
    assert tuple(out.previous_mount_100d_wait) == (0, 0, -2 * 3600 * 10**6, -2 * 3600 * 10**6)


def test_restore_chain_uses_own_done_columns(spark):
    stores = spark.createDataFrame([
        (1, "restore", 0, False, "P1", "CDMS1714557600000001", T0, "fam", None),
    ], "storageinfo_id bigint, action string, errorcode int, updated boolean, pnfsid string, "
       "bfid string, datestamp timestamp_ntz, file_family string, volume string")
    # BFID time 2024-05-01 10:00:00; first writing mount of the family 5 min later on V7
    fam_mounts = spark.createDataFrame([(200, "V7", T0 + dt.timedelta(minutes=5), None, 1, "fam")],
                                       MOUNTS + ", file_family string")
    mounts = spark.createDataFrame([(300, "V7", T0 + 2 * H, None, 1)], MOUNTS)
    out = waits.restore_chain(stores, fam_mounts, mounts).first()
    assert out.volume == "V7" and out.volume_done and out.wait_done
    assert out.next_mount_time == T0 + 2 * H
    assert out.updated is False          # the input flag is left alone


def test_enrich_check_unique_raises(spark):
    import pytest
    base = spark.createDataFrame([(1, "x")], "id bigint, v string")
    upd = spark.createDataFrame([(1, "a"), (1, "b")], "id bigint, v string")
    with pytest.raises(Exception, match="update keys repeat.*1"):
        enrich(base, upd, "id", check_unique=True).collect()
    # also when no base row has the key; a null key matches nothing and may repeat
    with pytest.raises(Exception, match="update keys repeat"):
        enrich(base.selectExpr("id + 1 as id", "v"), upd, "id").collect()
    nulls = spark.createDataFrame([(None, "a"), (None, "b"), (1, "c")], "id bigint, v string")
    assert [tuple(r) for r in enrich(base, nulls, "id").collect()] == [(1, "c")]


def test_enrich_computes_the_updates_once(spark):
    base = spark.createDataFrame([(1, "x"), (2, "y")], "id bigint, v string")
    runs = spark.sparkContext.accumulator(0)
    upd = spark.createDataFrame([(1, "a")], "id bigint, v string").rdd.map(lambda r: (runs.add(1), r)[1]).toDF()
    runs.value = 0
    assert sorted(tuple(r) for r in enrich(base, upd, "id").collect()) == [(1, "a"), (2, "y")]
    assert runs.value == 1


def test_bad_bfid_strict(spark):
    import pytest
    reads = spark.createDataFrame([(1, "CDMS17x", T0, "f", "V1", None, None)], READS)
    fam_mounts = spark.createDataFrame([(200, "V7", T0, None, 1, "f")], MOUNTS + ", file_family string")
    out = waits.read_host_volume(reads, fam_mounts).first()
    assert out.volume == "V1"          # no time -> no match, old value kept
    with pytest.raises(ValueError):
        waits.read_host_volume(reads, fam_mounts, strict=True)


def test_dimension_join_gives_no_hint(spark):
    from mountwait.operators.joins import join_dimension
    fact = spark.range(100).withColumnRenamed("id", "k")
    dim = spark.range(10).withColumnRenamed("id", "k")
    plan = join_dimension(fact, dim, "k")._jdf.queryExecution().analyzed().toString()
    assert "strategy=broadcast" not in plan


def test_restore_chain_skips_restores_marked_updated(spark):
    stores = spark.createDataFrame([
        (n, "restore", 0, flag, "P1", "CDMS1714557600000001", T0, "fam", None) for n, flag in enumerate([True, None, False])
    ], "storageinfo_id bigint, action string, errorcode int, updated boolean, pnfsid string, "
       "bfid string, datestamp timestamp_ntz, file_family string, volume string")
    fam = spark.createDataFrame([(200, "V7", T0 + dt.timedelta(minutes=5), None, 1, "fam")], MOUNTS + ", file_family string")
    mounts = spark.createDataFrame([(300, "V7", T0 + 2 * H, None, 1)], MOUNTS)
    out = {r.storageinfo_id: r.volume_done for r in waits.restore_chain(stores, fam, mounts).collect()}
    assert out == {0: False, 1: False, 2: True}


def test_small_file_stores_keep_their_family(spark):
    from mountwait.plans import prepare
    stores = spark.createDataFrame([(1, "P1", "own", None), (2, "P1", None, None), (3, "P2", None, "V9"), (4, "P3", None, None)],
                                   "storageinfo_id long, pnfsid string, file_family string, volume string")
    packaged = spark.createDataFrame([("P1", "V1"), ("P1", "V1"), ("P2", "V2")], "pnfsid string, volume string")
    volume = spark.createDataFrame([("V1", "fam-1"), ("V9", "fam-9")], "label string, file_family string")
    out = {r.storageinfo_id: r.file_family for r in prepare.small_file_stores(stores, packaged, volume).collect()}
    assert out == {1: "own", 2: "fam-1", 3: None}

def test_read_waits_all_same_for_any_cell_width(spark):
    from conftest import SF01
    from mountwait.sources import testdata as td
    reads, mounts = td.reads(spark, SF01), td.tape_mounts(spark, SF01)
    cols = ["sfbr_id", "next_mount_id", "mount_wait", "migration_next_mount_id",
            "migration_mount_wait", "previous_mount_100d_id", "previous_mount_100d_wait"]
    a = waits.read_waits_all(reads, mounts, 86400, 86400).select(*cols)
    spark.conf.set("mountwait.asof.targetCellRows", "3")
    try:
        b = waits.read_waits_all(reads, mounts, 86400, 86400).select(*cols)
    finally:
        spark.conf.unset("mountwait.asof.targetCellRows")
    assert a.count() == b.count() == reads.count()
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0
