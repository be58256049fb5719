"""End-to-end jobs on Parquet snapshots written from the driver tables."""

import os

from pyspark.sql import functions as F

from mountwait.plans import jobs
from mountwait.sources import testdata as td

from conftest import SF001


def _stage(spark, tmp_dir):
    paths = {}
    for name, fn in [("file", td.file), ("billinginfo", td.billinginfo), ("volume", td.volume),
                     ("tape_mounts", td.tape_mounts), ("reads", td.reads), ("stores", td.stores)]:
        p = os.path.join(tmp_dir, name)
        fn(spark, SF001).write.parquet(p)
        paths[name] = p
    return paths


def test_jobs_end_to_end(spark, tmp_dir):
    p = _stage(spark, tmp_dir)
    out = lambda n: os.path.join(tmp_dir, "out", n)

    # packaged files: the null test reaches the Parquet scan
    plan = jobs.prepare.packaged_files(jobs.load(spark, p["file"], "file"))
    assert "IsNotNull(package_id)" in plan._jdf.queryExecution().executedPlan().toString()
    jobs.packaged_files_job(spark, p["file"], out("packaged"))
    n_packaged = spark.read.parquet(out("packaged")).count()
    assert n_packaged == td.file(spark, SF001).filter("package_id is not null").count()

    jobs.packaged_files_job(spark, p["file"], out("packaged_sharded"), shards=4)
    sharded = spark.read.parquet(out("packaged_sharded"))
    assert sharded.count() == n_packaged
    scan = sharded.filter("shard = 1")._jdf.queryExecution().executedPlan().toString()
    pf = scan[scan.index("PartitionFilters"):].split("]")[0]
    assert "shard" in pf                                      # id-range read prunes partitions

    jobs.package_reads_job(spark, p["billinginfo"], out("packaged"), out("package_reads"))
    assert spark.read.parquet(out("package_reads")).count() > 0

    # family tables: create-if-absent keeps the labels already written
    jobs.family_tables_job(spark, p["volume"], out("labels"))
    first = spark.read.parquet(out("labels")).count()
    extra = spark.createDataFrame([(999999, "VX", "fam-a"), (999998, "VY", "fam-new")],
                                  "id bigint, label string, file_family string")
    spark.read.parquet(p["volume"]).unionByName(extra).write.parquet(os.path.join(tmp_dir, "vol2"))
    jobs.family_tables_job(spark, os.path.join(tmp_dir, "vol2"), out("labels"))
    labels = spark.read.parquet(out("labels"))
    assert labels.count() == first + 1
    assert labels.filter(F.col("label") == "VX").count() == 0

    jobs.read_waits_job(spark, p["reads"], p["tape_mounts"], out("read_waits"),
                        window=86400)
    rw = spark.read.parquet(out("read_waits"))
    assert rw.count() == spark.read.parquet(p["reads"]).count()
    assert "mount_wait" in rw.columns

    jobs.restore_job(spark, p["stores"], p["tape_mounts"], p["volume"], out("restores"),
                     volume_window=900, wait_window=86400)
    rs = spark.read.parquet(out("restores"))
    assert rs.count() == spark.read.parquet(p["stores"]).count()
    assert {"volume_done", "wait_done", "mount_wait"} <= set(rs.columns)


def test_incremental_run_equals_full_run(spark, tmp_dir):
    p = _stage(spark, tmp_dir)
    full, inc = os.path.join(tmp_dir, "full"), os.path.join(tmp_dir, "inc")
    jobs.read_waits_job(spark, p["reads"], p["tape_mounts"], full, kind="all", window=86400)
    jobs.read_waits_job(spark, p["reads"], p["tape_mounts"], inc, kind="all", window=86400)
    days = sorted(r.ds for r in spark.read.parquet(inc).select("ds").distinct().collect())
    since = days[len(days) // 2]
    old_day = os.path.join(inc, f"ds={days[0]}")
    before = sorted(os.listdir(old_day))
    jobs.read_waits_job(spark, p["reads"], p["tape_mounts"], inc, kind="all", window=86400,
                        since=str(since))
    assert sorted(os.listdir(old_day)) == before          # older days not rewritten
    cols = ["sfbr_id", "next_mount_id", "migration_next_mount_id", "previous_mount_100d_id",
            "mount_wait", "previous_mount_100d_wait", "ds"]
    a = spark.read.parquet(full).select(*cols)
    b = spark.read.parquet(inc).select(*cols)
    assert a.count() == b.count() and a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_reads_job_chains_host_volume_and_waits(spark, tmp_dir):
    from mountwait.plans import waits as W
    p = _stage(spark, tmp_dir)
    target = os.path.join(tmp_dir, "reads_out")
    jobs.reads_job(spark, p["reads"], p["tape_mounts"], p["volume"], target,
                   volume_window=900, wait_window=86400)
    got = spark.read.parquet(target)
    reads = spark.read.parquet(p["reads"])
    fm = jobs.prepare.filtered_tape_mounts(spark.read.parquet(p["tape_mounts"]),
                                           spark.read.parquet(p["volume"]))
    hosted = W.read_host_volume(reads, fm, 900)
    want = W.read_waits(hosted, spark.read.parquet(p["tape_mounts"]), 86400)
    a = got.select("sfbr_id", "volume", "next_mount_id", "mount_wait")
    b = want.select("sfbr_id", "volume", "next_mount_id", "mount_wait")
    assert a.count() == reads.count()
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_cli_lists_jobs_and_parses_values(capsys):
    import pytest
    with pytest.raises(SystemExit):
        jobs.main([])
    assert "read_waits" in capsys.readouterr().out
    assert jobs._value("false") is False and jobs._value("900") == 900
    assert jobs._value('{"url": "u", "table": "t"}') == {"url": "u", "table": "t"}
    assert jobs._value("/data/x") == "/data/x"


def test_store_table_jobs(spark, tmp_dir):
    from mountwait.plans import waits as W
    p = _stage(spark, tmp_dir)
    out = lambda n: os.path.join(tmp_dir, "out", n)
    stores = spark.read.parquet(p["stores"])
    mounts = spark.read.parquet(p["tape_mounts"])
    fm = jobs.prepare.filtered_tape_mounts(mounts, spark.read.parquet(p["volume"]))

    jobs.storage_job(spark, p["stores"], p["tape_mounts"], p["volume"], out("storage"),
                     store_window=900, volume_window=900, wait_window=86400)
    want = W.storage_waits_all(stores, fm, mounts, 900, 900, 86400)
    cols = ["storageinfo_id", "volume", "updated", "volume_done", "wait_done",
            "next_mount_time", "next_mount_id", "mount_wait"]
    got = spark.read.parquet(out("storage")).select(*cols)
    assert got.count() == stores.count()
    assert got.exceptAll(want.select(*cols)).count() == 0

    jobs.store_waits_job(spark, p["stores"], p["tape_mounts"], p["volume"], out("store"),
                         window=900)
    sw = spark.read.parquet(out("store"))
    assert sw.count() == stores.count() and "mount_wait" in sw.columns

    jobs.read_host_volume_job(spark, p["reads"], p["tape_mounts"], p["volume"], out("hv"),
                              window=900)
    assert spark.read.parquet(out("hv")).count() == spark.read.parquet(p["reads"]).count()

    # incremental restore run equals a full run
    for t in ("rs_full", "rs_inc"):
        jobs.restore_job(spark, p["stores"], p["tape_mounts"], p["volume"], out(t),
                         volume_window=900, wait_window=86400)
    cols = ["storageinfo_id", "volume", "wait_done", "next_mount_time", "ds"]
    full = spark.read.parquet(out("rs_full")).select(*cols)
    days = sorted(r.ds for r in full.select("ds").distinct().collect())
    jobs.restore_job(spark, p["stores"], p["tape_mounts"], p["volume"], out("rs_inc"),
                     volume_window=900, wait_window=86400, since=str(days[len(days) // 2]))
    again = spark.read.parquet(out("rs_inc")).select(*cols)
    assert again.count() == full.count() and again.exceptAll(full).count() == 0


def test_raw_tables_to_waits(spark, tmp_dir):
    """The command line from the raw tables to read and store waits."""
    p = _stage(spark, tmp_dir)
    out = lambda n: os.path.join(tmp_dir, "flow", n)
    raw = os.path.join(tmp_dir, "storageinfo")
    spark.read.parquet(p["stores"]).drop("updated", "volume", "file_family").write.parquet(raw)
    jobs.main(["packaged_files", f"file_src={p['file']}", f"target={out('packaged')}"])
    jobs.main(["package_reads", f"billing_src={p['billinginfo']}", f"packaged_src={out('packaged')}",
               f"target={out('package_reads')}"])
    jobs.main(["small_file_reads", f"package_reads_src={out('package_reads')}",
               f"volume_src={p['volume']}", f"target={out('reads')}"])
    jobs.main(["small_file_stores", f"storage_src={raw}", f"packaged_src={out('packaged')}",
               f"volume_src={p['volume']}", f"target={out('stores')}"])
    jobs.main(["filtered_mounts", f"mounts_src={p['tape_mounts']}", f"volume_src={p['volume']}",
               f"target={out('mounts')}"])
    assert spark.read.parquet(out("mounts")).filter("writes > 0 is not true").count() == 0
    jobs.main(["reads", f"reads_src={out('reads')}", f"mounts_src={p['tape_mounts']}",
               f"volume_src={p['volume']}", f"target={out('read_waits')}"])
    n_reads = spark.read.parquet(out("reads")).count()
    assert spark.read.parquet(out("read_waits")).count() == n_reads > 0
    jobs.main(["storage", f"stores_src={out('stores')}", f"mounts_src={p['tape_mounts']}",
               f"volume_src={p['volume']}", f"target={out('storage_waits')}"])
    stores = spark.read.parquet(out("stores"))
    got = spark.read.parquet(out("storage_waits"))
    assert got.count() == stores.count() > 0
    assert got.filter("file_family is not null").count() == stores.filter("file_family is not null").count()


def test_jobs_leave_nothing_in_the_shared_folder(spark, tmp_dir):
    from mountwait.session import checkpoint_dir, scratch_tables
    root = checkpoint_dir(spark).removeprefix("file:")
    left = lambda: [d for d in os.listdir(root) if d.startswith("mountwait-job-")]
    before = left()
    with scratch_tables(spark) as stored:
        assert stored(spark.range(5)).count() == 5 and len(left()) == len(before) + 1
    assert left() == before
    p = _stage(spark, tmp_dir)
    jobs.restore_job(spark, p["stores"], p["tape_mounts"], p["volume"],
                     os.path.join(tmp_dir, "rs"), volume_window=900, wait_window=86400)
    assert left() == before


def _files(root):
    return {d: sorted(f for f in os.listdir(os.path.join(root, d)) if not f.startswith(("_", ".")))
            for d in os.listdir(root) if d.startswith("ds=")}


def test_late_mounts_equal_a_full_run(spark, tmp_dir):
    """Mounts that arrive late, one of them twice and one only now given a finish: the table equals a full run, and
    days without a touched read keep their files."""
    p = _stage(spark, tmp_dir)
    out = lambda n: os.path.join(tmp_dir, "late", n)
    mounts = spark.read.parquet(p["tape_mounts"])
    hour = F.expr("interval 1 hour")
    last = mounts.agg(F.max("start")).first()[0]
    late = mounts.filter(F.col("start") > F.lit(str(last)).cast("timestamp_ntz") - F.expr("interval 3 days"))
    late = late.filter("tapemount_id % 3 = 0")
    reopened = mounts.filter("finish is null").orderBy(F.desc("start")).limit(20)
    early = mounts.join(late, "tapemount_id", "left_anti").select(mounts.columns)
    finished = reopened.withColumn("finish", F.col("start") + hour)
    complete = (early.unionByName(late).join(reopened.select("tapemount_id"), "tapemount_id", "left_anti")
                .select(mounts.columns).unionByName(finished))
    for name, df in (("early", early), ("complete", complete), ("changed", late.unionByName(finished))):
        df.write.parquet(out(name))
    w = 6 * 3600
    jobs.read_waits_job(spark, p["reads"], out("early"), out("inc"), kind="all", window=w)
    before = _files(out("inc"))
    days = {f"ds={d}" for d in jobs.late_mounts_job(spark, out("changed"), out("complete"), out("inc"), window=w)}
    after = _files(out("inc"))
    assert days and {d for d in before if before[d] != after[d]} == days < set(before)
    jobs.read_waits_job(spark, p["reads"], out("complete"), out("full"), kind="all", window=w)
    cols = [c for c in spark.read.parquet(out("full")).columns]
    a, b = (spark.read.parquet(out(n)).select(*cols) for n in ("full", "inc"))
    assert a.count() == b.count() and a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0
    # nothing changed: nothing written
    spark.read.parquet(out("changed")).limit(0).write.parquet(out("none"))
    assert jobs.late_mounts_job(spark, out("none"), out("complete"), out("inc"), window=w) == []
    assert _files(out("inc")) == after


def test_update_partitions_rewrites_only_touched_days(spark, tmp_dir):
    import pytest
    from mountwait.operators.enrich import enrich, update_partitions
    path = os.path.join(tmp_dir, "table")
    base = spark.range(400).selectExpr("id", "'old' as v", "date_add(date'2024-01-01', cast(id % 8 as int)) as ds")
    jobs.write_snapshot(base, path, partition_by=["ds"])
    before = _files(path)
    new = spark.createDataFrame([(3, "n3"), (11, "n11"), (4, None), (9999, "no such row")], "id bigint, v string")
    done = update_partitions(spark, path, new, "id", "ds")
    assert sorted(map(str, done)) == ["2024-01-04", "2024-01-05"]
    after = _files(path)
    assert {d for d in before if before[d] != after[d]} == {"ds=2024-01-04", "ds=2024-01-05"}
    got = spark.read.parquet(path).select("id", "v", "ds")
    want = enrich(base, new, "id").select("id", "v", "ds")
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0 and got.count() == 400
    assert update_partitions(spark, path, new.where("id > 5000"), "id", "ds") == [] and _files(path) == after
    with pytest.raises(ValueError):
        update_partitions(spark, path, new.withColumn("unknown", F.lit(1)), "id", "ds")
    with pytest.raises(Exception, match="repeat"):
        update_partitions(spark, path, new.unionByName(new), "id", "ds")


def test_host_volume_jobs_count_bad_bfids(spark, tmp_dir):
    p = _stage(spark, tmp_dir)
    bad = os.path.join(tmp_dir, "bad_reads")
    reads = spark.read.parquet(p["reads"])
    reads.withColumn("bfid", F.expr("if(sfbr_id % 5 = 0, 'CDMS17', bfid)")).write.parquet(bad)
    want = spark.read.parquet(bad).where("bfid = 'CDMS17'").count()
    got = jobs.read_host_volume_job(spark, bad, p["tape_mounts"], p["volume"], os.path.join(tmp_dir, "hv"), window=900)
    assert got == {"rows": reads.count(), "bad_bfids": want} and want > 0
    assert jobs.reads_job(spark, bad, p["tape_mounts"], p["volume"], os.path.join(tmp_dir, "rd"), volume_window=900,
                          wait_window=86400) == got
    assert jobs.restore_job(spark, p["stores"], p["tape_mounts"], p["volume"], os.path.join(tmp_dir, "rs"),
                            volume_window=900, wait_window=86400)["bad_bfids"] == 0


def test_bucketed_files_spare_the_exchange(spark, tmp_dir):
    """Both joins on pnfsid read the stored files without an exchange of their side; rows as without buckets."""
    import re
    p = _stage(spark, tmp_dir)
    target = {"path": os.path.join(tmp_dir, "bucketed"), "by": "pnfsid", "buckets": 8}
    jobs.packaged_files_job(spark, p["file"], target)
    jobs.packaged_files_job(spark, p["file"], os.path.join(tmp_dir, "plain"))
    assert len([f for f in os.listdir(target["path"]) if f.endswith(".parquet")]) == 8
    packaged, plain = jobs.load(spark, target, "file"), jobs.load(spark, os.path.join(tmp_dir, "plain"), "file")
    assert packaged.exceptAll(plain).count() == plain.exceptAll(packaged).count() == 0
    billing, stores = spark.read.parquet(p["billinginfo"]), spark.read.parquet(p["stores"])
    volume = spark.read.parquet(p["volume"])
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for fn in (lambda f: jobs.prepare.package_reads(billing, f),
                   lambda f: jobs.prepare.small_file_stores(stores, f, volume.where("1 = 1"))):
            with_buckets, without = fn(packaged), fn(plain)
            count = lambda d: len(re.findall(r"Exchange hashpartitioning\(pnfsid",
                                             d._jdf.queryExecution().executedPlan().toString()))
            assert count(with_buckets) < count(without)
            assert with_buckets.exceptAll(without).count() == without.exceptAll(with_buckets).count() == 0
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    # the job entry takes the same spec, and a second write replaces the first
    jobs.packaged_files_job(spark, p["file"], target)
    jobs.package_reads_job(spark, p["billinginfo"], target, os.path.join(tmp_dir, "pr"))
    assert spark.read.parquet(os.path.join(tmp_dir, "pr")).count() == jobs.prepare.package_reads(billing, plain).count()
