"""Incremental copy in date slices, with resume."""

import datetime as dt
import os
import random

import pytest
from pyspark.sql import functions as F

from mountwait.plans import ingest
from mountwait.plans.ingest import completed_slices, copy_by_slices, pending_slices, slice_table


def _rows(spark):
    base = dt.datetime(2022, 9, 8, 12)
    data = [(i, base + dt.timedelta(hours=6 * i)) for i in range(24)]   # 2022-09-08 .. 2022-09-14
    return spark.createDataFrame(data, "id bigint, datestamp timestamp_ntz")


def test_slices_are_half_open_and_outside_rows_dropped(spark, tmp_dir):
    target = os.path.join(tmp_dir, "half")
    copy_by_slices(spark, _rows(spark), "datestamp", target, ["2022-09-09", "2022-09-11", "2022-09-12"])
    got = spark.read.parquet(target).groupBy("ds").count().collect()
    assert sorted((str(r.ds), r["count"]) for r in got) == [("2022-09-09", 4), ("2022-09-10", 4), ("2022-09-11", 4)]


def test_interval_difference(spark):
    sl = lambda *ds: slice_table(spark, ds)
    left = lambda w, d: sorted((str(r[0])[5:], str(r[1])[5:]) for r in pending_slices(w, d).collect())
    wanted = sl("2024-01-01", "2024-01-10", "2024-01-20")
    assert left(wanted, sl()) == [("01-01", "01-10"), ("01-10", "01-20")]
    assert left(wanted, wanted) == []
    assert left(wanted, sl("2024-01-04", "2024-01-12")) == [("01-01", "01-04"), ("01-12", "01-20")]
    holes = sl("2024-01-03", "2024-01-04").unionByName(sl("2024-01-06", "2024-01-07")).unionByName(sl("2023-01-01", "2024-01-02"))
    assert left(wanted, holes) == [("01-02", "01-03"), ("01-04", "01-06"), ("01-07", "01-10"), ("01-10", "01-20")]


def test_copy_resumes_without_duplicates(spark, tmp_dir):
    df = _rows(spark)
    target = os.path.join(tmp_dir, "billing")
    first = copy_by_slices(spark, df, "datestamp", target, ["2022-09-09", "2022-09-10", "2022-09-11"])
    assert first.count() == 2
    again = copy_by_slices(spark, df, "datestamp", target, ["2022-09-09", "2022-09-10", "2022-09-11"])
    assert again.count() == 0
    more = copy_by_slices(spark, df, "datestamp", target,
                          ["2022-09-09", "2022-09-10", "2022-09-11", "2022-09-13"])
    assert more.count() == 1
    out = spark.read.parquet(target)
    assert out.count() == 16 and out.select("id").distinct().count() == 16
    assert completed_slices(spark, target).count() == 3
    assert out.filter(F.col("ds") == "2022-09-11").count() == 4


def test_copy_by_dates_job_reads_the_date_list(spark, tmp_dir):
    from mountwait.plans import jobs
    src = os.path.join(tmp_dir, "billing")
    rows = [(i, f"P{i}", dt.datetime(2022, 9, 8, 12) + dt.timedelta(hours=12 * i)) for i in range(10)]
    spark.createDataFrame(rows, "billinginfo_id bigint, pnfsid string, datestamp timestamp_ntz") \
        .write.parquet(src)
    dates = os.path.join(tmp_dir, "dates.txt")
    with open(dates, "w") as fh:
        fh.write("2022-09-10\n2022-09-12\n\n")
    target = os.path.join(tmp_dir, "copy")
    copied = jobs.copy_by_dates_job(spark, src, target, dates)   # first slice starts 2022-09-09
    assert sorted(str(r.slice_start) for r in copied.collect()) == ["2022-09-09", "2022-09-10"]
    out = spark.read.parquet(target)
    assert out.count() == 6      # 09-09 00:00 .. 09-11 12:00; 09-08 and from 09-12 are outside
    assert jobs.copy_by_dates_job(spark, src, target, dates).count() == 0   # resume: nothing left


@pytest.mark.parametrize("seed", range(3))
def test_any_sequence_of_lists_leaves_every_row_once(spark, tmp_dir, seed):
    """Overlapping, nested, merged and split lists in any order, one run failing before its manifest entry."""
    rnd = random.Random(seed)
    first = dt.date(2024, 1, 1)
    src = spark.createDataFrame([(i, dt.datetime(2024, 1, 1) + dt.timedelta(hours=7 * i)) for i in range(140)],
                                "id int, ts timestamp_ntz")
    target, days = f"{tmp_dir}/any", set()
    for n in range(4):
        offs = sorted(rnd.sample(range(0, 42), rnd.randrange(2, 6)))
        bounds = [first + dt.timedelta(days=o) for o in offs]
        days |= {first + dt.timedelta(days=o) for o in range(offs[0], offs[-1])}
        if n == 1:  # data written, manifest not: as after a crash
            real, ingest.MANIFEST = ingest.MANIFEST, "_lost"
            copy_by_slices(spark, src, "ts", target, bounds)
            ingest.MANIFEST = real
        copy_by_slices(spark, src, "ts", target, bounds)
    got = [r.id for r in spark.read.parquet(target).select("id").collect()]
    want = [r.id for r in src.collect() if r.ts.date() in days]
    assert sorted(got) == sorted(want)
    assert copy_by_slices(spark, src, "ts", target, bounds).count() == 0
