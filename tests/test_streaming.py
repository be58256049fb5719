"""Incremental stream copy resumes without duplicates."""

import datetime as dt
import os

from mountwait.contracts import BILLINGINFO
from mountwait.streaming import copy_new_files


def test_stream_copy_resumes(spark, tmp_dir):
    src, target, ckpt = (os.path.join(tmp_dir, x) for x in ("src", "dst", "ckpt"))
    t0 = dt.datetime(2022, 9, 9, 1)

    def drop(batch, n):
        rows = [(batch * 1000 + i, f"P{i}", t0 + dt.timedelta(hours=7 * i)) for i in range(n)]
        spark.createDataFrame(rows, BILLINGINFO).write.mode("append").parquet(src)

    drop(1, 10)
    copy_new_files(spark, src, BILLINGINFO, target, checkpoint=ckpt)
    assert spark.read.parquet(target).count() == 10
    drop(2, 5)
    copy_new_files(spark, src, BILLINGINFO, target, checkpoint=ckpt)
    out = spark.read.parquet(target)
    assert out.count() == 15 and out.select("billinginfo_id").distinct().count() == 15
    assert out.select("ds").distinct().count() == 3


def test_stream_copy_writes_one_file_per_day_per_batch(spark, tmp_dir):
    src, target, ckpt = (os.path.join(tmp_dir, x) for x in ("src", "dst", "ckpt"))
    t0 = dt.datetime(2022, 9, 9, 1)
    rows = [(i, f"P{i}", t0 + dt.timedelta(hours=7 * i)) for i in range(40)]
    spark.createDataFrame(rows, BILLINGINFO).repartition(8).write.parquet(src)
    copy_new_files(spark, src, BILLINGINFO, target, checkpoint=ckpt)
    days = [d for d in os.listdir(target) if d.startswith("ds=")]
    files = [f for d in days for f in os.listdir(os.path.join(target, d)) if f.endswith(".parquet")]
    assert len(files) == len(days)
    assert spark.read.parquet(target).count() == 40
