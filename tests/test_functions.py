"""Scalar functions: calendar age vs DuckDB, BFID parsing, family keys."""

import datetime as dt
import random

import duckdb
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mountwait.functions.age import with_age
from mountwait.functions.bfid import bfid_epoch, bfid_site_ok, bfid_time
from mountwait.functions.family import family_key


def _duck_age(pairs):
    con = duckdb.connect()
    con.execute("create table p(i bigint, a timestamp, b timestamp)")
    con.executemany("insert into p values (?, ?, ?)", pairs)
    ag = "age(a, b)"
    rows = con.execute(f"""select i, (date_part('year', {ag}) * 12 + date_part('month', {ag}))::INTEGER,
        date_part('day', {ag})::INTEGER,
        date_part('hour', {ag})::BIGINT * 3600000000 + date_part('minute', {ag})::BIGINT * 60000000
        + date_part('microseconds', {ag})::BIGINT from p""").fetchall()
    return {r[0]: tuple(r[1:]) for r in rows}


def test_age_matches_duckdb_both_signs(spark):
    rnd = random.Random(7)
    base = dt.datetime(2020, 1, 1)
    pairs = []
    for i in range(3000):
        a = base + dt.timedelta(seconds=rnd.randrange(0, 4 * 365 * 86400), microseconds=rnd.randrange(10**6))
        b = base + dt.timedelta(seconds=rnd.randrange(0, 4 * 365 * 86400), microseconds=rnd.randrange(10**6))
        pairs.append((i, a, b))
    # month ends and leap days
    for j, (a, b) in enumerate([(dt.datetime(2024, 3, 1), dt.datetime(2024, 1, 31, 1)),
                                (dt.datetime(2023, 3, 1), dt.datetime(2023, 2, 28, 23)),
                                (dt.datetime(2024, 2, 29), dt.datetime(2023, 2, 28)),
                                (dt.datetime(2024, 1, 31), dt.datetime(2024, 3, 1))]):
        pairs.append((10_000 + j, a, b))
    schema = T.StructType([T.StructField("i", T.LongType()), T.StructField("a", T.TimestampNTZType()),
                           T.StructField("b", T.TimestampNTZType())])
    df = spark.createDataFrame(pairs, schema)
    got_step = {r[0]: tuple(r[1:]) for r in
                with_age(df, "a", "b", "x_").select("i", "x_months", "x_days", "x_us").collect()}
    want = _duck_age(pairs)
    assert got_step == want


def test_age_of_null_is_null(spark):
    df = spark.createDataFrame([(dt.datetime(2024, 1, 1), None)], "a timestamp_ntz, b timestamp_ntz")
    assert tuple(with_age(df, "a", "b").first())[2:] == (None, None, None)


def test_bfid_parse(spark):
    df = spark.createDataFrame([("CDMS1700000000123456",), ("XXXX1700000000123456",), ("CDMS123",),
                                ("CDMS17000x0000123",), ("CDMS-700000000123",), (None,)], "bfid string")
    got = [tuple(r) for r in df.select(bfid_site_ok("bfid"), bfid_epoch("bfid"), bfid_time("bfid")).collect()]
    assert got[0] == (True, 1700000000, dt.datetime(2023, 11, 14, 22, 13, 20))
    assert got[1][0] is False and got[1][1] == 1700000000
    assert got[2][1] is None                               # short: no partial parse
    assert got[3][1] is None and got[4][1] is None         # not all digits
    assert got[5] == (None, None, None)


def test_bad_bfids_are_counted_without_a_second_pass(spark):
    from mountwait.functions.bfid import bad_bfids, count_bad_bfids
    runs = spark.sparkContext.accumulator(0)
    rows = [("CDMS1700000000123456",), ("XXXX17x",), ("CDMS123",), ("CDMS17000x0000123",), (None,)]
    df = spark.sparkContext.parallelize(rows, 2).map(lambda r: (runs.add(1), r)[1]).toDF("bfid string")
    out, seen = count_bad_bfids(df)
    assert out.write.format("noop").mode("overwrite").save() is None
    assert seen.get == {"rows": 5, "bad_bfids": 2} and runs.value == 5
    assert bad_bfids(df).count() == 2


def test_family_key_and_collisions(spark):
    df = spark.createDataFrame([("a-b",), ("a/b",), ("a_b",), ("c",)], "ff string")
    keys = [r[0] for r in df.select(family_key("ff")).collect()]
    assert keys == ["volume_labels_ff_a_b"] * 3 + ["volume_labels_ff_c"]
    from mountwait.operators.aggregates import family_key_collisions
    vol = spark.createDataFrame([(1, "L1", "a-b"), (2, "L2", "a/b"), (3, "L3", "c"), (4, "L4", None)],
                                "id bigint, label string, file_family string")
    rows = family_key_collisions(vol).collect()
    assert [(r.family_key, r.n_families) for r in rows] == [("volume_labels_ff_a_b", 2)]
