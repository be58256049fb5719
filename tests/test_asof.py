"""Bounded as-of join: edge cases and a brute-force property test."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mountwait.operators.asof import next_within, prev_within

T0 = dt.datetime(2024, 1, 10, 12, 0, 0)
DAY = dt.timedelta(days=1)

R_SCHEMA = T.StructType([T.StructField("rid", T.LongType()), T.StructField("k", T.StringType()),
                         T.StructField("t", T.TimestampNTZType())])
M_SCHEMA = T.StructType([T.StructField("mid", T.LongType()), T.StructField("mk", T.StringType()),
                         T.StructField("mt", T.TimestampNTZType()),
                         T.StructField("finish", T.TimestampNTZType())])


def run(spark, reqs, mounts, window=DAY, direction="forward", target=None):
    r = spark.createDataFrame(reqs, R_SCHEMA)
    m = spark.createDataFrame(mounts, M_SCHEMA)
    fn = next_within if direction == "forward" else prev_within
    out = fn(r, m, left_by="k", right_by="mk", left_time="t", right_time="mt", window=window,
             tie="mid", carry=["finish"], target_cell_rows=target)
    return {row.rid: (row.match.mid if row.match else None)
            for row in out.select("rid", "match").collect()}


def test_equal_time_is_not_a_match(spark):
    assert run(spark, [(1, "a", T0)], [(10, "a", T0, None)]) == {1: None}
    assert run(spark, [(1, "a", T0)], [(10, "a", T0, None)], direction="backward") == {1: None}


def test_far_end_is_strict(spark):
    assert run(spark, [(1, "a", T0)], [(10, "a", T0 + DAY, None)]) == {1: None}
    assert run(spark, [(1, "a", T0)], [(10, "a", T0 + DAY - dt.timedelta(microseconds=1), None)]) == {1: 10}
    assert run(spark, [(1, "a", T0)], [(10, "a", T0 - DAY, None)], direction="backward") == {1: None}


def test_ties_smallest_id_wins_both_directions(spark):
    ms = [(12, "a", T0 + dt.timedelta(hours=1), None), (11, "a", T0 + dt.timedelta(hours=1), None),
          (13, "a", T0 - dt.timedelta(hours=1), None), (9, "a", T0 - dt.timedelta(hours=1), None)]
    assert run(spark, [(1, "a", T0)], ms) == {1: 11}
    assert run(spark, [(1, "a", T0)], ms, direction="backward") == {1: 9}


def test_null_keys_never_match(spark):
    out = run(spark, [(1, None, T0), (2, "a", None)], [(10, None, T0 + dt.timedelta(hours=1), None)])
    assert out == {1: None, 2: None}


def test_match_in_a_far_cell(spark):
    # one row a cell: the mount is many cells away but inside the window
    for way, sign in (("forward", 1), ("backward", -1)):
        reqs = [(i, "a", T0 + sign * dt.timedelta(minutes=i)) for i in range(60)]
        out = run(spark, reqs, [(10, "a", T0 + sign * dt.timedelta(hours=20), None)], target=1, direction=way)
        assert out == {i: 10 for i in range(60)}


def test_every_left_row_kept_once(spark):
    reqs = [(i, "a", T0) for i in range(5)] + [(9, "b", T0)]
    out = run(spark, reqs, [(10, "a", T0 + dt.timedelta(minutes=5), None)])
    assert out == {0: 10, 1: 10, 2: 10, 3: 10, 4: 10, 9: None}


def test_eligible_rows_only(spark):
    r = spark.createDataFrame([(1, "a", T0), (2, "a", T0)], R_SCHEMA)
    m = spark.createDataFrame([(10, "a", T0 + dt.timedelta(minutes=5), None)], M_SCHEMA)
    out = next_within(r, m, left_by="k", right_by="mk", left_time="t", right_time="mt",
                      window=DAY, tie="mid", eligible=F.col("rid") == 1)
    got = {row.rid: row.match for row in out.collect()}
    assert got[1].mid == 10 and got[2] is None


def brute(reqs, mounts, window, direction):
    out = {}
    for rid, k, t in reqs:
        best = None
        for mid, mk, mt, _ in mounts:
            if k is None or mk is None or t is None or mt is None or mk != k:
                continue
            ok = (t < mt < t + window) if direction == "forward" else (t - window < mt < t)
            if not ok:
                continue
            key = (mt, mid) if direction == "forward" else (-mt.timestamp(), mid)
            if best is None or key < best[0]:
                best = (key, mid)
        out[rid] = best[1] if best else None
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
@pytest.mark.parametrize("direction", ["forward", "backward"])
def test_matches_brute_force(spark, seed, direction):
    rnd = random.Random(seed)
    keys = ["a", "b", "c", None]

    def ts():
        return T0 + dt.timedelta(minutes=rnd.randrange(0, 6 * 24 * 60, 30))

    reqs = [(i, rnd.choice(keys), ts()) for i in range(150)]
    mounts = [(1000 + i, rnd.choice(keys), ts(), None) for i in range(80)]
    window = dt.timedelta(hours=rnd.choice([3, 12, 30]))
    target = rnd.choice([None, 1, 7, 40])
    assert run(spark, reqs, mounts, window, direction, target) == \
        brute(reqs, mounts, window, direction)


@pytest.mark.parametrize("direction", ["forward", "backward"])
def test_hot_key_and_hot_instant(spark, direction):
    """One key holds most rows, many of them at one instant; results equal
    the brute force and every request row comes back once."""
    rnd = random.Random(11)
    hot_t = T0 + dt.timedelta(hours=30)
    reqs = [(i, "hot", hot_t) for i in range(400)]
    reqs += [(1000 + i, "hot", T0 + dt.timedelta(minutes=rnd.randrange(0, 5 * 24 * 60)))
             for i in range(300)]
    reqs += [(2000 + i, "cold", T0 + dt.timedelta(minutes=rnd.randrange(0, 5 * 24 * 60)))
             for i in range(50)]
    mounts = [(5000 + i, rnd.choice(["hot", "hot", "cold"]),
               T0 + dt.timedelta(minutes=rnd.randrange(0, 5 * 24 * 60, 15)), None) for i in range(120)]
    mounts += [(9000, "hot", hot_t, None), (9001, "hot", hot_t, None)]   # equal to the hot instant
    window = dt.timedelta(hours=10)
    got = run(spark, reqs, mounts, window, direction,
              target=20)
    assert len(got) == len(reqs)
    assert got == brute(reqs, mounts, window, direction)


def test_result_independent_of_shuffle_partitions(spark):
    rnd = random.Random(5)
    reqs = [(i, rnd.choice("abc"), T0 + dt.timedelta(minutes=rnd.randrange(0, 3 * 24 * 60, 10)))
            for i in range(200)]
    mounts = [(1000 + i, rnd.choice("abc"), T0 + dt.timedelta(minutes=rnd.randrange(0, 3 * 24 * 60, 10)),
               None) for i in range(100)]
    old = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        results = []
        for n in ("1", "13"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            results.append(run(spark, reqs, mounts, dt.timedelta(hours=8), "forward",
                               30))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert results[0] == results[1] == brute(reqs, mounts, dt.timedelta(hours=8), "forward")


def test_asof_lookups_with_repeated_ids(spark):
    """A repeated id, also with a null key, gives one row out per row in, each with its own match."""
    from mountwait.operators.asof import asof_lookups
    rows = [(1, "a", T0), (1, "a", T0), (1, "a", T0 + DAY), (1, "b", T0), (1, None, T0), (None, "a", T0)]
    r = spark.createDataFrame(rows, R_SCHEMA)
    m = spark.createDataFrame([(10, "a", T0 + dt.timedelta(hours=1), None), (11, "b", T0 + dt.timedelta(hours=2), None)],
                              M_SCHEMA)
    look = [dict(left_by="k", left_time="t", window=DAY, match="m1"),
            dict(left_by="k", left_time="t", window=DAY, match="m2", eligible=F.col("rid").isNotNull())]
    out = asof_lookups(r, m, right_by="mk", right_time="mt", lookups=look, tie="mid").collect()
    got = sorted(str((x.rid, x.k, x.t, x.m1 and x.m1.mid, x.m2 and x.m2.mid)) for x in out)
    assert got == sorted(map(str, [(1, "a", T0, 10, 10)] * 2 + [(1, "a", T0 + DAY, None, None), (1, "b", T0, 11, 11),
                                   (1, None, T0, None, None), (None, "a", T0, 10, None)]))


def test_missing_column_is_reported(spark):
    r = spark.createDataFrame([(1, "a", T0)], R_SCHEMA)
    m = spark.createDataFrame([(10, "a", T0, None)], M_SCHEMA)
    with pytest.raises(ValueError, match="right side lacks"):
        next_within(r, m, left_by="k", right_by="nope", left_time="t", right_time="mt", window=DAY)


@pytest.mark.parametrize("direction", ["forward", "backward"])
@pytest.mark.parametrize("target", [2, 50, 1_000_000])
def test_cells_of_any_size_match_brute_force(spark, direction, target):
    """Tiny targets cut the hot key into many cells; the answer must not change."""
    rnd = random.Random(23)
    hot_t = T0 + dt.timedelta(hours=30)
    reqs = [(i, "hot", hot_t) for i in range(50)]
    reqs += [(100 + i, "hot", T0 + dt.timedelta(seconds=rnd.randrange(0, 2 * 86400)))
             for i in range(200)]
    reqs += [(500 + i, rnd.choice(["cold", None]), T0 + dt.timedelta(minutes=rnd.randrange(0, 2880)))
             for i in range(40)]
    mounts = [(5000 + i, rnd.choice(["hot", "cold", "none"]),
               T0 + dt.timedelta(seconds=rnd.randrange(0, 2 * 86400, 60)), None) for i in range(150)]
    mounts += [(9000, "hot", hot_t, None), (9001, "hot", hot_t + dt.timedelta(seconds=1), None)]
    window = dt.timedelta(hours=6)
    r = spark.createDataFrame(reqs, R_SCHEMA)
    m = spark.createDataFrame(mounts, M_SCHEMA)
    fn = next_within if direction == "forward" else prev_within
    out = fn(r, m, left_by="k", right_by="mk", left_time="t", right_time="mt", window=window,
             tie="mid", target_cell_rows=target)
    got = {row.rid: (row.match.mid if row.match else None) for row in out.select("rid", "match").collect()}
    assert got == brute(reqs, mounts, window, direction)


def test_equal_times_without_tie_are_deterministic(spark):
    """No tie column: equal mount times resolve to the smallest carried
    values, both inside a cell and across cells."""
    r = spark.createDataFrame([(1, "a", T0), (2, "a", T0 - dt.timedelta(hours=5))], R_SCHEMA)
    m = spark.createDataFrame([(12, "a", T0 + dt.timedelta(minutes=5), None),
                               (11, "a", T0 + dt.timedelta(minutes=5), None)], M_SCHEMA)
    out = next_within(r, m, left_by="k", right_by="mk", left_time="t", right_time="mt",
                      window=DAY, carry=["mid"], target_cell_rows=1)
    got = {row.rid: row.match.mid for row in out.collect()}
    assert got == {1: 11, 2: 11}


def test_auto_target_from_session_conf(spark):
    rnd = random.Random(31)
    reqs = [(i, "hot", T0 + dt.timedelta(seconds=rnd.randrange(0, 86400))) for i in range(120)]
    mounts = [(5000 + i, "hot", T0 + dt.timedelta(seconds=rnd.randrange(0, 86400, 30)), None)
              for i in range(60)]
    window = dt.timedelta(hours=3)
    spark.conf.set("mountwait.asof.targetCellRows", "2")
    try:
        got = run(spark, reqs, mounts, window, "forward")
    finally:
        spark.conf.unset("mountwait.asof.targetCellRows")
    assert got == brute(reqs, mounts, window, "forward")


def test_cuts_follow_density(spark):
    """A key with a burst of 20,000 rows in 30 seconds and 1,000 rows over a year is cut inside the burst; an
    instant of 5,000 rows takes several cells; small keys have no cuts."""
    from mountwait.operators import asof
    rows = [("hot", i * 1500, 1) for i in range(20_000)] + [("hot", i * 31_536_000_000, 1) for i in range(1_000)]
    rows += [("hot", 15_000_000, 1)] * 5_000 + [("cold", i, 1) for i in range(500)]
    points = spark.createDataFrame(rows, f"{asof._K} string, {asof._S} long, {asof._N} int")
    cuts = {r[0]: r[1] for r in asof.hot_cuts(points, 500).collect()}
    assert set(cuts) == {"hot"}
    at = sorted(cuts["hot"])
    assert at == list(cuts["hot"]) and 40 <= len(at) <= 55
    assert sum(c <= 30_000_000 for c in at) >= 45
    assert at.count(15_000_000) >= 8
    cells = [0] * (len(at) + 1)
    for k, t, _ in rows:
        if k == "hot" and t != 15_000_000:
            cells[sum(c < t for c in at)] += 1
    assert max(cells) <= 2 * 500


@pytest.mark.parametrize("direction", ["forward", "backward"])
def test_hot_instant_over_many_cells(spark, direction):
    """Requests and mounts at one instant that spans many cells: strict ends and ties as ever."""
    hot_t = T0 + dt.timedelta(hours=5)
    reqs = [(i, "a", hot_t) for i in range(300)] + [(400 + i, "a", T0 + dt.timedelta(minutes=7 * i)) for i in range(100)]
    mounts = [(5000 - i, "a", hot_t, None) for i in range(300)]
    mounts += [(6000 + i, "a", T0 + dt.timedelta(minutes=20 * i + 1), None) for i in range(40)]
    window = dt.timedelta(hours=9)
    for target in (1, 10, 100):
        assert run(spark, reqs, mounts, window, direction, target) == brute(reqs, mounts, window, direction)


def test_both_directions_in_one_pass(spark):
    from mountwait.operators.asof import asof_lookups
    rnd = random.Random(7)
    ts = lambda: T0 + dt.timedelta(minutes=rnd.randrange(0, 600, 5))
    reqs = [(i, rnd.choice(["a", "a", "a", "b", None]), ts()) for i in range(200)]
    mounts = [(1000 + i, rnd.choice("aab"), ts(), None) for i in range(100)]
    r, m = spark.createDataFrame(reqs, R_SCHEMA), spark.createDataFrame(mounts, M_SCHEMA)
    h = dt.timedelta(hours=1)
    out = asof_lookups(r, m, right_by="mk", right_time="mt", tie="mid", target_cell_rows=7, lookups=[
        dict(left_by="k", left_time="t", window=3 * h, match="n"), dict(left_by="k", left_time="t", window=h, match="n1"),
        dict(left_by="k", left_time="t", window=2 * h, direction="backward", match="p")]).collect()
    got = [{x.rid: x[c].mid if x[c] else None for x in out} for c in ("n", "n1", "p")]
    assert got == [brute(reqs, mounts, 3 * h, "forward"), brute(reqs, mounts, h, "forward"),
                   brute(reqs, mounts, 2 * h, "backward")]


def test_right_rows_of_one_instant_are_one_row_in_the_window(spark):
    r = spark.createDataFrame([(1, "a", T0)], R_SCHEMA)
    m = spark.range(20_000).selectExpr("id as mid", "'a' as mk", "timestamp_ntz'2024-01-10 13:00:00' as mt",
                                       "cast(null as timestamp_ntz) as finish")
    from mountwait.operators import asof
    rows = asof._right_rows(m, "mk", "mt", "mid", ["finish"], r.schema["k"].dataType)
    assert [(x[0], x[2].mid) for x in rows.collect()] == [("a", 0)]
    out = next_within(r, m, left_by="k", right_by="mk", left_time="t", right_time="mt", window=DAY, tie="mid")
    assert out.first().match.mid == 0
