"""Physical plan properties that matter at scale."""

import os
import re

from mountwait.plans import suite

from conftest import SF001, SF01

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_asof_plan_has_no_pairs_and_no_single_partition(spark):
    plan = _plan(suite.read_waits(spark, SF001))
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "SinglePartition",
                "BatchEvalPython", "ArrowEvalPython"):
        assert bad not in plan, bad


def test_scans_are_pushed_and_pruned(spark):
    plan = _plan(suite.read_waits(spark, SF001))
    assert "PushedFilters: [IsNotNull(event_type), EqualTo(event_type,view)" in plan
    assert "ReadSchema: struct<event_id:bigint,ts:timestamp_ntz,user_id:bigint,event_type:string>" in plan
    assert "props" not in plan and "value" not in plan.replace("Values", "")


def test_no_python_in_any_registered_query(spark):
    for name, fn in suite.SUITE.items():
        plan = _plan(fn(spark, SF001))
        assert "EvalPython" not in plan and "PythonUDF" not in plan, name
        assert "CartesianProduct" not in plan, name


def test_asof_plan_has_one_shape_and_starts_no_job(spark):
    """One window over the rows, whatever the sizes; no job while planning, no join back."""
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("asof-plan", "planning")
    plans = [_plan(fn(spark, SF001)) for fn in (suite.asof_next_split, suite.asof_next, suite.read_waits)]
    jobs = tracker.getJobIdsForGroup("asof-plan")
    spark.sparkContext.setJobGroup("other", "other")
    assert not jobs
    for plan in plans:
        assert len(re.findall(r"Window \[last\(forward", plan)) == 1
        assert "SortMergeJoin" not in plan and "ShuffledHashJoin" not in plan
        for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "SinglePartition"):
            assert bad not in plan, bad


def _scans_and_task_rows(spark, query):
    """(Rows read from files, rows of each reduce task of the widest stage) of one run, by Spark's event log."""
    import glob
    import json
    import subprocess
    import sys
    import tempfile
    log = tempfile.mkdtemp(prefix="mountwait-log-")
    code = (f"import sys; sys.path.insert(0, {ROOT!r})\n"
            "from mountwait.session import build_session\nfrom mountwait.plans import suite\n"
            "s = build_session('local[4]', 8, extra={'spark.eventLog.enabled': 'true', 'spark.eventLog.compress': 'false',"
            f"'spark.eventLog.dir': 'file://{log}', 'spark.local.dir': {log!r}, 'spark.checkpoint.dir': '{log}/ckpt'"
            "})\ns.conf.set('spark.sql.adaptive.coalescePartitions.enabled', 'false')\n"
            f"suite.{query}(s, {SF01!r}).write.format('noop').mode('overwrite').save()\ns.stop()\n")
    subprocess.run([sys.executable, "-c", code], check=True, capture_output=True, timeout=300)
    scanned, stages = 0, {}
    for path in glob.glob(f"{log}/**/events*", recursive=True):
        for line in open(path):
            e = json.loads(line)
            if e["Event"] == "SparkListenerTaskEnd" and e.get("Task Metrics"):
                m = e["Task Metrics"]
                scanned += m["Input Metrics"]["Records Read"]
                stages.setdefault(e["Stage ID"], []).append(m["Shuffle Read Metrics"]["Total Records Read"])
    return scanned, max(stages.values(), key=sum)


def test_a_burst_is_split(spark):
    """Half of both tables on one key within 30 seconds, a tenth on one instant: no task of the window gets
    more than a fair share and some."""
    _, rows = _scans_and_task_rows(spark, "asof_next_burst")
    assert sum(rows) >= 60_000 and len(rows) == 8
    assert max(rows) < 2 * sum(rows) / len(rows)


def test_lookups_scan_little(spark):
    """events holds 10,000 rows: reads twice (keys and times alone, then whole) and mounts once per key column."""
    assert _scans_and_task_rows(spark, "read_waits")[0] <= 3 * 10_000
    assert _scans_and_task_rows(spark, "read_waits_all")[0] <= 5 * 10_000
    assert _scans_and_task_rows(spark, "enrich_update")[0] <= 6 * 10_000


def test_date_copy_prunes_the_scan(spark):
    """Both bounds of each run of pending slices reach the scan."""
    import datetime as dt

    from mountwait.plans import ingest
    src = spark.read.parquet(f"{SF001}/events.parquet")
    d = [dt.date(2024, 1, n) for n in (1, 2, 3, 9, 10)]
    plan = _plan(ingest.in_slices(src, "ts", [(d[0], d[1]), (d[1], d[2]), (d[3], d[4])]))
    assert ("PushedFilters: [Or(And(GreaterThanOrEqual(ts,2024-01-01T00:00),LessThan(ts,2024-01-03T00:00)),"
            "And(GreaterThanOrE") in plan


def test_combined_lookups_shuffle_the_rows_once_per_key(spark):
    """read_waits_all: next and previous mount of the migrated tape share one exchange and are not joined back."""
    plan = _plan(suite.read_waits_all(spark, SF001))
    rows = re.findall(r"Exchange hashpartitioning\(_aj_k#\d+, _aj_c#\d+, \d+\)", plan)
    assert len(rows) == 2
    assert "SortMergeJoin" not in plan
