"""JDBC source/sink on in-memory Derby (embedded, no network port), shards,
Parquet contracts."""

import uuid

import pytest
from pyspark.sql import functions as F

from mountwait.contracts import ContractError, conform, VOLUME
from mountwait.sources.jdbc import read_jdbc, read_jdbc_query
from mountwait.sources.shards import id_shard, with_depth_shards, with_shards
from mountwait.sources.sinks import append_table

DRIVER = {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}


@pytest.fixture()
def derby_url():
    return f"jdbc:derby:memory:mw{uuid.uuid4().hex[:8]};create=true"


def test_jdbc_append_and_scans(spark, derby_url):
    df = spark.range(0, 1000).select(F.col("id").cast("long").alias("ID"),
                                     (F.col("id") % 7).cast("int").alias("FAM"))
    append_table(df, "VOL", jdbc_url=derby_url, properties=DRIVER)
    assert read_jdbc(spark, derby_url, "VOL", properties=DRIVER).count() == 1000
    append_table(df, "VOL", jdbc_url=derby_url, properties=DRIVER)   # appending twice doubles
    whole = read_jdbc(spark, derby_url, "VOL", properties=DRIVER)
    assert whole.count() == 2000
    # bounds narrower than the data are strides, not filters: every row is read
    part = read_jdbc(spark, derby_url, "VOL", column="ID", num_partitions=4, lower=100, upper=200,
                     properties=DRIVER)
    assert part.rdd.getNumPartitions() == 4 and part.count() == 2000
    # default bounds come from the table itself
    auto = read_jdbc(spark, derby_url, "VOL", column="ID", num_partitions=4, properties=DRIVER)
    sizes = auto.rdd.glom().map(len).collect()
    assert sum(sizes) == 2000 and max(sizes) == 500
    # derived table computed by the database
    q = read_jdbc_query(spark, derby_url, "select FAM, min(ID) as MIN_ID from VOL group by FAM",
                        properties=DRIVER)
    assert sorted((r.FAM, r.MIN_ID) for r in q.collect()) == [(i, i) for i in range(7)]
    # filters on a JDBC scan are pushed to the database
    plan = whole.filter(F.col("FAM") == 3)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "FAM" in plan


def test_shards_cover_every_id(spark):
    df = spark.range(0, 1001).withColumnRenamed("id", "k")
    s = with_shards(df, "k", 10)
    counts = {r.shard: r.n for r in s.groupBy("shard").agg(F.count("*").alias("n")).collect()}
    assert sum(counts.values()) == 1001 and set(counts) == set(range(10))
    assert df.select(id_shard("k", 3, 1000).alias("s")).agg(F.max("s")).first()[0] == 2


def test_depth_shards_of_skewed_ids(spark):
    """Nine tenths of the ids in a thousandth of the range: equal strides put them in one shard, equal depth does not."""
    df = spark.range(0, 20_000).selectExpr("if(id % 10 < 9, id, id * 1000) as k").repartition(5)
    sizes = lambda s: {r.shard: r["count"] for r in s.groupBy("shard").count().collect()}
    assert max(sizes(with_shards(df, "k", 10)).values()) > 15_000
    got = with_depth_shards(df, "k", 10)
    assert sizes(got).keys() == set(range(10)) and all(abs(n - 2_000) <= 200 for n in sizes(got).values())
    ends = sorted((r.shard, r.lo, r.hi) for r in got.groupBy("shard").agg(F.min("k").alias("lo"), F.max("k").alias("hi")).collect())
    assert all(a[2] < b[1] for a, b in zip(ends, ends[1:]))
    # one id with most rows stays in one shard; null ids, few ids, one shard and no rows
    same = spark.createDataFrame([(5,)] * 90 + [(None,)] + [(i,) for i in range(9)], "k long")
    assert sum(sizes(with_depth_shards(same, "k", 4)).values()) == 100
    assert with_depth_shards(same, "k", 4).where("k = 5").select("shard").distinct().count() == 1
    assert sizes(with_depth_shards(same, "k", 1)) == {0: 100}
    assert sizes(with_depth_shards(same.where("k > 99"), "k", 3)) == {}


def test_jdbc_equal_depth_partitions(spark, derby_url):
    skewed = spark.range(0, 4000).selectExpr("if(id % 10 < 9, id, id * 1000) as ID", "cast(id % 7 as int) as FAM")
    append_table(skewed, "SK", jdbc_url=derby_url, properties=DRIVER)
    sizes = lambda **k: read_jdbc(spark, derby_url, "SK", column="ID", num_partitions=8, properties=DRIVER,
                                  **k).rdd.glom().map(len).collect()
    assert max(sizes()) > 3_000
    got = sizes(equal_depth=True)
    assert len(got) == 8 and sum(got) == 4000 and all(abs(n - 500) <= 50 for n in got)


def test_contract(spark):
    ok = spark.createDataFrame([(1, "L", "f", 5)], "id int, label string, file_family string, x int")
    out = conform(ok, VOLUME)
    assert out.schema["id"].dataType.simpleString() == "bigint" and "x" in out.columns
    with pytest.raises(ContractError):
        conform(ok.drop("label"), VOLUME)


def test_jobs_over_jdbc(spark, derby_url):
    """The reference's flow on a database: scan, filter, join, append."""
    from mountwait.plans import jobs
    from mountwait.sources import testdata as td
    from conftest import SF001
    # Derby cannot group CLOB columns (Spark's default for strings there): declare VARCHAR
    varchar = lambda *cols: dict(DRIVER, createTableColumnTypes=", ".join(
        f"{c} VARCHAR(64)" for c in cols))
    append_table(td.file(spark, SF001), "MW_FILE", jdbc_url=derby_url,
                 properties=varchar("original_library"))
    append_table(td.billinginfo(spark, SF001), "MW_BILLING", jdbc_url=derby_url, properties=DRIVER)
    src = lambda t, col=None: {"url": derby_url, "table": t, "column": col,
                               "partitions": 4 if col else None, "properties": DRIVER}
    job = jobs.library_counts_job(spark, src("MW_FILE", "id"))
    assert "group by" in job._jdf.queryExecution().executedPlan().toString().lower()  # pushed
    counts = {r.original_library: r.n_files for r in job.collect()}
    assert counts == {r.original_library: r.n_files for r in
                      jobs.library_counts(td.file(spark, SF001)).collect()}
    jobs.packaged_files_job(spark, src("MW_FILE", "id"), src("MW_PACKAGED"))
    jobs.package_reads_job(spark, src("MW_BILLING", "billinginfo_id"), src("MW_PACKAGED"),
                           src("MW_READS"))
    # Derby binds string nulls as CLOB, which a VARCHAR column refuses: named families only
    named = td.volume(spark, SF001).filter("file_family is not null")
    append_table(named, "MW_VOLUME", jdbc_url=derby_url, properties=varchar("file_family"))
    import tempfile, os
    labels_dir = os.path.join(tempfile.mkdtemp(prefix="mw-labels-"), "labels")
    mins = {r.file_family: r.min_id for r in
            jobs.family_tables_job(spark, src("MW_VOLUME"), labels_dir).collect()}
    assert mins == {r.file_family: r.min_id for r in jobs.family_min_id(named).collect()}
    got = read_jdbc(spark, derby_url, "MW_READS", properties=DRIVER).count()
    want = jobs.prepare.package_reads(td.billinginfo(spark, SF001),
                                      jobs.prepare.packaged_files(td.file(spark, SF001))).count()
    assert got == want > 0


def test_wait_jobs_over_jdbc(spark, derby_url):
    """Waits written to a database: flat columns, appended; zone-less times."""
    from pyspark.sql.types import TimestampNTZType

    from mountwait.plans import jobs, waits
    from mountwait.sources import testdata as td
    from conftest import SF001
    mounts, reads = td.tape_mounts(spark, SF001), td.reads(spark, SF001)
    append_table(mounts, "MW_MOUNTS", jdbc_url=derby_url, properties=DRIVER)
    append_table(reads, "MW_SMALL", jdbc_url=derby_url, properties=DRIVER)
    spec = lambda t, **more: {"url": derby_url, "table": t, "properties": DRIVER, **more}
    by_id = spec("MW_SMALL", column="sfbr_id", partitions=3, lower=0, upper=500, fetch_size=100)
    loaded = jobs.load(spark, by_id, "small_file_billinginfo_reads")
    assert loaded.rdd.getNumPartitions() == 3
    raw = read_jdbc(spark, derby_url, "MW_SMALL", properties=DRIVER)
    assert isinstance(raw.schema["datestamp"].dataType, TimestampNTZType)
    jobs.read_waits_job(spark, by_id, spec("MW_MOUNTS"), spec("MW_WAITS"), kind="all", window=86400)
    want = jobs.flat(waits.read_waits_all(reads, mounts, 86400, 86400))
    got = read_jdbc(spark, derby_url, "MW_WAITS", properties=DRIVER)
    assert set(got.columns) == set(want.columns)
    cols = [c for c in want.columns if c not in ("bfid", "file_family", "volume", "migrated_volume")]
    got, want = got.select(*cols), want.select(*cols)
    assert got.count() == want.count() and got.exceptAll(want).count() == want.exceptAll(got).count() == 0
    with pytest.raises(ValueError, match="since"):
        jobs.read_waits_job(spark, by_id, spec("MW_MOUNTS"), spec("MW_WAITS"), window=86400, since="2024-01-02")
    part = read_jdbc_query(spark, derby_url, 'select "sfbr_id" as ID from MW_SMALL', column="ID",
                           num_partitions=2, properties=DRIVER)
    assert part.rdd.getNumPartitions() == 2 and part.count() == reads.count()


def test_family_labels_over_jdbc(spark, derby_url):
    from mountwait.plans import jobs
    names = dict(DRIVER, createTableColumnTypes="label VARCHAR(64), file_family VARCHAR(64)")
    schema = "id bigint, label string, file_family string"
    append_table(spark.createDataFrame([(1, "L1", "f1"), (2, "L2", "f2")], schema), "V1",
                 jdbc_url=derby_url, properties=names)
    append_table(spark.createDataFrame([(3, "L3", "f1"), (4, "L4", "f3")], schema), "V2",
                 jdbc_url=derby_url, properties=names)
    spec = lambda t, p=DRIVER: {"url": derby_url, "table": t, "properties": p}
    target = spec("LABELS", names)
    jobs.family_tables_job(spark, spec("V1"), target, keep_existing=False)
    jobs.family_tables_job(spark, spec("V2"), target)          # f1 has labels already
    got = read_jdbc(spark, derby_url, "LABELS", properties=DRIVER).collect()
    assert sorted((r.file_family, r.label) for r in got) == [("f1", "L1"), ("f2", "L2"), ("f3", "L4")]
