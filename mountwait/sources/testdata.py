"""Adapters from the driver's synthetic tables to this package's contracts.

The driver tables (``events``, ``orders``, ``lineitem`` ...) are not archive
tables; these mappings give them the shapes of the archive tables
(``volume``, ``tape_mounts``, reads, stores, ``file``, ``billinginfo``) so
that every job runs on whole driver tables.  The same mappings exist as SQL
in ``__spark_entry__.oracle_sql`` for the DuckDB cross-check.

All mappings are column expressions over one scan, except ``volume``, which
is the distinct users of ``events`` (a partially aggregated shuffle).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values of the adapter mapping (the same values are in the oracle SQL).
FAMILIES_BY_USER_MOD5 = ("fam-a", "fam/a", "fam_b", "fam-c")  # user_id % 5 = 0..3; 4 -> null
MOUNT_EVENT_TYPES = ("purchase", "signup", "error")
READ_EVENT_TYPE = "view"
STORE_EVENT_TYPE = "click"


_SCHEMAS: dict[str, object] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table.  Its schema is inferred from the Parquet footers once
    per path and then given to the reader, so later reads of the same file
    skip the footer-reading job."""
    path = f"{sf_dir.rstrip('/')}/{name}.parquet"
    schema = _SCHEMAS.get(path)
    if schema is None:
        df = spark.read.parquet(path)
        _SCHEMAS[path] = df.schema
        return df
    return spark.read.schema(schema).parquet(path)


def _family(user_id: Column) -> Column:
    m = user_id % 5
    e = F.when(m == 0, FAMILIES_BY_USER_MOD5[0])
    for i, fam in enumerate(FAMILIES_BY_USER_MOD5[1:], start=1):
        e = e.when(m == i, fam)
    return e


def _label(user_id: Column) -> Column:
    return F.concat(F.lit("V"), user_id.cast("string"))


def _bfid(site: Column, ts: Column, event_id: Column) -> Column:
    epoch = F.floor(F.unix_micros(ts.cast("timestamp")) / 1_000_000).cast("long")
    return F.concat(site, F.lpad(epoch.cast("string"), 10, "0"),
                    F.lpad(event_id.cast("string"), 6, "0"))


def volume(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = table(spark, sf_dir, "events").select("user_id").distinct()
    return u.select(F.col("user_id").alias("id"), _label(F.col("user_id")).alias("label"),
                    _family(F.col("user_id")).alias("file_family"))


def tape_mounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").filter(F.col("event_type").isin(*MOUNT_EVENT_TYPES))
    finish = F.when(F.col("event_id") % 7 != 0,
                    F.col("ts") + F.make_dt_interval(mins=(1 + F.col("event_id") % 600).cast("int")))
    writes = F.when(F.col("event_type") == "error", F.lit(0)).otherwise(1 + F.col("event_id") % 5)
    return e.select(F.col("event_id").alias("tapemount_id"), _label(F.col("user_id")).alias("volume"),
                    F.col("ts").alias("start"), finish.alias("finish"),
                    writes.cast("long").alias("writes"))


def reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``small_file_billinginfo_reads``: one row per ``view`` event."""
    e = table(spark, sf_dir, "events").filter(F.col("event_type") == READ_EVENT_TYPE)
    eid, uid = F.col("event_id"), F.col("user_id")
    site = F.when(eid % 11 == 0, F.lit("XXXX")).otherwise(F.lit("CDMS"))
    return e.select(
        eid.alias("sfbr_id"), _bfid(site, F.col("ts"), eid).alias("bfid"),
        F.col("ts").alias("datestamp"), _family(uid).alias("file_family"),
        _label(uid).alias("volume"),
        F.when(eid % 3 != 0, _label(uid + 1)).alias("migrated_volume"))


def stores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``storageinfo_sfa``: one row per ``click`` event."""
    e = table(spark, sf_dir, "events").filter(F.col("event_type") == STORE_EVENT_TYPE)
    eid, uid = F.col("event_id"), F.col("user_id")
    return e.select(
        eid.alias("storageinfo_id"),
        F.when(eid % 2 == 0, F.lit("store")).otherwise(F.lit("restore")).alias("action"),
        F.when(eid % 5 == 0, F.lit(1)).otherwise(F.lit(0)).alias("errorcode"),
        F.when(eid % 17 == 0, F.lit(None).cast("boolean")).otherwise(eid % 13 == 0).alias("updated"),
        F.concat(F.lit("P"), eid.cast("string")).alias("pnfsid"),
        _bfid(F.lit("CDMS"), F.col("ts"), eid).alias("bfid"),
        F.col("ts").alias("datestamp"), _family(uid).alias("file_family"),
        F.when(eid % 3 != 0, _label(uid)).alias("volume"))


def file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``file``: one row per order; ``bfid`` from the order date, ``volume``
    (the tape the file is on) from the customer."""
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    return o.select(k.alias("id"), F.concat(F.lit("P"), k.cast("string")).alias("pnfsid"),
                    F.when(k % 4 != 0, F.col("o_custkey")).alias("package_id"),
                    F.col("o_orderpriority").alias("original_library"),
                    _bfid(F.lit("CDMS"), F.col("o_orderdate"), k).alias("bfid"),
                    _label(F.col("o_custkey") % 200).alias("volume"))


def billinginfo(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    bid = (F.col("l_orderkey") * 10 + F.col("l_linenumber")) * 1_000_000 + F.col("l_partkey")
    return li.select(bid.cast("long").alias("billinginfo_id"),
                     F.concat(F.lit("P"), F.col("l_orderkey").cast("string")).alias("pnfsid"),
                     F.col("l_shipdate").alias("datestamp"))
