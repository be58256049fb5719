"""Session helpers.

Every job needs the same few settings: UTC as session time zone (all
request and mount times are zone-less), adaptive query execution (runtime
partition coalescing, skew-join splitting and broadcast conversion from
measured sizes) and a shared checkpoint folder for cutting lineage.
"""

from __future__ import annotations

import itertools
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import SparkSession

# Settings every job in this package relies on.
CORE_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


def build_session(master: str | None = None, shuffle_partitions: int | None = None,
                  app_name: str = "mountwait", extra: dict | None = None) -> SparkSession:
    """Create (or fetch) a session with the package's core settings.

    On a cluster pass ``master=None`` and let spark-submit decide; tests and
    the bench pass ``local[N]``.
    """
    b = SparkSession.builder.appName(app_name)
    if master:
        b = b.master(master)
    conf = dict(CORE_CONF)
    conf["spark.ui.enabled"] = "false"
    conf["spark.cleaner.referenceTracking.cleanCheckpoints"] = "true"
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    apply_core_conf(spark)
    return spark


def apply_core_conf(spark: SparkSession) -> None:
    """Set the runtime SQL settings on an existing session (idempotent)."""
    for k, v in CORE_CONF.items():
        spark.conf.set(k, v)


def checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster this setting names a shared (distributed) folder and is
    used as given; when it is unset there, this raises rather than fall
    back to a folder only one machine sees.  Only in local mode (tests) an
    unset folder is made under the system temp area.
    """
    sc = spark.sparkContext
    d = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not d:
        jdir = sc._jsc.sc().getCheckpointDir()
        if jdir.isDefined():
            return jdir.get()
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a shared folder (e.g. on HDFS or an "
                               "object store) before running multi-stage jobs")
        d = tempfile.mkdtemp(prefix="mountwait-ckpt-")
    sc.setCheckpointDir(d)
    return d


@contextmanager
def scratch_tables(spark: SparkSession):
    """A function that stores a frame as a table in the shared checkpoint
    folder and reads it again (cuts lineage; later stages read only the
    columns they need).  The tables are deleted at the end of the block, so
    the final result must be written inside it."""
    root = f"{checkpoint_dir(spark).rstrip('/')}/mountwait-job-{uuid.uuid4().hex}"
    number = itertools.count()

    def store(df):
        path = f"{root}/{next(number)}"
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    try:
        yield store
    finally:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def cut_lineage(df, eager: bool = True):
    """Materialise ``df`` in the shared checkpoint folder (reliable checkpoint).

    Survives executor loss, unlike a local checkpoint.  Under Spark Connect
    there is no client-side context; the server's checkpoint folder is used.
    """
    try:
        has_context = df.sparkSession.sparkContext is not None
    except Exception:  # Spark Connect: no SparkContext on the client
        has_context = False
    if has_context:
        checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=eager)
