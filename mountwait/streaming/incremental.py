"""Copy newly arrived request files into a day-partitioned table.

The file source records in the checkpoint which files each micro-batch
consumed, and the file sink commits each batch in its own log, so a query
restarted after a failure resumes after the last committed batch: no file
is copied twice and none is skipped (exactly-once).  ``availableNow`` runs
every file present at start in rate-limited batches and then stops, which
suits a scheduled job.
"""

from __future__ import annotations

import os

from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mountwait.session import checkpoint_dir


def copy_new_files(spark: SparkSession, source_dir: str, schema: T.StructType, target: str,
                   ts_col: str = "datestamp", name: str = "request_copy",
                   checkpoint: str | None = None, max_files_per_trigger: int | None = None,
                   wait: bool = True):
    """Start (and by default finish) an ``availableNow`` copy of the Parquet
    files in ``source_dir`` to ``target``, partitioned by day (``ds``)."""
    ckpt = checkpoint or os.path.join(checkpoint_dir(spark), "streams", name)
    reader = spark.readStream.schema(schema)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", str(max_files_per_trigger))
    # One file per day per micro-batch (adaptive rebalancing does not run in
    # micro-batches); a batch is bounded by ``max_files_per_trigger``.
    stream = reader.parquet(source_dir).withColumn(
        "ds", F.date_format(F.to_date(ts_col), "yyyy-MM-dd")).repartition("ds")
    query = (stream.writeStream.format("parquet").option("path", target)
             .option("checkpointLocation", ckpt).partitionBy("ds")
             .trigger(availableNow=True).start())
    if wait:
        query.awaitTermination()
    return query
