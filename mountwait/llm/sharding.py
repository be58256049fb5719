"""Sharding by longest-processing-time scheduling (law ``bytes``).

Rows with equal texts form a group that must stay together.  Groups go, the
largest first, to the least-loaded shard through a heap.  All groups cannot
pass one heap at scale, so the schedule has two levels, both LPT:

* groups are spread over cells by their hash.  In each cell a streamed heap
  packs the groups, sorted by size, into bundles.  A bundle never mixes the
  bulk of a cell with its tail: three levels (the first 90 %, the next 9 %,
  the last 1 % of the cell's bytes) give ever smaller bundles;
* the driver runs the final heap over the bundles (cells x levels x shards of
  them, whatever the number of rows) and over the few groups above 1/64 of a
  shard's fair share - at most 64 x shards of those can exist.

Slots are numbered without a shard passing one task: (shard, block) counts
give offsets, and a window numbers the rows inside each block.
"""

from __future__ import annotations

import heapq

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mountwait.session import cut_lineage

SHARDS = 24
HEAVY_PARTS = 64
LEVELS = (0.90, 0.99, 1.0)
MIN_CELLS = 64


def lpt(sizes: list[tuple[int, object]], shards: int) -> dict:
    """item -> shard; sizes descending, ties by item, least-loaded shard first."""
    heap = [(0, s) for s in range(shards)]
    out = {}
    for size, item in sorted(sizes, key=lambda x: (-x[0], x[1])):
        load, s = heapq.heappop(heap)
        out[item] = s
        heapq.heappush(heap, (load + size, s))
    return out


def _pack(cell_bytes: dict[int, int], shards: int):
    """Streamed LPT of the groups of each cell into bundles."""
    def run(batches):
        cell, seen, heap, level = None, 0, [], 0
        for b in batches:
            cells, keys, sizes = (b.column(i).to_pylist() for i in range(3))
            bundle = []
            for c, size in zip(cells, sizes):
                if c != cell:
                    cell, seen, level = c, 0, 0
                    heap = [(0, s) for s in range(shards)]
                while seen >= LEVELS[level] * cell_bytes[c] and level + 1 < len(LEVELS):
                    level += 1
                    heap = [(0, s) for s in range(shards)]
                load, s = heapq.heappop(heap)
                heapq.heappush(heap, (load + size, s))
                seen += size
                bundle.append((c * len(LEVELS) + level) * shards + s)
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.binary()), pa.array(sizes, pa.int64()), pa.array(bundle, pa.int64())],
                names=["gk", "gsize", "bundle"])
    return run


def assign(df: DataFrame, key: str, size: str, shards: int = SHARDS) -> DataFrame:
    """df with ``shard``: rows of one ``key`` share a shard, byte sums near equal.

    ``key`` is a binary column without nulls, ``size`` a long column.
    """
    spark = df.sparkSession
    cells = max(MIN_CELLS, int(spark.conf.get("spark.sql.shuffle.partitions")))
    # Groups and packing are written down, as several jobs read them.
    groups = cut_lineage(df.groupBy(F.col(key).alias("gk")).agg(F.sum(size).alias("gsize"))
                         .withColumn("cell", F.pmod(F.xxhash64("gk"), F.lit(cells)).cast("int")))
    total = groups.agg(F.sum("gsize")).first()[0] or 0
    heavy_at = max(1, total // (shards * HEAVY_PARTS))
    heavy = [(r.gsize, bytes(r.gk)) for r in groups.where(F.col("gsize") >= heavy_at).select("gk", "gsize").collect()]
    light = groups.where(F.col("gsize") < heavy_at)
    cell_bytes = {r.cell: r.b for r in light.groupBy("cell").agg(F.sum("gsize").alias("b")).collect()}
    packed = cut_lineage(light.repartition(cells, "cell").sortWithinPartitions("cell", F.desc("gsize"), "gk")
                         .select("cell", "gk", "gsize")
                         .mapInArrow(_pack(cell_bytes, shards), "gk binary, gsize long, bundle long"))
    bundles = [(r.b, r.bundle) for r in packed.groupBy("bundle").agg(F.sum("gsize").alias("b")).collect()]
    # Heavy groups and bundles share the final heap; items are tagged to sort together.
    place = lpt([(b, (0, k)) for b, k in heavy] + [(b, (1, k)) for b, k in bundles], shards)
    of_bundle = spark.createDataFrame([(k, place[1, k]) for _, k in bundles], "bundle long, shard int")
    of_heavy = spark.createDataFrame([(k, place[0, k]) for _, k in heavy], "gk binary, shard int")
    where = packed.join(F.broadcast(of_bundle), "bundle").select("gk", "shard").unionByName(of_heavy)
    return df.join(where, df[key] == where["gk"]).drop("gk")


def number(df: DataFrame, shard: str, order: list[str], slot: str = "slot") -> DataFrame:
    """df with a gapless number from 0 in each shard, ordered inside blocks."""
    spark = df.sparkSession
    blocks = max(MIN_CELLS, int(spark.conf.get("spark.sql.shuffle.partitions")))
    df = df.withColumn("_block", F.pmod(F.xxhash64(*order), F.lit(blocks)).cast("int"))
    counts = df.groupBy(F.col(shard).alias("_s"), F.col("_block").alias("_b")).agg(F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy("_s").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_s", "_b", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_o"))
    # One row per (shard, block): bounded by the two settings, not by the data.
    inside = F.row_number().over(Window.partitionBy(shard, "_block").orderBy(*order))
    return (df.withColumn("_r", inside)
            .join(F.broadcast(offsets), (F.col(shard) == F.col("_s")) & (F.col("_block") == F.col("_b")))
            .withColumn(slot, F.col("_o") + F.col("_r") - 1).drop("_s", "_b", "_o", "_r", "_block"))


def shard_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    shards: int = SHARDS) -> DataFrame:
    """One row per document with its shard and slot.

    A null text has no bytes (size 8, CRC of the empty string) and groups
    with empty texts.  Repeated rows each get a slot of their own; null ids
    are kept.  An empty table gives no rows.  Other columns are not read.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = cut_lineage(docs.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(text).cast("long").alias("text_crc32"),
        F.unhex(F.md5(text)).alias("key")))
    out = cut_lineage(assign(rows, "key", "size", shards))
    out = number(out, "shard", ["doc_id", "key"])
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"),
                      F.col("shard").cast("int").alias("shard"), F.col("slot").cast("long").alias("slot"),
                      F.lit(None).cast("int").alias("grown_shard"))
