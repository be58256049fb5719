"""Exact deduplication by two-pass Bloom filtering, DataFrame functions only.

Texts are equal when identical after each run of white space is replaced by
one space.  They are told apart by SHA-256; a 64-bit hash of the text picks
its bits in a blocked Bloom filter: a block of 32,768 bits and two bits in it.

1. First pass: the bits that rows set are counted (partial aggregation before
   the shuffle, so a text that holds a third of all rows costs a task two
   rows).  Bits set twice or more make the filter of repeated bits, one 4 KB
   bitmap a block.
2. Second pass: each row probes its block's bitmap by a broadcast join.  A row
   with a bit that was set once cannot repeat and passes straight through.
   Only rows with both bits repeated - true repeats, and at most 1 row in 70
   besides - go on to the shuffle by SHA-256.

The filter has ``BITS_PER_ROW`` bits a row, so its size grows with the table.
It is cut by hash into sections of at most ``SECTION_BYTES``, which is the
bound of each broadcast; sections beyond the first are probed one after
another over the narrow table, stored by section, so a row is read once.

Rows learn their group by a join in two ways: groups above 1/``HOT_PARTS`` of
all rows, of which fewer than ``HOT_PARTS`` can exist, are broadcast; all others
are joined by shuffle, where a key then has less than that share.

Defined results: a null text counts as empty, and empty texts equal each
other (a text of white space is one space, not empty).  A null id sorts after
every other.  Of rows that repeat both id and text one stays.  An empty table
gives no rows.  Other columns are not read by ``mark`` and kept by ``keep_one``.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mountwait.llm.common import hot_cold_join, written

BLOCK_BITS = 1 << 15  # bits of one bitmap_construct_agg bitmap
BITS_PER_ROW = 16
SECTION_BYTES = 256 << 20
SPACES = r"[\x20\x09-\x0D]+"


def normalised(text_col: str) -> Column:
    """The text with every run of white space as one space; null as empty."""
    return F.regexp_replace(F.coalesce(F.col(text_col), F.lit("")), SPACES, " ")


def _blocks(rows: int) -> int:
    """Blocks of the filter: a power of two with BITS_PER_ROW bits a row at least."""
    return 1 << max(0, math.ceil(math.log2(max(1, rows * BITS_PER_ROW / BLOCK_BITS))))


def _places(blocks: int) -> list[Column]:
    """Block and the two bits of a row, from disjoint bits of its hash ``h``."""
    return [F.shiftrightunsigned("h", 30).bitwiseAND(F.lit(blocks - 1)).alias("block"),
            F.col("h").bitwiseAND(F.lit(BLOCK_BITS - 1)).alias("b1"),
            F.shiftrightunsigned("h", 15).bitwiseAND(F.lit(BLOCK_BITS - 1)).alias("b2")]


def repeated_bits(hashes: DataFrame, blocks: int) -> DataFrame:
    """First pass: (block, bits) with the bits that two or more rows set; column ``h`` is read."""
    cells = hashes.select(*_places(blocks)).select("block", F.explode(F.array_distinct(F.array("b1", "b2"))).alias("bit"))
    twice = cells.groupBy("block", "bit").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return twice.groupBy("block").agg(F.bitmap_construct_agg("bit").alias("bits"))


def _is_set(bit: str) -> Column:
    byte = F.conv(F.hex(F.expr(f"substring(bits, int({bit} div 8) + 1, 1)")), 16, 10).cast("int")
    return F.expr(f"shiftleft(1, int({bit} % 8))").bitwiseAND(byte) != 0


def probe(rows: DataFrame, filter_: DataFrame, blocks: int) -> DataFrame:
    """Second pass: rows with ``suspect``; no row moves, the filter's size is bounded by the caller."""
    placed = rows.select("*", *_places(blocks))
    return placed.join(F.broadcast(filter_), "block", "left").withColumn(
        "suspect", F.coalesce(_is_set("b1") & _is_set("b2"), F.lit(False))).drop("block", "b1", "b2", "bits")


def _sections(blocks: int, section_bytes: int) -> list[tuple[int, int]]:
    """Block ranges [lo, hi) whose bitmaps fit the bound."""
    step = max(1, section_bytes * 8 // BLOCK_BITS)
    return [(lo, min(lo + step, blocks)) for lo in range(0, blocks, step)]


def _suspects(rows: DataFrame, n: int, section_bytes: int) -> tuple[DataFrame, DataFrame, int, list[tuple[int, int]]]:
    """rows with ``suspect``, the written filter, its blocks and sections."""
    blocks = _blocks(n)
    parts = _sections(blocks, section_bytes)
    filter_ = written(repeated_bits(rows.select("h"), blocks), "bloom")
    if len(parts) == 1:
        return probe(rows, filter_, blocks), filter_, blocks, parts
    block = _places(blocks)[0]
    stored = written(rows.withColumn("section", F.floor(block / (parts[0][1])).cast("int")), "sections",
                     partition_by="section")
    out = None
    for s, (lo, hi) in enumerate(parts):  # one bounded broadcast at a time
        one = written(probe(stored.where(F.col("section") == s).drop("section"),
                            filter_.where((F.col("block") >= lo) & (F.col("block") < hi)), blocks), "probed")
        out = one if out is None else out.unionByName(one)
    return out, filter_, blocks, parts


def mark(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
         section_bytes: int = SECTION_BYTES) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256 (binary).

    ``keep_id`` is the smallest id among equal texts, ``kept`` marks the one
    row that stays.
    """
    text = normalised(text_col)
    rows = written(docs.select(F.col(id_col).alias("doc_id"), F.unhex(F.sha2(text, 256)).alias("sha"),
                               F.xxhash64(text).alias("h"), F.monotonically_increasing_id().alias("row")), "hashes")
    n = rows.count()
    marked = _suspects(rows, n, section_bytes)[0].select("doc_id", "sha", "row", "suspect")
    first = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")
    groups = written(
        marked.where("suspect").groupBy("sha").agg(F.min(first).alias("first"), F.count(F.lit(1)).alias("group_size"))
        .where("group_size > 1").select("sha", F.col("first.doc_id").alias("keep_id"), F.col("first.row").alias("keep_row"),
                                        "group_size"), "groups")
    out = hot_cold_join(marked, groups, "sha", "group_size", n, skip=~F.col("suspect"))
    single = F.col("group_size").isNull()
    return out.select(
        "doc_id", F.when(single, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).alias("group_size"),
        (single | (F.col("row") == F.col("keep_row"))).alias("kept"), F.col("sha").alias("text_sha256"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
             section_bytes: int = SECTION_BYTES) -> DataFrame:
    """docs with one whole row per distinct text: the smallest id's.

    Rows that repeat id and text as well are settled by a hash of their
    columns.  Rows that cannot repeat pass straight through; suspects are
    reduced before their shuffle, so a hot text sends one row a task.  Where
    the filter has several sections, docs are read once for each.
    """
    text = normalised(text_col)
    hashes = written(docs.select(F.xxhash64(text).alias("h")), "hashes")
    blocks = _blocks(hashes.count())
    filter_ = written(repeated_bits(hashes, blocks), "bloom")
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")
    place = [F.col(f"`{f.name}`") for f in docs.schema if f.dataType.typeName() not in ("map", "variant")]
    whole = docs.select(row, F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"),
                                      F.xxhash64(*place).alias("tie")).alias("_order"),
                        F.xxhash64(text).alias("h"), text.alias("_norm"))
    out = None
    for lo, hi in _sections(blocks, section_bytes):
        block = _places(blocks)[0]
        mine = whole.where((block >= lo) & (block < hi)) if hi - lo < blocks else whole
        probed = probe(mine, filter_.where((F.col("block") >= lo) & (F.col("block") < hi)), blocks)
        straight = probed.where(~F.col("suspect")).select("_row.*")
        least = (probed.where("suspect").groupBy(F.sha2("_norm", 256).alias("_sha"))
                 .agg(F.min_by("_row", "_order").alias("_row")).select("_row.*"))
        both = straight.unionByName(least)
        out = both if out is None else out.unionByName(both)
    return out
