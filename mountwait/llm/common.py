"""Helpers shared by the operators: table reading, byte views, word hashes.

The numpy helpers work on the UTF-8 bytes of one Arrow batch, without
copying the texts into Python strings.  ``slices`` bounds how many bytes are
in work at a time; a single text longer than the bound is one slice.
"""

from __future__ import annotations

import ctypes
import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mountwait.session import checkpoint_dir

SLICE_BYTES = 1 << 20
MASK64 = (1 << 64) - 1

# Arrow batches stay small, so that one batch of long texts fits a worker.
ARROW_CONF = {
    "spark.sql.execution.arrow.maxRecordsPerBatch": "1000",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(16 << 20),
}


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give the executors' Python workers this package, once per application."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    path = os.path.join(tempfile.mkdtemp(prefix="mountwait-ship-"), "mountwait-package.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for d, _, names in os.walk(root):
            for n in sorted(names):
                if n.endswith(".py"):
                    full = os.path.join(d, n)
                    z.write(full, os.path.relpath(full, os.path.dirname(root)))
    spark.sparkContext.addPyFile(path)
    _shipped.add(app)


def prepare(spark: SparkSession) -> None:
    """Session settings the operators rely on (idempotent)."""
    for k, v in ARROW_CONF.items():
        spark.conf.set(k, v)
    ship(spark)


def written(df: DataFrame, name: str, partition_by: str | None = None) -> DataFrame:
    """df as a compressed table in the shared checkpoint folder: cuts lineage, read by several jobs."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/mountwait-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path, partitionBy=partition_by)
    return spark.read.schema(df.schema).parquet(path)


HOT_PARTS = 2_000


def hot_cold_join(rows: DataFrame, groups: DataFrame, key: str, weight: str, total: int,
                  skip: Column | None = None) -> DataFrame:
    """Left join of rows to groups (one row a key) that no key can skew.

    ``weight`` counts the rows of each group, ``total`` all of them.  Groups
    above total / HOT_PARTS are fewer than HOT_PARTS and are broadcast; the
    rest are joined by shuffle.  Rows under ``skip`` have no group (their
    group columns are null) and take no part in the shuffle.
    """
    bound = max(1, total // HOT_PARTS)
    extra = [c for c in groups.columns if c != key]
    skip = F.lit(False) if skip is None else skip
    hot = groups.where(F.col(weight) > bound).select(key, F.struct(*extra).alias("_hot"))
    seen = rows.withColumn("_skip", skip).join(F.broadcast(hot), key, "left")
    done = F.col("_skip") | F.col("_hot").isNotNull()
    cold = groups.where(F.col(weight) <= bound)
    near = seen.where(done).select(*rows.columns, *[F.col(f"_hot.{c}").alias(c) for c in extra])
    far = seen.where(~done).select(*rows.columns).join(cold, key, "left").select(*rows.columns, *extra)
    return near.unionByName(far)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = pc.fill_null(col, "")
    col = col.cast(pa.large_string())
    if len(col) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    bufs = col.buffers()
    off = np.frombuffer(bufs[1], np.int64)[col.offset:col.offset + len(col) + 1]
    lo, hi = int(off[0]), int(off[-1])
    data = np.frombuffer(bufs[2], np.uint8)[lo:hi] if hi > lo else np.zeros(0, np.uint8)
    return data, off - lo


def give_back() -> None:
    """At a task's end: return freed memory to the system, as the worker lives on with other tasks."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim is not None:
        trim(0)


def slices(batches, text_col: str, bound: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(rows, bytes, offsets) for runs of rows of about ``bound`` bytes."""
    for batch in batches:
        if not batch.num_rows:
            continue
        data, off = text_buffers(batch.column(batch.schema.get_field_index(text_col)))
        i, n = 0, batch.num_rows
        while i < n:
            j = max(i + 1, int(np.searchsorted(off, off[i] + bound, "right")) - 1)
            j = min(j, n)
            yield batch.slice(i, j - i), data[off[i]:off[j]], off[i:j + 1] - off[i]
            i = j
    give_back()


def mix64(x: np.ndarray) -> np.ndarray:
    """splitmix64 finaliser over uint64."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_GAMMA = np.uint64(0x9E3779B97F4A7C15)
BYTE_CODES = mix64(np.arange(1, 257, dtype=np.uint64) * _GAMMA)
BASE = 0xD6E8FEB86659FD93  # odd, so that it has an inverse modulo 2**64
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, kept per worker."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        out = np.full(size, np.uint64(base), np.uint64)
        out[0] = 1
        have = np.multiply.accumulate(out)
        if size <= 2 * SLICE_BYTES:
            _powers[base] = have
    return have[:n]


INVERSE = pow(BASE, -1, 1 << 64)


def prefix_hash(data: np.ndarray, base: int = BASE, codes: np.ndarray = BYTE_CODES) -> np.ndarray:
    """Prefix sums of code * base**i: substring hashes are differences."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(codes[data] * powers(base, len(data)), out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray, base: int = BASE) -> np.ndarray:
    """Hash of data[start:end] for many spans, whatever their place."""
    inv = powers(pow(base, -1, 1 << 64), len(prefix))
    return mix64((prefix[end] - prefix[start]) * inv[start] + (end - start).astype(np.uint64) * _GAMMA)


WORD_BYTE = np.ones(256, bool)
WORD_BYTE[[9, 10, 11, 12, 13, 32]] = False  # words are [^\x20\x09-\x0D]+


def word_spans(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, document) of every word; words never cross documents."""
    if not len(data):
        z = np.zeros(0, np.int64)
        return z, z, z
    on = WORD_BYTE[data]
    first = on.copy()
    first[1:] &= ~on[:-1]
    inner = off[:-1][off[:-1] < len(data)]
    first[inner] = on[inner]
    last = on.copy()
    last[:-1] &= ~on[1:]
    ends = off[1:][off[1:] > 0] - 1
    last[ends] = on[ends]
    start = np.flatnonzero(first)
    end = np.flatnonzero(last) + 1
    return start, end, np.searchsorted(off, start, "right") - 1


def per_doc(flags: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Sum of a per-byte array in each document."""
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return total[off[1:]] - total[off[:-1]]


def repeated(keys: np.ndarray) -> np.ndarray:
    """Mask of the keys that occur twice or more."""
    if len(keys) < 2:
        return np.zeros(len(keys), bool)
    s = np.sort(keys)
    dup = s[1:][s[1:] == s[:-1]]
    if not len(dup):
        return np.zeros(len(keys), bool)
    dup = dup[np.r_[True, dup[1:] != dup[:-1]]]
    at = np.searchsorted(dup, keys)
    at[at == len(dup)] = 0
    return dup[at] == keys


def covered(starts: np.ndarray, width: int, n: int) -> np.ndarray:
    """Mask over n places of those in [s, s + width) for any start."""
    step = np.zeros(n + 1, np.int64)
    np.add.at(step, starts, 1)
    np.add.at(step, np.minimum(starts + width, n), -1)
    return np.cumsum(step[:-1]) > 0


def batch_of(schema: pa.Schema, *cols) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [c if isinstance(c, pa.Array) else pa.array(c, type=f.type) for c, f in zip(cols, schema)], schema=schema)
