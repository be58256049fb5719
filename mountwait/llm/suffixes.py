"""Exact substring duplicates: suffixes sampled, named, sorted and induced.

Every byte covered by a LENGTH-byte string that also starts elsewhere is
removed.  Sorting all suffixes of a corpus by full induction (tuples and
common-prefix values through disk-backed queues, level by level) moves each
byte many times; here the same recursion runs on a sample of suffixes, and
Spark's external sort and shuffle are the disk-backed queues:

1. Sample.  Of every LENGTH-byte window the K-gram with the least hash is the
   window's anchor (its last place, if there are several).  Equal windows
   have equal anchors at equal places, whatever stands around them, so only
   suffixes at anchors need to meet.  About one place in 170 is an anchor; it
   stands for a run of consecutive windows.
2. Name.  An anchor's extent is all text under its windows.  Rows (K-gram,
   name of the extent) are counted in Spark.  A K-gram met once: none of its
   windows occurs elsewhere.  An extent met twice: all its windows do.
3. Recur on what is open.  An extent met once under a K-gram met more often
   may share some windows only.  Just for these, the text of the extent goes
   with its suffix tuple to the K-gram's task, with one representative of
   each repeated extent there; the tuples are sorted, and all windows of a
   K-gram compared by place and content.  Under a K-gram with very many open
   extents each window is a row of its own, counted by its digest in Spark.
4. Induce.  The windows found at anchors cover the bytes to remove.

Rows travel by K-gram, extent or text key, with partial counts before each
shuffle; copies of a text or passage add to counts, not to rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mountwait.llm.common import hot_cold_join, mix64, prefix_hash, slices, span_hash, written
from mountwait.session import cut_lineage

LENGTH = 400
K = 64
_SALT = np.uint64(0x9E3779B97F4A7C15)


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    have = 1
    while 2 * have <= width:
        x = np.minimum(x[:-have], x[have:])
        have *= 2
    rest = width - have
    return np.minimum(x[:len(x) - rest], x[rest:]) if rest else x


def anchors(data: np.ndarray, off: np.ndarray, length: int = LENGTH, k: int = K):
    """(doc, first window, last window, anchor, K-gram, extent) of each run of windows.

    Places are in ``data``; windows lie inside one document.
    """
    none = np.zeros(0, np.int64)
    if len(data) < length:
        return none, none, none, none, none.view(np.uint64), none.view(np.uint64)
    prefix = prefix_hash(data)
    n = len(data)
    at = np.arange(n - k + 1)
    h = span_hash(prefix, at, at + k)
    width = length - k + 1
    low = _sliding_min(h, width)  # of the window from s: low[s]
    size = np.diff(off)
    docs = np.flatnonzero(size >= length)
    step = np.zeros(len(low) + 1, np.int32)
    np.add.at(step, off[docs], 1)
    np.add.at(step, off[docs + 1] - length + 1, -1)
    valid = np.cumsum(step[:-1]) > 0
    enters = h[width - 1:] == low
    turn = enters.copy()
    turn[1:] |= low[1:] != low[:-1]
    turn[off[docs]] = True
    first = np.flatnonzero(turn & valid)
    doc = np.searchsorted(off, first, "right") - 1
    last = np.minimum(np.r_[first[1:], n], off[doc + 1] - length + 1) - 1
    anchor = first + width - 1
    seek = np.flatnonzero(~enters[first])
    for b in range(0, len(seek), 1 << 13):
        part = first[seek[b:b + (1 << 13)]]
        same = h[part[:, None] + np.arange(width)] == low[part][:, None]
        anchor[seek[b:b + (1 << 13)]] = part + width - 1 - same[:, ::-1].argmax(axis=1)
    place = ((anchor - first) * 512 + (anchor - last)).astype(np.uint64)
    extent = mix64(span_hash(prefix, first, last + length) ^ mix64(place + _SALT))
    return doc, first, last, anchor, h[anchor], extent


def _anchor_rows(docs: DataFrame, length: int) -> DataFrame:
    """(kgram, extent, tkey, first, last, back, rid) of every anchor of (tkey, text)."""
    def run(batches):
        for rows, data, off in slices(batches, "text"):
            doc, first, last, anchor, kgram, extent = anchors(data, off, length)
            if not len(doc):
                continue
            begin = off[doc]
            yield pa.RecordBatch.from_arrays(
                [pa.array(kgram.view(np.int64)), pa.array(extent.view(np.int64)), rows.column(0).take(pa.array(doc)),
                 pa.array(first - begin), pa.array((last - first).astype(np.int16)),
                 pa.array((anchor - first).astype(np.int16))],
                names=["kgram", "extent", "tkey", "first", "more", "back"])
    return docs.select("tkey", "text").mapInArrow(
        run, "kgram long, extent long, tkey binary, first long, more short, back short"
    ).withColumn("rid", F.xxhash64("tkey", "first"))


# An item of a text: first << 24 | more << 15 | back << 6 | parts << 2 | kind.
_SAME, _OPEN = 1, 2
_MAX_PARTS = 4  # log2; a K-gram's open extents are split by window place into up to so many tasks
_BY_WINDOW = 15  # in place of parts: more extents than that, each window is a row of its own


def _pack(kind):
    return (F.shiftleft(F.col("first"), 24) + F.shiftleft(F.col("more").cast("long"), 15)
            + F.shiftleft(F.col("back").cast("long"), 6) + F.shiftleft(F.col("parts").cast("long"), 2) + kind)


def _open_contexts(docs: DataFrame, items: DataFrame, length: int) -> DataFrame:
    """(task, kgram, rid, tkey, first, place, context) of the open extents, from the texts."""
    def run(batches):
        for b in batches:
            out: list[tuple] = []
            for tkey, text, own in zip(b.column(0), b.column(1), b.column(2)):
                raw = text.as_buffer()
                key = tkey.as_py()
                for x in own.as_py():
                    first, more, back, parts = x >> 24, x >> 15 & 511, x >> 6 & 511, 1 << (x >> 2 & 15)
                    gram = hashlib.blake2b(raw[first + back:first + back + K], digest_size=8).digest()
                    rid = hashlib.blake2b(key + first.to_bytes(8, "little"), digest_size=8).digest()
                    # Windows by their distance to the anchor, the same slices in every text.
                    wide = 512 // parts
                    for part in range((back - more) // wide, back // wide + 1):
                        lo = max(first, first + back - (part + 1) * wide + 1)
                        hi = min(first + more, first + back - part * wide)
                        if lo <= hi:
                            out.append((gram + bytes([part, parts.bit_length()]), rid, key, lo, first + back - lo,
                                        raw[lo:hi + length].to_pybytes()))
            if out:
                cols = list(zip(*out))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(cols[0], pa.binary()), pa.array(cols[1], pa.binary()), pa.array(cols[2], pa.binary()),
                     pa.array(cols[3], pa.int64()), pa.array(cols[4], pa.int32()), pa.array(cols[5], pa.binary())],
                    names=["task", "rid", "tkey", "first", "place", "context"])
    return (docs.select("tkey", "text").join(items, "tkey").select("tkey", "text", "items")
            .mapInArrow(run, "task binary, rid binary, tkey binary, first long, place int, context binary"))


def _open_windows(docs: DataFrame, items: DataFrame, length: int) -> DataFrame:
    """(tkey, first, more): repeated windows of open extents under K-grams with very many of them.

    A window is a row of its 128-bit digest; rows meet by partial counts, so
    no task holds the extents of one K-gram.  A digest of very many rows is
    joined by broadcast.
    """
    def run(batches):
        for b in batches:
            for tkey, text, own in zip(b.column(0), b.column(1), b.column(2)):
                raw = text.as_buffer().to_pybytes()
                spans = [(x >> 24, x >> 15 & 511) for x in own.as_py()]
                for i in range(0, len(spans), 256):
                    at = np.unique(np.concatenate([np.arange(f, f + more + 1) for f, more in spans[i:i + 256]]))
                    digests = [hashlib.blake2b(raw[a:a + length], digest_size=16).digest() for a in at.tolist()]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(digests, pa.binary()), pa.array([tkey.as_py()] * len(at), pa.binary()), pa.array(at)],
                        names=["window", "tkey", "first"])
    rows = written(docs.select("tkey", "text").join(items, "tkey").select("tkey", "text", "items")
                   .mapInArrow(run, "window binary, tkey binary, first long"), "windows")
    # Copies of a text give the same (tkey, first): a window is repeated where two places differ.
    place = F.struct("tkey", "first")
    met = rows.groupBy("window").agg(F.count(F.lit(1)).alias("n"), (F.min(place) != F.max(place)).alias("twice"))
    return (hot_cold_join(rows, met, "window", "n", rows.count()).where("twice")
            .select("tkey", "first", F.lit(0).cast("short").alias("more")).distinct())


def compare(tasks: np.ndarray, places: np.ndarray, contexts: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, first window, last window) of the windows met twice or more.

    Windows meet if their task, their place (distance to the anchor) and
    their content agree.
    """
    size = np.fromiter(map(len, contexts), np.int64, len(contexts))
    data = np.frombuffer(b"".join(contexts), np.uint8)
    begin = np.cumsum(size) - size
    n = size - length + 1
    row = np.repeat(np.arange(len(size)), n)
    step = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    at = begin[row] + step
    key = mix64(span_hash(prefix_hash(data), at, at + length)
                ^ mix64(tasks[row] + (places[row] - step).astype(np.uint64) * _SALT))
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    hit = np.zeros(len(key), bool)
    hit[order[1:][same]] = True
    hit[order[:-1][same]] = True
    # Runs of such windows inside each row.
    good = np.flatnonzero(hit)
    if not len(good):
        z = np.zeros(0, np.int64)
        return z, z, z
    new = np.r_[True, (good[1:] != good[:-1] + 1) | (row[good[1:]] != row[good[:-1]])]
    starts = good[new]
    ends = good[np.r_[np.flatnonzero(new)[1:] - 1, len(good) - 1]]
    return row[starts], step[starts], step[ends]


def _resolve(contexts: DataFrame, length: int, bound: int = 2 << 20) -> DataFrame:
    """(tkey, first, more): runs of windows of open extents that occur elsewhere."""
    def run(batches):
        held: list[tuple] = []
        size, current, seen = 0, None, None

        def flush(rows):
            tasks = np.array([int.from_bytes(hashlib.blake2b(r[0], digest_size=8).digest(), "little") for r in rows], np.uint64)
            row, a, b = compare(tasks, np.array([r[4] for r in rows], np.int64), [r[5] for r in rows], length)
            rows_at = row.tolist()
            return pa.RecordBatch.from_arrays(
                [pa.array([rows[i][2] for i in rows_at], pa.binary()),
                 pa.array([rows[i][3] + x for i, x in zip(rows_at, a.tolist())], pa.int64()),
                 pa.array((b - a).astype(np.int16))], names=["tkey", "first", "more"])
        for batch in batches:
            for r in zip(*(c.to_pylist() for c in batch.columns)):
                if r[0] != current:
                    if size > bound:
                        yield flush(held)
                        held, size = [], 0
                    current = r[0]
                if (r[0], r[1]) == seen:  # a copy of the text gives the same tuple
                    continue
                seen = r[0], r[1]
                held.append(r)
                size += len(r[5])
        if held:
            yield flush(held)
    spark = contexts.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return (contexts.repartition(n, "task").sortWithinPartitions("task", "rid")
            .select("task", "rid", "tkey", "first", "place", "context")
            .mapInArrow(run, "tkey binary, first long, more short"))


def duplicate_runs(docs: DataFrame, length: int = LENGTH, hot: int = 4000) -> DataFrame:
    """(tkey, runs): for each text with any, packed runs (first << 16 | more) of repeated windows.

    ``docs`` has tkey (the digest of the text) and text.  ``hot`` open
    extents of one K-gram go to one task; more are split by place, and far
    more are counted window by window.
    """
    if not K <= length < K + 512:
        raise ValueError(f"length must be from {K} to {K + 511}")
    rows = written(_anchor_rows(docs, length), "anchors")
    names = rows.groupBy("kgram", "extent").agg(F.count(F.lit(1)).alias("m"), F.min("rid").alias("rep"))
    grams = names.groupBy("kgram").agg(F.sum("m").alias("n"), F.sum((F.col("m") == 1).cast("long")).alias("open"))
    parts = F.greatest(F.lit(0), F.ceil(F.log2(F.col("open") / F.lit(float(hot)))))
    parts = F.when(parts > _MAX_PARTS, _BY_WINDOW).otherwise(parts)
    known = names.join(grams.where("n > 1"), "kgram").select(
        "kgram", "extent", "m", "rep", (F.col("open") > 0).alias("sought"),
        F.coalesce(parts, F.lit(0)).cast("int").alias("parts"))
    met = written(rows.join(known, ["kgram", "extent"]).select(
        "tkey", _pack(F.when(F.col("m") > 1, _SAME).otherwise(0)
                      + F.when((F.col("m") == 1) | (F.col("sought") & (F.col("rid") == F.col("rep"))), _OPEN).otherwise(0))
        .alias("item")).where("item & 3 <> 0"), "met")
    opened = met.where(F.col("item").bitwiseAND(_OPEN) != 0)
    by_window = F.shiftright("item", 2).bitwiseAND(15) == _BY_WINDOW
    few, many = (opened.where(c).groupBy("tkey").agg(F.collect_set("item").alias("items")) for c in (~by_window, by_window))
    found = _resolve(_open_contexts(docs, few, length), length)
    if not opened.where(by_window).isEmpty():
        found = found.unionByName(_open_windows(docs, many, length))
    runs = (met.where(F.col("item").bitwiseAND(_SAME) != 0)
            .select("tkey", (F.shiftleft(F.shiftright("item", 24), 16) + F.shiftright("item", 15).bitwiseAND(511)).alias("run"))
            .unionByName(found.select("tkey", (F.shiftleft("first", 16) + F.col("more")).alias("run"))))
    return runs.groupBy("tkey").agg(F.collect_set("run").alias("runs"))


def cut(raw: bytes, runs: list[int], length: int = LENGTH) -> tuple[bytes, int]:
    """(what stays of raw, number of removed stretches)."""
    if not runs:
        return raw, 0
    kept, at, n, end = [], 0, 0, -1
    for x in sorted(runs):
        a, b = x >> 16, (x >> 16) + (x & 0xFFFF) + length
        if a > end:
            kept.append(raw[at:a])
            n += 1
        end = max(end, b)
        at = end
    kept.append(raw[at:])
    return b"".join(kept), n


def remove_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept), one row per document.

    Null texts are empty; texts under ``length`` bytes lose nothing; repeated
    rows of at least that length lose everything.  ``kept`` are the bytes
    that stay (they may split a character).  An empty table gives no rows.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.unhex(F.md5(text)).alias("tkey"), text.alias("text"))

    def run(batches):
        for b in batches:
            n_bytes, n_spans, kept = [], [], []
            for t, runs in zip(b.column(1), b.column(2)):
                raw = t.as_buffer().to_pybytes()
                rest, n = cut(raw, runs.as_py() or [], length)
                n_bytes.append(len(raw)), n_spans.append(n), kept.append(rest)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(n_bytes, pa.int64()), pa.array([x - len(y) for x, y in zip(n_bytes, kept)], pa.int64()),
                 pa.array(n_spans, pa.int64()), pa.array(kept, pa.binary())],
                names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])
    found = cut_lineage(duplicate_runs(src, length))
    return (src.join(found, "tkey", "left").select("doc_id", "text", "runs")
            .mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary"))
