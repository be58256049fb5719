"""Prefix trie of conversations by truncation peeling.

A node is a distinct sequence of first turns.  Turns are named by a 128-bit
digest of role and text, so a conversation is a path: a string of digests.

1. Each conversation's turns are gathered with those of its family (the five
   ids that share a base), rebuilt and turned into a path.  A conversation is one
   row, 24 bytes a turn.
2. Equal paths become one class with its number of conversations and smallest id.
   Ids are gathered in ranges of 65,536 and hashed in ascending order as a
   stream, so a class of any size never stands whole in memory.
3. Classes are range-partitioned and sorted by path, and each learns how many turns
   it shares with the paths before and after it.  Across two tasks' ends this is
   settled on the first and last row of each task (two rows a task).
4. Peeling, per block of sorted paths, from the greatest depth up: newly ended
   classes join the nodes that survive from below, runs that share their first d
   turns merge into the nodes of depth d, their counts are emitted, the last turn is
   stripped, and what is left is regrouped one level up.  One pass discovers
   the nodes and adds up their subtrees.
5. Blocks send partial nodes, which one aggregate merges.  All sums are whole in
   parts: a node counts as new only for the one class, in the order of paths, that
   has it first, so nodes that blocks share are never counted twice.  Hot prefixes
   therefore split like any others.
6. A node takes its parent's id by a join in which nodes of very many children are
   broadcast (see ``hot_cold_join``).

Defined results: null roles and texts are empty; turns are ordered by number, null
first, equal numbers by digest; repeated rows are turns of their own.  Rows without conv_id
are left out.  Remainders of negative ids are those of SQL.  An empty table gives no
rows.  Other columns are not read.  The ids that end in one node are hashed by one task,
as SHA-256 has no parallel form; it sees one row per 65,536 ids.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mountwait.llm.common import batch_of, give_back, hot_cold_join, mix64, written

FAMILY = 5
HEADS = 9
ID_BITS = 16  # ids of one class are gathered in ranges of 2**16
BLOCK_TURNS = 200_000  # turns peeled at a time; a longer path is a block of its own
DIGEST = 16

NO_ENDS = hashlib.sha256(b"").hexdigest()


def rebuilt(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
            text_col: str = "text", family: int = FAMILY, heads: int = HEADS) -> DataFrame:
    """(conv_id, path, lens): each conversation with the head of its family's base."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    named = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    rows = turns.where(F.col(conv_col).isNotNull()).select(
        F.col(conv_col).cast("long").alias("c"), F.col(turn_col).alias("t"),
        F.substring(F.sha2(named, 256), 1, 2 * DIGEST).alias("d"), F.octet_length(text).cast("long").alias("n"))
    kin = rows.groupBy((F.col("c") - F.col("c") % family).alias("base")).agg(
        F.sort_array(F.collect_list(F.struct("c", "t", "d", "n"))).alias("rows"))
    each = kin.select("base", "rows", F.explode(F.array_distinct(F.transform("rows", lambda x: x["c"]))).alias("conv_id"))
    each = each.select(
        "conv_id", F.filter("rows", lambda x: x["c"] == F.col("conv_id")).alias("own"),
        F.filter("rows", lambda x: x["c"] == F.col("base")).alias("head"),
        (F.crc32(F.col("conv_id").cast("string")) % heads).cast("int").alias("h"))
    each = each.select("conv_id", F.expr("concat(slice(head, 1, h), slice(own, h + 1, size(own)))").alias("p"))
    return each.select("conv_id", F.unhex(F.array_join(F.transform("p", lambda x: x["d"]), "")).alias("path"),
                       F.transform("p", lambda x: x["n"]).alias("lens"))


# ------------------------------------------------------------------ classes
_CLASS = pa.schema([("ck", pa.binary()), ("path", pa.binary()), ("lens", pa.list_(pa.int64())),
                    ("conv_id", pa.int64()), ("n", pa.int64()), ("ends", pa.string())])
_CLASS_SQL = "ck binary, path binary, lens array<long>, conv_id long, n long, ends string"


def _merge_chunks(batches: Iterator[pa.RecordBatch]):
    """One row per class from its id ranges in order: the ids are hashed as a stream."""
    key, count, digest, held = None, 0, None, None

    def out(first: list, done: list):
        rows = pa.Table.from_batches(first).combine_chunks().to_batches()[0]
        return batch_of(_CLASS, *(rows.column(rows.schema.get_field_index(c)) for c in ("ck", "path", "lens", "conv_id")),
                        [n for n, _ in done], [h for _, h in done])
    for b in batches:
        starts, done = [], []
        cks, counts, ids = (b.column(b.schema.get_field_index(c)).to_pylist() for c in ("ck", "n", "ids"))
        for i, (k, n, text) in enumerate(zip(cks, counts, ids)):
            if k == key:
                count += n
                digest.update(b"," + text.encode())
                continue
            if key is not None:
                done.append((count, digest.hexdigest()))
            key, count, digest = k, n, hashlib.sha256(text.encode())
            starts.append(i)
        if not starts:
            continue
        first = ([held] if held is not None else []) + [b.take(pa.array(starts[:-1], pa.int64()))]
        held = b.take(pa.array(starts[-1:], pa.int64()))
        if done:
            yield out(first, done)
    if held is not None:
        yield out([held], [(count, digest.hexdigest())])
    give_back()


def classes(convs: DataFrame) -> DataFrame:
    """One row per distinct path: ck (its digest), path, lens, smallest conv_id, n, ends (digest of all ids)."""
    keyed = convs.select("*", F.unhex(F.substring(F.sha2("path", 256), 1, 2 * DIGEST)).alias("ck"),
                         F.shiftright("conv_id", ID_BITS).alias("part"))
    chunks = keyed.groupBy("ck", "part").agg(
        F.first("path").alias("path"), F.first("lens").alias("lens"), F.min("conv_id").alias("conv_id"),
        F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_list("conv_id")).alias("ids"))
    chunks = chunks.withColumn("ids", F.array_join(F.transform("ids", lambda x: x.cast("string")), ","))
    return (chunks.repartition("ck").sortWithinPartitions("ck", "part")
            .mapInArrow(_merge_chunks, _CLASS_SQL))


# ------------------------------------------------------- shared turns of neighbours
def _digests(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(digests as pairs of integers, offsets in turns) of a column of paths."""
    col = col.cast(pa.large_binary())
    if not len(col):
        return np.zeros((0, 2), np.uint64), np.zeros(1, np.int64)
    off = np.frombuffer(col.buffers()[1], np.int64)[col.offset:col.offset + len(col) + 1]
    raw = col.buffers()[2].to_pybytes()[off[0]:off[-1]] if off[-1] > off[0] else b""
    return np.frombuffer(raw, np.uint64).reshape(-1, 2), (off - off[0]) // DIGEST


def shared(d: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Turns that each path shares with the one before it (the first: -1)."""
    size = np.diff(off)
    out = np.zeros(len(size), np.int64)
    at, k = np.arange(1, len(size)), 0
    while len(at):
        at = at[np.minimum(size[at - 1], size[at]) > k]
        at = at[(d[off[at] + k] == d[off[at - 1] + k]).all(axis=1)]
        k += 1
        out[at] = k
    out[:1] = -1
    return out


def _neighbours(path_at: int, edges: tuple[int | None, int | None]):
    """Appends ``before`` and ``after``: turns shared with the neighbours in this
    partition's order; at its two ends the values of ``edges``."""
    def run(batches: Iterator[pa.RecordBatch]):
        held, before = None, None

        def out(rows: pa.Table, prev: np.ndarray, nxt: list):
            rows = rows.combine_chunks()
            cols = [c.chunk(0) if c.num_chunks else pa.array([], c.type) for c in rows.columns]
            return pa.RecordBatch.from_arrays(
                cols + [pa.array([edges[0] if x < 0 else int(x) for x in prev], pa.int32()), pa.array(nxt, pa.int32())],
                names=rows.column_names + ["before", "after"])
        for b in batches:
            if not b.num_rows:
                continue
            rows = pa.Table.from_batches([b] if held is None else [held, b]).combine_chunks()
            lcp = shared(*_digests(rows.column(path_at).chunk(0)))
            if held is not None:
                lcp[0] = before
            if rows.num_rows > 1:
                yield out(rows.slice(0, rows.num_rows - 1), lcp[:-1], lcp[1:].tolist())
            held, before = rows.slice(rows.num_rows - 1).combine_chunks().to_batches()[0], lcp[-1]
        if held is not None:
            yield out(pa.Table.from_batches([held]), np.array([before]), [edges[1]])
        give_back()
    return run


def ordered(cls: DataFrame) -> DataFrame:
    """Classes in the order of their paths, with the turns shared ``before`` and ``after``."""
    lines = written(cls.repartitionByRange("path").sortWithinPartitions("path")
                    .mapInArrow(_neighbours(1, (None, None)), _CLASS_SQL + ", before int, after int"), "paths")
    ends = lines.where("before is null or after is null").select("ck", "path")
    # the first and last row of each task, nothing else; the very last path is a leaf at any length
    seams = (ends.repartition(1).sortWithinPartitions("path")
             .mapInArrow(_neighbours(1, (0, -1)), "ck binary, path binary, before int, after int")
             .select("ck", F.col("before").alias("b2"), F.col("after").alias("a2")))
    return lines.join(F.broadcast(seams), "ck", "left").select(
        "path", "lens", "conv_id", "n", "ends", F.coalesce("before", "b2").alias("before"),
        F.coalesce("after", "a2").alias("after"))


# ------------------------------------------------------------------ peeling
_NODE = pa.schema([("node", pa.binary()), ("parent", pa.binary()), ("depth", pa.int64()), ("conv_id", pa.int64()),
                   ("n_convs", pa.int64()), ("n_children", pa.int64()), ("n_leaves", pa.int64()),
                   ("saved", pa.int64()), ("ends", pa.string())])
_NODE_SQL = ("node binary, parent binary, depth long, conv_id long, n_convs long, n_children long, n_leaves long, "
             "saved long, ends string")


def _keys(d: np.ndarray, off: np.ndarray) -> np.ndarray:
    """128-bit key of each path's first 1, 2, ... turns, beside the turns."""
    out = np.zeros_like(d)
    size = np.diff(off)
    at, k = np.flatnonzero(size > 0), 0
    prev = np.zeros((len(size), 2), np.uint64)
    while len(at):
        here = off[at] + k
        a = mix64(prev[at, 0] * np.uint64(0x9E3779B97F4A7C15) + d[here, 0])
        b = mix64((prev[at, 1] ^ np.uint64(0xBF58476D1CE4E5B9)) * np.uint64(0xD6E8FEB86659FD93) + d[here, 1] + a)
        out[here, 0], out[here, 1] = a, b
        prev[at] = out[here]
        k += 1
        at = at[size[at] > k]
    return out


def peel(d: np.ndarray, off: np.ndarray, lens: np.ndarray, conv: np.ndarray, n: np.ndarray,
         before: np.ndarray, leaf: np.ndarray) -> list[tuple]:
    """Partial nodes of a block of paths, deepest first.

    Each entry holds one depth: (depth, first rows, smallest ids, conversations, new children,
    leaves, saved, row that ends here or -1).
    """
    local = shared(d, off)
    size = np.diff(off)
    by_size = np.argsort(-size, kind="stable")
    cuts = np.searchsorted(-size[by_size], -np.arange(size.max() + 2), "left") if len(size) else [0]
    z = np.zeros(0, np.int64)
    # surviving nodes: first row, smallest id, conversations, new, leaves, saved, least ``before``
    at, cid, cnt, new, leaves, saved, least = (z,) * 7
    out = []
    for depth in range(int(size.max()) if len(size) else -1, -1, -1):
        ended = by_size[cuts[depth]:cuts[depth - 1] if depth else len(by_size)]
        k = len(ended)
        at = np.r_[at, ended]
        turn = np.argsort(at, kind="stable")
        at = at[turn]
        first = np.flatnonzero(local[at] < depth) if depth else np.zeros(1, np.int64)
        first = first if len(first) and first[0] == 0 else np.r_[0, first]

        def total(kept, added, op=np.add):
            return op.reduceat(np.r_[kept, added][turn], first)
        none = np.zeros(k, np.int64)
        ends = total(np.full(len(at) - k, -1), ended, np.maximum)
        cid, cnt = total(cid, conv[ended], np.minimum), total(cnt, n[ended])
        children, leaves = total(new, none), total(leaves, leaf[ended])
        saved, least = total(saved, none), total(least, before[ended], np.minimum)
        at = at[first]
        new = (least < depth).astype(np.int64)
        if depth:
            saved = saved + (cnt - new) * lens[off[at] + depth - 1]
        out.append((depth, at, cid, cnt, children, leaves, saved, ends))
    return out


def _peel_blocks(batches: Iterator[pa.RecordBatch]):
    def block(rows: pa.Table):
        rows = rows.combine_chunks().to_batches()[0]
        col = {name: rows.column(i) for i, name in enumerate(rows.schema.names)}
        d, off = _digests(col["path"])
        lens = col["lens"].flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        num = {c: col[c].to_numpy(zero_copy_only=False).astype(np.int64) for c in ("conv_id", "n", "before", "after")}
        levels = peel(d, off, lens, num["conv_id"], num["n"], num["before"],
                      (num["after"] < np.diff(off)).astype(np.int64))
        keys = _keys(d, off)
        ends = col["ends"].to_pylist()
        for depth, at, cid, cnt, children, leaves, saved, end in levels:
            own = keys[off[at] + depth - 1] if depth else np.zeros((len(at), 2), np.uint64)
            up = keys[off[at] + depth - 2] if depth > 1 else np.zeros((len(at), 2), np.uint64)
            yield batch_of(_NODE, [x.tobytes() for x in own], [x.tobytes() if depth else None for x in up],
                           np.full(len(at), depth), cid, cnt, children, leaves, saved,
                           [ends[i] if i >= 0 else None for i in end])

    def joined(rows: pa.Table):
        got = list(block(rows))
        return pa.Table.from_batches(got).combine_chunks().to_batches()[0]
    held, turns = [], 0
    for b in batches:
        if not b.num_rows:
            continue
        held.append(b)
        turns += len(b.column(b.schema.get_field_index("lens")).flatten()) + b.num_rows
        if turns >= BLOCK_TURNS:
            yield joined(pa.Table.from_batches(held))
            held, turns = [], 0
    if held:
        yield joined(pa.Table.from_batches(held))
    give_back()


def nodes(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
          text_col: str = "text", family: int = FAMILY, heads: int = HEADS) -> DataFrame:
    """One row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256, and the binary keys ``node`` and ``parent``."""
    convs = rebuilt(turns, conv_col, turn_col, role_col, text_col, family, heads)
    parts = ordered(written(classes(convs), "classes")).mapInArrow(_peel_blocks, _NODE_SQL)
    found = written(parts.groupBy("node").agg(
        F.first("parent").alias("parent"), F.first("depth").alias("depth"), F.min("conv_id").alias("conv_id"),
        *(F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved")),
        F.max("ends").alias("ends")), "nodes")
    above = found.where("n_children > 0").select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"),
                                                 F.col("n_children").alias("weight"))
    out = hot_cold_join(found, above, "parent", "weight", found.count(), skip=F.col("parent").isNull())
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves",
                      F.col("saved").alias("saved_tokens"), F.coalesce("ends", F.lit(NO_ENDS)).alias("ends_sha256"),
                      "node", "parent")
