"""SimHash near-duplicates by a byte-position inverted index.

A fingerprint of 64 bits has 8 positional bytes.  Two fingerprints that
differ in at most 4 bits share at least 4 of them (the count filter).  The
index holds, for each choice of 4 byte positions, the bytes found there: a
pair whose tally of shared positional bytes reaches the minimum meets under
at least one entry, and a pair below it never meets.  Met pairs are verified
by their bit distance.

Equal fingerprints are one node, so copies never multiply links.  Under one
index entry only a spanning set of the verified links leaves the task (as
many as nodes at most, not all pairs): components, and hence ``component_id``,
are the same as with every link.  Components come from alternating
large-star / small-star rounds, each cut by a reliable checkpoint.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mountwait.llm.common import hot_cold_join, slices, word_spans
from mountwait.session import cut_lineage

SHINGLE = 4
MAX_BITS = 4
SEED = 42
BYTES = 8
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
HOT_ENTRY = 4096
BROADCAST_ENTRIES = 500_000  # hot entries, about 20 MB in a hash table
_SMALL = 24  # lists up to this length are linked as one matrix per length


def fingerprints(data: np.ndarray, off: np.ndarray, shingle: int = SHINGLE) -> np.ndarray:
    """One uint64 per text of a slice."""
    n_docs = len(off) - 1
    out = np.zeros(n_docs, np.uint64)
    start, end, doc = word_spans(data, off)
    if not len(start):
        return out
    # Words in lower case with one space after each.
    low = _LOWER[data]
    keep = np.zeros(len(low) + 1, bool)
    step = np.zeros(len(low) + 2, np.int8)
    step[start] += 1
    step[end] -= 1
    inside = np.cumsum(step[:-1], dtype=np.int8) > 0
    keep[:] = inside
    after = end[(end < len(low))]
    keep[after] = True
    low = np.append(low, np.uint8(32))
    low[~inside] = 32
    place = np.cumsum(keep) - keep
    text = low[keep].tobytes()
    s, e = place[start], place[end - 1] + 1
    n_words = np.bincount(doc, minlength=n_docs)
    base = np.cumsum(n_words) - n_words
    n_sh = np.where(n_words >= shingle, n_words - shingle + 1, (n_words > 0).astype(np.int64))
    total = int(n_sh.sum())
    first = np.cumsum(n_sh) - n_sh
    i = np.arange(total) - np.repeat(first, n_sh) + np.repeat(base, n_sh)
    j = np.minimum(i + shingle - 1, np.repeat(base + n_words - 1, n_sh))
    digest = xxhash.xxh64_intdigest
    h = np.fromiter((digest(text[a:b], SEED) for a, b in zip(s[i].tolist(), e[j].tolist())), np.uint64, total)
    full = np.flatnonzero(n_sh)
    bits = np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    ones = np.add.reduceat(bits, first[full], axis=0, dtype=np.int32)
    major = (2 * ones > n_sh[full][:, None])
    out[full] = np.packbits(major, axis=1, bitorder="little").view("<u8").ravel()
    return out


def with_fingerprint(docs: DataFrame, id_col: str, text_col: str, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, key, fp): key tells rows of one id with different texts apart."""
    def run(batches):
        for rows, data, off in slices(batches, "text"):
            fp = fingerprints(data, off, shingle).view(np.int64)
            yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array(fp)],
                                             names=["doc_id", "key", "fp"])
    text = F.col(text_col).cast("string")
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), row_key(text).alias("key"), text.alias("text"))
    return src.mapInArrow(run, "doc_id long, key long, fp long")


def row_key(text):
    return F.xxhash64(F.coalesce(text, F.lit("")))


def _star(values: np.ndarray, labels: np.ndarray, out: list) -> None:
    hit = labels != values
    if hit.any():
        out.append(np.stack([values[hit], labels[hit]], axis=1))


def _link_equal(lists: np.ndarray, max_bits: int, out: list) -> None:
    """Spanning links of many lists of one length, as one matrix."""
    step = max(1, (1 << 20) // (lists.shape[1] ** 2))
    for k in range(0, len(lists), step):
        v = lists[k:k + step]
        near = np.bitwise_count(v[:, :, None] ^ v[:, None, :]) <= max_bits
        lab = v.copy()
        while True:
            new = np.where(near, lab[:, None, :], np.uint64(np.iinfo(np.uint64).max)).min(axis=2)
            if (new == lab).all():
                break
            lab = new
        _star(v.ravel(), lab.ravel(), out)


def _link_long(v: np.ndarray, max_bits: int, out: list, block: int = 256) -> None:
    """Spanning links of one long list: waves from linked to not yet reached."""
    left = np.sort(v)
    while len(left):
        root, frontier, left = left[0], left[:1], left[1:]
        while len(frontier) and len(left):
            now, frontier = frontier[:block], frontier[block:]
            near = np.zeros(len(left), bool)
            for a in now:
                near |= np.bitwise_count(left ^ a) <= max_bits
            got = left[near]
            if len(got):
                out.append(np.stack([got, np.full(len(got), root)], axis=1))
                frontier, left = np.append(frontier, got), left[~near]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _bit_masks(max_bits: int) -> list[tuple[int, list[int]]]:
    """(mask of an entry's bytes, masks of these bytes with half of the other half bytes) per entry."""
    out = []
    for pos in combinations(range(BYTES), BYTES - max_bits):
        own = sum(0xFF << (8 * p) for p in pos)
        halves = [4 * h for h in range(2 * BYTES) if h // 2 not in pos]
        out.append((own, [own | sum(0xF << h for h in sub) for sub in combinations(halves, max_bits)]))
    return out


def _index(nodes: DataFrame, fp: str, max_bits: int, hot_entry: int) -> DataFrame:
    """(fs): the fingerprints under each entry that has two or more, long entries by their sub-entries."""
    spark = nodes.sparkSession
    masks = _bit_masks(max_bits)
    entries = nodes.select(F.col(fp).alias("f"), F.explode(F.array(*[
        F.struct(F.lit(n).cast("short").alias("n"), F.col(fp).bitwiseAND(F.lit(_signed(own))).alias("m"))
        for n, (own, _) in enumerate(masks)])).alias("e")).select("f", "e.n", "e.m")
    hot = cut_lineage(entries.groupBy("n", "m").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") > hot_entry)
                      .select("n", "m"))
    n_hot = hot.count()
    if n_hot <= BROADCAST_ENTRIES:
        hot = F.broadcast(hot)
    plain = entries.join(hot, ["n", "m"], "left_anti").groupBy("n", "m").agg(F.collect_list("f").alias("fs"))
    lists = plain.select("fs")
    if n_hot:
        subs = spark.createDataFrame([(n, [_signed(x) for x in sub]) for n, (_, sub) in enumerate(masks)],
                                     "n short, subs array<long>")  # one row per choice of bytes, 70 at most
        lists = lists.unionByName(
            entries.join(hot, ["n", "m"], "left_semi").join(F.broadcast(subs), "n")
            .select("n", "f", F.posexplode("subs").alias("k", "mask"))
            .groupBy("n", "k", F.col("f").bitwiseAND(F.col("mask")).alias("v")).agg(F.collect_list("f").alias("fs"))
            .select("fs"))
    return lists.where(F.size("fs") > 1)


def links(nodes: DataFrame, fp: str = "fp", max_bits: int = MAX_BITS, hot_entry: int = HOT_ENTRY) -> DataFrame:
    """(a, b) verified links, spanning under each index entry.

    ``nodes`` holds each fingerprint once.  With max_bits = 4 of 8 bytes the
    guaranteed minimum is 4 shared positional bytes.
    """
    if not 0 <= max_bits < BYTES:
        raise ValueError("max_bits must be from 0 to 7")
    index = _index(nodes, fp, max_bits, hot_entry)

    def run(batches):
        for b in batches:
            col = b.column(0)
            sizes = np.diff(col.offsets.to_numpy())
            values = col.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
            begin = np.cumsum(sizes) - sizes
            out: list = []
            for n in np.unique(sizes):
                rows = np.flatnonzero(sizes == n)
                if n <= _SMALL:
                    _link_equal(values[begin[rows][:, None] + np.arange(n)], max_bits, out)
                else:
                    for r in rows:
                        _link_long(values[begin[r]:begin[r] + n], max_bits, out)
            if out:
                ab = np.unique(np.concatenate(out), axis=0).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(ab[:, 0]), pa.array(ab[:, 1])], names=["a", "b"])
    return index.mapInArrow(run, "a long, b long").distinct()


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root): root is one member of the component, itself included.

    A node of very many links (the root of a large component) is joined by
    broadcast, so that no task gets all its links.  The smaller ends of one
    node's links stay few: one for each index entry that the node is in.
    """
    e = cut_lineage(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
                    .where("u <> v").distinct())
    state = e.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
    for _ in range(max_rounds):
        seen = state
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count(F.lit(1)).alias("degree"))
        large = hot_cold_join(both.where("v > u"), low, "u", "degree", 2 * seen[0])
        large = large.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .union(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct())
        e = cut_lineage(small)
        state = e.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
        if state == seen:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
    raise RuntimeError(f"components: no fixed point after {max_rounds} rounds")


def classes(prints: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """prints with component_id, the smallest doc_id of the component.

    Large components and fingerprints of very many copies are joined by broadcast (``hot_cold_join``).
    """
    nodes = cut_lineage(prints.groupBy("fp").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies")))
    n_rows, n_nodes = nodes.agg(F.coalesce(F.sum("copies"), F.lit(0)), F.count(F.lit(1))).first()
    # Nodes are narrow and grow by the index entry: deal them out by number, not by bytes.
    spread = nodes.repartition(int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions")), "fp")
    roots = components(links(spread, "fp", max_bits))
    rooted = cut_lineage(nodes.join(roots, nodes["fp"] == roots["node"], "left").select(
        "fp", "rep", "copies", F.coalesce("root", "fp").alias("root")))
    least = rooted.groupBy("root").agg(F.min("rep").alias("component_id"), F.count(F.lit(1)).alias("members"))
    known = cut_lineage(hot_cold_join(rooted, least, "root", "members", n_nodes)
                        .select("fp", "copies", "root", "component_id"))
    return hot_cold_join(prints, known, "fp", "copies", n_rows).drop("copies")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    shingle: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """(doc_id, key, fp, root, component_id), one row per document.

    Null and empty texts have fingerprint zero and link like any other;
    repeated rows are copies; null ids never are the smallest id (a component
    of null ids only has a null component_id); an empty table gives no rows.
    """
    return classes(cut_lineage(with_fingerprint(docs, id_col, text_col, shingle)), max_bits)


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
             shingle: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """docs with one row of each component: that of the smallest id (then key).

    All columns stay as they are.  The kept rows are chosen on narrow rows;
    the texts move once, to meet the chosen (id, key) pairs.
    """
    seen = near_duplicates(docs, id_col, text_col, shingle, max_bits)
    best = (seen.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", "key")).alias("b"))
            .select(F.coalesce("b.doc_id", F.lit(0)).alias("id"), F.col("b.no").alias("no"), F.col("b.key").alias("key")))
    # Rows that repeat in id and text: one stays, by partial aggregation before the shuffle.
    one = (docs.select(F.struct("*").alias("row"), F.coalesce(F.col(id_col).cast("long"), F.lit(0)).alias("id"),
                       F.col(id_col).isNull().alias("no"), row_key(F.col(text_col).cast("string")).alias("key"))
           .groupBy("id", "no", "key").agg(F.first("row").alias("row")))
    return one.join(best, ["id", "no", "key"], "left_semi").select("row.*")
