"""Benchmark decontamination by pigeonhole edit matching.

An item of n characters may be found with k = floor(ERROR_RATE * n) edits.
It is split into k + 1 pieces: whatever the k edits are, one piece stands in
the text unharmed.  An Aho-Corasick automaton finds every exact piece hit in
one pass over a text.  A hit is then verified bottom-up in a binary tree over
the pieces - a node of m pieces may have m - 1 edits, so most chance hits end
at a node of two pieces - by Myers' bit-parallel distance, which at the root
gives the edits of the whole item.

Pieces have the same width from an item's start on (the last takes what is left) and
the trees are aligned, so items that share a head share pieces and nodes.  A node
is one for all items that hold its text, and is verified once per place, and once per
text window, whichever pieces led there: hits of one diagonal merge.  Before that, the
part of the node that the hit does not cover must have enough of its 4-grams in the
window: each edit can spoil four of them.  So an item that only shares a head costs
a set operation.

Items and texts are compared in lower case with runs of white space as one
space.  Items go to the tasks in blocks of at most BLOCK_CHARS characters,
each block one pass over the texts, so nothing sent grows with the items.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mountwait.llm.common import give_back

ERROR_RATE = 0.1
BLOCK_CHARS = 2 << 20
GRAM = 4
KEPT_GRAMS = 50_000  # sets kept, a few MB for usual items


def normal(text: str | None) -> str:
    return " ".join((text or "").lower().split())


def myers(pattern: str, text: str, limit: int, peq: dict[str, int] | None = None) -> tuple[int, int]:
    """(least edits, end) of pattern against any part of text; limit + 1 if above limit."""
    n = len(pattern)
    if peq is None:
        peq = masks(pattern)
    top, full = 1 << (n - 1), (1 << n) - 1
    pv, mv, score = full, 0, n
    best, at = limit + 1, -1
    get = peq.get
    for j, c in enumerate(text):
        eq = get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | ~(xh | pv)
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph = (ph << 1) & full
        mh = (mh << 1) & full
        pv = (mh | ~(xv | ph)) & full
        mv = ph & xv
        if score < best:
            best, at = score, j + 1
            if not best:
                break
    return best, at


def masks(pattern: str) -> dict[str, int]:
    out: dict[str, int] = defaultdict(int)
    for i, c in enumerate(pattern):
        out[c] |= 1 << i
    return dict(out)


def grams_of(text: str) -> set[str]:
    return {text[i:i + GRAM] for i in range(len(text) - GRAM + 1)}


class Node:
    """A run of pieces, the same for all items that hold it."""
    __slots__ = ("text", "edits", "peq", "above", "items")

    def __init__(self, text: str, edits: int):
        self.text, self.edits, self.peq = text, edits, None
        self.above: dict[tuple[Node, int], None] = {}  # (node of more pieces, where this one starts in it)
        self.items: list[int] = []  # items that are this node

    def distance(self, window: str) -> int:
        if self.peq is None:
            self.peq = masks(self.text)
        return myers(self.text, window, self.edits, self.peq)[0]


class Matcher:
    def __init__(self, items: list[tuple[object, str]], rate: float = ERROR_RATE):
        self.keys = [k for k, _ in items]
        self._nodes: dict[tuple[str, int], Node] = {}
        self._grams: dict[tuple[Node, Node, int], set[str]] = {}
        leaves: dict[str, Node] = {}
        for number, (_, text) in enumerate(items):
            root, pieces = self._tree(text, min(int(len(text) * rate), max(len(text) - 1, 0)) + 1)
            root.items.append(number)
            leaves.update((n.text, n) for n in pieces)
        self.auto = ahocorasick.Automaton()
        for w, node in leaves.items():
            self.auto.add_word(w, (len(w), node))
        self.auto.make_automaton()

    def _node(self, text: str, edits: int) -> Node:
        if (n := self._nodes.get((text, edits))) is None:
            n = self._nodes[text, edits] = Node(text, edits)
        return n

    def _tree(self, text: str, m: int) -> tuple[Node, list[Node]]:
        """(root, pieces) of an item in m pieces."""
        width = len(text) // m
        cuts = [width * j for j in range(m)] + [len(text)]
        level = [(j, j + 1, self._node(text[cuts[j]:cuts[j + 1]], 0)) for j in range(m)]
        pieces = [n for _, _, n in level]
        while len(level) > 1:
            up = []
            for i in range(0, len(level) - 1, 2):
                (a, mid, left), (_, b, right) = level[i], level[i + 1]
                node = self._node(text[cuts[a]:cuts[b]], b - a - 1)
                left.above[node, 0] = right.above[node, cuts[mid] - cuts[a]] = None
                up.append((a, b, node))
            level = up + level[2 * len(up):]
        return level[0][2], pieces

    def _rest(self, node: Node, up: Node, begin: int) -> set[str]:
        """4-grams of ``up`` beside its part ``node``; kept for the nodes in use."""
        key = node, up, begin
        if (out := self._grams.get(key)) is None:
            if len(self._grams) > KEPT_GRAMS:
                self._grams.clear()
            out = self._grams[key] = grams_of(up.text[:begin] if begin else up.text[len(node.text):])
        return out

    def find(self, text: str, first: bool = False) -> dict[int, int]:
        """item number -> least edits found; with ``first``, any one item."""
        out: dict[int, int] = {}
        seen: set[tuple[Node, int]] = set()
        known: dict[tuple[Node, str], int] = {}
        grams: dict[tuple[int, int], set[str]] = {}
        for end, (width, leaf) in self.auto.iter(text):
            work = [(leaf, end + 1 - width, 0)]
            while work:
                node, start, edits = work.pop()
                for n in node.items:
                    if edits < out.get(n, edits + 1):
                        out[n] = edits
                        if first:
                            return out
                for place in node.above:
                    up, begin = place[0], start - place[1]
                    if (up, begin) in seen:
                        continue
                    seen.add((up, begin))
                    lo, hi = max(0, begin - up.edits), max(0, begin + len(up.text) + up.edits)
                    if (here := grams.get((lo, hi))) is None:
                        here = grams[lo, hi] = grams_of(text[lo:hi])
                    rest = self._rest(node, *place)
                    if len(rest) - len(rest & here) > GRAM * up.edits:
                        continue
                    window = text[lo:hi]
                    if (d := known.get((up, window))) is None:
                        d = known[up, window] = up.distance(window)
                    if d <= up.edits:
                        work.append((up, begin, d))
        return out


def blocks(items: DataFrame, id_col: str, text_col: str, bound: int = BLOCK_CHARS) -> Iterator[list[tuple[object, str]]]:
    """Distinct normalised items in blocks of bounded size; items without text are left out."""
    rows = (items.select(F.col(id_col).alias("k"), F.col(text_col).cast("string").alias("t"))
            .where("t is not null").distinct().orderBy("k", "t"))
    block, size = [], 0
    for r in rows.toLocalIterator():
        t = normal(r.t)
        if not t:
            continue
        if block and size + len(t) > bound:
            yield block
            block, size = [], 0
        block.append((r.k, t))
        size += len(t)
    if block:
        yield block


_cache: dict[tuple, Matcher] = {}


def _matcher(block: list[tuple[object, str]], rate: float) -> Matcher:
    """One automaton per worker for the block in use."""
    key = (rate, hash(tuple(block)))
    if key not in _cache:
        _cache.clear()
        _cache[key] = Matcher(block, rate)
    return _cache[key]


def contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 item_col: str = "item_id", item_text_col: str = "text", rate: float = ERROR_RATE) -> DataFrame:
    """(doc_id, item_id, distance): every document that holds an item, and the item.

    Null or empty texts hold nothing; null or blank items match nothing; an
    item shorter than 1 / rate characters must occur exactly.  Rows repeat as
    the documents do; equal items under several ids are reported under each.
    """
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    out = None
    for block in blocks(items, item_col, item_text_col):
        def run(batches, block=block):
            m = _matcher(block, rate)
            for b in batches:
                ids, keys, dist = [], [], []
                for i, t in zip(b.column(0).to_pylist(), b.column(1)):
                    for n, d in m.find(normal(t.as_py())).items():
                        ids.append(i)
                        keys.append(m.keys[n])
                        dist.append(d)
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(keys, pa.int64()),
                                                  pa.array(dist, pa.int32())], names=["doc_id", "item_id", "distance"])
            give_back()
        part = src.mapInArrow(run, "doc_id long, item_id long, distance int")
        out = part if out is None else out.unionByName(part)
    if out is None:
        return src.select("doc_id", F.lit(0).cast("long").alias("item_id"), F.lit(0).alias("distance")).where("false")
    return out


def keep_clean(docs: DataFrame, items: DataFrame, text_col: str = "text", item_col: str = "item_id",
               item_text_col: str = "text", rate: float = ERROR_RATE) -> DataFrame:
    """docs without those that hold an item; all columns as they are."""
    out = docs
    for block in blocks(items, item_col, item_text_col):
        def run(batches, block=block):
            m = _matcher(block, rate)
            for b in batches:
                texts = b.column(b.schema.get_field_index(text_col))
                yield b.filter(pa.array([not m.find(normal(t.as_py()), first=True) for t in texts], pa.bool_()))
            give_back()
        out = out.mapInArrow(run, docs.schema)
    return out
