"""SentencePiece encoding by sampling over the piece lattice, and decoding.

A text becomes a space plus the text, with spaces written as U+2581.  Its
lattice has an edge for each piece found at each place; a character without a
piece (and U+2581 in the text itself) has one edge of byte pieces, so that
decoding gives back every text.  The model holds merge ranks, not
probabilities; an edge weighs 1 / (rank + RANK_SHIFT), to the power ALPHA.

Forward filtering sums the weights of all ways to each place; backward
sampling then draws edges from the end.  No piece holds U+2581 after another
character, so a lattice falls apart into segments (spaces, then a word), and
filtering runs once per distinct segment, in numpy over all new segments of
a slice, and is kept for later slices up to a bound.  Each draw takes its random number from the row key and the place in
the text: neither batches nor tasks change the segmentation.
"""

from __future__ import annotations

import re
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mountwait.llm.common import give_back, mix64, slices

ALPHA = 1.0
RANK_SHIFT = 2.7
SEED = 20240
SLICE = 1 << 18
MAX_CHARS = 200_000
SPACE = "▁"
_GAMMA = np.uint64(0x9E3779B97F4A7C15)
_SEGMENT = re.compile(r" *[^ ]+| +")


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def read_pieces(path: str) -> tuple[dict[str, int], dict[int, int], pa.Array, np.ndarray]:
    """(text piece -> id, byte -> id, bytes of each id, scores) of a model."""
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    n = sp.get_piece_size()
    at_byte: dict[int, int] = {}
    raw: list[bytes] = [b""] * n
    text: dict[str, int] = {}
    for i in range(n):
        p = sp.id_to_piece(i)
        if sp.is_byte(i):
            at_byte[int(p[3:5], 16)] = i
            raw[i] = bytes([int(p[3:5], 16)])
        elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
            q = p.replace(SPACE, " ")
            text[q] = i
            raw[i] = q.encode()
    if len(at_byte) < 256:
        raise ValueError("the model has no byte pieces")
    if any(" " in q.lstrip(" ") for q in text):
        raise ValueError("a piece holds a space after another character")
    return text, at_byte, pa.array(raw, pa.large_binary()), np.array([sp.get_score(i) for i in range(n)])


class Pieces:
    """The vocabulary of a model: weights and a trie."""

    def __init__(self, path: str, alpha: float = ALPHA):
        text, self.bytes_at, _, scores = read_pieces(path)
        self.weight = (1.0 / (np.maximum(-scores, 0) + RANK_SHIFT)) ** alpha
        self.longest = max(map(len, text))
        own = self.weight[list(text.values())]
        self.byte_weight = float(own.min())
        # Chance weights differ by length only through a factor that cancels; this one keeps sums near one.
        self.scaled = (1.0 / float(np.median(own)) ** (1 / 3)) ** np.arange(self.longest + 1)
        self._trie(text)

    def _trie(self, text: dict[str, int]) -> None:
        """Nodes are the prefixes of pieces, those that grow first; node 0 is none.

        ``root`` leads from a character's class to a node; ``next`` from a
        growing node and a class to a node.  Classes of characters that stand
        second or later in a piece come first, so ``next`` stays narrow.
        """
        grows = sorted({q[:k] for q in text for k in range(1, len(q))})
        ends = sorted(set(text) - set(grows))
        node = {q: n for n, q in enumerate(grows + ends, 1)}
        later = sorted({c for q in text for c in q[1:]})
        chars = later + sorted({q[0] for q in text} - set(later))
        number = {c: n for n, c in enumerate(chars, 1)}
        self.class_of = np.zeros(0x110000, np.int32)
        self.class_of[[ord(c) for c in chars]] = np.arange(1, len(chars) + 1)
        self.n_grows, self.width = len(grows), len(later) + 1
        self.root = np.zeros(len(chars) + 1, np.int32)
        self.next = np.zeros((len(grows) + 1, self.width), np.int32 if len(node) > 0xFFFF else np.uint16)
        for q, n in node.items():
            if len(q) == 1:
                self.root[number[q]] = n
            else:
                self.next[node[q[:-1]], number[q[-1]]] = n
        self.next = self.next.ravel()
        every = [""] + grows + ends
        self.ids = np.fromiter((text.get(q, -1) for q in every), np.int32, len(every))
        self.node_weight = np.array([self.weight[i] * self.scaled[len(q)] if i >= 0 else 0.0
                                     for q, i in zip(every, self.ids)])


class Lattice:
    """Edges into every place of the given segments, with normalised cumulative chances.

    A place is the end of a character.  Places are ordered by their distance
    t from the segment's begin, then by segment, the longest first: all sums
    for one t come from one stretch of edges.  Place p has the edges first[p]
    .. first[p + 1]; an edge has a piece (-1: the character's bytes) and the
    place before it (-1: the segment's begin).
    """

    def __init__(self, pieces: Pieces, segments: list[str]):
        lengths = np.fromiter(map(len, segments), np.int64, len(segments))
        order = np.argsort(-lengths, kind="stable")
        size = lengths[order]
        codes = _codes("".join([segments[i] for i in order.tolist()]))
        n, longest = len(codes), int(size[0])
        off = np.r_[0, np.cumsum(len(size) - np.searchsorted(size[::-1], np.arange(1, longest + 1)))]  # places before t + 1
        row = np.repeat(np.arange(len(size), dtype=np.int32), size)
        begin = np.cumsum(size) - size
        t0 = (np.arange(n) - begin[row]).astype(np.int32)
        self.end = np.empty(len(size), np.int64)
        self.end[order] = off[size - 1] + np.arange(len(size))
        place = off[t0] + row  # of each character
        self.codes = np.empty(n, np.uint32)
        self.codes[place] = codes
        cls = pieces.class_of[codes]
        at = np.arange(n)
        node = pieces.root[cls]
        room = size[row] - t0
        counts = np.ones(n, np.int64)
        found = [(place, np.where(t0 > 0, off[t0 - 1] + row, -1), np.where(node > 0, pieces.ids[node], -1),
                  np.where((node > 0) & (pieces.ids[node] >= 0), pieces.node_weight[node],
                           pieces.byte_weight * pieces.scaled[1]))]
        for l in range(2, pieces.longest + 1):
            go = np.flatnonzero((node > 0) & (node <= pieces.n_grows) & (room[at] >= l))
            at, node = at[go], node[go]
            c = cls[at + l - 1]
            node = np.where(c < pieces.width, pieces.next[node * np.int64(pieces.width) + np.minimum(c, pieces.width - 1)], 0)
            some = np.flatnonzero(pieces.ids[node] >= 0)
            if len(some):
                s, m = at[some], node[some]
                p = place[s + l - 1]
                counts[p] += 1
                found.append((p, np.where(t0[s] > 0, off[t0[s] - 1] + row[s], -1), pieces.ids[m], pieces.node_weight[m]))
            if not len(at):
                break
        self.first = np.r_[0, np.cumsum(counts)]
        total = int(self.first[-1])
        self.prev, self.piece = np.empty(total, np.int32), np.empty(total, np.int32)
        weight = np.empty(total)
        fill = self.first[:-1].copy()
        for p, prev, piece, w in found:
            e = fill[p]
            self.prev[e], self.piece[e], weight[e] = prev, piece, w
            fill[p] += 1
        del found
        ways = np.empty(n + 1)
        ways[-1] = 1.0  # the begin of a segment
        self.cum = np.empty(total)
        for t in range(longest):
            a, b = int(off[t]), int(off[t + 1])
            cut = self.first[a:b + 1]
            e, f = int(cut[0]), int(cut[-1])
            w = weight[e:f] * ways[self.prev[e:f]]
            total = np.add.reduceat(w, cut[:-1] - e)
            ways[a:b] = total
            run = np.r_[0.0, np.cumsum(w / np.repeat(total, np.diff(cut)))]
            self.cum[e:f] = run[1:] - np.repeat(run[cut[:-1] - e], np.diff(cut))
            if t % 16 == 15 and (total.min() < 1e-100 or total.max() > 1e100):
                # Only ratios among the last places count: bring each segment's back to one.
                for k in range(max(0, t - pieces.longest), t + 1):
                    ways[off[k]:off[k] + b - a] /= total
        self.cum[self.first[1:] - 1] = 2.0  # the last edge takes what rounding leaves


class _Numbers(dict):
    """A number for each key, in order of first use."""

    def __missing__(self, key: str) -> int:
        n = self[key] = len(self)
        return n


class Lattices:
    """The lattices of segments seen so far, up to MAX_CHARS characters, then anew."""

    def __init__(self, pieces: Pieces):
        self.pieces = pieces
        self.clear()

    def clear(self) -> None:
        self.known = _Numbers()
        z = np.zeros
        self.codes, self.first, self.end, self.size = z(0, np.uint32), z(1, np.int32), z(0, np.int32), z(0, np.int32)
        self.cum, self.prev, self.piece = z(0), z(0, np.int32), z(0, np.int32)

    def numbers(self, found: list[list[str]]) -> np.ndarray:
        """The number of each segment of the texts, lattices made as needed."""
        if len(self.codes) > MAX_CHARS:
            self.clear()
        known, had = self.known, len(self.known)
        out = np.fromiter(map(known.__getitem__, chain.from_iterable(found)), np.int32)
        if len(known) > had:
            self._add(list(islice(known, had, None)))
        return out

    def _add(self, segments: list[str]) -> None:
        new = Lattice(self.pieces, segments)
        n, edges = len(self.codes), len(self.cum)
        new.prev[new.prev >= 0] += n
        new.first = (new.first[1:] + edges).astype(np.int32)
        new.end = (new.end + n).astype(np.int32)
        new.size = np.fromiter(map(len, segments), np.int32, len(segments))
        for name in ("first", "end", "size", "codes", "cum", "prev", "piece"):
            setattr(self, name, np.concatenate([getattr(self, name), getattr(new, name)]))


def sample(lat: Lattices, texts: list[str], seeds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ids, offsets): one sampled segmentation of each text."""
    pieces = lat.pieces
    found = [_SEGMENT.findall(" " + t) if t else [] for t in texts]
    counts = np.fromiter(map(len, found), np.int64, len(found))
    seg = lat.numbers(found)
    del found
    if not len(seg):
        return np.zeros(0, np.int32), np.zeros(len(texts) + 1, np.int64)
    doc = np.repeat(np.arange(len(texts)), counts)
    stop = np.cumsum(lat.size[seg], dtype=np.int64)
    base = np.r_[0, stop][np.cumsum(counts) - counts]  # characters before each text
    # The k-th draw of a segment takes the number of the character k before its end.
    random = seeds[doc] + (stop - base[doc]).astype(np.uint64) * _GAMMA
    live, place = np.arange(len(seg)), lat.end[seg]
    step_occ, step_edge = [], []
    while len(live):
        u = (mix64(random) >> np.uint64(11)) * 2.0 ** -53
        e = lat.first[place]
        more = np.flatnonzero(lat.cum[e] <= u)
        while len(more):
            e[more] += 1
            more = more[lat.cum[e[more]] <= u[more]]
        step_occ.append(live)
        step_edge.append(e)
        place = lat.prev[e]
        go = place >= 0
        live, place, random = live[go], place[go], random[go] - _GAMMA
    # Draws came from the end; number them back to front inside each segment, bytes spread out.
    occ, edge = np.concatenate(step_occ), np.concatenate(step_edge)
    piece = lat.piece[edge]
    width = np.ones(len(edge), np.int64)
    raw = np.flatnonzero(piece < 0)
    if len(raw):
        code = lat.codes[np.searchsorted(lat.first, edge[raw], "right") - 1]
        width[raw] = 1 + (code >= 0x80) + (code >= 0x800) + (code >= 0x10000)
    steps = np.bincount(occ, minlength=len(seg))
    n_round = np.concatenate([np.full(len(x), k) for k, x in enumerate(step_occ)])
    rank = (np.cumsum(steps) - 1)[occ] - n_round  # place of the draw in text order
    ordered_piece, ordered_width = np.empty(len(occ), np.int32), np.empty(len(occ), np.int64)
    ordered_piece[rank], ordered_width[rank] = piece, width
    out_at = np.cumsum(ordered_width) - ordered_width
    ids = np.empty(int(ordered_width.sum()), np.int32)
    plain = ordered_piece >= 0
    ids[out_at[plain]] = ordered_piece[plain]
    if len(raw):
        for r, c in zip(rank[raw].tolist(), code.tolist()):
            b = chr(c).encode()
            ids[out_at[r]:out_at[r] + len(b)] = [pieces.bytes_at[x] for x in b]
    doc_of = doc[np.repeat(np.arange(len(seg)), steps)]
    per = np.bincount(doc_of, weights=ordered_width, minlength=len(texts)).astype(np.int64)
    return ids, np.r_[0, np.cumsum(per)]


def decode_lists(raw: pa.Array, lists: pa.ListArray) -> pa.Array:
    """The texts of id lists: pieces joined, without the space put before a text."""
    joined = raw.take(lists.flatten())  # its buffer holds the pieces one after the other
    size = np.frombuffer(joined.buffers()[1], np.int64, len(joined) + 1, 8 * joined.offset)
    cut = size[lists.offsets.to_numpy() - lists.offsets[0].as_py()]
    data = joined.buffers()[2]
    texts = [data[a + 1:b].to_pybytes().decode() if b > a else "" for a, b in zip(cut[:-1].tolist(), cut[1:].tolist())]
    return pa.array(texts, pa.string(), mask=np.asarray(lists.is_null()))


_loaded: dict[tuple[str, float], Lattices] = {}


def load(path: str, alpha: float = ALPHA) -> Lattices:
    if (path, alpha) not in _loaded:
        _loaded[path, alpha] = Lattices(Pieces(path, alpha))
    return _loaded[path, alpha]


_raw: dict[str, pa.Array] = {}


def load_raw(path: str) -> pa.Array:
    """The bytes of each piece, all that decoding needs."""
    if path not in _raw:
        _raw[path] = read_pieces(path)[2]
    return _raw[path]


def seeds_of(keys: pa.Array, seed: int) -> np.ndarray:
    """Row seeds from 64-bit row keys; a null key counts as 0."""
    k = keys.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
    return mix64(mix64(k + _GAMMA) + np.uint64(seed))


def encode_sampled(docs: DataFrame, model_path: str, key_col: str = "doc_id", text_col: str = "text",
                   ids_col: str = "ids", alpha: float = ALPHA, seed: int = SEED) -> DataFrame:
    """docs with ``ids``: one sampled segmentation per row, fixed by row key and seed.

    Null and empty texts get an empty list; rows of equal key and text get
    equal ids; an existing column of the result's name is replaced.
    """
    rest = [c for c in docs.columns if c != ids_col]
    src = docs.select(*[docs[c] for c in rest])
    schema = T.StructType([*src.schema.fields, T.StructField(ids_col, T.ArrayType(T.IntegerType()))])

    def run(batches):
        lattices = load(model_path, alpha)
        for rows, data, off in slices(batches, text_col, SLICE):
            texts = [t or "" for t in rows.column(rows.schema.get_field_index(text_col)).to_pylist()]
            keys = rows.column(rows.schema.get_field_index(key_col)).cast(pa.int64())
            ids, at = sample(lattices, texts, seeds_of(keys, seed))
            col = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids))
            yield pa.RecordBatch.from_arrays([*rows.columns, col], names=[*rows.schema.names, ids_col])
        lattices.clear()
        give_back()
    return src.mapInArrow(run, schema)


def decode(encoded: DataFrame, model_path: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """encoded with the text that the ids give; a null list gives null."""
    rest = [c for c in encoded.columns if c != out_col]
    src = encoded.select(*[encoded[c] for c in rest])

    def run(batches):
        raw = load_raw(model_path)
        for b in batches:
            texts = decode_lists(raw, b.column(b.schema.get_field_index(ids_col)))
            yield pa.RecordBatch.from_arrays([*b.columns, texts], names=[*b.schema.names, out_col])
        give_back()
    return src.mapInArrow(run, T.StructType([*src.schema.fields, T.StructField(out_col, T.StringType())]))


def round_trip(docs: DataFrame, model_path: str, key_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_chars, n_tokens, ids_sha256, text_sha256, lossless) of encoding and decoding."""
    src = docs.select(F.col(key_col).cast("long").alias("doc_id"),
                      F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    both = decode(encode_sampled(src, model_path), model_path)
    return both.select(
        "doc_id", F.char_length("text").cast("long").alias("n_chars"), F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join("ids", ","), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("text_sha256"),
        (F.col("decoded") == F.col("text")).alias("lossless"))
