"""Token counts by a compiled finite-state transducer.

The tokenizer (byte-pair merges by rank over SentencePiece pieces, byte
pieces for characters without one) is compiled into a deterministic
transducer that reads a text character by character.  Its state keeps what
the future can depend on: the starts from which a piece may still grow, with
the last token before each and the token count there.  A transition is
annotated with the emitted-token count: how many tokens the text has more
after this character.  The last token after a character is the one piece
ending there that may follow the last token before it; a pair of tokens may
stand side by side if merging their characters would give just this pair.
States and transitions are compiled when first reached and kept up to a
bound, then compiled anew.

A space after another character always starts afresh, whatever the state.
So the state map of a chunk of text needs little: the characters before its
first such place (whose effect depends on the state that comes in), the
tokens between, and the state after its last.  Maps compose associatively;
the maps of a text's chunks are joined by a parallel prefix scan, and a
whole text's count is the last prefix applied to the start state.  The scan's
upward sweep gives that prefix; heads are kept as lists of parts of the text, so
memory grows with the text, also where it has no space at all.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPACE = "▁"
CHUNK = 1 << 16
MAX_STATES = 200_000
MAX_WORDS = 300_000
LIMIT = 4096
_SEGMENT = re.compile("▁+[^▁]*")


class Transducer:
    def __init__(self, path: str):
        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        special = lambda i: sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)
        rank = {sp.id_to_piece(i): -sp.get_score(i) for i in range(sp.get_piece_size()) if not special(i)}
        if any(SPACE in p.lstrip(SPACE) for p in rank):
            raise ValueError("a piece holds a space after another character")
        # Characters are there from the start; the others are formed in order of rank.
        self.order = {p: (-1.0 if len(p) == 1 else r) for p, r in rank.items()}
        self.split: dict[str, tuple[str, str]] = {}
        for p in rank:
            if len(p) > 1:
                parts = self._merge(p)
                if parts:
                    self.split[p] = parts
        self.pieces = {p for p in rank if len(p) == 1} | set(self.split)
        self.grows = {p[:k] for p in self.pieces for k in range(1, len(p))}
        self.pairs: dict[tuple[str, str], bool] = {}
        self._reset()

    def _reset(self) -> None:
        self.number: dict[tuple, int] = {}
        self.keys: list[tuple] = []
        self.trans: list[dict[str, tuple[int, int]]] = []
        self.start = self._state(("", ((0, None, 0),)))
        self.words: dict[str, int] = {}

    def _merge(self, text: str) -> tuple[str, str] | None:
        """The last merge that makes a piece of its characters; None if merging stops before."""
        parts, last = list(text), None
        while len(parts) > 1:
            best, at = None, -1
            for k in range(len(parts) - 1):
                r = self.order.get(parts[k] + parts[k + 1])
                if r is not None and (best is None or r < best):
                    best, at = r, k
            if best is None:
                return None
            last = parts[at], parts[at + 1]
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
        return last

    def follows(self, a: str | None, b: str) -> bool:
        """Whether token b may stand after token a (None: a fresh start)."""
        if a is None:
            return True
        known = self.pairs.get((a, b))
        if known is None:
            if len(self.pairs) > 4 * MAX_STATES:
                self.pairs.clear()
            known = self.pairs[a, b] = self._follows(a, b)
        return known

    def _follows(self, a: str, b: str) -> bool:
        """Undo the merges of both, the latest first: none across may come before one undone."""
        limit = float("inf")
        order = self.order
        while True:
            across = order.get(a + b)
            if across is not None and across < limit:
                return False
            ra, rb = order[a], order[b]
            if ra < 0 and rb < 0:
                return True
            if ra > rb:  # of equal ranks the left is merged first
                limit, a = ra, self.split[a][1]
            else:
                limit, b = rb + 0.5, self.split[b][0]

    def _state(self, key: tuple) -> int:
        n = self.number.get(key)
        if n is None:
            n = self.number[key] = len(self.keys)
            self.keys.append(key)
            self.trans.append({})
        return n

    def step(self, state: int, c: str) -> tuple[int, int]:
        """(next state, emitted tokens), compiled when first taken."""
        known = self.trans[state].get(c)
        if known is None:
            known = self.trans[state][c] = self._compile(self.keys[state], c)
        return known

    def _compile(self, key: tuple, c: str) -> tuple[int, int]:
        text, starts = key
        if c == SPACE and text[-1:] != SPACE and text != "":
            key = text, starts = "", ((0, None, 0),)
        if c not in self.pieces:
            return self._state(("", ((0, None, 0),))), len(c.encode())
        grown = text + c
        for back, last, before in starts:  # the longest start first; one of them fits
            piece = grown[len(grown) - back - 1:]
            if piece in self.pieces and self.follows(last, piece):
                emitted = before + 1
                break
        else:
            raise AssertionError(f"no token ends after {grown!r}")
        left = [(back + 1, last, before - emitted) for back, last, before in starts
                if grown[len(grown) - back - 1:] in self.grows]
        left.append((0, piece, 0))
        return self._state((grown[len(grown) - max(left[0][0], 1):], tuple(left))), emitted

    def run(self, state: int, text: str) -> tuple[int, int]:
        total, trans = 0, self.trans
        for c in text:
            known = trans[state].get(c)
            if known is None:
                known = self.step(state, c)
            state = known[0]
            total += known[1]
        return state, total

    def word(self, segment: str) -> int:
        """Tokens of a segment read from the start state."""
        n = self.words.get(segment)
        if n is None:
            n = self.run(self.start, segment)[1]
            if len(segment) <= 64:
                self.words[segment] = n
        return n

    def rest(self) -> None:
        """Between texts: drop what was compiled where it has grown past its bound."""
        if len(self.words) > MAX_WORDS:
            self.words.clear()
        if len(self.keys) > MAX_STATES:
            self._reset()


@dataclass(frozen=True)
class ChunkMap:
    """State map of a chunk: state -> (state, tokens).

    ``head`` is read from the state that comes in; where ``tail`` is not None
    the chunk has a fresh start after it, ``count`` tokens up to its end, and
    leaves in state ``tail`` whatever came in.
    """

    head: tuple[str, ...]
    count: int
    tail: int | None

    def apply(self, t: Transducer, state: int) -> tuple[int, int]:
        out, n = _run(t, state, self.head)
        return (out, n) if self.tail is None else (self.tail, n + self.count)


def _run(t: Transducer, state: int, parts: tuple[str, ...]) -> tuple[int, int]:
    total = 0
    for p in parts:
        state, n = t.run(state, p)
        total += n
    return state, total


def chunk_map(t: Transducer, chunk: str) -> ChunkMap:
    first = chunk.find(SPACE)
    # A space at the very start may follow another space, so it belongs to the head.
    while first == 0 or first > 0 and chunk[first - 1] == SPACE:
        first = chunk.find(SPACE, first + 1)
    if first < 0:
        return ChunkMap((chunk,), 0, None)
    segments = _SEGMENT.findall(chunk, first)
    last = segments.pop()
    word, known = t.word, t.words
    count = 0
    for s in segments:
        n = known.get(s)
        count += word(s) if n is None else n
    tail, n = t.run(t.start, last)
    return ChunkMap((chunk[:first],) if first else (), count + n, tail)


def compose(t: Transducer, a: ChunkMap, b: ChunkMap) -> ChunkMap:
    if a.tail is None:
        return ChunkMap(a.head + b.head, b.count, b.tail)
    state, n = _run(t, a.tail, b.head)
    if b.tail is None:
        return ChunkMap(a.head, a.count + n, state)
    return ChunkMap(a.head, a.count + n + b.count, b.tail)


def up_sweep(t: Transducer, maps: list[ChunkMap]) -> list[list[ChunkMap]]:
    """The levels of the scan's tree: neighbours composed in pairs, up to the map of all chunks."""
    levels = [list(maps)]
    while len(levels[-1]) > 1:
        row = levels[-1]
        levels.append([compose(t, row[i], row[i + 1]) if i + 1 < len(row) else row[i] for i in range(0, len(row), 2)])
    return levels


def prefix_scan(t: Transducer, maps: list[ChunkMap]) -> list[ChunkMap]:
    """All prefixes: up the tree, then down, with independent compositions on each level."""
    levels = up_sweep(t, maps)
    out = levels[-1]
    for row in reversed(levels[:-1]):
        out = [out[i // 2] if i % 2 else compose(t, out[i // 2 - 1], m) if i else m for i, m in enumerate(row)]
    return out


def count_tokens(t: Transducer, text: str, chunk: int = CHUNK) -> int:
    if not text:
        return 0
    text = SPACE + text.replace(" ", SPACE)
    maps = [chunk_map(t, text[k:k + chunk]) for k in range(0, len(text), chunk)]
    return up_sweep(t, maps)[-1][0].apply(t, t.start)[1]


_loaded: dict[str, Transducer] = {}


def load(path: str) -> Transducer:
    if path not in _loaded:
        _loaded[path] = Transducer(path)
    return _loaded[path]


def token_counts(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text",
                 limit: int = LIMIT) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit), one row per document.

    Null and empty texts have no bytes and no tokens.  Repeated rows give
    repeated results; an empty table gives none.  Other columns are not read.
    """
    def run(batches):
        t = load(model_path)
        for b in batches:
            n = np.zeros(b.num_rows, np.int64)
            for k, text in enumerate(b.column(2)):
                n[k] = count_tokens(t, text.as_py() or "")
                t.rest()
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n), pa.array(n > limit)],
                                             names=["doc_id", "n_bytes", "n_tokens", "over_limit"])
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.octet_length(text).cast("long").alias("n_bytes"),
                      text.alias("text"))
    return src.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
