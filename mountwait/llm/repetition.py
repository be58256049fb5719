"""Quality rules by repetition coverage, with rolling hashes in numpy.

Word hashes come from one prefix hash over the bytes of a slice of texts;
windows of 5 to 10 words are rolling sums of those.  For every length the
characters inside repeats of an earlier window of their text are measured,
and the characters inside repeats of an earlier line.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mountwait.llm.common import covered, mix64, per_doc, prefix_hash, repeated, slices, span_hash, word_spans

# Published limits for web text: share of characters in repeated n-grams, in repeated lines.
NGRAM_LIMITS = {5: 0.15, 6: 0.14, 7: 0.13, 8: 0.12, 9: 0.11, 10: 0.10}
LINE_LIMIT = 0.20
SYMBOL_WORDS = 0.10  # symbols per word
BASE_WINDOW = 8
MIN_WORDS = 20
SYMBOLS = b"#*$%&|<>"
_STEP = np.uint64(0xC2B2AE3D27D4EB4F)

SCHEMA = pa.schema([
    ("n_words", pa.int64()), ("word_chars", pa.int64()), ("n_symbols", pa.int64()), ("n_dup_lines", pa.int64()),
    ("n_repeat_words", pa.int64()), ("dup_line_chars", pa.int64()), ("dup_ngram_share", pa.float64()),
    ("base_failed", pa.bool_()), ("kept", pa.bool_())])
DDL = ("n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
       "dup_line_chars long, dup_ngram_share double, base_failed boolean, kept boolean")
_IS_SYMBOL = np.zeros(256, bool)
_IS_SYMBOL[list(SYMBOLS)] = True


def _windows(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of every n consecutive word hashes."""
    out = np.zeros(len(h) - n + 1, np.uint64)
    for j in range(n):
        out = out * _STEP + h[j:len(h) - n + 1 + j]
    return mix64(out)


def _later(keys: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Those of the places ``at`` whose key stands at an earlier one too."""
    later = np.ones(len(at), bool)
    later[np.unique(keys[at], return_index=True)[1]] = False
    return at[later]


def measure(data: np.ndarray, off: np.ndarray) -> list[np.ndarray]:
    """The columns of SCHEMA for the texts of a slice."""
    n_docs = len(off) - 1
    start, end, doc = word_spans(data, off)
    n_words = np.bincount(doc, minlength=n_docs)
    lead = (data & 0xC0) != 0x80  # first byte of a code point
    chars = np.zeros(len(data) + 1, np.int64)
    np.cumsum(lead, out=chars[1:])
    w_chars = chars[end] - chars[start]
    word_chars = np.bincount(doc, weights=w_chars, minlength=n_docs).astype(np.int64)
    n_symbols = per_doc(_IS_SYMBOL[data], off)
    prefix = prefix_hash(data)
    salt = mix64(np.arange(1, n_docs + 1, dtype=np.uint64))  # equal keys only inside a document

    # Lines with a word; a later one equal to an earlier one counts.
    cut = np.flatnonzero(data == 10)
    l_start = np.union1d(cut + 1, off[:-1])
    l_start = l_start[l_start < len(data)]
    l_doc = np.searchsorted(off, l_start, "right") - 1
    l_end = np.minimum(np.r_[l_start[1:], len(data)], off[l_doc + 1]) if len(l_start) else l_start
    ends_nl = (l_end > l_start) & (data[np.maximum(l_end - 1, 0)] == 10) if len(l_start) else np.zeros(0, bool)
    l_end = l_end - ends_nl
    filled = np.searchsorted(start, l_end) > np.searchsorted(start, l_start)
    l_start, l_end, l_doc = l_start[filled], l_end[filled], l_doc[filled]
    l_key = span_hash(prefix, l_start, l_end) ^ salt[l_doc]
    dup = repeated(l_key)
    at = _later(l_key, np.flatnonzero(dup))
    n_dup_lines = np.bincount(l_doc[at], minlength=n_docs)
    dup_line_chars = np.bincount(l_doc[at], weights=(chars[l_end] - chars[l_start])[at], minlength=n_docs).astype(np.int64)

    h = span_hash(prefix, start, end)
    n_repeat = np.zeros(n_docs, np.int64)
    over = np.zeros(n_docs)
    share_all = np.zeros(n_docs)
    safe = np.maximum(word_chars, 1)
    for n, limit in NGRAM_LIMITS.items():
        if len(h) < n:
            continue
        inside = doc[:len(h) - n + 1] == doc[n - 1:]
        at = np.flatnonzero(inside)
        keys = _windows(h, n)[at] ^ salt[doc[at]]
        twice = np.flatnonzero(repeated(keys))
        if n == BASE_WINDOW:
            n_repeat = np.bincount(doc[covered(at[twice], n, len(h))], minlength=n_docs)
        again = covered(at[_later(keys, twice)], n, len(h))
        share = np.bincount(doc[again], weights=w_chars[again], minlength=n_docs) / safe
        share_all = np.maximum(share_all, share)
        over = np.maximum(over, share / limit)
    base_failed = (n_words < MIN_WORDS) | (100 * n_repeat > 30 * n_words)
    line_chars = per_doc(lead, off)
    kept = ~(base_failed | (over > 1) | (dup_line_chars > LINE_LIMIT * np.maximum(line_chars, 1))
             | (n_symbols > SYMBOL_WORDS * n_words))
    return [n_words, word_chars, n_symbols, n_dup_lines, n_repeat, dup_line_chars, share_all, base_failed, kept]


def repetition_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: counts, repetition shares, base_failed, kept.

    A null or empty text has no words, fails the base rule and is not kept.
    Repeated rows give repeated results; an empty table gives none.  Only the
    two named columns are read.
    """
    def run(batches):
        for rows, data, off in slices(batches, "text"):
            cols = measure(data, off)
            yield pa.RecordBatch.from_arrays(
                [rows.column(0)] + [pa.array(c, f.type) for c, f in zip(cols, SCHEMA)],
                names=["doc_id", *SCHEMA.names])
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return src.mapInArrow(run, f"doc_id long, {DDL}")
