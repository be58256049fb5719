"""Quality classifier: Naive Bayes scaled n-gram indicators, linear hinge loss.

Words and word pairs (A-Z in lower case) are hashed to 2**18 indicators.
The class log-count ratio of each indicator comes from all labelled training
rows, summed in Spark.  A linear support vector machine over the indicators
scaled by those ratios is then fitted by dual coordinate descent, and its
margin calibrated to a probability, on a bounded sample of labelled rows
(``SAMPLE`` per class, in hash order of the id).  Rows whose crc32(doc_id as
text) mod 5 is 0 never take part.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mountwait.llm.common import mix64, prefix_hash, slices, span_hash, word_spans
from mountwait.session import cut_lineage

BITS = 18
DIM = 1 << BITS
SAMPLE = 2500
FOLDS = 5
THRESHOLD = 0.3
BROADCAST_LABELS = 1_000_000  # (id, label) pairs, about 30 MB in a hash table
SMOOTHING = 1.0
COST = 1.0
EPOCHS = 20
_STEP = np.uint64(0xC2B2AE3D27D4EB4F)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def indicators(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(document, bucket) pairs, each once, sorted."""
    low = _LOWER[data]
    start, end, doc = word_spans(low, off)
    if not len(start):
        z = np.zeros(0, np.int64)
        return z, z
    h = span_hash(prefix_hash(low), start, end)
    pair = mix64(h[:-1] * _STEP + h[1:])
    same = doc[:-1] == doc[1:]
    keys = np.concatenate([(doc << BITS) | (h & np.uint64(DIM - 1)).astype(np.int64),
                           (doc[:-1][same] << BITS) | (pair[same] & np.uint64(DIM - 1)).astype(np.int64)])
    keys.sort()
    keys = keys[np.r_[True, keys[1:] != keys[:-1]]]
    return keys >> BITS, keys & (DIM - 1)


@dataclass
class Model:
    """margin = sum(weight) / sqrt(sum(square)) + bias over a text's indicators."""

    weight: np.ndarray
    square: np.ndarray
    bias: float
    slope: float
    offset: float

    def score(self, data: np.ndarray, off: np.ndarray) -> np.ndarray:
        doc, bucket = indicators(data, off)
        n = len(off) - 1
        m = np.bincount(doc, weights=self.weight[bucket], minlength=n)
        s = np.bincount(doc, weights=self.square[bucket], minlength=n)
        z = m / np.sqrt(np.maximum(s, 1e-12)) + self.bias
        return 1.0 / (1.0 + np.exp(-np.clip(self.slope * z + self.offset, -30, 30)))


def dual_descent(rows: list[np.ndarray], values: list[np.ndarray], y: np.ndarray, cost: np.ndarray,
                 dim: int, epochs: int = EPOCHS, seed: int = 7) -> tuple[np.ndarray, float]:
    """Linear SVM with hinge loss: coordinate descent on the dual, bias as a feature of one."""
    w, b = np.zeros(dim), 0.0
    alpha = np.zeros(len(y))
    q = np.array([v @ v + 1.0 for v in values])
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        moved = 0.0
        for i in rng.permutation(len(y)):
            at, v = rows[i], values[i]
            g = y[i] * (w[at] @ v + b) - 1.0
            a = min(max(alpha[i] - g / q[i], 0.0), cost[i])
            d = (a - alpha[i]) * y[i]
            if d:
                w[at] += d * v
                b += d
                alpha[i] = a
                moved = max(moved, abs(d))
        if moved < 1e-3:
            break
    return w, b


def platt(z: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Logistic fit of labels (0/1) on margins by Newton steps."""
    t = np.where(y > 0, 1 - 1 / (2 + y.sum()), 1 / (2 + (1 - y).sum()))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30)))
        g = weight * (p - t)
        k = weight * p * (1 - p) + 1e-9
        grad = np.array([g @ z + 1e-3 * a, g.sum()])
        hess = np.array([[k @ (z * z) + 1e-3, k @ z], [k @ z, k.sum() + 1e-9]])
        step = np.linalg.solve(hess, grad)
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-8:
            break
    return float(max(a, 1e-3)), float(b)


def _training(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str):
    """Labelled training rows; ids with conflicting labels are left out."""
    lab = (labels.where(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1))
           .where(F.crc32(F.col(id_col).cast("string")) % FOLDS != 0)
           .groupBy(F.col(id_col).cast("long").alias("lid"))
           .agg(F.min(label_col).cast("int").alias("y"), F.max(label_col).cast("int").alias("y2"))
           .where("y = y2").select("lid", "y"))
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return lab, src


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
        label_col: str = "quality", sample: int = SAMPLE) -> Model:
    """Fit on the labelled rows.  Without labels of both classes every score is 0.5."""
    lab, src = _training(docs, labels, id_col, text_col, label_col)

    def count(batches):
        n = np.zeros((2, DIM + 1), np.int64)
        for rows, data, off in slices(batches, "text"):
            y = rows.column(rows.schema.get_field_index("y")).to_numpy(zero_copy_only=False)
            doc, bucket = indicators(data, off)
            for c in (0, 1):
                n[c, :DIM] += np.bincount(bucket[y[doc] == c], minlength=DIM)
                n[c, DIM] += int((y == c).sum())
        at = np.flatnonzero(n.any(axis=0))
        for k in range(0, len(at), 1 << 16):
            part = at[k:k + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array(n[0, part]), pa.array(n[1, part])],
                                             names=["bucket", "n0", "n1"])
    # Few labels go to the texts; with many, the texts move instead.
    lab = cut_lineage(lab)
    side = F.broadcast(lab) if lab.count() <= BROADCAST_LABELS else lab
    sums = (src.join(side, src["doc_id"] == side["lid"]).select("text", "y")
            .mapInArrow(count, "bucket int, n0 long, n1 long")
            .groupBy("bucket").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))).toArrow()  # 2**18 + 1 rows at most
    n = np.zeros((2, DIM + 1))
    for c in (0, 1):
        n[c, sums["bucket"].to_numpy()] = sums[f"n{c}"].to_numpy()
    totals = n[:, DIM]
    if totals.min() < 1:
        return Model(np.zeros(DIM, np.float32), np.zeros(DIM, np.float32), 0.0, 1.0, 0.0)
    share = (n[:, :DIM] + SMOOTHING) / (n[:, :DIM] + SMOOTHING).sum(axis=1, keepdims=True)
    ratio = np.log(share[1] / share[0])
    ratio[n[:, :DIM].sum(axis=0) == 0] = 0.0

    # The bounded sample: `sample` distinct rows (id and text) of each class, in hash order of the id.
    # An id of very many rows does not go to the driver as a whole.
    text = F.xxhash64(F.coalesce("text", F.lit("")))
    have_rows = cut_lineage(src.join(side, src["doc_id"] == side["lid"]).select("lid", "y", text.alias("h")).distinct())
    order = F.xxhash64("lid"), F.col("lid"), F.col("h")
    ids = (have_rows.where("y = 0").orderBy(*order).limit(sample)
           .unionByName(have_rows.where("y = 1").orderBy(*order).limit(sample)))

    def collect(batches):
        for rows, data, off in slices(batches, "text"):
            doc, bucket = indicators(data, off)
            cut = np.searchsorted(doc, np.arange(len(off)))
            yield pa.RecordBatch.from_arrays(
                [rows.column(0), rows.column(rows.schema.get_field_index("y")),
                 pa.ListArray.from_arrays(pa.array(cut.astype(np.int32)), pa.array(bucket.astype(np.int32)))],
                names=["doc_id", "y", "bs"])
    got = (src.join(F.broadcast(ids), (src["doc_id"] == ids["lid"]) & (text == ids["h"]))
           .select("doc_id", "y", "h", "text").groupBy("doc_id", "y", "h").agg(F.min("text").alias("text"))
           .select("doc_id", "y", "text")
           .mapInArrow(collect, "doc_id long, y int, bs array<int>")).toArrow().sort_by("doc_id")
    rows = [np.asarray(x, np.int64) for x in (got["bs"].combine_chunks()).to_pylist()]
    y01 = got["y"].to_numpy()
    y = np.where(y01 > 0, 1.0, -1.0)

    def scaled(at):
        v = ratio[at]
        return v / np.sqrt(max(v @ v, 1e-12))
    values = [scaled(r) for r in rows]
    have = np.array([(y01 == c).sum() for c in (0, 1)], float)
    cost = COST * (len(y) / (2 * np.maximum(have, 1)))[y01]
    # Margins of rows the fit has not seen calibrate the score; then all rows fit.
    fold = np.arange(len(y)) % 4
    z = np.zeros(len(y))
    for k in range(4):
        tr = np.flatnonzero(fold != k)
        w, b = dual_descent([rows[i] for i in tr], [values[i] for i in tr], y[tr], cost[tr], DIM)
        for i in np.flatnonzero(fold == k):
            z[i] = w[rows[i]] @ values[i] + b
    w, b = dual_descent(rows, values, y, cost, DIM)
    prior = (totals / totals.sum() / np.maximum(have / len(y), 1e-9))[y01]
    a, off = platt(z, y01.astype(float), prior)
    return Model((w * ratio).astype(np.float32), (ratio * ratio).astype(np.float32), b, a, off)


def score_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted), one row per document.

    Null and empty texts have no indicators and get the score of the bias
    alone.  A null id counts as held out only by its crc32 (null: false).
    Repeated rows are scored alike; an empty table gives no rows.
    """
    model = fit(docs, labels, id_col, text_col)

    def run(batches):
        for rows, data, off in slices(batches, "text"):
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(model.score(data, off))],
                                             names=["doc_id", "score"])
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return src.mapInArrow(run, "doc_id long, score double").select(
        "doc_id", F.coalesce(F.crc32(F.col("doc_id").cast("string")) % FOLDS == 0, F.lit(False)).alias("held_out"),
        "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, text_col: str = "text", id_col: str = "doc_id",
              threshold: float = THRESHOLD) -> DataFrame:
    """docs without the rows the classifier rejects; all columns as they are."""
    model = fit(docs, labels, id_col, text_col)

    def run(batches):
        for rows, data, off in slices(batches, text_col):
            yield rows.filter(pa.array(model.score(data, off) >= threshold))
    return docs.mapInArrow(run, docs.schema)
