"""Centroid clustering with exact integers, filtered by n-simplex projection.

Vectors become integers floor(1024 * x).  Lloyd rounds over them are exact:
squared distances are integers, ties go to the smaller number, a centroid is the
componentwise floor of sum / count.

* Projection.  The distances of a vector to ``PIVOTS`` fixed pivots are turned
  once into apex coordinates of the simplex that the pivots span: coordinates
  inside the pivots' space, then the altitude above it.  They are cached beside
  the integers in a table that all rounds read.
* Filter.  A round projects its few centroids onto the same simplex.  Between two
  apexes the Euclidean distance is a lower bound of the true distance, and with
  the altitude of one of them negated an upper bound.  A centroid whose lower
  bound is above another's upper bound (with slack for rounding) cannot be the
  nearest; only the others are compared exactly.
* Rounds.  Each task adds up its vectors by cluster and sends at most
  clusters x (components + 2) integers, which Spark sums; the driver sees only
  the totals of the clusters.  No vector is shuffled, so hot groups of copies
  cost nothing.

Defined results: vectors are kept if they have exactly ``dim`` components, none
null or non-finite.  A null id hashes as an empty one.  Equal ids or repeated
rows are rows of their own; seeds of equal hash are ordered by components.  With
fewer kept vectors than clusters every one is a seed.  No kept vector: no rows.
Components beyond +-2**27 (x beyond +-131,072) go through Python integers, as do
centroids there; sums are exact for |x| below 10**20, a larger one raises an error.  A distance that no long holds is null, as are sums with it.  Other columns are
not read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator
from decimal import Decimal
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mountwait.llm.common import batch_of, give_back, written

CLUSTERS = 8
ROUNDS = 10
PIVOTS = 16
SCALE = 1024
NARROW = 1 << 27  # 64 squared differences of such integers fit a long
LONG_MAX = (1 << 63) - 1
MOST = 1e20  # larger x could overflow a sum of decimal(38)
SLACK = 1e-6  # of the squared lengths compared; rounding stays far below it
MIN_ALTITUDE = 1e-3  # pivots nearer to the others' space than this share of their squared distance
MIN_REACH = 1e-12  # or of the squared reach of all pivots are left out

_CACHED = pa.schema([("vec_id", pa.int64()), ("ints", pa.binary()), ("wide", pa.string()), ("apex", pa.binary())])
_SUMS = pa.schema([("cluster", pa.int32()), ("pos", pa.int32()), ("s", pa.decimal128(38, 0))])
_COUNT, _INERTIA = -1, -2


def whole(x: float, scale: int = SCALE) -> int:
    """floor(scale * x) as a Python integer, whatever its size."""
    if abs(x) >= MOST:
        raise ValueError(f"components of {MOST} and more are not supported")
    return int(x) * scale if abs(x) >= 2.0 ** 52 else math.floor(scale * x)


def square(a, b) -> int:
    """Squared Euclidean distance of two integer sequences, exactly."""
    return sum((int(x) - int(y)) ** 2 for x, y in zip(a, b))


class Simplex:
    """The base simplex of the pivots: apex coordinates from distances alone."""

    def __init__(self, pivots: list[list[int]]):
        self.pivots, self.rows = [], np.zeros((0, 0))
        # squared length of the longest edge from the first pivot: the scale of all rounding errors
        self.reach = max((float(square(p, pivots[0])) for p in pivots), default=0.0)
        for p in pivots:
            self._add([int(x) for x in p])

    def _add(self, p: list[int]) -> None:
        if not self.pivots:
            self.pivots.append(p)
            return
        sq = np.array([[square(p, q) for q in self.pivots]], np.float64)
        at = self.apex(sq)[0]
        # a pivot in (or very near) the space of the others adds no coordinate
        if at[-1] ** 2 <= max(MIN_ALTITUDE * sq[0, 0], MIN_REACH * self.reach):
            return
        k = len(self.pivots)
        rows = np.zeros((k, k))
        rows[:k - 1, :k - 1] = self.rows
        rows[k - 1] = at
        self.rows = rows
        self.pivots.append(p)

    def apex(self, sq: np.ndarray) -> np.ndarray:
        """Apex coordinates (the altitude last) from squared distances to the pivots."""
        n = len(self.rows)
        out = np.zeros((len(sq), n + 1))
        for i in range(n):
            own = self.rows[i]
            rhs = (sq[:, 0] + own @ own - sq[:, i + 1]) / 2
            out[:, i] = (rhs - out[:, :i] @ own[:i]) / own[i]
        inside = np.einsum("ij,ij->i", out[:, :n], out[:, :n])
        out[:, n] = np.sqrt(np.maximum(sq[:, 0] - inside, 0.0))
        return out

    def of(self, points: list[list[int]]) -> np.ndarray:
        return self.apex(np.array([[square(c, p) for p in self.pivots] for c in points], np.float64))


def squares_to(ints: np.ndarray, point: list[int]) -> np.ndarray:
    """Exact squared distances of narrow vectors to a point of any size (then as objects)."""
    if max(map(abs, point)) <= NARROW:
        d = ints - np.array(point, np.int64)
        return np.einsum("ij,ij->i", d, d)
    d = ints.astype(object) - np.array(point, object)
    return (d * d).sum(axis=1)


class Centres(NamedTuple):
    """A round's centroids, with their apex coordinates and the simplex's reach."""
    points: list[list[int]]
    apex: np.ndarray
    reach: float

    @classmethod
    def on(cls, simplex: Simplex, points: list[list[int]]) -> Centres:
        return cls(points, simplex.of(points), simplex.reach)


def candidates(apex: np.ndarray, centres: np.ndarray, reach: float) -> np.ndarray:
    """Mask (vectors x centroids) of the centroids that may be nearest."""
    flat = apex[:, None, :-1] - centres[None, :, :-1]
    base = np.einsum("ijk,ijk->ij", flat, flat)
    up, mine = centres[None, :, -1], apex[:, None, -1]
    lower, upper = base + (mine - up) ** 2, base + (mine + up) ** 2
    size = np.einsum("ij,ij->i", apex, apex)[:, None] + np.einsum("ij,ij->i", centres, centres)[None, :]
    slack = SLACK * (size + reach)
    return lower - slack <= (upper + slack).min(axis=1, keepdims=True)


def nearest(ints: np.ndarray, apex: np.ndarray, centres: Centres):
    """(cluster, squared distance) of each narrow vector; the distances are objects if some are large."""
    may = candidates(apex, centres.apex, centres.reach)
    large = any(max(map(abs, c)) > NARROW for c in centres.points)
    best = np.full(len(ints), -1, np.int32)
    dist = np.full(len(ints), 0, object if large else np.int64)
    for j, c in enumerate(centres.points):
        at = np.flatnonzero(may[:, j])
        if not len(at):
            continue
        d = squares_to(ints[at], c)
        better = (best[at] < 0) | (d < dist[at])
        best[at[better]] = j
        dist[at[better]] = d[better]
    return best, dist


def _cache(simplex: Simplex, dim: int):
    """Rows with integers and apex coordinates; vectors beyond NARROW as text, without a projection."""
    def run(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            if not b.num_rows:
                continue
            x = b.column(1).flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, dim)
            wide = (np.abs(x) * SCALE >= NARROW).any(axis=1)
            ints = np.floor(np.where(wide[:, None], 0.0, x) * SCALE).astype(np.int64)
            apex = simplex.apex(np.stack([squares_to(ints, p) for p in simplex.pivots], axis=1).astype(np.float64))
            yield batch_of(
                _CACHED, b.column(0),
                [None if w else r.tobytes() for w, r in zip(wide, ints.astype(np.int32))],
                [",".join(str(whole(v)) for v in r) if w else None for w, r in zip(wide, x.tolist())],
                [None if w else r.tobytes() for w, r in zip(wide, apex)])
        give_back()
    return run


def _assigned(batch: pa.RecordBatch, dim: int, centres: Centres):
    """(narrow row numbers, their integers, cluster of each row, distance of each row, wide rows)."""
    ids, raw, wide, apex = (batch.column(batch.schema.get_field_index(n)) for n in ("vec_id", "ints", "wide", "apex"))
    narrow = np.flatnonzero(np.asarray(raw.is_valid()))
    far = np.flatnonzero(np.asarray(wide.is_valid()))
    v = np.frombuffer(b"".join(raw.drop_null().to_pylist()), np.int32).reshape(-1, dim).astype(np.int64)
    a = np.frombuffer(b"".join(apex.drop_null().to_pylist()), np.float64).reshape(len(v), -1)
    cluster = np.zeros(batch.num_rows, np.int32)
    dist = np.zeros(batch.num_rows, object)
    cluster[narrow], dist[narrow] = nearest(v, a, centres)
    large = []
    for i in far:
        point = [int(t) for t in wide[i].as_py().split(",")]
        d, j = min((square(point, c), j) for j, c in enumerate(centres.points))
        cluster[i], dist[i] = j, d
        large.append((i, point))
    return ids, narrow, v, cluster, dist, large


def _sums(dim: int, centres: Centres):
    """One task's sums: (cluster, component or count or inertia, integer)."""
    def run(batches: Iterator[pa.RecordBatch]):
        total = [[0] * (dim + 2) for _ in centres.points]
        for b in batches:
            if not b.num_rows:
                continue
            _, narrow, v, cluster, dist, large = _assigned(b, dim, centres)
            for j in range(len(total)):
                at = cluster == j
                total[j][_COUNT] += int(at.sum())
                total[j][_INERTIA] += int(dist[at].sum())
                for k, s in enumerate(v[at[narrow]].sum(axis=0).tolist()):
                    total[j][k] += s
            for i, point in large:
                for k, s in enumerate(point):
                    total[cluster[i]][k] += s
        for t in total:  # a larger inertia is null in the end: keep it large, and within a decimal
            t[_INERTIA] = min(t[_INERTIA], 10 ** 30)
        rows = [(j, k if k < dim else k - dim - 2, Decimal(s)) for j, t in enumerate(total) if t[_COUNT]
                for k, s in enumerate(t)]
        yield batch_of(_SUMS, *([r[i] for r in rows] for i in range(3)))
        give_back()
    return run


def _as_long(x: int):
    return x if x <= LONG_MAX else None


def _result(schema: pa.Schema, dim: int, centres: Centres, inertia: list[int]):
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres.points]
    whole_inertia = _as_long(sum(inertia))

    def run(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            if not b.num_rows:
                continue
            ids, _, _, cluster, dist, _ = _assigned(b, dim, centres)
            yield batch_of(schema, ids, cluster, [_as_long(int(d)) for d in dist],
                           [_as_long(inertia[j]) for j in cluster], [whole_inertia] * len(cluster),
                           [digest[j] for j in cluster])
        give_back()
    return run


_RESULT = pa.schema([("vec_id", pa.int64()), ("cluster", pa.int32()), ("distance", pa.int64()),
                     ("cluster_inertia", pa.int64()), ("inertia", pa.int64()), ("centroid_sha256", pa.string())])
_RESULT_SQL = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"


def _kept(vec: Column, dim: int) -> Column:
    bad = F.exists(vec, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return F.coalesce((F.size(vec) == dim) & ~bad, F.lit(False))


def cluster(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", dim: int = 64,
            clusters: int = CLUSTERS, rounds: int = ROUNDS, pivots: int = PIVOTS, seed: int = 3,
            log: Callable[[int, list[list[int]]], None] | None = None) -> DataFrame:
    """One row per kept vector: vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256.

    ``log`` is told each round's number and centroids.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"),
                          F.col(vec_col).cast("array<double>").alias("x")).where(_kept(F.col("x"), dim))
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    # a top-k of clusters or pivots, whichever is more: bounded by parameters
    first = [[whole(v) for v in r.x] for r in rows.orderBy(key, "x").limit(max(clusters, pivots)).collect()]
    centroids = first[:clusters]
    if not centroids:
        return spark.createDataFrame([], _RESULT_SQL)
    simplex = Simplex(first[:pivots])
    cached = written(rows.mapInArrow(_cache(simplex, dim), "vec_id long, ints binary, wide string, apex binary"),
                     "simplex")
    for n in range(rounds + 1):
        got = (cached.mapInArrow(_sums(dim, Centres.on(simplex, centroids)), "cluster int, pos int, s decimal(38,0)")
               .groupBy("cluster", "pos").agg(F.sum("s").alias("s")).collect())
        sums = {(r.cluster, r.pos): int(r.s) for r in got}
        if n == rounds:
            break
        centroids = [[sums[j, k] // sums[j, _COUNT] for k in range(dim)] if (j, _COUNT) in sums else c
                     for j, c in enumerate(centroids)]
        if log:
            log(n, centroids)
    inertia = [sums.get((j, _INERTIA), 0) for j in range(len(centroids))]
    return cached.mapInArrow(_result(_RESULT, dim, Centres.on(simplex, centroids), inertia), _RESULT_SQL)
