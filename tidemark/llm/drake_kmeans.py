"""Centroid clustering by Drake's adaptive bounds.

Every vector keeps an upper bound of the distance to its centroid, lower bounds
of the distances to its next nearest centroids in order, and one lower bound of
the distances to all the rest. After centroids move, the bounds move with them.
Where they still prove the order, a vector is not looked at; where they prove it
from some place on, only the centroids before that place are measured; where
they prove nothing, all are. The number of places starts at a quarter of the
centroids and follows what the last round needed, down to an eighth.

Components are integers, floor(scale * x), so squared distances, sums and means
are exact; bounds are doubles that must hold by a margin above their rounding.

A round is one pass over a table of vectors with their bounds: written, summed
by centroid within each task before anything is shuffled, and read by the next
round, after which the older table is deleted. What goes through the driver are
the centroids and their sums, which number as the parameter `k` says.

Defined cases: a vector that is null, has another number of components, or holds
a null or a non-finite one is left out; a null id counts as the empty text in
the order of the first centroids and stays null; repeated rows are vectors of
their own (equal first centroids tie, and the smaller number wins); fewer vectors
than `k` give as many centroids; an empty table gives an empty result; other
columns are ignored, whatever their names. Components so large that a squared
distance passes 63 bits raise an OverflowError.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import delete, scratch

_STATE = "vec_id long, v array<int>, was int, cluster int, upper double, near array<int>, lower array<double>, looked int, measured long, distance long"
#: Numbers of the matrix that one step of a pass measures.
_CELLS = 1 << 22


def _exact(v: np.ndarray, c: np.ndarray) -> type:
    """The number type in which squared distances of these vectors are exact."""
    reach = max((int(np.abs(m.astype(np.int64)).max()) for m in (v, c) if m.size), default=0)
    worst = v.shape[-1] * (2 * reach) ** 2
    if worst >= 2**63:
        raise OverflowError("a squared distance passes 63 bits")
    return np.float64 if worst < 2**53 else np.int64


def squares(v: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of v to all rows of c, exact, as int64."""
    kind = _exact(v, c)
    a, b = v.astype(kind), c.astype(kind)
    return ((a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * (a @ b.T)).astype(np.int64)


def squares_to(v: np.ndarray, c: np.ndarray, which: np.ndarray) -> np.ndarray:
    """Squared distances of each row of v to its own centroids which[row]."""
    kind = _exact(v, c)
    gap = v.astype(kind)[:, None, :] - c.astype(kind)[which]
    return (gap * gap).sum(2).astype(np.int64)


def _sure(upper: np.ndarray, lower: np.ndarray) -> np.ndarray:
    """Whether the upper bound is below the lower one beyond any rounding."""
    return upper + 1e-6 + 1e-9 * np.abs(upper) < lower


class Bounds:
    """Assignments and bounds of a block of vectors: places 0 to b-1 are single centroids, place b is the remainder."""

    def __init__(self, v: np.ndarray, cluster: np.ndarray, upper: np.ndarray, near: np.ndarray, lower: np.ndarray):
        self.v, self.cluster, self.upper, self.near, self.lower = v, cluster, upper, near, lower
        self.looked, self.measured = np.zeros(len(v), np.int32), np.zeros(len(v), np.int64)

    @classmethod
    def unknown(cls, v: np.ndarray, places: int) -> Bounds:
        n = len(v)
        return cls(v, np.full(n, -1, np.int32), np.full(n, np.inf), np.zeros((n, places), np.int32), np.zeros((n, places + 1)))

    def fold(self, places: int) -> None:
        """Fewer single places: the last ones go into the remainder."""
        if places < self.near.shape[1]:
            rest = self.lower[:, places:].min(1, keepdims=True)
            self.near, self.lower = self.near[:, :places].copy(), np.hstack([self.lower[:, :places], rest])

    def move(self, drift: np.ndarray) -> None:
        """Centroids moved by these distances."""
        known = self.cluster >= 0
        self.upper[known] += drift[self.cluster[known]]
        self.lower[known, :-1] -= drift[self.near[known]]
        self.lower[known, -1] -= drift.max(initial=0.0)

    def settle(self, c: np.ndarray) -> None:
        """Finds every vector's nearest centroid, measuring only what bounds can't certify."""
        b = self.near.shape[1]
        open_ = np.flatnonzero((self.cluster >= 0) & ~_sure(self.upper, self.lower.min(1)))
        if len(open_):  # the distance to its own centroid, exactly
            own = squares_to(self.v[open_], c, self.cluster[open_, None])[:, 0]
            self.upper[open_] = np.sqrt(own)
            self.measured[open_] += 1
        onward = np.minimum.accumulate(self.lower[:, ::-1], axis=1)[:, ::-1]  # the least bound from a place on
        place = np.where(self.cluster < 0, b + 1, (~_sure(self.upper[:, None], onward)).sum(1))
        for z in range(1, b + 1):
            self._reorder(np.flatnonzero(place == z), z, c)
        self._rescan(np.flatnonzero(place > b), c)
        self.looked = place.astype(np.int32)

    def _reorder(self, rows: np.ndarray, z: int, c: np.ndarray) -> None:
        """Measures a vector's own centroid and its first z others; all the rest are certified to be farther than the nearest."""
        if not len(rows):
            return
        which = np.hstack([self.cluster[rows, None], self.near[rows, :z]])
        far = squares_to(self.v[rows], c, which)
        order = np.lexsort((which, far), axis=1)
        which, far = np.take_along_axis(which, order, 1), np.take_along_axis(far, order, 1)
        self.cluster[rows], self.upper[rows] = which[:, 0], np.sqrt(far[:, 0])
        self.near[rows, :z], self.lower[rows, :z] = which[:, 1:], np.sqrt(far[:, 1:])
        self.measured[rows] += z

    def _rescan(self, rows: np.ndarray, c: np.ndarray) -> None:
        """Measures all centroids."""
        b, step = self.near.shape[1], max(1, _CELLS // max(len(c), self.v.shape[1]))
        for at in range(0, len(rows), step):
            some = rows[at : at + step]
            far = squares(self.v[some], c)
            order = np.argsort(far, axis=1, kind="stable")[:, : b + 2]
            near = np.sqrt(np.take_along_axis(far, order, 1))
            self.cluster[some], self.upper[some] = order[:, 0], near[:, 0]
            self.near[some], self.lower[some, :b] = order[:, 1 : b + 1], near[:, 1 : b + 1]
            self.lower[some, b] = near[:, b + 1] if len(c) > b + 1 else np.inf
            self.measured[some] += len(c)


def _matrix(column: pa.Array, width: int, kind: type) -> np.ndarray:
    return np.asarray(column.flatten()).astype(kind).reshape(len(column), width)


def _lists(m: np.ndarray, kind: pa.DataType) -> pa.Array:
    at = np.arange(0, m.size + 1, m.shape[1], dtype=np.int32) if m.shape[1] else np.zeros(len(m) + 1, np.int32)
    return pa.ListArray.from_arrays(pa.array(at), pa.array(m.ravel(), kind))


def _round(c: np.ndarray, drift: np.ndarray | None, places: int, last: bool):
    """The pass of a round over blocks of the table: bounds move, vectors settle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            v = _matrix(batch.column("v"), c.shape[1], np.int32)
            if drift is None:
                state = Bounds.unknown(v, places)
            else:
                near = batch.column("near")
                had = len(near[0])
                state = Bounds(v, np.array(batch.column("cluster")), np.array(batch.column("upper")), _matrix(near, had, np.int32), _matrix(batch.column("lower"), had + 1, np.float64))
                state.fold(places)
                state.move(drift)
            was = state.cluster.copy()
            state.settle(c)
            if last:
                step = max(1, _CELLS // c.shape[1])
                exact = [squares_to(v[at : at + step], c, state.cluster[at : at + step, None])[:, 0] for at in range(0, len(v), step)]
                distance = pa.array(np.concatenate(exact))
            else:
                distance = pa.nulls(len(v), pa.int64())
            columns = [batch.column("vec_id"), batch.column("v"), pa.array(was), pa.array(state.cluster), pa.array(state.upper), _lists(state.near, pa.int32()), _lists(state.lower, pa.float64())]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(state.looked), pa.array(state.measured), distance], names=["vec_id", "v", "was", "cluster", "upper", "near", "lower", "looked", "measured", "distance"])

    return run


def _moved(k: int, d: int):
    """Changes of the centroids' sums (and, in place d, of their counts) by the vectors that a task saw change hands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k, d + 1), np.int64)
        for batch in batches:
            v = np.hstack([_matrix(batch.column("v"), d, np.int64), np.ones((batch.num_rows, 1), np.int64)])
            was, now = np.asarray(batch.column("was")), np.asarray(batch.column("cluster"))
            np.add.at(total, now, v)
            np.subtract.at(total, was[was >= 0], v[was >= 0])
        i, j = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array(total[i, j])], names=["cluster", "place", "total"])

    return run


def kept_vectors(vectors: DataFrame, dims: int, scale: int, id_col: str, vector_col: str) -> DataFrame:
    """vec_id and v (integers floor(scale * x)) of the vectors with this many components, all of them finite numbers."""
    x = F.col(vector_col)
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), x.alias("x"))
    finite = F.forall("x", lambda y: F.coalesce(~F.isnan(y.cast("double")) & (F.abs(y.cast("double")) < F.lit(float("inf"))), F.lit(False)))
    whole = rows.where(F.col("x").isNotNull()).where((F.size("x") == dims) & finite)
    return whole.select("vec_id", F.transform("x", lambda y: F.floor(y.cast("double") * F.lit(float(scale))).cast("int")).alias("v"))


def drake_kmeans(
    vectors: DataFrame, k: int = 40, rounds: int = 5, dims: int = 64, scale: int = 256, seed: int = 2, id_col: str = "vec_id", vector_col: str = "embedding"
) -> DataFrame:
    """One row per kept vector: vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256, measured.

    Centroids start as the k kept vectors with the smallest sha256 of `seed:vec_id`;
    `measured` counts the distances that the last pass computed for the vector.
    """
    spark = vectors.sparkSession
    kept = kept_vectors(vectors, dims, scale, id_col, vector_col)
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    first = kept.orderBy(key, "v").limit(k).collect()  # k rows
    if not first:
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string, measured long")
    c = np.array([r.v for r in first], np.int64)
    k, places = len(c), min(len(c) - 1, max(1, len(c) // 4))
    sums, drift, source, old = np.zeros((k, dims + 1), object), None, kept, None
    for r in range(rounds + 1):
        path = scratch(spark, "clusters")
        source.mapInArrow(_round(c, drift, places, r == rounds), _STATE).write.parquet(path)
        if old:
            delete(spark, old)
        source, old = spark.read.schema(_STATE).parquet(path), path
        if r == rounds:
            break
        change = source.where("was <> cluster").select("v", "was", "cluster").mapInArrow(_moved(k, dims), "cluster long, place long, total long")
        for row in change.groupBy("cluster", "place").agg(F.sum("total").alias("total")).collect():  # k * (dims + 1) rows at most
            sums[row.cluster, row.place] += row.total
        new = np.array([[s // n for s in own] if (n := row[dims]) else list(at) for row, own, at in zip(sums, sums[:, :dims], c)], np.int64).reshape(k, dims)
        drift, c = np.sqrt(squares_to(new, c, np.arange(k)[:, None])[:, 0]), new
        needed = source.where(F.col("looked") <= places).agg(F.max("looked")).first()[0]
        places = min(places, max(needed or 0, k // 8, min(1, k - 1)))
    sha = [hashlib.sha256(",".join(map(str, x.tolist())).encode()).hexdigest() for x in c]
    own = {x.cluster: x.total for x in source.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("total")).collect()}  # k rows at most
    rows = [(i, int(own[i]), int(sum(own.values())), sha[i]) for i in own]
    totals = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return source.join(F.broadcast(totals), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256", "measured")
