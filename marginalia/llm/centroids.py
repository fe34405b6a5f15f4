"""Exact k-means on whole numbers by Yinyang: distance bounds per group of centroids say which distances need no computing."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DoubleType, IntegerType, LongType, StructField, StructType

from marginalia.llm.common import materialize
from marginalia.llm.words import slices

#: Components up to this size keep 64-component distances within 63 bits: 64 * (2 * 2**27)**2 = 2**62.
LARGEST = 1 << 27
#: Bounds are kept on the safe side of rounding by this share, which is far more than a few operations on doubles lose.
_SLACK = 1e-12
_FAR = np.iinfo(np.int64).max


@dataclass
class Centroids:
    """Whole-number centroids (k x dimension), the group of each, and how far the last move took each (none in the first round)."""

    at: np.ndarray
    group: np.ndarray
    moved: np.ndarray

    @property
    def groups(self) -> int:
        return int(self.group.max(initial=-1)) + 1

    def to(self, at: np.ndarray) -> Centroids:
        """The same groups, after the centroids moved."""
        return Centroids(at, self.group, np.array([_root(sum((int(x) - int(y)) ** 2 for x, y in zip(a, b, strict=True))) for a, b in zip(at, self.at, strict=True)]) * (1 + _SLACK))

    def sha256(self, i: int) -> str:
        return hashlib.sha256(",".join(map(str, self.at[i].tolist())).encode()).hexdigest()


def _root(n: int) -> float:
    return float(n) ** 0.5


def grouped(at: np.ndarray, groups: int) -> np.ndarray:
    """Groups of near centroids: the farthest-first ones begin, and a few rounds of k-means over the k centroids follow."""
    x = at.astype(np.float64)
    if not len(x):
        return np.zeros(0, dtype=np.int64)
    chosen = [0]
    away = ((x - x[0]) ** 2).sum(axis=1)
    while len(chosen) < min(groups, len(x)):
        chosen.append(int(away.argmax()))
        away = np.minimum(away, ((x - x[chosen[-1]]) ** 2).sum(axis=1))
    centres = x[chosen]
    for _ in range(5):
        own = ((x[:, None] - centres) ** 2).sum(axis=2).argmin(axis=1)
        centres = np.array([x[own == g].mean(axis=0) if (own == g).any() else centres[g] for g in range(len(centres))])
    return np.unique(own, return_inverse=True)[1]


def _squared(v: np.ndarray, c: np.ndarray) -> np.ndarray:
    d = v - c
    return np.einsum("ij,ij->i", d, d)


def reassign(v: np.ndarray, own: np.ndarray, upper: np.ndarray, lower: np.ndarray, c: Centroids) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Nearest centroids (ties: the smaller number) of whole-number vectors v, with new bounds and the number of distances computed.

    own is the centroid of each vector before (-1: none yet), upper a bound on its distance then, and lower, one column a group,
    bounds on the distances to the group's other centroids then. Bounds are first moved by how far centroids moved. A vector
    whose least lower bound lies beyond its upper bound keeps its centroid; otherwise its distance to it is computed, and the groups
    whose bound lies within it are looked at; of their centroids, those whose old group bound less their own move lies within it
    are computed. All that is left out is strictly farther, so ties are decided among computed distances."""
    n, k = len(v), len(c.at)
    fresh = own < 0
    step = np.array([c.moved[c.group == g].max() for g in range(c.groups)])
    old_lower = lower
    lower = np.where(fresh[:, None], 0.0, np.maximum(lower * (1 - _SLACK) - step * (1 + _SLACK), 0.0))
    upper = np.where(fresh, np.inf, (upper + c.moved[own]) * (1 + _SLACK))
    own, computed = own.copy(), 0
    open_ = np.flatnonzero(fresh | (lower.min(axis=1) <= upper))
    if not len(open_):
        return own, upper, lower, computed
    squares = np.full((len(open_), k), _FAR)
    known = np.flatnonzero(~fresh[open_])
    for i in np.unique(own[open_[known]]):
        mine = known[own[open_[known]] == i]
        squares[mine, i] = _squared(v[open_[mine]], c.at[i])
        upper[open_[mine]] = np.sqrt(squares[mine, i].astype(np.float64)) * (1 + _SLACK)
        computed += len(mine)
    bound = np.full((len(open_), k), np.inf)  # at most the distance, for centroids of groups that are looked at
    look = lower[open_] <= upper[open_, None]
    for i in range(k):
        g = c.group[i]
        less = np.where(fresh[open_], 0.0, old_lower[open_, g] * (1 - _SLACK) - c.moved[i] * (1 + _SLACK))
        asked = look[:, g] & (own[open_] != i)
        near = np.flatnonzero(asked & (less <= upper[open_]))
        squares[near, i] = _squared(v[open_[near]], c.at[i])
        computed += len(near)
        bound[asked, i] = less[asked]
        bound[near, i] = np.sqrt(squares[near, i].astype(np.float64)) * (1 - _SLACK)
    before = own[open_]
    old = np.flatnonzero(before >= 0)
    bound[old, before[old]] = np.sqrt(squares[old, before[old]].astype(np.float64)) * (1 - _SLACK)
    best = squares.argmin(axis=1)  # the first of equals
    own[open_] = best
    rows = np.arange(len(open_))
    upper[open_] = np.sqrt(squares[rows, best].astype(np.float64)) * (1 + _SLACK)
    bound[rows, best] = np.inf
    for g in range(c.groups):
        least = bound[:, c.group == g].min(axis=1)
        lower[open_, g] = np.where(look[:, g], least, np.minimum(lower[open_, g], least))
    return own, upper, lower, computed


def whole_vectors(df: DataFrame, key: str, vector: str, scale: int, dimension: int) -> DataFrame:
    """(key, v) of the vectors that have so many components, none of them null, NaN or infinite: floor(scale * x) of each, x as double.
    Components beyond LARGEST are an error, as distances between such vectors don't fit a long."""
    x = F.col(f"`{vector}`").cast("array<double>")
    good = x.isNotNull() & (F.size(x) == dimension) & F.forall(x, lambda e: F.coalesce(F.abs(e) < float("inf"), F.lit(False)))
    whole = lambda e: F.when(F.abs(F.floor(e * scale)) <= LARGEST, F.floor(e * scale).cast("int")).otherwise(F.raise_error(F.lit("a component is too large for exact distances")))
    return df.filter(good).select(F.col(f"`{key}`").alias("key"), F.transform(x, whole).alias("v"))


def _matrix(column: pa.Array, dimension: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dimension).astype(np.int64)


_STATE = [StructField("cluster", IntegerType()), StructField("was", IntegerType()), StructField("upper", DoubleType()), StructField("lower", BinaryType())]


def _round(state: DataFrame, c: Centroids, dimension: int) -> DataFrame:
    """The rows of state (key, v and, but in the first round, cluster, upper, lower) with new clusters and bounds, and the clusters that were."""
    names = ["key", "v", *[f.name for f in _STATE]]
    first = "cluster" not in state.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 4096):
            n, v = batch.num_rows, _matrix(batch.column(1), dimension)
            own, upper, lower = np.full(n, -1), np.full(n, np.inf), np.zeros((n, c.groups))
            if not first:
                own, upper = batch.column(2).to_numpy().astype(np.int64), batch.column(3).to_numpy()
                lower = np.frombuffer(b"".join(batch.column(4).to_pylist()), dtype=np.float64).reshape(n, c.groups)
            new, upper, lower, _ = reassign(v, own, upper, lower, c)
            bounds = pa.array([row.tobytes() for row in lower], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(new, pa.int32()), pa.array(own, pa.int32()), pa.array(upper), bounds], names)

    columns = ["key", "v"] if first else ["key", "v", "cluster", "upper", "lower"]
    return state.select(*columns).mapInArrow(run, StructType([state.schema["key"], StructField("v", ArrayType(IntegerType())), *_STATE]))


def _changes(state: DataFrame, k: int, dimension: int) -> tuple[np.ndarray, np.ndarray]:
    """What the sums (k x dimension, as exact numbers) and counts of the clusters gain by the vectors that changed theirs: added up
    per batch, then by Spark. k * dimension numbers reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = _matrix(batch.column(0), dimension)
            sums, counts = np.zeros((k, dimension), dtype=np.int64), np.zeros(k, dtype=np.int64)
            for column, sign in ((1, 1), (2, -1)):
                cluster = batch.column(column).to_numpy()
                for i in np.unique(cluster[cluster >= 0]):
                    sums[i] += sign * v[cluster == i].sum(axis=0)
                    counts[i] += sign * int((cluster == i).sum())
            touched = np.flatnonzero(sums.any(axis=1) | (counts != 0))
            yield pa.RecordBatch.from_arrays([pa.array(touched, pa.int32()), pa.array(counts[touched]), pa.array(sums[touched].tolist(), pa.list_(pa.int64()))], ["i", "n", "s"])

    changed = state.filter("cluster <> was").select("v", "cluster", "was").mapInArrow(run, "i int, n long, s array<long>")
    each = changed.select("i", "n", F.posexplode("s").alias("j", "x"))
    added = each.groupBy("i", "j").agg(F.sum(F.col("x").cast("decimal(38,0)")).alias("x"), F.sum("n").alias("n")).collect()  # k * dimension rows
    sums, counts = np.zeros((k, dimension), dtype=object), np.zeros(k, dtype=object)
    for r in added:
        sums[r.i, r.j], counts[r.i] = int(r.x), int(r.n)
    return sums, counts


def yinyang(df: DataFrame, k: int, rounds: int, key: str = "vec_id", vector: str = "embedding", scale: int = 64, dimension: int = 64, seed: int = 1, groups: int | None = None) -> tuple[DataFrame, Centroids]:
    """(key, cluster, distance) of every vector kept, and the centroids: k-means with exact integers.

    Vectors that are null, of another length, or hold null, NaN or infinite components are left out; component x becomes
    floor(scale * x). The k keys with the smallest SHA-256 of `seed:key` give the first centroids, in that order (equal keys: by their
    vectors; null keys last; with fewer vectors, fewer centroids). Each round takes every vector to its nearest centroid by
    squared distance, ties to the smaller number, and moves centroids that have vectors to the floors of their means; then
    vectors are assigned once more. Repeated rows are vectors of their own; an empty table gives an empty one; of other
    columns nothing is read.

    By Yinyang, the centroids are grouped once (k / 8 groups unless given), and a vector carries an upper bound and one lower
    bound a group from round to round, in a table written to the shared folder. Sums change by the vectors that change
    cluster only. The driver holds k centroids and k * dimension sums."""
    kept = whole_vectors(df, key, vector, scale, dimension)
    text = F.concat(F.lit(f"{seed}:"), F.col("key").cast("string"))
    starts = kept.orderBy(F.sha2(text, 256).asc_nulls_last(), "v").limit(k).select("v").collect()
    at = np.array([r.v for r in starts], dtype=np.int64).reshape(-1, dimension)
    group = grouped(at, groups or max(1, len(at) // 8))
    c = Centroids(at, group, np.zeros(len(at)))
    sums, counts = np.zeros((len(at), dimension), dtype=object), np.zeros(len(at), dtype=object)
    state = kept
    for _ in range(rounds if len(at) else 0):
        state = materialize(_round(state, c, dimension), "assigned")
        more, n = _changes(state, len(at), dimension)
        sums, counts = sums + more, counts + n
        new = np.array([[int(x) // int(m) for x in s] if m else old for s, m, old in zip(sums, counts, c.at.tolist(), strict=True)], dtype=np.int64)
        c = c.to(new)
    if not len(at):
        return kept.select(F.col("key").alias(key), F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")), c
    last = _round(state, c, dimension)
    centres, final = c.at, c

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 4096):
            own = batch.column(2).to_numpy()
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(_squared(_matrix(batch.column(1), dimension), centres[own]))], [key, "cluster", "distance"])

    out = last.select("key", "v", "cluster").mapInArrow(exact, StructType([StructField(key, kept.schema["key"].dataType), StructField("cluster", IntegerType()), StructField("distance", LongType())]))
    return materialize(out, "clusters"), final


def with_inertia(assigned: DataFrame, c: Centroids) -> DataFrame:
    """assigned (key, cluster, distance) with the sum of distances over the cluster (cluster_inertia) and over all (inertia), and the SHA-256
    of the cluster's centroid, its components as decimal numbers joined by commas. One row a centroid reaches the driver."""
    sums = {r.cluster: int(r.s) for r in assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    total = sum(sums.values())
    table = assigned.sparkSession.createDataFrame([(i, sums[i], total, c.sha256(i)) for i in sorted(sums)], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return assigned.join(F.broadcast(table), "cluster").select(*assigned.columns, "cluster_inertia", "inertia", "centroid_sha256")
