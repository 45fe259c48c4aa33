"""Centroid clustering over integer vectors with a LAESA pivot table.

The distances of every vector to a few fixed pivots are computed once and
stored beside the vectors.  In each round a centroid c is at least
``max over pivots p of |d(v, p) - d(c, p)|`` away from v, so most centroids
are ruled out from the table alone; those that may be nearest get their exact
integer distance.  Sums, counts and the rounded means are exact integers.

Only the k centroids, their pivot distances and k sums leave the tasks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadlake.llm.scratch import Scratch

#: Vectors from which the pivots are chosen, and how many (parameters: they don't change the result, only how much is ruled out).
PIVOT_SAMPLE, PIVOTS = 1024, 16
#: Components lie below this in size, so that a squared distance fits a long.
LIMIT = 1 << 27
#: What float rounding may take from a lower bound, relative to the distances it is made of.
SLACK = 1e-12


def codes(embedding: str, dims: int, scale: int) -> Column:
    """The vector as integers floor(scale * x), NULL unless it has ``dims`` components, all finite.

    A component of 2^27 or more in size is an error: distances would not fit a long.
    """
    e = F.col(embedding)
    good = (F.size(e) == dims) & F.forall(e, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")), F.lit(False)))

    def code(x: Column) -> Column:
        y = F.floor(x.cast("double") * scale)
        return F.when(F.abs(x.cast("double") * scale) < LIMIT, y).otherwise(F.raise_error(F.lit("a component is too large for distances in a long")).cast("long"))

    return F.when(good, F.transform(e, code))


def _matrix(col: pa.Array, dtype: str, width: int) -> np.ndarray:
    """A column of equally long binaries as the rows of an array."""
    data = b"".join(x.as_py() for x in col)
    return np.frombuffer(data, dtype).reshape(len(col), width)


def farthest_first(sample: np.ndarray, n: int) -> np.ndarray:
    """Up to n different rows, each as far as possible from those before it (ties: the earlier row)."""
    chosen = sample[:1]
    gap = ((sample - sample[:1]) ** 2).sum(1)
    while len(chosen) < n and gap.max(initial=0) > 0:
        p = sample[int(gap.argmax())][None]
        chosen = np.vstack([chosen, p])
        gap = np.minimum(gap, ((sample - p) ** 2).sum(1))
    return chosen


def distances(x: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Euclidean distances of the rows of x to the points, as doubles of the exact squares."""
    return np.sqrt(np.stack([((x - p) ** 2).sum(1) for p in points], axis=1).astype(float))


def nearest(x: np.ndarray, table: np.ndarray, centroids: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Nearest centroid of each row (ties: the smaller number), its exact squared distance, and how many were computed.

    ``table`` holds the rows' distances to the pivots.
    """
    n, k = len(x), len(centroids)
    of_centroids = distances(centroids, pivots)
    bound = np.zeros((n, k))
    for p in range(len(pivots)):
        a, b = table[:, p, None], of_centroids[None, :, p]
        np.maximum(bound, np.abs(a - b) - SLACK * (a + b), out=bound)
    rows = np.arange(n)
    near = bound.argmin(1)  # the most promising one first: its distance rules out others
    best = ((x - centroids[near]) ** 2).sum(1)
    first, made = near.copy(), n
    for c in range(k):
        left = rows[(first != c) & (bound[:, c] <= np.sqrt(best.astype(float)) * (1 + SLACK))]
        d = ((x[left] - centroids[c]) ** 2).sum(1)
        made += len(left)
        better = (d < best[left]) | ((d == best[left]) & (c < near[left]))
        near[left[better]], best[left[better]] = c, d[better]
    return near, best, made


def _store(dims: int, pivots: np.ndarray) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = b.column("codes").flatten().to_numpy(zero_copy_only=False).reshape(len(b), dims)
            table = distances(x, pivots)
            yield pa.RecordBatch.from_arrays(
                [b.column("vec_id"), pa.array([r.tobytes() for r in x.astype("<i4")], pa.binary()), pa.array([r.tobytes() for r in table], pa.binary())], ["vec_id", "v", "to_pivots"])
    return run


def _read(b: pa.RecordBatch, dims: int, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return _matrix(b.column("v"), "<i4", dims).astype(np.int64), _matrix(b.column("to_pivots"), "<f8", len(pivots))


def _sums(centroids: np.ndarray, pivots: np.ndarray) -> Callable:
    """Per task and cluster: its vectors' componentwise sums, and their number as the last entry."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k, dims = centroids.shape
        total = np.zeros((k, dims + 1), np.int64)
        for b in batches:
            x, table = _read(b, dims, pivots)
            near, _, _ = nearest(x, table, centroids, pivots)
            np.add.at(total, near, np.hstack([x, np.ones((len(x), 1), np.int64)]))
        yield pa.RecordBatch.from_arrays([pa.array(range(k), pa.int32()), pa.array(total.tolist(), pa.list_(pa.int64()))], ["cluster", "sums"])
    return run


def _members(centroids: np.ndarray, pivots: np.ndarray) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            near, best, made = nearest(*_read(b, centroids.shape[1], pivots), centroids, pivots)
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), pa.array(near, pa.int32()), pa.array(best), pa.array(np.r_[made, np.zeros(max(0, len(b) - 1), np.int64)][:len(b)])],
                                             ["vec_id", "cluster", "distance", "n_exact"])
    return run


def moved(centroids: np.ndarray, sums: DataFrame) -> np.ndarray:
    """The rounded-down means of the clusters; empty ones stay.  ``sums``: cluster, sums of each task."""
    cells = sums.select("cluster", F.posexplode("sums").alias("pos", "x")).groupBy("cluster", "pos").agg(F.sum(F.col("x").cast("decimal(38,0)")).alias("x"))
    total = [[0] * (centroids.shape[1] + 1) for _ in centroids]
    for r in cells.collect():  # k * (dims + 1) numbers
        total[r["cluster"]][r["pos"]] = int(r["x"])
    return np.array([[s // t[-1] for s in t[:-1]] if t[-1] else c.tolist() for t, c in zip(total, centroids, strict=True)], np.int64)


def cluster(vectors: DataFrame, k: int = 16, rounds: int = 3, dims: int = 64, scale: int = 64, seed: int = 1) -> DataFrame:
    """Lloyd's algorithm over integer vectors, exact in every step.

    ``vectors``: vec_id long, embedding array of a float type; other columns,
    whatever their names, are ignored.  A vector without exactly ``dims``
    components, or with a null or non-finite one, gives no row.  Centroids
    start as the k vectors with the smallest SHA-256 of ``seed:vec_id`` (rows
    with one id: in the order of their components; rows without an id come
    last).  With fewer than k vectors each one starts a centroid; without any
    the result is empty.  Repeated rows count each.

    Returns vec_id, cluster int, distance long (squared), cluster_inertia long,
    inertia long, centroid_sha256, and n_exact long, whose sum is the number of
    exact distances that the last round needed.
    """
    spark = vectors.sparkSession
    schema = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string, n_exact long"
    scratch = Scratch(spark, "centroids")
    kept = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), codes("embedding", dims, scale).alias("codes")).where("codes is not null")
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    head = kept.orderBy(key.asc_nulls_last(), "codes").limit(max(PIVOT_SAMPLE, k)).select("codes").collect()
    if not head:
        return spark.createDataFrame([], schema)
    sample = np.array([r["codes"] for r in head], np.int64)
    centroids, pivots = sample[:k], farthest_first(sample[:max(PIVOT_SAMPLE, k)], PIVOTS)
    table = scratch.keep(kept.mapInArrow(_store(dims, pivots), "vec_id long, v binary, to_pivots binary"), "table")
    for _ in range(rounds):
        centroids = moved(centroids, table.mapInArrow(_sums(centroids, pivots), "cluster int, sums array<long>"))
    members = scratch.keep(table.mapInArrow(_members(centroids, pivots), "vec_id long, cluster int, distance long, n_exact long"), "members")
    scratch.drop("table")
    inertia = {r["cluster"]: int(r["s"]) for r in members.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    rows = [(c, s, sum(inertia.values()), digest[c]) for c, s in inertia.items()]
    per = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return members.join(F.broadcast(per), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256", "n_exact")  # k rows
