"""Centroid clustering with whole numbers: equal-average equal-variance nearest centroid search.

Vectors and centroids are integers, so that every distance, sum and floor is exact and results do
not depend on the order of rows. With component sums S and deviations D (D^2 = k |x|^2 - S^2),
k times the squared distance of two vectors of k components is at least (Sx - Sc)^2, and at least
(Sx - Sc)^2 + (Dx - Dc)^2. Centroids are sorted by mean; a vector starts at its own mean and looks
outward on both sides. A side ends where the first bound exceeds the best distance, a centroid is
passed over where the second does, and the rest is compared in full.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.session import with_checkpoints

SCALE = 64
LARGEST = 1 << 24  # components below it keep distances of 64 components within a long
BLOCK = 8192


class Centroids:
    """Integer centroids, sorted by their means for the search."""

    def __init__(self, vectors: np.ndarray):
        """vectors: one row a centroid, in the order of their numbers."""
        sums = vectors.sum(axis=1)
        self.order = np.argsort(sums, kind="stable")  # equal means: smaller number first
        self.vectors, self.sums = vectors[self.order], sums[self.order]
        self.deviations = deviations(self.vectors, self.sums)

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number of the nearest centroid (ties: the smaller) and squared distance, for each row of x."""
        k, n = x.shape[1], len(self.order)
        sums = x.sum(axis=1)
        spread = deviations(x, sums)
        high = np.searchsorted(self.sums, sums)  # next to look at above the own mean
        low = high - 1  # and below
        best = np.full(len(x), np.iinfo(np.int64).max)
        number = np.full(len(x), n)
        rows = np.arange(len(x))
        far = np.iinfo(np.int64).max
        while len(rows):
            s, lo, hi = sums[rows], low[rows], high[rows]
            below = np.where(lo >= 0, s - self.sums[np.maximum(lo, 0)], far)
            above = np.where(hi < n, self.sums[np.minimum(hi, n - 1)] - s, far)
            down = below <= above
            gap = np.where(down, below, above)
            at = np.where(down, lo, hi)
            # the nearer side's gap bounds all that is left on both sides
            open_ = (gap != far) & ((number[rows] == n) | ~_exceeds(gap, 0.0, k, best[rows]))
            rows, gap, at, down = rows[open_], gap[open_], at[open_], down[open_]
            low[rows[down]] -= 1
            high[rows[~down]] += 1
            apart = spread[rows] - self.deviations[at]
            # rounding of the deviations is far below this slack
            apart = np.maximum(np.abs(apart) - 1e-6 * (1.0 + spread[rows] + self.deviations[at]), 0.0)
            compared = (number[rows] == n) | ~_exceeds(gap, apart, k, best[rows])
            row, c = rows[compared], at[compared]
            distance = np.square(x[row] - self.vectors[c]).sum(axis=1)
            named = self.order[c]
            better = (distance < best[row]) | ((distance == best[row]) & (named < number[row]))
            best[row[better]], number[row[better]] = distance[better], named[better]
        return number, best


def _exceeds(gap: np.ndarray, apart: np.ndarray | float, k: int, best: np.ndarray) -> np.ndarray:
    """Whether gap^2 + apart^2 is above k times the best distance, with room for rounding."""
    g = gap.astype(float)
    return (g * g + np.square(apart)) * (1 - 1e-9) > k * best.astype(float)


def deviations(x: np.ndarray, sums: np.ndarray) -> np.ndarray:
    """D of each row: the square root of k |x|^2 - S^2."""
    squares = np.square(x.astype(float)).sum(axis=1)
    return np.sqrt(np.maximum(x.shape[1] * squares - np.square(sums.astype(float)), 0.0))


def _finite(x: Column) -> Column:
    return x.isNotNull() & (F.abs(x) < float("inf"))  # NaN counts as above infinity


def integer_vectors(vectors: DataFrame, size: int = 64) -> DataFrame:
    """vec_id, vector (array<bigint>): floor(64 x) of the vectors with `size` components, none null or not finite."""
    values = F.col("embedding").cast("array<double>")
    kept = vectors.select("vec_id", values.alias("v")).filter((F.size("v") == size) & F.forall("v", _finite))
    return kept.select("vec_id", F.transform("v", lambda x: F.floor(x * F.lit(float(SCALE)))).alias("vector"))


def start_vectors(vectors: DataFrame, n: int, seed: int) -> np.ndarray:
    """The n vectors with the smallest sha256 of seed:vec_id, in that order; repeated ids by their vectors."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    rows = vectors.select(key.alias("key"), "vector").orderBy("key", "vector").limit(n).collect()  # n rows
    return np.array([r["vector"] for r in rows], np.int64)


def _blocks(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[pa.Array, np.ndarray]]:
    for batch in batches:
        for first in range(0, batch.num_rows, BLOCK):
            part = batch.slice(first, BLOCK)
            values = part.column("vector").flatten().to_numpy(zero_copy_only=False)
            x = values.astype(np.int64, copy=False).reshape(-1, size)
            if len(x) and max(-int(x.min()), int(x.max())) >= LARGEST:
                raise ValueError(f"components from {LARGEST // SCALE} on have no exact distance in a long")
            yield part.column("vec_id"), x


def assigned(vectors: DataFrame, centroids: np.ndarray) -> DataFrame:
    """vec_id, cluster, distance of every vector. Centroids (n x size numbers) travel with the tasks."""
    size = centroids.shape[1]

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = Centroids(centroids)
        for ids, x in _blocks(batches, size):
            number, distance = table.nearest(x)
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(number.astype(np.int32)), pa.array(distance)], ["vec_id", "cluster", "distance"]
            )

    kind = vectors.schema["vec_id"].dataType.simpleString()
    return vectors.mapInArrow(search, f"vec_id {kind}, cluster int, distance bigint")


def _sums(vectors: DataFrame, centroids: np.ndarray) -> dict[int, tuple[int, list[int]]]:
    """Vectors and component sums of each cluster: summed inside each task, then once more; one row a cluster returns."""
    n, size = centroids.shape

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, counts, sums = Centroids(centroids), np.zeros(n, np.int64), np.zeros((n, size), np.int64)
        for _, x in _blocks(batches, size):
            number, _ = table.nearest(x)
            order = np.argsort(number, kind="stable")
            present, starts = np.unique(number[order], return_index=True)
            counts += np.bincount(number, minlength=n)
            sums[present] += np.add.reduceat(x[order], starts, axis=0)
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays(
            [pa.array(used.astype(np.int32)), pa.array(counts[used]), pa.array(list(sums[used]), pa.list_(pa.int64()))],
            ["cluster", "n", "sums"],
        )

    parts = vectors.mapInArrow(search, "cluster int, n bigint, sums array<bigint>")
    total = [F.sum(F.col("sums")[i].cast("decimal(38,0)")).alias(f"s{i}") for i in range(size)]
    rows = parts.groupBy("cluster").agg(F.sum("n").alias("n"), *total).collect()  # n rows at most
    return {r["cluster"]: (r["n"], [int(r[f"s{i}"]) for i in range(size)]) for r in rows}


def fit(vectors: DataFrame, n: int = 16, rounds: int = 3, seed: int = 1) -> np.ndarray:
    """Centroids after `rounds` rounds of assignment and floored means; a centroid without vectors stays.

    vectors: vec_id, vector. All vectors count in every round. The result has as many rows as
    there are vectors, n at most.
    """
    centroids = start_vectors(vectors, n, seed)
    for _ in range(rounds if len(centroids) else 0):
        for cluster, (count, sums) in _sums(vectors, centroids).items():
            centroids[cluster] = [s // count for s in sums]
    return centroids


def digest(centroid: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, centroid.tolist())).encode()).hexdigest()


def cluster(vectors: DataFrame, n: int = 16, rounds: int = 3, seed: int = 1, size: int = 64) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of every kept row of vectors (vec_id, embedding).

    Kept are vectors of `size` components, none null, infinite or NaN; the others have no row, and a
    table without kept vectors gives none. Repeated rows count each time, rows without vec_id like
    any other. Components reach 2^18 at most: beyond, distances would not fit a long and the job
    ends with an error. An inertia that does not fit is null. No vector is shuffled: tasks return
    the sums of their clusters, and a cluster of any size is one row a task.
    """
    with_checkpoints(vectors.sparkSession)
    whole = integer_vectors(vectors, size)
    centroids = fit(whole, n, rounds, seed)
    if not len(centroids):
        centroids = np.zeros((1, size), np.int64)  # no vector will ask for it
    found = assigned(whole, centroids).checkpoint()
    sums = found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()  # n rows
    total = sum(int(r["s"]) for r in sums)
    number = lambda s: F.lit(s if s < 1 << 63 else None).cast("bigint")
    by_cluster = {r["cluster"]: int(r["s"]) for r in sums}
    pick = lambda values: reduce(
        lambda out, c: out.when(F.col("cluster") == c, values[c]), sorted(values), F.when(F.lit(False), None)
    )
    return found.select(
        "vec_id", "cluster", "distance",
        pick({c: number(s) for c, s in by_cluster.items()}).cast("bigint").alias("cluster_inertia"),
        number(total).alias("inertia"),
        pick({c: F.lit(digest(centroids[c])) for c in by_cluster}).cast("string").alias("centroid_sha256"),
    )
