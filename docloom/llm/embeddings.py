"""Near-duplicate embeddings by product quantisation.

Vectors of unit length go to the inverted list of the nearest coarse centroid; residuals are
coded by one codeword per subspace. A cosine of at least c is a distance of at most r. Two such
neighbours in different lists lie on either side of the plane halfway between the two centroids,
and their distances to it add up to at most r: one of them is within r / 2 of it. So a vector
probes every list whose plane is that near, in any dimension and whatever the fit, and no link
is lost; a pair that both sides find counts in the lower list. In a probed list the vector
compares itself with the codes by table lookups (asymmetric distance less the coded vector's own
coding error bounds the true distance from below, which loses nothing), and with the vectors
that pass by exact cosines.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.llm.components import components
from docloom.session import with_checkpoints

SUBSPACES = 8
WORDS = 64
SLACK = 1e-6  # on distances, far above rounding
PLACED = "row_id long, label {label}, size int, list int, home int, own boolean, code binary, error double, probed binary, vector binary"


def _nearest(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances, points x centres."""
    cross = points @ centres.T
    return np.maximum((points**2).sum(1)[:, None] - 2 * cross + (centres**2).sum(1)[None, :], 0)


def kmeans(points: np.ndarray, k: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    centres = points[rng.choice(len(points), min(k, len(points)), replace=False)]
    for _ in range(rounds):
        nearest = _nearest(points, centres).argmin(axis=1)
        count = np.bincount(nearest, minlength=len(centres))
        total = np.zeros_like(centres)
        np.add.at(total, nearest, points)
        used = count > 0
        centres[used] = total[used] / count[used, None]
    return centres


@dataclass
class Quantiser:
    dimension: int
    centres: np.ndarray  # lists x padded dimension
    words: np.ndarray  # subspaces x words x width
    radius: float

    def padded(self, vectors: np.ndarray) -> np.ndarray:
        short = self.centres.shape[1] - vectors.shape[1]
        return np.pad(vectors, ((0, 0), (0, short))) if short else vectors

    def tables(self, residuals: np.ndarray) -> np.ndarray:
        """Squared distances of each residual's parts to the codewords: rows x subspaces x words."""
        parts = residuals.reshape(len(residuals), *self.words.shape[::2])
        return np.stack([_nearest(parts[:, s], self.words[s]) for s in range(len(self.words))], axis=1)

    def encode(self, residuals: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes and the distance of each residual to its coded form."""
        table = self.tables(residuals)
        codes = table.argmin(axis=2)
        return codes.astype(np.uint8), np.sqrt(table.min(axis=2).sum(axis=1))

    def probes(self, vectors: np.ndarray, own: np.ndarray, distances: np.ndarray) -> np.ndarray:
        """For each vector and list but its own: whether to look for neighbours there."""
        mine = distances[np.arange(len(vectors)), own]
        between = np.sqrt(_nearest(self.centres[own], self.centres))
        reach = (distances - mine[:, None]) / np.maximum(2 * between, 1e-12)
        others = np.arange(len(self.centres))[None, :] != own[:, None]
        return others & ((reach <= self.radius / 2 + SLACK) | (between < 1e-9))


def fit(vectors: np.ndarray, lists: int, radius: float, seed: int = 11) -> Quantiser:
    """Coarse centroids and residual codewords from unit vectors; the fit only decides the cost."""
    rng = np.random.default_rng(seed)
    width = -(-vectors.shape[1] // SUBSPACES)
    points = np.pad(vectors, ((0, 0), (0, width * SUBSPACES - vectors.shape[1])))
    centres = kmeans(points, lists, 8, rng)
    residuals = points - centres[_nearest(points, centres).argmin(axis=1)]
    parts = residuals.reshape(len(points), SUBSPACES, width)
    few = [kmeans(parts[:, s].copy(), WORDS, 6, rng) for s in range(SUBSPACES)]
    return Quantiser(vectors.shape[1], centres, np.stack(few), radius)


def _clean(vectors: pd.Series) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """For each length, the rows that can be compared, and those rows as doubles."""
    found: dict[int, tuple[list[int], list[np.ndarray]]] = {}
    for i, v in enumerate(vectors):
        if v is None or not len(v):
            continue
        x = np.asarray(v, dtype=np.float64)
        if np.isfinite(x).all() and x.any():
            good, rows = found.setdefault(len(x), ([], []))
            good.append(i)
            rows.append(x)
    return {size: (np.array(good, np.int64), np.array(rows)) for size, (good, rows) in found.items()}


def _train(rows: DataFrame, min_cosine: float, sample_rows: int, max_lists: int) -> dict[int, Quantiser]:
    """A quantiser for each length of vectors (lengths are few: each is a job), from a sample of its rows by hash."""
    size = F.size("embedding")
    counts = rows.filter(size > 0).groupBy(size.alias("size")).agg(F.count("*").alias("n")).orderBy("size").collect()
    radius = float(np.sqrt(max(0.0, 2 - 2 * min_cosine)))
    found = {}
    for dimension, n in counts:
        own = rows.filter(size == dimension).orderBy(F.xxhash64("row_id")).limit(sample_rows)
        _, vectors = _clean(own.select("embedding").toPandas()["embedding"]).get(dimension, (None, np.zeros((0, 1))))
        # rows that cannot be compared are no reason to leave a length out: without a usable sample all share one list
        vectors = vectors if len(vectors) else np.ones((1, dimension))
        lists = int(np.clip(np.sqrt(n) / 4, 1, min(max_lists, max(1, len(vectors) // 8))))
        found[dimension] = fit(vectors / np.linalg.norm(vectors, axis=1, keepdims=True), lists, radius)
    return found


def _place(rows: DataFrame, quantisers: dict[int, Quantiser], kind: str) -> DataFrame:
    """PLACED: each comparable vector in its own list, with its code, and in the lists it probes."""
    held = rows.sparkSession.sparkContext.broadcast(quantisers)

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = (b.iloc[start : start + 2048] for b in batches for start in range(0, len(b), 2048))
        for part in parts:
            for size, (good, vectors) in _clean(part["embedding"]).items():
                q = held.value[size]
                unit = q.padded(vectors / np.linalg.norm(vectors, axis=1, keepdims=True))
                distances = _nearest(unit, q.centres)
                own = distances.argmin(axis=1)
                codes, errors = q.encode(unit - q.centres[own])
                probes = q.probes(unit, own, distances)
                who, where = np.nonzero(probes)
                all_rows, n = np.concatenate([np.arange(len(good)), who]), len(good)
                raw = [v.tobytes() for v in vectors.astype(kind)]
                yield pd.DataFrame(
                    {
                        "row_id": part["row_id"].to_numpy()[good][all_rows],
                        "label": part["label"].iloc[good[all_rows]].reset_index(drop=True),
                        "size": np.int32(size),
                        "list": np.concatenate([own, where]).astype(np.int32),
                        "home": own[all_rows].astype(np.int32),
                        "own": np.arange(len(all_rows)) < n,
                        "code": [c.tobytes() for c in codes] + [b""] * len(who),
                        "error": np.concatenate([errors, np.zeros(len(who))]),
                        "probed": [p.tobytes() for p in np.packbits(probes, axis=1)] + [b""] * len(who),
                        "vector": [raw[i] for i in all_rows],
                    }
                )

    label = rows.schema["label"].dataType.simpleString()
    return rows.select("row_id", "label", "embedding").mapInPandas(place, PLACED.format(label=label))


def compare(tile: pd.DataFrame, quantiser: Quantiser, min_cosine: float, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """Linked pairs (positions in the tile pair) between its two tiles, or within the one tile.

    The first tile has rows of the list; the second the same, others of the list, or visitors. A
    visitor from a lower list leaves out the rows that probe that list: they meet there.
    """
    side = tile["side"].to_numpy()
    within = tile["tile_a"].iloc[0] == tile["tile_b"].iloc[0]
    members = np.flatnonzero(side == tile["tile_a"].iloc[0])
    others = members if within else np.flatnonzero(side != tile["tile_a"].iloc[0])
    if not len(members) or not len(others):
        return members[:0], members[:0]
    vectors = np.stack([np.frombuffer(v, kind) for v in tile["vector"]]).astype(np.float64)
    length = np.linalg.norm(vectors, axis=1)
    residuals = quantiser.padded(vectors / length[:, None]) - quantiser.centres[int(tile["list"].iloc[0])]
    codes = np.stack([np.frombuffer(c, np.uint8) for c in tile["code"].to_numpy()[members]])
    errors = tile["error"].to_numpy()[members]
    probed = np.stack([np.frombuffer(p, np.uint8) for p in tile["probed"].to_numpy()[members]])
    probed = np.unpackbits(probed, axis=1).astype(bool)
    home = tile["home"].to_numpy()
    left, right = [], []
    for start in range(0, len(others), 64):
        rows = others[start : start + 64]
        table = quantiser.tables(residuals[rows])
        distance = sum(table[:, s, :][:, codes[:, s]] for s in range(codes.shape[1]))
        near = np.sqrt(distance) - errors[None, :] <= quantiser.radius + SLACK
        if within:
            near &= rows[:, None] < members[None, :]
        else:
            near &= (home[rows] >= tile["list"].iloc[0])[:, None] | ~probed[:, home[rows]].T
        a, b = np.nonzero(near)
        a, b = rows[a], members[b]
        cosine = np.einsum("ij,ij->i", vectors[a], vectors[b]) / (length[a] * length[b])
        linked = cosine >= min_cosine
        left.append(a[linked])
        right.append(b[linked])
    return np.concatenate(left), np.concatenate(right)


def _least_in_component(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Label of each of n points: the least position joined to it by the pairs."""
    label = np.arange(n)
    while True:
        least = label.copy()
        np.minimum.at(least, a, label[b])
        np.minimum.at(least, b, label[a])
        least = least[least]
        if np.array_equal(least, label):
            return label
        label = least


def _links(placed: DataFrame, quantisers: dict[int, Quantiser], min_cosine: float, tile_rows: int, kind: str) -> DataFrame:
    """row_id, n_links, least: links found in each pair of tiles and a row each row is joined to there.

    The rows of a list fill its first tiles, the visitors the others, twice as many in each. Tiles of
    the list meet each other and themselves, visitors' tiles those of the list only.
    """
    held = placed.sparkSession.sparkContext.broadcast(quantisers)
    key = ["label", "size", "list"]
    own = F.col("own")
    tiles = lambda flag, rows: F.ceil(F.sum(flag.cast("int")) / rows).cast("int")
    sizes = placed.groupBy(*key).agg(
        tiles(own, tile_rows).alias("own_tiles"), tiles(~own, 2 * tile_rows).alias("visitor_tiles"), F.count("*").alias("n")
    )
    tiled = placed.join(sizes.filter("own_tiles > 0 and n > 1").drop("n"), key)
    spread = F.xxhash64("row_id")
    side = F.when(own, F.pmod(spread, F.col("own_tiles"))).otherwise(
        F.col("own_tiles") + F.pmod(spread, F.col("visitor_tiles"))
    )
    met = F.when(own, F.col("own_tiles") + F.col("visitor_tiles")).otherwise(F.col("own_tiles"))
    paired = tiled.withColumns({"side": side.cast("int"), "other": F.explode(F.sequence(F.lit(0), met - 1))}).select(
        *key, "row_id", "home", "code", "error", "probed", "vector", "side",
        F.least("side", "other").alias("tile_a"), F.greatest("side", "other").alias("tile_b"),
    )

    def join_tile(tile: pd.DataFrame) -> pd.DataFrame:
        tile = tile.sort_values("row_id", ignore_index=True)
        a, b = compare(tile, held.value[int(tile["size"].iloc[0])], min_cosine, kind)
        n = np.bincount(np.concatenate([a, b]), minlength=len(tile))
        rows = tile["row_id"].to_numpy()
        out = pd.DataFrame({"row_id": rows, "n_links": n, "least": rows[_least_in_component(len(tile), a, b)]})
        return out[n > 0]

    return paired.groupBy(*key, "tile_a", "tile_b").applyInPandas(join_tile, "row_id long, n_links long, least long")


def near_vectors(
    vectors: DataFrame,
    min_cosine: float = 0.93,
    sample_rows: int = 8_192,
    max_lists: int = 1024,
    tile_rows: int = 2048,
) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of vectors (vec_id, embedding, label).

    Two rows are linked when their labels are equal and not null and their cosine in doubles is
    min_cosine or more; vectors of different lengths have none. Labels of any type that Spark groups by are compared as
    they are. Vectors that are null, empty, zero or hold null or non-finite components are linked with nothing.
    component_id is the least vec_id reachable; kept marks the row that carries it. Repeated rows
    are vectors of their own. A row without vec_id names no component (null if alone, then kept).
    No link is lost.

    Lists number a quarter of the root of the rows, up to max_lists, and are fitted on at most
    sample_rows rows. A list is cut into tiles of about tile_rows rows, and pairs of tiles are groups:
    a list that holds a third of all rows is many small groups, and tasks hand back one row for
    each row of a tile, never pairs.
    """
    spark = vectors.sparkSession
    with_checkpoints(spark)
    rows = vectors.select(
        "vec_id", "label", F.col("embedding").cast("array<double>").alias("embedding")
    ).withColumn("row_id", F.monotonically_increasing_id()).checkpoint()
    usable = rows.filter("label is not null and embedding is not null")
    quantisers = _train(usable, min_cosine, sample_rows, max_lists)
    kind = "<f4" if vectors.schema["embedding"].dataType.elementType == T.FloatType() else "<f8"
    ids = rows.select("row_id", "vec_id")
    if not quantisers:
        found = ids.select("row_id", F.lit(0).cast("bigint").alias("n_links"), F.col("row_id").alias("least")).limit(0)
    else:
        placed = _place(usable, quantisers, kind).checkpoint()
        found = _links(placed, quantisers, min_cosine, tile_rows, kind).checkpoint()
    joined = components(found.select(F.col("row_id").alias("a"), F.col("least").alias("b")))
    counts = found.groupBy("row_id").agg(F.sum("n_links").alias("n_links"))
    rooted = ids.join(joined.withColumnRenamed("node", "row_id"), "row_id", "left")
    rooted = rooted.withColumn("root", F.coalesce("root", "row_id"))
    names = rooted.groupBy("root").agg(F.min("vec_id").alias("component_id"))
    return (
        rooted.join(names, "root")
        .join(counts, "row_id", "left")
        .select(
            "vec_id",
            F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"),
            "component_id",
            F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept"),
        )
    )
