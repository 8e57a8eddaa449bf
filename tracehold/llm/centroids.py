"""Clustering of integer vectors around centroids, filtered by n-simplex projection.

Some of the first centroids are pivots. Each vector's distances to the pivots are taken once and kept as an apex: the
place that the vector would have above the simplex of the pivots, as coordinates in the simplex and a height over it.
Two apexes are at most as far from each other as their vectors; with one of them mirrored to below the simplex, at least
as far. So a round compares apexes of a few coordinates first, and only centroids whose lower bound does not exceed the
least upper bound are compared in whole numbers, component by component.

Vectors stay in the tasks that read them. A task sends one sum per centroid, and the driver holds the centroids alone.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracehold.llm.storage import written

DIMENSIONS, CENTROIDS, ROUNDS, PIVOTS = 64, 40, 5, 16
#: Components are clamped to this, so that squared distances fit in 64 bits.
LARGEST = 1 << 26
#: Most vectors compared at a time; the worst ratio of the simplex's sides; the rounding of bounds, as a share of the squared lengths.
TOGETHER, WORST_CONDITION, ROUNDING = 1_024, 1e4, 1e-5

RESULT = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"


class Simplex:
    """Pivots, the first of which is the origin, and the apex of a vector given its squared distances to them."""

    def __init__(self, vectors: np.ndarray, most: int = PIVOTS):
        """Takes the vector farthest from the simplex so far, again and again, while the simplex stays well shaped."""
        shifted = (vectors - vectors[0]).astype(float)
        chosen, basis, rest = [0], np.zeros((0, vectors.shape[1])), shifted.copy()
        while len(chosen) < min(most, len(vectors)):
            far = (rest**2).sum(1)
            new = int(far.argmax())
            if far[new] <= 0:
                break
            sides = np.linalg.qr(shifted[[*chosen[1:], new]].T, mode="r").T
            if np.linalg.cond(sides) > WORST_CONDITION:
                break
            chosen.append(new)
            basis = np.vstack([basis, rest[new] / np.sqrt(far[new])])
            rest = shifted - shifted @ basis.T @ basis
        self.pivots = vectors[chosen]
        gram = (shifted[chosen[1:]] @ shifted[chosen[1:]].T).reshape(len(chosen) - 1, len(chosen) - 1)
        self.inverse = np.linalg.inv(np.linalg.cholesky(gram)) if len(chosen) > 1 else np.zeros((0, 0))
        self.sides = np.diag(gram)

    def distances(self, x: np.ndarray) -> np.ndarray:
        """Squared distances of integer vectors to the pivots."""
        own, others = (x - self.pivots[0]).astype(float), (self.pivots - self.pivots[0]).astype(float)
        return np.maximum((own**2).sum(1)[:, None] + (others**2).sum(1) - 2 * own @ others.T, 0)

    def apexes(self, squared: np.ndarray) -> np.ndarray:
        """Coordinates in the simplex of the pivots and, last, the height over it."""
        inside = (squared[:, :1] + self.sides - squared[:, 1:]) / 2 @ self.inverse.T
        return np.hstack([inside, np.sqrt(np.maximum(squared[:, :1] - (inside**2).sum(1, keepdims=True), 0))])


def candidates(apexes: np.ndarray, of_centroids: np.ndarray) -> np.ndarray:
    """Which centroids each vector's bounds leave: none that could be nearest is missing."""
    a, c = (apexes**2).sum(1), (of_centroids**2).sum(1)
    lower = a[:, None] + c - 2 * apexes @ of_centroids.T
    upper = lower + 4 * apexes[:, -1:] * of_centroids[:, -1]
    return lower <= upper.min(1, keepdims=True) + 2 * ROUNDING * (a[:, None] + c.max())


def nearest(x: np.ndarray, apexes: np.ndarray, centroids: np.ndarray, of_centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Number and squared distance of the nearest centroid of each vector, the smaller number in a tie, and how many were compared."""
    number, distance, compared = np.zeros(len(x), np.int32), np.zeros(len(x), np.int64), 0
    for at in range(0, len(x), TOGETHER):
        some = slice(at, at + TOGETHER)
        row, col = np.nonzero(candidates(apexes[some], of_centroids))
        found = np.full((len(x[some]), len(centroids)), np.iinfo(np.int64).max)
        found[row, col] = ((x[some][row] - centroids[col]) ** 2).sum(1)
        number[some], distance[some], compared = found.argmin(1), found.min(1), compared + len(row)
    return number, distance, compared


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, v) of the vectors that have DIMENSIONS components, all finite, as whole numbers of 1/256."""
    x = F.col("embedding").cast("array<double>")
    finite = F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("x")).where((F.size("x") == DIMENSIONS) & F.coalesce(finite, F.lit(False)))
    return rows.select("vec_id", F.transform("x", lambda c: F.floor(F.greatest(F.least(c * 256, F.lit(float(LARGEST))), F.lit(-float(LARGEST)))).cast("int")).alias("v"))


def first_centroids(rows: DataFrame, k: int, salt: str) -> np.ndarray:
    """The k vectors with the smallest hash of their id, in order; a null id counts as an empty text, repeated ids go by their vectors."""
    key = F.sha2(F.concat(F.lit(f"{salt}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    found = rows.select(key.alias("key"), "v").orderBy("key", "v").limit(k).collect()
    return np.array([r["v"] for r in found], np.int64).reshape(len(found), DIMENSIONS)


def _matrix(column: pa.Array, width: int, kind: type) -> np.ndarray:
    return column.flatten().to_numpy().astype(kind).reshape(-1, width)


def projected(rows: DataFrame, simplex: Simplex) -> DataFrame:
    """rows with their apex."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            apexes = simplex.apexes(simplex.distances(_matrix(batch.column(1), DIMENSIONS, np.int64)))
            offsets = pa.array(np.arange(len(apexes) + 1) * apexes.shape[1], pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.ListArray.from_arrays(offsets, pa.array(apexes.ravel()))], ["vec_id", "v", "apex"])

    return rows.mapInArrow(run, "vec_id long, v array<int>, apex array<double>")


def sums(rows: DataFrame, centroids: np.ndarray, of_centroids: np.ndarray) -> DataFrame:
    """(cluster, at, s): of each centroid, how many vectors it is nearest to (at 0) and their componentwise sums (from 2 on); at 1, how many were compared. Zeros are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n, compared = np.zeros(centroids.shape, np.int64), np.zeros(len(centroids), np.int64), 0
        for batch in batches:
            x = _matrix(batch.column(0), DIMENSIONS, np.int64)
            number, _, met = nearest(x, _matrix(batch.column(1), of_centroids.shape[1], float), centroids, of_centroids)
            order = np.argsort(number, kind="stable")
            own, starts = np.unique(number[order], return_index=True)
            if len(own):
                total[own] += np.add.reduceat(x[order], starts, axis=0)
            n += np.bincount(number, minlength=len(n))
            compared += met
        met = np.zeros(len(n), np.int64)
        met[:1] = compared
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(n), dtype=np.int32)), pa.array(n), pa.array(met), pa.array(total.tolist(), pa.list_(pa.int64()))], ["cluster", "n", "compared", "sums"])

    parts = rows.select("v", "apex").mapInArrow(run, "cluster int, n long, compared long, sums array<long>")
    each = parts.select("cluster", F.posexplode(F.concat(F.array("n", "compared"), "sums")).alias("at", "s"))
    return each.groupBy("cluster", "at").agg(F.sum("s").alias("s")).where("s <> 0")


def fit(rows: DataFrame, simplex: Simplex, start: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, list[float]]:
    """The centroids after some rounds over projected rows, and the share of centroids that each round compared."""
    centroids, shares = start.copy(), []
    for _ in range(rounds):
        found = np.zeros((len(start), 2 + DIMENSIONS), object)
        for r in sums(rows, centroids, simplex.apexes(simplex.distances(centroids))).collect():  # at most k times 66 rows
            found[r["cluster"], r["at"]] = r["s"]
        filled = found[:, 0] > 0
        centroids[filled] = found[filled, 2:] // found[filled, :1]
        shares.append(found[:, 1].sum() / max(1, found[:, 0].sum() * len(start)))
    return centroids, shares


def assigned(rows: DataFrame, centroids: np.ndarray, of_centroids: np.ndarray) -> DataFrame:
    """(vec_id, cluster, distance) of projected rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            number, distance, _ = nearest(_matrix(batch.column(1), DIMENSIONS, np.int64), _matrix(batch.column(2), of_centroids.shape[1], float), centroids, of_centroids)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(number), pa.array(distance)], ["vec_id", "cluster", "distance"])

    return rows.select("vec_id", "v", "apex").mapInArrow(run, "vec_id long, cluster int, distance long")


def cluster(vectors: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS, salt: str = "2", pivots: int = PIVOTS) -> DataFrame:
    """RESULT for each of vectors (vec_id, embedding): its cluster after some rounds, its squared distance, and sums of these.

    Vectors of another length, or with a null or non-finite component, take no part and are not returned. Rows that
    repeat a vec_id are vectors of their own; a null vec_id is kept. With fewer than k vectors there are as many
    centroids. Components beyond +-262,144 are clamped. A sum over 64 bits is null. No vectors give no rows.
    """
    spark = vectors.sparkSession
    rows = usable(vectors)
    start = first_centroids(rows, k, salt)
    if not len(start):
        return spark.createDataFrame([], RESULT)
    simplex = Simplex(start, pivots)
    rows = written(projected(rows, simplex), "centroid-apexes")
    centroids, _ = fit(rows, simplex, start, rounds)
    found = written(assigned(rows, centroids, simplex.apexes(simplex.distances(centroids))), "centroid-assigned")
    own = {r["cluster"]: int(r["s"]) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    fits = lambda n: n if n < 1 << 63 else None
    about = [(c, fits(n), fits(sum(own.values())), hashlib.sha256(",".join(map(str, centroids[c].tolist())).encode()).hexdigest()) for c, n in sorted(own.items())]
    dimension = spark.createDataFrame(about, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")  # at most k rows
    return found.join(F.broadcast(dimension), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
