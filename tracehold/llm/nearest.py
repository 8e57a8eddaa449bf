"""Approximate nearest neighbours by multiprobe p-stable hashing.

Each of TABLES tables hashes a vector by some projections on Gaussian directions, offset and cut into slots of one
width. A query visits its own bucket and the perturbed buckets most likely to hold its neighbours: steps to a
neighbouring slot are ranked by the distance to its border, and sets of steps are visited in order of the scores that
they have on average, so the order of sets is one table for all queries. The tables' candidates are merged and reranked
by exact distances.

Projections, slots and probes are fitted to PILOTS queries that are compared with every vector: of all settings, the one
is taken that finds RECALL of their true neighbours and visits the least share of a bounded sample. As more vectors
bring neighbours closer, that share falls.

Vectors stay where they are: each task indexes its own rows in runs of SHARD vectors, and answers blocks of queries of
at most QUERY_BYTES. Only a shard's k best of each query leave a task. All vectors are indexed.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracehold.llm.storage import written

TABLES, SEED = 48, 7
#: Queries that are compared with every vector and the share of their neighbours that a setting must find; rows of the sample.
PILOTS, RECALL, SAMPLE = 48, 0.93, 1_000
#: Settings that are tried: projections of a table, slot width as a multiple of the neighbours' median distance, most probes.
HASHES, WIDTHS, MOST_PROBES = (6, 9, 12, 16, 20), (1.5, 2.0, 3.0), 1_024
#: Vectors indexed together, bytes of queries answered in one pass, queries whose candidates are held together.
SHARD, QUERY_BYTES, TOGETHER = 65_536, 32 << 20, 64
#: What a probe costs, in vectors compared.
PROBE_COST = 0.5

FOUND = "query_id long, vec_id long, score double"


def step_sets(hashes: int, number: int) -> np.ndarray:
    """The first sets of steps in order of their expected scores, as places in a query's ranking of its 2 * hashes steps.

    The j-th smallest of the distances to slot borders is known on average; a set's score is the sum of the squares. A
    set holds no two steps of one projection, which are the places j and 2 * hashes - 1 - j. Rows are padded by -1; the
    first row is the empty set, the query's own bucket.
    """
    m = hashes
    j = np.arange(1, m + 1)
    low = j * (j + 1) / (4 * (m + 1) * (m + 2))
    high = 1 - (2 * m + 1 - np.arange(m + 1, 2 * m + 1)) / (m + 1) + (2 * m + 1 - np.arange(m + 1, 2 * m + 1)) * (2 * m + 2 - np.arange(m + 1, 2 * m + 1)) / (4 * (m + 1) * (m + 2))
    scores = np.concatenate([low, high]).tolist()
    found: list[tuple[int, ...]] = [()]
    heap = [(scores[0], (0,))]
    while heap and len(found) < number:
        cost, chosen = heapq.heappop(heap)
        if all(2 * m - 1 - c not in chosen for c in chosen):
            found.append(chosen)
        last = chosen[-1]
        if last + 1 < 2 * m:
            heapq.heappush(heap, (cost - scores[last] + scores[last + 1], (*chosen[:-1], last + 1)))
            heapq.heappush(heap, (cost + scores[last + 1], (*chosen, last + 1)))
    wide = max(map(len, found))
    return np.array([[*s, *[-1] * (wide - len(s))] for s in found], np.int64).reshape(len(found), wide)


class Hasher:
    """Projections of all tables: x -> (x @ directions + offsets) / width, and the sets of steps that a query visits."""

    def __init__(self, dimensions: int, hashes: int, width: float, probes: int, tables: int = TABLES):
        rng = np.random.Generator(np.random.PCG64(SEED))
        self.tables, self.hashes, self.width = tables, hashes, width
        self.directions = rng.standard_normal((dimensions, tables * hashes))
        self.offsets = rng.uniform(0, width, tables * hashes)
        self.odd = rng.integers(1, 1 << 62, hashes, dtype=np.int64) | 1
        self.sets = step_sets(hashes, probes)

    def places(self, x: np.ndarray) -> np.ndarray:
        return ((x @ self.directions + self.offsets) / self.width).reshape(len(x), self.tables, self.hashes)

    def keys(self, places: np.ndarray) -> np.ndarray:
        """The bucket of each vector in each table."""
        return (np.floor(places).astype(np.int64) * self.odd).sum(-1)

    def probes(self, places: np.ndarray) -> np.ndarray:
        """The buckets that each query visits in each table, in estimated order of success."""
        inside = places - np.floor(places)
        away = np.concatenate([inside, 1 - inside], -1)
        order = np.argsort(away, axis=-1, kind="stable")
        moves = np.concatenate([-self.odd, self.odd])[order]
        moves = np.concatenate([moves, np.zeros((*moves.shape[:2], 1), np.int64)], -1)  # place -1 moves nothing
        found = np.repeat(self.keys(places)[..., None], len(self.sets), -1)
        for k in range(self.sets.shape[1]):
            found += moves[..., self.sets[:, k]]
        return found


def fitted(queries: np.ndarray, near: list[np.ndarray], sample: np.ndarray, tables: int = TABLES) -> tuple[Hasher, float, float]:
    """The cheapest hasher that finds RECALL of near[i], the true neighbours of queries[i]; its recall and its share of sample.

    Settings that cannot reach it are left out; where none does, the one with the best recall is taken.
    """
    true = np.concatenate(near)
    owner = np.repeat(np.arange(len(near)), [len(n) for n in near])
    typical = max(float(np.median(np.linalg.norm(true - queries[owner], axis=1))), 1e-9)
    best = None
    for hashes in HASHES:
        for width in WIDTHS:
            hasher = Hasher(queries.shape[1], hashes, width * typical, MOST_PROBES, tables)
            visited = hasher.probes(hasher.places(queries))
            first = lambda keys, of: np.where((hit := visited[of] == keys[..., None]).any(-1), hit.argmax(-1), MOST_PROBES).min(-1)  # noqa: B023, E731
            found = np.concatenate([first(k[None], o[None]) for k, o in zip(hasher.keys(hasher.places(true)), owner, strict=True)])
            other = hasher.keys(hasher.places(sample))
            met = np.full((len(queries), len(sample)), MOST_PROBES)
            for t in range(tables):
                by = np.argsort(other[:, t], kind="stable")
                row = other[by, t]
                for q in range(len(queries)):
                    keys, at = np.unique(visited[q, t], return_index=True)
                    where = np.minimum(np.searchsorted(keys, row), len(keys) - 1)
                    met[q, by] = np.minimum(met[q, by], np.where(keys[where] == row, at[where], MOST_PROBES))
            for probes in sorted({round(2 ** (e / 3)) for e in range(31)}):
                recall, share = float((found < probes).mean()), float((met < probes).mean())
                cost = share + PROBE_COST * tables * min(probes, len(hasher.sets)) / SHARD
                rank = (recall < RECALL, cost if recall >= RECALL else -recall)
                if best is None or rank < best[0]:
                    best = rank, hashes, width * typical, probes, recall, share
    _, hashes, width, probes, recall, share = best
    return Hasher(queries.shape[1], hashes, width, probes, tables), recall, share


class _Shard:
    """The hash tables of some vectors of one length."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, hasher: Hasher | None):
        self.ids, self.x, self.hasher = ids, x, hasher
        if hasher:
            keys = hasher.keys(hasher.places(x))
            self.order = np.argsort(keys, axis=0, kind="stable")
            self.keys = np.take_along_axis(keys, self.order, 0)

    def candidates(self, queries: np.ndarray) -> np.ndarray:
        """Which vectors each query visits."""
        if not self.hasher:
            return np.ones((len(queries), len(self.x)), bool)
        seen = np.zeros((len(queries), len(self.x)), bool)
        visited = self.hasher.probes(self.hasher.places(queries))
        for t in range(self.hasher.tables):
            keys, column = visited[:, t].ravel(), self.keys[:, t]
            low, high = np.searchsorted(column, keys), np.searchsorted(column, keys, "right")
            hit = np.flatnonzero(high > low)
            sizes = high[hit] - low[hit]
            at = np.repeat(high[hit] - np.cumsum(sizes), sizes) + np.arange(sizes.sum())
            seen[np.repeat(hit // visited.shape[2], sizes), self.order[at, t]] = True
        return seen

    def best(self, names: np.ndarray, queries: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(query, ids, distances) of the k nearest candidates of each query, without its own rows; one for each id."""
        for first in range(0, len(names), TOGETHER):
            some = queries[first : first + TOGETHER]
            for name, q, mine in zip(names[first : first + TOGETHER].tolist(), some, self.candidates(some), strict=True):
                at = np.flatnonzero(mine & (self.ids != name))
                if not len(at):
                    continue
                gap = np.sqrt(((self.x[at] - q) ** 2).sum(1))
                if len(at) > 4 * k:  # all that are not farther than the k-th nearest different id
                    limit, wide = np.inf, 4 * k
                    while wide < len(at):
                        part = np.argpartition(gap, wide - 1)[:wide]
                        if len(np.unique(self.ids[at[part]])) >= k:
                            limit = gap[part].max()
                            break
                        wide *= 4
                    keep = gap <= limit
                    at, gap = at[keep], gap[keep]
                by = np.lexsort((self.ids[at], gap))
                _, once = np.unique(self.ids[at[by]], return_index=True)
                once = by[np.sort(once)[:k]]
                yield name, self.ids[at[once]], gap[once]


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, v array<double>) of the vectors that are not null or zero and hold only finite components."""
    v = F.col("embedding").cast("array<double>")
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.where("vec_id IS NOT NULL").select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).where(F.col("v").isNotNull() & (F.size("v") > 0) & F.coalesce(finite, F.lit(False))).where(F.exists("v", lambda x: x != 0))


def _matrices(ids: np.ndarray, column: pa.ListArray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Ids and vectors of a column, apart by length."""
    sizes, flat = column.value_lengths().to_numpy(), column.flatten().to_numpy()
    starts = np.cumsum(sizes) - sizes
    for n in np.unique(sizes).tolist():
        at = np.flatnonzero(sizes == n)
        yield ids[at], flat[starts[at][:, None] + np.arange(n)]


def _answered(rows: DataFrame, asked: dict[int, tuple[np.ndarray, np.ndarray]], hashers: dict[int, Hasher], k: int) -> DataFrame:
    """FOUND: the k best of each task's shards for asked (ids and vectors by length); lengths without a hasher are compared whole."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def answers(n: int) -> Iterator[pa.RecordBatch]:
            parts = held.pop(n)
            shard = _Shard(np.concatenate([i for i, _ in parts]), np.concatenate([x for _, x in parts]), hashers.get(n))
            got = list(shard.best(*asked[n], k))
            if got:
                names = np.repeat([q for q, _, _ in got], [len(i) for _, i, _ in got])
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(np.concatenate([i for _, i, _ in got])), pa.array(np.concatenate([g for _, _, g in got]))], ["query_id", "vec_id", "score"])

        held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        for batch in batches:
            for ids, x in _matrices(batch.column(0).to_numpy(), batch.column(1)):
                if (n := x.shape[1]) in asked:
                    held.setdefault(n, []).append((ids, x))
                    if sum(len(i) for i, _ in held[n]) >= SHARD:
                        yield from answers(n)
        for n in list(held):
            yield from answers(n)

    return rows.mapInArrow(found, FOUND)


def _merged(parts: DataFrame, k: int) -> DataFrame:
    best = Window.partitionBy("query_id").orderBy("score", "vec_id")
    once = parts.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    return once.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _by_length(rows: list) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    found: dict[int, list] = {}
    for r in rows:
        found.setdefault(len(r[1]), []).append(r)
    return {n: (np.array([r[0] for r in some], np.int64), np.array([r[1] for r in some], float)) for n, some in found.items()}


def hashers_of(rows: DataFrame, wanted: DataFrame, k: int, tables: int = TABLES) -> dict[int, tuple[Hasher, float, float]]:
    """For each length, its hasher with the measured recall and share of candidates.

    Of each length, at most PILOTS queries and SAMPLE vectors come to the driver, and as many vectors as the pilots have
    neighbours: k each.
    """
    lengths = [r["n"] for r in rows.groupBy(F.size("v").alias("n")).count().collect()]
    found = {}
    for n in lengths:
        of = rows.where(F.size("v") == n)
        some = lambda df, name, number: df.where(F.size("v") == n).orderBy(F.xxhash64(name, F.lit(SEED)), name, "v").limit(number).collect()  # noqa: B023, E731
        pilots = _by_length(some(wanted, "vec_id", PILOTS))
        if not pilots:
            continue
        near = written(_merged(_answered(of, pilots, {}, k), k), "nearest-pilots")
        rows_of = near.select("query_id", "vec_id").join(of, "vec_id").groupBy("query_id", "vec_id").agg(F.min("v").alias("v")).collect()
        names, matrix = pilots[n]
        sample = np.array([r["v"] for r in some(of, "vec_id", SAMPLE)], float)
        true = [np.array([r["v"] for r in rows_of if r["query_id"] == name], float).reshape(-1, n) for name in names.tolist()]
        if any(len(t) for t in true):
            found[n] = fitted(matrix, true, sample, tables)
    return found


def search(vectors: DataFrame, queries: DataFrame, k: int = 10, tables: int = TABLES) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row of queries the k nearest of vectors, but not itself, both (vec_id, embedding).

    score is the Euclidean distance in double precision; ties go to the smaller vec_id. Vectors that are null, zero, or
    hold a null or non-finite component take no part; distances are between vectors of one length. Rows that repeat a
    vec_id are one candidate, with the nearest of its vectors; as a query, an id stands for the least of its vectors.
    Vectors are hashed whatever their number. Queries that find fewer than k candidates by their probes are compared with
    all vectors. An empty table gives an empty result; other columns play no part.
    """
    rows = usable(vectors)
    wanted = written(usable(queries).groupBy("vec_id").agg(F.min("v").alias("v")), "nearest-queries")
    size = wanted.agg(F.count("*").alias("n"), F.sum(8 * F.size("v") + 16).alias("bytes")).first()
    if not size["n"]:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    hashers = {n: h for n, (h, _, _) in hashers_of(rows, wanted, k, tables).items()}

    def answered(some: DataFrame, own: dict[int, Hasher]) -> list[DataFrame]:
        """Each block's answers, written before the next block's queries come to the driver."""
        blocks = -(-(some.agg(F.sum(8 * F.size("v") + 16)).first()[0] or 0) // QUERY_BYTES)
        block = F.pmod(F.xxhash64("vec_id"), F.lit(max(blocks, 1)))
        return [written(_merged(_answered(rows, _by_length(some.where(block == b).collect()), own, k), k), "nearest-found") for b in range(blocks)]

    near = reduce(DataFrame.union, answered(wanted, hashers))
    if not hashers:
        return near
    full = near.groupBy("query_id").count().where(F.col("count") >= k).select(F.col("query_id").alias("vec_id"))
    short = written(wanted.join(full, "vec_id", "left_anti"), "nearest-short")
    rest = answered(short, {})
    if not rest:
        return near
    return reduce(DataFrame.union, rest, near.join(short.select(F.col("vec_id").alias("query_id")), "query_id", "left_anti"))
