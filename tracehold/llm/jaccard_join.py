"""N-gram Jaccard join: documents whose sets of word shingles are similar, found by a size-aware heavy-light join.

Documents with one and the same set are one class from the start. Small sets enumerate fixed-size subsets: two sets of
sizes n and m are similar exactly if they share a subset of ceil(t / (1 + t) * (n + m)) shingles, so equal subsets are
links without further test. Large sets scan inverted lists: with all shingles in one order, rarest last-known first, two
similar sets share a shingle among their first n - ceil(t * n) + 1. The size that parts small from large is the one
with the least cost, counted from the table of sizes.

Inverted lists are not expanded into pairs. Each list first compares its sets with one pivot per size band, the set with
the smallest share of shingles that recur nowhere (copies that were edited have more of them than what they were copied
from); the links found join most of a group of copies. Only lists that still hold sets of different components are
expanded, and only into pairs of different components. A pair is left to the list of its first common shingle: what either
set has before it cannot be shared, and what is left must suffice. Pairs whose parity sketches differ in more bits than similar
sets can differ in shingles are dropped before any text is fetched; that bound is exact.

The order in which shingles are taken never changes the result, only the lengths of the lists: shingles that many
documents share come last. They are those that recur within a task's runs of documents, summed over all tasks.
Shingles and sets are compared by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import ceil, comb, floor, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracehold.llm import words
from tracehold.llm.components import components
from tracehold.llm.storage import discard, written

SHINGLE = 5
#: Similarity as a ratio of whole numbers: numerator * union <= denominator * intersection.
SIMILARITY = (80, 100)
#: Shingles kept as frequent ones, and how often they must recur among RUN shingles of a task to be counted.
FREQUENT, RECUR, RUN = 400_000, 3, 4_000_000
#: Largest size that may count as small, and the cost of a list entry against that of a subset.
LARGEST_SMALL, ENTRY_COST = 24, 4.0
#: Documents up to which the ids whose texts are to be compared are broadcast (8 bytes each); beyond, they are joined.
BROADCAST_IDS = 200_000

SKETCH_BITS = 1024

_SHINGLE_BASE = 0xD1342543DE82EF95


def least_overlap(n: int, m: int) -> int:
    """Shingles that sets of n and m must share to be similar."""
    a, b = SIMILARITY
    return -(-a * (n + m) // (a + b))


def shingle_sets(column: pa.Array) -> Iterator[tuple[int, list[np.ndarray]]]:
    """First row and the sorted distinct shingle hashes of each text, for runs of rows."""
    for row, data, offsets in words.texts(column):
        n = len(offsets) - 1
        doc, _, _, hashes = words.find_words(data, offsets, lower=True)
        at = words.bounds(doc, n)
        rolled = words.rolled(hashes, SHINGLE, _SHINGLE_BASE)
        found = []
        for first, last in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
            if last - first >= SHINGLE:
                found.append(np.unique(rolled[first : last - SHINGLE + 1]))
            elif last > first:
                found.append(words.rolled(hashes[first:last], last - first, _SHINGLE_BASE) + np.uint64(last - first))
            else:
                found.append(np.zeros(0, np.uint64))
        yield row, found


def signature(shingles: np.ndarray) -> int:
    """64 bits that stand for a set."""
    if not len(shingles):
        return 0
    spread = np.sum(words.mix(shingles), dtype=np.uint64, keepdims=True) * np.uint64(0x9FB21C651E98DF25)
    return int((spread ^ np.bitwise_xor.reduce(shingles)).view(np.int64)[0])


def sketch(shingles: np.ndarray) -> bytes:
    """For each of SKETCH_BITS buckets whether it has an odd number of shingles: two sketches differ in no more bits than the sets in shingles."""
    return np.packbits(np.bincount((shingles & np.uint64(SKETCH_BITS - 1)).astype(np.int64), minlength=SKETCH_BITS) & 1).tobytes()


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes, signs, sketches = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64), []
        for row, sets in shingle_sets(batch.column(1)):
            for k, s in enumerate(sets):
                sizes[row + k], signs[row + k] = len(s), signature(s)
                sketches.append(sketch(s) if len(s) else None)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes), pa.array(signs), pa.array(sketches, pa.binary())], ["doc_id", "n_shingles", "sig", "sketch"])


def _recurring(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def counted(held: list[np.ndarray]) -> pa.RecordBatch:
        values, counts = np.unique(np.concatenate(held), return_counts=True)
        keep = counts >= RECUR
        return pa.RecordBatch.from_arrays([pa.array(values[keep].view(np.int64)), pa.array(counts[keep].astype(np.int64))], ["h", "n"])

    held: list[np.ndarray] = []
    size = 0
    for batch in batches:
        for _, sets in shingle_sets(batch.column(0)):
            held += sets
            size += sum(map(len, sets))
            if size >= RUN:
                yield counted(held)
                held, size = [], 0
    if held:
        yield counted(held)


def _entries(frequent: np.ndarray, small: int):
    """Inverted-list entries of large sets (and of those small ones that a large set can be similar to)."""
    by_hash = np.argsort(frequent)
    ordered, ranks = frequent[by_hash], by_hash
    a, b = SIMILARITY

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            hs, sigs, ranks_of = [], [], []
            for _, sets in shingle_sets(batch.column(0)):
                for s in sets:
                    n = len(s)
                    if not n or n <= small and floor(n * b / a) <= small:
                        continue
                    sign = signature(s)
                    if sign in seen:
                        continue
                    if len(seen) < 250_000:
                        seen.add(sign)
                    length, rare = n - ceil(n * a / b) + 1, n
                    if len(ordered):
                        at = np.minimum(np.searchsorted(ordered, s), len(ordered) - 1)
                        common = ordered[at] == s
                        rare = n - int(common.sum())
                        if rare < length:
                            late = s[common]
                            s = np.concatenate([s[~common], late[np.argsort(-ranks[at[common]], kind="stable")]])
                        else:
                            s = s[~common]
                    hs.append(s[:length])
                    sigs.append(np.full(length, sign, np.int64))
                    ranks_of.append(((rare * 1000 // n << 53) | (n << 26)) + np.arange(length, dtype=np.int64))
            if hs:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(hs).view(np.int64)), pa.array(np.concatenate(sigs)), pa.array(np.concatenate(ranks_of))], ["h", "sig", "rank"])

    return entries


def _subsets(small: int):
    """Keys of the fixed-size subsets of small sets: (n, m, key) for every size m that they can be similar to."""
    a, b = SIMILARITY

    def subsets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            low, high, keys, sigs, firsts = [], [], [], [], []
            for _, sets in shingle_sets(batch.column(0)):
                for s in sets:
                    n = len(s)
                    if not 0 < n <= small:
                        continue
                    sign = signature(s)
                    for m in range(ceil(n * a / b), min(small, floor(n * b / a)) + 1):
                        size = least_overlap(n, m)
                        for part in combinations(s.tolist(), size):
                            low.append(min(n, m))
                            high.append(max(n, m))
                            keys.append(signature(np.array(part, np.uint64)))
                            sigs.append(sign)
                            firsts.append(n <= m)
            yield pa.RecordBatch.from_arrays([pa.array(low, pa.int32()), pa.array(high, pa.int32()), pa.array(keys, pa.int64()), pa.array(sigs, pa.int64()), pa.array(firsts, pa.bool_())], ["low", "high", "key", "sig", "lower"])

    return subsets


def _similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs (a, b, x, y) of nodes and texts that are similar."""
    a, b = SIMILARITY
    last_text, last_set = None, None
    for batch in batches:
        found = []
        for k in range(batch.num_rows):
            one = batch.slice(k, 1)
            (_, (x,)), *_ = shingle_sets(one.column(2))
            text = one.column(3)[0]
            if last_text is None or text != last_text:
                (_, (last_set,)), *_ = shingle_sets(one.column(3))
                last_text = text
            y = last_set
            both = len(np.intersect1d(x, y, assume_unique=True))
            # a row that repeats a doc_id with another text does not stand for the set
            own = signature(x) == one.column(0)[0].as_py() and signature(y) == one.column(1)[0].as_py()
            found.append(own and b * both >= a * (len(x) + len(y) - both))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(found, pa.bool_()))


def _possible(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs (a, b, n, m, s, t) of nodes, sizes and sketches that may be similar."""
    low, high = SIMILARITY
    for batch in batches:
        if batch.num_rows:
            n, m = batch.column(2).to_numpy(), batch.column(3).to_numpy()
            bits = [np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint64).reshape(batch.num_rows, -1) for c in (4, 5)]
            apart = np.bitwise_count(bits[0] ^ bits[1]).sum(1, dtype=np.int64)
            # similar sets share at least low * (n + m) / (low + high), so they differ in at most (n + m) less twice that
            possible = apart * (low + high) <= (n + m) * (high - low)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(possible))


def _promising(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    own = lambda key, n, s: nodes.select(F.col("sig").alias(key), F.col("n").alias(n), F.col("sketch").alias(s))
    return pairs.join(own("a", "n", "s"), "a").join(own("b", "m", "t"), "b").select("a", "b", "n", "m", "s", "t").mapInArrow(words.trimmed(_possible), "a long, b long")


def _verified(pairs: DataFrame, docs: DataFrame, nodes: DataFrame, repeated: bool) -> DataFrame:
    """The similar ones of pairs (a, b) of set signatures, by the texts of the documents that stand for them."""
    ids = pairs.select(F.col("a").alias("sig")).union(pairs.select(F.col("b").alias("sig"))).distinct().join(nodes, "sig")
    needed = written(ids.select("sig", "doc_id"), "jaccard-needed")
    few = needed.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    held = docs.join(F.broadcast(needed) if few else needed, "doc_id").select("sig", "text")
    if repeated:
        held = held.groupBy("sig", F.xxhash64("text").alias("same")).agg(F.first("text").alias("text")).drop("same")
    left, right = held.select(F.col("sig").alias("a"), F.col("text").alias("x")), held.select(F.col("sig").alias("b"), F.col("text").alias("y"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(words.trimmed(_similar), "a long, b long")


def _boundary(sizes: list[tuple[int, int]]) -> int:
    """The largest size of a small set: the one with the least cost of subsets and list entries, from (size, sets)."""
    a, b = SIMILARITY
    subsets = {n: sum(comb(n, least_overlap(n, m)) for m in range(ceil(n * a / b), floor(n * b / a) + 1)) for n in range(1, LARGEST_SMALL + 1)}
    entries = {n: (n - ceil(n * a / b) + 1) * ENTRY_COST for n in subsets}
    cost = lambda limit: sum(k * (subsets[n] if n <= limit else entries[n]) for n, k in sizes)
    return min(range(LARGEST_SMALL + 1), key=lambda limit: (cost(limit), limit))


def join(docs: DataFrame) -> DataFrame:
    """One row per row of docs (doc_id long, text): doc_id, n_shingles, class_id, component_id.

    n_shingles is the size of the document's set: its distinct 5-word shingles with A-Z lower-cased, the whole sequence
    where there are fewer words. class_id is the least doc_id with the same set, component_id the least doc_id
    reachable over links; both are the document's own where it links with nothing. Null, empty and blank texts have
    an empty set and link with nothing, not even with each other. Rows with a null doc_id are counted, but link with
    nothing and have null ids. Rows that repeat a doc_id with different texts each keep their own set; a set is then
    compared by the text of any of them that has it. An empty table gives an empty result; other columns play no part.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sets = written(docs.mapInArrow(words.trimmed(_summaries), "doc_id long, n_shingles long, sig long, sketch binary"), "jaccard-sets")
    nodes = written(sets.where("n_shingles > 0 AND doc_id IS NOT NULL").groupBy("sig").agg(F.min("doc_id").alias("doc_id"), F.min("n_shingles").alias("n"), F.min("sketch").alias("sketch")), "jaccard-nodes")
    repeated = not sets.groupBy("doc_id").count().where("count > 1").isEmpty()
    sizes = nodes.where(F.col("n") <= LARGEST_SMALL).groupBy("n").count().collect()
    small = _boundary([(r["n"], r["count"]) for r in sizes])
    text = docs.where("doc_id IS NOT NULL").select("text")

    frequent = text.mapInArrow(words.trimmed(_recurring), "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "h").limit(FREQUENT).select("h").toArrow()
    common = frequent.column(0).to_numpy().view(np.uint64) if frequent.num_rows else np.zeros(0, np.uint64)

    keyed = text.mapInArrow(words.trimmed(_subsets(small)), "low int, high int, key long, sig long, lower boolean").distinct()
    groups = keyed.groupBy("low", "high", "key").agg(F.min("sig").alias("pivot"), F.bool_or("lower").alias("has_low"), F.bool_or(~F.col("lower") | (F.col("low") == F.col("high"))).alias("has_high"), F.max("sig").alias("other"))
    by_subset = keyed.join(groups.where("has_low AND has_high AND pivot <> other"), ["low", "high", "key"]).where("sig <> pivot").select(F.col("sig").alias("a"), F.col("pivot").alias("b")).distinct()

    entries = text.mapInArrow(words.trimmed(_entries(common, small)), "h long, sig long, rank long")
    n = F.shiftright("rank", 26).bitwiseAND((1 << 27) - 1)
    band = F.floor(F.log(n.cast("double")) / log(SIMILARITY[1] / SIMILARITY[0])).cast("int")
    lists = entries.groupBy("h").agg(F.min("sig").alias("first"), F.max("sig").alias("last")).where("first <> last").select("h")
    shared = written(entries.join(lists, "h").distinct().withColumns({"n": n, "place": F.col("rank").bitwiseAND((1 << 26) - 1), "band": band}), "jaccard-lists")
    pivots = shared.groupBy("h", "band").agg(F.min(F.struct("rank", "sig", "n", "place")).alias("pivot"), F.min("sig").alias("first"), F.max("sig").alias("last")).where("first <> last").select("h", "band", F.col("pivot.n").alias("m"), F.col("pivot.place").alias("mplace"), F.col("pivot.sig").alias("pivot"))
    low, high = SIMILARITY
    fits = lambda n, place, m: (F.col(n) - F.col(place)) * (low + high) >= (F.col(n) + F.col(m)) * low
    proposed = shared.join(pivots, ["h", "band"]).where("sig <> pivot").where(fits("n", "place", "m") & fits("m", "mplace", "n"))
    proposed = proposed.select(F.least("sig", "pivot").alias("a"), F.greatest("sig", "pivot").alias("b")).distinct()
    to_pivot = written(_promising(proposed, nodes), "jaccard-pivots")
    first = written(_verified(to_pivot, docs, nodes, repeated).union(by_subset), "jaccard-links")

    known = written(components(first), "jaccard-components")
    owned = shared.join(known.withColumnRenamed("node", "sig"), "sig", "left").select("h", "sig", "n", "place", F.coalesce("component", "sig").alias("component"))
    mixed = owned.groupBy("h").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high").select("h")
    open_lists = written(owned.join(mixed, "h"), "jaccard-open")
    x, y = open_lists.alias("x"), open_lists.alias("y")
    between = F.expr("x.h = y.h AND x.component < y.component") & fits("x.n", "x.place", "y.n") & fits("y.n", "y.place", "x.n")
    left = x.join(y, between).select(F.least("x.sig", "y.sig").alias("a"), F.greatest("x.sig", "y.sig").alias("b")).distinct()
    rest = written(_promising(left, nodes).join(to_pivot, ["a", "b"], "left_anti"), "jaccard-rest")
    links = written(first.union(_verified(rest, docs, nodes, repeated)), "jaccard-links")
    discard(shared, to_pivot, first, known, open_lists, rest)

    least = components(links).withColumnRenamed("node", "sig").join(nodes, "sig")
    labels = least.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    member = least.join(labels, "component").select("sig", "component_id")
    sets = sets.drop("sketch")
    classes = written(nodes.select("sig", F.col("doc_id").alias("class_id")).join(member, "sig", "left"), "jaccard-classes")
    discard(nodes, links)
    linked = F.col("n_shingles") > 0
    return sets.join(classes, "sig", "left").select(
        "doc_id", "n_shingles",
        F.when(linked & F.col("doc_id").isNotNull(), F.col("class_id")).otherwise(F.col("doc_id")).alias("class_id"),
        F.when(linked & F.col("doc_id").isNotNull(), F.coalesce("component_id", "class_id")).otherwise(F.col("doc_id")).alias("component_id"),
    )
