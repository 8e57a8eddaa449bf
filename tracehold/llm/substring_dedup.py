"""Substring dedup by recompression: every word covered by a run of 35 words that also starts elsewhere is removed.

Texts are rewritten in rounds. A round may name maximal runs of one symbol, and names each pair of a left symbol and a
right symbol; which side a symbol is on in a round follows from its name. Names are hashes of what they stand for, so
they are the same in all documents. Whether two neighbours pair depends on the two alone, so equal substrings get the
same symbols in their interior. Spark counts the names of three levels, one exchange each, from long symbols to short:

- Long symbols, of LONG_ROUNDS rounds and at least 35 words. One that occurs twice, with a second hash of all its words
  to verify it, is a repeat as a whole. All its occurrences are taken; but for one they leave the further levels.
- Short symbols, as anchors of what is left. A window's anchor is the least-hashed symbol whose context (the words that
  decided it) lies in the window, of the highest round that has one; single words are their own context. Equal windows
  have equal anchors at equal places. Consecutive windows of one anchor form a stretch. An anchor that occurs once in
  the corpus rules out all windows of its stretch; stretches that are equal as a whole are repeats.
- Windows, of the different stretches that share an anchor: the ends of repeats. Only they are compared one by one, by
  the hash of all 35 words together with the anchor.

No group is gathered: groups are counted with partial aggregation. Groups of so many members that they would fill a task
are at most HOT, so these are broadcast to their members instead of being joined. Words are compared by 64-bit hashes,
symbols, stretches and windows by 128 bits.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracehold.llm import words
from tracehold.llm.storage import discard, written

WINDOW = 35
#: Rounds of pairing, those that also name runs, the longest anchor in words, and the rounds whose symbols may anchor.
ROUNDS, RUN_ROUNDS, LONGEST = 6, (0, 1), 10
ANCHOR_ROUNDS = (6, 3, 1, 0)
#: Rounds whose symbols are looked for as long repeats, those of them that also name runs, and the most words of one.
LONG_ROUNDS, LONG_RUN_ROUNDS, MOST_WORDS = (11, 14, 18, 22), (0, 1, 3, 5, 8, 11, 15), 1 << 20
#: Documents up to which the keys of those concerned are broadcast (8 bytes each); beyond, they are joined.
BROADCAST_KEYS = 200_000
#: Places of long repeats up to which they are broadcast (16 bytes each), and groups that may count as hot.
BROADCAST_PLACES, HOT = 1_000_000, 1_000

_PAIR, _RUN, _SIDE, _WINDOW_BASE, _STRETCH_BASE = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB
U = np.uint64


class Symbols:
    """Symbols of one round: name, first word, words, text, and the context [low, high) in words, where it is kept."""

    def __init__(self, name, first, size, doc, low=None, high=None):
        self.name, self.first, self.size, self.doc, self.low, self.high = name, first, size, doc, low, high

    @classmethod
    def of(cls, hashes: np.ndarray, edges: np.ndarray, contexts: bool) -> Symbols:
        """The words themselves."""
        at = np.arange(len(hashes))
        return cls(hashes, at, np.ones(len(hashes), np.int64), np.repeat(np.arange(len(edges) - 1), np.diff(edges)), *((at, at + 1) if contexts else ()))

    def take(self, at: np.ndarray) -> Symbols:
        return Symbols(self.name[at], self.first[at], self.size[at], self.doc[at], *((self.low[at], self.high[at]) if self.low is not None else ()))


def _borders(s: Symbols, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Contexts of the left and the right neighbour of each symbol; beyond a text's edge, one word outside of it."""
    left, right = edges[s.doc] - 1, edges[s.doc + 1] + 1
    same = s.doc[1:] == s.doc[:-1]
    left[1:][same], right[:-1][same] = s.low[:-1][same], s.high[1:][same]
    return left, right


def name_runs(s: Symbols, edges: np.ndarray, longest: int = LONGEST) -> Symbols:
    """Each maximal run of one symbol that is not too long becomes a symbol."""
    n = len(s.name)
    if not n:
        return s
    starts = np.ones(n, bool)
    starts[1:] = (s.name[1:] != s.name[:-1]) | (s.doc[1:] != s.doc[:-1])
    if s.low is None and starts.all():
        return s
    begin = np.flatnonzero(starts)
    end = np.append(begin[1:], n)
    run = np.cumsum(starts) - 1
    whole = s.size[begin] * (end - begin) <= longest
    keep = np.flatnonzero(starts | ~whole[run])
    many = (end - begin)[run[keep]]
    merged = (whole & (end - begin > 1))[run[keep]]
    name, size = s.name[keep], s.size[keep]
    name = np.where(merged, words.mix(name * U(_RUN) + many.astype(np.uint64)), name)
    found = Symbols(name, s.first[keep], np.where(merged, size * many, size), s.doc[keep])
    if s.low is not None:
        left, right = _borders(s, edges)
        found.low, found.high = left[begin][run[keep]], right[end - 1][run[keep]]
    return found


def name_pairs(s: Symbols, edges: np.ndarray, number: int, longest: int = LONGEST) -> Symbols:
    """Each left symbol followed by a right one, not too long together, becomes a symbol with it."""
    n = len(s.name)
    if not n:
        return s
    is_left = (words.mix(s.name ^ U(_SIDE * (number + 1) & (1 << 64) - 1)) & U(1)).astype(bool)
    opens = np.zeros(n, bool)
    opens[:-1] = is_left[:-1] & ~is_left[1:] & (s.doc[:-1] == s.doc[1:]) & (s.size[:-1] + s.size[1:] <= longest)
    closes = np.zeros(n, bool)
    closes[1:] = opens[:-1]
    at = np.flatnonzero(~closes)
    pair = opens[at]
    two = at[pair]
    name, size = s.name[at], s.size[at]
    name[pair] = words.mix(s.name[two] * U(_PAIR) + words.mix(s.name[two + 1] + U(number + 1)))
    size[pair] += s.size[two + 1]
    found = Symbols(name, s.first[at], size, s.doc[at])
    if s.low is not None:
        left, right = _borders(s, edges)
        found.low, found.high = np.where(~is_left & ~closes, left, s.low)[at], np.where(is_left & ~opens, right, s.high)[at]
        found.low[pair], found.high[pair] = s.low[two], s.high[two + 1]
    return found


def rounds(hashes: np.ndarray, edges: np.ndarray) -> list[Symbols]:
    """The symbols after each round, from the words themselves on; texts are hashes[edges[i]:edges[i+1]]."""
    s = Symbols.of(hashes, edges, True)
    found = [s]
    for number in range(ROUNDS):
        if number in RUN_ROUNDS:
            s = name_runs(s, edges)
        s = name_pairs(s, edges, number)
        # contexts only widen to the neighbours', so both ends stay in order
        found.append(s)
    return found


def _run_hashes(hashes: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int) -> np.ndarray:
    """A hash of each run hashes[start:end]."""
    sums = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(hashes * words.powers(base, len(hashes)), out=sums[1:])
    return words.mix((sums[ends] - sums[starts]) * words.powers(pow(base, -1, 1 << 64), len(hashes) + 1)[starts])


def long_symbols(hashes: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, ...]:
    """Name, hash of all words, first word and number of words of each symbol of LONG_ROUNDS that is as long as a window."""
    s = Symbols.of(hashes, edges, False)
    found = []
    for number in range(max(LONG_ROUNDS)):
        if number in LONG_RUN_ROUNDS:
            s = name_runs(s, edges, MOST_WORDS)
        s = name_pairs(s, edges, number, MOST_WORDS)
        if number + 1 in LONG_ROUNDS:
            found.append(s.take(np.flatnonzero(s.size >= WINDOW)))
    name, first, size = (np.concatenate([getattr(f, c) for f in found]) for c in ("name", "first", "size"))
    # one symbol may be found in several rounds
    _, once = np.unique(np.stack([first, size], 1), axis=0, return_index=True) if len(first) else (0, np.zeros(0, np.int64))
    name, first, size = name[once], first[once], size[once]
    return name, _run_hashes(hashes, first, first + size, _STRETCH_BASE | 1), first, size


def stretches(hashes: np.ndarray, edges: np.ndarray, gone: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    """Anchor symbol, hash of all words with the anchor's place, first window and number of windows of each stretch.

    Windows that start at words in gone are left out.
    """
    sizes = np.diff(edges)
    counts = np.maximum(sizes - WINDOW + 1, 0)
    total = int(counts.sum())
    if not total:
        none = np.zeros(0, np.uint64)
        return none, none, none.astype(np.int64), none.astype(np.int64), none.astype(np.int64)
    doc = np.repeat(np.arange(len(sizes)), counts)
    start = np.arange(total) - np.repeat(np.cumsum(counts) - counts, counts) + edges[:-1][doc]
    if gone is not None and len(gone):
        left = np.ones(len(hashes), bool)
        left[gone] = False
        start, doc = start[left[start]], doc[left[start]]
        total = len(start)
        if not total:
            none = np.zeros(0, np.uint64)
            return none, none, none.astype(np.int64), none.astype(np.int64), none.astype(np.int64)
    anchor_name, anchor_at = np.zeros(total, np.uint64), np.zeros(total, np.int64)
    kind = np.zeros(total, np.int64)
    todo = np.arange(total)
    levels = rounds(hashes, edges)
    for number in ANCHOR_ROUNDS:
        s = levels[number]
        low, high = np.maximum.accumulate(s.low), np.maximum.accumulate(s.high)
        p = start[todo]
        a, b = np.searchsorted(low, p), np.searchsorted(high, p + WINDOW, "right")
        seen = b > a
        here, a, b = todo[seen], a[seen], b[seen]
        least = (words.mix(s.name) >> U(32) << U(32)) | np.arange(len(s.name), dtype=np.uint64)
        table = [least]
        while (1 << len(table)) <= WINDOW:
            half = 1 << (len(table) - 1)
            last = table[-1]
            table.append(np.minimum(last, np.append(last[half:], np.full(min(half, len(last)), np.iinfo(np.uint64).max, np.uint64))))
        power = np.frexp((b - a).astype(np.float64))[1] - 1
        best = np.empty(len(here), np.uint64)
        for k in range(len(table)):
            at = power == k
            best[at] = np.minimum(table[k][a[at]], table[k][b[at] - (1 << k)])
        j = (best & U((1 << 32) - 1)).astype(np.int64)
        anchor_name[here], anchor_at[here], kind[here] = words.mix(s.name[j] + U(number)), s.first[j], number
        todo = todo[~seen]
        if not len(todo):
            break
    breaks = np.ones(total, bool)
    breaks[1:] = (doc[1:] != doc[:-1]) | (anchor_at[1:] != anchor_at[:-1]) | (kind[1:] != kind[:-1]) | (start[1:] != start[:-1] + 1)
    first = np.flatnonzero(breaks)
    count = np.diff(np.append(first, total))
    p1 = start[first]
    body = _run_hashes(hashes, p1, p1 + count - 1 + WINDOW, _STRETCH_BASE | 1)
    body = words.mix(body + (count * 64 + anchor_at[first] - p1).astype(np.uint64))
    return anchor_name[first], body, p1 - edges[:-1][doc[first]], count, doc[first]


#: What tells rows apart.
KEYS, KEY_TYPES = ("_key", "_key2"), "_key long, _key2 int"
#: Windows of a stretch are numbered from its first word on: at * PLACES + windows in one number.
PLACES = 64


def _long_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row, data, offsets in words.texts(batch.column(2)):
            hashes, edges = _hashed(data, offsets)
            name, body, first, size = long_symbols(hashes, edges)
            of = np.searchsorted(edges, first, "right") - 1
            own = pa.array(row + of)
            yield pa.RecordBatch.from_arrays([pa.array(name.view(np.int64)), pa.array(body.view(np.int64)), batch.column(0).take(own), batch.column(1).take(own), pa.array(first - edges[of]), pa.array(size)], ["name", "body", *KEYS, "first", "size"])


def _hashed(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of texts, and where each text's words begin."""
    doc, _, _, hashes = words.find_words(data, offsets)
    return hashes, words.bounds(doc, len(offsets) - 1)


def _expanded(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... for sizes[0] numbers, and so on."""
    return np.repeat(starts - np.cumsum(sizes) + sizes, sizes) + np.arange(int(sizes.sum()))


def _stretch_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stretches of (KEYS, text, firsts, sizes); windows inside of the given runs of words are left out."""
    for batch in batches:
        for row, data, offsets in words.texts(batch.column(2)):
            n = len(offsets) - 1
            hashes, edges = _hashed(data, offsets)
            firsts, sizes = batch.column(3).slice(row, n), batch.column(4).slice(row, n)
            lengths = np.asarray(firsts.value_lengths().fill_null(0))
            begin = firsts.flatten().to_numpy() + np.repeat(edges[:-1], lengths)
            name, body, at, count, of = stretches(hashes, edges, _expanded(begin, sizes.flatten().to_numpy() - WINDOW + 1))
            own = pa.array(row + of)
            yield pa.RecordBatch.from_arrays([pa.array(name.view(np.int64)), pa.array(body.view(np.int64)), batch.column(0).take(own), batch.column(1).take(own), pa.array(at * PLACES + count)], ["name", "body", *KEYS, "place"])


def _window_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Windows of the open stretches of each text: (KEYS, text, stretches (name, place, sure))."""
    for batch in batches:
        for row, data, offsets in words.texts(batch.column(2)):
            n = len(offsets) - 1
            hashes, edges = _hashed(data, offsets)
            lists = batch.column(3).slice(row, n)
            rows = lists.flatten()
            name, place = rows.field(0).to_numpy(), rows.field(1).to_numpy()
            sure = rows.field(2).to_numpy(zero_copy_only=False)
            of = np.repeat(np.arange(n), np.asarray(lists.value_lengths()))
            count = place % PLACES
            which = np.repeat(np.arange(len(place)), count)
            at = _expanded(place // PLACES, count)
            begin = at + edges[of[which]]
            window = _run_hashes(hashes, begin, begin + WINDOW, _WINDOW_BASE | 1)
            own = pa.array(row + of[which])
            yield pa.RecordBatch.from_arrays([pa.array(name[which]), pa.array(window.view(np.int64)), batch.column(0).take(own), batch.column(1).take(own), pa.array(at), pa.array(sure[which])], ["name", "body", *KEYS, "at", "sure"])


def _kept_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """n_words, n_removed, kept text of (..., text, firsts, sizes); bytes.split() parts words as they are parted here."""
    for batch in batches:
        texts, firsts, sizes = (batch.column(batch.schema.get_field_index(c)) for c in ("text", "firsts", "sizes"))
        total, gone, kept = [], [], []
        for k, text in enumerate(texts.cast(pa.large_binary())):
            found = (text.as_py() or b"").split()
            total.append(len(found))
            if firsts[k].is_valid:
                change = np.zeros(len(found) + 1, np.int64)
                first = firsts[k].values.to_numpy()
                np.add.at(change, first, 1)
                np.add.at(change, first + sizes[k].values.to_numpy(), -1)
                found = list(compress(found, (np.cumsum(change[:-1]) == 0).tolist()))
            gone.append(total[-1] - len(found))
            kept.append(b" ".join(found).decode())
        out = [c for c in batch.schema.names if c not in ("text", "firsts", "sizes")]
        yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in out), pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string())], names=[*out, "n_words", "n_removed", "kept"])


def _of_keys(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """The rows of docs whose keys are in keys, without moving the texts of the others where keys are few."""
    few = keys.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS
    return docs.join(F.broadcast(keys) if few else keys, list(KEYS), "left_semi")


def _members(rows: DataFrame, groups: DataFrame, n: int, by: tuple[str, ...] = ("name", "body")) -> DataFrame:
    """The rows of groups (by, n), which hold n members in all.

    Groups of more than n / HOT members are fewer than HOT and are broadcast; the rows of all others are joined.
    """
    big = groups.where(F.col("n") > n // HOT)
    few = groups.where(F.col("n") <= n // HOT).select(*by)
    if big.isEmpty():
        return rows.join(few, list(by), "left_semi")
    hot = F.broadcast(big.select(*by))
    return rows.join(hot, list(by), "left_semi").union(rows.join(hot, list(by), "left_anti").join(few, list(by), "left_semi"))


def _size(table: DataFrame) -> int:
    return table.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def long_repeats(keyed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Runs of words (KEYS, first, size) that occur twice as long symbols: all of them, and all but one of each."""
    symbols = written(keyed.mapInArrow(words.trimmed(_long_rows), f"name long, body long, {KEY_TYPES}, first long, size long"), "dedup-symbols")
    groups = symbols.groupBy("name", "body").agg(F.count("*").alias("n"), F.min(F.struct(*KEYS, "first")).alias("one")).where("n > 1")
    groups = written(groups.select("name", "body", "n", "one.*"), "dedup-shared-symbols")
    found = written(_members(symbols, groups, _size(groups)), "dedup-long")
    others = found.join(groups.drop("n"), ["name", "body", *KEYS, "first"], "left_anti")
    covered = written(others.select(*KEYS, "first", "size"), "dedup-covered")
    discard(symbols, groups)
    return found.select(*KEYS, "first", "size"), covered


def _listed(runs: DataFrame) -> DataFrame:
    """(KEYS, firsts, sizes) of runs (KEYS, first, size)."""
    both = runs.groupBy(*KEYS).agg(F.collect_list(F.struct("first", "size")).alias("runs"))
    return both.select(*KEYS, F.col("runs.first").alias("firsts"), F.col("runs.size").alias("sizes"))


def _with_runs(docs: DataFrame, runs: DataFrame, columns: list[str]) -> DataFrame:
    """docs with firsts and sizes of their runs (null without); texts move only where the runs are too many to broadcast."""
    few = runs.limit(BROADCAST_PLACES + 1).count() <= BROADCAST_PLACES
    lists = _listed(runs)
    if few:
        return docs.join(F.broadcast(lists), list(KEYS), "left").select(*columns, "text", "firsts", "sizes")
    lists = written(lists, "dedup-runs")
    keys = lists.select(*KEYS)
    hit = docs.join(F.broadcast(keys), list(KEYS), "left_semi") if (some := keys.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS) else docs
    hit = hit.join(lists, list(KEYS), "inner" if some else "left").select(*columns, "text", "firsts", "sizes")
    if not some:
        return hit
    none = F.lit(None).cast("array<long>")
    whole = docs.join(F.broadcast(keys), list(KEYS), "left_anti").withColumns({"firsts": none, "sizes": none})
    return hit.union(whole.select(*columns, "text", "firsts", "sizes"))


def repeated_runs(keyed: DataFrame) -> DataFrame:
    """(KEYS, first, size) of keyed (KEYS, text): runs of words whose windows are all repeated; all repeated windows lie in one."""
    long, covered = long_repeats(keyed)
    every = written(_with_runs(keyed, covered, list(KEYS)).mapInArrow(words.trimmed(_stretch_rows), f"name long, body long, {KEY_TYPES}, place long"), "dedup-stretches")
    shared = written(every.groupBy("name").agg(F.count("*").alias("n")).where("n > 1"), "dedup-shared")
    rows = written(_members(every, shared, _size(shared), ("name",)), "dedup-rows")
    discard(every, covered)
    groups = rows.groupBy("name", "body").agg(F.count("*").alias("n"), F.min(F.struct(*KEYS, "place")).alias("one"))
    groups = written(groups.select("name", "body", "n", "one.*"), "dedup-groups")
    repeated = groups.where("n > 1").select("name", "body", "n")
    equal = _members(rows, repeated, _size(repeated)).select(*KEYS, "place")
    # stretches of one symbol that differ: each is compared window by window, through one document that has it
    several = written(groups.groupBy("name").agg(F.count("*").alias("n")).where("n > 1"), "dedup-several")
    single = written(_members(groups, several, _size(several), ("name",)).select("name", *KEYS, "place", (F.col("n") > 1).alias("sure")), "dedup-open")
    per_text = single.groupBy(*KEYS).agg(F.collect_list(F.struct("name", "place", "sure")).alias("open"))
    texts = _of_keys(keyed, single.select(*KEYS).distinct())
    windows = texts.join(per_text, list(KEYS)).select(*KEYS, "text", "open").mapInArrow(words.trimmed(_window_rows), f"name long, body long, {KEY_TYPES}, at long, sure boolean")
    windows = written(windows, "dedup-windows")
    again = written(windows.groupBy("name", "body").agg(F.count("*").alias("n")).where("n > 1"), "dedup-again")
    ends = _members(windows.where("NOT sure"), again, _size(again)).select(*KEYS, (F.col("at") * PLACES + 1).alias("place"))
    short = equal.union(ends).select(*KEYS, F.floor(F.col("place") / PLACES).alias("first"), (F.col("place") % PLACES - 1 + WINDOW).alias("size"))
    found = written(long.union(short), "dedup-places")
    discard(shared, rows, groups, several, single, windows, again)
    return found


def dedup(docs: DataFrame) -> DataFrame:
    """docs without text, with n_words, n_removed, and kept: the words left of the input's, joined by one space.

    A word goes if it lies in 35 consecutive words of one document whose sequence also starts anywhere else, in another
    row or in the same text. Windows are those of the input, not of what is left. Null and empty texts have no words;
    texts of fewer than 35 words lose none. Repeated rows count as occurrences of each other; rows are told apart by 96
    bits of hashes of doc_id and text, so ids may be null or repeat. An empty table gives an empty result. Columns of
    docs named like the added ones, or with a leading underscore, are replaced.
    """
    docs = docs.drop("n_words", "n_removed", "kept", *KEYS, "firsts", "sizes")
    carried = [c for c in docs.columns if c != "text"]
    rows = docs.withColumns({KEYS[0]: F.xxhash64("doc_id", "text"), KEYS[1]: F.hash("text", "doc_id")})
    found = repeated_runs(rows.select(*KEYS, "text"))
    schema = docs.select(*carried).schema.add("n_words", "long").add("n_removed", "long").add("kept", "string")
    return _with_runs(rows, found, carried).mapInArrow(words.trimmed(_kept_rows), schema)
