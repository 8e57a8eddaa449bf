"""Grouping of spelling variants by bidirectional FM-index search schemes.

Two words that differ by one code point agree in the first or in the last half of either of them. So each word is
searched twice: its first half is matched from the left and extended to the right, its last half is matched from the
right and extended to the left, with exactly one error in the other half. Every step narrows an interval of suffix ranks
of an FM-index over the words of a shard, each between delimiters; as a pattern begins and ends at a delimiter, a search
to the right needs the index of the reversed words and one to the left that of the words, one interval at a time.

Shards hold the words that agree in a half, so a word is searched in the two shards that can hold its variants, and none
sees the whole vocabulary. A half that very many words share is cut into parts of SHARD_CHARS, in each of which its words
are searched.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracehold.llm import words
from tracehold.llm.storage import discard, written

#: Fewest code points and occurrences of a word, what the crc of a deleted one is divisible by, how much commoner a form is.
LEAST_CHARS, LEAST_COUNT, DELETED, COMMONER = 5, 3, 97, 2
#: Characters of an index, twice those of the words searched in it at a time; rows of a hot list that is broadcast; words, and bytes of them, that a task counts before it sends them.
SHARD_CHARS, HOT_ROWS, HELD, HELD_BYTES = 400_000, 100_000, 200_000, 16 << 20

#: Letters of the runs in UTF-8, A-Z lower-cased.
_RUN = re.compile(rb"(?:[a-z]|\xc3[\x80-\xbf])[a-z]*(?:\xc3[\x80-\xbf][a-z]*)*")

RESULT = "word string, form string, root string, n long, n_near long, form_n long"


class Index:
    """An FM-index over distinct words: the text is each word after a delimiter, and cyclic.

    Row r is the r-th rotation of the text in order; `before` holds the symbol before it. All rows whose rotations begin
    with one pattern are an interval, and steps() narrows intervals to those with one symbol more in front.
    """

    def __init__(self, found: list[str]):
        self.words = found
        points = np.frombuffer("\0".join(["", *found]).encode("utf-32-le"), np.uint32)
        self.alphabet = np.unique(points)  # the delimiter is 0
        text = np.searchsorted(self.alphabet, points)
        n, rank, width = len(text), text, 1
        while True:
            _, rank = np.unique(rank * np.int64(n + 1) + np.roll(rank, -width), return_inverse=True)
            if rank.max() == n - 1:
                break
            width *= 2
        rows = np.argsort(rank)
        self.n, self.before = n, text[rows - 1]
        order = np.argsort(self.before, kind="stable")
        self.keys = self.before[order] * np.int64(n + 1) + order
        self.word_at = (np.cumsum(text == 0) - 1)[rows]
        self.first = np.searchsorted(self.keys, np.arange(len(self.alphabet) + 1) * np.int64(n + 1))

    def steps(self, low: np.ndarray, high: np.ndarray, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The intervals with symbol in front; a symbol that the index has not (-1) gives an empty one."""
        at = symbol * np.int64(self.n + 1)
        return np.searchsorted(self.keys, at + low), np.searchsorted(self.keys, at + high)

    def branches(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(interval, symbol, low, high) of all letters that stand before some row of each interval."""
        wide = high - low > len(self.alphabet)
        narrow = np.flatnonzero(~wide)
        sizes = (high - low)[narrow]
        rows = np.repeat(high[narrow] - np.cumsum(sizes), sizes) + np.arange(sizes.sum())
        pairs = np.unique(np.repeat(narrow, sizes) * np.int64(len(self.alphabet)) + self.before[rows])
        letters = np.arange(len(self.alphabet))
        pairs = np.concatenate([pairs, (np.flatnonzero(wide)[:, None] * np.int64(len(letters)) + letters).ravel()])
        of, symbol = pairs // len(letters), pairs % len(letters)
        of, symbol = of[symbol > 0], symbol[symbol > 0]
        lows, highs = self.steps(low[of], high[of], symbol)
        some = highs > lows
        return of[some], symbol[some], lows[some], highs[some]

    def near(self, asked: list[str], exact: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(word asked, word of the index) that differ by one error after the first exact[i] code points of asked[i]."""
        sizes = np.array([len(w) for w in asked])
        points = np.frombuffer("".join(asked).encode("utf-32-le"), np.uint32)
        letter = np.minimum(np.searchsorted(self.alphabet, points), len(self.alphabet) - 1)
        letter = np.append(np.where(self.alphabet[letter] == points, letter, -1), 0)
        starts = np.cumsum(sizes) - sizes
        symbol = lambda q, j: np.where(j < sizes[q], letter[np.minimum(starts[q] + j, len(letter) - 1)], 0)  # noqa: E731  the delimiter ends a word
        q = np.arange(len(asked))
        low, high = np.zeros(len(q), np.int64), np.full(len(q), self.first[1])  # rotations that begin with the delimiter
        none = np.zeros(0, np.int64)
        bad_q, bad_low, bad_high = none, none, none  # intervals with the error behind them, which have read as many letters
        found: list[tuple[np.ndarray, np.ndarray]] = []
        j = 0
        while len(q) or len(bad_q):
            here, end = symbol(q, j), sizes[q] == j
            free = np.flatnonzero(j >= exact[q])
            of, other, lows, highs = self.branches(low[free], high[free])
            of = free[of]
            changes = other != here[of]  # else the letter may as well go in behind its equals
            of, lows, highs = of[changes], lows[changes], highs[changes]
            replaced = ~end[of]
            gone = free[~end[free] & (symbol(q[free], j + 1) != here[free])]  # of equal letters the last one goes
            ahead = [(q[of][replaced], lows[replaced], highs[replaced]), (q[gone], low[gone], high[gone])]
            bad_q, bad_low, bad_high = np.concatenate([bad_q, q[of]]), np.concatenate([bad_low, lows]), np.concatenate([bad_high, highs])
            bad_low, bad_high = self.steps(bad_low, bad_high, symbol(bad_q, j))
            some = bad_high > bad_low
            bad_q, bad_low, bad_high = bad_q[some], bad_low[some], bad_high[some]
            done = sizes[bad_q] == j
            found.append((bad_q[done], self.word_at[bad_low[done]]))
            kept = [(bad_q[~done], bad_low[~done], bad_high[~done]), *ahead]
            bad_q, bad_low, bad_high = (np.concatenate([x[k] for x in kept]) for k in range(3))
            low, high = self.steps(low, high, here)
            some = (high > low) & ~end
            q, low, high = q[some], low[some], high[some]
            j += 1
        return np.concatenate([a for a, _ in found] or [none]), np.concatenate([b for _, b in found] or [none])


def occurrences(docs: DataFrame) -> DataFrame:
    """(word, n) of docs (doc_id, text): lower-cased runs of letters, some with a code point deleted, of LEAST_CHARS at least and LEAST_COUNT occurrences."""

    @words.trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[bytes] = Counter()
        size = 0

        def sent() -> pa.RecordBatch:
            nonlocal size
            size = 0
            out = pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()).cast(pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])
            held.clear()
            return out

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                start = zlib.crc32(b"" if doc_id is None else b"%d" % doc_id)
                start = zlib.crc32(b":", start)
                for word, n in Counter(_RUN.findall(text.as_py().lower())).items():
                    if len(word) >= LEAST_CHARS:
                        h = zlib.crc32(word, start)
                        if h % DELETED == 0:
                            letters = word.decode()
                            k = h % len(letters)
                            word = (letters[:k] + letters[k + 1 :]).encode()  # noqa: PLW2901
                        if word not in held:
                            size += len(word)
                        held[word] += n
                if len(held) >= HELD or size >= HELD_BYTES:
                    yield sent()
        if held:
            yield sent()

    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).cast("binary")).mapInArrow(run, "word string, n long")
    return rows.groupBy("word").agg(F.sum("n").alias("n")).where((F.length("word") >= LEAST_CHARS) & (F.col("n") >= LEAST_COUNT))


def halves(vocabulary: DataFrame) -> DataFrame:
    """(side, half, asked, word, n): each word as one to be found, by the halves that words near it may have, and as one to ask by its own."""
    size, rows = F.length("word"), []
    for side, own, less, more in ((0, F.floor(size / 2), F.floor((size - 1) / 2), F.floor((size + 1) / 2)), (1, F.ceil(size / 2), F.ceil((size - 1) / 2), F.ceil((size + 1) / 2))):
        part = lambda k, side=side: F.left("word", k.cast("int")) if side == 0 else F.right("word", k.cast("int"))
        rows.append(F.struct(F.lit(side).alias("side"), part(own).alias("half"), F.lit(True).alias("asked")))
        for k in (less, more):  # one of them is the word's own half
            rows.append(F.struct(F.lit(side).alias("side"), part(k).alias("half"), F.lit(False).alias("asked")))
    return vocabulary.select(F.inline(F.array(*rows)), "word", "n")


def _searched(rows: DataFrame, shard: int) -> DataFrame:
    """(word, near, near_n) of rows (side, half, part, parts, asked, word, n), sorted within partitions. Parts of a half are searched apart from all else."""

    @words.trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, int] = {}
        asked: list[str] = []
        index: Index | None = None
        group, side, alone, chars, asking = None, 0, False, 0, 0

        def answers() -> Iterator[pa.RecordBatch]:
            nonlocal index, asking
            if held and asked:
                turn = (lambda w: w[::-1]) if side == 0 else (lambda w: w)
                index = index or Index([turn(w) for w in held])
                patterns = [w if side == 0 else w[::-1] for w in asked]
                exact = np.array([len(w) // 2 if side == 0 else -(-len(w) // 2) for w in asked])
                q, u = index.near(patterns, exact)
                pairs = [(asked[a], turn(index.words[b])) for a, b in zip(q.tolist(), u.tolist(), strict=True)]
                if side == 1:  # those that agree in the first half too are found by the other search
                    pairs = [(w, v) for w, v in pairs if v[: len(w) // 2] != w[: len(w) // 2]]
                if pairs:
                    yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in pairs]), pa.array([v for _, v in pairs]), pa.array([held[v] for _, v in pairs], pa.int64())], ["word", "near", "near_n"])
            asked.clear()
            asking = 0

        for batch in batches:
            for s, half, part, parts, ask, word, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (s, half, part) != group:
                    if chars + asking >= shard or s != side or alone or parts > 1:
                        yield from answers()
                        held.clear()
                        index, chars = None, 0
                    group, side, alone = (s, half, part), s, parts > 1
                if not ask:
                    if index:  # asked words of the groups before were answered already
                        yield from answers()
                        held.clear()
                        index, chars = None, 0
                    held[word] = n
                    chars += len(word) + 1
                else:
                    asked.append(word)
                    asking += len(word)
                    if asking >= shard // 2:
                        yield from answers()
        yield from answers()

    return rows.select("side", "half", "part", "parts", "asked", "word", "n").mapInArrow(run, "word string, near string, near_n long")


def near_pairs(vocabulary: DataFrame, shard: int = SHARD_CHARS) -> DataFrame:
    """(word, near, near_n): all ordered pairs of words of vocabulary (word, n) that differ by one code point, each once."""
    rows = halves(vocabulary)
    sizes = rows.where("NOT asked").groupBy("side", "half").agg(F.ceil(F.sum(F.length("word") + 1) / shard).alias("parts")).where("parts > 1")
    hot = written(sizes, "spelling-hot")
    few = hot.count()
    rows = rows.join(F.broadcast(hot) if few <= HOT_ROWS else hot, ["side", "half"], "left") if few else rows.withColumn("parts", F.lit(None).cast("long"))
    rows = rows.withColumn("parts", F.coalesce("parts", F.lit(1)))
    own = F.array(F.pmod(F.xxhash64("word"), "parts"))
    part = F.explode(F.when(F.col("asked") & (F.col("parts") > 1), F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).otherwise(own))
    rows = rows.withColumn("part", part).repartition("side", "half", "part").sortWithinPartitions("side", "half", "part", "asked")
    return _searched(rows, shard)


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of forms (word, form): the last form that is reached. Each step doubles how far is seen, and counts at least double along forms."""
    at = written(forms.select("word", F.col("form").alias("root"), F.lit(True).alias("moved")), "spelling-roots")
    while not at.where("moved").isEmpty():
        ahead = at.select(F.col("word").alias("root"), F.col("root").alias("next"))
        before, at = at, written(at.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "spelling-roots")
        discard(before)
    return at.drop("moved")


def group(docs: DataFrame, shard: int = SHARD_CHARS) -> DataFrame:
    """RESULT: each word of docs (doc_id, text) with its form and root.

    A null text has no words, a null id counts as an empty text in the hash. Repeated rows count each. Words are as long
    as they are: a run of letters is never cut. Ties go to the smaller form by code points. An empty table gives an
    empty result; other columns play no part.
    """
    vocabulary = written(occurrences(docs), "spelling-vocabulary")
    best = F.min(F.struct((-F.col("near_n")).alias("less"), "near"))
    near = written(near_pairs(vocabulary, shard).groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best")), "spelling-near")
    rows = vocabulary.join(near, "word", "left").withColumn("commoner", -F.col("best.less") >= COMMONER * F.col("n"))
    rows = written(rows.select("word", F.when(F.col("commoner"), F.col("best.near")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(F.col("commoner"), -F.col("best.less")).alias("form_n")), "spelling-forms")
    last = roots(rows.where("form IS NOT NULL"))
    return rows.join(last, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
