"""Quality rules: a decision list learned from labelled documents, beside fixed base rules.

Each document gets counts over its whole text. Sequential covering learns from the counts of labelled documents that pass
the base rules: a rule grows, threshold by threshold, towards documents of bad quality alone, is pruned on rows that it
did not grow from, and is kept while it holds there; what it covers is taken out and the next rule grows. The list
becomes one Spark expression, `CASE WHEN share of symbols > 0.05 AND ... THEN false ... ELSE true`.

The list learns from at most max_labels labelled rows, the first by a hash of their id; everything else is over all rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from math import log2

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracehold.llm import words
from tracehold.llm.toxicity import held_out

#: Fixed values of the base rules: fewest words, largest share of words in repeated windows; a window's words; what counts as a symbol.
LEAST_WORDS, MOST_REPEATED, WINDOW, SYMBOLS = 50, 0.5, 3, "#*$%&|<>"
MAX_LABELS = 50_000
#: A rule's most thresholds, values tried for each, share of rows that prune instead of growing; precision and rows that it needs there.
CONDITIONS, VALUES, PRUNING, PRECISION, LEAST_ROWS = 5, 64, 3, 0.9, 3

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_distinct_words", "n_letters", "n_digits", "n_upper", "n_one_char_words", "longest_word")
#: Shares that rules are about: (numerator, denominator).
SHARES = {
    "mean_word_chars": ("word_chars", "n_words"), "symbol_share": ("n_symbols", "word_chars"), "dup_line_share": ("n_dup_lines", "n_lines"), "repeat_share": ("n_repeat_words", "n_words"),
    "words_a_line": ("n_words", "n_lines"), "distinct_share": ("n_distinct_words", "n_words"), "letter_share": ("n_letters", "word_chars"), "digit_share": ("n_digits", "word_chars"),
    "upper_share": ("n_upper", "n_letters"), "one_char_share": ("n_one_char_words", "n_words"),
}
FEATURES = (*SHARES, "n_words", "n_symbols", "n_dup_lines", "longest_word")

_SYMBOL = np.isin(np.arange(256), np.frombuffer(SYMBOLS.encode(), np.uint8))
_DIGIT, _UPPER = (np.isin(np.arange(256), np.frombuffer(s, np.uint8)) for s in (b"0123456789", bytes(range(65, 91))))
_LETTER = _UPPER | np.isin(np.arange(256), np.frombuffer(bytes(range(97, 123)), np.uint8)) | (np.arange(256) >= 0xC0)
_POINT = (np.arange(256) & 0xC0) != 0x80  # bytes that begin a code point
_LINE_BASE, _GRAM_BASE = 0xD6E8FEB86659FD93, 0xA0761D6478BD642F


def _per_text(found: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How many of found (a flag per byte) each text has."""
    total = np.zeros(len(found) + 1, np.int64)
    np.cumsum(found, out=total[1:])
    return np.diff(total[offsets])


def _later(owner: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which entries equal an earlier entry of their owner, and which equal any other."""
    order = np.lexsort((np.arange(len(owner)), hashes, owner))
    same = (owner[order][1:] == owner[order][:-1]) & (hashes[order][1:] == hashes[order][:-1])
    later, some = np.zeros(len(owner), bool), np.zeros(len(owner), bool)
    later[order[1:]] = same
    some[order[1:]] = same
    some[order[:-1]] |= same
    return later, some


def _lines(data: np.ndarray, offsets: np.ndarray, starts: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How many lines with a word each text has, and how many of these equal an earlier one."""
    n = len(offsets) - 1
    cut = np.unique(np.concatenate([offsets[:-1][np.diff(offsets) > 0], np.flatnonzero(data == 10) + 1]))
    cut = cut[cut < len(data)]
    if not len(cut):
        return np.zeros(n, np.int64), np.zeros(n, np.int64)
    ends = np.append(cut[1:], len(data))
    ends = ends - (data[ends - 1] == 10)
    full = np.unique(np.searchsorted(cut, starts, "right") - 1)
    owner = np.searchsorted(offsets, cut[full], "right") - 1
    hashes = words.hashed(data, cut[full], ends[full])
    later, _ = _later(owner, hashes)
    return np.bincount(owner, minlength=n), np.bincount(owner[later], minlength=n)


def counts(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """COUNTS of the texts data[offsets[i]:offsets[i+1]], in UTF-8."""
    n = len(offsets) - 1
    doc, starts, ends, hashes = words.find_words(data, offsets)
    points = np.zeros(len(data) + 1, np.int64)
    np.cumsum(_POINT[data], out=points[1:])
    sizes = points[ends] - points[starts]
    n_words = np.bincount(doc, minlength=n)
    n_lines, dup_lines = _lines(data, offsets, starts, doc)
    whole = doc[WINDOW - 1 :] == doc[: len(doc) - WINDOW + 1] if len(doc) >= WINDOW else np.zeros(0, bool)
    first = np.flatnonzero(whole)
    _, again = _later(doc[first], words.rolled(hashes, WINDOW, _GRAM_BASE)[first] if len(first) else hashes[:0])
    covered = np.zeros(len(doc), bool)
    for k in range(WINDOW):
        covered[first[again] + k] = True
    distinct, _ = _later(doc, hashes)
    longest = np.zeros(n, np.int64)
    np.maximum.at(longest, doc, sizes)
    by = lambda flag: np.bincount(doc[flag], minlength=n)
    return [
        n_words, np.bincount(doc, sizes, minlength=n).astype(np.int64), _per_text(_SYMBOL[data], offsets), dup_lines, by(covered), n_lines, by(~distinct),
        _per_text(_LETTER[data], offsets), _per_text(_DIGIT[data], offsets), _per_text(_UPPER[data], offsets), by(sizes == 1), longest,
    ]


def statistics(docs: DataFrame) -> DataFrame:
    """(doc_id, *COUNTS) of every document's whole text; a null or empty text has zeros."""

    @words.trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, data, offsets in words.texts(batch.column(1)):
                found = [pa.array(x.astype(np.int64)) for x in counts(data, offsets)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, len(offsets) - 1), *found], ["doc_id", *COUNTS])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS))


def with_shares(stats: DataFrame) -> DataFrame:
    """stats with SHARES; a share of nothing is 0."""
    return stats.withColumns({name: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0) for name, (a, b) in SHARES.items()})


def base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > F.lit(int(100 * MOST_REPEATED)) * F.col("n_words"))


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    value: float

    def holds(self, x: dict[str, np.ndarray]) -> np.ndarray:
        return x[self.feature] > self.value if self.above else x[self.feature] <= self.value

    def column(self) -> Column:
        return F.col(self.feature) > self.value if self.above else F.col(self.feature) <= self.value

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.value:.6g}"


@dataclass
class DecisionList:
    """Rules in order; a document that one of them covers is of bad quality, all others are kept."""

    rules: list[tuple[Condition, ...]] = field(default_factory=list)

    def verdict(self) -> Column:
        """True for documents that no rule covers, as one conditional expression over FEATURES."""
        out = F.lit(True)
        for rule in reversed(self.rules):
            covered = F.lit(True)
            for c in rule:
                covered = covered & c.column()
            out = F.when(covered, False).otherwise(out)
        return out

    def __str__(self) -> str:
        return "\n".join(["IF " + " AND ".join(map(str, r)) + " THEN drop" for r in self.rules] + ["ELSE keep"])


def _covered(rule: tuple[Condition, ...], x: dict[str, np.ndarray], n: int) -> np.ndarray:
    found = np.ones(n, bool)
    for c in rule:
        found &= c.holds(x)
    return found


def _best(x: dict[str, np.ndarray], bad: np.ndarray, inside: np.ndarray) -> Condition | None:
    """The threshold that gains most information about the bad rows among those inside, counted by how many it keeps."""
    p0, n0 = int((inside & bad).sum()), int((inside & ~bad).sum())
    if not p0 or not n0:
        return None
    best, gained = None, 1e-9
    before = log2(p0 / (p0 + n0))
    for name in FEATURES:
        values, of = x[name][inside], bad[inside]
        edges = np.unique(values)
        if len(edges) > VALUES:
            edges = np.unique(np.quantile(values, np.linspace(0, 1, VALUES + 1), method="lower"))
            edges = np.unique(np.concatenate([edges, np.quantile(values[of], np.linspace(0, 1, VALUES + 1), method="lower")]))
        if len(edges) < 2:
            continue
        cuts = (edges[1:] + edges[:-1]) / 2
        at = np.searchsorted(cuts, values, "left")  # rows at or below cuts[k] have a place of at most k
        p_below, n_below = np.cumsum(np.bincount(at[of], minlength=len(edges)))[:-1], np.cumsum(np.bincount(at[~of], minlength=len(edges)))[:-1]
        for above, p, n in ((True, p0 - p_below, n0 - n_below), (False, p_below, n_below)):
            gain = np.where(p > 0, p * (np.log2(np.maximum(p, 1) / np.maximum(p + n, 1)) - before), 0)
            k = int(gain.argmax())
            if gain[k] > gained:
                best, gained = Condition(name, above, float(cuts[k])), float(gain[k])
    return best


def _pruned(rule: tuple[Condition, ...], x: dict[str, np.ndarray], bad: np.ndarray, inside: np.ndarray) -> tuple[tuple[Condition, ...], int, int]:
    """The beginning of the rule that is worth most on rows that it did not grow from, and how many bad and good ones it covers."""
    found = []
    for k in range(1, len(rule) + 1):
        covered = _covered(rule[:k], x, len(bad)) & inside
        p, n = int((covered & bad).sum()), int((covered & ~bad).sum())
        found.append(((p - n) / max(p + n, 1), -k, p, n))
    worth = max(found)
    return rule[: -worth[1]], worth[2], worth[3]


def learn(x: dict[str, np.ndarray], bad: np.ndarray, pruning: np.ndarray) -> DecisionList:
    """Sequential covering of the bad rows; rows marked pruning take no part in growing. The same rows give the same list."""
    left, out = np.ones(len(bad), bool), DecisionList()
    while (left & bad & ~pruning).any():
        rule, inside = (), left & ~pruning
        while len(rule) < CONDITIONS and (c := _best(x, bad, inside)):
            rule, inside = (*rule, c), inside & c.holds(x)
        if not rule:
            break
        rule, p, n = _pruned(rule, x, bad, left & pruning)
        if p < LEAST_ROWS or p < PRECISION * (p + n):
            break
        out.rules.append(rule)
        left &= ~_covered(rule, x, len(bad))
    return out


def fit(docs: DataFrame, labels: DataFrame, max_labels: int = MAX_LABELS) -> DecisionList:
    """A decision list from docs (doc_id, text) and labels (doc_id, quality 0 or 1).

    Learns from at most max_labels documents that are not held out (as for toxicity), have a label and pass the base rules. An id with
    both labels counts as bad; null ids and labels other than 0 and 1 are left out. Without bad documents the list is
    empty and keeps all.
    """
    by_hash = F.xxhash64("doc_id", F.lit(11))
    known = labels.where("quality IN (0, 1) AND doc_id IS NOT NULL").where(~held_out()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("quality"))
    known = known.orderBy(by_hash, "doc_id").limit(max_labels)
    rows = with_shares(statistics(docs.join(F.broadcast(known.select("doc_id")), "doc_id", "left_semi"))).where(~base_failed()).join(F.broadcast(known), "doc_id")
    rows = rows.select("doc_id", "quality", *FEATURES).orderBy(by_hash, "doc_id", *FEATURES).limit(max_labels).toPandas()
    if rows.empty:
        return DecisionList()
    return learn({f: rows[f].to_numpy(float) for f in FEATURES}, rows["quality"].to_numpy() == 0, np.arange(len(rows)) % PRUNING == 0)


def judge(docs: DataFrame, rules: DecisionList) -> DataFrame:
    """(doc_id, *COUNTS, *SHARES, base_failed, kept) for every document.

    A document without words (null or empty text) fails the base rules. Repeated rows are judged each; a null id is
    kept as null; other columns play no part.
    """
    stats = with_shares(statistics(docs)).withColumn("base_failed", base_failed())
    return stats.withColumn("kept", ~F.col("base_failed") & rules.verdict())
