"""Toxicity: noisy-channel deobfuscation, then a linear score of the restored words.

A token that may be disguised (digits or symbols between letters, letters spaced apart, letters drawn out) becomes a
lattice: each observed character offers the letters that it may stand for, each with a channel cost, or may be skipped
as a separator or a repeat. Runs of spaced letters and long tokens may also break into words. Viterbi decoding under a character trigram model picks the cheapest letters. The trigram
counts are taken over all documents; the table has at most 64**3 rows whatever the corpus.

The classifier sees the words as written and as restored, and the beginnings of each of them. It learns from at most
max_labels labelled rows, one of each group of near-equal texts. A document scores by its strongest feature, a logistic
function of that weight.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from math import ceil, exp, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracehold.llm import words
from tracehold.llm.storage import written

#: What disguising characters stand for.
LEET = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "il", "|": "li", "+": "t", "(": "c", "€": "e", "¡": "i"}
#: Channel costs in nats: a substitute, a skipped separator, a skipped sign that could be a letter, a second and a further repeat.
COST_LEET, COST_SEPARATOR, COST_SIGN, COST_SECOND, COST_FURTHER = 0.7, 0.3, 6.0, 4.0, 0.1
CLASSES = 64
#: Tokens of more characters are read as several words, as are letters that are spaced apart.
LONG_TOKEN = 64
PREFIXES = range(3, 9)
MAX_LABELS = 50_000
#: Steps to a unit in which weights are told apart for the cut.
STEPS = 20
#: The least share of the toxic labelled rows that must have a feature; it bounds how many there are.
LEAST_SHARE = 0.01
#: Min-hashes that near-equal labelled rows share.
MINS = 6
#: Characters of the words whose readings a task remembers.
CACHE = 4_000_000

_SPACED = re.compile(r"(?<!\S)(?:[^\W_][ .\-_*]){3,}[^\W_](?!\S)")
_DRAWN = re.compile(r"(.)\1\1")
_INNER = re.compile(r"[^\W\d_].*[\d@$!|+(€¡.\-_*].*[^\W\d_]|^[\d@$!|+(€¡].*[^\W\d_]{2}|[^\W\d_]{2}.*[\d]$")
_EDGE = re.compile(r"^[^\w@$!|+(€¡]+|[\W_]+$")


def _class_table() -> np.ndarray:
    found = np.zeros(0x3000, np.uint8)
    for c in range(len(found)):
        ch = chr(c)
        if "a" <= ch <= "z":
            found[c] = c - 96
        elif ch.isalpha():
            found[c] = 27 + c % 37
    return found


_CLASS = _class_table()


def char_class(ch: str) -> int:
    c = ord(ch)
    return int(_CLASS[c]) if c < len(_CLASS) else (27 + c % 37 if ch.isalpha() else 0)


def _trigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(CLASSES**3, np.int64)
    for batch in batches:
        for row, data, offsets in words.texts(batch.column(0)):
            text = b"\n".join(data[a:b].tobytes() for a, b in zip(offsets[:-1], offsets[1:], strict=True)).decode("utf-8", "replace").lower()
            points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
            classes = np.where(points < len(_CLASS), _CLASS[np.minimum(points, len(_CLASS) - 1)], 27 + points % 37).astype(np.int64)
            classes = np.concatenate([np.zeros(2, np.int64), classes])
            total += np.bincount((classes[:-2] << 12) | (classes[1:-1] << 6) | classes[2:], minlength=CLASSES**3)
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["code", "n"])


def char_model(docs: DataFrame) -> np.ndarray:
    """-ln P(c | a, b) of character classes over all texts, interpolated with lower orders; CLASSES**3 numbers."""
    rows = docs.select("text").mapInArrow(words.trimmed(_trigrams), "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(CLASSES**3)
    counts[rows.column(0).to_numpy()] = rows.column(1).to_numpy()
    tri = counts.reshape(CLASSES, CLASSES, CLASSES)
    bi, uni = tri.sum(0), tri.sum((0, 1))
    p1 = (uni + 1) / (uni.sum() + CLASSES)
    p2 = (bi + 20 * p1) / (bi.sum(1, keepdims=True) + 20)
    p3 = (tri + 20 * p2) / (tri.sum(2, keepdims=True) + 20)
    return -np.log(p3).astype(np.float32).ravel()


def _lattice(token: str, breaks: bool = False) -> list[list[tuple[str, float]]]:
    """For each observed character, the letters it may stand for ('' to skip it) and their costs; breaks: see decode()."""
    steps = []
    run = 0
    for k, ch in enumerate(token):
        run = run + 1 if k and token[k - 1] == ch else 1
        options: list[tuple[str, float]] = []
        if ch.isalpha():
            options.append((ch, 0.0))
        options += [(letter, COST_LEET) for letter in LEET.get(ch, "")]
        if not ch.isalpha():
            options.append(("", COST_SIGN if ch in LEET else COST_SEPARATOR))
        elif run > 1:
            options.append(("", COST_SECOND if run == 2 and token[k + 1 : k + 2] != ch else COST_FURTHER))
        if breaks:
            options += [(letter + " ", cost + COST_SEPARATOR * (letter != "")) for letter, cost in options]
        steps.append(options)
    return steps


def decode(token: str, model: list[float], breaks: bool = False) -> str:
    """The cheapest letters of a token, by Viterbi over all states of the last two classes; work is linear in its length.

    breaks: a word may end after each letter and at each skipped sign; the words come with spaces between them.
    """
    states: dict[tuple[int, int], tuple[float, tuple | None]] = {(0, 0): (0.0, None)}  # the letters as (those before, the last)
    for options in _lattice(token, breaks):
        nexts: dict[tuple[int, int], tuple[float, tuple | None]] = {}
        choices = [(letters, paid, [char_class(ch) for ch in letters]) for letters, paid in options]
        for (a, b), (cost, text) in states.items():
            for letters, paid, classes in choices:
                x, y, now = a, b, cost + paid
                for c in classes:
                    now += model[(x << 12) | (y << 6) | c]
                    x, y = y, c
                key = x, y
                if key not in nexts or now < nexts[key][0]:
                    nexts[key] = (now, (text, letters) if letters else text)
        states = nexts
    text = min(((cost + model[(a << 12) | (b << 6)], text) for (a, b), (cost, text) in states.items()), key=lambda s: s[0])[1]
    letters = []
    while text:
        text, last = text
        letters.append(last)
    return "".join(reversed(letters))


def bare(word: str) -> str:
    return _EDGE.sub("", word)


def suspicious(word: str) -> bool:
    return len(word) > 2 and not (word.isalpha() and not _DRAWN.search(word)) and bool(_INNER.search(word) or _DRAWN.search(word))


def readings(word: str, model: list[float]) -> tuple[str, ...]:
    """A lower-case word without its edge signs, and the words of its restored form where it may be disguised."""
    core = bare(word)
    if core and suspicious(core):
        restored = decode(core, model, len(core) > LONG_TOKEN).split()
        if restored and restored != [core]:
            return core, *restored
    return (core,) if core else ()


def spaced(text: str, model: list[float]) -> list[str]:
    """The restored words of letters that are spaced apart in a lower-case text: each run as one word and as several."""
    found = []
    for m in _SPACED.finditer(text):
        found += [decode(m[0], model), *decode(m[0], model, True).split()]
    return found


def features(word: str) -> list[str]:
    return [word + "$", *(word[:n] for n in PREFIXES if len(word) > n)] if len(word) > 2 else []


@dataclass
class Model:
    """chars: the character model. weights: log-likelihood ratios of features. cut: the weight that scores 1/2."""

    chars: np.ndarray
    weights: dict[str, float] = field(default_factory=dict)
    cut: float = 4.0


class _Reader:
    """The features of texts, with the restored forms of words remembered within a task."""

    def __init__(self, chars: np.ndarray):
        self.chars = chars.tolist()
        self.known: dict[str, tuple[str, ...]] = {}
        self.held = 0

    def words(self, text: str) -> set[str]:
        text = text.lower()
        found: set[str] = set()
        for word in set(text.split()):
            got = self.known.get(word)
            if got is None:
                if self.held > CACHE:
                    self.known.clear()
                    self.held = 0
                got = self.known[word] = readings(word, self.chars)
                self.held += len(word) + 16
            found.update(got)
        found.update(spaced(text, self.chars))
        return found


def _near(text: str) -> int:
    """One number for the MINS least hashes of the 3-word shingles; a shared line alone does not make two texts alike."""
    data = np.frombuffer(text.encode(), np.uint8)
    hashes = words.find_words(data, np.array([0, len(data)]), lower=True)[3]
    rolled = words.rolled(hashes, min(3, max(1, len(hashes))), 0xD1342543DE82EF95)
    if not len(rolled):
        return 0
    least = np.array([words.mix(rolled ^ np.uint64(k * 0x9E3779B97F4A7C15 & (1 << 64) - 1)).min() for k in range(MINS)])
    return int(words.rolled(least, MINS, 0xC2B2AE3D27D4EB4F).view(np.int64)[0])


def _counted(chars: np.ndarray, wanted: set[str] | None):
    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, seen = _Reader(chars), Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                mine = {f for w in reader.words(text or "") for f in features(w)}
                seen.update(mine if wanted is None else mine & wanted)
                if len(seen) > 2_000_000:
                    yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], ["feature", "n"])
                    seen.clear()
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], ["feature", "n"])

    return counted


def _nears(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        near = [_near(t or "") for t in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(near, pa.int64())], ["doc_id", "text", "toxic", "near"])


def held_out(doc_id="doc_id"):
    """Whether crc32 of the id as text leaves 0 modulo 5; false for a null id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, max_labels: int = MAX_LABELS) -> Model:
    """A model from docs (doc_id, text), all of them for the characters, and labels (doc_id, toxic) for the words.

    Rows whose crc32(doc_id) modulo 5 is 0 are held out. Of the rest, at most about max_labels are taken, by a hash of
    the id, so that they can be broadcast and no text is shuffled but theirs. Of near-equal rows one counts. Without
    labelled rows of both kinds the model has no weights and every score is low. Rows that repeat a doc_id with other
    texts are rows of that label; null ids and texts have none and no words.
    """
    chars = char_model(docs)
    known = labels.where(F.col("toxic").isin(0, 1) & ~held_out()).select("doc_id", "toxic").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    share = max_labels / max(known.count(), 1)
    if share < 1:
        known = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(share * (1 << 20)))
    labelled = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id").select("doc_id", "text", "toxic").mapInArrow(words.trimmed(_nears), "doc_id long, text string, toxic int, near long")
    rows = written(labelled.groupBy("near", "toxic").agg(F.min_by("text", "doc_id").alias("text")), "toxicity-labelled")
    totals = {r["toxic"]: r["count"] for r in rows.groupBy("toxic").count().collect()}
    toxic, clean = totals.get(1, 0), totals.get(0, 0)
    model = Model(chars)
    if not toxic or not clean:
        return model
    counts = lambda kind, wanted: rows.where(F.col("toxic") == kind).select("text").mapInArrow(words.trimmed(_counted(chars, wanted)), "feature string, n long").groupBy("feature").agg(F.sum("n").alias("n"))
    least = max(4, ceil(LEAST_SHARE * toxic))
    bad = {r["feature"]: r["n"] for r in counts(1, None).where(F.col("n") >= least).collect()}
    good = {r["feature"]: r["n"] for r in counts(0, set(bad)).collect()}
    for f, n in bad.items():
        ratio = log((n + 0.5) / (toxic + 1)) - log((good.get(f, 0) + 0.5) / (clean + 1))
        if ratio > 1:
            model.weights[f] = ratio
    steps = score(rows.select("text", "toxic"), model).groupBy("toxic", F.round(F.col("strongest") * STEPS).cast("int").alias("step")).count().collect()
    model.cut = best_cut([(r["step"] / STEPS, r["toxic"], r["count"]) for r in steps])
    return model


def best_cut(counts: list[tuple[float, int, int]]) -> float:
    """Between two weights, the cut with the least harm, from (strongest weight, toxic, rows): a clean row lost counts twice."""
    levels = sorted({w for w, _, _ in counts} | {0.0})
    between = [(a + b) / 2 for a, b in zip(levels, [*levels[1:], levels[-1] + 1], strict=True)]
    wrong = lambda cut: sum(n * (1 if toxic else 2) for w, toxic, n in counts if (w > cut) != bool(toxic))
    return min(between, key=lambda cut: (wrong(cut), -cut))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """docs with score (0 to 1; higher: likelier toxic), predicted (1 from 0.5 on) and strongest (the weight behind it).

    Whole texts are read, spaced letters and disguised tokens at any length. Null and empty texts get the score of a text
    without any feature. Repeated rows score alike; an empty table stays empty; columns of docs named like the added ones are replaced.
    """
    docs = docs.drop("score", "predicted", "strongest")

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, weights, worth, held = _Reader(model.chars), model.weights, {}, 0
        for batch in batches:
            strongest = []
            for text in batch.column(batch.schema.get_field_index("text")).to_pylist():
                text = (text or "").lower()
                best = 0.0
                for word in set(text.split()):
                    value = worth.get(word)
                    if value is None:
                        if held > CACHE:
                            worth.clear()
                            held = 0
                        held += len(word) + 16
                        value = worth[word] = max((weights.get(f, 0.0) for w in readings(word, reader.chars) for f in features(w)), default=0.0)
                    if value > best:
                        best = value
                for word in spaced(text, reader.chars):
                    best = max(best, *(weights.get(f, 0.0) for f in features(word)), 0.0)
                strongest.append(best)
            scores = [1 / (1 + exp(2 * (model.cut - w))) for w in strongest]
            added = [pa.array(scores, pa.float64()), pa.array([int(s >= 0.5) for s in scores], pa.int32()), pa.array(strongest, pa.float64())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *added], names=[*batch.schema.names, "score", "predicted", "strongest"])

    schema = docs.select("*").schema.add("score", "double").add("predicted", "integer").add("strongest", "double")
    return docs.mapInArrow(words.trimmed(scored), schema)


def restore(docs: DataFrame, model: Model) -> DataFrame:
    """docs with the column restored: the lower-case text, disguised tokens and spaced letters replaced by their letters."""
    docs = docs.drop("restored")

    def restored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = _Reader(model.chars)
        for batch in batches:
            out = []
            for text in batch.column(batch.schema.get_field_index("text")).to_pylist():
                text = _SPACED.sub(lambda m: decode(m[0], reader.chars, True).strip(), (text or "").lower())
                out.append(re.sub(r"\S+", lambda m: " ".join(readings(m[0], reader.chars)[1:]) or bare(m[0]) if suspicious(bare(m[0])) else m[0], text))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.string())], names=[*batch.schema.names, "restored"])

    return docs.mapInArrow(words.trimmed(restored), docs.select("*").schema.add("restored", "string"))
