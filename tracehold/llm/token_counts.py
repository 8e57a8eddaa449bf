"""Token counts of whole texts by a compiled finite-state transducer.

The vocabulary's merges are compiled into a deterministic transducer over characters. A sequence of pieces is what the
tokenizer gives exactly if each two neighbours are what it gives for those two alone; so the last piece of every prefix
follows from the last pieces of shorter ones. A state holds just that: the characters that a longer piece may still
begin in, with the last piece before each of them and how many tokens more it stands for than the least of them. A
transition is annotated with the tokens that it emits, those that no later character can undo; what a state still owes
is its closing count. Transitions are compiled where a corpus first takes them and are tables of numbers from then on,
run for all words of many texts at once, one character a step. Spaces after other characters, and characters outside of
the vocabulary, lead every state back to the start.

Texts are cut into chunks. A chunk's map takes the state it is entered in to the state it is left in and the tokens
between. It is made for the state that the characters before the chunk lead to. Where that is not the state that the
neighbour leaves, maps are composed by a parallel prefix scan: entries point to the next chunk's entry, and pointers
are doubled, so a text of n chunks takes log2(n) joins of small rows. A map that the scan misses is made for its state,
for all chunks of the same characters at once. Long texts are counted on any executors.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracehold.llm import words
from tracehold.llm.storage import discard, written

LIMIT = 4096
VOCABULARY = "piece_bpe_32k.model"
#: Characters of a chunk, of the run before it that tells how it is entered, and of a lane within a task.
CHUNK, LOOK, LANE = 16_384, 64, 1_024
#: Characters of texts counted together; states up to which a process keeps its table.
SLICE, MOST_STATES = 1 << 20, 400_000
MARK = "▁"
#: Bits of a packed transition that hold the emitted tokens, and the factor that spreads keys over the table.
EMITTED_BITS, _SPREAD = 12, np.uint64(0x9E3779B97F4A7C15)

State = tuple[str, tuple[tuple[int, str, int], ...]]
_START: State = ("", ((0, "", 0),))


class Transducer:
    """States, and transitions (state, character class) -> (state, emitted tokens), of one vocabulary."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self.model = model = SentencePieceProcessor(model_file=path)
        own = [i for i in range(model.get_piece_size()) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        self.scores = {model.id_to_piece(i): model.get_score(i) for i in own}
        self.pieces = {p: p for p in self.scores}
        self.begun = {p[:k] for p in self.scores for k in range(1, len(p))}
        alphabet = sorted({c for p in self.scores for c in p})
        if any(MARK in p.lstrip(MARK) for p in self.scores) or not all(c in self.scores for c in alphabet):
            raise ValueError("pieces reach over spaces, or some characters are no pieces")
        self.letters = ["", *alphabet]
        self.classes = np.zeros(0x110000, np.uint16)
        self.classes[[ord(c) for c in alphabet]] = np.arange(1, len(self.letters))
        self.mark = int(self.classes[ord(MARK)])
        self.classes[ord(" ")] = self.mark
        self.width = len(self.letters)
        self.apart: dict[tuple[str, str], bool] = {}
        self.forget()
        for probe in ("", " ", "a  b", " Über\nstraße ", "x▁y <s>", "\x00é日本 tokenizers'll"):
            if self.count([probe])[0] != len(model.encode(probe)):
                raise ValueError("the model does more to a text than this transducer")

    def forget(self) -> None:
        """Back to the start state alone."""
        self.states, self.numbers = [_START], {_START: 0}
        self.closing = np.zeros(1 << 12, np.int64)
        self.size = 0
        self.keys = np.full(1 << 14, -1, np.int64)
        self.values = np.zeros(1 << 14, np.int64)

    def number(self, state: State) -> int:
        found = self.numbers.get(state)
        if found is None:
            found = self.numbers[state] = len(self.states)
            self.states.append(state)
            if found == len(self.closing):
                self.closing = np.concatenate([self.closing, np.zeros_like(self.closing)])
            self.closing[found] = state[1][-1][2]
        return found

    def _stay_apart(self, left: str, right: str) -> bool:
        """Whether the tokenizer's merges of left + right never cross from one into the other."""
        found = self.apart.get((left, right))
        if found is None:
            scores, parts, found = self.scores, [*left, *right], True
            cut = len(left)  # the number of parts that make up left
            while found:
                best, at = None, -1
                for k in range(len(parts) - 1):
                    score = scores.get(parts[k] + parts[k + 1])
                    if score is not None and (best is None or score > best):
                        best, at = score, k
                if at < 0:
                    break
                found = at + 1 != cut
                parts[at : at + 2] = [parts[at] + parts[at + 1]]
                cut -= at + 1 < cut
            if len(self.apart) > MOST_STATES:
                self.apart.clear()
            self.apart[left, right] = found
        return found

    def _compiled(self, number: int, letter: str) -> tuple[int, int]:
        """The state after a character, and the tokens that it makes certain."""
        text, open_ = self.states[number]
        text += letter
        n, last, count, kept = len(text), None, 0, []
        for length, before, ahead in open_:
            piece = text[n - length - 1 :]
            if last is None and piece in self.pieces and (not before or self._stay_apart(before, piece)):
                last, count = self.pieces[piece], ahead + 1
            if piece in self.begun:
                kept.append((length + 1, before, ahead))
        kept.append((0, last, count))
        certain = min(ahead for _, _, ahead in kept)
        return self.number((text[n - kept[0][0] :] if kept[0][0] else "", tuple((length, before, ahead - certain) for length, before, ahead in kept))), certain

    def _place(self, keys: np.ndarray, values: np.ndarray) -> None:
        shift, mask = np.uint64(65 - len(self.keys).bit_length()), len(self.keys) - 1
        at = ((keys.view(np.uint64) * _SPREAD) >> shift).astype(np.int64)
        while len(keys):
            free = np.flatnonzero(self.keys[at] < 0)
            _, first = np.unique(at[free], return_index=True)
            won = free[first]
            self.keys[at[won]], self.values[at[won]] = keys[won], values[won]
            rest = np.ones(len(keys), bool)
            rest[won] = False
            keys, values, at = keys[rest], values[rest], (at[rest] + 1) & mask

    def _add(self, keys: np.ndarray) -> None:
        """Compiles the transitions of keys (state * width + class)."""
        values = np.empty(len(keys), np.int64)
        for k, key in enumerate(keys.tolist()):
            to, emitted = self._compiled(key // self.width, self.letters[key % self.width])
            values[k] = to << EMITTED_BITS | emitted
        self.size += len(keys)
        if 2 * self.size > len(self.keys):
            old = self.keys >= 0
            held = self.keys[old], self.values[old]
            wide = 1 << (4 * self.size).bit_length()
            self.keys, self.values = np.full(wide, -1, np.int64), np.zeros(wide, np.int64)
            self._place(*held)
        self._place(keys, values)

    def _looked_up(self, keys: np.ndarray) -> np.ndarray:
        """Packed transitions of keys, compiled where they are missing."""
        while True:
            shift, mask = np.uint64(65 - len(self.keys).bit_length()), len(self.keys) - 1
            at = ((keys.view(np.uint64) * _SPREAD) >> shift).astype(np.int64)
            met = self.keys[at]
            found = self.values[at]
            open_ = np.flatnonzero(met != keys)
            missing = []
            while len(open_):
                empty = met[open_] < 0
                if empty.any():
                    missing.append(open_[empty])
                    open_ = open_[~empty]
                at[open_] = (at[open_] + 1) & mask
                met[open_], found[open_] = self.keys[at[open_]], self.values[at[open_]]
                open_ = open_[met[open_] != keys[open_]]
            if not missing:
                return found
            self._add(np.unique(keys[np.concatenate(missing)]))

    def run(self, codes: np.ndarray, starts: np.ndarray, ends: np.ndarray, entered: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The states that runs of character classes are left in and the tokens they emit, entered in the given states."""
        by = np.argsort(starts - ends, kind="stable")
        begin, sizes, state = starts[by], (ends - starts)[by], entered[by].astype(np.int64)
        emitted = np.zeros(len(by), np.int64)
        alive = np.searchsorted(-sizes, -np.arange(int(sizes[0]) if len(sizes) else 0), "left")
        for k, n in enumerate(alive.tolist()):
            found = self._looked_up(state[:n] * self.width + codes[begin[:n] + k])
            state[:n] = found >> EMITTED_BITS
            emitted[:n] += found & ((1 << EMITTED_BITS) - 1)
        out, total = np.empty_like(state), np.empty_like(emitted)
        out[by], total[by] = state, emitted
        return out, total

    def scanned(self, codes: np.ndarray, first: np.ndarray, entered: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The states at the ends of texts and their tokens, as if the texts were closed there.

        Text i has the classes codes[first[i]:first[i+1]] and is entered in state entered[i]; -1 stands for the start.
        Tokens are counted from where it was entered, so that counts of neighbours add up. A character outside of the
        vocabulary has the negative of its bytes as its class.
        """
        n = len(first) - 1
        known = codes > 0
        edge = np.zeros(len(codes) + 1, bool)
        edge[first] = True
        edge = edge[:-1]
        before = np.zeros(len(codes), codes.dtype)
        before[1:] = codes[:-1]
        before[edge] = 0
        new = known & ((before <= 0) | ((codes == self.mark) & (before != self.mark)))
        starts, borders = np.flatnonzero(new), np.append(np.flatnonzero(new | ~known | edge), len(codes))
        ends = borders[np.searchsorted(borders, starts, "right")]
        text = np.searchsorted(first, starts, "right") - 1
        # lanes: words, and pieces of long ones
        lanes = -(-(ends - starts) // LANE)
        word = np.repeat(np.arange(len(starts)), lanes)
        place = np.arange(len(word)) - np.repeat(np.cumsum(lanes) - lanes, lanes)
        begin = starts[word] + place * LANE
        stop = np.minimum(begin + LANE, ends[word])
        state = np.zeros(len(word), np.int64)
        at_edge = (place == 0) & edge[begin]
        goes_on = at_edge & (entered[text[word]] >= 0)
        state[goes_on] = entered[text[word[goes_on]]]
        later = np.flatnonzero(place > 0)
        if len(later):
            state[later] = self.run(codes, begin[later] - LOOK, begin[later], np.zeros(len(later), np.int64))[0]
        left, tokens = self.run(codes, begin, stop, state)
        while len(later):
            later = later[state[later] != left[later - 1]]
            state[later] = left[later - 1]
            if len(later):
                left[later], tokens[later] = self.run(codes, begin[later], stop[later], state[later])
                later = np.flatnonzero(place > 0)
        tokens += self.closing[left]
        inner = (place > 0) | goes_on
        tokens[inner] -= self.closing[state[inner]]
        total = np.bincount(text[word], tokens, n).astype(np.int64) if len(word) else np.zeros(n, np.int64)
        odd = np.flatnonzero(codes < 0)
        if len(odd):
            total += np.bincount(np.searchsorted(first, odd, "right") - 1, -codes[odd], n).astype(np.int64)
        exits = np.zeros(n, np.int64)
        exits[(first[1:] == first[:-1]) & (entered >= 0)] = entered[(first[1:] == first[:-1]) & (entered >= 0)]
        if len(word):
            last = np.flatnonzero(np.append(word[1:] != word[:-1], True) & (stop == first[text[word] + 1]))
            exits[text[word[last]]] = left[last]
        return exits, total

    def coded(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Classes of the characters of texts one after the other, and where each begins."""
        points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        codes = self.classes[points].astype(np.int64)
        odd = np.flatnonzero(codes == 0)
        codes[odd] = -(1 + (points[odd] > 0x7F).astype(np.int64) + (points[odd] > 0x7FF) + (points[odd] > 0xFFFF))
        return codes, np.append(0, np.cumsum(list(map(len, texts)), dtype=np.int64))

    def count(self, texts: list[str]) -> np.ndarray:
        """Tokens of whole texts; a text that is not empty is entered by a space of its own."""
        if len(self.states) > MOST_STATES:
            self.forget()
        return self.scanned(*self.coded([MARK + t if t else t for t in texts]), np.full(len(texts), -1))[1]

    def name(self, state: int) -> str:
        """A state's name in all processes."""
        return json.dumps(self.states[state])

    def named(self, name: str) -> int:
        text, open_ = json.loads(name)
        return self.number((text, tuple(map(tuple, open_))))

    def chunk_map(self, text: str, look: str, entered: str | None = None) -> tuple[str | None, str, int]:
        """(entered, left, tokens) of a chunk and the names of its states; look is the text before it, empty for a first chunk.

        Where entered is not given it is the state that look leads to, or None if the chunk's first character leads all
        states to the start, which fits any neighbour.
        """
        if len(self.states) > MOST_STATES:
            self.forget()
        if not look:
            look, text = "", MARK + text
        codes, _ = self.coded([look + text])
        a, b = (codes[len(look) - 1] if look else 0), codes[len(look)]
        if not look or b < 0 or a < 0 or (b == self.mark and a != self.mark):
            entered, state = None, -1
        elif entered is None:
            state = int(self.scanned(codes[: len(look)], np.array([0, len(look)]), np.array([-1]))[0][0])
            entered = self.name(state)
        else:
            state = self.named(entered)
        left, tokens = self.scanned(codes[len(look) :], np.array([0, len(codes) - len(look)]), np.array([state]))
        return entered, self.name(int(left[0])), int(tokens[0])


_loaded: dict[str, Transducer] = {}


def transducer(path: str | None = None) -> Transducer:
    """The transducer of a vocabulary file (the public one where none is given), once per process."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(VOCABULARY)
    if path not in _loaded:
        _loaded[path] = Transducer(path)
    return _loaded[path]


def _slices(column: pa.Array, size: pa.Array) -> Iterator[list[str]]:
    """The texts of a column (null: empty) in runs of about SLICE characters."""
    at, ends = 0, np.cumsum(size.to_numpy())
    while at < len(column):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + SLICE, "right")))
        yield [t or "" for t in column.slice(at, to - at).to_pylist()]
        at = to


def _scan(maps: DataFrame) -> DataFrame:
    """The entries of maps (_row, _chunk, entered, left, tokens; entered '' fits any) that each row's text goes through, from its first chunk on.

    A parallel prefix: entries point to the entry of the next chunk that their state enters, and pointers are doubled by
    joins, so a text of n chunks takes log2(n) steps. The scan of a row ends where the next chunk has no entry.
    """
    steps = maps.select("_row", (F.col("_chunk") - 1).alias("_chunk"), F.col("entered").alias("_to"))
    fits = maps.select("_row", "_chunk", "entered", "left").join(steps, ["_row", "_chunk"]).where("_to IN ('', left)")
    jump = written(fits.select("_row", F.struct("_chunk", "entered").alias("_at"), F.struct((F.col("_chunk") + 1).alias("_chunk"), F.col("_to").alias("entered")).alias("_next")), "token-jumps")
    reached = written(maps.where("_chunk = 0").select("_row", F.struct("_chunk", "entered").alias("_at")), "token-reached")
    while not jump.isEmpty():
        more = reached.join(jump, ["_row", "_at"]).select("_row", F.col("_next").alias("_at"))
        far = jump.select("_row", F.col("_at").alias("_next"), F.col("_next").alias("_far"))
        before, old = reached, jump
        reached = written(reached.unionByName(more), "token-reached")
        jump = written(jump.join(far, ["_row", "_next"]).select("_row", "_at", F.col("_far").alias("_next")), "token-jumps")
        discard(before, old)
    discard(jump)
    return maps.join(reached.select("_row", "_at._chunk", "_at.entered"), ["_row", "_chunk", "entered"])


def _chunk_sums(cut: DataFrame, vocabulary: str | None, rounds: list[int] | None = None) -> DataFrame:
    """(_row, n_tokens) of texts given as chunks (_row, _chunk, part, look). rounds gets a number for each round of maps.

    Each chunk is mapped for the state that look leads to. Where that is the state that the chunk before is left in, all
    through a text, its tokens are summed. Other texts are scanned; where a scan ends, the chunk is mapped for the state it
    is entered in, and so are the text's later chunks of the same characters, as a text that repeats will ask for it again.
    """

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = transducer(vocabulary)
        for batch in batches:
            made = [machine.chunk_map(*row) for row in zip(*(batch.column(c).to_pylist() for c in (2, 3, 4)), strict=True)]
            columns = [pa.array([m[0] or "" for m in made]), pa.array([m[1] for m in made]), pa.array([m[2] for m in made], pa.int64())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], names=["_row", "_chunk", "entered", "left", "tokens"])

    def maps_of(chunks: DataFrame) -> DataFrame:
        if rounds is not None:
            rounds.append(len(rounds) + 1)
        found = chunks.select("_row", "_chunk", "part", "look", "given").mapInArrow(words.trimmed(mapped), "_row long, _chunk long, entered string, left string, tokens long")
        return written(found, "token-maps")

    maps = maps_of(cut.withColumn("given", F.lit(None).cast("string")))
    before = F.lag("left").over(Window.partitionBy("_row").orderBy("_chunk"))
    unsure = written(maps.withColumn("_before", before).where("entered NOT IN ('', _before)").select("_row").distinct(), "token-unsure")
    total = F.sum("tokens").alias("n_tokens")
    sure = maps.join(unsure, "_row", "left_anti").groupBy("_row").agg(total)
    if unsure.isEmpty():
        return sure
    own = written(cut.join(unsure, "_row").withColumn("_same", F.xxhash64("part", "look")), "token-chunks")
    maps = maps.join(unsure, "_row")
    while True:
        scanned = written(_scan(maps), "token-scanned")
        ends = scanned.groupBy("_row").agg((F.max("_chunk") + 1).alias("_chunk"), F.max_by("left", "_chunk").alias("given"))
        asked = written(own.join(ends, ["_row", "_chunk"]).select("_row", F.col("_chunk").alias("_from"), "_same", "given"), "token-asked")
        if asked.isEmpty():
            return sure.unionByName(scanned.groupBy("_row").agg(total))
        again = own.join(asked, ["_row", "_same"]).where("_chunk >= _from")
        more = maps_of(again).join(maps.select("_row", "_chunk", "entered"), ["_row", "_chunk", "entered"], "left_anti")
        maps = written(maps.unionByName(more), "token-maps")


def count(docs: DataFrame, vocabulary: str | None = None, limit: int = LIMIT) -> DataFrame:
    """docs (text) with n_bytes (of UTF-8), n_tokens, and over_limit (n_tokens > limit).

    Null and empty texts have no tokens. Texts of more than CHUNK characters are cut into chunks that any task counts;
    none is put together again, however long its words are. Repeated rows are counted alike; an empty table stays empty;
    columns of docs named like the added ones are replaced.
    """
    docs = docs.drop("n_bytes", "n_tokens", "over_limit")
    kept = docs.schema.fieldNames()
    length = F.coalesce(F.length("text"), F.lit(0))
    rows = docs.withColumn("n_bytes", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long"))
    carried = rows.columns

    def short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = transducer(vocabulary)
        for batch in batches:
            counts = [machine.count(some) for some in _slices(batch.column(carried.index("text")), batch.column(len(carried)))]
            n = pa.array(np.concatenate(counts) if counts else np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(carried)], n], names=[*carried, "n_tokens"])

    brief = rows.where(length <= CHUNK).withColumn("_size", length.cast("long")).mapInArrow(words.trimmed(short), rows.schema.add("n_tokens", "long"))
    # a row's number must not change if its task runs again, so it is written with the rows
    long = written(rows.where(length > CHUNK).withColumn("_row", F.monotonically_increasing_id()), "token-long")
    cut = long.select("_row", F.explode(F.sequence(F.lit(0), F.floor((length - 1) / CHUNK).cast("int"))).alias("k"), "text")
    look = F.when(F.col("k") > 0, F.substr("text", F.col("k") * CHUNK + 1 - LOOK, F.lit(LOOK))).otherwise("")
    cut = cut.select("_row", F.col("k").cast("long").alias("_chunk"), F.substr("text", F.col("k") * CHUNK + 1, F.lit(CHUNK)).alias("part"), look.alias("look")).repartition("_row", "_chunk")
    counted = brief.unionByName(long.join(_chunk_sums(cut, vocabulary), "_row").select(*carried, "n_tokens"))
    return counted.select(*kept, "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
