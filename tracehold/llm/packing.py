"""Hierarchical multi-length packing of tokenized documents into training sequences.

Each task tokenizes its rows and packs runs of them. A document first fills whole windows of the longest tier; what is
left of it is routed to the shortest tier that holds it. Tiers are packed from the longest down: a window opens with
the longest piece of its tier, its gap is filled with the largest shorter pieces that fit, and the last of them is cut
to close it. What no window takes waits for the task's next documents; at a task's end the rest is laid end to end and
cut at powers of two, so every sequence is full. Tiers are powers of two and need no padding.

Full sequences of a tier are dealt to step groups with the same number of tokens each.
"""

from __future__ import annotations

import os
import unicodedata
import zlib
from bisect import bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from tracehold.llm import words

LONGEST = 4096
TIERS = (256, 512, 1024, 2048, LONGEST)
#: Tokens held while a task packs, characters of the words whose ids it remembers, words of a text at a time, tokens of a step group.
HELD, CACHE, RUN, STEP_TOKENS = 1_000_000, 14_000_000, 200_000, 65_536
#: Texts whose unknown words are tokenized together.
GROUP = 100
VOCABULARY = "word_bpe_49k.json"
END = 2

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, sequence_length long, tier int, step_group long"

_PUNCTUATION = "".join(c for c in map(chr, range(33, 127)) if not c.isalnum() and c != "'")
#: Separators of str.split() that the tokenizer does not take for white space.
_ODD = ("\x1c", "\x1d", "\x1e", "\x1f")


class WordTokenizer:
    """Ids of texts, word by word: the vocabulary's merges never cross white space, so a word's ids can be remembered.

    A word of letters with trailing signs is two tokens' worth of text for the tokenizer; its letters and its signs are
    remembered apart. Any other word goes to the tokenizer as it is.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=False)
        self.ends = np.zeros(max(vocabulary.values()) + 3, bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.words: dict[str, bytes] = {}
        self.letters: dict[str, bytes] = {}
        self.held = 0
        probes = ["", "Plain words, it's 12abc!", " Ünï x\x1cy <|startoftext|>z don't.", "日本 a\n\tb"]
        for probe, found in zip(probes, self.ids(probes), strict=True):
            if found.tolist() != self.tokenizer.encode(probe, add_special_tokens=False).ids:
                raise ValueError("this vocabulary does not part words at white space, lower-cased and with word ends")

    def _plain(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, np.uint32).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn_letters(self, cores: list[str]) -> None:
        for k in range(0, len(cores), 500):
            some = cores[k : k + 500]
            ids = np.frombuffer(self._plain([" ".join(some)])[0], np.uint32)
            cuts = np.flatnonzero(self.ends[ids]) + 1
            if len(cuts) == len(some):
                self.letters.update(zip(some, (ids[a:b].tobytes() for a, b in zip([0, *cuts[:-1].tolist()], cuts.tolist(), strict=True)), strict=True))
            else:
                self.letters.update(zip(some, self._plain(some), strict=True))

    def _learn(self, missing: list[str]) -> None:
        if self.held > CACHE:
            self.words.clear()
            self.letters.clear()
            self.held = 0
        self.held += sum(map(len, missing)) + 16 * len(missing)
        parts, other = {}, []
        for word in missing:
            core = word.rstrip(_PUNCTUATION)
            if core.isalpha() and "<|" not in word and (core.isascii() or unicodedata.is_normalized("NFC", core)):
                core = core.lower() if core.isascii() else core
                parts[word] = core, word[len(core) :]
            else:
                other.append(word)
        wanted = {core for core, _ in parts.values() if core not in self.letters}
        signs = {s for _, s in parts.values() if s and s not in self.letters}
        self._learn_letters(list(wanted))
        self.letters.update(zip(signs, self._plain(list(signs)), strict=True))
        for word, (core, sign) in parts.items():
            self.words[word] = self.letters[core] + self.letters[sign] if sign else self.letters[core]
        self.words.update(zip(other, self._plain(other), strict=True))

    def ids(self, texts: list[str]) -> Iterator[np.ndarray]:
        """The ids of each text as the tokenizer gives them, without special tokens of its own."""
        split = [[text] if any(c in text for c in _ODD) else text.split() for text in texts]
        missing = {w for run in split if len(run) <= RUN for w in run if w not in self.words}
        if missing:
            self._learn(list(missing))
        for run in split:
            for k in range(0, len(run), RUN):  # a very long text in runs of words, so that the memory of words suffices
                got = list(map(self.words.get, part := run[k : k + RUN]))
                if None in got:  # the memory was emptied meanwhile, or the text is long
                    self._learn(list(set(part)))
                    got = [self.words[w] for w in part]
                run[k : k + RUN] = got
            yield np.frombuffer(b"".join(run), np.uint32)


_loaded: dict[str, WordTokenizer] = {}


def word_tokenizer(path: str | None = None) -> WordTokenizer:
    """The tokenizer of a vocabulary file (the public one where none is given), loaded once per process."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(VOCABULARY)
    if path not in _loaded:
        _loaded[path] = WordTokenizer(path)
    return _loaded[path]


class _Packer:
    """Packs pieces (document number, first token, number of tokens) and numbers the sequences of one task."""

    def __init__(self, task: int):
        self.next_id, self.made = task << 36, {}
        self.group = task << 36
        self.rows: list[tuple] = []
        self.pool: list[tuple[int, int, int]] = []  # (length, document, start), ascending

    def add(self, doc: int, start: int, length: int) -> None:
        while length >= LONGEST:
            self._close(LONGEST, [(doc, start, LONGEST)])
            start, length = start + LONGEST, length - LONGEST
        if length:
            insort(self.pool, (length, doc, start))

    def _close(self, tier: int, pieces: list[tuple[int, int, int]]) -> None:
        size = sum(p[2] for p in pieces)
        count = self.made[tier] = self.made.get(tier, -1) + 1
        group = self.group + (TIERS.index(tier) << 30 if tier in TIERS else (len(TIERS) << 30)) + count * tier // STEP_TOKENS
        at = 0
        for doc, start, length in pieces:
            self.rows.append((doc, start, length, self.next_id, at, size, tier, group))
            at += length
        self.next_id += 1

    def pack(self, least: int) -> None:
        """Closes windows while the pool holds more than least tokens of pieces."""
        held = sum(p[0] for p in self.pool)
        for k in range(len(TIERS) - 1, -1, -1):
            tier, below = TIERS[k], TIERS[k - 1] if k else 0
            while held - least >= tier and self.pool and below < self.pool[-1][0] <= tier:
                length, doc, start = self.pool.pop()
                pieces, gap = [(doc, start, length)], tier - length
                while gap:
                    at = bisect_right(self.pool, (gap, 1 << 62, 0)) - 1
                    if at >= 0:
                        length, doc, start = self.pool.pop(at)
                    else:  # nothing fits whole: the shortest piece is cut to close the window
                        length, doc, start = self.pool.pop(0)
                        insort(self.pool, (length - gap, doc, start + gap))
                        length = gap
                    pieces.append((doc, start, length))
                    gap -= length
                held -= tier
                self._close(tier, pieces)

    def finish(self) -> None:
        """Lays the rest end to end and cuts it at powers of two."""
        self.pack(0)
        left, self.pool = self.pool[::-1], []
        total = sum(p[0] for p in left)
        while total:
            room = size = min(LONGEST, 1 << (total.bit_length() - 1))
            pieces = []
            while room:
                length, doc, start = left.pop(0)
                if length > room:
                    left.insert(0, (length - room, doc, start + room))
                    length = room
                pieces.append((doc, start, length))
                room -= length
            total -= size
            self._close(size, pieces)


def _packed(path: str | None):
    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, packer = word_tokenizer(path), _Packer(TaskContext.get().partitionId())
        docs: dict[int, tuple[int | None, np.ndarray]] = {}
        held = number = 0

        def out() -> pa.RecordBatch:
            nonlocal docs
            rows, packer.rows = packer.rows, []
            columns = list(zip(*rows, strict=True)) if rows else [()] * 8
            crc = [zlib.crc32(docs[d][1][s : s + n].astype("<u4", copy=False)) for d, s, n, *_ in rows]
            made = [[docs[d][0] for d in columns[0]], columns[1], columns[2], crc, [len(docs[d][1]) for d in columns[0]], columns[3], columns[4], columns[5], columns[6], columns[7]]
            waiting = {p[1] for p in packer.pool}
            docs = {d: docs[d] for d in waiting}
            types = [pa.int64()] * 8 + [pa.int32(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(made, types, strict=True)], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "sequence_length", "tier", "step_group"])

        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            for k in range(0, batch.num_rows, GROUP):
                some = [t or "" for t in texts.slice(k, GROUP).to_pylist()]
                for doc_id, found in zip(ids.slice(k, GROUP).to_pylist(), tokenizer.ids(some), strict=True):
                    tokens = np.append(found, np.uint32(END))
                    docs[number] = doc_id, tokens
                    packer.add(number, 0, len(tokens))
                    number, held = number + 1, held + len(tokens)
                    if held >= HELD:
                        packer.pack(LONGEST)
                        yield out()
                        held = sum(len(t) for _, t in docs.values())
        packer.finish()
        yield out()

    return packed


def pack(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """One row per piece of docs (doc_id, text), all of them packed; columns as in SCHEMA.

    A document's ids are those of its whole text and the end id 2; a null or empty text has the end id alone. Every id
    lies in exactly one piece. sequence_length is always a power of two up to 4096, so no sequence is padded;
    sequence_id and offset give a piece's place, tier the window's length, step_group sequences of one tier that hold
    STEP_TOKENS tokens together (the last group of a task fewer). Rows that repeat a doc_id are documents of their own.
    An empty table gives an empty result; other columns play no part.
    """
    return docs.selectExpr("CAST(doc_id AS LONG) AS doc_id", "text").mapInArrow(words.trimmed(_packed(vocabulary)), SCHEMA)
