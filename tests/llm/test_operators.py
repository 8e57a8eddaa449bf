"""Each training-data operator against a brute-force version, with nulls, empty and long texts, repeats and clashing columns."""

from __future__ import annotations

import base64
import hashlib
import itertools
import math
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tracehold.llm import catalog, components, jaccard_join, mixing, nearest, packing, secret_scan, substring_dedup, token_counts, topk_search, toxicity, warc
from tracehold.llm.storage import written

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string"


def words(text):
    return WORD.findall(text or "")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def similar_texts(seed, n=200):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(rng.choice([6, 400]))]
    rows = []
    for i in range(n):
        own = random.Random(f"{seed} {i // 6}")
        text = [own.choice(vocabulary) for _ in range(own.randint(1, 60))]
        for _ in range(rng.randint(0, 3)):
            k = rng.randrange(len(text) + 1)
            text = text[:k] + [rng.choice(vocabulary)] * rng.randint(0, 1) + text[k + rng.randint(0, 1) :]
        rows.append((i, " ".join(text)))
    return [*rows, (1000, None), (1001, ""), (1002, " \n\t"), (1003, rows[0][1]), (1003, rows[0][1])]


def shingles(text):
    w = words(lower(text))
    return frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


@pytest.mark.parametrize("seed", range(2))
def test_jaccard_join(spark, seed):
    rows = similar_texts(seed)
    sets = {i: shingles(t) for i, t in rows}
    least = {i: i for i in sets}

    def top(x):
        while least[x] != x:
            x = least[x]
        return x

    for i, s in sets.items():
        for j, t in sets.items():
            if j < i and s and t and 100 * len(s & t) >= 80 * len(s | t):
                a, b = top(i), top(j)
                least[max(a, b)] = min(a, b)
    docs = spark.createDataFrame(rows, DOCS).repartition(3).withColumns({"sig": F.lit(1), "component_id": F.lit(2)})
    got = jaccard_join.join(docs).collect()
    assert len(got) == len(rows)
    assert {(r.doc_id, r.n_shingles, r.component_id) for r in got} == {(i, len(s), top(i)) for i, s in sets.items()}


def test_jaccard_join_of_one_id_with_two_texts_and_nulls(spark):
    a, b = " ".join(f"a{i}" for i in range(30)), " ".join(f"b{i}" for i in range(30))
    rows = [(1, a), (1, b), (2, a + " x"), (3, b + " y"), (None, a)]
    got = {(r.doc_id, r.component_id) for r in jaccard_join.join(spark.createDataFrame(rows, DOCS)).collect()}
    assert {(2, 1), (3, 1), (None, None)} <= got


def test_components_of_a_path_and_a_star(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {100 + i: 100 for i in range(30)}


@pytest.mark.parametrize("vocabulary", [3, 300])
def test_substring_dedup(spark, vocabulary):
    rng = random.Random(vocabulary)
    v = [f"w{i}" for i in range(vocabulary)]
    passages = [[rng.choice(v) for _ in range(rng.randint(30, 90))] for _ in range(8)] + [["x"] * 60, ["a", "b"] * 40]
    rows = []
    for i in range(120):
        text = []
        for _ in range(rng.randint(0, 4)):
            p = rng.choice(passages)
            text += p[rng.randint(0, 9) : len(p) - rng.randint(0, 9)] if rng.random() < 0.4 else [rng.choice(v) for _ in range(rng.randint(1, 70))]
        rows.append((i, " ".join(text)))
    rows += [(900, None), (901, ""), (902, " ".join(["y"] * 35)), (903, " ".join(["z"] * 36)), (904, rows[1][1])]
    seen = Counter(tuple(w[k : k + 35]) for _, t in rows for w in [words(t)] for k in range(len(w) - 34))
    want = {}
    for i, t in rows:
        w = words(t)
        gone = {x for k in range(len(w) - 34) if seen[tuple(w[k : k + 35])] > 1 for x in range(k, k + 35)}
        want[i] = (len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone))
    docs = spark.createDataFrame(rows, DOCS).repartition(3).withColumns({"kept": F.lit("mine"), "places": F.lit(0)})
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in substring_dedup.dedup(docs).collect()} == want


@pytest.mark.parametrize("hot", [1_000, 3])
def test_substring_dedup_of_long_repeats(spark, monkeypatch, hot):
    monkeypatch.setattr(substring_dedup, "HOT", hot)
    rng = random.Random(hot)
    v = [f"w{i}" for i in range(500)]
    some = lambda n: [rng.choice(v) for _ in range(n)]
    passages = [some(60), some(90), some(400), some(1500), ["Is", "onhe."] * 300, ["x", "y", "z"] * 40]
    rows = []
    for i in range(60):
        text = some(rng.randint(0, 50))
        for _ in range(rng.randint(0, 2)):
            p = rng.choice(passages)
            a = rng.choice([0, 0, rng.randrange(len(p) - 20)])
            text += p[a : rng.choice([len(p), a + 36, a + 80])] + some(rng.randint(0, 30))
        rows.append((rng.choice([i, None, 7]), " ".join(text)))
    rows += [rows[1], rows[1], (None, None), (7, " "), (8, " ".join(some(40_000) + passages[2] + passages[2][50:]))]
    seen = Counter(tuple(w[k : k + 35]) for _, t in rows for w in [words(t)] for k in range(len(w) - 34))
    want = Counter()
    for i, t in rows:
        w = words(t)
        gone = {x for k in range(len(w) - 34) if seen[tuple(w[k : k + 35])] > 1 for x in range(k, k + 35)}
        want[i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)] += 1
    docs = spark.createDataFrame(rows, DOCS).repartition(3).withColumns({"firsts": F.lit("mine"), "n_words": F.lit(0), "name": F.lit(1)})
    got = substring_dedup.dedup(docs)
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept) for r in got.collect()) == want
    assert {"name"} <= set(got.columns)
    long, covered = substring_dedup.long_repeats(docs.select(F.monotonically_increasing_id().alias("_key"), F.lit(1).alias("_key2"), "text"))
    assert 0 < covered.count() < long.count() and long.where("size >= 100").count() > 2


def test_secret_spans(spark):
    pattern = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
    texts = [None, "", "secret=token : abcdefgh", "😀 Password = 'hunter22x' token:ab", "AKIA" + "Q7" * 8 + " AKIAAKIA", "deadbeef" * 4 + " api_key: x=y/z.w-", "a" * 50_000 + " passwd:abcdef", "token=" * 30]

    def spans(t):
        found = [(m.start(), 0, m.end()) for m in pattern.finditer(t) if len(m[2]) >= 6]
        found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20] + [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
        return ",".join(f"{secret_scan.KINDS[k]}:{a}:{b}" for a, k, b in sorted(found))

    docs = spark.createDataFrame(list(enumerate(texts)), DOCS).withColumn("spans", F.lit("mine"))
    got = {r.doc_id: r for r in secret_scan.scan(docs).collect()}
    assert {i: r.base_text for i, r in got.items()} == {i: spans(t or "") for i, t in enumerate(texts)}
    assert got[3].spans.startswith("assign:2:")
    masked = {r.doc_id: r.text for r in secret_scan.redact(secret_scan.scan(docs)).collect()}
    assert masked[0] is None and masked[3].startswith("😀 [assign]") and masked[2] == texts[2]


def test_random_strings_are_found_and_names_are_not(spark):
    rng = random.Random(5)
    alphabet = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    secrets = [(i, "use " + "".join(rng.choice(alphabet) for _ in range(48)) + " now") for i in range(60)]
    plain = [(100 + i, f"see release_notes_for_version_{i}_of_the_handbook_and_the_handbook_1 aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa1") for i in range(60)]
    got = {r.doc_id: r.n_random for r in secret_scan.scan(spark.createDataFrame(secrets + plain, DOCS)).collect()}
    assert sum(got[i] > 0 for i, _ in secrets) >= 50
    assert sum(got[i] > 0 for i, _ in plain) <= 3


def _battery(token):
    """(stratum, -ln of Fisher's combined p) of one candidate, from the definitions of the tests."""
    bare = token.rstrip("=")
    which = next(i for i, (_, _, pattern) in enumerate(secret_scan.ENCODINGS) if re.search(pattern, bare))
    alphabet = secret_scan.ENCODINGS[which][1]
    x, k, n = [alphabet.index(c) for c in bare], len(alphabet), len(bare)
    upper = lambda z: max(math.erfc(z / math.sqrt(2)) / 2, 1e-18)
    chi = sum((c - n / k) ** 2 / (n / k) for c in (x.count(v) for v in range(k)))
    df = k - 1
    p_chi = upper(((max(chi, 1e-9) / df) ** (1 / 3) - (1 - 2 / (9 * df))) / math.sqrt(2 / (9 * df)))
    high = [v >= k / 2 for v in x]
    ups = sum(high)
    runs = 1 + sum(a != b for a, b in zip(high, high[1:], strict=False))
    expected = 2 * ups * (n - ups) / n + 1
    z_runs = math.sqrt(n) if ups in (0, n) else abs(runs - expected) / math.sqrt(max((expected - 1) * (expected - 2) / (n - 1), 1e-9))
    mean = sum(x) / n
    spread = sum((v - mean) ** 2 for v in x)
    serial = sum((a - mean) * (b - mean) for a, b in zip(x, x[1:], strict=False)) / spread if spread else 1.0
    z_serial = abs(serial + 1 / n) * math.sqrt(n)
    half = -math.log(p_chi) - sum(math.log(min(1.0, 2 * upper(z))) for z in (z_runs, z_serial))
    band = sum(n >= b for b in secret_scan.BANDS[1:])
    return which * len(secret_scan.BANDS) + band, max(half - math.log(1 + half + half * half / 2), 0.0)  # Fisher: chi-squared with 6 degrees


def test_randomness_battery(spark):
    rng = random.Random(9)
    alphabets = [a for _, a, _ in secret_scan.ENCODINGS]
    tokens = ["".join(rng.choice(rng.choice(alphabets)[: rng.choice([4, 16, 64])]) for _ in range(rng.randint(20, 300))) for _ in range(150)]
    tokens += ["".join(rng.choice(a) for _ in range(60)) + "=" for a in alphabets] + ["a1" * 20, "0" * 24 + "a", "ab12" * 3_000]
    rows = spark.createDataFrame(list(enumerate(tokens)), DOCS).select("doc_id", secret_scan._tested(F.col("text")).alias("t")).collect()
    for r in rows:
        stratum, surprise = _battery(tokens[r.doc_id])
        assert r.t.stratum == stratum and r.t.surprise == pytest.approx(surprise, rel=1e-3, abs=1e-4), tokens[r.doc_id][:80]


def test_false_discovery_control(spark):
    rng = random.Random(3)
    rows = [(s, round(rng.choice([rng.random() * 3, 2 + rng.random() * 20]), 3)) for s in (0, 1, 7) for _ in range(400)]
    got = secret_scan.cleared_from(spark.createDataFrame(rows, "stratum int, surprise double"))
    for s in (0, 1, 7):
        ps = sorted(math.exp(-math.floor(v * 10) / 10) for t, v in rows if t == s)
        passing = [p for k, p in enumerate(ps) if p <= 0.05 * (k + 1) / len(ps)]
        assert got[s] == pytest.approx(-math.log(max(passing)), abs=1e-6)


def test_secret_scan_of_long_tokens_and_many_matches(spark):
    rng = random.Random(2)
    blob = base64.b64encode(rng.randbytes(750_000)).decode()
    many = "".join(f"token={k:06d} " for k in range(20_000))
    docs = spark.createDataFrame([(1, f"x {blob} y"), (2, many), (2, many), (None, None)], DOCS).withColumns({"n_hex": F.lit("mine"), "rows": F.lit(1)})
    began = time.perf_counter()
    got = secret_scan.redact(secret_scan.scan(docs)).collect()
    assert time.perf_counter() - began < 60
    assert [r.n_assign for r in got if r.doc_id == 2] == [20_000] * 2
    assert {r.text for r in got if r.doc_id == 2} == {"[assign] " * 20_000}
    assert next(r for r in got if r.doc_id == 1).n_random == 1 and next(r for r in got if r.doc_id is None).spans == ""


def test_mixing(spark):
    rng = random.Random(1)
    rows = [(i, f"s{min(rng.randrange(9), 4)}" if i % 11 else None, " ".join(["w"] * rng.randint(0, 40))) for i in range(900)] + [(901, "s0", None), (902, "s0", "")]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    got = mixing.mix(docs).collect()
    size, taken, target = Counter(), Counter(), {}
    for r in got:
        size[r.source] += r.size
        taken[r.source] += r.taken
        target[r.source] = r.target
        assert r.taken in (0, r.size, 2 * r.size)
    order = sorted((s for s in size if s is not None)) + [None]
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}
    left, open_, want = 1.5 * sum(size.values()), set(order), {}
    while True:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if level * weight[s] > 2 * size[s]}
        if not full:
            break
        want |= {s: 2.0 * size[s] for s in full}
        left -= sum(2 * size[s] for s in full)
        open_ -= full
    want |= {s: level * weight[s] for s in open_}
    for s in order:
        assert target[s] == pytest.approx(want[s])
        assert abs(taken[s] - target[s]) <= 80
    again = mixing.mix(docs.repartition(5)).select("doc_id", "taken").collect()
    assert Counter(map(tuple, again)) == Counter((r.doc_id, r.taken) for r in got)


def test_mixing_of_repeated_rows_and_clashing_columns(spark):
    rows = [(1, "a", "x y z"), (1, "a", "x y z"), (1, "a", "other words here now"), (None, "a", "p q"), (None, "a", "p q"), (2, "b", "w " * 30_000)] + [(k, "ab"[k % 2], "u v w") for k in range(10, 60)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string").withColumns({c: F.lit("mine") for c in ("size", "target", "taken", "copies", "slot", "finish", "bucket0")})
    got = mixing.mix(docs).collect()
    size = lambda t: len(words(t))
    assert Counter((r.doc_id, r.source, r.size) for r in got) == Counter((i, s, size(t)) for i, s, t in rows)
    assert all(r.taken == r.size * r.copies and r.copies in (0, 1, 2) for r in got)
    assert sorted(map(tuple, mixing.mix(docs.repartition(4)).collect()), key=str) == sorted(map(tuple, got), key=str)


def test_mixing_without_words(spark):
    assert {r.taken for r in mixing.mix(spark.createDataFrame([(1, "a", None), (2, None, " ")], "doc_id long, source string, text string")).collect()} == {0}


TEXTS = [None, "", " ", "  a  b ", "\n", "a\n\n  b", "▁x ▁▁y", "trail  ", "tab\tx\r\ny", "<s> </s> <unk> <0x0A>", "日本語 テキスト", "a" * 1000, "\x1c a\x1d", "<|endoftext|> foo<|startoftext|>bar", "it's we'll I'd 'S", "Σοφός ΣΑΣ İstanbul ﬁ", "é ́x", "x y 12abc34", "word###.. (a)b", "long " * 70_000 + "tail", "  " * 140_000 + "q\n" * 2000 + "r " * 140_000]


def test_token_counts(spark):
    import public_tokenizers
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=public_tokenizers.path(token_counts.VOCABULARY))
    long = ["a" * 70_000, "b" + "a" * 50_001, "日本" * 20_000, "\x00" * 17_000, "the" * 30_000 + " end", "▁" * 40_001 + "x", "abc\n" * 20_000]
    rows = list(enumerate([*TEXTS, *long, *TEXTS[:3]]))
    docs = spark.createDataFrame(rows, DOCS).withColumns({"n_tokens": F.lit("mine"), "_chunk": F.lit(1), "look": F.lit(2)})
    got = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts.count(docs).collect()}
    want = {i: (len((t or "").encode()), n := len(model.encode(t or "")), n > 4096) for i, t in rows}
    assert got == want


def test_chunk_maps_compose_to_the_whole(spark):
    def compose(left, right):
        """The map of two neighbouring chunks, None if the right one was made for another state."""
        return (left[0], right[1], left[2] + right[2]) if right[0] in (None, left[1]) else None

    machine, rng = token_counts.transducer(), random.Random(3)
    for n in range(300):
        text = "".join(rng.choice("ab  \n▁étheino日" if n % 2 else "aab") for _ in range(rng.randint(1, 300)))
        cuts = sorted({0, len(text), *(rng.randrange(len(text) + 1) for _ in range(4))})
        parts = list(zip(cuts, cuts[1:], strict=False))
        look = rng.choice([1, 3, 64])
        maps = [machine.chunk_map(text[a:b], text[max(0, a - look) : a]) for a, b in parts]
        for k in range(1, len(maps)):  # chunks that are entered otherwise than expected
            if compose(maps[k - 1], maps[k]) is None:
                maps[k] = machine.chunk_map(text[parts[k][0] : parts[k][1]], text[max(0, parts[k][0] - look) : parts[k][0]], maps[k - 1][1])
        left, right = maps[0], maps[-1]
        for m in maps[1:]:
            left = compose(left, m)
        for m in reversed(maps[:-1]):
            right = compose(m, right)
        assert left == right and left[2] == machine.count([text])[0] == len(machine.model.encode(text))


def test_a_prefix_scan_takes_few_rounds(spark):
    """Texts that repeat, of 62 chunks and of chunks entered otherwise than expected, one of them with an odd part within."""
    from pyspark.sql import DataFrame

    machine, size = token_counts.transducer(), 16_384
    texts = ["a" * 1_000_000, "b" + "ab" * 150_000 + "c" + "a" * 200_001, "the" * 60_000]
    rows = [(i, k, t[k * size : (k + 1) * size], t[max(0, k * size - token_counts.LOOK) : k * size]) for i, t in enumerate(texts) for k in range(-(-len(t) // size))]
    cut: DataFrame = spark.createDataFrame(rows, "_row long, _chunk long, part string, look string")
    rounds = []
    got = {r["_row"]: r["n_tokens"] for r in token_counts._chunk_sums(cut, None, rounds).collect()}
    assert got == {i: len(machine.model.encode(t)) for i, t in enumerate(texts)}
    assert len(rounds) <= 6  # log2 of the chunks of the longest


def test_transducer_tells_states_and_emitted_tokens():
    machine = token_counts.transducer()
    rng = random.Random(8)
    texts = ["".join(rng.choice(["the", "in", "er", "▁", "a", "ñ", "x", "ing", "\n"]) for _ in range(rng.randint(0, 40))) for _ in range(800)]
    assert machine.count(texts).tolist() == [len(machine.model.encode(t)) for t in texts]
    before = len(machine.states)
    assert machine.count(texts).tolist() == [len(machine.model.encode(t)) for t in texts] and len(machine.states) == before
    machine.forget()
    assert machine.count(texts[:5]).tolist() == [len(machine.model.encode(t)) for t in texts[:5]]


def test_packing(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path(packing.VOCABULARY))
    rng = random.Random(2)
    rows = list(enumerate([*TEXTS[:-1], *(" ".join(f"word{rng.randrange(99)}," for _ in range(rng.randint(1, 900))) for _ in range(80))]))
    rows[-1] = (len(rows) - 1, "very " * 60_000 + "long")
    docs = spark.createDataFrame(rows, DOCS).repartition(2).withColumns({"start": F.lit("mine"), "tier": F.lit("mine")})
    pieces = packing.pack(docs).collect()
    assert packing.pack(docs.union(docs)).where("start = 0").count() == 2 * len(rows)
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p.doc_id].append(p)
        by_sequence[p.sequence_id].append(p)
    for i, t in rows:
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        at = 0
        for p in sorted(by_doc[i], key=lambda p: p.start):
            assert (p.start, p.doc_tokens) == (at, len(ids)) and p.ids_crc32 == zlib.crc32(ids[at : at + p.length].tobytes())
            at += p.length
        assert at == len(ids)
    for own in by_sequence.values():
        at = 0
        for p in sorted(own, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= 4096 and at & (at - 1) == 0 and all(p.sequence_length == at for p in own)


def test_warc_round_trip(spark):
    rows = [(5, "http://a/\r\nX: y", "<p>é</p>"), (3, None, "<p>é</p>"), (9, "u", None), (8, "u", ""), (None, "n", "<p>é</p>"), (11, "big", "z" * 300_000), (3, None, "<p>é</p>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit("mine"))
    got = warc.read(written(warc.write(pages.repartition(2)), "archives")).collect()
    assert len(got) == len(rows)
    sha = lambda t: base64.b32encode(hashlib.sha1((t or "").encode()).digest()).decode()
    want = Counter()
    for i, _, html in rows:
        first = min(p for p, _, h in rows if (h or "") == (html or "") and p is not None)
        revisit = i != first
        want[i, len((html or "").encode()), sha(html), "revisit" if revisit else "response", first if revisit else None] += 1
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got) == want


def test_broken_archives_are_refused():
    good = warc.record(1, "u", b"payload", warc.sha1(b"payload"), None)
    squeeze = zlib.compressobj(6, zlib.DEFLATED, 31)
    member = squeeze.compress(good) + squeeze.flush()
    headers, block = warc.parsed(next(warc.members(member * 2)))
    assert warc.checked(headers, block) == (7, warc.sha1(b"payload"), b"payload")
    with pytest.raises(EOFError):
        list(next(warc.members(member[:-9])))
    with pytest.raises(ValueError, match="digest"):
        warc.checked(headers, block[:-1] + b"X")


def test_archives_of_others_are_read(spark):
    def squeezed(kind, block, *more):
        head = "\r\n".join(["WARC/1.0", f"WARC-Type: {kind}", "WARC-Date: 2020-01-01T00:00:00Z", *more, f"Content-Length: {len(block)}"])
        squeeze = zlib.compressobj(9, zlib.DEFLATED, 31)
        return squeeze.compress(head.encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + squeeze.flush()

    http = "Content-Type: application/http; msgtype=response"
    chunked = b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\nContent-Length: 99\r\n\r\n2\r\nok\r\n0\r\n\r\n"
    records = [
        squeezed("warcinfo", b"software: x\r\n", "Content-Type: application/warc-fields"), squeezed("request", b"GET / HTTP/1.1\r\nHost: a\r\n\r\n", "Content-Type: application/http; msgtype=request", "WARC-Target-URI: http://a/"),
        squeezed("response", chunked, http), squeezed("response", b"HTTP/1.1 200 OK\r\n\r\nbody", http, "WARC-Block-Digest: md5:abc", f"WARC-Payload-Digest: sha1:{warc.sha1(b'body').lower()}"),
        squeezed("revisit", b"HTTP/1.1 304\r\n\r\n", http, "WARC-Payload-Digest: sha1:X"), squeezed("metadata", b"\x00\xff", f"WARC-Block-Digest: sha1:{warc.sha1(bytes([0, 255]))}"),
    ]
    archives = spark.createDataFrame([("a", bytearray(b"".join(records))), ("a", bytearray(b"".join(records)))], "archive string, content binary").withColumn("page_id", F.lit("mine"))
    got = warc.read(archives).collect()
    assert Counter(r.record_type for r in got) == {"warcinfo": 2, "request": 2, "response": 4, "revisit": 2, "metadata": 2}
    assert {(r.record_type, r.payload_bytes) for r in got} == {("warcinfo", 13), ("request", 0), ("response", 12), ("response", 4), ("revisit", 0), ("metadata", 2)}
    assert {r.url for r in got} == {None, "http://a/"} and {r.page_id for r in got} == {None}


def test_topk_search(spark):
    rng = random.Random(4)
    vocabulary = [f"w{int(rng.paretovariate(0.6)) % 300}" for _ in range(3000)]
    rows = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 60)))) for i in range(400)] + [(500, None), (501, ""), (502, "w1 w1 w1"), (503, "w1 w1 w1")]
    queries = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 12)))) for i in range(15)] + [(90, None), (91, "nowhere"), (92, "W1")]
    got = defaultdict(list)
    index = topk_search.build(spark.createDataFrame(rows, DOCS).repartition(3))
    for r in topk_search.search(written(index, "index"), spark.createDataFrame(queries, "query_id long, text string"), 7).collect():
        got[r.query_id].append((r.rank, r.doc_id, r.score))
    bags = {i: Counter(words(lower(t))) for i, t in rows}
    n, mean = len(bags), sum(sum(c.values()) for c in bags.values()) / len(bags)
    df = Counter(w for c in bags.values() for w in c)
    for q, text in queries:
        scores = []
        for i, c in bags.items():
            s = sum(math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * c[w] * 2.2 / (c[w] + 1.2 * (0.25 + 0.75 * sum(c.values()) / mean)) for w in set(words(lower(text))) if w in c)
            if s:
                scores.append((-round(s, 6), i))
        want = [(k + 1, i, pytest.approx(-s, abs=2e-6)) for k, (s, i) in enumerate(sorted(scores)[:7])]
        assert sorted(got[q]) == want


def test_topk_search_of_odd_rows(spark):
    rows = [(7, "a b c"), (7, "a b c"), (7, "a x"), (8, "a " * 50_000), (None, "a b"), (9, None)]
    docs = spark.createDataFrame(rows, DOCS).withColumns({"term": F.lit("mine"), "shard": F.lit(1), "counts": F.lit(2)})
    queries = spark.createDataFrame([(1, "A b"), (1, "c"), (2, "x")], DOCS).withColumnRenamed("doc_id", "query_id").withColumn("rank", F.lit(0))
    got = defaultdict(list)
    for r in topk_search.search(written(topk_search.build(docs), "odd"), queries, 10).collect():
        got[r.query_id].append((r.rank, r.doc_id))
    assert sorted(got[1])[:2] == [(1, 7), (2, 7)] and sorted(i for _, i in got[1]) == [7, 7, 7, 8] and got[2] == [(1, 7)]


def test_topk_search_asks_whole_documents(spark, tmp_path):
    rng = random.Random(5)
    vocabulary = [f"w{int(rng.paretovariate(0.5)) % 4000}" for _ in range(6000)]
    rows = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.choice([3, 40, 400])))) for i in range(300)]
    rows += [(300 + i, rows[i][1]) for i in range(0, 60, 20)] + [(400, None), (None, rows[0][1])]
    spark.createDataFrame(rows, DOCS).repartition(2).write.parquet(f"{tmp_path}/documents.parquet")
    got = defaultdict(list)
    for r in catalog.op1_topk_documents(spark, str(tmp_path)).collect():
        got[r.query_id].append((r.rank, r.doc_id, r.score))
    bags = {i: Counter(words(lower(t))) for i, t in rows if i is not None}
    n, mean = len(bags), sum(sum(c.values()) for c in bags.values()) / len(bags)
    df = Counter(w for c in bags.values() for w in c)
    assert set(got) == {i for i in bags if i % 20 == 0 and bags[i]}
    assert any(len(bags[i]) > topk_search.LONG_QUERY for i in got) and any(len(bags[i]) < topk_search.LONG_QUERY for i in got)
    for q, found in got.items():
        scores = []
        for i, c in bags.items():
            s = math.fsum(math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * c[w] * 2.2 / (c[w] + 1.2 * (0.25 + 0.75 * sum(c.values()) / mean)) for w in bags[q] if w in c)
            if s:
                scores.append((-round(s, 6), i))
        assert sorted(found) == [(k + 1, i, pytest.approx(-s, abs=2e-6)) for k, (s, i) in enumerate(sorted(scores)[:20])]


def _nearest_by_force(rows, q, k):
    """(vec_id, distance) of the k nearest ids by one distance at a time; rows (vec_id, vector) of usable vectors."""
    own = min(tuple(v) for i, v in rows if i == q)
    gaps = {}
    for i, v in rows:
        if i != q and len(v) == len(own):
            gaps[i] = min(gaps.get(i, math.inf), math.sqrt(sum((a - b) ** 2 for a, b in zip(own, v, strict=True))))
    return sorted(gaps.items(), key=lambda x: (x[1], x[0]))[:k]


def test_nearest_with_odd_rows(spark):
    rng = np.random.default_rng(0)
    centres = rng.normal(size=(20, 8))
    rows = [(i, (centres[i % 20] + 0.3 * rng.normal(size=8)).tolist()) for i in range(300)]
    rows += [(2000 + i, rows[0][1]) for i in range(40)] + [(50, rows[7][1]), (50, rows[7][1]), (61, rows[50][1]), *((4000 + 50 * i, [float(i), 1.0, 2.0]) for i in range(4))]
    odd = [(3000, None), (3001, [0.0] * 8), (3002, [None, *[1.0] * 7]), (3003, [float("nan")] * 8), (None, rows[0][1])]
    df = spark.createDataFrame([*rows, *odd], "vec_id long, embedding array<double>").repartition(3).withColumns({"rank": F.lit("mine"), "query_id": F.lit(1), "v": F.lit(2)})
    got = defaultdict(list)
    for r in nearest.search(df, df.where("vec_id % 50 = 0 OR vec_id > 2999"), 10).collect():
        got[r.query_id].append((r.rank, r.vec_id, r.score))
    asked = {i for i, _ in rows if i % 50 == 0 or i > 2999}
    assert set(got) == asked
    hits = total = 0
    for q in asked:
        every, want = dict(_nearest_by_force(rows, q, len(rows))), _nearest_by_force(rows, q, 10)
        assert [(r, s) for r, _, s in sorted(got[q])] == [(k + 1, pytest.approx(s)) for k, s in enumerate(sorted(every[v] for _, v, _ in got[q]))]
        assert len(got[q]) == len({v for _, v, _ in got[q]}) == len(want)
        hits, total = hits + sum(s <= want[-1][1] + 1e-12 for _, _, s in got[q]), total + len(want)
    assert hits >= 0.9 * total
    assert sorted(got[4000]) == [(k + 1, i, pytest.approx(s)) for k, (i, s) in enumerate(_nearest_by_force(rows, 4000, 10))]  # of four vectors of a length, all are found


@pytest.mark.parametrize("clusters", [0, 150])
def test_nearest_finds_by_hashing(spark, clusters):
    rng = np.random.default_rng(clusters)
    x = rng.normal(size=(12_000, 24))
    if clusters:
        x = 4 * rng.normal(size=(clusters, 24))[rng.integers(0, clusters, 12_000)] + x
    x[5000:5400] = x[5000]  # a vector with many copies
    df = spark.createDataFrame(pd.DataFrame({"vec_id": np.arange(12_000), "embedding": x.tolist()}), "vec_id long, embedding array<double>").repartition(4)
    asked = df.where("vec_id % 100 = 0")
    rows, wanted = nearest.usable(df), nearest.usable(asked)
    (hasher, recall, share) = nearest.hashers_of(rows, wanted, 10)[24]
    assert recall >= 0.9 and share < (0.2 if clusters else 0.6)
    shard = nearest._Shard(np.arange(12_000), x, hasher)
    assert shard.candidates(x[::100]).mean() < share + 0.05
    hits = 0
    found = defaultdict(list)
    for r in nearest.search(df, asked, 10).collect():
        found[r.query_id].append((r.rank, r.vec_id, r.score))
    assert set(found) == set(range(0, 12_000, 100))
    for q, mine in found.items():
        gap = np.sqrt(((x - x[q]) ** 2).sum(1))
        want = [int(i) for i in np.lexsort((np.arange(12_000), gap)) if i != q][:10]
        assert sorted(r for r, _, _ in mine) == list(range(1, 11)) and all(s == gap[v] for _, v, s in mine)
        hits += len(set(want) & {v for _, v, _ in mine})
    assert hits / (10 * len(found)) >= 0.9


def test_nearest_sets_of_steps_are_in_order():
    sets = nearest.step_sets(5, 60)
    assert (sets[0] == -1).all() and len({tuple(r) for r in sets.tolist()}) == len(sets)
    m = 5
    expect = [j * (j + 1) / (4 * (m + 1) * (m + 2)) if j <= m else 1 - (2 * m + 1 - j) / (m + 1) + (2 * m + 1 - j) * (2 * m + 2 - j) / (4 * (m + 1) * (m + 2)) for j in range(1, 2 * m + 1)]
    every = sorted(sum(expect[c] for c in range(2 * m) if mask >> c & 1) for mask in range(1 << 2 * m) if not any(mask >> c & 1 and mask >> (2 * m - 1 - c) & 1 for c in range(m)))
    assert [sum(expect[c] for c in row if c >= 0) for row in sets.tolist()] == pytest.approx(every[:60])


def test_toxicity_restores_and_learns(spark):
    rng = random.Random(6)
    syllables = ["ta", "ren", "mo", "lis", "ver", "dan", "shi", "pol"]
    plain = lambda: " ".join("".join(rng.choice(syllables) for _ in range(rng.randint(1, 4))) for _ in range(60))
    disguises = ["blorgon", "bl0rg0n", "bloooorgon", "b.l.o.r.g.o.n", "b l o r g o n", "BLORGON!!", "bl-or-gon"]
    rows, labels = [], []
    for i in range(700):
        toxic = i % 5 == 0
        rows.append((i, plain() + (f" {rng.choice(disguises) if i % 2 else 'blorgon'} " if toxic else " ") + plain()))
        labels.append((i, int(toxic)))
    docs = spark.createDataFrame([*rows, (9000, None), (9001, "")], DOCS).withColumn("score", F.lit("mine"))
    model = toxicity.fit(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    got = {r.doc_id: (r.score, r.predicted, r.held_out) for r in toxicity.score(docs, model).withColumn("held_out", toxicity.held_out()).collect()}
    held = [i for i, (_, _, h) in got.items() if h and i < 9000]
    assert all(got[i][2] == (zlib.crc32(str(i).encode()) % 5 == 0) for i in got)
    assert sum(got[i][1] == int(i % 5 == 0) for i in held) / len(held) >= 0.97
    assert got[9000][1] == got[9001][1] == 0
    chars = model.chars.tolist()
    assert [toxicity.readings(w, chars)[-1] for w in ("bl0rg0n", "bloooorgon", "b.l.o.r.g.o.n", "bl-or-gon")] == ["blorgon"] * 4
    assert toxicity.fit(docs, spark.createDataFrame([], "doc_id long, toxic int")).weights == {}


def test_toxicity_decodes_as_exhaustive_enumeration(spark):
    rng = random.Random(12)
    texts = ["".join(rng.choice("ilabegostz ") for _ in range(200)) for _ in range(30)]
    chars = toxicity.char_model(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], DOCS)).tolist()

    def worth(path):
        x = y = 0
        total = sum(cost for _, cost in path)
        for ch in "".join(letters for letters, _ in path):
            c = toxicity.char_class(ch)
            total, x, y = total + chars[(x << 12) | (y << 6) | c], y, c
        return total + chars[(x << 12) | (y << 6)]

    for n in range(150):
        token = "".join(rng.choice("16!|0@3$.-aabbgil") for _ in range(rng.randint(1, 5 if n % 3 == 0 else 8)))
        breaks = n % 3 == 0
        costs = defaultdict(lambda: math.inf)
        for path in itertools.product(*toxicity._lattice(token, breaks)):
            text = "".join(letters for letters, _ in path)
            costs[text] = min(costs[text], worth(path))
        assert costs[toxicity.decode(token, chars, breaks)] == pytest.approx(min(costs.values()), abs=1e-4), token


def test_toxicity_of_odd_rows(spark):
    rows = [(1, "good words here"), (1, "good words here"), (1, "other"), (None, "bad blorg"), (2, None), (3, "bl0rg " * 30_000), (4, "b l o r g " * 20_000), (5, "x" * 200_000 + "0a0b")]
    docs = spark.createDataFrame([*rows, *((10 + i, f"say blorg {i} now") for i in range(30)), *((50 + i, f"say hello {i} now") for i in range(60))], DOCS).withColumns({"score": F.lit("a"), "predicted": F.lit("b"), "strongest": F.lit("c"), "near": F.lit(1)})
    labels = spark.createDataFrame([*((10 + i, 1) for i in range(30)), *((50 + i, 0) for i in range(60)), (10, 1), (None, 1), (1, None)], "doc_id long, toxic int")
    got = toxicity.score(docs, toxicity.fit(docs, labels)).collect()
    assert len(got) == 98 and {r.score for r in got if r.text == "good words here"} == {next(r.score for r in got if r.doc_id == 2)}
    assert [r.predicted for r in got if r.doc_id in (3, 4)] == [1, 1] and next(r.predicted for r in got if r.doc_id is None) == 1
    line = " ".join(f"licence{i}" for i in range(20))
    own = lambda k: " ".join(f"own{k}x{i}" for i in range(60))
    assert len({toxicity._near(f"{line} {own(k)}") for k in range(30)}) == 30 and toxicity._near(own(1)) == toxicity._near(own(1).upper())


def test_toxicity_reads_long_runs_and_tokens_whole(spark):
    rng = random.Random(6)
    syllables = ["ta", "ren", "mo", "lis", "ver", "dan", "shi", "pol"]
    plain = lambda: " ".join("".join(rng.choice(syllables) for _ in range(rng.randint(1, 4))) for _ in range(60))
    rows = [(i, f"{plain()} {'blorgon' if i % 5 == 0 else ''} {plain()}") for i in range(500)]
    model = toxicity.fit(spark.createDataFrame(rows, DOCS), spark.createDataFrame([(i, int(i % 5 == 0)) for i, _ in rows], "doc_id long, toxic int"))
    clean = [" ".join(rng.choice(syllables) + rng.choice(syllables) for _ in range(30)) for _ in range(20)]
    inner = lambda texts, sign: [(i, f"ta {sign.join(c for w in [*t.split()[:20], *mid, *t.split()[20:]] for c in w)} ren") for i, (t, mid) in enumerate(texts)]
    for sign in (" ", "."):  # inside of runs of over 64 characters, and of long tokens
        for mid, least in ((["blorgon"], 18), ([], 0)):
            rows = toxicity.score(spark.createDataFrame(inner([(t, mid) for t in clean], sign), DOCS), model).collect()
            assert least <= sum(r.predicted for r in rows) <= (20 if mid else 1), (sign, mid)
    assert toxicity.suspicious("a$s") and not toxicity.suspicious("ass")


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, source string")
    assert jaccard_join.join(docs).count() == substring_dedup.dedup(docs).count() == token_counts.count(docs).count() == packing.pack(docs).count() == 0
    assert secret_scan.scan(docs).count() == mixing.mix(docs).count() == toxicity.score(docs, toxicity.fit(docs, spark.createDataFrame([], "doc_id long, toxic int"))).count() == 0
    assert topk_search.search(topk_search.build(docs), spark.createDataFrame([(1, "a")], "query_id long, text string")).count() == 0
    assert warc.read(warc.write(spark.createDataFrame([], "page_id long, url string, html string"))).count() == 0
    none = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert nearest.search(none, none).count() == 0


def test_topk_search_in_a_shard(monkeypatch):
    """WAND over all of a query's blocks at once gives what the sums of all documents give, and reads only stretches that can reach the k-th best score."""
    rng = np.random.default_rng(6)
    n, k, mean = 20_000, 10, 100.0
    held = [np.flatnonzero(rng.random(n) < share) for share in (0.9, 0.5, 0.2, 0.05, 0.01, 0.0005)]
    counts = [np.where(d // 500 == 17 + t % 2, 30, 1) + rng.integers(0, 2, len(d)) for t, d in enumerate(held)]
    sizes, lengths = np.array([len(d) for d in held]), rng.integers(90, 110, n)
    blocks = [(t, a) for t, d in enumerate(held) for a in range(0, len(d), topk_search.BLOCK)]
    most = np.array([counts[t][a : a + topk_search.BLOCK].max() for t, a in blocks])
    least = np.array([lengths[held[t][a : a + topk_search.BLOCK]].min() for t, a in blocks])
    idf = np.log(1 + (n - sizes + 0.5) / (sizes + 0.5))
    norm = 1.2 * (0.25 + 0.75 * lengths / mean)
    shard = topk_search._Shard(np.concatenate(held), np.concatenate(counts), sizes, most, least, idf, norm, mean)
    queries = [np.array(q) for q in ([0, 1, 2, 3, 4, 5], [0], [2, 3], [5], [1, 4])]
    read, scored = [], shard._scored
    monkeypatch.setattr(shard, "_scored", lambda b, e, live: read.append(np.diff(e)[live].sum()) or scored(b, e, live))
    shard.wand(queries[1], k)
    assert sum(read) < 0.05 * n
    by_wand = [shard.wand(q, k) for q in queries]
    by_sums = {q: (docs[some == q], scores[some == q]) for some, docs, scores in shard.best(queries, k) for q in np.unique(some)}
    for q, terms in enumerate(queries):
        total = np.zeros(n)
        for t in terms:
            total[held[t]] += idf[t] * counts[t] * 2.2 / (counts[t] + norm[held[t]])
        want = sorted((-round(s, 6), d) for d, s in enumerate(total.tolist()) if s)[:k]
        for docs, scores in (by_wand[q], by_sums[q]):
            assert list(zip((-scores).tolist(), docs.tolist(), strict=True)) == want


def test_topk_search_makes_one_list_a_task(spark, monkeypatch):
    """However many shards the index has, a query has at most k documents from each task, and the best of all are found."""
    rng, k = random.Random(8), 3
    rows = [(i, " ".join(f"w{int(rng.paretovariate(0.7)) % 400}" for _ in range(rng.choice([5, 30, 200])))) for i in range(800)]
    rows += [(800 + i, rows[i][1]) for i in range(0, 200, 20)]
    index = written(topk_search.build(spark.createDataFrame(rows, DOCS).repartition(40)), "index", **topk_search.OPTIONS)
    assert index.count() == 40
    made, kept = {}, topk_search.written
    monkeypatch.setattr(topk_search, "written", lambda df, name, **options: made.setdefault(name, kept(df, name, **options)))
    batch = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    asked = spark.createDataFrame(rows[::20], DOCS).withColumnRenamed("doc_id", "query_id")
    got = defaultdict(list)
    for r in topk_search.search(index, asked, k).collect():
        got[r.query_id].append((r.rank, r.doc_id, r.score))
    assert made["search-found"].count() <= len(rows[::20]) * k * spark.sparkContext.defaultParallelism
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == batch
    bags = {i: Counter(words(t)) for i, t in rows}
    n, mean = len(bags), sum(sum(c.values()) for c in bags.values()) / len(bags)
    df = Counter(w for c in bags.values() for w in c)
    for q, _ in rows[::20]:
        scores = [(-round(sum(math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * c[w] * 2.2 / (c[w] + 1.2 * (0.25 + 0.75 * sum(c.values()) / mean)) for w in bags[q] if w in c), 6), i) for i, c in bags.items()]
        assert sorted(got[q]) == [(r + 1, i, pytest.approx(-s, abs=2e-6)) for r, (s, i) in enumerate(sorted(scores)[:k])]


def test_topk_search_of_long_queries_with_a_score_to_be_reached():
    """Rough 32-bit sums leave out no document that reaches the score, and equal scores go to the smaller place."""
    rng = np.random.default_rng(9)
    n, k, m = 3000, 20, 200
    held = [np.flatnonzero(rng.random(n) < share) for share in rng.choice([0.4, 0.1, 0.01, 0.002], m)]
    held = [np.unique(np.append(d, [7, 1907, 2907])) for d in held]
    sizes = np.array([len(d) for d in held])
    counts, lengths = np.ones(sizes.sum(), np.int32), np.full(n, 100)
    blocks = -(-sizes // topk_search.BLOCK)
    idf = np.log(1 + (n - sizes + 0.5) / (sizes + 0.5))
    shard = topk_search._Shard(np.concatenate(held).astype(np.int32), counts, sizes, np.ones(blocks.sum(), np.int32), np.full(blocks.sum(), 100), idf, 1.2 * (0.25 + 0.75 * lengths / 100.0), 100.0)
    queries = [np.sort(rng.choice(m, 80, replace=False)).astype(np.int32) for _ in range(30)]
    want = {}
    for q, terms in enumerate(queries):
        total = np.zeros(n)
        for t in terms:
            total[held[t]] += idf[t] * 2.2 / (1 + 1.2)
        want[q] = sorted((-round(s, 6), d) for d, s in enumerate(total.tolist()) if s)[:k]
        assert {7, 1907, 2907} <= {d for _, d in want[q]}
    for reach in (1, 5, k):
        limits = np.array([-want[q][reach - 1][0] for q in range(len(queries))])
        found = [(int(q), -s, int(d)) for some, docs, scores in shard.best(queries, k, limits) for q, d, s in zip(some, docs, scores, strict=True)]
        for q in range(len(queries)):
            must = [x for x in want[q] if -x[0] >= limits[q]]
            mine = [(s, d) for p, s, d in found if p == q]
            assert mine[: len(must)] == must
            docs, scores = shard.wand(queries[q], k, limits[q])
            assert list(zip((-scores).tolist(), docs.tolist(), strict=True))[: len(must)] == must
