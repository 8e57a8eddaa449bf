"""Clustering, quality rules and spelling variants against brute-force versions."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from tracehold.llm import catalog, centroids, quality_rules, spelling
from tracehold.llm.storage import table, written

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string"
VECTORS = "vec_id long, embedding array<float>"


def _clustered_by_force(rows, k=40, rounds=5):
    kept = [(i, [int(np.floor(256 * float(c))) for c in v]) for i, v in rows if v is not None and len(v) == 64 and all(c is not None and np.isfinite(c) for c in v)]
    key = lambda i: hashlib.sha256(f"2:{'' if i is None else i}".encode()).hexdigest()
    found = [v for _, v in sorted((key(i), v) for i, v in kept)][:k]
    gap = lambda v, c: sum((a - b) ** 2 for a, b in zip(v, c, strict=True))
    assign = lambda: [min((gap(v, c), n) for n, c in enumerate(found)) for _, v in kept]
    for _ in range(rounds):
        near = assign()
        for n in range(len(found)):
            own = [v for (_, v), (_, m) in zip(kept, near, strict=True) if m == n]
            if own:
                found[n] = [sum(c) // len(own) for c in zip(*own, strict=True)]
    near, inertia = assign(), Counter()
    for d, n in near:
        inertia[n] += d
    total = sum(inertia.values())
    return sorted(((i, n, d, inertia[n], total, hashlib.sha256(",".join(map(str, found[n])).encode()).hexdigest()) for (i, _), (d, n) in zip(kept, near, strict=True)), key=str)


@pytest.mark.parametrize("seed", range(3))
def test_clusters_equal_brute_force(spark, seed):
    rng = np.random.default_rng(seed)
    centers = rng.normal(size=(12, 64)) * (3 if seed else 0.01) + (50 if seed == 2 else 0)
    rows = [(i, (centers[i % 12] + rng.normal(size=64) * 0.2).astype(np.float32).tolist()) for i in range(260)]
    rows += [(7, rows[8][1]), (8, rows[8][1]), (None, rows[3][1]), (900, None), (901, rows[0][1][:63]), (902, [None, *rows[0][1][1:]]), (903, [float("nan"), *rows[0][1][1:]]), (904, [float("inf"), *rows[0][1][1:]]), (905, [0.0] * 64), (906, [0.0] * 64)]
    got = centroids.cluster(spark.createDataFrame(rows, VECTORS).selectExpr("*", "1 AS cluster", "2 AS distance", "3 AS v"))
    assert sorted(map(tuple, got.collect()), key=str) == _clustered_by_force(rows)


def test_clusters_of_few_equal_and_huge_vectors(spark):
    same = [(i, [1.0] * 64) for i in range(9)]
    assert sorted(map(tuple, centroids.cluster(spark.createDataFrame(same, VECTORS)).collect()), key=str) == _clustered_by_force(same)
    far = centroids.cluster(spark.createDataFrame([(1, [3e38] * 64), (2, [-3e38] * 64)], VECTORS), k=1, rounds=1).collect()
    assert [r["distance"] for r in far] == [64 * centroids.LARGEST**2] * 2
    assert centroids.cluster(spark.createDataFrame([(1, None)], VECTORS)).count() == 0


def test_bounds_enclose_every_distance_and_spare_comparisons(spark):
    rng = np.random.default_rng(5)
    x = np.vstack([rng.integers(-400, 400, 64) + rng.integers(-20, 20, (50, 64)) for _ in range(20)])
    simplex = centroids.Simplex(x[::13])
    apexes = simplex.apexes(simplex.distances(x))
    true = ((x[:, None] - x[None]) ** 2).sum(-1)
    lower = ((apexes[:, None] - apexes[None]) ** 2).sum(-1)
    upper = lower + 4 * apexes[:, None, -1] * apexes[None, :, -1]
    assert (lower <= true + 1e-6 * true.max()).all() and (true <= upper + 1e-6 * true.max()).all()
    rows = written(centroids.projected(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, v array<int>"), simplex), "test-apexes")
    _, shares = centroids.fit(rows, simplex, x[::50][:20])
    assert len(shares) == 5 and max(shares) < 0.2


def _counts_by_force(text):
    text = text or ""
    w = WORD.findall(text)
    grams = Counter(zip(w, w[1:], w[2:], strict=False))
    covered = {k + j for k in range(len(w) - 2) if grams[w[k], w[k + 1], w[k + 2]] > 1 for j in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return {"n_words": len(w), "word_chars": sum(map(len, w)), "n_symbols": len(re.findall(r"[#*$%&|<>]", text)), "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(covered), "n_lines": len(lines), "n_distinct_words": len(set(w)), "n_digits": sum(c in "0123456789" for c in text), "n_one_char_words": sum(len(x) == 1 for x in w), "longest_word": max(map(len, w), default=0)}


def test_counts_equal_brute_force(spark):
    rng = random.Random(3)
    pieces = ["a", "bé", "a", "\n", " ", "\n\n", "#x", "|", "é|$", "\t", "\r", "12", "end.\n", "ÄB", "日本"]
    texts = [None, "", " \n\t", "\n", "a\nb\na\n a\na", "x" * 300_000, "one two three " * 30_000, *("".join(rng.choice(pieces) for _ in range(rng.randint(0, 60))) for _ in range(300))]
    got = {r["doc_id"]: r.asDict() for r in quality_rules.statistics(spark.createDataFrame(list(enumerate(texts)), DOCS)).collect()}
    for i, t in enumerate(texts):
        want = _counts_by_force(t)
        assert {k: got[i][k] for k in want} == want, (i, t)


def test_list_learns_conjunctions_and_keeps_the_rest():
    rng = np.random.default_rng(1)
    x = {f: rng.uniform(0, 1, 3_000) for f in quality_rules.FEATURES}
    bad = ((x["symbol_share"] > 0.7) & (x["mean_word_chars"] <= 0.4)) | (x["digit_share"] > 0.9)
    rules = quality_rules.learn(x, bad, np.arange(3_000) % 3 == 0)
    found = np.zeros(3_000, bool)
    for r in rules.rules:
        found |= quality_rules._covered(r, x, 3_000)
    assert (found == bad).mean() > 0.99 and 2 <= len(rules.rules) <= 6
    assert "symbol_share > 0.7" in str(rules) and str(rules).endswith("ELSE keep")
    assert quality_rules.learn(x, np.zeros(3_000, bool), np.arange(3_000) % 3 == 0).rules == []
    noise = rng.uniform(size=3_000) < 0.1
    assert not quality_rules.learn(x, noise, np.arange(3_000) % 3 == 0).rules


def test_verdict_is_one_expression_in_order(spark):
    rules = quality_rules.DecisionList([(quality_rules.Condition("a", True, 1.0), quality_rules.Condition("b", False, 0.0)), (quality_rules.Condition("b", True, 5.0),)])
    rows = spark.createDataFrame([(2.0, 0.0), (2.0, 1.0), (0.0, 6.0)], "a double, b double")
    assert [r[0] for r in rows.select(rules.verdict()).collect()] == [False, True, False]


def test_quality_rules_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    labels = {r["doc_id"]: r["quality"] for r in table(spark, sf, "labels").collect()}
    docs = {r["doc_id"]: r["text"] for r in table(spark, sf, "documents").collect()}
    rows = [r for r in catalog.op12_quality_rules(spark, sf).collect()]
    assert len(rows) == len(docs)
    for r in rows:
        want = _counts_by_force(docs[r["doc_id"]])
        assert all(r[k] == want[k] for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"))
        assert r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"]) and not (r["base_failed"] and r["kept"])
    judged = [(labels[r["doc_id"]], r["kept"]) for r in rows if r["doc_id"] in labels and not r["base_failed"] and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0]
    assert sum(k for q, k in judged if q == 1) >= 0.97 * sum(q == 1 for q, _ in judged)
    assert sum(not k for q, k in judged if q == 0) >= 0.6 * sum(q == 0 for q, _ in judged)


def test_quality_rules_of_odd_rows(spark):
    docs = spark.createDataFrame([(None, "a b"), (1, None), (1, ""), (2, "w " * 60), (2, "w " * 60)], DOCS).selectExpr("*", "1 AS n_words", "2 AS kept")
    labels = spark.createDataFrame([(1, 0), (1, 1), (None, 0), (2, 7), (3, None)], "doc_id long, quality int")
    rules = quality_rules.fit(docs, labels)
    assert rules.rules == []
    assert sorted((str(r["doc_id"]), r["n_words"], r["kept"]) for r in quality_rules.judge(docs, rules).collect()) == [("1", 0, False), ("1", 0, False), ("2", 60, False), ("2", 60, False), ("None", 2, False)]
    assert quality_rules.judge(docs.where("FALSE"), rules).count() == 0


def _near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def _grouped_by_force(rows):
    n = Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if h % 97 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            n[w] += 1
    n = {w: k for w, k in n.items() if len(w) >= 5 and k >= 3}
    forms, near = {}, {w: [v for v in n if _near(w, v)] for w in n}
    for w in n:
        best = min(near[w], key=lambda v: (-n[v], v), default=None)
        forms[w] = best if best is not None and n[best] >= 2 * n[w] else None

    def root(w):
        return w if forms[w] is None else root(forms[w])

    return sorted((w, forms[w] or "", root(w), n[w], len(near[w]), n.get(forms[w])) for w in n)


@pytest.mark.parametrize(("alphabet", "shard"), [("abÉ", 400_000), ("abcdeféÿÀ", 400_000), ("ab", 60)])
def test_spelling_groups(spark, alphabet, shard):
    """With small shards, halves that many words share are cut into parts and asked in blocks."""
    rng = random.Random(len(alphabet))
    vocabulary = ["".join(rng.choice(alphabet) for _ in range(rng.randint(4, 8))) for _ in range(150)] + ["a" * k for k in range(4, 30)] + ["Wordlike", "wordlikes", "wordlike"]
    weights = [rng.paretovariate(0.7) for _ in vocabulary]
    rows = [(i, " ".join(rng.choices(vocabulary, weights, k=rng.randint(0, 200)))) for i in range(120)]
    rows += [(None, "wordlike, wordlike-wordlike×x"), (500, None), (501, ""), (502, rows[0][1]), (502, rows[0][1])]
    got = spelling.group(spark.createDataFrame(rows, DOCS).selectExpr("*", "'x' AS word", "1 AS n"), shard)
    assert sorted((r["word"], r["form"] or "", r["root"], r["n"], r["n_near"], r["form_n"]) for r in got.collect()) == _grouped_by_force(rows)


def test_spelling_of_very_long_words_and_empty_tables(spark):
    long = "abcdefghij" * 2_000
    rows = [(i, t) for i, t in enumerate([long, long, long + " " + long[:9_000] + "x" + long[9_001:], long[1:], long[1:], long[1:], long[:-1] + "z"])]
    got = spelling.group(spark.createDataFrame(rows, DOCS))
    assert sorted((r["word"], r["form"] or "", r["root"], r["n"], r["n_near"], r["form_n"]) for r in got.collect()) == _grouped_by_force(rows)
    assert spelling.group(spark.createDataFrame([], DOCS)).count() == 0
    assert spelling.group(spark.createDataFrame([(1, "a b c")], DOCS)).count() == 0


def test_forms_lead_to_roots(spark):
    forms = [(f"w{i}", f"w{i + 1}") for i in range(21)]
    assert sorted(map(tuple, spelling.roots(spark.createDataFrame(forms, "word string, form string")).collect())) == sorted((f"w{i}", "w21") for i in range(21))


def test_spelling_query_on_whole_table(spark):
    sf = "/root/testdata/sf0.001"
    docs = [tuple(r) for r in table(spark, sf, "documents").select("doc_id", "text").collect()]
    got = catalog.op13_spelling_variants(spark, sf).collect()
    assert sorted((r["word"], r["form"] or "", r["root"], r["n"], r["n_near"], r["form_n"]) for r in got) == _grouped_by_force(docs)
