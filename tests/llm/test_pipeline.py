"""The pipeline's stages on the smallest tables, each against a plain version of its decision."""

from __future__ import annotations

import os
import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tracehold.llm import toxicity
from tracehold.llm.storage import table, written

DATA = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def test_stages(spark):
    docs = table(spark, DATA, "documents")
    labels = table(spark, DATA, "labels")
    seen = [docs]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        seen.append(written(stage(spark, seen[-1], DATA), f"test-{k}"))
        if k < len(corpus_pipeline.STAGES) - 1:
            assert seen[-1].columns == docs.columns
    clean = {r.doc_id for r in toxicity.score(docs, toxicity.fit(docs, labels)).where("predicted = 0").collect()}
    kept = {r.doc_id: r.text for r in seen[1].collect()}
    assert set(kept) == clean
    sets = {i: shingles(t) for i, t in sorted(kept.items())}
    group = {i: i for i in sets}

    def top(x):
        while group[x] != x:
            x = group[x]
        return x

    for i, a in sets.items():
        for j, b in sets.items():
            if j < i and a and b and 100 * len(a & b) >= 80 * len(a | b):
                group[max(top(i), top(j))] = min(top(i), top(j))
    assert {r.doc_id for r in seen[2].collect()} == {i for i in sets if top(i) == i}
    before = {r.doc_id: r.text for r in seen[2].collect()}
    for r in seen[3].collect():
        secret = re.search(r"(?:token|secret|password) = \"[0-9a-f]{24,}", before[r.doc_id] or "")
        assert not secret or "[assign]" in r.text
        assert r.n_chars == len(r.text or "") or r.text == before[r.doc_id]
    copies = {(r.doc_id): r["count"] for r in seen[4].groupBy("doc_id").count().collect()}
    assert set(copies.values()) <= {1, 2} and set(copies) <= set(before)
    pieces = seen[5]
    assert pieces.where("start = 0").count() == seen[4].count()
    full = pieces.groupBy("sequence_id").agg(F.sum("length").alias("n"))
    assert full.where("n > 4096 OR (n & (n - 1)) <> 0").isEmpty()


def test_stages_keep_rows_with_null_and_repeated_ids(spark):
    text = lambda name, n=30: " ".join(f"{name}{k}" for k in range(n))
    rows = [(1, text("a")), (1, text("a")), (2, text("a") + " x"), (None, text("a")), (None, text("b")), (None, text("b")), (None, text("c")), (3, text("d")), (3, text("e")), (4, ""), (4, ""), (None, None)]
    docs = written(spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3), "test-ids")
    kept = corpus_pipeline.keep_one_of_near_copies(spark, docs, DATA)
    assert kept.columns == docs.columns
    want = [(1, text("a")), (None, text("b")), (None, text("c")), (3, text("d")), (3, text("e")), (4, ""), (4, ""), (None, None)]
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted(want, key=str)
    mixed = corpus_pipeline.mix_sources(spark, docs, DATA)
    assert mixed.columns == docs.columns
    counts = {(r.doc_id, r.text): r["count"] for r in mixed.groupBy("doc_id", "text").count().collect()}
    repeats = {row: rows.count(row) for row in rows}
    assert all(n <= 2 * repeats[row] for row, n in counts.items())
    # every row is in the mix's first epoch, as one source may be taken one and a half times
    assert all(counts.get(row, 0) >= n for row, n in repeats.items() if row[1])
