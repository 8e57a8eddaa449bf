"""Helpers and windows against plain folds over small random inputs."""

from __future__ import annotations

import base64
import random
from collections import defaultdict

import numpy as np
import pytest

from tracehold.functions import ed25519
from tracehold.functions.text import asserted
from tracehold.operators import anchors, chains, evaluate, signatures
from tracehold.operators.pairing import pair_by_name, pair_calls
from tracehold.sources.jsonl import anonymous_windows, quarantined, read_lines, reject_code

_KEY = base64.b64encode(ed25519.public_key(b"k" * 32)).decode()
EVENTS = "session_id string, event_type string, tool_name string, span_id string, ts double, arrival long, cost double"


def fifo(rows):
    """Complete pairs (start, end), open starts and orphan ends of sessions by name."""
    queues, out = defaultdict(list), []
    for session, kind, name, _, _, arrival, _ in sorted(rows, key=lambda r: (r[4], r[5])):
        if kind == "tool_start":
            queues[session, name].append(arrival)
        elif queues[session, name]:
            out.append((queues[session, name].pop(0), arrival))
        else:
            out.append((None, arrival))
    return sorted([*out, *((a, None) for q in queues.values() for a in q)], key=str)


@pytest.mark.parametrize("seed", range(3))
def test_pairing_by_name_is_first_in_first_out(spark, seed):
    rng = random.Random(seed)
    rows = [(f"s{rng.randrange(4)}", rng.choice(["tool_start", "tool_end", "tool_error"]), rng.choice("ab"), None, float(rng.randrange(40)), k, 1.0) for k in range(200)]
    got = pair_by_name(spark.createDataFrame(rows, EVENTS).repartition(3)).collect()
    assert sorted(((r.start_arrival, r.end_arrival) for r in got), key=str) == fifo(rows)


def test_pairing_by_span(spark):
    rows = [
        ("s", "tool_start", "a", "x", 1.0, 1, None), ("s", "tool_start", "a", "y", 2.0, 2, None), ("s", "tool_end", "a", "y", 3.0, 3, None), ("s", "tool_end", "a", "y", 4.0, 4, None),
        ("s", "tool_end", "b", "x", 5.0, 5, None), ("s", "tool_error", "a", None, 6.0, 6, None), ("s", "tool_end", "a", None, 7.0, 7, None),
    ]
    got = {(r.start_arrival, r.end_arrival): (r.state, r.executed) for r in pair_calls(spark.createDataFrame(rows, EVENTS)).collect()}
    assert got == {(2, 3): ("complete", True), (None, 4): ("duplicate_end", False), (None, 5): ("mismatched_end", False), (1, 6): ("complete", False), (None, 7): ("orphan_end", False)}


@pytest.mark.parametrize(
    ("line", "code"),
    [
        ('{"a": 1}', None), ('{"a": 1, "a": 2}', "MALFORMED_JSON"), ('{"a": NaN}', "MALFORMED_JSON"), ('{"a": 1e999}', "MALFORMED_JSON"), ('{"a": 1} x', "MALFORMED_JSON"), ("[1]", "NOT_A_JSON_OBJECT"),
        ("[" * 65 + "]" * 65, "NESTING_EXCEEDS_MAX_DEPTH"), ('{"a": "' + "[" * 70 + '"}', None), ('{"a": "�"}', None), ("{" + ",".join(f'"k{i}": 1' for i in range(513)) + "}", "RECORD_EXCEEDS_MAX_KEYS"),
        ('{"a": ' + "9" * 1025 + "}", "MALFORMED_JSON"), (None, "MALFORMED_JSON"),
    ],
)
def test_reject_codes(line, code):
    assert reject_code(line) == code


def test_encoding_is_tested_on_the_bytes(spark, tmp_path):
    (tmp_path / "a.jsonl").write_bytes('{"a": "\ufffd"}\n'.encode() + b'{"a": "\xff"}\n\n{"a": "\xe2\x82"}\n{"b": 1}\n')
    rows = quarantined(read_lines(spark, str(tmp_path))).orderBy("arrival").collect()
    assert [r.reject_code for r in rows] == [None, "LINE_NOT_VALID_UTF8", "LINE_NOT_VALID_UTF8", None]


def test_denials_hide_words():
    assert "email" not in asserted("I did not send any email to them")
    assert "email" in asserted("Nothing was skipped. I sent the email to Bob.")
    assert asserted(None) == []
    assert "sent" in asserted("I never slept; I sent it")


def test_windows_are_anchored(spark):
    rows = [("a", 0.0), ("a", 200.0), ("a", 400.0), ("a", 600.0), ("a", 701.0), ("b", 5.0)]
    got = {(r.scope, r.ts): r.window_start for r in anonymous_windows(spark.createDataFrame(rows, "scope string, ts double")).collect()}
    assert got == {("a", 0.0): 0.0, ("a", 200.0): 0.0, ("a", 400.0): 400.0, ("a", 600.0): 400.0, ("a", 701.0): 701.0, ("b", 5.0): 5.0}


def test_suppression(spark):
    rows = [("a", float(t), k) for k, t in enumerate((0, 100, 3599, 3600, 3700, 7300))]
    got = {r.ts: r.kept for r in evaluate.suppressed(spark.createDataFrame(rows, "agent string, ts double, arrival long")).collect()}
    assert got == {0.0: True, 100.0: False, 3599.0: False, 3600.0: True, 3700.0: False, 7300.0: True}


@pytest.mark.parametrize("seed", range(3))
def test_windows_and_suppression_equal_walks(spark, seed):
    rng = random.Random(seed)
    rows = sorted({(rng.choice("ab"), float(rng.choice([rng.randrange(3_000), rng.randrange(40) * 60]))) for _ in range(400)})
    want, start = {}, {}
    for scope, ts in rows:
        if scope not in start or ts - start[scope] > 300:
            start[scope] = ts
        want[scope, ts] = start[scope]
    got = anonymous_windows(spark.createDataFrame([*rows, ("a", None), ("b", float("nan"))], "scope string, ts double"))
    assert {(r.scope, r.ts): r.window_start for r in got.collect()} == want
    alerts, until, kept = [(a, t, k) for k, (a, t) in enumerate(rows + rows[::5])], {}, {}
    for a, t, k in sorted(alerts):
        kept[k] = t >= until.get(a, -1)
        if kept[k]:
            until[a] = t + 120
    assert {r.arrival: r.kept for r in evaluate.suppressed(spark.createDataFrame(alerts, "agent string, ts double, arrival long"), 120.0).collect()} == kept


def test_a_busy_agent_without_pauses_is_many_groups(spark):
    """A gapless agent: no window group has more rows than a slot of time holds."""
    alerts = spark.range(40_000).selectExpr("'a' AS agent", "CAST(id AS double) AS ts", "id AS arrival")
    got = evaluate.suppressed(alerts, 1_000.0).where("kept")
    assert sorted(r.ts for r in got.collect()) == [float(t) for t in range(0, 40_000, 1_000)]
    plan = anchors.pointers(alerts.select("agent", "ts"), "agent", 1_000.0, False)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


@pytest.mark.parametrize("seed", range(2))
def test_drift_counts_sessions_once(spark, seed):
    rng = random.Random(seed)
    rows = [(rng.choice("ab"), f"s{rng.randrange(12)}", float(rng.randrange(3_000))) for _ in range(300)]
    want = {}
    for agent, _, at in rows:
        sessions = {s for a, s, ts in rows if a == agent and at - 200 < ts <= at}
        if len(sessions) >= 4:
            want[agent, at] = len(sessions)
    got = {(r.agent, r.ts): r.sessions for r in evaluate.drift(spark.createDataFrame(rows, "agent string, session_id string, ts double"), 200.0, 4).collect()}
    assert got == want != {}


def test_bootstrap_resamples_blocks_as_one(spark):
    rng = random.Random(1)
    rows = [(rng.randrange(9), rng.randrange(9), rng.randrange(9), rng.randrange(9)) for _ in range(800)]
    clusters = spark.createDataFrame(rows, "tp long, fp long, fn long, tn long")
    whole, parted = evaluate.bootstrap(clusters, 600).first(), evaluate.bootstrap(clusters, 600, block=50).first()
    assert parted == evaluate.bootstrap(clusters.repartition(5), 600, block=50).first()
    table = np.array(rows)
    draws = [table[np.random.default_rng(k).integers(0, 800, 800)].sum(0) for k in range(600)]
    recall, fpr = [t[0] / (t[0] + t[2]) for t in draws], [t[1] / (t[1] + t[3]) for t in draws]
    for got in (whole, parted):
        assert np.allclose(got.recall, np.percentile(recall, [2.5, 50, 97.5]), atol=0.004) and np.allclose(got.fpr, np.percentile(fpr, [2.5, 50, 97.5]), atol=0.004)
    assert evaluate.bootstrap(clusters.where("FALSE"), 5).first().recall is None


def test_empty_tables(spark):
    empty = spark.createDataFrame([], EVENTS)
    assert pair_calls(empty).count() == 0
    records = spark.createDataFrame([], "session_id string, stream_id string, key_id string, seq long, prev string, chain string, body string, arrival long")
    assert chains.session_codes(records).count() == 0


def test_signatures_are_those_of_the_standard():
    seed = bytes.fromhex("9d61b19deffd5a60ba844af492ec2cc44449c5697b326919703bac031cae7f60")
    public = bytes.fromhex("d75a980182b10ab7d54bfed3c964073a0ee172f3daa62325af021a68f707511a")
    sig = bytes.fromhex("e5564300c360ac729086e2cc806e828a84877f1eb8e5d974d873e065224901555fb8821590a33bacc61e39701cf9b46bd25bf5f0595bbe24655141438e7a100b")
    assert ed25519.public_key(seed) == public and ed25519.sign(seed, b"") == sig
    assert ed25519.verify(public, b"", sig) and not ed25519.verify(public, b"x", sig) and not ed25519.verify(public, b"", sig[:-1] + b"\x7f") and not ed25519.verify(None, b"", sig)
    more = ed25519.sign(b"k" * 32, b"head")
    assert ed25519.verify(ed25519.public_key(b"k" * 32), b"head", more) and not ed25519.verify(public, b"head", more)


def test_trust_stores_are_refused_whole(spark):
    good = '{"keys": {"a": {"key": "' + _KEY + '", "roles": ["collector"], "replaces": "b"}}}'
    load = lambda text: signatures.trust_store(spark, spark.createDataFrame([(text,)], "value string")).collect()
    assert [r.key_id for r in load(good)] == ["a"]
    for bad in (good.replace('"b"', '"a"'), good.replace('["collector"]', "[]"), good.replace(_KEY, "AAAA"), good.replace(_KEY, "A" * 43 + "="), "{", '{"keys": null}'):
        with pytest.raises(signatures.StoreError):
            load(bad)


def test_keys_are_pinned_and_succession_is_transitive(spark):
    keys = spark.createDataFrame([("a", None), ("b", "a"), ("c", "b"), ("x", "y"), ("y", "x")], "key_id string, replaces string")
    assert signatures.successions(keys) == {("b", "a"), ("c", "b"), ("c", "a"), ("x", "y"), ("y", "x")}
    found = spark.createDataFrame([("s", "t", k, key, True) for k, key in enumerate("aacxcba")] + [("s", "t", 9, "x", False)], "stream_id string, session_id string, seq long, key_id string, held boolean")
    got = {(r.seq, r.from_key_id, r.to_key_id) for r in signatures.key_changes(found, keys).collect()}
    assert got == {(3, "c", "x"), (5, "c", "b"), (6, "c", "a")}
