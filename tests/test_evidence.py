"""Signatures, chains, the code table and ordering by verified position against plain folds."""

from __future__ import annotations

import hashlib
import os
import random
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tracehold.functions import ed25519
from tracehold.operators import approvals, attestation, chains, detect, signatures, traces
from tracehold.plans import catalog, signing

DATA = "/root/testdata/sf0.001"

RECORDS = "session_id string, stream_id string, key_id string, seq long, prev string, chain string, body string, arrival long"


def test_small_order_points_vouch_for_nothing():
    seed = b"s" * 32
    public = ed25519.public_key(seed)
    assert len(ed25519.small_order()) == 8 and ed25519.usable_key(public)
    spellings = ed25519.small_order() | {(int.from_bytes(p, "little") ^ 1 << 255).to_bytes(32, "little") for p in ed25519.small_order()}
    spellings |= {(ed25519.P + y | sign << 255).to_bytes(32, "little") for y in (0, 1) for sign in (0, 1)}
    for point in spellings:
        assert not ed25519.usable_key(point)
        for scalar in (0, 1, ed25519.ORDER - 1):
            for message in (b"anything", b"else"):
                assert not ed25519.verify(point, message, ed25519._packed(ed25519.BASE) + scalar.to_bytes(32, "little"))
                assert not ed25519.verify(public, message, point + scalar.to_bytes(32, "little"))
    signature = ed25519.sign(seed, b"m")
    late = int.from_bytes(signature[32:], "little") + ed25519.ORDER
    assert ed25519.verify(public, b"m", signature) and not ed25519.verify(public, b"m", signature[:32] + late.to_bytes(32, "little"))


def test_combs_and_digits_agree_and_are_fast():
    rng = random.Random(2)
    seeds = [rng.randbytes(32) for _ in range(3)]
    rows = []
    for k in range(60):
        seed, message = rng.choice(seeds), rng.randbytes(rng.randint(0, 80))
        signature = bytearray(ed25519.sign(seed, message))
        if k % 3 == 0:
            signature[rng.randrange(64)] ^= 1 << rng.randrange(8)
        rows.append((ed25519.public_key(seed), message, bytes(signature)))
    want = [k % 3 != 0 for k in range(60)]
    assert [ed25519.verify(*r) for r in rows] == want == [ed25519.verify(*r, often=True) for r in rows] == ed25519.verify_all(rows)
    began = time.process_time()
    ed25519.verify_all(rows)
    assert (time.process_time() - began) / 60 < 0.004
    for n in (0, 1, 15, 16, ed25519.ORDER - 1, ed25519.ORDER):
        assert ed25519._packed(ed25519._times(n, ed25519.BASE)) == ed25519._packed(ed25519._times_comb(n, ed25519.comb(ed25519.BASE, 5), 5))


def test_every_task_takes_signatures(spark):
    seed = b"k" * 32
    keys = spark.createDataFrame([("k", bytearray(ed25519.public_key(seed)), ["collector"], None, None, None)], "key_id string, public binary, roles array<string>, not_before double, not_after double, revoked_at double")
    rows = [("s", "t", i, "c", False, "k", bytearray(ed25519.sign(seed, chains.SEPARATOR.join([chains.SCHEME, "s", str(i), "c"]).encode())), 1.0) for i in range(80)]
    signed = spark.createDataFrame(rows, "stream_id string, session_id string, seq long, chain string, final boolean, key_id string, sig binary, ts double").coalesce(1)
    found = signatures.results(signed, keys).withColumn("task", F.spark_partition_id())
    assert {r.result for r in found.collect()} == {"VERIFIED"} and found.select("task").distinct().count() == 4


def _sha(*parts):
    return hashlib.sha256("\x1f".join(parts).encode()).hexdigest()


def _fold(rows):
    """Codes of records walked stream by stream in order of position, as they would be met one by one."""
    found, first = Counter(), {}
    for r in sorted(rows, key=lambda r: r[7]):
        first.setdefault(r[1], r[3])
    taken, streams = set(), {}
    for r in sorted(rows, key=lambda r: r[7]):
        if (r[1], r[3]) in taken or r[3] < first[r[1]]:
            found[r[0], "SEQUENCE_REPLAY"] += 1
        else:
            taken.add((r[1], r[3]))
            streams.setdefault(r[1], []).append(r)
    for own in streams.values():
        head, before, last = "", None, None
        for session, stream, key, seq, prev, chain, body, _ in sorted(own, key=lambda r: r[3]):
            both = {s for s in (last, session) if s}
            if before is None or seq != before + 1:
                if before is None and seq > 0:
                    found[session, "JOINED_MIDSTREAM"] += 1
                if before is not None:
                    found.update((s, "SEQUENCE_GAP") for s in both)
                head = _sha("stream/1", stream, key or "", "") if seq == 0 else prev or ""
            step = _sha(head, body) if head else None
            if step is None:
                found[session, "CHAIN_UNANCHORED"] += 1
            if (step and chain and chain != step) or (head and prev and prev != head):
                found.update((s, "CHAIN_BROKEN") for s in both)
            head, before, last = chain or step or head, seq, session
    return found


@pytest.mark.parametrize("seed", range(4))
def test_chains_equal_a_fold(spark, seed):
    """Streams with undeclared chains and predecessors, gaps, replays, edits and late arrivals, in blocks of a few positions."""
    rng = random.Random(seed)
    rows, arrival = [], 0
    for s in range(12):
        head = _sha("stream/1", f"s{s}", "k", "")
        start = rng.choice([0, 0, 3])
        for seq in range(rng.randint(1, 40)):
            body = f"{s}-{seq}"
            prev, head = head, _sha(head, body)
            if seq < start or rng.random() < 0.06:
                continue
            said = None if rng.random() < 0.4 else head
            stated = body if rng.random() > 0.06 else "edited"
            arrival += 1
            rows.append((rng.choice(["a", "b", "c", None]), f"s{s}", "k" if s % 5 else None, seq, None if rng.random() < 0.3 else prev, said, stated, arrival + rng.choice([0, 0, 0, 5])))
            if rng.random() < 0.05:
                rows.append((*rows[-1][:7], arrival + 1000))
    rows = [(*r[:7], k) for k, r in enumerate(sorted(rows, key=lambda r: r[7]))]
    got = chains.session_codes(spark.createDataFrame(rows, RECORDS).repartition(3), block=7).collect()
    assert {(r.session_id, r.code): r.n for r in got} == {k: n for k, n in _fold(rows).items() if k[0] is not None}


@pytest.mark.parametrize("seed", range(2))
def test_streams_taken_whole_equal_blocks(spark, seed):
    """Without blocks every column and summary is as with them, and a ledger that records have seen says as much as one that is joined."""
    rng = random.Random(seed)
    rows = [(rng.choice(["a", "b", None]), f"s{rng.randrange(6)}", rng.choice(["k", None]), rng.randrange(30), rng.choice([None, "p"]), rng.choice([None, None, "c"]), "b", n) for n in range(120)]
    records = spark.createDataFrame(rows, RECORDS)
    ledger = spark.createDataFrame([(f"s{k}", 0, 4 * k, rng.choice("ch"), k == 2) for k in range(8)], "stream_id string, first_seq long, last_seq long, head string, closed boolean")
    blocked, whole = (chains.verified(records, block) for block in (7, None))
    assert sorted(map(str, blocked.select(sorted(blocked.columns)).collect())) == sorted(map(str, whole.select(sorted(blocked.columns)).collect()))
    old = chains.ledger_status(chains.summary(records, blocked, 7), ledger, records, blocked)
    new = chains.ledger_status(chains.summary(chains.seen(records, ledger), block=None), ledger)
    assert sorted(map(str, old.select(sorted(old.columns)).collect())) == sorted(map(str, new.select(sorted(old.columns)).collect()))


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name", ["sequence_gaps", "evidence_status", "stream_summary", "ledger_next", "stream_ledger_status", "stream_codes", "chain_breaks"])
def test_chains_of_orders_are_dealt_once_and_not_written(spark, name):
    """What is shuffled by the record is lines without digests; nothing is read back from the shared folder."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        found = catalog.queries()[name](spark, DATA)
        plan = found._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert {path.split("/")[-1] for path in found.inputFiles()} == {"lineitem.parquet"}
    dealt = [line for line in plan.splitlines() if "- Exchange hashpartitioning" in line and "REPARTITION_BY_NUM" in line]
    assert len(dealt) <= (3 if "ledger" in name else 1), "what else reads the lines reuses that shuffle"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_evidence_takes_the_streams_of_the_view_alone(spark):
    """The records behind the code table are those of a sixteenth of the orders, from the first table written on."""
    linked = signing.attested(spark, DATA)
    assert linked.where("l_orderkey % 16 <> 0").isEmpty()
    assert linked.count() == spark.read.parquet(f"{DATA}/lineitem.parquet").where("l_orderkey % 16 = 0 AND l_partkey % 89 <> 0").count() > 0


def test_a_hot_stream_is_many_groups(spark):
    rows = spark.range(50_000).selectExpr("'s' AS session_id", "'one' AS stream_id", "'k' AS key_id", "id AS seq", "concat('p', id) AS prev", "concat('p', id + 1) AS chain", "'b' AS body", "id AS arrival")
    found = chains.with_previous(rows, ["seq", "chain"], block=2_000)
    assert found.where("seq > 0 AND (prev_seq <> seq - 1 OR prev_chain <> prev)").count() == 0 and found.where("prev_seq IS NULL").count() == 1
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        sizes = [r["count"] for r in found.groupBy(F.spark_partition_id().alias("task")).count().collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert len(sizes) == 4 and max(sizes) < 30_000


def test_ledger_holds_a_stream_against_its_end(spark):
    ledger = spark.createDataFrame([(s, 0, 4, "h", s == "closed") for s in ("joins", "differs", "unstated", "gap", "closed", "again", "rewritten")], "stream_id string, first_seq long, last_seq long, head string, closed boolean")
    record = lambda s, seq, prev, chain: ("x", s, "k", seq, prev, chain, "b", seq)
    rows = [record("joins", 5, "h", "i"), record("differs", 5, "z", "i"), record("unstated", 5, None, "i"), record("gap", 7, "h", "i"), record("closed", 5, "h", "i"), record("again", 4, "g", "h"), record("again", 5, "h", "i"), record("rewritten", 4, "g", "z"), record("fresh", 0, None, "i")]
    records = spark.createDataFrame(rows, RECORDS)
    got = {r.stream_id: (r.status, r.boundary) for r in chains.ledger_status(chains.summary(records), ledger, records).collect()}
    assert got == {"joins": ("advanced", "match"), "differs": ("forked", "differs"), "unstated": ("advanced", "unstated"), "gap": ("discontinuous", "gap"), "closed": ("after_close", "not_compared"), "again": ("replayed", "not_compared"), "rewritten": ("forked", "not_compared"), "fresh": ("new", None)}


@pytest.mark.parametrize("seed", range(4))
def test_order_by_verified_position_equals_a_fold(spark, seed):
    """Sessions over several streams: a position counts where it is verified, and outranks the clock in its own stream."""
    rng = random.Random(seed)
    clock = lambda: rng.choice([None, float("nan"), *map(float, range(8))])
    place = lambda: rng.choice([(None, None), *((s, rng.randrange(5)) for s in "xyz")])
    events = [(f"s{rng.randrange(30)}", clock(), *place(), rng.random() < 0.4, k) for k in range(160)]
    calls = [(f"s{rng.randrange(30)}", clock(), *place(), k) for k in range(200)]

    def order(call, event, streams):
        if call[2] is not None and call[2] == event[2]:
            return 2 if call[3] > event[3] else 1 if call[3] == event[3] else 0
        if event[1] is None or event[1] != event[1]:  # only a stream of the call's own settles these
            return 0 if call[2] in streams else 1
        if call[1] is None or call[1] != call[1]:
            return 1
        return 2 if call[1] > event[1] else 1 if call[1] == event[1] else 0

    want = {}
    for call in calls:
        own = [e for e in events if e[4] and e[0] == call[0]]
        found = [order(call, e, {x[2] for x in own if x[2] is not None}) for e in own]
        if found:
            want[call[4]] = ("not_after", "indeterminate", "after")[max(found)]
    refs = detect.references(spark.createDataFrame(events, "session_id string, ts double, at_stream string, at_seq long, marked boolean, n long"), F.col("marked"))
    got = detect.ordered_after(spark.createDataFrame(calls, "session_id string, start_ts double, start_stream string, start_seq long, n long"), refs).collect()
    assert len(got) == len(want)
    wrong = {r.n: (r.position, want[r.n]) for r in got if r.position != want[r.n]}
    assert not wrong


def test_positions_count_only_where_verified(spark):
    events = spark.createDataFrame([("a", "x", 1), ("a", "x", 3), ("b", "x", 1), ("a", "y", 1), ("a", None, None)], "session_id string, stream_id string, seq long")
    spans = spark.createDataFrame([("x", 2), ("y", None)], "stream_id string, verified_to long")
    codes = spark.createDataFrame([("b", "CHAIN_BROKEN"), ("a", "JOINED_MIDSTREAM")], "session_id string, code string")
    got = sorted(((r.session_id, r.stream_id, r.seq), (r.at_stream, r.at_seq)) for r in attestation.positions(events, spans, codes).where("stream_id IS NOT NULL").collect())
    assert got == [(("a", "x", 1), ("x", 1)), (("a", "x", 3), (None, None)), (("a", "y", 1), (None, None)), (("b", "x", 1), (None, None))]


def test_signed_approvals_are_good_once_and_only_as_signed(spark):
    fields = {"decision": "allow", "span_id": "sp", "tool_id": "pay", "arg_digest": "sha256:" + "a" * 64, "nonce": "n1", "granted_at": 10.0, "expires_at": 20.5}
    seed = b"a" * 32
    text = "\x1f".join(("approval/1", "allow", "sp", "pay", fields["arg_digest"], "n1", "10.0", "20.5"))
    signature = bytearray(ed25519.sign(seed, text.encode()))
    schema = "n long, decision string, span_id string, tool_id string, arg_digest string, nonce string, granted_at double, expires_at double, key_id string, sig binary, arrival long"
    made = lambda n, key="k", sig=signature, **other: (n, *(fields | other).values(), key, sig, n)
    rows = [
        made(0), made(1), made(2, nonce="n2"), made(3, span_id="sq"), made(4, tool_id=None), made(5, arg_digest=None), made(6, decision="deny"), made(7, granted_at=11.0), made(8, expires_at=None), made(9, "gone"), made(10, "other"),
        made(11, "late"), made(12, None, None), made(13, span_id="s\x1fp"), made(14, nonce=None),
    ]
    public = bytearray(ed25519.public_key(seed))
    keys = spark.createDataFrame([("k", public, ["approver"], 0.0, 99.0, None), ("gone", public, ["approver"], None, None, 1.0), ("other", public, ["collector"], None, None, None), ("late", public, ["approver"], 50.0, None, None)], "key_id string, public binary, roles array<string>, not_before double, not_after double, revoked_at double")
    asked = spark.createDataFrame(rows, schema)
    empty = spark.createDataFrame([], "nonce string")
    got = {r.n: (r.verified, r.unspent, r.tier, r.assured) for r in approvals.judged(asked, keys, empty).collect()}
    assert got[0] == (True, True, "single_use", True) and got[1] == (True, False, "authenticated", False)
    assert all(got[n][0] is False and got[n][1] is None and not got[n][3] for n in range(2, 15))
    assert got[4][2] == got[5][2] == "claimed" and got[2][2] == "bound"
    after = approvals.next_ledger(approvals.verified(asked, keys), empty)
    assert [r.nonce for r in after.collect()] == ["n1"]
    assert {r.n: r.assured for r in approvals.judged(asked, keys, after).collect()}[0] is False


def test_message_traces_pair_by_id_or_in_order(spark):
    call, result = (lambda *c: ("assistant", None, list(c), None, None)), (lambda i, f, t="r": ("tool", t, None, i, f))
    rows = [
        ("mixed", None, True, None, [("user", "hi", None, None, None), call(("c1", "send", "{}"), (None, "read", "{}"), (None, "read", "{}"), (None, "write", "{}")), result(None, "read", "one"), result(None, "read", "two"), result(None, "read", "stray"), result(None, "send", "no id"), result("c1", "send", "id"), result("c1", "send", "again"), ("assistant", "done", None, None, None)]),
        ("broken", "boom", True, None, [call((None, "read", "{}"))]), ("unknown", None, None, "x", [call((None, "read", "{}"))]), ("hit", None, False, "x", []), ("early", None, True, "x", [result("c", "f"), call(("c", "f", "{}"))]), ("empty", None, True, None, None),
    ]
    made = spark.createDataFrame(rows, f"trace_id string, error string, outcome boolean, attack string, messages {traces.MESSAGES}")
    found = traces.events(made).collect()
    assert {r.session_id for r in found} == {"mixed", "early"}
    own = sorted((r.ts, r.event_type, r.tool_name, r.span_id, r.text) for r in found if r.session_id == "mixed")
    spans = {r.span_id: r.tool_name for r in found if r.event_type == "tool_start" and r.session_id == "mixed"}
    assert len(spans) == 4 and sorted(spans.values()) == ["read", "read", "send", "write"]
    assert [(k, t, x) for _, k, t, _, x in own if k == "tool_end"] == [("tool_end", "read", "one"), ("tool_end", "read", "two"), ("tool_end", "send", "id")]
    assert [s for _, k, _, s, _ in own if k == "tool_end"][:2] == sorted(s for s, t in spans.items() if t == "read")
    assert [k for _, k, *_ in own][0] == "user_message" and [k for _, k, *_ in own][-1] == "model_response"
    assert {r.session_id: (r.stray_results, r.open_calls) for r in traces.unpaired(made).collect()} == {"mixed": (3, 1), "early": (1, 1)}
    assert {r.session_id: (r.is_attack, r.kind) for r in traces.labels(made, harm_when=False).collect()} == {"mixed": (False, "clean"), "hit": (True, "attack_succeeded"), "early": (False, "attack_resisted"), "empty": (False, "clean")}


def test_undeclared_controls_need_a_manifest_that_declares_some(spark):
    events = spark.createDataFrame([("a", "cost_threshold_exceeded", "p9"), ("a", "cost_threshold_exceeded", None), ("b", "cost_threshold_exceeded", "p0"), ("c", "depth_exceeded", "x"), ("d", "tool_start", "p9")], "session_id string, event_type string, policy_id string")
    found = lambda *names: {r.session_id: (r.policy, r.n_calls) for r in detect.undeclared_findings(events, spark.createDataFrame([(n,) for n in names], "policy_id string")).collect()}
    assert found("p0", "depth_exceeded") == {"a": ("cost_threshold_exceeded,p9", 2)} and found() == {}
