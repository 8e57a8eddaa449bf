"""The union of findings holds every check's rows."""

from __future__ import annotations

import os
from collections import Counter, defaultdict

import pytest

from tracehold.plans import catalog

DATA = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def test_all_seven_checks_are_united_and_stamped(spark):
    queries = catalog.queries()
    want = Counter()
    for name in ("ch01_sequence_order", "ch02_concealment_gap", "ch03_untrusted", "ch04_guardrail", "ch05_unpaired", "ch06_integrity", "ch07_effects"):
        want.update((r.session_id, name[:4].upper(), r.severity) for r in queries[name](spark, DATA).collect())
    assert {"CH01", "CH04", "CH06"} <= {check for _, check, _ in want}
    confidence = {(r.session_id, r.check): (r.confidence, r.status) for r in queries["contracts"](spark, DATA).collect()}
    status = {r.session_id: r.status for r in queries["signed_evidence_status"](spark, DATA).collect()}
    rows = queries["findings_all"](spark, DATA).collect()
    assert Counter({(r.session_id, r.check, r.severity): r.n for r in rows}) == want
    for r in rows:
        assert (r.confidence, r.coverage) == confidence[r.session_id, r.check]
        assert r.evidence_status == ("not_applicable" if r.check == "CH06" else status[r.session_id])
        assert r.coverage != "not_evaluated", "a check that fired could look"
    worst, rules = defaultdict(int), defaultdict(set)
    for session, check, severity in want:
        worst[session] = max(worst[session], ("low", "medium", "high", "critical").index(severity))
        rules[session].add(check)
    got = {r.session_id: (r.severity, r.rules) for r in queries["session_severity_all"](spark, DATA).collect()}
    assert got == {s: (("low", "medium", "high", "critical")[w], ",".join(sorted(rules[s]))) for s, w in worst.items()}
    ranked = queries["findings_all_ranked"](spark, DATA).collect()
    assert len(ranked) == sum(want.values()) and sum(r.place == 1 for r in ranked) == len(worst)


def test_contracts_vary_with_the_evidence(spark):
    """No check has the same confidence everywhere, and those that could not look say what they miss."""
    rows = catalog.queries()["contracts"](spark, DATA).collect()
    for check, least in {"CH01": 2, "CH03": 9, "CH04": 3, "CH05": 2, "CH06": 3, "CH07": 9}.items():
        assert len({r.confidence for r in rows if r.check == check}) >= least, check
    assert len({r.reasons for r in rows}) > 20
    assert all((r.status == "not_evaluated") <= (r.confidence == 0 and r.missing != "" and r.reasons != "") for r in rows)
    assert any(r.status == "degraded" and r.confidence == 0 for r in rows if r.check == "CH06")


def test_receipts_of_all_complete_calls_are_bound(spark):
    """Read-only calls carry receipts too; the rest of a call's arrival tells how its receipt was made."""
    made = {0: "bound", 1: "bound_span_only", 2: "arg_mismatch", 3: "unbound", 7: "bound"}
    want, classes = Counter(), set()
    for r in catalog.queries()["tool_calls"](spark, DATA).collect():
        if r.state == "complete" and r.start_arrival % 8 in made:
            want[r.session_id, made[r.start_arrival % 8]] += 1
            classes.add(r.name)
    assert {"fetch_page", "send_payment"} <= classes
    assert Counter({(r.session_id, r.receipt_binding): r.n for r in catalog.queries()["receipt_bindings"](spark, DATA).collect()}) == want


def test_leakage_is_the_same_by_shuffled_joins(spark):
    """Tables too large to broadcast: the transitions are joined by session after a shuffle."""
    want = catalog.queries()["leakage_delta"](spark, DATA).collect()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert catalog.queries()["leakage_delta"](spark, DATA).collect() == want
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
