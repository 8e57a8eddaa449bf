"""What the checks of one run share over the telemetry view, each part made once and written."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from tracehold.operators import bindings, detect, scans
from tracehold.operators.pairing import pair_calls
from tracehold.plans import claims, detections, intake, signing, surface
from tracehold.plans.view import positions
from tracehold.sources.shared import kept


class Scored:
    """The view's events, calls, approvals, receipts, responses and collector evidence, and the seven checks over them."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        self.contracts: DataFrame | None = None

    @cached_property
    def events(self) -> DataFrame:
        return kept(positions(self.spark, self.sf_dir), "events")

    @cached_property
    def calls(self) -> DataFrame:
        paired = detect.with_positions(detect.classified(pair_calls(self.events)), self.events)
        return kept(detections.with_arguments(paired, self.events), "calls")

    @cached_property
    def grammar(self) -> DataFrame:
        return detections.benign_grammar(self.spark, self.sf_dir, self.calls)

    @cached_property
    def matches(self) -> DataFrame:
        own = claims.spanned(self.calls)
        return kept(bindings.approval_matches(own, claims.granted(own)), "matches")

    @cached_property
    def receipts(self) -> DataFrame:
        return kept(claims.with_receipts(self.calls), "receipts")

    @cached_property
    def responses(self) -> DataFrame:
        return kept(intake.responses(self.spark, self.sf_dir), "responses")

    @cached_property
    def evidence(self) -> signing.Evidence:
        return signing.evidence_of(self.spark, self.sf_dir)

    @cached_property
    def said(self) -> DataFrame:
        return kept(surface.said(self.spark, self.sf_dir), "said")

    @cached_property
    def disclosures(self) -> DataFrame:
        return kept(detect.disclosures(self.calls, intake.said_in(self.responses)), "disclosures")

    @cached_property
    def status(self) -> DataFrame:
        """(session_id, evidence_status)."""
        e = self.evidence
        found = signing.attestation.status(signing.sessions_of(self.spark, self.sf_dir, e), e.records, e.found, e.codes)
        return kept(found.withColumnRenamed("status", "evidence_status"), "status")

    @cached_property
    def marker_order(self) -> DataFrame:
        return detect.ordered_after(self.calls, detect.references(self.events, self.events["marked"]))

    @cached_property
    def policy_order(self) -> DataFrame:
        return detect.ordered_after(self.calls, detect.references(self.events, self.events["event_type"].isin(*detect.POLICY_TYPES)))

    @cached_property
    def scans(self) -> tuple[DataFrame, DataFrame]:
        spanned = surface.with_spans(self.calls)
        return scans.scanner_coverage(self.said, spanned), scans.content_signals(self.said, spanned)

    def checks(self) -> dict[str, DataFrame]:
        approvals = bindings.approval_states(claims.spanned(self.calls), self.matches).select("session_id", "start_arrival", "approval")
        return {
            "ch01": detect.ch01_sequence_order(self.calls, self.grammar), "ch02": detect.ch02_concealment_gap(self.calls, intake.said_in(self.responses)), "ch03": detect.ch03_untrusted(self.calls, self.events),
            "ch04": detect.ch04_guardrail(self.calls, detections.cited(self.events), detections.enforcement(self.spark), approvals, detections.declared(self.spark)), "ch05": detect.ch05_unpaired(self.calls),
            "ch06": signing.attestation.ch06_integrity(self.evidence.codes), "ch07": detect.ch07_effects(self.receipts),
        }

    @cached_property
    def findings(self) -> DataFrame:
        """(session_id, check, severity) of the seven checks."""
        return kept(detect.union_findings(**self.checks()), "findings")
