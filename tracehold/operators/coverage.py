"""How much evidence each check had, per session: columnar arithmetic on one wide row, turned into one row per check."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FEATURES = (
    "corr", "clock", "calls", "class_worst", "unknown_calls", "heuristic_calls", "manifest_calls", "has_baseline", "vocabulary_matches", "has_response", "truncated", "consequential", "ambiguous",
    "scanner_answers", "scanned", "scannable", "unbound", "result_share", "contradicted", "unscanned", "unordered_marker", "policy_events", "policy_declared", "undeclared", "in_band_only",
    "approvals", "span_only", "dangling", "unordered_policy", "with_sidecar", "partial", "signed", "coverage", "covers_final", "freshness_checked", "has_ledger", "not_closed", "inadmissible",
    "integrity_codes", "receipted", "effectful", "loose", "digest_disagrees",
)


def share(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def contracts(features: DataFrame) -> DataFrame:
    """(session_id, check, confidence, status, reasons, missing) for the seven checks, from features (session_id and FEATURES).

    A check that could not look at all is not_evaluated, with the surfaces that it misses; one that looked is evaluated
    at full confidence and degraded below, even at 0: then what it saw speaks against itself. reasons name what was not
    there, sorted and joined by commas.
    """
    c = F.col
    cut = lambda flag, factor: F.when(flag, factor).otherwise(1.0)
    left = lambda a: 1 - share(c(a), c("consequential"))
    common = [(c("corr") < 1, "CORRELATION_KEY_NOT_PRODUCER_SUPPLIED"), (c("clock") < 1, "EVENT_CLOCK_INVALID")]
    classes = [(c("unknown_calls") > 0, "TOOL_CLASS_UNKNOWN"), (c("heuristic_calls") > 0, "TOOL_CLASS_FROM_NAME_HEURISTIC"), ((c("manifest_calls") == 0) & (c("calls") > 0), "NO_CAPABILITY_MANIFEST")]
    seen = F.when(c("scannable") > 0, F.least(F.lit(1.0), c("scanned") / c("scannable"))).otherwise(1.0)
    spoke = c("policy_events") > 0
    semantics = F.when(c("undeclared"), 0.6).when(c("in_band_only"), 0.85).otherwise(1.0) * F.when(c("approvals") == 0, 0.8).when(c("span_only"), 0.9).otherwise(1.0) * left("unordered_policy")
    reach = F.when(~c("signed"), 0.6).when(c("covers_final"), 1.0).otherwise(c("coverage"))
    bad_class = c("class_worst") < 1
    every = F.lit(True)
    # of each check: when it could not look, why and what is missing then; else its confidence, what lowers it, and what is missing
    spec: dict[str, tuple[Column, list, list, Column, list, list]] = {
        "CH01": (
            ~(c("has_baseline") & c("vocabulary_matches")), [(~c("has_baseline"), "NO_BENIGN_BASELINE_FITTED"), (c("has_baseline"), "BASELINE_VOCABULARY_MISMATCH")], [(every, "benign_baseline")],
            c("corr") * c("clock") * (0.5 + 0.5 * c("class_worst")), [*common, *((bad_class & on, code) for on, code in classes)], [],
        ),
        "CH02": (
            ~c("has_response") | c("truncated"), [(~c("has_response"), "NO_FINAL_RESPONSE_TEXT"), (c("truncated"), "FINAL_RESPONSE_TRUNCATED")], [(every, "final_response")],
            c("corr") * c("class_worst") * left("ambiguous"), [*common, *classes, (c("ambiguous") > 0, "DISCLOSURE_AMBIGUOUS_SHARED_TOKENS")], [],
        ),
        "CH03": (
            c("scanner_answers") == 0, [(every, "NO_INJECTION_SCANNER_EVIDENCE"), (c("unscanned") > 0, "UNSCANNED_CONTENT_CARRIES_MARKERS")], [(every, "injection_scanner")],
            c("corr") * c("class_worst") * c("clock") * seen * (0.8 + 0.2 * c("result_share")) * left("unordered_marker") * (1 - 0.5 * share(c("contradicted"), c("scanned"))),
            [
                *common, *classes, (c("result_share") < 1, "NO_TOOL_RESULT_CAPTURED"), ((seen < 1) | (c("unbound") > 0), "INJECTION_SCANNER_PARTIAL_COVERAGE"), (c("unordered_marker") > 0, "EVENT_ORDER_INDETERMINATE"),
                (c("contradicted") > 0, "SCANNER_ANSWER_CONTRADICTED_BY_CONTENT"), (c("unscanned") > 0, "UNSCANNED_CONTENT_CARRIES_MARKERS"),
            ],
            [(c("result_share") < 1, "tool_result")],
        ),
        "CH04": (
            ~spoke & ~c("policy_declared"), [(every, "NO_POLICY_EVIDENCE")], [(every, "policy_semantics"), (c("approvals") == 0, "approval_binding")],
            c("corr") * c("class_worst") * c("clock") * F.when(spoke, semantics).otherwise(1.0),
            [
                *common, *classes, (spoke & c("undeclared"), "POLICY_SEMANTICS_UNDECLARED"), (spoke & ~c("undeclared") & c("in_band_only"), "POLICY_ENFORCEMENT_DECLARED_IN_BAND"), (spoke & (c("approvals") == 0), "NO_APPROVAL_EVIDENCE"),
                (spoke & (c("approvals") > 0) & c("span_only"), "APPROVAL_BOUND_BY_SPAN_ONLY"), (spoke & (c("dangling") > 0), "APPROVAL_MATCHES_NO_CALL"), (spoke & (c("unordered_policy") > 0), "EVENT_ORDER_INDETERMINATE"),
            ],
            [(spoke & c("undeclared"), "policy_semantics"), (spoke & (c("approvals") == 0), "approval_binding")],
        ),
        "CH05": (F.lit(False), [], [], c("corr") * F.when(c("unknown_calls") > 0, c("class_worst")).otherwise(1.0), [*common, (c("unknown_calls") > 0, "TOOL_CLASS_UNKNOWN")], []),
        "CH06": (
            ~c("with_sidecar"), [(every, "NO_INTEGRITY_EVIDENCE")], [(every, "event_integrity")],
            F.when(c("inadmissible"), 0.0).otherwise(cut(c("partial"), 0.5) * reach * cut(~c("freshness_checked"), 0.8) * cut(~c("has_ledger"), 0.9) * cut(c("not_closed"), 0.9)),
            [(c("signed") & ~c("covers_final"), "SIGNATURE_PREFIX_ONLY"), (~c("freshness_checked"), "NO_FRESHNESS_BOUND"), (~c("has_ledger"), "NO_STREAM_LEDGER"), (every, c("integrity_codes"))], [],
        ),
        "CH07": (
            c("receipted") == 0, [(every, "NO_EFFECT_RECEIPT")], [(every, "effect_receipt")],
            share(c("receipted"), c("effectful")) * c("corr") * c("class_worst") * (1 - 0.5 * share(c("loose"), c("receipted"))) * cut(c("digest_disagrees"), 0.5),
            [*common, *classes, (c("receipted") < c("effectful"), "NO_EFFECT_RECEIPT"), (c("loose") > 0, "RECEIPT_BOUND_BY_SPAN_ONLY"), (c("digest_disagrees"), "ARG_DIGEST_CONTRADICTS_CAPTURED_ARGS")], [],
        ),
    }

    def listed(codes: list) -> Column:
        given = [F.when(on, code if isinstance(code, Column) else F.lit(code)) for on, code in codes]
        words = F.split(F.concat_ws(",", F.lit(None).cast("string"), *given), ",")
        return F.array_join(F.array_sort(F.array_distinct(F.filter(words, lambda w: w != ""))), ",")

    rows = F.array(*(
        F.struct(
            F.lit(check).alias("check"), F.when(blind, 0.0).otherwise(confidence).cast("double").alias("confidence"), blind.alias("_blind"),
            F.when(blind, listed(why)).otherwise(listed(reasons)).alias("reasons"), F.when(blind, listed(lost)).otherwise(listed(missing)).alias("missing"),
        )
        for check, (blind, why, lost, confidence, reasons, missing) in spec.items()
    ))
    out = features.select("session_id", F.inline(rows))
    status = F.when(c("_blind"), "not_evaluated").when(c("confidence") >= 1, "evaluated").otherwise("degraded")
    return out.select("session_id", "check", "confidence", status.alias("status"), "reasons", "missing")


def millionths(confidence: Column) -> Column:
    return F.floor(confidence * 1e6 + 0.5)


def completeness(found: DataFrame) -> DataFrame:
    """(session_id, completeness, n_evaluated, n_not_evaluated): the mean confidence over the checks, to three places, summed in whole millionths."""
    mean = F.floor((F.sum(millionths(F.col("confidence"))) * 2 + F.count("*") * 1000) / (F.count("*") * 2000)) / 1000
    return found.groupBy("session_id").agg(mean.alias("completeness"), F.count_if(F.col("status") == "evaluated").alias("n_evaluated"), F.count_if(F.col("status") == "not_evaluated").alias("n_not_evaluated"))
