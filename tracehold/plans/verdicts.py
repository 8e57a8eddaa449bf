"""Queries: coverage from evidence, the findings of all seven checks stamped with it, and the verdicts that commit to both."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracehold.operators import coverage, detect
from tracehold.plans import claims, evidence, intake, signing, surface  # noqa: F401  (their SQL is read by name)
from tracehold.plans.detections import _RANK, _STEPS
from tracehold.plans.detections import _after as _AFTER
from tracehold.plans.registry import SQL, query
from tracehold.plans.scored import Scored
from tracehold.plans.view import CALLS, VIEW
from tracehold.sources import jsonl
from tracehold.sources.shared import kept

_CHECKS = {
    "CH01": "ch01_sequence_order", "CH02": "ch02_concealment_gap", "CH03": "ch03_untrusted", "CH04": "ch04_guardrail", "CH05": "ch05_unpaired", "CH06": "ch06_integrity", "CH07": "ch07_effects",
}
_FOUND = "found AS (" + " UNION ALL ".join(f"SELECT session_id, '{check}' AS \"check\", severity FROM ({SQL[name]})" for check, name in _CHECKS.items()) + ")"


def features(s: Scored) -> DataFrame:
    """What the seven checks have to go on, per session, from the run's own events, calls, claims, responses and streams."""
    user = F.regexp_extract("session_id", r"^u(\d+)", 1).cast("long")
    base = signing.sessions_of(s.spark, s.sf_dir, s.evidence).withColumn("corr", F.when(user % 20 == 3, 0.9).otherwise(1.0))
    source = F.col("k") % 3  # the manifest declares a third of the controls, the event itself another
    policy = F.col("event_type").isin(*detect.POLICY_TYPES)
    per = s.events.groupBy("session_id").agg(
        F.avg(F.when(F.col("ts").isNotNull() & ~F.isnan("ts"), 1.0).otherwise(0.0)).alias("clock"), F.count("marked").alias("scanner_answers"), F.count_if(policy).alias("policy_events"),
        F.bool_or(policy & (source == 2)).alias("undeclared"), F.bool_or(policy & (source == 1)).alias("in_band_only"), F.bool_or((F.col("event_type") == "tool_start") & (F.col("k") % 50 == 1)).alias("digest_disagrees"),
    )
    vocabulary = s.grammar.where(F.col("next") != detect.END).select(F.col("next").alias("name")).distinct().withColumn("_known", F.lit(True))
    known = s.calls.groupBy("session_id", "name").agg(F.count("*").alias("_n")).join(vocabulary, "name", "left").groupBy("session_id").agg(F.sum("_n").alias("_n"), (F.count_if("_known") / F.count("*")).alias("_overlap"))
    fits = known.select("session_id", (~((F.col("_n") >= detect.LEAST_CALLS) & (F.col("_overlap") < detect.LEAST_OVERLAP))).alias("vocabulary_matches"))
    unknown = F.col("class") == "unknown"
    calls = s.calls.groupBy("session_id").agg(
        F.count("*").alias("calls"), F.min(F.when(unknown, 0.0).when(F.col("class_source") == "manifest", 1.0).otherwise(0.7)).alias("class_worst"), F.count_if(unknown).alias("unknown_calls"),
        F.count_if(F.col("class_source") == "name_heuristic").alias("heuristic_calls"), F.count_if(F.col("class_source") == "manifest").alias("manifest_calls"), F.count_if("consequential").alias("consequential"),
        F.count_if(F.col("consequential") | unknown).alias("effectful"),
    )
    told = s.responses.groupBy("session_id").agg(F.lit(True).alias("has_response"), F.bool_or("truncated").alias("truncated"))
    unsure = s.calls.where("executed AND consequential").join(s.disclosures.where("disclosure = 'ambiguous'"), ["session_id", "name"]).groupBy("session_id").agg(F.count("*").alias("ambiguous"))
    seen, signals = s.scans
    disputed = signals.groupBy("session_id").agg(F.count_if(F.col("signal") == "contradicted").alias("contradicted"), F.count_if(F.col("signal") == "unscanned").alias("unscanned"))
    captured = s.calls.where("NOT consequential").join(s.said.select(F.col("arrival").alias("end_arrival"), F.col("tool_result").isNotNull().alias("_had")), "end_arrival", "left").groupBy("session_id").agg(F.avg(F.when(F.col("_had"), 1.0).otherwise(0.0)).alias("result_share"))
    unplaced = lambda rows, name: rows.where("consequential AND position = 'indeterminate'").groupBy("session_id").agg(F.count("*").alias(name))
    own = claims.spanned(s.calls)
    granted = claims.granted(own)
    loose = s.matches.where("consequential").groupBy("session_id").agg(F.bool_or(F.col("binding") == "bound_span_only").alias("span_only"))
    stray = granted.join(own.select("session_id", "span_id"), ["session_id", "span_id"], "left_anti").groupBy("session_id").agg(F.count("*").alias("dangling"))
    receipted = s.receipts.where("receipt IS NOT NULL AND (consequential OR class = 'unknown')").groupBy("session_id").agg(F.count("*").alias("receipted"), F.count_if(F.col("receipt_binding") == "bound_span_only").alias("loose"))
    e = s.evidence
    reach = signing.signatures.session_reach(e.records, e.spans).withColumn("with_sidecar", F.lit(True))
    signed = e.found.groupBy("session_id").agg(F.bool_or(~F.col("result").isin("KEY_UNKNOWN", "KEY_WRONG_ROLE", "KEY_REVOKED")).alias("signed"), F.bool_or("held").alias("freshness_checked"))
    has = lambda code: F.bool_or(F.col("code") == code)
    coded = e.codes.groupBy("session_id").agg(has("PARTIAL_INTEGRITY").alias("partial"), has("STREAM_NOT_CLOSED").alias("not_closed"), F.bool_or(signing.attestation.inadmissible()).alias("inadmissible"), F.array_join(F.array_sort(F.collect_set("code")), ",").alias("integrity_codes"))
    parts = [
        per, fits, calls, told, unsure, seen, disputed, captured, unplaced(s.marker_order, "unordered_marker"), unplaced(s.policy_order, "unordered_policy"),
        granted.groupBy("session_id").agg(F.count("*").alias("approvals")), loose, stray, receipted, reach, signed, coded,
    ]
    wide = base
    for part in parts:
        wide = wide.join(part, "session_id", "left")
    given = {"class_worst": 1.0, "clock": 1.0, "result_share": 1.0, "vocabulary_matches": True, "integrity_codes": ""}
    wide = wide.withColumns({"has_baseline": F.lit(True), "policy_declared": F.lit(False), "has_ledger": F.lit(True)}).fillna(given)
    flags = ["has_response", "truncated", "undeclared", "in_band_only", "span_only", "with_sidecar", "partial", "signed", "covers_final", "freshness_checked", "not_closed", "inadmissible", "digest_disagrees"]
    return wide.fillna(False, flags).fillna(0, [c for c in coverage.FEATURES if c not in (*given, *flags)]).select("session_id", *coverage.FEATURES)


def contracts_of(s: Scored) -> DataFrame:
    """The run's contracts, made once."""
    if s.contracts is None:
        found = coverage.contracts(features(s))
        s.contracts = kept(found.withColumn("confidence", coverage.millionths(F.col("confidence")) / 1e6), "contracts")
    return s.contracts


#: The same features, each from the tables that the checks' own SQL makes, and each check's contract written out.
_COVER = f"""WITH status AS ({SQL['signed_evidence_status']}), codes AS ({SQL['evidence_codes']}), reach AS ({signing.COVERED}), signed AS ({signing.TRIED}), seen AS ({SQL['scanner_coverage']}), signals AS ({SQL['content_contradictions']}), named AS ({CALLS + intake.DISCLOSED} SELECT session_id, count(*) AS ambiguous FROM classed JOIN named USING (session_id, name) WHERE executed AND consequential AND d = 1 GROUP BY 1),
told AS ({CALLS + intake.DISCLOSED} SELECT session_id, bool_or(truncated) AS truncated FROM told GROUP BY 1),
marks AS ({CALLS + _AFTER('marked')} SELECT session_id, count(*) AS n FROM placed WHERE consequential AND position = 'indeterminate' GROUP BY 1), turns AS ({CALLS + _AFTER("event_type = 'cost_threshold_exceeded'")} SELECT session_id, count(*) AS n FROM placed WHERE consequential AND position = 'indeterminate' GROUP BY 1),
per AS ({VIEW} SELECT session_id, count(marked) AS answers, count_if(event_type = 'cost_threshold_exceeded') AS policy, bool_or(event_type = 'cost_threshold_exceeded' AND k % 3 = 2) AS undeclared, bool_or(event_type = 'cost_threshold_exceeded' AND k % 3 = 1) AS in_band, bool_or(event_type = 'tool_start' AND k % 50 = 1) AS disagrees FROM tele GROUP BY 1),
cl AS ({CALLS} SELECT session_id, count(*) AS calls, min(CASE WHEN class = 'unknown' THEN 0.0::DOUBLE ELSE 0.7::DOUBLE END) AS w, count_if(class = 'unknown') AS unknown, count_if(class <> 'unknown') AS heuristic, count_if(consequential) AS cons, count_if(consequential OR class = 'unknown') AS effectful FROM classed GROUP BY 1),
cap AS ({CALLS} SELECT session_id, avg(CASE WHEN k % 10 = 3 OR k % 9 <> 4 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS results FROM (SELECT c.session_id, t.k FROM classed c LEFT JOIN tele t ON t.arrival = c.end_arrival WHERE NOT consequential) GROUP BY 1),
voc AS ({CALLS + _STEPS} SELECT session_id, NOT (sum(n) >= 3 AND count_if(v.name IS NOT NULL) / count(*) < 0.5) AS fits FROM (SELECT session_id, name, count(*) AS n FROM calls GROUP BY ALL) c LEFT JOIN (SELECT DISTINCT next AS name FROM grammar WHERE next <> '<end>') v ON c.name = v.name GROUP BY 1),
appr AS ({CALLS + claims.CLAIMS} SELECT g.session_id, count(*) AS approvals, count_if(s.span_id IS NULL) AS stray, any_value(l.loose) AS loose FROM granted g LEFT JOIN spanned s ON g.session_id = s.session_id AND g.span_id = s.span_id LEFT JOIN (SELECT m.session_id, bool_or(binding = 'bound_span_only') AS loose FROM matches m JOIN spanned s USING (session_id, span_id) WHERE consequential GROUP BY 1) l ON l.session_id = g.session_id GROUP BY 1),
rec AS ({CALLS + claims.CLAIMS} SELECT session_id, count(*) AS receipted, count_if(receipt_binding = 'bound_span_only') AS loose FROM receipted WHERE receipt_binding IS NOT NULL AND (consequential OR class = 'unknown') GROUP BY 1),
coded AS (SELECT session_id, bool_or(code = 'PARTIAL_INTEGRITY') AS partial, bool_or(code = 'STREAM_NOT_CLOSED') AS open, string_agg(code, ',' ORDER BY code) AS listed FROM codes GROUP BY 1),
disp AS (SELECT session_id, count_if(signal = 'contradicted') AS contradicted, count_if(signal = 'unscanned') AS unscanned FROM signals GROUP BY 1),
f AS (SELECT st.session_id, CASE WHEN CAST(regexp_extract(st.session_id, '^u([0-9]+)', 1) AS BIGINT) % 20 = 3 THEN 0.9::DOUBLE ELSE 1.0::DOUBLE END AS corr, st.status AS evidence, coalesce(calls, 0) AS calls, coalesce(w, 1.0::DOUBLE) AS w, coalesce(unknown, 0) AS unknown, coalesce(heuristic, 0) AS heuristic, coalesce(cons, 0) AS cons, coalesce(effectful, 0) AS effectful, coalesce(fits, TRUE) AS fits, told.session_id IS NOT NULL AS answered, coalesce(truncated, FALSE) AS truncated, coalesce(ambiguous, 0) AS ambiguous,
  coalesce(answers, 0) AS answers, coalesce(scanned, 0) AS scanned, coalesce(scannable, 0) AS scannable, coalesce(unbound, 0) AS unbound, coalesce(results, 1.0::DOUBLE) AS results, coalesce(contradicted, 0) AS contradicted, coalesce(unscanned, 0) AS unscanned, coalesce(marks.n, 0) AS um, coalesce(turns.n, 0) AS up, coalesce(policy, 0) AS policy, coalesce(undeclared, FALSE) AS undeclared, coalesce(in_band, FALSE) AS in_band, coalesce(disagrees, FALSE) AS disagrees,
  coalesce(approvals, 0) AS approvals, coalesce(stray, 0) AS stray, coalesce(appr.loose, FALSE) AS span_only, coalesce(receipted, 0) AS receipted, coalesce(rec.loose, 0) AS loose, coalesce(partial, FALSE) AS partial, coalesce(open, FALSE) AS open, coalesce(listed, '') AS listed, coalesce(tried, FALSE) AS signed, coalesce(held, FALSE) AS fresh, coalesce(covers_final, FALSE) AS covers_final, coverage
  FROM status st LEFT JOIN per USING (session_id) LEFT JOIN cl USING (session_id) LEFT JOIN voc USING (session_id) LEFT JOIN told USING (session_id) LEFT JOIN named USING (session_id) LEFT JOIN seen USING (session_id) LEFT JOIN disp USING (session_id) LEFT JOIN cap USING (session_id) LEFT JOIN marks USING (session_id) LEFT JOIN turns USING (session_id) LEFT JOIN appr USING (session_id) LEFT JOIN rec USING (session_id) LEFT JOIN coded USING (session_id) LEFT JOIN reach USING (session_id) LEFT JOIN signed USING (session_id)),
g AS (SELECT *, corr < 1 AS weak, CASE WHEN scannable > 0 THEN least(1.0::DOUBLE, scanned / scannable) ELSE 1.0::DOUBLE END AS scan, list_filter([CASE WHEN corr < 1 THEN 'CORRELATION_KEY_NOT_PRODUCER_SUPPLIED' END], lambda x: x IS NOT NULL) AS common, list_filter([CASE WHEN unknown > 0 THEN 'TOOL_CLASS_UNKNOWN' END, CASE WHEN heuristic > 0 THEN 'TOOL_CLASS_FROM_NAME_HEURISTIC' END, CASE WHEN calls > 0 THEN 'NO_CAPABILITY_MANIFEST' END], lambda x: x IS NOT NULL) AS classes FROM f),
stated AS (
  SELECT session_id, 'CH01' AS "check", NOT fits AS blind, corr * (0.5::DOUBLE + 0.5::DOUBLE * w) AS confidence, CASE WHEN fits THEN common || CASE WHEN w < 1 THEN classes ELSE [] END ELSE ['BASELINE_VOCABULARY_MISMATCH'] END AS why, CASE WHEN NOT fits THEN ['benign_baseline'] ELSE [] END AS lost FROM g
  UNION ALL SELECT session_id, 'CH02', NOT answered OR truncated, corr * w * (1 - CASE WHEN cons > 0 THEN ambiguous / cons ELSE 0 END), CASE WHEN NOT answered THEN ['NO_FINAL_RESPONSE_TEXT'] WHEN truncated THEN ['FINAL_RESPONSE_TRUNCATED'] ELSE common || classes || [CASE WHEN ambiguous > 0 THEN 'DISCLOSURE_AMBIGUOUS_SHARED_TOKENS' END] END, CASE WHEN NOT answered OR truncated THEN ['final_response'] ELSE [] END FROM g
  UNION ALL SELECT session_id, 'CH03', answers = 0, corr * w * scan * (0.8::DOUBLE + 0.2::DOUBLE * results) * (1 - CASE WHEN cons > 0 THEN um / cons ELSE 0 END) * (1 - 0.5::DOUBLE * CASE WHEN scanned > 0 THEN contradicted / scanned ELSE 0 END), CASE WHEN answers = 0 THEN ['NO_INJECTION_SCANNER_EVIDENCE', CASE WHEN unscanned > 0 THEN 'UNSCANNED_CONTENT_CARRIES_MARKERS' END] ELSE common || classes || [CASE WHEN results < 1 THEN 'NO_TOOL_RESULT_CAPTURED' END, CASE WHEN scan < 1 OR unbound > 0 THEN 'INJECTION_SCANNER_PARTIAL_COVERAGE' END, CASE WHEN um > 0 THEN 'EVENT_ORDER_INDETERMINATE' END, CASE WHEN contradicted > 0 THEN 'SCANNER_ANSWER_CONTRADICTED_BY_CONTENT' END, CASE WHEN unscanned > 0 THEN 'UNSCANNED_CONTENT_CARRIES_MARKERS' END] END, CASE WHEN answers = 0 THEN ['injection_scanner'] WHEN results < 1 THEN ['tool_result'] ELSE [] END FROM g
  UNION ALL SELECT session_id, 'CH04', policy = 0, corr * w * (CASE WHEN undeclared THEN 0.6::DOUBLE WHEN in_band THEN 0.85::DOUBLE ELSE 1.0::DOUBLE END * CASE WHEN approvals = 0 THEN 0.8::DOUBLE WHEN span_only THEN 0.9::DOUBLE ELSE 1.0::DOUBLE END * (1 - CASE WHEN cons > 0 THEN up / cons ELSE 0 END)), CASE WHEN policy = 0 THEN ['NO_POLICY_EVIDENCE'] ELSE common || classes || [CASE WHEN undeclared THEN 'POLICY_SEMANTICS_UNDECLARED' WHEN in_band THEN 'POLICY_ENFORCEMENT_DECLARED_IN_BAND' END, CASE WHEN approvals = 0 THEN 'NO_APPROVAL_EVIDENCE' WHEN span_only THEN 'APPROVAL_BOUND_BY_SPAN_ONLY' END, CASE WHEN stray > 0 THEN 'APPROVAL_MATCHES_NO_CALL' END, CASE WHEN up > 0 THEN 'EVENT_ORDER_INDETERMINATE' END] END, [CASE WHEN policy = 0 OR undeclared THEN 'policy_semantics' END, CASE WHEN approvals = 0 THEN 'approval_binding' END] FROM g
  UNION ALL SELECT session_id, 'CH05', FALSE, corr * CASE WHEN unknown > 0 THEN w ELSE 1.0::DOUBLE END, common || [CASE WHEN unknown > 0 THEN 'TOOL_CLASS_UNKNOWN' END], [] FROM g
  UNION ALL SELECT session_id, 'CH06', evidence = 'unattested', CASE WHEN evidence = 'inadmissible' THEN 0.0::DOUBLE ELSE CASE WHEN partial THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END * CASE WHEN NOT signed THEN 0.6::DOUBLE WHEN covers_final THEN 1.0::DOUBLE ELSE coverage END * CASE WHEN fresh THEN 1.0::DOUBLE ELSE 0.8::DOUBLE END * CASE WHEN open THEN 0.9::DOUBLE ELSE 1.0::DOUBLE END END, CASE WHEN evidence = 'unattested' THEN ['NO_INTEGRITY_EVIDENCE'] ELSE string_split(listed, ',') || [CASE WHEN signed AND NOT covers_final THEN 'SIGNATURE_PREFIX_ONLY' END, CASE WHEN NOT fresh THEN 'NO_FRESHNESS_BOUND' END] END, CASE WHEN evidence = 'unattested' THEN ['event_integrity'] ELSE [] END FROM g
  UNION ALL SELECT session_id, 'CH07', receipted = 0, CASE WHEN effectful > 0 THEN receipted / effectful ELSE 0 END * corr * w * (1 - 0.5::DOUBLE * CASE WHEN receipted > 0 THEN loose / receipted ELSE 0 END) * CASE WHEN disagrees THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END, CASE WHEN receipted = 0 THEN ['NO_EFFECT_RECEIPT'] ELSE common || classes || [CASE WHEN receipted < effectful THEN 'NO_EFFECT_RECEIPT' END, CASE WHEN loose > 0 THEN 'RECEIPT_BOUND_BY_SPAN_ONLY' END, CASE WHEN disagrees THEN 'ARG_DIGEST_CONTRADICTS_CAPTURED_ARGS' END] END, CASE WHEN receipted = 0 THEN ['effect_receipt'] ELSE [] END FROM g),
contracts AS (SELECT session_id, "check", floor(CASE WHEN blind THEN 0.0::DOUBLE ELSE confidence END * 1e6 + 0.5) / 1e6 AS confidence, CASE WHEN blind THEN 'not_evaluated' WHEN confidence >= 1 THEN 'evaluated' ELSE 'degraded' END AS status, array_to_string(list_sort(list_distinct(list_filter(why, lambda x: x <> ''))), ',') AS reasons, array_to_string(list_sort(list_distinct(list_filter(lost, lambda x: x <> ''))), ',') AS missing FROM stated)"""


@query(_COVER + " SELECT * FROM contracts")
def contracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each session's contract with each check: how far it could look, why not further, and what it misses."""
    return contracts_of(Scored(spark, sf_dir))


@query(_COVER + " SELECT session_id, floor((sum(CAST(floor(confidence * 1e6 + 0.5) AS BIGINT)) * 2 + count(*) * 1000) / (count(*) * 2000)) / 1000 AS completeness, count_if(status = 'evaluated') AS n_evaluated, count_if(status = 'not_evaluated') AS n_not_evaluated FROM contracts GROUP BY 1")
def coverage_per_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coverage.completeness(contracts_of(Scored(spark, sf_dir)))


@query(_COVER + ", listed AS (SELECT * FROM (VALUES ('CH01', 'sequence'), ('CH02', 'concealment'), ('CH03', 'untrusted_flow'), ('CH04', 'guardrail'), ('CH05', 'pairing'), ('CH06', 'integrity'), ('CH07', 'effects')) AS t(\"check\", family)) SELECT \"check\", family, count_if(status = 'evaluated') AS evaluated, count_if(status = 'degraded') AS degraded, count_if(status = 'not_evaluated') AS not_evaluated FROM contracts JOIN listed USING (\"check\") GROUP BY ALL")
def checks_by_family(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The registry of checks, with how many sessions each could judge."""
    families = spark.createDataFrame(list(detect.FAMILIES.items()), "check string, family string")
    stated = contracts_of(Scored(spark, sf_dir)).join(F.broadcast(families), "check")  # seven rows
    return stated.groupBy("check", "family").agg(*(F.count_if(F.col("status") == s).alias(s) for s in ("evaluated", "degraded", "not_evaluated")))


_STAMPED = f"{_COVER}, {_FOUND}, stamped AS (SELECT f.session_id, f.\"check\", f.severity, c.confidence, c.status AS coverage, CASE WHEN f.\"check\" = 'CH06' THEN 'not_applicable' ELSE st.status END AS evidence_status FROM found f LEFT JOIN contracts c ON c.session_id = f.session_id AND c.\"check\" = f.\"check\" LEFT JOIN status st ON st.session_id = f.session_id)"


def stamped(s: Scored) -> DataFrame:
    """(session_id, check, severity, confidence, coverage, evidence_status). The finding about the evidence itself has no status of evidence."""
    stated = contracts_of(s).select("session_id", "check", "confidence", F.col("status").alias("coverage"))
    rows = s.findings.join(stated, ["session_id", "check"], "left").join(s.status, "session_id", "left")
    return rows.withColumn("evidence_status", F.when(F.col("check") == "CH06", "not_applicable").otherwise(F.col("evidence_status")))


@query(_STAMPED + " SELECT *, count(*) AS n FROM stamped GROUP BY ALL")
def findings_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stamped(Scored(spark, sf_dir)).groupBy("session_id", "check", "severity", "confidence", "coverage", "evidence_status").agg(F.count("*").alias("n"))


@query(f"WITH {_FOUND} SELECT session_id, arg_max(severity, {_RANK}) AS severity, string_agg(DISTINCT \"check\", ',' ORDER BY \"check\") AS rules, count(*) AS n_findings FROM found GROUP BY 1")
def session_severity_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect.session_severity(Scored(spark, sf_dir).findings)


@query(_STAMPED + f" SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY {_RANK} DESC, \"check\", severity) AS place FROM stamped")
def findings_all_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = Window.partitionBy("session_id").orderBy(detect.ranked(F.col("severity")).desc(), "check", "severity")
    return stamped(Scored(spark, sf_dir)).withColumn("place", F.row_number().over(order))


#: Detection content: rules on the checks that fired, and three filters on what a verdict says of its evidence.
RULES = (
    ("novel_sequence", "CH01"), ("concealed_action", "CH02"), ("untrusted_flow", "CH03"), ("guardrail_bypassed", "CH04"), ("unpaired_call", "CH05"), ("evidence_tampered", "CH06"), ("effect_contradicted", "CH07"),
)
LEAST_COMPLETENESS = 0.8
_RULES = ", ".join(f"('{rule}', '{check}')" for rule, check in RULES)


@query(f"WITH {_FOUND}" + f""" SELECT DISTINCT session_id, rule FROM found JOIN (VALUES {_RULES}) AS r(rule, "check") USING ("check")
UNION ALL SELECT session_id, 'coverage_degraded' FROM ({SQL['coverage_per_session']}) WHERE completeness <= {LEAST_COMPLETENESS} UNION ALL SELECT session_id, 'integrity_defects' FROM ({SQL['stream_codes']}) GROUP BY 1
UNION ALL SELECT session_id, 'unpaired_consequential' FROM ({SQL['ch05_unpaired']}) WHERE n_consequential >= 1""")
def content_alerts_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions with the rules that they trip, over all checks, and the filters on completeness, integrity and consequence."""
    s = Scored(spark, sf_dir)
    rules = spark.createDataFrame(list(RULES), "rule string, check string")
    fired = s.findings.select("session_id", "check").distinct().join(F.broadcast(rules), "check")  # as many rows as there are checks
    complete = coverage.completeness(contracts_of(s))
    filters = (
        ("coverage_degraded", complete.where(F.col("completeness") <= LEAST_COMPLETENESS)), ("integrity_defects", evidence.stream_codes(spark, sf_dir)),
        ("unpaired_consequential", detect.ch05_unpaired(s.calls).where("n_consequential >= 1")),
    )
    out = fired.select("session_id", "rule")
    for rule, rows in filters:
        out = out.unionByName(rows.select("session_id").distinct().withColumn("rule", F.lit(rule)))
    return out


_IDS = f"""{_STAMPED}, fd AS (SELECT session_id, string_agg("check" || ':' || severity || ':' || evidence_status, ',' ORDER BY "check", {_RANK}) AS listed FROM stamped GROUP BY 1), cd AS (SELECT session_id, string_agg("check" || ':' || status || ':' || reasons || ':' || missing, ';' ORDER BY "check") AS stated FROM contracts GROUP BY 1), ev AS ({SQL['session_digest']})"""


@query(_IDS + """ SELECT session_id, findings_digest, coverage_digest, substr(sha256('{"coverage":"' || coverage_digest || '","events":"' || digest || '","findings":"' || findings_digest || '","run":"run-1","schema":"verdict/1","session":"' || session_id || '"}'), 1, 32) AS verdict_id FROM (SELECT ev.session_id, digest, sha256(coalesce(listed, '')) AS findings_digest, sha256(coalesce(stated, '')) AS coverage_digest FROM ev LEFT JOIN fd USING (session_id) LEFT JOIN cd USING (session_id))""")
def verdict_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An identity of each verdict that commits to its run, its events, its coverage and the findings of all seven checks."""
    s = Scored(spark, sf_dir)
    one = F.struct("check", detect.ranked(F.col("severity")).alias("rank"), "severity", "evidence_status")
    join = lambda array, sep, *fields: F.array_join(F.transform(F.array_sort(array), lambda x: F.concat_ws(":", *(x[f] for f in fields))), sep)
    listed = stamped(s).groupBy("session_id").agg(join(F.collect_list(one), ",", "check", "severity", "evidence_status").alias("listed"))
    stated = contracts_of(s).groupBy("session_id").agg(join(F.collect_list(F.struct("check", "status", "reasons", "missing")), ";", "check", "status", "reasons", "missing").alias("stated"))
    digest = lambda c: F.sha2(F.coalesce(c, F.lit("")), 256)
    rows = evidence.session_digest(spark, sf_dir).join(listed, "session_id", "left").join(stated, "session_id", "left").withColumns({"findings_digest": digest("listed"), "coverage_digest": digest("stated")})
    identity = F.struct(F.col("coverage_digest").alias("coverage"), F.col("digest").alias("events"), F.col("findings_digest").alias("findings"), F.lit("run-1").alias("run"), F.lit("verdict/1").alias("schema"), F.col("session_id").alias("session"))
    return rows.select("session_id", "findings_digest", "coverage_digest", F.substring(F.sha2(F.to_json(identity), 256), 1, 32).alias("verdict_id"))


@query(_STAMPED + f""", ev AS ({VIEW} SELECT session_id, count(*) AS events, min(ts) AS started_at, arg_min(agent_name, (ts, arrival)) AS agent, arg_min(host, (ts, arrival)) AS host FROM tele GROUP BY 1), worst AS (SELECT session_id, arg_max(severity, {_RANK}) AS severity, count(*) AS n_findings, string_agg(DISTINCT "check", ',' ORDER BY "check") AS rules FROM found GROUP BY 1), done AS (SELECT session_id, floor((sum(CAST(floor(confidence * 1e6 + 0.5) AS BIGINT)) * 2 + count(*) * 1000) / (count(*) * 2000)) / 1000 AS completeness FROM contracts GROUP BY 1)
SELECT session_id, events, started_at, agent, host, coalesce(severity, 'info') AS severity, coalesce(n_findings, 0) AS n_findings, coalesce(rules, '') AS rules, completeness, status.status AS evidence_status, row_number() OVER (ORDER BY started_at, session_id) - 1 AS sequence FROM ev LEFT JOIN worst USING (session_id) LEFT JOIN done USING (session_id) LEFT JOIN status USING (session_id)""")
def verdict_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One numbered verdict per session, with the findings of all checks, written as JSON lines and read back."""
    return jsonl.read_verdicts(spark, jsonl.write_verdicts(verdict_rows(Scored(spark, sf_dir))))


def verdict_rows(s: Scored) -> DataFrame:
    order = F.struct("ts", "arrival")
    events = s.events.groupBy("session_id").agg(F.count("*").alias("events"), F.min("ts").alias("started_at"), F.min_by("agent_name", order).alias("agent"), F.min_by("host", order).alias("host"))
    done = coverage.completeness(contracts_of(s)).select("session_id", "completeness")
    rows = events.join(detect.session_severity(s.findings), "session_id", "left").join(done, "session_id", "left").join(s.status, "session_id", "left")
    rows = rows.select(
        "session_id", "events", "started_at", "agent", "host", F.coalesce("severity", F.lit("info")).alias("severity"), F.coalesce("n_findings", F.lit(0)).cast("long").alias("n_findings"), F.coalesce("rules", F.lit("")).alias("rules"),
        "completeness", "evidence_status",
    )
    return kept(detect.numbered(kept(rows, "verdicts"), F.floor(F.col("started_at") / 86_400), ["started_at", "session_id"]), "verdicts-numbered")
