"""Queries: approvals, receipts, sidecars, canonical digests, and coverage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracehold.functions.canonical import body_digests
from tracehold.operators import bindings
from tracehold.plans import claims
from tracehold.plans.detections import calls_of
from tracehold.plans.registry import query
from tracehold.plans.view import CALLS, VIEW, table, telemetry

_SPANNED = CALLS + claims.CLAIMS + " "


@query(_SPANNED + "SELECT session_id, span_id, decision, binding, in_window, observed_before FROM matches")
def approval_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls = claims.spanned(calls_of(spark, sf_dir))
    return bindings.approval_matches(calls, claims.granted(calls)).select("session_id", "span_id", "decision", "binding", "in_window", "observed_before")


@query(_SPANNED + "SELECT session_id, span_id, observed_at FROM matches WHERE decision = 'allow' AND binding = 'bound' AND observed_before AND in_window")
def covering_approvals(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls = claims.spanned(calls_of(spark, sf_dir))
    return bindings.covering(bindings.approval_matches(calls, claims.granted(calls))).select("session_id", "span_id", "observed_at")


@query(_SPANNED.rstrip() + claims.SIGNED + " SELECT session_id, span_id, verified, unspent, tier FROM worth")
def approval_trust(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each approval is worth: claimed, bound, authenticated by its issuer, or authenticated and used for the first time."""
    return claims.judged(claims.spanned(calls_of(spark, sf_dir))).select("session_id", "span_id", "verified", "unspent", "tier")


@query(_SPANNED.rstrip() + claims.SIGNED + """, marked AS (SELECT m.session_id, m.span_id, CASE WHEN m.decision = 'deny' AND m.binding = 'bound' THEN 1 WHEN m.decision = 'allow' AND m.binding = 'bound' AND observed_before AND in_window THEN CASE WHEN assured THEN 2 ELSE 3 END WHEN m.binding = 'arg_mismatch' THEN 4 WHEN NOT in_window THEN 5 WHEN m.binding = 'bound_span_only' THEN 6 ELSE 7 END AS r FROM matches m JOIN worth w ON w.session_id = m.session_id AND w.span_id = m.span_id)
SELECT session_id, list_extract(['denied', 'covered', 'unassured', 'arg_mismatch', 'expired', 'span_only', 'none'], coalesce(r, 7)) AS approval, count(*) AS n FROM spanned LEFT JOIN (SELECT session_id, span_id, min(r) AS r FROM marked GROUP BY ALL) USING (session_id, span_id) GROUP BY ALL""")
def approval_states_signed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The state of each call's approvals where only signed ones of a first use may cover: the rest are unassured."""
    own = claims.spanned(calls_of(spark, sf_dir))
    matches = bindings.approval_matches(own, claims.judged(own))
    return bindings.approval_states(own, matches, F.col("assured")).groupBy("session_id", "approval").agg(F.count("*").alias("n"))


@query(_SPANNED + "SELECT g.session_id, g.span_id, g.decision FROM granted g ANTI JOIN spanned s ON g.session_id = s.session_id AND g.span_id = s.span_id")
def dangling_approvals(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls = claims.spanned(calls_of(spark, sf_dir))
    return bindings.dangling(claims.granted(calls), calls).select("session_id", "span_id", "decision")


@query(_SPANNED + "SELECT session_id, start_arrival, receipt_binding, CASE WHEN start_arrival % 8 IN (5, 6, 7) THEN 'INVALID_RECEIPT_OBJECT' END AS defect, CASE WHEN b_span IS NOT NULL THEN list_extract(['claimed', 'bound', 'authenticated', 'reconciled'], least(CASE WHEN receipt_binding = 'bound' THEN 2 ELSE 1 END, CASE WHEN start_arrival % 8 = 7 THEN 1 WHEN assurance = 'operation' THEN 4 WHEN assurance = 'object' THEN 2 ELSE 1 END)) END AS tier FROM receipted")
def receipts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each complete call's receipt, parsed and bound, with the trust that it supports."""
    rows = claims.with_receipts(calls_of(spark, sf_dir))
    tier = F.get(F.array(*map(F.lit, bindings.RECEIPT_TIERS)), bindings.receipt_tier(F.col("receipt_binding")) - 1)
    return rows.select("session_id", "start_arrival", "receipt_binding", F.col("receipt_defect").alias("defect"), tier.alias("tier"))


@query(CALLS + claims.CLAIMS + "SELECT session_id, list_extract(['claimed', 'bound', 'authenticated', 'reconciled'], min(tier)) AS weakest, list_extract(['claimed', 'bound', 'authenticated', 'reconciled'], max(tier)) AS strongest FROM (SELECT session_id, least(CASE WHEN receipt_binding = 'bound' THEN 2 ELSE 1 END, CASE WHEN start_arrival % 8 = 7 THEN 1 WHEN assurance = 'operation' THEN 4 WHEN assurance = 'object' THEN 2 ELSE 1 END) AS tier FROM receipted WHERE receipt_binding IS NOT NULL) GROUP BY 1")
def trust_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The weakest and the strongest tier of a session's receipts: the weaker of what binding and assurance support."""
    rank = bindings.receipt_tier(F.col("receipt_binding"))
    names = F.array(*map(F.lit, bindings.RECEIPT_TIERS))
    rows = claims.with_receipts(calls_of(spark, sf_dir)).where("receipt IS NOT NULL")
    return rows.groupBy("session_id").agg(F.element_at(names, F.min(rank)).alias("weakest"), F.element_at(names, F.max(rank)).alias("strongest"))


@query(VIEW + "SELECT arrival, CASE k % 5 WHEN 0 THEN 'declared_and_recomputed' WHEN 1 THEN 'producer_contradicted' WHEN 2 THEN 'recomputed' WHEN 3 THEN 'producer_declared' ELSE 'none' END AS identity FROM tele")
def arg_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Declared digests that are right, wrong, absent, alone, and of a form that is none."""
    fifth, real = F.col("k") % 5, F.concat(F.lit("sha256:"), F.sha2(F.col("k").cast("string"), 256))
    declared = F.when(fifth == 0, F.upper(real)).when(fifth == 1, F.concat(F.lit("sha256:"), F.sha2(F.lit("no"), 256))).when(fifth == 3, real).when(fifth == 4, F.lit("md5:abc"))
    declared = F.when(fifth == 0, F.concat(F.lit("sha256:"), F.upper(F.sha2(F.col("k").cast("string"), 256)))).otherwise(declared)
    return telemetry(spark, sf_dir).select("arrival", bindings.arg_identity(declared, F.when(fifth < 3, real)).alias("identity"))


@query(VIEW + "SELECT arrival, CASE WHEN k % 5 IN (1, 2, 3) THEN 'INVALID_INTEGRITY_OBJECT' END AS defect, k % 5 = 0 AS is_chained FROM tele")
def integrity_sidecars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sidecars: sound, of another scheme, without a position, with a short signature, and chained by half."""
    fifth, chain = F.col("k") % 5, F.sha2(F.col("k").cast("string"), 256)
    made = F.to_json(F.struct(
        F.when(fifth == 1, "other/9").otherwise("stream/1").alias("scheme"), F.lit("s").alias("stream_id"), F.when(fifth != 2, F.col("arrival")).alias("seq"),
        F.when(fifth == 4, "nothex").otherwise(chain).alias("prev"), chain.alias("chain"), F.when(fifth == 3, "QUJD").alias("sig"),
    ))
    return bindings.sidecars(telemetry(spark, sf_dir).withColumn("integrity", made), "stream/1").select("arrival", "defect", "is_chained")


@query(VIEW + "SELECT arrival, CASE WHEN k % 4 IN (0, 1) THEN 'allow' END AS decision, CASE k % 4 WHEN 0 THEN 'blocking' WHEN 1 THEN 'undeclared' END AS enforcement, CASE WHEN k % 4 IN (2, 3) THEN 'INVALID_APPROVAL_OBJECT' END AS defect FROM tele")
def approvals(spark: SparkSession, sf_dir: str) -> DataFrame:
    rest = F.col("k") % 4
    made = F.to_json(F.struct(
        F.when(rest == 2, "maybe").otherwise("allow").alias("decision"), F.struct(F.when(rest != 3, F.concat(F.lit("sp"), "arrival")).alias("span_id"), F.col("tool_name").alias("tool_id")).alias("subject"),
        F.when(rest == 0, "blocking").otherwise("sometimes").alias("enforcement"),
    ))
    return bindings.approvals(telemetry(spark, sf_dir).select("arrival", made.alias("approval"))).select("arrival", "decision", "enforcement", "defect")


_RESPONSES = "SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN ['charge_id', CAST(o_custkey AS VARCHAR), 'operation'] WHEN 1 THEN ['issue_id', CAST(o_custkey AS VARCHAR), 'object'] WHEN 2 THEN ['resource_version', CAST(o_custkey AS VARCHAR), 'operation'] WHEN 3 THEN ['client_message_id', CAST(o_custkey AS VARCHAR), 'client'] ELSE [NULL, NULL, NULL] END AS r FROM orders"


@query(f"SELECT o_orderkey, r[1] AS kind, r[2] AS identifier, r[3] AS assurance FROM ({_RESPONSES})")
def receipts_from_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    which, value = F.col("o_orderkey") % 5, F.col("o_custkey").cast("string")
    operation = F.when(which == 0, "stripe.charge").when(which == 1, "jira.create_issue").when(which == 2, "kubernetes.apply").when(which == 3, "smtp.send").otherwise("unknown.call")
    response = F.when(which == 2, F.to_json(F.struct(F.struct(value.alias("resourceVersion"), F.lit("u").alias("uid")).alias("metadata")))).when(which == 3, F.to_json(F.struct(F.lit(" ").alias("server_message_id"), value.alias("message_id")))).otherwise(F.to_json(F.struct(value.alias("id"))))
    found = bindings.receipts(table(spark, sf_dir, "orders").select("o_orderkey", operation.alias("operation"), response.alias("response")))
    return found.select("o_orderkey", "receipt.kind", "receipt.identifier", "receipt.assurance")


_PATHS = bindings.RECEIPT_PATHS
_EXPECTED = ", ".join(f"({i}, '{op}', '{authority}', '{kind}', '{assurance}')" for i, (op, authority, _, kind, assurance) in enumerate(_PATHS))


def _nested(path: str) -> str:
    """A response that holds its value (%s) at this path alone, headers with capital letters."""
    *parents, name = path.split(".")
    text = '{"' + (name.title() if "-" in name else name) + '": "%s"}'
    for parent in reversed(parents):
        text = '{"' + parent + '": ' + text + "}"
    return text


@query(f"SELECT o_orderkey, op AS operation, authority, kind, CAST(o_custkey AS VARCHAR) AS identifier, assurance FROM orders JOIN (VALUES {_EXPECTED}) AS p(i, op, authority, kind, assurance) ON o_orderkey % {len(_PATHS)} = i")
def receipt_authorities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every authority's response by every path that its identifier may be found at."""
    at = (F.col("o_orderkey") % len(_PATHS) + 1).cast("int")
    shapes, operations = F.array(*(F.lit(_nested(path)) for _, _, path, _, _ in _PATHS)), F.array(*(F.lit(op) for op, *_ in _PATHS))
    made = table(spark, sf_dir, "orders").select("o_orderkey", F.element_at(operations, at).alias("operation"), F.replace(F.element_at(shapes, at), F.lit("%s"), F.col("o_custkey").cast("string")).alias("response"))
    return bindings.receipts(made).select("o_orderkey", "operation", "receipt.authority", "receipt.kind", "receipt.identifier", "receipt.assurance")


@query("SELECT conv_id AS session_id, role AS tool_name, event_type, count(*) AS n FROM conversations, (VALUES ('tool_start'), ('tool_end')) AS e(event_type) WHERE conv_id % 6 <> 0 GROUP BY ALL")
def adapt_trajectories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as foreign trajectories; those that ended with an error are left out."""
    steps = F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("content")))), lambda s: F.struct(s["role"].alias("role"), s["content"].alias("content")))
    made = table(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("trajectory_id")).agg(steps.alias("steps"))
    made = made.withColumn("error", F.when(F.col("trajectory_id") % 6 == 0, "timeout"))
    return bindings.adapted(made).groupBy("session_id", "tool_name", "event_type").agg(F.count("*").alias("n"))


@query(VIEW + """SELECT arrival, sha256('{"event_type":"' || event_type || '","k":' || k || ',"session_id":"' || session_id || '"}') AS digest FROM tele""")
def body_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.to_json(F.struct("session_id", "k", "event_type", F.struct(F.col("arrival").alias("seq")).alias("integrity")))
    return telemetry(spark, sf_dir).select("arrival", body_digests(line).alias("digest"))
