"""Approvals and receipts of the view's calls, in Spark and as the same rows in DuckDB SQL."""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from tracehold.functions import ed25519
from tracehold.operators import approvals, bindings
from tracehold.sources.shared import kept

SCHEME = "receipt/1"

#: After CALLS. granted: approvals of two thirds of the calls; receipted: complete calls with their receipts' fields.
CLAIMS = """, spanned AS (SELECT session_id, 'sp' || start_arrival AS span_id, name, class, consequential, state, executed, 'sha256:' || sha256(CAST(start_arrival AS VARCHAR)) AS arg_digest, start_ts, start_arrival, start_stream, start_seq FROM classed WHERE start_arrival IS NOT NULL),
granted AS (SELECT session_id, 'sp' || (start_arrival + CASE WHEN start_arrival % 13 = 0 THEN 100000000 ELSE 0 END) AS span_id, CASE WHEN start_arrival % 10 = 1 THEN 'other' WHEN start_arrival % 10 = 2 THEN NULL ELSE name END AS tool_id, CASE start_arrival % 3 WHEN 0 THEN arg_digest WHEN 1 THEN NULL ELSE 'sha256:' || sha256('x') END AS granted_digest, CASE WHEN start_arrival % 7 = 0 THEN 'deny' ELSE 'allow' END AS decision, start_ts - 60 AS granted_at, CASE WHEN start_arrival % 4 = 0 THEN start_ts - 30 ELSE start_ts + 600 END AS expires_at, start_ts - CASE WHEN start_arrival % 9 = 0 THEN -5 WHEN start_arrival % 9 = 1 THEN 0 ELSE 20 END AS observed_at, CASE WHEN start_arrival % 5 < 2 THEN start_stream END AS observed_stream, start_seq + CASE WHEN start_arrival % 5 = 0 THEN -1 WHEN start_arrival % 2 = 0 THEN 0 ELSE 1 END AS observed_seq FROM spanned WHERE start_arrival % 2 = 0 OR start_arrival % 3 = 0),
matches AS (SELECT s.session_id, s.span_id, s.start_ts, decision, observed_at, CASE WHEN granted_digest <> arg_digest THEN 'arg_mismatch' WHEN granted_digest = arg_digest AND tool_id IS NOT NULL THEN 'bound' ELSE 'bound_span_only' END AS binding, granted_at <= start_ts AND start_ts <= expires_at AS in_window, CASE WHEN observed_stream = start_stream THEN observed_seq < start_seq ELSE observed_at <= start_ts END AS observed_before FROM spanned s JOIN granted g ON s.session_id = g.session_id AND s.span_id = g.span_id WHERE tool_id IS NULL OR tool_id = name),
states AS (SELECT s.session_id, s.start_arrival, list_extract(['denied', 'covered', 'unassured', 'arg_mismatch', 'expired', 'span_only', 'none'], min(CASE WHEN decision = 'deny' AND binding = 'bound' THEN 1 WHEN decision = 'allow' AND binding = 'bound' AND observed_before AND in_window THEN 2 WHEN binding = 'arg_mismatch' THEN 4 WHEN NOT in_window THEN 5 WHEN binding = 'bound_span_only' THEN 6 ELSE 7 END)) AS approval FROM spanned s LEFT JOIN matches m ON s.session_id = m.session_id AND s.span_id = m.span_id GROUP BY ALL),
stated AS (SELECT *, CASE WHEN start_arrival % 8 NOT IN (4, 5, 6) THEN CASE WHEN start_arrival % 8 = 3 THEN 'elsewhere' ELSE span_id END END AS b_span, CASE WHEN start_arrival % 8 NOT IN (4, 5, 6) THEN name END AS b_tool, CASE WHEN start_arrival % 8 IN (0, 3, 7) THEN arg_digest WHEN start_arrival % 8 = 2 THEN 'sha256:' || sha256('y') END AS b_digest, CASE WHEN start_arrival % 8 = 7 THEN NULL ELSE list_extract(['operation', 'object', 'client'], start_arrival % 3 + 1) END AS assurance FROM spanned WHERE state = 'complete' AND class <> 'read_only'),
receipted AS (SELECT *, CASE WHEN b_span IS NULL THEN NULL WHEN b_span <> span_id THEN 'unbound' WHEN b_digest <> arg_digest THEN 'arg_mismatch' WHEN b_digest IS NOT NULL THEN 'bound' ELSE 'bound_span_only' END AS receipt_binding FROM stated)"""

#: CLAIMS with the receipts of all complete calls, read-only ones too.
ALL_RECEIPTS = CLAIMS.replace(" AND class <> 'read_only'", "")


def spanned(calls: DataFrame) -> DataFrame:
    """Started calls with a span and an argument digest of their own."""
    n = F.col("start_arrival")
    return calls.where("start_arrival IS NOT NULL").select("session_id", F.concat(F.lit("sp"), n).alias("span_id"), "name", "class", "consequential", "state", "executed", F.concat(F.lit("sha256:"), F.sha2(n.cast("string"), 256)).alias("arg_digest"), "start_ts", "start_arrival", "start_stream", "start_seq")


def granted(calls: DataFrame) -> DataFrame:
    """Approvals of two thirds of spanned() calls: some for other spans, tools or arguments, some denied, expired or late."""
    n = F.col("start_arrival")
    return calls.where((n % 2 == 0) | (n % 3 == 0)).select(
        "session_id", F.concat(F.lit("sp"), n + F.when(n % 13 == 0, 100_000_000).otherwise(0)).alias("span_id"),
        F.when(n % 10 == 1, "other").when(n % 10 == 2, F.lit(None)).otherwise(F.col("name")).alias("tool_id"),
        F.when(n % 3 == 0, F.col("arg_digest")).when(n % 3 == 1, F.lit(None)).otherwise(F.concat(F.lit("sha256:"), F.sha2(F.lit("x"), 256))).alias("arg_digest"),
        F.when(n % 7 == 0, "deny").otherwise("allow").alias("decision"), (F.col("start_ts") - 60).alias("granted_at"),
        F.when(n % 4 == 0, F.col("start_ts") - 30).otherwise(F.col("start_ts") + 600).alias("expires_at"),
        (F.col("start_ts") - F.when(n % 9 == 0, -5).when(n % 9 == 1, 0).otherwise(20)).alias("observed_at"),
        F.when(n % 5 < 2, F.col("start_stream")).alias("observed_stream"), (F.col("start_seq") + F.when(n % 5 == 0, -1).when(n % 2 == 0, 0).otherwise(1)).alias("observed_seq"),
    )


#: After CLAIMS: approvals with what their signatures and nonces make of them.
SIGNED = """, issued AS (SELECT *, CASE n % 8 WHEN 4 THEN 'a1' WHEN 5 THEN 'a2' WHEN 6 THEN 'a4' WHEN 7 THEN NULL ELSE 'a0' END AS key_id, CASE WHEN n % 23 = 0 THEN NULL WHEN n % 10 = 4 THEN 'n' || (n // 100) ELSE 'n-' || n END AS nonce FROM (SELECT *, CAST(substr(span_id, 3) AS BIGINT) % 100000000 AS n FROM granted)),
proved AS (SELECT *, coalesce(key_id, '') IN ('a0', 'a4') AND n % 17 <> 0 AND (key_id = 'a0' OR granted_at <= 1.7045e9) AS verified FROM issued),
used AS (SELECT *, CASE WHEN verified AND nonce IS NOT NULL THEN row_number() OVER (PARTITION BY nonce, verified ORDER BY n) = 1 AND NOT (n % 10 <> 4 AND n % 29 = 0) END AS unspent FROM proved),
worth AS (SELECT *, CASE WHEN verified AND coalesce(unspent, FALSE) THEN 'single_use' WHEN verified THEN 'authenticated' WHEN tool_id IS NOT NULL AND granted_digest IS NOT NULL THEN 'bound' ELSE 'claimed' END AS tier, verified AND coalesce(unspent, TRUE) AS assured FROM used)"""


def seed_of(key_id: str) -> bytes:
    return hashlib.sha256(f"approver {key_id}".encode()).digest()


@F.pandas_udf(BinaryType())
def _signature(key_id: pd.Series, text: pd.Series) -> pd.Series:
    return pd.Series([ed25519.sign(seed_of(k), m.encode()) if isinstance(k, str) else None for k, m in zip(key_id, text, strict=True)])


def approver_keys(spark: SparkSession) -> DataFrame:
    """a0; a1 revoked; a2 for telemetry only; a4 with an end. a3 is unknown."""
    rows = [("a0", ["approver"], None, None, None), ("a1", ["approver"], None, None, 1.0), ("a2", ["collector"], None, None, None), ("a4", ["approver"], 0.0, 1.7045e9, None)]
    return spark.createDataFrame([(k, bytearray(ed25519.public_key(seed_of(k))), *rest) for k, *rest in rows], "key_id string, public binary, roles array<string>, not_before double, not_after double, revoked_at double")


def signed(calls: DataFrame) -> DataFrame:
    """granted() approvals of spanned() calls as issuers sent them: some of keys that do not count, some altered, some nonces used again."""
    n = F.substring("span_id", 3, 20).cast("long") % 100_000_000
    rows = granted(calls).withColumn("arrival", n)
    n = F.col("arrival")
    key = F.when(n % 8 == 4, "a1").when(n % 8 == 5, "a2").when(n % 8 == 6, "a4").when(n % 8 != 7, "a0")
    nonce = F.when(n % 23 == 0, F.lit(None)).when(n % 10 == 4, F.concat(F.lit("n"), F.floor(n / 100))).otherwise(F.concat(F.lit("n-"), n))
    rows = rows.withColumns({"key_id": key, "nonce": nonce})
    text = approvals.message(*approvals.FIELDS)
    return kept(rows.withColumn("sig", _signature("key_id", F.when(n % 17 == 0, F.concat(text, F.lit("?"))).otherwise(text))), "approvals")


def judged(calls: DataFrame) -> DataFrame:
    """signed() approvals and what they are worth, after runs in which some nonces were used."""
    rows = signed(calls)
    before = rows.where("arrival % 10 <> 4 AND arrival % 29 = 0 AND nonce IS NOT NULL").select("nonce")
    return approvals.judged(rows, approver_keys(calls.sparkSession), before)


def approval_states(calls: DataFrame) -> DataFrame:
    """spanned() calls with the state of their approvals."""
    own = spanned(calls)
    return bindings.approval_states(own, bindings.approval_matches(own, granted(own)))


def with_receipts(calls: DataFrame) -> DataFrame:
    """Complete calls that may have effects, with all_receipts() of them."""
    return all_receipts(calls.where("class <> 'read_only'"))


def all_receipts(calls: DataFrame) -> DataFrame:
    """Complete calls with parsed receipts: sound ones, for other arguments or spans, without digest, of no scheme, naming nothing, or of odd assurance."""
    rest, own = F.col("start_arrival") % 8, spanned(calls).where("state = 'complete'")
    named = F.struct(
        F.when(rest == 3, "elsewhere").when(rest != 6, F.col("span_id")).alias("span_id"), F.when(rest != 6, F.col("name")).alias("tool_id"),
        F.when(rest.isin(0, 3, 5, 7), F.col("arg_digest")).when(rest == 2, F.concat(F.lit("sha256:"), F.sha2(F.lit("y"), 256))).alias("arg_digest"),
    )
    stated = F.when(rest == 7, "surely").otherwise(F.element_at(F.array(F.lit("operation"), F.lit("object"), F.lit("client")), (F.col("start_arrival") % 3 + 1).cast("int")))
    made = F.to_json(F.struct(F.when(rest == 5, "receipt/0").otherwise(SCHEME).alias("scheme"), F.lit("payments").alias("authority"), F.lit("charge").alias("kind"), F.concat(F.lit("ch"), "start_arrival").alias("identifier"), named.alias("binding"), stated.alias("assurance")))
    parsed = bindings.parsed_receipts(own.withColumn("receipt", F.when(rest != 4, made)), SCHEME)
    bound = parsed.withColumn("receipt_binding", bindings.receipt_binding(F.col("span_id"), F.col("name"), F.col("arg_digest")))
    return bound.withColumn("receipt_rank", bindings.receipt_tier(F.col("receipt_binding")))
