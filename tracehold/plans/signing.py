"""Queries: signed chain heads over the lines of orders, a trust store, and what the signatures amount to."""

from __future__ import annotations

import hashlib
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from tracehold.functions import ed25519
from tracehold.operators import attestation, chains, signatures
from tracehold.plans.evidence import _STREAMS, linked_lines, streams_of
from tracehold.plans.registry import query
from tracehold.plans.view import table, telemetry
from tracehold.sources.shared import kept

_ROWS = _STREAMS + """, sent AS (SELECT *, l_orderkey // 16 AS o FROM linked JOIN (SELECT l_orderkey, seq, l_shipdate FROM numbered) USING (l_orderkey, seq) WHERE l_partkey % 89 <> 0 AND l_orderkey % 16 = 0),
drawn AS (SELECT *, (o * 7 + seq * (1 + o % 4)) % 40 AS x FROM sent),
placed AS (SELECT *, seq = max(seq) OVER (PARTITION BY stream_id) AS is_last, 'k' || (CASE WHEN x < 28 THEN o % 2 WHEN x < 37 THEN (o + seq // 2) % 2 ELSE x - 35 END) AS signer, l_partkey % 41 = 0 AS corrupt, epoch(l_shipdate) AS signed_at FROM drawn),
signed AS (SELECT *, (is_last AND o % 2 = 0) OR (seq = 2 AND o % 7 = 0) AS final FROM placed WHERE seq % 2 = 0 OR is_last),
results AS (SELECT *, CASE signer WHEN 'k4' THEN 'KEY_UNKNOWN' WHEN 'k2' THEN 'KEY_WRONG_ROLE' WHEN 'k3' THEN 'KEY_REVOKED' ELSE CASE WHEN corrupt THEN 'SIGNATURE_INVALID' WHEN signer = 'k1' AND signed_at > 9.9e8 THEN 'KEY_EXPIRED' ELSE 'VERIFIED' END END AS result FROM signed),
judged2 AS (SELECT *, result IN ('VERIFIED', 'KEY_EXPIRED') AS held FROM results),
reach AS (SELECT s.stream_id, min(s.seq) AS first_seq, max(s.seq) AS last_seq, any_value(v) AS verified_to FROM sent s LEFT JOIN (SELECT stream_id, max(seq) AS v FROM judged2 WHERE held GROUP BY 1) r ON r.stream_id = s.stream_id GROUP BY 1)
"""


def seed_of(key_id: str) -> bytes:
    return hashlib.sha256(f"seed of {key_id}".encode()).digest()


def trust_keys_of(spark: SparkSession) -> DataFrame:
    """k0; its successor k1 with a window; k2 for approvals only; k3 revoked. k4 is unknown."""
    rows = [("k0", ["collector"], None, None, None, None), ("k1", ["collector", "approver"], 0.0, 9.9e8, None, "k0"), ("k2", ["approver"], None, None, None, None), ("k3", ["collector"], None, None, 1.0, None)]
    keys = [(k, bytearray(ed25519.public_key(seed_of(k))), *rest) for k, *rest in rows]
    return spark.createDataFrame(keys, "key_id string, public binary, roles array<string>, not_before double, not_after double, revoked_at double, replaces string")


@F.pandas_udf(BinaryType())
def _public(name: pd.Series) -> pd.Series:
    return pd.Series([ed25519.public_key(seed_of(n)) for n in name])


@F.pandas_udf(BinaryType())
def _signature(key_id: pd.Series, text: pd.Series) -> pd.Series:
    return pd.Series([ed25519.sign(seed_of(k), m.encode()) for k, m in zip(key_id, text, strict=True)])


def attested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chained records that carry the view's sessions, a sixteenth of the orders; written once."""
    return kept(linked_lines(spark, sf_dir, "l_orderkey % 16 = 0"), "attested")


def sent_of(spark: SparkSession, sf_dir: str, linked: DataFrame | None = None) -> DataFrame:
    return (attested(spark, sf_dir) if linked is None else linked).withColumn("o", F.floor(F.col("l_orderkey") / 16))


def signed_of(spark: SparkSession, sf_dir: str, linked: DataFrame | None = None) -> DataFrame:
    """The first, third, ... and last record of some streams, signed by keys in turn; some signatures are tampered with. Written once."""
    sent = sent_of(spark, sf_dir, linked)
    rows = sent.join(sent.groupBy("stream_id").agg(F.max("seq").alias("last")), "stream_id").where("seq % 2 = 0 OR seq = last")
    x = (F.col("o") * 7 + F.col("seq") * (1 + F.col("o") % 4)) % 40
    signer = F.concat(F.lit("k"), F.when(x < 28, F.col("o") % 2).when(x < 37, (F.col("o") + F.floor(F.col("seq") / 2)) % 2).otherwise(x - 35))
    final = ((F.col("seq") == F.col("last")) & (F.col("o") % 2 == 0)) | ((F.col("seq") == 2) & (F.col("o") % 7 == 0))
    rows = rows.select("stream_id", "session_id", "seq", "chain", signer.alias("key_id"), final.alias("final"), F.unix_micros(F.col("l_shipdate").cast("timestamp")).cast("double").alias("us"), (F.col("l_partkey") % 41 == 0).alias("corrupt"))
    text = signatures.message(F.col("stream_id"), F.col("seq"), F.col("chain"), F.col("final"))
    text = F.when(F.col("corrupt"), F.concat(text, F.lit("?"))).otherwise(text)
    rows = rows.withColumn("text", text).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), F.xxhash64("text"))
    return kept(rows.withColumns({"sig": _signature("key_id", "text"), "ts": F.col("us") / 1e6}).drop("us", "corrupt", "text"), "signed")


def results_of(spark: SparkSession, sf_dir: str, linked: DataFrame | None = None) -> DataFrame:
    return signatures.results(signed_of(spark, sf_dir, linked), trust_keys_of(spark))


@query(_ROWS + "SELECT stream_id, seq, signer AS key_id, result FROM results")
def signature_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return results_of(spark, sf_dir).select("stream_id", "seq", "key_id", "result")


@query(_ROWS + "SELECT * FROM reach")
def signature_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    linked = attested(spark, sf_dir)
    return signatures.ranges(sent_of(spark, sf_dir, linked), results_of(spark, sf_dir, linked))


@query(_ROWS + "SELECT session_id, round(sum(CASE WHEN verified_to IS NULL THEN 0 ELSE greatest(least(verified_to, last_seq) - first_seq + 1, 0) END) / sum(last_seq - first_seq + 1), 6) AS coverage, bool_and(coalesce(verified_to >= last_seq, FALSE)) AS covers_final FROM (SELECT DISTINCT session_id, stream_id FROM sent) JOIN reach USING (stream_id) GROUP BY 1")
def signature_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    linked = attested(spark, sf_dir)
    sent = sent_of(spark, sf_dir, linked)
    return signatures.session_reach(sent, signatures.ranges(sent, results_of(spark, sf_dir, linked)))


_AS_OF, _MAX_AGE = 1.0e9, 2.05e8
#: After _ROWS: the code table of the view's sessions.
_CODES = f""", changes AS (SELECT session_id, stream_id, seq, signer FROM (SELECT *, bool_or(signer = 'k1') OVER (PARTITION BY stream_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS passed FROM judged2 WHERE held) WHERE signer = 'k0' AND passed),
closing AS (SELECT stream_id, min(seq) FILTER (held) AS closed_at FROM judged2 WHERE final GROUP BY 1),
feeds AS (SELECT DISTINCT session_id, stream_id FROM records WHERE CAST(substr(stream_id, 2) AS BIGINT) % 16 = 0),
old AS (SELECT stream_id, seq AS last_seq, CASE WHEN l_orderkey % 58 = 0 THEN sha256(chain) ELSE chain END AS head FROM linked WHERE l_orderkey % 29 = 0 AND seq = 0 AND l_partkey % 89 <> 0),
bare AS (SELECT DISTINCT 'u' || user_id || '-w' || CAST(floor(epoch_us(ts) / 1e6 / 604800) AS BIGINT) AS session_id FROM events WHERE user_id % 10 = 9),
sessions AS (SELECT DISTINCT 'u' || user_id || '-w' || CAST(floor(epoch_us(ts) / 1e6 / 604800) AS BIGINT) AS session_id FROM events UNION SELECT session_id FROM feeds),
every AS (SELECT session_id, code, n FROM codes WHERE session_id LIKE 'u%'
  UNION ALL SELECT session_id, result, count(*) FROM judged2 WHERE result <> 'VERIFIED' GROUP BY ALL
  UNION ALL SELECT session_id, 'STREAM_KEY_CHANGED', count(*) FROM changes GROUP BY 1
  UNION ALL SELECT session_id, CASE WHEN {_AS_OF} - signed_at > {_MAX_AGE} THEN 'STALE' ELSE 'FROM_FUTURE' END, count(*) FROM judged2 WHERE held AND ({_AS_OF} - signed_at > {_MAX_AGE} OR {_AS_OF} - signed_at < -300) GROUP BY ALL
  UNION ALL SELECT session_id, 'RECORDS_AFTER_CLOSE', count(*) FROM records r JOIN closing c ON c.stream_id = r.stream_id WHERE seq > closed_at GROUP BY 1
  UNION ALL SELECT session_id, 'STREAM_NOT_CLOSED', count(*) FROM feeds f LEFT JOIN closing c USING (stream_id) WHERE closed_at IS NULL GROUP BY 1
  UNION ALL SELECT session_id, 'CLOSE_UNVERIFIED', count(*) FROM feeds f JOIN closing c USING (stream_id) WHERE closed_at IS NULL GROUP BY 1
  UNION ALL SELECT f.session_id, CASE WHEN w.after <> o.head THEN 'STREAM_FORKED' ELSE 'STREAM_REPLAYED' END, count(*) FROM feeds f JOIN old o USING (stream_id) JOIN summary s USING (stream_id) LEFT JOIN walk w ON w.stream_id = f.stream_id AND w.seq = o.last_seq WHERE s.first_seq <= o.last_seq GROUP BY ALL
  UNION ALL SELECT f.session_id, 'STREAM_SKIPPED_RECORDS', count(*) FROM feeds f JOIN old o USING (stream_id) JOIN summary s USING (stream_id) WHERE s.first_seq > o.last_seq + 1 GROUP BY 1
  UNION ALL SELECT f.session_id, CASE WHEN s.first_prev IS NULL THEN 'STREAM_BOUNDARY_UNVERIFIED' ELSE 'STREAM_FORKED' END, count(*) FROM feeds f JOIN old o USING (stream_id) JOIN summary s USING (stream_id) WHERE s.first_seq = o.last_seq + 1 AND (s.first_prev IS NULL OR s.first_prev <> o.head) GROUP BY ALL
  UNION ALL SELECT session_id, 'PARTIAL_INTEGRITY', 1 FROM bare SEMI JOIN feeds USING (session_id)),
table_ AS (SELECT session_id, code, CAST(sum(n) AS BIGINT) AS n FROM every GROUP BY ALL),
bad AS (SELECT session_id, string_agg(code, ',' ORDER BY code) AS codes FROM table_ WHERE code IN ({', '.join(f"'{c}'" for c in chains.INADMISSIBLE)}) GROUP BY 1),
spans AS (SELECT stream_id, min(seq) AS first_seq, max(seq) AS last_seq, any_value(v) AS verified_to FROM records r LEFT JOIN (SELECT stream_id, max(seq) AS v FROM judged2 WHERE held GROUP BY 1) USING (stream_id) WHERE CAST(substr(stream_id, 2) AS BIGINT) % 16 = 0 GROUP BY 1),
covers AS (SELECT session_id, bool_and(coalesce(verified_to >= last_seq, FALSE)) AS covers_final, sum(CASE WHEN verified_to IS NULL THEN 0 ELSE greatest(least(verified_to, last_seq) - first_seq + 1, 0) END) / sum(last_seq - first_seq + 1) AS coverage FROM feeds JOIN spans USING (stream_id) GROUP BY 1),
stood AS (SELECT s.session_id, CASE WHEN covers_final IS NULL THEN 'unattested' WHEN codes IS NOT NULL THEN 'inadmissible' WHEN t.session_id IS NULL THEN 'chained_unsigned' WHEN covers_final THEN 'verified_complete' ELSE 'verified_prefix' END AS status, coverage, covers_final, codes FROM sessions s LEFT JOIN covers USING (session_id) LEFT JOIN bad USING (session_id) LEFT JOIN (SELECT DISTINCT session_id FROM judged2 WHERE result NOT IN ('KEY_UNKNOWN', 'KEY_WRONG_ROLE', 'KEY_REVOKED')) t USING (session_id))"""


COVERED = _ROWS + _CODES + " SELECT session_id, covers_final, round(coverage, 6) AS coverage FROM covers"
TRIED = _ROWS + " SELECT session_id, bool_or(result NOT IN ('KEY_UNKNOWN', 'KEY_WRONG_ROLE', 'KEY_REVOKED')) AS tried, bool_or(held) AS held FROM judged2 GROUP BY 1"


class Evidence(NamedTuple):
    """What the collectors' streams say about the view's sessions."""

    records: DataFrame
    found: DataFrame
    spans: DataFrame
    codes: DataFrame


def evidence_of(spark: SparkSession, sf_dir: str) -> Evidence:
    """The records of the streams that carry the view's sessions, their signatures, how far these reach, and all codes; written once."""
    linked = attested(spark, sf_dir)
    records = streams_of(spark, sf_dir, linked)
    found = kept(results_of(spark, sf_dir, linked), "signatures")
    old = linked.where("l_orderkey % 29 = 0 AND seq = 0").select("stream_id", F.lit(0).alias("first_seq"), F.col("seq").alias("last_seq"), F.when(F.col("l_orderkey") % 58 == 0, F.sha2("chain", 256)).otherwise(F.col("chain")).alias("head"), F.lit(False).alias("closed"))
    bare = telemetry(spark, sf_dir).where("user_id % 10 = 9").select("session_id")
    walked = chains.verified(records, None).select("session_id", "prev_session_id", "stream_id", "seq", "prev", "after", "broken", "gap", "unanchored", "midstream")
    codes = attestation.codes(records, found, trust_keys_of(spark), old, bare, _AS_OF, _MAX_AGE, walked=kept(walked, "walked"))
    return Evidence(records, found, signatures.ranges(records, found), kept(codes, "codes"))


def sessions_of(spark: SparkSession, sf_dir: str, e: Evidence) -> DataFrame:
    """The sessions that have an event of the view or a record of a stream."""
    return telemetry(spark, sf_dir).select("session_id").union(e.records.select("session_id")).distinct()


@query(_ROWS + _CODES + " SELECT * FROM table_")
def evidence_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every code of chains, signatures, keys, freshness, closure, ledger and missing sidecars, per session."""
    return evidence_of(spark, sf_dir).codes


@query(_ROWS + _CODES + " SELECT session_id, status FROM stood")
def signed_evidence_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The status of every session of the view; one with any inadmissible code is never verified."""
    e = evidence_of(spark, sf_dir)
    return attestation.status(sessions_of(spark, sf_dir, e), e.records, e.found, e.codes)


@query(_ROWS + _CODES + " SELECT session_id, codes, 'critical' AS severity FROM bad")
def ch06_integrity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return attestation.ch06_integrity(evidence_of(spark, sf_dir).codes)


@query(_ROWS + "SELECT stream_id, seq, 'k1' AS from_key_id, signer AS to_key_id FROM (SELECT *, bool_or(signer = 'k1') OVER (PARTITION BY stream_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS passed FROM judged2 WHERE held) WHERE signer = 'k0' AND passed")
def key_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """k1 may follow k0, but k0 not k1."""
    return signatures.key_changes(results_of(spark, sf_dir), trust_keys_of(spark)).drop("session_id")


@query(_ROWS + """, ends AS (SELECT stream_id, min(seq) FILTER (held) AS closed_at, TRUE AS final_seen FROM judged2 WHERE final GROUP BY 1)
SELECT stream_id, any_value(closed_at) AS closed_at, count_if(coalesce(seq > closed_at, FALSE)) AS n_after_close, concat_ws(',', CASE WHEN count_if(coalesce(seq > closed_at, FALSE)) > 0 THEN 'RECORDS_AFTER_CLOSE' END, CASE WHEN any_value(closed_at) IS NULL THEN 'STREAM_NOT_CLOSED' END, CASE WHEN any_value(closed_at) IS NULL AND any_value(final_seen) THEN 'CLOSE_UNVERIFIED' END, CASE WHEN any_value(closed_at) IS NULL THEN 'STREAM_END_MISSING' END) AS codes FROM sent LEFT JOIN ends USING (stream_id) GROUP BY 1""")
def stream_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    linked = attested(spark, sf_dir)
    return signatures.closure(sent_of(spark, sf_dir, linked), results_of(spark, sf_dir, linked), required=True)


@query("SELECT 'key-' || n_name AS key_id, CASE n_regionkey % 2 WHEN 0 THEN 'collector' ELSE 'collector,approver' END AS roles, CAST(n_nationkey * 1000 AS DOUBLE) AS not_before, CASE WHEN n_nationkey % 5 = 0 THEN 1.0e9::DOUBLE END AS revoked_at, CASE WHEN n_nationkey % 3 = 1 THEN 'key-' || (SELECT any_value(m.n_name) FROM nation m WHERE m.n_nationkey = nation.n_nationkey - 1) END AS replaces FROM nation")
def trust_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A trust store as one JSON document, a key per nation."""
    nation = table(spark, sf_dir, "nation")
    before = nation.select((F.col("n_nationkey") + 1).alias("n_nationkey"), F.concat(F.lit("key-"), "n_name").alias("previous"))
    n = F.col("n_nationkey")
    key = F.struct(
        F.base64(_public("n_name")).alias("key"), F.when(F.col("n_regionkey") % 2 == 0, F.array(F.lit("collector"))).otherwise(F.array(F.lit("collector"), F.lit("approver"))).alias("roles"),
        (n * 1000).cast("double").alias("not_before"), F.when(n % 5 == 0, 1.0e9).alias("revoked_at"), F.when(n % 3 == 1, F.col("previous")).alias("replaces"),
    )
    rows = nation.join(before, "n_nationkey", "left").select(F.struct(F.concat(F.lit("key-"), "n_name").alias("key"), key.alias("value")).alias("entry"))
    text = rows.agg(F.to_json(F.struct(F.map_from_entries(F.collect_list("entry")).alias("keys"))).alias("value"))
    return signatures.trust_store(spark, text).select("key_id", F.array_join("roles", ",").alias("roles"), "not_before", "revoked_at", "replaces")
