"""Agent telemetry derived from the given tables, in Spark and as the same view in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracehold.operators import attestation


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One event per row of `events`: weekly sessions of a user, three tools, policy events, costs and scanner flags.

    Clocks of a seventh of the events run two hours behind their arrival. Some marked events call a tool that no other
    session knows.
    """
    kind = F.col("event_type")
    k = F.get_json_object("props", "$.k").cast("long")
    marked = F.when(k % 3 == 0, F.lit(None).cast("boolean")).otherwise(k % 2 == 0)
    return table(spark, sf_dir, "events").select(
        F.concat(F.lit("u"), "user_id", F.lit("-w"), F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1e6 / 604800)).alias("session_id"),
        F.col("event_id").alias("arrival"),
        (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6 - F.when(k % 7 == 0, 7200).otherwise(0)).alias("ts"),
        F.when(kind.isin("view", "purchase"), "tool_start").when(kind == "click", "tool_end").when(kind == "signup", F.when(k < 20, "tool_error").otherwise("tool_end")).otherwise("cost_threshold_exceeded").alias("event_type"),
        F.when(kind.isin("view", "click"), "fetch_page").when(kind.isin("purchase", "signup") & marked & (k % 20 == 4), "wipe_payment").when(kind.isin("purchase", "signup"), "send_payment").alias("tool_name"),
        F.lit(None).cast("string").alias("span_id"),
        F.col("value").alias("cost"), "user_id", k.alias("k"),
        F.concat(F.lit("agent"), k % 10).alias("agent_name"),
        marked.alias("marked"), F.concat(F.lit("sha256:"), F.sha2(F.floor(k / 25).cast("string"), 256)).alias("arg_digest"),
        F.concat(F.lit("h"), F.col("user_id") % 7).alias("host"), F.concat(F.lit("c"), k % 3, F.lit("-"), F.col("user_id") % 7).alias("stream_id"), F.col("event_id").alias("seq"),
    )


def positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The view's events with their verified positions: two of three streams of a host are signed now and then, and some sessions miss records."""
    events = telemetry(spark, sf_dir)
    spans = events.where("k % 25 = 7 AND k % 3 < 2").groupBy("stream_id").agg(F.max("seq").alias("verified_to"))
    return attestation.positions(events, spans, events.where("k % 50 = 13").select("session_id", F.lit("SEQUENCE_GAP").alias("code")))


VIEW = """WITH tele AS (
  SELECT 'u' || user_id || '-w' || CAST(floor(epoch_us(ts) / 1e6 / 604800) AS BIGINT) AS session_id, event_id AS arrival, epoch_us(ts) / 1e6 - CASE WHEN k % 7 = 0 THEN 7200 ELSE 0 END AS ts,
    CASE WHEN event_type IN ('view', 'purchase') THEN 'tool_start' WHEN event_type = 'click' THEN 'tool_end' WHEN event_type = 'signup' THEN CASE WHEN k < 20 THEN 'tool_error' ELSE 'tool_end' END ELSE 'cost_threshold_exceeded' END AS event_type,
    CASE WHEN event_type IN ('view', 'click') THEN 'fetch_page' WHEN event_type IN ('purchase', 'signup') AND k % 3 <> 0 AND k % 20 = 4 THEN 'wipe_payment' WHEN event_type IN ('purchase', 'signup') THEN 'send_payment' END AS tool_name,
    value AS cost, user_id, k, 'agent' || (k % 10) AS agent_name, CASE WHEN k % 3 = 0 THEN NULL ELSE k % 2 = 0 END AS marked, 'sha256:' || sha256(CAST(k // 25 AS VARCHAR)) AS arg_digest, 'h' || (user_id % 7) AS host, 'c' || (k % 3) || '-' || (user_id % 7) AS stream_id, event_id AS seq
  FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events))
"""

#: Calls of the view: first in, first out by name.
CALLS = (
    VIEW
    + """, reach AS (SELECT stream_id, max(seq) AS verified_to FROM tele WHERE k % 25 = 7 AND k % 3 < 2 GROUP BY 1),
pos AS (SELECT t.arrival, session_id, event_type, marked, ts, CASE WHEN good THEN stream_id END AS at_stream, CASE WHEN good THEN seq END AS at_seq FROM (SELECT t.*, coalesce(seq <= verified_to, FALSE) AND session_id NOT IN (SELECT session_id FROM tele WHERE k % 50 = 13) AS good FROM tele t LEFT JOIN reach USING (stream_id)) t),
tool AS (SELECT *, sum(CASE WHEN event_type = 'tool_start' THEN 1 ELSE -1 END) OVER (PARTITION BY session_id, tool_name ORDER BY ts, arrival) AS level FROM tele WHERE tool_name IS NOT NULL),
walked AS (SELECT *, least(coalesce(min(level) OVER (PARTITION BY session_id, tool_name ORDER BY ts, arrival ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 0) AS low FROM tool),
kinds AS (SELECT *, CASE WHEN event_type = 'tool_start' THEN 'start' WHEN level < low THEN 'orphan' ELSE 'end' END AS kind FROM walked),
ranked AS (SELECT *, row_number() OVER (PARTITION BY session_id, tool_name, kind ORDER BY ts, arrival) AS nth FROM kinds),
calls AS (
  SELECT s.session_id, s.tool_name AS name, CASE WHEN e.arrival IS NULL THEN 'open' ELSE 'complete' END AS state, coalesce(e.event_type = 'tool_end', FALSE) AS executed,
    s.ts AS start_ts, s.arrival AS start_arrival, e.ts AS end_ts, e.arrival AS end_arrival, s.cost
  FROM ranked s LEFT JOIN ranked e ON e.kind = 'end' AND e.session_id = s.session_id AND e.tool_name = s.tool_name AND e.nth = s.nth WHERE s.kind = 'start'
  UNION ALL SELECT session_id, tool_name, 'orphan_end', FALSE, NULL, NULL, ts, arrival, NULL FROM ranked WHERE kind = 'orphan')
, classed AS (SELECT *, CASE name WHEN 'send_payment' THEN 'egress' WHEN 'fetch_page' THEN 'read_only' WHEN 'wipe_payment' THEN 'state_change' ELSE 'unknown' END AS class, name IN ('send_payment', 'wipe_payment') AS consequential, at_stream AS start_stream, at_seq AS start_seq FROM calls LEFT JOIN (SELECT arrival AS start_arrival, at_stream, at_seq FROM pos) USING (start_arrival))
"""
)
