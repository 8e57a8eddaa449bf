"""Queries: calls and detections over the telemetry view."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracehold.functions.names import tool_class
from tracehold.operators import detect
from tracehold.operators.pairing import pair_calls
from tracehold.plans import claims
from tracehold.plans.claims import ALL_RECEIPTS, CLAIMS
from tracehold.plans.registry import query
from tracehold.plans.view import CALLS, VIEW, positions, table, telemetry
from tracehold.sources.shared import kept


def calls_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The view's calls, paired once and written: most queries read them several times."""
    return kept(detect.with_positions(detect.classified(pair_calls(telemetry(spark, sf_dir))), positions(spark, sf_dir)), "calls")


def benign_grammar(spark: SparkSession, sf_dir: str, calls: DataFrame | None = None) -> DataFrame:
    """Transitions of the sessions in which no scanner marked anything and no control spoke."""
    suspect = telemetry(spark, sf_dir).where(F.col("marked") | F.col("event_type").isin(*detect.POLICY_TYPES)).select("session_id").distinct()
    calls = calls_of(spark, sf_dir) if calls is None else calls
    return kept(detect.grammar(calls.join(suspect, "session_id", "left_anti")), "grammar")


def with_arguments(calls: DataFrame, events: DataFrame) -> DataFrame:
    """calls with the argument digest of their start."""
    if "arg_digest" in calls.columns:
        return calls
    return calls.join(events.select(F.col("arrival").alias("start_arrival"), "arg_digest"), "start_arrival", "left")


def enforcement(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("cost_threshold_exceeded", "blocking")], "event_type string, enforcement string")


def cited(events: DataFrame) -> DataFrame:
    """events with the policy_id that their policy events cite."""
    return events.withColumn("policy_id", F.when(F.col("event_type").isin(*detect.POLICY_TYPES), F.concat(F.lit("p"), F.col("k") % 3)))


def declared(spark: SparkSession) -> DataFrame:
    """The controls that the manifest declares: two of the three that events cite."""
    return spark.createDataFrame([("p0",), ("p1",)], "policy_id string")


_STEPS = ", ordered AS (SELECT c.*, arg_digest, coalesce(start_ts, end_ts) AS clk, coalesce(start_arrival, end_arrival) AS pos FROM classed c LEFT JOIN (SELECT arrival AS start_arrival, arg_digest FROM tele) USING (start_arrival)), steps AS (SELECT session_id, coalesce(lag(name) OVER w, '<start>') AS prev, name AS next, consequential, coalesce(lag(name) OVER w = name AND NOT lag(executed) OVER w AND lag(arg_digest) OVER w = arg_digest, FALSE) AS is_retry, lead(name) OVER w IS NULL AS is_last FROM ordered WINDOW w AS (PARTITION BY session_id ORDER BY clk, pos)), trans AS (SELECT session_id, prev, next, consequential, is_retry FROM steps UNION ALL SELECT session_id, next, '<end>', FALSE, FALSE FROM steps WHERE is_last), grammar AS (SELECT prev, next, count(*) AS n FROM trans WHERE session_id NOT IN (SELECT session_id FROM tele WHERE marked OR event_type IN ('cost_threshold_exceeded', 'depth_exceeded')) GROUP BY ALL)"


@query(CALLS + "SELECT session_id, name, state, executed, start_ts, start_arrival, end_ts, end_arrival, cost FROM calls")
def tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pair_calls(telemetry(spark, sf_dir)).drop("span_id")


@query()
def tool_calls_spanned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same events with spans on the starts and ends of users with an odd id."""
    span = F.when((F.col("user_id") % 2 == 1) & F.col("tool_name").isNotNull(), F.concat(F.lit("s"), F.floor(F.col("ts") / 7200)))
    return pair_calls(telemetry(spark, sf_dir).withColumn("span_id", span))


@query(CALLS + "SELECT session_id, string_agg(name, ',' ORDER BY coalesce(start_ts, end_ts), coalesce(start_arrival, end_arrival)) AS tools, count(*) AS n_calls FROM calls GROUP BY session_id")
def tool_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls = pair_calls(telemetry(spark, sf_dir)).select("session_id", F.struct(*detect.call_clock(), "name").alias("call"))
    return calls.groupBy("session_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("call")), lambda c: c["name"]), ",").alias("tools"), F.count("*").alias("n_calls"))


@query(CALLS + "SELECT session_id, name, class, class_source, count(*) AS n FROM (SELECT *, CASE WHEN class = 'unknown' THEN 'unclassified' ELSE 'name_heuristic' END AS class_source FROM classed) GROUP BY ALL")
def classified_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calls_of(spark, sf_dir).groupBy("session_id", "name", "class", "class_source").agg(F.count("*").alias("n"))


_WORDS = "list_filter(string_split_regex(lower({0}), '[^a-z0-9]+'), lambda t: t <> '')"


def _hit(keywords: tuple[str, ...]) -> str:
    whole = "list_has_any(w, [" + ", ".join(f"'{k}'" for k in keywords if "_" not in k) + "])"
    return "(" + " OR ".join([whole, *(f"contains(array_to_string(w, '_'), '{k}')" for k in keywords if "_" in k)]) + ")"


def _class_sql(source: str) -> str:
    from tracehold.functions import names

    return f"SELECT name, CASE WHEN {_hit(names.EGRESS)} THEN 'egress' WHEN {_hit(names.STATE_CHANGE)} THEN 'state_change' WHEN {_hit(names.READ_ONLY)} THEN 'read_only' ELSE 'unknown' END AS class FROM (SELECT name, {_WORDS.format('name')} AS w FROM ({source}))"


_TOOL_NAMES = "SELECT DISTINCT p_name || CASE p_size % 8 WHEN 0 THEN ' get' WHEN 1 THEN '_send-email' WHEN 2 THEN '.Delete' WHEN 3 THEN ' budget' WHEN 4 THEN '_postmortem' WHEN 5 THEN ' send_message' WHEN 6 THEN '/HTTP' ELSE '' END AS name FROM part"


@query(_class_sql(_TOOL_NAMES))
def tool_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    endings = (" get", "_send-email", ".Delete", " budget", "_postmortem", " send_message", "/HTTP", "")
    name = F.concat("p_name", F.element_at(F.array(*map(F.lit, endings)), (F.col("p_size") % 8 + 1).cast("int")))
    return table(spark, sf_dir, "part").select(name.alias("name")).distinct().select("name", tool_class(F.col("name")).alias("class"))


@query(CALLS + _STEPS + "SELECT prev, next, n FROM grammar")
def grammar_bigrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return benign_grammar(spark, sf_dir)


@query(CALLS + _STEPS + "SELECT t.session_id, t.prev, t.next, count(*) AS n FROM trans t ANTI JOIN grammar g ON t.prev = g.prev AND t.next = g.next GROUP BY ALL")
def unseen_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls = calls_of(spark, sf_dir)
    return detect.unseen_transitions(calls, benign_grammar(spark, sf_dir, calls)).groupBy("session_id", "prev", "next").agg(F.count("*").alias("n"))


@query(CALLS + _STEPS + """, known AS (SELECT * FROM grammar), vocab AS (SELECT DISTINCT next AS name FROM known WHERE next <> '<end>'),
per AS (SELECT t.session_id, count(*) AS n_transitions, count_if(g.prev IS NULL) AS n_unseen, count_if(g.prev IS NULL AND consequential AND NOT is_retry) AS n_into FROM trans t LEFT JOIN known g ON t.prev = g.prev AND t.next = g.next GROUP BY 1),
shape AS (SELECT session_id, sum(n) AS n_calls, count_if(v.name IS NULL) AS n_novel, count_if(v.name IS NOT NULL) / count(*) AS overlap FROM (SELECT session_id, name, count(*) AS n FROM calls GROUP BY ALL) c LEFT JOIN vocab v ON c.name = v.name GROUP BY 1)
SELECT session_id, n_transitions, n_unseen, round(n_unseen / n_transitions, 6) AS rate, CASE WHEN n_novel > 0 THEN 'high' ELSE 'medium' END AS severity FROM per JOIN shape USING (session_id) WHERE (n_unseen / n_transitions > 0.25 OR n_into >= 1) AND NOT (n_calls >= 3 AND overlap < 0.5)""")
def ch01_sequence_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls = calls_of(spark, sf_dir)
    return detect.ch01_sequence_order(with_arguments(calls, telemetry(spark, sf_dir)), benign_grammar(spark, sf_dir, calls))


def _after(refs: str) -> str:
    """Every call against every reference: after any, else indeterminate with any, by sequence within a verified stream and by clock elsewhere."""
    return f""", refs AS (SELECT session_id, ts, at_stream, at_seq FROM pos WHERE {refs}),
against AS (SELECT c.session_id, c.call_no, CASE WHEN c.start_stream = r.at_stream THEN CASE WHEN c.start_seq > r.at_seq THEN 2 WHEN c.start_seq = r.at_seq THEN 1 ELSE 0 END WHEN c.start_ts > r.ts THEN 2 WHEN c.start_ts IS NULL OR r.ts IS NULL OR c.start_ts = r.ts THEN 1 ELSE 0 END AS o FROM (SELECT *, row_number() OVER (ORDER BY session_id, coalesce(start_arrival, -1), coalesce(end_arrival, -1)) AS call_no FROM classed) c JOIN refs r USING (session_id)),
placed AS (SELECT c.*, list_extract(['not_after', 'indeterminate', 'after'], o + 1) AS position FROM (SELECT *, row_number() OVER (ORDER BY session_id, coalesce(start_arrival, -1), coalesce(end_arrival, -1)) AS call_no FROM classed) c JOIN (SELECT call_no, max(o) AS o FROM against GROUP BY 1) USING (call_no))"""


_MARKED, _POLICY = _after("marked"), _after("event_type = 'cost_threshold_exceeded'")


@query(CALLS + _MARKED + "SELECT session_id, name, position, count(*) AS n FROM placed GROUP BY ALL")
def calls_after_marker(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = detect.ordered_after(calls_of(spark, sf_dir), detect.references(positions(spark, sf_dir), F.col("marked")))
    return placed.groupBy("session_id", "name", "position").agg(F.count("*").alias("n"))


@query(CALLS + _POLICY + "SELECT session_id, name, position, count(*) AS n FROM placed GROUP BY ALL")
def calls_after_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = detect.ordered_after(calls_of(spark, sf_dir), detect.references(positions(spark, sf_dir), F.col("event_type").isin(*detect.POLICY_TYPES)))
    return placed.groupBy("session_id", "name", "position").agg(F.count("*").alias("n"))


_CH03 = "SELECT session_id, kind, n_calls, CASE WHEN kind = 'attempted' THEN 'medium' WHEN egress THEN 'critical' ELSE 'high' END AS severity FROM (SELECT session_id, CASE WHEN executed THEN 'completed' ELSE 'attempted' END AS kind, count(*) AS n_calls, bool_or(class = 'egress') AS egress FROM placed WHERE position = 'after' AND consequential AND start_arrival IS NOT NULL GROUP BY ALL)"


@query(CALLS + _MARKED + _CH03)
def ch03_untrusted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect.ch03_untrusted(calls_of(spark, sf_dir), positions(spark, sf_dir))


_CH04 = _POLICY + CLAIMS + """, judged AS (SELECT p.*, coalesce(approval, 'none') AS approval FROM placed p LEFT JOIN states a ON p.session_id = a.session_id AND p.start_arrival = a.start_arrival WHERE position = 'after' AND consequential AND p.start_arrival IS NOT NULL),
sums AS (SELECT session_id, CASE WHEN bool_or(executed AND approval <> 'covered' AND class = 'egress') THEN 'critical' ELSE 'high' END AS severity, count_if(executed AND approval <> 'covered') AS n_completed, count_if(NOT executed AND approval <> 'covered') AS n_attempted FROM judged GROUP BY 1),
ch04 AS (SELECT session_id, 'cost_threshold_exceeded' AS policy, 'blocking' AS enforcement, 'bypassed' AS kind, severity, n_completed AS n_calls FROM sums WHERE n_completed > 0 UNION ALL SELECT session_id, 'cost_threshold_exceeded', 'blocking', 'attempted', 'medium', n_attempted FROM sums WHERE n_attempted > 0 UNION ALL SELECT session_id, string_agg(DISTINCT 'p' || (k % 3), ','), 'undeclared', 'undeclared', 'medium', count(*) FROM tele WHERE event_type = 'cost_threshold_exceeded' AND k % 3 = 2 GROUP BY 1)"""


def approval_states_of(calls: DataFrame) -> DataFrame:
    return claims.approval_states(calls).select("session_id", "start_arrival", "approval")


@query(CALLS + _CH04 + "SELECT * FROM ch04")
def ch04_guardrail(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls = calls_of(spark, sf_dir)
    return detect.ch04_guardrail(calls, cited(positions(spark, sf_dir)), enforcement(spark), approval_states_of(calls), declared(spark))


@query(CALLS + CLAIMS + "SELECT session_id, approval, count(*) AS n FROM states GROUP BY ALL")
def approval_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return claims.approval_states(calls_of(spark, sf_dir)).groupBy("session_id", "approval").agg(F.count("*").alias("n"))


@query(VIEW + "SELECT session_id, event_type, count(*) AS n FROM tele WHERE event_type IN ('cost_threshold_exceeded', 'depth_exceeded') GROUP BY ALL")
def undeclared_controls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Against a manifest that declares another control only."""
    declared = spark.createDataFrame([("depth_exceeded", "blocking")], "event_type string, enforcement string")
    return detect.undeclared_controls(telemetry(spark, sf_dir), declared)


_CH05 = ", ch05 AS (SELECT session_id, count(*) AS n_unpaired, count_if(consequential) AS n_consequential, count_if(state = 'open') AS n_open, count_if(state = 'orphan_end') AS n_orphan_end, count_if(state = 'mismatched_end') AS n_mismatched_end, count_if(state = 'duplicate_end') AS n_duplicate_end, CASE WHEN count_if(consequential) > 0 THEN 'medium' ELSE 'low' END AS severity FROM classed WHERE state <> 'complete' GROUP BY 1)"


@query(CALLS + _CH05 + "SELECT * FROM ch05")
def ch05_unpaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect.ch05_unpaired(calls_of(spark, sf_dir))


_CH07 = CLAIMS + ", ch07 AS (SELECT session_id, kind, n_calls, list_extract(['claimed', 'bound', 'authenticated', 'reconciled'], rank) AS receipt_trust, CASE WHEN kind = 'partial' THEN 'low' WHEN kind = 'contradicted' AND egress THEN 'high' ELSE 'medium' END AS severity FROM (SELECT session_id, min(least(CASE WHEN b = 'bound' THEN 2 ELSE 1 END, CASE WHEN start_arrival % 8 = 7 THEN 1 WHEN assurance = 'operation' THEN 4 WHEN assurance = 'object' THEN 2 ELSE 1 END)) AS rank, CASE WHEN b IN ('unbound', 'arg_mismatch') THEN 'unbound' WHEN NOT executed AND b = 'bound' THEN 'contradicted' WHEN NOT executed AND b = 'bound_span_only' THEN 'partial' END AS kind, count(*) AS n_calls, bool_or(class = 'egress') AS egress FROM (SELECT *, receipt_binding AS b FROM receipted) GROUP BY ALL) WHERE kind IS NOT NULL)"


@query(CALLS + _CH07 + "SELECT * FROM ch07")
def ch07_effects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect.ch07_effects(claims.with_receipts(calls_of(spark, sf_dir)))


@query(CALLS + ALL_RECEIPTS + "SELECT session_id, receipt_binding, count(*) AS n FROM receipted WHERE receipt_binding IS NOT NULL GROUP BY ALL")
def receipt_bindings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return claims.all_receipts(calls_of(spark, sf_dir)).where("receipt_binding IS NOT NULL").groupBy("session_id", "receipt_binding").agg(F.count("*").alias("n"))


_FINDINGS = _MARKED + f", ch03 AS ({_CH03})" + _CH05 + _CH07 + ", findings AS (SELECT session_id, 'CH03' AS \"check\", severity FROM ch03 UNION ALL SELECT session_id, 'CH05', severity FROM ch05 UNION ALL SELECT session_id, 'CH07', severity FROM ch07)"


def findings_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls = calls_of(spark, sf_dir)
    return detect.union_findings(ch03=detect.ch03_untrusted(calls, positions(spark, sf_dir)), ch05=detect.ch05_unpaired(calls), ch07=detect.ch07_effects(claims.with_receipts(calls)))


@query(CALLS + _FINDINGS + "SELECT session_id, \"check\", severity, count(*) AS n FROM findings GROUP BY ALL")
def findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return findings_of(spark, sf_dir).groupBy("session_id", "check", "severity").agg(F.count("*").alias("n"))


_RANK = "CASE severity WHEN 'low' THEN 1 WHEN 'medium' THEN 2 WHEN 'high' THEN 3 ELSE 4 END"


@query(CALLS + _FINDINGS + f"SELECT session_id, arg_max(severity, {_RANK}) AS severity, string_agg(DISTINCT \"check\", ',' ORDER BY \"check\") AS rules, count(*) AS n_findings FROM findings GROUP BY 1")
def session_severity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect.session_severity(findings_of(spark, sf_dir))


@query(CALLS + _FINDINGS + f"SELECT * FROM (SELECT session_id, \"check\", severity, row_number() OVER (PARTITION BY session_id ORDER BY {_RANK} DESC, \"check\", severity) AS place FROM findings)")
def findings_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    order = Window.partitionBy("session_id").orderBy(detect.ranked(F.col("severity")).desc(), "check", "severity")
    return findings_of(spark, sf_dir).withColumn("place", F.row_number().over(order))


_DEDUP = VIEW + """, again AS (SELECT *, arrival // 2 AS event_key, arrival AS n FROM tele UNION ALL SELECT *, arrival // 2, arrival + 10000000 FROM tele WHERE arrival % 7 = 0 UNION ALL SELECT * REPLACE (ts + 1 AS ts), arrival // 2, arrival + 20000000 FROM tele WHERE arrival % 11 = 0),
keyed AS (SELECT *, concat_ws('|', session_id, event_type, coalesce(tool_name, ''), k, event_key) AS restamp, concat_ws('|', session_id, event_type, coalesce(tool_name, ''), k, event_key, CAST(round(ts * 1000) AS BIGINT)) AS content FROM again),
marked AS (SELECT *, row_number() OVER (PARTITION BY session_id, content ORDER BY ts, n) AS nth, row_number() OVER i AS of_id, first_value(restamp) OVER i AS first_restamp FROM keyed WINDOW i AS (PARTITION BY session_id, event_key ORDER BY ts, n)),
judged AS (SELECT *, nth > 1 OR (of_id > 1 AND restamp = first_restamp) AS is_dup, nth = 1 AND of_id > 1 AND restamp <> first_restamp AS is_conflict FROM marked)"""


def redelivered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The view with a seventh of its records delivered twice, an eleventh restamped, and ids shared by two."""
    events = telemetry(spark, sf_dir).withColumn("event_key", F.floor(F.col("arrival") / 2))
    twice = events.where("arrival % 7 = 0").withColumn("arrival", F.col("arrival") + 10_000_000)
    late = events.where("arrival % 11 = 0").withColumns({"ts": F.col("ts") + 1, "arrival": F.col("arrival") + 20_000_000})
    events = events.unionByName(twice).unionByName(late)
    restamp = F.concat_ws("|", "session_id", "event_type", F.coalesce("tool_name", F.lit("")), "k", "event_key")
    return detect.dedup(events, F.concat_ws("|", restamp, F.round(F.col("ts") * 1000).cast("long")), restamp)


@query(_DEDUP + "SELECT session_id, count(*) AS event_count, count_if(NOT is_dup) AS unique_event_count, count_if(is_dup) AS duplicates, count_if(is_conflict) AS conflicts FROM judged GROUP BY 1")
def dedup_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return redelivered(spark, sf_dir).groupBy("session_id").agg(F.count("*").alias("event_count"), F.count_if(~F.col("is_dup")).alias("unique_event_count"), F.count_if("is_dup").alias("duplicates"), F.count_if("is_conflict").alias("conflicts"))


@query(_DEDUP + "SELECT session_id, n AS arrival, is_conflict FROM judged WHERE NOT is_dup")
def dedup_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return redelivered(spark, sf_dir).where("NOT is_dup").select("session_id", "arrival", "is_conflict")


_SHAPES = ", ".join([*(f"count_if(state = '{s}') AS {s}_calls" for s in ("complete", "orphan_end", "mismatched_end", "duplicate_end")), *(f"count_if(class = '{c}') AS {c}_calls" for c in detect.CLASSES), "count_if(state = 'complete' AND NOT executed) AS failed_calls", "count_if(consequential AND executed) AS consequential_executed"])
_SHAPED = ", ".join(f"coalesce({part.rsplit(' ', 1)[1]}, 0) AS {part.rsplit(' ', 1)[1]}" for part in _SHAPES.split(", "))


@query(CALLS + f""", ev AS (SELECT session_id, count(*) AS event_count, min(ts) AS started_at, max(ts) AS ended_at, round(max(ts) - min(ts), 3) AS duration_s, count_if(event_type = 'cost_threshold_exceeded') AS policy_events, count_if(coalesce(marked, FALSE)) AS markers, count(marked) AS scanner_answers, arg_min(agent_name, (ts, arrival)) AS agent, arg_min(host, (ts, arrival)) AS host, count(DISTINCT agent_name) AS agents, count_if(event_type = 'tool_start') AS tool_starts, count_if(event_type IN ('tool_end', 'tool_error')) AS tool_ends, count_if(event_type = 'tool_error') AS tool_errors, count_if(marked IS NULL) AS unanswered, count(ts) AS valid_clocks, count(DISTINCT event_type) AS event_types, count(DISTINCT host) AS hosts, arg_min(user_id, (ts, arrival)) AS first_user FROM tele GROUP BY 1),
cl AS (SELECT session_id, count(*) AS call_count, count(DISTINCT name) AS distinct_tools, count_if(executed) AS executed_calls, count_if(state = 'open') AS open_calls, count_if(consequential) AS consequential_calls, round(sum(cost), 6) AS call_cost, round(max(cost), 6) AS largest_call_cost, {_SHAPES} FROM classed GROUP BY 1)
SELECT ev.*, largest_call_cost, {_SHAPED}, coalesce(call_count, 0) AS call_count, coalesce(distinct_tools, 0) AS distinct_tools, coalesce(executed_calls, 0) AS executed_calls, coalesce(open_calls, 0) AS open_calls, coalesce(consequential_calls, 0) AS consequential_calls, call_cost FROM ev LEFT JOIN cl USING (session_id)""")
def session_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect.session_features(telemetry(spark, sf_dir), calls_of(spark, sf_dir))


@query(CALLS + "SELECT g.session_id, g.arrival AS guard, c.start_arrival AS call FROM tele g JOIN classed c ON g.session_id = c.session_id AND c.start_ts BETWEEN g.ts AND g.ts + 300 WHERE g.event_type = 'cost_threshold_exceeded' AND c.consequential")
def followed_by_300s(spark: SparkSession, sf_dir: str) -> DataFrame:
    guard = telemetry(spark, sf_dir).where(F.col("event_type").isin(*detect.POLICY_TYPES)).select("session_id", F.col("ts").alias("at"), F.col("arrival").alias("guard"), F.explode(F.array(F.floor(F.col("ts") / 300), F.floor(F.col("ts") / 300) + 1)).alias("slot"))
    starts = calls_of(spark, sf_dir).where("consequential AND start_ts IS NOT NULL").select("session_id", "start_ts", F.col("start_arrival").alias("call"), F.floor(F.col("start_ts") / 300).alias("slot"))
    return guard.join(starts, ["session_id", "slot"]).where("start_ts BETWEEN at AND at + 300").select("session_id", "guard", "call")
