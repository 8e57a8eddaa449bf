"""Queries: measures on labelled documents as sessions, and drift over the telemetry view."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracehold.operators import detect, evaluate, grid
from tracehold.operators.pairing import pair_calls
from tracehold.plans.detections import _FINDINGS, calls_of, findings_of, with_arguments
from tracehold.plans.registry import query
from tracehold.plans.view import CALLS, VIEW, positions, table, telemetry

_OUT = "WITH outcomes AS (SELECT doc_id, source AS family, lang AS kind, source || '-' || (doc_id % 5) AS task, toxic = 1 AS is_attack, (quality = 0) <> (doc_id % 4 = 0) AS alerted FROM labels JOIN documents USING (doc_id)), c AS (SELECT count_if(is_attack AND alerted) AS tp, count_if(NOT is_attack AND alerted) AS fp, count_if(is_attack AND NOT alerted) AS fn, count_if(NOT is_attack AND NOT alerted) AS tn FROM outcomes) "
_COUNTS = "count_if(is_attack AND alerted) AS tp, count_if(NOT is_attack AND alerted) AS fp, count_if(is_attack AND NOT alerted) AS fn, count_if(NOT is_attack AND NOT alerted) AS tn"


def outcomes_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "source", "lang"), "doc_id")
    return rows.select("doc_id", F.col("source").alias("family"), F.col("lang").alias("kind"), F.concat("source", F.lit("-"), F.col("doc_id") % 5).alias("task"), (F.col("toxic") == 1).alias("is_attack"), ((F.col("quality") == 0) != (F.col("doc_id") % 4 == 0)).alias("alerted"))


@query(_OUT + "SELECT tp, fp, fn, tn FROM c")
def confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.counts(outcomes_of(spark, sf_dir))


_RATES = "round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) END, 6) AS recall, round(CASE WHEN fp + tn > 0 THEN fp / (fp + tn) END, 6) AS fpr, round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) END, 6) AS precision, round(CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) END, 6) AS f1, round(CASE WHEN fp + tn > 0 THEN 1000 * fp / (fp + tn) END, 6) AS fp_per_1000"


@query(_OUT + f"SELECT tp, fp, fn, tn, {_RATES} FROM c")
def metrics_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.rates(evaluate.counts(outcomes_of(spark, sf_dir)))


@query(_OUT + f"SELECT family, kind, tp, fp, fn, tn, {_RATES} FROM (SELECT family, kind, {_COUNTS} FROM outcomes GROUP BY GROUPING SETS ((family), (kind)))")
def metrics_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = outcomes_of(spark, sf_dir)
    a, f = F.col("is_attack"), F.col("alerted")
    sets = rows.groupingSets([["family"], ["kind"]], "family", "kind").agg(F.count_if(a & f).alias("tp"), F.count_if(~a & f).alias("fp"), F.count_if(a & ~f).alias("fn"), F.count_if(~a & ~f).alias("tn"))
    return evaluate.rates(sets.select("family", "kind", "tp", "fp", "fn", "tn"))


@query(_OUT + f", f AS (SELECT family, {_COUNTS} FROM outcomes GROUP BY 1), n AS (SELECT family, tp, CAST(nullif(tp + fn, 0) AS DOUBLE) AS n, 3.8414588206941254 AS z FROM f), h AS (SELECT *, tp / n AS p, (tp / n + z / (2 * n)) / (1 + z / n) AS centre, 1.959963984540054 / (1 + z / n) * sqrt(tp / n * (1 - tp / n) / n + z / (4 * n * n)) AS half FROM n) SELECT family, round(coalesce(greatest(0.0, centre - half), 0.0), 6) AS low, round(coalesce(least(1.0, centre + half), 1.0), 6) AS high FROM h")
def wilson(spark: SparkSession, sf_dir: str) -> DataFrame:
    per = evaluate.counts(outcomes_of(spark, sf_dir), "family")
    low, high = evaluate.wilson(F.col("tp"), F.col("tp") + F.col("fn"))
    return per.select("family", F.round(low, 6).alias("low"), F.round(high, 6).alias("high"))


@query(_OUT + "SELECT prevalence, round(tp / (tp + fn) * prevalence / (tp / (tp + fn) * prevalence + fp / (fp + tn) * (1 - prevalence)), 6) AS precision FROM c, (VALUES (0.001::DOUBLE), (0.01::DOUBLE), (0.05::DOUBLE)) AS p(prevalence)")
def base_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.base_rate(evaluate.counts(outcomes_of(spark, sf_dir)))


@query(_OUT + f"SELECT round(avg(recall), 6) AS macro_recall, round(avg(fpr), 6) AS macro_fpr, count(*) AS families FROM (SELECT CASE WHEN tp + fn > 0 THEN tp / (tp + fn) END AS recall, CASE WHEN fp + tn > 0 THEN fp / (fp + tn) END AS fpr FROM (SELECT family, {_COUNTS} FROM outcomes GROUP BY 1))")
def macro_average(spark: SparkSession, sf_dir: str) -> DataFrame:
    per = evaluate.counts(outcomes_of(spark, sf_dir), "family")
    recall, fpr = evaluate.ratio(F.col("tp"), F.col("tp") + F.col("fn")), evaluate.ratio(F.col("fp"), F.col("fp") + F.col("tn"))
    return per.agg(F.round(F.avg(recall), 6).alias("macro_recall"), F.round(F.avg(fpr), 6).alias("macro_fpr"), F.count("*").alias("families"))


@query(_OUT + "SELECT is_attack, count(DISTINCT doc_id) AS sessions, count(DISTINCT task) AS tasks, count(DISTINCT family) AS families, count(DISTINCT kind) AS kinds FROM outcomes GROUP BY 1")
def independence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outcomes_of(spark, sf_dir).groupBy("is_attack").agg(*(F.count_distinct(c).alias(n) for c, n in (("doc_id", "sessions"), ("task", "tasks"), ("family", "families"), ("kind", "kinds"))))


_GRID = CALLS + """, corpus AS (SELECT *, (u + wk) % 4 = 0 AS is_attack, list_extract(['CH01', 'CH03', 'CH05'], u % 3 + 1) AS target, 'h' || (u % 7) AS family, 'u' || u AS task, substr(md5(session_id), 1, 1) < '8' AS trains_random FROM (SELECT DISTINCT session_id, user_id AS u, CAST(regexp_extract(session_id, 'w([0-9]+)$', 1) AS BIGINT) AS wk FROM tele)),
halves AS (SELECT task, family, percent_rank() OVER (PARTITION BY family ORDER BY md5(task), task) < 0.5 AS trains_task FROM (SELECT DISTINCT task, family FROM corpus)),
placed AS (SELECT * FROM corpus JOIN halves USING (task, family)),
able AS (SELECT c.*, coalesce(start_ts, end_ts) AS clk, coalesce(start_arrival, end_arrival) AS place, s.source, CASE s.source WHEN 'manifest' THEN name = 'send_payment' WHEN 'producer' THEN name = 'send_payment' OR CASE WHEN start_arrival IS NULL THEN consequential ELSE start_arrival % 3 = 0 END ELSE consequential END AS cons FROM classed c, (VALUES ('manifest'), ('producer'), ('name_only')) AS s(source)),
hops AS (SELECT session_id, source, coalesce(lag(name) OVER w, '<start>') AS prev, name AS next, cons, coalesce(lag(name) OVER w = name AND NOT lag(executed) OVER w AND lag(dig) OVER w = dig, FALSE) AS is_retry, lead(name) OVER w IS NULL AS is_last FROM (SELECT a.*, t.arg_digest AS dig FROM able a LEFT JOIN tele t ON t.arrival = a.start_arrival) WINDOW w AS (PARTITION BY session_id, source ORDER BY clk, place)),
steps AS (SELECT session_id, source, prev, next, cons, is_retry FROM hops UNION ALL SELECT session_id, source, next, '<end>', FALSE, FALSE FROM hops WHERE is_last),
shown AS (SELECT DISTINCT regime, fold, prev, next FROM steps s JOIN placed p USING (session_id), LATERAL (SELECT 'task_disjoint' AS regime, '' AS fold WHERE trains_task UNION ALL SELECT 'random_control', '' WHERE trains_random UNION ALL SELECT 'family_holdout', f.family FROM (SELECT DISTINCT family FROM placed) f WHERE f.family <> p.family) WHERE NOT is_attack AND source = 'manifest'),
tests AS (SELECT p.*, r.regime, CASE WHEN r.regime = 'family_holdout' THEN family ELSE '' END AS fold FROM placed p, (VALUES ('task_disjoint'), ('family_holdout'), ('random_control')) AS r(regime) WHERE CASE r.regime WHEN 'task_disjoint' THEN NOT trains_task WHEN 'random_control' THEN NOT trains_random ELSE TRUE END),
scores AS (SELECT t.regime, s.source, t.session_id, count_if(k.prev IS NULL) / count(*) > 0.25 OR count_if(k.prev IS NULL AND cons AND NOT is_retry) >= 1 AS wild FROM tests t JOIN steps s USING (session_id) LEFT JOIN shown k ON k.regime = t.regime AND k.fold = t.fold AND k.prev = s.prev AND k.next = s.next GROUP BY 1, 2, 3),
apt AS (SELECT t.regime, t.session_id, NOT (sum(n) >= 3 AND count_if(k.next IS NOT NULL) / count(*) < 0.5) AS fits FROM tests t JOIN (SELECT session_id, name, count(*) AS n FROM calls GROUP BY ALL) c USING (session_id) LEFT JOIN (SELECT DISTINCT regime, fold, next FROM shown WHERE next <> '<end>') k ON k.regime = t.regime AND k.fold = t.fold AND k.next = c.name GROUP BY 1, 2),
marks AS (SELECT session_id, ts, at_stream, at_seq FROM pos WHERE marked),
tainted AS (SELECT a.session_id, a.source FROM able a JOIN marks m USING (session_id) WHERE cons AND start_arrival IS NOT NULL GROUP BY ALL HAVING bool_or(CASE WHEN a.start_stream = m.at_stream THEN a.start_seq > m.at_seq ELSE a.start_ts > m.ts END)),
unpaired AS (SELECT DISTINCT session_id FROM calls WHERE state <> 'complete' AND session_id LIKE '%1'),
outs AS (SELECT t.*, s.source, wild AND fits AS c1, x.session_id IS NOT NULL AS c3, u.session_id IS NOT NULL AS c5, CASE target WHEN 'CH01' THEN fits WHEN 'CH03' THEN m.session_id IS NOT NULL ELSE TRUE END AS could FROM tests t JOIN scores s ON s.regime = t.regime AND s.session_id = t.session_id JOIN apt a ON a.regime = t.regime AND a.session_id = t.session_id LEFT JOIN tainted x ON x.session_id = t.session_id AND x.source = s.source LEFT JOIN unpaired u ON u.session_id = t.session_id LEFT JOIN (SELECT DISTINCT session_id FROM marks) m ON m.session_id = t.session_id),
outcomes AS (SELECT *, c1 OR c3 OR c5 AS flagged, CASE target WHEN 'CH01' THEN c1 WHEN 'CH03' THEN c3 ELSE c5 END AS hit FROM outs),
sums AS (SELECT regime, source, count(*) AS sessions, count_if(is_attack AND flagged) AS tp, count_if(NOT is_attack AND flagged) AS fp, count_if(is_attack AND NOT flagged) AS fn, count_if(NOT is_attack AND NOT flagged) AS tn, count_if(is_attack AND hit) AS attributed, count_if(is_attack AND could) AS evaluable, count_if(is_attack AND hit AND could) AS attributed_evaluable FROM outcomes GROUP BY ALL)
"""


def corpus_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The view's sessions as a labelled corpus: hosts are families, users tasks, weeks attempts."""
    week = F.regexp_extract("session_id", r"w(\d+)$", 1).cast("long")
    target = F.element_at(F.array(*map(F.lit, ("CH01", "CH03", "CH05"))), (F.col("user_id") % 3 + 1).cast("int"))
    sessions = telemetry(spark, sf_dir).select("session_id", "user_id").distinct()
    return sessions.select("session_id", F.concat(F.lit("h"), F.col("user_id") % 7).alias("family"), F.concat(F.lit("u"), "user_id").alias("task"), ((F.col("user_id") + week) % 4 == 0).alias("is_attack"), target.alias("target"))


@query(_GRID + f"SELECT *, {_RATES}, round(CASE WHEN tp + fn > 0 THEN attributed / (tp + fn) END, 6) AS attributable_recall, tp - attributed AS incidental, round(CASE WHEN evaluable > 0 THEN attributed_evaluable / evaluable END, 6) AS recall_where_evaluable FROM sums")
def evaluation_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three ways to part the corpus by three sources of what tools can do: what alerts, and what the check named by the label sees."""
    calls, events = calls_of(spark, sf_dir), positions(spark, sf_dir)
    flag = F.when(F.col("start_arrival").isNull(), F.col("consequential")).otherwise(F.col("start_arrival") % 3 == 0)
    sent = F.col("name") == "send_payment"
    calls = with_arguments(calls, events).withColumns({"consequential_manifest": sent, "consequential_producer": sent | flag, "consequential_name_only": F.col("consequential")})
    fired = calls.where("state <> 'complete' AND session_id LIKE '%1'").select("session_id", F.lit("CH05").alias("check")).distinct()
    return grid.summary(grid.outcomes(corpus_of(spark, sf_dir), calls, detect.references(events, F.col("marked")), fired))


@query()
def cluster_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.bootstrap(evaluate.counts(outcomes_of(spark, sf_dir), "task"))


_SPLIT = _OUT + ", units AS (SELECT *, CASE WHEN percent_rank() OVER (PARTITION BY family ORDER BY md5(task), task) < 0.5 THEN 'train' ELSE 'test' END AS side FROM (SELECT DISTINCT task, family FROM outcomes)) "


@query(_SPLIT + "SELECT doc_id, task, side FROM outcomes JOIN units USING (task, family)")
def corpus_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.split(outcomes_of(spark, sf_dir), "task", ["family"]).select("doc_id", "task", "side")


@query(_SPLIT + "SELECT count(*) AS shared_tasks FROM (SELECT task FROM units WHERE side = 'train' INTERSECT SELECT task FROM units WHERE side = 'test')")
def split_disjoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = evaluate.split(outcomes_of(spark, sf_dir), "task", ["family"])
    side = lambda s: rows.where(F.col("side") == s).select("task")
    return side("train").intersect(side("test")).agg(F.count("*").alias("shared_tasks"))


@query("SELECT count_if(l.doc_id IS NULL) AS unlabelled, count_if(d.doc_id IS NULL) AS orphan_labels, count_if(l.n > 1) AS duplicate_labels, count_if(l.n = 1 AND d.doc_id IS NOT NULL) AS matched FROM (SELECT doc_id, count(*) AS n FROM labels GROUP BY 1) l FULL OUTER JOIN (SELECT doc_id FROM documents WHERE doc_id % 9 <> 0) d ON l.doc_id = d.doc_id")
def corpus_bijection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels against sessions, of which a ninth is missing."""
    labels = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.count("*").alias("n")).withColumnRenamed("doc_id", "label_id")
    docs = table(spark, sf_dir, "documents").where("doc_id % 9 <> 0").select("doc_id")
    both = labels.join(docs, F.col("label_id") == F.col("doc_id"), "full_outer")
    return both.agg(F.count_if(F.col("label_id").isNull()).alias("unlabelled"), F.count_if(F.col("doc_id").isNull()).alias("orphan_labels"), F.count_if(F.col("n") > 1).alias("duplicate_labels"), F.count_if((F.col("n") == 1) & F.col("doc_id").isNotNull()).alias("matched"))


_FIRED = _OUT + ", fired AS (SELECT *, CASE doc_id % 3 WHEN 0 THEN 'CH01' WHEN 1 THEN 'CH03' ELSE 'CH05' END AS \"check\", CASE doc_id % 2 WHEN 0 THEN 'CH01' ELSE 'CH03' END AS target FROM outcomes WHERE alerted) "


@query(_FIRED + "SELECT \"check\", count_if(is_attack) AS on_attacks, count_if(NOT is_attack) AS on_benign, count_if(is_attack AND \"check\" = target) AS on_own_target, round(count_if(is_attack) / count(*), 6) AS precision FROM fired GROUP BY 1")
def check_attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    third, half = F.col("doc_id") % 3, F.col("doc_id") % 2
    fired = outcomes_of(spark, sf_dir).where("alerted").withColumns({"check": F.when(third == 0, "CH01").when(third == 1, "CH03").otherwise("CH05"), "target": F.when(half == 0, "CH01").otherwise("CH03")})
    return fired.groupBy("check").agg(F.count_if("is_attack").alias("on_attacks"), F.count_if(~F.col("is_attack")).alias("on_benign"), F.count_if(F.col("is_attack") & (F.col("check") == F.col("target"))).alias("on_own_target"), F.round(F.count_if("is_attack") / F.count("*"), 6).alias("precision"))


@query(CALLS + "SELECT name, count(*) AS n, count_if(class <> 'unknown') AS recognised, count_if((class = 'egress') = (name = 'send_payment')) AS correct, round(count_if(class = 'unknown') / count(*), 6) AS blind_rate FROM classed GROUP BY 1")
def vocabulary_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calls_of(spark, sf_dir).groupBy("name").agg(F.count("*").alias("n"), F.count_if(F.col("class") != "unknown").alias("recognised"), F.count_if((F.col("class") == "egress") == (F.col("name") == "send_payment")).alias("correct"), F.round(F.count_if(F.col("class") == "unknown") / F.count("*"), 6).alias("blind_rate"))


@query(CALLS + "SELECT session_id, min(q) AS worst, round(avg(q), 6) AS mean, count_if(q = 0) AS unknown, count_if(q = 0.7) AS heuristic, count_if(q = 1) AS manifest FROM (SELECT session_id, CASE WHEN name = 'fetch_page' THEN 1.0::DOUBLE WHEN class <> 'unknown' THEN 0.7::DOUBLE ELSE 0.0::DOUBLE END AS q FROM classed) GROUP BY 1")
def class_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """1 for tools of the manifest (it declares one here), 0.7 for tools known by name, 0 for others."""
    manifest = spark.createDataFrame([("fetch_page", "read_only")], "tool_id string, effect string")
    q = F.when(F.col("class") == "unknown", 0.0).when(F.col("class_source") == "manifest", 1.0).otherwise(0.7)
    calls = detect.classified(pair_calls(telemetry(spark, sf_dir)), manifest)
    return calls.withColumn("q", q).groupBy("session_id").agg(F.min("q").alias("worst"), F.round(F.avg("q"), 6).alias("mean"), F.count_if(F.col("q") == 0).alias("unknown"), F.count_if(F.col("q") == 0.7).alias("heuristic"), F.count_if(F.col("q") == 1).alias("manifest"))


@query(VIEW + "SELECT session_id, round(coalesce(max(CASE WHEN k % 4 = 0 THEN cost * 10 END), sum(cost)), 6) AS cost FROM tele GROUP BY 1")
def session_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The largest running cost where one is reported, else the sum of the calls' costs."""
    running = F.max(F.when(F.col("k") % 4 == 0, F.col("cost") * 10))
    return telemetry(spark, sf_dir).groupBy("session_id").agg(F.round(F.coalesce(running, F.sum("cost")), 6).alias("cost"))


@query(VIEW + "SELECT session_id, max(k % 6) AS max_depth, string_agg(CAST(k % 6 AS VARCHAR), '>' ORDER BY ts, arrival) FILTER (k % 9 = 0) AS chain FROM tele GROUP BY 1")
def handoffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    hop = F.when(F.col("k") % 9 == 0, F.struct("ts", "arrival", (F.col("k") % 6).cast("string").alias("to")))
    per = telemetry(spark, sf_dir).groupBy("session_id").agg(F.max(F.col("k") % 6).alias("max_depth"), F.array_sort(F.collect_list(hop)).alias("hops"))
    return per.select("session_id", "max_depth", F.when(F.size("hops") > 0, F.array_join(F.transform("hops", lambda h: h["to"]), ">")).alias("chain"))


_DRIFT = 21_600


@query(VIEW + f", bad AS (SELECT DISTINCT agent_name AS agent, session_id, ts FROM tele WHERE event_type IN ('tool_error', 'cost_threshold_exceeded')) SELECT a.agent, a.ts, count(DISTINCT v.session_id) AS sessions FROM (SELECT DISTINCT agent, ts FROM bad) a JOIN bad v ON v.agent = a.agent AND v.ts <= a.ts AND v.ts + {_DRIFT} > a.ts GROUP BY ALL HAVING count(DISTINCT v.session_id) >= 3")
def agent_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Instants at which three or more different sessions of an agent had errors or policy events within six hours."""
    bad = telemetry(spark, sf_dir).where(F.col("event_type").isin("tool_error", "cost_threshold_exceeded"))
    return evaluate.drift(bad.withColumnRenamed("agent_name", "agent"), float(_DRIFT), 3)


_SUPPRESSED = """, numbered AS (SELECT agent_name AS agent, ts, arrival, row_number() OVER (PARTITION BY agent_name ORDER BY ts, arrival) AS nth FROM tele WHERE event_type = 'cost_threshold_exceeded'),
folded AS (SELECT *, TRUE AS kept, ts + 3600 AS until FROM numbered WHERE nth = 1 UNION ALL SELECT n.*, n.ts >= f.until, CASE WHEN n.ts >= f.until THEN n.ts + 3600 ELSE f.until END FROM folded f JOIN numbered n ON n.agent = f.agent AND n.nth = f.nth + 1)
SELECT agent, ts, arrival, kept FROM folded"""


@query((VIEW + _SUPPRESSED).replace("WITH tele", "WITH RECURSIVE tele", 1))
def alert_suppression(spark: SparkSession, sf_dir: str) -> DataFrame:
    alerts = telemetry(spark, sf_dir).where("event_type = 'cost_threshold_exceeded'").withColumnRenamed("agent_name", "agent")
    return evaluate.suppressed(alerts)


@query(VIEW + ", per AS (SELECT agent_name, session_id, min(ts) AS begun, round(count(marked) / count(*), 6) AS completeness FROM tele GROUP BY 1, 2) SELECT * FROM (SELECT agent_name, session_id, completeness, lag(completeness) OVER (PARTITION BY agent_name ORDER BY begun, session_id) AS before FROM per) WHERE completeness < before")
def coverage_drop(spark: SparkSession, sf_dir: str) -> DataFrame:
    per = telemetry(spark, sf_dir).groupBy("agent_name", "session_id").agg(F.min("ts").alias("at"), F.round(F.count("marked") / F.count("*"), 6).alias("completeness"))
    before = F.lag("completeness").over(Window.partitionBy("agent_name").orderBy("at", "session_id"))
    return per.withColumn("before", before).where("completeness < before").select("agent_name", "session_id", "completeness", "before")


_RULES = "(VALUES ('untrusted_flow', 'CH03'), ('unpaired', 'CH05'), ('effects', 'CH07')) AS rules(rule, \"check\")"


@query(CALLS + _FINDINGS + f"SELECT DISTINCT session_id, rule FROM findings JOIN {_RULES} USING (\"check\")")
def content_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detection content over verdicts: a small rule table against the checks that fired."""
    rules = spark.createDataFrame([("untrusted_flow", "CH03"), ("unpaired", "CH05"), ("effects", "CH07")], "rule string, check string")
    return findings_of(spark, sf_dir).select("session_id", "check").distinct().join(F.broadcast(rules), "check").select("session_id", "rule")


_SIG = VIEW + ", sig AS (SELECT session_id, user_id, string_agg(event_type, ',' ORDER BY ts, arrival) AS ordered, string_agg(event_type, ',' ORDER BY event_type) AS bag, count(*) AS arity FROM tele GROUP BY ALL) "


@query(_SIG + "SELECT count(*) AS pairs, count_if(a.ordered = b.ordered) AS same_ordered, count_if(a.bag = b.bag) AS same_bag, count_if(a.arity = b.arity) AS same_arity FROM sig a JOIN sig b ON a.user_id = b.user_id AND a.session_id < b.session_id")
def separability_ceiling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of a user's sessions whose actions are the same in order, as a bag, or in number."""
    one = F.struct("ts", "arrival", "event_type")
    per = telemetry(spark, sf_dir).groupBy("session_id", "user_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(one)), lambda x: x["event_type"]), ",").alias("ordered"), F.array_join(F.sort_array(F.collect_list("event_type")), ",").alias("bag"), F.count("*").alias("arity"))
    # pairs of equals are counted by groups of equals, so no two sessions meet
    pairs = lambda *by: per.groupBy("user_id", *by).count().agg(F.sum(F.expr("count * (count - 1) div 2")).alias("n"))
    sums = [pairs(*by).select(F.col("n").alias(name)) for name, by in (("pairs", ()), ("same_ordered", ("ordered",)), ("same_bag", ("bag",)), ("same_arity", ("arity",)))]
    return reduce(lambda x, y: x.crossJoin(y), sums)
