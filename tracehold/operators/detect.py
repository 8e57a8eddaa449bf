"""Detections over paired calls: each takes calls and events of sessions and returns one row per finding."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracehold.functions.names import consequential, tool_class
from tracehold.operators.pairing import clock

#: Fixed values of the rules: share of unseen transitions, least calls and vocabulary overlap.
VIOLATION_RATE, LEAST_CALLS, LEAST_OVERLAP = 0.25, 3, 0.5
POLICY_TYPES = ("cost_threshold_exceeded", "depth_exceeded")
SEVERITIES = ("low", "medium", "high", "critical")
CLASSES = ("egress", "state_change", "read_only", "unknown")
START, END = "<start>", "<end>"
#: The registry of checks: each one's family.
FAMILIES = {"CH01": "sequence", "CH02": "concealment", "CH03": "untrusted_flow", "CH04": "guardrail", "CH05": "pairing", "CH06": "integrity", "CH07": "effects"}


#: Tiers of trust in a receipt from the weakest on, and the first of them that shows that an effect took place.
RECEIPT_TIERS, AUTHENTIC = ("claimed", "bound", "authenticated", "reconciled"), 3
#: Rows up to which a dimension is broadcast; a larger one is joined as any other table.
DIMENSION_ROWS = 100_000


def small(dimension: DataFrame) -> DataFrame:
    """dimension, to be broadcast if it is as small as dimensions are."""
    return F.broadcast(dimension) if dimension.limit(DIMENSION_ROWS + 1).count() <= DIMENSION_ROWS else dimension


def classified(calls: DataFrame, manifest: DataFrame | None = None) -> DataFrame:
    """calls with class and class_source: the manifest (tool_id, effect) before the name; a manifest is a small dimension."""
    if manifest is None:
        known = calls.withColumn("effect", F.lit(None).cast("string"))
    else:
        known = calls.join(small(manifest.select(F.col("tool_id").alias("name"), "effect")), "name", "left")
    by_name = tool_class(F.col("name"))
    source = F.when(F.col("effect").isNotNull(), "manifest").when(by_name != "unknown", "name_heuristic").otherwise("unclassified")
    out = known.withColumns({"class": F.coalesce("effect", by_name), "class_source": source}).drop("effect")
    return out.withColumn("consequential", consequential(F.col("class")))


def in_order(calls: DataFrame) -> Window:
    """Calls in clock order of their first event, those without a valid clock last, ties by arrival."""
    return Window.partitionBy("session_id").orderBy(*call_clock())


def call_clock() -> list[Column]:
    at = F.when(F.col("start_arrival").isNotNull(), F.col("start_ts")).otherwise(F.col("end_ts"))
    return [F.when(at.isNull() | F.isnan(at), 1).otherwise(0), at, F.coalesce("start_arrival", "end_arrival")]


def transitions(calls: DataFrame) -> DataFrame:
    """(session_id, prev, next, consequential, is_retry) over each session's calls in order, with a start and an end.

    A retry repeats the tool and the arguments (arg_digest, where calls have one) of a call that did not execute.
    """
    order = in_order(calls)
    before = lambda c: F.lag(c).over(order)
    again = (before("name") == F.col("name")) & ~before("executed") & (before("arg_digest") == F.col("arg_digest")) if "arg_digest" in calls.columns else F.lit(False)
    steps = calls.withColumns({"prev": F.coalesce(before("name"), F.lit(START)), "is_last": F.lead("name").over(order).isNull(), "is_retry": F.coalesce(again, F.lit(False))})
    # one pass, not a union: Spark takes a union of two sides dealt alike for one that is dealt so itself, and a shuffled join over it then fails
    own = F.struct("prev", F.col("name").alias("next"), "consequential", "is_retry")
    end = F.struct(F.col("name").alias("prev"), F.lit(END).alias("next"), F.lit(False).alias("consequential"), F.lit(False).alias("is_retry"))
    return steps.select("session_id", F.inline(F.array_compact(F.array(own, F.when(F.col("is_last"), end)))))


def grammar(calls: DataFrame) -> DataFrame:
    """(prev, next, n) of benign sessions' transitions; as large as the vocabulary squared, not as the input."""
    return transitions(calls).groupBy("prev", "next").agg(F.count("*").alias("n"))


def unseen_transitions(calls: DataFrame, known: DataFrame) -> DataFrame:
    return transitions(calls).join(known.select("prev", "next"), ["prev", "next"], "left_anti")


def ch01_sequence_order(calls: DataFrame, known: DataFrame) -> DataFrame:
    """Sessions whose order of tools is unusual: too many unseen transitions, or one into a consequential call, but for retries."""
    seen = known.select("prev", "next", F.lit(True).alias("seen"))
    vocabulary = known.select(F.col("next").alias("name")).where(F.col("name") != END).distinct()
    per = transitions(calls).join(seen, ["prev", "next"], "left").groupBy("session_id").agg(
        F.count("*").alias("n_transitions"), F.count_if(F.col("seen").isNull()).alias("n_unseen"), F.count_if(F.col("seen").isNull() & F.col("consequential") & ~F.col("is_retry")).alias("n_into_consequential"),
    )
    tools = calls.groupBy("session_id", "name").agg(F.count("*").alias("n")).join(vocabulary.withColumn("known", F.lit(True)), "name", "left")
    shape = tools.groupBy("session_id").agg(F.sum("n").alias("n_calls"), F.count_if(F.col("known").isNull()).alias("n_novel"), (F.count_if(F.col("known")) / F.count("*")).alias("overlap"))
    rate = F.col("n_unseen") / F.col("n_transitions")
    fires = ((rate > VIOLATION_RATE) | (F.col("n_into_consequential") >= 1)) & ~((F.col("n_calls") >= LEAST_CALLS) & (F.col("overlap") < LEAST_OVERLAP))
    return per.join(shape, "session_id").where(fires).select("session_id", "n_transitions", "n_unseen", F.round(rate, 6).alias("rate"), F.when(F.col("n_novel") > 0, "high").otherwise("medium").alias("severity"))


class References(NamedTuple):
    """What ordering calls against a set of reference events takes, of constant size per session and per stream of it.

    clocks: ref_ts, the lowest valid clock, ref_stream, the verified stream that it is from, other_ts, the lowest of any
    other stream, n_unclocked and n_refs. minima: at_stream and low_seq, the lowest verified position in each stream.
    """

    clocks: DataFrame
    minima: DataFrame
    per: tuple[str, ...]


def references(events: DataFrame, condition: Column, per: tuple[str, ...] = ("session_id",)) -> References:
    """The reference events of each session (or finer), reduced. events may have at_stream and at_seq, as attestation.positions() gives them."""
    if "at_stream" not in events.columns:
        events = events.withColumns({"at_stream": F.lit(None).cast("string"), "at_seq": F.lit(None).cast("long")})
    valid = F.when(~F.isnan("ts"), F.col("ts"))
    streams = events.where(condition).groupBy(*per, "at_stream").agg(F.min(valid).alias("_ts"), F.min("at_seq").alias("low_seq"), F.count_if(valid.isNull()).alias("_unclocked"), F.count("*").alias("_n"))
    place = F.row_number().over(Window.partitionBy(*per).orderBy(F.col("_ts").asc_nulls_last()))
    nth = lambda k, c: F.max(F.when(F.col("_place") == k, F.col(c)))
    clocks = streams.withColumn("_place", place).groupBy(*per).agg(
        nth(1, "_ts").alias("ref_ts"), nth(1, "at_stream").alias("ref_stream"), nth(2, "_ts").alias("other_ts"), F.sum("_unclocked").alias("n_unclocked"), F.sum("_n").alias("n_refs"),
    )
    return References(clocks, streams.where("at_stream IS NOT NULL").select(*per, "at_stream", "low_seq"), per)


def with_positions(calls: DataFrame, positioned: DataFrame) -> DataFrame:
    """calls with start_stream and start_seq, the verified position of the event that started each."""
    return calls.join(positioned.select(F.col("arrival").alias("start_arrival"), F.col("at_stream").alias("start_stream"), F.col("at_seq").alias("start_seq")), "start_arrival", "left")


def ordered_after(calls: DataFrame, refs: References) -> DataFrame:
    """calls of sessions with references, with position: after any of them, indeterminate, or not_after.

    Within a call's own verified stream the positions decide, and the clock has no say there; references elsewhere are
    held against the clock. A tie, or a clock that is missing where it would have to decide, is indeterminate.
    """
    if "start_stream" not in calls.columns:
        calls = calls.withColumns({"start_stream": F.lit(None).cast("string"), "start_seq": F.lit(None).cast("long")})
    minima = refs.minima.withColumnRenamed("at_stream", "start_stream")
    known = calls.join(refs.clocks, "session_id").join(minima, [*refs.per, "start_stream"], "left")
    start = F.when(~F.isnan("start_ts"), F.col("start_ts"))
    own = F.coalesce(F.col("start_stream") == F.col("ref_stream"), F.lit(False))
    at = F.when(own, F.col("other_ts")).otherwise(F.col("ref_ts"))
    yes = lambda c: F.coalesce(c, F.lit(False))
    tie = yes(F.col("start_seq") == F.col("low_seq")) | (at.isNotNull() & (start.isNull() | yes(start == at))) | ((F.col("n_unclocked") > 0) & F.col("low_seq").isNull())
    position = F.when(yes(F.col("start_seq") > F.col("low_seq")) | yes(start > at), "after").when(tie, "indeterminate").otherwise("not_after")
    return known.withColumn("position", position)


def disclosures(calls: DataFrame, said: DataFrame) -> DataFrame:
    """(session_id, name, disclosure) of the tools of sessions in said (session_id, words): disclosed, ambiguous or absent.

    A tool is disclosed by a word of its name that is said and that no other tool of the session has in its name;
    ambiguous if all that is said of it are words that it shares; else absent. Words have more than two letters.
    """
    tokens = F.filter(F.split(F.lower("name"), "[^a-z0-9]+"), lambda t: F.length(t) > 2)
    names = calls.select("session_id", "name").distinct().join(said, "session_id").select("session_id", "name", "words", tokens.alias("_tokens"))
    each = names.select("session_id", "name", "words", F.explode_outer(F.array_distinct("_tokens")).alias("_token"))
    shared = each.groupBy("session_id", "_token").agg((F.count("*") > 1).alias("_shared"))
    found = each.join(shared, ["session_id", "_token"], "left").withColumn("_rank", F.when(~F.coalesce(F.array_contains("words", F.col("_token")), F.lit(False)), 0).when(F.col("_shared"), 1).otherwise(2))
    words = F.array(*map(F.lit, ("absent", "ambiguous", "disclosed")))
    return found.groupBy("session_id", "name").agg(F.element_at(words, F.max("_rank") + 1).alias("disclosure"))


def ch02_concealment_gap(calls: DataFrame, said: DataFrame) -> DataFrame:
    """Executed consequential calls that the session's final response, said (session_id, words), leaves out altogether."""
    hidden = calls.where("executed AND consequential").join(disclosures(calls, said).where("disclosure = 'absent'"), ["session_id", "name"])
    return hidden.groupBy("session_id").agg(F.count("*").alias("n_calls"), F.when(F.bool_or(F.col("class") == "egress"), "critical").otherwise("high").alias("severity"))


def ch03_untrusted(calls: DataFrame, events: DataFrame) -> DataFrame:
    """Consequential calls after a scanner's marker: completed (critical for egress, else high) and attempted (medium)."""
    after = ordered_after(calls, references(events, F.col("marked"))).where("position = 'after' AND consequential AND start_arrival IS NOT NULL")
    kind = F.when(F.col("executed"), "completed").otherwise("attempted")
    found = after.groupBy("session_id", kind.alias("kind")).agg(F.count("*").alias("n_calls"), F.bool_or(F.col("class") == "egress").alias("egress"))
    return found.select("session_id", "kind", "n_calls", F.when(F.col("kind") == "attempted", "medium").when(F.col("egress"), "critical").otherwise("high").alias("severity"))


def ch04_guardrail(calls: DataFrame, events: DataFrame, enforcement: DataFrame, approvals: DataFrame | None = None, declared: DataFrame | None = None) -> DataFrame:
    """Consequential calls after a guardrail spoke, per session and policy type; with declared, also controls that it does not name.

    enforcement: (event_type, enforcement), a small dimension. approvals: (start_arrival, session_id, approval) with
    covered or denied; without a row a call is neither. Advisory controls report only what was denied and done.
    """
    per = ("session_id", "policy")
    policy = events.where(F.col("event_type").isin(*POLICY_TYPES)).withColumn("policy", F.col("event_type"))
    after = ordered_after(calls, references(policy, F.lit(True), per)).where("position = 'after' AND consequential AND start_arrival IS NOT NULL")
    if approvals is None:
        after = after.withColumn("approval", F.lit("none"))
    else:
        after = after.join(approvals, ["session_id", "start_arrival"], "left").withColumn("approval", F.coalesce("approval", F.lit("none")))
    known = after.join(small(enforcement.select(F.col("event_type").alias("policy"), "enforcement")), "policy", "left").withColumn("enforcement", F.coalesce("enforcement", F.lit("undeclared")))
    done = F.col("executed") & (F.col("approval") != "covered")
    tried = ~F.col("executed") & (F.col("approval") != "covered")
    sums = known.groupBy("session_id", "policy", "enforcement").agg(F.count_if(done).alias("n_completed"), F.count_if(done & (F.col("approval") == "denied")).alias("n_denied"), F.count_if(tried).alias("n_attempted"), F.bool_or(done & (F.col("class") == "egress")).alias("egress"))
    bypassed = (F.col("n_completed") > 0) & ((F.col("enforcement") == "blocking") | (F.col("n_denied") > 0))
    rows = F.array(
        F.when(bypassed, F.struct(F.lit("bypassed").alias("kind"), F.when(F.col("egress"), "critical").otherwise("high").alias("severity"), F.col("n_completed").alias("n_calls"))),
        F.when(~bypassed & (F.col("n_completed") > 0) & (F.col("enforcement") != "advisory"), F.struct(F.lit("completed").alias("kind"), F.lit("high").alias("severity"), F.col("n_completed").alias("n_calls"))),
        F.when((F.col("n_attempted") > 0) & (F.col("enforcement") != "advisory"), F.struct(F.lit("attempted").alias("kind"), F.lit("medium").alias("severity"), F.col("n_attempted").alias("n_calls"))),
    )
    found = sums.select("session_id", "policy", "enforcement", F.inline(F.array_compact(rows)))
    return found if declared is None else found.unionByName(undeclared_findings(events, declared))


def undeclared_controls(events: DataFrame, enforcement: DataFrame) -> DataFrame:
    """Policy events that match no declaration."""
    spoke = events.where(F.col("event_type").isin(*POLICY_TYPES)).groupBy("session_id", "event_type").agg(F.count("*").alias("n"))
    return spoke.join(small(enforcement.select("event_type")), "event_type", "left_anti")


def undeclared_findings(events: DataFrame, declared: DataFrame) -> DataFrame:
    """A finding per session whose policy events cite a control that the manifest does not declare, by policy_id or event_type.

    An outdated manifest and an invented refusal look the same, so it is medium. A manifest without controls says nothing
    about which exist, and finds nothing. events: with policy_id. declared: (policy_id), a small dimension.
    """
    names = declared.select("policy_id").where("policy_id IS NOT NULL").distinct()
    spoke = events.where(F.col("event_type").isin(*POLICY_TYPES)).withColumn("_any", F.lit(True))
    some = names.limit(1).select(F.lit(True).alias("_any"))
    stray = spoke.join(F.broadcast(some), "_any", "left_semi").join(small(names), "policy_id", "left_anti").join(small(names.select(F.col("policy_id").alias("event_type"))), "event_type", "left_anti")
    cited = F.array_join(F.slice(F.array_sort(F.collect_set(F.coalesce("policy_id", "event_type"))), 1, 50), ",")
    return stray.groupBy("session_id").agg(cited.alias("policy"), F.count("*").alias("n_calls")).select("session_id", "policy", F.lit("undeclared").alias("enforcement"), F.lit("undeclared").alias("kind"), F.lit("medium").alias("severity"), "n_calls")


def ch05_unpaired(calls: DataFrame) -> DataFrame:
    """Sessions with calls that have no start or no end; medium if any of them is consequential."""
    per = calls.where("state <> 'complete'").groupBy("session_id").agg(
        F.count("*").alias("n_unpaired"), F.count_if("consequential").alias("n_consequential"),
        *(F.count_if(F.col("state") == s).alias(f"n_{s}") for s in ("open", "orphan_end", "mismatched_end", "duplicate_end")),
    )
    return per.withColumn("severity", F.when(F.col("n_consequential") > 0, "medium").otherwise("low"))


def ch07_effects(calls: DataFrame) -> DataFrame:
    """Receipts that contradict their calls: calls (session_id, executed, class, receipt_binding, receipt_rank), null binding: no receipt.

    A contradiction weighs as much as the weakest of its receipts: only authenticated ones show that an effect took place.
    """
    kind = (
        F.when(F.col("receipt_binding").isin("unbound", "arg_mismatch"), "unbound")
        .when(~F.col("executed") & (F.col("receipt_binding") == "bound"), "contradicted")
        .when(~F.col("executed") & (F.col("receipt_binding") == "bound_span_only"), "partial")
    )
    found = calls.withColumn("kind", kind).where("kind IS NOT NULL").groupBy("session_id", "kind").agg(F.count("*").alias("n_calls"), F.bool_or(F.col("class") == "egress").alias("egress"), F.min("receipt_rank").alias("rank"))
    step = F.col("egress").cast("int") + (F.col("rank") >= AUTHENTIC).cast("int") + 2
    severity = F.when(F.col("kind") == "partial", "low").when(F.col("kind") == "unbound", "medium").otherwise(F.element_at(F.array(*map(F.lit, SEVERITIES)), step))
    return found.select("session_id", "kind", "n_calls", F.element_at(F.array(*map(F.lit, RECEIPT_TIERS)), F.col("rank")).alias("receipt_trust"), severity.alias("severity"))


def ranked(severity: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, SEVERITIES)), severity)


def union_findings(**checks: DataFrame) -> DataFrame:
    """(session_id, check, severity) of all checks' rows."""
    out = None
    for name, df in checks.items():
        rows = df.select("session_id", F.lit(name.upper()).alias("check"), "severity")
        out = rows if out is None else out.unionByName(rows)
    return out


def session_severity(findings: DataFrame) -> DataFrame:
    """The worst severity and the checks that fired, per session."""
    return findings.groupBy("session_id").agg(F.max_by("severity", ranked(F.col("severity"))).alias("severity"), F.array_join(F.sort_array(F.collect_set("check")), ",").alias("rules"), F.count("*").alias("n_findings"))


def dedup(events: DataFrame, content: Column, restamp: Column) -> DataFrame:
    """events with is_dup and is_conflict: an exact redelivery, a retry that only restamped, or an id reused by another record."""
    walk = Window.partitionBy("session_id", "_content").orderBy(*clock())
    by_id = Window.partitionBy("session_id", "event_key").orderBy(*clock())
    rows = events.withColumns({"_content": content, "_restamp": restamp})
    rows = rows.withColumns({"_nth": F.row_number().over(walk), "_of_id": F.row_number().over(by_id), "_first": F.first("_restamp").over(by_id)})
    later = F.col("event_key").isNotNull() & (F.col("_of_id") > 1)
    dup = (F.col("_nth") > 1) | (later & (F.col("_restamp") == F.col("_first")))
    return rows.withColumns({"is_dup": dup, "is_conflict": (F.col("_nth") == 1) & later & (F.col("_restamp") != F.col("_first"))}).drop("_content", "_restamp", "_nth", "_of_id", "_first")


def session_features(events: DataFrame, calls: DataFrame) -> DataFrame:
    """One row per session of counts, clocks and costs; order-free aggregates only, so a hot session is combined early."""
    per_event = events.groupBy("session_id").agg(
        F.count("*").alias("event_count"), F.min("ts").alias("started_at"), F.max("ts").alias("ended_at"), F.round(F.max("ts") - F.min("ts"), 3).alias("duration_s"),
        F.count_if(F.col("event_type").isin(*POLICY_TYPES)).alias("policy_events"), F.count_if(F.coalesce("marked", F.lit(False))).alias("markers"), F.count("marked").alias("scanner_answers"),
        F.min_by("agent_name", F.struct(*clock())).alias("agent"), F.min_by("host", F.struct(*clock())).alias("host"), F.count_distinct("agent_name").alias("agents"),
        F.count_if(F.col("event_type") == "tool_start").alias("tool_starts"), F.count_if(F.col("event_type").isin("tool_end", "tool_error")).alias("tool_ends"), F.count_if(F.col("event_type") == "tool_error").alias("tool_errors"),
        F.count_if(F.col("marked").isNull()).alias("unanswered"), F.count_if(F.col("ts").isNotNull() & ~F.isnan("ts")).alias("valid_clocks"), F.count_distinct("event_type").alias("event_types"),
        F.count_distinct("host").alias("hosts"), F.min_by("user_id", F.struct(*clock())).alias("first_user"),
    )
    states = ("complete", "orphan_end", "mismatched_end", "duplicate_end")
    per_call = calls.groupBy("session_id").agg(
        F.count("*").alias("call_count"), F.count_distinct("name").alias("distinct_tools"), F.count_if("executed").alias("executed_calls"), F.count_if(F.col("state") == "open").alias("open_calls"),
        F.count_if("consequential").alias("consequential_calls"), F.round(F.sum("cost"), 6).alias("call_cost"),
        *(F.count_if(F.col("state") == s).alias(f"{s}_calls") for s in states), *(F.count_if(F.col("class") == c).alias(f"{c}_calls") for c in CLASSES),
        F.count_if((F.col("state") == "complete") & ~F.col("executed")).alias("failed_calls"), F.count_if(F.col("consequential") & F.col("executed")).alias("consequential_executed"), F.round(F.max("cost"), 6).alias("largest_call_cost"),
    )
    counts = ["call_count", "distinct_tools", "executed_calls", "open_calls", "consequential_calls", *(f"{s}_calls" for s in (*states, *CLASSES)), "failed_calls", "consequential_executed"]
    return per_event.join(per_call, "session_id", "left").fillna(0, counts)


def numbered(rows: DataFrame, block: Column, order: list[str]) -> DataFrame:
    """rows with sequence, from 0 on in order. block must not fall as order rises; blocks are counted first and sorted apart."""
    blocks = rows.groupBy(block.alias("_block")).agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ahead = blocks.select("_block", before.alias("_ahead"))
    own = rows.withColumn("_block", block).join(ahead, "_block")
    place = F.row_number().over(Window.partitionBy("_block").orderBy(*order))
    return own.withColumn("sequence", (F.col("_ahead") + place - 1).cast("long")).drop("_block", "_ahead")


def leakage(calls: DataFrame) -> DataFrame:
    """What near-copies in the training set hide: calls with attempt and held_out (a task of the test set).

    The test set is attempts 0 and 1 of held-out tasks. The clean grammar knows other tasks only, the leaky one the later
    attempts of the same tasks too. Both score the same sessions; a session alerts with any unseen transition.
    """
    steps = transitions(calls).select("session_id", "prev", "next")
    rows = steps.join(calls.select("session_id", "attempt", "held_out").distinct(), "session_id")
    known = rows.where("NOT held_out OR attempt >= 2").groupBy("prev", "next").agg(F.bool_and("held_out").alias("leaked"))
    test = rows.where("held_out AND attempt < 2").join(known, ["prev", "next"], "left")
    scored = test.groupBy("session_id").agg(F.bool_or(F.coalesce("leaked", F.lit(True))).alias("clean"), F.bool_or(F.col("leaked").isNull()).alias("leaky"))
    return scored.agg(F.count("*").alias("test_sessions"), F.count_if("clean").alias("clean_alerts"), F.count_if("leaky").alias("leaky_alerts"), F.count_if(F.col("clean") & ~F.col("leaky")).alias("hidden"))
