"""Tool calls from start and end events."""

from __future__ import annotations

from collections import defaultdict, deque

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

STARTS, ENDS = ("tool_start",), ("tool_end", "tool_error")
CALLS = "session_id string, name string, span_id string, state string, executed boolean, start_ts double, start_arrival long, end_ts double, end_arrival long, cost double"
UNNAMED = "<unnamed>"


def clock(ts: str = "ts", arrival: str = "arrival") -> list[Column]:
    """Valid clocks in time, then the others, ties by arrival."""
    return [F.when(F.col(ts).isNull() | F.isnan(ts), 1).otherwise(0), F.col(ts), F.col(arrival)]


def pair_by_name(events: DataFrame) -> DataFrame:
    """Calls of sessions whose tool events carry no span: the oldest open start of a name takes the next end of it.

    An end is an orphan exactly when the count of starts less ends reaches a new low below zero, so no queue is kept:
    the j-th other end of a name belongs to its j-th start.
    """
    walk = Window.partitionBy("session_id", "name").orderBy(*clock())
    tool = events.where(F.col("event_type").isin(*STARTS, *ENDS)).select("session_id", F.coalesce("tool_name", F.lit(UNNAMED)).alias("name"), "ts", "arrival", "event_type", "cost")
    step = F.when(F.col("event_type").isin(*STARTS), 1).otherwise(-1)
    walked = tool.withColumn("level", F.sum(step).over(walk)).withColumn("low", F.least(F.min("level").over(walk.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    walked = walked.withColumn("kind", F.when(F.col("event_type").isin(*STARTS), "start").when(F.col("level") < F.coalesce("low", F.lit(0)), "orphan").otherwise("end"))
    nth = Window.partitionBy("session_id", "name", "kind").orderBy(*clock())
    ranked = walked.withColumn("nth", F.when(F.col("kind") == "orphan", -F.row_number().over(nth)).otherwise(F.row_number().over(nth)))
    is_start, is_end = F.col("kind") == "start", F.col("kind") != "start"
    pick = lambda cond, c: F.max(F.when(cond, F.col(c)))
    calls = ranked.groupBy("session_id", "name", "nth").agg(
        pick(is_start, "ts").alias("start_ts"), pick(is_start, "arrival").alias("start_arrival"),
        pick(is_end, "ts").alias("end_ts"), pick(is_end, "arrival").alias("end_arrival"),
        pick(is_end, "event_type").alias("ended"), pick(is_start, "cost").alias("cost"),
    )
    state = F.when(F.col("start_arrival").isNull(), "orphan_end").when(F.col("end_arrival").isNull(), "open").otherwise("complete")
    return calls.select("session_id", "name", F.lit(None).cast("string").alias("span_id"), state.alias("state"), F.coalesce((state == "complete") & (F.col("ended") == "tool_end"), F.lit(False)).alias("executed"), "start_ts", "start_arrival", "end_ts", "end_arrival", "cost")


def _walk(part: pd.DataFrame) -> pd.DataFrame:
    """One session's calls, walked in clock order."""
    part = part.assign(_bad=part["ts"].isna()).sort_values(["_bad", "ts", "arrival"])
    by_span: dict[str, dict] = {}
    by_name: dict[str, deque] = defaultdict(deque)
    closed: set[str] = set()
    calls: list[dict] = []
    for session, kind, name, span, ts, arrival, cost in part[["session_id", "event_type", "tool_name", "span_id", "ts", "arrival", "cost"]].itertuples(index=False, name=None):
        name = name if isinstance(name, str) else UNNAMED
        span = span if isinstance(span, str) else None
        call = {"session_id": session, "name": name, "span_id": span, "state": "open", "executed": False, "start_ts": None, "start_arrival": None, "end_ts": None, "end_arrival": None, "cost": None}
        if kind in STARTS:
            call |= {"start_ts": ts, "start_arrival": arrival, "cost": cost}
            calls.append(call)
            if span is not None and span not in by_span:
                by_span[span] = call
            by_name[name].append(call)
            continue
        found = None
        if span is not None:
            held = by_span.get(span)
            found = held if held is not None and held["name"] == name else None
        else:
            while by_name[name] and by_name[name][0]["state"] != "open":
                by_name[name].popleft()
            found = by_name[name].popleft() if by_name[name] else None
        if found is None:
            state = "duplicate_end" if span in closed and span is not None else "mismatched_end" if span is not None else "orphan_end"
            calls.append(call | {"state": state, "end_ts": ts, "end_arrival": arrival})
            continue
        found |= {"state": "complete", "executed": kind == "tool_end", "end_ts": ts, "end_arrival": arrival}
        if found["span_id"] is not None and by_span.get(found["span_id"]) is found:
            closed.add(found["span_id"])
            del by_span[found["span_id"]]
    return pd.DataFrame(calls, columns=[c.split()[0] for c in CALLS.split(", ")])


def pair_calls(events: DataFrame) -> DataFrame:
    """All calls (columns as in CALLS) of events (session_id, event_type, tool_name, span_id, ts, arrival, cost).

    Sessions without spans are paired by windows; those with any span are walked one by one.
    """
    tool = events.where(F.col("event_type").isin(*STARTS, *ENDS))
    spanned = tool.where("span_id IS NOT NULL").select("session_id").distinct()
    plain = pair_by_name(tool.join(spanned, "session_id", "left_anti"))
    columns = ["session_id", "event_type", "tool_name", "span_id", "ts", "arrival", "cost"]
    walked = tool.join(spanned, "session_id", "left_semi").select(*columns).groupBy("session_id").applyInPandas(_walk, CALLS)
    return plain.unionByName(walked)
