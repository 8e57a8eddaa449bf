"""Message traces of other tools as event rows: calls and results nested in messages, paired by id or first in, first out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracehold.operators.pairing import pair_by_name

MESSAGES = "array<struct<role:string,content:string,tool_calls:array<struct<id:string,function:string,args:string>>,tool_call_id:string,function:string>>"


def sound(traces: DataFrame) -> DataFrame:
    """Traces that can be used: those that ended without an error and state their outcome. Which population any other belongs to is not known."""
    return traces.where("error IS NULL AND outcome IS NOT NULL")


def labels(traces: DataFrame, harm_when: bool) -> DataFrame:
    """(session_id, is_attack, kind) of sound traces (trace_id, attack, outcome): outcome equal to harm_when says that an attack came through."""
    done = F.col("outcome") == harm_when
    kind = F.when(F.col("attack").isNull(), "clean").when(done, "attack_succeeded").otherwise("attack_resisted")
    return sound(traces).select(F.col("trace_id").alias("session_id"), (F.col("attack").isNotNull() & done).alias("is_attack"), kind.alias("kind"))


def events(traces: DataFrame) -> DataFrame:
    """(session_id, event_type, tool_name, span_id, ts, text) of sound traces (trace_id, error, outcome, messages).

    A result goes to the call of its id; without an id, to the oldest open call of its function that has no id either.
    One never stands in for the other. A result that fits no open call is left out, and a call without a result stays
    open; unpaired() counts both. Places in the trace serve as the clock: only their order means anything.
    """
    return _events(*_paired(traces))


def _messages(traces: DataFrame) -> DataFrame:
    return sound(traces).select(F.col("trace_id").alias("session_id"), F.posexplode("messages").alias("at", "m")).select("session_id", "at", "m.*")


def _paired(traces: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Messages; starts and ends, each at a place of its own; and how they pair."""
    said = _messages(traces)
    place = lambda k: F.col("at") * 1_000_000 + k
    made = said.where("role = 'assistant'").select("session_id", "at", F.posexplode("tool_calls").alias("k", "c"))
    starts = made.select("session_id", place(F.col("k") + 1).alias("arrival"), F.lit("tool_start").alias("event_type"), F.col("c.id").alias("id"), F.col("c.function").alias("function"), F.col("c.args").alias("text"))
    ends = said.where("role = 'tool'").select("session_id", place(F.lit(0)).alias("arrival"), F.lit("tool_end").alias("event_type"), F.col("tool_call_id").alias("id"), "function", F.col("content").alias("text"))
    both = starts.unionByName(ends)
    key = F.when(F.col("id").isNotNull(), F.concat(F.lit("id:"), "id")).otherwise(F.concat(F.lit("fn:"), F.coalesce("function", F.lit(""))))
    pairs = pair_by_name(both.select("session_id", key.alias("tool_name"), F.col("arrival").cast("double").alias("ts"), "arrival", "event_type", F.lit(None).cast("double").alias("cost")))
    return said, both, pairs


def _events(said: DataFrame, both: DataFrame, pairs: DataFrame) -> DataFrame:
    span = F.concat("session_id", F.lit("-"), F.col("start_arrival"))
    begun = pairs.where("start_arrival IS NOT NULL")
    names = both.where("event_type = 'tool_start'").select("session_id", F.col("arrival").alias("start_arrival"), F.col("function").alias("tool_name"), F.col("text").alias("_args"))
    known = begun.join(names, ["session_id", "start_arrival"])
    started = known.select("session_id", F.lit("tool_start").alias("event_type"), "tool_name", span.alias("span_id"), F.col("start_arrival").alias("_place"), F.col("_args").alias("text"))
    results = both.where("event_type = 'tool_end'").select("session_id", F.col("arrival").alias("end_arrival"), "text")
    ended = known.join(results, ["session_id", "end_arrival"]).select("session_id", F.lit("tool_end").alias("event_type"), "tool_name", span.alias("span_id"), F.col("end_arrival").alias("_place"), "text")
    spoken = said.where("role IN ('user', 'assistant') AND content IS NOT NULL").select(
        "session_id", F.when(F.col("role") == "user", "user_message").otherwise("model_response").alias("event_type"), F.lit(None).cast("string").alias("tool_name"), F.lit(None).cast("string").alias("span_id"),
        (F.col("at") * 1_000_000).alias("_place"), F.col("content").alias("text"),
    )
    rows = started.unionByName(ended).unionByName(spoken)
    return rows.select("session_id", "event_type", "tool_name", "span_id", (F.col("_place") / 1e6).alias("ts"), "text")


def unpaired(traces: DataFrame) -> DataFrame:
    """(session_id, stray_results, open_calls) of the traces that have any."""
    _, _, pairs = _paired(traces)
    sums = pairs.groupBy("session_id").agg(F.count_if(F.col("state") == "orphan_end").alias("stray_results"), F.count_if(F.col("state") == "open").alias("open_calls"))
    return sums.where("stray_results + open_calls > 0")
