"""Scanner answers and captured tool results at the calls that they are about."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracehold.functions import text
from tracehold.operators.detect import in_order


def at_calls(events: DataFrame, calls: DataFrame) -> DataFrame:
    """events (session_id, span_id, tool_name, ...) with call: the start_arrival or end_arrival of the call each is about, or null.

    A span's last call comes first, then the session's first call of that tool name.
    """
    own = calls.withColumn("call", F.coalesce("start_arrival", "end_arrival"))
    ranked = own.withColumn("_nth", F.row_number().over(in_order(calls)))
    by_span = ranked.where("span_id IS NOT NULL").groupBy("session_id", "span_id").agg(F.max_by("call", "_nth").alias("_by_span"))
    by_name = ranked.groupBy("session_id", F.col("name").alias("tool_name")).agg(F.min_by("call", "_nth").alias("_by_name"))
    bound = events.join(by_span, ["session_id", "span_id"], "left").join(by_name, ["session_id", "tool_name"], "left")
    return bound.withColumn("call", F.coalesce("_by_span", "_by_name")).drop("_by_span", "_by_name")


def scanner_coverage(events: DataFrame, calls: DataFrame) -> DataFrame:
    """(session_id, scanned, scannable, unbound): calls that are not consequential and whether a scanner answered about them."""
    answers = at_calls(events.where("marked IS NOT NULL").select("session_id", "span_id", "tool_name"), calls)
    unbound = answers.where("call IS NULL").groupBy("session_id").agg(F.count("*").alias("unbound"))
    seen = answers.where("call IS NOT NULL").select("session_id", "call").distinct().withColumn("seen", F.lit(True))
    scannable = calls.where("NOT consequential").withColumn("call", F.coalesce("start_arrival", "end_arrival"))
    per = scannable.join(seen, ["session_id", "call"], "left").groupBy("session_id").agg(F.count_if("seen").alias("scanned"), F.count("*").alias("scannable"))
    return per.join(unbound, "session_id", "full_outer").fillna(0, ["scanned", "scannable", "unbound"])


def content_signals(events: DataFrame, calls: DataFrame) -> DataFrame:
    """(session_id, call, markers, signal) of calls whose captured tool_result holds markers.

    unscanned: no scanner answered about the call. contradicted: one did and marked nothing. agreed: one marked it.
    """
    found = at_calls(events.select("session_id", "span_id", "tool_name", "marked", text.markers(F.col("tool_result")).alias("markers")), calls)
    # only calls whose results are someone else's text
    scannable = calls.where("NOT consequential").select("session_id", F.coalesce("start_arrival", "end_arrival").alias("call"))
    per = found.join(scannable, ["session_id", "call"]).groupBy("session_id", "call").agg(
        F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_set("markers")))), ",").alias("markers"), F.count("marked").alias("answers"), F.count_if("marked").alias("marks"),
    )
    signal = F.when(F.col("answers") == 0, "unscanned").when(F.col("marks") == 0, "contradicted").otherwise("agreed")
    return per.where("markers <> ''").select("session_id", "call", "markers", signal.alias("signal"))


def capped(rows: DataFrame, per: list[str], order: list, limit: int) -> tuple[DataFrame, DataFrame]:
    """The first limit rows of each group, and (per, total, truncated): how many there are and how many were left out."""
    kept = rows.withColumn("_nth", F.row_number().over(Window.partitionBy(*per).orderBy(*order))).where(F.col("_nth") <= limit).drop("_nth")
    n = F.count("*")
    return kept, rows.groupBy(*per).agg(n.alias("total"), F.greatest(n - limit, F.lit(0)).alias("truncated"))
