"""Instants at which something begins that rules for a while: windows anchored at their first event, alerts that silence the next.

The next beginning after an instant is the first instant that its reach leaves out. So all instants point ahead, and the
beginnings are those that pointers lead to from the first one. Pointers are doubled round by round, by joins; no task
walks a scope. What has to look along a scope does so in slots of time, with a table of one row per slot between them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracehold.sources.shared import dropped, kept


def _along(rows: DataFrame, key: str, at: Column, slot: float, value: Column, order: list[Column], ahead: bool) -> DataFrame:
    """rows with found: the nearest non-null value at or before (or, ahead, at or after) each row of its key, in order of at."""
    slots = rows.withColumns({"_slot": F.floor(at / slot), "_value": value})
    within = Window.partitionBy(key, "_slot").orderBy(*order)
    if ahead:
        near, edge = F.first("_value", ignorenulls=True).over(within.rowsBetween(0, Window.unboundedFollowing)), F.min("_value")
        beyond = F.first("_edge", ignorenulls=True).over(Window.partitionBy(key).orderBy("_slot").rowsBetween(1, Window.unboundedFollowing))
    else:
        near, edge = F.last("_value", ignorenulls=True).over(within.rowsBetween(Window.unboundedPreceding, 0)), F.max("_value")
        beyond = F.last("_edge", ignorenulls=True).over(Window.partitionBy(key).orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1))
    edges = slots.groupBy(key, "_slot").agg(edge.alias("_edge")).select(key, "_slot", beyond.alias("_beyond"))
    return slots.withColumn("_near", near).join(edges, [key, "_slot"]).withColumn("found", F.coalesce("_near", "_beyond")).drop("_slot", "_value", "_near", "_beyond")


def pointers(instants: DataFrame, key: str, reach: float, includes_end: bool) -> DataFrame:
    """(key, ts, next) of distinct instants (key, ts): the first instant beyond ts + reach, or from there on if the end is out of reach; null at the last."""
    events = instants.select(key, F.col("ts").alias("at"), F.lit(False).alias("asks"), F.lit(None).cast("double").alias("ts"))
    asked = instants.select(key, (F.col("ts") + reach).alias("at"), F.lit(True).alias("asks"), "ts")
    # an instant at the very end of the reach comes after the question unless the reach includes it
    order = [F.col("at"), F.col("asks").asc() if includes_end else F.col("asks").desc()]
    found = _along(events.union(asked), key, F.col("at"), reach, F.when(~F.col("asks"), F.col("at")), order, True)
    return found.where("asks").select(key, "ts", F.col("found").alias("next"))


def beginnings(instants: DataFrame, key: str, reach: float, includes_end: bool) -> DataFrame:
    """(key, ts): the first of the distinct instants of each key, and from each of these on the next one beyond its reach."""
    jump = kept(pointers(instants, key, reach, includes_end).where("next IS NOT NULL"), "pointers")
    reached = kept(instants.groupBy(key).agg(F.min("ts").alias("ts")), "beginnings")
    while not jump.isEmpty():
        more = reached.join(jump, [key, "ts"]).select(key, F.col("next").alias("ts"))
        before, reached = reached, kept(reached.union(more), "beginnings")
        far = jump.select(key, F.col("ts").alias("next"), F.col("next").alias("_next"))
        old, jump = jump, kept(jump.join(far, [key, "next"]).select(key, "ts", F.col("_next").alias("next")), "pointers")
        dropped(before, old)
    dropped(jump)
    return reached


def governed(instants: DataFrame, starts: DataFrame, key: str, slot: float) -> DataFrame:
    """(key, ts, start): the last of starts at or before each of the distinct instants."""
    rows = instants.join(starts.withColumn("_start", F.lit(True)), [key, "ts"], "left")
    return _along(rows, key, F.col("ts"), slot, F.when(F.col("_start"), F.col("ts")), [F.col("ts")], False).select(key, "ts", F.col("found").alias("start"))


def running(rows: DataFrame, key: str, at: Column, slot: float, value: Column, order: list[Column]) -> DataFrame:
    """rows with total: the sum of value of a key up to each row in order, summed slot by slot of at."""
    slots = rows.withColumns({"_slot": F.floor(at / slot), "_value": value})
    own = F.sum("_value").over(Window.partitionBy(key, "_slot").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    before = F.coalesce(F.sum("_sum").over(Window.partitionBy(key).orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    edges = slots.groupBy(key, "_slot").agg(F.sum("_value").alias("_sum")).select(key, "_slot", before.alias("_before"))
    return slots.withColumn("_own", own).join(edges, [key, "_slot"]).withColumn("total", F.col("_own") + F.col("_before")).drop("_slot", "_value", "_own", "_before")
