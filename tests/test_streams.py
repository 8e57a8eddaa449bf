"""Streaming jobs over several batches: sealed sessions never change, late records go aside, joins equal their batch form."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from tracehold.operators import chains
from tracehold.streaming import jobs

EVENTS = "session_id string, at timestamp, ts double, event_type string, seq long, reached long"


def _events(spark, rows):
    made = spark.createDataFrame([(s, float(ts), kind, seq, reached) for s, ts, kind, seq, reached in rows], "session_id string, ts double, event_type string, seq long, reached long")
    return made.select("session_id", F.timestamp_seconds("ts").alias("at"), "ts", "event_type", "seq", "reached")


def _tables(spark, folder):
    read = lambda name, schema: sorted(tuple(r) for r in spark.read.schema(schema).parquet(f"{folder}/{name}").drop("batch").collect())
    return read("sealed", "session_id string, started_at double, ended_at double, events long, session_completion string, incomplete boolean"), read("late", "session_id string, late_ts double, late_event string")


def test_a_late_record_changes_no_sealed_session(spark, tmp_path):
    folder, fed = str(tmp_path / "run"), str(tmp_path / "in")
    batches = [
        [("ended", 100, "tool_start", 1, None), ("ended", 110, "tool_end", 2, None), ("ended", 120, "agent_end", 3, None), ("cut", 100, "tool_start", 4, None), ("cut", 130, "agent_end", 5, None), ("idle", 100, "tool_start", 6, None), ("signed", 100, "tool_start", 10, 10)],
        [("ended", 125, "tool_start", 7, None), ("signed", 101, "tick", None, 70), ("other", 20_000, "tool_start", 80, None)],
        [("other", 20_001, "tool_end", 81, None), ("signed", 150, "tool_end", 82, None), ("other", 40_000, "tool_start", 83, None)],
        [("idle", 40_000, "tool_end", 84, None), ("other", 40_001, "tool_end", 85, None)],
    ]
    seen = []
    for rows in batches:
        _events(spark, rows).coalesce(1).write.mode("append").parquet(fed)
        jobs.split_completed(spark.readStream.schema(EVENTS).parquet(fed), folder, idle=1_000.0, advance=50, remember=1e6, late="1000 days")
        seen.append(_tables(spark, folder))
    sealed, late = seen[-1]
    assert ("ended", 100.0, 120.0, 3, "terminal_event", False) in sealed and ("cut", 100.0, 130.0, 2, "terminal_event", True) in sealed
    assert ("signed", 100.0, 100.0, 1, "sequence_advance", True) in sealed
    assert ("ended", 125.0, "tool_start") in late and ("signed", 150.0, "tool_end") in late
    for (before, aside), (after, aside_after) in zip(seen, seen[1:], strict=False):
        assert set(before) <= set(after) and set(aside) <= set(aside_after)
    assert len({s for s, *_ in sealed}) == len(sealed)


def test_a_pause_seals_by_the_watermark(spark, tmp_path):
    folder, fed = str(tmp_path / "run"), str(tmp_path / "in")
    for rows in ([("a", 100, "tool_start", 1, None), ("b", 100, "tool_start", 2, None)], [("b", 90_000, "tool_end", 3, None)], [("b", 90_001, "agent_end", 4, None)]):
        _events(spark, rows).coalesce(1).write.mode("append").parquet(fed)
        jobs.split_completed(spark.readStream.schema(EVENTS).parquet(fed), folder, idle=1_000.0, late="1 minute")
    sealed, late = _tables(spark, folder)
    assert ("a", 100.0, 100.0, 1, "idle_timeout", True) in sealed and late == []


def test_followed_by_equals_its_batch_form(spark, tmp_path):
    rng = random.Random(4)
    rows = [(f"s{rng.randrange(6)}", float(rng.randrange(5_000)), rng.choice("gc"), k) for k in range(300)]
    made = spark.createDataFrame(rows, "session_id string, ts double, kind string, arrival long").withColumn("at", F.timestamp_seconds("ts"))
    made.repartition(3).write.parquet(str(tmp_path / "in"))
    feed = lambda: spark.readStream.schema(made.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    found = jobs.followed_by(feed().where("kind = 'g'"), feed().where("kind = 'c'"), 300, "3 hours")
    run = found.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    run.awaitTermination()
    got = sorted(tuple(r) for r in spark.read.schema(found.schema).parquet(str(tmp_path / "out")).collect())
    assert got == sorted((a[0], a[3], b[3]) for a in rows for b in rows if a[0] == b[0] and a[2] == "g" and b[2] == "c" and a[1] <= b[1] <= a[1] + 300) != []


def test_records_are_dealt_without_loss(spark):
    """Digests travel as bytes; text that is none, of any length, comes back as it was."""
    odd = [None, "", "ab" * 32, "AB" * 32, "a" * 31, "a" * 32, "é" * 16, "g" * 64, "ab" * 33, "\x00" * 33]
    rows = [("x", f"s{k % 3}", "k", k, a, odd[-k % len(odd)], "b", k) for k, a in enumerate(odd * 2)]
    records = spark.createDataFrame(rows, "session_id string, stream_id string, key_id string, seq long, prev string, chain string, body string, arrival long")
    found = chains.dealt(records)
    assert sorted(map(str, found.collect())) == sorted(map(str, records.collect()))
