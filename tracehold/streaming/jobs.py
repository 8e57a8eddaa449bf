"""The same logic on streams: rates, duplicate drop, quarantine, and sessions with an explicit end."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, TimerValues

from tracehold.operators import chains
from tracehold.sources.jsonl import quarantined


def alert_rates(events: DataFrame, late: str = "10 minutes", window: str = "1 hour", slide: str = "15 minutes") -> DataFrame:
    """Policy events and errors of an agent per sliding window; events (at timestamp, agent_name, event_type)."""
    bad = events.where(F.col("event_type").isin("tool_error", "cost_threshold_exceeded", "depth_exceeded")).withWatermark("at", late)
    return bad.groupBy(F.window("at", window, slide), "agent_name").agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "agent_name", "n")


def dropped_duplicates(events: DataFrame, keys: list[str], late: str = "1 hour") -> DataFrame:
    """The first delivery of each record; state is kept for the watermark only."""
    return events.withWatermark("at", late).dropDuplicatesWithinWatermark(keys)


def quarantine(lines: DataFrame) -> DataFrame:
    """lines with reject_code; split_quarantine() parts them."""
    return quarantined(lines)


def followed_by(guards: DataFrame, starts: DataFrame, seconds: int = 300, late: str = "10 minutes") -> DataFrame:
    """(session_id, guard, call): consequential starts within seconds after a guardrail spoke in their session.

    guards and starts: streams (session_id, at timestamp, arrival). Both have a watermark and the interval bounds the join,
    so each side's state is kept for as long as a partner may still come, and no longer.
    """
    spoke = guards.select(F.col("session_id").alias("_session"), F.col("at").alias("_at"), F.col("arrival").alias("guard")).withWatermark("_at", late)
    began = starts.select("session_id", "at", F.col("arrival").alias("call")).withWatermark("at", late)
    within = F.expr(f"session_id = _session AND at >= _at AND at <= _at + INTERVAL {int(seconds)} SECONDS")
    return spoke.join(began, within, "inner").select("session_id", "guard", "call")


SESSION = "session_id string, started_at double, ended_at double, events long, closed_by string"
_STATE = "started_at double, ended_at double, events long"


def sessions(events: DataFrame, idle: float = 1800.0, late: str = "10 minutes") -> DataFrame:
    """Sealed sessions of events (session_id, at, ts, event_type), each with the rule that closed it.

    A session ends with its agent_end event, by a pause of more than idle seconds before its next event, or when the
    watermark passes its last event by idle seconds. A later event opens another session of the same id; a sealed one
    never changes.
    """

    def advance(key: tuple[str], parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        start, end, n = state.get if state.exists else (None, None, 0)
        sealed = []

        def seal(rule: str) -> None:
            sealed.append((key[0], start, end, n, rule))

        if state.hasTimedOut:
            seal("idle")
            state.remove()
        else:
            rows = pd.concat(list(parts)).sort_values("ts")
            for ts, kind in zip(rows["ts"].tolist(), rows["event_type"].tolist(), strict=True):
                if n and ts - end > idle:
                    seal("pause")
                    start, n = None, 0
                start, end, n = (ts if start is None else min(start, ts)), (ts if not n else max(end, ts)), n + 1
                if kind == "agent_end":
                    seal("agent_end")
                    start, end, n = None, None, 0
            if n:
                state.update((start, end, n))
                state.setTimeoutTimestamp(max(int((end + idle) * 1000), state.getCurrentWatermarkMs() + 1))
            elif state.exists:
                state.remove()
        yield pd.DataFrame(sealed, columns=[c.split()[0] for c in SESSION.split(", ")])

    rows = events.select("session_id", "at", "ts", "event_type").withWatermark("at", late)
    return rows.groupBy("session_id").applyInPandasWithState(advance, SESSION, _STATE, "append", GroupStateTimeout.EventTimeTimeout)


_STORE = "spark.sql.streaming.stateStore.providerClass"
SEALED = "session_id string, started_at double, ended_at double, events long, session_completion string, incomplete boolean, late_ts double, late_event string"
#: Rules by which a session may be completed, and those of them that a producer cannot bring about or put off by its clock.
COMPLETIONS = ("terminal_event", "sequence_advance", "idle_timeout")


class _Completion(StatefulProcessor):
    """One session's state: open, with its extent and open calls, or sealed for as long as late records are watched for."""

    def __init__(self, idle: float, advance: int, remember: float):
        self.idle, self.advance, self.remember = idle, advance, remember

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("session", "started double, ended double, events long, calls long, last_seq long, sealed boolean")

    def _timer(self, seconds: float) -> None:
        for at in list(self.handle.listTimers()):
            self.handle.deleteTimer(int(at))
        self.handle.registerTimer(int(seconds * 1000))

    def handleInputRows(self, key: tuple[str], rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        started, ended, n, calls, last, sealed = self.state.get() if self.state.exists() else (None, None, 0, 0, None, False)
        out = []
        for ts, kind, seq, reached in pd.concat(list(rows)).sort_values(["ts", "seq"])[["ts", "event_type", "seq", "reached"]].itertuples(index=False, name=None):
            if sealed:
                if kind != "tick":
                    out.append((key[0], None, None, None, None, None, ts, kind))
                continue
            if kind != "tick":
                started, ended, n = ts if started is None else min(started, ts), ts if ended is None else max(ended, ts), n + 1
                calls += {"tool_start": 1, "tool_end": -1, "tool_error": -1}.get(kind, 0)
                last = seq if last is None or seq > last else last
            rule = "terminal_event" if kind == "agent_end" else "sequence_advance" if n and last is not None and reached is not None and reached == reached and reached - last >= self.advance else None
            if rule:
                out.append((key[0], started, ended, n, rule, rule != "terminal_event" or calls > 0, None, None))
                sealed = True
        if n or sealed:
            self.state.update((started, ended, n, calls, last, sealed))
            wait = (ended if ended is not None else 0.0) + (self.remember if sealed else self.idle)
            self._timer(max(wait, timerValues.getCurrentWatermarkInMs() / 1000 + 0.001))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in SEALED.split(", ")])

    def handleExpiredTimer(self, key: tuple[str], timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        started, ended, n, calls, last, sealed = self.state.get() if self.state.exists() else (None, None, 0, 0, None, True)
        out = []
        if not sealed:
            out.append((key[0], started, ended, n, "idle_timeout", True, None, None))
            self.state.update((started, ended, n, calls, last, True))
            self._timer(max(ended + self.remember, timerValues.getCurrentWatermarkInMs() / 1000 + 0.001))
        else:
            self.state.clear()
        yield pd.DataFrame(out, columns=[c.split()[0] for c in SEALED.split(", ")])

    def close(self) -> None:
        pass


def completed(events: DataFrame, idle: float = 1800.0, advance: int = 1_000_000, remember: float = 86_400.0, late: str = "10 minutes") -> DataFrame:
    """Completed sessions and late records (SEALED) of a stream events (session_id, at, ts, event_type, seq, reached).

    A session is sealed by its agent_end, when its collector stream has verifiably reached advance positions past its
    last record (reached; an event of type tick tells it without being one), or when the watermark passes its last event
    by idle seconds; session_completion names the rule, and incomplete says that the end was not stated or left calls
    open. A sealed session never changes: a record that comes later is a row with late_ts and late_event, for as long as
    the watermark is within remember seconds of the session's end; after that its id opens a new session.
    """
    rows = events.select("session_id", "at", "ts", "event_type", "seq", "reached").withWatermark("at", late)
    return rows.groupBy("session_id").transformWithStateInPandas(_Completion(idle, advance, remember), SEALED, "Append", "EventTime")


def split_completed(events: DataFrame, folder: str, **rules: float) -> None:
    """Writes sealed sessions and late records to two tables in folder, batch by batch, and stops when all is taken."""

    def taken(batch: DataFrame, number: int) -> None:
        batch.where("late_event IS NULL").drop("late_ts", "late_event").write.mode("overwrite").parquet(f"{folder}/sealed/batch={number}")
        batch.where("late_event IS NOT NULL").select("session_id", "late_ts", "late_event").write.mode("overwrite").parquet(f"{folder}/late/batch={number}")

    conf = events.sparkSession.conf
    before = conf.get(_STORE)
    conf.set(_STORE, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")  # timers need column families
    try:
        run = completed(events, **rules).writeStream.foreachBatch(taken).outputMode("append").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    finally:
        conf.set(_STORE, before)
    run.awaitTermination()


RECORD_COLUMNS = ("session_id", "stream_id", "key_id", "seq", "prev", "chain", "body", "arrival")
LEDGER = "stream_id string, first_seq long, last_seq long, head string, runs long, closed boolean"


def latest_ledger(spark: SparkSession, folder: str) -> DataFrame:
    """The ledger's last version in folder, empty before the first batch. Versions are whole tables, so a lost batch is run again."""
    versions = spark.read.schema(LEDGER + ", version long").option("basePath", f"{folder}/ledger").parquet(f"{folder}/ledger") if _versions(spark, folder) else None
    if versions is None:
        return spark.createDataFrame([], LEDGER)
    last = versions.agg(F.max("version")).first()[0]
    return versions.where(F.col("version") == last).drop("version")


def _versions(spark: SparkSession, folder: str) -> bool:
    try:
        spark.read.schema(LEDGER).parquet(f"{folder}/ledger")
    except AnalysisException:  # no batch has written one yet
        return False
    return True


def run_ledger(records: DataFrame, folder: str, block: int | None = chains.BLOCK) -> None:
    """Takes what records (RECORD_COLUMNS, and final where verified closes are known) hold so far into the ledger in folder, one version per batch, and stops.

    A batch that is run again writes its version again, from the version before it. block None takes streams whole, as
    chains.verified() does.
    """
    spark = records.sparkSession

    def taken(batch: DataFrame, number: int) -> None:
        before = latest_ledger(spark, folder)
        ends = batch.where("final").select("stream_id", F.lit(True).alias("closes")).distinct() if "final" in batch.columns else None
        batch = batch if block else chains.dealt(batch)
        status = chains.ledger_status(chains.summary(chains.seen(batch, before), block=block), before)
        status = status if ends is None else status.join(ends, "stream_id", "left")
        chains.ledger_next(status, before).write.mode("overwrite").parquet(f"{folder}/ledger/version={number}")

    run = records.writeStream.foreachBatch(taken).option("checkpointLocation", f"{folder}/ledger-state").trigger(availableNow=True).start()
    run.awaitTermination()


def split_quarantine(lines: DataFrame, folder: str) -> None:
    """Writes accepted and rejected lines of a stream to two sinks, batch by batch, and stops when all is taken."""

    def taken(batch: DataFrame, number: int) -> None:
        judged = quarantined(batch)
        judged.where("reject_code IS NULL").write.mode("overwrite").parquet(f"{folder}/accepted/batch={number}")
        judged.where("reject_code IS NOT NULL").write.mode("overwrite").parquet(f"{folder}/rejected/batch={number}")

    run = lines.writeStream.foreachBatch(taken).option("checkpointLocation", f"{folder}/split-state").trigger(availableNow=True).start()
    run.awaitTermination()
