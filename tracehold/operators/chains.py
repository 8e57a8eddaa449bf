"""Hash-chained collector streams: breaks, gaps, replays, reordering, status, and the ledger of streams seen before."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracehold.operators.detect import small
from tracehold.sources.shared import kept

SCHEME = "stream/1"
SEPARATOR = "\x1f"
#: Codes that make a session's evidence inadmissible: a question that was answered, and against it.
INADMISSIBLE = (
    "CHAIN_BROKEN", "CHAIN_UNANCHORED", "SEQUENCE_GAP", "SEQUENCE_REPLAY", "PARTIAL_INTEGRITY", "SIGNATURE_INVALID", "KEY_UNKNOWN", "KEY_REVOKED", "KEY_EXPIRED", "KEY_NOT_YET_VALID",
    "KEY_WRONG_ROLE", "STALE", "FROM_FUTURE", "STREAM_REPLAYED", "STREAM_FORKED", "STREAM_KEY_CHANGED", "STREAM_END_MISSING", "RECORDS_AFTER_CLOSE",
)
#: Positions of a stream that a task takes together, so that a hot stream is many groups.
BLOCK = 100_000


def seed(stream_id: Column, key_id: Column) -> Column:
    return F.sha2(F.concat(F.lit(SCHEME + SEPARATOR), stream_id, F.lit(SEPARATOR), key_id, F.lit(SEPARATOR)), 256)


def step(head: Column, body: Column) -> Column:
    return F.sha2(F.concat(head, F.lit(SEPARATOR), body), 256)


def _blocked(records: DataFrame, block: int | None) -> DataFrame:
    """records with _block, by which one shuffle serves all that follows, and is_replay. What holds for a whole stream goes through a row per block; without blocks, through windows over streams."""
    if block is None:
        again = F.row_number().over(Window.partitionBy("stream_id", "seq").orderBy("arrival"))
        first = F.min(F.struct("arrival", "seq")).over(Window.partitionBy("stream_id"))
        return records.withColumn("is_replay", (again > 1) | (F.col("seq") < first["seq"]))
    rows = records.withColumn("_block", F.floor(F.col("seq") / block))
    first = F.min("_first").over(Window.partitionBy("stream_id"))
    firsts = rows.groupBy("stream_id", "_block").agg(F.min(F.struct("arrival", "seq")).alias("_first")).select("stream_id", "_block", first["seq"].alias("_first_seq"))
    again = F.row_number().over(Window.partitionBy("stream_id", "_block", "seq").orderBy("arrival"))
    return rows.join(firsts, ["stream_id", "_block"]).withColumn("is_replay", (again > 1) | (F.col("seq") < F.col("_first_seq"))).drop("_first_seq")


def with_replays(records: DataFrame, block: int | None = BLOCK) -> DataFrame:
    """records with is_replay: a filled position again, or one before the first-arrived position of its stream."""
    return _blocked(records, block).drop("_block")


def with_previous(rows: DataFrame, columns: list[str], block: int | None = BLOCK) -> DataFrame:
    """rows (stream_id, seq) with prev_<column> of the record before in their stream, null for the first.

    A window takes a block of positions; each block's first record gets the last one of the blocks before from a table
    of one row per block. So no task holds a stream, however many records it has. Without blocks a window takes a stream.
    """
    last = F.struct("seq", *(c for c in columns if c != "seq"))
    before = {f"prev_{c}": F.col(f"_before.{c}") for c in columns}
    if block is None:
        return rows.withColumn("_before", F.lag(last).over(Window.partitionBy("stream_id").orderBy("seq"))).withColumns(before).drop("_before")
    within = Window.partitionBy("stream_id", "_block").orderBy("seq")
    blocks = rows if "_block" in rows.columns else rows.withColumn("_block", F.floor(F.col("seq") / block))
    edges = blocks.groupBy("stream_id", "_block").agg(F.max_by(last, "seq").alias("_last"))
    edges = edges.select("stream_id", "_block", F.lag("_last").over(Window.partitionBy("stream_id").orderBy("_block")).alias("_edge")).where("_edge IS NOT NULL")
    near = blocks.withColumns({"_near": F.lag(last).over(within), "_first": F.row_number().over(within) == 1}).join(edges, ["stream_id", "_block"], "left")
    return near.withColumn("_before", F.when(F.col("_first"), F.col("_edge")).otherwise(F.col("_near"))).withColumns(before).drop("_block", "_near", "_first", "_edge", "_before")


def dealt(records: DataFrame) -> DataFrame:
    """records dealt by stream, for what takes streams whole. A digest in hexadecimal is shuffled as its 32 bytes, any other text with 33 more, by which it is told."""
    digests = ("prev", "chain", "body")
    packed = lambda c: F.when(F.col(c).rlike("^[0-9a-f]{64}$"), F.unhex(c)).otherwise(F.concat(F.col(c).cast("binary"), F.lit(bytearray(33))))
    text = lambda c: F.when(F.length(c) == 32, F.lower(F.hex(c))).otherwise(F.substring(c, F.lit(1), F.length(c) - 33).cast("string"))
    parts = int(records.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return records.withColumns({c: packed(c) for c in digests}).repartition(parts, "stream_id").withColumns({c: text(c) for c in digests})


def _folded(rows: DataFrame) -> DataFrame:
    """rows of runs in which records declare no chain, with the head that the steps before come to; sorted within partitions by stream and seq."""
    columns = rows.columns

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        after = ""
        for batch in batches:
            heads = []
            for opens, head, chain, body in zip(batch["opens"], batch["head"], batch["chain"], batch["body"], strict=True):
                head = head if opens else after
                head = head if isinstance(head, str) else ""
                step_ = hashlib.sha256(f"{head}{SEPARATOR}{body}".encode()).hexdigest() if head else ""
                after = chain if isinstance(chain, str) else step_
                heads.append(head or None)
            yield batch.assign(head=pd.Series(heads, dtype=object, index=batch.index))[columns]

    return rows.repartition("stream_id").sortWithinPartitions("stream_id", "seq").mapInPandas(run, rows.schema)


def verified(records: DataFrame, block: int | None = BLOCK) -> DataFrame:
    """Records (session_id, stream_id, key_id, seq, prev, chain, body, arrival) without replays, with head, after, gap, broken, unanchored, midstream, prev_session_id.

    A declared chain is the next record's head, so the record before is all that most records need. Where a record
    declares none, its computed step is the next head: such runs alone are walked one by one. A record after a gap, or
    the first of a stream past position 0, is held against its own prev.

    block None is for streams of few records each: windows take whole streams, so records that are dealt by stream
    already are neither dealt again nor written.
    """
    rows = with_previous(_blocked(records, block).where("NOT is_replay"), ["seq", "chain", "session_id"], block)
    follows = F.coalesce(F.col("seq") == F.col("prev_seq") + 1, F.lit(False)) & (F.col("seq") > 0)
    head = F.when(F.col("seq") == 0, seed(F.col("stream_id"), F.coalesce("key_id", F.lit("")))).when(follows, F.col("prev_chain")).otherwise(F.col("prev"))
    rows = rows.withColumns({"head": head, "opens": ~follows | F.col("prev_chain").isNotNull(), "midstream": F.col("prev_seq").isNull() & (F.col("seq") > 0)})
    if block is None or not records.where("chain IS NULL").isEmpty():
        walked, rows = ~F.col("opens") | F.col("chain").isNull(), rows if block is None else kept(rows, "linked")
        rows = rows.where(~walked).unionByName(_folded(rows.where(walked)))
    mismatch = F.coalesce(F.col("chain") != step(F.col("head"), F.col("body")), F.lit(False)) | F.coalesce(F.col("prev") != F.col("head"), F.lit(False))
    gap = F.coalesce(F.greatest(F.col("seq") - F.col("prev_seq") - 1, F.lit(0)), F.lit(0))
    rows = rows.withColumn("after", F.coalesce("chain", step(F.col("head"), F.col("body")), "head"))
    return rows.withColumns({"gap": gap, "broken": F.col("head").isNotNull() & mismatch, "unanchored": F.col("head").isNull() & (F.col("seq") > 0)}).drop("opens")


def session_codes(records: DataFrame, block: int | None = BLOCK, walked: DataFrame | None = None) -> DataFrame:
    """(session_id, code, n), from verified() of records, if that is at hand as walked: faults charged to the sessions they touch; breaks and gaps also to the record before."""
    flags = F.array_compact(F.array(F.when(F.col("broken"), F.lit("CHAIN_BROKEN")), F.when(F.col("gap") > 0, F.lit("SEQUENCE_GAP"))))
    alone = F.array_compact(F.array(F.when(F.col("unanchored"), F.lit("CHAIN_UNANCHORED")), F.when(F.col("midstream"), F.lit("JOINED_MIDSTREAM"))))
    both = F.array_distinct(F.array_compact(F.array("prev_session_id", "session_id")))
    charged = F.concat(F.flatten(F.transform(flags, lambda code: F.transform(both, lambda s: F.struct(s.alias("session_id"), code.alias("code"))))), F.transform(alone, lambda code: F.struct(F.col("session_id").alias("session_id"), code.alias("code"))))
    found = (verified(records, block) if walked is None else walked).select(F.inline(charged))
    replays = with_replays(records, block).where("is_replay").select("session_id", F.lit("SEQUENCE_REPLAY").alias("code"))
    return replays.unionByName(found).where("session_id IS NOT NULL").groupBy("session_id", "code").agg(F.count("*").alias("n"))


def reordered(records: DataFrame, block: int | None = BLOCK) -> DataFrame:
    """Records that arrive after a later position of their stream."""
    before = Window.partitionBy("stream_id").orderBy("arrival").rowsBetween(Window.unboundedPreceding, -1)
    return with_replays(records, block).where("NOT is_replay").withColumn("reached", F.max("seq").over(before)).where("seq < reached")


def seen(records: DataFrame, ledger: DataFrame) -> DataFrame:
    """records with seen_seq, where a ledger (stream_id, last_seq) has their stream end."""
    return records.join(ledger.select("stream_id", F.col("last_seq").alias("seen_seq")), "stream_id", "left")


def summary(records: DataFrame, walked: DataFrame | None = None, block: int | None = BLOCK) -> DataFrame:
    """Of records, and of verified() of them: each stream's extent, the head that its last record leaves, what its first one says that it follows, and of seen() records the head at seen_seq as now_head.

    Sessions are counted apart: counted distinct beside the heads, every record's heads would be shuffled. The same streams
    are on both sides; an inner join would filter one of them, so that both could not read the same shuffle.
    """
    walked = verified(records, block) if walked is None else walked
    now = [F.max(F.when(F.col("seq") == F.col("seen_seq"), F.col("after"))).alias("now_head")] if "seen_seq" in walked.columns else []
    sessions = with_replays(records, block).where("NOT is_replay").select("stream_id", "session_id").distinct().groupBy("stream_id").agg(F.count("session_id").alias("sessions"))
    return walked.groupBy("stream_id").agg(
        F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"), F.count("*").alias("records"), F.max_by("after", "seq").alias("head"), F.min_by("prev", "seq").alias("first_prev"), *now,
    ).join(sessions, "stream_id", "full_outer")


#: How far the integrity of a session's telemetry was established.
STATUSES = ("unattested", "inadmissible", "chained_unsigned", "verified_prefix", "verified_complete")


def evidence_status(codes: DataFrame, records: DataFrame) -> DataFrame:
    """(session_id, status) of chained records alone: inadmissible, or chained_unsigned; attestation.status() adds all other evidence."""
    bad = codes.where(F.col("code").isin(*INADMISSIBLE)).select("session_id").distinct().withColumn("bad", F.lit(True))
    return records.select("session_id").distinct().join(bad, "session_id", "left").select("session_id", F.when(F.col("bad"), "inadmissible").otherwise("chained_unsigned").alias("status"))


def ledger_status(streams: DataFrame, ledger: DataFrame, records: DataFrame | None = None, walked: DataFrame | None = None) -> DataFrame:
    """streams (summary) against a ledger (stream_id, first_seq, last_seq, head, closed), with status and boundary. Streams of seen() records know their head there, others take their records or verified() of them.

    A stream that reaches back to positions seen before is replayed, or forked if its head there is another one. One
    that goes on from the last position is after_close if that was signed as the end, discontinuous past a gap, forked
    if its first record names another predecessor, and advanced otherwise; boundary says what the join was held against.
    """
    old = ledger.select("stream_id", F.col("last_seq").alias("seen_seq"), F.col("head").alias("seen_head"), "closed")
    joined = streams.join(old, "stream_id", "left")
    if "now_head" not in streams.columns:
        at_seen = (verified(records) if walked is None else walked).select("stream_id", F.col("seq").alias("seen_seq"), F.col("after").alias("now_head"))
        joined = joined.join(at_seen, ["stream_id", "seen_seq"], "left")
    goes_on, next_ = F.col("first_seq") > F.col("seen_seq"), F.col("first_seq") == F.col("seen_seq") + 1
    differs = F.coalesce(F.col("first_prev") != F.col("seen_head"), F.lit(True))
    status = (
        F.when(F.col("seen_seq").isNull(), "new")
        .when(goes_on & F.coalesce("closed", F.lit(False)), "after_close")
        .when(goes_on & ~next_, "discontinuous")
        .when(goes_on & F.col("first_prev").isNotNull() & differs, "forked")
        .when(goes_on, "advanced")
        .when(F.col("now_head").isNotNull() & F.coalesce(F.col("now_head") != F.col("seen_head"), F.lit(True)), "forked")
        .otherwise("replayed")
    )
    boundary = F.when(F.col("seen_seq").isNull(), F.lit(None)).when(~goes_on | F.col("closed"), "not_compared").when(~next_, "gap").when(F.col("first_prev").isNull(), "unstated").when(differs, "differs").when(next_, "match")
    return joined.withColumns({"status": status, "boundary": boundary})


def ledger_next(status: DataFrame, ledger: DataFrame) -> DataFrame:
    """The ledger after a run: streams that held are merged, others only count the run. A stream once closed stays closed."""
    closes = F.col("closes") if "closes" in status.columns else F.lit(False)
    now = status.select("stream_id", "status", F.col("first_seq").alias("f"), F.col("last_seq").alias("l"), F.col("head").alias("h"), closes.alias("closes"))
    held = F.col("status").isin("new", "advanced", "discontinuous")
    return ledger.join(now, "stream_id", "full_outer").select(
        "stream_id",
        F.when(F.col("first_seq").isNull(), F.col("f")).otherwise(F.when(held, F.least("first_seq", "f")).otherwise(F.col("first_seq"))).alias("first_seq"),
        F.when(held, F.greatest("last_seq", "l")).otherwise(F.col("last_seq")).alias("last_seq"),
        F.when(held, F.col("h")).otherwise(F.col("head")).alias("head"),
        (F.coalesce("runs", F.lit(0)) + F.col("status").isNotNull().cast("long")).alias("runs"),
        *([(F.coalesce("closed", F.lit(False)) | (F.coalesce("closes", F.lit(False)) & held)).alias("closed")] if "closed" in ledger.columns else []),
    )


def key_status(signed: DataFrame, keys: DataFrame) -> DataFrame:
    """signed (key_id, role, at) against trust keys (key_id, roles, not_before, not_after, revoked_at); the first test that fails."""
    known = signed.join(small(keys), "key_id", "left")
    status = (
        F.when(F.col("roles").isNull(), "KEY_UNKNOWN")
        .when(~F.array_contains("roles", F.col("role")), "KEY_WRONG_ROLE")
        .when(F.col("at") >= F.col("revoked_at"), "KEY_REVOKED")
        .when(F.col("at") < F.col("not_before"), "KEY_NOT_YET_VALID")
        .when(F.col("at") > F.col("not_after"), "KEY_EXPIRED")
        .otherwise("TRUSTED")
    )
    return known.withColumn("key_status", status)


def freshness(records: DataFrame, as_of: float, max_age: float, skew: float = 300.0) -> DataFrame:
    """records (ts) with age and freshness: fresh, STALE or FROM_FUTURE against a pinned clock; undated without a clock."""
    age = F.lit(as_of) - F.col("ts")
    return records.withColumns({"age": age, "freshness": F.when(F.col("ts").isNull() | F.isnan("ts"), "undated").when(age > max_age, "STALE").when(age < -skew, "FROM_FUTURE").otherwise("fresh")})


def spent_nonces(approvals: DataFrame, spent: DataFrame) -> DataFrame:
    """approvals (nonce, arrival) with use: first use of a nonce wins, later ones and those of earlier runs are spent."""
    order = Window.partitionBy("nonce").orderBy("arrival")
    marked = approvals.withColumn("_nth", F.row_number().over(order)).join(spent.select("nonce", F.lit(True).alias("_spent")).distinct(), "nonce", "left")
    return marked.withColumn("use", F.when(F.col("nonce").isNull(), "no_nonce").when(F.col("_spent") | (F.col("_nth") > 1), "spent").otherwise("first")).drop("_nth", "_spent")
