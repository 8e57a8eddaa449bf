"""What all evidence about collector streams comes to, per session: one table of codes, a status, and the check on integrity."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracehold.operators import chains, signatures

#: What a stream's status against the ledger says of every session that it carries.
LEDGER_CODES = {"forked": "STREAM_FORKED", "replayed": "STREAM_REPLAYED", "discontinuous": "STREAM_SKIPPED_RECORDS", "after_close": "RECORDS_AFTER_CLOSE"}


def _of_streams(streams: DataFrame, records: DataFrame) -> DataFrame:
    """(session_id, code) of streams (stream_id, code): charged to every session that has a record on them."""
    return records.select("session_id", "stream_id").distinct().join(streams, "stream_id").select("session_id", "code")


def codes(
    records: DataFrame, found: DataFrame, keys: DataFrame, ledger: DataFrame | None = None, unattested: DataFrame | None = None, as_of: float | None = None, max_age: float = float("inf"), require_closed: bool = False,
    walked: DataFrame | None = None,
) -> DataFrame:
    """(session_id, code, n) from chains, signatures, keys, freshness, closure, the ledger and missing sidecars.

    records: as chains.verified() takes them. found: signatures.results() of the signed ones. ledger: streams of earlier
    runs. walked: chains.verified() of records, if at hand. unattested: (session_id) of records without a sidecar. Chain breaks and gaps are charged to both neighbours; a
    signature, a change of key, an age and a record after a close to the record's session; closure and ledger codes to
    every session of the stream. Ages are taken of verified records only: no other clock is vouched for.
    """
    charge = lambda rows, code: rows.select("session_id", F.lit(code).alias("code"))
    parts = [chains.session_codes(records, walked=walked).select("session_id", "code", "n")]
    once = [found.where("result <> 'VERIFIED'").select("session_id", F.col("result").alias("code")), charge(signatures.key_changes(found, keys), "STREAM_KEY_CHANGED")]
    if as_of is not None:
        once.append(chains.freshness(found.where("held"), as_of, max_age).where("freshness IN ('STALE', 'FROM_FUTURE')").select("session_id", F.col("freshness").alias("code")))
    ends = signatures.closure(records, found, require_closed)
    late = records.join(ends.where("closed_at IS NOT NULL").select("stream_id", "closed_at"), "stream_id").where("seq > closed_at")
    once.append(charge(late, "RECORDS_AFTER_CLOSE"))
    open_ = ends.where("closed_at IS NULL").select("stream_id", F.explode(F.split("codes", ",")).alias("code"))
    once.append(_of_streams(open_, records))
    if ledger is not None:
        seen = chains.ledger_status(chains.summary(records, walked), ledger, records, walked)
        code = reduce(lambda c, k: c.when(F.col("status") == k, LEDGER_CODES[k]), LEDGER_CODES, F.when(F.lit(False), ""))
        both = F.array_compact(F.array(code, F.when(F.col("boundary") == "unstated", F.lit("STREAM_BOUNDARY_UNVERIFIED"))))
        once.append(_of_streams(seen.select("stream_id", F.explode(both).alias("code")), records))
    if unattested is not None:
        once.append(charge(unattested.select("session_id").distinct().join(records.select("session_id").distinct(), "session_id"), "PARTIAL_INTEGRITY"))
    parts.append(reduce(DataFrame.unionByName, once).where("session_id IS NOT NULL").groupBy("session_id", "code").agg(F.count("*").alias("n")))
    return reduce(DataFrame.unionByName, parts).groupBy("session_id", "code").agg(F.sum("n").alias("n"))


def inadmissible() -> Column:
    return F.col("code").isin(*chains.INADMISSIBLE)


def status(sessions: DataFrame, records: DataFrame, found: DataFrame, code_table: DataFrame) -> DataFrame:
    """(session_id, status), one of chains.STATUSES, of sessions (session_id).

    Without a sidecar a session is unattested; with an inadmissible code it is inadmissible, whatever was verified;
    without a signature of its own it is chained_unsigned; else verified as far as signatures reach on all its streams.
    """
    reach = signatures.session_reach(records, signatures.ranges(records, found))
    tried = found.where("result NOT IN ('KEY_UNKNOWN', 'KEY_WRONG_ROLE', 'KEY_REVOKED')").select("session_id").distinct().withColumn("_tried", F.lit(True))
    bad = code_table.where(inadmissible()).select("session_id").distinct().withColumn("_bad", F.lit(True))
    word = (
        F.when(F.col("covers_final").isNull(), "unattested").when(F.col("_bad"), "inadmissible").when(F.col("_tried").isNull(), "chained_unsigned")
        .when(F.col("covers_final"), "verified_complete").otherwise("verified_prefix")
    )
    return sessions.select("session_id").distinct().join(reach, "session_id", "left").join(tried, "session_id", "left").join(bad, "session_id", "left").select("session_id", word.alias("status"))


def ch06_integrity(code_table: DataFrame) -> DataFrame:
    """Sessions whose evidence is inadmissible, with the codes that make it so."""
    return code_table.where(inadmissible()).groupBy("session_id").agg(F.array_join(F.array_sort(F.collect_set("code")), ",").alias("codes"), F.lit("critical").alias("severity"))


def positions(events: DataFrame, spans: DataFrame, code_table: DataFrame) -> DataFrame:
    """events (session_id, stream_id, seq) with at_stream and at_seq: their position where it is verified, else null.

    A position counts when a signature that held reaches it and the session has no inadmissible code; any other is as if
    it were not there. spans: signatures.ranges().
    """
    bad = code_table.where(inadmissible()).select("session_id").distinct().withColumn("_bad", F.lit(True))
    known = events.join(spans.select("stream_id", "verified_to"), "stream_id", "left").join(bad, "session_id", "left")
    good = F.col("_bad").isNull() & F.coalesce(F.col("seq") <= F.col("verified_to"), F.lit(False))
    return known.withColumns({"at_stream": F.when(good, F.col("stream_id")), "at_seq": F.when(good, F.col("seq"))}).drop("_bad", "verified_to")
