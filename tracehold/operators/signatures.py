"""Signatures over chain heads: which held, how far they reach, under whose key, and whether a stream was closed."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from tracehold.functions import ed25519
from tracehold.operators.chains import SCHEME, SEPARATOR
from tracehold.operators.detect import DIMENSION_ROWS, small

STORE = "struct<keys:map<string,struct<key:string,roles:array<string>,not_before:double,not_after:double,revoked_at:double,replaces:string>>>"
#: Results of a signature that held: a clock outside of the key's window does not undo it.
HELD = ("VERIFIED", "KEY_EXPIRED", "KEY_NOT_YET_VALID")


class StoreError(ValueError):
    """A trust store that is refused whole."""


def message(stream_id: Column, seq: Column, chain: Column, final: Column) -> Column:
    """What is signed: the chain head with its place, and for a closing record that it is one."""
    head = F.concat_ws(SEPARATOR, F.lit(SCHEME), stream_id, seq.cast("string"), F.coalesce(chain, F.lit("")))
    return F.when(final, F.concat(head, F.lit(SEPARATOR + "final"))).otherwise(head)


def trust_store(spark: SparkSession, text: DataFrame) -> DataFrame:
    """(key_id, public, roles, not_before, not_after, revoked_at, replaces) of one JSON document (value); refused if any key is unsound."""
    parsed = text.select(F.from_json("value", STORE).alias("s"))
    keys = parsed.select(F.explode("s.keys").alias("key_id", "k")).select("key_id", F.expr("try_to_binary(k.key, 'base64')").alias("public"), "k.roles", "k.not_before", "k.not_after", "k.revoked_at", "k.replaces")
    unsound = ~_usable("public") | F.col("roles").isNull() | (F.size("roles") == 0) | (F.col("not_before") > F.col("not_after")) | (F.col("replaces") == F.col("key_id"))
    if not parsed.where("s.keys IS NULL").isEmpty() or not keys.where(F.coalesce(unsound, F.lit(False))).isEmpty():
        raise StoreError("a key of the trust store is unsound")
    return keys


@F.pandas_udf(BooleanType())
def _usable(public: pd.Series) -> pd.Series:
    return pd.Series([ed25519.usable_key(p) for p in public], dtype=bool)


@F.pandas_udf(BooleanType())
def holds(public: pd.Series, signed: pd.Series, sig: pd.Series) -> pd.Series:
    rows = list(zip(public, [m.encode() for m in signed], sig, strict=True))
    once = list(dict.fromkeys(rows))
    return pd.Series(map(dict(zip(once, ed25519.verify_all(once), strict=True)).__getitem__, rows), dtype=bool)


def even(rows: DataFrame, public: str, signed: str, sig: str) -> DataFrame:
    """rows dealt evenly over as many tasks as shuffles have, those of one key and equal ones together in a task."""
    parts = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    return rows.repartition(parts, public, F.pmod(F.xxhash64(signed, sig), F.lit(16 * parts))).sortWithinPartitions(public, signed, sig)


def results(signed: DataFrame, keys: DataFrame, role: str = "collector") -> DataFrame:
    """signed (stream_id, session_id, seq, chain, final, key_id, sig binary, ts) with result and held.

    Unknown keys, wrong roles and revoked keys are told from the store alone, before any signature is computed; then the
    signature; only then the record's clock, which nothing vouches for before. Signatures are dealt evenly over all
    tasks and sorted by key, so that a key that signs often is prepared once in a task, and equal ones are computed once.
    """
    known = signed.join(small(keys.select("key_id", "public", "roles", "not_before", "not_after", "revoked_at")), "key_id", "left").withColumn("message", message(F.col("stream_id"), F.col("seq"), F.col("chain"), F.col("final")))
    early = F.when(F.col("roles").isNull(), "KEY_UNKNOWN").when(~F.array_contains("roles", role), "KEY_WRONG_ROLE").when(F.col("revoked_at").isNotNull(), "KEY_REVOKED")
    known = known.withColumn("early", early).withColumn("_tried", F.when(F.col("early").isNull(), F.col("public")))
    judged = even(known, "_tried", "message", "sig").withColumn("holds", holds("_tried", "message", "sig"))
    late = F.when(~F.coalesce("holds", F.lit(False)), "SIGNATURE_INVALID").when(F.col("ts") < F.col("not_before"), "KEY_NOT_YET_VALID").when(F.col("ts") > F.col("not_after"), "KEY_EXPIRED").otherwise("VERIFIED")
    found = judged.withColumn("result", F.coalesce("early", late)).withColumn("held", F.col("result").isin(*HELD))
    return found.drop("early", "_tried", "holds", "message", "public", "roles", "not_before", "not_after", "revoked_at")


def ranges(records: DataFrame, found: DataFrame) -> DataFrame:
    """(stream_id, first_seq, last_seq, verified_to): a verified head covers all records before it."""
    reach = found.where("held").groupBy("stream_id").agg(F.max("seq").alias("verified_to"))
    return records.groupBy("stream_id").agg(F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq")).join(reach, "stream_id", "left")


def session_reach(records: DataFrame, spans: DataFrame) -> DataFrame:
    """(session_id, coverage, covers_final): the share of the records of a session's streams that signatures reach, and whether all ends are."""
    own = records.select("session_id", "stream_id").distinct().join(spans, "stream_id")
    reach = F.greatest(F.least("verified_to", "last_seq") - F.col("first_seq") + 1, F.lit(0))
    total = F.sum(F.col("last_seq") - F.col("first_seq") + 1)
    return own.groupBy("session_id").agg(
        F.round(F.coalesce(F.sum(F.when(F.col("verified_to").isNotNull(), reach)), F.lit(0)) / total, 6).alias("coverage"),
        F.bool_and(F.coalesce(F.col("verified_to") >= F.col("last_seq"), F.lit(False))).alias("covers_final"),
    )


def successions(keys: DataFrame) -> set[tuple[str, str]]:
    """(key, predecessor) for each key and all that it replaces, directly or not; the store is a small dimension."""
    replaces = {r["key_id"]: r["replaces"] for r in keys.select("key_id", "replaces").limit(DIMENSION_ROWS + 1).collect()}
    if len(replaces) > DIMENSION_ROWS:
        raise StoreError("the trust store has too many keys")
    found = set()
    for key in replaces:
        seen, at = {key}, replaces[key]
        while at is not None and at not in seen:
            found.add((key, at))
            seen.add(at)
            at = replaces.get(at)
    return found


def key_changes(found: DataFrame, keys: DataFrame) -> DataFrame:
    """(stream_id, seq, session_id, from_key_id, to_key_id) of verified records under a key that does not succeed the stream's own.

    A stream is pinned to the key that first verified in it, and pinned anew by a declared successor. Only records whose
    key differs from the one before can change that; these few are folded per stream.
    """
    order = Window.partitionBy("stream_id").orderBy("seq")
    held = found.where("held").select("stream_id", "seq", "key_id", "session_id")
    turns = held.withColumn("before", F.lag("key_id").over(order)).where("before IS NULL OR before <> key_id")
    after = F.array(*(F.lit(f"{a}{SEPARATOR}{b}") for a, b in sorted(successions(keys)))).cast("array<string>")
    pins = turns.groupBy("stream_id").agg(F.array_sort(F.collect_list(F.struct("seq", "key_id"))).alias("turns"))
    first = F.struct(F.lit(None).cast("string").alias("pin"), F.array().cast("array<struct<seq:long,pin:string>>").alias("out"))

    def pinned(acc: Column, x: Column) -> Column:
        moves = acc["pin"].isNull() | (x["key_id"] == acc["pin"]) | F.array_contains(after, F.concat(x["key_id"], F.lit(SEPARATOR), acc["pin"]))
        pin = F.when(F.coalesce(moves, F.lit(True)), x["key_id"]).otherwise(acc["pin"])
        return F.struct(pin.alias("pin"), F.concat(acc["out"], F.array(F.struct(x["seq"].alias("seq"), pin.alias("pin")))).alias("out"))

    at = pins.select("stream_id", F.inline(F.aggregate("turns", first, pinned, lambda acc: acc["out"])))
    joined = held.join(at, ["stream_id", "seq"], "left").withColumn("pin", F.last("pin", ignorenulls=True).over(order))
    return joined.where("key_id <> pin").select("stream_id", "seq", "session_id", F.col("pin").alias("from_key_id"), F.col("key_id").alias("to_key_id"))


def closure(records: DataFrame, found: DataFrame, required: bool = False) -> DataFrame:
    """(stream_id, closed_at, n_after_close, codes): a close counts from the first verified closing record on."""
    ends = found.where("final").groupBy("stream_id").agg(F.min(F.when(F.col("held"), F.col("seq"))).alias("closed_at"), F.lit(True).alias("final_seen"))
    joined = records.select("stream_id", "seq").join(ends, "stream_id", "left")
    per = joined.groupBy("stream_id").agg(F.first("closed_at").alias("closed_at"), F.first("final_seen").alias("final_seen"), F.count_if(F.col("seq") > F.col("closed_at")).alias("n_after_close"))
    open_ = F.col("closed_at").isNull()
    codes = F.array(
        F.when(F.col("n_after_close") > 0, "RECORDS_AFTER_CLOSE"), F.when(open_, "STREAM_NOT_CLOSED"), F.when(open_ & F.coalesce("final_seen", F.lit(False)), "CLOSE_UNVERIFIED"),
        F.when(open_ & F.lit(required), "STREAM_END_MISSING"),
    )
    return per.select("stream_id", "closed_at", "n_after_close", F.array_join(F.array_compact(codes), ",").alias("codes"))
