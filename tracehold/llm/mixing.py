"""Mixing sources to target weights by weighted fair queueing.

Every document joins its source's queue once per epoch, in an order shuffled by hash. A queued copy's virtual finish
time is the number of its source's words up to and with it, divided by the source's target. Copies are range-sorted by
that time over all sources and the queue is cut where the total budget is spent, so each source has then sent about
its target.

No queue and no slice of the global order is summed in one task: words are first summed per hash bucket of a queue
and per slot of virtual time, and only the short tables of sums are accumulated by window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracehold.llm.storage import written

WEIGHTS = (3, 1, 2)
BUDGET = 1.5
EPOCHS = 2
#: Hash buckets of a queue (4 hex digits) and slots of virtual time; both only bound the rows that one task sorts.
BUCKET_DIGITS = 3
SLOTS = 16384

#: Sources up to which their targets are broadcast; beyond, they are joined.
BROADCAST_SOURCES = 100_000

WORD = r"[^\x20\x09-\x0D]+"


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, budget: float = BUDGET, epochs: int = EPOCHS) -> DataFrame:
    """(source, source_size, target): shares of budget times all words by weight, none above epochs times its size.

    Sources by code point, null last, weigh 3, 1, 2 in turn. A source that hits its ceiling keeps it and the others
    share what is left: with sources sorted by ceiling over weight, the level is that of the first prefix of ceilings
    whose level does not pass the next ratio.
    """
    every = Window.orderBy(F.col("source").asc_nulls_last())
    by_ratio = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.row_number().over(every) - 1) % len(WEIGHTS) + 1)
    ranked = (
        sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
        .withColumn("weight", weight.cast("long"))
        .withColumn("ceiling", (F.col("source_size") * epochs).cast("long"))
        .withColumn("ratio", F.col("ceiling") / F.col("weight"))
    )
    all_rows = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (F.sum("source_size").over(all_rows) * F.lit(budget) - F.coalesce(F.sum("ceiling").over(before), F.lit(0))) / (
        F.sum("weight").over(all_rows) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    )
    leveled = ranked.withColumn("level", level)
    # the first source below its ceiling sets the level for itself and all after it
    open_level = F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", F.col("source").isNull(), "source", "level"))).over(all_rows)
    return leveled.withColumn("open_level", open_level.getField("level")).select(
        "source", "source_size",
        F.when(F.col("open_level").isNull() | (F.col("level") > F.col("ratio")), F.col("ceiling").cast("double"))
        .otherwise(F.least(F.col("open_level") * F.col("weight"), F.col("ceiling").cast("double"))).alias("target"),
    )


def mix(docs: DataFrame, budget: float = BUDGET, epochs: int = EPOCHS, key: str | None = None) -> DataFrame:
    """One row per row of docs (doc_id, source, text): doc_id, source, size, source_size, target, taken, copies.

    size is the number of words (null text: 0), taken the words that the mix holds of this document, copies how often
    it holds it. Null sources are one source, ordered last. Documents without words are taken in no epoch. Repeated
    rows are documents of their own; among equal doc_ids and sizes either may be the last one taken. An empty table
    gives an empty result; other columns of docs play no part, but for key: a column that tells all rows apart, which
    is added to the result, deals out rows without a doc_id and orders equal ones.
    """
    own = [key] if key else []
    name = F.coalesce(F.col("doc_id").cast("string"), *(F.concat(F.lit("row "), k) for k in own), F.lit(""))
    order = lambda e: F.md5(F.concat_ws(":", name, F.lit(str(e))))
    sized = docs.select(*own, "doc_id", "source", n_words(F.col("text")).alias("size"))
    sizes = written(sized.withColumns({f"order{e}": order(e) for e in range(epochs)}), "mix-sizes")
    shares = written(targets(sizes, budget, epochs), "mix-targets")

    few = shares.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES
    rows = sizes.join(F.broadcast(shares) if few else shares, sizes["source"].eqNullSafe(shares["source"])).drop(shares["source"])
    for e in range(epochs):
        rows = rows.withColumn(f"bucket{e}", F.substring(f"order{e}", 1, BUCKET_DIGITS))
        sums = sizes.groupBy("source", F.substring(f"order{e}", 1, BUCKET_DIGITS).alias("bucket")).agg(F.sum("size").alias("words"))
        ahead = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
        sums = sums.select(F.col("source").alias("of"), F.col("bucket").alias("at"), F.coalesce(F.sum("words").over(ahead), F.lit(0)).alias(f"ahead{e}"))
        rows = rows.join(sums, F.col("source").eqNullSafe(F.col("of")) & (F.col(f"bucket{e}") == F.col("at"))).drop("of", "at")
        within = Window.partitionBy("source", f"bucket{e}").orderBy(f"order{e}", "size", *own).rowsBetween(Window.unboundedPreceding, 0)
        done = F.col("source_size") * e + F.col(f"ahead{e}") + F.sum("size").over(within)
        rows = rows.withColumn(f"finish{e}", F.when((F.col("size") > 0) & (F.col("target") > 0), done / F.col("target")))
    queue = written(
        rows.select(*own, "doc_id", "source", "size", "source_size", "target", F.array(*(F.struct(F.col(f"finish{e}").alias("finish"), F.col(f"order{e}").alias("tie")) for e in range(epochs))).alias("queued")),
        "mix-queue",
    )

    slot = F.floor(F.col("finish") * (SLOTS // 2)).cast("long")
    copies = queue.select("size", F.inline("queued")).where("finish IS NOT NULL AND finish < 2").withColumn("slot", slot)
    total = shares.agg(F.coalesce(F.sum("target"), F.lit(0.0)).alias("total"))
    sent = copies.groupBy("slot").agg(F.sum("size").alias("words"))
    up_to = Window.orderBy("slot").rowsBetween(Window.unboundedPreceding, 0)
    slots = sent.withColumn("sent", F.sum("words").over(up_to)).crossJoin(F.broadcast(total))
    crossing = slots.where("sent > total").agg(F.min_by(F.struct("slot", (F.col("sent") - F.col("words")).alias("ahead"), "total"), "slot").alias("at")).where("at IS NOT NULL").select("at.*")
    in_slot = Window.orderBy("finish", "tie").rowsBetween(Window.unboundedPreceding, 0)
    last = (
        copies.join(F.broadcast(crossing), "slot")
        .withColumn("sent", F.col("ahead") + F.sum("size").over(in_slot))
        .where("sent > total")
        .agg(F.min(F.struct("finish", "tie")).alias("first_refused"))
    )
    taken = F.size(F.filter("queued", lambda x: x["finish"].isNotNull() & (F.col("first_refused").isNull() | (F.struct(x["finish"], x["tie"]) < F.col("first_refused"))))).cast("long")
    return queue.crossJoin(F.broadcast(last)).select(*own, "doc_id", "source", "size", "source_size", "target", (F.col("size") * taken).alias("taken"), taken.alias("copies"))
