"""Measures of detections on labelled sessions."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracehold.operators import anchors
from tracehold.sources.shared import kept

Z95 = 1.959963984540054
PREVALENCES = (0.001, 0.01, 0.05)
#: Different rows of cluster counts that a task of the bootstrap resamples.
BLOCK = 10_000


def counts(outcomes: DataFrame, *by: str) -> DataFrame:
    """tp, fp, fn, tn of outcomes (is_attack, alerted)."""
    a, f = F.col("is_attack"), F.col("alerted")
    return outcomes.groupBy(*by).agg(F.count_if(a & f).alias("tp"), F.count_if(~a & f).alias("fp"), F.count_if(a & ~f).alias("fn"), F.count_if(~a & ~f).alias("tn"))


def ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b)


def rates(confusion: DataFrame) -> DataFrame:
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return confusion.withColumns({
        "recall": F.round(ratio(tp, tp + fn), 6), "fpr": F.round(ratio(fp, fp + tn), 6), "precision": F.round(ratio(tp, tp + fp), 6),
        "f1": F.round(ratio(2 * tp, 2 * tp + fp + fn), 6), "fp_per_1000": F.round(ratio(1000 * fp, fp + tn), 6),
    })


def wilson(successes: Column, total: Column, z: float = Z95) -> tuple[Column, Column]:
    """Bounds of the Wilson score interval; (0, 1) without observations."""
    n = F.when(total > 0, total.cast("double"))
    p, z2 = successes / n, z * z
    centre = (p + z2 / (2 * n)) / (1 + z2 / n)
    half = F.lit(z) / (1 + z2 / n) * F.sqrt(p * (1 - p) / n + z2 / (4 * n * n))
    return F.coalesce(F.greatest(F.lit(0.0), centre - half), F.lit(0.0)), F.coalesce(F.least(F.lit(1.0), centre + half), F.lit(1.0))


def base_rate(confusion: DataFrame) -> DataFrame:
    """Precision at prevalences that the corpus does not have."""
    r, f = ratio(F.col("tp"), F.col("tp") + F.col("fn")), ratio(F.col("fp"), F.col("fp") + F.col("tn"))
    rows = confusion.withColumn("prevalence", F.explode(F.array(*map(F.lit, PREVALENCES))))
    hit, miss = r * F.col("prevalence"), f * (1 - F.col("prevalence"))
    return rows.select("prevalence", F.round(ratio(hit, hit + miss), 6).alias("precision"))


def bootstrap(clusters: DataFrame, draws: int = 2000, seed: int = 7, block: int = BLOCK) -> DataFrame:
    """2.5%, 50% and 97.5% of recall and false-positive rate over resampled clusters (tp, fp, fn, tn).

    Clusters with the same counts are one row with a number of clusters. These rows are dealt into blocks of about block
    of them; a draw is first shared out over the blocks and then, within each block, over its rows, both multinomially,
    which is the same as one multinomial over all of them. Each task resamples one block for all draws.
    """
    names = ["tp", "fp", "fn", "tn"]
    rows = clusters.groupBy(*names).agg(F.count("*").alias("n"))
    blocks = max(1, -(-rows.count() // block))
    rows = rows.withColumn("block", F.pmod(F.xxhash64(*names), F.lit(blocks)).cast("int"))
    weights = np.zeros(blocks)  # one number for each block
    for r in rows.groupBy("block").agg(F.sum("n").alias("n")).collect():
        weights[r["block"]] = r["n"]
    total = int(weights.sum())

    def drawn(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(names)
        own, counts_, b = part["n"].to_numpy(float), part[names].to_numpy(np.int64), int(part["block"].iloc[0])
        picked = np.zeros((draws, len(names)), np.int64)
        for draw in range(draws):
            size = np.random.default_rng([seed, draw]).multinomial(total, weights / total)[b]
            picked[draw] = np.random.default_rng([seed, draw, b]).multinomial(size, own / own.sum()) @ counts_
        return pd.DataFrame({"draw": np.arange(draws), **{c: picked[:, k] for k, c in enumerate(names)}})

    parts = rows.groupBy("block").applyInPandas(drawn, "draw long, tp long, fp long, fn long, tn long")
    sums = parts.groupBy("draw").agg(*(F.sum(c).alias(c) for c in names))
    every = sums.select(ratio(F.col("tp"), F.col("tp") + F.col("fn")).alias("recall"), ratio(F.col("fp"), F.col("fp") + F.col("tn")).alias("fpr"))
    at = F.array(F.lit(0.025), F.lit(0.5), F.lit(0.975))
    return every.agg(F.percentile("recall", at).alias("recall"), F.percentile("fpr", at).alias("fpr"))


def split(rows: DataFrame, unit: str, strata: list[str], train: float = 0.5) -> DataFrame:
    """rows with side train or test: units whole, stratified, in the order of a hash."""
    order = Window.partitionBy(*strata).orderBy(F.md5(F.col(unit).cast("string")), unit)
    units = rows.select(unit, *strata).distinct().withColumn("side", F.when(F.percent_rank().over(order) < train, "train").otherwise("test"))
    return rows.join(units, [unit, *strata])


def suppressed(alerts: DataFrame, quiet: float = 3600.0) -> DataFrame:
    """alerts (agent, ts, arrival) with kept: the first of an agent, then none until quiet seconds after the last kept one.

    Alerts without a clock are kept: nothing says that they follow another.
    """
    rows = alerts.select("agent", "ts", "arrival")
    clocked = F.col("ts").isNotNull() & ~F.isnan("ts")
    first = rows.where(clocked).groupBy("agent", "ts").agg(F.min("arrival").alias("arrival"))
    starts = anchors.beginnings(kept(first.select("agent", "ts"), "instants"), "agent", quiet, False)
    chosen = first.join(starts, ["agent", "ts"]).withColumn("_chosen", F.lit(True))
    found = rows.where(clocked).join(chosen, ["agent", "ts", "arrival"], "left").withColumn("kept", F.coalesce("_chosen", F.lit(False))).drop("_chosen")
    return found.unionByName(rows.where(~clocked).withColumn("kept", F.lit(True)))


def drift(violations: DataFrame, window: float, least: int) -> DataFrame:
    """(agent, ts, sessions): instants at which at least that many different sessions of an agent violated in the window up to then.

    violations: (agent, session_id, ts). A session counts from a violation until window seconds after it; such spans are
    merged per session and then counted by a running sum over their ends, so a session counts once and no two meet. The
    window is open at its far end.
    """
    rows = violations.where("ts IS NOT NULL AND NOT isnan(ts)").select("agent", "session_id", "ts").distinct()
    own = Window.partitionBy("agent", "session_id").orderBy("ts")
    opens = rows.withColumn("_opens", F.coalesce(F.col("ts") - F.lag("ts").over(own) >= window, F.lit(True)).cast("int"))
    spans = opens.withColumn("_span", F.sum("_opens").over(own)).groupBy("agent", "session_id", "_span").agg(F.min("ts").alias("begin"), (F.max("ts") + window).alias("end"))
    ends = spans.select("agent", F.inline(F.array(F.struct(F.col("begin").alias("ts"), F.lit(1).alias("step")), F.struct(F.col("end").alias("ts"), F.lit(-1).alias("step")))))
    asked = rows.select("agent", "ts").distinct().withColumn("step", F.lit(0))
    # at one instant, ends come first, then beginnings, then the question
    order = [F.col("ts"), F.when(F.col("step") == 0, 2).otherwise(F.col("step"))]
    found = anchors.running(ends.unionByName(asked), "agent", F.col("ts"), window, F.col("step"), order)
    return found.where((F.col("step") == 0) & (F.col("total") >= least)).select("agent", "ts", F.col("total").alias("sessions"))
