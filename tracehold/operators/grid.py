"""Checks scored on a labelled corpus under every way to part it and every source of what tools can do, in one pass.

Regimes: task_disjoint (half of the tasks of each family train), family_holdout (each family is scored by what the others
show) and random_control (half of the sessions, whatever their task: it leaks). The transitions of benign training
sessions under all regimes are one table of the vocabulary's size; a session's transitions meet it once, and are counted
per regime and source in one aggregate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracehold.operators import detect, evaluate

REGIMES = ("task_disjoint", "family_holdout", "random_control")
SOURCES = ("manifest", "producer", "name_only")


def sides(corpus: DataFrame) -> DataFrame:
    """corpus (session_id, family, task) with trains_task and trains_random: whether a session trains under these regimes; family_holdout needs none."""
    tasks = evaluate.split(corpus.select("session_id", "family", "task"), "task", ["family"]).select("session_id", (F.col("side") == "train").alias("trains_task"))
    drawn = F.substring(F.md5("session_id"), 1, 1) < "8"
    return corpus.join(tasks, "session_id").withColumn("trains_random", drawn)


def _known(shown: DataFrame, *by: str) -> DataFrame:
    """What benign training sessions show: under the two halves whether at all, and of families how many and, if one, which."""
    families = shown.groupBy(*by).agg(
        F.bool_or("trains_task").alias("_task"), F.bool_or("trains_random").alias("_random"), F.min("family").alias("_least"), F.max("family").alias("_most"),
    )
    return detect.small(families)


def _seen() -> dict[str, Column]:
    """Whether a joined row of _known() is seen under each regime by a session of this family."""
    others = (F.col("_least") != F.col("_most")) | (F.col("_least") != F.col("family"))
    yes = lambda c: F.coalesce(c, F.lit(False))
    return {"task_disjoint": yes(F.col("_task")), "family_holdout": yes(others), "random_control": yes(F.col("_random"))}


def outcomes(corpus: DataFrame, calls: DataFrame, refs: detect.References, fired: DataFrame) -> DataFrame:
    """(regime, source, session_id, family, task, is_attack, target, checks, flagged, attributed, evaluable) of each test session.

    corpus: (session_id, family, task, is_attack, target). calls: with consequential_<source> for each of SOURCES. refs:
    the markers that CH03 orders by. fired: (session_id, check) of checks that depend on neither regime nor source.
    evaluable: whether the check that should have seen an attack could look.
    """
    placed = sides(corpus).join(fired.groupBy("session_id").agg(F.collect_set("check").alias("_always")), "session_id", "left")
    steps = None
    for source in SOURCES:  # the same order of calls, so one window; what a call may do is a column of each source
        rows = detect.transitions(calls.withColumn("consequential", F.col(f"consequential_{source}"))).withColumn("source", F.lit(source))
        steps = rows if steps is None else steps.unionByName(rows)
    own = steps.join(placed.select("session_id", "family", "is_attack", "trains_task", "trains_random"), "session_id")
    train = own.where(F.col("source") == SOURCES[0]).where("NOT is_attack")
    known = _known(train, "prev", "next")
    met = own.select("session_id", "family", "source", "prev", "next", "consequential", "is_retry").join(known, ["prev", "next"], "left")
    counts = [F.count("*").alias("_n")]
    for regime, seen in _seen().items():
        counts += [F.count_if(~seen).alias(f"_unseen_{regime}"), F.count_if(~seen & F.col("consequential") & ~F.col("is_retry")).alias(f"_into_{regime}")]
    rates = met.groupBy("session_id", "source").agg(*counts)
    names = _known(train.where(F.col("next") != detect.END), "next").withColumnRenamed("next", "name")
    tools = calls.groupBy("session_id", "name").agg(F.count("*").alias("_calls")).join(placed.select("session_id", "family"), "session_id").join(names, "name", "left")
    fits = tools.groupBy("session_id").agg(F.sum("_calls").alias("_calls"), *((F.count_if(seen) / F.count("*")).alias(f"_overlap_{regime}") for regime, seen in _seen().items()))
    after = detect.ordered_after(calls, refs).where("position = 'after' AND start_arrival IS NOT NULL").groupBy("session_id").agg(*(F.bool_or(f"consequential_{s}").alias(f"_ch03_{s}") for s in SOURCES))
    scanned = refs.clocks.select("session_id", F.lit(True).alias("_marked"))
    wide = placed.join(rates, "session_id", "left").join(fits, "session_id", "left").join(after, "session_id", "left").join(scanned, "session_id", "left")
    no = lambda c: F.coalesce(c, F.lit(False))
    ch03 = F.lit(False)
    for source in SOURCES:
        ch03 = F.when(F.col("source") == source, no(F.col(f"_ch03_{source}"))).otherwise(ch03)
    rows = []
    for regime in REGIMES:
        test = {"task_disjoint": ~F.col("trains_task"), "family_holdout": F.lit(True), "random_control": ~F.col("trains_random")}[regime]
        apt = no(~((F.col("_calls") >= detect.LEAST_CALLS) & (F.col(f"_overlap_{regime}") < detect.LEAST_OVERLAP)))
        ch01 = no((F.col(f"_unseen_{regime}") / F.col("_n") > detect.VIOLATION_RATE) | (F.col(f"_into_{regime}") >= 1)) & apt
        checks = F.array_sort(F.array_union(F.coalesce("_always", F.array().cast("array<string>")), F.array_compact(F.array(F.when(ch01, F.lit("CH01")), F.when(ch03, F.lit("CH03"))))))
        could = F.when(F.col("target") == "CH01", apt).when(F.col("target") == "CH03", no(F.col("_marked"))).otherwise(True)
        rows.append(F.when(test, F.struct(F.lit(regime).alias("regime"), checks.alias("checks"), could.alias("evaluable"))))
    out = wide.where("source IS NOT NULL").select("source", "session_id", "family", "task", "is_attack", "target", F.inline(F.array_compact(F.array(*rows))))
    return out.withColumns({"flagged": F.size("checks") > 0, "attributed": F.array_contains("checks", F.col("target"))})


def summary(found: DataFrame) -> DataFrame:
    """Per regime and source: the confusion of any alert, and recall by the check that should have seen each attack, over all attacks and where it could look."""
    a, f, t = F.col("is_attack"), F.col("flagged"), F.coalesce("attributed", F.lit(False))
    sums = found.groupBy("regime", "source").agg(
        F.count("*").alias("sessions"), F.count_if(a & f).alias("tp"), F.count_if(~a & f).alias("fp"), F.count_if(a & ~f).alias("fn"), F.count_if(~a & ~f).alias("tn"),
        F.count_if(a & t).alias("attributed"), F.count_if(a & F.col("evaluable")).alias("evaluable"), F.count_if(a & t & F.col("evaluable")).alias("attributed_evaluable"),
    )
    return evaluate.rates(sums).withColumns({
        "attributable_recall": F.round(evaluate.ratio(F.col("attributed"), F.col("tp") + F.col("fn")), 6), "incidental": F.col("tp") - F.col("attributed"),
        "recall_where_evaluable": F.round(evaluate.ratio(F.col("attributed_evaluable"), F.col("evaluable")), 6),
    })
