"""Gold of several annotators whose segments need not have the same bounds: votes on elementary intervals, disputed spans apart."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from turnloom.functions.vocab import TURN_VIEW
from turnloom.operators import scoring
from turnloom.operators.intervals import range_join

CHANNEL = ["conv_id", "speaker"]


def elementary_votes(segments: DataFrame) -> DataFrame:
    """(conv_id, speaker, start_ms, end_ms, label, n, given): the intervals between all bounds of a channel's segments (conv_id, speaker, annotator,
    start_ms, end_ms, label), with the label that most annotators have there (ties by label), how many have it, and how many have any.

    Of an annotator's segments that overlap, the one that began last counts. Intervals that nobody marks are left out.
    """
    segments = segments.where("label IS NOT NULL AND end_ms > start_ms")
    cuts = segments.select(*CHANNEL, F.explode(F.array("start_ms", "end_ms")).alias("start_ms")).distinct()
    nxt = F.lead("start_ms").over(W.partitionBy(*CHANNEL).orderBy("start_ms"))
    between = cuts.withColumn("end_ms", nxt).where("end_ms IS NOT NULL")
    over = range_join(between, segments, CHANNEL).where("b_start_ms <= start_ms AND b_end_ms >= end_ms")
    each = over.groupBy(*CHANNEL, "start_ms", "end_ms", "b_annotator").agg(F.max(F.struct("b_start_ms", "b_label"))["b_label"].alias("label"))
    counts = each.groupBy(*CHANNEL, "start_ms", "end_ms", "label").agg(F.count("*").alias("n"))
    best = counts.groupBy(*CHANNEL, "start_ms", "end_ms").agg(F.max_by("label", F.struct(F.col("n"), F.col("label"))).alias("label"), F.max("n").alias("n"), F.sum("n").alias("given"))
    return best


def consensus_spans(segments: DataFrame, annotators: int, k: int = 2) -> DataFrame:
    """(conv_id, speaker, start_ms, end_ms, label): what at least k of so many annotators say, silence being said too. label is null where no k agree.

    Neighbouring intervals of one label are one span, so segments that touch and have one label fall together.
    """
    votes = elementary_votes(segments)
    agreed = F.col("n") >= k
    told = votes.withColumn("label", F.when(agreed, F.col("label"))).where(agreed | (annotators - F.col("given") < k))
    order = W.partitionBy(*CHANNEL).orderBy("start_ms")
    goes_on = F.lag("end_ms").over(order).eqNullSafe(F.col("start_ms")) & F.lag("label").over(order).eqNullSafe(F.col("label"))
    runs = told.withColumn("new", F.when(goes_on, 0).otherwise(1)).withColumn("run", F.sum("new").over(order))
    return runs.groupBy(*CHANNEL, "run").agg(F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"), F.first("label").alias("label")).drop("run")


def consensus_gold(segments: DataFrame, annotators: int, k: int = 2) -> DataFrame:
    """Gold events (conv_id, task, kind, speaker, start_ms, end_ms) of segments (conv_id, speaker, annotator, start_ms, end_ms, canonical).

    Turn ends stand on the turn view (a turn or an interruption, or neither), interruptions on the labels. Spans without a majority are excluded from the
    task whose view they dispute, agreed failed attempts from interruptions.
    """
    view = F.when(F.col("canonical").isin(*TURN_VIEW), F.lit("Turn"))
    turns = consensus_spans(segments.withColumn("label", view), annotators, k).withColumnRenamed("label", "canonical")
    labels = consensus_spans(segments.withColumn("label", F.col("canonical")), annotators, k).withColumnRenamed("label", "canonical")
    out = None
    for task, spans in (("eot", turns), ("int", labels)):
        agreed = scoring.gold_events(spans.where("canonical IS NOT NULL")).where(F.col("task") == task)
        disputed = spans.where("canonical IS NULL").select("conv_id", F.lit(task).alias("task"), F.lit("excl").alias("kind"), "speaker", "start_ms", "end_ms")
        rows = agreed.unionByName(disputed)
        out = rows if out is None else out.unionByName(rows)
    return out


def own_events(segments: DataFrame, annotator: str) -> DataFrame:
    """Positive events (conv_id, task, speaker, t_ms) of one annotator's own segments: what the annotator would tell with hindsight and no delay."""
    gold = scoring.gold_events(segments.where(F.col("annotator") == annotator)).where("kind = 'pos'")
    return gold.select("conv_id", "task", "speaker", F.col("start_ms").alias("t_ms"))


def annotator_ceiling(segments: DataFrame, annotators: list[str], k: int = 2) -> DataFrame:
    """(annotator, against, task, counts, rates, latencies): each annotator as a system, scored against gold of the others (all of whom have to agree; what
    they dispute is excluded) and against that of all, which the annotator is part of. Rows as of scoring.event_totals()."""
    official, out = consensus_gold(segments, len(annotators), k), None
    for x in annotators:
        others = consensus_gold(segments.where(F.col("annotator") != x), len(annotators) - 1, len(annotators) - 1)
        for against, gold in (("others", others), ("all", official)):
            rows = scoring.event_totals(gold, own_events(segments, x), []).withColumns({"annotator": F.lit(x), "against": F.lit(against)})
            out = rows if out is None else out.unionByName(rows)
    return out


def by_marking(gold: DataFrame, segments: DataFrame, annotators: list[str], preds: DataFrame, near_ms: int = 300) -> DataFrame:
    """(task, kind, marking, n, hit): gold events by how many annotators mark a positive of their own there, and how many of them predictions
    (conv_id, task, speaker, t_ms) hit. There: within near_ms of a positive; in a negative span or shortly before it. A positive is hit in its window
    whatever its neighbours claim, a negative by any prediction inside."""
    on = ["conv_id", "task", "speaker"]
    own = None
    for x in annotators:
        rows = own_events(segments, x).withColumn("annotator", F.lit(x))
        own = rows if own is None else own.unionByName(rows)
    at = {"start_ms": F.col("t_ms"), "end_ms": F.col("t_ms")}
    events = gold.where("kind IN ('pos', 'neg')").select(*on, "kind", F.col("start_ms").alias("a"), F.col("end_ms").alias("b"))
    pos = F.col("kind") == "pos"
    around = events.withColumns({"start_ms": F.when(pos, F.col("a") - near_ms).otherwise(F.col("a") - scoring.BEFORE_MS), "end_ms": F.when(pos, F.col("a") + near_ms).otherwise(F.col("b"))})
    marks = range_join(around, own.withColumns(at), on).groupBy(*on, "kind", "a", "b").agg(F.count_distinct("b_annotator").alias("marking"))
    window = events.withColumns({"start_ms": F.when(pos, F.col("a") - scoring.BEFORE_MS).otherwise(F.col("a")), "end_ms": F.when(pos, F.col("a") + scoring.AFTER_MS).otherwise(F.col("b"))})
    hits = range_join(window, preds.withColumns(at), on).select(*on, "kind", "a", "b").distinct().withColumn("is_hit", F.lit(1))
    told = events.join(marks, [*on, "kind", "a", "b"], "left").join(hits, [*on, "kind", "a", "b"], "left")
    told = told.withColumn("marking", F.coalesce("marking", F.lit(0)))
    return told.groupBy("task", "kind", "marking").agg(F.count("*").alias("n"), F.count("is_hit").alias("hit"))
