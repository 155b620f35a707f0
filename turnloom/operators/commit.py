"""Event commits on frame tracks (conv_id, speaker, i, score columns): where a causal policy fires, in batch form.

A frame i covers [i * step, (i + 1) * step) and is known at its end. Sequential rules fold over one channel's few events, not over its frames.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

CHANNEL = ["conv_id", "speaker"]


def by_frame() -> W:
    return W.partitionBy(*CHANNEL).orderBy("i")


def rising_edges(track: DataFrame, p: Column, theta: Column) -> DataFrame:
    """Frames where p is above theta and was not the frame before."""
    before = F.coalesce(F.lag(p).over(by_frame()), F.lit(0.0))
    return track.withColumn("__before", before).where((p > theta) & ~(F.col("__before") > theta)).drop("__before")


def apart(events: DataFrame, keys: list[str], at: str, least: int) -> DataFrame:
    """The events that are at least `least` after the last one kept, in order: a fold over each key's events."""
    order = F.array_sort(F.collect_set(at))
    kept = F.aggregate(
        order,
        F.expr("CAST(array() AS array<long>)"),
        lambda acc, x: F.when((F.size(acc) == 0) | (x - F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(0)) >= least), F.concat(acc, F.array(x))).otherwise(acc),
    )
    return events.groupBy(*keys).agg(kept.alias("__kept")).select(*keys, F.explode("__kept").alias(at))


def rising_edge_commit(track: DataFrame, score: str, theta: float, refractory: int) -> DataFrame:
    """(conv_id, speaker, i) where score rises above theta, refractory frames apart at least; suppressed edges do not count."""
    return apart(rising_edges(track, F.col(score), F.lit(theta)), CHANNEL, "i", refractory)


def recommit(track: DataFrame, commits: DataFrame, score: str, theta: float, hold: int) -> DataFrame:
    """commits, and one more fire hold frames after each during which the score stays above theta."""
    ahead = by_frame().rowsBetween(0, hold)
    above = track.withColumns({"__low": F.min((F.col(score) > theta).cast("int")).over(ahead), "__n": F.count("*").over(ahead)})
    again = above.where(f"__low = 1 AND __n = {hold + 1}").select(*CHANNEL, "i").join(commits.hint("merge"), [*CHANNEL, "i"])  # frames look small to the planner
    return commits.union(again.withColumn("i", F.col("i") + hold)).distinct()


def quiet_armed_commit(track: DataFrame, vad: str, score: str, theta: float, recommit_after: int) -> DataFrame:
    """Fires while the channel is quiet after own speech: the first frame of a quiet episode with score >= theta, and again every
    recommit_after frames at the first such frame. Speech re-arms; quiet before any speech does not fire."""
    speech = F.col(vad) > 0.5
    episode = F.sum(speech.cast("int")).over(by_frame())
    quiet = track.withColumn("__episode", episode).where(~speech & (F.col("__episode") > 0) & (F.col(score) >= theta))
    return apart(quiet, [*CHANNEL, "__episode"], "i", recommit_after).drop("__episode")


def next_hits(hits: DataFrame, spans: DataFrame, keys: list[str]) -> DataFrame:
    """spans (keys…, from_i, to_i) with first_i, the first of hits (keys…, i) in (from_i, to_i], or null: each span looks up the next hit, by one union and a window."""
    hits = hits.select(*keys, "i", F.lit(None).cast("long").alias("to_i"), F.lit(1).alias("kind"))
    asks = spans.select(*keys, F.col("from_i").alias("i"), F.col("to_i").cast("long"), F.lit(0).alias("kind"))
    # Backwards in time, the last hit seen lies after i: hits at i itself come after the question.
    order = W.partitionBy(*keys).orderBy(F.desc("i"), F.col("kind")).rowsBetween(W.unboundedPreceding, -1)
    nxt = F.last(F.when(F.col("kind") == 1, F.col("i")), ignorenulls=True).over(order)
    out = hits.unionByName(asks).withColumn("__next", nxt).where("kind = 0")
    return out.select(*keys, F.col("i").alias("from_i"), "to_i", F.when(F.col("__next") <= F.col("to_i"), F.col("__next")).alias("first_i"))


def first_above(track: DataFrame, spans: DataFrame, score: str, theta: float) -> DataFrame:
    """spans (conv_id, speaker, from_i, to_i) with the first frame in (from_i, to_i] whose score reaches theta, or null. Only frames that reach theta take part."""
    return next_hits(track.where(F.col(score) >= theta), spans, CHANNEL)


def query_points(track: DataFrame, score: str, theta: float, step: int) -> DataFrame:
    """Each rising edge, and every step frames while the score stays above theta."""
    above = F.col(score) > theta
    run = F.sum((~above).cast("int")).over(by_frame())
    runs = track.withColumn("__run", run).where(above)
    first = F.min("i").over(W.partitionBy(*CHANNEL, "__run"))
    return runs.withColumn("__first", first).where(F.pmod(F.col("i") - F.col("__first"), F.lit(step)) == 0).select(*CHANNEL, "i")


def veto(fires: DataFrame, answers: DataFrame, cut: float) -> DataFrame:
    """fires whose answer (conv_id, speaker, i, confidence) reaches cut, or that have none."""
    return fires.join(answers, [*CHANNEL, "i"], "left").where(F.coalesce("confidence", F.lit(1.0)) >= cut).select(*fires.columns)
