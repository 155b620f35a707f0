"""Context at speech onsets, questions to a text oracle, and drafts before a turn's end. Times are milliseconds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from turnloom.operators.intervals import range_join

CHANNEL = ["conv_id", "speaker"]


def onset_context(segments: DataFrame, track: DataFrame, step_ms: int, delays: list[int], back_ms: int = 2000, cap_ms: int = 5000) -> DataFrame:
    """Causal context at each delay after each onset: shares of own and other speech since the onset and in the last back_ms, whether the
    other spoke in the last three frames, the silence before, and how long the other's run had lasted at the onset (0: none).

    segments (conv_id, speaker, start_ms, end_ms), no two of a channel starting together; track (conv_id, speaker, i, own, other). Only frames known
    in full at the point count; without one, shares are 0. Each point meets its few frames by an equi-join on the frame index.
    """
    before = F.lag("end_ms").over(W.partitionBy(*CHANNEL).orderBy("start_ms"))
    silence = F.least(F.coalesce(F.col("start_ms") - before, F.lit(cap_ms)), F.lit(cap_ms)).cast("long")
    onset = segments.select(*CHANNEL, "start_ms", F.col("start_ms").alias("end_ms"), silence.alias("silence_ms"))
    runs = segments.select("conv_id", (3 - F.col("speaker")).alias("speaker"), "start_ms", (F.col("end_ms") + 200).alias("end_ms"))
    run = range_join(onset, runs, CHANNEL).groupBy(*CHANNEL, "start_ms").agg(F.min("b_start_ms").alias("run_start"))
    points = onset.drop("end_ms").join(run, [*CHANNEL, "start_ms"], "left").withColumn("delay_ms", F.explode(F.array(*[F.lit(x).cast("long") for x in delays])))
    points = points.withColumns({
        "from_i": F.expr(f"start_ms div {step_ms}"),
        "back_i": F.expr(f"greatest(start_ms + delay_ms - {back_ms}, 0) div {step_ms}"),
        "now_i": F.expr(f"(start_ms + delay_ms) div {step_ms}"),
    })
    seen = points.withColumn("i", F.explode_outer(F.expr("IF(least(from_i, back_i) < now_i, sequence(least(from_i, back_i), now_i - 1), NULL)")))
    met = seen.join(track.select(*CHANNEL, "i", "own", "other").hint("merge"), [*CHANNEL, "i"], "left")
    since, own, other = F.col("i") >= F.col("from_i"), F.col("own").cast("int"), F.col("other").cast("int")
    out = met.groupBy(*CHANNEL, "start_ms", "delay_ms").agg(
        F.coalesce(F.avg(F.when(since, own)), F.lit(0.0)).alias("own_share"),
        F.coalesce(F.avg(F.when(since, other)), F.lit(0.0)).alias("other_share"),
        F.coalesce(F.avg(F.when(F.col("i") >= F.col("back_i"), own)), F.lit(0.0)).alias("own_recent"),
        F.coalesce(F.avg(F.when(F.col("i") >= F.col("back_i"), other)), F.lit(0.0)).alias("other_recent"),
        F.coalesce(F.max(F.when(F.col("i") >= F.col("now_i") - 3, F.col("other"))), F.lit(False)).alias("other_now"),
        F.min("silence_ms").alias("silence_ms"),
        F.least(F.coalesce(F.col("start_ms") - F.min("run_start"), F.lit(0)), F.lit(cap_ms)).cast("long").alias("other_run_ms"),
    )
    return out


def oracle_queries(segments: DataFrame, lag_ms: int, near_ms: int = 300) -> DataFrame:
    """(conv_id, speaker, start_ms, kind, words, t_ms): when to ask a text oracle about segments (conv_id, speaker, start_ms, end_ms, n words).

    eot: at each segment's end plus lag. int: after 1, 2, 4 and all words of segments that start while the other speaks or at most near_ms after; words
    are spread evenly over the segment. Segments without words ask nothing.
    """
    said = segments.where("n > 0").select(*CHANNEL, "start_ms", "end_ms", "n")
    eot = said.select(*CHANNEL, "start_ms", F.lit("eot").alias("kind"), F.col("n").alias("words"), (F.col("end_ms") + lag_ms).alias("t_ms"))
    onset = said.select(*CHANNEL, "start_ms", F.col("start_ms").alias("end_ms")).distinct()
    other = said.select("conv_id", (3 - F.col("speaker")).alias("speaker"), "start_ms", (F.col("end_ms") + near_ms).alias("end_ms"))
    inside = range_join(onset, other, CHANNEL).select(*CHANNEL, "start_ms").distinct()
    asked = said.join(inside, [*CHANNEL, "start_ms"], "left_semi").withColumn("words", F.explode(F.expr("array_distinct(array(least(n, 1), least(n, 2), least(n, 4), n))")))
    at = F.expr(f"start_ms + {lag_ms} + (words * (end_ms - start_ms)) div n")
    return eot.unionByName(asked.select(*CHANNEL, "start_ms", F.lit("int").alias("kind"), "words", at.alias("t_ms")))


def speculation_rates(candidates: DataFrame, keys: list[str], least: float) -> DataFrame:
    """For drafts at pauses only, and at pauses and clauses: turns, the share without a draft before the end, how often the last such draft is a hit
    (score >= least), the median time it leads the end by, and drafts per turn with the final one.

    candidates (keys…, kind pause/clause/end, at, score, t_ms); those without score are no drafts. A turn without end has no lead.
    """
    plan = F.explode(F.array(F.lit("pause"), F.lit("clause"))).alias("schedule")
    rows = candidates.select("*", plan).withColumn("draft", F.expr("kind <> 'end' AND score IS NOT NULL AND (schedule = 'clause' OR kind = 'pause')"))
    last = F.max(F.when(F.col("draft"), F.struct("at", "score", "t_ms")))
    turns = rows.groupBy("schedule", *keys).agg(last.alias("last"), F.count_if("draft").alias("n"), F.max(F.when(F.col("kind") == "end", F.col("t_ms"))).alias("end_ms"))
    hit = (F.col("last.score") >= least).cast("int")
    return turns.groupBy("schedule").agg(
        F.count("*").alias("turns"), F.avg((F.col("n") == 0).cast("int")).alias("none"), F.avg(hit).alias("hits"),
        F.percentile(F.col("end_ms") - F.col("last.t_ms"), 0.5).alias("lead_ms"), F.avg(F.col("n") + 1).alias("drafts"),
    )
