"""The silence baseline: turn ends by how long a channel is quiet and the other has talked, for many policies in one plan.

Policies are rows (policy, quiet, other, again) in frames: how long the own channel has to be quiet; how long the other has to have talked, null where it
does not matter; after how long a commit is repeated, null for never. Ages count from the first frame of a state, so that frame has age 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from turnloom.operators.commit import CHANNEL, by_frame
from turnloom.operators.intervals import range_join
from turnloom.sources.settle import settle

#: Policies up to which they are sent to all tasks.
FEW_POLICIES = 10_000
#: Frames of a bucket in which episodes and the other's talk meet.
BUCKET = 512


def state_ages(track: DataFrame, vad: str = "vad") -> DataFrame:
    """(conv_id, speaker, i, talk, age, armed, other_talk, other_age): the state of both channels at each frame and the frames since it began; armed: the
    channel has talked before. Both channels meet at their frame, by a window over the frame's two rows."""
    w = by_frame()
    aged = track.select(*CHANNEL, "i", (F.col(vad) >= 0.5).alias("talk"))
    turned = lambda state: F.coalesce(F.max(F.when(state, F.col("i"))).over(w), F.min("i").over(w) - 1)
    since = F.when(F.col("talk"), turned(~F.col("talk"))).otherwise(turned(F.col("talk")))
    aged = aged.withColumns({"age": F.col("i") - since - 1, "armed": F.max("talk").over(w)})
    pair = W.partitionBy("conv_id", "i").orderBy("speaker")
    other = lambda c: F.coalesce(F.lead(c).over(pair), F.lag(c).over(pair))
    return aged.withColumns({"other_talk": F.coalesce(other("talk"), F.lit(False)), "other_age": other("age")})


def eligible(quiet: int, other: int | None = None) -> Column:
    """Whether a frame of state_ages() may tell the end of a turn: quiet for so long, and, unless other is None, the other talking for so long."""
    out = ~F.col("talk") & (F.col("age") >= quiet)
    return out if other is None else out & F.col("other_talk") & (F.col("other_age") >= other)


def state_runs(track: DataFrame, vad: str = "vad") -> DataFrame:
    """(conv_id, speaker, talk, start_ms, end_ms): first and last frame of each run of one state (frames, for all the names)."""
    w = by_frame()
    told = track.select(*CHANNEL, "i", (F.col(vad) >= 0.5).alias("talk"))
    told = told.withColumn("run", F.sum(F.when(F.lag("talk").over(w) == F.col("talk"), 0).otherwise(1)).over(w.rowsBetween(W.unboundedPreceding, 0)))
    return told.groupBy(*CHANNEL, "talk", "run").agg(F.min("i").alias("start_ms"), F.max("i").alias("end_ms")).drop("run")


def quiet_episodes(track: DataFrame, vad: str = "vad") -> DataFrame:
    """(conv_id, speaker, episodes): a channel's quiet episodes after own speech, in order, as (a, b, talks): first and last frame, and the runs (a, b) of the
    other's talk that they meet. Frames are reduced to runs in the tasks of their channel, and only runs are kept."""
    runs = settle(state_runs(track, vad), "runs")
    before = F.row_number().over(W.partitionBy(*CHANNEL).orderBy("start_ms"))
    quiet = runs.withColumn("nth", before).where("NOT talk AND nth > 1").select(*CHANNEL, "start_ms", "end_ms")
    other = runs.where("talk").select("conv_id", (3 - F.col("speaker")).cast("int").alias("speaker"), "start_ms", "end_ms")
    talk = F.struct(F.col("b_start_ms").alias("a"), F.col("b_end_ms").alias("b"))
    met = range_join(quiet, other, CHANNEL, bucket_ms=BUCKET).select(*CHANNEL, "start_ms", "end_ms", talk.alias("talk"))
    each = met.unionByName(quiet, allowMissingColumns=True).groupBy(*CHANNEL, "start_ms", "end_ms").agg(F.array_sort(F.collect_list("talk")).alias("talks"))
    episode = F.struct(F.col("start_ms").alias("a"), F.col("end_ms").alias("b"), "talks")
    return each.groupBy(*CHANNEL).agg(F.array_sort(F.collect_list(episode)).alias("episodes"))


def episode_fires(channels: DataFrame, policies: DataFrame) -> DataFrame:
    """channels (…, episodes) with a row for each policy that fires there: policy, and `at`, the frames of its commits in order.

    In an episode the eligible frames of a policy are one interval, or one for each of the other's talks that it meets; a fold over an episode's intervals
    gives the commits. Policies multiply channels in their own row: nothing is shuffled for them.
    """
    policies = F.broadcast(policies) if policies.count() <= FEW_POLICIES else policies
    again = """flatten(aggregate(spans, named_struct('last', CAST(NULL AS BIGINT), 'out', CAST(array() AS array<array<bigint>>)),
        (acc, s) -> transform(array(CAST(greatest(s.lo, coalesce(acc.last + again, s.lo)) AS BIGINT)), f -> IF(f > s.hi, acc,
            named_struct('last', f + (s.hi - f) DIV again * again, 'out', array_append(acc.out, sequence(f, CAST(s.hi AS BIGINT), CAST(again AS BIGINT))))))[0],
        acc -> acc.out))"""
    spans = """filter(IF(other IS NULL, array(named_struct('lo', e.a + quiet, 'hi', e.b)),
        transform(e.talks, x -> named_struct('lo', greatest(e.a + quiet, x.a + other), 'hi', least(e.b, x.b)))), s -> s.lo <= s.hi)"""
    held = f"filter(transform(filter(episodes, e -> e.a + quiet <= e.b), e -> {spans}), s -> size(s) > 0)"
    at = f"flatten(transform({held}, spans -> IF(again IS NULL, array(CAST(spans[0].lo AS BIGINT)), {again})))"
    # Exploded, the commits are made once: what comes after would else repeat them wherever it uses them.
    told = channels.crossJoin(policies.select("policy", "quiet", "other", "again")).withColumn("at", F.explode(F.expr(f"filter(array({at}), x -> size(x) > 0)")))
    return told.drop("episodes", "quiet", "other", "again")


def silence_fires(track: DataFrame, policies: DataFrame, vad: str = "vad") -> DataFrame:
    """(policy, conv_id, speaker, i): the commits of all policies.

    A commit comes at the first eligible frame of a quiet episode after own speech, and again at the first eligible one `again` frames after the last.
    """
    return episode_fires(quiet_episodes(track, vad), policies).select("policy", *CHANNEL, F.explode("at").alias("i"))
