"""Causal turn policies on vocalisations (conv_id, speaker, start_ms, end_ms) of both channels, with an optional score track.

A silence shorter than min_gap does not end a vocalisation, so one that was last heard at b counts as going on until b + min_gap: rules
test durations against that bound, never against b, which would look ahead. Every event is stamped no earlier than the last thing it depends on.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from turnloom.operators.commit import CHANNEL, first_above
from turnloom.operators.intervals import range_join, union_intervals
from turnloom.sources.settle import settle


@dataclass(frozen=True)
class Policy:
    """Milliseconds and thresholds; a threshold of None leaves the score out, confirm None the confirmation."""

    min_gap: int = 200
    min_wait: int = 800
    other_dur: int = 200
    deadline: int = 2500
    resume_min: int = 500
    confirm: int | None = 2500
    eot_th: float | None = 0.8
    read_from: int = 160
    mw_model: int = 480
    int_th: float | None = 0.1
    int_from: int = 160
    int_dur: int = 1000
    int_fallback: bool = True


def _known_between(lo: Column, hi: Column, step_ms: int) -> tuple[Column, Column]:
    """(from_i, to_i] of the frames that become known at lo or later and at hi at the latest; frame i is known at (i + 1) * step_ms."""
    return F.greatest(F.ceil(lo / step_ms) - 2, F.lit(-1)).cast("long"), (F.floor(hi / step_ms) - 1).cast("long")


def _first_known(asked: DataFrame, track: DataFrame, score: str, theta: float, lo: Column, hi: Column, step_ms: int) -> DataFrame:
    """asked with `seen`: when the first frame with score >= theta in [lo, hi] is known, or null."""
    from_i, to_i = _known_between(lo, hi, step_ms)
    spans = asked.withColumns({"from_i": from_i, "to_i": to_i})
    hit = first_above(track, spans.select(*CHANNEL, "from_i", "to_i").distinct(), score, theta)
    out = spans.join(hit, [*CHANNEL, "from_i", "to_i"], "left")
    return out.withColumn("seen", (F.col("first_i") + 1) * step_ms).drop("from_i", "to_i", "first_i")


def turn_ends(voices: DataFrame, durations: DataFrame, p: Policy, track: DataFrame | None = None, score: str = "eot", step_ms: int = 80) -> DataFrame:
    """(conv_id, speaker, t_ms): ends of turns. durations: (conv_id, duration_ms).

    A candidate opens at the end t of each vocalisation and commits at the earliest of: t + deadline; when the other has been vocalising for
    other_dur, not before t + min_wait; the first frame whose score reaches eot_th, read from t + read_from on and not before t + mw_model; the
    end of the audio. It is cancelled if the speaker resumes within the horizon and lasts resume_min before that. If nothing cancels
    it by then, a confirmation follows at t + confirm. Times are distinct.
    """
    w = W.partitionBy(*CHANNEL).orderBy("start_ms", "end_ms")
    lasting = F.col("end_ms") + p.min_gap - F.col("start_ms") >= p.resume_min
    resumed = F.first(F.when(lasting, F.col("start_ms")), ignorenulls=True).over(w.rowsBetween(1, W.unboundedFollowing))
    horizon = max(p.deadline, p.confirm or 0)
    cand = voices.select(*CHANNEL, F.col("end_ms").alias("t"), F.when(resumed - F.col("end_ms") <= horizon, resumed + p.resume_min).alias("cancel"))

    # The other's vocalisations that go on at t + min_wait or begin later, up to the deadline.
    window = cand.select(*CHANNEL, "t", (F.col("t") + p.min_wait - p.min_gap).alias("start_ms"), (F.col("t") + p.deadline).alias("end_ms"))
    other = voices.select("conv_id", (3 - F.col("speaker")).cast("int").alias("speaker"), "start_ms", "end_ms")
    heard = F.greatest(F.col("b_start_ms") + p.other_dur, F.col("t") + p.min_wait)
    taken = range_join(window, other, CHANNEL).where(heard <= F.col("b_end_ms") + p.min_gap).groupBy(*CHANNEL, "t").agg(F.min(heard).alias("taken"))
    cand = cand.join(taken, [*CHANNEL, "t"], "left").join(durations, "conv_id")
    if track is not None and p.eot_th is not None:
        until = F.least(F.col("t") + p.deadline, F.coalesce("cancel", F.col("t") + p.deadline))
        cand = _first_known(cand, track, score, p.eot_th, F.col("t") + p.read_from, until, step_ms)
        told = F.greatest(F.col("seen"), F.when(F.col("seen").isNotNull(), F.col("t") + p.mw_model))
    else:
        told = F.lit(None).cast("long")
    at = F.least(F.col("t") + p.deadline, F.coalesce("taken", F.col("t") + p.deadline), F.coalesce(told, F.col("t") + p.deadline), F.col("duration_ms"))
    free = lambda t: F.col("cancel").isNull() | (t < F.col("cancel"))
    cand = cand.withColumn("at", at)
    fires = [F.when(free(F.col("at")), F.col("at"))]
    if p.confirm:
        again = F.col("t") + p.confirm
        fires.append(F.when(free(F.col("at")) & free(again) & (again <= F.col("duration_ms")), again))
    return cand.select(*CHANNEL, F.explode(F.array_compact(F.array(*fires))).alias("t_ms")).distinct()


#: What a policy of turn_end_grid() says, with its type: the fields of Policy that turn ends use.
GRID = "policy string, min_gap int, min_wait int, other_dur int, deadline int, resume_min int, confirm int, eot_th double, read_from int, mw_model int"


def grid_row(name: str, p: Policy) -> tuple:
    return (name, p.min_gap, p.min_wait, p.other_dur, p.deadline, p.resume_min, p.confirm, p.eot_th, p.read_from, p.mw_model)


def turn_end_channels(speech: DataFrame, durations: DataFrame, policies: DataFrame, track: DataFrame, score: str = "eot", step_ms: int = 80) -> DataFrame:
    """(conv_id, speaker, duration_ms, ends): a channel's candidates for all policies (columns of GRID), as (min_gap, resume_min, t, resumed, others, hits): the other's
    vocalisations (a, b) and the frames (at, p: when it is known, its score) that the widest policy may ask for.

    Speech is merged once for each min_gap, resumptions are found once for each min_gap and resume_min, and frames are read once, for all thresholds. No policy
    multiplies what is shuffled.
    """
    gaps, voices = sorted(r.min_gap for r in policies.select("min_gap").distinct().collect()), None  # one for each merge, so few
    for g in gaps:
        one = union_intervals(speech, CHANNEL, g, inclusive=False).withColumn("min_gap", F.lit(g))
        voices = one if voices is None else voices.unionByName(one)
    voices = settle(voices.select("min_gap", *CHANNEL, "start_ms", "end_ms"), "voices")

    forms = F.broadcast(policies.select("min_gap", "resume_min").distinct())
    w = W.partitionBy("min_gap", "resume_min", *CHANNEL).orderBy("start_ms", "end_ms")
    lasting = F.expr("end_ms + min_gap - start_ms >= resume_min")
    resumed = F.first(F.when(lasting, F.col("start_ms")), ignorenulls=True).over(w.rowsBetween(1, W.unboundedFollowing))
    ends = voices.join(forms, "min_gap").withColumn("resumed", resumed).select("min_gap", "resume_min", *CHANNEL, F.col("end_ms").alias("t"), "resumed")

    widest = policies.groupBy("min_gap").agg(F.min(F.col("min_wait") - F.col("min_gap")).alias("lo"), F.max("deadline").alias("hi"))
    window = voices.join(F.broadcast(widest), "min_gap").selectExpr("min_gap", *CHANNEL, "end_ms AS t", "end_ms + lo AS start_ms", "end_ms + hi AS end_ms").distinct()
    other = voices.withColumn("speaker", (3 - F.col("speaker")).cast("int"))
    met = range_join(window, other, ["min_gap", *CHANNEL]).groupBy("min_gap", *CHANNEL, "t").agg(F.collect_list(F.struct(F.col("b_start_ms").alias("a"), F.col("b_end_ms").alias("b"))).alias("others"))

    scored = policies.where("eot_th IS NOT NULL").agg(F.min("read_from").alias("lo"), F.max("deadline").alias("hi"), F.min("eot_th").alias("least"))  # one row
    known = (F.col("i") + 1) * step_ms
    high = track.select(*CHANNEL, known.alias("start_ms"), known.alias("end_ms"), F.col(score).alias("p")).crossJoin(F.broadcast(scored.select("least"))).where("p >= least").drop("least")
    asked = voices.select(*CHANNEL, F.col("end_ms").alias("t")).distinct().crossJoin(F.broadcast(scored.select("lo", "hi"))).selectExpr(*CHANNEL, "t", "t + lo AS start_ms", "t + hi AS end_ms").where("end_ms >= start_ms")
    hits = range_join(asked, high, CHANNEL).groupBy(*CHANNEL, "t").agg(F.collect_list(F.struct(F.col("b_start_ms").alias("at"), F.col("b_p").alias("p"))).alias("hits"))

    each = ends.join(met, ["min_gap", *CHANNEL, "t"], "left").join(hits, [*CHANNEL, "t"], "left")
    each = each.withColumns({c: F.coalesce(c, F.array()) for c in ("others", "hits")})
    return each.groupBy(*CHANNEL).agg(F.collect_list(F.struct("min_gap", "resume_min", "t", "resumed", "others", "hits")).alias("ends")).join(durations, "conv_id")


def end_fires(channels: DataFrame, policies: DataFrame) -> DataFrame:
    """channels (…, duration_ms, ends) with a row for each policy that fires there: policy, and `seen`, the times of its turn ends in order. Policies, which go to
    every task, multiply channels in their own row: nothing is shuffled for them."""
    rest = [c for c in channels.columns if c not in ("duration_ms", "ends")]
    heard = "greatest(o.a + other_dur, e.t + min_wait)"
    own = """transform(filter(ends, e -> e.min_gap = min_gap AND e.resume_min = resume_min), e -> named_struct('t', e.t, 'others', e.others, 'hits', e.hits,
        'cancel', IF(e.resumed - e.t <= greatest(deadline, coalesce(confirm, 0)), e.resumed + resume_min, NULL)))"""
    taken = f"array_min(transform(filter(e.others, o -> o.b >= e.t + min_wait - min_gap AND o.a <= e.t + deadline AND {heard} <= o.b + min_gap), o -> {heard}))"
    told = "array_min(filter(e.hits, h -> h.p >= eot_th AND h.at BETWEEN e.t + read_from AND least(e.t + deadline, coalesce(e.cancel, e.t + deadline))).at)"
    known = f"transform({own}, e -> named_struct('t', e.t, 'cancel', e.cancel, 'taken', {taken}, 'told', {told}))"
    at = "least(e.t + deadline, coalesce(e.taken, e.t + deadline), coalesce(greatest(e.told, IF(e.told IS NULL, NULL, e.t + mw_model)), e.t + deadline), duration_ms)"
    at = f"transform({known}, e -> named_struct('t', e.t, 'cancel', e.cancel, 'at', {at}))"
    free = "(e.cancel IS NULL OR {0} < e.cancel)"
    again = f"IF({free.format('e.at')} AND {free.format('(e.t + confirm)')} AND e.t + confirm <= duration_ms, e.t + confirm, NULL)"
    seen = f"sort_array(array_distinct(filter(flatten(transform({at}, e -> array(IF({free.format('e.at')}, e.at, NULL), {again}))), x -> x IS NOT NULL)))"
    # Exploded, the times are made once: what comes after would else repeat them wherever it uses them.
    return channels.crossJoin(F.broadcast(policies)).select(*rest, "policy", F.explode(F.array(F.expr(seen))).alias("seen")).where("size(seen) > 0")


def turn_end_grid(speech: DataFrame, durations: DataFrame, policies: DataFrame, track: DataFrame, score: str = "eot", step_ms: int = 80) -> DataFrame:
    """(policy, conv_id, speaker, t_ms): turn_ends() of all policies (columns of GRID) in one plan. speech: intervals that are not merged yet."""
    fires = end_fires(turn_end_channels(speech, durations, policies, track, score, step_ms), policies)
    return fires.select("policy", *CHANNEL, F.explode("seen").alias("t_ms"))


def floor_taken(voices: DataFrame, p: Policy, track: DataFrame | None = None, score: str = "int", step_ms: int = 80) -> DataFrame:
    """(conv_id, speaker, t_ms): at most one interruption for each vocalisation, when the score reaches int_th between int_from and int_dur after its
    start and before it ends, else at int_dur if it lasts that long. A score that rises later says nothing about what was known then."""
    a, heard = F.col("start_ms"), F.col("end_ms") + p.min_gap
    asked = voices.select(*CHANNEL, "start_ms", "end_ms")
    if track is not None and p.int_th is not None:
        asked = _first_known(asked, track, score, p.int_th, a + p.int_from, F.least(heard, a + p.int_dur), step_ms)
    else:
        asked = asked.withColumn("seen", F.lit(None).cast("long"))
    late = F.when((a + p.int_dur <= heard) & F.lit(p.int_fallback), a + p.int_dur)
    return asked.select(*CHANNEL, F.coalesce("seen", late).alias("t_ms")).where("t_ms IS NOT NULL").distinct()
