"""Rasterising segments to frames, and training targets on frames (conv_id, speaker, i)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from turnloom.operators.commit import first_above
from turnloom.operators.intervals import range_join, union_intervals
from turnloom.operators.windows import laid_on, pair_features

CHANNEL = ["conv_id", "speaker"]


def touched(segments: DataFrame, step_ms: int) -> DataFrame:
    """segments with a row for each frame that they touch: start rounded down, end up."""
    last = F.floor((F.col("end_ms") + step_ms - 1) / step_ms) - 1
    return segments.where("end_ms > start_ms").withColumn("i", F.explode(F.sequence(F.floor(F.col("start_ms") / step_ms), last)))


def grid(segments: DataFrame, step_ms: int) -> DataFrame:
    """All frames of both channels up to the end of each conversation."""
    last = segments.groupBy("conv_id").agg(F.max(F.floor((F.col("end_ms") + step_ms - 1) / step_ms) - 1).alias("last"))
    return last.select("conv_id", F.explode(F.array(F.lit(1), F.lit(2))).alias("speaker"), F.explode(F.sequence(F.lit(0).cast("long"), "last")).alias("i"))


def _painted(grid: DataFrame, marks: DataFrame, value: Column) -> DataFrame:
    """grid with an aggregate of a column of marks (conv_id, speaker, i, column), named as it. One table of both, and one shuffle by channel: a join would weigh
    the exploded marks as the segments that they come from, and broadcast them."""
    name = marks.columns[-1]
    marks = marks.na.drop(subset=CHANNEL).withColumn("speaker", F.col("speaker").cast("int"))
    both = grid.withColumn("__on", F.lit(True)).unionByName(marks, allowMissingColumns=True).repartition(*CHANNEL)
    return both.groupBy(*CHANNEL, "i").agg(value.alias(name), F.max("__on").alias("__on")).where("__on").drop("__on")


def rasterize(segments: DataFrame, step_ms: int, pad_ms: int = 0, excluded: Sequence[str] = ()) -> DataFrame:
    """Whether a channel is active in each frame of the grid: the union of all its segments (of several annotators too), each widened by pad_ms on both
    sides. Segments with an excluded label make no activity, but count for the grid's length."""
    said = segments.where(~F.coalesce(F.col("label").isin(*excluded), F.lit(False))) if excluded else segments
    wide = said.where("end_ms > start_ms").withColumns({"start_ms": F.greatest(F.col("start_ms") - pad_ms, F.lit(0)), "end_ms": F.col("end_ms") + pad_ms})
    return _painted(grid(segments, step_ms), touched(wide, step_ms).select(*CHANNEL, "i", F.lit(1).alias("active")), F.max("active")).na.fill(0, ["active"])


def fine_acts(segments: DataFrame, index: Column, step_ms: int) -> DataFrame:
    """The fine label of each frame: the least positive index among its segments, 0 for none."""
    said = touched(segments.withColumn("fine", index), step_ms).where("fine > 0").select(*CHANNEL, "i", "fine")
    return _painted(grid(segments, step_ms), said, F.min("fine")).na.fill(0, ["fine"])


def floor_hard(claims: DataFrame, anchors: DataFrame, step_ms: int) -> DataFrame:
    """(conv_id, i, floor): CONTESTED when both claim the frame's end, HELD_0 or HELD_1 when one does; else the last holder's, or OPEN when its last claim
    ended at an anchor (conv_id, speaker, t_ms), or before any claim. claims: segments that claim the floor."""
    at = (F.col("i") + 1) * step_ms
    ends = anchors.select("conv_id", "speaker", F.col("t_ms").alias("end_ms"), F.lit(True).alias("passed")).distinct()
    told = claims.select(*CHANNEL, "start_ms", "end_ms").join(ends, [*CHANNEL, "end_ms"], "left")
    said = touched(told, step_ms).where((at > F.col("start_ms")) & (at <= F.col("end_ms")))
    every = grid(claims, step_ms).where("speaker = 1").select("conv_id", "i", F.lit(True).alias("__on"))
    # Frames and claims as one table, shuffled once by what the window goes by.
    every = every.unionByName(said.where("conv_id IS NOT NULL").select("conv_id", "i", "speaker", "end_ms", "passed"), allowMissingColumns=True).repartition("conv_id").groupBy("conv_id", "i").agg(
        F.max("__on").alias("__on"), F.max((F.col("speaker") == 1).cast("int")).alias("s1"), F.max((F.col("speaker") == 2).cast("int")).alias("s2"),
        F.max_by(F.struct(F.col("speaker").alias("who"), "passed"), "end_ms").alias("claim"),
    ).where("__on")
    w = W.partitionBy("conv_id").orderBy("i")
    every = every.withColumn("last", F.last(F.when(F.col("s1") + F.col("s2") == 1, F.col("claim")), ignorenulls=True).over(w))
    holder = F.concat(F.lit("HELD_"), (F.col("last.who") - 1).cast("string"))
    floor = F.when(F.col("s1") + F.col("s2") == 2, "CONTESTED").when(F.col("s1").isNotNull(), holder)
    return every.select("conv_id", "i", floor.when(F.col("last").isNull() | F.col("last.passed"), "OPEN").otherwise(holder).alias("floor"))


def floor_soft(hard: DataFrame) -> DataFrame:
    """(conv_id, i, held_0, held_1): runs of CONTESTED between two holders become a linear hand-off, between equal ones they are the neighbour's."""
    w = W.partitionBy("conv_id").orderBy("i")
    change = F.coalesce((F.col("floor") != F.lag("floor").over(w)).cast("int"), F.lit(1))
    runs = hard.withColumn("__c", change).withColumn("run", F.sum("__c").over(w))
    edge = runs.groupBy("conv_id", "run").agg(F.min("floor").alias("floor"), F.min("i").alias("first"), F.count("*").alias("n"))
    by_run = W.partitionBy("conv_id").orderBy("run")
    edge = edge.select("conv_id", "run", "first", "n", F.lag("floor").over(by_run).alias("before"), F.lead("floor").over(by_run).alias("after"))
    out = runs.join(edge, ["conv_id", "run"])
    part = (F.col("i") - F.col("first") + 0.5) / F.col("n")
    def share(name: str) -> Column:
        a, b = (F.coalesce((F.col(c) == name).cast("double"), F.lit(0.0)) for c in ("before", "after"))
        return F.when(F.col("floor") == "CONTESTED", a * (1 - part) + b * part).otherwise((F.col("floor") == name).cast("double"))
    return out.select("conv_id", "i", share("HELD_0").alias("held_0"), share("HELD_1").alias("held_1"))


def target_weights(frames: DataFrame, excluded: DataFrame, step_ms: int) -> DataFrame:
    """frames with weight 0 where an excluded span (conv_id, speaker, start_ms, end_ms) touches them, else 1."""
    out = touched(excluded, step_ms).select(*CHANNEL, "i", F.lit(0.0).alias("__out"))
    return laid_on(frames, out, weight=F.min("__out")).na.fill(1.0, ["weight"])


def floor_act_weights(frames: DataFrame, eot_excluded: DataFrame, int_excluded: DataFrame, attempts: DataFrame, step_ms: int) -> DataFrame:
    """frames (conv_id, speaker, i, …) with floor_w and act_w, by their end time t: floor_w is 0 for both speakers where a span of
    eot_excluded has start <= t < end; act_w is 0 for the speaker in one of int_excluded, unless that very span is an agreed attempt. Else 1.
    Spans: (conv_id, speaker, start_ms, end_ms)."""
    span = [*CHANNEL, "start_ms", "end_ms"]
    def inside(spans: DataFrame) -> DataFrame:
        first, last = F.ceil(F.col("start_ms") / step_ms) - 1, F.ceil(F.col("end_ms") / step_ms) - 2
        return spans.where(last >= F.greatest(first, F.lit(0))).withColumn("i", F.explode(F.sequence(F.greatest(first, F.lit(0)), last)))
    both = F.explode(F.array(F.lit(1), F.lit(2))).alias("speaker")
    floor = inside(eot_excluded).select("conv_id", both, "i", F.lit(0.0).alias("__floor"))
    act = inside(int_excluded.select(*span).distinct().join(attempts.select(*span).distinct(), span, "left_anti")).select(*CHANNEL, "i", F.lit(0.0).alias("__act"))
    out = laid_on(frames, floor.unionByName(act, allowMissingColumns=True), floor_w=F.min("__floor"), act_w=F.min("__act"))
    return out.na.fill(1.0, ["floor_w", "act_w"])


def floor_projection(hard: DataFrame, horizons: list[int], weight: str | None = None) -> DataFrame:
    """The floor after each horizon in frames; null past the end. With a weight column, also the weight there, 0 past the end."""
    w = W.partitionBy("conv_id").orderBy("i")
    ahead = [F.lead("floor", h).over(w).alias(f"floor_{h}") for h in horizons]
    if weight:
        ahead += [F.coalesce(F.lead(F.col(weight).cast("double"), h).over(w), F.lit(0.0)).alias(f"weight_{h}") for h in horizons]
    return hard.select("conv_id", "i", "floor", *ahead)


def vap_code(active: DataFrame, bins: list[int]) -> DataFrame:
    """(conv_id, speaker, i, code, valid): bit k is set when the channel is active in at least half of the k-th future bin of that many frames."""
    w = W.partitionBy(*CHANNEL).orderBy("i")
    lo, code = 1, F.lit(0)
    for k, n in enumerate(bins):
        share = F.avg("active").over(w.rowsBetween(lo, lo + n - 1))
        code = code + F.when(F.coalesce(share, F.lit(0.0)) >= 0.5, 1 << k).otherwise(0)
        lo += n
    left = F.count("*").over(w.rowsBetween(1, lo - 1))
    return active.select(*CHANNEL, "i", code.alias("code"), (left == lo - 1).alias("valid"))


def vap_occupancy(active: DataFrame, bins: list[int]) -> DataFrame:
    """Mean activity of the channel in each future bin; null past the end."""
    w = W.partitionBy(*CHANNEL).orderBy("i")
    out, lo = [], 1
    for k, n in enumerate(bins):
        out.append(F.avg("active").over(w.rowsBetween(lo, lo + n - 1)).alias(f"occ_{k}"))
        lo += n
    return active.select(*CHANNEL, "i", *out)


def vap_targets(active: DataFrame, bins: list[int]) -> DataFrame:
    """(conv_id, speaker, i, own_k, other_k, mask_k): mean activity of both channels in each future bin, of the frames that there are (0 if none), and
    whether the whole bin lies in the conversation."""
    w = W.partitionBy(*CHANNEL).orderBy("i")
    own, lo = {}, 1
    for k, n in enumerate(bins):
        ahead = w.rowsBetween(lo, lo + n - 1)
        own |= {f"own_{k}": F.coalesce(F.avg("active").over(ahead), F.lit(0.0)), f"mask_{k}": F.count("*").over(ahead) == n}
        lo += n
    both = pair_features(active.select(*CHANNEL, "i", *[c.alias(name) for name, c in own.items()]), list(own))
    return both.select(*CHANNEL, "i", *[F.col(c).alias(c.replace("other_own", "other")) for k in range(len(bins)) for c in (f"own_{k}", f"other_own_{k}", f"mask_{k}")])


def vap_code_exact(times: DataFrame, segments: DataFrame, bins_ms: list[int], share: float = 0.5) -> DataFrame:
    """times (conv_id, t_ms) with code: bit 4 * channel + k is set when segments of the channel fill at least `share` of its k-th bin after t. Exact on
    intervals: each time meets the merged segments that touch its bins; overlaps are added up by channel and bin."""
    total = sum(bins_ms)
    asked = times.select("conv_id", "t_ms").distinct()
    met = range_join(asked.withColumns({"start_ms": F.col("t_ms"), "end_ms": F.col("t_ms") + total}), union_intervals(segments, CHANNEL), ["conv_id"])
    sums, lo = [], 0
    for k, n in enumerate(bins_ms):
        shared = F.greatest(F.least("b_end_ms", F.col("t_ms") + lo + n) - F.greatest("b_start_ms", F.col("t_ms") + lo), F.lit(0))
        sums += [F.sum(F.when(F.col("b_speaker") == c + 1, shared).otherwise(0)).alias(f"s_{c}_{k}") for c in (0, 1)]
        lo += n
    code = F.lit(0)
    for c in (0, 1):
        for k, n in enumerate(bins_ms):
            code = code + F.when(F.col(f"s_{c}_{k}") >= share * n, 1 << (len(bins_ms) * c + k)).otherwise(0)
    told = met.groupBy("conv_id", "t_ms").agg(*sums).select("conv_id", "t_ms", code.alias("code"))
    return asked.join(told, ["conv_id", "t_ms"], "left").na.fill(0, ["code"])


def arrival_slots(active: DataFrame) -> DataFrame:
    """(conv_id, speaker, slot): channels by their first active frame, ties by speaker, never active last."""
    first = active.groupBy(*CHANNEL).agg(F.min(F.when(F.col("active") == 1, F.col("i"))).alias("first"))
    return first.select(*CHANNEL, (F.row_number().over(W.partitionBy("conv_id").orderBy(F.asc_nulls_last("first"), "speaker")) - 1).alias("slot"))


def to_slots(per_speaker: DataFrame, slots: DataFrame) -> DataFrame:
    """A table by conv_id and speaker with every speaker replaced by its slot (conv_id, speaker, slot), from 0."""
    return per_speaker.join(slots.select(*CHANNEL, "slot").hint("shuffle_hash"), CHANNEL).drop("speaker")


def floor_to_slots(hard: DataFrame, slots: DataFrame) -> DataFrame:
    """The floor with HELD_<slot> for HELD_<speaker - 1>; OPEN and CONTESTED stay."""
    by = slots.withColumns({"floor": F.concat(F.lit("HELD_"), (F.col("speaker") - 1).cast("string")), "held": F.concat(F.lit("HELD_"), F.col("slot").cast("string"))})
    out = hard.join(by.select("conv_id", "floor", "held").hint("shuffle_hash"), ["conv_id", "floor"], "left")
    return out.withColumn("floor", F.coalesce("held", "floor")).drop("held").select(*hard.columns)


def onset_label(onsets: DataFrame, fine: DataFrame, width: int) -> DataFrame:
    """onsets (conv_id, speaker, i) with the most frequent positive fine label in the width frames from them on, the lowest of equals, as its place
    in the order of priority (onset_fine); vocab.group_of_index() names its group."""
    asked = onsets.withColumn("f", F.explode(F.sequence(F.col("i"), F.col("i") + width - 1)))
    seen = fine.where("fine > 0").select(*CHANNEL, F.col("i").alias("f"), "fine")
    return asked.join(seen.hint("merge"), [*CHANNEL, "f"]).groupBy(*CHANNEL, "i").agg(F.mode("fine", True).alias("onset_fine"))


def class_weights(labels: DataFrame, label: str, alpha: float, cap: float = 20.0) -> DataFrame:
    """Frequency to the power -alpha, scaled to mean 1 over classes, at most cap."""
    counts = labels.groupBy(label).agg(F.count("*").alias("n"))
    raw = F.pow(F.greatest("n", F.lit(1)).cast("double"), F.lit(-alpha))
    return counts.withColumn("raw", raw).withColumn("weight", F.least(F.col("raw") / F.avg("raw").over(W.partitionBy(F.lit(1))), F.lit(cap))).drop("raw")


def crop_starts(lengths: DataFrame, crop: int, warm: int, every: int, repeat: Column | None = None) -> DataFrame:
    """(conv_id, start): starts from warm on, and before n - crop, in a conversation of n frames; each so many times as repeat says."""
    ok = lengths.where(F.col("n") - crop > warm)
    starts = F.sequence(F.lit(warm).cast("long"), F.col("n") - crop - 1, F.lit(every).cast("long"))
    if repeat is not None:
        starts = F.flatten(F.array_repeat(starts, repeat.cast("int")))
    return ok.select("conv_id", F.explode(starts).alias("start"))


def chunk_plan(lengths: DataFrame, size: int, context: int) -> DataFrame:
    """(conv_id, from_i, start, to_i): consecutive chunks of size frames of a conversation of n, and where reading begins, up to context frames before."""
    cut = lengths.where("n > 0").select("conv_id", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(size).cast("long"))).alias("start"))
    return cut.select("conv_id", F.greatest(F.col("start") - context, F.lit(0)).alias("from_i"), "start", F.least(F.col("start") + size, F.col("n")).alias("to_i"))


def slots_from_diarization(segments: DataFrame, slots: int = 2) -> DataFrame:
    """(conv_id, who, slot, ok): speakers named `who` by their first start, ties by name; ok is false where there are more than `slots`."""
    first = segments.groupBy("conv_id", "who").agg(F.min("start_ms").alias("first"))
    every = W.partitionBy("conv_id")
    return first.select("conv_id", "who", (F.row_number().over(every.orderBy("first", "who")) - 1).alias("slot"), (F.count("*").over(every) <= slots).alias("ok"))


def slot_activity(segments: DataFrame, lengths: DataFrame, step_ms: int, slots: int = 2) -> DataFrame:
    """(conv_id, i, slot, active) of conversations with at most `slots` speakers: 1 where a segment (conv_id, who, start_ms, end_ms) of the slot's speaker covers the centre of
    frame i. lengths: (conv_id, frames). Those with more speakers are left out; slot_rejects() names them."""
    named = slots_from_diarization(segments, slots).where("ok").select("conv_id", "who", "slot")
    half = step_ms / 2
    first, last = F.greatest(F.ceil((F.col("start_ms") - half) / step_ms), F.lit(0)), F.ceil((F.col("end_ms") - half) / step_ms) - 1
    spoken = segments.join(named, ["conv_id", "who"]).withColumns({"a": first, "b": last}).where("a <= b")
    spoken = spoken.select("conv_id", "slot", F.explode(F.sequence("a", "b")).alias("i")).distinct().withColumn("active", F.lit(1))
    grid = lengths.join(named.select("conv_id").distinct(), "conv_id").where("frames > 0")
    grid = grid.select("conv_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("frames") - 1)).alias("i"))
    grid = grid.withColumn("slot", F.explode(F.array(*[F.lit(k) for k in range(slots)])))
    return grid.join(spoken.hint("merge"), ["conv_id", "slot", "i"], "left").select("conv_id", "i", "slot", F.coalesce("active", F.lit(0)).alias("active"))


def slot_rejects(segments: DataFrame, slots: int = 2) -> DataFrame:
    """(conv_id, speakers) of conversations with more speakers than slots."""
    return segments.groupBy("conv_id").agg(F.count_distinct("who").alias("speakers")).where(F.col("speakers") > slots)


def eot_targets(frames: DataFrame, gold: DataFrame, vad: str, step_ms: int, background: float = 0.02, longest_ms: int = 2500, speech: float = 0.5) -> DataFrame:
    """(conv_id, speaker, i, y, w): training targets of the end of turns on quiet frames, by their end time t.

    Positives begin at an anchor, never before it, and stop where speech resumes or after longest_ms; negatives are the quiet frames of annotated pauses. Each
    such window has a total weight of 1. The other quiet frames share `background` per quiet episode, from the channel's first speech on. What
    is excluded has no weight. Excluded goes before positive, positive before negative, and of several windows the latest counts.
    gold: (conv_id, kind in pos, neg, excl, speaker, start_ms, end_ms).
    """
    w = W.partitionBy(*CHANNEL).orderBy("i")
    f = frames.select(*CHANNEL, "i", (F.col(vad) < speech).alias("quiet"))
    talked = F.coalesce(F.max((~F.col("quiet")).cast("int")).over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)) == 1
    f = f.withColumns({"was_quiet": F.coalesce(F.lag("quiet").over(w), F.lit(False)), "episode": F.sum((~F.col("quiet")).cast("int")).over(w), "talked": talked})
    size = F.count("*").over(W.partitionBy(*CHANNEL, "episode", "quiet"))
    f = f.withColumn("calm", F.when(F.col("quiet") & F.col("talked"), F.lit(background) / size))

    # Where speech resumes after each anchor.
    anchors = gold.where("kind = 'pos'").select(*CHANNEL, F.col("start_ms").alias("anchor")).distinct()
    resumes = f.select(*CHANNEL, "i", (~F.col("quiet") & F.col("was_quiet")).cast("double").alias("rises"))
    asked = anchors.withColumns({"from_i": F.floor(F.col("anchor") / step_ms) - 1, "to_i": F.floor((F.col("anchor") + longest_ms) / step_ms) - 1})
    again = first_above(resumes, asked.select(*CHANNEL, "from_i", "to_i").distinct(), "rises", 1.0)
    asked = asked.join(again, [*CHANNEL, "from_i", "to_i"], "left")
    stop = F.least(F.col("anchor") + longest_ms, F.coalesce((F.col("first_i") + 1) * step_ms, F.col("anchor") + longest_ms))
    pos = asked.select(*CHANNEL, F.col("anchor").alias("lo"), (stop - 1).alias("hi"), F.lit(2).alias("rank"))
    spans = gold.where("kind IN ('neg', 'excl')").select(*CHANNEL, F.col("start_ms").alias("lo"), F.col("end_ms").alias("hi"), F.when(F.col("kind") == "neg", 1).otherwise(3).alias("rank")).distinct()
    windows = pos.unionByName(spans)
    windows = windows.withColumns({"a": F.expr(f"greatest(ceil(lo / {step_ms}) - 1, 0)"), "b": F.expr(f"floor(hi / {step_ms}) - 1")}).where("b >= a")
    # How many quiet frames a window has: those up to its last frame less those before its first, counted in one pass in time.
    bounds = windows.where("rank < 3").select(*CHANNEL, F.explode(F.array(F.col("a") - 1, F.col("b"))).alias("i"), F.struct("rank", "lo", "hi").alias("of"))
    passed = f.where("quiet").select(*CHANNEL, "i", F.lit(1).alias("one")).unionByName(bounds, allowMissingColumns=True)
    passed = passed.withColumn("upto", F.coalesce(F.sum("one").over(W.partitionBy(*CHANNEL).orderBy("i")), F.lit(0))).where("of IS NOT NULL")
    counts = passed.groupBy(*CHANNEL, "of").agg((F.max("upto") - F.min("upto")).alias("n")).select(*CHANNEL, "of.*", "n")
    marked = windows.join(counts, [*CHANNEL, "rank", "lo", "hi"], "left").withColumn("share", F.try_divide(F.lit(1.0), "n"))
    marked = marked.select(*CHANNEL, F.explode(F.sequence("a", "b")).alias("i"), F.struct("rank", "lo", "share").alias("__m"))
    excluded = F.col("__m.rank") == 3
    out = laid_on(f, marked, out=F.max(excluded), m=F.max(F.when(~excluded, F.col("__m"))), yes=F.max(F.col("__m.rank") == 2))
    held = F.col("quiet") & F.col("m").isNotNull()
    # An excluded frame of a positive window keeps its label.
    yes = F.when(F.col("quiet") & F.col("yes"), 1.0).otherwise(0.0)
    weight = F.when(F.col("out"), 0.0).when(held, F.col("m.share")).otherwise(F.coalesce("calm", F.lit(0.0)))
    return out.select(*CHANNEL, "i", yes.alias("y"), weight.alias("w"))
