"""Breakdowns of errors and corpora, and statistics of signals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from turnloom.functions.text import hash_order, spoken
from turnloom.operators.intervals import range_join
from turnloom.operators.windows import laid_on


def rate_table(items: DataFrame, key: Column, flag: Column) -> DataFrame:
    """n and the share of flag for each level, most frequent first."""
    return items.groupBy(key.alias("level")).agg(F.count("*").alias("n"), F.avg(flag.cast("double")).alias("rate"))


def turn_end_residuals(scores: DataFrame, windows: DataFrame, preds: DataFrame, track: DataFrame, score: str, segments: DataFrame, annotators: list[str], step_ms: int) -> DataFrame:
    """A row for each positive turn end (conv_id, task, speaker, t_ms, outcome, latency_ms as of score_events): peak, the greatest score in its window;
    fired_before, a prediction in the 3 s before the window; label, dur_ms and last (two words) of the own segment that ends nearest within 0.5 s, of the
    first annotator who has one; agree, how many have one within 0.25 s; gap_ms, from the end to the other's first turn that begins after t - 3 s and ends after t.

    segments: (conv_id, annotator, speaker, start_ms, end_ms, label, canonical, text).
    """
    on = ["conv_id", "speaker", "t_ms"]
    pos = scores.where("outcome IN ('TP', 'FN')").join(windows.select(*on, "lo_ms", "hi_ms"), on)
    frames = pos.withColumn("i", F.explode(F.expr(f"sequence(greatest(lo_ms, 0) div {step_ms}, greatest(hi_ms, 0) div {step_ms})")))
    peak = frames.join(track.select("conv_id", "speaker", "i", score).hint("merge"), ["conv_id", "speaker", "i"]).groupBy(*on).agg(F.max(score).alias("peak"))

    point = pos.select(*on).withColumns({"start_ms": F.col("t_ms") - 3000, "end_ms": F.col("t_ms") - 251})
    fired = preds.select("conv_id", "speaker", F.col("t_ms").alias("start_ms"), F.col("t_ms").alias("end_ms"))
    before = range_join(point, fired, ["conv_id", "speaker"]).select(*on).distinct().withColumn("fired_before", F.lit(True))

    at = pos.select(*on).withColumns({"start_ms": F.col("t_ms"), "end_ms": F.col("t_ms")})
    ends = segments.select("conv_id", "speaker", "annotator", F.col("start_ms").alias("from_ms"), F.col("end_ms").alias("start_ms"), "end_ms", "label", "text")
    near = range_join(at, ends, ["conv_id", "speaker"], pad_ms=500)
    off = F.abs(F.col("b_end_ms") - F.col("t_ms"))
    best = F.min(F.struct(F.array_position(F.array(*[F.lit(x) for x in annotators]), F.col("b_annotator")).alias("who"), off.alias("off"), F.col("b_from_ms").alias("a"), F.col("b_end_ms").alias("b"), F.col("b_label").alias("label"), F.col("b_text").alias("text")))
    near = near.groupBy(*on).agg(best.alias("m"), F.count_distinct(F.when(off <= 250, F.col("b_annotator"))).alias("agree"))
    near = near.select(*on, "m.label", (F.col("m.b") - F.col("m.a")).alias("dur_ms"), F.concat_ws(" ", F.slice(spoken(F.col("m.text")), F.greatest(F.size(spoken(F.col("m.text"))) - 1, F.lit(1)), F.lit(2))).alias("last"), "agree")

    turns = segments.where((F.col("annotator") == annotators[0]) & F.col("canonical").isin("Turn", "Interruption")).select("conv_id", (3 - F.col("speaker")).cast("int").alias("speaker"), "start_ms", "end_ms")
    # Of the turns that go on at t those that began in the last 3 s, else the first that begins at t or later, however late.
    point = pos.select(*on).withColumns({"start_ms": F.col("t_ms") - 2999, "end_ms": F.col("t_ms")})
    begun = range_join(point, turns.select("conv_id", "speaker", "start_ms", F.col("start_ms").alias("end_ms"), F.col("end_ms").alias("to_ms")), ["conv_id", "speaker"])
    begun = begun.where("b_to_ms > t_ms").groupBy(*on).agg(F.min("b_start_ms").alias("begun"))
    back = W.partitionBy("conv_id", "speaker").orderBy(F.desc("at"), F.desc("s")).rowsBetween(W.unboundedPreceding, -1)
    asks = pos.select("conv_id", "speaker", F.col("t_ms").alias("at"), F.lit(None).cast("long").alias("s"))
    starts = turns.select("conv_id", "speaker", F.col("start_ms").alias("at"), F.col("start_ms").alias("s"))
    later = asks.unionByName(starts).withColumn("later", F.min("s").over(back)).where("s IS NULL").select("conv_id", "speaker", F.col("at").alias("t_ms"), "later").distinct()
    gap = later.join(begun, on, "left").select(*on, (F.coalesce("begun", "later") - F.col("t_ms")).alias("gap_ms"))

    out = pos.join(peak, on, "left").join(before, on, "left").join(near, on, "left").join(gap, on, "left").na.fill(0, ["agree", "peak"]).na.fill(False, ["fired_before"])
    return out.drop("lo_ms", "hi_ms")


def pause_residuals(scores: DataFrame, gold: DataFrame, preds: DataFrame, segments: DataFrame) -> DataFrame:
    """A row for each annotated pause (negative span): fired, dur_ms, fire_after_ms, prev_label (own segment that ends nearest within 0.3 s of its
    start), other_backchannel (one of the other's touches it). segments: (conv_id, speaker, start_ms, end_ms, label, canonical)."""
    on = ["conv_id", "speaker"]
    neg = gold.where("kind = 'neg'").select(*on, "start_ms", "end_ms").distinct()
    at = [*on, "start_ms", "end_ms"]
    fired = preds.select(*on, F.col("t_ms").alias("start_ms"), F.col("t_ms").alias("end_ms"))
    first = range_join(neg, fired, on).groupBy(*at).agg((F.min("b_start_ms") - F.col("start_ms")).alias("fire_after_ms"))
    point = neg.select(*at).withColumn("to_ms", F.col("end_ms")).withColumn("end_ms", F.col("start_ms"))
    ends = segments.select(*on, F.col("end_ms").alias("start_ms"), "end_ms", "label")
    prev = range_join(point, ends, on, pad_ms=300).groupBy(*on, "start_ms", "to_ms").agg(F.min(F.struct(F.abs(F.col("b_end_ms") - F.col("start_ms")).alias("off"), F.col("b_end_ms").alias("e"), F.col("b_label").alias("label")))["label"].alias("prev_label"))
    prev = prev.withColumnRenamed("to_ms", "end_ms")
    bc = segments.where("canonical = 'Backchannel'").select("conv_id", (3 - F.col("speaker")).cast("int").alias("speaker"), "start_ms", "end_ms")
    bc = range_join(neg, bc, on).where("b_start_ms < end_ms AND b_end_ms > start_ms").select(*at).distinct().withColumn("other_backchannel", F.lit(True))
    out = neg.join(first, at, "left").join(prev, at, "left").join(bc, at, "left").na.fill(False, ["other_backchannel"])
    return out.select(*at, F.col("fire_after_ms").isNotNull().alias("fired"), (F.col("end_ms") - F.col("start_ms")).alias("dur_ms"), "fire_after_ms", "prev_label", "other_backchannel")


def miss_causes(scores: DataFrame, windows: DataFrame, track: DataFrame, score: str, theta: float, step_ms: int) -> DataFrame:
    """(task, cause, n, peak_10 … peak_90) of the positives: hit; prefired, the score was above theta before the window and still is; refractory, it rises
    in the window and nothing fired; never, with quantiles of the greatest score in the window."""
    on = ["conv_id", "task", "speaker", "t_ms"]
    pos = scores.where("outcome IN ('TP', 'FN')").join(windows.select(*on, "lo_ms", "hi_ms"), on)
    first = F.expr(f"greatest(lo_ms, 0) div {step_ms}")
    seen = pos.withColumn("first", first).withColumn("i", F.explode(F.expr(f"sequence(greatest(first - 1, 0), cast(ceil(hi_ms / {step_ms}) as long) - 1)")))
    seen = seen.join(track.select("conv_id", "speaker", "i", score).hint("merge"), ["conv_id", "speaker", "i"])
    inside = F.col("i") >= F.col("first")
    each = seen.groupBy(*on, "outcome").agg(
        F.max(F.when(inside, F.col(score))).alias("peak"), F.max(F.when(F.col("i") == F.col("first"), F.col(score))).alias("begins"), F.max(F.when(F.col("i") == F.col("first") - 1, F.col(score))).alias("before")
    )
    cause = F.when(F.col("outcome") == "TP", "hit").when((F.col("begins") > theta) & (F.col("before") > theta), "prefired").when(F.col("peak") > theta, "refractory").otherwise("never")
    never = F.when(F.col("cause") == "never", F.col("peak"))
    return each.where("peak IS NOT NULL").withColumn("cause", cause).groupBy("task", "cause").agg(F.count("*").alias("n"), *[F.percentile(never, q / 100).alias(f"peak_{q}") for q in (10, 25, 50, 75, 90)])


def anatomy_by_type(scores: DataFrame, spans: DataFrame, meta: DataFrame) -> DataFrame:
    """For each type and outcome: n, median latency, and for pauses the 10, 50 and 90 % quantiles of their length. spans: (conv_id, speaker, t_ms, dur_ms)."""
    told = scores.join(spans, ["conv_id", "speaker", "t_ms"], "left").withColumn("dur_ms", F.when(F.col("outcome").isin("FP", "TN"), F.col("dur_ms")))
    return told.join(meta, "conv_id").groupBy("type", "outcome").agg(
        F.count("*").alias("n"), F.percentile("latency_ms", 0.5).alias("p50_ms"), *[F.percentile("dur_ms", q / 100).alias(f"dur_{q}") for q in (10, 50, 90)]
    )


def corpus_stats(gold: DataFrame, durations: DataFrame, meta: DataFrame, agreement: DataFrame) -> DataFrame:
    """Conversations, minutes, positives, positives per minute and mean agreement (conv_id, agreement) of each type."""
    pos = gold.where("kind = 'pos'").groupBy("conv_id").agg(F.count("*").alias("events"))
    each = durations.join(meta, "conv_id").join(agreement, "conv_id", "left").join(pos, "conv_id", "left").na.fill(0, ["events"])
    minutes = F.sum("duration_ms") / 60000.0
    return each.groupBy("type").agg(F.count("*").alias("conversations"), minutes.alias("minutes"), F.sum("events").alias("events"), F.try_divide(F.sum("events"), minutes).alias("per_minute"), F.avg("agreement").alias("agreement"))


def report_card(results: DataFrame, clean: str) -> DataFrame:
    """Mean over seeds of value for each (group, condition), mean of the group over its conditions, and the drop from the clean condition."""
    seeds = results.groupBy("grp", "condition").agg(F.avg("value").alias("value"))
    base = seeds.where(F.col("condition") == clean).agg(F.avg("value").alias("clean"))
    means = seeds.groupBy("grp").agg(F.avg("value").alias("value"), F.count("*").alias("conditions"))
    return means.crossJoin(F.broadcast(base)).withColumn("drop", F.col("clean") - F.col("value"))


def level_gain(frames: DataFrame, keys: list[str], level: str, snr_db: float, mask: Column | None = None) -> DataFrame:
    """Root mean square of the frames in the mask (0 without any), or else of those within 30 dB of the 95th percentile; and the gain that puts noise
    snr_db below it."""
    if mask is not None:
        x = F.when(mask, F.col(level).cast("double"))
        rms = F.when(F.count(x) > 0, F.sqrt(F.avg(x * x) + 1e-12)).otherwise(0.0)
        return frames.groupBy(*keys).agg(rms.alias("rms")).withColumn("gain", F.col("rms") * 10 ** (-snr_db / 20))
    top = frames.groupBy(*keys).agg(F.percentile(level, 0.95).alias("p95"))
    loud = frames.join(top, keys).where(F.col(level) >= F.col("p95") * 10 ** (-30 / 20))
    return loud.groupBy(*keys).agg(F.sqrt(F.avg(F.col(level) * F.col(level))).alias("rms")).withColumn("gain", F.col("rms") * 10 ** (-snr_db / 20))


def shuffle_control(answers: DataFrame, kind: str, order: list[str], value: str, salt: str) -> DataFrame:
    """answers with the values of each kind permuted: by rank in order against rank by hash. Ranks by hash are counted in ranges of it, those in order in
    ranges of the first column of `order`, so no task orders a kind."""
    by = hash_order(F.concat_ws("/", *order), salt)
    asked = _ranked(answers, kind, F.floor(F.col(order[0]) / 64), order, "__r")
    given = _ranked(answers.select(kind, F.col(value).alias("shuffled"), by.alias("__by")), kind, F.substring("__by", 1, 3), ["__by"], "__r")
    return asked.join(given.drop("__by"), [kind, "__r"]).drop("__r")


def _ranked(rows: DataFrame, group: str, cell: Column, order: list[str], name: str) -> DataFrame:
    """rows with their number from 0 in their group, counted in cells that follow the order."""
    out = rows.withColumn("__cell", cell)
    held = out.groupBy(group, "__cell").agg(F.count("*").alias("__n"))
    before = F.sum("__n").over(W.partitionBy(group).orderBy("__cell").rowsBetween(W.unboundedPreceding, -1))
    held = held.select(group, "__cell", F.coalesce(before, F.lit(0)).alias("__before"))
    within = F.row_number().over(W.partitionBy(group, "__cell").orderBy(*order)) - 1
    return out.withColumn("__within", within).join(held, [group, "__cell"]).withColumn(name, F.col("__before") + F.col("__within")).drop("__cell", "__before", "__within")


def false_event_rate(fires: DataFrame, active: DataFrame, step_ms: int, padded: DataFrame | None = None) -> DataFrame:
    """Fires per minute while the channel is silent and the other talks. fires and active: (conv_id, speaker, i, active). padded: activity with a pad, if
    the channel's own silence is to keep away from its speech."""
    rows = active.select("conv_id", "i", "speaker", F.col("active"), F.lit(None).cast("int").alias("wide"))
    if padded is not None:
        rows = rows.unionByName(padded.select("conv_id", "i", "speaker", F.lit(None).cast("int").alias("active"), F.col("active").cast("int").alias("wide")))
    of = lambda c, k: F.max(F.when(F.col("speaker") == k, F.col(c)))
    both = rows.groupBy("conv_id", "i").agg(*[of(c, k).alias(f"{c}_{k}") for c in ("active", "wide") for k in (1, 2)])
    own = "active" if padded is None else "wide"
    there = F.col("active_1").isNotNull() & F.col("active_2").isNotNull() & (F.lit(padded is None) | F.col("wide_1").isNotNull() & F.col("wide_2").isNotNull())
    sides = F.array(*[F.struct(F.lit(k).alias("speaker"), F.col(f"{own}_{k}").alias("own"), F.col(f"active_{3 - k}").alias("other")) for k in (1, 2)])
    quiet = both.where(there).select("conv_id", "i", F.inline(sides)).where("own = 0 AND other = 1").select("conv_id", "speaker", "i")
    return _per_minute(quiet, fires, step_ms)


def padded_false_event_rate(fires: DataFrame, segments: DataFrame, step_ms: int, pad_ms: int, excluded: list[str] | tuple[str, ...] = ()) -> DataFrame:
    """What false_event_rate() says of fires with the activity that frames.rasterize() makes of segments (conv_id, speaker, start_ms, end_ms, label), and its form with
    a pad. Bounds of activity and fires are one table, in which running sums tell where the channel is silent and the other talks: no frames are made."""
    in_frames = lambda ms: F.floor((ms + step_ms - 1) / step_ms)  # noqa: E731 - the frames up to a time, the one it lies in too
    start, end, speaker = F.col("start_ms"), F.col("end_ms"), F.col("speaker")
    counts = (~F.coalesce(F.col("label").isin(*excluded), F.lit(False)) if excluded else F.lit(True)) & (end > start) & speaker.isin(1, 2)
    def bound(of, at, own: int, other: int):
        return F.struct(of.cast("int").alias("speaker"), at.cast("long").alias("at"), F.lit(own).alias("own"), F.lit(other).alias("other"))
    bounds = F.array(
        bound(speaker, F.floor(F.greatest(start - pad_ms, F.lit(0)) / step_ms), 1, 0), bound(speaker, in_frames(end + pad_ms), -1, 0),
        bound(3 - speaker, F.floor(start / step_ms), 0, 1), bound(3 - speaker, in_frames(end), 0, -1),
    )
    # A segment that makes no activity still counts for the length of the conversation.
    length = F.array(bound(F.lit(1), F.lit(0), 0, 0))
    marks = segments.select("conv_id", in_frames(end).alias("frames"), F.inline(F.when(counts, bounds).otherwise(length)))
    told = fires.select("conv_id", speaker.cast("int").alias("speaker"), F.col("i").cast("long").alias("at"), F.lit(1).alias("fire"))
    both = marks.unionByName(told, allowMissingColumns=True).where("conv_id IS NOT NULL").repartition("conv_id")
    each = both.groupBy("conv_id", "speaker", "at").agg(F.max("frames").alias("frames"), *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("own", "other", "fire")])
    channel = W.partitionBy("conv_id", "speaker").orderBy("at")
    each = each.withColumn("frames", F.max("frames").over(W.partitionBy("conv_id")))
    state = each.withColumns({"own": F.sum("own").over(channel), "other": F.sum("other").over(channel), "to": F.least(F.lead("at").over(channel), "frames")})
    quiet = state.where("own = 0 AND other > 0 AND at < frames").groupBy("speaker").agg(F.sum("fire").alias("fires"), F.sum(F.col("to") - F.col("at")).alias("n"))
    minutes = F.col("n") * step_ms / 60000.0
    return quiet.select("speaker", "fires", minutes.alias("minutes"), F.try_divide(F.col("fires"), minutes).alias("per_minute"))


def _per_minute(quiet: DataFrame, fires: DataFrame, step_ms: int) -> DataFrame:
    hit = quiet.join(fires.select("conv_id", "speaker", "i").withColumn("hit", F.lit(1)).hint("merge"), ["conv_id", "speaker", "i"], "left")
    return hit.groupBy("speaker").agg(F.count("hit").alias("fires"), (F.count("*") * step_ms / 60000.0).alias("minutes"), F.try_divide(F.count("hit"), F.count("*") * step_ms / 60000.0).alias("per_minute"))


def activity_agreement(ref: DataFrame, est: DataFrame) -> DataFrame:
    """For each conversation the better pairing of channels: accuracy, F1, frames of overlap and their recall. One pass over both pairings."""
    rows = ref.select("conv_id", "i", "speaker", F.col("active").alias("r"), F.lit(1).alias("is_r"), F.lit(None).cast("int").alias("e"), F.lit(0).alias("is_e"))
    rows = rows.unionByName(est.select("conv_id", "i", "speaker", F.lit(None).cast("int").alias("r"), F.lit(0).alias("is_r"), F.col("active").alias("e"), F.lit(1).alias("is_e")))
    each = [F.max(F.when(F.col("speaker") == k, F.col(c))).alias(f"{c}{k}") for c in ("r", "e") for k in (1, 2)]
    x = rows.repartition("conv_id").groupBy("conv_id", "i").agg(*each, F.max("is_r").alias("is_r"), F.max("is_e").alias("is_e")).where("is_r = 1 AND is_e = 1")
    x = x.withColumn("swap", F.explode(F.array(F.lit(False), F.lit(True))))
    a, b = F.when(F.col("swap"), F.col("e2")).otherwise(F.col("e1")), F.when(F.col("swap"), F.col("e1")).otherwise(F.col("e2"))
    x = x.withColumns({"a": a, "b": b})
    same = F.sum((F.col("r1") == F.col("a")).cast("int") + (F.col("r2") == F.col("b")).cast("int"))
    tp = F.sum(F.col("r1") * F.col("a") + F.col("r2") * F.col("b"))
    of = F.sum(F.col("r1") + F.col("r2") + F.col("a") + F.col("b"))
    over = F.sum(F.col("r1") * F.col("r2"))
    per = x.groupBy("conv_id", "swap").agg((same / (2 * F.count("*"))).alias("accuracy"), F.try_divide(2.0 * tp, of).alias("f1"), over.alias("overlap"), F.try_divide(F.sum(F.col("r1") * F.col("r2") * F.col("a") * F.col("b")).cast("double"), over).alias("overlap_recall"))
    return per.withColumn("__r", F.row_number().over(W.partitionBy("conv_id").orderBy(F.desc("accuracy"), "swap"))).where("__r = 1").drop("__r")


def aligned_mean(members: DataFrame, keys: list[str], value: str, n: int) -> tuple[DataFrame, DataFrame]:
    """(mean over n members for each key, violations: keys that not all members have once, or values outside [0, 1])."""
    # The set of a key's few members: a distinct count would group all rows by key and member first, in memory beside the keys.
    each = members.groupBy(*keys).agg(F.avg(value).alias("mean"), F.count("*").alias("n"), F.size(F.collect_set("member")).alias("members"), F.min(value).alias("lo"), F.max(value).alias("hi"))
    bad = (F.col("n") != n) | (F.col("members") != n) | (F.col("lo") < 0) | (F.col("hi") > 1)
    return each.where(~bad).select(*keys, "mean"), each.where(bad).select(*keys)


def consensus(labels: DataFrame, keys: list[str], k: int = 2) -> DataFrame:
    """labels (keys…, annotator, label): the label of at least k annotators or null, and the share that gave it."""
    counts = labels.groupBy(*keys, "label").agg(F.count("*").alias("n"))
    best = counts.groupBy(*keys).agg(F.max(F.struct("n", "label")).alias("m"), F.sum("n").alias("all"))
    return best.select(*keys, F.when(F.col("m.n") >= k, F.col("m.label")).alias("label"), (F.col("m.n") / F.col("all")).alias("agreement"))


def undecided(labels: DataFrame, keys: list[str], k: int = 2) -> DataFrame:
    """The keys whose label no k annotators share, with all that were given, sorted."""
    counts = labels.groupBy(*keys, "label").agg(F.count("*").alias("n"))
    out = counts.groupBy(*keys).agg(F.max("n").alias("most"), F.array_join(F.array_sort(F.collect_set("label")), ",").alias("labels"))
    return out.where(F.col("most") < k).drop("most")


def sufficiency_table(pairs: DataFrame, suff: str, done: str, least: float, cuts: list[tuple[int, int]]) -> DataFrame:
    """One row: n, correlation of the two scores, shares that are only sufficient or only done, and for each range of the second score the count and the
    share that is sufficient. Pairs with a missing score are left out."""
    enough, over = F.col(suff) >= least, F.col(done) >= least
    share = lambda c: F.avg(c.cast("double"))
    ranges = []
    for lo, hi in cuts:
        within = (F.col(done) >= lo) & (F.col(done) < hi)
        ranges += [F.count(F.when(within, 1)).alias(f"n_{lo}_{hi}"), share(F.when(within, enough)).alias(f"sufficient_{lo}_{hi}")]
    return pairs.where(F.col(suff).isNotNull() & F.col(done).isNotNull()).agg(
        F.count("*").alias("n"), F.corr(F.col(suff).cast("double"), F.col(done).cast("double")).alias("corr"), share(enough & ~over).alias("only_sufficient"), share(over & ~enough).alias("only_done"), *ranges
    )


def pause_fires(preds: DataFrame, thetas: int, delays: list[int]) -> DataFrame:
    """(rule, span, label, lasts, k, delay, at): when each span (span, silence_ms, p, label in hold, eot) would be told an end, for thresholds k / thetas.

    first: the first time p >= theta at the delay or later. harness: the first time p > theta at all, acted on at the delay at the earliest. A time tells
    the thresholds between the greatest score before it and its own, so no time is paired with the others. Holds outside 0.2 to 5 s are left out.
    """
    span = W.partitionBy("span")
    rows = preds.withColumn("lasts", F.max("silence_ms").over(span)).where("label = 'eot' OR lasts BETWEEN 200 AND 5000")
    delayed = rows.withColumn("delay", F.explode(F.array(*[F.lit(d) for d in delays])))
    before = F.coalesce(F.max("p").over(W.partitionBy("span", "delay").orderBy("silence_ms").rowsBetween(W.unboundedPreceding, -1)), F.lit(-1.0))
    late = delayed.where("silence_ms >= delay").withColumn("low", before).where("p > low").withColumn("rule", F.lit("first"))
    late = late.withColumns({"a": F.greatest(F.ceil(F.col("low") * thetas + 1e-7), F.lit(0)), "b": F.least(F.floor(F.col("p") * thetas + 1e-7), F.lit(thetas))})
    late = late.withColumn("a", F.when(F.floor(F.col("low") * thetas + 1e-7) >= F.col("a"), F.col("a") + 1).otherwise(F.col("a")))
    early = F.coalesce(F.max("p").over(span.orderBy("silence_ms").rowsBetween(W.unboundedPreceding, -1)), F.lit(-1.0))
    any_ = rows.withColumn("low", early).where("p > low").withColumn("rule", F.lit("harness")).withColumn("delay", F.explode(F.array(*[F.lit(d) for d in delays])))
    any_ = any_.withColumns({"a": F.greatest(F.ceil(F.col("low") * thetas - 1e-7), F.lit(0)), "b": F.least(F.ceil(F.col("p") * thetas - 1e-7) - 1, F.lit(thetas))})
    told = late.unionByName(any_).where("a <= b").withColumn("k", F.explode(F.expr("sequence(cast(a as int), cast(b as int))")))
    return told.select("rule", "span", "label", "lasts", "k", "delay", F.when(F.col("rule") == "harness", F.greatest("delay", "silence_ms")).otherwise(F.col("silence_ms")).alias("at"))


def pause_sweep(preds: DataFrame, thetas: int, delays: list[int], timeouts: list[int]) -> DataFrame:
    """(rule, k, delay, timeout, cutoff, latency_ms) for thresholds k / thetas: the share of holds that are cut off, by the score or by the timeout, and the
    mean latency at ends, which the timeout bounds. Timeouts below the delay are left out.

    Spans without a fire are counted from the spans alone: a setting's sums are those of the fires added to what no fire would give.
    """
    fires = pause_fires(preds, thetas, delays)
    spans = preds.groupBy("span").agg(F.max("silence_ms").alias("lasts"), F.first("label").alias("label")).where("label = 'eot' OR lasts BETWEEN 200 AND 5000")
    hold, eot = F.col("label") == "hold", F.col("label") == "eot"
    alone = spans.agg(F.count_if(hold).alias("holds"), F.count_if(eot).alias("ends"), *[F.count_if(hold & (F.col("lasts") > t)).alias(f"cut_{t}") for t in timeouts])
    gains = []
    for t in timeouts:
        gains.append(F.count_if(hold & (F.col("lasts") <= t) & (F.col("lasts") > F.col("at"))).alias(f"more_{t}"))
        gains.append(F.coalesce(F.sum(F.when(eot & (F.col("at") <= t), t - F.col("at"))), F.lit(0)).alias(f"less_{t}"))
    told = fires.groupBy("rule", "k", "delay").agg(*gains)
    grid = alone.select("*", F.explode(F.array(F.lit("first"), F.lit("harness"))).alias("rule")).select("*", F.explode(F.sequence(F.lit(0), F.lit(thetas))).alias("k"))
    grid = grid.select("*", F.explode(F.array(*[F.lit(d) for d in delays])).alias("delay")).join(told, ["rule", "k", "delay"], "left").na.fill(0)
    rows = F.explode(F.array(*[F.struct(F.lit(t).alias("timeout"), F.try_divide((F.col(f"cut_{t}") + F.col(f"more_{t}")).cast("double"), F.col("holds")).alias("cutoff"), F.try_divide((F.col("ends") * t - F.col(f"less_{t}")).cast("double"), F.col("ends")).alias("latency_ms")) for t in timeouts])).alias("x")
    return grid.select("rule", "k", "delay", rows).select("rule", "k", "delay", "x.*").where("timeout >= delay")


def pause_points(sweep: DataFrame, cutoffs: list[float], latencies: list[int]) -> DataFrame:
    """(rule, what, value): the least latency within each cut-off rate, and the least cut-off rate within each latency."""
    best = [F.min(F.when(F.col("cutoff") <= c + 1e-9, F.col("latency_ms"))).alias(f"latency@{round(100 * c)}%") for c in cutoffs]
    best += [F.min(F.when(F.col("latency_ms") <= t + 1e-9, F.col("cutoff"))).alias(f"cutoff@{t}ms") for t in latencies]
    return sweep.groupBy("rule").agg(*best).unpivot("rule", None, "what", "value")


def validity_join(queries: DataFrame, frames: DataFrame, step_ms: int) -> DataFrame:
    """frames with the value that is live at their end: queries (conv_id, speaker, t_ms, value) hold until the channel's next one."""
    on = ["conv_id", "speaker"]
    # A channel's frames and queries meet in its row, so frames are not shuffled where they lie together by channel.
    ticks = frames.groupBy(*on).agg(F.collect_list("i").alias("ticks"))
    asks = queries.groupBy(*on).agg(F.collect_list(F.struct("t_ms", "value")).alias("asks"))
    told = F.concat(
        F.transform("ticks", lambda i: F.struct(i.alias("i"), ((i + 1) * step_ms).cast("long").alias("t_ms"), F.lit(None).cast("double").alias("value"), F.lit(1).alias("kind"))),
        F.transform(F.coalesce("asks", F.array()), lambda x: F.struct(F.lit(None).cast("long").alias("i"), x["t_ms"].cast("long").alias("t_ms"), x["value"].cast("double").alias("value"), F.lit(0).alias("kind"))),
    )
    each = ticks.join(asks.hint("merge"), on, "left").select(*on, F.inline(told))
    live = F.last("value", ignorenulls=True).over(W.partitionBy(*on).orderBy("t_ms", "kind"))
    return each.withColumn("live", live).where("kind = 1").select(*on, "i", "live")


def validity_spans(queries: DataFrame, frames: DataFrame, step_ms: int) -> DataFrame:
    """frames with the value that is live at their end: queries (conv_id, speaker, t_ms, until_ms, value) hold from t to before until, and where several
    do, the latest counts. Each query meets the frames of its span only."""
    on = ["conv_id", "speaker"]
    span = F.expr(f"sequence(greatest(cast(ceil(t_ms / {step_ms}) as long) - 1, 0), cast(ceil(until_ms / {step_ms}) as long) - 2)")
    held = queries.where(f"cast(ceil(until_ms / {step_ms}) as long) - 2 >= greatest(cast(ceil(t_ms / {step_ms}) as long) - 1, 0)").withColumn("i", F.explode(span))
    held = held.select(*on, "i", F.struct("t_ms", "value").alias("__held"))
    return laid_on(frames.select(*on, "i"), held, live=F.max("__held")).select(*on, "i", F.col("live.value").alias("live"))


def text_context(words: DataFrame, points: DataFrame, key: str, lag_ms: int, n: int) -> DataFrame:
    """points (key, t_ms) with the last n words (key, end_ms, word) that end at least lag_ms before t, however long ago.

    Words are numbered in their order; a point learns the number of the last one it may see from a union in time, and looks up the n before by number.
    """
    numbered = words.withColumn("no", F.row_number().over(W.partitionBy(key).orderBy("end_ms", "word")))
    asks = points.select(key, "t_ms", (F.col("t_ms") - lag_ms).alias("at"), F.lit(None).cast("int").alias("no"), F.lit(1).alias("kind"))
    said = numbered.select(key, F.lit(None).cast("long").alias("t_ms"), F.col("end_ms").alias("at"), "no", F.lit(0).alias("kind"))
    last = F.max("no").over(W.partitionBy(key).orderBy("at", "kind"))
    seen = asks.unionByName(said).withColumn("last", last).where("kind = 1 AND last IS NOT NULL").select(key, "t_ms", F.explode(F.sequence(F.greatest(F.col("last") - (n - 1), F.lit(1)), F.col("last"))).alias("no"))
    met = seen.join(numbered.select(key, "no", "word"), [key, "no"]).groupBy(key, "t_ms").agg(F.array_sort(F.collect_list(F.struct("no", "word"))).alias("w"))
    return points.join(met.select(key, "t_ms", F.array_join(F.transform("w", lambda x: x["word"]), " ").alias("context")), [key, "t_ms"], "left")


def other_turn_context(words: DataFrame, points: DataFrame, n: int) -> DataFrame:
    """points (conv_id, speaker, t_ms) with the last n words that the other speaker has said by t in the latest turn that began before.

    words: (conv_id, speaker, turn_start_ms, end_ms, word). A point meets the words of one turn.
    """
    turns = words.select("conv_id", (3 - F.col("speaker")).cast("int").alias("speaker"), F.col("turn_start_ms").alias("at")).distinct()
    asks = points.select("conv_id", "speaker", F.col("t_ms").alias("at"), F.col("t_ms"), F.lit(0).alias("kind"))
    both = asks.unionByName(turns.withColumns({"t_ms": F.lit(None).cast("long"), "kind": F.lit(1)}))
    began = F.last(F.when(F.col("kind") == 1, F.col("at")), ignorenulls=True).over(W.partitionBy("conv_id", "speaker").orderBy("at", "kind"))
    latest = both.withColumn("turn_start_ms", began).where("kind = 0 AND turn_start_ms IS NOT NULL").select("conv_id", "speaker", "t_ms", "turn_start_ms").distinct()
    said = words.select("conv_id", (3 - F.col("speaker")).cast("int").alias("speaker"), "turn_start_ms", "end_ms", "word")
    met = latest.join(said, ["conv_id", "speaker", "turn_start_ms"]).where("end_ms <= t_ms").groupBy("conv_id", "speaker", "t_ms").agg(F.array_sort(F.collect_list(F.struct("end_ms", "word"))).alias("w"))
    tail = F.slice("w", F.greatest(F.size("w") - (n - 1), F.lit(1)), F.lit(n))
    return points.join(met.select("conv_id", "speaker", "t_ms", F.array_join(F.transform(tail, lambda x: x["word"]), " ").alias("context")), ["conv_id", "speaker", "t_ms"], "left")
