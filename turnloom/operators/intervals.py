"""Interval algebra on (key…, start_ms, end_ms) tables of half-open intervals."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Width of the time buckets of range joins: long conversations are spread over them, so no key's rows meet in one task.
BUCKET_MS = 30_000


def range_join(a: DataFrame, b: DataFrame, on: Sequence[str], pad_ms: int = 0, bucket_ms: int = BUCKET_MS) -> DataFrame:
    """Pairs of rows with equal keys whose intervals overlap when those of b are widened by pad_ms on both sides, touching included.

    Columns of b get the prefix b_. Each interval is put in the time buckets that it covers, so the join is an equi-join on key and bucket;
    a pair is kept in the first bucket that both cover.
    """
    lo, hi = F.col("start_ms"), F.col("end_ms")
    left = a.withColumn("__from", F.floor(lo / bucket_ms)).withColumn("__bucket", F.explode(F.sequence("__from", F.floor(hi / bucket_ms))))
    right = b.select(*[F.col(c).alias(f"b_{c}") for c in b.columns])
    blo, bhi = F.col("b_start_ms") - pad_ms, F.col("b_end_ms") + pad_ms
    right = right.withColumn("__b_from", F.floor(blo / bucket_ms)).withColumn("__b_bucket", F.explode(F.sequence("__b_from", F.floor(bhi / bucket_ms))))
    same = [left[c] == right[f"b_{c}"] for c in on]
    cond = left["__bucket"] == right["__b_bucket"]
    for s in same:
        cond = cond & s
    cond = cond & (lo <= bhi) & (blo <= hi) & (F.col("__bucket") == F.greatest("__from", "__b_from"))
    return left.join(right, cond).drop("__from", "__bucket", "__b_from", "__b_bucket")


def union_intervals(df: DataFrame, keys: Sequence[str], gap_ms: int = 0, inclusive: bool = True) -> DataFrame:
    """Merged intervals: those that overlap, or lie at most (inclusive) or less than gap_ms apart. Empty ones are dropped."""
    order = W.partitionBy(*keys).orderBy("start_ms", "end_ms")
    reach = F.max("end_ms").over(order.rowsBetween(W.unboundedPreceding, -1))
    apart = F.col("start_ms") - reach
    new = F.coalesce(apart > gap_ms if inclusive else apart >= gap_ms, F.lit(True))
    if not inclusive:
        new = new & F.coalesce(apart >= 0, F.lit(True))
    runs = df.where("end_ms > start_ms").withColumn("__new", new.cast("int")).withColumn("__run", F.sum("__new").over(order))
    return runs.groupBy(*keys, "__run").agg(F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms")).drop("__run")


def intersect_intervals(a: DataFrame, b: DataFrame, on: Sequence[str], least_ms: int = 1) -> DataFrame:
    """Overlaps of each interval of a with each of b."""
    met = range_join(a, b, on)
    cut = met.select(*on, F.greatest("start_ms", "b_start_ms").alias("start_ms"), F.least("end_ms", "b_end_ms").alias("end_ms"))
    return cut.where(F.col("end_ms") - F.col("start_ms") >= least_ms)


def overlapping(segments: DataFrame, spans: DataFrame, on: Sequence[str]) -> DataFrame:
    """Pairs of segments and spans with segment start < span end and segment end > span start."""
    return range_join(spans, segments, on).where("b_start_ms < end_ms AND b_end_ms > start_ms")


def segment_ending_near(points: DataFrame, segments: DataFrame, on: Sequence[str], tol_ms: int) -> DataFrame:
    """points (on…, t_ms) with the end and label of the nearest segment end within tol_ms; the earlier of two equally near; null if none."""
    p = points.withColumns({"start_ms": F.col("t_ms"), "end_ms": F.col("t_ms")})
    ends = segments.withColumn("start_ms", F.col("end_ms"))
    met = range_join(p, ends, on, pad_ms=tol_ms)
    best = F.min(F.struct(F.abs(F.col("b_end_ms") - F.col("t_ms")).alias("d"), F.col("b_end_ms").alias("e"), F.col("b_label").alias("l"))).alias("m")
    best = met.groupBy(*on, "t_ms").agg(best).select(*on, "t_ms", F.col("m.e").alias("near_end_ms"), F.col("m.l").alias("near_label"))
    return points.join(best, [*on, "t_ms"], "left")


def segment_ending_near_any(points: DataFrame, segments: DataFrame, on: Sequence[str], tol_ms: int) -> DataFrame:
    """As segment_ending_near, over annotators: of the first (by name) who has an end within tol_ms, the nearest one. One join for all annotators."""
    p = points.withColumns({"start_ms": F.col("t_ms"), "end_ms": F.col("t_ms")})
    met = range_join(p, segments.withColumn("start_ms", F.col("end_ms")), on, pad_ms=tol_ms)
    rank = F.struct(F.col("b_annotator").alias("a"), F.abs(F.col("b_end_ms") - F.col("t_ms")).alias("d"), F.col("b_end_ms").alias("e"), F.col("b_label").alias("l"))
    best = met.groupBy(*on, "t_ms").agg(F.min(rank).alias("m"))
    return points.join(best.select(*on, "t_ms", F.col("m.a").alias("annotator"), F.col("m.e").alias("near_end_ms"), F.col("m.l").alias("near_label")), [*on, "t_ms"], "left")


def assign_by_max_overlap(segments: DataFrame, items: DataFrame, on: Sequence[str]) -> DataFrame:
    """segments with the label of the item that they overlap most (the earlier of equals), or NonContent; only the first segment of an item labelled
    as an interruption keeps that label, later ones are its Turn."""
    met = range_join(segments, items, on).where("b_start_ms < end_ms AND b_end_ms > start_ms")
    shared = F.least("end_ms", "b_end_ms") - F.greatest("start_ms", "b_start_ms")
    best = F.max(F.struct(shared.alias("o"), (-F.col("b_start_ms")).alias("s"), F.col("b_label").alias("l"))).alias("m")
    best = met.groupBy(*on, "start_ms", "end_ms").agg(best)
    nth = F.row_number().over(W.partitionBy(*on, "m.s").orderBy("start_ms", "end_ms"))
    label = F.when((F.col("m.l") == "Interruption") & (nth > 1), F.lit("Turn")).otherwise(F.col("m.l"))
    best = best.select(*on, "start_ms", "end_ms", label.alias("assigned"))
    out = segments.join(best, [*on, "start_ms", "end_ms"], "left")
    return out.withColumn("assigned", F.coalesce("assigned", F.lit("NonContent")))


def words_in_segment(words: DataFrame, segments: DataFrame, on: Sequence[str]) -> DataFrame:
    """segments with the words (on…, start_ms, end_ms, word) whose midpoint lies in them, joined by spaces in order."""
    mid = words.withColumn("m2", F.col("start_ms") + F.col("end_ms")).withColumns({"start_ms": F.floor(F.col("m2") / 2), "end_ms": F.floor(F.col("m2") / 2)})
    met = range_join(segments, mid, on).where("b_m2 >= 2 * start_ms AND b_m2 < 2 * end_ms")
    said = F.array_sort(F.collect_list(F.struct(F.col("b_m2").alias("m"), F.col("b_word").alias("w"))))
    return met.groupBy(*on, "start_ms", "end_ms").agg(F.array_join(F.transform(said, lambda x: x["w"]), " ").alias("said"))


def clip_to(spans: DataFrame, keep: DataFrame, on: Sequence[str], label: str = "NonContent") -> DataFrame:
    """spans (on…, start_ms, end_ms, label) where those of the label are cut down to the parts that keep holds."""
    cut = intersect_intervals(spans.where(F.col("label") == label), union_intervals(keep, on), on).withColumn("label", F.lit(label))
    return spans.where(F.col("label") != label).select(*on, "start_ms", "end_ms", "label").unionByName(cut.select(*on, "start_ms", "end_ms", "label"))


def turn_runs(segments: DataFrame, key: str = "conv_id") -> DataFrame:
    """Maximal runs of one speaker's segments in the order of start."""
    order = W.partitionBy(key).orderBy("start_ms", "speaker")
    change = (F.col("speaker") != F.lag("speaker").over(order)).cast("int")
    runs = segments.withColumn("run", F.coalesce(F.sum(change).over(order), F.lit(0)))
    return runs.groupBy(key, "run").agg(F.first("speaker").alias("speaker"), F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"), F.count("*").alias("n")).drop("run")


def floor_transfer_offsets(anchors: DataFrame, turns: DataFrame, key: str = "conv_id", back_ms: int = 3000) -> DataFrame:
    """For anchors (key, speaker, t_ms): the nearest start of the other speaker after t - back_ms, minus t; the earlier of two equally near. Anchors
    without one are left out. The last start up to t and the first after it come from one pass over both tables in time."""
    asked = anchors.select(key, "speaker", "t_ms", F.lit(True).alias("__asked")).distinct()
    starts = turns.select(key, (3 - F.col("speaker")).alias("speaker"), F.col("start_ms").alias("t_ms"), F.lit(False).alias("__asked"))
    w = W.partitionBy(key, "speaker").orderBy("t_ms")
    start = F.when(~F.col("__asked"), F.col("t_ms"))
    both = asked.unionByName(starts).withColumns({
        "__before": F.max(start).over(w.rangeBetween(W.unboundedPreceding, W.currentRow)) - F.col("t_ms"), "__after": F.min(start).over(w.rangeBetween(W.currentRow, W.unboundedFollowing)) - F.col("t_ms"),
    }).where("__asked")
    before = F.when(F.col("__before") > -back_ms, F.col("__before"))
    off = F.when(before.isNotNull() & (F.col("__after").isNull() | (-before <= F.col("__after"))), before).otherwise(F.col("__after"))
    return both.select(key, "speaker", "t_ms", off.alias("offset_ms")).where("offset_ms IS NOT NULL")


def offset_summary(offsets: DataFrame) -> DataFrame:
    """One row: n, median_ms, and the share of offsets below 0 (overlaps). Equal offsets are counted first, so the median sees whole milliseconds once."""
    counts = offsets.groupBy("offset_ms").agg(F.count("*").alias("c"))
    return counts.agg(
        F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.percentile("offset_ms", 0.5, F.col("c")).alias("median_ms"),
        F.try_divide(F.sum(F.when(F.col("offset_ms") < 0, F.col("c")).otherwise(0)).cast("double"), F.sum("c")).alias("overlap_share"),
    )


def rule_labels(segments: DataFrame, key: str = "conv_id", short_ms: int = 1000, around_ms: int = 1000, on_ms: int = 500) -> DataFrame:
    """Backchannel: shorter than short_ms, the other speaks within around_ms before and after, and the speaker does not go on within on_ms. Else Turn."""
    seg = segments.select(key, "speaker", "start_ms", "end_ms")
    other = seg.withColumn("speaker", 3 - F.col("speaker"))
    met = range_join(seg, other, [key, "speaker"], pad_ms=around_ms)
    near = met.groupBy(key, "speaker", "start_ms", "end_ms").agg(
        F.max((F.col("b_start_ms") < F.col("start_ms")) & (F.col("b_end_ms") >= F.col("start_ms") - around_ms)).alias("before"),
        F.max((F.col("b_end_ms") > F.col("end_ms")) & (F.col("b_start_ms") <= F.col("end_ms") + around_ms)).alias("after"),
    )
    nxt = F.lead("start_ms").over(W.partitionBy(key, "speaker").orderBy("start_ms", "end_ms"))
    out = seg.withColumn("goes_on", F.coalesce(nxt - F.col("end_ms") < on_ms, F.lit(False))).join(near, [key, "speaker", "start_ms", "end_ms"], "left")
    hit = (F.col("end_ms") - F.col("start_ms") < short_ms) & F.coalesce("before", F.lit(False)) & F.coalesce("after", F.lit(False)) & ~F.col("goes_on")
    return out.select(key, "speaker", "start_ms", "end_ms", F.when(hit, "Backchannel").otherwise("Turn").alias("rule_label"))


#: Milliseconds a word below which a gap counts as none.
LEAST_WORD_MS = 50


def fill_missing_times(words: DataFrame, key: str, order: str, word: str, duration: str) -> DataFrame:
    """words with null start_ms and end_ms filled: a run of unaligned words shares the time between its aligned neighbours evenly.

    Before the first is 0, after the last the end of the audio (column `duration`). A gap of under LEAST_WORD_MS a word is none: then the run shares the
    neighbours' own time too. Words without a letter or digit take no time and stand at the end of what comes before them, or at the start of
    the first word. If a key has no other words, all share the whole audio. Fractions are cut off.
    """
    w = W.partitionBy(key).orderBy(order)
    every = W.partitionBy(key)
    spoken = F.regexp_like(word, F.lit(r"[\p{L}\p{N}]"))
    out = words.withColumn("spoken", spoken).withColumn("known", F.col("spoken") & F.col("start_ms").isNotNull() & F.col("end_ms").isNotNull())
    times = F.when(F.col("known"), F.struct("start_ms", "end_ms"))
    out = out.withColumns({
        "isle": F.sum(F.col("known").cast("int")).over(w),
        "left": F.last(times, ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, -1)),
        "right": F.first(times, ignorenulls=True).over(w.rowsBetween(1, W.unboundedFollowing)),
        "words": F.sum(F.col("spoken").cast("int")).over(every),
        "all": F.count("*").over(every),
        "place": F.row_number().over(w) - 1,
    })
    kind = F.col("spoken") & ~F.col("known")
    out = out.withColumn("fill", kind)
    run = W.partitionBy(key, "isle", "fill")
    out = out.withColumns({"nth": F.row_number().over(run.orderBy(order)) - 1, "size": F.count("*").over(run)})
    lo, hi = F.coalesce("left.end_ms", F.lit(0)), F.coalesce("right.start_ms", F.col(duration))
    tight = hi - lo < LEAST_WORD_MS * F.col("size")
    out = out.withColumns({"lo": F.when(tight, F.coalesce("left.start_ms", lo)).otherwise(lo), "hi": F.when(tight, F.coalesce("right.end_ms", hi)).otherwise(hi)})
    at = lambda k: F.floor(F.col("lo") + (F.col("hi") - F.col("lo")) * k / F.col("size"))
    share = lambda k: F.floor(F.col(duration) * k / F.col("all"))
    start = F.when(F.col("known"), F.col("start_ms")).when(F.col("fill"), at(F.col("nth")))
    end = F.when(F.col("known"), F.col("end_ms")).when(F.col("fill"), at(F.col("nth") + 1))
    out = out.withColumns({"s": start, "e": end})
    mark = F.coalesce(F.last("e", ignorenulls=True).over(w), F.first("s", ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)))
    silent = F.col("words") == 0
    out = out.withColumns({"start_ms": F.when(silent, share(F.col("place"))).otherwise(F.coalesce("s", mark)), "end_ms": F.when(silent, share(F.col("place") + 1)).otherwise(F.coalesce("e", mark))})
    return out.select(*words.columns)


def top_speakers(utterances: DataFrame, key: str, speaker: str, ms: Column, rest: float = 0.05) -> DataFrame:
    """The two longest talkers of each key (ties by name), with their share; keys where all others hold more than `rest` are rejected."""
    held = utterances.groupBy(key, speaker).agg(F.sum(ms).alias("ms"))
    every = W.partitionBy(key)
    ranked = held.withColumn("rank", F.row_number().over(every.orderBy(F.desc("ms"), speaker))).withColumn("all", F.sum("ms").over(every))
    ranked = ranked.withColumn("two", F.sum(F.when(F.col("rank") <= 2, F.col("ms"))).over(every))
    return ranked.where((F.col("rank") <= 2) & (F.col("all") - F.col("two") <= rest * F.col("all"))).select(key, speaker, "ms", "rank", (F.col("ms") / F.col("all")).alias("share"))


def _run_number(gap_ms: int, w: W) -> Column:
    """Numbers the runs of intervals at most gap_ms apart, within a key."""
    reach = F.max("end_ms").over(w.rowsBetween(W.unboundedPreceding, -1))
    return F.coalesce((F.col("start_ms") - reach > gap_ms).cast("int"), F.lit(1))


def overlap_geometry(
    segments: DataFrame, key: str = "conv_id", run_ms: int = 500, resume_ms: int = 700, overlap_ms: int = 900, took_ms: int = 300, short_ms: int = 1000, past_ms: int = 100
) -> DataFrame:
    """(key, speaker, start_ms, end_ms, geometry) of segments: how each lies to the other speaker's run that is under way when it begins.

    none: there is no such run (one that began before and goes on past_ms longer). Else the other is followed while it resumes within resume_ms, before this
    speaker's own run ends: overlap, if it ends within overlap_ms of the onset; took, if it ends took_ms before the own run does; else short
    or failed by the segment's length. Runs are segments at most run_ms apart.
    """
    on = [key, "speaker"]
    w = W.partitionBy(*on).orderBy("start_ms", "end_ms")
    seg = segments.select(*on, "start_ms", "end_ms").distinct().withColumns({"__n": _run_number(run_ms, w), "__m": _run_number(resume_ms, w)})
    seg = seg.withColumns({"run": F.sum("__n").over(w), "chain": F.sum("__m").over(w)}).drop("__n", "__m")
    seg = seg.withColumn("own_end", F.max("end_ms").over(W.partitionBy(*on, "run")))
    other = seg.withColumn("speaker", (3 - F.col("speaker")).cast("int"))
    runs = other.groupBy(*on, "run", "chain").agg(F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"))
    onset = seg.select(*on, "start_ms", F.col("start_ms").alias("end_ms"), F.col("end_ms").alias("to_ms"), "own_end")
    under_way = range_join(onset, runs, on).where((F.col("b_start_ms") < F.col("start_ms")) & (F.col("b_end_ms") > F.col("start_ms") + past_ms))
    under_way = under_way.select(*on, "start_ms", F.greatest("own_end", "start_ms").alias("end_ms"), "to_ms", "own_end", "b_chain", F.col("b_end_ms").alias("run_end"))
    followed = range_join(under_way.withColumnRenamed("b_chain", "chain"), other.select(*on, "chain", "start_ms", "end_ms"), [*on, "chain"])
    followed = followed.where("b_start_ms < own_end").groupBy(*on, "start_ms", "to_ms", "own_end").agg(F.greatest(F.max("b_end_ms"), F.max("run_end")).alias("last"))
    last, start = F.col("last"), F.col("start_ms")
    kind = F.when(last - start <= overlap_ms, "overlap").when(last < F.col("own_end") - took_ms, "took").when(F.col("to_ms") - start < short_ms, "short").otherwise("failed")
    found = followed.select(*on, "start_ms", F.col("to_ms").alias("end_ms"), kind.alias("geometry"))
    return segments.join(found, [*on, "start_ms", "end_ms"], "left").withColumn("geometry", F.coalesce("geometry", F.lit("none")))


#: The label that the geometry alone gives.
GEOMETRY_LABELS = [
    ("none", "Normal Turn"), ("overlap", "Overlap"), ("took", "Floor-taking Competitive Interruption"), ("short", "Acknowledgement Backchannel"),
    ("failed", "Non-floor Taking Competitive Interruption"),
]


def geometry_label(geometry: Column) -> Column:
    out = F.lit(None).cast("string")
    for kind, label in GEOMETRY_LABELS:
        out = F.when(geometry == kind, label).otherwise(out)
    return out


def rule_judge(geometry: Column, lexical: Column) -> Column:
    """The fine label of a segment from its geometry and the lexical class of its text."""
    heard = {"continuer": "Continuer Backchannel", "reaction": "Reaction Backchannel", "ack": "Acknowledgement Backchannel"}
    out = F.when(lexical == "empty", "Speech, Non-Linguistic").when(lexical == "filler", "Filler")
    for kind, label in heard.items():
        out = out.when((geometry != "none") & (lexical == kind), label)
    return (
        out.when(geometry.isin("short", "failed"), "Non-floor Taking Competitive Interruption").when(geometry == "took", "Floor-taking Competitive Interruption")
        .when(geometry == "overlap", "Overlap").otherwise("Normal Turn")
    )
