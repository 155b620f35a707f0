"""Causal and analytic windows over frame tracks (conv_id, speaker, i, …)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

CHANNEL = ["conv_id", "speaker"]


def by_frame() -> W:
    return W.partitionBy(*CHANNEL).orderBy("i")


def speech_segments(track: DataFrame, vad: str, theta: float, min_gap: int) -> DataFrame:
    """(conv_id, speaker, from_i, to_i): runs of frames with vad > theta, where gaps of fewer than min_gap frames are closed."""
    on = track.where(F.col(vad) > theta)
    new = F.coalesce(F.col("i") - F.lag("i").over(by_frame()) - 1 >= F.greatest(F.lit(min_gap), F.lit(1)), F.lit(True))
    runs = on.withColumn("__new", new.cast("int")).withColumn("__run", F.sum("__new").over(by_frame()))
    return runs.groupBy(*CHANNEL, "__run").agg(F.min("i").alias("from_i"), (F.max("i") + 1).alias("to_i")).drop("__run")


def energy_segments(track: DataFrame, level: str, floor: float, below_top: float, min_gap: int, least: int, pad: int) -> DataFrame:
    """Segments by level: the threshold of a channel is the greater of floor and its 99th percentile less below_top; short segments go, and each
    grows by pad frames on both sides, within the track."""
    top = track.groupBy(*CHANNEL).agg(F.greatest(F.lit(floor), F.percentile(level, 0.99) - below_top).alias("th"), F.max("i").alias("last"))
    loud = track.join(top.hint("merge"), CHANNEL).withColumn("__on", (F.col(level) > F.col("th")).cast("double"))
    runs = speech_segments(loud, "__on", 0.5, min_gap).where(F.col("to_i") - F.col("from_i") >= least)
    return runs.join(top.select(*CHANNEL, "last"), CHANNEL).select(
        *CHANNEL, F.greatest(F.col("from_i") - pad, F.lit(0)).alias("from_i"), F.least(F.col("to_i") + pad, F.col("last") + 1).alias("to_i")
    )


def causal_history(track: DataFrame, vad: str, widths: list[int], cap: int) -> DataFrame:
    """Quiet and talk ages (frames since the state began, capped) and trailing means of vad over each width."""
    talk = F.col(vad) > 0.5
    change = F.coalesce((talk != F.lag(talk).over(by_frame())).cast("int"), F.lit(1))
    runs = track.withColumn("__change", change).withColumn("__run", F.sum("__change").over(by_frame()))
    age = F.least(F.row_number().over(W.partitionBy(*CHANNEL, "__run").orderBy("i")), F.lit(cap))
    means = [F.avg(vad).over(by_frame().rowsBetween(-(w - 1), 0)).alias(f"mean_{w}") for w in widths]
    return runs.select(
        *CHANNEL, "i", F.col(vad), F.when(~talk, age).otherwise(0).alias("quiet_age"), F.when(talk, age).otherwise(0).alias("talk_age"), *means
    )


def pair_features(track: DataFrame, columns: list[str]) -> DataFrame:
    """Own columns, then the other channel's of the same frame."""
    other = track.select("conv_id", (3 - F.col("speaker")).alias("speaker"), "i", *[F.col(c).alias(f"other_{c}") for c in columns])
    return track.select(*CHANNEL, "i", *columns).join(other.hint("merge"), [*CHANNEL, "i"])  # frames look small to the planner


def laid_on(track: DataFrame, marks: DataFrame, **values: Column) -> DataFrame:
    """track (conv_id, speaker, i, …) with `values`, aggregates of the columns of marks (conv_id, speaker, i, …) at the same frame, null without marks.

    Frames and marks are one table, so one shuffle by channel does, which windows by channel share. In a join, the planner would take marks made by
    explode for as small as what they are made of, and send them all to every task through the driver.
    """
    kinds = dict(track.dtypes)
    marks = marks.na.drop(subset=[*CHANNEL, "i"]).withColumns({c: F.col(c).cast(kinds[c]) for c in [*CHANNEL, "i"]})
    both = track.withColumn("__on", F.lit(True)).unionByName(marks, allowMissingColumns=True).repartition(*CHANNEL)
    frame = W.partitionBy(*CHANNEL, "i")
    return both.withColumns({name: x.over(frame) for name, x in values.items()}).where("__on").select(*track.columns, *values)


def past_max(x: Column, n: int) -> Column:
    """Greatest of the n frames before, without this one; 0 at the start."""
    return F.coalesce(F.max(x).over(by_frame().rowsBetween(-n, -1)), F.lit(0.0))


def hold(x: Column, n: int, how: str = "min") -> Column:
    """x over this frame and the n before, by least or mean; frames before the start count as 0."""
    w = by_frame().rowsBetween(-n, 0)
    full = F.count("*").over(w) == n + 1
    return F.when(full, F.min(x).over(w)).otherwise(F.least(F.min(x).over(w), F.lit(0.0))) if how == "min" else F.sum(x).over(w) / (n + 1)


def block_reduce(track: DataFrame, x: str, k: int, how: str = "mean") -> DataFrame:
    """Blocks of k frames as one: mean or last value, or with raw the frames of whole blocks as they are; an incomplete tail is dropped."""
    if how == "raw":
        n = F.count("*").over(W.partitionBy(*CHANNEL, F.floor(F.col("i") / k)))
        return track.select(*CHANNEL, "i", x, n.alias("__n")).where(F.col("__n") == k).drop("__n")
    value = F.avg(x) if how == "mean" else F.max_by(x, "i")
    blocks = track.groupBy(*CHANNEL, F.floor(F.col("i") / k).alias("block")).agg(value.alias(x), F.count("*").alias("n"))
    return blocks.where(F.col("n") == k).drop("n")


def trailing_block(track: DataFrame, x: str, k: int, phase: int) -> DataFrame:
    """The mean of the last k frames at every k-th frame from phase on."""
    w = by_frame().rowsBetween(-(k - 1), 0)
    out = track.withColumns({"mean": F.avg(x).over(w), "n": F.count("*").over(w)})
    return out.where((F.col("n") == k) & (F.pmod(F.col("i") - phase, F.lit(k)) == 0)).select(*CHANNEL, "i", "mean")


def standardizer(df: DataFrame, columns: list[str], least: float = 0.01) -> DataFrame:
    """One row: mean and population deviation (at least `least`) of each column."""
    return df.agg(*[F.avg(c).alias(f"{c}_mean") for c in columns], *[F.greatest(F.stddev_pop(c), F.lit(least)).alias(f"{c}_std") for c in columns])


def readout(track: DataFrame, points: DataFrame, columns: list[str], width: int) -> DataFrame:
    """At points (conv_id, speaker, i): own and other values now, and trailing means over width frames."""
    means = {f"{c}_trail": F.avg(c).over(by_frame().rowsBetween(-(width - 1), 0)) for c in columns}
    both = pair_features(track.withColumns(means), [*columns, *means])
    return points.select(*CHANNEL, "i").join(both.hint("merge"), [*CHANNEL, "i"])


def as_of(points: DataFrame, track: DataFrame, step_ms: int) -> DataFrame:
    """points (conv_id, speaker, t_ms) with i, the last frame fully known by t (clamped to the track), and its values: an equi-join on the computed frame.
    Before the first frame is known, i is -1 and numbers are 0."""
    last = track.groupBy(*CHANNEL).agg(F.max("i").alias("__last"))
    frame = F.greatest(F.least(F.floor(F.col("t_ms") / step_ms) - 1, F.col("__last")), F.lit(-1))
    at = points.join(last, CHANNEL).withColumn("i", frame).drop("__last").join(track.hint("merge"), [*CHANNEL, "i"], "left")
    values = [c for c, kind in track.dtypes if c not in (*CHANNEL, "i") and kind in ("double", "float", "int", "bigint")]
    return at.withColumns({c: F.when(F.col("i") < 0, F.lit(0).cast(track.schema[c].dataType)).otherwise(F.col(c)) for c in values})


def stable_suffix(candidates: DataFrame, keys: list[str], order: str, score: str, least: float) -> DataFrame:
    """For each key the earliest candidate from which on all score at least `least`, and how long before the last it is."""
    back = W.partitionBy(*keys).orderBy(F.desc(order))
    flagged = candidates.withColumn("__ok", F.min((F.col(score) >= least).cast("int")).over(back))
    return flagged.groupBy(*keys).agg(F.min(F.when(F.col("__ok") == 1, F.col(order))).alias("stable"), F.max(order).alias("last")).withColumn("lead", F.col("last") - F.col("stable"))


def sufficient_from(candidates: DataFrame, keys: list[str], order: str, score: str, least: float, seen: str) -> DataFrame:
    """For keys of two candidates or more: the earliest after which all later ones but the last score at least `least` (the last itself always counts, a
    missing score ends the stretch), how long before the last it is, and its share of the last's `seen` words."""
    back = W.partitionBy(*keys).orderBy(F.desc(order))
    good = F.coalesce(F.col(score) >= least, F.lit(False)) | (F.row_number().over(back) == 1)
    marked = candidates.withColumn("__ok", good.cast("int")).withColumn("__ok", F.min("__ok").over(back))
    told = marked.groupBy(*keys).agg(
        F.min(F.when(F.col("__ok") == 1, F.struct(order, seen))).alias("s"), F.max(F.struct(order, seen)).alias("l"), F.count("*").alias("n")
    ).where("n >= 2")
    return told.select(*keys, F.col(f"s.{order}").alias("stable"), (F.col(f"l.{order}") - F.col(f"s.{order}")).alias("lead"), F.try_divide(F.col(f"s.{seen}").cast("double"), F.col(f"l.{seen}")).alias("share"))


def consecutive_pairs(candidates: DataFrame, keys: list[str], order: str, words: str) -> DataFrame:
    """Each candidate with the one before it in its turn: Jaccard overlap of their word sets."""
    before = F.lag(words).over(W.partitionBy(*keys).orderBy(order))
    out = candidates.withColumn("__before", before).where("__before IS NOT NULL")
    shared, both = F.size(F.array_intersect(words, "__before")), F.size(F.array_union(words, "__before"))
    return out.select(*keys, order, (shared / F.greatest(both, F.lit(1))).alias("overlap"))


def enrollment_vector(frames: DataFrame, keys: list[str], order: str, vector: str, n: int, active: Column | None = None) -> DataFrame:
    """(keys…, pos, mean): element-wise mean of the vectors of the first n frames of each key; of the active ones, if told which. A key without any
    active frame has zeros."""
    if active is not None:
        zeros = frames.groupBy(*keys).agg(F.max(F.size(vector)).alias("__d")).select(*keys, F.explode(F.sequence(F.lit(0), F.col("__d") - 1)).alias("pos"))
        means = enrollment_vector(frames.where(active), keys, order, vector, n)
        return zeros.join(means, [*keys, "pos"], "left").na.fill(0.0, ["mean"])
    first = frames.withColumn("__r", F.row_number().over(W.partitionBy(*keys).orderBy(order))).where(F.col("__r") <= n)
    return first.select(*keys, F.posexplode(vector).alias("pos", "x")).groupBy(*keys, "pos").agg(F.avg(F.col("x").cast("double")).alias("mean"))
