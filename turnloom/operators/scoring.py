"""Gold events, matching of predictions to them, rates, sweeps and comparisons. Times are milliseconds."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from turnloom.operators import folds
from turnloom.operators.intervals import range_join
from turnloom.sources.settle import settle

CHANNEL = ["conv_id", "speaker"]
BEFORE_MS, AFTER_MS = 250, 3000


def gold_events(segments: DataFrame) -> DataFrame:
    """(conv_id, task, kind, speaker, start_ms, end_ms) from segments (conv_id, speaker, start_ms, end_ms, canonical).

    Kinds are pos, neg and excl. EOT: in the order of starts of turns and interruptions, a segment end before the other speaker's next one is positive; before the same speaker's
    the gap between both, if there is one, is a negative span; the last one is neither. INT: starts of interruptions are positive; backchannels and non-content are negative,
    failed attempts to take the floor are excluded.
    """
    order = W.partitionBy("conv_id").orderBy("start_ms", "speaker")
    view = F.col("canonical").isin("Turn", "Interruption")
    # The next segment of a turn or interruption: one pass over the segments, whatever they are.
    nxt = F.first(F.when(view, F.struct("speaker", "start_ms")), ignorenulls=True).over(order.rowsBetween(1, W.unboundedFollowing))
    def event(cond: Column, task: str, kind: str, start: object, end: object) -> Column:
        return F.when(cond, F.struct(F.lit(task).alias("task"), F.lit(kind).alias("kind"), F.col("speaker"), F.col(start).alias("start_ms"), F.col(end).alias("end_ms")))
    passed, held = F.col("nxt.speaker") != F.col("speaker"), (F.col("nxt.speaker") == F.col("speaker")) & (F.col("nxt.start_ms") > F.col("end_ms"))
    events = F.array_compact(F.array(
        event(view & passed, "eot", "pos", "end_ms", "end_ms"),
        event(view & held, "eot", "neg", "end_ms", "nxt.start_ms"),
        event(F.col("canonical") == "Interruption", "int", "pos", "start_ms", "start_ms"),
        event(F.col("canonical").isin("Backchannel", "NonContent"), "int", "neg", "start_ms", "end_ms"),
        event(F.col("canonical") == "NonFloorTakingInterruption", "int", "excl", "start_ms", "end_ms"),
    ))
    told = segments.withColumn("nxt", nxt).select("conv_id", F.explode(events).alias("e"))
    return told.select("conv_id", "e.task", "e.kind", "e.speaker", "e.start_ms", "e.end_ms").distinct()


def match_windows(gold: DataFrame) -> DataFrame:
    """Positives (conv_id, task, speaker, t_ms) with [lo_ms, hi_ms]: from BEFORE_MS before to AFTER_MS after, or the channel's next positive."""
    nxt = F.lead("t_ms").over(W.partitionBy("conv_id", "task", "speaker").orderBy("t_ms"))
    pos = gold.where("kind = 'pos'").select("conv_id", "task", "speaker", F.col("start_ms").alias("t_ms")).distinct()
    return pos.withColumns({"lo_ms": F.col("t_ms") - BEFORE_MS, "hi_ms": F.least(F.col("t_ms") + AFTER_MS, F.coalesce(nxt, F.col("t_ms") + AFTER_MS))})


ON = ["conv_id", "task", "speaker"]


def _by_channel(gold: DataFrame) -> DataFrame:
    """(conv_id, task, speaker, pos, negs, excl): a channel's gold as arrays in order."""
    span = F.struct("start_ms", "end_ms")
    return gold.groupBy(*ON).agg(
        F.sort_array(F.collect_set(F.when(F.col("kind") == "pos", F.col("start_ms")))).alias("pos"),
        F.sort_array(F.collect_set(F.when(F.col("kind") == "neg", span))).alias("negs"),
        F.collect_set(F.when(F.col("kind") == "excl", span)).alias("excl"),
    )


def _claimed(seen: pa.Array, pos: pa.Array, negs: pa.Array, excl: pa.Array) -> pa.Array:
    return folds.matches(seen, pos, negs, excl, BEFORE_MS, AFTER_MS)


def _matched(gold: DataFrame, preds: DataFrame, keys: tuple[str, ...], how: str, fires: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """(keys…, conv_id, task, speaker, pos, negs, hits, fps): for each channel the prediction that each positive claims, or null, and whether a
    negative span is hit. Two shuffles, of gold and of predictions by channel; a channel's few events are matched in its row, in the order of time."""
    if fires is None:
        out = _by_channel(gold).join(preds.groupBy(*keys, *ON).agg(F.sort_array(F.collect_set(F.col("t_ms").cast("long"))).alias("seen")), ON, how)
    else:
        out = fires(_by_channel(gold).join(preds, [c for c in ON if c in preds.columns], how))
        if "lats" in out.columns:
            return out
    claimed = F.arrow_udf(_claimed, folds.MATCH)("seen", "pos", "negs", "excl")
    return out.select(*keys, *ON, "pos", "negs", claimed.alias("m")).select(*keys, *ON, "pos", "negs", "m.hits", "m.fps")


def score_events(gold: DataFrame, preds: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys…, conv_id, task, speaker, outcome, t_ms, latency_ms) for each gold event under each set of predictions.

    preds (keys…, conv_id, task, speaker, t_ms). Predictions in an excluded span are dropped. In the order of time each positive claims the first
    prediction in its window that none before has claimed: TP with its latency, else FN. A negative span with a prediction in it that lies in no
    positive's window is FP, else TN. With keys (policies, thresholds), a gold event has a row for each of their values, so there are as many
    rows as events times policies; event_totals() counts without them.
    """
    if keys:
        preds = settle(preds, "preds")
        channels = gold.select(*ON).distinct().crossJoin(F.broadcast(preds.select(*keys).distinct()))  # one row a setting
        silent = channels.join(preds.select(*keys, *ON).distinct(), [*keys, *ON], "left_anti")
        matched = _matched(gold, preds, keys, "inner")
        none = _by_channel(gold).join(silent, ON).select(*keys, *ON, "pos", "negs", F.expr("transform(pos, a -> CAST(NULL AS BIGINT))").alias("hits"), F.expr("transform(negs, n -> false)").alias("fps"))
        matched = matched.select(*none.columns).unionByName(none)
    else:
        matched = _matched(gold, preds, keys, "left")
    events = F.expr("""concat(
        zip_with(pos, hits, (t, h) ->
            named_struct('outcome', IF(h IS NULL, 'FN', 'TP'), 't_ms', t, 'latency_ms', h - t)),
        zip_with(negs, fps, (n, f) ->
            named_struct('outcome', IF(coalesce(f, false), 'FP', 'TN'), 't_ms', n.start_ms, 'latency_ms', CAST(NULL AS BIGINT))))""")
    return matched.select(*keys, *ON, F.explode(events).alias("e")).select(*keys, *ON, "e.outcome", "e.t_ms", "e.latency_ms")


def event_totals(gold: DataFrame, preds: DataFrame, keys: list[str], by: tuple[str, ...] = ("task",), settings: DataFrame | None = None, fires: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """As summarize() of score_events() by keys and `by` (columns of a channel), without a row for each event and setting.

    What fires is counted by setting; what does not is the difference to the totals of gold, which no setting changes. Latencies are counted by
    value before their quantiles, so a setting brings as many rows as there are distinct latencies. settings (keys): those that count even if
    they never fire; default: those with predictions.

    fires: with it, preds has one row for each channel (conv_id, speaker, …, task too if it matters), which meets gold first; fires() then makes of it a row for each
    setting that fires there, with `seen`, its times in order and distinct, or with what they come to (lats, fp: the latencies of its hits, and how many negative
    spans it hits). So settings multiply channels in their own row and not what is shuffled.
    """
    gold = settle(gold, "gold")
    preds = preds if fires else settle(preds, "preds")
    # Without settings, those that only fire in channels without gold count too.
    matched = _matched(gold, preds, tuple(keys), "right" if fires and settings is None else "inner", fires)
    if "lats" not in matched.columns:
        lats = F.expr("filter(zip_with(pos, hits, (t, h) -> h - t), x -> x IS NOT NULL)").alias("lats")
        matched = matched.select(*keys, *ON, lats, F.expr("size(filter(fps, f -> f))").alias("fp"))
    matched = settle(matched.select(*keys, *ON, "lats", "fp"), "matched")
    totals = _by_channel(gold).groupBy(*by).agg(F.sum(F.size("pos")).alias("positives"), F.sum(F.size("negs")).alias("negatives"))
    settings = (matched if fires else preds).select(*keys).distinct() if settings is None else settings
    hit = matched.groupBy(*keys, *by).agg(F.sum(F.size("lats")).alias("tp"), F.sum("fp").alias("fp"))
    counted = matched.select(*keys, *by, F.explode("lats").alias("x")).groupBy(*keys, *by, "x").agg(F.count("*").alias("n"))
    lats = counted.groupBy(*keys, *by).agg(*[F.percentile("x", q, F.col("n")).alias(f"p{round(100 * q)}_ms") for q in (0.1, 0.5, 0.9)])
    all_of = totals.crossJoin(settings) if keys else totals  # as many rows as the answer
    out = all_of.join(hit, [*keys, *by], "left").join(lats, [*keys, *by], "left")
    tp, fp = F.coalesce("tp", F.lit(0)), F.coalesce("fp", F.lit(0))
    return out.select(
        *keys, *by, tp.alias("tp"), (F.col("positives") - tp).alias("fn"), fp.alias("fp"), (F.col("negatives") - fp).alias("tn"),
        F.try_divide(tp.cast("double"), "positives").alias("recall"), F.try_divide(fp.cast("double"), "negatives").alias("fp_rate"), "p10_ms", "p50_ms", "p90_ms",
    )


def channel_totals(gold: DataFrame, preds: DataFrame) -> DataFrame:
    """event_totals() by task, for all speakers (channel 0) and for each."""
    whole = event_totals(gold, preds, []).withColumn("channel", F.lit(0))
    each = event_totals(gold, preds, [], ("task", "speaker")).withColumnRenamed("speaker", "channel")
    return each.unionByName(whole)


def _rates() -> list[Column]:
    n = {k: F.count_if(F.col("outcome") == k) for k in ("TP", "FN", "FP", "TN")}
    return [
        *[v.alias(k.lower()) for k, v in n.items()],
        F.try_divide(n["TP"].cast("double"), n["TP"] + n["FN"]).alias("recall"),
        F.try_divide(n["FP"].cast("double"), n["FP"] + n["TN"]).alias("fp_rate"),
        *[F.percentile("latency_ms", q).alias(f"p{round(100 * q)}_ms") for q in (0.1, 0.5, 0.9)],
    ]


def summarize(scores: DataFrame, keys: list[str]) -> DataFrame:
    """Counts, recall, false-positive rate (null if undefined) and latency quantiles."""
    return scores.groupBy(*keys).agg(*_rates())


def theta_grid(scores: DataFrame, score: str, n: int) -> DataFrame:
    """Thresholds: n quantiles of the positive scores and 0.01 to 0.99, distinct.

    Scores are counted first; a quantile lies between the two distinct scores whose ranks enclose its own, found by ranges of scores with the counts of the
    ranges before, so no task orders all scores.
    """
    counts = settle(scores.where(F.col(score) > 0).groupBy(F.col(score).alias("v")).agg(F.count("*").alias("n")).withColumn("cell", F.floor(F.col("v") * 256)), "score-counts")
    cells = counts.groupBy("cell").agg(F.sum("n").alias("held"), F.max("v").alias("top"))
    before = W.orderBy("cell").rowsBetween(W.unboundedPreceding, -1)
    cells = cells.select("cell", F.coalesce(F.sum("held").over(before), F.lit(0)).alias("before"), F.min("cell").over(W.orderBy("cell").rowsBetween(1, 1)).alias("following"))
    upto = F.col("before") + F.sum("n").over(W.partitionBy("cell").orderBy("v").rowsBetween(W.unboundedPreceding, 0))
    ranked = counts.join(cells, "cell").withColumn("upto", upto)
    least = counts.groupBy(F.col("cell").alias("following")).agg(F.min("v").alias("first_after"))
    after = F.coalesce(F.lead("v").over(W.partitionBy("cell").orderBy("v")), F.col("first_after"))
    ranked = ranked.join(least, "following", "left").withColumn("next", F.coalesce(after, F.col("v"))).select("v", "n", "upto", "next")
    total = counts.agg(F.sum("n").alias("total"))
    asked = total.select("total", F.explode(F.array(*[F.lit(k / (n - 1)) for k in range(n)])).alias("q")).withColumn("at", F.col("q") * (F.col("total") - 1))
    # Rank floor(at) is held by v; the next rank by v too, or by the next score.
    met = asked.join(ranked, (F.floor("at") < F.col("upto")) & (F.floor("at") >= F.col("upto") - F.col("n")))
    low, part = F.col("v"), F.col("at") - F.floor("at")
    high = F.when(F.floor("at") + 1 < F.col("upto"), F.col("v")).otherwise(F.col("next"))
    return met.select((low + part * (high - low)).alias("theta")).unionByName(total.select(F.explode(F.array(*[F.lit(k / 100) for k in range(1, 100)])).alias("theta"))).distinct()


#: Thresholds up to which each frame is compared with all of them; more are met by ranges of the score.
FEW_THETAS = 64


def sweep_edges(track: DataFrame, score: str, thetas: DataFrame, holds: list[int] = ()) -> DataFrame:
    """(theta, conv_id, speaker, i): the rising edges for each threshold. Frame i is an edge for theta in [p(i-1), p(i)): thresholds are joined to these
    intervals, and only a rise takes part. For each of `holds` a column low_k: the least score of the frame and the k after it, null where they end."""
    w = W.partitionBy(*CHANNEL).orderBy("i")
    before = F.coalesce(F.lag(score).over(w), F.lit(0.0))
    lows = [F.when(F.count("*").over(w.rowsBetween(0, k)) == k + 1, F.min(score).over(w.rowsBetween(0, k))).alias(f"low_{k}") for k in holds]
    steps = track.select(*CHANNEL, "i", before.alias("lo"), F.col(score).alias("hi"), *lows).where("hi > lo")
    columns = ["theta", *CHANNEL, "i", *[f"low_{k}" for k in holds]]
    if thetas.count() <= FEW_THETAS:
        return steps.join(F.broadcast(thetas), F.expr("theta >= lo AND theta < hi")).select(*columns)
    grid = thetas.withColumn("cell", F.floor(F.col("theta") * 20))
    cells = steps.withColumn("cell", F.explode(F.expr("sequence(floor(lo * 20), floor(hi * 20))")))
    return cells.join(grid, "cell").where("theta >= lo AND theta < hi").select(*columns)


def channel_rises(track: DataFrame, score: str, thetas: DataFrame, holds: list[int] = ()) -> DataFrame:
    """(conv_id, speaker, rises): a channel's rises in order that some threshold may lie in, as (i, lo, hi, low_k…), as of sweep_edges(). A channel's frames become
    one row in the tasks where they are, and only its rises are kept."""
    least, most = (x or 0.0 for x in thetas.agg(F.min("theta"), F.max("theta")).first())
    ahead = [k for k in holds if k]

    def run(frames: pa.Table) -> pa.Table:
        rises = folds.rises(frames["i"].combine_chunks(), frames["p"].combine_chunks(), least, most, ahead)
        return pa.table({c: frames[c][:1] for c in CHANNEL} | {"rises": rises})

    told = track.select(*CHANNEL, F.col("i").cast("long").alias("i"), F.col(score).cast("double").alias("p"))
    fields = ", ".join(["i: bigint, lo: double, hi: double", *[f"low_{k}: double" for k in ahead]])
    schema = told.select(*CHANNEL).schema.add(StructType.fromDDL(f"rises array<struct<{fields}>>")[0])
    return told.groupBy(*CHANNEL).applyInArrow(run, schema)


def _by_setting(channels: DataFrame, rest: list[str], made: str, settings: tuple, tell: Callable[[pa.RecordBatch, pa.Array], dict[str, pa.Array]]) -> DataFrame:
    """channels (rest…, rises, …) with a row for each setting that fires there: theta, refractory, recommit, and what tell(batch, fires by row) makes of it. A fold
    over a channel's edges keeps them apart for each refractory, and those that hold fire again."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for theta, r, k, at in folds.sweep(b["rises"], *settings):
                n, told = len(at), tell(b, at)
                setting = {"theta": pa.array([theta] * n, pa.float64()), "refractory": pa.array([r] * n, pa.int32()), "recommit": pa.array([k] * n, pa.int32())}
                out = pa.RecordBatch.from_pydict({c: b[c] for c in rest} | setting | told)
                yield out.filter(pc.greater(pc.list_value_length(at), 0))

    schema = channels.select(*rest).schema
    for f in StructType.fromDDL(f"theta double, refractory int, recommit int, {made}"):
        schema = schema.add(f)
    return channels.mapInArrow(run, schema)


def _listed(thetas: DataFrame) -> list[float]:
    return [r.theta for r in thetas.select("theta").collect()]  # one a setting


def sweep_fires(track: DataFrame, score: str, thetas: DataFrame, refractories: list[int], recommits: list[int]) -> DataFrame:
    """(theta, refractory, recommit, conv_id, speaker, i): the commits for each setting; recommit 0 is none."""
    channels = channel_rises(track, score, thetas, recommits)
    fires = _by_setting(channels, CHANNEL, "at array<bigint>", (_listed(thetas), refractories, recommits), lambda b, at: {"at": at})
    return fires.select("theta", "refractory", "recommit", *CHANNEL, F.explode("at").alias("i"))


def rise_totals(channels: DataFrame, thetas: DataFrame, refractories: list[int], recommits: list[int], step_ms: int) -> DataFrame:
    """What event_totals() asks of `fires`, for the commits of sweep_fires() by the end of their frames: channels with their gold and rises become a row for each
    setting that fires there, with the latencies of its hits and its number of false positives. Settings multiply nothing that is shuffled or sent to Python."""
    def tell(b: pa.RecordBatch, at: pa.Array) -> dict[str, pa.Array]:
        m = _claimed(folds.ends(at, step_ms), b["pos"], b["negs"], b["excl"])
        return dict(zip(("lats", "fp"), folds.counted(b["pos"], m), strict=True))

    return _by_setting(channels, ON, "lats array<bigint>, fp bigint", (_listed(thetas), refractories, recommits), tell)


def operating_point(sweep: DataFrame, keys: list[str], budget: float) -> DataFrame:
    """For each key the row with the highest recall and fp_rate <= budget; ties by lower p50_ms, then theta."""
    return _best(sweep.where(F.col("fp_rate") <= budget), keys, F.desc("recall"), F.asc_nulls_last("p50_ms"), F.asc("theta"))


def at_theta(sweep: DataFrame, keys: list[str], theta: float) -> DataFrame:
    """For each key the row with the nearest threshold, the lower of two equally near."""
    return _best(sweep, keys, F.abs(F.col("theta") - theta).asc(), F.asc("theta"))


def fp_at_recall(sweep: DataFrame, keys: list[str], recall: float) -> DataFrame:
    """For each key the row with the lowest fp_rate of those that reach the recall; ties by lower p50_ms, then theta."""
    return _best(sweep.where((F.col("recall") >= recall) & F.col("fp_rate").isNotNull()), keys, F.asc("fp_rate"), F.asc_nulls_last("p50_ms"), F.asc("theta"))


def selection_rank(sweep: DataFrame, keys: list[str], ceiling: float = 0.1) -> DataFrame:
    """sweep with rank: first what keeps fp_rate to the ceiling, by recall; then by lower fp_rate, lower p50_ms, and theta."""
    ok = F.coalesce(F.col("fp_rate") <= ceiling, F.lit(False))
    recall = F.when(ok, F.coalesce("recall", F.lit(-1.0))).otherwise(-1.0)
    order = [ok.desc(), recall.desc(), F.asc_nulls_last("fp_rate"), F.coalesce("p50_ms", F.lit(0.0)).asc(), F.asc("theta")]
    return sweep.withColumn("rank", F.row_number().over(W.partitionBy(*keys).orderBy(*order)))


def _best(rows: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    return rows.withColumn("__r", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("__r = 1").drop("__r")


def greedy_match(pred: DataFrame, gold: DataFrame, keys: list[str], tol: int) -> DataFrame:
    """Predictions (keys…, t_ms) in the order of time take the nearest gold (keys…, g_ms) within tol that is free; the earlier of two equally near."""
    p = pred.withColumns({"start_ms": F.col("t_ms"), "end_ms": F.col("t_ms")})
    g = gold.withColumns({"start_ms": F.col("g_ms"), "end_ms": F.col("g_ms")})
    near = range_join(p, g, keys, pad_ms=tol).groupBy(*keys, "t_ms").agg(F.array_sort(F.collect_set(F.struct(F.abs(F.col("b_g_ms") - F.col("t_ms")).alias("d"), F.col("b_g_ms").alias("g")))).alias("near"))
    folded = near.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("t_ms", "near"))).alias("all"))
    out = F.aggregate("all", F.expr("CAST(array() AS array<struct<t_ms:long,g_ms:long>>)"), lambda acc, x: _take(acc, x))
    return folded.select(*keys, F.explode(out).alias("m")).select(*keys, "m.t_ms", "m.g_ms").where("g_ms IS NOT NULL")


def _take(acc: Column, x: Column) -> Column:
    used = F.transform(acc, lambda m: m["g_ms"])
    free = F.filter(x["near"], lambda n: ~F.array_contains(F.coalesce(used, F.array().cast("array<long>")), n["g"]))
    return F.concat(acc, F.array(F.struct(x["t_ms"].alias("t_ms"), F.try_element_at(free, F.lit(1))["g"].alias("g_ms"))))


def paired_outcomes(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """How two systems differ on the same positives: common, gained (b only), lost (a only), missed by both; median latency gain of the common ones."""
    x = a.where("outcome IN ('TP', 'FN')").select(*keys, (F.col("outcome") == "TP").alias("in_a"), F.col("latency_ms").alias("la"))
    y = b.where("outcome IN ('TP', 'FN')").select(*keys, (F.col("outcome") == "TP").alias("in_b"), F.col("latency_ms").alias("lb"))
    return x.join(y, keys).groupBy("task").agg(
        F.count_if(F.col("in_a") & F.col("in_b")).alias("common"),
        F.count_if(~F.col("in_a") & F.col("in_b")).alias("gained"),
        F.count_if(F.col("in_a") & ~F.col("in_b")).alias("lost"),
        F.count_if(~F.col("in_a") & ~F.col("in_b")).alias("missed"),
        F.median(F.when(F.col("in_a") & F.col("in_b"), F.col("la") - F.col("lb"))).alias("gain_ms"),
        F.avg(F.when(F.col("in_a") & F.col("in_b"), F.col("la") - F.col("lb"))).alias("mean_gain_ms"),
    )


def advancement(a: DataFrame, b: DataFrame, paired: DataFrame, fp_most: float = 0.1, loss_most: float = 0.005, gain_least: float = 16.0) -> DataFrame:
    """Whether system b may take the place of a, by task: summaries of both (summarize()) and their paired outcomes. Each criterion, and all of them."""
    x = a.select("task", F.col("recall").alias("recall_a"))
    y = b.select("task", F.col("recall").alias("recall_b"), F.col("fp_rate").alias("fp_b"))
    out = x.join(y, "task").join(paired.select("task", "gain_ms"), "task").select(
        "task", F.coalesce(F.col("fp_b") <= fp_most, F.lit(False)).alias("fp_ok"), F.coalesce(F.col("recall_b") >= F.col("recall_a") - loss_most, F.lit(False)).alias("recall_ok"),
        F.coalesce(F.col("gain_ms") >= gain_least, F.lit(False)).alias("gain_ok"), (F.col("recall_b") - F.col("recall_a")).alias("recall_delta"),
    )
    return out.withColumn("passed", F.col("fp_ok") & F.col("recall_ok") & F.col("gain_ok"))


def fpr_at_tpr(df: DataFrame, y: str, s: str, tpr: float = 0.9, keys: tuple[str, ...] = ()) -> DataFrame:
    """The share of negatives at or above the score that `tpr` of the positives reach; null with one class."""
    cut = df.where(F.col(y) == 1).groupBy(*keys).agg(F.percentile(s, 1 - tpr).alias("cut")) if keys else df.where(F.col(y) == 1).agg(F.percentile(s, 1 - tpr).alias("cut"))
    met = df.join(cut, list(keys)) if keys else df.crossJoin(cut)
    share = F.avg(F.when(F.col(y) == 0, (F.col(s) >= F.col("cut")).cast("double"))).alias("fpr")
    return met.groupBy(*keys).agg(share) if keys else met.agg(share)


def auc(df: DataFrame, y: str, s: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """Area under the ROC curve with average ranks of ties; null with one class. Scores are counted first, so the window holds distinct ones."""
    counts = df.groupBy(*keys, s).agg(F.count("*").alias("n"), F.sum(F.col(y).cast("long")).alias("pos"))
    upto = F.coalesce(F.sum("n").over(W.partitionBy(*keys).orderBy(s).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    ranked = counts.withColumn("rank", upto + (F.col("n") + 1) / 2.0)
    p, n = F.sum("pos"), F.sum("n")
    value = F.try_divide(F.sum(F.col("pos") * F.col("rank")) - p * (p + 1) / 2.0, p.cast("double") * (n - p))
    return ranked.groupBy(*keys).agg(value.alias("auc"), n.alias("n"), p.alias("positives"))


def cluster_bootstrap(counts: DataFrame, latencies: DataFrame, group: str, system: str, n: int, against: object, least_groups: int = 5, salt: str = "boot") -> DataFrame:
    """(system, metric, value, low, high, diff, low_diff, high_diff, valid): recall, fp_rate and p50_ms of each system on all groups, 2.5 and 97.5 % of n
    resamples of groups with replacement, and the same of the difference to the system `against`, resample by resample, the draws being the same for all.

    counts (group, system, tp, fn, fp, tn), latencies (group, system, latency_ms, n). valid: resamples in which the metric is defined. Groups are numbered in
    ranges of their hash; a draw picks the group whose number is a hash of resample and draw. Draws are counted first and weigh a group's counts and
    latencies, so rows are not repeated: there are at most n times the groups. No rows with fewer than least_groups groups.
    """
    ranged = counts.select(group).distinct().withColumn("__by", F.sha2(F.concat(F.lit(f"{salt}:"), F.col(group).cast("string")), 256))
    ranged = ranged.withColumn("__range", F.substring("__by", 1, 2))
    ranges = ranged.groupBy("__range").agg(F.count("*").alias("held"))
    ranges = ranges.select("__range", F.coalesce(F.sum("held").over(W.orderBy("__range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"), F.sum("held").over(W.partitionBy(F.lit(1))).alias("all"))
    no = F.col("before") + F.row_number().over(W.partitionBy("__range").orderBy("__by", group)) - 1
    groups = settle(ranged.join(ranges, "__range").select(group, no.alias("no"), "all").where(F.col("all") >= least_groups), "groups")
    draws = groups.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    unit = F.conv(F.substring(F.md5(F.concat_ws(":", "rep", "no")), 1, 8), 16, 10).cast("long")
    picks = draws.select("rep", F.pmod(unit, F.col("all")).alias("no")).groupBy("rep", "no").agg(F.count("*").alias("w"))
    # Resample -1 is the whole, each group once.
    picks = picks.join(groups.select("no", group), "no").select("rep", group, "w").unionByName(groups.select(F.lit(-1).alias("rep"), group, F.lit(1).cast("long").alias("w")))
    picks = settle(picks, "picks")
    share = lambda a, b: F.try_divide(F.sum(F.col("w") * F.col(a)).cast("double"), F.sum(F.col("w") * (F.col(a) + F.col(b))))
    rates = picks.join(counts, group).groupBy("rep", system).agg(share("tp", "fn").alias("recall"), share("fp", "tn").alias("fp_rate"))
    p50 = picks.join(latencies, group).groupBy("rep", system).agg(F.percentile("latency_ms", 0.5, F.col("w") * F.col("n")).alias("p50_ms"))
    wide = rates.join(p50, ["rep", system], "left")
    metrics = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in ("recall", "fp_rate", "p50_ms")])
    long = settle(wide.select("rep", system, F.explode(metrics).alias("m")).select("rep", system, "m.*"), "resampled")
    base = long.where(F.col(system) == F.lit(against)).select("rep", "metric", F.col("value").alias("base"))
    both = long.join(base, ["rep", "metric"], "left").withColumn("diff", F.col("value") - F.col("base"))
    drawn = lambda c: F.when(F.col("rep") >= 0, F.col(c))
    whole = lambda c: F.max(F.when(F.col("rep") < 0, F.col(c)))
    return both.groupBy(system, "metric").agg(
        whole("value").alias("value"), F.percentile(drawn("value"), 0.025).alias("low"), F.percentile(drawn("value"), 0.975).alias("high"),
        whole("diff").alias("diff"), F.percentile(drawn("diff"), 0.025).alias("low_diff"), F.percentile(drawn("diff"), 0.975).alias("high_diff"), F.count(drawn("value")).alias("valid"),
    )
