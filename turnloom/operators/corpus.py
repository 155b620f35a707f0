"""Corpus building: splits without shared actors, guards, selection and checks."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from turnloom.functions.text import hash_order, hash_unit
from turnloom.operators.components import components
from turnloom.sources.settle import settle


def actor_split(meta: DataFrame, shares: dict[str, float], salt: str) -> DataFrame:
    """meta (conv_id, actor_1, actor_2) with split: actors are dealt to splits by hash, conversations between splits are `excluded`."""
    actors = meta.select(F.explode(F.array("actor_1", "actor_2")).alias("actor")).distinct()
    u, upto, split = hash_unit(F.col("actor"), salt), 0.0, None
    for name, share in shares.items():
        upto += share
        split = F.when(u < upto, name) if split is None else split.when(u < upto, name)
    dealt = actors.withColumn("split", F.coalesce(split, F.lit(list(shares)[-1])))
    out = meta
    for k in (1, 2):
        out = out.join(dealt.select(F.col("actor").alias(f"actor_{k}"), F.col("split").alias(f"split_{k}")), f"actor_{k}", "left")
    same = (F.col("split_1") == F.col("split_2")) | F.col("actor_2").isNull()
    return out.withColumn("split", F.when(same, F.col("split_1")).otherwise("excluded"))


def order_in_split(split: DataFrame, key: str, salt: str) -> DataFrame:
    """split with nth, the place of a key in the hash order of its split, from 0. Counted in ranges of the hash and offset by those before, so no
    task orders a split."""
    out = split.withColumn("by", hash_order(F.col(key), salt)).withColumn("range", F.substring("by", 1, 3))
    held = out.groupBy("split", "range").agg(F.count("*").alias("n"))
    before = F.sum("n").over(W.partitionBy("split").orderBy("range").rowsBetween(W.unboundedPreceding, -1))
    held = held.select("split", "range", F.coalesce(before, F.lit(0)).alias("offset"))
    within = F.row_number().over(W.partitionBy("split", "range").orderBy("by")) - 1
    return out.withColumn("within", within).join(held, ["split", "range"]).select(*split.columns, (F.col("offset") + F.col("within")).alias("nth"))


def recover_cross_partition(split: DataFrame, gate: str) -> DataFrame:
    """Excluded conversations without an actor of the gate split."""
    return split.where((F.col("split") == "excluded") & (F.col("split_1") != gate) & (F.col("split_2") != gate)).select("conv_id")


def leakage_report(manifest: DataFrame, plan: DataFrame, assignments: DataFrame, source: str, revision: str) -> DataFrame:
    """(problem, id): records (id, split, source, revision, actor_1, actor_2) of another source or revision, not in the plan (id, split) or planned
    for another split, doubled, whose actors are assigned (actor, split) to another split or to none; and actors that stand in several splits."""
    def named(df: DataFrame, name: str, column: str = "id") -> DataFrame:
        return df.select(F.lit(name).alias("problem"), F.col(column).cast("string").alias("id"))
    rows = named(manifest.where(~F.col("source").eqNullSafe(F.lit(source))), "source").unionByName(named(manifest.where(~F.col("revision").eqNullSafe(F.lit(revision))), "revision"))
    planned = manifest.join(plan.select("id", F.col("split").alias("planned")), "id", "left")
    rows = rows.unionByName(named(planned.where("planned IS NULL"), "not_planned")).unionByName(named(planned.where("planned != split"), "split"))
    rows = rows.unionByName(named(manifest.groupBy("id").count().where("count > 1"), "doubled"))
    each = manifest.select("id", "split", F.explode(F.array("actor_1", "actor_2")).alias("actor")).where("actor IS NOT NULL")
    dealt = each.join(assignments.select("actor", F.col("split").alias("dealt")), "actor", "left").where("NOT dealt <=> split")
    rows = rows.unionByName(named(dealt.select("id").distinct(), "actor_elsewhere"))
    shared = each.groupBy("actor").agg(F.min("split").alias("a"), F.max("split").alias("b")).where("a != b")
    return rows.unionByName(named(shared, "shared_actor", "actor"))


def actor_components(meta: DataFrame) -> DataFrame:
    """(conv_id, component): conversations that share actors, by the least conv_id of each component. Each conversation is linked to the least one of each
    of its actors; stars are contracted until nothing hangs from two, so a chain of any length ends."""
    member = meta.select("conv_id", F.explode(F.array("actor_1", "actor_2")).alias("actor")).where("actor IS NOT NULL").distinct()
    least = member.groupBy("actor").agg(F.min("conv_id").alias("b"))
    links = settle(member.join(least, "actor").select(F.col("conv_id").alias("a"), "b").distinct(), "actors")
    found = components(links).select(F.col("a").alias("conv_id"), F.col("b").alias("root"))
    return meta.select("conv_id").distinct().join(found, "conv_id", "left").select("conv_id", F.coalesce("root", "conv_id").alias("component"))


def numbered(rows: DataFrame, cell: Column, order: list, name: str = "no") -> DataFrame:
    """rows with their number from 0 in the order of cell, then `order`: counted in each cell, with the counts of the cells before, so no task orders all."""
    out = rows.withColumn("__cell", cell)
    held = out.groupBy("__cell").agg(F.count("*").alias("__n"))
    held = held.select("__cell", F.coalesce(F.sum("__n").over(W.orderBy("__cell").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    no = F.col("__before") + F.row_number().over(W.partitionBy("__cell").orderBy(*order)) - 1
    return out.join(held, "__cell").withColumn(name, no).drop("__cell", "__before")


#: Seconds of a feed's clips that a task folds at once, in feed caps.
FEED_CAPS_AT_ONCE = 4.0


def feed_partition(feed: Column, val_share: float, salt: str) -> Column:
    """val or train, by the hash of the feed."""
    return F.when(hash_unit(feed, f"{salt}:split") < val_share, "val").otherwise("train")


def _fold_clips(feed_cap: float, episode_cap: float):
    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        """One feed's next clips in order; those that exceed a cap are skipped."""
        rows = rows.sort_values(["by", "episode", "clip"])
        used, episodes, keep = float(rows["feed_used"].iloc[0]), {}, []
        for episode, seconds, before in zip(rows["episode"], rows["seconds"], rows["episode_used"], strict=True):
            held = episodes.get(episode, before)
            ok = used + seconds <= feed_cap and held + seconds <= episode_cap
            keep.append(ok)
            if ok:
                used, episodes[episode] = used + seconds, held + seconds
        return rows.loc[keep, ["feed", "episode", "clip", "seconds", "by"]]

    return fold


def select_clips(
    manifest: DataFrame, seconds: float, feed_cap: float, episode_cap: float, salt: str, least: float, most: float, partition: str | None = None, val_share: float = 0.02
) -> DataFrame:
    """Clips (feed, episode, clip, seconds) of fitting length, in hash order, skipping those that would exceed a feed's or an episode's cap, until
    `seconds` are reached; a larger selection holds a smaller one. partition: train or val feeds only.

    A feed is taken in ranges of the hash, each of about FEED_CAPS_AT_ONCE caps of clips, so what a task folds is bounded by the cap and not by the feed. After
    each round, what feeds and episodes have used goes on to the next, and clips that can't fit any more go at once: feeds and episodes that are
    full never come back. The stop is a running sum over hash ranges and, in them, clips.
    """
    fit = manifest.where(F.col("seconds").between(least, most))
    fit = fit.where(feed_partition(F.col("feed"), val_share, salt) == partition) if partition else fit
    kind = {c: fit.schema[c].dataType.simpleString() for c in ("feed", "episode", "clip")}
    left = fit.select("feed", "episode", "clip", F.col("seconds").cast("double").alias("seconds"), hash_unit(F.concat_ws("#", "episode", F.col("clip").cast("string")), salt).alias("by"))
    left = left.where("feed IS NOT NULL AND episode IS NOT NULL").withColumns({"feed_used": F.lit(0.0), "episode_used": F.lit(0.0)})
    schema = f"feed {kind['feed']}, episode {kind['episode']}, clip {kind['clip']}, seconds double, by double"
    kept = None
    while True:
        left = settle(left, "clips-left")
        held = left.groupBy("feed").agg(F.sum("seconds").alias("held"), F.min("by").alias("lo"), F.max("by").alias("hi"))
        share = F.least(F.lit(1.0), FEED_CAPS_AT_ONCE * feed_cap / F.col("held"))
        upto = settle(held.select("feed", (F.col("lo") + (F.col("hi") - F.col("lo")) * share).alias("upto")), "clips-upto")
        if upto.isEmpty():
            break
        dealt = left.join(upto, "feed")
        now = dealt.where("by <= upto").groupBy("feed").applyInPandas(_fold_clips(feed_cap, episode_cap), schema)
        kept = settle(now if kept is None else kept.unionByName(now), "clips-kept")
        feeds = kept.groupBy("feed").agg(F.sum("seconds").alias("feed_used"))
        episodes = kept.groupBy("feed", "episode").agg(F.sum("seconds").alias("episode_used"))
        left = dealt.where("by > upto").drop("upto", "feed_used", "episode_used").join(feeds, "feed", "left").join(episodes, ["feed", "episode"], "left").na.fill(0.0, ["feed_used", "episode_used"])
        left = left.where((F.col("feed_used") + F.col("seconds") <= feed_cap) & (F.col("episode_used") + F.col("seconds") <= episode_cap))
    if kept is None:
        return left.select("feed", "episode", "clip", "seconds")
    kept = kept.withColumn("range", F.floor(F.col("by") * 256))
    sums = kept.groupBy("range").agg(F.sum("seconds").alias("held"))
    sums = sums.select("range", F.coalesce(F.sum("held").over(W.orderBy("range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)).alias("before"))
    order = W.partitionBy("range").orderBy("by", "episode", "clip").rowsBetween(W.unboundedPreceding, 0)
    running = F.col("before") + F.sum("seconds").over(order) - F.col("seconds")
    return kept.join(sums, "range").withColumn("at", running).where(F.col("at") < seconds).select("feed", "episode", "clip", "seconds")


def donor_plan(ids: DataFrame, key: str, n: int, salt: str, styles: dict[str, float] | None = None, snr: tuple[float, float] = (0.0, 20.0)) -> DataFrame:
    """For each id a channel (1 or 2) and n others, distinct and never itself: the next ones in a hash order, around the end; with a style drawn by
    weight and a level drawn in a range. Offsets on numbers, so no pairs of all; every draw is a hash of the id."""
    each = ids.select(key).distinct()
    by = hash_order(F.col(key), salt)
    ranked = settle(numbered(each.withColumn("by", by), F.substring("by", 1, 3), ["by"], "rank"), "donors")
    total = ranked.count()
    if total < 2:
        return ranked.select(key, F.lit(1).alias("channel"), F.lit(1).alias("nth"), F.col(key).alias("donor"), F.lit("").alias("style"), F.lit(0.0).alias("snr")).where("false")
    unit = lambda what: hash_unit(F.concat_ws("/", F.lit(what), F.col(key).cast("string")), salt)
    weights, upto, style = styles or {"speech": 1.0}, 0.0, None
    for name, weight in weights.items():
        upto += weight / sum(weights.values())
        style = F.when(unit("style") < upto, name) if style is None else style.when(unit("style") < upto, name)
    asked = ranked.select(
        key, "rank", (F.floor(unit("channel") * 2) + 1).cast("int").alias("channel"), F.coalesce(style, F.lit(list(weights)[-1])).alias("style"),
        F.round(snr[0] + unit("snr") * (snr[1] - snr[0]), 6).alias("snr"), F.explode(F.sequence(F.lit(1), F.lit(min(n, total - 1)))).alias("nth"),
    )
    asked = asked.withColumn("pick", F.pmod(F.col("rank") + F.col("nth"), F.lit(total)))
    return asked.join(ranked.select(F.col("rank").alias("pick"), F.col(key).alias("donor")), "pick").select(key, "channel", "nth", "donor", "style", "snr")


#: A pause mark in a script.
PAUSE = r"<pause\s+[0-9.]+\s*>"


def dialogue_filter(items: DataFrame, least_items: int = 20, longest: int = 120, longest_backchannel: int = 4, most_run: int = 4, least_share: float = 0.15) -> DataFrame:
    """(script_id, reasons) of scripts (script_id, pos, id, speaker, kind, text, host, after_word, takes_floor, language) that break a rule; reasons sorted.

    too_short, long_backchannel, long_turn; monologue_run, of items that hold the floor; participation of either of the two speakers; verbatim_repeat of a turn
    by the next item; stage_direction; role_break; no_pauses in floor items; unsegmented, words of over 3.5 characters on average where words are not
    spaced; weak_interruption, where the host has under six words left or the interrupter under five. Pause marks are not words.
    """
    clean = F.regexp_replace("text", PAUSE, " ")
    w = W.partitionBy("script_id").orderBy("pos")
    x = items.withColumns({"clean": clean, "paused": F.regexp_like("text", F.lit(PAUSE)), "floor": (F.col("kind") == "turn") | ((F.col("kind") == "interruption") & F.coalesce("takes_floor", F.lit(False)))})
    x = x.withColumn("n", F.regexp_count("clean", F.lit(r"[^ \t\n\r\f]+")))
    same = F.lower(F.trim("text")).eqNullSafe(F.lag(F.lower(F.trim("text"))).over(w)) & (F.col("kind") == "turn") & (F.lag("kind").over(w) == "turn")
    x = x.withColumn("again", F.coalesce(same, F.lit(False)))
    held = x.where("floor").withColumn("c", F.coalesce((F.col("speaker") != F.lag("speaker").over(w)).cast("int"), F.lit(1))).withColumn("run", F.sum("c").over(w))
    runs = held.groupBy("script_id", "run").count().groupBy("script_id").agg(F.max("count").alias("run"))
    said = x.groupBy("script_id", "speaker").agg(F.sum("n").alias("w")).groupBy("script_id").agg(F.try_divide(F.min("w").cast("double"), F.sum("w")).alias("share"), F.count("*").alias("speakers"))
    hosts = x.select("script_id", F.col("id").alias("host"), F.col("n").alias("host_n")).groupBy("script_id", "host").agg(F.min("host_n").alias("host_n"))
    weak = x.where("kind = 'interruption' AND takes_floor").join(hosts, ["script_id", "host"]).where("host_n - after_word < 6 OR n < 5").select("script_id").distinct().withColumn("weak", F.lit(True))
    flags = x.groupBy("script_id").agg(
        F.count("*").alias("items"), F.max(F.when(F.col("kind") == "backchannel", F.col("n"))).alias("bc"), F.max(F.when(F.col("kind") == "turn", F.col("n"))).alias("turn"), F.max("again").alias("again"),
        F.max(F.regexp_like("clean", F.lit(r"[\[(*].*?[\])*]"))).alias("stage"), F.max(F.regexp_like(F.lower("clean"), F.lit(r"\bas an ai\b"))).alias("role"),
        F.max(F.col("floor") & F.col("paused")).alias("pauses"), F.max(F.col("language").isin("ja", "zh")).alias("unspaced"),
        F.try_divide(F.sum(F.length(F.regexp_replace("clean", r"[ \t\n\r\f]+", ""))).cast("double"), F.greatest(F.sum("n"), F.lit(1))).alias("chars"),
    )
    flags = flags.join(runs, "script_id", "left").join(said, "script_id").join(weak, "script_id", "left")
    rules = {
        "too_short": F.col("items") < least_items, "long_backchannel": F.col("bc") > longest_backchannel, "long_turn": F.col("turn") > longest, "monologue_run": F.col("run") > most_run,
        "participation": (F.col("share") < least_share) | (F.col("speakers") < 2) | F.col("share").isNull(), "verbatim_repeat": F.col("again"), "stage_direction": F.col("stage"), "role_break": F.col("role"),
        "no_pauses": ~F.col("pauses"), "unsegmented": F.col("unspaced") & (F.col("chars") > 3.5), "weak_interruption": F.col("weak"),
    }
    reasons = F.array_sort(F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in rules.items()])))
    return flags.select("script_id", F.array_join(reasons, ",").alias("reasons")).where("reasons != ''")


def constrained_batches(items: DataFrame, keys: list[str], order: str, size: int, salt: str) -> DataFrame:
    """items with lane and batch: items of one key are in different lanes, and a batch is of one lane, so it never holds two of a key."""
    lane = F.row_number().over(W.partitionBy(*keys).orderBy(order)) - 1
    out = items.withColumn("lane", lane).withColumn("by", hash_order(F.concat_ws("/", *keys, order), salt))
    # Ranks in a lane come from sums over hash ranges, so a lane is not ordered in one task.
    out = out.withColumn("range", F.substring("by", 1, 2))
    held = out.groupBy("lane", "range").count()
    held = held.select("lane", "range", F.coalesce(F.sum("count").over(W.partitionBy("lane").orderBy("range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    rank = F.col("before") + F.row_number().over(W.partitionBy("lane", "range").orderBy("by")) - 1
    return out.join(held, ["lane", "range"]).withColumn("batch", F.floor(rank / size)).drop("range", "before", "by")


def dedupe_prompts(queries: DataFrame, what: list[str], use: str) -> DataFrame:
    """Equal prompts once, with the sorted list of their uses."""
    return queries.groupBy(*what).agg(F.array_sort(F.collect_set(use)).alias("uses"))


def folds(ids: DataFrame, key: str, k: int) -> DataFrame:
    """ids (longs) in folds by turns in the order of id: 0 to k - 1. Numbered in 1024 equal ranges of ids."""
    each = ids.select(key).distinct()
    lo, hi = each.agg(F.min(key), F.max(key)).first()
    cell = F.floor((F.col(key) - (lo or 0)) / max(1, -(-((hi or 0) - (lo or 0) + 1) // 1024)))
    return numbered(each, cell, [key]).select(key, F.pmod(F.col("no"), F.lit(k)).alias("fold"))


def pending(todo: DataFrame, done: DataFrame, key: str, result: str) -> DataFrame:
    """What has no result yet: failed ones are asked again."""
    return todo.join(done.where(F.col(result).isNotNull()), key, "left_anti")


def merge_runs(runs: list[DataFrame], key: str, keep: DataFrame | None = None, split: str | None = None, own: str | None = None, kept: str | None = None) -> DataFrame:
    """Outputs of runs as one; for equal keys the first run's. Where the column `split` is given: of several runs, rows of split `own` go (no threshold
    fits all of them), and rows of split `kept` stay if their key is in keep."""
    every = None
    for n, r in enumerate(runs):
        r = r.withColumn("__run", F.lit(n))
        every = r if every is None else every.unionByName(r, allowMissingColumns=True)
    if split and own and len(runs) > 1:
        every = every.where(~F.col(split).eqNullSafe(F.lit(own)))
    if split and keep is not None:
        listed = keep.select(key).distinct().withColumn("__keep", F.lit(True))
        every = every.join(listed, key, "left").where(~F.col(split).eqNullSafe(F.lit(kept)) | F.col("__keep")).drop("__keep")
    return every.withColumn("__r", F.row_number().over(W.partitionBy(key).orderBy("__run"))).where("__r = 1").drop("__r", "__run")


def validate_predictions(preds: DataFrame, conversations: DataFrame) -> DataFrame:
    """(problem, conv_id): conversations without a record, records without a conversation, doubled records, times outside the conversation."""
    def said(df: DataFrame, name: str) -> DataFrame:
        return df.select(F.lit(name).alias("problem"), "conv_id")
    out = said(conversations.join(preds, "conv_id", "left_anti"), "missing").unionByName(said(preds.join(conversations, "conv_id", "left_anti"), "unknown"))
    out = out.unionByName(said(preds.groupBy("conv_id").count().where("count > 1"), "doubled"))
    bad = preds.join(conversations, "conv_id").where(F.exists("times", lambda t: (t < 0) | (t > F.col("duration"))))
    return out.unionByName(said(bad, "range"))


def accept_conversations(agreement: DataFrame, errors: DataFrame, segments: DataFrame, least_agreement: float = 0.6, most_error: float = 0.35) -> DataFrame:
    """(conv_id, reasons): low_agreement, high_wer, silent_channel; empty for an accepted one. agreement and errors: (conv_id, value)."""
    speakers = segments.groupBy("conv_id").agg(F.count_distinct("speaker").alias("speakers"))
    x = speakers.join(agreement.select("conv_id", F.col("value").alias("agreement")), "conv_id", "left").join(errors.select("conv_id", F.col("value").alias("error")), "conv_id", "left")
    rules = {"high_wer": F.col("error") > most_error, "low_agreement": F.col("agreement") < least_agreement, "silent_channel": F.col("speakers") < 2}
    reasons = F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in rules.items()]))
    return x.select("conv_id", F.array_join(reasons, ",").alias("reasons"))
