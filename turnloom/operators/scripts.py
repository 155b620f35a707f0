"""Checks of written dialogues, and the voices that can speak them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from turnloom.functions.text import norm_text, quote_position, words

# Speakers and kinds of dialogue items.
SPEAKERS = ["A", "B"]
KINDS = ["turn", "backchannel", "interruption"]


def schema_check(items: DataFrame) -> DataFrame:
    """(script_id, pos, id, code): what is wrong with items (script_id, pos, id, speaker, kind, text, host, after, takes_floor).

    Codes: duplicate_id, bad_speaker, bad_kind, empty_text; for all but turns bad_host (the host has to be an earlier turn or floor-taking item of the
    other speaker), after_missing (its words are not in the host), after_range (the place is not between two words of the host) and not_current
    (a floor-taking interruption whose host is not the last floor item). Positions are distinct; nulls are bad values. Of an id's repeats the first hosts.
    """
    script = W.partitionBy("script_id")
    floor = F.expr("coalesce(kind = 'turn' OR (kind = 'interruption' AND takes_floor), false)")
    rows = items.withColumn("floor", floor).withColumns({
        "same": F.count("*").over(W.partitionBy("script_id", "id")),
        "last_floor": F.max(F.when(F.col("floor"), F.col("pos"))).over(script.orderBy("pos").rowsBetween(W.unboundedPreceding, -1)),
    })
    hosts = items.withColumn("floor", floor).groupBy("script_id", F.col("id").alias("host")).agg(F.min_by(F.struct("pos", "speaker", "floor", "text"), "pos").alias("h"))
    rows = rows.join(hosts, ["script_id", "host"], "left").withColumn("spoken", words(norm_text(F.col("h.text"))))
    rows = rows.withColumn("hosted", F.expr("coalesce(h.pos < pos AND h.floor AND h.speaker <> speaker, false)"))
    rows = rows.withColumn("place", quote_position(F.col("spoken"), words(norm_text(F.col("after")))))
    hangs = F.expr("kind <> 'turn'")
    codes = {
        "duplicate_id": F.col("same") > 1,
        "bad_speaker": ~F.col("speaker").isin(SPEAKERS) | F.col("speaker").isNull(),
        "bad_kind": ~F.col("kind").isin(KINDS) | F.col("kind").isNull(),
        "empty_text": F.size(words(F.coalesce("text", F.lit("")))) == 0,
        "bad_host": hangs & ~F.col("hosted"),
        "after_missing": hangs & F.col("hosted") & F.col("place").isNull(),
        "after_range": hangs & F.col("hosted") & (F.col("place") >= F.size("spoken")),
        "not_current": hangs & F.col("hosted") & F.col("floor") & (F.col("h.pos") != F.col("last_floor")),
    }
    found = F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in codes.items()]))
    return rows.select("script_id", "pos", "id", F.explode(found).alias("code"))


def voice_bank(utterances: DataFrame, least_ms: int = 6000, most_ms: int = 10_000, gap_ms: int = 250, per_gender: int = 8) -> DataFrame:
    """(gender, place, speaker, quality, clip_ms, ids): the best speakers of each gender with a clip of their own utterances.

    utterances (speaker, gender, utt_id, ms, quality). Longest first, each that still fits in most_ms joins the clip, gap_ms apart; speakers need least_ms
    of speech and of clip. At most most_ms / (ms + gap_ms) utterances of one length can join, so only so many are gathered: a speaker's list has a
    bounded length, and the result is that of all utterances. Ties by utt_id, then speaker; a speaker's gender is the least one. Nulls in ms are left out.
    """
    known = utterances.where("ms > 0")
    total = known.groupBy("speaker").agg(F.sum("ms").alias("total"), F.avg("quality").alias("quality"), F.min("gender").alias("gender")).where(F.col("total") >= least_ms)
    nth = F.row_number().over(W.partitionBy("speaker", "ms").orderBy("utt_id"))
    fits = known.where(F.col("ms") <= most_ms).withColumn("__nth", nth).where(F.col("__nth") <= F.expr(f"({most_ms} + {gap_ms}) div (ms + {gap_ms})"))
    lists = fits.groupBy("speaker").agg(F.array_sort(F.collect_list(F.struct((-F.col("ms")).cast("long").alias("minus"), "utt_id"))).alias("all"))
    start = F.struct(F.lit(0).cast("long").alias("used"), F.expr("slice(transform(all, x -> x.utt_id), 1, 0)").alias("ids"))
    packed = F.aggregate("all", start, lambda acc, x: F.when(
        acc["used"] - x["minus"] <= most_ms,
        F.struct((acc["used"] - x["minus"] + gap_ms).alias("used"), F.concat(acc["ids"], F.array(x["utt_id"])).alias("ids")),
    ).otherwise(acc))
    clips = total.join(lists.withColumn("p", packed), "speaker").select("speaker", "gender", "quality", (F.col("p.used") - gap_ms).alias("clip_ms"), F.col("p.ids").alias("ids"))
    order = W.partitionBy("gender").orderBy(F.desc_nulls_last("quality"), "speaker")
    return clips.where(F.col("clip_ms") >= least_ms).withColumn("place", F.row_number().over(order)).where(F.col("place") <= per_gender)
