"""What of a conversation's words can be known at a time: texts shown as lines, runs and messages. Times are milliseconds.

The words of a segment are revealed evenly over it and known lag_ms later. A conversation's segments and the times asked for meet in one row, as both are
bounded by its length; nothing after a time takes part in what is shown for it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A word, or a tag in brackets that stays whole.
TOKEN = r"\[[^\]]*\]|\S+"


def _asked(segments: DataFrame, points: DataFrame, token: str, shown: str, more: tuple[str, ...] = ()) -> DataFrame:
    """points (conv_id, speaker, t_ms, more…) with `shown`: an expression over segs, the conversation's segments in order, and p, the point."""
    words = F.regexp_extract_all("text", F.lit(token), F.lit(0))
    segs = segments.where("text IS NOT NULL").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("start_ms", "speaker", "end_ms", words.alias("words")))).alias("segs"))
    names = ["speaker", "t_ms", *more]
    asked = points.groupBy("conv_id").agg(F.collect_set(F.struct(*names)).alias("asked"))
    none = "CAST(array() AS array<struct<start_ms:bigint,speaker:int,end_ms:bigint,words:array<string>>>)"
    both = asked.join(segs, "conv_id", "left").withColumn("segs", F.coalesce("segs", F.expr(none)))
    told = F.expr(f"transform(asked, p -> named_struct({', '.join(f"'{c}', p.{c}" for c in names)}, 'shown', {shown}))")
    return both.select("conv_id", F.explode(told).alias("x")).select("conv_id", *[f"x.{c}" for c in (*names, "shown")])


def _visible(lag_ms: int) -> str:
    """How many words of segment s are known at p.t_ms."""
    n = "size(s.words)"
    return f"""CASE WHEN p.t_ms < s.start_ms + {lag_ms} THEN 0 WHEN p.t_ms >= s.end_ms + {lag_ms} THEN {n}
        ELSE CAST(least({n}, {n} * (p.t_ms - s.start_ms - {lag_ms}) DIV greatest(s.end_ms - s.start_ms, 1)) AS INT) END"""


def _last(array: str, n: int) -> str:
    return f"slice({array}, greatest(size({array}) - {n - 1}, 1), {n})"


def shown_lines(segments: DataFrame, points: DataFrame, lag_ms: int = 300, n: int = 10) -> DataFrame:
    """points (conv_id, speaker, t_ms, own_start_ms) with context: the last n segments of which a word is known, by start, one to a line: `A: ` for the point's
    speaker, `B: ` for the other, and ` ...` behind those of which there is more to come. own_start_ms: the start of an own segment to leave out, or null.
    An empty text if there are none."""
    line = f"""transform(filter(transform(segs, s -> named_struct('s', s, 'k', {_visible(lag_ms)})),
        x -> x.k > 0 AND NOT (x.s.speaker = p.speaker AND x.s.start_ms <=> p.own_start_ms)),
        x -> named_struct('at', x.s.start_ms, 'who', IF(x.s.speaker = p.speaker, 'A', 'B'),
            'text', concat(array_join(slice(x.s.words, 1, x.k), ' '), IF(p.t_ms >= x.s.end_ms + {lag_ms}, '', ' ...'))))"""
    joined = f"array_join(transform(transform(array(array_sort({line})), all -> {_last('all', n)})[0], l -> concat(l.who, ': ', l.text)), '\n')"
    return _asked(segments, points, r"\S+", joined, ("own_start_ms",)).withColumnRenamed("shown", "context")


def _runs(items: str, n: int) -> str:
    """The last n runs of one speaker in an array of (who, words), merged."""
    merged = f"""aggregate({items}, CAST(array() AS array<struct<who:string,words:array<string>>>), (acc, x) ->
        IF(size(acc) > 0 AND try_element_at(acc, -1).who = x.who,
           concat(slice(acc, 1, size(acc) - 1), array(named_struct('who', x.who, 'words', concat(try_element_at(acc, -1).words, x.words)))),
           concat(acc, array(x))))"""
    return f"transform(array({merged}), all -> {_last('all', n)})[0]"


def shown_runs(segments: DataFrame, points: DataFrame, lag_ms: int = 300, n: int = 12) -> DataFrame:
    """points (conv_id, speaker, t_ms) with context: the last n runs of one speaker, of what is known of each utterance, in the order of utterances' starts, as
    lines `A: ` (the point's speaker) and `B: `. `(nothing yet)` if there are none."""
    items = f"""transform(filter(transform(segs, s -> named_struct('s', s, 'k', {_visible(lag_ms)})), x -> x.k > 0),
        x -> named_struct('who', IF(x.s.speaker = p.speaker, 'A', 'B'), 'words', slice(x.s.words, 1, x.k)))"""
    joined = f"array_join(transform({_runs(items, n)}, r -> concat(r.who, ': ', array_join(r.words, ' '))), '\n')"
    out = _asked(segments, points, TOKEN, joined)
    return out.withColumn("context", F.when(F.col("shown") == "", "(nothing yet)").otherwise(F.col("shown"))).drop("shown")


def shown_messages(segments: DataFrame, points: DataFrame, least: int = 3, n: int = 6) -> DataFrame:
    """points (conv_id, speaker, t_ms) with messages: the last n of array<struct<who,words>>: own segments (user) and the other's of at least `least` words
    (assistant) that have ended by t, in the order of their starts, neighbours of one role merged."""
    items = f"""transform(filter(segs, s -> s.end_ms <= p.t_ms AND size(s.words) >= IF(s.speaker = p.speaker, 1, {least})),
        s -> named_struct('who', IF(s.speaker = p.speaker, 'user', 'assistant'), 'words', s.words))"""
    return _asked(segments, points, r"\S+", _runs(items, n)).withColumnRenamed("shown", "messages")


def message_texts(messages: Column) -> Column:
    """array<struct<who,words>> as one text, `role: words` to a line."""
    return F.array_join(F.transform(messages, lambda m: F.concat(m["who"], F.lit(": "), F.array_join(m["words"], " "))), "\n")
