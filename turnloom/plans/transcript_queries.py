"""Queries of causal transcripts and of the external judge, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnloom.operators import corpus as K
from turnloom.operators import judge as J
from turnloom.operators import transcripts as T
from turnloom.plans.fixtures import SEG, segments
from turnloom.plans.registry import register
from turnloom.sources.settle import settle


def _points(s, d) -> DataFrame:
    """In the middle of each segment and at its end; every third leaves the segment out."""
    seg = segments(s, d)
    times = F.explode(F.array(F.expr("(start_ms + end_ms) DIV 2"), F.col("end_ms"))).alias("t_ms")
    return seg.select("conv_id", "speaker", times, F.when(F.expr("k % 3 = 0"), F.col("start_ms")).alias("own_start_ms")).distinct()


_P = """po AS (SELECT DISTINCT conv_id, speaker, unnest([(start_ms + end_ms) // 2, end_ms]) AS t_ms, CASE WHEN k % 3 = 0 THEN start_ms END AS own_start_ms FROM seg)"""
# Words known of each segment at each point.
_KNOWN = r"""sw AS MATERIALIZED (SELECT conv_id, speaker, start_ms, end_ms, regexp_extract_all(text, '{token}') AS words, len(regexp_extract_all(text, '{token}')) AS n FROM seg),
kn AS (SELECT p.conv_id, p.speaker, p.t_ms, {own} s.start_ms, s.end_ms, words, CASE WHEN s.speaker = p.speaker THEN 'A' ELSE 'B' END AS who,
  CASE WHEN t_ms >= end_ms + 300 THEN n WHEN t_ms < s.start_ms + 300 THEN 0 ELSE least(n, n * (t_ms - s.start_ms - 300) // greatest(end_ms - s.start_ms, 1)) END AS k
  FROM po p JOIN sw s ON s.conv_id = p.conv_id {where})"""
register(
    "J03_lines",
    lambda s, d: T.shown_lines(segments(s, d), _points(s, d)),
    f"""WITH {SEG}, {_P}, {_KNOWN.format(token=chr(92) + "S+", own="own_start_ms,", where="AND NOT (s.speaker = p.speaker AND s.start_ms IS NOT DISTINCT FROM own_start_ms)")},
    li AS (SELECT *, array_to_string(words[:k], ' ') || CASE WHEN t_ms >= end_ms + 300 THEN '' ELSE ' ...' END AS text FROM kn WHERE k > 0),
    nm AS (SELECT *, row_number() OVER (PARTITION BY conv_id, speaker, t_ms, own_start_ms ORDER BY start_ms DESC, who DESC, text DESC) AS nth FROM li),
    ct AS (SELECT conv_id, speaker, t_ms, own_start_ms, string_agg(who || ': ' || text, chr(10) ORDER BY nth DESC) AS context FROM nm WHERE nth <= 10 GROUP BY ALL)
    SELECT p.*, coalesce(context, '') AS context FROM po p LEFT JOIN ct c ON c.conv_id = p.conv_id AND c.speaker = p.speaker AND c.t_ms = p.t_ms AND c.own_start_ms IS NOT DISTINCT FROM p.own_start_ms""",
)
_RUNS = """nu AS (SELECT *, CASE WHEN lag(who) OVER (PARTITION BY conv_id, speaker, t_ms ORDER BY start_ms, seg_speaker, end_ms) = who THEN 0 ELSE 1 END AS new_ FROM it),
ru AS (SELECT *, sum(new_) OVER (PARTITION BY conv_id, speaker, t_ms ORDER BY start_ms, seg_speaker, end_ms) AS run FROM nu),
rt AS (SELECT conv_id, speaker, t_ms, run, who, string_agg(text, ' ' ORDER BY start_ms, seg_speaker, end_ms) AS text FROM ru GROUP BY ALL),
rn AS (SELECT *, row_number() OVER (PARTITION BY conv_id, speaker, t_ms ORDER BY run DESC) AS nth FROM rt)"""
register(
    "J03_runs",
    lambda s, d: T.shown_runs(segments(s, d), _points(s, d).select("conv_id", "speaker", "t_ms")),
    f"""WITH {SEG}, {_P.replace(", CASE WHEN k % 3 = 0 THEN start_ms END AS own_start_ms", "")}, {_KNOWN.format(token=T.TOKEN, own="s.speaker AS seg_speaker,", where="")},
    it AS (SELECT *, array_to_string(words[:k], ' ') AS text FROM kn WHERE k > 0), {_RUNS},
    ct AS (SELECT conv_id, speaker, t_ms, string_agg(who || ': ' || text, chr(10) ORDER BY nth DESC) AS context FROM rn WHERE nth <= 12 GROUP BY ALL)
    SELECT conv_id, speaker, t_ms, coalesce(context, '(nothing yet)') AS context FROM po LEFT JOIN ct USING (conv_id, speaker, t_ms)""",
)
register(
    "J03_messages",
    lambda s, d: T.shown_messages(segments(s, d), segments(s, d).select("conv_id", "speaker", F.col("end_ms").alias("t_ms"))).select("conv_id", "speaker", "t_ms", T.message_texts(F.col("messages")).alias("context")),
    f"""WITH {SEG}, po AS (SELECT DISTINCT conv_id, speaker, end_ms AS t_ms FROM seg),
    sw AS MATERIALIZED (SELECT conv_id, speaker, start_ms, end_ms, regexp_extract_all(text, '\\S+') AS words FROM seg),
    it AS (SELECT p.conv_id, p.speaker, p.t_ms, s.speaker AS seg_speaker, s.start_ms, s.end_ms, CASE WHEN s.speaker = p.speaker THEN 'user' ELSE 'assistant' END AS who, array_to_string(words, ' ') AS text
      FROM po p JOIN sw s ON s.conv_id = p.conv_id AND s.end_ms <= t_ms AND len(words) >= CASE WHEN s.speaker = p.speaker THEN 1 ELSE 3 END), {_RUNS},
    ct AS (SELECT conv_id, speaker, t_ms, string_agg(who || ': ' || text, chr(10) ORDER BY nth DESC) AS context FROM rn WHERE nth <= 6 GROUP BY ALL)
    SELECT conv_id, speaker, t_ms, coalesce(context, '') AS context FROM po LEFT JOIN ct USING (conv_id, speaker, t_ms)""",
)


def _length(rows: list[dict]) -> list[int]:
    """A stand-in for a judge: no model is shipped."""
    return [len(r["text"].split()) % 11 for r in rows]


def _at_first(rows: list[dict]) -> list[int]:
    if rows[0]["batch"] % 2 == 0:
        raise TimeoutError("no answer")
    return _length(rows)


def judge_runs(s, d) -> DataFrame:
    """Two runs of a judge over pieces in batches that hold no two of a turn: the first fails for half of the batches, the second asks these again."""
    items = segments(s, d).select("conv_id", "turn", "k", F.concat_ws("/", "conv_id", "turn", "k").alias("id"), "text")
    items = settle(K.constrained_batches(items, ["conv_id", "turn"], "k", 8, "judge"), "judge-items")
    first = settle(J.judged(items, "id", ["lane", "batch"], _at_first, "int"), "judge-first")
    again = J.judged(items, "id", ["lane", "batch"], _length, "int", first)
    asked_twice = again.select("id", F.lit(True).alias("again"))
    return J.resumed(first, settle(again, "judge-again"), "id").join(asked_twice, "id", "left").select("id", "result", "error", F.coalesce("again", F.lit(False)).alias("again"))


register(
    "J06_judge",
    lambda s, d: judge_runs(s, d).select("id", "result", "error"),
    f"WITH {SEG} SELECT conv_id || '/' || turn || '/' || k AS id, (n % 11)::INT AS result, NULL::VARCHAR AS error FROM seg",
)
