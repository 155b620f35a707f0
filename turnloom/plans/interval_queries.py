"""Queries of the interval operators and of labels, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from turnloom.functions import vocab
from turnloom.operators import intervals as I
from turnloom.plans.fixtures import SEG, segments
from turnloom.plans.registry import register

KEY = ["conv_id", "speaker"]
# Fixed values, as the reference lists them: fine label, canonical label, group, place in the order of priority.
LABELS = """('Floor-taking Competitive Interruption', 'Interruption', 'floor_taking', 1), ('Floor-taking Cooperative Interruption', 'Interruption', 'floor_taking', 2),
('Non-floor Taking Competitive Interruption', 'NonFloorTakingInterruption', 'attempt', 3), ('Non-floor Taking Cooperative Interruption', 'NonFloorTakingInterruption', 'attempt', 4),
('Normal Turn', 'Turn', 'turn', 5), ('Strong Floor Hold', 'Turn', 'turn', 6), ('Bounded Response', 'Turn', 'turn', 7), ('Overlap', 'Turn', 'turn', 8), ('Filler', 'Turn', 'turn', 9),
('Reaction Backchannel', 'Backchannel', 'backchannel', 10), ('Acknowledgement Backchannel', 'Backchannel', 'backchannel', 11), ('Continuer Backchannel', 'Backchannel', 'backchannel', 12),
('Laughter', 'Laughter', 'noncontent', 13), ('Speech, Non-Linguistic', 'NonContent', 'noncontent', 14), ('Non-Speech Noise', 'NonContent', 'noncontent', 15),
('Channel Bleed', 'NonContent', 'noncontent', 16), ('Awkward Silence', 'AwkwardSilence', NULL, 17)"""


def _turns(s, d):
    return segments(s, d).withColumn("canonical", vocab.canonical(F.col("label"))).where("canonical IN ('Turn', 'Interruption')")


register(
    "F01_labels",
    lambda s, d: segments(s, d).select("conv_id", "turn", "k", vocab.canonical(F.col("label")).alias("canonical"), vocab.group(F.col("label_b")).alias("grp"), vocab.fine_index(F.col("label_c")).cast("long").alias("fine"), vocab.act(F.col("label_c")).alias("act"), vocab.group(F.col("label_c")).alias("grp_c")),
    f"""WITH {SEG}, fl(name, canonical_, grp, fine) AS (VALUES {LABELS}, ('Regular Turn', 'Turn', 'turn', 5))
    SELECT conv_id, turn, k, x.canonical_ AS canonical, y.grp, coalesce(z.fine, 0)::BIGINT AS fine, CASE WHEN z.canonical_ IN ('Turn', 'Interruption', 'NonFloorTakingInterruption') THEN 'CLAIM'
      WHEN z.canonical_ = 'Backchannel' THEN 'BACKCHANNEL' WHEN z.canonical_ = 'Laughter' THEN 'LAUGHTER' WHEN z.canonical_ = 'NonContent' THEN 'NONCONTENT' ELSE 'SILENT' END AS act, z.grp AS grp_c
    FROM seg LEFT JOIN fl x ON x.name = label LEFT JOIN fl y ON y.name = label_b LEFT JOIN fl z ON z.name = label_c""",
)
_UNION = """m AS (SELECT *, max(end_ms) OVER (PARTITION BY conv_id, speaker ORDER BY start_ms, end_ms ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM seg),
r AS (SELECT *, sum(CASE WHEN reach IS NULL OR start_ms - reach > {gap} THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id, speaker ORDER BY start_ms, end_ms) AS run FROM m),
un AS (SELECT conv_id, speaker, min(start_ms) AS start_ms, max(end_ms) AS end_ms FROM r GROUP BY conv_id, speaker, run)"""
register("I01_union", lambda s, d: I.union_intervals(segments(s, d), KEY, 500), f"WITH {SEG}, {_UNION.format(gap=500)} SELECT * FROM un")


def _other(s, d):
    return segments(s, d).where("speaker = 2").drop("speaker"), segments(s, d).where("speaker = 1").drop("speaker")


register(
    "I02_intersect",
    lambda s, d: I.intersect_intervals(*_other(s, d), ["conv_id"], 100),
    f"""WITH {SEG} SELECT a.conv_id, greatest(a.start_ms, b.start_ms) AS start_ms, least(a.end_ms, b.end_ms) AS end_ms FROM seg a JOIN seg b ON a.conv_id = b.conv_id
    AND a.speaker = 2 AND b.speaker = 1 AND least(a.end_ms, b.end_ms) - greatest(a.start_ms, b.start_ms) >= 100""",
)
register(
    "I03_overlapping",
    lambda s, d: I.overlapping(*_other(s, d)[::-1], ["conv_id"]).select("conv_id", "turn", "k", F.col("b_turn").alias("other_turn"), F.col("b_k").alias("other_k")),
    f"""WITH {SEG} SELECT a.conv_id, a.turn, a.k, b.turn AS other_turn, b.k AS other_k FROM seg a JOIN seg b ON a.conv_id = b.conv_id AND a.speaker = 2 AND b.speaker = 1
    AND b.start_ms < a.end_ms AND b.end_ms > a.start_ms""",
)
register(
    "I04_ending_near",
    lambda s, d: I.segment_ending_near(segments(s, d).where("speaker = 1").select("conv_id", F.col("start_ms").alias("t_ms")), segments(s, d).where("speaker = 2").select("conv_id", "start_ms", "end_ms", "label"), ["conv_id"], 1000),
    f"""WITH {SEG}, p AS (SELECT conv_id, start_ms AS t_ms FROM seg WHERE speaker = 1),
    b AS (SELECT p.conv_id, t_ms, min(row(abs(end_ms - t_ms), end_ms, label)) AS m FROM p JOIN seg s ON s.conv_id = p.conv_id AND s.speaker = 2 AND abs(end_ms - t_ms) <= 1000 GROUP BY ALL)
    SELECT p.*, m[2] AS near_end_ms, m[3] AS near_label FROM p LEFT JOIN b USING (conv_id, t_ms)""",
)
_ITEMS = "items AS (SELECT conv_id, turn, min(start_ms) AS start_ms, max(end_ms) AS end_ms, arg_min(canonical, k) AS label FROM canon GROUP BY conv_id, turn)"


def _items(s, d):
    seg = segments(s, d).withColumn("canonical", vocab.canonical(F.col("label")))
    return seg.groupBy("conv_id", "turn").agg(F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"), F.min_by("canonical", "k").alias("label"))


register(
    "I05_assign",
    lambda s, d: I.assign_by_max_overlap(segments(s, d).select("conv_id", "start_ms", "end_ms").distinct(), _items(s, d), ["conv_id"]),
    f"""WITH {SEG}, {_ITEMS}, q AS (SELECT DISTINCT conv_id, start_ms, end_ms FROM seg),
    o AS (SELECT q.*, max(row(least(q.end_ms, i.end_ms) - greatest(q.start_ms, i.start_ms), -i.start_ms, i.label)) AS m FROM q JOIN items i ON i.conv_id = q.conv_id AND i.start_ms < q.end_ms AND i.end_ms > q.start_ms GROUP BY ALL),
    n AS (SELECT conv_id, start_ms, end_ms, m, row_number() OVER (PARTITION BY conv_id, m[2] ORDER BY start_ms, end_ms) AS nth FROM o)
    SELECT q.*, coalesce(CASE WHEN m[3] = 'Interruption' AND nth > 1 THEN 'Turn' ELSE m[3] END, 'NonContent') AS assigned FROM q LEFT JOIN n USING (conv_id, start_ms, end_ms)""",
)


def _words(s, d):
    w = segments(s, d).select("conv_id", "start_ms", F.posexplode(F.regexp_extract_all("text", F.lit(r"\S+"), F.lit(0))).alias("j", "word"))
    return w.select("conv_id", (F.col("start_ms") + 300 * F.col("j")).alias("start_ms"), (F.col("start_ms") + 300 * F.col("j") + 300).alias("end_ms"), "word")


register(
    "I06_words",
    lambda s, d: I.words_in_segment(_words(s, d), _items(s, d).select("conv_id", "start_ms", "end_ms"), ["conv_id"]),
    f"""WITH {SEG}, {_ITEMS}, w AS (SELECT conv_id, 2 * start_ms + 600 * (j - 1) + 300 AS m2, ws[j] AS word FROM (SELECT *, unnest(generate_series(1, len(ws))) AS j FROM (SELECT conv_id, start_ms, regexp_extract_all(text, '\\S+') AS ws FROM seg)))
    SELECT i.conv_id, start_ms, end_ms, string_agg(word, ' ' ORDER BY m2, word) AS said FROM items i JOIN w ON w.conv_id = i.conv_id AND m2 >= 2 * start_ms AND m2 < 2 * end_ms GROUP BY ALL""",
)
register(
    "I07_clip",
    lambda s, d: I.clip_to(segments(s, d).select(*KEY, "start_ms", "end_ms", vocab.canonical(F.col("label")).alias("label")), segments(s, d).select(*KEY, F.col("start_ms").alias("start_ms"), (F.col("start_ms") + 700).alias("end_ms")), KEY),
    f"""WITH {SEG}, k0 AS (SELECT conv_id, speaker, start_ms, start_ms + 700 AS end_ms FROM seg),
    m AS (SELECT *, max(end_ms) OVER (PARTITION BY conv_id, speaker ORDER BY start_ms, end_ms ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM k0),
    r AS (SELECT *, sum(CASE WHEN reach IS NULL OR start_ms > reach THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id, speaker ORDER BY start_ms, end_ms) AS run FROM m),
    kp AS (SELECT conv_id, speaker, min(start_ms) AS start_ms, max(end_ms) AS end_ms FROM r GROUP BY conv_id, speaker, run)
    SELECT conv_id, speaker, start_ms, end_ms, canonical AS label FROM canon WHERE canonical <> 'NonContent' UNION ALL
    SELECT c.conv_id, c.speaker, greatest(c.start_ms, k.start_ms), least(c.end_ms, k.end_ms), 'NonContent' FROM canon c JOIN kp k ON c.conv_id = k.conv_id AND c.speaker = k.speaker
    AND canonical = 'NonContent' AND c.start_ms < k.end_ms AND k.start_ms < c.end_ms""",
)
register(
    "I08_turn_runs",
    lambda s, d: I.turn_runs(_turns(s, d)),
    f"""WITH {SEG}, l AS (SELECT *, lag(speaker) OVER (PARTITION BY conv_id ORDER BY start_ms, speaker) AS p FROM canon WHERE canonical IN ('Turn', 'Interruption')),
    r AS (SELECT *, sum(CASE WHEN p <> speaker THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY start_ms, speaker) AS run FROM l)
    SELECT conv_id, speaker, min(start_ms) AS start_ms, max(end_ms) AS end_ms, count(*) AS n FROM r GROUP BY conv_id, speaker, run""",
)
register(
    "I09_offsets",
    lambda s, d: I.floor_transfer_offsets(I.turn_runs(_turns(s, d)).select("conv_id", "speaker", F.col("end_ms").alias("t_ms")), _turns(s, d)),
    f"""WITH {SEG}, l AS (SELECT *, lag(speaker) OVER (PARTITION BY conv_id ORDER BY start_ms, speaker) AS p FROM canon WHERE canonical IN ('Turn', 'Interruption')),
    r AS (SELECT *, sum(CASE WHEN p <> speaker THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY start_ms, speaker) AS run FROM l),
    a AS (SELECT conv_id, speaker, max(end_ms) AS t_ms FROM r GROUP BY conv_id, speaker, run)
    SELECT a.conv_id, a.speaker, t_ms, min(row(abs(start_ms - t_ms), start_ms - t_ms))[2] AS offset_ms FROM a JOIN canon c ON c.conv_id = a.conv_id AND c.speaker = 3 - a.speaker
    AND canonical IN ('Turn', 'Interruption') AND start_ms > t_ms - 3000 GROUP BY ALL""",
)
register(
    "I11_rule_labels",
    lambda s, d: I.rule_labels(segments(s, d)),
    f"""WITH {SEG}, n AS (SELECT conv_id, speaker, start_ms, end_ms, lead(start_ms) OVER (PARTITION BY conv_id, speaker ORDER BY start_ms, end_ms) - end_ms < 500 AS on_ FROM seg)
    SELECT conv_id, speaker, start_ms, end_ms, CASE WHEN end_ms - start_ms < 1000 AND NOT coalesce(on_, false)
      AND EXISTS (SELECT 1 FROM seg o WHERE o.conv_id = n.conv_id AND o.speaker = 3 - n.speaker AND o.start_ms < n.start_ms AND o.end_ms >= n.start_ms - 1000)
      AND EXISTS (SELECT 1 FROM seg o WHERE o.conv_id = n.conv_id AND o.speaker = 3 - n.speaker AND o.end_ms > n.end_ms AND o.start_ms <= n.end_ms + 1000)
    THEN 'Backchannel' ELSE 'Turn' END AS rule_label FROM n""",
)


# Pieces as words: some are marks, every fourth is unaligned, some run into what follows, and in some conversations nothing is spoken.
_WORD = "CASE WHEN conv_id % 17 = 3 OR (turn * 3 + k) % 7 = 2 THEN '--' ELSE text END"
_HOLE, _LATE = "(conv_id + turn * 3 + k) % 4 IN (0, 1)", "CASE WHEN (conv_id + k) % 5 = 2 THEN 4000 ELSE 0 END"


def _holes(s, d):
    return segments(s, d).selectExpr(
        "conv_id", "turn * 1000 + k AS nth_word", f"{_WORD} AS word", "max(end_ms) OVER (PARTITION BY conv_id) + 100 AS duration_ms",
        f"IF({_HOLE}, NULL, start_ms) AS start_ms", f"IF({_HOLE}, NULL, end_ms + {_LATE}) AS end_ms",
    )


register(
    "I13_fill_times",
    lambda s, d: I.fill_missing_times(_holes(s, d), "conv_id", "nth_word", "word", "duration_ms"),
    rf"""WITH {SEG}, h AS (SELECT conv_id, turn * 1000 + k AS nth_word, {_WORD} AS word, max(end_ms) OVER (PARTITION BY conv_id) + 100 AS duration_ms,
      CASE WHEN NOT ({_HOLE}) THEN start_ms END AS a, CASE WHEN NOT ({_HOLE}) THEN end_ms + {_LATE} END AS b FROM seg),
    v AS (SELECT *, regexp_matches(word, '[\p{{L}}\p{{N}}]') AS spoken FROM h),
    -- Words alone: in order, with the aligned ones before and after each.
    x AS (SELECT *, row_number() OVER o AS p, max(CASE WHEN a IS NOT NULL THEN nth_word END) OVER (o ROWS UNBOUNDED PRECEDING) AS l,
      min(CASE WHEN a IS NOT NULL THEN nth_word END) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS r FROM v WHERE spoken WINDOW o AS (PARTITION BY conv_id ORDER BY nth_word)),
    y AS (SELECT x.*, row_number() OVER (PARTITION BY x.conv_id, x.l, x.r ORDER BY x.nth_word) - 1 AS k, count(*) OVER (PARTITION BY x.conv_id, x.l, x.r) AS n, f.a AS la, f.b AS lb, g.a AS ra, g.b AS rb
      FROM x LEFT JOIN v f ON f.conv_id = x.conv_id AND f.nth_word = x.l LEFT JOIN v g ON g.conv_id = x.conv_id AND g.nth_word = x.r),
    z AS (SELECT *, coalesce(ra, duration_ms) - coalesce(lb, 0) < 50 * n AS tight FROM y),
    f AS (SELECT conv_id, nth_word, CASE WHEN tight THEN coalesce(la, 0) ELSE coalesce(lb, 0) END AS lo, CASE WHEN tight THEN coalesce(rb, duration_ms) ELSE coalesce(ra, duration_ms) END AS hi, k, n, a, b FROM z),
    t AS (SELECT conv_id, nth_word, CASE WHEN a IS NULL THEN floor(lo + (hi - lo) * k / n::DOUBLE) ELSE a END::BIGINT AS s, CASE WHEN a IS NULL THEN floor(lo + (hi - lo) * (k + 1) / n::DOUBLE) ELSE b END::BIGINT AS e FROM f),
    u AS (SELECT v.*, t.s, t.e, last_value(t.e IGNORE NULLS) OVER (PARTITION BY v.conv_id ORDER BY v.nth_word) AS before, first_value(t.s IGNORE NULLS) OVER (PARTITION BY v.conv_id ORDER BY v.nth_word ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS first_,
      row_number() OVER (PARTITION BY v.conv_id ORDER BY v.nth_word) - 1 AS i, count(*) OVER (PARTITION BY v.conv_id) AS many FROM v LEFT JOIN t USING (conv_id, nth_word))
    SELECT conv_id, nth_word, word, duration_ms, CASE WHEN first_ IS NULL THEN floor(duration_ms * i / many::DOUBLE) ELSE coalesce(s, before, first_) END::BIGINT AS start_ms,
      CASE WHEN first_ IS NULL THEN floor(duration_ms * (i + 1) / many::DOUBLE) ELSE coalesce(e, before, first_) END::BIGINT AS end_ms FROM u""",
)
register(
    "I14_top_speakers",
    lambda s, d: I.top_speakers(segments(s, d).withColumn("who", F.expr("concat(speaker, '-', turn % 3)")), "conv_id", "who", F.expr("end_ms - start_ms"), 0.4),
    f"""WITH {SEG}, h AS (SELECT conv_id, speaker || '-' || turn % 3 AS who, sum(end_ms - start_ms)::BIGINT AS ms FROM seg GROUP BY ALL),
    r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY ms DESC, who) AS rank, sum(ms) OVER (PARTITION BY conv_id) AS all_ FROM h),
    t AS (SELECT *, sum(CASE WHEN rank <= 2 THEN ms END) OVER (PARTITION BY conv_id) AS two FROM r)
    SELECT conv_id, who, ms, rank, ms / all_::DOUBLE AS share FROM t WHERE rank <= 2 AND all_ - two <= 0.4::DOUBLE * all_""",
)
