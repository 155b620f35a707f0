"""Queries of the further forms of operators: several annotators, pads, masks, weights, exact intervals and slots, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from turnloom.functions import text as T
from turnloom.functions import vocab
from turnloom.operators import anatomy as A
from turnloom.operators import commit as C
from turnloom.operators import corpus as K
from turnloom.operators import frames as R
from turnloom.operators import intervals as I
from turnloom.operators import windows as V
from turnloom.plans.corpus_queries import _SPLIT, split
from turnloom.plans.fixtures import SEG, frames, segments, table
from turnloom.plans.frame_queries import _ACT, _GRID, _HARD, CH, FR, active, hard
from turnloom.plans.interval_queries import _UNION, _turns
from turnloom.plans.registry import register

# Labels that do not say that the channel's speaker is talking.
NO_ACTIVITY = ("Awkward Silence", "Non-Speech Noise", "Channel Bleed")


def annotated(s, d) -> DataFrame:
    """Segments by three annotators: a and b leave some out, b and c end later than a."""
    marks = F.array(
        F.struct(F.lit("a").alias("annotator"), F.col("end_ms").alias("to_ms"), F.col("label").alias("said"), F.expr("(conv_id + turn + k) % 7 <> 0").alias("given")),
        F.struct(F.lit("b").alias("annotator"), (F.col("end_ms") + 100).alias("to_ms"), F.col("label_b").alias("said"), F.expr("(conv_id + turn + k) % 5 <> 0").alias("given")),
        F.struct(F.lit("c").alias("annotator"), (F.col("end_ms") + 200).alias("to_ms"), F.col("label_c").alias("said"), F.lit(True).alias("given")),
    )
    each = segments(s, d).select("conv_id", "speaker", "start_ms", F.explode(marks).alias("m")).where("m.given")
    return each.select("conv_id", "speaker", "start_ms", F.col("m.annotator").alias("annotator"), F.col("m.to_ms").alias("end_ms"), F.col("m.said").alias("label"))


ANNOTATED = """an AS (
  SELECT conv_id, speaker, 'a' AS annotator, start_ms, end_ms, label FROM seg WHERE (conv_id + turn + k) % 7 <> 0 UNION ALL
  SELECT conv_id, speaker, 'b', start_ms, end_ms + 100, label_b FROM seg WHERE (conv_id + turn + k) % 5 <> 0 UNION ALL
  SELECT conv_id, speaker, 'c', start_ms, end_ms + 200, label_c FROM seg)"""

# No SQL: DuckDB has the canonical composed form only.
register("F02_nfkc", lambda s, d: table(s, d, "documents").select("doc_id", T.norm_text(F.col("text"), fold=True).alias("norm")))
register(
    "I04_annotators",
    lambda s, d: I.segment_ending_near_any(
        segments(s, d).where("speaker = 1").select("conv_id", F.col("start_ms").alias("t_ms")), annotated(s, d).where("speaker = 2").drop("speaker"), ["conv_id"], 500
    ),
    f"""WITH {SEG}, {ANNOTATED}, p AS (SELECT conv_id, start_ms AS t_ms FROM seg WHERE speaker = 1),
    b AS (SELECT p.conv_id, t_ms, min(row(annotator, abs(end_ms - t_ms), end_ms, label)) AS m
          FROM (SELECT DISTINCT * FROM p) p JOIN an ON an.conv_id = p.conv_id AND speaker = 2 AND abs(end_ms - t_ms) <= 500 GROUP BY ALL)
    SELECT p.*, m[1] AS annotator, m[3] AS near_end_ms, m[4] AS near_label FROM p LEFT JOIN b USING (conv_id, t_ms)""",
)
register(
    "I09_summary",
    lambda s, d: I.offset_summary(I.floor_transfer_offsets(I.turn_runs(_turns(s, d)).select("conv_id", "speaker", F.col("end_ms").alias("t_ms")), _turns(s, d))),
    f"""WITH {SEG}, l AS (SELECT *, lag(speaker) OVER (PARTITION BY conv_id ORDER BY start_ms, speaker) AS p FROM canon WHERE canonical IN ('Turn', 'Interruption')),
    r AS (SELECT *, sum(CASE WHEN p <> speaker THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY start_ms, speaker) AS run FROM l),
    a AS (SELECT DISTINCT conv_id, speaker, t_ms FROM (SELECT conv_id, speaker, max(end_ms) AS t_ms FROM r GROUP BY conv_id, speaker, run)),
    o AS (SELECT a.conv_id, a.speaker, t_ms, min(row(abs(start_ms - t_ms), start_ms - t_ms))[2] AS off FROM a
          JOIN canon c ON c.conv_id = a.conv_id AND c.speaker = 3 - a.speaker AND canonical IN ('Turn', 'Interruption') AND start_ms > t_ms - 3000 GROUP BY ALL)
    SELECT count(*) AS n, quantile_cont(off::DOUBLE, 0.5) AS median_ms, avg((off < 0)::INT) AS overlap_share FROM o""",
)
_OUT = ", ".join(f"'{x}'" for x in NO_ACTIVITY)
_WIDE = f"""gn AS (SELECT conv_id, speaker, unnest(generate_series(0, l)) AS i FROM (SELECT conv_id, max((end_ms + 79) // 80 - 1) AS l FROM an GROUP BY conv_id), (VALUES (1), (2)) v(speaker)),
wd AS (SELECT DISTINCT conv_id, speaker, unnest(generate_series(greatest(start_ms - 300, 0) // 80, (end_ms + 379) // 80 - 1)) AS i FROM an WHERE label NOT IN ({_OUT})),
nr AS (SELECT DISTINCT conv_id, speaker, unnest(generate_series(start_ms // 80, (end_ms + 79) // 80 - 1)) AS i FROM an WHERE label NOT IN ({_OUT}))"""
register(
    "R01_annotators",
    lambda s, d: R.rasterize(annotated(s, d), 80, 300, NO_ACTIVITY),
    f"WITH {SEG}, {ANNOTATED}, {_WIDE} SELECT gn.*, (wd.i IS NOT NULL)::INT AS active FROM gn LEFT JOIN wd USING (conv_id, speaker, i)",
)
register(
    "R05_floor_act",
    lambda s, d: R.floor_act_weights(
        active(s, d), segments(s, d).where("label_c = 'Overlap'"), segments(s, d).where("label <> label_b"),
        segments(s, d).where(vocab.canonical(F.col("label")) == "NonFloorTakingInterruption"), 80,
    ),
    f"""WITH {SEG}, {_ACT}, x AS (SELECT *, unnest(generate_series(start_ms // 80 - 1, end_ms // 80)) AS i FROM canon), y AS (SELECT * FROM x WHERE (i + 1) * 80 >= start_ms AND (i + 1) * 80 < end_ms),
    f AS (SELECT DISTINCT conv_id, i FROM y WHERE label_c = 'Overlap'), g AS (SELECT DISTINCT conv_id, speaker, i FROM y WHERE label <> label_b AND canonical <> 'NonFloorTakingInterruption')
    SELECT act.*, CASE WHEN f.i IS NULL THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS floor_w, CASE WHEN g.i IS NULL THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS act_w
    FROM act LEFT JOIN f ON f.conv_id = act.conv_id AND f.i = act.i LEFT JOIN g ON g.conv_id = act.conv_id AND g.speaker = act.speaker AND g.i = act.i""",
)
_AHEAD = ", ".join(f"lead(floor, {h}) OVER w AS floor_{h}, coalesce(lead(weight, {h}) OVER w, 0) AS weight_{h}" for h in (5, 10, 20))
register(
    "R06_weighted",
    lambda s, d: R.floor_projection(hard(s, d).withColumn("weight", F.when(F.col("floor") == "CONTESTED", 0.5).otherwise(1.0)), [5, 10, 20], "weight"),
    f"""WITH {SEG}, {_HARD}, q AS (SELECT *, CASE WHEN floor = 'CONTESTED' THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END AS weight FROM hard)
    SELECT conv_id, i, floor, {_AHEAD} FROM q WINDOW w AS (PARTITION BY conv_id ORDER BY i)""",
)
register(
    "R07_exact",
    lambda s, d: R.vap_code_exact(segments(s, d).select("conv_id", F.col("end_ms").alias("t_ms")), segments(s, d), [200, 400, 600, 800]),
    f"""WITH {SEG}, {_UNION.format(gap=0)}, t AS (SELECT DISTINCT conv_id, end_ms AS t_ms FROM seg), b(k, lo, hi) AS (VALUES (0, 0, 200), (1, 200, 600), (2, 600, 1200), (3, 1200, 2000)),
    s AS (SELECT t.conv_id, t_ms, speaker, k, hi - lo AS n, sum(greatest(0, least(end_ms, t_ms + hi) - greatest(start_ms, t_ms + lo))) AS o FROM t JOIN un USING (conv_id), b GROUP BY ALL)
    SELECT conv_id, t_ms, sum(CASE WHEN 2 * o >= n THEN 1 << (4 * (speaker - 1) + k) ELSE 0 END)::INT AS code FROM s GROUP BY ALL""",
)
_BINS = [(1, 4), (5, 8), (9, 16), (17, 32)]
_OWN = ", ".join(
    f"coalesce(avg(active) OVER ({CH} ROWS BETWEEN {a} FOLLOWING AND {b} FOLLOWING), 0) AS own_{k}, count(*) OVER ({CH} ROWS BETWEEN {a} FOLLOWING AND {b} FOLLOWING) = {b - a + 1} AS mask_{k}"
    for k, (a, b) in enumerate(_BINS)
)
register(
    "R08_targets",
    lambda s, d: R.vap_targets(active(s, d), [4, 4, 8, 16]),
    f"""WITH {SEG}, {_ACT}, o AS (SELECT *, {_OWN} FROM act)
    SELECT a.conv_id, a.speaker, a.i, {', '.join(f'a.own_{k}, b.own_{k} AS other_{k}, a.mask_{k}' for k in range(4))} FROM o a JOIN o b ON a.conv_id = b.conv_id AND a.speaker = 3 - b.speaker AND a.i = b.i""",
)
_SLOTS = """fa AS (SELECT conv_id, speaker, min(CASE WHEN active = 1 THEN i END) AS f FROM act GROUP BY ALL),
sl AS (SELECT conv_id, speaker, row_number() OVER (PARTITION BY conv_id ORDER BY f NULLS LAST, speaker) - 1 AS slot FROM fa)"""
register(
    "R10_acts",
    lambda s, d: R.to_slots(active(s, d), R.arrival_slots(active(s, d))),
    f"WITH {SEG}, {_ACT}, {_SLOTS} SELECT conv_id, i, active, slot FROM act JOIN sl USING (conv_id, speaker)",
)
register(
    "R10_floor",
    lambda s, d: R.floor_to_slots(hard(s, d), R.arrival_slots(active(s, d))),
    f"""WITH {SEG}, {_HARD}, {_ACT}, {_SLOTS} SELECT hard.conv_id, i, CASE floor WHEN 'HELD_0' THEN 'HELD_' || a.slot WHEN 'HELD_1' THEN 'HELD_' || b.slot ELSE floor END AS floor
    FROM hard JOIN sl a ON a.conv_id = hard.conv_id AND a.speaker = 1 JOIN sl b ON b.conv_id = hard.conv_id AND b.speaker = 2""",
)


def _lengths(s, d):
    return active(s, d).where("speaker = 1").groupBy("conv_id").agg(F.count("*").alias("n"))


_LEN = f"{_ACT}, ln AS (SELECT conv_id, count(*) AS n FROM act WHERE speaker = 1 GROUP BY conv_id)"
register(
    "R14_repeated",
    lambda s, d: R.crop_starts(_lengths(s, d), 120, 30, 40, F.col("conv_id") % 3),
    f"""WITH {SEG}, {_LEN}, c AS (SELECT conv_id, unnest(generate_series(30, n - 121, 40)) AS start FROM ln WHERE n > 150)
    SELECT conv_id, start FROM c, (VALUES (1), (2)) v(r) WHERE r <= conv_id % 3""",
)
register(
    "R14_chunks",
    lambda s, d: R.chunk_plan(_lengths(s, d), 250, 60),
    f"WITH {SEG}, {_LEN}, c AS (SELECT *, unnest(generate_series(0, n - 1, 250)) AS start FROM ln) SELECT conv_id, greatest(start - 60, 0) AS from_i, start, least(start + 250, n) AS to_i FROM c",
)
register(
    "W08_raw",
    lambda s, d: V.block_reduce(frames(s, d), "eot", 5, "raw"),
    f"WITH {SEG}, {FR}, c AS (SELECT *, count(*) OVER (PARTITION BY conv_id, speaker, i // 5) AS n FROM fr) SELECT conv_id, speaker, i, eot FROM c WHERE n = 5",
)
register(
    "W10_active",
    lambda s, d: V.enrollment_vector(table(s, d, "embeddings"), ["label"], "vec_id", "embedding", 20, F.element_at("embedding", 1) > 0),
    """WITH r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS r FROM embeddings WHERE embedding[1] > 0),
    e AS (SELECT label, embedding, unnest(generate_series(1, len(embedding))) AS k FROM r WHERE r <= 20), m AS (SELECT label, k, avg(embedding[k]::DOUBLE) AS mean FROM e GROUP BY ALL),
    z AS (SELECT label, unnest(generate_series(1, max(len(embedding)))) AS k FROM embeddings GROUP BY label)
    SELECT label, (k - 1)::INT AS pos, coalesce(mean, 0) AS mean FROM z LEFT JOIN m USING (label, k)""",
)


def _drafts(s, d):
    seen = F.sum("n").over(W.partitionBy("conv_id", "turn").orderBy("k"))
    score = F.expr("CASE WHEN (conv_id + turn * 3 + k) % 13 <> 0 THEN (conv_id * 31 + turn * 7 + k * 5) % 11 END")
    return segments(s, d).select("conv_id", "turn", F.col("end_ms").alias("t_ms"), score.alias("score"), seen.alias("seen"))


register(
    "W12_sufficient",
    lambda s, d: V.sufficient_from(_drafts(s, d), ["conv_id", "turn"], "t_ms", "score", 4, "seen"),
    f"""WITH {SEG}, c AS (SELECT conv_id, turn, end_ms AS t_ms, CASE WHEN (conv_id + turn * 3 + k) % 13 <> 0 THEN (conv_id * 31 + turn * 7 + k * 5) % 11 END AS score,
           sum(n) OVER (PARTITION BY conv_id, turn ORDER BY k) AS seen, row_number() OVER (PARTITION BY conv_id, turn ORDER BY k DESC) AS back FROM seg),
    g AS (SELECT conv_id, turn, count(*) AS n, max(t_ms) AS e, max(seen) AS all_, coalesce(min(back) FILTER (back > 1 AND (score IS NULL OR score < 4)), count(*) + 1) AS bad FROM c GROUP BY ALL)
    SELECT g.conv_id, g.turn, t_ms AS stable, e - t_ms AS lead, seen::DOUBLE / all_ AS share FROM g JOIN c ON c.conv_id = g.conv_id AND c.turn = g.turn AND back = bad - 1 WHERE n >= 2""",
)
register(
    "M02_undecided",
    lambda s, d: A.undecided(
        segments(s, d).select("conv_id", "turn", "k", F.explode(F.array("label", "label_b", "label_c")).alias("label")), ["conv_id", "turn", "k"]
    ),
    f"""WITH {SEG} SELECT conv_id, turn, k, array_to_string(list_sort([label, label_b, label_c]), ',') AS labels FROM seg
    WHERE label <> label_b AND label <> label_c AND label_b <> label_c""",
)
register(
    "M17_padded",
    lambda s, d: A.padded_false_event_rate(C.rising_edges(frames(s, d), F.col("int"), F.lit(0.45)), annotated(s, d), 80, 300, NO_ACTIVITY),
    f"""WITH {SEG}, {FR}, {ANNOTATED}, {_WIDE}, f AS (SELECT conv_id, speaker, i FROM (SELECT *, coalesce(lag(int) OVER ({CH}), 0) AS b FROM fr) WHERE int > 0.45 AND NOT b > 0.45),
    q AS (SELECT nr.conv_id, 3 - nr.speaker AS speaker, nr.i FROM nr JOIN gn USING (conv_id, speaker, i) LEFT JOIN wd ON wd.conv_id = nr.conv_id AND wd.speaker = 3 - nr.speaker AND wd.i = nr.i WHERE wd.i IS NULL)
    SELECT q.speaker, count(f.i) AS fires, count(*) * 80 / 60000.0::DOUBLE AS minutes, count(f.i) / (count(*) * 80 / 60000.0::DOUBLE) AS per_minute FROM q LEFT JOIN f USING (conv_id, speaker, i) GROUP BY q.speaker""",
)
_CUTS = [(0, 4), (4, 8), (8, 11)]
register(
    "A07_table",
    lambda s, d: A.sufficiency_table(
        segments(s, d).selectExpr("CASE WHEN k % 7 <> 3 THEN (conv_id * 31 + turn * 7 + k * 5) % 11 END AS suff", "(conv_id * 17 + turn * 5 + k * 3) % 11 AS done"), "suff", "done", 8, _CUTS
    ),
    f"""WITH {SEG}, p AS (SELECT (conv_id * 31 + turn * 7 + k * 5) % 11 AS suff, (conv_id * 17 + turn * 5 + k * 3) % 11 AS done FROM seg WHERE k % 7 <> 3)
    SELECT count(*) AS n, corr(suff, done) AS corr, avg((suff >= 8 AND done < 8)::INT) AS only_sufficient, avg((done >= 8 AND suff < 8)::INT) AS only_done,
    {', '.join(f'count(*) FILTER (done >= {a} AND done < {b}) AS n_{a}_{b}, avg((suff >= 8)::INT) FILTER (done >= {a} AND done < {b}) AS sufficient_{a}_{b}' for a, b in _CUTS)} FROM p""",
)
register(
    "A08_mask",
    lambda s, d: A.level_gain(table(s, d, "events"), ["user_id"], "value", 12.0, F.col("event_type") == "click"),
    """WITH r AS (SELECT user_id, coalesce(sqrt(avg(value * value) FILTER (event_type = 'click') + 1e-12), 0) AS rms FROM events GROUP BY user_id)
    SELECT *, rms * power(10.0::DOUBLE, -0.6::DOUBLE) AS gain FROM r""",
)
register(
    "K01_order",
    lambda s, d: K.order_in_split(split(s, d), "conv_id", "o").select("conv_id", "split", "nth"),
    f"WITH {_SPLIT} SELECT conv_id, split, row_number() OVER (PARTITION BY split ORDER BY sha256('o:' || conv_id)) - 1 AS nth FROM sl",
)
