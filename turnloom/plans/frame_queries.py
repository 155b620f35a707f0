"""Queries of the frame, target and window operators, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from turnloom.functions import vocab
from turnloom.operators import frames as R
from turnloom.operators import windows as V
from turnloom.plans.commit_queries import GOLD, _canon, _SPANS, _spans, gold
from turnloom.plans.fixtures import SEG, frames, frames_sql, segments
from turnloom.plans.registry import register

FR = frames_sql()
CH = "PARTITION BY conv_id, speaker ORDER BY i"
_TOUCH = "tc AS (SELECT *, unnest(generate_series(start_ms // 80, (end_ms + 79) // 80 - 1)) AS i FROM canon)"
_GRID = "gr AS (SELECT conv_id, speaker, unnest(generate_series(0, l)) AS i FROM (SELECT conv_id, max((end_ms + 79) // 80 - 1) AS l FROM seg GROUP BY conv_id), (VALUES (1), (2)) v(speaker))"
_ACT = f"{_TOUCH}, {_GRID}, act AS (SELECT g.*, CASE WHEN a.i IS NULL THEN 0 ELSE 1 END AS active FROM gr g LEFT JOIN (SELECT DISTINCT conv_id, speaker, i FROM tc) a USING (conv_id, speaker, i))"


def active(s, d):
    return R.rasterize(segments(s, d), 80)


register("R01_rasterize", active, f"WITH {SEG}, {_ACT} SELECT * FROM act")
_FINE = """CASE label WHEN 'Floor-taking Competitive Interruption' THEN 1 WHEN 'Non-floor Taking Cooperative Interruption' THEN 4 WHEN 'Normal Turn' THEN 5
  WHEN 'Acknowledgement Backchannel' THEN 11 WHEN 'Laughter' THEN 13 WHEN 'Non-Speech Noise' THEN 15 END"""
register(
    "R02_fine_acts",
    lambda s, d: R.fine_acts(segments(s, d), vocab.fine_index(F.col("label")), 80),
    f"WITH {SEG}, {_ACT}, p AS (SELECT conv_id, speaker, i, min({_FINE}) AS fine FROM tc GROUP BY ALL) SELECT g.*, coalesce(fine, 0) AS fine FROM gr g LEFT JOIN p USING (conv_id, speaker, i)",
)


def hard(s, d):
    claims = _canon(s, d).where("canonical IN ('Turn', 'Interruption')")
    anchors = gold(s, d).where("task = 'eot' AND kind = 'pos'").select("conv_id", "speaker", F.col("start_ms").alias("t_ms"))
    return R.floor_hard(claims, anchors, 80)


_HARD = f"""{GOLD}, cl0 AS (SELECT *, unnest(generate_series(start_ms // 80, (end_ms + 79) // 80 - 1)) AS i FROM canon WHERE canonical IN ('Turn', 'Interruption')),
hd AS (SELECT conv_id, i, max((speaker = 1)::INT) AS s1, max((speaker = 2)::INT) AS s2, arg_max(speaker, end_ms) AS who, max(end_ms) AS to_ms FROM cl0 WHERE (i + 1) * 80 > start_ms AND (i + 1) * 80 <= end_ms GROUP BY conv_id, i),
ev AS (SELECT g.conv_id, g.i, s1, s2, last_value(CASE WHEN s1 + s2 = 1 THEN row(who, to_ms) END IGNORE NULLS) OVER (PARTITION BY g.conv_id ORDER BY g.i) AS l
  FROM (SELECT conv_id, unnest(generate_series(0, m)) AS i FROM (SELECT conv_id, max((end_ms + 79) // 80 - 1) AS m FROM canon WHERE canonical IN ('Turn', 'Interruption') GROUP BY conv_id)) g LEFT JOIN hd USING (conv_id, i)),
hard AS (SELECT conv_id, i, CASE WHEN s1 + s2 = 2 THEN 'CONTESTED' WHEN s1 IS NOT NULL THEN 'HELD_' || (l[1] - 1)
  WHEN l IS NULL OR EXISTS (SELECT 1 FROM gold g WHERE g.task = 'eot' AND g.kind = 'pos' AND g.conv_id = ev.conv_id AND g.speaker = l[1] AND g.start_ms = l[2]) THEN 'OPEN' ELSE 'HELD_' || (l[1] - 1) END AS floor FROM ev)"""
register("R03_floor_hard", hard, f"WITH {SEG}, {_HARD} SELECT * FROM hard")
register(
    "R04_floor_soft",
    lambda s, d: R.floor_soft(hard(s, d)),
    f"""WITH {SEG}, {_HARD}, rn AS (SELECT *, sum(c) OVER (PARTITION BY conv_id ORDER BY i) AS run FROM (SELECT *, CASE WHEN floor = lag(floor) OVER (PARTITION BY conv_id ORDER BY i) THEN 0 ELSE 1 END AS c FROM hard)),
    e AS (SELECT conv_id, run, min(i) AS f, count(*) AS n, lag(min(floor)) OVER (PARTITION BY conv_id ORDER BY run) AS b, lead(min(floor)) OVER (PARTITION BY conv_id ORDER BY run) AS a FROM rn GROUP BY conv_id, run),
    j AS (SELECT rn.*, a, b, (i - f + 0.5::DOUBLE) / n AS p FROM rn JOIN e USING (conv_id, run))
    SELECT conv_id, i, CASE WHEN floor = 'CONTESTED' THEN coalesce((b = 'HELD_0')::INT, 0) * (1 - p) + coalesce((a = 'HELD_0')::INT, 0) * p ELSE (floor = 'HELD_0')::INT END AS held_0,
    CASE WHEN floor = 'CONTESTED' THEN coalesce((b = 'HELD_1')::INT, 0) * (1 - p) + coalesce((a = 'HELD_1')::INT, 0) * p ELSE (floor = 'HELD_1')::INT END AS held_1 FROM j""",
)
register(
    "R05_weights",
    lambda s, d: R.target_weights(active(s, d), segments(s, d).where("(conv_id + turn + k) % 7 = 0"), 80),
    f"""WITH {SEG}, {_ACT}, x AS (SELECT DISTINCT conv_id, speaker, i FROM tc WHERE (conv_id + turn + k) % 7 = 0)
    SELECT a.*, CASE WHEN x.i IS NULL THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS weight FROM act a LEFT JOIN x USING (conv_id, speaker, i)""",
)
register(
    "R06_projection",
    lambda s, d: R.floor_projection(hard(s, d), [5, 10, 20]),
    f"WITH {SEG}, {_HARD} SELECT conv_id, i, floor, lead(floor, 5) OVER w AS floor_5, lead(floor, 10) OVER w AS floor_10, lead(floor, 20) OVER w AS floor_20 FROM hard WINDOW w AS (PARTITION BY conv_id ORDER BY i)",
)
_BIN = [(1, 3), (4, 8), (9, 15), (16, 25)]
register(
    "R07_vap_code",
    lambda s, d: R.vap_code(active(s, d), [3, 5, 7, 10]),
    f"""WITH {SEG}, {_ACT} SELECT conv_id, speaker, i, {' + '.join(f"CASE WHEN coalesce(avg(active) OVER ({CH} ROWS BETWEEN {a} FOLLOWING AND {b} FOLLOWING), 0) >= 0.5 THEN {1 << k} ELSE 0 END" for k, (a, b) in enumerate(_BIN))} AS code,
    count(*) OVER ({CH} ROWS BETWEEN 1 FOLLOWING AND 25 FOLLOWING) = 25 AS valid FROM act""",
)
register(
    "R08_occupancy",
    lambda s, d: R.vap_occupancy(active(s, d), [3, 5, 7, 10]),
    f"""WITH {SEG}, {_ACT} SELECT conv_id, speaker, i, {', '.join(f"avg(active) OVER ({CH} ROWS BETWEEN {a} FOLLOWING AND {b} FOLLOWING) AS occ_{k}" for k, (a, b) in enumerate(_BIN))} FROM act""",
)
register(
    "R10_slots",
    lambda s, d: R.arrival_slots(active(s, d)),
    f"""WITH {SEG}, {_ACT}, f AS (SELECT conv_id, speaker, min(CASE WHEN active = 1 THEN i END) AS f FROM act GROUP BY ALL) SELECT conv_id, speaker, row_number() OVER (PARTITION BY conv_id ORDER BY f NULLS LAST, speaker) - 1 AS slot FROM f""",
)
register(
    "R12_onset_label",
    lambda s, d: R.onset_label(_spans(s, d).select("conv_id", "speaker", F.col("start_i").alias("i")).distinct(), R.fine_acts(segments(s, d), vocab.fine_index(F.col("label")), 80), 12).withColumn("grp", vocab.group_of_index(F.col("onset_fine"))),
    f"""WITH {SEG}, {_ACT}, p AS (SELECT conv_id, speaker, i, min({_FINE}) AS fine FROM tc GROUP BY ALL), o AS (SELECT DISTINCT conv_id, speaker, start_ms // 80 AS i FROM seg),
    c AS (SELECT o.conv_id, o.speaker, o.i, fine, count(*) AS n FROM o JOIN p ON p.conv_id = o.conv_id AND p.speaker = o.speaker AND p.i BETWEEN o.i AND o.i + 11 GROUP BY ALL),
    t AS (SELECT conv_id, speaker, i, arg_min(fine, row(-n, fine)) AS onset_fine FROM c GROUP BY conv_id, speaker, i)
    SELECT *, CASE onset_fine WHEN 1 THEN 'floor_taking' WHEN 4 THEN 'attempt' WHEN 5 THEN 'turn' WHEN 11 THEN 'backchannel' ELSE 'noncontent' END AS grp FROM t""",
)
register(
    "R13_class_weights",
    lambda s, d: R.class_weights(segments(s, d), "label", 0.5),
    f"WITH {SEG}, c AS (SELECT label, count(*) AS n FROM seg GROUP BY label) SELECT label, n, least(power(n::DOUBLE, -0.5) / avg(power(n::DOUBLE, -0.5)) OVER (), 20.0) AS weight FROM c",
)
register(
    "R14_crops",
    lambda s, d: R.crop_starts(active(s, d).where("speaker = 1").groupBy("conv_id").agg(F.count("*").alias("n")), 250, 50, 100),
    f"""WITH {SEG}, {_ACT}, n AS (SELECT conv_id, count(*) AS n FROM act WHERE speaker = 1 GROUP BY conv_id) SELECT conv_id, unnest(generate_series(50, n - 251, 100)) AS start FROM n WHERE n > 300""",
)
register(
    "W01_speech",
    lambda s, d: V.speech_segments(frames(s, d), "vad", 0.5, 4),
    f"""WITH {SEG}, {FR}, o AS (SELECT *, CASE WHEN i - lag(i) OVER ({CH}) - 1 < 4 THEN 0 ELSE 1 END AS nw FROM fr WHERE vad > 0.5), r AS (SELECT *, sum(nw) OVER ({CH}) AS run FROM o)
    SELECT conv_id, speaker, min(i) AS from_i, max(i) + 1 AS to_i FROM r GROUP BY conv_id, speaker, run""",
)
register(
    "W02_energy",
    lambda s, d: V.energy_segments(frames(s, d).withColumn("db", F.expr("20D * vad - 40D + 10D * eot")), "db", -50.0, 18.0, 3, 2, 1),
    f"""WITH {SEG}, {FR}, x AS (SELECT *, 20.0::DOUBLE * vad - 40.0::DOUBLE + 10.0::DOUBLE * eot AS db FROM fr),
    t AS (SELECT conv_id, speaker, greatest(-50.0, quantile_cont(db, 0.99) - 18.0) AS th, max(i) AS last_ FROM x GROUP BY ALL),
    o AS (SELECT x.*, CASE WHEN i - lag(i) OVER (PARTITION BY x.conv_id, x.speaker ORDER BY i) - 1 < 3 THEN 0 ELSE 1 END AS nw FROM x JOIN t USING (conv_id, speaker) WHERE db > th),
    r AS (SELECT conv_id, speaker, i, sum(nw) OVER ({CH}) AS run FROM o), g AS (SELECT conv_id, speaker, min(i) AS a, max(i) + 1 AS b FROM r GROUP BY conv_id, speaker, run HAVING max(i) + 1 - min(i) >= 2)
    SELECT conv_id, speaker, greatest(a - 1, 0) AS from_i, least(b + 1, last_ + 1) AS to_i FROM g JOIN t USING (conv_id, speaker)""",
)
_HIST = f"""hs AS (SELECT *, least(row_number() OVER (PARTITION BY conv_id, speaker, run ORDER BY i), 125) AS age FROM (
  SELECT *, sum(c) OVER ({CH}) AS run FROM (SELECT *, CASE WHEN (vad > 0.5) = (lag(vad) OVER ({CH}) > 0.5) THEN 0 ELSE 1 END AS c FROM fr)))"""
register(
    "W03_history",
    lambda s, d: V.causal_history(frames(s, d), "vad", [4, 16, 64], 125),
    f"""WITH {SEG}, {FR}, {_HIST} SELECT conv_id, speaker, i, vad, CASE WHEN vad > 0.5 THEN 0 ELSE age END AS quiet_age, CASE WHEN vad > 0.5 THEN age ELSE 0 END AS talk_age,
    {', '.join(f'avg(vad) OVER ({CH} ROWS BETWEEN {w - 1} PRECEDING AND CURRENT ROW) AS mean_{w}' for w in (4, 16, 64))} FROM hs""",
)
register(
    "W04_pair",
    lambda s, d: V.pair_features(frames(s, d), ["vad", "eot"]),
    f"WITH {SEG}, {FR} SELECT a.conv_id, a.speaker, a.i, a.vad, a.eot, b.vad AS other_vad, b.eot AS other_eot FROM fr a JOIN fr b ON a.conv_id = b.conv_id AND a.speaker = 3 - b.speaker AND a.i = b.i",
)
register(
    "W06_past_max",
    lambda s, d: frames(s, d).select("conv_id", "speaker", "i", V.past_max(F.col("eot"), 8).alias("m")),
    f"WITH {SEG}, {FR} SELECT conv_id, speaker, i, coalesce(max(eot) OVER ({CH} ROWS BETWEEN 8 PRECEDING AND 1 PRECEDING), 0) AS m FROM fr",
)
register(
    "W07_hold",
    lambda s, d: frames(s, d).select("conv_id", "speaker", "i", V.hold(F.col("eot"), 3).alias("low"), V.hold(F.col("eot"), 3, "mean").alias("mean")),
    f"""WITH {SEG}, {FR} SELECT conv_id, speaker, i, CASE WHEN count(*) OVER w = 4 THEN min(eot) OVER w ELSE least(min(eot) OVER w, 0) END AS low, sum(eot) OVER w / 4 AS mean FROM fr WINDOW w AS ({CH} ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)""",
)
register(
    "W08_blocks",
    lambda s, d: V.block_reduce(frames(s, d), "eot", 5),
    f"WITH {SEG}, {FR} SELECT conv_id, speaker, i // 5 AS block, avg(eot) AS eot FROM fr GROUP BY ALL HAVING count(*) = 5",
)
register(
    "W08_trailing",
    lambda s, d: V.trailing_block(frames(s, d), "eot", 5, 3),
    f"WITH {SEG}, {FR}, x AS (SELECT conv_id, speaker, i, avg(eot) OVER w AS mean, count(*) OVER w AS n FROM fr WINDOW w AS ({CH} ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)) SELECT conv_id, speaker, i, mean FROM x WHERE n = 5 AND (i + 2) % 5 = 0",
)
register(
    "W09_standardizer",
    lambda s, d: V.standardizer(frames(s, d).where("conv_id % 5 != 0"), ["vad", "eot"]),
    f"WITH {SEG}, {FR} SELECT avg(vad) AS vad_mean, avg(eot) AS eot_mean, greatest(stddev_pop(vad), 0.01) AS vad_std, greatest(stddev_pop(eot), 0.01) AS eot_std FROM fr WHERE conv_id % 5 <> 0",
)
register(
    "W11_readout",
    lambda s, d: V.readout(frames(s, d), _spans(s, d).select("conv_id", "speaker", F.col("start_i").alias("i")).distinct(), ["eot"], 13),
    f"""WITH {SEG}, {FR}, {_SPANS}, t AS (SELECT conv_id, speaker, i, eot, avg(eot) OVER ({CH} ROWS BETWEEN 12 PRECEDING AND CURRENT ROW) AS eot_trail FROM fr), p AS (SELECT DISTINCT conv_id, speaker, start_i AS i FROM sp)
    SELECT p.*, a.eot, a.eot_trail, b.eot AS other_eot, b.eot_trail AS other_eot_trail FROM p JOIN t a USING (conv_id, speaker, i) JOIN t b ON b.conv_id = p.conv_id AND b.speaker = 3 - p.speaker AND b.i = p.i""",
)
def _asked(s, d):
    """Ends of segments, and times about the first frame."""
    seg = segments(s, d)
    early = seg.where("k < 4").select("conv_id", F.explode(F.array(F.lit(1), F.lit(2))).alias("speaker"), (F.col("k") * 37).alias("t_ms"))
    return seg.select("conv_id", "speaker", F.col("end_ms").alias("t_ms")).unionByName(early)


register(
    "J01_as_of",
    lambda s, d: V.as_of(_asked(s, d), frames(s, d).select("conv_id", "speaker", "i", "eot"), 80),
    f"""WITH {SEG}, {FR}, m AS (SELECT conv_id, speaker, max(i) AS l FROM fr GROUP BY ALL),
    q AS (SELECT conv_id, speaker, end_ms AS t_ms FROM seg UNION ALL SELECT conv_id, v.speaker, k * 37 AS t_ms FROM seg, (VALUES (1), (2)) v(speaker) WHERE k < 4),
    p AS (SELECT conv_id, speaker, t_ms, least(t_ms // 80 - 1, l) AS i FROM q JOIN m USING (conv_id, speaker))
    SELECT conv_id, speaker, i, t_ms, CASE WHEN i < 0 THEN 0.0::DOUBLE ELSE eot END AS eot FROM p LEFT JOIN fr USING (conv_id, speaker, i)""",
)


def _candidates(s, d):
    return segments(s, d).select("conv_id", "turn", "k", F.expr("(conv_id * 31 + turn * 7 + k * 5) % 11").alias("score"), F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"\S+"), F.lit(0))).alias("words"))


register(
    "W12_stable_suffix",
    lambda s, d: V.stable_suffix(_candidates(s, d), ["conv_id", "turn"], "k", "score", 4),
    f"""WITH {SEG}, c AS (SELECT conv_id, turn, k, min(((conv_id * 31 + turn * 7 + k * 5) % 11 >= 4)::INT) OVER (PARTITION BY conv_id, turn ORDER BY k DESC) AS ok FROM seg),
    g AS (SELECT conv_id, turn, min(CASE WHEN ok = 1 THEN k END) AS stable, max(k) AS last FROM c GROUP BY ALL) SELECT *, last - stable AS lead FROM g""",
)
register(
    "W13_pairs",
    lambda s, d: V.consecutive_pairs(_candidates(s, d), ["conv_id", "turn"], "k", "words"),
    f"""WITH {SEG}, c AS (SELECT conv_id, turn, k, list_distinct(regexp_extract_all(lower(text), '\\S+')) AS ws FROM seg), b AS (SELECT *, lag(ws) OVER (PARTITION BY conv_id, turn ORDER BY k) AS p FROM c)
    SELECT conv_id, turn, k, len(list_intersect(ws, p))::DOUBLE / greatest(len(list_distinct(list_concat(ws, p))), 1) AS overlap FROM b WHERE p IS NOT NULL""",
)

