"""Queries of the commit and scoring operators, with their SQL."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from turnloom.functions import vocab
from turnloom.operators import commit as C
from turnloom.operators import scoring as M
from turnloom.operators import silence as S
from turnloom.plans.fixtures import SEG, frames, frames_sql, segments, table
from turnloom.plans.registry import register
from turnloom.sources.settle import settle

FR = frames_sql()
CH = "PARTITION BY conv_id, speaker ORDER BY i"
STEP = 80


def _canon(s, d):
    return segments(s, d).withColumn("canonical", vocab.canonical(F.col("label")))


def gold(s, d) -> DataFrame:
    return M.gold_events(_canon(s, d))


GOLD = """vw AS (SELECT *, lead(speaker) OVER (PARTITION BY conv_id ORDER BY start_ms, speaker) AS who, lead(start_ms) OVER (PARTITION BY conv_id ORDER BY start_ms, speaker) AS at_
  FROM canon WHERE canonical IN ('Turn', 'Interruption')),
gold AS (
  SELECT conv_id, 'eot' AS task, 'pos' AS kind, speaker, end_ms AS start_ms, end_ms FROM vw WHERE who <> speaker UNION
  SELECT conv_id, 'eot', 'neg', speaker, end_ms, at_ FROM vw WHERE who = speaker AND at_ > end_ms UNION
  SELECT conv_id, 'int', 'pos', speaker, start_ms, start_ms FROM canon WHERE canonical = 'Interruption' UNION
  SELECT conv_id, 'int', 'neg', speaker, start_ms, end_ms FROM canon WHERE canonical IN ('Backchannel', 'NonContent') UNION
  SELECT conv_id, 'int', 'excl', speaker, start_ms, end_ms FROM canon WHERE canonical = 'NonFloorTakingInterruption')"""
WINDOWS = """win AS (
  SELECT conv_id, task, speaker, t_ms, t_ms - 250 AS lo_ms,
         least(t_ms + 3000, coalesce(lead(t_ms) OVER (PARTITION BY conv_id, task, speaker ORDER BY t_ms), t_ms + 3000)) AS hi_ms
  FROM (SELECT DISTINCT conv_id, task, speaker, start_ms AS t_ms FROM gold WHERE kind = 'pos'))"""
register("M01_gold", gold, f"WITH {SEG}, {GOLD} SELECT * FROM gold")
register("M03_windows", lambda s, d: M.match_windows(gold(s, d)), f"WITH {SEG}, {GOLD}, {WINDOWS} SELECT * FROM win")


def _edges_sql(score: str, theta: float, name: str = "ed") -> str:
    return f"{name} AS (SELECT conv_id, speaker, i FROM (SELECT *, coalesce(lag({score}) OVER ({CH}), 0) AS b FROM fr) WHERE {score} > {theta} AND NOT b > {theta})"


def _apart_sql(source: str, least: int, name: str, keys: str = "conv_id, speaker") -> str:
    """The kept events: from each, the next one at least `least` later."""
    same = " AND ".join(f"e.{k.strip()} = c.{k.strip()}" for k in keys.split(","))
    return f"""{name} AS (
      SELECT {keys}, min(i) AS i FROM {source} GROUP BY {keys}
      UNION ALL SELECT * FROM (SELECT {', '.join('c.' + k.strip() for k in keys.split(','))}, (SELECT min(e.i) FROM {source} e WHERE {same} AND e.i >= c.i + {least}) AS i FROM {name} c) WHERE i IS NOT NULL)"""


register(
    "C01_commit",
    lambda s, d: C.rising_edge_commit(frames(s, d), "eot", 0.6, 25),
    f"WITH RECURSIVE {SEG}, {FR}, {_edges_sql('eot', 0.6)}, {_apart_sql('ed', 25, 'cm')} SELECT * FROM cm",
)
register(
    "C02_recommit",
    lambda s, d: C.recommit(frames(s, d), C.rising_edge_commit(frames(s, d), "eot", 0.2, 5), "eot", 0.2, 3),
    f"""WITH RECURSIVE {SEG}, {FR}, {_edges_sql('eot', 0.2)}, {_apart_sql('ed', 5, 'cm')},
    ab AS (SELECT conv_id, speaker, i, bool_and(eot > 0.2) OVER w AND count(*) OVER w = 4 AS held FROM fr WINDOW w AS ({CH} ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING))
    SELECT * FROM cm UNION SELECT conv_id, speaker, i + 3 FROM ab JOIN cm USING (conv_id, speaker, i) WHERE held""",
)
register(
    "C03_quiet_armed",
    lambda s, d: C.quiet_armed_commit(frames(s, d), "vad", "eot", 0.7, 20),
    f"""WITH RECURSIVE {SEG}, {FR}, ep AS (SELECT *, sum(CASE WHEN vad > 0.5 THEN 1 ELSE 0 END) OVER ({CH}) AS episode FROM fr),
    q AS (SELECT conv_id, speaker, episode, i FROM ep WHERE vad <= 0.5 AND episode > 0 AND eot >= 0.7), {_apart_sql('q', 20, 'cm', 'conv_id, speaker, episode')} SELECT conv_id, speaker, i FROM cm""",
)


# Frames for 0.16 to 2.4 s of quiet, 0.16 to 0.64 s of the other's talk or any, and a second commit after 1.5 s or none.
QUIETS, OTHERS, AGAINS = [2, 4, 6, 8, 12, 16, 20, 25, 30], [None, 2, 4, 8], [None, 19]
_AGES = f"""tk AS (SELECT conv_id, speaker, i, vad >= 0.5 AS talk, coalesce(max(CASE WHEN vad >= 0.5 THEN i END) OVER ({CH}), -1) AS lt,
         coalesce(max(CASE WHEN vad < 0.5 THEN i END) OVER ({CH}), -1) AS lq FROM fr),
ag AS MATERIALIZED (SELECT *, sum(CASE WHEN talk THEN i - lq ELSE 0 END) OVER (PARTITION BY conv_id, i) - CASE WHEN talk THEN i - lq ELSE 0 END AS other_talks FROM tk)"""


def silence_grid(s) -> DataFrame:
    """The 72 policies, numbered."""
    points = [(q, o, a) for q in QUIETS for o in OTHERS for a in AGAINS]
    return s.createDataFrame([(n, *p) for n, p in enumerate(points)], "policy int, quiet int, other int, again int")


register(
    "C04_silence_policy",
    lambda s, d: S.state_ages(frames(s, d)).where(S.eligible(6, 3) | S.eligible(20)).select("conv_id", "speaker", "i"),
    f"WITH {SEG}, {FR}, {_AGES} SELECT conv_id, speaker, i FROM ag WHERE NOT talk AND (i - lt - 1 >= 6 AND other_talks >= 4 OR i - lt - 1 >= 20)",
)
def _listed(values: list) -> str:
    return str(values).replace("None", "NULL")


#: The 72 policies, numbered as by silence_grid(), and the commits of each.
_GRID = f"""px AS MATERIALIZED (SELECT (q.n * {len(OTHERS)} + o.n) * {len(AGAINS)} + a.n AS policy, quiet, other, again FROM (SELECT unnest({QUIETS}) AS quiet, unnest(range({len(QUIETS)})) AS n) q,
           (SELECT unnest({_listed(OTHERS)}) AS other, unnest(range({len(OTHERS)})) AS n) o, (SELECT unnest({_listed(AGAINS)}) AS again, unnest(range({len(AGAINS)})) AS n) a),
    el AS (SELECT policy, again, conv_id, speaker, lt, list(i ORDER BY i) AS at_ FROM ag, px WHERE NOT talk AND lt >= 0 AND i - lt - 1 >= quiet AND (other IS NULL OR other_talks >= other + 1) GROUP BY ALL),
    gc AS MATERIALIZED (SELECT policy, conv_id, speaker, unnest(CASE WHEN again IS NULL THEN at_[:1] ELSE list_reduce(list_transform(at_, lambda x: [x]), lambda y, x: CASE WHEN x[1] - y[-1] >= again THEN list_append(y, x[1]) ELSE y END) END) AS i FROM el)"""
register(
    "C04_silence_grid",
    lambda s, d: S.silence_fires(frames(s, d), silence_grid(s)).groupBy("policy").agg(F.count("*").alias("n"), F.sum("i").alias("at"), F.countDistinct("conv_id").alias("conversations")),
    f"""WITH {SEG}, {FR}, {_AGES}, {_GRID}
    SELECT policy::INT AS policy, count(*) AS n, sum(i)::BIGINT AS at, count(DISTINCT conv_id) AS conversations FROM gc GROUP BY policy""",
)


def _spans(s, d):
    nxt = F.lead("start_ms").over(W.partitionBy("conv_id", "speaker").orderBy("start_ms", "end_ms"))
    return segments(s, d).select("conv_id", "speaker", F.expr("start_ms div 80").alias("start_i"), F.expr("end_ms div 80").alias("end_i"), F.floor(nxt / 80).alias("next_i"))


_SPANS = "sp AS (SELECT conv_id, speaker, start_ms // 80 AS start_i, end_ms // 80 AS end_i, lead(start_ms) OVER (PARTITION BY conv_id, speaker ORDER BY start_ms, end_ms) // 80 AS next_i FROM seg)"
_FIRST = "(SELECT min(i) FROM hit WHERE hit.conv_id = x.conv_id AND hit.speaker = x.speaker AND hit.i > x.a AND hit.i <= x.b)"
register(
    "C07_first_above",
    lambda s, d: C.first_above(frames(s, d), _spans(s, d).select("conv_id", "speaker", F.col("end_i").alias("from_i"), (F.col("end_i") + 12).alias("to_i")), "eot", 0.95),
    f"""WITH {SEG}, {FR}, {_SPANS}, hit AS (SELECT conv_id, speaker, i FROM fr WHERE eot >= 0.95), x AS (SELECT *, end_i AS a, end_i + 12 AS b FROM sp)
    SELECT conv_id, speaker, a AS from_i, b AS to_i, {_FIRST} AS first_i FROM x""",
)
register(
    "C08_query_points",
    lambda s, d: C.query_points(frames(s, d), "eot", 0.3, 2),
    f"""WITH {SEG}, {FR}, r AS (SELECT *, sum(CASE WHEN eot > 0.3 THEN 0 ELSE 1 END) OVER ({CH}) AS run FROM fr),
    a AS (SELECT *, min(i) OVER (PARTITION BY conv_id, speaker, run) AS f FROM r WHERE eot > 0.3) SELECT conv_id, speaker, i FROM a WHERE (i - f) % 2 = 0""",
)


def _answers(s, d):
    return C.rising_edges(frames(s, d), F.col("eot"), F.lit(0.6)).where("(conv_id + i) % 3 != 0").select("conv_id", "speaker", "i", F.expr("((conv_id * 31 + i * 7) % 11) / 10.0D").alias("confidence"))


register(
    "C09_veto",
    lambda s, d: C.veto(C.rising_edge_commit(frames(s, d), "eot", 0.6, 25), _answers(s, d), 0.5),
    f"""WITH RECURSIVE {SEG}, {FR}, {_edges_sql('eot', 0.6)}, {_apart_sql('ed', 25, 'cm')} SELECT * FROM cm
    WHERE (conv_id + i) % 3 = 0 OR ((conv_id * 31 + i * 7) % 11) / 10.0::DOUBLE >= 0.5""",
)


def preds(s, d, theta: float = 0.6, task: str = "eot") -> DataFrame:
    fires = C.rising_edge_commit(frames(s, d), task, theta, 6)
    return fires.select("conv_id", F.lit(task).alias("task"), "speaker", ((F.col("i") + 1) * STEP).alias("t_ms"))


def eot_gold(s, d) -> DataFrame:
    return gold(s, d).where("task = 'eot'")


def scores(s, d, theta: float = 0.6, task: str = "eot") -> DataFrame:
    return M.score_events(gold(s, d).where(F.col("task") == task), preds(s, d, theta, task))


# First claims in SQL: anchors in order, each the least prediction in its window after the last one claimed.
def scores_sql(task: str) -> str:
    """Claims of the predictions of a task outside its excluded spans."""
    return _SCORES.replace("'eot'", f"'{task}'").replace("__EDGES__", _edges_sql(task, 0.6))


_SCORES = f"""__EDGES__, {_apart_sql('ed', 6, 'cm')}, pr AS (
  SELECT conv_id, speaker, (i + 1) * 80 AS t_ms FROM cm
  WHERE NOT EXISTS (SELECT 1 FROM gold e WHERE e.task = 'eot' AND e.kind = 'excl' AND e.conv_id = cm.conv_id AND e.speaker = cm.speaker AND (i + 1) * 80 BETWEEN e.start_ms AND e.end_ms)),
aw AS (SELECT *, row_number() OVER (PARTITION BY conv_id, speaker ORDER BY t_ms) AS nth FROM win WHERE task = 'eot'),
cl AS (
  SELECT conv_id, speaker, 0::BIGINT AS nth, NULL::BIGINT AS anchor, NULL::BIGINT AS hit, -1000000::BIGINT AS last_ FROM (SELECT DISTINCT conv_id, speaker FROM aw)
  UNION ALL
  SELECT conv_id, speaker, nth, anchor, hit, coalesce(hit, last_) FROM (
    SELECT c.conv_id, c.speaker, a.nth, a.t_ms AS anchor, c.last_,
           (SELECT min(p.t_ms) FROM pr p WHERE p.conv_id = a.conv_id AND p.speaker = a.speaker AND p.t_ms BETWEEN a.lo_ms AND a.hi_ms AND p.t_ms > c.last_) AS hit
    FROM cl c JOIN aw a ON a.conv_id = c.conv_id AND a.speaker = c.speaker AND a.nth = c.nth + 1)),
fp AS (SELECT p.* FROM pr p WHERE NOT EXISTS (SELECT 1 FROM aw a WHERE a.conv_id = p.conv_id AND a.speaker = p.speaker AND p.t_ms BETWEEN a.lo_ms AND a.hi_ms)),
sc AS (
  SELECT conv_id, 'eot' AS task, speaker, CASE WHEN hit IS NULL THEN 'FN' ELSE 'TP' END AS outcome, anchor AS t_ms, hit - anchor AS latency_ms FROM cl WHERE nth > 0
  UNION ALL
  SELECT conv_id, 'eot', speaker, CASE WHEN EXISTS (SELECT 1 FROM fp WHERE fp.conv_id = g.conv_id AND fp.speaker = g.speaker AND fp.t_ms BETWEEN g.start_ms AND g.end_ms) THEN 'FP' ELSE 'TN' END, start_ms, NULL
  FROM gold g WHERE task = 'eot' AND kind = 'neg')"""
SCORES = scores_sql("eot")
_ALL = f"WITH RECURSIVE {SEG}, {FR}, {GOLD}, {WINDOWS}, {SCORES}"
RATES = """count(*) FILTER (outcome = 'TP') AS tp, count(*) FILTER (outcome = 'FN') AS fn, count(*) FILTER (outcome = 'FP') AS fp, count(*) FILTER (outcome = 'TN') AS tn,
count(*) FILTER (outcome = 'TP')::DOUBLE / nullif(count(*) FILTER (outcome IN ('TP', 'FN')), 0) AS recall, count(*) FILTER (outcome = 'FP')::DOUBLE / nullif(count(*) FILTER (outcome IN ('FP', 'TN')), 0) AS fp_rate,
quantile_cont(latency_ms::DOUBLE, 0.1) AS p10_ms, quantile_cont(latency_ms::DOUBLE, 0.5) AS p50_ms, quantile_cont(latency_ms::DOUBLE, 0.9) AS p90_ms"""
register("M04_scores", scores, f"{_ALL} SELECT * FROM sc")
# Interruptions: predictions on failed attempts are dropped.
register("M04_int_scores", lambda s, d: scores(s, d, 0.6, "int"), f"WITH RECURSIVE {SEG}, {FR}, {GOLD}, {WINDOWS}, {scores_sql('int')} SELECT * FROM sc")
register("M06_summary", lambda s, d: M.event_totals(eot_gold(s, d), preds(s, d), []), f"{_ALL} SELECT task, {RATES} FROM sc GROUP BY task")
register(
    "M07_by_channel",
    lambda s, d: M.channel_totals(eot_gold(s, d), preds(s, d)),
    f"{_ALL} SELECT task, 0 AS channel, {RATES} FROM sc GROUP BY task UNION ALL SELECT task, speaker, {RATES} FROM sc GROUP BY task, speaker",
)
register(
    "M08_theta_grid",
    lambda s, d: M.theta_grid(frames(s, d), "eot", 17),
    f"""WITH {SEG}, {FR}, q AS (SELECT unnest(quantile_cont(eot, [{', '.join(str(k / 16) for k in range(17))}])) AS theta FROM fr WHERE eot > 0) SELECT theta FROM q UNION SELECT unnest(generate_series(1, 99)) / 100.0::DOUBLE""",
)
THETAS = [0.3, 0.5, 0.6, 0.7, 0.8, 0.9, 0.95]


REFRACTORIES, RECOMMITS = [6, 25], [0, 12]


def sweep(s, d) -> DataFrame:
    """Every threshold with every refractory and re-commit, on the turn ends."""
    thetas = s.createDataFrame([(t,) for t in THETAS], "theta double")
    channels = M.channel_rises(frames(s, d), "eot", thetas, RECOMMITS)
    return M.event_totals(eot_gold(s, d), channels, ["theta", "refractory", "recommit"], (), fires=lambda met: M.rise_totals(met, thetas, REFRACTORIES, RECOMMITS, STEP))


# The sweep in SQL: fires of all settings, then claims anchor by anchor.
_SWEEP = f"""WITH RECURSIVE {SEG}, {FR}, {GOLD}, {WINDOWS},
sb AS (SELECT conv_id, speaker, i, eot, coalesce(lag(eot) OVER ({CH}), 0) AS b, min(eot) OVER ({CH} ROWS BETWEEN CURRENT ROW AND 12 FOLLOWING) AS low, count(*) OVER ({CH} ROWS BETWEEN CURRENT ROW AND 12 FOLLOWING) AS many FROM fr),
se AS MATERIALIZED (SELECT theta, refractory, conv_id, speaker, i, low, many FROM sb, (SELECT unnest({THETAS})::DOUBLE AS theta), (SELECT unnest({REFRACTORIES}) AS refractory) WHERE eot > theta AND NOT b > theta),
sn AS MATERIALIZED (SELECT a.theta, a.refractory, a.conv_id, a.speaker, a.i, min(n.i) AS nxt FROM se a JOIN se n ON a.theta = n.theta AND a.refractory = n.refractory AND a.conv_id = n.conv_id AND a.speaker = n.speaker AND n.i >= a.i + a.refractory GROUP BY ALL),
sc0 AS (SELECT theta, refractory, conv_id, speaker, min(i) AS i FROM se GROUP BY ALL UNION ALL SELECT c.theta, c.refractory, c.conv_id, c.speaker, n.nxt FROM sc0 c JOIN sn n USING (theta, refractory, conv_id, speaker, i) WHERE n.nxt IS NOT NULL),
sf AS (SELECT theta, refractory, recommit, conv_id, speaker, i FROM sc0, (VALUES (0), (12)) v(recommit)
       UNION SELECT theta, refractory, 12, conv_id, speaker, i + 12 FROM sc0 JOIN se USING (theta, refractory, conv_id, speaker, i) WHERE low > theta AND many = 13),
sp AS MATERIALIZED (SELECT theta, refractory, recommit, conv_id, speaker, (i + 1) * 80 AS t_ms FROM sf),
st AS (SELECT DISTINCT theta, refractory, recommit FROM sp),
aw AS (SELECT *, row_number() OVER (PARTITION BY conv_id, speaker ORDER BY t_ms) AS nth FROM win WHERE task = 'eot'),
ca AS MATERIALIZED (SELECT theta, refractory, recommit, a.conv_id, a.speaker, nth, a.t_ms AS anchor, list_sort(list(p.t_ms) FILTER (p.t_ms IS NOT NULL)) AS seen FROM aw a CROSS JOIN st
       LEFT JOIN sp p USING (theta, refractory, recommit) WHERE p.conv_id = a.conv_id AND p.speaker = a.speaker AND p.t_ms BETWEEN a.lo_ms AND a.hi_ms GROUP BY ALL),
cb AS MATERIALIZED (SELECT st.*, aw.conv_id, aw.speaker, aw.nth, aw.t_ms AS anchor, seen FROM aw CROSS JOIN st LEFT JOIN ca USING (theta, refractory, recommit, conv_id, speaker, nth)),
cl AS (SELECT theta, refractory, recommit, conv_id, speaker, 0::BIGINT AS nth, NULL::BIGINT AS anchor, NULL::BIGINT AS hit, -1000000::BIGINT AS last_ FROM (SELECT DISTINCT theta, refractory, recommit, conv_id, speaker FROM cb)
       UNION ALL SELECT theta, refractory, recommit, conv_id, speaker, nth, anchor, hit, coalesce(hit, last_) FROM (SELECT c.theta, c.refractory, c.recommit, c.conv_id, c.speaker, b.nth, b.anchor, c.last_,
         list_filter(b.seen, lambda t: t > c.last_)[1] AS hit FROM cl c JOIN cb b ON b.theta = c.theta AND b.refractory = c.refractory AND b.recommit = c.recommit AND b.conv_id = c.conv_id AND b.speaker = c.speaker AND b.nth = c.nth + 1)),
fa AS (SELECT sp.* FROM sp WHERE NOT EXISTS (SELECT 1 FROM aw a WHERE a.conv_id = sp.conv_id AND a.speaker = sp.speaker AND sp.t_ms BETWEEN a.lo_ms AND a.hi_ms)),
fh AS (SELECT DISTINCT fa.theta, fa.refractory, fa.recommit, g.conv_id, g.speaker, g.start_ms, g.end_ms FROM fa JOIN gold g ON g.task = 'eot' AND g.kind = 'neg' AND g.conv_id = fa.conv_id AND g.speaker = fa.speaker AND fa.t_ms BETWEEN g.start_ms AND g.end_ms),
sc AS (SELECT theta, refractory, recommit, CASE WHEN hit IS NULL THEN 'FN' ELSE 'TP' END AS outcome, hit - anchor AS latency_ms FROM cl WHERE nth > 0
       UNION ALL SELECT st.*, CASE WHEN fh.conv_id IS NULL THEN 'TN' ELSE 'FP' END, NULL FROM (SELECT * FROM gold WHERE task = 'eot' AND kind = 'neg') g CROSS JOIN st
         LEFT JOIN fh ON fh.theta = st.theta AND fh.refractory = st.refractory AND fh.recommit = st.recommit AND fh.conv_id = g.conv_id AND fh.speaker = g.speaker AND fh.start_ms = g.start_ms AND fh.end_ms = g.end_ms),
sw AS (SELECT theta, refractory, recommit, {RATES} FROM sc GROUP BY theta, refractory, recommit)"""
_SETTING = ["refractory", "recommit"]


register(
    "M09_sweep_edges",
    lambda s, d: M.sweep_edges(frames(s, d), "eot", s.createDataFrame([(t,) for t in THETAS], "theta double")).groupBy("theta").agg(F.count("*").alias("n"), F.sum("i").alias("at")),
    f"""WITH {SEG}, {FR}, b AS (SELECT *, coalesce(lag(eot) OVER ({CH}), 0) AS b FROM fr) SELECT theta, count(*) AS n, sum(i)::BIGINT AS at FROM b, (SELECT unnest({THETAS})::DOUBLE AS theta) WHERE eot > theta AND NOT b > theta GROUP BY theta""",
)
register("M09_sweep", sweep, f"{_SWEEP} SELECT * FROM sw")
_PICK = "QUALIFY row_number() OVER (PARTITION BY refractory, recommit ORDER BY {}) = 1"
register("M10_operating_point", lambda s, d: M.operating_point(sweep(s, d), _SETTING, 0.5), f"{_SWEEP} SELECT * FROM sw WHERE fp_rate <= 0.5 {_PICK.format('recall DESC, p50_ms NULLS LAST, theta')}")
register("M10_at_theta", lambda s, d: M.at_theta(sweep(s, d), _SETTING, 0.66), f"{_SWEEP} SELECT * FROM sw {_PICK.format('abs(theta - 0.66::DOUBLE), theta')}")
register("M10_fp_at_recall", lambda s, d: M.fp_at_recall(sweep(s, d), _SETTING, 0.6), f"{_SWEEP} SELECT * FROM sw WHERE recall >= 0.6 AND fp_rate IS NOT NULL {_PICK.format('fp_rate, p50_ms NULLS LAST, theta')}")
register(
    "M10_selection_rank",
    lambda s, d: M.selection_rank(sweep(s, d), _SETTING, 0.3),
    f"""{_SWEEP} SELECT *, row_number() OVER (PARTITION BY refractory, recommit ORDER BY coalesce(fp_rate <= 0.3, false) DESC, CASE WHEN coalesce(fp_rate <= 0.3, false) THEN coalesce(recall, -1.0) ELSE -1.0 END DESC,
    fp_rate NULLS LAST, coalesce(p50_ms, 0), theta) AS rank FROM sw""",
)


def silence_sweep(s, d) -> DataFrame:
    """All silence policies scored in one plan, with their rank under a ceiling of false positives."""
    channels = S.quiet_episodes(frames(s, d)).withColumn("task", F.lit("eot"))
    def fires(met: DataFrame) -> DataFrame:
        return S.episode_fires(met, silence_grid(s)).withColumn("seen", F.expr(f"transform(at, i -> (i + 1) * {STEP})")).drop("at")
    totals = M.event_totals(eot_gold(s, d), channels, ["policy"], (), silence_grid(s).select("policy"), fires)
    return M.selection_rank(totals.join(silence_grid(s), "policy").withColumn("theta", F.col("policy").cast("double")), [], 0.5).drop("theta")


register(
    "M11_silence_grid",
    silence_sweep,
    # A channel's claims anchor by anchor: what was claimed last, then a latency for each anchor, -1e9 for none.
    f"""WITH {SEG}, {FR}, {GOLD}, {WINDOWS}, {_AGES}, {_GRID},
    pl AS (SELECT policy, conv_id, speaker, list(DISTINCT (i + 1) * 80 ORDER BY (i + 1) * 80) AS ps FROM gc GROUP BY ALL),
    al AS (SELECT conv_id, speaker, list([t_ms, lo_ms, hi_ms] ORDER BY t_ms) AS a FROM win WHERE task = 'eot' GROUP BY ALL),
    nl AS (SELECT conv_id, speaker, list([start_ms, end_ms]) AS n FROM gold WHERE task = 'eot' AND kind = 'neg' GROUP BY ALL),
    j AS (SELECT policy, ps, coalesce(a, ([[0]]::BIGINT[][])[:0]) AS a, coalesce(n, ([[0]]::BIGINT[][])[:0]) AS n FROM pl LEFT JOIN al USING (conv_id, speaker) LEFT JOIN nl USING (conv_id, speaker)),
    k AS (SELECT policy, list_reduce(list_prepend([-1000000]::BIGINT[], a), lambda y, e: [coalesce(list_filter(ps, lambda p: p BETWEEN e[2] AND e[3] AND p > y[1])[1], y[1])] || y[2:]
        || [coalesce(list_filter(ps, lambda p: p BETWEEN e[2] AND e[3] AND p > y[1])[1] - e[1], -1000000000)]) AS y,
      list_filter(ps, lambda p: len(list_filter(a, lambda e: p BETWEEN e[2] AND e[3])) = 0) AS free, n FROM j),
    h AS (SELECT policy, list_filter(y[2:], lambda x: x > -1000000000) AS lats, len(list_filter(n, lambda m: len(list_filter(free, lambda p: p BETWEEN m[1] AND m[2])) > 0)) AS fp FROM k),
    q AS (SELECT policy, quantile_cont(x::DOUBLE, 0.1) AS p10_ms, quantile_cont(x::DOUBLE, 0.5) AS p50_ms, quantile_cont(x::DOUBLE, 0.9) AS p90_ms FROM (SELECT policy, unnest(lats) AS x FROM h) GROUP BY policy),
    f AS (SELECT policy, sum(len(lats)) AS tp, sum(fp) AS fp FROM h GROUP BY policy),
    tt AS (SELECT (SELECT count(*) FROM win WHERE task = 'eot') AS pos, (SELECT count(*) FROM gold WHERE task = 'eot' AND kind = 'neg') AS neg),
    r AS (SELECT px.policy::INT AS policy, quiet, other, again, coalesce(tp, 0)::BIGINT AS tp, (pos - coalesce(tp, 0))::BIGINT AS fn, coalesce(fp, 0)::BIGINT AS fp, (neg - coalesce(fp, 0))::BIGINT AS tn,
      coalesce(tp, 0)::DOUBLE / pos AS recall, coalesce(fp, 0)::DOUBLE / neg AS fp_rate, p10_ms, p50_ms, p90_ms FROM px CROSS JOIN tt LEFT JOIN f USING (policy) LEFT JOIN q USING (policy))
    SELECT *, row_number() OVER (ORDER BY coalesce(fp_rate <= 0.5, false) DESC, CASE WHEN coalesce(fp_rate <= 0.5, false) THEN recall ELSE -1.0 END DESC, fp_rate NULLS LAST, coalesce(p50_ms, 0), policy) AS rank FROM r""",
)
register(
    "M05_greedy_match",
    lambda s, d: M.greedy_match(preds(s, d).select("conv_id", "speaker", "t_ms"), gold(s, d).where("task = 'eot' AND kind = 'pos'").select("conv_id", "speaker", F.col("start_ms").alias("g_ms")), ["conv_id", "speaker"], 300),
    # Predictions in order, each with the nearest gold that none before has taken.
    f"""{_ALL}, ch AS (SELECT conv_id, speaker, list(DISTINCT t_ms ORDER BY t_ms) AS ps FROM pr GROUP BY ALL),
    gd AS (SELECT conv_id, speaker, list(DISTINCT start_ms ORDER BY start_ms) AS gs FROM gold WHERE task = 'eot' AND kind = 'pos' GROUP BY ALL),
    mt AS (SELECT conv_id, speaker, unnest(list_reduce(list_prepend([]::STRUCT(t BIGINT, g BIGINT)[], list_transform(ps, lambda p: [{{'t': p, 'g': NULL::BIGINT}}])), lambda y, x: list_append(y, {{'t': x[1].t,
      'g': list_sort(list_transform(list_filter(gs, lambda g: abs(g - x[1].t) <= 300 AND NOT coalesce(list_contains(list_transform(y, lambda a: a.g), g), false)), lambda g: [abs(g - x[1].t), g]))[1][2]}}))) AS m FROM ch JOIN gd USING (conv_id, speaker))
    SELECT conv_id, speaker, m.t AS t_ms, m.g AS g_ms FROM mt WHERE m.g IS NOT NULL""",
)
# Both systems' claims: the tables of one renamed, then those of the other.
_SECOND = re.sub(r"\b(ed|cm|pr|aw|cl|fp|sc)\b", r"\1_2", SCORES.replace("> 0.6", "> 0.8"))
_PAIRED = f"""{_ALL}, {_SECOND},
    x AS (SELECT a.task, a.outcome = 'TP' AS in_a, b.outcome = 'TP' AS in_b, a.latency_ms - b.latency_ms AS gain FROM sc a JOIN sc_2 b USING (conv_id, task, speaker, t_ms) WHERE a.outcome IN ('TP', 'FN') AND b.outcome IN ('TP', 'FN')),
    pa AS (SELECT task, count(*) FILTER (in_a AND in_b) AS common, count(*) FILTER (NOT in_a AND in_b) AS gained, count(*) FILTER (in_a AND NOT in_b) AS lost, count(*) FILTER (NOT in_a AND NOT in_b) AS missed,
      quantile_cont(gain::DOUBLE, 0.5) FILTER (in_a AND in_b) AS gain_ms, avg(gain) FILTER (in_a AND in_b) AS mean_gain_ms FROM x GROUP BY task)"""
register("M14_paired", lambda s, d: M.paired_outcomes(scores(s, d, 0.6), scores(s, d, 0.8), ["conv_id", "task", "speaker", "t_ms"]), f"{_PAIRED} SELECT * FROM pa")


def advancement(s, d) -> DataFrame:
    a, b = scores(s, d, 0.6), scores(s, d, 0.8)
    return M.advancement(M.summarize(a, ["task"]), M.summarize(b, ["task"]), M.paired_outcomes(a, b, ["conv_id", "task", "speaker", "t_ms"]))


register(
    "M14_advancement",
    advancement,
    f"""{_PAIRED}, sa AS (SELECT task, {RATES} FROM sc GROUP BY task), sb AS (SELECT task, {RATES} FROM sc_2 GROUP BY task)
    SELECT task, coalesce(sb.fp_rate <= 0.1, false) AS fp_ok, coalesce(sb.recall >= sa.recall - 0.005, false) AS recall_ok, coalesce(gain_ms >= 16, false) AS gain_ok, sb.recall - sa.recall AS recall_delta,
    coalesce(sb.fp_rate <= 0.1, false) AND coalesce(sb.recall >= sa.recall - 0.005, false) AND coalesce(gain_ms >= 16, false) AS passed FROM sa JOIN sb USING (task) JOIN pa USING (task)""",
)


def _labelled(s, d):
    return table(s, d, "labels").join(table(s, d, "documents").select("doc_id", "n_chars", "lang"), "doc_id")


register(
    "M15_auc",
    lambda s, d: M.auc(_labelled(s, d), "quality", "n_chars", ("lang",)),
    """WITH j AS (SELECT lang, quality, n_chars FROM labels JOIN documents USING (doc_id)),
    r AS (SELECT *, rank() OVER (PARTITION BY lang ORDER BY n_chars) + (count(*) OVER (PARTITION BY lang, n_chars) - 1) / 2.0::DOUBLE AS rk FROM j)
    SELECT lang, (sum(CASE WHEN quality = 1 THEN rk END) - sum(quality) * (sum(quality) + 1) / 2.0::DOUBLE) / nullif(sum(quality)::DOUBLE * (count(*) - sum(quality)), 0) AS auc, count(*) AS n, sum(quality)::BIGINT AS positives FROM r GROUP BY lang""",
)


register(
    "M15_fpr_at_tpr",
    lambda s, d: M.fpr_at_tpr(_labelled(s, d), "quality", "n_chars", 0.9, ("lang",)),
    """WITH j AS (SELECT lang, quality, n_chars FROM labels JOIN documents USING (doc_id)), c AS (SELECT lang, quantile_cont(n_chars::DOUBLE, 0.1) AS cut FROM j WHERE quality = 1 GROUP BY lang)
    SELECT lang, avg(CASE WHEN quality = 0 THEN (n_chars >= cut)::INT END) AS fpr FROM j JOIN c USING (lang) GROUP BY lang""",
)


def bootstrap(s, d) -> DataFrame:
    """Speakers as systems, conversations in twenty groups."""
    rows = settle(scores(s, d).select(F.pmod("conv_id", F.lit(20)).alias("grp"), F.col("speaker").alias("system"), "outcome", "latency_ms"), "outcomes")
    counts = rows.groupBy("grp", "system").agg(*[F.count_if(F.col("outcome") == k).alias(k.lower()) for k in ("TP", "FN", "FP", "TN")])
    latencies = rows.where("latency_ms IS NOT NULL").groupBy("grp", "system", "latency_ms").agg(F.count("*").alias("n"))
    out = M.cluster_bootstrap(counts, latencies, "grp", "system", 200, 1)
    return out.withColumns({c: F.round(c, 6) for c in ("value", "low", "high", "diff", "low_diff", "high_diff")})


register(
    "M13_bootstrap",
    bootstrap,
    f"""{_ALL}, r AS MATERIALIZED (SELECT conv_id % 20 AS grp, speaker AS system, outcome, latency_ms FROM sc),
    g AS MATERIALIZED (SELECT grp, row_number() OVER (ORDER BY sha256('boot:' || grp)) - 1 AS no, count(*) OVER () AS n FROM (SELECT DISTINCT grp FROM r)),
    w0 AS (SELECT rep, ('0x' || substr(md5(rep || ':' || no), 1, 8))::BIGINT % n AS no FROM g, (SELECT unnest(range(200)) AS rep)),
    w AS MATERIALIZED (SELECT rep, grp, count(*) AS w FROM w0 JOIN g USING (no) GROUP BY ALL UNION ALL SELECT -1, grp, 1 FROM g),
    c AS (SELECT grp, system, count(*) FILTER (outcome = 'TP') AS tp, count(*) FILTER (outcome = 'FN') AS fn, count(*) FILTER (outcome = 'FP') AS fp, count(*) FILTER (outcome = 'TN') AS tn FROM r GROUP BY ALL),
    ra AS (SELECT rep, system, sum(w * tp)::DOUBLE / nullif(sum(w * (tp + fn)), 0) AS recall, sum(w * fp)::DOUBLE / nullif(sum(w * (fp + tn)), 0) AS fp_rate FROM w JOIN c USING (grp) GROUP BY ALL),
    la AS (SELECT rep, system, quantile_cont(latency_ms::DOUBLE, 0.5) AS p50_ms FROM (SELECT rep, system, latency_ms, unnest(range(w)) FROM w JOIN r USING (grp) WHERE latency_ms IS NOT NULL) GROUP BY ALL),
    l AS MATERIALIZED (SELECT rep, system, unnest(['recall', 'fp_rate', 'p50_ms']) AS metric, unnest([recall, fp_rate, p50_ms]) AS value FROM ra LEFT JOIN la USING (rep, system)),
    b AS (SELECT l.*, l.value - o.value AS diff FROM l LEFT JOIN l o ON o.rep = l.rep AND o.metric = l.metric AND o.system = 1)
    SELECT system, metric, round(max(value) FILTER (rep < 0), 6) AS value, round(quantile_cont(value, 0.025) FILTER (rep >= 0), 6) AS low, round(quantile_cont(value, 0.975) FILTER (rep >= 0), 6) AS high,
    round(max(diff) FILTER (rep < 0), 6) AS diff, round(quantile_cont(diff, 0.025) FILTER (rep >= 0), 6) AS low_diff, round(quantile_cont(diff, 0.975) FILTER (rep >= 0), 6) AS high_diff, count(value) FILTER (rep >= 0) AS valid FROM b GROUP BY system, metric""",
)
