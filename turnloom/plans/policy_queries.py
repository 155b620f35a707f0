"""Queries of the turn policies, overlap geometry, turn candidates and training targets of turn ends, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from turnloom.functions import text as T
from turnloom.operators import candidates as Q
from turnloom.operators import frames as R
from turnloom.operators import intervals as I
from turnloom.operators import policy as P
from turnloom.operators import scoring as M
from turnloom.operators import selection
from turnloom.plans.commit_queries import GOLD, _canon, gold
from turnloom.plans.corpus_queries import NORM
from turnloom.plans.fixtures import SEG, frames, frames_sql, segments
from turnloom.plans.registry import register

FR = frames_sql()
KEY = ["conv_id", "speaker"]
POLICY = P.Policy(eot_th=0.9, int_th=0.7)


def voices(s, d):
    """Vocalisations: segments less than 200 ms apart are one."""
    return I.union_intervals(segments(s, d), KEY, 200, inclusive=False)


def durations(s, d):
    return segments(s, d).groupBy("conv_id").agg(F.max("end_ms").alias("duration_ms"))


VOICES = """vm AS (SELECT *, max(end_ms) OVER (PARTITION BY conv_id, speaker ORDER BY start_ms, end_ms ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM seg),
vr AS (SELECT *, sum(CASE WHEN reach IS NULL OR start_ms - reach >= 200 THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id, speaker ORDER BY start_ms, end_ms) AS run FROM vm),
vo AS (SELECT conv_id, speaker, min(start_ms) AS a, max(end_ms) AS b FROM vr GROUP BY conv_id, speaker, run),
du AS (SELECT conv_id, max(end_ms) AS dur FROM seg GROUP BY conv_id)"""


def eot_sql(theta: float, deadline: int = 2500, confirm: int = 2500, voices: str = VOICES) -> str:
    """The rule as it is told: a resumption that lasts 500 ms cancels, the other's 200 ms of voice or the score commit early. A theta above 1 is no score."""
    return f"""{voices}, hit AS (SELECT conv_id, speaker, (i + 1) * 80 AS seen FROM fr WHERE eot >= {theta}),
c0 AS (SELECT v.conv_id, v.speaker, v.b AS t, min(n.a) + 500 AS cancel FROM vo v LEFT JOIN vo n ON n.conv_id = v.conv_id AND n.speaker = v.speaker AND n.a > v.b
       AND n.a - v.b <= {max(deadline, confirm)} AND n.a + 500 <= n.b + 200 GROUP BY ALL),
c1 AS (SELECT c0.*, min(greatest(o.a + 200, t + 800)) FILTER (o.a IS NOT NULL) AS taken FROM c0 LEFT JOIN vo o ON o.conv_id = c0.conv_id AND o.speaker = 3 - c0.speaker
       AND o.b >= t - 200 AND o.a <= t + {deadline} AND greatest(o.a + 200, t + 800) <= o.b + 200 GROUP BY ALL),
c2 AS (SELECT c1.conv_id, c1.speaker, t, cancel, taken, min(greatest(seen, t + 480)) FILTER (seen IS NOT NULL) AS told FROM c1 LEFT JOIN hit ON hit.conv_id = c1.conv_id AND hit.speaker = c1.speaker
       AND seen >= t + 160 AND seen <= least(t + {deadline}, coalesce(cancel, t + {deadline})) GROUP BY ALL),
c3 AS (SELECT *, least(t + {deadline}, coalesce(taken, t + {deadline}), coalesce(told, t + {deadline}), dur) AS at_ FROM c2 JOIN du USING (conv_id)),
ev AS (SELECT conv_id, speaker, at_ AS t_ms FROM c3 WHERE cancel IS NULL OR at_ < cancel
       UNION SELECT conv_id, speaker, t + {confirm} FROM c3 WHERE (cancel IS NULL OR (at_ < cancel AND t + {confirm} < cancel)) AND t + {confirm} <= dur)"""


register("C05_eot_policy", lambda s, d: P.turn_ends(voices(s, d), durations(s, d), POLICY, frames(s, d)), f"WITH {SEG}, {FR}, {eot_sql(0.9)} SELECT * FROM ev")
register("C05_eot_rules", lambda s, d: P.turn_ends(voices(s, d), durations(s, d), POLICY), f"WITH {SEG}, {FR}, {eot_sql(2)} SELECT * FROM ev")
_FEW = [(None, 1000, 2500), (None, 2500, 1800), (0.7, 2500, 2500), (0.9, 1800, 2500), (0.95, 2500, 3200)]


def few_policies(s, d):
    rows = [P.grid_row(f"p{n}", P.Policy(eot_th=theta, deadline=deadline, confirm=confirm)) for n, (theta, deadline, confirm) in enumerate(_FEW)]
    return P.turn_end_grid(segments(s, d).select(*KEY, "start_ms", "end_ms"), durations(s, d), s.createDataFrame(rows, P.GRID), frames(s, d))


register(
    "C05_grid",
    few_policies,
    f"WITH {SEG}, {FR} " + " UNION ALL ".join(
        f"SELECT 'p{n}' AS policy, * FROM (WITH {eot_sql(2 if theta is None else theta, deadline, confirm)} SELECT * FROM ev)" for n, (theta, deadline, confirm) in enumerate(_FEW)
    ),
)


def policy_grid(s, d):
    """108 policies, rules alone and rules with the score, scored in one plan; the best of each family for each budget and cap of latency."""
    points = [
        (theta, P.Policy(min_gap=gap, min_wait=wait, mw_model=model, deadline=deadline, eot_th=theta))
        for theta in (None, 0.5, 0.7, 0.8, 0.9, 0.95) for gap in (200, 320) for wait in (600, 800, 1000) for model in (320, 480) for deadline in (1800, 2500) if theta is not None or model == 480
    ]
    rows = [("rules" if theta is None else "rules+score", *P.grid_row(f"{n:03d}", p)) for n, (theta, p) in enumerate(points)]
    table_ = s.createDataFrame(rows, f"family string, {P.GRID}")
    policies = table_.drop("family")
    channels = P.turn_end_channels(segments(s, d).select(*KEY, "start_ms", "end_ms"), durations(s, d), policies, frames(s, d))
    summary = M.event_totals(gold(s, d).where("task = 'eot'"), channels, ["policy"], (), table_.select("policy"), lambda met: P.end_fires(met, policies))
    return selection.pick_policies(summary.join(table_.select("policy", "family"), "policy"), [0.1, 0.5, 1.0], [500.0, 1e9])


register("M11_policy_grid", policy_grid)
register(
    "C06_int_policy",
    lambda s, d: P.floor_taken(voices(s, d), POLICY, frames(s, d)),
    f"""WITH {SEG}, {FR}, {VOICES}, x AS (SELECT vo.*, min((i + 1) * 80) AS seen FROM vo LEFT JOIN fr ON fr.conv_id = vo.conv_id AND fr.speaker = vo.speaker AND int >= 0.7
      AND (i + 1) * 80 >= a + 160 AND (i + 1) * 80 <= least(b + 200, a + 1000) GROUP BY ALL),
    f AS (SELECT conv_id, speaker, coalesce(seen, CASE WHEN a + 1000 <= b + 200 THEN a + 1000 END) AS t_ms FROM x) SELECT DISTINCT * FROM f WHERE t_ms IS NOT NULL""",
)

# Geometry in SQL: runs by gaps of 500 and chains by gaps of 700, looked up by plain joins.
GEOMETRY = """s0 AS (SELECT DISTINCT conv_id, speaker, start_ms, end_ms FROM seg),
g0 AS (SELECT *, max(end_ms) OVER (PARTITION BY conv_id, speaker ORDER BY start_ms, end_ms ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM s0),
g1 AS (SELECT *, sum(CASE WHEN reach IS NULL OR start_ms - reach > 500 THEN 1 ELSE 0 END) OVER w AS run, sum(CASE WHEN reach IS NULL OR start_ms - reach > 700 THEN 1 ELSE 0 END) OVER w AS chain
       FROM g0 WINDOW w AS (PARTITION BY conv_id, speaker ORDER BY start_ms, end_ms)),
g2 AS (SELECT conv_id, speaker, run, min(chain) AS chain, min(start_ms) AS ra, max(end_ms) AS rb FROM g1 GROUP BY ALL),
g3 AS (SELECT g1.conv_id, g1.speaker, g1.start_ms, g1.end_ms, own.rb AS own_end, o.rb AS run_end, o.chain AS ochain FROM g1 JOIN g2 own USING (conv_id, speaker, run)
       JOIN g2 o ON o.conv_id = g1.conv_id AND o.speaker = 3 - g1.speaker AND o.ra < g1.start_ms AND o.rb > g1.start_ms + 100),
g4 AS (SELECT g3.*, greatest(max(run_end), max(n.end_ms)) AS last_ FROM g3 JOIN g1 n ON n.conv_id = g3.conv_id AND n.speaker = 3 - g3.speaker AND n.chain = ochain AND n.start_ms < own_end GROUP BY ALL),
ge AS (SELECT seg.*, CASE WHEN last_ IS NULL THEN 'none' WHEN last_ - seg.start_ms <= 900 THEN 'overlap' WHEN last_ < own_end - 300 THEN 'took' WHEN seg.end_ms - seg.start_ms < 1000 THEN 'short' ELSE 'failed' END AS geometry
       FROM seg LEFT JOIN g4 ON g4.conv_id = seg.conv_id AND g4.speaker = seg.speaker AND g4.start_ms = seg.start_ms AND g4.end_ms = seg.end_ms)"""
_AT = ["conv_id", "turn", "k"]
register(
    "I10_geometry",
    lambda s, d: I.overlap_geometry(segments(s, d)).select(*_AT, "geometry", I.geometry_label(F.col("geometry")).alias("geometry_label")),
    f"""WITH {SEG}, {GEOMETRY} SELECT conv_id, turn, k, geometry, CASE geometry WHEN 'none' THEN 'Normal Turn' WHEN 'overlap' THEN 'Overlap' WHEN 'took' THEN 'Floor-taking Competitive Interruption'
    WHEN 'short' THEN 'Acknowledgement Backchannel' ELSE 'Non-floor Taking Competitive Interruption' END AS geometry_label FROM ge""",
)
#: The first words of each text, so that the short utterances that the lexicons know occur, beside the texts as they are.
_SAID = "CASE WHEN (conv_id + k) % 3 = 0 THEN concat(element_at(array('Um,', 'Mhm.', 'Oh really?', 'Yeah, I see', 'uh-huh', '...'), cast((conv_id + turn) % 6 + 1 as int)), ' ') ELSE text END"
_SAID_SQL = "CASE WHEN (conv_id + k) % 3 = 0 THEN ['Um,', 'Mhm.', 'Oh really?', 'Yeah, I see', 'uh-huh', '...'][(conv_id + turn) % 6 + 1] || ' ' ELSE text END"


def lexical_sql(said: str) -> str:
    """The lexical class of a text, from the listed words."""
    marks = "'.,?!;:" + chr(34) + "'" * 3
    bare = rf"list_transform(regexp_extract_all({said}, '[^ \t\n\r\f]+'), lambda w: lower(trim(w, {marks})))"
    w = f"list_filter({bare}, lambda w: w <> '')"
    within = lambda *lists: f"len(list_filter(ws, lambda w: NOT list_contains({[x for y in lists for x in y]}, w))) = 0"
    some = lambda listed: f"len(list_filter(ws, lambda w: list_contains({listed}, w))) > 0"
    return f"""(SELECT CASE WHEN len(ws) = 0 THEN 'empty' WHEN {within(T.FILLERS)} THEN 'filler' WHEN len(ws) > 3 OR NOT {within(T.CONTINUERS, T.REACTIONS, T.ACKS)} THEN 'other'
    WHEN {some(T.CONTINUERS)} THEN 'continuer' WHEN {some(T.REACTIONS)} THEN 'reaction' ELSE 'ack' END FROM (SELECT {w} AS ws))"""


register(
    "F07_lexical_class",
    lambda s, d: segments(s, d).select(*_AT, T.lexical_class(F.expr(_SAID)).alias("cls"), T.lexical_class(F.col("text")).alias("own")),
    f"WITH {SEG} SELECT conv_id, turn, k, {lexical_sql(_SAID_SQL)} AS cls, {lexical_sql('text')} AS own FROM seg",
)
register(
    "I12_rule_judge",
    lambda s, d: I.overlap_geometry(segments(s, d)).select(*_AT, I.rule_judge(F.col("geometry"), T.lexical_class(F.expr(_SAID))).alias("judged")),
    f"""WITH {SEG}, {GEOMETRY}, lx AS (SELECT *, {lexical_sql(_SAID_SQL)} AS cls FROM ge)
    SELECT conv_id, turn, k, CASE WHEN cls = 'empty' THEN 'Speech, Non-Linguistic' WHEN cls = 'filler' THEN 'Filler' WHEN geometry <> 'none' AND cls = 'continuer' THEN 'Continuer Backchannel'
    WHEN geometry <> 'none' AND cls = 'reaction' THEN 'Reaction Backchannel' WHEN geometry <> 'none' AND cls = 'ack' THEN 'Acknowledgement Backchannel'
    WHEN geometry IN ('short', 'failed') THEN 'Non-floor Taking Competitive Interruption' WHEN geometry = 'took' THEN 'Floor-taking Competitive Interruption' WHEN geometry = 'overlap' THEN 'Overlap'
    ELSE 'Normal Turn' END AS judged FROM lx""",
)


def _claims(s, d):
    return _canon(s, d).where("canonical IN ('Turn', 'Interruption')").select("conv_id", "speaker", "start_ms", "end_ms", "text")


def _norm(text: str) -> str:
    return NORM.replace("lower(text)", f"lower({text})")


_BARE = r"regexp_replace(text, '\[[^\]]*\]', ' ', 'g')"
register(
    "J04_candidates",
    lambda s, d: Q.turn_candidates(_claims(s, d)).withColumn("t_ms", F.round("t_ms", 3)),
    rf"""WITH {SEG}, a0 AS (SELECT conv_id, speaker, start_ms, end_ms, {_BARE} AS tx FROM canon WHERE canonical IN ('Turn', 'Interruption')),
    a1 AS (SELECT *, CASE WHEN speaker <> lag(speaker) OVER (PARTITION BY conv_id ORDER BY start_ms, speaker) THEN 1 ELSE 0 END AS nw FROM a0 WHERE {_norm('tx')} <> ''),
    a2 AS (SELECT *, sum(nw) OVER (PARTITION BY conv_id ORDER BY start_ms, speaker) AS run FROM a1),
    a3 AS (SELECT *, row_number() OVER (PARTITION BY conv_id, run ORDER BY start_ms) AS nth, count(*) OVER (PARTITION BY conv_id, run) AS many_, regexp_extract_all(tx, '[^ \t\n\r\f]+') AS tk,
           regexp_split_to_array(tx, '[^ \t\n\r\f]+') AS bl FROM a2),
    a4 AS (SELECT *, tk[j] AS tok, bl[j] AS blank FROM (SELECT *, unnest(generate_series(1, len(tk))) AS j FROM a3)),
    a5 AS (SELECT *, sum(length(blank) + length(tok)) OVER (PARTITION BY conv_id, run, nth ORDER BY j) AS upto,
           sum(({_norm('tok')} <> '')::INT) OVER (PARTITION BY conv_id, run ORDER BY nth, j)::BIGINT AS n_words FROM a4),
    e AS (SELECT conv_id, run, speaker, nth, many_, max(n_words) AS n_words, max(end_ms)::DOUBLE AS t_ms FROM a5 GROUP BY ALL),
    u AS (SELECT conv_id, run, speaker, n_words, start_ms + (end_ms - start_ms) * upto / greatest(length(tx), 1)::DOUBLE AS t_ms, 'mid' AS kind, nth, j AS place FROM a5
          WHERE {_norm('tok')} <> '' AND regexp_matches(tok, '[,.?!;]$') AND upto < length(regexp_replace(tx, '[ \t\n\r\f]+$', '')) - 1
          UNION ALL SELECT conv_id, run, speaker, n_words, t_ms, 'pause', nth, 1 << 30 FROM e WHERE nth < many_),
    q AS (SELECT u.*, row_number() OVER (PARTITION BY u.conv_id, u.run, u.n_words ORDER BY u.nth, u.place) AS f, e.n_words AS all_ FROM u JOIN e ON e.conv_id = u.conv_id AND e.run = u.run AND e.nth = e.many_),
    k AS (SELECT *, row_number() OVER (PARTITION BY conv_id, run ORDER BY n_words) - 1 AS rk, count(*) OVER (PARTITION BY conv_id, run) AS m FROM q WHERE f = 1 AND n_words >= 2 AND n_words <> all_)
    SELECT conv_id, run::BIGINT AS run, speaker, n_words, round(t_ms, 3) AS t_ms, kind FROM k WHERE m <= 11 OR list_contains(list_transform(generate_series(0, 10), lambda i: round_even(i * (m - 1) / 10.0::DOUBLE, 0)::BIGINT), rk)
    UNION ALL SELECT conv_id, run::BIGINT, speaker, n_words, round(t_ms, 3), 'end' FROM e WHERE nth = many_""",
)


def _eot_gold(s, d):
    """Turn ends and pauses, and every eleventh piece of a turn as a disputed span."""
    g = gold(s, d).where("task = 'eot'").select("conv_id", "kind", "speaker", "start_ms", "end_ms")
    return g.unionByName(segments(s, d).where("(conv_id + turn + k) % 11 = 0").select("conv_id", F.lit("excl").alias("kind"), "speaker", "start_ms", F.col("end_ms")))


register(
    "R09_eot_targets",
    lambda s, d: R.eot_targets(frames(s, d), _eot_gold(s, d), "vad", 80).withColumn("w", F.round("w", 9)),
    f"""WITH {SEG}, {FR}, {GOLD}, q0 AS (SELECT conv_id, speaker, i, (i + 1) * 80 AS t, vad < 0.5 AS quiet FROM fr),
    q1 AS (SELECT *, coalesce(lag(quiet) OVER w, false) AS was, sum((NOT quiet)::INT) OVER w AS ep FROM q0 WINDOW w AS (PARTITION BY conv_id, speaker ORDER BY i)),
    q2 AS (SELECT *, count(*) OVER (PARTITION BY conv_id, speaker, ep, quiet) AS n FROM q1),
    an AS (SELECT DISTINCT conv_id, speaker, start_ms AS anchor FROM gold WHERE task = 'eot' AND kind = 'pos'),
    r0 AS (SELECT an.*, min(q1.t) AS again FROM an LEFT JOIN q1 ON q1.conv_id = an.conv_id AND q1.speaker = an.speaker AND q1.t > anchor AND q1.t <= anchor + 2500 AND NOT quiet AND was GROUP BY ALL),
    re AS (SELECT *, least(anchor + 2500, coalesce(again, anchor + 2500)) AS stop FROM r0),
    wi AS (SELECT conv_id, speaker, anchor AS lo, stop - 1 AS hi, 2 AS rank FROM re UNION SELECT conv_id, speaker, start_ms, end_ms, 1 FROM gold WHERE task = 'eot' AND kind = 'neg'
           UNION SELECT conv_id, speaker, start_ms, end_ms, 3 FROM seg WHERE (conv_id + turn + k) % 11 = 0),
    mx AS (SELECT wi.*, i, 1.0::DOUBLE / count(*) OVER (PARTITION BY wi.conv_id, wi.speaker, rank, lo, hi) AS share FROM wi JOIN q0 ON q0.conv_id = wi.conv_id AND q0.speaker = wi.speaker AND t >= lo AND t <= hi AND (quiet OR rank = 3)),
    be AS (SELECT conv_id, speaker, i, max(row(rank, lo, share)) AS m, bool_or(rank = 2) AS yes FROM mx GROUP BY ALL)
    SELECT q2.conv_id, q2.speaker, q2.i, CASE WHEN yes THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS y,
    round(CASE WHEN m[1] = 3 THEN 0.0::DOUBLE WHEN m IS NOT NULL THEN m[3] WHEN quiet AND ep > 0 THEN 0.02::DOUBLE / n ELSE 0.0::DOUBLE END, 9) AS w FROM q2 LEFT JOIN be ON be.conv_id = q2.conv_id AND be.speaker = q2.speaker AND be.i = q2.i""",
)
