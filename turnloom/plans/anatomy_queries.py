"""Queries of breakdowns, sources and streams, with their SQL where there is one."""

from __future__ import annotations


from pyspark.sql import functions as F

from turnloom.functions import vocab
from turnloom.operators import anatomy as A
from turnloom.operators import commit as C
from turnloom.operators import scoring as M
from turnloom.plans.commit_queries import GOLD, _ALL, _canon, gold, preds, scores
from turnloom.plans.fixtures import SEG, frames, frames_sql, segments, table
from turnloom.plans.frame_queries import _ACT, active
from turnloom.plans.registry import register
from turnloom.sources import io
from turnloom.sources.settle import shared_path

FR = frames_sql()
CH = "PARTITION BY conv_id, speaker ORDER BY i"
register("A01_rates", lambda s, d: A.rate_table(scores(s, d), F.col("speaker"), F.col("outcome").isin("TP", "TN")), f"{_ALL} SELECT speaker AS level, count(*) AS n, avg((outcome IN ('TP', 'TN'))::INT) AS rate FROM sc GROUP BY speaker")
def _three(s, d):
    """Three annotators' segments: the second marks ends up to 0.4 s late, the third leaves every fifth out."""
    seg = segments(s, d)
    late = F.expr("end_ms + 200 * ((conv_id + k) % 3)")
    a = seg.select("conv_id", F.lit("a").alias("annotator"), "speaker", "start_ms", "end_ms", "label", "text").where("(conv_id + turn) % 4 <> 0")
    b = seg.select("conv_id", F.lit("b").alias("annotator"), "speaker", "start_ms", late.alias("end_ms"), F.col("label_b").alias("label"), "text")
    c = seg.where("(turn + k) % 5 <> 0").select("conv_id", F.lit("c").alias("annotator"), "speaker", "start_ms", "end_ms", F.col("label_c").alias("label"), "text")
    return a.unionByName(b).unionByName(c).withColumn("canonical", vocab.canonical(F.col("label")))


def _windows(s, d):
    return M.match_windows(gold(s, d)).where("task = 'eot'")


register(
    "A02_turn_ends",
    lambda s, d: A.turn_end_residuals(scores(s, d), _windows(s, d), preds(s, d), frames(s, d), "eot", _three(s, d), ["a", "b", "c"], 80),
    rf"""{_ALL}, an AS (SELECT conv_id, 1 AS who, speaker, start_ms, end_ms, label, text FROM seg WHERE (conv_id + turn) % 4 <> 0 UNION ALL SELECT conv_id, 2, speaker, start_ms, end_ms + 200 * ((conv_id + k) % 3), label_b, text FROM seg
      UNION ALL SELECT conv_id, 3, speaker, start_ms, end_ms, label_c, text FROM seg WHERE (turn + k) % 5 <> 0),
    po AS (SELECT sc.*, lo_ms, hi_ms FROM sc JOIN win USING (conv_id, task, speaker, t_ms) WHERE outcome IN ('TP', 'FN')),
    pk AS (SELECT po.conv_id, po.speaker, po.t_ms, max(eot) AS peak FROM po JOIN fr ON fr.conv_id = po.conv_id AND fr.speaker = po.speaker AND i BETWEEN greatest(lo_ms, 0) // 80 AND hi_ms // 80 GROUP BY ALL),
    nr AS (SELECT po.conv_id, po.speaker, po.t_ms, min(row(who, abs(an.end_ms - t_ms), an.start_ms, an.end_ms, label, text)) AS m, count(DISTINCT CASE WHEN abs(an.end_ms - t_ms) <= 250 THEN who END) AS agree
      FROM po JOIN an ON an.conv_id = po.conv_id AND an.speaker = po.speaker AND abs(an.end_ms - t_ms) <= 500 GROUP BY ALL),
    gp AS (SELECT po.conv_id, po.speaker, po.t_ms, min(canon.start_ms) - po.t_ms AS gap_ms FROM po JOIN canon ON canon.conv_id = po.conv_id AND canon.speaker = 3 - po.speaker AND canonical IN ('Turn', 'Interruption')
      AND (canon.conv_id + canon.turn) % 4 <> 0 AND canon.start_ms > t_ms - 3000 AND canon.end_ms > t_ms GROUP BY po.conv_id, po.speaker, po.t_ms),
    ls AS (SELECT *, list_filter(list_transform(regexp_extract_all(m[6], '[^ \t\n\r\f]+'), lambda w: lower(trim(w, '.,?!;:' || chr(34) || chr(39)))), lambda w: w <> '') AS ws FROM nr)
    SELECT po.conv_id, po.task, po.speaker, po.outcome, po.t_ms, po.latency_ms, coalesce(peak, 0) AS peak, EXISTS (SELECT 1 FROM pr WHERE pr.conv_id = po.conv_id AND pr.speaker = po.speaker AND pr.t_ms >= po.t_ms - 3000 AND pr.t_ms < po.t_ms - 250) AS fired_before,
    m[5] AS label, m[4] - m[3] AS dur_ms, array_to_string(ws[greatest(len(ws) - 1, 1):], ' ') AS last, coalesce(agree, 0) AS agree, gap_ms
    FROM po LEFT JOIN pk USING (conv_id, speaker, t_ms) LEFT JOIN ls USING (conv_id, speaker, t_ms) LEFT JOIN gp USING (conv_id, speaker, t_ms)""",
)
register(
    "A02_pauses",
    lambda s, d: A.pause_residuals(scores(s, d), gold(s, d).where("task = 'eot'"), preds(s, d), _canon(s, d)),
    f"""{_ALL}, ng AS (SELECT DISTINCT conv_id, speaker, start_ms, end_ms FROM gold WHERE task = 'eot' AND kind = 'neg')
    SELECT ng.*, x IS NOT NULL AS fired, end_ms - start_ms AS dur_ms, x - start_ms AS fire_after_ms, prev_label,
      EXISTS (SELECT 1 FROM canon o WHERE o.conv_id = ng.conv_id AND o.speaker = 3 - ng.speaker AND canonical = 'Backchannel' AND o.start_ms < ng.end_ms AND o.end_ms > ng.start_ms) AS other_backchannel
    FROM ng LEFT JOIN (SELECT ng.conv_id, ng.speaker, ng.start_ms, ng.end_ms, min(t_ms) AS x FROM ng JOIN pr ON pr.conv_id = ng.conv_id AND pr.speaker = ng.speaker AND t_ms BETWEEN ng.start_ms AND ng.end_ms GROUP BY ALL) USING (conv_id, speaker, start_ms, end_ms)
    LEFT JOIN (SELECT ng.conv_id, ng.speaker, ng.start_ms, ng.end_ms, min(row(abs(seg.end_ms - ng.start_ms), seg.end_ms, label))[3] AS prev_label FROM ng JOIN seg ON seg.conv_id = ng.conv_id AND seg.speaker = ng.speaker AND abs(seg.end_ms - ng.start_ms) <= 300
      GROUP BY ng.conv_id, ng.speaker, ng.start_ms, ng.end_ms) USING (conv_id, speaker, start_ms, end_ms)""",
)
register(
    "A03_miss_causes",
    lambda s, d: A.miss_causes(scores(s, d), _windows(s, d), frames(s, d), "eot", 0.6, 80),
    f"""{_ALL}, po AS (SELECT sc.*, greatest(lo_ms, 0) // 80 AS f, ceil(hi_ms / 80.0)::BIGINT - 1 AS l FROM sc JOIN win USING (conv_id, task, speaker, t_ms) WHERE outcome IN ('TP', 'FN')),
    e AS (SELECT po.conv_id, po.speaker, po.t_ms, outcome, max(eot) FILTER (i >= f) AS peak, max(eot) FILTER (i = f) AS begins, max(eot) FILTER (i = f - 1) AS before FROM po JOIN fr ON fr.conv_id = po.conv_id AND fr.speaker = po.speaker AND i BETWEEN f - 1 AND l GROUP BY ALL),
    c AS (SELECT *, CASE WHEN outcome = 'TP' THEN 'hit' WHEN begins > 0.6 AND before > 0.6 THEN 'prefired' WHEN peak > 0.6 THEN 'refractory' ELSE 'never' END AS cause FROM e WHERE peak IS NOT NULL)
    SELECT 'eot' AS task, cause, count(*) AS n, {', '.join(f"quantile_cont(CASE WHEN cause = 'never' THEN peak END, {q / 100}) AS peak_{q}" for q in (10, 25, 50, 75, 90))} FROM c GROUP BY cause""",
)


def _types(s, d):
    return segments(s, d).select("conv_id", F.concat(F.lit("t"), F.col("conv_id") % 4).alias("type")).distinct()


def _lengths(s, d):
    return gold(s, d).where("task = 'eot' AND kind = 'neg'").select("conv_id", "speaker", F.col("start_ms").alias("t_ms"), (F.col("end_ms") - F.col("start_ms")).alias("dur_ms")).distinct()


register(
    "A04_by_type",
    lambda s, d: A.anatomy_by_type(scores(s, d), _lengths(s, d), _types(s, d)),
    f"""{_ALL}, ln AS (SELECT DISTINCT conv_id, speaker, start_ms AS t_ms, end_ms - start_ms AS dur FROM gold WHERE task = 'eot' AND kind = 'neg'),
    j AS (SELECT sc.*, CASE WHEN outcome IN ('FP', 'TN') THEN dur END AS dur_ms FROM sc LEFT JOIN ln USING (conv_id, speaker, t_ms))
    SELECT 't' || conv_id % 4 AS type, outcome, count(*) AS n, quantile_cont(latency_ms::DOUBLE, 0.5) AS p50_ms, {', '.join(f"quantile_cont(dur_ms::DOUBLE, {q / 100}) AS dur_{q}" for q in (10, 50, 90))} FROM j GROUP BY ALL""",
)
register(
    "A05_corpus_stats",
    lambda s, d: A.corpus_stats(
        gold(s, d), segments(s, d).groupBy("conv_id").agg(F.max("end_ms").alias("duration_ms")), _types(s, d), segments(s, d).groupBy("conv_id").agg(F.avg((F.col("label") == F.col("label_b")).cast("double")).alias("agreement"))
    ),
    f"""WITH {SEG}, {GOLD}, e AS (SELECT conv_id, max(end_ms) AS dur, avg((label = label_b)::INT) AS agreement, (SELECT count(*) FROM gold g WHERE g.conv_id = seg.conv_id AND kind = 'pos') AS events FROM seg GROUP BY conv_id)
    SELECT 't' || conv_id % 4 AS type, count(*) AS conversations, sum(dur) / 60000.0::DOUBLE AS minutes, sum(events)::BIGINT AS events, sum(events) / (sum(dur) / 60000.0::DOUBLE) AS per_minute, avg(agreement) AS agreement FROM e GROUP BY 1""",
)
register(
    "A06_report_card",
    lambda s, d: A.report_card(table(s, d, "events").select(F.col("event_type").alias("condition"), F.when(F.col("event_type") == "view", "g1").otherwise("g2").alias("grp"), "value"), "view"),
    """WITH s AS (SELECT CASE WHEN event_type = 'view' THEN 'g1' ELSE 'g2' END AS grp, event_type AS condition, avg(value) AS value FROM events GROUP BY ALL), c AS (SELECT avg(value) AS clean FROM s WHERE condition = 'view')
    SELECT grp, avg(value) AS value, count(*) AS conditions, clean, clean - avg(value) AS drop FROM s, c GROUP BY grp, clean""",
)
register(
    "A08_level_gain",
    lambda s, d: A.level_gain(table(s, d, "events"), ["user_id"], "value", 12.0),
    """WITH t AS (SELECT user_id, quantile_cont(value, 0.95) AS p FROM events GROUP BY 1), r AS (SELECT user_id, sqrt(avg(value * value)) AS rms FROM events JOIN t USING (user_id) WHERE value >= p * power(10.0::DOUBLE, -1.5::DOUBLE) GROUP BY 1)
    SELECT *, rms * power(10.0::DOUBLE, -0.6::DOUBLE) AS gain FROM r""",
)
register(
    "A10_shuffle",
    lambda s, d: A.shuffle_control(segments(s, d).select("conv_id", "turn", "k", F.col("label").alias("kind"), F.expr("((conv_id * 31 + k * 7) % 11) / 10.0D").alias("v")), "kind", ["conv_id", "turn", "k"], "v", "sh"),
    f"""WITH {SEG}, a AS (SELECT conv_id, turn, k, label AS kind, ((conv_id * 31 + k * 7) % 11) / 10.0::DOUBLE AS v FROM seg), q AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY conv_id, turn, k) AS r FROM a),
    g AS (SELECT kind, v AS shuffled, row_number() OVER (PARTITION BY kind ORDER BY sha256('sh:' || conv_id || '/' || turn || '/' || k)) AS r FROM a) SELECT conv_id, turn, k, kind, v, shuffled FROM q JOIN g USING (kind, r)""",
)
register(
    "M17_false_events",
    lambda s, d: A.false_event_rate(C.rising_edges(frames(s, d), F.col("int"), F.lit(0.45)), active(s, d), 80),
    f"""WITH {SEG}, {FR}, {_ACT}, f AS (SELECT conv_id, speaker, i FROM (SELECT *, coalesce(lag(int) OVER ({CH}), 0) AS b FROM fr) WHERE int > 0.45 AND NOT b > 0.45),
    q AS (SELECT a.* FROM act a JOIN act b ON a.conv_id = b.conv_id AND a.speaker = 3 - b.speaker AND a.i = b.i AND a.active = 0 AND b.active = 1)
    SELECT q.speaker, count(f.i) AS fires, count(*) * 80 / 60000.0::DOUBLE AS minutes, count(f.i) / (count(*) * 80 / 60000.0::DOUBLE) AS per_minute FROM q LEFT JOIN f USING (conv_id, speaker, i) GROUP BY q.speaker""",
)


def _estimate(s, d):
    return frames(s, d).select("conv_id", F.when(F.col("conv_id") % 2 == 0, 3 - F.col("speaker")).otherwise(F.col("speaker")).alias("speaker"), "i", (F.col("vad") > 0.5).cast("int").alias("active"))


register(
    "M18_agreement",
    lambda s, d: A.activity_agreement(active(s, d), _estimate(s, d)),
    f"""WITH {SEG}, {FR}, {_ACT}, r AS (SELECT conv_id, i, max(CASE WHEN speaker = 1 THEN active END) AS r1, max(CASE WHEN speaker = 2 THEN active END) AS r2 FROM act GROUP BY ALL),
    e AS (SELECT conv_id, i, max(CASE WHEN (speaker = 1) = (conv_id % 2 <> 0) THEN (vad > 0.5)::INT END) AS e1, max(CASE WHEN (speaker = 2) = (conv_id % 2 <> 0) THEN (vad > 0.5)::INT END) AS e2 FROM fr GROUP BY ALL),
    x AS (SELECT conv_id, swap, r1, r2, CASE WHEN swap THEN e2 ELSE e1 END AS a, CASE WHEN swap THEN e1 ELSE e2 END AS b FROM r JOIN e USING (conv_id, i), (VALUES (false), (true)) v(swap)),
    p AS (SELECT conv_id, swap, sum((r1 = a)::INT + (r2 = b)::INT) / (2.0::DOUBLE * count(*)) AS accuracy, 2.0::DOUBLE * sum(r1 * a + r2 * b) / nullif(sum(r1 + r2 + a + b), 0) AS f1, sum(r1 * r2)::BIGINT AS overlap,
      sum(r1 * r2 * a * b)::DOUBLE / nullif(sum(r1 * r2), 0) AS overlap_recall FROM x GROUP BY ALL) SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY accuracy DESC, swap) = 1""",
)


def _members(s, d):
    f = frames(s, d).withColumn("member", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3)))).where("NOT (member = 2 AND i % 50 = 0)")
    return f.select("conv_id", "speaker", "i", "member", (F.col("eot") / F.col("member")).alias("p"))


register(
    "M19_aligned_mean",
    lambda s, d: A.aligned_mean(_members(s, d), ["conv_id", "speaker", "i"], "p", 3)[0],
    f"WITH {SEG}, {FR} SELECT conv_id, speaker, i, (eot + eot / 2 + eot / 3) / 3 AS mean FROM fr WHERE i % 50 <> 0",
)
register(
    "M19_violations",
    lambda s, d: A.aligned_mean(_members(s, d), ["conv_id", "speaker", "i"], "p", 3)[1],
    f"WITH {SEG}, {FR} SELECT conv_id, speaker, i FROM fr WHERE i % 50 = 0",
)


def _annotated(s, d):
    seg = segments(s, d).select("conv_id", "turn", "k", F.explode(F.array(*[F.struct(F.lit(a).alias("annotator"), F.col(c).alias("label")) for a, c in (("a", "label"), ("b", "label_b"), ("c", "label_c"))])).alias("x"))
    return seg.select("conv_id", "turn", "k", "x.*")


register(
    "M02_consensus",
    lambda s, d: A.consensus(_annotated(s, d), ["conv_id", "turn", "k"]),
    f"""WITH {SEG} SELECT conv_id, turn, k, CASE WHEN label = label_b OR label = label_c THEN label WHEN label_b = label_c THEN label_b END AS label,
    CASE WHEN label = label_b AND label_b = label_c THEN 1.0 WHEN label = label_b OR label = label_c OR label_b = label_c THEN 2 / 3.0::DOUBLE ELSE 1 / 3.0::DOUBLE END AS agreement FROM seg""",
)


def _pauses(s, d):
    gaps = segments(s, d).selectExpr("conv_id", "turn", "k", "end_ms", "speaker", "lead(start_ms) OVER (PARTITION BY conv_id ORDER BY turn, k) AS nxt", "lead(speaker) OVER (PARTITION BY conv_id ORDER BY turn, k) AS who").where("nxt - end_ms >= 100")
    at = gaps.selectExpr("concat_ws('/', conv_id, turn, k) AS span", "conv_id", "k", "end_ms", "CASE WHEN who = speaker THEN 'hold' ELSE 'eot' END AS label", "explode(sequence(100, nxt - end_ms, 100)) AS silence_ms")
    return at.withColumn("p", F.expr("((conv_id * 37 + k * 11 + silence_ms div 100 * 17) % 100) / 100.0D + CASE WHEN label = 'eot' THEN 0.2D ELSE 0D END"))


_DELAYS, _TIMEOUTS = list(range(200, 1001, 100)), list(range(1000, 3501, 500))
_PAUSES = f"""WITH {SEG}, g AS (SELECT *, lead(start_ms) OVER (PARTITION BY conv_id ORDER BY turn, k) AS nxt, lead(speaker) OVER (PARTITION BY conv_id ORDER BY turn, k) AS who FROM seg),
f AS (SELECT conv_id || '/' || turn || '/' || k AS span, conv_id, k, CASE WHEN who = speaker THEN 'hold' ELSE 'eot' END AS label, nxt - end_ms AS gap, unnest(generate_series(100, nxt - end_ms, 100)) AS silence_ms FROM g WHERE nxt - end_ms >= 100),
p AS MATERIALIZED (SELECT *, ((conv_id * 37 + k * 11 + silence_ms // 100 * 17) % 100) / 100.0::DOUBLE + CASE WHEN label = 'eot' THEN 0.2::DOUBLE ELSE 0 END AS p, max(silence_ms) OVER (PARTITION BY span) AS lasts FROM f),
q AS (SELECT * FROM p WHERE label = 'eot' OR lasts BETWEEN 200 AND 5000),
e AS (SELECT span, label, lasts, t AS k, delay, min(CASE WHEN silence_ms >= delay AND p > t / 50.0::DOUBLE - 1e-9 THEN silence_ms END) AS first,
      min(CASE WHEN p > t / 50.0::DOUBLE + 1e-9 THEN silence_ms END) AS any_ FROM q, (SELECT unnest(generate_series(0, 50)) AS t), (SELECT unnest({_DELAYS}) AS delay) GROUP BY ALL),
u AS (SELECT 'first' AS rule, span, label, lasts, k, delay, first AS at_ FROM e UNION ALL SELECT 'harness', span, label, lasts, k, delay, CASE WHEN any_ IS NOT NULL THEN greatest(delay, any_) END FROM e),
ps AS (SELECT rule, k::INT AS k, delay, timeout::INT AS timeout, count(*) FILTER (label = 'hold' AND (lasts > timeout OR coalesce(lasts > at_, false)))::DOUBLE / nullif(count(*) FILTER (label = 'hold'), 0) AS cutoff,
       avg(CASE WHEN label = 'eot' THEN CASE WHEN at_ <= timeout THEN at_ ELSE timeout END END) AS latency_ms FROM u, (SELECT unnest({_TIMEOUTS}) AS timeout) WHERE timeout >= delay GROUP BY rule, k, delay, timeout)"""


def pause_sweep(s, d):
    return A.pause_sweep(_pauses(s, d), 50, _DELAYS, _TIMEOUTS)


register("M16_pause_sweep", pause_sweep, f"{_PAUSES} SELECT * FROM ps")
register(
    "M16_pause_points",
    lambda s, d: A.pause_points(pause_sweep(s, d), [0.05, 0.1], [300, 600]),
    f"""{_PAUSES}, b AS (SELECT rule, min(latency_ms) FILTER (cutoff <= 0.05 + 1e-9) AS a1, min(latency_ms) FILTER (cutoff <= 0.1 + 1e-9) AS a2, min(cutoff) FILTER (latency_ms <= 300 + 1e-9) AS a3, min(cutoff) FILTER (latency_ms <= 600 + 1e-9) AS a4 FROM ps GROUP BY rule)
    SELECT rule, unnest(['latency@5%', 'latency@10%', 'cutoff@300ms', 'cutoff@600ms']) AS what, unnest([a1, a2, a3, a4]) AS value FROM b""",
)
register(
    "J02_validity_spans",
    lambda s, d: A.validity_spans(segments(s, d).selectExpr("conv_id", "speaker", "start_ms + 500 AS t_ms", "end_ms + 300 AS until_ms", "((conv_id * 31 + k * 7) % 11) / 10.0D AS value"), frames(s, d), 80),
    f"""WITH {SEG}, {FR}, q AS (SELECT conv_id, speaker, start_ms + 500 AS t_ms, end_ms + 300 AS until_ms, ((conv_id * 31 + k * 7) % 11) / 10.0::DOUBLE AS value FROM seg),
    l AS (SELECT fr.conv_id, fr.speaker, fr.i, max(row(t_ms, value))[2] AS live FROM fr JOIN q ON q.conv_id = fr.conv_id AND q.speaker = fr.speaker AND (i + 1) * 80 >= t_ms AND (i + 1) * 80 < until_ms GROUP BY ALL)
    SELECT fr.conv_id, fr.speaker, fr.i, live FROM fr LEFT JOIN l USING (conv_id, speaker, i)""",
)
register(
    "J02_validity",
    lambda s, d: A.validity_join(segments(s, d).select("conv_id", "speaker", F.col("end_ms").alias("t_ms"), F.expr("((conv_id * 31 + k * 7) % 11) / 10.0D").alias("value")), frames(s, d), 80),
    f"""WITH {SEG}, {FR}, q AS (SELECT conv_id, speaker, end_ms AS t_ms, ((conv_id * 31 + k * 7) % 11) / 10.0::DOUBLE AS value FROM seg), t AS (SELECT conv_id, speaker, i, (i + 1) * 80 AS t_ms FROM fr)
    SELECT t.conv_id, t.speaker, t.i, q.value AS live FROM t ASOF LEFT JOIN q ON t.conv_id = q.conv_id AND t.speaker = q.speaker AND t.t_ms >= q.t_ms""",
)


def _words(s, d):
    w = segments(s, d).select("conv_id", "start_ms", F.posexplode(F.regexp_extract_all("text", F.lit(r"\S+"), F.lit(0))).alias("j", "word"))
    return w.select("conv_id", (F.col("start_ms") + 300 * F.col("j") + 300).alias("end_ms"), "word")


register(
    "J03_context",
    lambda s, d: A.text_context(_words(s, d), segments(s, d).select("conv_id", F.col("end_ms").alias("t_ms")).distinct(), "conv_id", 300, 6),
    f"""WITH {SEG}, w AS (SELECT conv_id, start_ms + 300 * j AS end_ms, ws[j] AS word FROM (SELECT *, unnest(generate_series(1, len(ws))) AS j FROM (SELECT conv_id, start_ms, regexp_extract_all(text, '\\S+') AS ws FROM seg))),
    p AS (SELECT DISTINCT conv_id, end_ms AS t_ms FROM seg),
    r AS (SELECT p.conv_id, t_ms, w.end_ms, word, row_number() OVER (PARTITION BY p.conv_id, t_ms ORDER BY w.end_ms DESC, word DESC) AS n FROM p JOIN w ON w.conv_id = p.conv_id AND w.end_ms <= t_ms - 300)
    SELECT p.conv_id, p.t_ms, string_agg(word, ' ' ORDER BY r.end_ms, word) AS context FROM p LEFT JOIN r ON p.conv_id = r.conv_id AND p.t_ms = r.t_ms AND n <= 6 GROUP BY ALL""",
)


def _turn_words(s, d):
    w = segments(s, d).select("conv_id", "speaker", "turn", "start_ms", F.posexplode(F.regexp_extract_all("text", F.lit(r"\S+"), F.lit(0))).alias("j", "word"))
    first = segments(s, d).groupBy("conv_id", "turn").agg(F.min("start_ms").alias("turn_start_ms"))
    return w.join(first, ["conv_id", "turn"]).select("conv_id", "speaker", "turn_start_ms", (F.col("start_ms") + 300 * F.col("j") + 300).alias("end_ms"), "word")


register(
    "J03_other_turn",
    lambda s, d: A.other_turn_context(_turn_words(s, d), segments(s, d).select("conv_id", "speaker", F.col("end_ms").alias("t_ms")).distinct(), 8),
    f"""WITH {SEG}, w AS (SELECT conv_id, speaker, first_ AS turn_start, start_ms + 300 * j AS end_ms, ws[j] AS word FROM (SELECT *, unnest(generate_series(1, len(ws))) AS j FROM (SELECT conv_id, speaker, turn, start_ms, regexp_extract_all(text, '\\S+') AS ws, min(start_ms) OVER (PARTITION BY conv_id, turn) AS first_ FROM seg))),
    p AS (SELECT DISTINCT conv_id, speaker, end_ms AS t_ms FROM seg), l AS (SELECT p.*, max(turn_start) AS ts FROM p JOIN w ON w.conv_id = p.conv_id AND w.speaker = 3 - p.speaker AND turn_start < t_ms GROUP BY ALL),
    r AS (SELECT l.conv_id, l.speaker, t_ms, w.end_ms, word, row_number() OVER (PARTITION BY l.conv_id, l.speaker, t_ms ORDER BY w.end_ms DESC, word DESC) AS n FROM l JOIN w ON w.conv_id = l.conv_id AND w.speaker = 3 - l.speaker AND turn_start = ts AND w.end_ms <= t_ms)
    SELECT p.conv_id, p.speaker, p.t_ms, string_agg(word, ' ' ORDER BY r.end_ms, word) AS context FROM p LEFT JOIN r ON p.conv_id = r.conv_id AND p.speaker = r.speaker AND p.t_ms = r.t_ms AND n <= 8 GROUP BY ALL""",
)


def _folder(s) -> str:
    return shared_path(s, "io")


def s02_round_trip(s, d):
    seg = _annotated_segments(s, d)
    io.write_conversations(seg, path := _folder(s))
    return io.read_conversations(s, path).drop("pos")


def _annotated_segments(s, d):
    seg = segments(s, d)
    item = F.explode(F.array(*[F.struct(F.lit(a).alias("annotator"), F.col(c).alias("label")) for a, c in (("a", "label"), ("b", "label_b"), ("c", "label_c"))])).alias("x")
    return seg.select("conv_id", "speaker", (F.col("start_ms") / 1000.0).alias("start_s"), (F.col("end_ms") / 1000.0).alias("end_s"), "text", item).select("conv_id", "speaker", "start_s", "end_s", "text", "x.*")


register("S02_round_trip", s02_round_trip, f"""WITH {SEG} SELECT conv_id::VARCHAR AS conv_id, speaker, annotator, start_ms / 1000.0::DOUBLE AS start_s, end_ms / 1000.0::DOUBLE AS end_s, CASE annotator WHEN 'a' THEN label WHEN 'b' THEN label_b ELSE label_c END AS label, text
FROM seg, (VALUES ('a'), ('b'), ('c')) v(annotator)""")


def s03_srt(s, d):
    io.write_srt(segments(s, d), path := _folder(s), "conv_id")
    return io.read_srt(s, f"{path}/*")[0].select(F.regexp_extract("file", r"conv_id=([0-9]+)", 1).cast("long").alias("conv_id"), "start_ms", "end_ms", "label", "text")


register("S03_srt", s03_srt, f"WITH {SEG} SELECT conv_id, start_ms, end_ms, label, regexp_replace(text, '^ +| +$', '', 'g') AS text FROM seg")


def s04_tracks(s, d):
    io.write_tracks(frames(s, d), path := _folder(s), ["conv_id", "speaker"], "eot")
    return io.read_tracks(s, path, ["conv_id", "speaker"]).select("conv_id", "speaker", "i", F.round(F.col("score").cast("double"), 5).alias("score"))


register(
    "S04_tracks",
    s04_tracks,
    f"WITH {SEG}, {FR} SELECT conv_id::VARCHAR AS conv_id, speaker::VARCHAR AS speaker, i::INT AS i, round(eot::FLOAT::DOUBLE, 5) AS score FROM fr",
)


def s05_manifest(s, d):
    m = table(s, d, "documents").select(F.col("source").alias("rss_url"), F.concat(F.col("source"), F.lit("/"), F.col("doc_id") % 50).alias("audio_url"), F.col("doc_id").alias("dialogue_idx"), (F.col("n_chars") / 15.0).alias("duration_sec"))
    io.write_manifest(m, path := _folder(s))
    return io.read_manifest(s, path)


register("S05_manifest", s05_manifest, "SELECT source AS rss_url, source || '/' || doc_id % 50 AS audio_url, doc_id AS dialogue_idx, n_chars / 15.0::DOUBLE AS duration_sec FROM documents")
register(
    "S06_export",
    lambda s, d: io.export_predictions(preds(s, d), segments(s, d).groupBy("conv_id").agg((F.max("end_ms") - 5000).alias("duration_ms"))).select("conv_id", *[F.array_join(F.transform(f"speaker_{k}", lambda x: F.round(x * 1000).cast("long").cast("string")), ",").alias(f"speaker_{k}") for k in (1, 2)]),
    f"""{_ALL}, c AS (SELECT conv_id, max(end_ms) - 5000 AS dur FROM seg GROUP BY 1)
    SELECT c.conv_id, coalesce(string_agg(CASE WHEN speaker = 1 THEN t_ms END, ',' ORDER BY t_ms), '') AS speaker_1, coalesce(string_agg(CASE WHEN speaker = 2 THEN t_ms END, ',' ORDER BY t_ms), '') AS speaker_2
    FROM c LEFT JOIN pr p ON p.conv_id = c.conv_id AND p.t_ms >= 0 AND p.t_ms <= dur GROUP BY c.conv_id""",
)
