"""Queries of several annotators' gold, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnloom.functions import vocab
from turnloom.operators import consensus as G
from turnloom.operators import scoring as M
from turnloom.plans.commit_queries import FR, preds, scores_sql
from turnloom.plans.fixtures import SEG, segments
from turnloom.plans.registry import register

ANNOTATORS = ["a", "b", "c"]
#: The annotators' own bounds: b ends earlier or later, c begins later.
_BOUNDS = {
    "a": ("start_ms", "end_ms", "label"),
    "b": ("start_ms", "end_ms + 100 * ((conv_id + turn + k) % 4 - 1)", "label_b"),
    "c": ("start_ms + 100 * ((conv_id * 3 + k) % 3)", "end_ms", "label_c"),
}


def annotated(s, d) -> DataFrame:
    """Segments (conv_id, speaker, annotator, start_ms, end_ms, canonical) of three annotators."""
    rows = [f"struct('{x}' AS annotator, {a} AS start_ms, {b} AS end_ms, {c} AS label)" for x, (a, b, c) in _BOUNDS.items()]
    told = segments(s, d).selectExpr("conv_id", "speaker", f"explode(array({', '.join(rows)})) AS x").select("conv_id", "speaker", "x.*")
    return told.withColumn("canonical", vocab.canonical(F.col("label"))).drop("label")


_CANON = " ".join(f"WHEN label = '{n}' THEN '{c}'" for n, c, _ in [*vocab.FINE, *[(old, dict((n, c) for n, c, _ in vocab.FINE)[new], None) for old, new in vocab.ALIAS.items()]])
_ANNOTATED = "an0 AS (" + " UNION ALL ".join(f"SELECT conv_id, speaker, '{x}' AS annotator, {a} AS start_ms, {b} AS end_ms, {c} AS label FROM seg" for x, (a, b, c) in _BOUNDS.items()) + (
    f"), an AS MATERIALIZED (SELECT conv_id, speaker, annotator, start_ms, end_ms, CASE {_CANON} END AS canonical FROM an0)"
)


def spans_sql(name: str, label: str, n: int = 3, k: int = 2) -> str:
    """The table `name` of consensus spans over the labels that the expression gives."""
    return f"""
    {name}_s AS MATERIALIZED (SELECT conv_id, speaker, annotator, start_ms, end_ms, {label} AS label FROM an WHERE {label} IS NOT NULL),
    {name}_c AS (SELECT conv_id, speaker, start_ms AS t FROM {name}_s UNION SELECT conv_id, speaker, end_ms FROM {name}_s),
    {name}_i AS (SELECT conv_id, speaker, t AS a, lead(t) OVER (PARTITION BY conv_id, speaker ORDER BY t) AS b FROM {name}_c),
    {name}_e AS (SELECT i.conv_id, i.speaker, a, b, annotator, arg_max(label, row(s.start_ms, label)) AS label
      FROM {name}_i i JOIN {name}_s s ON i.conv_id = s.conv_id AND i.speaker = s.speaker AND s.start_ms <= a AND s.end_ms >= b GROUP BY ALL),
    {name}_n AS (SELECT conv_id, speaker, a, b, label, count(*) AS n FROM {name}_e GROUP BY ALL),
    {name}_v AS (SELECT conv_id, speaker, a, b, arg_max(label, row(n, label)) AS label, max(n) AS n, sum(n)::BIGINT AS given FROM {name}_n GROUP BY ALL),
    {name}_w AS (SELECT conv_id, speaker, a, b, CASE WHEN n >= {k} THEN label END AS label FROM {name}_v WHERE n >= {k} OR {n} - given < {k}),
    {name}_r AS (SELECT *, CASE WHEN lag(b) OVER w IS NOT DISTINCT FROM a AND lag(label) OVER w IS NOT DISTINCT FROM label THEN 0 ELSE 1 END AS new_ FROM {name}_w WINDOW w AS (PARTITION BY conv_id, speaker ORDER BY a)),
    {name} AS MATERIALIZED (SELECT conv_id, speaker, min(a) AS start_ms, max(b) AS end_ms, any_value(label) AS canonical
      FROM (SELECT *, sum(new_) OVER (PARTITION BY conv_id, speaker ORDER BY a) AS run FROM {name}_r) GROUP BY conv_id, speaker, run)"""


_GOLD = f"""{_ANNOTATED}, {spans_sql('tv', "CASE WHEN canonical IN ('Turn', 'Interruption') THEN 'Turn' END")}, {spans_sql('lv', 'canonical')},
vw AS (SELECT *, lead(speaker) OVER (PARTITION BY conv_id ORDER BY start_ms, speaker) AS who, lead(start_ms) OVER (PARTITION BY conv_id ORDER BY start_ms, speaker) AS at_ FROM tv WHERE canonical IS NOT NULL),
gold AS MATERIALIZED (
  SELECT conv_id, 'eot' AS task, 'pos' AS kind, speaker, end_ms AS start_ms, end_ms FROM vw WHERE who <> speaker UNION
  SELECT conv_id, 'eot', 'neg', speaker, end_ms, at_ FROM vw WHERE who = speaker AND at_ > end_ms UNION
  SELECT conv_id, 'eot', 'excl', speaker, start_ms, end_ms FROM tv WHERE canonical IS NULL UNION
  SELECT conv_id, 'int', 'pos', speaker, start_ms, start_ms FROM lv WHERE canonical = 'Interruption' UNION
  SELECT conv_id, 'int', 'neg', speaker, start_ms, end_ms FROM lv WHERE canonical IN ('Backchannel', 'NonContent') UNION
  SELECT conv_id, 'int', 'excl', speaker, start_ms, end_ms FROM lv WHERE canonical IS NULL OR canonical = 'NonFloorTakingInterruption'),
win AS (
  SELECT conv_id, task, speaker, t_ms, t_ms - 250 AS lo_ms,
         least(t_ms + 3000, coalesce(lead(t_ms) OVER (PARTITION BY conv_id, task, speaker ORDER BY t_ms), t_ms + 3000)) AS hi_ms
  FROM (SELECT DISTINCT conv_id, task, speaker, start_ms AS t_ms FROM gold WHERE kind = 'pos'))"""


def _labelled(s, d):
    return annotated(s, d).withColumn("label", F.col("canonical"))


register(
    "M02_elementary",
    lambda s, d: G.elementary_votes(_labelled(s, d)),
    f"WITH {SEG}, {_ANNOTATED}, {spans_sql('lv', 'canonical')} SELECT conv_id, speaker, a AS start_ms, b AS end_ms, label, n, given FROM lv_v",
)
register(
    "M02_consensus_spans",
    lambda s, d: G.consensus_spans(_labelled(s, d), 3),
    f"WITH {SEG}, {_ANNOTATED}, {spans_sql('lv', 'canonical')} SELECT conv_id, speaker, start_ms, end_ms, canonical AS label FROM lv",
)


def gold(s, d) -> DataFrame:
    return G.consensus_gold(annotated(s, d), 3)


register("M01_consensus_gold", gold, f"WITH {SEG}, {_GOLD} SELECT * FROM gold")
for _task in ("eot", "int"):
    register(
        f"M04_consensus_{_task}",
        lambda s, d, task=_task: M.score_events(gold(s, d).where(F.col("task") == task), preds(s, d, 0.6, task)),
        f"WITH RECURSIVE {SEG}, {FR}, {_GOLD}, {scores_sql(_task)} SELECT * FROM sc",
    )
register("M20_annotator_ceiling", lambda s, d: G.annotator_ceiling(annotated(s, d), ANNOTATORS))


def _both(s, d) -> DataFrame:
    return preds(s, d, 0.6, "eot").unionByName(preds(s, d, 0.6, "int"))


def _own_sql(x: str) -> str:
    return f"""ow_{x} AS (SELECT *, lead(speaker) OVER (PARTITION BY conv_id ORDER BY start_ms, speaker) AS who FROM an WHERE annotator = '{x}' AND canonical IN ('Turn', 'Interruption'))"""


_OWN = " UNION ".join(
    f"SELECT '{x}' AS annotator, conv_id, 'eot' AS task, speaker, end_ms AS t FROM ow_{x} WHERE who <> speaker UNION "
    f"SELECT '{x}', conv_id, 'int', speaker, start_ms FROM an WHERE annotator = '{x}' AND canonical = 'Interruption'"
    for x in ANNOTATORS
)
_EDGE_PREDS = ", ".join(
    f"pd_{t} AS (SELECT conv_id, '{t}' AS task, speaker, (i + 1) * 80 AS t FROM cm_{t})" for t in ("eot", "int")
)


def _commits_sql() -> str:
    from turnloom.plans.commit_queries import _apart_sql, _edges_sql

    return ", ".join(f"{_edges_sql(t, 0.6, f'ed_{t}')}, {_apart_sql(f'ed_{t}', 6, f'cm_{t}')}" for t in ("eot", "int"))


register(
    "M20_marking",
    lambda s, d: G.by_marking(gold(s, d), annotated(s, d), ANNOTATORS, _both(s, d)),
    f"""WITH RECURSIVE {SEG}, {FR}, {_GOLD}, {', '.join(_own_sql(x) for x in ANNOTATORS)}, own AS MATERIALIZED ({_OWN}), {_commits_sql()}, {_EDGE_PREDS},
    pd AS MATERIALIZED (SELECT * FROM pd_eot UNION ALL SELECT * FROM pd_int),
    ev AS (SELECT *, row_number() OVER () AS id FROM gold WHERE kind IN ('pos', 'neg')),
    mkd AS (SELECT id, count(DISTINCT annotator) AS m FROM ev JOIN own o ON o.conv_id = ev.conv_id AND o.task = ev.task AND o.speaker = ev.speaker
           AND o.t BETWEEN CASE kind WHEN 'pos' THEN start_ms - 300 ELSE start_ms - 250 END AND CASE kind WHEN 'pos' THEN start_ms + 300 ELSE end_ms END GROUP BY id),
    ht AS (SELECT DISTINCT id FROM ev JOIN pd p ON p.conv_id = ev.conv_id AND p.task = ev.task AND p.speaker = ev.speaker
           AND p.t BETWEEN CASE kind WHEN 'pos' THEN start_ms - 250 ELSE start_ms END AND CASE kind WHEN 'pos' THEN start_ms + 3000 ELSE end_ms END)
    SELECT task, kind, coalesce(m, 0) AS marking, count(*) AS n, count(ht.id) AS hit FROM ev LEFT JOIN mkd USING (id) LEFT JOIN ht USING (id) GROUP BY ALL""",
)
