"""Queries of further corpus and frame operators, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from turnloom.operators import corpus as K
from turnloom.operators import frames as R
from turnloom.operators import windows as V
from turnloom.plans.fixtures import SEG, segments, table
from turnloom.plans.registry import register

register(
    "K10_accept",
    lambda s, d: K.accept_conversations(
        segments(s, d).groupBy("conv_id").agg(F.avg((F.col("label") == F.col("label_b")).cast("double")).alias("value")),
        segments(s, d).groupBy("conv_id").agg(F.avg(F.expr("CASE WHEN n <= 4 THEN 1D ELSE 0D END")).alias("value")),
        segments(s, d),
        0.84,
    ),
    f"""WITH {SEG}, c AS (SELECT conv_id, avg((label = label_b)::INT) AS a, avg((n <= 4)::INT) AS e, count(DISTINCT speaker) AS k FROM seg GROUP BY conv_id)
    SELECT conv_id, array_to_string(list_filter([CASE WHEN e > 0.35 THEN 'high_wer' END, CASE WHEN a < 0.84 THEN 'low_agreement' END, CASE WHEN k < 2 THEN 'silent_channel' END], lambda x: x IS NOT NULL), ',') AS reasons FROM c""",
)
register(
    "W10_enrollment",
    lambda s, d: V.enrollment_vector(table(s, d, "embeddings"), ["label"], "vec_id", "embedding", 20),
    """WITH r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS r FROM embeddings), e AS (SELECT label, embedding, unnest(generate_series(1, len(embedding))) AS k FROM r WHERE r <= 20)
    SELECT label, (k - 1)::INT AS pos, avg(embedding[k]::DOUBLE) AS mean FROM e GROUP BY ALL""",
)
register(
    "R11_diarization_slots",
    lambda s, d: R.slots_from_diarization(segments(s, d).withColumn("who", F.expr("concat('p', speaker, CASE WHEN conv_id % 5 = 0 THEN concat('-', turn % 2) ELSE '' END)"))),
    f"""WITH {SEG}, f AS (SELECT conv_id, 'p' || speaker || CASE WHEN conv_id % 5 = 0 THEN '-' || turn % 2 ELSE '' END AS who, min(start_ms) AS first FROM seg GROUP BY ALL)
    SELECT conv_id, who, row_number() OVER (PARTITION BY conv_id ORDER BY first, who) - 1 AS slot, count(*) OVER (PARTITION BY conv_id) <= 2 AS ok FROM f""",
)


_WHO = "concat('p', speaker, CASE WHEN conv_id % 5 = 0 THEN concat('-', k % 2) ELSE '' END)"


def _diarized(s, d):
    return segments(s, d).withColumn("who", F.expr(_WHO))


register(
    "R11_slot_activity",
    lambda s, d: R.slot_activity(_diarized(s, d), segments(s, d).groupBy("conv_id").agg(F.expr("max(end_ms) div 80 + 1").alias("frames")), 80),
    f"""WITH {SEG}, w AS (SELECT *, {_WHO} AS who FROM seg), f AS (SELECT conv_id, who, row_number() OVER (PARTITION BY conv_id ORDER BY min(start_ms), who) - 1 AS slot, count(*) OVER (PARTITION BY conv_id) AS many FROM w GROUP BY conv_id, who),
    g AS (SELECT conv_id, unnest(range(max(end_ms) // 80 + 1)) AS i FROM seg GROUP BY conv_id),
    e AS (SELECT w.conv_id, slot, start_ms, end_ms, unnest(range(start_ms // 80, end_ms // 80 + 1)) AS i FROM w JOIN f USING (conv_id, who) WHERE many <= 2),
    a AS (SELECT DISTINCT conv_id, slot, i FROM e WHERE i * 80 + 40 >= start_ms AND i * 80 + 40 < end_ms)
    SELECT g.conv_id, g.i, s.slot::INT AS slot, CASE WHEN a.i IS NULL THEN 0 ELSE 1 END AS active FROM g JOIN (SELECT DISTINCT conv_id FROM f WHERE many <= 2) USING (conv_id), (VALUES (0), (1)) s(slot)
    LEFT JOIN a ON a.conv_id = g.conv_id AND a.slot = s.slot AND a.i = g.i""",
)
register(
    "R11_rejects",
    lambda s, d: R.slot_rejects(_diarized(s, d)),
    f"WITH {SEG} SELECT conv_id, count(DISTINCT {_WHO}) AS speakers FROM seg GROUP BY conv_id HAVING count(DISTINCT {_WHO}) > 2",
)
