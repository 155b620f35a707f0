"""Queries of onset context, oracle questions, policy choice, dialogue checks and voices, with their SQL where there is one."""

from __future__ import annotations

from pyspark.sql import functions as F

from turnloom.operators import onsets as O
from turnloom.operators import scoring as M
from turnloom.operators import scripts as K
from turnloom.operators import selection as P
from turnloom.plans.commit_queries import STEP
from turnloom.plans.fixtures import SEG, frames, frames_sql, segments, table
from turnloom.plans.registry import register
from turnloom.sources.settle import settle

FR = frames_sql()

register(
    "F04_edit_distance_chars",
    lambda s, d: segments(s, d).select("conv_id", "turn", "k", F.levenshtein("label", "label_b").cast("long").alias("chars")),
    f"WITH {SEG} SELECT conv_id, turn, k, levenshtein(label, label_b) AS chars FROM seg",
)
register(
    "W05_onset_context",
    lambda s, d: O.onset_context(segments(s, d), frames(s, d), STEP, [240, 480]),
    f"""WITH {SEG}, {FR},
    a AS (SELECT conv_id, speaker, start_ms, least(coalesce(start_ms - lag(end_ms) OVER (PARTITION BY conv_id, speaker ORDER BY start_ms), 5000), 5000) AS silence_ms FROM seg),
    o AS (SELECT a.*, (SELECT least(coalesce(a.start_ms - min(b.start_ms), 0), 5000) FROM seg b WHERE b.conv_id = a.conv_id AND b.speaker = 3 - a.speaker AND b.start_ms <= a.start_ms AND a.start_ms <= b.end_ms + 200) AS other_run_ms FROM a),
    p AS (SELECT *, start_ms // 80 AS from_i, greatest(start_ms + delay_ms - 2000, 0) // 80 AS back_i, (start_ms + delay_ms) // 80 AS now_i FROM o, (VALUES (240::BIGINT), (480::BIGINT)) v(delay_ms))
    SELECT p.conv_id, p.speaker, p.start_ms, delay_ms, coalesce(avg(own::INT) FILTER (i >= from_i), 0) AS own_share, coalesce(avg(other::INT) FILTER (i >= from_i), 0) AS other_share,
           coalesce(avg(own::INT) FILTER (i >= back_i), 0) AS own_recent, coalesce(avg(other::INT) FILTER (i >= back_i), 0) AS other_recent, coalesce(bool_or(other) FILTER (i >= now_i - 3), false) AS other_now,
           min(silence_ms)::BIGINT AS silence_ms, min(other_run_ms)::BIGINT AS other_run_ms
    FROM p LEFT JOIN fr ON fr.conv_id = p.conv_id AND fr.speaker = p.speaker AND i >= least(from_i, back_i) AND i < now_i GROUP BY p.conv_id, p.speaker, p.start_ms, delay_ms""",
)
register(
    "J05_oracle_queries",
    lambda s, d: O.oracle_queries(segments(s, d), 300),
    f"""WITH {SEG}, x AS (SELECT * FROM seg a WHERE n > 0 AND EXISTS (FROM seg b WHERE b.n > 0 AND b.conv_id = a.conv_id AND b.speaker = 3 - a.speaker AND b.start_ms <= a.start_ms AND a.start_ms <= b.end_ms + 300))
    SELECT conv_id, speaker, start_ms, 'eot' AS kind, n AS words, end_ms + 300 AS t_ms FROM seg WHERE n > 0 UNION ALL
    SELECT conv_id, speaker, start_ms, 'int', w, start_ms + 300 + (w * (end_ms - start_ms)) // n FROM (SELECT *, unnest(list_distinct([least(n, 1), least(n, 2), least(n, 4), n])) AS w FROM x)""",
)


def _drafts(s, d):
    seg = segments(s, d)
    last = seg.groupBy("conv_id", "turn").agg(F.max("k").alias("last"))
    kind = F.expr("CASE WHEN k = last THEN 'end' WHEN k % 2 = 0 THEN 'pause' ELSE 'clause' END")
    return seg.join(last, ["conv_id", "turn"]).select("conv_id", "turn", kind.alias("kind"), F.col("k").alias("at"), F.expr("(conv_id * 31 + turn * 7 + k * 5) % 11").alias("score"), F.col("end_ms").alias("t_ms"))


register(
    "A07_speculation",
    lambda s, d: O.speculation_rates(_drafts(s, d), ["conv_id", "turn"], 8),
    f"""WITH {SEG}, c AS (SELECT conv_id, turn, k, end_ms, (conv_id * 31 + turn * 7 + k * 5) % 11 AS score, max(k) OVER (PARTITION BY conv_id, turn) AS last FROM seg),
    t AS (SELECT schedule, conv_id, turn, count(*) FILTER (k < last AND (schedule = 'clause' OR k % 2 = 0)) AS n, arg_max(score, k) FILTER (k < last AND (schedule = 'clause' OR k % 2 = 0)) AS sc,
          arg_max(end_ms, k) FILTER (k < last AND (schedule = 'clause' OR k % 2 = 0)) AS t_ms, max(end_ms) FILTER (k = last) AS e FROM c, (VALUES ('pause'), ('clause')) v(schedule) GROUP BY ALL)
    SELECT schedule, count(*) AS turns, avg((n = 0)::INT) AS none, avg((sc >= 8)::INT) AS hits, quantile_cont(e - t_ms, 0.5) AS lead_ms, avg(n + 1) AS drafts FROM t GROUP BY schedule""",
)

CUTS = [500, 1000, 2000, 4000]


def _counts(s, d):
    rows = table(s, d, "labels").where("quality IS NOT NULL").join(table(s, d, "documents").select("doc_id", "n_chars"), "doc_id")
    rows = rows.withColumn("policy", F.explode(F.array(*[F.lit(c) for c in CUTS]))).withColumn("said", F.col("n_chars") > F.col("policy"))
    return rows.groupBy("policy", "doc_id").agg(
        F.count_if(F.expr("quality = 1 AND said")).alias("tp"), F.count_if(F.expr("quality = 1 AND NOT said")).alias("fn"),
        F.count_if(F.expr("quality = 0 AND said")).alias("fp"), F.count_if(F.expr("quality = 0 AND NOT said")).alias("tn"),
    )


def _rounded(df, *cols):
    return df.withColumns({c: F.round(c, 6) for c in cols})


register(
    "M12_split_half",
    lambda s, d: _rounded(P.split_half(_counts(s, d), "doc_id", 0.5, 200, "half"), "recall", "fp_rate", "fp_p95"),
    f"""WITH r AS (SELECT doc_id, quality, policy, n_chars > policy AS said FROM labels JOIN documents USING (doc_id), (SELECT unnest({CUTS}) AS policy) WHERE quality IS NOT NULL),
    x AS (SELECT *, ('0x' || substr(sha256('half:' || doc_id || '/' || split), 1, 15))::BIGINT::DOUBLE / 1152921504606846976.0::DOUBLE < 0.5 AS a FROM r, (SELECT unnest(generate_series(0, 199)) AS split)),
    g AS (SELECT split, policy, avg(said::INT) FILTER (a AND quality = 1) AS recall_a, avg(said::INT) FILTER (a AND quality = 0) AS fp_a, avg(said::INT) FILTER (NOT a AND quality = 1) AS recall_b,
          avg(said::INT) FILTER (NOT a AND quality = 0) AS fp_b FROM x GROUP BY ALL),
    h AS (SELECT * FROM g WHERE fp_a <= 0.5 QUALIFY row_number() OVER (PARTITION BY split ORDER BY recall_a DESC NULLS LAST, policy) = 1)
    SELECT round(avg(recall_b), 6) AS recall, round(avg(fp_b), 6) AS fp_rate, round(quantile_cont(fp_b, 0.95), 6) AS fp_p95, count(*) AS splits FROM h WHERE recall_b IS NOT NULL AND fp_b IS NOT NULL""",
)


def _probed(s, d):
    rows = table(s, d, "embeddings").withColumns({"y": (F.col("label") < 5).cast("int"), "part": F.col("vec_id") % 20})
    scored = P.grouped_cv_scores(rows, "embedding", "y", "part", 4, 8, "probe")
    return settle(scored, "probed")


# The folds are slices like any other.
register("A09_grouped_cv", lambda s, d: P.probe_report(_probed(s, d), "y", "score", {"fold": F.col("fold"), "label": F.col("label") % 5}))


def _items(s, d):
    talk = table(s, d, "conversations").where("role <> 'system'")
    kind = F.expr("CASE WHEN regexp_count(text, '\\\\S+') <= 2 THEN 'backchannel' WHEN (conv_id + turn) % 5 = 0 THEN 'interruption' ELSE 'turn' END")
    return talk.select(
        F.col("conv_id").alias("script_id"), F.col("turn").alias("pos"), F.expr("turn - CASE WHEN (conv_id + turn) % 13 = 0 THEN 1 ELSE 0 END").alias("id"),
        F.expr("CASE WHEN role = 'user' THEN 'A' ELSE 'B' END").alias("speaker"), kind.alias("kind"), F.expr("concat('one two three ', text)").alias("text"),
        (F.col("turn") - 1).alias("host"), F.expr("CASE WHEN (conv_id + turn) % 7 = 0 THEN 'zero one' ELSE 'One, two' END").alias("after"), F.expr("turn % 2 = 0").alias("takes_floor"),
    )


register(
    "K09_schema_check",
    lambda s, d: K.schema_check(_items(s, d)),
    r"""WITH i AS (SELECT conv_id AS script_id, turn AS pos, turn - CASE WHEN (conv_id + turn) % 13 = 0 THEN 1 ELSE 0 END AS id, CASE WHEN role = 'user' THEN 'A' ELSE 'B' END AS speaker,
      CASE WHEN len(regexp_extract_all(text, '\S+')) <= 2 THEN 'backchannel' WHEN (conv_id + turn) % 5 = 0 THEN 'interruption' ELSE 'turn' END AS kind, turn - 1 AS host,
      (conv_id + turn) % 7 = 0 AS lost, turn % 2 = 0 AS takes_floor, trim(regexp_replace(regexp_replace(lower(text), '\[[^\]]*\]', ' ', 'g'), '[!-&(-,./:-@\[-`{-~ \t\n\r\f]+', ' ', 'g')) = '' AS bare FROM conversations WHERE role <> 'system'),
    f AS (SELECT *, kind = 'turn' OR (kind = 'interruption' AND takes_floor) AS floor FROM i),
    w AS (SELECT *, count(*) OVER (PARTITION BY script_id, id) AS same, max(CASE WHEN floor THEN pos END) OVER (PARTITION BY script_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last_floor FROM f),
    h AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY script_id, id ORDER BY pos) = 1),
    j AS (SELECT w.*, coalesce(h.pos < w.pos AND h.floor AND h.speaker <> w.speaker, false) AS hosted, h.pos AS hpos FROM w LEFT JOIN h ON h.script_id = w.script_id AND h.id = w.host)
    SELECT script_id, pos, id, unnest(list_filter([CASE WHEN same > 1 THEN 'duplicate_id' END, CASE WHEN kind <> 'turn' AND NOT hosted THEN 'bad_host' END, CASE WHEN kind <> 'turn' AND hosted AND lost THEN 'after_missing' END,
      CASE WHEN kind <> 'turn' AND hosted AND floor AND hpos <> last_floor THEN 'not_current' END], lambda x: x IS NOT NULL)) AS code FROM j""",
)
register(
    "K07_voice_bank",
    lambda s, d: K.voice_bank(table(s, d, "documents").selectExpr("source AS speaker", "concat('g', length(source) % 2) AS gender", "doc_id AS utt_id", "n_chars AS ms", "doc_id % 7 AS quality")).withColumn("ids", F.array_join("ids", ",")),
    """WITH u AS (SELECT source AS speaker, 'g' || length(source) % 2 AS gender, doc_id AS utt_id, n_chars AS ms, doc_id % 7 AS quality FROM documents WHERE n_chars > 0),
    tt AS (SELECT speaker, avg(quality) AS quality, min(gender) AS gender FROM u GROUP BY speaker HAVING sum(ms) >= 6000),
    l AS (SELECT speaker, list([ms, utt_id] ORDER BY ms DESC, utt_id) AS a FROM u WHERE ms <= 10000 GROUP BY speaker),
    -- The length used so far, then the utterances that fitted.
    p AS (SELECT speaker, list_reduce(list_prepend([0]::BIGINT[], a), lambda y, x: CASE WHEN y[1] + x[1] <= 10000 THEN list_append(list_prepend(y[1] + x[1] + 250, y[2:]), x[2]) ELSE y END) AS r FROM l),
    c AS (SELECT speaker, gender, quality, r[1] - 250 AS clip_ms, array_to_string(r[2:], ',') AS ids FROM tt JOIN p USING (speaker) WHERE r[1] - 250 >= 6000),
    g AS (SELECT *, row_number() OVER (PARTITION BY gender ORDER BY quality DESC NULLS LAST, speaker) AS place FROM c)
    SELECT gender, place, speaker, quality, clip_ms, ids FROM g WHERE place <= 8""",
)
