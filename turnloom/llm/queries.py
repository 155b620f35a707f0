"""One query for each operator of this subpackage, over whole tables, and SQL for those that it can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnloom.llm import archive, decontaminate, licenses, merkle, mixing, ngram_jaccard, ngram_lm, pii, quality, repair, secrets, sharding, simhash

# Fixed values of the contracts.
SOURCE_WEIGHTS, BUDGET_RATIO, MAX_REPEATS = [5, 2, 1], 1.5, 2
SHARDS = 40


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.fair_queue(_table(spark, sf_dir, "documents"), SOURCE_WEIGHTS, BUDGET_RATIO, MAX_REPEATS).select(
        "doc_id", "size", "source_size", "target", "taken"
    )


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.find_secrets(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.filter("secrets", lambda s: s["kind"] != "entropy")
    counts = [F.size(F.filter("secrets", _is(kind))).cast("long").alias(f"n_{kind}") for kind in ("assign", "access", "hex", "entropy")]
    return found.select("doc_id", *counts, F.sha2(secrets.spelled(base), 256).alias("base_sha256"), secrets.spelled(F.col("secrets")).alias("spans"))


def _is(kind: str):
    return lambda s: s["kind"] == kind


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find_contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), ["doc_id"])
    return found.drop("hit_spans")


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(_table(spark, sf_dir, "documents"), ["doc_id"])


def op5_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard.similar_groups(_table(spark, sf_dir, "documents"))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_pii(_table(spark, sf_dir, "documents"), ["doc_id"]).drop("found")


def op7_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive.round_trip(_table(spark, sf_dir, "pages")).drop("url")


def op8_ngram_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_lm.score_documents(_table(spark, sf_dir, "documents"))


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.find_licenses(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.array_sort(F.array_distinct(F.transform("places", lambda p: p["label"])))
    both = F.array_sort(F.array_union(base, F.transform("matches", lambda m: m["label"])))
    starts = F.transform("places", lambda p: p["word"])
    return found.select(
        "doc_id",
        "n_words",
        F.size("places").cast("long").alias("n_base"),
        F.array_min(starts).cast("long").alias("first_word"),
        F.array_max(starts).cast("long").alias("last_word"),
        F.array_join(base, ",").alias("base_labels"),
        F.array_join(both, ",").alias("labels"),
        F.coalesce(F.array_max(F.transform("matches", lambda m: m["score"])), F.lit(0.0)).alias("score"),
    )


def op10_rendezvous(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign_shards(_table(spark, sf_dir, "documents").select("doc_id", "text"), [1.0] * SHARDS).drop("text")


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars", "text")
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    without = merkle.leaf(text=F.replace("text", F.lit("\n"), F.lit("")))
    return merkle.audit(docs, F.when(tampered, without).otherwise(merkle.leaf()))


def op12_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return repair.repair(repair.damaged(conversations), conversations)


def op13_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    named = [op1_mix_sources, op2_secrets, op3_decontaminate, op4_quality, op5_ngram_jaccard, op6_pii, op7_archive, op8_ngram_lm, op9_licenses, op10_rendezvous, op11_merkle, op12_repair, op13_simhash]
    return {f.__name__: f for f in named}


_OP1 = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS key
  FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS weight
  FROM d GROUP BY source),
c AS (SELECT *, source_size::DOUBLE * 2 AS cap, sum(source_size) OVER ()::DOUBLE * 1.5 AS budget FROM s),
l AS (
  SELECT *, (budget - coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM c WINDOW o AS (ORDER BY cap / weight, source NULLS LAST)),
f AS (SELECT *, bool_and(cap <= level * weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS UNBOUNDED PRECEDING) AS capped FROM l),
t AS (
  SELECT source, source_size, budget,
         CASE WHEN capped THEN cap ELSE weight * arg_min(CASE WHEN NOT capped THEN level END, CASE WHEN NOT capped THEN cap / weight END) OVER () END AS target
  FROM f),
q AS (
  SELECT d.*, source_size, target, budget,
         sum(size) OVER (PARTITION BY d.source ORDER BY key, doc_id, size ROWS UNBOUNDED PRECEDING)::BIGINT AS reached
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
r AS (
  SELECT *, (reached + p * source_size) / target AS finish
  FROM q, (VALUES (0), (1)) v(p) WHERE size > 0 AND target > 0),
u AS (SELECT *, sum(size) OVER (ORDER BY finish, key, doc_id, size ROWS UNBOUNDED PRECEDING) AS upto FROM r),
z AS (SELECT max(row(finish, key)) AS cut FROM u WHERE upto <= budget),
n AS (SELECT doc_id, source, size, count(*) / count(DISTINCT p) AS same, count(*) AS k FROM u, z WHERE row(finish, key) <= cut GROUP BY ALL)
SELECT q.doc_id, q.size, q.source_size, q.target, (q.size * coalesce(n.k / n.same, 0))::BIGINT AS taken
FROM q LEFT JOIN n ON q.doc_id IS NOT DISTINCT FROM n.doc_id AND q.source IS NOT DISTINCT FROM n.source AND q.size = n.size
"""

_OP3 = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
p AS (
  SELECT DISTINCT item_id, least(len(ws), 10) AS n, array_to_string(ws[k:k + least(len(ws), 10) - 1], ' ') AS phrase
  FROM (SELECT item_id, ws, unnest(generate_series(1, greatest(len(ws) - 9, 1))) AS k FROM b WHERE len(ws) > 0)),
g AS (
  SELECT doc_id, k, n, array_to_string(ws[k:k + n - 1], ' ') AS phrase
  FROM (SELECT doc_id, ws, n, unnest(generate_series(1, len(ws) - n + 1)) AS k FROM w, (SELECT DISTINCT n FROM p) WHERE len(ws) >= n)),
m AS (SELECT doc_id, k, n, item_id FROM g JOIN p USING (n, phrase)),
h AS (SELECT doc_id, count(DISTINCT word) AS n_hit FROM (SELECT doc_id, unnest(generate_series(k, k + n - 1)) AS word FROM m) GROUP BY doc_id),
i AS (SELECT doc_id, list_sort(list(DISTINCT CAST(item_id AS VARCHAR))) AS items FROM m GROUP BY doc_id)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(len(items), 0)::BIGINT AS n_items,
       sha256(array_to_string(coalesce(items, []), ',')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM w LEFT JOIN h USING (doc_id) LEFT JOIN i USING (doc_id)
"""


#: Unsigned CRC-32 of an ASCII string {0}, bit by bit.
_CRC = (
    "xor(4294967295::UBIGINT, list_reduce(list_prepend(4294967295::UBIGINT, list_transform(string_split({0}, ''), lambda c: ascii(c)::UBIGINT)), "
    "lambda a, b: list_reduce(list_prepend(xor(a, b), [0, 0, 0, 0, 0, 0, 0, 0]::UBIGINT[]), lambda x, i: xor(x >> 1, (x & 1) * 3988292384::UBIGINT))))"
)


def _spelled(c: str) -> str:
    return f"coalesce(strlen({c}::VARCHAR) || ':' || {c}, '-')"


_OP11 = f"""
WITH RECURSIVE d AS MATERIALIZED (
  SELECT doc_id, source, {" || ".join(map(_spelled, ("doc_id", "source", "lang", "n_chars")))} AS head, text,
         coalesce({_CRC.format("doc_id::VARCHAR")} % 2 = 0, false) AS tampered
  FROM documents),
l AS MATERIALIZED (
  SELECT doc_id, source, sha256(head || {_spelled("text")}) AS leaf,
         sha256(head || CASE WHEN tampered THEN {_spelled("replace(text, chr(10), '')")} ELSE {_spelled("text")} END) AS found
  FROM d),
a AS MATERIALIZED (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY source) AS n FROM l),
up AS (
  SELECT source, 0 AS level, pos, n, leaf AS digest FROM a
  UNION ALL
  SELECT source, level + 1, pos // 3, (n + 2) // 3, sha256(string_agg(digest, '' ORDER BY pos)) FROM up WHERE n > 1 GROUP BY source, level, pos // 3, n),
tops AS MATERIALIZED (
  SELECT source, digest AS subroot, row_number() OVER (ORDER BY encode(source) NULLS FIRST) - 1 AS pos, count(*) OVER () AS n FROM up WHERE n = 1),
hi AS (
  SELECT 0 AS level, pos, n, subroot AS digest FROM tops
  UNION ALL
  SELECT level + 1, pos // 3, (n + 2) // 3, sha256(string_agg(digest, '' ORDER BY pos)) FROM hi WHERE n > 1 GROUP BY level, pos // 3, n),
runs AS MATERIALIZED (
  SELECT source, level, pos // 3 AS run, list(digest ORDER BY pos) AS held FROM up WHERE n > 1 GROUP BY ALL),
hi_runs AS MATERIALIZED (SELECT level, pos // 3 AS run, list(digest ORDER BY pos) AS held FROM hi WHERE n > 1 GROUP BY ALL),
steps AS (
  SELECT a.source, a.pos, r.level, r.held, (a.pos // pow(3, r.level)::BIGINT) % 3 AS slot
  FROM a JOIN runs r ON a.source IS NOT DISTINCT FROM r.source AND a.pos // pow(3, r.level + 1)::BIGINT = r.run
  UNION ALL
  SELECT a.source, a.pos, 100 + r.level, r.held, (t.pos // pow(3, r.level)::BIGINT) % 3
  FROM a JOIN tops t ON a.source IS NOT DISTINCT FROM t.source JOIN hi_runs r ON t.pos // pow(3, r.level + 1)::BIGINT = r.run),
paths AS (
  SELECT source, pos, list(array_to_string(held[:slot], '') || '|' || array_to_string(held[slot + 2:], '') ORDER BY level) AS path FROM steps GROUP BY source, pos)
SELECT doc_id, leaf, subroot, hi.digest AS root,
       sha256(replace(array_to_string(coalesce(path, []), ''), '|', '')) AS proof_sha256,
       list_reduce(list_prepend(found, coalesce(path, [])), lambda x, s: sha256(split_part(s, '|', 1) || x || split_part(s, '|', 2))) AS folded_root,
       folded_root = hi.digest AS verified
FROM a LEFT JOIN paths p ON a.source IS NOT DISTINCT FROM p.source AND a.pos = p.pos JOIN tops t ON a.source IS NOT DISTINCT FROM t.source, hi
WHERE hi.n = 1
"""


#: Forward over the rows of a conversation: for each state the cheapest edits so far, of these the first in ASCII. Up to two insertions before each row.
_OP12 = f"""
WITH RECURSIVE k AS MATERIALIZED (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         {_CRC.format("(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '))")} % 20 AS kind FROM conversations),
g AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
         CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM k, (VALUES (0), (1)) v(again) WHERE kind != 0 AND (again = 0 OR kind = 3)),
n AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM g),
f AS MATERIALIZED (
  SELECT conv_id, i, turn, role, text, CASE WHEN role[1:1] IN ('s', 'u', 'a') THEN role[1:1] ELSE 'o' END AS initial,
         lead(initial) OVER (PARTITION BY conv_id ORDER BY i) AS next,
         CASE WHEN NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') THEN 'blank'
              WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate'
              WHEN NOT regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*\\z') THEN 'truncated' ELSE '' END AS fault
  FROM n),
c AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
         count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
         count(*) FILTER (next IS NOT NULL AND initial || next NOT IN ('su', 'ua', 'au')) AS illegal, max(i) AS rows
  FROM f GROUP BY conv_id),
ins(q, z, edits, cost, lines) AS (VALUES (0, 0, '', 0, ''), (1, 1, '', 0, ''), (2, 2, '', 0, ''), (3, 3, '', 0, ''),
  (0, 2, 'I', 5, chr(10) || 'user:'), (1, 2, 'I', 5, chr(10) || 'user:'), (2, 3, 'I', 5, chr(10) || 'assistant:'), (3, 2, 'I', 5, chr(10) || 'user:'),
  (0, 3, 'II', 10, chr(10) || 'user:' || chr(10) || 'assistant:'), (1, 3, 'II', 10, chr(10) || 'user:' || chr(10) || 'assistant:')),
move(q, role, z) AS (VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (2, 'a', 3), (3, 'u', 2)),
step AS MATERIALIZED (
  SELECT conv_id, i, q, 'D' AS edit, q AS z, 2 AS cost, '' AS line FROM f, (VALUES (0), (1), (2), (3)) s(q)
  UNION ALL
  SELECT conv_id, i, q, 'K', z, CASE fault WHEN 'truncated' THEN 5 ELSE 0 END, chr(10) || f.role || ':' || text
  FROM f JOIN move ON initial = move.role WHERE fault NOT IN ('blank', 'duplicate')
  UNION ALL
  SELECT conv_id, i, q, 'R', z, CASE fault WHEN 'truncated' THEN 6 ELSE 1 END, chr(10) || CASE move.role WHEN 'u' THEN 'user:' ELSE 'assistant:' END || text
  FROM f, move WHERE fault NOT IN ('blank', 'duplicate') AND move.role != 's'),
dp AS (
  SELECT DISTINCT conv_id, 0::BIGINT AS i, 0 AS q, {{'cost': 0, 'edits': '', 'lines': ''}} AS best FROM f
  UNION ALL
  SELECT dp.conv_id, dp.i + 1, step.z,
         min({{'cost': best.cost + ins.cost + step.cost, 'edits': best.edits || ins.edits || step.edit, 'lines': best.lines || ins.lines || step.line}})
  FROM dp JOIN ins ON dp.q = ins.q JOIN step ON dp.conv_id IS NOT DISTINCT FROM step.conv_id AND step.i = dp.i + 1 AND step.q = ins.z
  GROUP BY dp.conv_id, dp.i, step.z),
e AS (
  SELECT dp.conv_id, min({{'cost': best.cost + ins.cost, 'edits': best.edits || ins.edits, 'lines': best.lines || ins.lines}}) AS best
  FROM dp JOIN c ON dp.conv_id IS NOT DISTINCT FROM c.conv_id AND dp.i = c.rows JOIN ins ON dp.q = ins.q AND ins.z IN (0, 3) GROUP BY dp.conv_id)
SELECT o.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
       coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, coalesce(best.cost, 0)::BIGINT AS cost,
       coalesce(best.edits, '') AS audit, sha256(coalesce(best.lines[2:], '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o
LEFT JOIN c ON o.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN e ON o.conv_id IS NOT DISTINCT FROM e.conv_id
"""


#: Base 32 of the 160 bits of a SHA-1: four characters from each five hexadecimal digits.
_OP7 = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS h FROM pages),
d AS (
  SELECT page_id, n, array_to_string(list_transform(range(32), lambda k:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(h, (k // 4 * 5 + 1)::INT, 5))::BIGINT >> (15 - k % 4 * 5)::INT) & 31)::INT, 1)), '') AS digest FROM p),
f AS (SELECT digest, min(page_id) AS first FROM d GROUP BY digest)
SELECT page_id, n::BIGINT AS payload_bytes, digest AS payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id != first THEN first END AS refers_to
FROM d JOIN f USING (digest)
"""

#: The CRC of the texts goes by bytes, with a table that is made first.
_OP10 = f"""
WITH t AS MATERIALIZED (
  SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i::UBIGINT, [0, 0, 0, 0, 0, 0, 0, 0]::UBIGINT[]), lambda x, j: xor(x >> 1, (x & 1) * 3988292384::UBIGINT))) AS step),
d AS MATERIALIZED (
  SELECT row_number() OVER () AS nth, doc_id, coalesce(doc_id::VARCHAR, 'null') AS key, strlen(coalesce(text, '')) + 16 AS size,
         list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda h: ('0x' || h)::UBIGINT) AS bytes FROM documents),
c AS MATERIALIZED (
  SELECT nth, doc_id, key, size, xor(4294967295::UBIGINT, list_reduce(list_prepend(4294967295::UBIGINT, bytes), lambda a, b: xor(step[(xor(a, b) & 255)::INT + 1], a >> 8))) AS crc FROM d, t),
s AS (
  SELECT nth, n, -1.0::DOUBLE / ln((('0x' || substr(md5('shard:' || n || ':' || key), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0) AS score
  FROM c, (SELECT unnest(range({SHARDS} + 1)) AS n)),
b AS (SELECT nth, arg_max(n, row(score, -n)) FILTER (n < {SHARDS}) AS shard, arg_max(n, row(score, -n)) AS grown FROM s GROUP BY nth)
SELECT doc_id, size::BIGINT AS size, crc::BIGINT AS text_crc32, 'key' AS law, shard::INT AS shard,
       row_number() OVER (PARTITION BY shard ORDER BY md5('shard:slot:' || key || ':' || crc), doc_id, crc) - 1 AS slot, grown::INT AS grown_shard
FROM c JOIN b USING (nth)
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_mix_sources": _OP1, "op3_decontaminate": _OP3, "op7_archive": _OP7, "op10_rendezvous": _OP10, "op11_merkle": _OP11, "op12_repair": _OP12}
