"""Queries of text functions and corpus operators, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from turnloom.functions import text as T
from turnloom.operators import corpus as K
from turnloom.plans.fixtures import SEG, segments, table
from turnloom.plans.registry import register

_SEGK = ["conv_id", "turn", "k"]


def _seg(s, d, *cols):
    return segments(s, d).select(*_SEGK, *cols)


NORM = r"""trim(regexp_replace(regexp_replace(regexp_replace(lower(text), '\[[^\]]*\]', ' ', 'g'), '[!-&(-,./:-@\[-`{-~]', ' ', 'g'), '[ \t\n\r\f]+', ' ', 'g'))"""
register("F02_norm_text", lambda s, d: _seg(s, d, T.norm_text(F.col("text")).alias("norm")), f"WITH {SEG} SELECT conv_id, turn, k, {NORM} AS norm FROM seg")
register(
    "F03_error_units",
    lambda s, d: table(s, d, "documents").select("doc_id", F.size(T.error_units(F.col("text"), F.when(F.col("lang") == "fr", "ja").otherwise(F.col("lang")))).cast("long").alias("n")),
    r"""SELECT doc_id, CASE WHEN lang = 'fr' THEN len(regexp_replace(text, '\s', '', 'g')) ELSE len(regexp_extract_all(text, '[^ \t\n\r\f]+')) END AS n FROM documents""",
)


def _pairs(s, d):
    """Neighbouring pieces of a turn as words (w, v) and texts (t, u), whole."""
    w = T.words(T.norm_text(F.col("text")))
    seg = segments(s, d).select("conv_id", "turn", "k", w.alias("w"), F.concat_ws(" ", w).alias("t"))
    nxt = seg.select("conv_id", "turn", (F.col("k") - 1).alias("k"), F.col("w").alias("v"), F.col("t").alias("u"))
    return seg.join(nxt, _SEGK)


_PAIRS = rf"""wd AS (SELECT conv_id, turn, k, regexp_extract_all({NORM}, '[^ \t\n\r\f]+') AS w FROM seg),
pq AS (SELECT a.conv_id, a.turn, a.k, a.w, b.w AS v FROM wd a JOIN wd b ON a.conv_id = b.conv_id AND a.turn = b.turn AND b.k = a.k + 1)"""


def _distance_sql(w: str, v: str) -> str:
    """The edit distance of two lists: the rows of the table, each folded from the one before."""
    row = f"""list_reduce(list_prepend([p[1] + 1], list_transform(range(1, len({v}) + 1), lambda j: [j])),
      lambda a, j: list_append(a, least(a[-1] + 1, p[j[1] + 1] + 1, p[j[1]] + CASE WHEN {w}[e[1]] = {v}[j[1]] THEN 0 ELSE 1 END)))"""
    return f"list_reduce(list_prepend(range(len({v}) + 1), list_transform(range(1, len({w}) + 1), lambda i: [i])), lambda p, e: {row})[-1]"


register(
    "F04_edit_distance",
    lambda s, d: _pairs(s, d).select(*_SEGK, T.edit_distance(F.col("w"), F.col("v")).alias("words")),
    f"WITH {SEG}, {_PAIRS} SELECT conv_id, turn, k, {_distance_sql('w', 'v')} AS words FROM pq",
)
# DuckDB's own distance counts bytes, so it serves ASCII only.
register(
    "F04_char_distance",
    lambda s, d: _pairs(s, d).select(*_SEGK, F.levenshtein("t", "u").cast("long").alias("chars")),
    f"""WITH {SEG}, {_PAIRS}, tx AS (SELECT conv_id, turn, k, array_to_string(w, ' ') AS t, array_to_string(v, ' ') AS u FROM pq), ch AS (SELECT *, string_split(t, '') AS tc, string_split(u, '') AS uc FROM tx)
    SELECT conv_id, turn, k, CASE WHEN strlen(t) = length(t) AND strlen(u) = length(u) THEN levenshtein(t, u) ELSE {_distance_sql('tc', 'uc')} END AS chars FROM ch""",
)


def error_rate(s, d):
    """Word errors of each conversation's neighbouring pieces, over the words of the first of each."""
    pairs = _pairs(s, d).select("conv_id", T.edit_distance(F.col("w"), F.col("v")).alias("errors"), F.size("w").alias("n"))
    return pairs.groupBy("conv_id").agg(F.sum("errors").alias("errors"), F.sum("n").alias("words"), F.try_divide(F.sum("errors").cast("double"), F.sum("n")).alias("rate"))


register(
    "F04_error_rate",
    error_rate,
    f"""WITH {SEG}, {_PAIRS}, ds AS (SELECT conv_id, {_distance_sql('w', 'v')} AS e, len(w) AS n FROM pq)
    SELECT conv_id, sum(e)::BIGINT AS errors, sum(n)::BIGINT AS words, sum(e)::DOUBLE / nullif(sum(n), 0) AS rate FROM ds GROUP BY conv_id""",
)


def _jaccard(pairs):
    return pairs.select(*_SEGK, T.jaccard(F.array_distinct("w"), F.array_distinct("v")).alias("j"))


def _quote(pairs):
    return pairs.select(*_SEGK, T.quote_position(F.concat("w", F.array(F.lit("."), F.lit("!")), "v"), F.slice("w", F.greatest(F.size("w") - 1, F.lit(1)), F.lit(2))).cast("long").alias("at"))


register(
    "F05_jaccard",
    lambda s, d: _jaccard(_pairs(s, d)),
    f"WITH {SEG}, {_PAIRS} SELECT conv_id, turn, k, len(list_intersect(w, v))::DOUBLE / greatest(len(list_distinct(list_concat(w, v))), 1) AS j FROM pq",
)
register(
    "F06_last_words",
    lambda s, d: _seg(s, d, F.concat_ws(" ", T.last_words(F.col("text"), 3)).alias("tail"), T.ends_with_function_word(F.col("text")).alias("fw")),
    rf"""WITH {SEG}, w AS (SELECT *, regexp_extract_all(text, '[^ \t\n\r\f]+') AS ws, regexp_extract_all({NORM}, '[^ \t\n\r\f]+') AS nw FROM seg)
    SELECT conv_id, turn, k, array_to_string(ws[greatest(len(ws) - 2, 1):], ' ') AS tail, coalesce(list_contains({T.FUNCTION_WORDS}, nw[-1]), false) AS fw FROM w""",
)
register("F08_hash_unit", lambda s, d: table(s, d, "documents").select("doc_id", T.hash_unit(F.col("doc_id"), "x").alias("u")),
    "SELECT doc_id, ('0x' || substr(sha256('x:' || doc_id), 1, 15))::BIGINT::DOUBLE / 1152921504606846976.0::DOUBLE AS u FROM documents")
register("F09_hash_order", lambda s, d: table(s, d, "documents").select("doc_id", F.row_number().over(W.partitionBy("source").orderBy(T.hash_order(F.col("doc_id"), "o"))).alias("r")),
    "SELECT doc_id, row_number() OVER (PARTITION BY source ORDER BY sha256('o:' || doc_id)) AS r FROM documents")
register("F10_quote", lambda s, d: _quote(_pairs(s, d)),
    f"""WITH {SEG}, {_PAIRS}, x AS (SELECT *, list_concat(list_concat(w, ['.', '!']), v) AS a, w[greatest(len(w) - 1, 1):] AS q FROM pq), p AS (SELECT *, list_filter(generate_series(1, len(a) - len(q) + 1), lambda i: a[i:i + len(q) - 1] = q)[1] + len(q) - 1 AS e FROM x)
    SELECT conv_id, turn, k, CASE WHEN e = len(w) THEN e + 2 ELSE e END AS at FROM p""")
# A reply to three questions: marks around numbers, a repeated one, one not asked for, and sometimes one missing.
_REPLY = """concat('**0:** ', text, chr(10), 'noise', chr(10), '- 1. ', n * 3 - 2, '/10', chr(10), '7: x', chr(10), '(2) : 007 of ', n, chr(10),
  CASE WHEN k % 3 = 0 THEN '02:  maybe ' ELSE '1 - no' END, CASE WHEN k % 5 = 4 THEN concat(chr(10), '0. ') ELSE '' END, CASE WHEN k % 7 = 6 THEN '12345 words' ELSE '' END)"""
register(
    "F11_numbered",
    lambda s, d: segments(s, d).select(*_SEGK, F.explode(T.parse_numbered(F.expr(_REPLY.replace("chr(10)", "char(10)")), F.when(F.col("k") % 11 == 10, 4).otherwise(3))).alias("r")).select(*_SEGK, "r.*"),
    rf"""WITH {SEG}, p AS (SELECT conv_id, turn, k, {_REPLY} AS reply, CASE WHEN k % 11 = 10 THEN 4 ELSE 3 END AS asked FROM seg),
    l AS (SELECT *, unnest(regexp_extract_all(reply, '(?m)^\W*(\d+)\W*[:.]\s*(.+)$', 1)) AS no, unnest(regexp_extract_all(reply, '(?m)^\W*(\d+)\W*[:.]\s*(.+)$', 2)) AS answer,
      unnest(range(len(regexp_extract_all(reply, '(?m)^\W*(\d+)\W*[:.]\s*(.+)$', 1)))) AS place FROM p),
    g AS (SELECT conv_id, turn, k, asked, no::INT AS no, trim(arg_max(answer, place), ' ' || chr(9) || chr(10) || chr(13)) AS answer FROM l WHERE no::BIGINT < asked GROUP BY ALL),
    c AS (SELECT *, count(*) OVER (PARTITION BY conv_id, turn, k) AS n_ FROM g)
    SELECT conv_id, turn, k, no, answer, CASE WHEN regexp_matches(answer, '^\d') THEN least(10, regexp_extract(answer, '^\d+')::BIGINT)::INT END AS score FROM c WHERE n_ = asked"""
)
_VERDICT = "concat('Answer: ', CASE WHEN n % 2 = 0 THEN 'no' ELSE 'yes' END, '. ', text, CASE k % 3 WHEN 0 THEN ' ANSWER: yes' WHEN 1 THEN ' so ANSWER:no' ELSE '' END)"
register(
    "F12_verdict",
    lambda s, d: segments(s, d).select(*_SEGK, T.parse_verdict(F.expr(_VERDICT)).alias("v"), T.parse_verdict(F.col("text")).alias("w")),
    rf"""WITH {SEG}, r AS (SELECT conv_id, turn, k, regexp_extract_all(lower({_VERDICT}), 'answer:\s*(yes|no)', 1)[-1] AS a, regexp_extract_all(lower(text), 'answer:\s*(yes|no)', 1)[-1] AS b FROM seg)
    SELECT conv_id, turn, k, CASE a WHEN 'yes' THEN 1 WHEN 'no' THEN 0 END AS v, CASE b WHEN 'yes' THEN 1 WHEN 'no' THEN 0 END AS w FROM r""",
)
register("F13_time_grid", lambda s, d: segments(s, d).select(*_SEGK, F.explode(T.time_grid(F.col("start_ms"), F.col("end_ms"), 700)).alias("t")),
    f"WITH {SEG} SELECT conv_id, turn, k, unnest(list_distinct(list_append(generate_series(start_ms, end_ms, 700), end_ms))) AS t FROM seg")


def _post(s, d):
    e = lambda i: F.exp(F.element_at("embedding", i).cast("double"))
    total = e(1) + e(2) + e(3) + e(4)
    silent = 1 / (1 + F.exp(-F.element_at("embedding", 17).cast("double")))
    return table(s, d, "embeddings").select("vec_id", (e(1) / total).alias("own"), (e(2) / total).alias("oth"), (e(3) / total).alias("op"), silent.alias("si"))


_POST = "po AS (SELECT vec_id, exp(embedding[1]::DOUBLE) / t AS own, exp(embedding[2]::DOUBLE) / t AS oth, exp(embedding[3]::DOUBLE) / t AS op, 1 / (1 + exp(-embedding[17]::DOUBLE)) AS si FROM (SELECT *, exp(embedding[1]::DOUBLE) + exp(embedding[2]::DOUBLE) + exp(embedding[3]::DOUBLE) + exp(embedding[4]::DOUBLE) AS t FROM embeddings))"
_GROUPS = ["backchannel", "noncontent", "floor_taking", "turn", "attempt"]


def _variants(s, d):
    soft = lambda first, n: [F.exp(F.element_at("embedding", first + k).cast("double")) / sum((F.exp(F.element_at("embedding", first + j).cast("double")) for j in range(1, n)), F.exp(F.element_at("embedding", first).cast("double"))) for k in range(n)]
    e = table(s, d, "embeddings").withColumns({"channel": F.col("vec_id") % 20} | {f"p{h}_{k}": c for h in range(4) for k, c in enumerate(soft(1 + 4 * h, 4))} | {f"g{o}_{k}": c for o in range(2) for k, c in enumerate(soft(18 + 5 * o, 5))})
    e = e.withColumn("si", 1 / (1 + F.exp(-F.element_at("embedding", 17).cast("double"))))
    at = [[F.col(f"p{h}_{k}") for k in range(4)] for h in range(4)]
    told = T.score_variants(*at, F.col("si"), *[{g: F.col(f"g{o}_{k}") for k, g in enumerate(_GROUPS)} for o in range(2)], W.partitionBy("channel").orderBy("vec_id"))
    return e.select("vec_id", *[F.round(c, 9).alias(k) for k, c in told.items()])


def _variants_sql() -> str:
    soft = lambda first, n, name: ", ".join(f"exp(embedding[{first + k}]::DOUBLE) / ({' + '.join(f'exp(embedding[{first + j}]::DOUBLE)' for j in range(n))}) AS {name}_{k}" for k in range(n))
    ex = ", ".join([*[soft(1 + 4 * h, 4, f"p{h}") for h in range(4)], *[soft(18 + 5 * o, 5, f"g{o}") for o in range(2)]])
    past = lambda c, n: f"coalesce(max({c}) OVER (PARTITION BY vec_id % 20 ORDER BY vec_id ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING), 0)"
    v = {"eot": "p0_2 + p0_1", "eot_f04": "p1_2 + p1_1", "eot_mix": "(p0_2 + p0_1 + p1_2 + p1_1) / 2", "int": "p2_0", "int_f04": "p1_0", "int_f16": "p3_0", "int_mix": "(p1_0 + p2_0 + p3_0) / 3"}
    v |= {f"eot_tr{n}": f"(p0_2 + p0_1) * {past('p0_0', n)}" for n in (5, 10, 20)} | {f"eot_f04_tr{n}": f"(p1_2 + p1_1) * {past('p0_0', n)}" for n in (5, 10, 20)}
    v |= {"int_tr10": f"p2_0 * {past('p0_1', 10)}", "eot_q": "(p0_2 + p0_1) * si", "eot_f04_q": "(p1_2 + p1_1) * si", "eot_mix_q": "(p0_2 + p0_1 + p1_2 + p1_1) / 2 * si", "eot_q_sqrt": "(p0_2 + p0_1) * sqrt(si)",
          "int_spk": "p1_0 * (1 - si)", "int_nobc": "p1_0 * (1 - si) * greatest(least(1 - g0_0 - g0_1, 1), 0)", "int_ft": "g0_2", "int_claim": "p1_0 * (g0_2 + g0_3)", "eot_nobc": "(p0_2 + p0_1) * si * greatest(least(1 - g1_0 - g1_1, 1), 0)"}
    return f"WITH e AS (SELECT vec_id, {ex}, 1 / (1 + exp(-embedding[17]::DOUBLE)) AS si FROM embeddings) SELECT vec_id, {', '.join(f'round(greatest(least({x}, 1.0::DOUBLE), 0.0::DOUBLE), 9) AS {k}' for k, x in v.items())} FROM e"


register("F14_variants", _variants, _variants_sql())
register("F15_fuse", lambda s, d: _post(s, d).select("vec_id", T.fuse_geometric(F.col("own"), F.when(F.col("vec_id") % 3 != 0, F.col("si")), 0.3).alias("g"), T.fuse_logit(F.col("own"), F.col("si"), 0.3).alias("l")),
    f"WITH {_POST} SELECT vec_id, power(own, 0.7::DOUBLE) * power(CASE WHEN vec_id % 3 <> 0 THEN si ELSE 0.5::DOUBLE END, 0.3::DOUBLE) AS g, 1 / (1 + exp(-(0.7::DOUBLE * ln(own / (1 - own)) + 0.3::DOUBLE * ln(si / (1 - si))))) AS l FROM po")
register("F16_yes", lambda s, d: _post(s, d).select("vec_id", T.yes_probability(F.array(F.struct(F.lit(" Yes").alias("token"), F.log("own").alias("logprob")), F.struct(F.lit("no").alias("token"), F.log("oth").alias("logprob")), F.struct(F.lit("maybe").alias("token"), F.log("op").alias("logprob")))).alias("p")),
    f"WITH {_POST} SELECT vec_id, own / (own + oth) AS p FROM po")
register("F17_vap_near", lambda s, d: table(s, d, "embeddings").select("vec_id", T.vap_near_probability(F.transform("embedding", lambda x: F.abs(x)), 2).alias("p")),
    "SELECT vec_id, list_sum(list_transform(generate_series(0, len(embedding) - 1), lambda i: CASE WHEN (i // 4) % 2 = 1 THEN abs(embedding[i + 1])::DOUBLE ELSE 0 END)) AS p FROM embeddings")


def meta(s, d):
    line = table(s, d, "lineitem").groupBy("l_orderkey").agg(F.min("l_suppkey").alias("supp"))
    o = table(s, d, "orders").join(line, F.col("o_orderkey") == F.col("l_orderkey"))
    return o.select(F.col("o_orderkey").alias("conv_id"), F.concat(F.lit("c"), "o_custkey").alias("actor_1"), F.concat(F.lit("s"), "supp").alias("actor_2"), F.col("o_orderpriority").alias("type")).distinct()


META = "mt AS (SELECT DISTINCT o_orderkey AS conv_id, 'c' || o_custkey AS actor_1, 's' || supp AS actor_2, o_orderpriority AS type FROM orders JOIN (SELECT l_orderkey, min(l_suppkey) AS supp FROM lineitem GROUP BY 1) ON o_orderkey = l_orderkey)"
_SPLIT = f"""{META}, ac AS (SELECT actor, ('0x' || substr(sha256('s:' || actor), 1, 15))::BIGINT::DOUBLE / 1152921504606846976.0::DOUBLE AS u FROM (SELECT actor_1 AS actor FROM mt UNION SELECT actor_2 FROM mt)),
dl AS (SELECT actor, CASE WHEN u < 0.6::DOUBLE THEN 'train' WHEN u < 0.8::DOUBLE THEN 'dev' ELSE 'gate' END AS split FROM ac),
sl AS (SELECT mt.*, a.split AS split_1, b.split AS split_2, CASE WHEN a.split = b.split THEN a.split ELSE 'excluded' END AS split FROM mt JOIN dl a ON a.actor = actor_1 JOIN dl b ON b.actor = actor_2)"""


def split(s, d):
    return K.actor_split(meta(s, d), {"train": 0.6, "dev": 0.2, "gate": 0.2}, "s")


register("K01_actor_split", split, f"WITH {_SPLIT} SELECT * FROM sl")
register("K02_recover", lambda s, d: K.recover_cross_partition(split(s, d), "gate"), f"WITH {_SPLIT} SELECT conv_id FROM sl WHERE split = 'excluded' AND split_1 <> 'gate' AND split_2 <> 'gate'")


def _manifest(s, d):
    m = split(s, d).select(
        F.col("conv_id").alias("id"), "split", F.when(F.col("conv_id") % 101 == 0, "other").otherwise("main").alias("source"), "actor_1", "actor_2",
        F.when(F.col("conv_id") % 97 == 0, "old").otherwise("new").alias("revision"),
    )
    return m.unionByName(m.where("id % 89 = 0"))


def leakage(s, d):
    plan = split(s, d).where("conv_id % 79 <> 0").select(F.col("conv_id").alias("id"), F.when(F.col("conv_id") % 83 == 0, "dev").otherwise(F.col("split")).alias("split"))
    dealt = split(s, d).select(F.explode(F.array(*[F.struct(F.col(f"actor_{k}").alias("actor"), F.col(f"split_{k}").alias("split")) for k in (1, 2)])).alias("x")).select("x.*").distinct()
    return K.leakage_report(_manifest(s, d), plan, dealt.where(f"NOT ({_left_out('actor')})"), "main", "new")


def _left_out(actor: str) -> str:
    """Actors that the assignments leave out."""
    return f"right({actor}, 2) = '07'"


register(
    "K03_leakage",
    lambda s, d: leakage(s, d),
    f"""WITH {_SPLIT}, mf AS (SELECT conv_id AS id, split, CASE WHEN conv_id % 101 = 0 THEN 'other' ELSE 'main' END AS source, actor_1, actor_2, CASE WHEN conv_id % 97 = 0 THEN 'old' ELSE 'new' END AS revision FROM sl),
    m2 AS (SELECT * FROM mf UNION ALL SELECT * FROM mf WHERE id % 89 = 0), pl AS (SELECT conv_id AS id, CASE WHEN conv_id % 83 = 0 THEN 'dev' ELSE split END AS planned FROM sl WHERE conv_id % 79 <> 0),
    ea AS (SELECT id, split, actor_1 AS actor FROM m2 UNION ALL SELECT id, split, actor_2 FROM m2)
    SELECT 'source' AS problem, id::VARCHAR AS id FROM m2 WHERE source <> 'main' UNION ALL SELECT 'revision', id::VARCHAR FROM m2 WHERE revision <> 'new'
    UNION ALL SELECT 'not_planned', id::VARCHAR FROM m2 WHERE id NOT IN (SELECT id FROM pl) UNION ALL SELECT 'split', id::VARCHAR FROM m2 JOIN pl USING (id) WHERE split <> planned
    UNION ALL SELECT 'doubled', id::VARCHAR FROM m2 GROUP BY id HAVING count(*) > 1
    UNION ALL SELECT DISTINCT 'actor_elsewhere', id::VARCHAR FROM ea LEFT JOIN dl ON dl.actor = ea.actor AND NOT ({_left_out('dl.actor')}) WHERE dl.split IS DISTINCT FROM ea.split
    UNION ALL SELECT 'shared_actor', actor FROM ea GROUP BY actor HAVING min(split) <> max(split)""",
)
register(
    "K04_components",
    lambda s, d: K.actor_components(meta(s, d)),
    f"""WITH RECURSIVE {META}, ea AS (SELECT conv_id, actor_1 AS actor FROM mt UNION SELECT conv_id, actor_2 FROM mt), le AS (SELECT actor, min(conv_id) AS least FROM ea GROUP BY actor),
    ed AS MATERIALIZED (SELECT DISTINCT conv_id AS a, least AS b FROM ea JOIN le USING (actor) WHERE conv_id <> least), bo AS MATERIALIZED (SELECT a, b FROM ed UNION SELECT b, a FROM ed),
    -- From the least of each actor's conversations along the links, with labels only going down.
    rc AS (SELECT conv_id AS n, conv_id AS l, 0 AS step FROM mt UNION ALL SELECT n, min(l) AS l, max(step) AS step FROM (SELECT bo.b AS n, rc.l, step + 1 AS step FROM rc JOIN bo ON bo.a = rc.n WHERE rc.l < bo.b AND step < 12) GROUP BY n)
    SELECT n AS conv_id, min(l) AS component FROM rc GROUP BY n""",
)
_CLIPS = "source AS feed", "concat(source, '/', doc_id % 50) AS episode", "doc_id AS clip", "n_chars / 15.0D AS seconds"
register(
    "K05_select_clips",
    lambda s, d: K.select_clips(table(s, d, "documents").selectExpr(*_CLIPS), 36000.0, 3000.0, 600.0, "c", 5.0, 900.0),
    """WITH m AS (SELECT source AS feed, source || '/' || doc_id % 50 AS episode, doc_id AS clip, n_chars / 15.0::DOUBLE AS seconds FROM documents),
    o AS (SELECT *, ('0x' || substr(sha256('c:' || episode || '#' || clip), 1, 15))::BIGINT::DOUBLE / 1152921504606846976.0 AS by_ FROM m WHERE seconds BETWEEN 5 AND 900),
    l AS (SELECT feed, list({'by_': by_, 'episode': episode, 'clip': clip, 'seconds': seconds} ORDER BY by_, episode, clip) AS a FROM o GROUP BY feed),
    -- Clip by clip: what is kept, unless the feed or the episode would be over its cap.
    k AS (SELECT feed, unnest(list_reduce(list_prepend(a[:0], list_transform(a, lambda x: [x])), lambda y, x: CASE WHEN coalesce(list_sum(list_transform(y, lambda z: z.seconds)), 0) + x[1].seconds <= 3000
      AND coalesce(list_sum(list_transform(list_filter(y, lambda z: z.episode = x[1].episode), lambda z: z.seconds)), 0) + x[1].seconds <= 600 THEN list_concat(y, x) ELSE y END)) AS c FROM l),
    r AS (SELECT feed, c.episode AS episode, c.clip AS clip, c.seconds AS seconds, coalesce(sum(c.seconds) OVER (ORDER BY c.by_, c.episode, c.clip ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM k)
    SELECT feed, episode, clip, seconds FROM r WHERE before < 36000""",
)
_UNIT = "('0x' || substr(sha256('d:{}/' || conv_id), 1, 15))::BIGINT::DOUBLE / 1152921504606846976.0::DOUBLE"
register(
    "K06_donors",
    lambda s, d: K.donor_plan(table(s, d, "conversations"), "conv_id", 3, "d", {"babble": 0.5, "music": 0.3, "near": 0.2}, (5.0, 20.0)),
    f"""WITH r AS (SELECT conv_id, row_number() OVER (ORDER BY sha256('d:' || conv_id)) - 1 AS rk, count(*) OVER () AS n, floor({_UNIT.format('channel')} * 2)::INT + 1 AS channel,
      CASE WHEN {_UNIT.format('style')} < 0.5 THEN 'babble' WHEN {_UNIT.format('style')} < 0.8 THEN 'music' ELSE 'near' END AS style, round(5 + {_UNIT.format('snr')} * 15, 6) AS snr FROM (SELECT DISTINCT conv_id FROM conversations))
    SELECT a.conv_id, a.channel, k::INT AS nth, b.conv_id AS donor, a.style, a.snr FROM r a, (SELECT unnest([1, 2, 3]) AS k), r b WHERE b.rk = (a.rk + k) % a.n""",
)


def _script(s, d):
    """Turns as script items: pauses, roles, languages and interruptions by their numbers."""
    talk = table(s, d, "conversations").where("role != 'system'")
    kind = F.expr(r"CASE WHEN regexp_count(text, '\\S+') <= 2 THEN 'backchannel' WHEN (conv_id + turn) % 4 = 0 THEN 'interruption' ELSE 'turn' END")
    text = F.expr("concat(text, CASE WHEN conv_id % 3 = 0 THEN ' <pause 0.5>' ELSE '' END, CASE WHEN conv_id % 17 = 5 AND turn = 2 THEN ' As an AI I' ELSE '' END)")
    return talk.select(
        F.col("conv_id").alias("script_id"), F.col("turn").alias("pos"), F.col("turn").alias("id"), F.col("role").alias("speaker"), kind.alias("kind"), text.alias("text"), (F.col("turn") - 1).alias("host"),
        F.expr("(conv_id * 7 + turn) % 15").alias("after_word"), F.expr("turn % 2 = 0").alias("takes_floor"), F.expr("CASE WHEN conv_id % 5 = 0 THEN 'ja' ELSE 'en' END").alias("language"),
    )


register(
    "K08_dialogue_filter",
    lambda s, d: K.dialogue_filter(_script(s, d), least_items=6),
    r"""WITH i0 AS (SELECT conv_id AS script_id, turn AS pos, role AS speaker, text || CASE WHEN conv_id % 3 = 0 THEN ' <pause 0.5>' ELSE '' END || CASE WHEN conv_id % 17 = 5 AND turn = 2 THEN ' As an AI I' ELSE '' END AS text,
      CASE WHEN len(regexp_extract_all(text, '\S+')) <= 2 THEN 'backchannel' WHEN (conv_id + turn) % 4 = 0 THEN 'interruption' ELSE 'turn' END AS kind, turn - 1 AS host, (conv_id * 7 + turn) % 15 AS after_word, turn % 2 = 0 AS takes_floor, conv_id % 5 = 0 AS ja
      FROM conversations WHERE role <> 'system'),
    i AS (SELECT *, regexp_replace(text, '<pause\s+[0-9.]+\s*>', ' ', 'g') AS cl, kind = 'turn' OR (kind = 'interruption' AND takes_floor) AS floor FROM i0),
    x AS (SELECT *, len(regexp_extract_all(cl, '[^ \t\n\r\f]+')) AS n, coalesce(lower(trim(text)) = lag(lower(trim(text))) OVER w AND kind = 'turn' AND lag(kind) OVER w = 'turn', false) AS again FROM i WINDOW w AS (PARTITION BY script_id ORDER BY pos)),
    h AS (SELECT *, CASE WHEN speaker = lag(speaker) OVER (PARTITION BY script_id ORDER BY pos) THEN 0 ELSE 1 END AS c FROM x WHERE floor), h2 AS (SELECT script_id, sum(c) OVER (PARTITION BY script_id ORDER BY pos) AS run FROM h),
    r AS (SELECT script_id, max(k) AS run FROM (SELECT script_id, run, count(*) AS k FROM h2 GROUP BY ALL) GROUP BY 1),
    sh AS (SELECT script_id, min(w)::DOUBLE / nullif(sum(w), 0) AS share, count(*) AS speakers FROM (SELECT script_id, speaker, sum(n) AS w FROM x GROUP BY ALL) GROUP BY 1),
    wk AS (SELECT DISTINCT a.script_id FROM x a JOIN x b ON b.script_id = a.script_id AND b.pos = a.host WHERE a.kind = 'interruption' AND a.takes_floor AND (b.n - a.after_word < 6 OR a.n < 5)),
    f AS (SELECT script_id, count(*) AS items, max(CASE WHEN kind = 'backchannel' THEN n END) AS bc, max(CASE WHEN kind = 'turn' THEN n END) AS turn, bool_or(again) AS again, bool_or(regexp_matches(cl, '[\[(*].*?[\])*]')) AS stage,
      bool_or(regexp_matches(lower(cl), '\bas an ai\b')) AS role, bool_or(floor AND text LIKE '%<pause 0.5>%') AS pauses, bool_or(ja) AS ja, sum(length(regexp_replace(cl, '[ \t\n\r\f]+', '', 'g')))::DOUBLE / greatest(sum(n), 1) AS chars FROM x GROUP BY 1),
    o AS (SELECT f.script_id, array_to_string(list_filter([CASE WHEN bc > 4 THEN 'long_backchannel' END, CASE WHEN turn > 120 THEN 'long_turn' END, CASE WHEN run > 4 THEN 'monologue_run' END, CASE WHEN NOT pauses THEN 'no_pauses' END,
      CASE WHEN share < 0.15 OR speakers < 2 OR share IS NULL THEN 'participation' END, CASE WHEN role THEN 'role_break' END, CASE WHEN stage THEN 'stage_direction' END, CASE WHEN items < 6 THEN 'too_short' END,
      CASE WHEN ja AND chars > 3.5 THEN 'unsegmented' END, CASE WHEN again THEN 'verbatim_repeat' END, CASE WHEN wk.script_id IS NOT NULL THEN 'weak_interruption' END], lambda v: v IS NOT NULL), ',') AS reasons
      FROM f LEFT JOIN r USING (script_id) JOIN sh USING (script_id) LEFT JOIN wk USING (script_id)) SELECT * FROM o WHERE reasons <> ''""",
)
register(
    "K11_batches",
    lambda s, d: K.constrained_batches(segments(s, d).select(*_SEGK), ["conv_id", "turn"], "k", 15, "b"),
    f"""WITH {SEG}, l AS (SELECT conv_id, turn, k, row_number() OVER (PARTITION BY conv_id, turn ORDER BY k) - 1 AS lane FROM seg)
    SELECT *, (row_number() OVER (PARTITION BY lane ORDER BY sha256('b:' || conv_id || '/' || turn || '/' || k)) - 1) // 15 AS batch FROM l""",
)
register(
    "K12_dedupe_prompts",
    lambda s, d: K.dedupe_prompts(table(s, d, "conversations"), ["role", "text"], "conv_id").select("role", "text", F.array_join(F.transform("uses", lambda x: x.cast("string")), ",").alias("uses")),
    "SELECT role, text, array_to_string(list_sort(list(DISTINCT conv_id)), ',') AS uses FROM conversations GROUP BY role, text",
)
register("K13_folds", lambda s, d: K.folds(table(s, d, "conversations"), "conv_id", 5), "SELECT conv_id, (row_number() OVER (ORDER BY conv_id) - 1) % 5 AS fold FROM (SELECT DISTINCT conv_id FROM conversations)")
register(
    "S07_validate",
    lambda s, d: K.validate_predictions(_records(s, d), segments(s, d).groupBy("conv_id").agg((F.max("end_ms") - 1000).alias("duration"))),
    f"""WITH {SEG}, c AS (SELECT conv_id, max(end_ms) - 1000 AS duration FROM seg GROUP BY 1), r0 AS (SELECT conv_id + CASE WHEN conv_id % 10 = 0 THEN 100000 ELSE 0 END AS conv_id, list(end_ms) AS times FROM seg GROUP BY 1), r AS (SELECT * FROM r0 UNION ALL SELECT * FROM r0 WHERE conv_id % 7 = 3)
    SELECT 'missing' AS problem, conv_id FROM c WHERE conv_id NOT IN (SELECT conv_id FROM r) UNION ALL SELECT 'unknown', conv_id FROM r WHERE conv_id NOT IN (SELECT conv_id FROM c)
    UNION ALL SELECT 'doubled', conv_id FROM r GROUP BY conv_id HAVING count(*) > 1 UNION ALL SELECT 'range', conv_id FROM r JOIN c USING (conv_id) WHERE len(list_filter(times, lambda t: t < 0 OR t > duration)) > 0""",
)


def _records(s, d):
    r = segments(s, d).groupBy((F.col("conv_id") + F.when(F.col("conv_id") % 10 == 0, 100000).otherwise(0)).alias("conv_id")).agg(F.collect_list("end_ms").alias("times"))
    return r.unionByName(r.where("conv_id % 7 = 3"))


register("S08_pending", lambda s, d: K.pending(table(s, d, "documents").select("doc_id"), table(s, d, "labels").withColumn("r", F.when(F.col("doc_id") % 5 != 0, F.col("quality"))), "doc_id", "r"),
    "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id % 5 <> 0)")
def _run_of(s, d, name: str, where: str):
    return table(s, d, "documents").where(where).select("doc_id", F.lit(name).alias("run"), F.expr("CASE WHEN doc_id % 7 = 0 THEN 'own' WHEN doc_id % 7 = 1 THEN 'dev' ELSE 'train' END").alias("split"))


register(
    "S09_merge_runs",
    lambda s, d: K.merge_runs([_run_of(s, d, "a", "doc_id % 2 = 0"), _run_of(s, d, "b", "doc_id % 3 = 0"), _run_of(s, d, "c", "true")], "doc_id", table(s, d, "documents").where("doc_id % 5 <> 0"), "split", "own", "dev"),
    """SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'a' WHEN doc_id % 3 = 0 THEN 'b' ELSE 'c' END AS run, CASE WHEN doc_id % 7 = 1 THEN 'dev' ELSE 'train' END AS split
    FROM documents WHERE doc_id % 7 <> 0 AND (doc_id % 7 <> 1 OR doc_id % 5 <> 0)""",
)
