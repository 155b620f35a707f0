"""Places in a turn where a listener could answer: clause ends, pauses and the end, with the words said by then."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from turnloom.functions.text import norm_text

_TOKEN = r"[^ \t\n\r\f]+"


def turn_candidates(claims: DataFrame, key: str = "conv_id", most: int = 12, least_words: int = 2) -> DataFrame:
    """(key, run, speaker, n_words, t_ms, kind) from segments that claim the floor (key, speaker, start_ms, end_ms, text).

    A turn is a run of one speaker's segments in the order of their starts; segments without words are left out. Candidates: after a word with a
    mark at its end, unless it ends the segment (mid), at the end of each segment but the last (pause), and the end, which always stays. Words are
    spread over a segment by their characters. Of candidates after the same number of words the first counts, those with
    under least_words go, and of more than `most` that many are kept, evenly spread.
    """
    bare = F.regexp_replace("text", r"\[[^\]]*\]", " ")
    seg = claims.withColumn("text", bare).where(norm_text(F.col("text")) != "")
    order = W.partitionBy(key).orderBy("start_ms", "speaker")
    seg = seg.withColumn("__new", F.coalesce((F.col("speaker") != F.lag("speaker").over(order)).cast("int"), F.lit(0))).withColumn("run", F.sum("__new").over(order))
    turn = W.partitionBy(key, "run")
    seg = seg.withColumns({"nth": F.row_number().over(turn.orderBy("start_ms")), "segments": F.count("*").over(turn)}).drop("__new")

    # Each token with the characters up to its end: a token and the blank before it come in turn.
    zipped = F.arrays_zip(F.split("text", _TOKEN, -1).alias("blank"), F.regexp_extract_all("text", F.lit(_TOKEN), F.lit(0)).alias("token"))
    tokens = seg.select(key, "run", "speaker", "nth", "segments", "start_ms", "end_ms", "text", F.posexplode(zipped).alias("j", "x")).where("x.token IS NOT NULL")
    upto = F.sum(F.length("x.blank") + F.length("x.token")).over(W.partitionBy(key, "run", "nth").orderBy("j"))
    tokens = tokens.withColumn("upto", upto).withColumn("word", (norm_text(F.col("x.token")) != "").cast("int"))
    tokens = tokens.withColumn("n_words", F.sum("word").over(turn.orderBy("nth", "j")))
    chars = F.greatest(F.length("text"), F.lit(1))
    at = F.col("start_ms") + (F.col("end_ms") - F.col("start_ms")) * F.col("upto") / chars
    within = F.col("upto") < F.length(F.rtrim(F.regexp_replace("text", r"[ \t\n\r\f]+$", ""))) - 1
    mid = tokens.where((F.col("word") == 1) & F.regexp_like("x.token", F.lit(r"[,.?!;]$")) & within)
    mid = mid.select(key, "run", "speaker", "n_words", at.alias("t_ms"), F.lit("mid").alias("kind"), "nth", F.col("j").alias("place"))
    ends = tokens.groupBy(key, "run", "speaker", "nth", "segments").agg(F.max("n_words").alias("n_words"), F.max("end_ms").cast("double").alias("t_ms"))
    pause = ends.where("nth < segments").select(key, "run", "speaker", "n_words", "t_ms", F.lit("pause").alias("kind"), "nth", F.lit(1 << 30).alias("place"))
    end = ends.where("nth = segments").select(key, "run", "speaker", "n_words", "t_ms", F.lit("end").alias("kind"))

    early = mid.unionByName(pause).join(end.select(key, "run", F.col("n_words").alias("all")), [key, "run"])
    first = F.row_number().over(W.partitionBy(key, "run", "n_words").orderBy("nth", "place"))
    early = early.withColumn("first", first).where((F.col("first") == 1) & (F.col("n_words") >= least_words) & (F.col("n_words") != F.col("all")))
    early = early.withColumns({"rank": F.row_number().over(turn.orderBy("n_words")) - 1, "many": F.count("*").over(turn)})
    spread = F.transform(F.sequence(F.lit(0), F.lit(most - 2)), lambda i: F.bround(i * (F.col("many") - 1) / (most - 2)).cast("int"))
    kept = early.where((F.col("many") <= most - 1) | F.array_contains(spread, F.col("rank")))
    return kept.select(*end.columns).unionByName(end)
