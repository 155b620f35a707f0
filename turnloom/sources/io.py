"""Sources and sinks: nested conversations, subtitle files, packed tracks, clip manifests, prediction records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SEGMENT = "struct<start_s:double,end_s:double,label:string,text:string>"
ANNOTATORS = ("a", "b", "c")


def write_conversations(segments: DataFrame, path: str, rows_per_file: int = 50) -> None:
    """segments (conv_id, annotator, speaker, start_s, end_s, label, text) as one nested row for each conversation."""
    item = F.struct("start_s", "end_s", "label", "text")
    columns = [
        F.array_sort(F.collect_list(F.when((F.col("speaker") == k) & (F.col("annotator") == a), item))).alias(f"speaker_{k}_annotation_{a}") for k in (1, 2) for a in ANNOTATORS
    ]
    nested = segments.groupBy(F.col("conv_id").cast("string").alias("conversation_id")).agg(*columns)
    nested.write.option("maxRecordsPerFile", rows_per_file).parquet(path)


def read_conversations(spark: SparkSession, path: str) -> DataFrame:
    """Nested conversations as segments; other columns, as of audio, are not read."""
    df = spark.read.parquet(path)
    lists = [f"speaker_{k}_annotation_{a}" for k in (1, 2) for a in ANNOTATORS]
    parts = F.array(*[F.struct(F.lit(int(c[8])).alias("speaker"), F.lit(c[-1]).alias("annotator"), F.col(c).alias("items")) for c in lists if c in df.columns])
    each = df.select("conversation_id", F.explode(parts).alias("p"))
    return each.select(F.col("conversation_id").alias("conv_id"), "p.speaker", "p.annotator", F.posexplode("p.items").alias("pos", "s")).select("conv_id", "speaker", "annotator", "pos", "s.*")


def _srt_time(c: F.Column) -> F.Column:
    part = lambda i: F.regexp_extract(c, r"([0-9]+):([0-9]{2}):([0-9]{2})[,.]([0-9]{3})", i).cast("long")
    return 3_600_000 * part(1) + 60_000 * part(2) + 1000 * part(3) + part(4)


def read_srt(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(segments, rejects) of subtitle files whose cue text is "[Label] words". A cue of another form is a reject (file, cue)."""
    files = spark.read.text(path, wholetext=True).withColumn("file", F.input_file_name())
    cues = files.select("file", F.posexplode(F.split(F.regexp_replace("value", "\r", ""), r"\n\s*\n")).alias("nth", "cue")).where(F.regexp_like("cue", F.lit(r"\S")))
    times = r"([0-9]+:[0-9]{2}:[0-9]{2}[,.][0-9]{3}) --> ([0-9]+:[0-9]{2}:[0-9]{2}[,.][0-9]{3})"
    form = rf"^\s*[0-9]+\n{times}[^\n]*\n\[[^\]]+\]"
    good = F.regexp_like("cue", F.lit(form))
    segments = cues.where(good).select(
        "file", "nth", _srt_time(F.regexp_extract("cue", times, 1)).alias("start_ms"), _srt_time(F.regexp_extract("cue", times, 2)).alias("end_ms"),
        F.regexp_extract("cue", r"\n\[([^\]]+)\]", 1).alias("label"), F.regexp_replace(F.regexp_extract("cue", r"\n\[[^\]]+\]([\s\S]*)$", 1), r"^\s+|\s+$", "").alias("text"),
    )
    return segments, cues.where(~good).select("file", "cue")


def write_srt(segments: DataFrame, path: str, key: str) -> None:
    """segments (key, start_ms, end_ms, label, text) as one subtitle file for each key (a folder key=…)."""
    def stamp(c: str) -> F.Column:
        ms = F.col(c)
        return F.format_string("%02d:%02d:%02d,%03d", F.floor(ms / 3_600_000), F.floor(ms / 60_000) % 60, F.floor(ms / 1000) % 60, ms % 1000)
    line = F.concat(stamp("start_ms"), F.lit(" --> "), stamp("end_ms"), F.lit("\n["), F.col("label"), F.lit("] "), F.col("text"))
    cues = segments.select(key, F.struct("start_ms", line.alias("line")).alias("c")).groupBy(key).agg(F.array_sort(F.collect_list("c")).alias("all"))
    numbered = F.transform("all", lambda c, i: F.concat((i + 1).cast("string"), F.lit("\n"), c["line"]))
    cues.select(key, F.array_join(numbered, "\n\n").alias("value")).write.partitionBy(key).option("lineSep", "\n").text(path)


def write_tracks(frames: DataFrame, path: str, keys: list[str], score: str) -> None:
    """Frames as one array for each key. A conversation's track is short (some 15,000 frames in 20 minutes)."""
    packed = frames.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", score))), lambda x: x[score].cast("float")).alias("score"))
    packed.select(F.concat_ws("/", *keys).alias("key"), "score").write.parquet(path)


def read_tracks(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """Packed tracks as frames; the parts of the key become columns of text."""
    parts = F.split("key", "/")
    return spark.read.parquet(path).select(*[parts[i].alias(k) for i, k in enumerate(keys)], F.posexplode("score").alias("i", "score"))


def write_manifest(manifest: DataFrame, path: str) -> None:
    manifest.write.option("compression", "gzip").json(path)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("rss_url string, audio_url string, dialogue_idx long, duration_sec double").json(path)


def export_predictions(preds: DataFrame, conversations: DataFrame) -> DataFrame:
    """A record (conv_id, speaker_1, speaker_2) for each conversation (conv_id, duration_ms), with the times of preds (conv_id, speaker, t_ms) within
    it, in seconds with three decimals, ascending; empty lists where there are none."""
    fit = preds.join(conversations, "conv_id").where((F.col("t_ms") >= 0) & (F.col("t_ms") <= F.col("duration_ms")))
    lists = [F.array_sort(F.collect_set(F.when(F.col("speaker") == k, F.bround(F.col("t_ms") / 1000.0, 3)))).alias(f"speaker_{k}") for k in (1, 2)]
    out = conversations.select("conv_id").join(fit.groupBy("conv_id").agg(*lists), "conv_id", "left")
    none = F.expr("CAST(array() AS array<double>)")
    return out.select("conv_id", *[F.coalesce(f"speaker_{k}", none).alias(f"speaker_{k}") for k in (1, 2)])
