"""Sharding by rendezvous hashing over weighted shards."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Blocks of a shard's slots, by key hash: slots are counted in a block and offset by the blocks before.
BLOCK_DIGITS = 3


def rendezvous(key: Column, weights: Mapping[int, float] | Sequence[float], salt: str = "shard") -> Column:
    """The shard with the highest score -weight / ln(u), u in (0, 1) from md5 of salt, shard and key.

    A key's scores do not depend on which other shards there are: one more shard only takes rows into itself.
    """
    pairs = dict(enumerate(weights)) if not isinstance(weights, Mapping) else weights
    return _number(_best(key, pairs, salt))


def _score(key: Column, shard: int, weight: float, salt: str) -> Column:
    digits = F.substring(F.md5(F.concat(F.lit(f"{salt}:{shard}:"), key)), 1, 13)
    u = (F.conv(digits, 16, 10).cast("double") + 0.5) / float(16**13)
    return F.struct((F.lit(-float(weight)) / F.log(u)).alias("s"), F.lit(-int(shard)).alias("n"))


def _best(key: Column, weights: Mapping[int, float], salt: str) -> Column:
    scores = [_score(key, s, w, salt) for s, w in weights.items() if w > 0]
    return scores[0] if len(scores) == 1 else F.greatest(*scores)


def _number(best: Column) -> Column:
    return (-best["n"]).cast("int")


def assign_shards(docs: DataFrame, weights: Sequence[float], salt: str = "shard") -> DataFrame:
    """docs with size (UTF-8 bytes of text plus 16), text_crc32, law, shard, slot and grown_shard (with one more shard
    of the mean weight).

    The law is `key`: doc_id and the shards decide, so equal doc_ids go together and equal texts need not. Slots are
    gapless from 0 in a shard, by hash of the key and text_crc32, then doc_id and text_crc32; rows equal in these are interchangeable.
    Nulls: a null text has 0 bytes, its CRC is that of no bytes; null doc_ids share one key, so one shard, where their slots are
    counted in many blocks unless their texts are equal too. Empty table: no rows. Columns of docs
    with one of the new names are replaced.
    """
    new = ["size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    more = _score(F.col("__key"), len(weights), sum(weights) / len(weights), salt)
    text = F.coalesce(F.col("text"), F.lit(""))
    place = F.md5(F.concat(F.lit(f"{salt}:slot:"), F.col("__key"), F.lit(":"), F.col("text_crc32").cast("string")))
    out = (
        docs.withColumns({"__key": key})
        .withColumns({
            "size": (F.octet_length(text) + 16).cast("long"),
            "text_crc32": F.crc32(text.cast("binary")),
            "law": F.lit("key"),
            "__best": _best(F.col("__key"), dict(enumerate(weights)), salt),
        })
        .withColumns({"shard": _number(F.col("__best")), "grown_shard": _number(F.greatest("__best", more)), "__place": place})
        .withColumn("__block", F.substring("__place", 1, BLOCK_DIGITS))
    )
    within = F.row_number().over(W.partitionBy("shard", "__block").orderBy("__place", "doc_id", "text_crc32"))
    before = W.partitionBy("shard").orderBy("__block").rowsBetween(W.unboundedPreceding, -1)
    held = out.groupBy("shard", "__block").agg(F.count("*").alias("__n"))
    held = held.select(
        F.col("shard").alias("__s"), F.col("__block").alias("__b"), F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__offset")
    )
    return (
        out.withColumn("__within", within)
        .join(held, (F.col("shard") == F.col("__s")) & (F.col("__block") == F.col("__b")))
        .withColumn("slot", (F.col("__offset") + F.col("__within") - 1).cast("long"))
        .select(*[c for c in docs.columns if c not in new], *new)
    )


def write_shards(sharded: DataFrame, path: str, rows_per_file: int = 1_000_000) -> DataFrame:
    """Writes sharded (with shard and slot) as one folder for each shard, in files of consecutive slots, and returns what was written, with its columns.

    A file's rows meet in one task, in no order; a shard with many rows has many files, so no task holds a shard. An empty table
    leaves an empty folder. Columns of sharded that differ in case only, or are named like `__file`, aren't allowed by Parquet or this function.
    """
    by_file = sharded.withColumn("__file", F.floor(F.col("slot") / rows_per_file)).repartition("shard", "__file").drop("__file")
    by_file.write.partitionBy("shard").parquet(path)
    return sharded.sparkSession.read.schema(sharded.schema).parquet(path).select(*sharded.columns)
