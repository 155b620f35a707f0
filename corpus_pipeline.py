"""The corpus pipeline: documents pass five stages, each written as Parquet in the shared folder and read again.

Columns beside doc_id, text, lang and source pass through; those named like the last stage's own (size, text_crc32, law, shard, slot, grown_shard) are replaced
there. A null or empty text fails the quality rules. Of equal rows one stays, as of equal texts; the mix may then take it twice. Empty tables give no rows and
an empty benchmark contaminates nothing. Every stage decides by values and hashes of them, so reruns keep the same documents in the same shards.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from turnloom.llm import decontaminate, mixing, ngram_jaccard, quality, queries, sharding
from turnloom.llm._spark import settle, shared_path


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_jaccard.one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the mix takes twice come twice, those it does not take go."""
    return mixing.mix(docs, queries.SOURCE_WEIGHTS, budget_ratio=queries.BUDGET_RATIO, max_repeats=queries.MAX_REPEATS)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sharding.assign_shards(docs, [1.0] * queries.SHARDS)


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("mixing sources to target weights", source_mix),
    ("sharding", shards),
]

#: The stages on near copies and on language references can't be put in SQL; tests compare them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table documents, the last written as a folder for each shard, by the tasks that number its slots: texts are not shuffled again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    sharded = STAGES[-1][1](spark, docs, sf_dir)
    sharded.write.partitionBy("shard").parquet(path := shared_path(spark, "shards"))
    return spark.read.schema(sharded.schema).parquet(path).select(*sharded.columns)
