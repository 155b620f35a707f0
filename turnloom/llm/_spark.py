"""Spark helpers shared by the operators of this subpackage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from turnloom.sources.settle import settle, shared_path  # noqa: F401

# Fixed values of the contracts: what is white space, and what parts words in the "alphanumeric" sense.
SPACE_WORD = r"[^\x20\x09-\x0D]+"
ALNUM_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: What parts them: cutting at the gaps costs a fraction of matching the words.
SPACE_GAP = r"[\x20\x09-\x0D]+"
ALNUM_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z only. lower() is the same on pure ASCII and much cheaper than translate()."""
    return F.when(F.octet_length(c) == F.length(c), F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))


def words_between(c: Column, gap: str = SPACE_GAP) -> Column:
    """The words of c, which gaps part; null for null."""
    return F.array_remove(F.split(c, gap, -1), "")


def word_count(c: Column, gap: str = SPACE_GAP) -> Column:
    """Number of words; null counts as 0."""
    return F.coalesce(F.size(words_between(c, gap)), F.lit(0)).cast("long")


def ranked(rows: DataFrame, group: list[str], order: list[str], name: str = "at") -> DataFrame:
    """rows with their place from 0 in their group, in `order` (ascending, nulls first). No task orders a group: rows are dealt in ranges of group and order and
    settled, places are counted in a range and offset by the group's rows in the ranges before. Rows equal in all of these are spread by their place in
    the input; they are interchangeable."""
    dealt = rows.withColumn("__tie", F.monotonically_increasing_id())
    dealt = settle(dealt.repartitionByRange(*group, *order, "__tie").withColumn("__range", F.spark_partition_id()), "ranked")
    held = dealt.groupBy(*group, "__range").agg(F.count("*").alias("__n"))
    before = F.sum("__n").over(W.partitionBy(*group).orderBy("__range").rowsBetween(W.unboundedPreceding, -1))
    held = held.withColumn("__before", before).where("__before > 0").drop("__n")  # groups that go on from another range: one to a range at most
    within = F.row_number().over(W.partitionBy(*group, "__range").orderBy(*order, "__tie")) - 1
    out = dealt.withColumn("__within", within).join(held, [*group, "__range"], "left")
    return out.withColumn(name, F.coalesce("__before", F.lit(0)) + F.col("__within")).select(*rows.columns, name)
