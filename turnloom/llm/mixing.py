"""Mixing sources to target weights by weighted fair queueing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from turnloom.llm._spark import settle, word_count

#: Key blocks of a source's queue: running sums are taken in a block and offset by the sums of the blocks before, so no
#: task orders a whole source. Three hexadecimal digits of the shuffle key.
BLOCK_DIGITS = 3


def source_targets(sizes: DataFrame, weights: Sequence[float], budget_ratio: float, max_repeats: int) -> DataFrame:
    """(source, source_size, weight, target) from (source, size).

    Sources by code point, null last, take the weights in turn. The budget is shared by weight; a target stops at
    max_repeats times its source's size and the excess is shared again. That is the water level: sources in the order of
    cap / weight are capped as long as the level that the rest would get is not below.
    """
    one = W.orderBy(F.col("source").asc_nulls_last())
    by_ratio = W.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = by_ratio.rowsBetween(W.unboundedPreceding, -1)
    after = by_ratio.rowsBetween(W.currentRow, W.unboundedFollowing)
    everything = W.partitionBy(F.lit(1))
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    return (
        sizes.groupBy("source")
        .agg(F.sum("size").alias("source_size"))
        .withColumn("weight", F.element_at(cycle, ((F.row_number().over(one) - 1) % len(weights) + 1).cast("int")))
        .withColumn("cap", F.col("source_size").cast("double") * max_repeats)
        .withColumn("budget", F.sum("source_size").over(everything) * F.lit(float(budget_ratio)))
        .withColumn("level", (F.col("budget") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(after))
        .withColumn("full", F.col("cap") <= F.col("level") * F.col("weight"))
        .withColumn("full", F.min("full").over(by_ratio.rowsBetween(W.unboundedPreceding, 0)))
        .withColumn("level", F.min(F.when(~F.col("full"), F.struct(F.col("cap") / F.col("weight"), F.col("level")))).over(everything)["level"])
        .withColumn("target", F.when(F.col("full") | F.col("level").isNull(), F.col("cap")).otherwise(F.col("level") * F.col("weight")))
        .select("source", "source_size", "weight", "target")
    )


def _slot(finish: Column) -> Column:
    """Range of virtual time, in order: equal steps up to 1, where every source meets its target, then by octaves."""
    return F.when(finish <= 1, F.floor(finish * 4096)).otherwise(4097 + F.floor(512 * F.log2(F.greatest(finish, F.lit(1.0)))))


def fair_queue(
    docs: DataFrame, weights: Sequence[float], budget_ratio: float = 1.5, max_repeats: int = 2, salt: str = "mix", size: Column | None = None
) -> DataFrame:
    """Per row of docs (doc_id, source, text): doc_id, source, size, source_size, target, copies, taken.

    Each source's documents queue in a shuffled order (md5 of salt and doc_id), again for every repeat. A document's
    virtual finish time is the cumulative size of its source's queue over the source's target. Rows of all sources are
    ordered by finish time, in ranges of virtual time whose sums are known, and the order is cut where the running total
    passes the budget. Deterministic: reruns agree.

    Nulls: a null text has size 0; null doc_ids share one key; a null source is a source, the last. Repeated rows and
    equal doc_ids tie and are ordered by size; rows equal in all of these are taken together. Empty table: no rows.
    Further columns are ignored. Sources of size 0 have target 0 and take nothing.
    """
    size = word_count(F.col("text")) if size is None else size
    key = F.md5(F.concat_ws(":", F.lit(salt), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))))
    sized = settle(docs.select("doc_id", "source", size.alias("size"), key.alias("key")), "mix-sized")
    targets = settle(source_targets(sized, weights, budget_ratio, max_repeats), "mix-targets")
    sized = sized.withColumn("block", F.substring("key", 1, BLOCK_DIGITS))
    blocks = sized.groupBy("source", "block").agg(F.sum("size").alias("held"))
    blocks = blocks.select(
        F.col("source").alias("b_source"),
        F.col("block").alias("b_block"),
        F.coalesce(F.sum("held").over(W.partitionBy("source").orderBy("block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("offset"),
    )
    queue = W.partitionBy("source", "block").orderBy("key", "doc_id", "size").rowsBetween(W.unboundedPreceding, 0)
    queued = (
        sized.withColumn("within", F.sum("size").over(queue))
        .join(blocks, F.col("source").eqNullSafe(F.col("b_source")) & (F.col("block") == F.col("b_block")))
        .withColumn("reached", F.col("offset") + F.col("within"))
        .join(targets.withColumnRenamed("source", "t_source"), F.col("source").eqNullSafe(F.col("t_source")))
    )
    finishes = [
        F.when((F.col("size") > 0) & (F.col("target") > 0), (F.col("reached") + p * F.col("source_size")) / F.col("target")) for p in range(max_repeats)
    ]
    queued = settle(
        queued.select("doc_id", "source", "size", "source_size", "target", "key", F.array(*finishes).alias("finish")), "mix-queued"
    )
    turns = queued.select("size", "key", "doc_id", "source", F.explode("finish").alias("finish")).where(F.col("finish").isNotNull())
    turns = turns.withColumn("slot", _slot(F.col("finish")))
    budget = F.lit(float(budget_ratio)) * targets.agg(F.coalesce(F.sum("source_size"), F.lit(0)).alias("n")).first()["n"]
    slots = turns.groupBy("slot").agg(F.sum("size").alias("held"))
    slots = slots.withColumn("upto", F.sum("held").over(W.orderBy("slot")))
    edge = slots.where(F.col("upto") > budget).orderBy("slot").first()
    if edge is None:
        cut = F.lit(True)
    else:
        order = F.struct("finish", "key", "doc_id", "size")
        inside = turns.where(F.col("slot") == edge["slot"])
        upto = F.sum("size").over(W.partitionBy("slot").orderBy("finish", "key", "doc_id", "size")) + (edge["upto"] - edge["held"])
        last = inside.select(order.alias("o"), upto.alias("upto")).where(F.col("upto") <= budget).agg(F.max("o").alias("o")).first()["o"]
        cut = None if last is None else F.struct(*[F.lit(last[c]).alias(c) for c in ("finish", "key")])
    def taken(i: int) -> Column:
        f = F.col("finish")[i]
        if edge is None:
            return f.isNotNull()
        early = _slot(f) < edge["slot"]
        return f.isNotNull() & (early if cut is None else early | ((_slot(f) == edge["slot"]) & (F.struct(f.alias("finish"), F.col("key")) <= cut)))

    copies = sum((F.coalesce(taken(i), F.lit(False)).cast("int") for i in range(1, max_repeats)), F.coalesce(taken(0), F.lit(False)).cast("int"))
    return queued.select("doc_id", "source", "size", "source_size", "target", copies.alias("copies"), (F.col("size") * copies).alias("taken"))


def mix(docs: DataFrame, weights: Sequence[float], **options) -> DataFrame:
    """The documents of the mix, with the columns of docs: those that the mix takes twice come twice.

    Rows that agree in doc_id, source and size have the same number of copies each.
    """
    size = word_count(F.col("text"))
    plan = fair_queue(docs, weights, size=size, **options)
    plan = plan.groupBy("doc_id", "source", "size").agg(F.max("copies").alias("copies")).where("copies > 0")
    plan = plan.select(*[F.col(c).alias(f"__{c}") for c in ("doc_id", "source", "size", "copies")])
    sized = docs.withColumn("__words", size)
    on = sized["doc_id"].eqNullSafe(plan["__doc_id"]) & sized["source"].eqNullSafe(plan["__source"]) & (sized["__words"] == plan["__size"])
    return sized.join(plan, on).withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies")))).select(*[docs[c] for c in docs.columns])
