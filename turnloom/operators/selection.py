"""Choice of policies under budgets, checks on held-out halves, annotators as systems, and grouped cross-validation."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import PCA, StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from turnloom.functions.text import hash_unit
from turnloom.operators import scoring


def pick_policies(summary: DataFrame, budgets: list[float], caps_ms: list[float]) -> DataFrame:
    """For each family, budget and latency cap, the policy with the highest recall; ties by lower p50_ms, then by policy.

    summary (family, policy, recall, fp_rate, p50_ms). Where no policy fits, there is no row; without latency, any cap holds.
    """
    def each(values: list[float]) -> object:
        return F.explode(F.array(*[F.lit(float(v)) for v in values]))
    rows = summary.select("*", each(budgets).alias("budget")).select("*", each(caps_ms).alias("cap_ms"))
    fit = rows.where("fp_rate <= budget AND coalesce(p50_ms <= cap_ms, true)")
    order = W.partitionBy("family", "budget", "cap_ms").orderBy(F.desc_nulls_last("recall"), F.asc_nulls_last("p50_ms"), "policy")
    return fit.withColumn("__r", F.row_number().over(order)).where("__r = 1").drop("__r")


def split_half(counts: DataFrame, unit: str, budget: float, n: int, salt: str) -> DataFrame:
    """What a policy chosen on one half does on the other, over n splits: mean recall, mean and 95th percentile of the false-positive rate, and splits.

    counts (policy, unit, tp, fn, fp, tn). Each unit falls in a half by its own hash, so no split needs an order of all units; halves are equal on average.
    The choice is the highest recall within the budget, then the lowest policy. Splits without one, or without events in the other half, don't count.
    """
    cells = counts.groupBy("policy", unit).agg(*[F.sum(c).alias(c) for c in ("tp", "fn", "fp", "tn")])
    split = cells.withColumn("split", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    chosen = hash_unit(F.concat_ws("/", F.col(unit).cast("string"), F.col("split").cast("string")), salt) < 0.5
    sums = [F.sum(F.when(side, F.col(c)).otherwise(0)).alias(f"{c}_{h}") for h, side in (("a", chosen), ("b", ~chosen)) for c in ("tp", "fn", "fp", "tn")]
    rates = split.groupBy("split", "policy").agg(*sums)
    for h in "ab":
        rates = rates.withColumn(f"recall_{h}", F.expr(f"try_divide(double(tp_{h}), tp_{h} + fn_{h})")).withColumn(f"fp_{h}", F.expr(f"try_divide(double(fp_{h}), fp_{h} + tn_{h})"))
    best = W.partitionBy("split").orderBy(F.desc_nulls_last("recall_a"), "policy")
    held = rates.where(F.col("fp_a") <= budget).withColumn("__r", F.row_number().over(best)).where("__r = 1 AND recall_b IS NOT NULL AND fp_b IS NOT NULL")
    return held.agg(F.avg("recall_b").alias("recall"), F.avg("fp_b").alias("fp_rate"), F.percentile("fp_b", 0.95).alias("fp_p95"), F.count("*").alias("splits"))


def grouped_cv_scores(rows: DataFrame, features: str, y: str, group: str, folds: int, components: int, salt: str) -> DataFrame:
    """rows with score: the out-of-fold probability of y from standardised features, their principal components and a logistic regression.

    A group's rows share a fold, by the hash of the group. One model for each fold; all rows train the models of the other folds.
    """
    fold = F.floor(hash_unit(F.col(group), salt) * folds).cast("int")
    data = rows.withColumns({"fold": fold, "__x": array_to_vector(F.col(features).cast("array<double>")), "__y": F.col(y).cast("double")})
    steps = [
        StandardScaler(inputCol="__x", outputCol="__z", withMean=True),
        PCA(k=components, inputCol="__z", outputCol="__p"),
        LogisticRegression(featuresCol="__p", labelCol="__y", probabilityCol="__q", rawPredictionCol="__w", predictionCol="__c", regParam=0.01),
    ]
    out = None
    for k in range(folds):
        model = Pipeline(stages=steps).fit(data.where(F.col("fold") != k))
        told = model.transform(data.where(F.col("fold") == k)).select(*rows.columns, "fold", vector_to_array("__q")[1].alias("score"))
        out = told if out is None else out.unionByName(told)
    return out


def probe_report(scored: DataFrame, y: str, score: str, slices: dict[str, Column]) -> DataFrame:
    """(slice, value, auc, n, positives) of out-of-fold scores: over all rows (slice `all`), and for each value of each slice."""
    out = scoring.auc(scored.withColumns({"slice": F.lit("all"), "value": F.lit("")}), y, score, ("slice", "value"))
    for name, column in slices.items():
        out = out.unionByName(scoring.auc(scored.withColumns({"slice": F.lit(name), "value": column.cast("string")}), y, score, ("slice", "value")))
    return out
