"""Classification metrics over prediction tables (target, probability)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from helixbag.functions.ranks import running_sums

# Partitions of a report with their column prefix, and its metrics in order.
STAGES = (("training", "train"), ("validation", "val"), ("test", "test"))
METRICS = ("accuracy", "matthews_corrcoef", "roc_auc")


def hard_label(probability: Column) -> Column:
    """Rounded half to even: exactly 0.5 is class 0."""
    return F.bround(probability, 0).cast("int")


def confusion_counts(predictions: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """tp, fp, tn, fn per group."""
    hit, truth = hard_label(F.col("probability")) == 1, F.col("target") == 1
    return predictions.groupBy(*by).agg(
        F.count_if(hit & truth).alias("tp"), F.count_if(hit & ~truth).alias("fp"),
        F.count_if(~hit & ~truth).alias("tn"), F.count_if(~hit & truth).alias("fn"),
    )


def _d(name: str) -> Column:
    return F.col(name).cast("double")


def accuracy_of() -> Column:
    return (_d("tp") + _d("tn")) / (_d("tp") + _d("fp") + _d("tn") + _d("fn"))


def mcc_of() -> Column:
    product = (_d("tp") + _d("fp")) * (_d("tp") + _d("fn")) * (_d("tn") + _d("fp")) * (_d("tn") + _d("fn"))
    return F.when(product == 0, F.lit(0.0)).otherwise((_d("tp") * _d("tn") - _d("fp") * _d("fn")) / F.sqrt(product))


def f1_weighted_of() -> Column:
    def f1(hit: str) -> Column:
        base = 2 * _d(hit) + _d("fp") + _d("fn")
        return F.when(base == 0, F.lit(0.0)).otherwise(2 * _d(hit) / base)

    positives, negatives = _d("tp") + _d("fn"), _d("tn") + _d("fp")
    return (f1("tp") * positives + f1("tn") * negatives) / (positives + negatives)


def _metric(predictions: DataFrame, value: Column, name: str, by: Sequence[str]) -> DataFrame:
    return confusion_counts(predictions, by).select(*by, value.alias(name))


def accuracy(predictions: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return _metric(predictions, accuracy_of(), "accuracy", by)


def mcc(predictions: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return _metric(predictions, mcc_of(), "mcc", by)


def f1_weighted(predictions: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return _metric(predictions, f1_weighted_of(), "f1_weighted", by)


def roc_auc(predictions: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Area under the ROC curve, ties counted half; null where a group has one class only.

    Rows are counted per distinct score first. Each positive then scores the negatives below it plus half of
    those at its own score.
    """
    scores = predictions.groupBy(*by, "probability").agg(
        F.sum("target").cast("bigint").alias("pos"), F.count_if(F.col("target") == 0).alias("neg")
    )
    below = running_sums(scores, "probability", {"neg_below": "neg"}, groups=by)
    wins = F.sum(_d("pos") * (_d("neg_below") + _d("neg") / 2))
    pairs = F.sum(_d("pos")) * F.sum(_d("neg"))
    return below.groupBy(*by).agg(F.when(pairs > 0, wins / pairs).alias("roc_auc"))


def metrics_report(predictions: DataFrame, partition: str = "partition", digits: int = 3) -> DataFrame:
    """One row of accuracy, mcc and auc for training, validation and test, rounded half to even."""
    counted = confusion_counts(predictions, [partition]).select(
        partition, accuracy_of().alias("accuracy"), mcc_of().alias("matthews_corrcoef")
    )
    per_stage = counted.join(roc_auc(predictions, [partition]), partition)
    return per_stage.agg(*[
        F.bround(F.max(F.when(F.col(partition) == name, F.col(metric))), digits).alias(f"{stage}_{metric}")
        for metric in METRICS for name, stage in STAGES
    ])


def aggregate_predictions(predictions: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Mean target and score per genome, with the hard label of the older rule (score >= threshold)."""
    return predictions.groupBy("genome").agg(
        F.avg("target").alias("target"), F.avg("probability").alias("probability")
    ).withColumn("prediction", (F.col("probability") >= threshold).cast("int"))


def distinct_genomes(predictions: DataFrame) -> DataFrame:
    return predictions.select("genome").distinct()
