"""Hyperparameter trial tables and comparisons of runs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F, types as T

# The report columns of a trial table and their names.
METRIC_NAMES = {
    "mean_train_accuracy": "train_accuracy",
    "mean_test_accuracy": "val_accuracy",
    "mean_train_matthews_corrcoef": "train_matthews_corrcoef",
    "mean_test_matthews_corrcoef": "val_matthews_corrcoef",
    "mean_train_roc_auc": "train_roc_auc",
    "mean_test_roc_auc": "val_roc_auc",
}
DISPLAY_NAMES = {
    "accuracy": "Accuracy",
    "roc_auc": "AUROC",
    "f1_weighted": "Weighted F1",
    "matthews_corrcoef": "MCC",
}
STAGES = ("train", "val", "test")


def tidy_cv(cv: DataFrame, digits: int = 3, names: dict[str, str] = METRIC_NAMES, rename: bool = False) -> DataFrame:
    """Drop spread and per-split columns and the params column, round, and optionally rename."""
    kept = [f for f in cv.schema.fields if "std" not in f.name and "split" not in f.name and f.name != "params"]
    return cv.select(*[
        (F.bround(f.name, digits) if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else F.col(f.name))
        .alias(names.get(f.name, f.name) if rename else f.name)
        for f in kept
    ])


def hyperparameters(cv: DataFrame) -> DataFrame:
    return cv.select(*[c for c in cv.columns if "param_" in c])


def rank_trials(cv: DataFrame, metrics: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Rank of each trial per metric, greatest first, ties sharing the least rank.

    A search has tens to hundreds of trials, so a window per search holds a handful of rows.
    """
    out = cv
    for metric in metrics:
        rank = F.rank().over(Window.partitionBy(*by).orderBy(F.desc(metric)))
        out = out.withColumn(metric.replace("mean_", "rank_"), rank.cast("bigint"))
    return out


def refit_best(ranked: DataFrame, rank: str = "rank_test_accuracy", by: Sequence[str] = ()) -> DataFrame:
    """The first trial of accuracy rank 1."""
    return ranked.where(F.col(rank) == 1).groupBy(*by).agg(F.min("trial").alias("trial"))


def refit_rank_sum(ranked: DataFrame, ranks: Sequence[str], by: Sequence[str] = (),
                   train: str = "mean_train_accuracy") -> DataFrame:
    """Trial of the least rank sum among those above a training accuracy of 0.9, lowered by 0.1 until any is.

    The first trial wins ties.
    """
    levels, level = [], 0.9
    while level > -1.0:
        levels.append(level)
        level -= 0.1
    best = F.max(train).over(Window.partitionBy(*by))
    threshold = F.element_at(F.filter(F.array(*map(F.lit, levels)), lambda t: t < F.col("_best")), 1)
    total = sum((F.col(r) for r in ranks[1:]), F.col(ranks[0]))
    return (
        ranked.withColumn("_best", best).where(F.col(train) > threshold)
        .groupBy(*by).agg(F.min(F.struct(total.alias("rank_sum"), F.col("trial").alias("trial"))).alias("_m"))
        .select(*by, "_m.trial", F.col("_m.rank_sum").cast("bigint").alias("rank_sum"))
    )


def best_run(runs: DataFrame) -> DataFrame:
    """Per task the run of greatest validation accuracy; ties by vocabulary size, then method."""
    order = Window.partitionBy("task").orderBy(F.desc("val_accuracy"), "vocab_size", "method")
    return runs.withColumn("_rn", F.row_number().over(order)).where("_rn = 1").drop("_rn")


def union_trials(cv_metrics: DataFrame, test_metrics: DataFrame) -> DataFrame:
    """The columns of two one-row metric tables side by side; a second row in the right one is an error."""
    row = test_metrics.select(F.struct(*[F.col(c) for c in test_metrics.columns]).alias("_row"))
    # A scalar subquery holds one row by its nature, so nothing is paired.
    return cv_metrics.withColumn("_row", row.scalar()).select(*cv_metrics.columns, "_row.*")


def stage_rows(metrics: DataFrame, metric: str, keys: Sequence[str]) -> DataFrame:
    """Unpivot the train, val and test columns of one metric into rows with a capitalised stage."""
    long = metrics.unpivot(list(keys), [f"{s}_{metric}" for s in STAGES], "_column", DISPLAY_NAMES[metric])
    stage = F.initcap(F.substring_index("_column", "_", 1))
    return long.select(*keys, stage.alias("stage"), F.col(DISPLAY_NAMES[metric]))


# The subword vocabularies that a sensitivity table compares.
VOCABULARY_SIZES = (4000, 8000, 16000, 32000)


def collect_feature_scan(base: DataFrame, folds: DataFrame, counts: DataFrame, metric: str = "accuracy") -> DataFrame:
    """Metric per stage with all features and for each smaller feature count, sorted by feature count.

    Runs are named by the columns of ``counts`` beside ``num_features``, such as dataset, vocab_size and strategy. ``base``
    and ``folds`` have them too; ``folds`` has ``num_features``, ``counts`` gives the full number.
    """
    run = [c for c in counts.columns if c != "num_features"]
    cols = [*run, "num_features"]
    every = base.join(counts, run).select(*cols, *[f"{s}_{metric}" for s in STAGES])
    rows = every.unionByName(folds.select(*every.columns))
    return stage_rows(rows, metric, cols).orderBy("num_features", *run, "stage")


def vocab_sensitivity(metrics: DataFrame, counts: DataFrame, metric: str = "accuracy",
                      sizes: Sequence[int] | None = VOCABULARY_SIZES) -> DataFrame:
    """Metric per stage and vocabulary size with the number of features; sizes=None keeps every size.

    Runs are named by the columns of ``counts`` beside ``num_features``.
    """
    kept = metrics if sizes is None else metrics.where(F.col("vocab_size").isin(list(sizes)))
    run = [c for c in counts.columns if c != "num_features"]
    return stage_rows(kept.join(counts, run), metric, [*run, "num_features"])
