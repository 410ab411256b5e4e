"""The two vectorizers, sparse feature vectors and boosted-tree classifiers."""

from __future__ import annotations

import math
import random
import time
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from multiprocessing.pool import ThreadPool

import numpy as np
import pyarrow as pa
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VarianceThresholdSelector
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame, functions as F

from helixbag.operators import metrics as M
from helixbag.operators.terms import idf_fit, kmer_bound, kmer_counts, tfidf_transform, token_rows
from helixbag.session import materialize, scratch_path

# Half-open ranges of the random search, its number of trials, and the learning rate.
SEARCH_SPACE = {"max_bin": (4, 32), "max_depth": (4, 10), "n_estimators": (500, 2000), "num_leaves": (16, 256)}
N_TRIALS = 50
LEARNING_RATE = 0.9


@dataclass(frozen=True)
class KmerCounter:
    """Counts k-mers of k_min to k_max letters."""

    k_min: int = 3
    k_max: int = 8

    @property
    def bound(self) -> int | None:
        return kmer_bound(self.k_min, self.k_max)

    @property
    def margin(self) -> int:
        """Letters beside a changed stretch that a changed k-mer may reach."""
        return self.k_max - 1

    def counts(self, contigs: DataFrame, keys: Sequence[str] = ("genome",), sign: Column | None = None) -> DataFrame:
        return kmer_counts(contigs, self.k_min, self.k_max, keys, sign)


@dataclass(frozen=True)
class TokenCounter:
    """Counts tokens of both strands. ``tokenize`` maps a sequence column to an array of strings."""

    tokenize: Callable[[Column], Column]
    bound: int | None = None
    # Tokens of a text may depend on all of it, so changed texts are counted whole.
    margin: int | None = None

    def counts(self, contigs: DataFrame, keys: Sequence[str] = ("genome",), sign: Column | None = None) -> DataFrame:
        # Tokens of a learned model are counted batch by batch beforehand.
        counted = getattr(self.tokenize, "counts", None)
        if counted and sign is None:
            return counted(contigs, keys).groupBy(*keys, "term").agg(F.sum("n").alias("tf"))
        if counted:
            rows = counted(contigs.withColumn("_sign", sign), [*keys, "_sign"])
            return rows.groupBy(*keys, "term").agg(F.sum(F.col("n") * F.col("_sign")).alias("tf"))
        if sign is None:
            rows = token_rows(contigs, self.tokenize, keys)
            return rows.groupBy(*keys, "term").agg(F.count(F.lit(1)).alias("tf"))
        rows = token_rows(contigs.withColumn("_sign", sign), self.tokenize, [*keys, "_sign"])
        return rows.groupBy(*keys, "term").agg(F.sum("_sign").cast("bigint").alias("tf"))


class TfidfModel:
    """A counter with its fitted vocabulary."""

    def __init__(self, counter, vocab: DataFrame, size: int):
        self.counter, self.vocab, self.size = counter, vocab, size

    def transform(self, contigs: DataFrame, keys: Sequence[str] = ("genome",)) -> DataFrame:
        return self.transform_counts(self.counter.counts(contigs, keys), keys)

    def transform_counts(self, tf: DataFrame, keys: Sequence[str] = ("genome",)) -> DataFrame:
        return tfidf_transform(tf, self.vocab, self.size, keys)

    def save(self, path: str) -> None:
        self.vocab.write.mode("overwrite").parquet(path)

    @staticmethod
    def load(spark, path: str, counter) -> TfidfModel:
        vocab = spark.read.parquet(path)
        return TfidfModel(counter, vocab, vocab.count())


class TfidfVectorizer:
    """Learns a vocabulary with document frequencies from training genomes."""

    def __init__(self, counter, min_df: int | float = 1, max_df: int | float = 1.0):
        self.counter, self.min_df, self.max_df = counter, min_df, max_df

    def fit(self, contigs: DataFrame, documents: DataFrame | None = None) -> TfidfModel:
        return self.fit_counts(self.counter.counts(contigs), documents)

    def fit_counts(self, tf: DataFrame, documents: DataFrame | None = None) -> TfidfModel:
        """Fit on existing training counts; ``documents`` lists all training genomes in column ``genome``."""
        fitted = idf_fit(tf, documents, self.min_df, self.max_df, self.counter.bound)
        vocab = materialize(fitted, "vocab")
        return TfidfModel(self.counter, vocab, vocab.count())


@F.arrow_udf(VectorUDT())
def _sparse(size: pa.Array, indices: pa.Array, values: pa.Array) -> pa.Array:
    return pa.StructArray.from_arrays(
        [pa.array(np.zeros(len(size), dtype=np.int8)), size.cast(pa.int32()), indices.cast(pa.list_(pa.int32())),
         values.cast(pa.list_(pa.float64()))], names=["type", "size", "indices", "values"])


def sparse_vector(entries: Column, size: int) -> Column:
    """A sparse vector from an array of (idx, weight) structs sorted by idx."""
    return _sparse(
        F.lit(size), F.transform(entries, lambda e: e["idx"].cast("int")),
        F.transform(entries, lambda e: e["weight"].cast("double")),
    )


def assemble_features(tfidf: DataFrame, size: int, keys: Sequence[str] = ("genome",)) -> DataFrame:
    """One sparse vector per genome. A genome has one row per vocabulary term at most, which bounds the list."""
    entries = F.array_sort(F.collect_list(F.struct(F.col("idx"), F.col("tfidf").alias("weight"))))
    return tfidf.groupBy(*keys).agg(entries.alias("_e")).select(*keys, sparse_vector(F.col("_e"), size).alias("features"))


def with_empty_documents(features: DataFrame, dataset: DataFrame, size: int) -> DataFrame:
    """Dataset rows with their features; genomes without a known term get the zero vector."""
    empty = sparse_vector(F.expr("cast(array() as array<struct<idx:bigint,weight:double>>)"), size)
    return dataset.join(features, "genome", "left").withColumn("features", F.coalesce("features", empty))


def classifier_stages(spark, max_bin: int = 32, max_depth: int = 5, n_estimators: int = 20, num_leaves: int = 256,
                      learning_rate: float = LEARNING_RATE, seed: int = 0) -> list:
    """Pipeline stages over ``features`` and ``label``: constant features dropped, then boosted trees. Spark trees have no
    leaf count, so the number of leaves limits the depth."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(scratch_path(spark, "trees"))
    depth = min(max_depth, math.ceil(math.log2(num_leaves)))
    return [
        VarianceThresholdSelector(featuresCol="features", outputCol="kept", varianceThreshold=0.0),
        GBTClassifier(featuresCol="kept", labelCol="label", maxBins=max_bin, maxDepth=depth, maxIter=n_estimators,
                      stepSize=learning_rate, seed=seed, checkpointInterval=10),
    ]


def train_classifier(train: DataFrame, **params) -> PipelineModel:
    """The classifier stages fitted to a table of ``features`` and ``label``."""
    return Pipeline(stages=classifier_stages(train.sparkSession, **params)).fit(train)


def predict_proba(model: PipelineModel, df: DataFrame, keys: Sequence[str] = ("genome",)) -> DataFrame:
    """Id, target, hard label and probability of the positive class."""
    p = vector_to_array(F.col("probability"))[1]
    target = [F.col("label").alias("target")] if "label" in df.columns else []
    scored = model.transform(df).select(*keys, *target, p.alias("_p"))
    return scored.select(
        *keys, *[c for c in scored.columns if c == "target"], M.hard_label(F.col("_p")).alias("prediction"),
        F.col("_p").alias("probability"),
    )


def feature_importances(model: PipelineModel, spark) -> DataFrame:
    """Importance per feature index of the vocabulary; features the trees never use are absent."""
    selected = model.stages[0].selectedFeatures
    found = model.stages[1].featureImportances
    rows = [(int(selected[i]), float(v)) for i, v in zip(found.indices, found.values)]
    return spark.createDataFrame(rows, "idx long, importance double")


def draw_trials(n: int = N_TRIALS, seed: int = 0, space: dict[str, tuple[int, int]] = SEARCH_SPACE) -> list[dict]:
    rng = random.Random(seed)
    return [{name: rng.randrange(low, high) for name, (low, high) in space.items()} for _ in range(n)]


def _scores(predictions: DataFrame) -> dict[str, dict[str, float]]:
    """Metrics by partition, as at most three rows on the driver."""
    counted = M.confusion_counts(predictions, ["partition"]).select(
        "partition", M.accuracy_of().alias("accuracy"), M.mcc_of().alias("matthews_corrcoef")
    )
    rows = counted.join(M.roc_auc(predictions, ["partition"]), "partition").collect()
    return {r["partition"]: r.asDict() for r in rows}


def random_search(dataset: DataFrame, trials: Sequence[dict], parallelism: int = 2, seed: int = 0):
    """Fit every trial on training, score training and validation, refit the best on both.

    ``dataset`` has genome, features, label and partition. Returns the trial table and the refitted model. A few
    driver threads keep the cluster busy while each fit is distributed.
    """
    spark = dataset.sparkSession
    data = materialize(dataset.where(F.col("partition").isin("training", "validation")), "develop")
    train = data.where(F.col("partition") == "training")

    def run(item):
        index, params = item
        begin = time.time()
        model = train_classifier(train, **params, seed=seed)
        fitted = time.time()
        scored = materialize(predict_proba(model, data, ("genome", "partition")), "scores")
        by_part = _scores(scored)
        done = time.time()
        row = {"trial": index, "mean_fit_time": fitted - begin, "mean_score_time": done - fitted,
               **{f"param_classifier__{k}": v for k, v in params.items()}}
        for part, stage in (("training", "train"), ("validation", "test")):
            for metric in M.METRICS:
                value = by_part[part][metric]
                row[f"mean_{stage}_{metric}"] = None if value is None else float(value)
        return row

    with ThreadPool(parallelism) as pool:
        rows = pool.map(run, list(enumerate(trials)), chunksize=1)
    kinds = {"trial": "long", "mean_fit_time": "double", "mean_score_time": "double"}
    names = list(rows[0])
    schema = ", ".join(
        f"{n} {kinds.get(n, 'long' if n.startswith('param_') else 'double')}" for n in names
    )
    from helixbag.operators.trials import rank_trials

    table = rank_trials(spark.createDataFrame([tuple(r[n] for n in names) for r in rows], schema),
                        [f"mean_test_{m}" for m in M.METRICS])
    best = max(rows, key=lambda r: (r["mean_test_accuracy"], -r["trial"]))["trial"]
    return table, train_classifier(data, **trials[best], seed=seed)


