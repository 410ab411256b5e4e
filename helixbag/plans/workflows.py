"""The command-line steps of a study as functions: each reads tables, runs Spark jobs and writes a table once."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from helixbag.operators import cohort as C
from helixbag.operators import features as X
from helixbag.operators import knockout as K
from helixbag.operators import loci as L
from helixbag.operators import metrics as M
from helixbag.operators.bpe import BpeModel, bpe_train
from helixbag.operators.corpus import load_corpus
from helixbag.operators.terms import KMER_VOCABULARIES
from helixbag.operators.trials import METRIC_NAMES, refit_best, tidy_cv, union_trials
from helixbag.session import checked_broadcast, materialize
from helixbag.sources import files as S


def prepare_dataset(genomes: DataFrame, contigs: DataFrame, task: str, num_val: int = 500, num_test: int = 1000,
                    n_clusters: int = 512, num_contigs: int = 10, seed: int = 0) -> DataFrame:
    """Filter, label, measure quality, balance and split: (path, genome, label, partition)."""
    labelled = C.filter_cohort(genomes, task=C.TASKS[task])
    labelled = labelled.withColumn("genome", C.genome_id_from_path(F.col("path")).cast("bigint"))
    quality = C.fraction_covered(contigs, num_contigs)
    measured = materialize(labelled.join(quality, "genome"), "quality")
    balanced = C.balance_quality(C.cluster_quality(measured, n_clusters), seed=seed)
    # k-means draws its start points from the data order, so its outcome is fixed before it is used twice.
    balanced = materialize(balanced.select("path", "genome", "label"), "balanced")
    return C.stratified_split(balanced, num_val, num_test, seed=seed)


def learn_tokenizer(contigs: DataFrame, dataset: DataFrame, vocab_size: int, num_sentences: int | None = 1000,
                    seed: int = 0) -> BpeModel:
    """Learn a subword vocabulary from sampled passages of the training genomes."""
    training = checked_broadcast(C.select_partition(dataset, "training").select("genome"))
    return bpe_train(load_corpus(contigs.join(training, "genome", "left_semi"), num_sentences, seed), vocab_size)


def kmer_counter(vocab_size: int) -> X.KmerCounter:
    return X.KmerCounter(*KMER_VOCABULARIES[vocab_size])


def vectorize(contigs: DataFrame, dataset: DataFrame, counter) -> tuple[X.TfidfModel, DataFrame]:
    """Fit the vocabulary on training genomes, then weigh all partitions at once.

    Counts are written once and read for document frequencies and for weights.
    """
    members = dataset.select("genome", "partition")
    chosen = checked_broadcast(members.select("genome"))
    tf = materialize(counter.counts(contigs.join(chosen, "genome", "left_semi")), "tf")
    training = C.select_partition(members, "training").select("genome")
    model = X.TfidfVectorizer(counter).fit_counts(tf.join(training, "genome", "left_semi"), training)
    return model, model.transform_counts(tf).join(members, "genome")


def train(dataset: DataFrame, tfidf: DataFrame, size: int, trials: list[dict] | None = None, parallelism: int = 2,
          seed: int = 0):
    """Random search on the fixed fold, refit, and report: (trials, model, predictions, metrics)."""
    vectors = X.with_empty_documents(
        X.assemble_features(tfidf, size), dataset.select("genome", "label", "partition"), size
    )
    data = materialize(vectors, "vectors")
    table, model = X.random_search(data, trials or X.draw_trials(seed=seed), parallelism, seed)
    table = materialize(table, "trials")
    predictions = materialize(X.predict_proba(model, data.where(F.col("partition") == "test")), "predictions")
    best = table.join(refit_best(table, "rank_test_accuracy"), "trial")
    chosen = tidy_cv(best, rename=True).select(*METRIC_NAMES.values())
    test = predictions.withColumn("partition", F.lit("test"))
    scores = M.metrics_report(test).select(*[f"test_{m}" for m in M.METRICS])
    report = union_trials(chosen, scores).select(*[f"{s}_{m}" for m in M.METRICS for _, s in M.STAGES])
    return table, model, predictions, report


def gene_study(predictions_path: str, out: str, contigs: DataFrame, loci: DataFrame, genes: DataFrame,
               vectorizer: X.TfidfModel, classifier, control: bool = False, seed: int = 0) -> DataFrame:
    """Single-gene knockouts of the invasive genomes of a prediction file, written once under ``out``.

    One job covers all genes of the list (locus_tag, pos); the table has a row per genome and gene.
    """
    spark = contigs.sparkSession
    columns = ["genome", "gene", "original", "removed", "delta", "length"]
    return S.run_once(spark, f"{out}/genes{'-control' if control else ''}", lambda: K.knockout_gene(
        S.read_predictions(spark, predictions_path), contigs, loci, genes, vectorizer, classifier, "invasive",
        control=control, seed=seed).select(*columns)).select(*columns)


def panel_study(predictions_path: str, out: str, contigs: DataFrame, loci: DataFrame, panel: DataFrame,
                vectorizer: X.TfidfModel, classifier, control: bool = False, seed: int = 0,
                name: str = "virulence") -> DataFrame:
    """All genes of a panel masked together in the invasive genomes of a prediction file, written once under ``out``."""
    spark = contigs.sparkSession
    columns = ["genome", "gene", "original", "removed", "delta", "length"]
    return S.run_once(spark, f"{out}/{name}{'-control' if control else ''}", lambda: K.knockout_panel(
        S.read_predictions(spark, predictions_path), contigs, loci, panel, vectorizer, classifier, "invasive",
        control=control, seed=seed, name=name).select(*columns)).select(*columns)


def capsule_study(predictions_path: str, out: str, contigs: DataFrame, loci: DataFrame, vectorizer: X.TfidfModel,
                  classifier, threshold: float = 0.99, control: bool = False, seed: int = 0,
                  boundary: tuple[str, str] = L.CAPSULE_BOUNDARY) -> DataFrame:
    """Region knockouts of the confident capsule genomes of a prediction file, written once under ``out``."""
    spark = contigs.sparkSession
    columns = ["genome", "grp", "before", "after", "length"]
    return S.run_once(spark, f"{out}/capsule{'-control' if control else ''}", lambda: K.knockout_capsule(
        S.read_predictions(spark, predictions_path), contigs, loci, vectorizer, classifier, threshold, control, seed,
        boundary).select(*columns)).select(*columns)
