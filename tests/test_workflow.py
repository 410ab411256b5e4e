"""The steps of a study end to end on a small made-up cohort."""

import random

import pytest

from helixbag.operators import cohort as C
from helixbag.operators.resync import subword_counter
from helixbag.plans import workflows as W
from helixbag.sources.files import load_model, save_model
from helixbag.operators import features as X


@pytest.fixture(scope="module")
def cohort(spark):
    rng = random.Random(0)
    genomes, contigs = [], []
    for i in range(120):
        invasive = i % 2
        genomes.append((i, f"iso{i}", C.SPECIES, 0, "meningitis" if invasive else "carrier", None, f"raw/{i}.fasta"))
        weights = (6, 4, 4, 6) if invasive else (4, 6, 6, 4)
        for c in range(rng.randint(2, 14)):
            contigs.append((i, c, f"c{c}", "".join(rng.choices("ACGT", weights, k=rng.randint(500, 700)))))
    g = spark.createDataFrame(genomes, "id long, isolate string, species string, complete int, disease string, capsule_group string, path string")
    return g, spark.createDataFrame(contigs, "genome long, contig_idx long, seqid string, seq string").cache()


@pytest.fixture(scope="module")
def dataset(cohort):
    return W.prepare_dataset(*cohort, "disease", num_val=10, num_test=14, n_clusters=4).cache()


def test_dataset(dataset):
    sizes = {(r["partition"], r["label"]): r["n"] for r in C.partition_stats(dataset).collect()}
    assert sizes["test", None] == 14 and sizes["validation", None] == 10
    assert sizes["training", 0] == sizes["training", 1]


def test_kmer_study(spark, cohort, dataset, tmp_path):
    model, tfidf = W.vectorize(cohort[1], dataset, W.kmer_counter(64))
    assert model.size == 64
    trials = X.draw_trials(2, space={"max_bin": (4, 32), "max_depth": (2, 4), "n_estimators": (2, 4), "num_leaves": (4, 16)})
    table, classifier, predictions, report = W.train(dataset, tfidf, model.size, trials)
    assert table.count() == 2 and predictions.count() == 14
    row = report.first()
    assert len(row) == 9 and row["test_roc_auc"] > 0.9 and row["val_accuracy"] > 0.7
    save_model(classifier, str(tmp_path / "m"))
    vectors = X.assemble_features(tfidf.where("partition = 'test'"), model.size)
    one = {r["genome"]: r["probability"] for r in X.predict_proba(classifier, vectors).collect()}
    two = {r["genome"]: r["probability"] for r in X.predict_proba(load_model(str(tmp_path / "m")), vectors).collect()}
    assert one == two


def test_knockout_studies_run_once_from_files(spark, cohort, dataset, tmp_path):
    from pyspark.sql import functions as F

    from helixbag.operators import knockout as K
    from helixbag.sources import files as S

    model, tfidf = W.vectorize(cohort[1], dataset, W.kmer_counter(64))
    members = dataset.select("genome", "label")
    data = X.with_empty_documents(X.assemble_features(tfidf, model.size), members, model.size).cache()
    classifier = X.train_classifier(data, max_bin=16, max_depth=2, n_estimators=2, num_leaves=4)
    S.write_predictions(X.predict_proba(classifier, data), str(tmp_path / "predictions"))
    S.write_fasta(cohort[1], str(tmp_path / "fasta"))
    rows = [(g, f"c{c}", 1 + 200 * j, 120 + 200 * j, f"N{j}") for g in range(120) for c, j in ((0, 0), (0, 1))]
    S.write_gff3(spark.createDataFrame(rows, "genome long, seqid string, start_pos long, end_pos long, locus_tag string"), str(tmp_path / "gff3"))
    contigs, loci = S.read_fasta(spark, str(tmp_path / "fasta")).cache(), S.read_gff3(spark, str(tmp_path / "gff3"))
    (tmp_path / "genes.txt").write_text("N0\nN1\n")
    genes = S.read_gene_list(spark, str(tmp_path / "genes.txt"))
    args = (str(tmp_path / "predictions"), str(tmp_path / "out"), contigs, loci)

    table = W.gene_study(*args, genes, model, classifier)
    direct = K.knockout_gene(S.read_predictions(spark, args[0]), contigs, loci, genes, model, classifier)
    assert sorted(map(tuple, table.select(direct.columns).collect())) == sorted(map(tuple, direct.collect()))
    assert table.count() == 2 * dataset.count() and table.where("length > 0").count() == table.count()
    again = W.gene_study(*args, genes.limit(0), model, classifier)
    assert again.count() == table.count()
    assert W.panel_study(*args, genes, model, classifier, control=True).where("gene = 'virulence-control'").count() == dataset.count()
    region = W.capsule_study(*args, model, classifier, threshold=0.5, boundary=("N0", "N1"))
    assert region.where(F.col("after").isNotNull()).count() == region.count() > 0
    wide = K.assemble_deltas_outer(table)
    assert wide.columns == ["genome", "N0", "N1"] and wide.count() == dataset.count()


def test_subword_study(spark, cohort, dataset):
    tokens = W.learn_tokenizer(cohort[1], dataset, 20, num_sentences=200)
    assert len(tokens.tokens) == 20
    counter = subword_counter(tokens, spark)
    model, tfidf = W.vectorize(cohort[1], dataset, counter)
    words = {r["term"] for r in model.vocab.collect()}
    assert words <= {t for t in tokens.tokens if len(t) > 2 and "X" not in t} and words
    assert {r["partition"] for r in tfidf.select("partition").distinct().collect()} == set(C.PARTITIONS)


def test_too_large_a_sample_fails(spark, cohort):
    from helixbag.operators.corpus import random_sample_k, sample_subsequence

    with pytest.raises(Exception, match="cannot sample"):
        random_sample_k(sample_subsequence(cohort[1]), 10 ** 6).collect()


def test_trial_draws_stay_in_range():
    draws = X.draw_trials()
    assert len(draws) == 50 and draws == X.draw_trials()
    for name, (low, high) in X.SEARCH_SPACE.items():
        assert all(low <= d[name] < high for d in draws)
