"""Knockout scores: counting only what changed must equal counting everything again."""

import random

import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from helixbag.functions.sequence import fixed_chunks
from helixbag.operators import features as X
from helixbag.operators import knockout as K
from helixbag.operators import loci as L

CONTIGS = "genome long, contig_idx long, seqid string, seq string"
LOCI = "genome long, seqid string, start_pos long, end_pos long, locus_tag string"


@pytest.fixture(scope="module")
def study(spark):
    rng = random.Random(11)
    contigs, loci = [], []
    for g in range(1, 25):
        letters, weights = "ACGTN", (8, 4, 4, 8, 1) if g % 2 else (4, 8, 8, 4, 1)
        for c in range(3):
            contigs.append((g, c, f"c{c}", "".join(rng.choices(letters, weights, k=150))))
            loci += [(g, f"c{c}", s, s + 35, f"T{c * 2 + j}") for j, s in enumerate((10, 90)) if rng.random() < 0.8]
    frame, table = spark.createDataFrame(contigs, CONTIGS), spark.createDataFrame(loci, LOCI)
    frame.cache()
    labels = frame.select("genome").distinct().withColumn("label", (F.col("genome") % 2).cast("int"))
    panel = spark.createDataFrame([(f"T{i}", i) for i in range(6)], "locus_tag string, pos long")
    return frame, table, labels, panel


@pytest.fixture(scope="module", params=["kmer", "tokens"])
def fitted(request, study):
    frame, _, labels, _ = study
    counter = X.KmerCounter(3, 4) if request.param == "kmer" else X.TokenCounter(lambda s: fixed_chunks(s, 3), 100_000)
    model = X.TfidfVectorizer(counter).fit(frame)
    data = labels.join(X.assemble_features(model.transform(frame), model.size), "genome").cache()
    classifier = X.train_classifier(data, max_bin=16, max_depth=3, n_estimators=3, num_leaves=8)
    return model, classifier, X.predict_proba(classifier, data).cache()


def rescored(frame, masked, fitted):
    model, classifier, _ = fitted
    vectors = X.assemble_features(model.transform(masked), model.size)
    return {r["genome"]: r["probability"] for r in X.predict_proba(classifier, vectors).collect()}


def test_feature_vectors_equal_full_counting(spark, study, fitted):
    frame, table, _, panel = study
    model, _, predictions = fitted
    located = L.locate_genes(frame, table, panel).withColumn("target", F.lit("all"))
    jobs = predictions.select("genome", F.lit("all").alias("target"))
    changes = K.count_changes(K.changed_contigs(frame, located, 20, margin=model.counter.margin), model.counter)
    fast = K.knockout_features(model.counter.counts(frame), changes, jobs, model)
    fast = {r["genome"]: r["v"] for r in fast.select("genome", vector_to_array("features").alias("v")).collect()}
    slow = X.assemble_features(model.transform(L.mask_genes(frame, table, panel)), model.size)
    slow = {r["genome"]: r["v"] for r in slow.select("genome", vector_to_array("features").alias("v")).collect()}
    assert set(fast) == set(slow)
    for g in slow:
        assert fast[g] == pytest.approx(slow[g], abs=1e-9)


def test_single_gene_scores_equal_full_rescoring(spark, study, fitted):
    frame, table, _, panel = study
    model, classifier, predictions = fitted
    genes = panel.where("pos in (1, 4)")
    got = K.knockout_gene(predictions, frame, table, genes, model, classifier).collect()
    assert len(got) == 48
    for tag in ("T1", "T4"):
        one = panel.where(F.col("locus_tag") == tag)
        want = rescored(frame, L.mask_genes(frame, table, one), fitted)
        lengths = {r["genome"]: r["length"] for r in L.locate_gene(frame, table, tag).collect()}
        for r in got:
            if r["gene"] == tag:
                assert r["length"] == lengths.get(r["genome"], 0)
                expected = want[r["genome"]] if r["length"] else r["original"]
                assert r["removed"] == pytest.approx(expected, abs=1e-9)
                assert r["delta"] == pytest.approx(r["original"] - r["removed"])


def test_panel_and_control(spark, study, fitted):
    frame, table, _, panel = study
    model, classifier, predictions = fitted
    got = {r["genome"]: r for r in K.knockout_panel(predictions, frame, table, panel, model, classifier).collect()}
    want = rescored(frame, L.mask_genes(frame, table, panel), fitted)
    for g, r in got.items():
        assert r["removed"] == pytest.approx(want[g] if r["length"] else r["original"], abs=1e-9)
    control = K.knockout_panel(predictions, frame, table, panel, model, classifier, control=True, seed=2).collect()
    want = rescored(frame, L.mask_control(frame, table, panel, seed=2), fitted)
    for r in control:
        assert r["gene"] == "virulence-control" and r["length"] == got[r["genome"]]["length"]
        assert r["removed"] == pytest.approx(want[r["genome"]] if r["length"] else r["original"], abs=1e-9)


def test_capsule_drops_genomes_without_region(spark, study, fitted):
    frame, table, _, _ = study
    model, classifier, predictions = fitted
    got = K.knockout_capsule(predictions, frame, table, model, classifier, boundary=("T0", "T1")).collect()
    regions = {r["genome"]: r["length"] for r in L.locate_capsule(frame, table, ("T0", "T1")).where("length > 0").collect()}
    assert {r["genome"]: r["length"] for r in got} == regions and 0 < len(got) < 24
    want = rescored(frame, L.mask_capsule(frame, table, ("T0", "T1")), fitted)
    for r in got:
        assert r["grp"] == "capsule" and r["after"] == pytest.approx(want[r["genome"]], abs=1e-9)


def test_thresholds(spark):
    rows = spark.createDataFrame([(1, 0.95), (2, 0.05), (3, 0.5)], "genome long, probability double")
    assert {r["genome"] for r in K.filter_predictions(rows, "invasive", 0.9).collect()} == {1}
    assert {r["genome"] for r in K.filter_predictions(rows, "carriage", 0.9).collect()} == {2}
    assert K.filter_predictions(rows, "capsule").count() == 3
    assert K.filter_predictions(rows, "capsule").first()["fasta"] == "data/raw/fasta/1.fasta"


def test_clip_treats_nan_as_missing(spark):
    rows = spark.createDataFrame([(1, -0.5), (2, float("nan")), (3, None), (4, 0.25)], "i int, delta double")
    fill = [r["delta"] for r in K.clip_negative(rows, "delta").orderBy("i").collect()]
    keep = [r["delta"] for r in K.clip_negative(rows, "delta", keep_missing=True).orderBy("i").collect()]
    assert fill == [0.0, 0.0, 0.0, 0.25] and keep == [0.0, None, None, 0.25]


def test_summary_and_relevance_by_hand(spark):
    ko = spark.createDataFrame([("k", 0.9, 0.2, 10), ("k", 0.8, 0.6, 20), ("c", 0.9, 0.9, 10)],
                               "grp string, before double, after double, length long")
    row = {r["grp"]: r for r in K.knockout_summary(ko).collect()}["k"]
    assert (row["n"], row["n_before"], row["n_after"], row["switches"]) == (2, 2, 1, 1)
    assert row["mean_length"] == 15 and row["std_length"] == pytest.approx(7.0710678)
    deltas = [(g, f"N{i}", 1.0 if i == 0 else i / 1000) for g in range(3) for i in range(40)]
    table = spark.createDataFrame(deltas, "genome long, gene string, delta double")
    # The 95th percentile of 40 values leaves the two greatest above it.
    assert [tuple(r) for r in K.relevant_loci(table, min_genomes=3).collect()] == [("N0", 3), ("N39", 3)]


def test_wide_export(spark):
    ko = spark.createDataFrame([(1, "A", 0.5, 0.1234, 0.4), (2, "B", 0.5, 0.25, 0.2)],
                               "genome long, gene string, original double, removed double, delta double")
    wide = {r["genome"]: (r["A"], r["B"]) for r in K.assemble_deltas_outer(ko, ["A", "B"]).collect()}
    assert wide == {1: (0.4, None), 2: (None, 0.2)}
    left = K.assemble_deltas_left(ko).collect()
    assert [(r["gene"], r["genome"], round(r["delta"], 6)) for r in left] == [("A", 1, 0.377)]


def test_absent_loci_count_as_zeros(spark):
    # One genome has 4 of 100 loci: over the filled grid the 95th percentile is 0, and all four exceed it.
    rows = [(0, f"N{i}", 0.0) for i in range(100)] + [(1, f"N{i}", 0.5 + i / 10) for i in range(4)]
    got = K.relevant_loci(spark.createDataFrame(rows, "genome long, gene string, delta double"), min_genomes=1).collect()
    assert {r["locus"] for r in got} == {"N0", "N1", "N2", "N3"}


def test_only_the_parts_around_masks_are_counted_again(spark):
    rng = random.Random(3)
    text = "".join(rng.choices("ACGT", k=20000))
    frame = spark.createDataFrame([(1, 0, "c0", text)], CONTIGS)
    cuts = [(1, f"T{i}", 0, i, 40 * i, 40 * i + 35) for i in range(300)]
    located = spark.createDataFrame(cuts, "genome long, target string, contig_idx long, pos long, start long, end long")
    parts = K.changed_contigs(frame, located, 20, margin=7).collect()
    assert len(parts) == 300 and max(len(r["seq"]) for r in parts) <= 35 + 20 + 14
    assert all(len(r["seq"]) == len(r["masked"]) for r in parts)


def test_snippets_merge_where_margins_meet(spark):
    from helixbag.functions.sequence import masked_snippets

    rows = [("ACGTACGTACGTACGT", "ACXTACGXACGTACGX"), ("AAAA", "XXXX"), ("AC", "AC")]
    got = spark.createDataFrame(rows, "seq string, masked string").select(masked_snippets(F.col("seq"), F.col("masked"), 2).alias("s")).collect()
    # The first two runs are 4 letters apart: their margins meet but share nothing.
    assert [[tuple(p) for p in r["s"]] for r in got] == [
        [("ACGTA", "ACXTA"), ("CGTAC", "CGXAC"), ("CGT", "CGX")], [("AAAA", "XXXX")], []]


@pytest.mark.parametrize("k", [(3, 3), (2, 4)])
def test_changed_kmers_never_become_rows(spark, k):
    """Changes listed per target and contig equal those counted as rows, with repeated contigs and targets on several contigs."""
    from helixbag.operators.genome_jobs import genome_rows
    from tests.test_letters import plan

    rng = random.Random(5)
    rows = [(g, c, f"c{c}", "".join(rng.choices("ACGTN", k=rng.choice([0, 5, 90])))) for g in (1, 2, 3) for c in range(4)]
    frame = spark.createDataFrame([*rows, rows[1], rows[1], (4, 0, "c0", None)], CONTIGS)
    cuts = [(g, t, c, p, s, s + rng.choice([0, 4, 30])) for g in (1, 2, 3, 4) for c in range(4)
            for p, (t, s) in enumerate([("a", 3), ("a", 40), ("b", 60), (None, 10)])]
    located = spark.createDataFrame(cuts, "genome long, target string, contig_idx long, pos long, start long, end long")
    jobs = spark.createDataFrame([(g, t) for g in (1, 2, 3, 4) for t in ("a", "b", "d")], "genome long, target string")
    counter = X.KmerCounter(*k)
    fitted = X.TfidfVectorizer(counter, min_df=2).fit(frame)
    tf = counter.counts(frame)

    def vectors(changes):
        got = K.knockout_features(tf, changes, jobs, fitted).select("genome", "target", vector_to_array("features").alias("v"))
        return {(r.genome, r.target): r.v for r in got.collect()}

    counted = K.count_changes(K.changed_contigs(frame, located, 6, margin=counter.margin), counter)
    listed = K.term_changes(frame, located, 6, counter, vocab=fitted.vocab)
    want, got = vectors(counted), vectors(listed)
    assert len(want) == 12 and want[1, "a"] != want[1, "d"] and set(got) == set(want)
    assert all(got[key] == pytest.approx(want[key], abs=1e-12) for key in want)
    assert "term" not in listed.columns and plan(listed).count("MapInArrow") == 1
    moved = genome_rows(tf, listed, jobs, fitted)
    assert moved.count() == 4


def test_windows_and_their_prefixes_are_numbered_alike():
    import numpy as np
    import pyarrow as pa
    from helixbag.operators import terms

    words = terms.kmer_words(2, 4)
    batch = pa.RecordBatch.from_arrays([pa.array(["ACGTA", "GG", "NAC", None, "A"])], names=["seq"])
    groups, windows, counts = terms.tally_windows(batch, np.array([0, 0, 1, 1, 1]), 2, 2, 4)
    assert sorted(zip(groups.tolist(), [words[w] for w in windows], counts.tolist())) == [
        (0, "ACGT", 1), (0, "CGTA", 1), (0, "GG", 1), (0, "GTA", 1), (0, "TA", 1), (1, "AC", 1)]
    at, found = terms.window_prefixes(windows, 2, 4)
    assert sorted((words[windows[i]], words[w]) for i, w in zip(at, found)) == sorted(
        (words[w], words[w][:n]) for w in windows for n in range(2, len(words[w]) + 1))
