"""k-mers, TF-IDF and vectorizers by hand and by brute force."""

import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from helixbag.functions.sequence import fixed_chunks
from helixbag.operators import features as X
from helixbag.operators import terms as T

SCHEMA = "genome long, contig_idx long, seqid string, seq string"


def frame(spark, genomes):
    rows = [(g, i, f"c{i}", s) for g, seqs in genomes.items() for i, s in enumerate(seqs)]
    return spark.createDataFrame(rows, SCHEMA)


def brute_counts(seqs, low, high):
    found = Counter()
    for s in seqs:
        s = re.sub("[BD-FH-SU-Z]+", "X", s)
        for k in range(low, high + 1):
            found.update(w for i in range(len(s) - k + 1) if re.fullmatch("[ACGT]+", w := s[i:i + k]))
    return found


@pytest.fixture(scope="module")
def genomes():
    rng = random.Random(5)
    long = "".join(rng.choices("ACGTN", (5, 5, 5, 5, 1), k=70_000))  # longer than the outermost piece
    return {
        1: ["ACGTNNACG", "", "AC", "acgTACGT"],
        2: [long, "".join(rng.choices("ACGT", k=1_030))],
        3: ["".join(rng.choices("ACGT", k=rng.randint(1, 100))) for _ in range(12)],
        4: ["NNNN"],
    }


@pytest.mark.parametrize("low,high", [(3, 3), (3, 5), (2, 8)])
def test_kmer_counts_equal_brute_force(spark, genomes, low, high):
    df = frame(spark, genomes)
    fast = {(r["genome"], r["term"]): r["tf"] for r in T.kmer_counts(df, low, high).collect()}
    plain = {(r["genome"], r["term"]): r["tf"] for r in T.term_counts(T.kmer_extract(df, low, high)).collect()}
    want = {(g, w): n for g, seqs in genomes.items() for w, n in brute_counts(seqs, low, high).items()}
    assert fast == want and plain == want


def test_vocabulary_sizes(spark):
    for size, (low, high) in T.KMER_VOCABULARIES.items():
        assert T.kmer_bound(low, high) == size
    assert T.kmer_universe(spark, 3, 4).distinct().count() == 320


def test_tfidf_by_hand(spark):
    df = frame(spark, {1: ["AAAC"], 2: ["AAAA"], 3: ["CC"]})
    tf = T.kmer_counts(df, 3, 3)
    docs = df.select("genome").distinct()
    vocab = {r["term"]: r for r in T.idf_fit(tf, docs, bound=64).collect()}
    assert vocab["AAA"]["df"] == 2 and vocab["AAC"]["idx"] == 1
    assert vocab["AAA"]["idf"] == pytest.approx(math.log(4 / 3) + 1)
    weights = {(r["genome"], r["term"]): r["tfidf"] for r in T.tfidf_transform(tf, T.idf_fit(tf, docs), 64).collect()}
    a, b = math.log(4 / 3) + 1, math.log(4 / 2) + 1
    assert weights[1, "AAA"] == pytest.approx(a / math.hypot(a, b))
    assert weights[2, "AAA"] == pytest.approx(1.0)
    assert set(weights) == {(1, "AAA"), (1, "AAC"), (2, "AAA")}


def test_unit_length_and_unseen_terms(spark, genomes):
    df = frame(spark, genomes)
    model = X.TfidfVectorizer(X.KmerCounter(3, 4)).fit(df.where("genome = 3"))
    norms = model.transform(df).groupBy("genome").agg(F.sum(F.col("tfidf") ** 2).alias("n")).collect()
    assert all(r["n"] == pytest.approx(1.0) for r in norms)
    known = {r["term"] for r in model.vocab.collect()}
    assert {r["term"] for r in model.transform(df).select("term").distinct().collect()} <= known


def test_document_frequency_limits(spark):
    df = spark.createDataFrame([("A", 1), ("B", 2), ("C", 4)], "term string, df long")
    n = F.lit(4)
    assert {r["term"] for r in T.min_max_df_filter(df, n, 2, 1.0).collect()} == {"B", "C"}
    assert {r["term"] for r in T.min_max_df_filter(df, n, 1, 0.5).collect()} == {"A", "B"}


def test_tokens_of_both_strands(spark):
    df = frame(spark, {1: ["AACCGGNT"]})
    got = sorted(r["term"] for r in T.token_rows(df, lambda s: fixed_chunks(s, 3)).collect())
    # forward AACCGGXT -> AAC CGG (XT dropped); reverse AXCCGGTT -> (AXC dropped) CGG (TT short)
    assert got == ["AAC", "CGG", "CGG"]


def test_sparse_vectors_and_empty_documents(spark):
    tfidf = spark.createDataFrame([(1, 2, 0.5), (1, 0, 0.25)], "genome long, idx long, tfidf double")
    dataset = spark.createDataFrame([(1, 1), (2, 0)], "genome long, label int")
    rows = X.with_empty_documents(X.assemble_features(tfidf, 4), dataset, 4).orderBy("genome").collect()
    assert rows[0]["features"].toArray().tolist() == [0.25, 0, 0.5, 0]
    assert rows[1]["features"].size == 4 and rows[1]["features"].numNonzeros() == 0


def test_constant_features_have_no_variance(spark):
    rows = [(g, 0, 0.1) for g in range(7)] + [(g, 1, 0.1) for g in range(6)] + [(g, 2, 0.0) for g in range(3)]
    table = spark.createDataFrame(rows, "genome long, idx long, tfidf double")
    assert [r["idx"] for r in T.variance_threshold(table, F.lit(7)).collect()] == [1]


def test_counts_of_one_size_are_shuffled_once(spark):
    frame = spark.createDataFrame([(1, 0, "ACGTACGT")], "genome long, contig_idx long, seq string")
    plan = T.kmer_counts(frame, 3, 3)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") - plan.count("RoundRobin") == 1


def test_long_kmers_deal_out_contigs_once(spark):
    rows = spark.createDataFrame([(g, i, "ACGTTGCA" * (g + i) + "NAC") for g in range(5) for i in range(4)],
                                 "genome long, contig_idx long, seq string")
    counted = T.kmer_counts(rows, 3, 8)
    extracted = T.kmer_extract(T.deal_out(rows), 3, 4).groupBy("genome", "contig_idx", "term").count()
    for df in (counted, extracted):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 1
    plain = {}
    for genome, _, seq in rows.collect():
        for k in range(3, 9):
            for i in range(len(seq) - k + 1):
                if "N" not in seq[i : i + k]:
                    plain[genome, seq[i : i + k]] = plain.get((genome, seq[i : i + k]), 0) + 1
    assert {(r["genome"], r["term"]): r["tf"] for r in counted.collect()} == plain
    assert T.kmer_counts(rows.limit(0), 3, 8).count() == 0
