"""Labels, quality, balance and splits."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from helixbag.operators import cohort as C

GENOMES = "id long, isolate string, species string, complete int, disease string, capsule_group string, path string"


def test_labels_and_null_groups(spark):
    rows = [
        (1, "a", C.SPECIES, 0, "carrier", "B", "p/1.fasta"), (2, "b", C.SPECIES, 0, "meningitis", None, "p/2.fasta"),
        (3, "c", C.SPECIES, 0, "other", "discrepancy", "p/3.fasta"), (4, "d", C.SPECIES, 1, "carrier", "B", "p/4.fasta"),
        (5, "e", "other", 0, "carrier", "B", "p/5.fasta"), (6, "f", C.SPECIES, 0, None, "C", "p/6.fasta"),
    ]
    g = spark.createDataFrame(rows, GENOMES)
    pairs = lambda df: {(r["path"][2], r["label"]) for r in df.collect()}
    assert pairs(C.filter_cohort(g, task=C.label_disease)) == {("1", 0), ("2", 1)}
    assert pairs(C.filter_cohort(g, task=C.label_capsule)) == {("1", 1), ("2", 0), ("6", 0)}
    drop = C.filter_cohort(g, task=lambda d: C.label_capsule(d, drop_null_group=True))
    assert pairs(drop) == {("1", 1), ("6", 0)}


def test_fraction_covered(spark):
    rng = random.Random(0)
    lengths = {1: [rng.randint(0, 9) for _ in range(500)], 2: [4, 4, 4], 3: [5] * 11 + [1], 4: [0, 0]}
    rows = [(g, i, "A" * n) for g, ns in lengths.items() for i, n in enumerate(ns)]
    df = spark.createDataFrame(rows, "genome long, contig_idx long, seq string")
    got = {r["genome"]: r["fraction_covered"] for r in C.fraction_covered(df).collect()}
    want = {g: sum(sorted(ns, reverse=True)[:10]) / sum(ns) for g, ns in lengths.items() if sum(ns)}
    assert got == pytest.approx(want)


def test_balance_makes_classes_equal_in_every_cluster(spark):
    rng = random.Random(1)
    rows = [(f"p{i}", int(rng.random() < 0.3), 0 if rng.random() < 0.7 else rng.randrange(1, 6)) for i in range(1500)]
    rows += [("only", 1, 99)]
    df = spark.createDataFrame(rows, "path string, label int, cluster int")
    kept = C.balance_quality(df).collect()
    sizes, before = Counter((r["cluster"], r["label"]) for r in kept), Counter((c, y) for _, y, c in rows)
    assert 99 not in {c for c, _ in sizes}
    for c in {c for _, _, c in rows} - {99}:
        assert sizes[c, 0] == sizes[c, 1] == min(before[c, 0], before[c, 1])
    assert len({r["path"] for r in kept}) == len(kept)


def test_split_sizes_are_exact_and_stratified(spark):
    rows = [(f"p{i}", int(i % 7 == 0)) for i in range(1003)]
    df = spark.createDataFrame(rows, "path string, label int")
    parts = C.stratified_split(df, 101, 203).collect()
    by = Counter((r["partition"], r["label"]) for r in parts)
    assert len({r["path"] for r in parts}) == 1003
    assert by["test", 0] + by["test", 1] == 203 and by["validation", 0] + by["validation", 1] == 101
    # Shares of label 1: 203 * 144 / 1003 = 29.14 -> 29; then 101 * 115 / 800 = 14.52 -> 15, the greater remainder.
    assert by["test", 1] == 29 and by["validation", 1] == 15
    again = {r["path"]: r["partition"] for r in C.stratified_split(df.repartition(5), 101, 203).collect()}
    assert again == {r["path"]: r["partition"] for r in parts}
    other = {r["path"]: r["partition"] for r in C.stratified_split(df, 101, 203, seed=9).collect()}
    assert other != again


def test_split_needs_more_rows_than_it_holds_out(spark):
    df = spark.createDataFrame([(f"p{i}", i % 2) for i in range(30)], "path string, label int")
    with pytest.raises(Exception, match="more than 30 rows"):
        C.stratified_split(df, 10, 20).collect()


def lloyd(values, k, rounds):
    """Clusters of whole numbers by moving centres, each value compared with every centre."""
    distinct = sorted(set(values))
    m = len(distinct)
    centres = [distinct[i] for i in sorted({i * (m - 1) // (k - 1) for i in range(k)})] if k < m else distinct

    def nearest(v):
        return next(i for i in range(len(centres)) if i + 1 == len(centres) or 2 * v <= 2 * ((centres[i] + centres[i + 1]) // 2))

    for _ in range(rounds):
        groups = {}
        for v in values:
            groups.setdefault(nearest(v), []).append(v)
        centres = [sum(groups[i]) // len(groups[i]) if i in groups else c for i, c in enumerate(centres)]
    return [nearest(v) for v in values]


@pytest.mark.parametrize("k,n", [(10, 300), (40, 60), (100, 30), (2, 7)])
def test_clusters_equal_moving_every_centre(spark, k, n):
    rng = random.Random(k)
    values = [round(rng.choice([rng.random(), rng.random() ** 4, 0.5]), 9) for _ in range(n)]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, fraction_covered double")
    got = {r["i"]: r["cluster"] for r in C.cluster_quality(df, k, 8).collect()}
    assert [got[i] for i in range(n)] == lloyd([round(v * 10**9) for v in values], k, 8)


def test_clusters_of_odd_tables(spark):
    schema = "i int, fraction_covered double"
    same = C.cluster_quality(spark.createDataFrame([(1, 0.5), (2, 0.5), (3, None)], schema), 5).orderBy("i").collect()
    assert [r["cluster"] for r in same] == [0, 0, None]
    assert C.cluster_quality(spark.createDataFrame([], schema)).collect() == []
    one = C.cluster_quality(spark.createDataFrame([(1, 0.1), (2, 0.9)], schema), 1).collect()
    assert [r["cluster"] for r in one] == [0, 0]


def test_lists_and_names(spark):
    df = spark.createDataFrame([("b", 1), ("a", 2), ("z", 3)], "locus_tag string, n int")
    listed = spark.createDataFrame([("a", 0), ("q", 1), ("b", 2)], "locus_tag string, pos long")
    assert [r["locus_tag"] for r in C.order_by_list(df, listed, "locus_tag").collect()] == ["a", "b"]
    named = C.label_names(spark.createDataFrame([(0,), (1,), (2,)], "label int"), {0: "Not B", 1: "B"})
    assert [r["label_name"] for r in named.orderBy("label").collect()] == ["Not B", "B", None]
