"""Locating and masking against a plain-Python genome."""

import random

import pytest
from pyspark.sql import functions as F

from helixbag.operators import loci as L

CONTIGS = "genome long, contig_idx long, seqid string, seq string"
LOCI = "genome long, seqid string, start_pos long, end_pos long, locus_tag string"
PANEL = "locus_tag string, pos long"


def cut(seq, start, end, padding):
    start, end = max(start - padding // 2, 0), min(end + padding // 2, len(seq))
    return seq.replace(seq[start:end], "X" * (end - start)) if end > start else seq


def fold(seqs, loci, panel, padding):
    """Mask panel genes that occur once, in list order."""
    seqs, length = dict(seqs), 0
    for tag in panel:
        rows = [r for r in loci if r[3] == tag]
        if len(rows) == 1:
            seqid, start, end, _ = rows[0]
            seqs[seqid] = cut(seqs[seqid], start, end + 1, padding)
            length += end + 1 - start
    return seqs, length


@pytest.fixture(scope="module")
def study(spark):
    rng = random.Random(3)
    genomes, loci = {}, {}
    for g in range(1, 7):
        motif = "".join(rng.choices("ACGT", k=12))
        genomes[g] = {f"c{i}": motif.join("".join(rng.choices("ACGT", k=40)) for _ in range(3)) for i in range(4)}
        loci[g] = []
        for i in range(12):
            seqid = f"c{rng.randrange(4)}"
            start = rng.randint(1, 90)
            loci[g].append((seqid, start, start + rng.randint(3, 20), f"T{rng.randrange(9)}"))
    contigs = spark.createDataFrame([(g, i, c, s) for g, cs in genomes.items() for i, (c, s) in enumerate(cs.items())], CONTIGS)
    table = spark.createDataFrame([(g, *r) for g, rows in loci.items() for r in rows], LOCI)
    return genomes, loci, contigs, table


@pytest.mark.parametrize("padding", [0, 20])
def test_panel_is_folded_in_list_order(spark, study, padding):
    genomes, loci, contigs, table = study
    panel = ["T5", "T1", "T8", "T0", "T3", "missing"]
    listed = spark.createDataFrame([(t, i) for i, t in enumerate(panel)], PANEL)
    got = {(r["genome"], r["seqid"]): r["seq"] for r in L.mask_genes(contigs, table, listed, padding).collect()}
    lengths = {r["genome"]: r["length"] for r in L.removed_lengths(L.locate_genes(contigs, table, listed)).collect()}
    for g in genomes:
        want, length = fold(genomes[g], loci[g], panel, padding)
        assert {c: got[g, c] for c in want} == want
        assert lengths.get(g, 0) == length


def test_coordinates(spark):
    contigs = spark.createDataFrame([(1, 0, "c", "AACCGGTTAC")], CONTIGS)
    loci = spark.createDataFrame([(1, "c", 3, 4, "T")], LOCI)
    for coord, want in (("reference", "AACXXGTTAC"), ("exact", "AAXXGGTTAC")):
        panel = spark.createDataFrame([("T", 0)], PANEL)
        assert L.mask_genes(contigs, loci, panel, 0, coord).first()["seq"] == want
    with pytest.raises(ValueError):
        L.locate_gene(contigs, loci, "T", "other")


def test_ambiguous_names_and_duplicate_tags_are_not_located(spark):
    contigs = spark.createDataFrame([(1, 0, "c", "ACGT"), (1, 1, "c", "ACGT"), (2, 0, "c", "ACGT")], CONTIGS)
    loci = spark.createDataFrame([(1, "c", 1, 2, "T"), (2, "c", 1, 2, "T"), (2, "c", 1, 3, "D"), (2, "c", 1, 2, "D")], LOCI)
    assert [r["genome"] for r in L.locate_gene(contigs, loci, "T").collect()] == [2]
    assert L.locate_gene(contigs, loci, "D").count() == 0


def test_capsule_region(spark):
    seq = "ACGTACGTAAGGCCTT"
    contigs = spark.createDataFrame([(g, 0, "c", seq) for g in range(1, 5)] + [(3, 1, "d", seq)], CONTIGS)
    loci = spark.createDataFrame([
        (1, "c", 1, 4, "A"), (1, "c", 12, 16, "B"), (2, "c", 12, 16, "A"), (2, "c", 1, 4, "B"),
        (3, "c", 1, 4, "A"), (3, "d", 12, 16, "B"), (4, "c", 1, 12, "A"), (4, "c", 10, 16, "B"),
    ], LOCI)
    found = {r["genome"]: (r["start"], r["end"], r["length"]) for r in L.locate_capsule(contigs, loci, ("A", "B")).collect()}
    assert found == {1: (5, 12, 7), 2: (5, 12, 7), 4: (13, 10, -3)}
    masked = {(r["genome"], r["seqid"]): r["seq"] for r in L.mask_capsule(contigs, loci, ("A", "B")).collect()}
    assert masked[1, "c"] == cut(seq, 5, 12, 0) and masked[3, "c"] == seq and masked[4, "c"] == seq


def test_control_moves_cuts_to_contigs_of_the_same_genome(spark, study):
    genomes, _, contigs, table = study
    panel = spark.createDataFrame([(f"T{i}", i) for i in range(9)], PANEL)
    located = L.locate_genes(contigs, table, panel)
    moved = L.control_targets(contigs, located, seed=1)
    assert moved.count() == located.count()
    key = ["genome", "locus_tag"]
    both = moved.join(located.select(*key, F.col("start").alias("s"), F.col("end").alias("e")), key)
    assert both.where("start <> s or `end` <> e").count() == 0
    masked = L.mask_control(contigs, table, panel, seed=1)
    assert all(len(r["seq"]) == len(genomes[r["genome"]][r["seqid"]]) for r in masked.collect())
    assert L.genomes_differ(contigs, masked).where("differs = 1").count() > 0


def test_contig_order_with_gaps_and_blocks(spark):
    rows = [(g, i * 3 + g, f"c{i}", "A") for g in (1, 2) for i in range(50)]
    contigs = spark.createDataFrame(rows, CONTIGS)
    got = {(r["genome"], r["contig_idx"]): r["contig_ord"] for r in L.contig_order(contigs, block=7).collect()}
    assert got == {(g, i * 3 + g): i for g in (1, 2) for i in range(50)}
