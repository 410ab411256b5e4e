"""Sequence functions against plain Python."""

import random
import re
import string

from pyspark.sql import functions as F

from helixbag.functions import sequence as Q


def column(spark, texts, make):
    rows = spark.createDataFrame([(i, s) for i, s in enumerate(texts)], "i int, s string")
    return [r[0] for r in rows.select(make(F.col("s")), "i").orderBy("i").collect()]


def test_clean_seq(spark):
    rng = random.Random(0)
    texts = ["", "ACGT", "ANNNT", "acgNt", "XXAXX", "NRYA-C"] + [
        "".join(rng.choices(string.ascii_uppercase + "acgt", k=50)) for _ in range(50)
    ]
    want = [re.sub("X+", "X", re.sub("[BD-FH-SU-Z]", "X", s)) for s in texts]
    assert column(spark, texts, Q.clean_seq) == want


def test_reverse_complement_twice_is_identity(spark):
    texts = ["ACGT", "AACCGN", "acgtRYKM", "X"]
    assert column(spark, texts, Q.reverse_complement)[:2] == ["ACGT", "NCGGTT"]
    assert column(spark, texts, lambda s: Q.reverse_complement(Q.reverse_complement(s))) == texts


def python_mask(seq, start, end, padding):
    start, end = max(start - padding // 2, 0), min(end + padding // 2, len(seq))
    return seq.replace(seq[start:end], "X" * (end - start)) if end > start else seq


def test_mask_interval_masks_every_copy_and_keeps_length(spark):
    rng = random.Random(1)
    cases = [("ACGACGTT", 0, 3, 0), ("AAAA", 1, 2, 0), ("ACGT", 3, 9, 2), ("ACGT", 9, 12, 2), ("ACGT", 2, 2, 0), ("", 0, 3, 4)]
    for _ in range(100):
        seq = "".join(rng.choices("ACG", k=rng.randint(0, 30)))
        start = rng.randint(0, 30)
        cases.append((seq, start, start + rng.randint(-2, 6), rng.randint(0, 6)))
    for padding in {c[3] for c in cases}:
        mine = [c for c in cases if c[3] == padding]
        rows = spark.createDataFrame([(i, *c[:3]) for i, c in enumerate(mine)], "i int, s string, a int, b int")
        out = rows.select("i", Q.mask_interval(F.col("s"), F.col("a"), F.col("b"), padding).alias("m")).orderBy("i").collect()
        for r, c in zip(out, mine):
            assert r["m"] == python_mask(*c), c
            assert len(r["m"]) == len(c[0])


def test_mask_one_copy(spark):
    rows = spark.createDataFrame([("ACGACG",)], "s string")
    assert rows.select(Q.mask_interval(F.col("s"), F.lit(0), F.lit(3), all_copies=False)).first()[0] == "XXXACG"


def test_chunks_and_token_filter(spark):
    rows = spark.createDataFrame([("ACGTACGXAA",)], "s string")
    got = rows.select(Q.fixed_chunks(F.col("s"), 4), Q.keep_tokens(Q.fixed_chunks(F.col("s"), 4))).first()
    assert got[0] == ["ACGT", "ACGX", "AA"]
    assert got[1] == ["ACGT"]


def test_file_stem(spark):
    assert column(spark, ["/a/b/12.fasta", "12.fasta", "a/b", "x.y.z"], Q.file_stem) == ["12", "12", "b", "x.y"]


def test_sql_functions_equal_the_column_functions(spark):
    from helixbag.functions import sequence as S
    from helixbag.functions.sql import register_functions
    from helixbag.operators.terms import kmer_extract

    assert register_functions(spark) == ["clean_seq", "reverse_complement", "mask_interval", "strands", "kmers"]
    texts = ["ACGTNNRYACGGTTACG", "", "acgtNX", "A" * 40, "ACG" * 30 + "N", None]
    frame = spark.createDataFrame([(1, i, t) for i, t in enumerate(texts)], "genome int, contig_idx int, seq string")
    frame.createOrReplaceTempView("sql_contigs")
    got = spark.sql("select contig_idx, clean_seq(seq) a, reverse_complement(seq) b, mask_interval(seq, 3, 6, 2) c, "
                    "mask_interval(seq, 30, 20, 0) d from sql_contigs").collect()
    want = frame.select("contig_idx", S.clean_seq(F.col("seq")), S.reverse_complement(F.col("seq")),
                        S.mask_interval(F.col("seq"), F.lit(3), F.lit(6), 2), F.col("seq")).collect()
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, want), key=str)
    both = spark.sql("select contig_idx, strand, text from sql_contigs, lateral strands(seq) where contig_idx = 0").collect()
    assert {(r["strand"], r["text"]) for r in both} == {("+", "ACGTXACGGTTACG"), ("-", "CGTAACCGTXACGT")}
    plan = spark.sql("select contig_idx, term from sql_contigs, lateral kmers(seq, 2, 4)")
    assert sorted(map(tuple, plan.collect())) == sorted(map(tuple, kmer_extract(frame, 2, 4).select("contig_idx", "term").collect()))
    assert "Python" not in plan._jdf.queryExecution().toString()
