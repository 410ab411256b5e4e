"""Texts read, mapped and counted by whole batches, against plain Python."""

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from helixbag.functions import letters as L
from helixbag.functions.sequence import clean_seq, reverse_complement
from helixbag.operators import bpe as B
from helixbag.operators.features import TokenCounter
from helixbag.operators.merge_kernel import MergeKernel
from helixbag.plans.shapes import as_bases

TEXTS = [None, "", "A", "ACGTACGTXACGT", "XXACGBDNNGTACCAX", "acgtACGTuAC", "ACéGTACGTA", "\U0001f600ACGTAC", "AC GT|AC\nGTAC", "GTGTGTGTACACACAC"]
MERGES = (("A", "C"), ("G", "T"), ("AC", "GT"), ("C", "A"), ("T", "A"), ("AC", "A"), ("GT", "C"), ("ACGT", "CA"))


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_letters_become_bases_in_one_arrow_step(spark):
    texts = [None, "", "Eios, ünd\n12 hlmpq", "Z", "é", "aé\U0001f600b"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string").select("i", as_bases(F.col("text")).alias("seq"))
    table = str.maketrans("EIOUNRSHLDMP", "ACGTACGTACGT")
    want = [None if t is None else re.sub("[^A-Za-z]", "", t).upper().translate(table) for t in texts]
    assert [r.seq for r in df.orderBy("i").collect()] == want
    assert "ArrowEvalPython" in plan(df) and "regexp_replace" not in plan(df)


def test_tokens_of_both_strands_equal_the_fold(spark):
    rows = [(i % 4, i, t) for i, t in enumerate(TEXTS * 2)]
    df = spark.createDataFrame(rows, "genome long, contig_idx long, seq string")
    model = B.BpeModel(("X", "A", "C", "G", "T", *[a + b for a, b in MERGES]), MERGES)
    cleaned = df.select("genome", "contig_idx", clean_seq(F.col("seq")).alias("s"))
    both = cleaned.select("genome", "contig_idx", F.explode(F.array("s", reverse_complement(F.col("s")))).alias("s"))
    parts = both.select("genome", "contig_idx", F.explode(F.split("s", "X")).alias("s")).where("not contains(s, '|')")
    slow = parts.select("genome", "contig_idx", F.explode(B.fold_encode(F.col("s"), MERGES)).alias("term")).where("length(term) > 2")
    got = B.bpe_encode(df.where("seq is null or not contains(seq, '|')"), model)
    assert Counter(map(tuple, got.collect())) == Counter(map(tuple, slow.collect())) != Counter()
    assert "MapInArrow" in plan(got) and "replace(" not in plan(got)
    counter = TokenCounter(B.bpe_tokenizer(model, spark), 13)
    want = Counter((r.genome, r.term) for r in got.collect())
    counted = counter.counts(df.where("seq is null or not contains(seq, '|')"))
    assert {(r.genome, r.term): r.tf for r in counted.collect()} == want
    assert counted.schema["tf"].dataType.simpleString() == "bigint"
    signed = counter.counts(df, sign=F.lit(-1)).agg(F.sum("tf")).first()[0]
    assert signed == -counter.counts(df).agg(F.sum("tf")).first()[0]


def test_long_texts_are_cut_at_mask_symbols(monkeypatch):
    monkeypatch.setattr(B, "SLICE_LETTERS", 5)
    parts, rows = B._split_long(pa.array(["ACGTXXACA"]))
    assert parts.to_pylist() == ["ACGT", "", "ACA"] and rows.tolist() == [0, 0, 0]
    assert B._split_long(pa.array([None], pa.string()))[1] is None and B._split_long(pa.array(["ACGTX"]))[1] is None


def test_pairs_in_a_table_and_in_sorted_keys_merge_alike(monkeypatch):
    rng = np.random.default_rng(3)
    merges = [(a, b) for a in "ACGT" for b in "ACGT"] + [("AA", "AA"), ("AC", "GT"), ("ACGT", "ACGT"), ("TT", "T")]
    texts = ["".join(rng.choice(list("ACGTTTTXé"), size=n)) for n in rng.integers(0, 60, 200)]
    table = MergeKernel(merges, "X")
    monkeypatch.setattr("helixbag.operators.merge_kernel.TABLE_SYMBOLS", 0)
    keys = MergeKernel(merges, "X")
    assert table.table is not None and keys.table is None
    assert table.encode(texts).to_pylist() == keys.encode(texts).to_pylist()


def test_keys_of_a_batch_are_numbered_with_nulls():
    batch = pa.RecordBatch.from_pydict({"a": [1, None, 1, 2, None], "b": ["x", "y", "x", "x", "y"]})
    number, rows = L.key_numbers(batch, ["a", "b"])
    assert number[0] == number[2] and number[1] == number[4] and len(set(number.tolist())) == len(rows) == 3
    assert [batch.column("a")[r].as_py() for r in rows[number]] == [1, None, 1, 2, None]
