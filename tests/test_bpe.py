"""Subword learning and encoding against the public tokenizer library and by hand."""

import json
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from helixbag.operators import bpe as B
from helixbag.operators import merge_kernel
from helixbag.operators.merge_kernel import MergeKernel, in_order

tokenizers = pytest.importorskip("tokenizers")


def corpus(n, length, seed, letters="ACGTX", weights=(10, 6, 5, 8, 1)):
    rng = random.Random(seed)
    return ["".join(rng.choices(letters, weights, k=rng.randint(20, length))) for _ in range(n)]


def library(sentences, size, least=5):
    tok = tokenizers.SentencePieceBPETokenizer(add_prefix_space=False)
    tok.train_from_iterator([sentences], show_progress=False, initial_alphabet=list("ACGT"), vocab_size=size,
                            special_tokens=["X"], min_frequency=least)
    return tok


@pytest.mark.parametrize("seed,size,length", [(1, 40, 60), (2, 120, 150), (3, 300, 80)])
def test_learned_vocabulary_equals_the_library(spark, seed, size, length):
    sentences = corpus(60, length, seed)
    tok = library(sentences, size)
    want = sorted(tok.get_vocab(), key=tok.get_vocab().get)
    model = B.bpe_train(spark.createDataFrame([(s,) for s in sentences], "sentence string"), size)
    assert list(model.tokens) == want


def test_encoding_equals_the_library(spark):
    sentences = corpus(60, 120, 4)
    tok = library(sentences, 200)
    model = B.bpe_train(spark.createDataFrame([(s,) for s in sentences], "sentence string"), 200)
    texts = corpus(10, 400, 5)
    frame = spark.createDataFrame([(i, f"c{i}", s) for i, s in enumerate(texts)], "genome long, seqid string, seq string")
    plain = B.BpeModel(model.tokens, tuple(m for m in model.merges if "X" not in m[0] + m[1]))
    pieces = frame.select("genome", F.posexplode(F.split("seq", "X")).alias("p", "s")).where("s <> ''")
    heap = pieces.select("genome", "p", B.heap_encode(F.col("s"), plain, spark).alias("t")).orderBy("genome", "p").collect()
    for i, text in enumerate(texts):
        want = [t for t in tok.encode(text).tokens if "X" not in t]
        assert [t for r in heap if r["genome"] == i for t in r["t"]] == want


def test_fold_equals_heap_for_merges_with_tokens_of_their_own(spark):
    merges = (("A", "C"), ("G", "T"), ("AC", "GT"), ("A", "A"), ("AA", "AC"))
    model = B.BpeModel(("X", "A", "C", "G", "T"), merges)
    frame = spark.createDataFrame([(s.replace("X", ""),) for s in corpus(20, 200, 6)], "s string")
    rows = frame.select(B.fold_encode(F.col("s"), merges).alias("fold"), B.heap_encode(F.col("s"), model, spark).alias("heap"))
    assert all(r["fold"] == r["heap"] for r in rows.collect())
    with pytest.raises(ValueError):
        B.fold_encode(F.col("s"), (("A", "C"), ("AC", "A"), ("C", "A"), ("A", "CA")))


def repetitive(n, length, seed):
    """Texts of shared motifs, as genes are, so that long tokens are learned."""
    rng = random.Random(seed)
    motifs = ["".join(rng.choices("ACGT", (10, 6, 5, 8), k=rng.randint(5, 40))) for _ in range(200)]
    return ["".join(rng.choice(motifs) if rng.random() < 0.5 else "".join(rng.choices("ACGT", k=20))
                    for _ in range(length // 20)) for _ in range(n)]


@pytest.mark.parametrize("size,sentences", [(300, 200), (2_000, 300), (32_000, 6_000)])
def test_kernel_equals_the_library(size, sentences):
    tok = tokenizers.SentencePieceBPETokenizer(add_prefix_space=False)
    tok.train_from_iterator([repetitive(sentences, 900, 7)], show_progress=False, initial_alphabet=list("ACGT"),
                            vocab_size=size, special_tokens=["X"], min_frequency=2)
    found = json.loads(tok.to_str())["model"]["merges"]
    merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in found]
    assert len(merges) == size - 5 and in_order(merges)
    texts = [*repetitive(20, 4_000, 8), "", "A", "A" * 1_001, "AC" * 700, "ACGTT" * 90, "C"]
    got = MergeKernel(merges, "X").encode(texts).to_pylist()
    assert got == [tok.encode(t).tokens for t in texts]


def test_kernel_equals_heap_on_drawn_merges():
    rng = random.Random(9)
    for _ in range(150):
        tokens, merges = list("ACG"), []
        for _ in range(rng.randint(1, 40)):
            pair = rng.choice(tokens), rng.choice(tokens)
            if pair[0] + pair[1] not in tokens:
                merges.append(pair)
                tokens.append("".join(pair))
        texts = ["".join(rng.choices("ACGXN", (5, 5, 5, 1, 1), k=rng.randint(0, 60))) for _ in range(20)] + [None]
        if not in_order(merges):
            with pytest.raises(ValueError):
                MergeKernel(merges)
            continue
        rank = {m: i for i, m in enumerate(merges)}
        want = [None if t is None else [x for part in t.split("X") for x in B._segment_tokens(part, rank)] for t in texts]
        kernel = MergeKernel(merges, "X")
        assert kernel.encode(texts).to_pylist() == want
        assert [r for b in kernel.encode_batches(iter([pa.array(texts, pa.string()), pa.array([], pa.string())])) for r in b.to_pylist()] == want


def test_slices_of_a_batch_join(monkeypatch):
    monkeypatch.setattr(merge_kernel, "SLICE_LETTERS", 10)
    kernel = MergeKernel([("A", "C"), ("AC", "AC")])
    texts = ["ACACAC", None, "", "ACAC" * 9, "CA"]
    got = pa.concat_arrays(list(kernel.encode_batches(iter([pa.array(texts)])))).to_pylist()
    assert got == [["ACAC", "AC"], None, [], ["ACAC"] * 9, ["C", "A"]]


def test_ranks_that_fall_are_told():
    assert in_order([("A", "C"), ("AC", "G"), ("AC", "AC")])
    assert not in_order([("AC", "G"), ("A", "C")])
    assert not in_order([("A", "C"), ("C", "G"), ("AC", "G"), ("A", "CG")])


def test_kernel_as_a_column(spark):
    frame = spark.createDataFrame([(1, "ACGTACNXAC"), (2, None), (3, "")], "id int, s string")
    model = B.BpeModel((), (("A", "C"), ("G", "T"), ("AC", "GT")))
    got = {r["id"]: r["t"] for r in frame.select("id", B.kernel_encode(F.col("s"), model, spark).alias("t")).collect()}
    assert got == {1: ["ACGT", "AC", "N", "AC"], 2: None, 3: []}


def test_small_corpus_by_hand(spark):
    # AB-like toy: AC occurs 6 times, then ACG 5 times; nothing else reaches 5.
    rows = [("ACG",)] * 5 + [("ACT",)]
    model = B.bpe_train(spark.createDataFrame(rows, "sentence string"), 100)
    assert model.merges == (("A", "C"), ("AC", "G"))
    assert model.tokens == ("X", "A", "C", "G", "T", "AC", "ACG")


def test_json_round_trip():
    model = B.BpeModel(("X", "A", "C", "AC"), (("A", "C"),))
    assert B.BpeModel.from_json(model.to_json()) == model


def test_the_registered_query_learns_from_all_contigs(spark, monkeypatch):
    """Contigs below 500 bases and all windows of longer ones are read, for a vocabulary of 2,000."""
    from helixbag.catalog import QUERIES, learned

    seen = {}

    def train(corpus, size, *args, text="sentence", **more):
        seen.update(rows=corpus.count(), least=corpus.selectExpr(f"min(length({text}))").first()[0], size=size)
        return B.BpeModel(("X",), ())

    monkeypatch.setattr(learned, "bpe_train", train)
    assert QUERIES["bpe_train"](spark, "/root/testdata/sf0.001").count() == 1
    assert seen["rows"] > 0 and seen["least"] < 500 and seen["size"] == 2_000


def test_learning_holds_few_blocks_at_once(spark, monkeypatch):
    names = ("spark.sql.parquet.columnarReaderBatchSize", "spark.sql.inMemoryColumnarStorage.batchSize")
    seen, apply = [], B.apply_merges
    monkeypatch.setattr(B, "apply_merges", lambda *a: seen.extend(int(spark.conf.get(n)) for n in names) or apply(*a))
    before = [spark.conf.get(n) for n in names]
    B.bpe_train(spark.createDataFrame([("ACGTACGT" * 4,)] * 3, "sentence string"), 7)
    # A block has a few hundred KB, and a task holds that many at once.
    assert seen and max(seen) <= 64
    assert [spark.conf.get(n) for n in names] == before
