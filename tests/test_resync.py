"""Token changes around masks against counting masked and whole texts."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from helixbag.catalog.sequences import LONG_MODEL, MODEL
from helixbag.operators import bpe as B
from helixbag.operators import knockout as K
from helixbag.operators.merge_kernel import MergeKernel
from helixbag.operators import resync as R

CONTIGS = "genome long, contig_idx long, seqid string, seq string"
LOCATED = "genome long, target string, contig_idx long, pos long, start long, end long"


def whole(seq, merges):
    """Tokens of both strands, segment by segment, by merging letter by letter."""
    rank = {m: i for i, m in reversed(list(enumerate(merges)))}
    counts = Counter()
    for part in R.SEGMENT.findall(seq):
        for strand in (part, part.translate(R.COMPLEMENT)[::-1]):
            counts.update(t for t in B._segment_tokens(strand, rank) if len(t) > 2)
    return counts


def masked(seq, spans):
    for low, high in spans:
        seq = seq[:low] + "X" * (high - low) + seq[high:]
    return seq


def learned(rng, n):
    """A merge list that joins what is there, with long runs of one letter among it."""
    merges, made = [], ["A", "C", "G", "T"]
    known = set(made)
    while len(merges) < n:
        a, b = rng.choice(made), rng.choice(made[-12:] + ["A"])
        if a + b not in known and len(a + b) < 40:
            merges.append((a, b))
            made.append(a + b)
            known.add(a + b)
    return tuple(merges)


@pytest.mark.parametrize("seed", range(12))
def test_changes_equal_counting_twice(seed):
    rng = random.Random(seed)
    merges = (MODEL.merges, LONG_MODEL.merges, learned(rng, 30), learned(rng, 120))[seed % 4]
    contigs = []
    for _ in range(25):
        motif = "".join(rng.choices("ACGT", k=6))
        letters = rng.choice(["ACGT", "AC", "A", "ACGTNx", motif])
        seq = "".join(rng.choices([*letters, motif, "AAAAAAA"], k=rng.randint(1, 300)))
        lists = []
        for _ in range(8):
            marks = sorted(rng.sample(range(len(seq) + 1), min(len(seq) + 1, 2 * rng.randint(1, 4))))
            spans = list(zip(marks[::2], marks[1::2]))
            lists.append([s for s in spans if s[0] < s[1]])
        lists += [[], [(0, len(seq))], [(0, 1)], [(len(seq) - 1, len(seq))]]
        contigs.append((seq, lists))
    for (seq, lists), got in zip(contigs, R.token_changes(MergeKernel(merges), contigs)):
        before = whole(seq, merges)
        for spans, counts in zip(lists, got):
            after = whole(masked(seq, spans), merges)
            want = {t: after[t] - before[t] for t in {*after, *before} if after[t] != before[t]}
            assert {t: n for t, n in counts.items() if n} == want, (seq, spans)


def test_only_tokens_beside_a_mask_are_encoded_again(monkeypatch):
    rng = random.Random(5)
    seq = "".join(rng.choices("ACGT", k=100_000))
    kernel, sizes = MergeKernel(LONG_MODEL.merges), []
    encode = kernel.encode
    monkeypatch.setattr(kernel, "encode", lambda texts: (sizes.append(sum(map(len, texts))), encode(texts))[1])
    R.token_changes(kernel, [(seq, [[(i * 900, i * 900 + 60)] for i in range(1, 101)])])
    # Both strands once, then some tokens beside each of 400 cuts.
    assert sizes[0] == 200_000 and sum(sizes[1:]) < 400 * 60


def test_spans_equal_the_masking_fold(spark):
    rng = random.Random(9)
    rows, want = [], []
    for i in range(60):
        motif = "".join(rng.choices("ACGT", k=5))
        seq = "".join(rng.choices(["A", "CG", motif, "N", "X", "é"], k=40))
        cuts = [{"start": (s := rng.randint(-3, len(seq))), "end": s + rng.randint(-2, 12)} for _ in range(rng.randint(1, 4))]
        rows.append((i, seq, [(k, c["start"], c["end"]) for k, c in enumerate(cuts)]))
        want.append([masked(seq, R.masked_spans(seq, cuts, 4, copies)) for copies in (True, False)])
    frame = spark.createDataFrame(rows, "i long, seq string, cuts array<struct<pos:long,start:long,end:long>>")
    got = frame.select("i", *[K.mask_intervals(F.col("seq"), F.col("cuts"), 4, c).alias(n) for c, n in ((True, "a"), (False, "b"))])
    assert [[r["a"], r["b"]] for r in got.orderBy("i").collect()] == want


def test_counter_equals_counting_changed_contigs_whole(spark):
    rng = random.Random(2)
    contigs = [(g, c, f"c{c}", "".join(rng.choices("ACGTN", (8, 6, 6, 8, 1), k=rng.choice([30, 400])))) for g in range(6) for c in range(3)]
    contigs.append((9, 0, "c0", None))
    cuts = [(g, f"T{rng.randrange(3)}", c, p, s, s + rng.randint(0, 30)) for g in range(6) for c in range(3)
            for p in range(4) for s in [rng.randrange(380)]] + [(9, "T0", 0, 0, 1, 5)]
    frame, located = spark.createDataFrame(contigs, CONTIGS), spark.createDataFrame(cuts, LOCATED)
    counter = R.subword_counter(LONG_MODEL, spark)
    assert isinstance(counter, R.SubwordCounter)
    for copies in (True, False):
        fast = K.term_changes(frame, located, 20, counter, copies)
        slow = K.count_changes(K.changed_contigs(frame, located, 20, copies), counter)
        rows = sorted(tuple(r) for r in fast.select("genome", "target", "term", "tf").collect())
        assert rows and rows == sorted(tuple(r) for r in slow.select("genome", "target", "term", "tf").collect())
    assert K.term_changes(frame.limit(0), located, 20, counter).count() == 0


def test_ranks_that_fall_count_whole_contigs(spark):
    falling = B.BpeModel(("X", "A", "C", "AC", "ACA"), (("AC", "A"), ("A", "C")))
    assert not isinstance(R.subword_counter(falling, spark), R.SubwordCounter)


def test_changes_of_all_contigs_of_a_slice_leave_in_one_batch(spark):
    """Rows of many contigs and targets, null genomes among them, against counting whole contigs."""
    rng = random.Random(8)
    rows, want = [], Counter()
    model = LONG_MODEL
    kernel = MergeKernel(model.merges)
    for i in range(40):
        seq = "".join(rng.choices("ACGTB", (9, 9, 9, 9, 1), k=rng.randint(0, 90)))
        cuts = [("t%d" % k, [(0, a, a + rng.randint(0, 25))]) for k in range(3) for a in [rng.randint(0, 80)]]
        rows.append((i % 5 or None, seq, cuts))
        for name, ((_, start, end),) in cuts:
            (changed,), = R.token_changes(kernel, [(seq, [R.masked_spans(seq, [{"start": start, "end": end}], 4)])])
            for term, n in changed.items():
                want[i % 5 or None, name, term] += n
    df = spark.createDataFrame(
        rows, "genome long, seq string, _targets array<struct<target:string,_cuts:array<struct<pos:int,start:int,end:int>>>>").coalesce(1)
    got = R.subword_counter(model, spark).changes(df, 4)
    assert {tuple(r)[:3]: r.tf for r in got.collect()} == {k: n for k, n in want.items() if n}
    assert len(want) > 100
