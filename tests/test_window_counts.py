"""k-mer windows counted by whole batches, against plain Python."""

import re
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from helixbag.operators import terms as T
from tests.test_letters import TEXTS, plan


def windows(text, k_min, k_max):
    return Counter(run[i : i + k_max] for run in re.split("[^ACGT]+", text or "") for i in range(len(run) - k_min + 1))


@pytest.mark.parametrize("ks", [(3, 3), (3, 4), (1, 5)])
def test_kmers_are_counted_in_batches_before_any_row_is_made(spark, ks):
    rows = [(i % 3 if i % 4 else None, str(i % 2), t) for i, t in enumerate(TEXTS * 3)]
    df = spark.createDataFrame(rows, "genome long, target string, seq string")
    got = T.kmer_counts(df, *ks, keys=("genome", "target"), sign=F.when(F.col("seq").startswith("A"), 1).otherwise(-1))
    want = Counter()
    for genome, target, text in rows:
        for window, n in windows(text, *ks).items():
            for k in range(ks[0], len(window) + 1):
                want[genome, target, window[:k]] += n if text.startswith("A") else -n
    assert {(r[0], r[1], r[2]): r[3] for r in got.where("tf <> 0").collect()} == {k: n for k, n in want.items() if n}
    assert "MapInArrow" in plan(T.kmer_counts(df, *ks)) and "substring(text" not in plan(T.kmer_counts(df, 3, 3))


def test_a_long_text_is_numbered_in_parts(monkeypatch):
    monkeypatch.setattr(T, "WINDOW_LETTERS", 7)
    texts = ["ACG", "ACGTACGTAGGTCA" * 2, "", None, "CCCCCCC", "AC", "GT"]
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], names=["seq"])
    assert [(row, bytes(data).decode(), offsets.tolist()) for row, data, offsets in T._text_slices(batch, 2)] == [
        (0, "ACG", [0, 3]), (1, "ACGTACGTA", [0, 9]), (1, "TAGGTCAAC"[:9], [0, 9]), (1, "ACGTACGTA", [0, 9]), (1, "TAGGTCA", [0, 7]),
        (2, "CCCCCCC", [0, 0, 0, 7]), (5, "ACGT", [0, 2, 4])]


@pytest.mark.parametrize("ks,letters", [((3, 8), 1 << 20), ((6, 6), 50), ((1, 7), 9)])
def test_long_kmers_of_a_key_are_counted_in_one_go(spark, ks, letters):
    """Keys that are null, lie in several batches and slices, or have texts without a window; no row is made per window."""
    rows = [(i % 3 if i % 4 else None, str(i % 2), t) for i, t in enumerate([*TEXTS, "ACGTTGCAXN" * 9, None, "é", "GATTACA"] * 3)]
    df = spark.createDataFrame(rows, "genome long, target string, seq string")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2")
    try:
        got = T.kmer_counts(df, *ks, keys=("genome", "target"))
        assert "MapInArrow" in plan(got) and "substring(text" not in plan(got)
        found = [tuple(r) for r in got.collect()]
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    want = Counter()
    for genome, target, text in rows:
        for window, n in windows(text, *ks).items():
            for k in range(ks[0], len(window) + 1):
                want[genome, target, window[:k]] += n
    assert len(found) == len(want) and {r[:3]: r[3] for r in found} == dict(want)

    # The same function in this process, by short slices.
    made = Counter()
    batch = pa.RecordBatch.from_arrays([pa.array([r[2] for r in rows])], names=["seq"])
    words = T.kmer_words(*ks)
    for row, data, offsets in T._text_slices(batch, ks[1] - 1, letters):
        own = letters if len(offsets) == 2 else len(data) + len(offsets)
        groups = T.np.arange(row, row + len(offsets) - 1) % 5
        for group, word, n in zip(*(v.tolist() for v in T.tally_kmers(data, offsets, own, groups, *ks))):
            made[group, words[word]] += n
    want = Counter()
    for i, (_, _, text) in enumerate(rows):
        for window, n in windows(text, *ks).items():
            for k in range(ks[0], len(window) + 1):
                want[i % 5, window[:k]] += n
    assert made == want
