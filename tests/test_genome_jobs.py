"""Jobs beside the counts of their genome, worked on by whole batches."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from helixbag.functions.sequence import mask_intervals, masked_snippets
from helixbag.operators import genome_jobs as J
from helixbag.operators import knockout as K
from helixbag.operators import resync as R
from tests.test_letters import plan


def test_masked_parts_equal_the_column_function(spark):
    rng = random.Random(4)
    rows = []
    for i in range(60):
        seq = "".join(rng.choices("ACGé", k=rng.randint(0, 60)))
        cuts = [(rng.choice([None, rng.randint(-5, 60)]), rng.choice([None, rng.randint(-5, 70)])) for _ in range(rng.randint(0, 3))]
        rows.append((i, seq, cuts))
    df = spark.createDataFrame(rows, "i int, seq string, cuts array<struct<start:int,end:int>>")
    for copies in (True, False):
        masked = mask_intervals(F.col("seq"), F.col("cuts"), 6, copies)
        slow = df.withColumn("masked", masked).where("seq <> masked").select("i", masked_snippets(F.col("seq"), F.col("masked"), 2).alias("p"))
        want = {r.i: [tuple(p) for p in r.p] for r in slow.collect()}
        got = {}
        for i, seq, cuts in rows:
            spans = R.masked_spans(seq, [{"start": a, "end": b} for a, b in cuts], 6, copies)
            found = [p for p in R.parts_around(seq, spans, 2) if p[0] != p[1]]
            if found:
                got[i] = found
        assert got == want and len(got) > 20


def test_entries_of_sparse_dense_and_missing_vectors(spark):
    rows = [(1, "a", Vectors.sparse(5, [1, 3], [0.5, 0.0])), (2, "b", Vectors.dense([0.0, 2.0, float("nan")])), (3, "c", None),
            (4, "d", Vectors.sparse(5, [], []))]
    df = spark.createDataFrame(rows, ["genome", "target", "features"]).coalesce(1)
    got = [(r.genome, r.target, r.idx, str(r.weight)) for r in K.long_features(df).collect()]
    assert got == [(1, "a", 1, "0.5"), (2, "b", 1, "2.0"), (2, "b", 2, "nan")]
    assert "MapInArrow" in plan(K.long_features(df))


def genome_batch():
    job = pa.struct([("target", pa.string()), ("length", pa.int64())])
    count = pa.struct([("idx", pa.int64()), ("n", pa.int64()), ("idf", pa.float64())])
    change = pa.struct([("target", pa.string()), ("idx", pa.int64()), ("n", pa.int64()), ("idf", pa.float64())])
    c = lambda idx, n, **more: {**more, "idx": idx, "n": n, "idf": 1.0 + idx}
    rows = {
        "genome": pa.array([5, None, 7, 8]),
        "jobs": pa.array([[{"target": "a", "length": 1}, {"target": "b", "length": 2}, {"target": "a", "length": 3}],
                          [{"target": "a", "length": 4}], [{"target": None, "length": 5}], [{"target": "b", "length": 6}]], pa.list_(job)),
        "counts": pa.array([[c(4, 2), c(1, 3)], [], [c(2, 1)], [c(0, 2)]], pa.list_(count)),
        "changes": pa.array([[c(1, -3, target="a"), c(9, 1, target="a"), c(4, 1, target="c")], [], [c(2, 5, target=None)],
                             [c(0, -1, target="b")]], pa.list_(change)),
    }
    return pa.RecordBatch.from_arrays(list(rows.values()), names=list(rows))


@pytest.mark.parametrize("entries", [1 << 19, 1, 4])
def test_changes_go_to_every_job_of_their_target(monkeypatch, entries):
    monkeypatch.setattr(J, "BLOCK_ENTRIES", entries)
    # A slice, so that offsets into the lists do not begin at 0.
    batch = pa.concat_batches([genome_batch(), genome_batch()]).slice(4)
    held = J.GenomeJobs.read(batch)
    want = [{4: 2, 9: 1}, {4: 2, 1: 3}, {4: 2, 9: 1}, {}, {2: 1}, {0: 1}]
    got = []
    for begin, end, offsets, indices, weights in held.vectors():
        assert begin == len(got)
        got += [(indices[a:b].tolist(), weights[a:b].tolist()) for a, b in zip(offsets, offsets[1:])]
        assert len(got) == end
    norms2, shift = held.norms2()
    for i, (counts, (indices, weights)) in enumerate(zip(want, got)):
        norm = np.sqrt(sum((n * (1.0 + k)) ** 2 for k, n in counts.items()))
        assert indices == sorted(counts) and weights == pytest.approx([counts[k] * (1.0 + k) / norm for k in sorted(counts)])
        assert np.sqrt(norms2[held.of[i]] + shift[i]) == pytest.approx(norm)


def test_features_keep_the_columns_of_jobs_and_list_changes_once(spark):
    from helixbag.operators.features import TfidfModel

    vocab = spark.createDataFrame([("x", 0, 1.5), ("y", 1, 2.0), ("z", 2, 1.0)], "term string, idx long, idf double")
    tf = spark.createDataFrame([(1, "x", 2), (1, "q", 9), (2, "y", 1)], "genome long, term string, tf long")
    changes = spark.createDataFrame([(1, "a", "z", 4), (1, "a", "x", -2), (2, "b", "y", 1)], "genome long, target string, term string, tf long")
    jobs = spark.createDataFrame([(10, 1, "a"), (20, 1, "b"), (30, 2, "a"), (40, 3, "a")], "length long, genome long, target string")
    got = K.knockout_features(tf, changes, jobs, TfidfModel(None, vocab, 3))
    assert got.columns == ["length", "genome", "target", "features"]
    rows = {r.length: (r.genome, r.target, r.v) for r in got.select("*", vector_to_array("features").alias("v")).collect()}
    assert rows == {10: (1, "a", [0, 0, 1]), 20: (1, "b", [1, 0, 0]), 30: (2, "a", [0, 1, 0]), 40: (3, "a", [0, 0, 0])}
    text = plan(got)
    assert "map_zip_with" not in text and text.count("-4") <= 1 and text.count("MapInArrow") == 1
