"""Indexed blocks against plain lists."""

import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from helixbag.operators import bpe as B
from helixbag.operators import pair_index as P


def flat(sentences):
    return np.array([t for s in sentences for t in [*s, P.WALL]], dtype=np.int32)


def plain_counts(sentences, weights):
    out = Counter()
    for s, w in zip(sentences, weights):
        for pair in zip(s, s[1:]):
            out[P.pair_key(*pair)] += w
    return out


def plain_merge(sentence, table):
    out, i = [], 0
    while i < len(sentence):
        pair = tuple(sentence[i : i + 2])
        out.append(table.get(pair, sentence[i]))
        i += 2 if pair in table else 1
    return out


@pytest.mark.parametrize("seed", range(30))
def test_a_merge_and_its_changes_equal_plain_lists(seed):
    rng = random.Random(seed)
    sentences = [[rng.randrange(5) for _ in range(rng.choice([1, 2, 3, 30]))] for _ in range(8)] + [[3] * 7, [3]]
    weights = [rng.randint(1, 4) for _ in sentences]
    table = rng.choice([{(3, 3): 9}, {(0, 1): 9, (0, 2): 10, (3, 1): 11}, {(4, 0): 9}, {(7, 7): 9}, {(1, 2): 9, (3, 3): 10}])
    olds = sorted(table)
    merged, (moved, moves) = P.merge(flat(sentences), np.array(weights), np.array([P.pair_key(*p) for p in olds]),
                                     np.array([table[p] for p in olds], dtype=np.int32))
    want = [plain_merge(s, table) for s in sentences]
    assert merged.tolist() == flat(want).tolist()
    after = plain_counts(want, weights)
    after.subtract(plain_counts(sentences, weights))
    assert dict(zip(moved.tolist(), moves.tolist())) == {k: n for k, n in after.items() if n}


def test_blocks_keep_their_index_right(spark, monkeypatch):
    monkeypatch.setattr(P, "BLOCK_LETTERS", 40)
    rng = random.Random(1)
    texts = ["".join(rng.choices("ACGT", k=25)) for _ in range(30)] + ["GGGGG", "T"]
    rows = spark.createDataFrame([(t, i % 3 + 1) for i, t in enumerate(texts)], "sentence string, n long").repartition(3)
    ids = {"A": 1, "C": 2, "G": 3, "T": 4}
    blocks = P.build_blocks(rows, ids)
    assert blocks.count() > 3
    after = P.apply_merges(P.apply_merges(blocks, [(1, 2, 5), (3, 3, 6)]), [(5, 5, 7)])
    want = Counter()
    for i, t in enumerate(texts):
        s = plain_merge(plain_merge([ids[c] for c in t], {(1, 2): 5, (3, 3): 6}), {(5, 5): 7})
        want.update(plain_counts([s], [i % 3 + 1]))
    assert {r.pair: r.n for r in P.pair_totals(after).collect()} == dict(want)
    # A block without the pair is left out of the changes, and its tokens stay.
    assert P.changes(P.apply_merges(blocks, [(8, 9, 10)])).count() == 0


@pytest.mark.parametrize("known", [1, 7])
def test_a_short_list_of_known_pairs_learns_the_same(spark, monkeypatch, known):
    rng = random.Random(2)
    texts = spark.createDataFrame([("".join(rng.choices("ACGTX", k=60)),) for _ in range(25)] + [(None,), ("",)], "sentence string")
    whole = B.bpe_train(texts, 24)
    monkeypatch.setattr(B, "KNOWN_PAIRS", known)
    assert B.bpe_train(texts, 24) == whole


def test_nothing_to_learn(spark):
    empty = spark.createDataFrame([], "sentence string")
    assert B.bpe_train(empty, 50).tokens == ("X", "A", "C", "G", "T")


@pytest.mark.parametrize("known,distinct", [(100_000, False), (100_000, True), (40, True)])
def test_many_merges_are_learned_in_one_stage_and_alike(spark, monkeypatch, known, distinct):
    rng = random.Random(3)
    texts = ["".join(rng.choices("ACGTXN", (9, 6, 5, 8, 1, 1), k=rng.choice([1, 2, 60]))) for _ in range(40)] + ["A" * 31, "AC" * 9]
    frame = spark.createDataFrame([(t,) for t in (texts if distinct else texts * 3)], "sentence string")
    monkeypatch.setattr(B, "FEW_MERGES", 10 ** 9)
    by_jobs = B.bpe_train(frame, 90, 2)
    monkeypatch.setattr(B, "FEW_MERGES", 0)
    monkeypatch.setattr(B, "KNOWN_PAIRS", known)
    monkeypatch.setattr(B, "apply_merges", None)
    assert B.bpe_train(frame, 90, 2) == by_jobs and len(by_jobs.merges) > 50


@pytest.mark.parametrize("seed", range(30))
def test_cells_equal_plain_lists(seed, monkeypatch):
    from helixbag.operators import joint_learning as J

    monkeypatch.setattr(J, "CHUNK_LETTERS", 40)
    rng = random.Random(seed)
    texts = ["".join(rng.choices("ABC", k=rng.choice([1, 2, 3, 30]))) for _ in range(8)] + ["A" * 9, "B"]
    weights = [rng.randint(1, 4) for _ in texts]
    held = J.Sentences([pa.record_batch([pa.array(texts), pa.array(weights)], names=["s", "n"])], {"A": 0, "B": 1, "C": 2}, 50)
    sentences = [["ABC".index(c) for c in t] for t in texts]
    for made in range(3, 9):
        counts = plain_counts(sentences, weights)
        assert dict(zip(*(v.tolist() for v in held.counts()))) == dict(counts)
        # Equal pairs often, as their runs overlap themselves.
        pair = P.pair_of(rng.choice([k for k in counts if rng.random() < 0.5 or len(set(P.pair_of(k))) == 1] or list(counts)))
        moved, moves = held.merge(*pair, made)
        sentences = [plain_merge(s, {pair: made}) for s in sentences]
        after = plain_counts(sentences, weights)
        after.subtract(counts)
        assert dict(zip(moved.tolist(), moves.tolist())) == {k: n for k, n in after.items() if n}
        # A merge that is undone leaves no trace.
        held.undo(0, made + 1)
        cells = [c.copy() for c, _, _ in held.chunks]
        held.merge(made, made, made + 1)
        held.merge(0, 0, made + 2)
        held.undo(2, made + 1)
        assert all((c == d).all() for c, (d, _, _) in zip(cells, held.chunks))


def test_learning_by_jobs_caches_no_blocks(spark, monkeypatch):
    """Rounds repeat past merges over stored blocks of two bytes a token, and write them anew after some rounds."""
    rng = random.Random(5)
    texts = ["".join(rng.choices("ACGTN", (9, 6, 5, 8, 1), k=70)) for _ in range(40)] + ["A" * 9]
    frame = spark.createDataFrame([(t,) for t in texts], "sentence string")
    want = B.bpe_train(frame, 60, 2)
    held, kinds, wrote = set(), set(), []
    inner, store = B.apply_merges, B.materialize
    seen = lambda: {r for r in spark.sparkContext._jsc.getPersistentRDDs().keySet().toArray()}
    past = seen()

    def spy(blocks, merges, before=(), kind=None):
        held.update(seen() - past)
        kinds.add(kind)
        return inner(blocks, merges, before, kind)

    monkeypatch.setattr(B, "apply_merges", spy)
    monkeypatch.setattr(B, "materialize", lambda *a: wrote.append(a[1]) or store(*a))
    monkeypatch.setattr(B, "FEW_MERGES", 10 ** 9)
    monkeypatch.setattr(B, "CUT_EVERY", 2)
    assert B.bpe_train(frame, 60, 2) == want and len(want.merges) > 30
    assert not held and kinds == {np.int16} and len(wrote) > 2
    assert P.cell_type(1 << 15) == np.int32


@pytest.mark.parametrize("seed", range(10))
def test_cells_in_files_equal_cells_in_memory(seed, monkeypatch):
    """A share beyond what a task holds is mapped, and no places are remembered but those of tokens that were there before."""
    from helixbag.operators import joint_learning as J

    monkeypatch.setattr(J, "CHUNK_LETTERS", 40)
    rng = random.Random(seed)
    texts = ["".join(rng.choices("ABC", k=rng.choice([1, 2, 3, 30]))) for _ in range(30)] + ["A" * 9, "B"]
    batch = pa.record_batch([pa.array(texts), pa.array([rng.choice([1, 300, 1 << 33]) for _ in texts])], names=["s", "n"])
    plain = J.Sentences([batch], {"A": 0, "B": 1, "C": 2}, 50)
    monkeypatch.setattr(J, "HELD_CELLS", 60)
    monkeypatch.setattr(J, "HELD_PLACES", 0)
    monkeypatch.setattr(J, "COUNTED_CHUNKS", 1)
    filed = J.Sentences([batch], {"A": 0, "B": 1, "C": 2}, 50)
    assert sum(cells.base is not None for cells, _, _ in filed.chunks) >= 3
    for made in range(3, 9):
        counts = [dict(zip(*(v.tolist() for v in held.counts()))) for held in (plain, filed)]
        assert counts[0] == counts[1]
        pair = P.pair_of(rng.choice([k for k in counts[0] if rng.random() < 0.5 or len(set(P.pair_of(k))) == 1] or list(counts[0])))
        moved = [[v.tolist() for v in held.merge(*pair, made)] for held in (plain, filed)]
        assert moved[0] == moved[1]
        assert all(step[1] is None for step in filed.done[-1])
        for held in (plain, filed):
            held.undo(0, made + 1)
            cells = [c.copy() for c, _, _ in held.chunks]
            # Two new tokens on top of each other, and one that is spelled again.
            held.merge(0, 1, made + 1)
            held.merge(made + 1, made + 1, made + 2)
            held.merge(2, 2, made)
            held.undo(3, made + 1)
            assert all((c == d).all() for c, (d, _, _) in zip(cells, held.chunks))
