"""Trees walked again only where a job changes them, against walking all trees on whole vectors."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from helixbag.operators import features as X
from helixbag.operators import forest as W
from helixbag.operators import knockout as K
from helixbag.operators import loci as L
from tests.test_knockout import study  # noqa: F401


def grown(rng, trees, features, depth):
    """Random full trees; thresholds include 0 and less."""
    nodes = []
    for t in range(trees):
        inner = 2**depth - 1
        for i in range(2 * inner + 1):
            if i < inner:
                threshold = rng.choice([0.0, -0.1, 0.05, 0.2, rng.random()])
                nodes.append((t, i, 2 * i + 1, 2 * i + 2, rng.randrange(features) * 3, threshold, 0.0))
            else:
                nodes.append((t, i, -1, -1, W.LEAF, 0.0, rng.uniform(-1, 1)))
    return nodes


def plain(nodes, weights):
    total, table = 0.0, {(n[0], n[1]): n for n in nodes}
    for t in sorted({n[0] for n in nodes}):
        node = table[t, 0]
        while node[4] != W.LEAF:
            node = table[t, node[2] if weights.get(node[4], 0.0) <= node[5] else node[3]]
        total += node[6]
    return total


@pytest.mark.parametrize("seed", range(6))
def test_margins_equal_walking_everything(seed, monkeypatch):
    rng = random.Random(seed)
    features = 40
    nodes = grown(rng, 60, features, 3)
    idf = {i * 3: rng.uniform(1, 4) for i in range(features)}
    forest = W.Forest.from_nodes(nodes, idf)
    counts = {i: rng.randint(1, 9) for i in idf if rng.random() < 0.6}
    outside = rng.uniform(0, 50)
    norm2 = outside + sum((n * idf[i]) ** 2 for i, n in counts.items())
    jobs, want = [], []
    for k in range(40):
        # Few changes, none, all gone, or only terms that no tree reads.
        chosen = rng.sample(sorted(idf), rng.randint(0, 4)) if k else sorted(idf)
        changes = {i: (-counts.get(i, 0) if not k else rng.randint(-counts.get(i, 0), 3)) for i in chosen}
        after = {i: counts.get(i, 0) + changes.get(i, 0) for i in idf}
        other = outside * rng.choice([1, 1, 0.9, 2])
        total = other + sum((n * idf[i]) ** 2 for i, n in after.items())
        jobs.append((total - norm2, [(i, n) for i, n in changes.items() if n]))
        norm = np.sqrt(total)
        want.append(plain(nodes, {i: n * idf[i] / norm for i, n in after.items() if n and norm}))
    walked, walk = [], W.Forest.walk
    monkeypatch.setattr(W.Forest, "walk", lambda self, trees, *rest: (walked.append(len(trees)), walk(self, trees, *rest))[1])
    got = list(forest.score(norm2, list(counts.items()), jobs))
    assert got == pytest.approx(want, abs=1e-9)
    assert walked[0] == 60 and sum(walked[2:]) < 60 * 40 * 0.7


def test_genome_without_terms_and_trees_without_splits():
    leaf = W.Forest.from_nodes([(0, 0, -1, -1, W.LEAF, 0.0, 0.5)], {})
    assert list(leaf.score(0.0, [], [(0.0, []), (4.0, [])])) == [0.5, 0.5]
    stump = W.Forest.from_nodes([(0, 0, 1, 2, 7, 0.5, 0.0), (0, 1, -1, -1, W.LEAF, 0.0, -1.0), (0, 2, -1, -1, W.LEAF, 0.0, 1.0)], {7: 2.0})
    assert list(stump.score(0.0, [], [(0.0, []), (4.0, [(7, 1)])])) == [-1.0, 1.0]
    assert list(stump.score(4.0, [(7, 1)], [(0.0, []), (-4.0, [(7, -1)]), (100.0, [])])) == [1.0, -1.0, -1.0]


@pytest.mark.parametrize("counter", [X.KmerCounter(3, 4), X.KmerCounter(3, 5)])
def test_every_job_equals_the_model_on_whole_vectors(spark, study, counter):  # noqa: F811
    frame, table, labels, panel = study
    model = X.TfidfVectorizer(counter).fit(frame)
    data = labels.join(X.assemble_features(model.transform(frame), model.size), "genome").cache()
    classifier = X.train_classifier(data, max_bin=16, max_depth=4, n_estimators=8, num_leaves=16)
    located = L.locate_genes(frame, table, panel).withColumn("target", F.col("locus_tag"))
    jobs = located.select("genome", "target").union(labels.select("genome", F.lit("none")))
    changes = K.term_changes(frame, located, 20, counter).cache()
    tf = counter.counts(frame).cache()
    forest = W.Forest.from_model(classifier, model.vocab)
    got = {(r[0], r[1]): r[2] for r in K.forest_scores(tf, changes, jobs, model, forest).collect()}
    vectors = K.knockout_features(tf, changes, jobs, model)
    want = {(r["genome"], r["target"]): r["probability"] for r in X.predict_proba(classifier, vectors, K.KEYS).collect()}
    assert got == pytest.approx(want, abs=1e-9) and len(got) > 100 and len(set(got.values())) > 1


def test_jobs_of_many_genomes_are_scored_together(monkeypatch):
    rng = random.Random(9)
    nodes = grown(rng, 20, 30, 3)
    idf = {i * 3: rng.uniform(1, 4) for i in range(30)}
    forest = W.Forest.from_nodes(nodes, idf)
    norm2, counts, of, shifts, changes, want = [], [], [], [], [], []
    for g in range(7):
        held = {i: rng.randint(1, 9) for i in idf if rng.random() < 0.5} if g else {}
        norm2.append(sum((n * idf[i]) ** 2 for i, n in held.items()))
        counts += [(g, i, n) for i, n in held.items()]
        for _ in range(rng.randint(1, 9)):
            after = dict(held)
            for i in rng.sample(sorted(idf), rng.randint(0, 4)):
                n = rng.randint(-held.get(i, 0), 3)
                changes.append((len(of), i, n))
                after[i] = held.get(i, 0) + n
            total = sum((n * idf[i]) ** 2 for i, n in after.items())
            of.append(g), shifts.append(total - norm2[g])
            norm = np.sqrt(total)
            want.append(plain(nodes, {i: n * idf[i] / norm for i, n in after.items() if n and norm}))
    columns = [tuple(np.array(c) for c in zip(*rows)) for rows in (counts, changes)]
    calls, walk = [], W.Forest.walk
    monkeypatch.setattr(W.Forest, "walk", lambda self, *rest: (calls.append(1), walk(self, *rest))[1])
    for cells, most in ((1 << 18, 2), (90, 2 * len(of))):
        calls.clear()
        monkeypatch.setattr(W, "BLOCK_CELLS", cells)
        got = forest.score_many(np.array(norm2), columns[0], np.array(of), np.array(shifts), columns[1])
        assert got == pytest.approx(want, abs=1e-9) and len(calls) <= most
