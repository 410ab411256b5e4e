import re
from collections import defaultdict

from pyspark.sql import functions as F

from helixbag.llm import mixing as M


def water(sizes):
    """Targets by repeated resharing."""
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: 1 + i % 3 for i, s in enumerate(names)}
    total, capped = sum(sizes.values()), {}
    while True:
        left = total - sum(3 * sizes[s] for s in capped)
        free = sum(weight[s] for s in names if s not in capped)
        aims = {s: 3 * sizes[s] if s in capped else left * weight[s] / free for s in names}
        above = [s for s in names if s not in capped and aims[s] > 3 * sizes[s] + 1e-9]
        if not above:
            return aims
        capped.update(dict.fromkeys(above))


def check(rows, got):
    sizes = defaultdict(int)
    for _, text, source in rows:
        sizes[source] += len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
    aims, taken = water(sizes), defaultdict(int)
    assert len(got) == len(rows)
    for r in got:
        taken[r.source] += r.taken
        assert r.source_size == sizes[r.source] and abs(r.target - aims[r.source]) < 1e-6 * max(1, aims[r.source])
        assert 0 <= r.taken <= 3 * r.size
        if r.source_size:
            epochs = int(r.target / r.source_size + 1e-12)
            assert epochs * r.size <= r.taken <= (epochs + 1) * r.size
    for s in sizes:
        assert abs(taken[s] - aims[s]) <= 1


def make(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("size", F.lit("x"))


def test_targets_and_budgets(spark):
    rows = [(i, "w " * (i % 50), f"s{i % 7}" if i % 3 else "hot") for i in range(3000)]
    rows += [(None, "a b", None), (None, "a b", None), (5, None, "tiny"), (6, "x", "tiny"), (7, None, "void"), (8, "é y", "Ä")]
    first, again = M.mix(make(spark, rows)).collect(), M.mix(make(spark, rows[::-1])).collect()
    check(rows, first)
    assert sorted(map(str, first)) == sorted(map(str, again))


def test_many_ranges_give_the_same_sums(spark, monkeypatch):
    rows = [(i, "w " * (i % 30), "hot" if i % 3 else "cold") for i in range(2000)]
    whole = sorted(map(str, M.mix(make(spark, rows)).collect()))
    monkeypatch.setattr(M, "RANGE", 50)
    assert sorted(map(str, M.mix(make(spark, rows)).collect())) == whole


def test_better_documents_are_taken_first(spark):
    rows = [(i, "good words " * 10 if i % 2 else "b### a*** " * 10, ["a", "b", "c"][i % 3]) for i in range(6000)]
    got = M.mix(make(spark, rows)).collect()
    part = [r for r in got if r.source == "a"]
    assert sum(r.taken for r in part if r.doc_id % 2) > 1.5 * sum(r.taken for r in part if r.doc_id % 2 == 0)


def test_empty_table_and_given_weights(spark):
    assert M.mix(make(spark, [])).count() == 0
    rows = [(i, "w w", "s") for i in range(5)]
    assert len(M.mix(make(spark, rows), weight=F.lit(None)).collect()) == 5
