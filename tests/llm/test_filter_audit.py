import random
import re
from itertools import combinations, permutations
from math import factorial

import pytest
from pyspark.sql import functions as F

from helixbag.llm import filter_audit

SCHEMA = "doc_id long, text string, source string, mask string"
LABELS = "doc_id long, quality int, toxic int"


def classic(n):
    """n! times the Shapley weights by the formula over coalitions."""
    rows = []
    for i in range(n):
        row = [0] * (1 << n)
        for size in range(n):
            for others in combinations([j for j in range(n) if j != i], size):
                s = sum(1 << j for j in others)
                weight = factorial(size) * factorial(n - size - 1)
                row[s | 1 << i] += weight
                row[s] -= weight
        rows.append(row)
    return rows


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5])
def test_least_squares_give_the_shapley_weights(n):
    got = filter_audit.shapley_weights(n)
    want = classic(n)
    # The empty coalition removes nothing, so its weight plays no part.
    assert [row[1:] for row in got] == [row[1:] for row in want]


def brute(rows, labels):
    good = {k for k, q, _ in labels if q == 1 and k is not None}
    toxic = {k for k, _, t in labels if t == 1 and k is not None}
    failed = []
    for key, text, source, *_ in rows:
        body = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", body)
        fails = set()
        if len(words) < 50:
            fails.add("A")
        if 100 * len(set(words)) < 65 * len(words):
            fails.add("B")
        if 100 * len(re.findall("[A-Z]", body)) > 5 * len(body):
            fails.add("C")
        if re.search(r"[#$%&*|]", body):
            fails.add("D")
        if key is not None and any(k is not None and k < key and (t or "") == body for k, t, *_ in rows):
            fails.add("E")
        failed.append((key, source or "", fails))
    out = {}
    for part in {p for _, p, _ in failed}:
        own = [(k, f) for k, p, f in failed if p == part]
        sums = dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left, gone = own, []
            for step, letter in enumerate(order, 1):
                here = [(k, f) for k, f in left if letter in f]
                left = [(k, f) for k, f in left if letter not in f]
                sums[letter] += len(here)
                out[part, "".join(order), step] = [
                    len(left), len(here), sum(letter in f for _, f in gone), sum(f == {letter} for _, f in own),
                    sum(k in good for k, _ in here), sum(k in toxic for k, _ in here), letter]
                gone = gone + here
        for key, values in out.items():
            if key[0] == part:
                values[-1] = sums[values[-1]] if isinstance(values[-1], str) else values[-1]
    return {k: tuple(v) for k, v in out.items()}


def run(spark, rows, labels):
    docs = spark.createDataFrame(rows, SCHEMA)
    found = filter_audit.audit(docs, spark.createDataFrame(labels, LABELS)).collect()
    got = {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley)
           for r in found}
    assert len(got) == len(found)
    return got


def test_equals_removing_row_by_row(spark):
    rng = random.Random(8)
    texts = [None, "", " \t\n ", "A B C # D", "x" * 100_000, "long " * 40_000]
    for _ in range(20):
        size = rng.choice([10, 49, 50, 80])
        texts.append(" ".join(rng.choice(["ab", "Cd", "EFG", "h", "#", "x%d" % rng.randint(0, 200)]) for _ in range(size)))
    rows = [(rng.choice([None, *range(60)]), rng.choice(texts), rng.choice([None, "", "s1", "s2", "s3"]), "extra") for _ in range(200)]
    # Repeated rows, rows of one id in two parts, and a large group of copies.
    rows += rows[:5] + [(7, texts[-1], "s1", ""), (7, texts[-1], "s2", ""), (7, texts[-1], "s2", "")]
    rows += [(i, "the same text", "s1", "") for i in range(100, 180)] + [(3, "lonely", "only copies", ""), (4, "lonely", "copied", "")]
    labels = [(rng.choice([None, *range(180), 999]), rng.choice([0, 1, None]), rng.choice([0, 1, None])) for _ in range(150)]
    want = brute(rows, labels)
    got = run(spark, rows, labels)
    assert got == want
    assert {k[0] for k in got} == {"", "s1", "s2", "s3", "only copies", "copied"}


def test_empty_tables(spark):
    assert run(spark, [], []) == {}
    got = run(spark, [(1, "a", "s", "")], [])
    assert len(got) == 600 and all(v[4:6] == (0, 0) for v in got.values())


def test_other_filters_may_be_named(spark):
    docs = spark.createDataFrame([(1, "aa", "p", ""), (2, "b", "p", ""), (3, "aa", "p", "")], SCHEMA)
    labels = spark.createDataFrame([], LABELS)
    got = filter_audit.audit(docs, labels, {"L": F.length("text") > 1}, "X").collect()
    assert {(r.filter_order, r.step): (r.kept, r.removed, r.shapley) for r in got} == {
        ("LX", 1): (1, 2, 3), ("LX", 2): (1, 0, 1), ("XL", 1): (2, 1, 1), ("XL", 2): (1, 1, 3)}
    with pytest.raises(ValueError):
        filter_audit.audit(docs, labels, {x: F.lit(True) for x in "ABCDEF"}, "G")
