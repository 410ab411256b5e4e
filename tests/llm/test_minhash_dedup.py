import random
import re

from pyspark.sql import functions as F

from helixbag.llm import minhash_dedup as D
from helixbag.llm.components import components


def shingles(text, size):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", lower)
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))) if len(w) >= size else frozenset([tuple(w)])


def brute(rows, size=2, percent=80):
    sets = [(i, shingles(t, size)) for i, t in rows]
    parent = {i: i for i, _ in sets if i is not None}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, (i, a) in enumerate(sets):
        for j, b in sets[k + 1 :]:
            if i is None or j is None or not a or not b or min(len(a), len(b)) * 100 < percent * max(len(a), len(b)):
                continue
            common = len(a & b)
            if 100 * common >= percent * (len(a) + len(b) - common):
                x, y = sorted((root(i), root(j)))
                parent[y] = x
    return sorted(((i, len(s), root(i) if i is not None else None, i is None or root(i) == i) for i, s in sets), key=str)


def found(spark, rows, **more):
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n", F.lit("x"))
    return sorted((tuple(r) for r in D.near_duplicates(docs, shingle=2, **more).collect()), key=str)


def corpus(seed, groups=25, edits=(0, 12)):
    rng = random.Random(seed)
    word = lambda: rng.choice("abcdefghijklmnop") + str(rng.randint(0, 60))
    rows = []
    for _ in range(groups):
        base = [word() for _ in range(rng.choice([1, 2, 3, 5, 6, 9, 20, 60, 90, 200]))]
        for _ in range(rng.choice([1, 2, 3, 30])):
            own = list(base)
            for _ in range(rng.randint(*edits) * len(base) // 120):
                own[rng.randrange(len(own))] = word()
            if rng.random() < 0.3:
                own = own + [word() for _ in range(len(own) // 9)]
            rows.append(" ".join(own).upper() if rng.random() < 0.1 else "\t".join(own))
    rng.shuffle(rows)
    return list(enumerate(rows))


def test_components_equal_brute_force(spark):
    rows = corpus(1) + [(900, None), (901, " \n"), (902, "one"), (903, "ONE"), (904, "é É"), (905, "É é")]
    assert found(spark, rows) == brute(rows)


def test_long_lists_and_shared_passages(spark, monkeypatch):
    monkeypatch.setattr(D, "SHORT", 2)
    rng = random.Random(3)
    passage = [f"p{i}" for i in range(60)]
    rows = corpus(2, groups=12)
    for i in range(150):
        own = [f"{i}x{j}" for j in range(rng.choice([0, 3, 5, 7, 8, 10, 14, 30]))]
        rows.append((5000 + i, " ".join(own + passage)))
    assert found(spark, rows) == brute(rows)


def test_repeated_and_null_keys_and_empty_table(spark):
    rows = [(5, "a b c d e f"), (3, "a b c d e f"), (5, "q r s t u v"), (7, "q r s t u v"), (None, "a b c d e f"), (3, "a b c d e f")]
    assert found(spark, rows) == sorted(
        [(5, 5, 3, False), (3, 5, 3, True), (5, 5, 3, False), (7, 5, 3, False), (None, 5, None, True), (3, 5, 3, True)], key=str)
    assert found(spark, []) == []


def test_components_of_a_long_chain(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(400, 400), (500, 499)], "a long, b long")
    got = dict((r.node, r.component) for r in components(chain).collect())
    assert got == {**{i: 0 for i in range(301)}, 499: 499, 500: 499}


def test_a_percent_that_would_lose_pairs_is_refused(spark):
    import pytest

    docs = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    with pytest.raises(ValueError):
        D.near_duplicates(docs, percent=60)


def test_words_that_polynomial_hashes_confuse_stay_apart(spark):
    one = "".join("ab"[bin(i).count("1") % 2] for i in range(1024))
    two = one.translate(str.maketrans("ab", "ba"))
    rows = [(1, one), (2, two), (3, f"{one} c"), (4, f"{two} c"), (5, one)]
    assert found(spark, rows) == brute(rows)


def test_a_text_larger_than_a_slice(spark):
    rng = random.Random(4)
    long = " ".join(f"{rng.choice('abc')}{rng.randint(0, 9999)}" for _ in range(200_000))
    rows = [(1, long), (2, long[: len(long) * 9 // 10]), (3, long[: len(long) // 2])]
    assert found(spark, rows) == brute(rows)


def test_links_between_two_parts_are_followed_as_one(spark, monkeypatch):
    followed, plain = [], D.components
    monkeypatch.setattr(D, "components", lambda links, label: followed.append(links.count()) or plain(links, label))
    nodes = spark.createDataFrame([(i, i // 20 * 20) for i in range(60)], "node long, component long")
    links = [(i, j, 0, 20) for i in range(20) for j in range(20, 40)] + [(99, 21, 99, 20), (70, 71, 70, 71), (3, 4, 0, 0)]
    got = D._joined(nodes, spark.createDataFrame(links, "a long, b long, _a long, _b long"), "joined")
    assert followed == [3]
    assert dict(map(tuple, got.collect())) == {**{i: 0 for i in range(40)}, **{i: 40 for i in range(40, 60)}, 99: 0, 70: 70, 71: 70}
