import hashlib
import random
import re

from pyspark.sql import functions as F

from helixbag.llm import substring_dedup as S


def brute(rows, window=50):
    texts = [(i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in rows]
    first = {}
    for i, w in texts:
        if i is not None:
            for k in range(len(w) - window + 1):
                p = tuple(w[k : k + window])
                first[p] = min(first.get(p, i), i)
    out = []
    for i, w in texts:
        gone = set()
        for k in range(len(w) - window + 1):
            if i is not None and first[tuple(w[k : k + window])] < i:
                gone.update(range(k, k + window))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def found(spark, rows, **more):
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n", F.lit("x"))
    return sorted((tuple(r) for r in S.remove_repeats(docs, **more).collect()), key=str)


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: rng.choice("abcdéf") + str(rng.randint(0, 300))
    passages = [[word() for _ in range(rng.choice([48, 49, 50, 51, 52, 70, 130, 400]))] for _ in range(14)]
    texts = []
    for _ in range(160):
        own = [word() for _ in range(rng.choice([0, 1, 30, 200]))]
        for _ in range(rng.randint(0, 3)):
            p = list(rng.choice(passages))
            if rng.random() < 0.3:
                p[rng.randrange(len(p))] = "edit"
            if rng.random() < 0.3:
                p = p[rng.randint(0, 9) : len(p) - rng.randint(0, 9)]
            own += p + [word() for _ in range(rng.choice([0, 0, 2, 60]))]
        texts.append(rng.choice([" ", "\t", "  \n"]).join(own))
    texts += ["De " * 120, "De " * 300 + "end", "ab ab cd " * 60, "ab ab cd " * 40, "  " + " ".join(passages[0]) + " \n"]
    return list(enumerate(texts))


def test_equals_brute_force(spark):
    rows = corpus(1)
    assert found(spark, rows) == brute(rows)
    assert sum(r[2] for r in brute(rows)) > 3000


def test_small_windows_branch_everywhere(spark):
    rng = random.Random(4)
    rows = [(rng.randint(0, 90), " ".join(rng.choice("ab") for _ in range(rng.randint(0, 60)))) for _ in range(120)]
    assert found(spark, rows, window=9, anchor=3) == brute(rows, 9)


def test_null_and_repeated_keys_empty_table_and_text(spark):
    p = " ".join(f"w{i}" for i in range(60))
    rows = [(None, p), (4, p), (4, p + " more"), (4, p), (9, "x " + p), (9, None), (8, ""), (None, "x " + p)]
    assert found(spark, rows) == brute(rows)
    assert found(spark, []) == []
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = {r.doc_id: r.kept_text for r in S.remove_repeats(docs, with_text=True).where("doc_id = 9 and n_words > 0").collect()}
    assert kept == {9: "x"}


def twins():
    """Two different words of equal sums under polynomial hashes modulo 2**64 with any odd base."""
    one = "".join("ab"[bin(i).count("1") % 2] for i in range(1024))
    return one, one.translate(str.maketrans("ab", "ba"))


def test_words_that_polynomial_hashes_confuse_stay_apart(spark):
    one, two = twins()
    near = [f"w{i}" for i in range(25)]
    rows = [(1, " ".join([*near, one, *near])), (2, " ".join([*near, two, *near])), (3, " ".join([*near, two, *near]))]
    # Sequences of two words in the same order, too.
    order = [["x", "y"][bin(i).count("1") % 2] for i in range(64)]
    rows += [(4, " ".join(order)), (5, " ".join({"x": "y", "y": "x"}[w] for w in order))]
    assert found(spark, rows) == brute(rows)


def test_a_text_larger_than_a_slice(spark):
    rng = random.Random(4)
    long = " ".join(f"{rng.choice('abc')}{rng.randint(0, 99999)}" for _ in range(200_000))
    rows = [(1, long), (2, "own words here " + long[:3000]), (3, long)]
    assert found(spark, rows) == brute(rows)
