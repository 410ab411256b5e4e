"""Skew-safe ranks and running sums against brute force, with one group holding most rows."""

import hashlib
import random

from pyspark.sql import functions as F

from helixbag.functions import ranks as R


def test_draw_key_and_draw_int(spark):
    row = spark.createDataFrame([(7, "c1")], "a int, b string")
    key, draw = row.select(R.draw_key("a", "b", seed=3), R.draw_int(F.lit("7-c1-3"), F.lit(1000))).first()
    digest = hashlib.md5(b"7-c1-3").hexdigest()
    assert key == digest and draw == int(digest[:8], 16) % 1000


def test_hash_rank_with_a_hot_group(spark):
    rows = [(0 if i % 10 else i % 3, i) for i in range(3000)]
    df = spark.createDataFrame(rows, "g int, i int").withColumn("k", R.draw_key("i", seed=0))
    for digits in (1, 3):
        got = {(r["g"], r["i"]): r["hash_rank"] for r in R.hash_rank(df, ["g"], "k", digits=digits).collect()}
        for g in {g for g, _ in rows}:
            ordered = sorted((hashlib.md5(f"{i}-0".encode()).hexdigest(), i) for a, i in rows if a == g)
            assert [got[g, i] for _, i in ordered] == list(range(len(ordered)))


def test_take_by_hash(spark):
    df = spark.range(2000).withColumn("k", R.draw_key("id", seed=1))
    want = {i for _, i in sorted((hashlib.md5(f"{i}-1".encode()).hexdigest(), i) for i in range(2000))[:137]}
    for digits in (1, 4):
        assert {r["id"] for r in R.take_by_hash(df, 137, "k", digits).collect()} == want
    assert R.take_by_hash(df, 5000, "k").count() == 2000


def test_running_sums_both_directions_and_groups(spark):
    rng = random.Random(0)
    # A third of the values crowd next to 1.
    values = {(g, rng.random() if rng.random() > 0.3 else 1 - rng.random() * 1e-9) for g in "ab" for _ in range(700)}
    rows = [(g, v, rng.randint(0, 5)) for g, v in values]
    df = spark.createDataFrame(rows, "g string, v double, n int")
    for down in (False, True):
        got = {(r["g"], r["v"]): r["s"] for r in R.running_sums(df, "v", {"s": "n"}, ["g"], down, buckets=20).collect()}
        for g in "ab":
            total = 0
            for v, n in sorted(((v, n) for a, v, n in rows if a == g), reverse=down):
                assert got[g, v] == total
                total += n


def test_alphabetical_index_agrees_in_both_forms(spark):
    words = ["A", "AA", "AAB", "B", "ACGTA", "ACGT", "ACGTAC", "T", "TTTTT", "TTTT"]
    df = spark.createDataFrame([(w,) for w in words], "w string")
    want = {w: i for i, w in enumerate(sorted(words))}
    for bound in (None, 10):
        assert {r["w"]: r["idx"] for r in R.alphabetical_index(df, "w", bound=bound).collect()} == want


def test_scratch_tables_can_be_deleted(spark):
    from pathlib import Path

    from helixbag.session import clear_scratch, discard, materialize

    one, two = materialize(spark.range(3), "one"), materialize(spark.range(4), "two")
    folder = Path(one._scratch.removeprefix("file:"))
    assert folder.exists() and two.count() == 4
    discard(one)
    assert not folder.exists() and two.count() == 4
    clear_scratch(spark)
    assert not Path(two._scratch.removeprefix("file:")).exists()
