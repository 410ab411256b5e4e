import random
import re
from collections import Counter

import pytest

from helixbag.llm import collocations

SCHEMA = "doc_id long, text string, lang string, rank string"
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, threshold=10, longest=3, share=50, top=2000):
    f, n = Counter(), Counter()
    for _, text, lang, *_ in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(UPPER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for size in range(1, longest + 1):
                for i in range(len(words) - size + 1):
                    f[lang, tuple(words[i : i + size])] += 1
    cands = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= threshold}
    out = []
    for lang in {k[0] for k in cands}:
        kept = []
        for (own, phrase), a in cands.items():
            if own != lang:
                continue
            size = len(phrase)
            if any(o == lang and len(p) > size and 100 * b >= share * a
                   and any(p[i : i + size] == phrase for i in range(len(p) - size + 1)) for (o, p), b in cands.items()):
                continue
            score, k = min((1000000 * a * a // (f[lang, phrase[:k]] * f[lang, phrase[k:]]), k) for k in range(1, size))
            kept.append((-score, -a, " ".join(phrase).encode(), f[lang, phrase[:k]], f[lang, phrase[k:]]))
        for rank, (score, a, phrase, l, r) in enumerate(sorted(kept)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, l, r, n[lang], -score))
    return sorted(out)


def run(spark, rows, **options):
    return sorted(map(tuple, collocations.mine(spark.createDataFrame(rows, SCHEMA), **options).collect()))


def drawn(seed, docs=60):
    rng = random.Random(seed)
    words = ["new", "york", "New", "city", "of", "the", "Éa", "x", "machine", "learning", "la", "中文", "a\x00b"]
    ends = [" ", " ", " ", "  ", "\t", ". ", ", ", "\n", "\x0b", "\x0d", ";", "!?"]
    rows = []
    for i in range(docs):
        text = "".join(rng.choice(words[: rng.choice([4, 8, 13])]) + rng.choice(ends) for _ in range(rng.randint(0, 120)))
        rows.append((rng.choice([None, i, 1]), text, rng.choice(["en", "en", "fr", None]), "extra"))
    return rows


@pytest.mark.parametrize("shards", [1, 3])
def test_equals_counting_everything(spark, shards):
    rows = drawn(1, 150) + [(5, None, "en", ""), (6, "", None, ""), (7, " \t .,", "xx", "")]
    rows += rows[:3]
    want = brute(rows)
    assert len(want) > 50
    assert run(spark, rows, shards=shards) == want


def test_longer_phrases_thresholds_and_tops(spark):
    rows = drawn(2, 40)
    assert run(spark, rows, threshold=4, longest=4, share=80, top=25) == brute(rows, 4, 4, 80, 25)


def test_hot_phrase_and_long_text(spark):
    rows = [(i, "the same old line. The same old line", "en", "") for i in range(300)]
    rows += [(1000, "word after word " * 30_000, "en", ""), (1001, "und so weiter, und so fort " * 9, "de", "")]
    assert run(spark, rows) == brute(rows)


def test_bitmaps_with_too_many_bits_change_nothing(spark, monkeypatch):
    monkeypatch.setattr(collocations, "LEAST_BITS", 64)
    monkeypatch.setattr(collocations, "MOST_BITS", 64)
    rows = drawn(3, 30)
    assert run(spark, rows) == brute(rows)


def test_products_beyond_64_bits(spark):
    a, b, c = 3 * 10**12, 4 * 10**12 + 7, 5 * 10**12 + 1
    counts = spark.createDataFrame(
        [("en", 0, "", 10**13), ("en", 1, "x", b), ("en", 1, "y", c), ("en", 2, "x y", a)], "lang string, length int, phrase string, n long")
    got = collocations.scored(counts, 10, 50, 3).collect()
    assert [tuple(r) for r in got] == [("en", "x y", a, b, c, 10**13, 1000000 * a * a // (b * c))]


def test_late_phrases_complete_their_cycle(spark):
    # Words that only come together reach the threshold late, and their phrases are counted in every shard all the same.
    rows = [(i, f"rare{i % 7} pair of words{i % 7}", "en", "") for i in range(80)]
    assert run(spark, rows, shards=5) == brute(rows)


def test_empty_table(spark):
    assert run(spark, []) == []
    with pytest.raises(ValueError):
        run(spark, [], longest=1)


def test_a_worker_adds_up_its_batches(spark):
    docs = spark.createDataFrame([("one two one three", "en")] * 6, "text string, lang string").coalesce(1)
    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    past = spark.conf.get(setting)
    spark.conf.set(setting, "2")
    try:
        rows = collocations._visit(docs, 0, [{}], 2, 3).where("n > 0").collect()
    finally:
        spark.conf.set(setting, past)
    assert sorted(r["n"] for r in rows) == [6, 6, 12] and {r["length"] for r in rows} == {1}
