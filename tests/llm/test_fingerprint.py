import hashlib
import random
import re

from pyspark.sql import functions as F

from helixbag.llm import fingerprint as P


def units(text):
    return set(re.findall(r"[^\n.!?]{1,160}[.!?\n]*|[.!?\n]+", text))


def alike(a, b):
    x, y = units(a), units(b)
    return 1.0 if not x and not y else 2 * len(x & y) / (len(x) + len(y))


def brute(rows):
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1] or ""))
    out = []
    for k, (i, t) in enumerate(order):
        t, after = t or "", order[(k + 1) % len(order)][1] or ""
        cut = len(t) // 3
        edited = t[: len(t) - cut] + after[:cut]
        out.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), round(alike(t, edited), 9), round(alike(t, after), 9)))
    return sorted(out, key=str)


def found(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_chars", F.lit("x"))
    got = P.compare(docs).collect()
    return got, sorted(((r.doc_id, r.n_chars, r.edited_sha256, round(r.near_edited, 9), round(r.near_next, 9)) for r in got), key=str)


def corpus():
    rng = random.Random(2)
    sentence = lambda: " ".join(rng.choice("aéioux😀") * rng.randint(1, 9) for _ in range(rng.randint(1, 12))) + rng.choice(".!?\n")
    texts = ["".join(sentence() for _ in range(rng.choice([0, 1, 2, 5, 9, 30, 120]))) for _ in range(90)]
    texts += [texts[3], texts[5] + "More.", "x" * 5000, "no end", "...", None, "", "".join(sentence() for _ in range(1500))]
    return [(i * 3 - 40, t) for i, t in enumerate(texts)]


def test_equals_brute_force_in_one_and_many_ranges(spark, monkeypatch):
    rows = corpus()
    got, seen = found(spark, rows)
    assert seen == brute(rows)
    prints = {r.doc_id: r.fingerprint for r in got}
    assert prints[3 * 3 - 40] == prints[90 * 3 - 40]
    assert len(set(prints.values())) == len({frozenset(units(t or "")) for _, t in rows})
    monkeypatch.setattr(P, "RANGE", 7)
    assert found(spark, rows)[1] == brute(rows)


def test_null_and_repeated_ids_and_small_tables(spark, monkeypatch):
    monkeypatch.setattr(P, "RANGE", 2)
    rows = [(None, "z. y."), (4, "a. b."), (4, "a. b."), (4, "c."), (7, "d. e. f."), (None, None), (9, "q."), (1, "r. s.")]
    assert found(spark, rows)[1] == brute(rows)
    assert found(spark, [(None, "b. c. d."), (None, "a.")])[1] == brute([(None, "b. c. d."), (None, "a.")])
    assert found(spark, [(3, "only one. here.")])[1] == brute([(3, "only one. here.")])
    assert found(spark, [])[1] == []


def test_peeling_recovers_the_digests(spark):
    left, right = list(range(100, 130)), list(range(105, 131))
    rows = spark.createDataFrame([(left, right)], "l array<long>, r array<long>").select(
        *[F.transform(c, lambda v: F.xxhash64(v)).alias(c) for c in ("l", "r")])
    rows = rows.withColumns({"lt": F.expr(P.table_of("l")), "rt": F.expr(P.table_of("r"))})
    row = rows.select("l", "r", F.expr(P.differing("l", "r", "lt", "rt")).alias("d")).first()
    assert {x.k: x.n for x in row.d} == {k: 1 for k in set(row.l) - set(row.r)} | {k: -1 for k in set(row.r) - set(row.l)}
