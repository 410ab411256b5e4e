import math
import re

from pyspark.sql import functions as F

from helixbag.llm import license_scan as L

PROSE = "The river bent around the old mill and nobody spoke of it again. "


def table(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, path string, text string").withColumn("license", F.lit(1))


def brute(texts, threshold=L.THRESHOLD):
    """License and score of each text by scoring every passage against every template."""
    df = {}
    for t in texts:
        for w in set(L._python_terms(t or "")):
            df[w] = df.get(w, 0) + 1
    vocabulary = {w for _, b in L.TEMPLATES for w in L._python_terms(b)}
    idf = {w: math.log((1 + len(texts)) / (1 + df.get(w, 0))) + 1 for w in vocabulary | df.keys()}
    out = []
    for t in texts:
        best = []
        for p in (t or "").split("\n") + re.sub(r"([.!?])[ \t\r]+", r"\1\n", t or "").split("\n"):
            own = L._python_terms(p)
            norm = math.sqrt(sum(idf[w] ** 2 for w in own))
            for name, body in L.TEMPLATES:
                held = L._python_terms(body)
                dot = sum(idf[w] ** 2 for w in held if w in own) / math.sqrt(sum(idf[w] ** 2 for w in held))
                if own and round(dot / norm, 6) >= threshold:
                    best.append((-round(dot / norm, 6), name))
        out.append((min(best)[1], -min(best)[0]) if best else (None, None))
    return out


def test_scores_equal_brute_force(spark):
    texts = [PROSE * 3 + f"\n{body}" for _, body in L.TEMPLATES] + [body for _, body in L.TEMPLATES]
    texts += [PROSE * 9, None, "", "licensed", "Licensed under the Apache License.", "Licensed under CC BY 4.0!\tSo. Really the MIT License"]
    rows = [(i, None, t) for i, t in enumerate(texts)]
    got = {r.doc_id: (r.license, r.license_score) for r in L.scan(table(spark, rows)).collect()}
    want = brute(texts)
    for i, (name, score) in enumerate(want):
        assert got[i][0] == name and (score is None or abs(got[i][1] - score) < 2e-6), (texts[i], got[i], want[i])
    for i in range(2 * len(L.TEMPLATES)):
        assert got[i] == (L.TEMPLATES[i % len(L.TEMPLATES)][0], 1.0)


def test_the_nearest_directory_hands_down(spark):
    rows = [(1, "a/LICENSE", PROSE * 20 + "\nReleased under the MIT License."), (2, "a/b/COPYING", "Licensed under the Apache License, Version 2.0."),
            (3, "a/x.txt", PROSE), (4, "a/b/c/y.txt", PROSE), (5, "ab/z.txt", PROSE), (6, "top.txt", PROSE), (7, None, PROSE),
            (8, "a/b/own.txt", PROSE * 20 + "\nLicensed under CC BY-NC 4.0."), (8, "a/b/own.txt", PROSE * 20 + "\nLicensed under CC BY-NC 4.0.")]
    got = {r.doc_id: (r.license, r.license_from) for r in L.scan(table(spark, rows)).collect()}
    assert got == {1: ("MIT", "file"), 2: ("Apache-2.0", "file"), 3: ("MIT", "a"), 4: ("Apache-2.0", "a/b"), 5: (None, None),
                   6: (None, None), 7: (None, None), 8: ("CC-BY-NC-4.0", "text")}
    assert L.scan(table(spark, rows)).count() == 9


def test_triggers_cannot_be_missed():
    idf = {w: 1 + len(w) % 5 for _, b in L.TEMPLATES for w in L._python_terms(b)}
    needed = set(L.triggers(idf, L.TEMPLATES, L.THRESHOLD))
    for _, body in L.TEMPLATES:
        own = L._python_terms(body)
        norm = sum(idf[w] ** 2 for w in own)
        assert math.sqrt(sum(idf[w] ** 2 for w in own if w not in needed) / norm) < L.THRESHOLD


def test_empty(spark):
    assert L.scan(table(spark, [])).count() == 0


def test_ordinary_words_weigh_by_their_frequency_at_every_size(spark):
    """Words outside the templates that many documents have do not hide a license, however large the corpus."""
    found = ["The project code here is licensed under the Apache License, Version 2.0.", "All of this project code is released under the MIT License."]
    for n in (100, 2_000):
        rows = [(i, None, found[i % 40] if i % 40 < 2 else f"All of this project code here is prose about mill {i % 9}.") for i in range(n)]
        got = {r.doc_id: (r.license, r.license_score) for r in L.scan(table(spark, rows)).collect()}
        df = {}
        for _, _, t in rows:
            for w in L._python_terms(t):
                df[w] = df.get(w, 0) + 1
        weight = lambda w: (math.log((1 + n) / (1 + df.get(w, 0))) + 1) ** 2
        for i, name in ((0, "Apache-2.0"), (1, "MIT")):
            own, body = set(L._python_terms(found[i])), L._python_terms(dict((a, b) for a, b in reversed(L.TEMPLATES))[name])
            score = sum(weight(w) for w in body if w in own) / math.sqrt(sum(map(weight, own)) * sum(map(weight, body)))
            assert got[i][0] == name and abs(got[i][1] - score) < 2e-6
        assert sum(name is not None for name, _ in got.values()) == 2 * -(-n // 40)
