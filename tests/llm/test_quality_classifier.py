import math
import random

from pyspark.sql import functions as F

from helixbag.llm import quality_classifier as C


def corpus():
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(3, 8))) for _ in range(400)]
    rows = []
    for i in range(600):
        good = i % 4 != 0
        text = " ".join(rng.choice(words) + ("" if good else rng.choice(["###", "%%%"])) for _ in range(rng.randint(30, 80)))
        if i % 8 == 1:
            good, text = False, text + " nasty"
        rows.append((i, text, f"h{i % 3}" if i % 50 else None, "p" if i % 2 else None, int(good)))
    return rows


def bad():
    return F.col("good") == 0


def table(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, good int")


def test_held_out_accuracy_and_posteriors(spark):
    rows = corpus()
    docs = table(spark, rows).drop("good").withColumn("kept", F.lit(7))
    labels = table(spark, rows[:300]).select("doc_id", "good")
    got = {r.doc_id: r for r in C.classify(docs, labels, bad()).collect()}
    assert len(got) == 600
    assert sum(got[r[0]].kept == bool(r[4]) for r in rows[300:]) >= 0.9 * 300

    def logit(p):
        p = min(max(p, 1e-6), 1 - 1e-6)
        return math.log(p / (1 - p))

    for r in got.values():
        odds = logit(r.evidence) + logit(r.site_mean) - logit(r.global_mean)
        assert abs(r.quality - 1 / (1 + math.exp(-odds))) < 1e-9
    means = {}
    for r in got.values():
        means.setdefault((r.source, r.lang), []).append(r.evidence)
    for r in got.values():
        own = sum(means[r.source, r.lang]) / len(means[r.source, r.lang])
        assert min(own, r.host_mean) - 1e-9 <= r.site_mean <= max(own, r.host_mean) + 1e-9
        assert r.site_docs == len(means[r.source, r.lang])


def test_sparse_sites_shrink_more(spark):
    rows = [("big", "x", 0.2)] * 200 + [("small", "x", 0.2)] * 2 + [("other", "x", 0.9)] * 200
    found = {r._host: r for r in C.sites(spark.createDataFrame(rows, "source string, lang string, evidence double"), "source", "lang").collect()}
    assert found["big"].site_mean < found["small"].site_mean < found["other"].site_mean


def test_odd_tables(spark):
    docs = table(spark, [(None, None, None, None, 1), (1, "a b", "h", "p", 1), (1, "a b", "h", "p", 1)]).drop("good")
    labels = spark.createDataFrame([(1, None), (None, 0), (9, 1)], "doc_id long, good int")
    got = C.classify(docs, labels, bad()).collect()
    assert len(got) == 3 and all(r.kept and r.evidence == 0.5 for r in got)
    assert C.classify(docs.limit(0), labels, bad()).count() == 0
