"""Vectorizers as pipeline stages against the plain operators."""

import random

import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.sql import functions as F

from helixbag.operators import features as X
from helixbag.operators import stages as S
from helixbag.operators.bpe import BpeModel
from helixbag.operators.resync import subword_counter

PAIRS = [a + b for a in "ACGT" for b in "ACGT"]
MERGES = (*[(p[0], p[1]) for p in PAIRS], *[(p, q) for p in PAIRS for q in PAIRS])
MODEL = BpeModel(("X", "A", "C", "G", "T", *[a + b for a, b in MERGES]), MERGES)


def pieces(spark, seed=1, n=24):
    rng = random.Random(seed)
    rows = [(i, i % 2, f"site {i % 3}", "".join(rng.choices("ACGT", (6, 1, 1, 6) if i % 2 else (1, 6, 6, 1), k=60)))
            for i in range(n) for _ in range(1 + i % 3)]
    return spark.createDataFrame(rows, "genome long, label int, site string, seq string")


def vectors(df, key="genome"):
    return {r[key]: r["features"] for r in df.select(key, "features").collect()}


@pytest.mark.parametrize("stage,counter", [
    (lambda: S.KmerVectorizer(kMin=3, kMax=4), lambda spark: X.KmerCounter(3, 4)),
    (lambda: S.SubwordVectorizer.of(MODEL), lambda spark: subword_counter(MODEL, spark))])
def test_vectors_equal_the_plain_operators(spark, stage, counter):
    data = pieces(spark)
    fitted = X.TfidfVectorizer(counter(spark)).fit(data, data.select("genome").distinct())
    want = vectors(X.assemble_features(fitted.transform(data), fitted.size))
    got = stage().fit(data).transform(data)
    assert got.columns == ["genome", "label", "site", "features"]
    found = vectors(got)
    assert {k: found[k] for k in want} == want and len(found) == 24 and len(want) > 20
    assert all(found[k].numNonzeros() == 0 for k in set(found) - set(want))


def test_a_pipeline_fits_saves_loads_and_scores_alike(spark, tmp_path):
    data = pieces(spark)
    for stage in (S.KmerVectorizer(kMin=3, kMax=3, minDf=2.0), S.SubwordVectorizer.of(MODEL)):
        boosted = X.classifier_stages(spark, max_bin=8, max_depth=2, n_estimators=2)
        model = Pipeline(stages=[stage, *boosted]).fit(data)
        path = str(tmp_path / stage.uid)
        model.write().save(path)
        again = PipelineModel.load(path)
        new = pieces(spark, seed=2)
        before, after = ({r.genome: (r.label, r.prediction, r.probability) for r in X.predict_proba(m, new).withColumnRenamed(
            "target", "label").collect()} for m in (model, again))
        assert before == after and len(before) == 24
        assert sum(label == hard for label, hard, _ in after.values()) >= 22
        assert again.stages[0].vocabulary.count() == model.stages[0].size == again.stages[0].size
        assert again.stages[0].uid == model.stages[0].uid


def test_an_unfitted_pipeline_is_saved_with_its_parameters(spark, tmp_path):
    stage = S.KmerVectorizer(kMin=4, kMax=5, keyCol="id", outputCol="v")
    stage.write().save(str(tmp_path / "plain"))
    again = S.KmerVectorizer.load(str(tmp_path / "plain"))
    assert {p.name: again.getOrDefault(p) for p in again.params} == {p.name: stage.getOrDefault(p) for p in stage.params}


def test_empty_null_and_clashing_input(spark):
    data = pieces(spark, n=4).union(spark.createDataFrame([(9, 1, "x", None), (8, 0, "x", ""), (None, 0, "x", "ACGACG")],
                                                           "genome long, label int, site string, seq string"))
    model = S.KmerVectorizer(kMin=3, kMax=3).fit(data)
    got = vectors(model.transform(data))
    assert set(got) == {0, 1, 2, 3, 8, 9, None} and got[8].numNonzeros() == got[9].numNonzeros() == 0 < got[None].numNonzeros()
    assert model.transform(data.limit(0)).count() == 0
    with pytest.raises(ValueError):
        model.transform(data.withColumn("features", F.lit(1)))
    moved = data.withColumnsRenamed({"genome": "id", "seq": "features"})
    renamed = S.KmerVectorizer(kMin=3, kMax=3, keyCol="id", textCol="features").fit(moved)
    assert vectors(renamed.transform(moved), "id") == got
