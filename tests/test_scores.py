"""Metrics, trial tables and statistics against brute force and known values."""

import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from helixbag.operators import metrics as M
from helixbag.operators import stats as S
from helixbag.operators import trials as R


def brute_auc(rows):
    pos, neg = [p for t, p in rows if t], [p for t, p in rows if not t]
    return sum((a > b) + (a == b) / 2 for a in pos for b in neg) / (len(pos) * len(neg))


def test_auc_with_ties_groups_and_crowded_scores(spark):
    rng = random.Random(0)
    rows = [(g, rng.randint(0, 1), rng.choice([round(rng.random(), 1), 1 - rng.random() * 1e-12])) for g in "abc" for _ in range(120)]
    df = spark.createDataFrame(rows, "g string, target int, probability double")
    got = {r["g"]: r["roc_auc"] for r in M.roc_auc(df, ["g"]).collect()}
    for g in "abc":
        assert got[g] == pytest.approx(brute_auc([(t, p) for a, t, p in rows if a == g]))
    assert M.roc_auc(df).first()[0] == pytest.approx(brute_auc([(t, p) for _, t, p in rows]))
    assert M.roc_auc(df.where("target = 1")).first()[0] is None


def test_half_rounds_to_the_negative_class(spark):
    df = spark.createDataFrame([(1, 0.5), (0, 0.5), (1, 0.51), (0, 0.49), (1, 1.0)], "target int, probability double")
    assert tuple(M.confusion_counts(df).first()) == (2, 0, 2, 1)
    assert M.accuracy(df).first()[0] == pytest.approx(0.8)
    assert M.mcc(df).first()[0] == pytest.approx((2 * 2 - 0) / math.sqrt(2 * 3 * 2 * 3))
    f1 = (2 * 2 / 5 * 3 + 2 * 2 / 5 * 2) / 5
    assert M.f1_weighted(df).first()[0] == pytest.approx(f1)
    assert M.mcc(df.where("target = 1")).first()[0] == 0.0


def test_report_has_one_row_of_nine_columns(spark):
    rows = [(p, t, s) for p in ("training", "validation", "test") for t, s in ((1, 0.9), (0, 0.1), (1, 0.4), (0, 0.2))]
    row = M.metrics_report(spark.createDataFrame(rows, "partition string, target int, probability double")).first()
    assert row["test_accuracy"] == 0.75 and row["val_roc_auc"] == 1.0 and len(row) == 9


def brute_wilcoxon(d):
    a = [x for x in d if x]
    order = sorted(abs(x) for x in a)
    rank = {v: sum(i + 1 for i, w in enumerate(order) if w == v) / order.count(v) for v in order}
    return sum(rank[abs(x)] for x in a if x > 0), sum(rank[abs(x)] for x in a if x < 0)


def test_signed_ranks_with_zero_and_ties(spark):
    d = [3, -1, 1, 0, 5, -4]
    pairs = spark.createDataFrame([(float(x), 0.0) for x in d], "x double, y double")
    row = S.wilcoxon_signed_rank(pairs).first()
    assert (row["r_plus"], row["r_minus"]) == brute_wilcoxon(d) and row["n"] == 5 and row["w"] == 5.5
    # Zeros and ties rule out the exact form: z = (5.5 - 7.5) / sqrt((5 * 6 * 11 - 6 / 2) / 24)
    z = -2 / math.sqrt((330 - 3) / 24)
    assert row["p_value"] == pytest.approx(math.erfc(abs(z) / math.sqrt(2)))


def test_exact_p_values(spark):
    pairs = spark.createDataFrame([(float(i + 1), 0.0) for i in range(32)], "x double, y double")
    assert S.wilcoxon_signed_rank(pairs).first()["p_value"] == pytest.approx(2 / 2 ** 32)
    d = [1, -2, 3, 4, -5, 6, 7]
    w = min(brute_wilcoxon(d))
    hits = sum(sum(r for r, s in zip(range(1, 8), signs) if s) <= w for signs in itertools.product((0, 1), repeat=7))
    pairs = spark.createDataFrame([(float(x), 0.0) for x in d], "x double, y double")
    assert S.wilcoxon_signed_rank(pairs).first()["p_value"] == pytest.approx(min(1, 2 * hits / 2 ** 7))


def test_nothing_left_to_rank(spark):
    pairs = spark.createDataFrame([(1.0, 1.0)], "x double, y double")
    row = S.wilcoxon_signed_rank(pairs).first()
    assert row["n"] == 0 and row["p_value"] is None


def test_fisher(spark):
    names = lambda r: spark.createDataFrame([(f"g{i}",) for i in r], "locus string")
    row = S.fisher_overlap(names(range(8)), names(range(5, 12)), names(range(20)), "locus").first()
    assert tuple(row)[:4] == (3, 5, 4, 8)
    p = lambda x: math.comb(7, x) * math.comb(13, 8 - x) / math.comb(20, 8)
    assert row["p_value"] == pytest.approx(sum(p(x) for x in range(8) if p(x) <= p(3) * (1 + 1e-9)))
    over = S.set_overlap(names(range(8)), names(range(5, 12)), "locus").first()
    assert tuple(over) == (8, 7, 3, "g5, g6, g7")


def test_refit_rules(spark):
    rows = [("t", 0, 0.85, 0.7), ("t", 1, 0.95, 0.7), ("t", 2, 0.95, 0.6), ("u", 0, 0.75, 0.5), ("u", 1, 0.65, 0.9)]
    cv = spark.createDataFrame(rows, "task string, trial long, mean_train_accuracy double, mean_test_accuracy double")
    ranked = R.rank_trials(cv, ["mean_test_accuracy"], ["task"])
    assert {r["task"]: r["trial"] for r in R.refit_best(ranked, by=["task"]).collect()} == {"t": 0, "u": 1}
    got = {r["task"]: (r["trial"], r["rank_sum"]) for r in R.refit_rank_sum(ranked, ["rank_test_accuracy"], ["task"]).collect()}
    assert got == {"t": (1, 1), "u": (0, 2)}


def test_tidy_cv(spark):
    cv = spark.createDataFrame([(0.12345, 1.0, 2.0, "{}", 7)],
                               "mean_test_accuracy double, std_fit double, split0_x double, params string, param_classifier__max_bin long")
    assert R.tidy_cv(cv, rename=True).first().asDict() == {"val_accuracy": 0.123, "param_classifier__max_bin": 7}
    assert R.hyperparameters(cv).columns == ["param_classifier__max_bin"]
    assert R.tidy_cv(spark.createDataFrame([(0.0625,)], "mean_x double")).select(F.col("mean_x")).first()[0] == 0.062
