"""Rank tests and overlap tests."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import DoubleType

from helixbag.functions.ranks import running_sums

EXACT_LIMIT = 50


def signed_rank_sums(pairs: DataFrame, left: str = "x", right: str = "y") -> DataFrame:
    """One row (n, r_plus, r_minus, tie_term, ties) of the signed-rank statistic; zero differences drop out.

    Differences are counted per absolute value first, so only distinct values are ranked.
    """
    d = pairs.select((F.col(left) - F.col(right)).alias("d")).where((F.col("d") != 0) & ~F.isnan("d"))
    sizes = d.groupBy(F.abs("d").alias("a")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("d") > 0).alias("n_pos")
    )
    ranked = running_sums(sizes, "a", {"before": "n"})
    rank = F.col("before").cast("double") + (F.col("n").cast("double") + 1) / 2
    t = F.col("n").cast("double")
    return ranked.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n"),
        F.coalesce(F.sum(rank * F.col("n_pos")), F.lit(0.0)).alias("r_plus"),
        F.coalesce(F.sum(rank * (F.col("n") - F.col("n_pos"))), F.lit(0.0)).alias("r_minus"),
        F.coalesce(F.sum(t * t * t - t), F.lit(0.0)).alias("tie_term"),
        F.count_if(F.col("n") > 1).alias("ties"),
    )


def wilcoxon_z(sums: DataFrame, correction: bool = True) -> DataFrame:
    """Adds the statistic W = min(R+, R-) and its normal score."""
    n = F.col("n").cast("double")
    mean = n * (n + 1) / 4
    spread = F.sqrt((n * (n + 1) * (2 * n + 1) - F.col("tie_term") / 2) / 24)
    w = F.least("r_plus", "r_minus")
    shift = F.signum(w - mean) * 0.5 if correction else F.lit(0.0)
    return sums.withColumn("w", w).withColumn("z", F.when(spread > 0, (w - mean - shift) / spread))


@F.pandas_udf(DoubleType())
def _wilcoxon_p(n: pd.Series, w: pd.Series, z: pd.Series, exact: pd.Series) -> pd.Series:
    def two_sided(size, stat, score, use_exact):
        if size == 0:
            return None
        if not use_exact:
            return math.erfc(abs(score) / math.sqrt(2)) if score is not None else None
        ways = [1] + [0] * (size * (size + 1) // 2)
        for rank in range(1, size + 1):
            for total in range(len(ways) - 1, rank - 1, -1):
                ways[total] += ways[total - rank]
        return min(1.0, 2 * sum(ways[: int(stat) + 1]) / 2 ** size)

    return pd.Series([two_sided(int(a), b, c, bool(e)) for a, b, c, e in zip(n, w, z, exact)], dtype="float64")


def wilcoxon_signed_rank(pairs: DataFrame, left: str = "x", right: str = "y", method: str = "auto",
                         correction: bool = False) -> DataFrame:
    """Two-sided signed-rank test as one row.

    method="auto" is exact for at most 50 pairs without zero differences or ties and normal otherwise;
    "approx" is always normal.
    """
    # The sums drop zero differences; their number decides between the exact and the normal form.
    zeros = pairs.agg(F.count_if(F.col(left) == F.col(right))).scalar()
    scored = wilcoxon_z(signed_rank_sums(pairs, left, right), correction).withColumn("zeros", zeros)
    exact = F.lit(method == "auto") & (F.col("n") <= EXACT_LIMIT) & (F.col("ties") == 0) & (F.col("zeros") == 0)
    # One row: the tail probability is the only step in Python.
    return scored.withColumn("p_value", _wilcoxon_p("n", "w", F.coalesce("z", F.lit(0.0)), exact))


def set_overlap(left: DataFrame, right: DataFrame, col: str) -> DataFrame:
    """Sizes of two sets, of their intersection, and the sorted list of shared members.

    Sets here are gene lists, so the list of shared members stays short.
    """
    a, b = left.select(col).distinct(), right.select(col).distinct()
    shared = a.intersect(b)
    return shared.agg(
        a.agg(F.count(F.lit(1))).scalar().alias("size_left"), b.agg(F.count(F.lit(1))).scalar().alias("size_right"),
        F.count(F.lit(1)).alias("size_shared"),
        F.array_join(F.array_sort(F.collect_list(col)), ", ").alias("shared"),
    )


@F.pandas_udf(DoubleType())
def _fisher_p(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.Series:
    def log_choose(n, k):
        return math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)

    def two_sided(a, b, c, d):
        rows, cols, total = a + b, a + c, a + b + c + d

        def log_p(x):
            return log_choose(cols, x) + log_choose(total - cols, rows - x) - log_choose(total, rows)

        limit = log_p(a) + 1e-7
        tables = (log_p(x) for x in range(max(0, rows + cols - total), min(rows, cols) + 1))
        return min(1.0, sum(math.exp(p) for p in tables if p <= limit))

    return pd.Series([two_sided(*map(int, t)) for t in zip(a, b, c, d)], dtype="float64")


def fisher_overlap(left: DataFrame, right: DataFrame, universe: DataFrame, col: str) -> DataFrame:
    """Contingency table of two gene sets within a universe and the two-sided exact p-value, as one row."""
    sizes = set_overlap(left, right, col).withColumn("total", universe.agg(F.count_distinct(col)).scalar())
    table = sizes.select(
        F.col("size_shared").alias("a"), (F.col("size_left") - F.col("size_shared")).alias("b"),
        (F.col("size_right") - F.col("size_shared")).alias("c"),
        (F.col("total") - F.col("size_left") - F.col("size_right") + F.col("size_shared")).alias("d"),
    )
    return table.withColumn("p_value", _fisher_p("a", "b", "c", "d"))
