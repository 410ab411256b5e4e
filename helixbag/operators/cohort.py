"""Cohort filters, labels, assembly quality, class balance and stratified splits."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window, functions as F

from helixbag.functions.ranks import draw_key, hash_rank, running_sums
from helixbag.functions.sequence import file_stem
from helixbag.session import checked_broadcast

# The phenotypes of the disease task and its negative class.
PHENOTYPES = [
    "carrier",
    "invasive (unspecified/other)",
    "meningitis",
    "septicaemia",
    "meningitis and septicaemia",
]
CARRIER = "carrier"
SPECIES = "Neisseria meningitidis"
PARTITIONS = ("training", "validation", "test")
# Steps of the quality feature that clusters tell apart, and most rounds of moving centres.
GRID, CLUSTER_ROUNDS = 1_000_000_000, 50


def filter_cohort(genomes: DataFrame, species: str = SPECIES, complete: int = 0,
                  task: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Genomes of one species and completeness, then an optional task function such as ``label_disease``."""
    kept = genomes.where((F.col("species") == species) & (F.col("complete") == complete))
    return task(kept) if task else kept


def label_disease(genomes: DataFrame) -> DataFrame:
    return genomes.where(F.col("disease").isin(PHENOTYPES)).select(
        "path", F.when(F.col("disease") == CARRIER, 0).otherwise(1).alias("label")
    )


def label_capsule(genomes: DataFrame, drop_null_group: bool = False) -> DataFrame:
    """Group B against the rest. A null group counts as the rest unless ``drop_null_group`` is set."""
    group = F.col("capsule_group")
    kept = genomes.where(~group.eqNullSafe("discrepancy"))
    if drop_null_group:
        kept = kept.where(group.isNotNull())
    return kept.select("path", F.when(group == "B", 1).otherwise(0).alias("label"))


TASKS = {"capsule": label_capsule, "disease": label_disease}


def select_partition(dataset: DataFrame, partition: str | None = None) -> DataFrame:
    return dataset if partition is None else dataset.where(F.col("partition") == partition)


def genome_id_from_path(path: Column) -> Column:
    return file_stem(path)


def label_names(df: DataFrame, names: dict[int, str], label: str = "label", out: str = "label_name") -> DataFrame:
    """Display names of coded labels; codes without a name become null."""
    name = F.lit(None).cast("string")
    for code, text in names.items():
        name = F.when(F.col(label) == code, text).otherwise(name)
    return df.withColumn(out, name)


def fraction_covered(contigs: DataFrame, num: int = 10) -> DataFrame:
    """Share of each genome's bases that lie in its ``num`` longest contigs.

    Contigs are first counted per (genome, length), which combines before the shuffle, so a genome with very
    many contigs is ranked over its distinct lengths only. Genomes without bases drop out.
    """
    lengths = (
        contigs.groupBy("genome", F.length("seq").cast("bigint").alias("len"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    longer = Window.partitionBy("genome").orderBy(F.desc("len")).rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("n").over(longer), F.lit(0))
    taken = F.greatest(F.least(F.col("n"), F.lit(num) - F.col("before")), F.lit(0))
    return (
        lengths.withColumn("before", before)
        .groupBy("genome")
        .agg(F.sum(F.col("len") * taken).alias("top"), F.sum(F.col("len") * F.col("n")).alias("total"))
        .where(F.col("total") > 0)
        .select("genome", (F.col("top").cast("double") / F.col("total")).alias("fraction_covered"))
    )


def attach_quality(labelled: DataFrame, quality: DataFrame) -> DataFrame:
    """Inner join of labels and the quality feature on path; genomes without a value drop out."""
    return labelled.join(quality, "path")


def quality_histogram(df: DataFrame, bins: int = 20) -> DataFrame:
    """Rows per quality bin over [0, 1] and label; the value 1.0 belongs to the last bin."""
    slot = F.least(F.floor(F.col("fraction_covered") * bins), F.lit(bins - 1)).cast("bigint")
    return df.groupBy(slot.alias("bin"), "label").agg(F.count(F.lit(1)).alias("n"))


def cluster_quality(df: DataFrame, k: int = 512, rounds: int = CLUSTER_ROUNDS, col: str = "fraction_covered") -> DataFrame:
    """One-dimensional k-means of the quality feature; adds ``cluster``, numbered by value (null without a value).

    Values are whole numbers of a billionth, counted once each. Centres begin at even ranks of the distinct values and move to
    the mean of their range, rounded down, until they stay or ``rounds`` are over; a centre without values stays. A range ends
    halfway to the next centre. Sums are whole numbers, so every run gives the same clusters. Only centres, their sums and
    their counts come to the driver, ``k`` rows a round.
    """
    grid = F.round(F.col(col) * GRID).cast("bigint")
    counted = df.select(grid.alias("_value")).where("_value is not null").groupBy("_value").agg(F.count(F.lit(1)).alias("_n"))
    values = running_sums(counted.withColumn("_one", F.lit(1)), "_value", {"_rank": "_one"})
    size = counted.count()
    if not size:
        return df.withColumn("cluster", F.lit(None).cast("int"))
    first = {i * (size - 1) // (k - 1) for i in range(k)} if 1 < k < size else set(range(size)) if k > 1 else {0}
    centres = sorted(r[0] for r in values.where(F.col("_rank").isin(sorted(first))).select("_value").collect())

    def ranged(rows: DataFrame, value: str, centres: list[int]) -> DataFrame:
        # Bounds lie between whole numbers, which doubles hold exactly.
        ends = [(a + b) // 2 + 0.5 for a, b in zip(centres, centres[1:])]
        if not ends:
            return rows.withColumn("cluster", F.when(F.col(value).isNotNull(), 0))
        splits = [-float("inf"), *ends, float("inf")]
        found = Bucketizer(splits=splits, inputCol=value, outputCol="_cluster", handleInvalid="keep").transform(rows)
        return found.withColumn("cluster", F.when(F.col(value).isNotNull(), F.col("_cluster")).cast("int")).drop("_cluster")

    for _ in range(rounds):
        sums = ranged(values, "_value", centres).groupBy("cluster").agg(
            F.sum(F.col("_value").cast("decimal(20,0)") * F.col("_n")).alias("s"), F.sum("_n").alias("n")).collect()
        moved = list(centres)
        for row in sums:
            moved[row["cluster"]] = int(row["s"]) // row["n"]
        if moved == centres:
            break
        centres = moved
    return ranged(df.withColumn("_value", grid), "_value", centres).drop("_value")


def bin_quality(df: DataFrame, bins: int = 512) -> DataFrame:
    """Equal-width bins of the quality feature over [0, 1]: clusters that need no fitting."""
    slot = F.least(F.floor(F.col("fraction_covered") * bins), F.lit(bins - 1)).cast("bigint")
    return df.withColumn("cluster", slot)


def balance_quality(df: DataFrame, id_col: str = "path", seed: int = 0) -> DataFrame:
    """Sample the larger class of each cluster down to the size of the smaller one.

    A cluster that holds one class only vanishes. Cluster sizes are pre-aggregated, and rows are ranked by
    hash buckets, so one cluster may hold most of the table. The table of cluster sizes is broadcast if it is small.
    """
    sizes = df.groupBy("cluster").agg(
        F.least(F.count_if(F.col("label") == 0), F.count_if(F.col("label") == 1)).alias("_keep")
    )
    keyed = df.join(checked_broadcast(sizes.where("_keep > 0")), "cluster").withColumn("_key", draw_key(id_col, seed=seed))
    ranked = hash_rank(keyed, ["cluster", "label"], "_key", "_rank")
    return ranked.where(F.col("_rank") < F.col("_keep")).drop("_keep", "_key", "_rank")


def _allocation(counts: DataFrame, size: int, available: str, out: str) -> DataFrame:
    """Largest-remainder share of ``size`` per label, proportional to ``available``; ties by label ascending."""
    # One row per label, so the unpartitioned windows hold a handful of rows.
    every = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    exact = counts.withColumn("_exact", F.col(available) * F.lit(size).cast("double") / F.sum(available).over(every))
    floored = exact.withColumn(out, F.floor("_exact")).withColumn("_rest", F.col("_exact") - F.floor("_exact"))
    order = Window.orderBy(F.desc("_rest"), "label")
    extra = F.when(F.row_number().over(order) <= F.lit(size) - F.sum(out).over(every), 1).otherwise(0)
    return floored.withColumn(out, F.col(out) + extra).drop("_exact", "_rest")


def stratified_split(df: DataFrame, num_val: int = 500, num_test: int = 1000, id_col: str = "path",
                     seed: int = 0) -> DataFrame:
    """Exact-size test and validation partitions in proportion to the labels; the rest is training.

    Test rows are the first of each label in hash order, validation rows the next ones. Fails at run time
    unless the table has more rows than both together.
    """
    counts = df.groupBy("label").agg(F.count(F.lit(1)).alias("_n"))
    sized = _allocation(counts, num_test, "_n", "_test")
    sized = _allocation(sized.withColumn("_left", F.col("_n") - F.col("_test")), num_val, "_left", "_val")
    every = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    enough = F.assert_true(
        F.sum("_n").over(every) > num_val + num_test,
        f"the table must have more than {num_val + num_test} rows",
    )
    # assert_true gives null when it holds; coalescing it into a used column keeps the check in the plan.
    sized = sized.select("label", F.coalesce(enough.cast("bigint"), F.col("_test")).alias("_test"), "_val")
    ranked = hash_rank(df.withColumn("_key", draw_key(id_col, seed=seed)), ["label"], "_key", "_rank", digits=4)
    part = (
        F.when(F.col("_rank") < F.col("_test"), "test")
        .when(F.col("_rank") < F.col("_test") + F.col("_val"), "validation")
        .otherwise("training")
    )
    return (
        ranked.join(F.broadcast(sized), "label").withColumn("partition", part)
        .drop("_key", "_rank", "_test", "_val")
    )


def label_counts(df: DataFrame) -> DataFrame:
    return df.groupBy("label").agg(F.count(F.lit(1)).alias("n"))


def partition_stats(df: DataFrame) -> DataFrame:
    """Rows per partition and label, per partition, and in total (nulls mark the totals)."""
    return df.rollup("partition", "label").agg(F.count(F.lit(1)).alias("n"))


def fixed_fold(dataset: DataFrame) -> DataFrame:
    """Development rows (training and validation) with the flag of the one fixed validation fold."""
    return develop_set(dataset).withColumn("is_validation", F.col("partition") == "validation")


def develop_set(dataset: DataFrame) -> DataFrame:
    return dataset.where(F.col("partition").isin("training", "validation"))


def semi_filter(df: DataFrame, keep: DataFrame, on: str) -> DataFrame:
    return df.join(keep, on, "left_semi")


def order_by_list(df: DataFrame, listed: DataFrame, on: str) -> DataFrame:
    """Rows named in a list (columns ``on`` and ``pos``), in list order. The list is a gene panel, hence small."""
    return df.join(checked_broadcast(listed.select(on, "pos")), on).orderBy("pos")


def fill_missing(df: DataFrame, cols: list[str], value: str = "-") -> DataFrame:
    return df.na.fill(value, subset=cols)


# Clonal complexes with a colour slot of their own, in slot order.
CLONAL_COMPLEXES = ["ST-11 complex", "ST-41/44 complex", "ST-32 complex", "ST-23 complex", "ST-213 complex"]


def bucket_clonal_complex(df: DataFrame, col: str = "clonal_complex") -> DataFrame:
    """Colour slot of each clonal complex; -1 is the default colour."""
    slots = F.array(*[F.lit(c) for c in CLONAL_COMPLEXES])
    return df.withColumn("colour_slot", F.coalesce(F.array_position(slots, F.col(col)), F.lit(0)).cast("bigint") - 1)
