"""Queries of cohort filters, quality, balance, splits and trial tables."""

from pyspark.sql import functions as F

from helixbag.catalog.registry import query
from helixbag.operators import cohort as C
from helixbag.operators import trials as R
from helixbag.plans.shapes import Tables

TEST, VALIDATION, BINS = 40, 20, 20
METRICS = ["mean_test_accuracy", "mean_test_mcc", "mean_test_auc"]
RANKS = ["rank_test_accuracy", "rank_test_mcc", "rank_test_auc"]


def labelled(t: Tables):
    rows = C.filter_cohort(t.genomes(), task=C.label_disease)
    return rows.withColumn("genome", C.genome_id_from_path(F.col("path")).cast("bigint"))


def measured(t: Tables):
    return C.bin_quality(labelled(t).join(C.fraction_covered(t.contigs()), "genome"), BINS)


def dataset(t: Tables):
    return C.stratified_split(labelled(t), VALIDATION, TEST).select("path", "genome", "label", "partition")


@query("filter_cohort", "select * from cohort_rows")
def _(t):
    return C.filter_cohort(t.genomes())


@query("label_disease", "select path, label from labelled")
def _(t):
    return C.filter_cohort(t.genomes(), task=C.label_disease)


@query("label_capsule_keep_null", """
select path, case when capsule_group = 'B' then 1 else 0 end as label from cohort_rows
where capsule_group is distinct from 'discrepancy'""")
def _(t):
    return C.filter_cohort(t.genomes(), task=C.label_capsule)


@query("label_capsule_drop_null", """
select path, case when capsule_group = 'B' then 1 else 0 end as label from cohort_rows where capsule_group <> 'discrepancy'""")
def _(t):
    return C.filter_cohort(t.genomes(), task=lambda g: C.label_capsule(g, drop_null_group=True))


@query("genome_id_from_path", "select id, regexp_extract(path, '([^/]+)\\.fasta$', 1) as stem from genomes")
def _(t):
    return t.genomes().select("id", C.genome_id_from_path(F.col("path")).alias("stem"))


@query("label_names", """
select path, label, case when label = 0 then 'Carriage' else 'Invasive' end as label_name from labelled""")
def _(t):
    return C.label_names(labelled(t).select("path", "label"), {0: "Carriage", 1: "Invasive"})


@query("fraction_covered", "select genome, round(fraction_covered, 6) as fraction_covered from quality")
def _(t):
    return C.fraction_covered(t.contigs()).select("genome", F.round("fraction_covered", 6).alias("fraction_covered"))


@query("attach_quality", """
select l.path, l.label, round(q.fraction_covered, 6) as fraction_covered from labelled l join quality q using (genome)""")
def _(t):
    path = F.concat(F.lit("data/raw/fasta/"), F.col("genome").cast("string"), F.lit(".fasta"))
    quality = C.fraction_covered(t.contigs()).select(path.alias("path"), "fraction_covered")
    return C.attach_quality(labelled(t).select("path", "label"), quality).withColumn(
        "fraction_covered", F.round("fraction_covered", 6)
    )


@query("quality_histogram", "select cluster as bin, label, count(*) as n from measured group by 1, 2")
def _(t):
    return C.quality_histogram(measured(t), BINS)


@query("bin_quality", "select path, label, cluster from measured")
def _(t):
    return measured(t).select("path", "label", "cluster")


CLUSTERS, CLUSTER_ROUNDS = 512, 12


def cluster_sql(k, rounds):
    """The centres of each round as a table of its own."""
    steps = [f"""
valued as (select path, label, cast(round(fraction_covered * 1000000000) as bigint) as v from measured),
counted as (select v, count(*) as n, row_number() over (order by v) - 1 as r from valued group by v),
centres0 as (
    select row_number() over (order by v) - 1 as i, v as c from counted
    where (select count(*) from counted) <= {k}
       or r in (select unnest(range({k})) * ((select count(*) from counted) - 1) // {k - 1}))"""]
    for step in range(rounds):
        steps.append(f"""
ranges{step} as (
    select i, c, coalesce((c + lag(c) over (order by i)) // 2, -1) as low,
        coalesce((c + lead(c) over (order by i)) // 2, 9000000000000000000) as high from centres{step}),
centres{step + 1} as materialized (
    select i, coalesce(cast(sum(cast(v as hugeint) * n) // sum(n) as bigint), c) as c
    from ranges{step} left join counted on v > low and v <= high group by i, c)""")
    steps.append(f"""
ends as (select i, coalesce((c + lead(c) over (order by i)) // 2, 9000000000000000000) as high,
    coalesce((c + lag(c) over (order by i)) // 2, -1) as low from centres{rounds})
select path, label, cast(i as int) as cluster from valued join ends on v > low and v <= high""")
    return "with " + ",".join(steps[:-1]) + "," + steps[-1]


@query("cluster_quality", cluster_sql(CLUSTERS, CLUSTER_ROUNDS))
def _(t):
    return C.cluster_quality(measured(t).drop("cluster"), CLUSTERS, CLUSTER_ROUNDS).select("path", "label", "cluster")


@query("balance_quality", """
select path, label, cluster
from (select *, row_number() over (partition by cluster, label order by md5(concat(path, '-0'))) as rn from measured)
join (select cluster, least(count(*) filter (label = 0), count(*) filter (label = 1)) as keep
      from measured group by cluster) using (cluster)
where rn <= keep""")
def _(t):
    return C.balance_quality(measured(t)).select("path", "label", "cluster")


@query("stratified_split", "select * from dataset")
def _(t):
    return dataset(t)


@query("select_partition", "select * from dataset where partition = 'validation'")
def _(t):
    return C.select_partition(dataset(t), "validation")


@query("develop_set", "select * from dataset where partition in ('training', 'validation')")
def _(t):
    return C.develop_set(dataset(t))


@query("fixed_fold", """
select *, case when partition = 'validation' then 1 else 0 end as is_validation
from dataset where partition in ('training', 'validation')""")
def _(t):
    return C.fixed_fold(dataset(t)).withColumn("is_validation", F.col("is_validation").cast("int"))


@query("label_counts", "select label, count(*) as n from labelled group by label")
def _(t):
    return C.label_counts(labelled(t))


@query("partition_stats", "select partition, label, count(*) as n from dataset group by rollup (partition, label)")
def _(t):
    return C.partition_stats(dataset(t))


@query("semi_filter", "select * from clonal where id in (select id from genomes where disease = 'carrier')")
def _(t):
    return C.semi_filter(t.clonal(), t.genomes().where(F.col("disease") == "carrier"), "id")


@query("bucket_clonal_complex", """
select id, clonal_complex, case clonal_complex when 'ST-11 complex' then 0 when 'ST-41/44 complex' then 1
       when 'ST-32 complex' then 2 when 'ST-23 complex' then 3 when 'ST-213 complex' then 4 else -1 end as colour_slot
from clonal""")
def _(t):
    return C.bucket_clonal_complex(t.clonal())


@query("fill_missing", """
select id, coalesce(disease, '-') as disease, coalesce(capsule_group, '-') as capsule_group from genomes""")
def _(t):
    return C.fill_missing(t.genomes().select("id", "disease", "capsule_group"), ["disease", "capsule_group"])


@query("tidy_cv", """
select task, trial, max_bin as param_classifier__max_bin, round_even(mean_train_accuracy / 3, 3) as train_accuracy,
       round_even(mean_test_accuracy / 3, 3) as val_accuracy from cv_results""")
def _(t):
    wide = t.cv_results().select(
        "task", "trial", F.col("max_bin").alias("param_classifier__max_bin"), F.lit("{}").alias("params"),
        (F.col("mean_train_accuracy") / 3).alias("mean_train_accuracy"), F.lit(0.1).alias("std_train_accuracy"),
        (F.col("mean_test_accuracy") / 3).alias("mean_test_accuracy"), F.lit(0.1).alias("split0_test_accuracy"),
    )
    return R.tidy_cv(wide, rename=True)


@query("hyperparameters", "select max_bin as param_classifier__max_bin from cv_results")
def _(t):
    return R.hyperparameters(t.cv_results().withColumnRenamed("max_bin", "param_classifier__max_bin"))


RANKED = """
(select *, rank() over (partition by task order by mean_test_accuracy desc) as rank_test_accuracy,
        rank() over (partition by task order by mean_test_mcc desc) as rank_test_mcc,
        rank() over (partition by task order by mean_test_auc desc) as rank_test_auc from cv_results)"""


def ranked(t):
    return R.rank_trials(t.cv_results(), METRICS, ["task"])


@query("rank_trials", f"select * from {RANKED}")
def _(t):
    return ranked(t)


@query("refit_best", f"select task, min(trial) as trial from {RANKED} where rank_test_accuracy = 1 group by task")
def _(t):
    return R.refit_best(ranked(t), by=["task"])


@query("refit_rank_sum", f"""
select task, trial, rank_sum from (
  select task, trial, rank_test_accuracy + rank_test_mcc + rank_test_auc as rank_sum,
         row_number() over (partition by task order by rank_test_accuracy + rank_test_mcc + rank_test_auc, trial) as rn
  from {RANKED} r
  join (select task, case when max(mean_train_accuracy) > 0.9 then 0.9 when max(mean_train_accuracy) > 0.8 then 0.8
                          when max(mean_train_accuracy) > 0.7000000000000001 then 0.7000000000000001
                          when max(mean_train_accuracy) > 0.6000000000000001 then 0.6000000000000001 else 0.5 end as cut
        from cv_results group by task) c using (task)
  where mean_train_accuracy > cut)
where rn = 1""")
def _(t):
    return R.refit_rank_sum(ranked(t), RANKS, ["task"])


@query("best_run", """
select task, method, vocab_size, val_accuracy from (
  select *, row_number() over (partition by task order by val_accuracy desc, vocab_size, method) as rn from runs)
where rn = 1""")
def _(t):
    return R.best_run(t.runs())


@query("union_trials", """
select * from (select round(max(mean_train_accuracy), 3) as train_accuracy, round(max(mean_test_accuracy), 3) as val_accuracy
               from cv_results)
cross join (select round(max(val_accuracy), 3) as test_accuracy from runs)""")
def _(t):
    cv = t.cv_results().agg(F.round(F.max("mean_train_accuracy"), 3).alias("train_accuracy"),
                            F.round(F.max("mean_test_accuracy"), 3).alias("val_accuracy"))
    return R.union_trials(cv, t.runs().agg(F.round(F.max("val_accuracy"), 3).alias("test_accuracy")))


def stage_metrics(t, *keys):
    price = F.col("p_retailprice")
    return t.read("part").groupBy(*keys).agg(
        F.round(F.max(price) / 3000, 3).alias("train_accuracy"), F.round(F.min(price) / 3000, 3).alias("val_accuracy"),
        F.round(F.max(price) / 4000, 3).alias("test_accuracy"),
    )


STAGE_SQL = """round(max(p_retailprice) / cast(3000 as double), 3) as train_accuracy,
       round(min(p_retailprice) / cast(3000 as double), 3) as val_accuracy,
       round(max(p_retailprice) / cast(4000 as double), 3) as test_accuracy"""
UNPIVOT_SQL = """
select {keys}, 'Train' as stage, train_accuracy as "Accuracy" from r
union all select {keys}, 'Val', val_accuracy from r union all select {keys}, 'Test', test_accuracy from r"""


@query("collect_feature_scan", f"""
with r as (
  select p_brand as dataset, count(*) + 100 as num_features, {STAGE_SQL} from part group by 1
  union all select p_brand, cast(p_size as bigint), {STAGE_SQL} from part group by 1, 2)
{UNPIVOT_SQL.format(keys='dataset, num_features')}""")
def _(t):
    brand, size = F.col("p_brand").alias("dataset"), F.col("p_size").cast("bigint").alias("num_features")
    counts = t.read("part").groupBy(brand).agg((F.count(F.lit(1)) + 100).alias("num_features"))
    return R.collect_feature_scan(stage_metrics(t, brand), stage_metrics(t, brand, size), counts)


@query("vocab_sensitivity", f"""
with r as (
  select p_brand as dataset, p_size * 100 as vocab_size, count(*) as num_features, {STAGE_SQL} from part group by 1, 2)
{UNPIVOT_SQL.format(keys='dataset, vocab_size, num_features')}""")
def _(t):
    keys = [F.col("p_brand").alias("dataset"), (F.col("p_size") * 100).alias("vocab_size")]
    counts = t.read("part").groupBy(*keys).agg(F.count(F.lit(1)).alias("num_features"))
    return R.vocab_sensitivity(stage_metrics(t, *keys), counts, sizes=None)


RUN_SQL = "p_brand as dataset, 2000 * (p_size % 16 + 1) as vocab_size, p_type as strategy"


def run_keys():
    return [F.col("p_brand").alias("dataset"), (F.col("p_size") % 16 * 2000 + 2000).alias("vocab_size"), F.col("p_type").alias("strategy")]


@query("collect_feature_scan_runs", f"""
with r as (
  select {RUN_SQL}, count(*) + 20000 as num_features, {STAGE_SQL} from part group by 1, 2, 3
  union all select {RUN_SQL}, cast(2 ** (p_partkey % 14 + 1) as bigint), {STAGE_SQL} from part group by 1, 2, 3, 4)
{UNPIVOT_SQL.format(keys='dataset, vocab_size, strategy, num_features')}""")
def _(t):
    fold = F.pow(F.lit(2), F.col("p_partkey") % 14 + 1).cast("bigint").alias("num_features")
    counts = t.read("part").groupBy(*run_keys()).agg((F.count(F.lit(1)) + 20000).alias("num_features"))
    return R.collect_feature_scan(stage_metrics(t, *run_keys()), stage_metrics(t, *run_keys(), fold), counts)


@query("vocab_sensitivity_runs", f"""
with r as (
  select {RUN_SQL}, count(*) as num_features, {STAGE_SQL} from part
  where 2000 * (p_size % 16 + 1) in (4000, 8000, 16000, 32000) group by 1, 2, 3)
{UNPIVOT_SQL.format(keys='dataset, vocab_size, strategy, num_features')}""")
def _(t):
    counts = t.read("part").groupBy(*run_keys()).agg(F.count(F.lit(1)).alias("num_features"))
    return R.vocab_sensitivity(stage_metrics(t, *run_keys()), counts)
