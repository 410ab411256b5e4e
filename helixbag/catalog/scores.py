"""Queries of classification metrics, rank tests and overlap tests."""

from pyspark.sql import functions as F

from helixbag.catalog.registry import query
from helixbag.operators import metrics as M
from helixbag.operators import stats as S
from helixbag.operators.knockout import relevant_loci

BY = ["part_name"]
ACC = "cast(tp + tn as double) / (tp + fp + tn + fn)"
MCC = """case when tp + fp = 0 or tp + fn = 0 or tn + fp = 0 or tn + fn = 0 then 0
     else (cast(tp as double) * tn - cast(fp as double) * fn)
          / sqrt(cast(tp + fp as double) * (tp + fn) * (tn + fp) * (tn + fn)) end"""
F1 = """((case when 2 * tp + fp + fn = 0 then 0 else cast(2 * tp as double) / (2 * tp + fp + fn) end) * (tp + fn)
     + (case when 2 * tn + fp + fn = 0 then 0 else cast(2 * tn as double) / (2 * tn + fp + fn) end) * (tn + fp))
     / (tp + fp + tn + fn)"""
AUC = "(rank_sum - p * (p + 1) / 2) / (p * q)"


def rounded(df, *cols, digits=6):
    for c in cols:
        df = df.withColumn(c, F.round(c, digits))
    return df


@query("confusion_counts", "select * from confusion")
def _(t):
    return M.confusion_counts(t.predictions(), BY)


@query("accuracy", f"select part_name, round({ACC}, 6) as accuracy from confusion")
def _(t):
    return rounded(M.accuracy(t.predictions(), BY), "accuracy")


@query("mcc", f"select part_name, round({MCC}, 6) as mcc from confusion")
def _(t):
    return rounded(M.mcc(t.predictions(), BY), "mcc")


@query("f1_weighted", f"select part_name, round({F1}, 6) as f1_weighted from confusion")
def _(t):
    return rounded(M.f1_weighted(t.predictions(), BY), "f1_weighted")


@query("roc_auc", f"select part_name, round({AUC}, 6) as roc_auc from auc_rows")
def _(t):
    return rounded(M.roc_auc(t.predictions(), BY), "roc_auc")


@query("roc_auc_overall", """
select round((sum(case when target = 1 then r else 0 end) - sum(target) * cast(sum(target) + 1 as double) / 2)
             / (cast(sum(target) as double) * sum(1 - target)), 6) as roc_auc
from (select target, rank() over (order by probability)
             + (count(*) over (partition by probability) - 1) / cast(2 as double) as r from predictions)""")
def _(t):
    return rounded(M.roc_auc(t.predictions()), "roc_auc")


# Every priority belongs to a stage.
STAGE_OF = {"1-URGENT": "training", "2-HIGH": "validation", "3-MEDIUM": "training", "4-NOT SPECIFIED": "validation", "5-LOW": "test"}
STAGED = "case part_name " + " ".join(f"when '{p}' then '{s}'" for p, s in STAGE_OF.items()) + " end"


@query("metrics_report", f"""
with staged as (select *, {STAGED} as stage from predictions),
stage_confusion as (
    select stage, count(*) filter (round_even(probability, 0) = 1 and target = 1) as tp,
           count(*) filter (round_even(probability, 0) = 1 and target = 0) as fp,
           count(*) filter (round_even(probability, 0) = 0 and target = 0) as tn,
           count(*) filter (round_even(probability, 0) = 0 and target = 1) as fn
    from staged group by stage),
stage_auc as (
    select stage, sum(case when target = 1 then r else 0 end) as rank_sum,
           cast(sum(target) as double) as p, cast(sum(1 - target) as double) as q
    from (select stage, target, rank() over (partition by stage order by probability)
                 + (count(*) over (partition by stage, probability) - 1) / cast(2 as double) as r from staged)
    group by stage)
select {', '.join(f"round_even(max(case when stage = '{p}' then {m} end), 3) as {s}_{n}"
                  for n, m in (('accuracy', ACC), ('matthews_corrcoef', MCC), ('roc_auc', AUC))
                  for p, s in (('training', 'train'), ('validation', 'val'), ('test', 'test')))}
from stage_confusion join stage_auc using (stage)""")
def _(t):
    stage = F.lit(None).cast("string")
    for name, partition in STAGE_OF.items():
        stage = F.when(F.col("part_name") == name, partition).otherwise(stage)
    return M.metrics_report(t.predictions().withColumn("partition", stage))


@query("aggregate_predictions", """
select o_custkey as genome, round(avg(case when o_orderstatus = 'F' then 1 else 0 end), 6) as target,
       round(avg(probability), 6) as probability, case when avg(probability) >= 0.5 then 1 else 0 end as prediction
from orders join predictions on o_orderkey = genome group by 1""")
def _(t):
    owner = t.read("orders").select(F.col("o_orderkey").alias("genome"), "o_custkey")
    rows = t.predictions().join(owner, "genome").drop("genome").withColumnRenamed("o_custkey", "genome")
    return rounded(M.aggregate_predictions(rows), "target", "probability")


@query("distinct_genomes", "select distinct genome from ko")
def _(t):
    return M.distinct_genomes(t.ko())


PAIRS = "select genome, max(original) as x, min(removed) as y from ko group by genome"


def pairs(t):
    return t.ko().groupBy("genome").agg(F.max("original").alias("x"), F.min("removed").alias("y"))


@query("wilcoxon_signed_rank", f"""
with d as (select x - y as d from ({PAIRS}) where x <> y),
r as (select d, rank() over (order by abs(d)) + (count(*) over (partition by abs(d)) - 1) / cast(2 as double) as r from d),
s as (select count(*) as n, sum(case when d > 0 then r else 0 end) as r_plus, sum(case when d < 0 then r else 0 end) as r_minus from r),
ties as (select sum(n * n * n - n) as tie_term from (select cast(count(*) as double) as n from d group by abs(d)))
select n, r_plus, r_minus, least(r_plus, r_minus) as w,
       round((least(r_plus, r_minus) - n * (n + 1) / cast(4 as double)
              - sign(least(r_plus, r_minus) - n * (n + 1) / cast(4 as double)) * 0.5)
             / sqrt((cast(n as double) * (n + 1) * (2 * n + 1) - tie_term / 2) / 24), 6) as z
from s cross join ties""")
def _(t):
    out = S.wilcoxon_signed_rank(pairs(t), method="approx", correction=True)
    return rounded(out, "z").select("n", "r_plus", "r_minus", "w", "z")


@query("wilcoxon_p_value")
def _(t):
    return S.wilcoxon_signed_rank(pairs(t), method="approx", correction=True).select("n", "w", "p_value")


# erfc of the score by its power series; beyond 6 it is 0 at the places compared.
@query("wilcoxon_p_value_series", f"""
with d as (select x - y as d from ({PAIRS}) where x <> y),
r as (select d, rank() over (order by abs(d)) + (count(*) over (partition by abs(d)) - 1) / cast(2 as double) as r from d),
s as (select count(*) as n, sum(case when d > 0 then r else 0 end) as r_plus, sum(case when d < 0 then r else 0 end) as r_minus from r),
ties as (select sum(n * n * n - n) as tie_term from (select cast(count(*) as double) as n from d group by abs(d))),
z as (
    select n, least(r_plus, r_minus) as w,
           abs((least(r_plus, r_minus) - n * (n + 1) / cast(4 as double)
                - sign(least(r_plus, r_minus) - n * (n + 1) / cast(4 as double)) * 0.5)
               / sqrt((cast(n as double) * (n + 1) * (2 * n + 1) - tie_term / 2) / 24)) / sqrt(cast(2 as double)) as x
    from s cross join ties)
select n, w, case when x > 4.3 then 0 else round(1 - 2 / sqrt(pi()) * list_sum(list_transform(range(0, 80),
    lambda k: (case when k % 2 = 0 then 1 else -1 end) * exp((2 * k + 1) * ln(x) - lgamma(k + 1)) / (2 * k + 1))), 6) end as p_value
from z""")
def _(t):
    return rounded(S.wilcoxon_signed_rank(pairs(t), method="approx", correction=True), "p_value").select("n", "w", "p_value")


PANEL = "select distinct gene as locus from ko where delta <= -0.07"
HITS = "select locus from relevance"


def gene_sets(t):
    panel = t.ko().where("delta <= -0.07").select(F.col("gene").alias("locus")).distinct()
    return panel, relevant_loci(t.ko(), min_genomes=20).select("locus")


@query("set_overlap", f"""
select (select count(*) from ({PANEL})) as size_left, (select count(*) from ({HITS})) as size_right,
       count(*) as size_shared, coalesce(string_agg(locus, ', ' order by locus), '') as shared
from (({PANEL}) intersect ({HITS}))""")
def _(t):
    return S.set_overlap(*gene_sets(t), "locus")


@query("fisher_overlap", f"""
with s as (
  select (select count(*) from (({PANEL}) intersect ({HITS}))) as a, (select count(*) from ({PANEL})) as n,
         (select count(*) from ({HITS})) as k, (select count(distinct gene) from ko) as m),
p as (
  select x, lgamma(k + 1) - lgamma(x + 1) - lgamma(k - x + 1) + lgamma(m - k + 1) - lgamma(n - x + 1)
         - lgamma(m - k - n + x + 1) - lgamma(m + 1) + lgamma(n + 1) + lgamma(m - n + 1) as lp
  from (select s.*, unnest(range(greatest(0, n + k - m), least(n, k) + 1)) as x from s))
select a, n - a as b, k - a as c, m - n - k + a as d,
       round((select sum(exp(lp)) from p where lp <= (select lp from p where x = a) + 1e-7), 6) as p_value from s""")
def _(t):
    panel, hits = gene_sets(t)
    universe = t.ko().select(F.col("gene").alias("locus"))
    return rounded(S.fisher_overlap(panel, hits, universe, "locus"), "p_value")
