"""Queries of knockout tables: filters, deltas, summaries and relevance."""

from pyspark.sql import functions as F

from helixbag.catalog.registry import query
from helixbag.operators import knockout as K

# The columns of the wide table, which SQL must name; the query takes them from the table.
GENES = [f"NEIS{i:04d}" for i in range(120)]


def filtered_sql(condition):
    return f"""
select *, concat('data/raw/fasta/', genome, '.fasta') as fasta, concat('data/raw/gff3/', genome, '.gff3') as gff3
from predictions where {condition}"""


@query("filter_predictions_capsule", filtered_sql("probability >= 0.9"))
def _(t):
    return K.filter_predictions(t.predictions(), "capsule", 0.9)


@query("filter_predictions_invasive", filtered_sql("probability >= 0.0"))
def _(t):
    return K.filter_predictions(t.predictions(), "invasive")


@query("filter_predictions_carriage", filtered_sql("probability < 1 - cast(0.9 as double)"))
def _(t):
    return K.filter_predictions(t.predictions(), "carriage", 0.9)


def with_gaps(t):
    """Knockout rows whose score after is missing where little was cut."""
    after = F.when(F.col("length") > 60, F.col("removed"))
    return t.ko().select("genome", F.col("gene").alias("grp"), F.col("original").alias("before"), after.alias("after"), "length")


GAPS = "(select genome, gene as grp, original as before, case when length > 60 then removed end as after, length from ko)"


@query("drop_unscored", f"select * from {GAPS} where after is not null")
def _(t):
    return K.drop_unscored(with_gaps(t))


@query("knockout_delta", f"""
select genome, grp, before as original, coalesce(after, before) as removed,
       round(before - coalesce(after, before), 6) as delta, length from {GAPS}""")
def _(t):
    rows = with_gaps(t).withColumnRenamed("before", "original")
    return K.knockout_delta(rows).withColumn("delta", F.round("delta", 6))


SUMMARY = ["mean_length", "std_length", "mean_before", "std_before", "mean_after", "std_after"]


# Means of steps of 0.01 over 32 or 64 rows end in a 5 at the 7th place, so 9 places are compared.
@query("knockout_summary", """
select gene as grp, count(*) as n, round(avg(length), 9) as mean_length, round(stddev_samp(length), 9) as std_length,
       round(avg(original), 9) as mean_before, round(stddev_samp(original), 9) as std_before,
       round(avg(removed - 0.45), 9) as mean_after, round(stddev_samp(removed - 0.45), 9) as std_after,
       count(*) filter (original > 0.5) as n_before, count(*) filter (removed - 0.45 > 0.5) as n_after,
       count(*) - count(*) filter (removed - 0.45 > 0.5) as switches
from ko group by gene""")
def _(t):
    rows = t.ko().select(F.col("gene").alias("grp"), F.col("original").alias("before"),
                         (F.col("removed") - 0.45).alias("after"), "length")
    out = K.knockout_summary(rows)
    for c in SUMMARY:
        out = out.withColumn(c, F.round(c, 9))
    return out


# The control of a gene is the one that follows it, by number and around the end.
@query("align_control", """
select k.genome, k.gene, c.original, c.removed as control, k.removed as knockout
from ko c join ko k on c.genome = k.genome and cast(substr(c.gene, 5) as int) = (cast(substr(k.gene, 5) as int) + 1) % 120""")
def _(t):
    rows = t.ko().select("genome", "gene", F.col("original").alias("before"), F.col("removed").alias("after"))
    number = F.substring("gene", 5, 4).cast("int")
    follows = F.concat(F.lit("NEIS"), F.lpad(((number + 119) % 120).cast("string"), 4, "0"))
    return K.align_control(rows, rows.withColumn("gene", follows), ["genome", "gene"])


MISSING = "case when length % 90 = 0 then null else delta end"


def deltas_with_gaps(t):
    gap = F.when(F.col("length") % 90 == 0, F.lit(None).cast("double")).otherwise(F.col("delta"))
    return t.ko().select("genome", "gene", gap.alias("delta"))


@query("clip_negative_fill", f"select genome, gene, case when {MISSING} >= 0 then {MISSING} else 0 end as delta from ko")
def _(t):
    return K.clip_negative(deltas_with_gaps(t), "delta")


@query("clip_negative_keep", f"select genome, gene, case when {MISSING} < 0 then 0 else {MISSING} end as delta from ko")
def _(t):
    return K.clip_negative(deltas_with_gaps(t), "delta", keep_missing=True)


@query("assemble_deltas_left", """
select gene, genome, round(original - round_even(removed, 3), 6) as delta from ko
where genome in (select genome from ko where gene = (select min(gene) from ko))""")
def _(t):
    return K.assemble_deltas_left(t.ko()).withColumn("delta", F.round("delta", 6))


@query("assemble_deltas_outer", f"""
select genome, {', '.join(f"max(case when gene = '{g}' then delta end) as {g}" for g in GENES)} from ko group by genome""")
def _(t):
    return K.assemble_deltas_outer(t.ko())


def scaled_sql(share):
    return f"""
select genome, gene, (delta - low) / (high - low + 1e-12) as scaled
from (select *, sum(delta) over w as total, min(delta) over w as low, max(delta) over w as high
      from (select genome, gene, case when delta < 0 then 0 else delta end as delta from ko
            where gene in (select gene from ko where delta is not null group by gene
                           having count(*) >= floor((select count(distinct genome) from ko) * {share})))
      window w as (partition by genome))
where total > 0"""


@query("delta_filter_scale", f"select genome, gene, round(scaled, 6) as scaled from ({scaled_sql('cast(0.7 as double)')})")
def _(t):
    return K.delta_filter_scale(t.ko(), 0.7).withColumn("scaled", F.round("scaled", 6))


@query("delta_filter_scale_top", f"""
with s as ({scaled_sql('cast(0.7 as double)')})
select genome, gene, round(scaled, 6) as scaled from s
where gene in (select gene from s group by gene order by round(avg(scaled), 9) desc, gene limit 20)""")
def _(t):
    return K.delta_filter_scale(t.ko(), 0.7, k=20).withColumn("scaled", F.round("scaled", 6))


@query("relevant_loci", "select * from relevance")
def _(t):
    return K.relevant_loci(t.ko(), min_genomes=20)


CATALOGUE_SQL = """
aliases as (select gene as locus, concat('NMB', substr(gene, 5)) as NMB_locus from ko where gene < 'NEIS0110' group by gene),
catalogue as (select concat('NMB', lpad(cast(p_partkey % 120 as varchar), 4, '0')) as NMB_locus, min(p_name) as gene,
                     min(p_brand) as "Name", case when min(p_size) > 5 then null else min(p_type) end as product,
                     max(p_partkey) as "NCBI" from part group by 1)"""


def annotated(t):
    locus = F.col("gene").alias("locus")
    aliases = t.ko().where("gene < 'NEIS0110'").select(locus).distinct().withColumn(
        "NMB_locus", F.concat(F.lit("NMB"), F.substring("locus", 5, 4))
    )
    slot = F.concat(F.lit("NMB"), F.lpad((F.col("p_partkey") % 120).cast("string"), 4, "0"))
    catalogue = t.read("part").groupBy(slot.alias("NMB_locus")).agg(
        F.min("p_name").alias("gene"), F.min("p_brand").alias("Name"),
        F.when(F.min("p_size") <= 5, F.min("p_type")).alias("product"), F.max("p_partkey").alias("NCBI"),
    )
    return K.annotate_loci(K.relevant_loci(t.ko(), min_genomes=20), aliases, catalogue)


@query("annotate_loci", f"""
with {CATALOGUE_SQL} select * from relevance join aliases using (locus) join catalogue using (NMB_locus)""")
def _(t):
    return annotated(t)


@query("top_n_table", f"""
with {CATALOGUE_SQL}
select locus, NMB_locus, gene, "Name", coalesce(product, '-') as product, "NCBI"
from relevance join aliases using (locus) join catalogue using (NMB_locus) order by ranking desc, locus limit 10""")
def _(t):
    return K.top_n_table(annotated(t))
