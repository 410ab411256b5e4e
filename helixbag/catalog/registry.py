"""Registration of queries and assembly of their checking SQL."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from helixbag.plans.shapes import Tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

BASES = "translate(upper(regexp_replace({col}, '[^A-Za-z]', '', 'g')), 'EIOUNRSHLDMP', 'ACGTACGTACGT')"

# Derived tables in DuckDB SQL; a query gets those it names, directly or through others.
SHAPES = {
    "genomes": """
select d.doc_id as id, concat('iso', d.doc_id) as isolate,
       case when d.lang = 'en' then 'Neisseria meningitidis' else d.lang end as species,
       case when d.source = 'src0' then 1 else 0 end as complete,
       case when d.doc_id % 11 = 0 then null when d.doc_id % 7 < 3 then 'carrier'
            when d.doc_id % 7 = 3 then 'meningitis' when d.doc_id % 7 = 4 then 'septicaemia'
            when d.doc_id % 7 = 5 then 'meningitis and septicaemia' else 'other' end as disease,
       case when l.toxic = 1 then 'discrepancy' when l.quality = 1 then 'B' when l.quality = 0 then 'C' end as capsule_group,
       concat('data/raw/fasta/', d.doc_id, '.fasta') as path
from documents d left join labels l on d.doc_id = l.doc_id""",
    "text_lines": """
select doc_id, unnest(range(len(string_split(text, chr(10))))) as pos, unnest(string_split(text, chr(10))) as line
from documents""",
    "contigs": f"""
select doc_id as genome, pos as contig_idx, concat('c', pos) as seqid, {BASES.format(col='line')} as seq
from text_lines where regexp_matches(line, '[A-Za-z]')""",
    "talk": f"""
select conv_id as genome, turn as contig_idx, concat('c', turn) as seqid, {BASES.format(col='text')} as seq
from conversations where regexp_matches(text, '[A-Za-z]')""",
    "loci": """
select c.genome, c.seqid,
       1 + (c.genome * 31 + c.contig_idx * 17 + g.g * 101) % (length(c.seq) - 40) as start_pos,
       1 + (c.genome * 31 + c.contig_idx * 17 + g.g * 101) % (length(c.seq) - 40) + 29 + (c.genome + g.g) % 10 as end_pos,
       concat('NEIS', lpad(cast((c.contig_idx * 3 + g.g) % 200 as varchar), 4, '0')) as locus_tag
from contigs c cross join (values (0), (1), (2)) g(g) where length(c.seq) >= 60""",
    "predictions": """
select o_orderkey as genome, o_orderpriority as part_name,
       case when o_orderstatus = 'F' then 1 else 0 end as target,
       round(0.6 * (cast((o_orderkey * 7919 + o_custkey * 104729) % 100003 as double) / 100003)
             + 0.4 * (case when o_orderstatus = 'F' then 1 else 0 end), 3) as probability
from orders""",
    "ko": """
select l_orderkey % 436 as genome, concat('NEIS', lpad(cast(l_partkey % 120 as varchar), 4, '0')) as gene,
       round(0.9 + max(l_discount), 6) as original, round(0.9 + max(l_tax), 6) as removed,
       round(max(l_discount) - max(l_tax), 6) as delta, 30 * count(*) as length
from lineitem group by 1, 2""",
    "cv_results": """
select p_brand as task, p_partkey as trial, 4 + p_partkey % 28 as max_bin,
       round(0.6 + cast(p_partkey % 10 as double) / 40, 3) as mean_train_accuracy,
       round(0.4 + cast(p_size as double) / 100, 3) as mean_test_accuracy,
       round(cast(p_partkey * 37 % 23 as double) / 23, 3) as mean_test_mcc,
       round(cast(p_partkey * 11 % 17 as double) / 17, 3) as mean_test_auc
from part""",
    "runs": """
select p_type as task, p_brand as method, p_size * 100 as vocab_size,
       round(max(p_retailprice) / cast(3000 as double), 3) as val_accuracy
from part group by 1, 2, 3""",
    "clonal": """
select c_custkey as id, case c_mktsegment when 'BUILDING' then 'ST-11 complex' when 'MACHINERY' then 'ST-41/44 complex'
       when 'FURNITURE' then 'ST-32 complex' when 'AUTOMOBILE' then 'ST-23 complex' else 'other' end as clonal_complex
from customer""",
    "cohort_rows": "select * from genomes where species = 'Neisseria meningitidis' and complete = 0",
    "labelled": """
select path, cast(regexp_extract(path, '([0-9]+)\\.fasta', 1) as bigint) as genome,
       case when disease = 'carrier' then 0 else 1 end as label
from cohort_rows
where disease in ('carrier', 'invasive (unspecified/other)', 'meningitis', 'septicaemia', 'meningitis and septicaemia')""",
    "quality": """
select genome, sum(case when rn <= 10 then len else 0 end) * cast(1 as double) / sum(len) as fraction_covered
from (select genome, length(seq) as len,
             row_number() over (partition by genome order by length(seq) desc, contig_idx) as rn from contigs)
group by genome""",
    "measured": """
select l.path, l.genome, l.label, q.fraction_covered,
       cast(least(floor(q.fraction_covered * 20), 19) as bigint) as cluster
from labelled l join quality q on l.genome = q.genome""",
    "kmer3": """
select genome, substr(x, cast(i as int), 3) as term, count(*) as tf
from (select genome, x, unnest(range(1, length(x) - 1)) as i
      from (select genome, regexp_replace(seq, '[BD-FH-SU-Z]+', 'X', 'g') as x from contigs))
where regexp_full_match(substr(x, cast(i as int), 3), '[ACGT]{3}')
group by 1, 2""",
    "vocab3": """
select term, row_number() over (order by term) - 1 as idx, count(*) as df,
       ln((1 + (select count(distinct genome) from contigs)) / cast(1 + count(*) as double)) + 1 as idf
from kmer3 group by term""",
    "tfidf3": """
select genome, idx, term, tf * idf / sqrt(sum(tf * idf * tf * idf) over (partition by genome)) as tfidf
from kmer3 join vocab3 using (term)""",
    "split_counts": "select label, count(*) as n from labelled group by label",
    "split_test": """
select label, n, base + case when row_number() over (order by rest desc, label) <= 40 - sum(base) over () then 1 else 0 end as n_test
from (select label, n, floor(n * cast(40 as double) / sum(n) over ()) as base,
             n * cast(40 as double) / sum(n) over () - floor(n * cast(40 as double) / sum(n) over ()) as rest
      from split_counts)""",
    "split_sizes": """
select label, n_test, base + case when row_number() over (order by rest desc, label) <= 20 - sum(base) over () then 1 else 0 end as n_val
from (select label, n_test, floor((n - n_test) * cast(20 as double) / sum(n - n_test) over ()) as base,
             (n - n_test) * cast(20 as double) / sum(n - n_test) over ()
             - floor((n - n_test) * cast(20 as double) / sum(n - n_test) over ()) as rest
      from split_test)""",
    "dataset": """
select path, genome, r.label,
       case when rn <= n_test then 'test' when rn <= n_test + n_val then 'validation' else 'training' end as partition
from (select *, row_number() over (partition by label order by md5(concat(path, '-0'))) as rn from labelled) r
join split_sizes s on r.label = s.label""",
    "confusion": """
select part_name, count(*) filter (round_even(probability, 0) = 1 and target = 1) as tp,
       count(*) filter (round_even(probability, 0) = 1 and target = 0) as fp,
       count(*) filter (round_even(probability, 0) = 0 and target = 0) as tn,
       count(*) filter (round_even(probability, 0) = 0 and target = 1) as fn
from predictions group by part_name""",
    "auc_rows": """
select part_name, sum(case when target = 1 then r else 0 end) as rank_sum,
       cast(sum(target) as double) as p, cast(sum(1 - target) as double) as q
from (select part_name, target, rank() over (partition by part_name order by probability)
             + (count(*) over (partition by part_name, probability) - 1) / cast(2 as double) as r from predictions)
group by part_name""",
    "clipped": "select genome, gene, case when delta >= 0 then delta else 0 end as delta from ko",
    "relevance": """
select gene as locus, count(*) filter (delta > cut) as ranking
from clipped join (
    select genome, quantile_cont(coalesce(delta, 0), 0.95) as cut
    from (select distinct genome from clipped) cross join (select distinct gene from clipped) left join clipped using (genome, gene)
    group by genome) using (genome)
group by gene having count(*) filter (delta > cut) >= 20""",
}


def oracle(sql: str) -> str:
    """The SQL with the derived tables it needs in front."""
    names = "|".join(SHAPES)
    needed: set[str] = set()

    def visit(text: str) -> None:
        for name in re.findall(rf"\b({names})\b", text):
            if name not in needed:
                needed.add(name)
                visit(SHAPES[name])

    visit(sql)
    parts = [f"{name} as ({SHAPES[name].strip()})" for name in SHAPES if name in needed]
    body = sql.strip()
    if body.lower().startswith("with "):
        parts.append(body[5:])
        return "with " + ",\n".join(parts)
    return f"with {', '.join(parts)}\n{body}" if parts else body


def query(name: str, sql: str | None = None):
    """Register a function of ``Tables`` under a query name."""
    def register(build: Callable[[Tables], DataFrame]):
        QUERIES[name] = lambda spark, folder: build(Tables(spark, folder))
        if sql is not None:
            ORACLE[name] = oracle(sql)
        return build

    return register
