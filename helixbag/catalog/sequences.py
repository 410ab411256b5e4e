"""Queries of sequence functions, locus joins, masking, terms and TF-IDF."""

from pyspark.sql import functions as F

from helixbag.catalog.registry import query
from helixbag.functions import sequence as Q
from helixbag.operators import corpus as P
from helixbag.operators import loci as L
from helixbag.operators import terms as T
from helixbag.operators.bpe import BpeModel, bpe_encode, bpe_pair_counts
from helixbag.session import materialize

CLEAN = "regexp_replace(seq, '[BD-FH-SU-Z]+', 'X', 'g')"
REVERSE = "reverse(translate({x}, 'ACGTUMRWSYKVHDBNXacgtumrwsykvhdbnx', 'TGCAAKYWSRMBDHVNXtgcaakywsrmbdhvnx'))"
BOUNDARY = ("NEIS0003", "NEIS0005")
PANEL = ["NEIS0000", "NEIS0004", "NEIS0001", "NEIS0007", "NEIS0012"]
IN_PANEL = ", ".join(f"'{g}'" for g in PANEL)


def panel(t):
    return t.spark.createDataFrame([(g, i) for i, g in enumerate(PANEL)], "locus_tag string, pos long")


@query("clean_seq", f"select genome, contig_idx, {CLEAN} as seq from contigs")
def _(t):
    return t.contigs().select("genome", "contig_idx", Q.clean_seq(F.col("seq")).alias("seq"))


@query("reverse_complement", f"select genome, contig_idx, {REVERSE.format(x='seq')} as seq from contigs")
def _(t):
    return t.contigs().select("genome", "contig_idx", Q.reverse_complement(F.col("seq")).alias("seq"))


@query("mask_interval", """
select genome, contig_idx, case when hi > lo then replace(seq, substr(seq, lo + 1, hi - lo), repeat('X', hi - lo)) else seq end as seq
from (select *, cast(greatest(length(seq) // 3 - 4, 0) as int) as lo,
             cast(least(length(seq) // 3 + genome % 12 + 4, length(seq)) as int) as hi from contigs)""")
def _(t):
    start = F.floor(F.length("seq") / 3)
    masked = Q.mask_interval(F.col("seq"), start, start + F.col("genome") % 12, padding=8)
    return t.contigs().select("genome", "contig_idx", masked.alias("seq"))


@query("contig_length_filter", "select genome, contig_idx, length(seq) as len from contigs where length(seq) >= 500")
def _(t):
    return P.contig_length_filter(t.contigs()).select("genome", "contig_idx", F.length("seq").alias("len"))


DRAW = "(cast('0x' || substr(md5(concat(genome, '-', contig_idx, '-0-{what}')), 1, 8) as bigint) % {n})"
SAMPLE = f"""
select genome, contig_idx, {CLEAN.replace('seq', 'cut')} as sentence
from (select *, substr(seq, cast({DRAW.format(what='start', n='(length(seq) - width + 1)')} as int) + 1, width) as cut
      from (select *, cast(500 + {DRAW.format(what='length', n='(least(length(seq), 1000) - 500 + 1)')} as int) as width
            from contigs where length(seq) >= 500))"""


@query("sample_subsequence", SAMPLE)
def _(t):
    return P.sample_subsequence(t.contigs())


@query("random_sample_k", f"""
select genome, contig_idx, sentence from ({SAMPLE}) order by md5(concat(genome, '-', contig_idx, '-0')) limit 20""")
def _(t):
    return P.random_sample_k(P.sample_subsequence(t.contigs()), 20)


@query("genomes_differ", f"""
select genome, max(case when seq <> {CLEAN} then 1 else 0 end) as differs from contigs group by genome""")
def _(t):
    t.stored()
    cleaned = t.contigs().withColumn("seq", Q.clean_seq(F.col("seq")))
    return L.genomes_differ(t.contigs(), cleaned)


@query("join_contigs", """
select genome, contig_idx // 100 as piece, string_agg(seq, chr(10) order by contig_idx) as document
from contigs group by 1, 2""")
def _(t):
    return P.join_contigs(t.contigs())


@query("join_contigs_whole", """
select genome, string_agg(seq, chr(10) order by contig_idx) as document from contigs group by 1""")
def _(t):
    return P.join_contigs(t.contigs(), per_piece=None)


KMERS34 = """
select genome, contig_idx, term, count(*) as n
from (select genome, contig_idx, substr(x, cast(i as int), k) as term, k
      from (select *, unnest(range(1, length(x) - k + 2)) as i
            from (select genome, contig_idx, regexp_replace(seq, '[BD-FH-SU-Z]+', 'X', 'g') as x from contigs)
            cross join (values (3), (4)) v(k)))
where regexp_full_match(term, '[ACGT]+') group by 1, 2, 3"""


@query("kmer_extract", KMERS34)
def _(t):
    return T.kmer_extract(T.deal_out(t.contigs()), 3, 4).groupBy("genome", "contig_idx", "term").agg(F.count(F.lit(1)).alias("n"))


@query("kmer_extract_sql", KMERS34)
def _(t):
    # The same in SQL alone, with the library's table function.
    from helixbag.functions.sql import register_functions

    register_functions(t.spark)
    return t.spark.sql("""
        select genome, contig_idx, term, count(*) as n
        from (select genome, contig_idx, clean_seq(seq) as seq from {contigs}) c, lateral kmers(seq, 3, 4) group by genome, contig_idx, term""", contigs=T.deal_out(t.contigs()))


WORDS3 = """(select a.c || b.c || d.c as term from (values ('A'), ('C'), ('G'), ('T')) a(c)
 cross join (values ('A'), ('C'), ('G'), ('T')) b(c) cross join (values ('A'), ('C'), ('G'), ('T')) d(c))"""


@query("kmer_universe", f"""
select term, coalesce(sum(tf), 0) as n, count(genome) as df from {WORDS3} left join kmer3 using (term) group by term""")
def _(t):
    # How often each possible word occurs, and in how many genomes.
    counts = T.kmer_counts(t.contigs(), 3, 3).groupBy("term").agg(F.sum("tf").alias("n"), F.count(F.lit(1)).alias("df"))
    return T.kmer_universe(t.spark, 3, 3).join(counts, "term", "left").na.fill(0)


CHUNKS = f"""
select genome, contig_idx, unnest(regexp_extract_all(x, '.{{1,6}}')) as term
from (select genome, contig_idx, {CLEAN} as x from contigs)"""


@query("token_filter", f"""
select genome, term, count(*) as n from ({CHUNKS}) where length(term) > 2 and not contains(term, 'X') group by 1, 2""")
def _(t):
    cleaned = t.contigs().select("genome", F.explode(Q.fixed_chunks(Q.clean_seq(F.col("seq")), 6)).alias("term"))
    return T.token_filter(cleaned).groupBy("genome", "term").agg(F.count(F.lit(1)).alias("n"))


@query("both_strand_tokens", f"""
select genome, term, count(*) as n
from (select genome, unnest(regexp_extract_all(x, '.{{1,6}}')) as term
      from (select genome, {CLEAN} as x from contigs
            union all select genome, {REVERSE.format(x=CLEAN)} as x from contigs))
where length(term) > 2 and not contains(term, 'X') group by 1, 2""")
def _(t):
    rows = T.token_rows(t.contigs(), lambda s: Q.fixed_chunks(s, 6), ["genome"])
    return rows.groupBy("genome", "term").agg(F.count(F.lit(1)).alias("n"))


LOCATED = f"""
select l.genome, l.locus_tag, list_position([{IN_PANEL}], l.locus_tag) - 1 as pos, l.seqid, c.contig_idx,
       l.start_pos as "start", l.end_pos + 1 as "end", l.end_pos + 1 - l.start_pos as length
from (select *, count(*) over (partition by genome, locus_tag) as n from loci where locus_tag in ({IN_PANEL})) l
join (select genome, seqid, min(contig_idx) as contig_idx from contigs group by 1, 2 having count(*) = 1) c
  on l.genome = c.genome and l.seqid = c.seqid
where n = 1"""


@query("locate_gene", f"select * from ({LOCATED}) where locus_tag = 'NEIS0004'")
def _(t):
    return L.locate_gene(t.contigs(), t.loci(), "NEIS0004").withColumn("pos", F.lit(1).cast("bigint"))


@query("locate_genes", LOCATED)
def _(t):
    return L.locate_genes(t.contigs(), t.loci(), panel(t))


REGION = f"""
select p.genome, p.seqid, c.contig_idx, p.left_end + 1 as "start", p.right_start as "end", p.right_start - p.left_end - 1 as length
from (select genome, min(seqid) as seqid, max(seqid) as other, count(*) as n,
             arg_min(end_pos, row(start_pos, locus_tag)) as left_end,
             arg_min(start_pos, row(-end_pos, locus_tag)) as right_start
      from loci where locus_tag in ('{BOUNDARY[0]}', '{BOUNDARY[1]}') group by genome) p
join (select genome, seqid, min(contig_idx) as contig_idx from contigs group by 1, 2 having count(*) = 1) c
  on p.genome = c.genome and p.seqid = c.seqid
where n = 2 and p.seqid = other"""


@query("locate_capsule", REGION)
def _(t):
    return L.locate_capsule(t.contigs(), t.loci(), BOUNDARY)


def cut_sql(lo, hi):
    return f"case when {hi} > {lo} then replace(seq, substr(seq, cast({lo} as int) + 1, cast({hi} - {lo} as int)), repeat('X', cast({hi} - {lo} as int))) else seq end"


@query("mask_capsule", f"""
select c.genome, c.contig_idx, md5(case when r.length > 0 then {cut_sql('"start"', 'least("end", length(seq))')} else seq end) as digest
from contigs c left join ({REGION}) r on c.genome = r.genome and c.contig_idx = r.contig_idx""")
def _(t):
    t.stored()
    masked = L.mask_capsule(t.contigs(), t.loci(), BOUNDARY)
    return masked.select("genome", "contig_idx", F.md5("seq").alias("digest"))


def fold_sql(source, key, rows):
    """Mask panel genes one after the other, in list order."""
    text = source
    for i in range(len(PANEL)):
        cut = cut_sql('greatest("start" - 10, 0)', 'least("end" + 10, length(seq))')
        text = f"""(select c.genome, c.contig_idx, c.{key} as {key}, case when l.genome is null then seq else {cut} end as seq
 from {text} c left join (select * from {rows} where pos = {i}) l on c.genome = l.genome and c.{key} = l.{key})"""
    return text


@query("mask_genes", f"""
with located as materialized ({LOCATED})
select genome, contig_idx, md5(seq) as digest
from {fold_sql('(select genome, contig_idx, contig_idx as k, seq from contigs)', 'k', '(select *, contig_idx as k from located)')}""")
def _(t):
    t.stored()
    return L.mask_genes(t.contigs(), t.loci(), panel(t)).select("genome", "contig_idx", F.md5("seq").alias("digest"))


@query("mask_control", f"""
with located as materialized ({LOCATED}),
numbered as materialized (
  select genome, contig_idx, seq, row_number() over (partition by genome order by contig_idx) - 1 as k from contigs),
moved as materialized (
  select l.genome, l.pos, l."start", l."end",
         cast('0x' || substr(md5(concat(l.genome, '-', l.locus_tag, '-0')), 1, 8) as bigint) % n as k
  from located l join (select genome, count(*) as n from contigs group by genome) using (genome))
select genome, contig_idx, md5(seq) as digest from {fold_sql('numbered', 'k', 'moved')}""")
def _(t):
    t.stored()
    masked = L.mask_control(t.contigs(), t.loci(), panel(t))
    return masked.select("genome", "contig_idx", F.md5("seq").alias("digest"))


@query("removed_lengths", f"select genome, sum(length) as length from ({LOCATED}) group by genome")
def _(t):
    t.stored()
    return L.removed_lengths(L.locate_genes(t.contigs(), t.loci(), panel(t)))


@query("order_by_list", f"""
select locus_tag, n, list_position([{IN_PANEL}], locus_tag) - 1 as pos
from (select locus_tag, count(*) as n from loci group by locus_tag) where locus_tag in ({IN_PANEL})""")
def _(t):
    from helixbag.operators.cohort import order_by_list

    counts = t.loci().groupBy("locus_tag").agg(F.count(F.lit(1)).alias("n"))
    return order_by_list(counts, panel(t), "locus_tag")


def counts3(t):
    return T.kmer_counts(t.contigs(), 3, 3)


def fitted3(t):
    """3-mer counts, written once because fitting and weighing both read them, and their vocabulary."""
    tf = materialize(counts3(t), "tf")
    return tf, T.idf_fit(tf, t.contigs().select("genome"), bound=64)


@query("term_counts", "select * from kmer3")
def _(t):
    return counts3(t)


# All k-mers of 3 to 8 letters, summed up per k; the terms themselves would be 20 million rows at the bench scale.
@query("kmer_counts_3_8", " union all ".join(f"""
select {k} as k, count(*) as n, count(distinct substr(x, cast(i as int), {k})) as words
from (select x, unnest(range(1, length(x) - {k - 2})) as i from (select regexp_replace(seq, '[BD-FH-SU-Z]+', 'X', 'g') as x from contigs))
where regexp_full_match(substr(x, cast(i as int), {k}), '[ACGT]{{{k}}}')""" for k in range(3, 9)))
def _(t):
    counted = T.kmer_counts(t.contigs(), 3, 8).groupBy("term").agg(F.sum("tf").alias("n"))
    k = F.length("term").alias("k")
    return counted.groupBy(k).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("words"))


@query("document_frequency", "select term, df from vocab3")
def _(t):
    return T.document_frequency(counts3(t))


@query("idf_fit", "select term, idx, df, round(idf, 6) as idf from vocab3")
def _(t):
    return T.idf_fit(counts3(t), t.contigs().select("genome"), bound=64).withColumn("idf", F.round("idf", 6))


@query("idf_fit_unbounded", "select term, idx, df, round(idf, 6) as idf from vocab3")
def _(t):
    return T.idf_fit(counts3(t), t.contigs().select("genome")).withColumn("idf", F.round("idf", 6))


@query("tfidf_transform", "select genome, idx, term, round(tfidf, 6) as tfidf from tfidf3")
def _(t):
    tf, vocab = fitted3(t)
    return T.tfidf_transform(tf, vocab, 64).withColumn("tfidf", F.round("tfidf", 6))


@query("binary_tf", "select genome, term, least(tf, 1) as tf from kmer3")
def _(t):
    return T.binary_tf(counts3(t))


@query("min_max_df_filter", """
select term, df from vocab3
where df >= 0.1 * (select count(distinct genome) from contigs) and df <= 0.98 * (select count(distinct genome) from contigs)""")
def _(t):
    n = t.contigs().agg(F.count_distinct("genome")).scalar()
    return T.min_max_df_filter(T.document_frequency(counts3(t)), n, 0.1, 0.98)


@query("variance_threshold", """
select idx, round(sum(tfidf * tfidf) / n - (sum(tfidf) / n) * (sum(tfidf) / n), 7) as variance
from tfidf3 cross join (select count(distinct genome) as n from contigs) group by idx, n
having sum(tfidf * tfidf) / n - (sum(tfidf) / n) * (sum(tfidf) / n) > 0.001""")
def _(t):
    tf, vocab = fitted3(t)
    n = t.contigs().agg(F.count_distinct("genome")).scalar()
    kept = T.variance_threshold(T.tfidf_transform(tf, vocab, 64), n, 0.001)
    return kept.withColumn("variance", F.round("variance", 7))


# At the default threshold only constant features go: one that all genomes have alike, and one that is 0 in all.
@query("variance_threshold_default", """
with features as (
    select genome, idx, tfidf from tfidf3
    union all select distinct genome, 1000, 0.1 from tfidf3
    union all select distinct genome, 1001, 0 from tfidf3)
select idx from features group by idx
having max(tfidf) <> min(tfidf) or (count(*) < (select count(distinct genome) from contigs) and max(tfidf) <> 0)""")
def _(t):
    tf, vocab = fitted3(t)
    n = t.contigs().agg(F.count_distinct("genome")).scalar()
    weights = T.tfidf_transform(tf, vocab, 64).select("genome", "idx", "tfidf")
    genomes = weights.select("genome").distinct()
    for idx, value in ((1000, 0.1), (1001, 0.0)):
        weights = weights.unionByName(genomes.select("genome", F.lit(idx).cast("bigint").alias("idx"), F.lit(value).alias("tfidf")))
    return T.variance_threshold(weights, n).select("idx")


@query("zip_importances", """
select term as word, round(sum(tfidf), 4) as importance from tfidf3 group by term""")
def _(t):
    tf, vocab = fitted3(t)
    importances = T.tfidf_transform(tf, vocab, 64).groupBy("idx").agg(F.round(F.sum("tfidf"), 4).alias("importance"))
    return T.zip_importances(vocab, importances)


def kmers_sql(source, k):
    return f"""
select genome, term, count(*) as tf
from (select genome, substr(x, cast(i as int), {k}) as term
      from (select genome, x, unnest(range(1, length(x) - {k} + 2)) as i from (select genome, {CLEAN} as x from {source})))
where regexp_full_match(term, '[ACGT]{{{k}}}') group by 1, 2"""


HELD_OUT = """(select item_id as genome, translate(upper(regexp_replace(text, '[^A-Za-z]', '', 'g')), 'EIOUNRSHLDMP', 'ACGTACGTACGT') as seq
 from benchmark)"""


@query("vocab_lookup", f"""
select genome, term, tf, idx from ({kmers_sql('contigs', 5)})
join (select term, row_number() over (order by term) - 1 as idx from ({kmers_sql(HELD_OUT, 5)}) group by term) using (term)""")
def _(t):
    from helixbag.plans.shapes import as_bases

    # The vocabulary of the benchmark passages, looked up in the documents.
    passages = t.read("benchmark").select(F.col("item_id").alias("genome"), as_bases(F.col("text")).alias("seq"))
    vocab = T.idf_fit(T.kmer_counts(passages, 5, 5), bound=T.kmer_bound(5, 5))
    found = T.vocab_lookup(T.kmer_counts(t.contigs(), 5, 5), vocab, T.kmer_bound(5, 5))
    return found.select("genome", "term", "tf", "idx")


def weights_sql(counts):
    return f"""
with tf as materialized ({counts}), n as (select count(distinct genome) as n from tf),
v as (select term, row_number() over (order by term) - 1 as idx, ln((1 + n) / cast(1 + count(*) as double)) + 1 as idf
      from tf cross join n group by term, n)
select genome, idx, term, round(tf * idf / sqrt(sum(tf * idf * tf * idf) over (partition by genome)), 6) as tfidf
from tf join v using (term)"""


@query("kmer_tfidf", weights_sql(kmers_sql("talk", 3) + " union all " + kmers_sql("talk", 4)))
def _(t):
    from helixbag.operators.features import KmerCounter, TfidfVectorizer

    counter = KmerCounter(3, 4)
    tf = materialize(counter.counts(t.conversation_contigs()), "tf")
    model = TfidfVectorizer(counter).fit_counts(tf)
    return model.transform_counts(tf).withColumn("tfidf", F.round("tfidf", 6))


# A fixed merge list: what a short training run over bases might learn.
MERGES = (("A", "C"), ("G", "T"), ("AC", "GT"), ("C", "A"), ("T", "A"), ("AC", "A"), ("GT", "C"), ("ACGT", "CA"))
MODEL = BpeModel(("X", "A", "C", "G", "T", *[a + b for a, b in MERGES]), MERGES)


# A merge list too long for replacements, by rule: bases to pairs, pairs to fours, then longer tokens of some fours.
PAIRS = [a + b for a in "ACGT" for b in "ACGT"]
LONG_MERGES = (
    *[(p[0], p[1]) for p in PAIRS], *[(a, b) for a in PAIRS for b in PAIRS], *[(p + p, p + p) for p in PAIRS],
    *[("AC" + p, b) for p in PAIRS for b in "ACGT"], *[("GT" + p, p) for p in PAIRS])
LONG_MODEL = BpeModel(("X", "A", "C", "G", "T", *[a + b for a, b in LONG_MERGES]), LONG_MERGES)


def encode_sql(source, merges=MERGES):
    text = "regexp_replace(x, '(.)', '|\\1|', 'g')"
    for a, b in merges:
        text = f"replace({text}, '|{a}||{b}|', '|{a}{b}|')"
    return f"""
select genome, contig_idx, unnest(string_split({text}, '|')) as term
from (select genome, contig_idx, {CLEAN} as x from {source}
      union all select genome, contig_idx, {REVERSE.format(x=CLEAN)} as x from {source})"""


def encoded_sql(merges):
    return (f"select genome, term, count(*) as tf from ({encode_sql('contigs', merges)}) "
            "where length(term) > 2 and not contains(term, 'X') group by 1, 2")


ENCODED = encoded_sql(MERGES)


@query("bpe_encode", ENCODED)
def _(t):
    return T.term_counts(bpe_encode(t.contigs(), MODEL))


@query("bpe_encode_long", encoded_sql(LONG_MERGES))
def _(t):
    return T.term_counts(bpe_encode(t.contigs(), LONG_MODEL))


@query("sentence_tfidf", weights_sql(ENCODED))
def _(t):
    from helixbag.operators.bpe import bpe_tokenizer
    from helixbag.operators.features import TfidfVectorizer, TokenCounter

    counter = TokenCounter(bpe_tokenizer(MODEL, t.spark), len(MODEL.tokens))
    tf = materialize(counter.counts(t.contigs()), "tf")
    return TfidfVectorizer(counter).fit_counts(tf).transform_counts(tf).withColumn("tfidf", F.round("tfidf", 6))


@query("bpe_pair_counts", f"""
select "left", "right", count(*) as n
from (select substr(sentence, cast(i as int), 1) as "left", substr(sentence, cast(i as int) + 1, 1) as "right"
      from (select seq as sentence, unnest(range(1, length(seq))) as i from contigs))
group by 1, 2""")
def _(t):
    return bpe_pair_counts(t.contigs(), "seq")


@query("vocabulary_stats", r"""
select count(*) as n_words, min(len) as min_len, max(len) as max_len, round(avg(len), 6) as mean_len,
       round(stddev_samp(len), 6) as std_len, median(len) as median_len,
       (select len from (select length(w) as len, count(*) as n from (
          select distinct unnest(string_split_regex(text, '\s+')) as w from documents) where length(w) >= 3
          group by 1 order by n desc, len limit 1)) as mode_len,
       count(*) filter (len > 8) as n_long, round(count(*) filter (len > 8) * cast(100 as double) / count(*), 6) as pct_long
from (select length(w) as len from (select distinct unnest(string_split_regex(text, '\s+')) as w from documents))
where len >= 3""")
def _(t):
    from helixbag.operators.bpe import vocabulary_stats
    from helixbag.session import spread

    words = spread(t.read("documents").select("text")).select(F.explode(F.split("text", r"\s+")).alias("term"))
    out = vocabulary_stats(words.distinct())
    for c in ("mean_len", "std_len", "pct_long"):
        out = out.withColumn(c, F.round(c, 6))
    return out


@query("assemble_features", """
select genome, count(*) as n_terms, round(sum(tfidf * tfidf), 6) as norm2, round(sum(idx * tfidf), 4) as idx_sum
from tfidf3 group by genome""")
def _(t):
    from pyspark.ml.functions import vector_to_array

    from helixbag.operators.features import assemble_features

    tf, vocab = fitted3(t)
    dense = assemble_features(T.tfidf_transform(tf, vocab, 64), 64).select("genome", vector_to_array("features").alias("v"))
    add = lambda a, x: a + x
    return dense.select(
        "genome", F.size(F.filter("v", lambda x: x > 0)).cast("bigint").alias("n_terms"),
        F.round(F.aggregate(F.transform("v", lambda x: x * x), F.lit(0.0), add), 6).alias("norm2"),
        F.round(F.aggregate(F.transform("v", lambda x, i: x * i), F.lit(0.0), add), 4).alias("idx_sum"),
    )
