"""Queries that write the test tables in the file formats of a study and read them back."""

from pyspark.sql import functions as F

from helixbag.catalog.registry import query
from helixbag.operators import features as X
from helixbag.operators.metrics import hard_label
from helixbag.operators import terms as T
from helixbag.session import materialize, scratch_path
from helixbag.sources import files as S
from helixbag.streaming import ingest as I


@query("read_metadata", "select * from genomes")
def _(t):
    path = scratch_path(t.spark, "metadata")
    S.write_metadata(t.genomes(), path)
    return S.read_metadata(t.spark, path)


@query("read_metadata_by_name", "select * from genomes")
def _(t):
    # Columns in another order and case, with one that no schema names.
    path = scratch_path(t.spark, "metadata")
    named = [F.col(c).alias(c.capitalize()) for c in reversed(t.genomes().columns)]
    t.genomes().select(F.lit("x").alias("Note"), *named).write.option("header", True).csv(path)
    return S.read_metadata(t.spark, path)


@query("read_predictions", """
select genome, target, cast(round_even(probability, 0) as int) as prediction, probability, part_name
from predictions where part_name = '1-URGENT'
union all select genome, target, cast(round_even(probability, 0) as int), probability, 'other'
from predictions where part_name <> '1-URGENT'""")
def _(t):
    # Both layouts: with a probability column, and with the probability as the prediction.
    rows, paths = t.predictions(), [scratch_path(t.spark, "predictions") for _ in range(2)]
    S.write_predictions(rows.where("part_name = '1-URGENT'").withColumn("prediction", hard_label(F.col("probability"))), paths[0])
    short = rows.where("part_name <> '1-URGENT'").select(
        F.col("target").alias("Target"), F.col("genome").alias("Genome"), F.col("probability").alias("Prediction"))
    short.write.option("header", True).csv(paths[1])
    found = [S.read_predictions(t.spark, p).withColumn("part_name", F.lit(n)) for p, n in zip(paths, ("1-URGENT", "other"))]
    return found[0].unionByName(found[1])


@query("read_gff3_odd_lines", """
select genome, seqid, start_pos, end_pos, case when start_pos % 5 > 0 then locus_tag end as locus_tag from loci""")
def _(t):
    # Attributes that repeat, blanks after semicolons, loci without a tag, and a sequence section behind each genome.
    path = scratch_path(t.spark, "gff3")
    loci = t.loci()
    tag = F.when(F.col("start_pos") % 5 > 0, F.concat(F.lit("; locus_tag="), "locus_tag")).otherwise("")
    attributes = F.concat(F.lit("Dbxref=A:1;Dbxref=B:2;old_locus_tag=none"), tag, S.gff3_genome())
    fields = ["seqid", F.lit("annotation"), F.lit("gene"), F.col("start_pos").cast("string"),
              F.col("end_pos").cast("string"), F.lit("."), F.lit("+"), F.lit("."), attributes]
    line = F.concat_ws("\t", *fields)
    tail = F.explode(F.array(*map(F.lit, ("##FASTA", ">c0", "ACGT"))))
    rows = loci.select("genome", F.lit(0).alias("_at"), line.alias("value")).union(
        loci.select("genome").distinct().select("genome", F.lit(1), tail))
    rows.repartition("genome").sortWithinPartitions("genome", "_at").select("value").write.text(path)
    return S.read_gff3(t.spark, path)


@query("read_fasta_blank_names", """
select genome, row_number() over (partition by genome order by contig_idx) - 1 as contig_idx, seqid, length(seq) as bases
from contigs""")
def _(t):
    # A tab ends the name as a blank does, and a blank may stand before it.
    path = scratch_path(t.spark, "fasta")
    named = F.concat(F.lit(" "), "seqid", F.lit("\tlen=4 > x"))
    S.write_fasta(t.contigs().withColumn("description", named), path)
    return S.read_fasta(t.spark, path).select("genome", "contig_idx", "seqid", F.length("seq").alias("bases"))


@query("read_gene_list_gaps", """
with genes as (select gene, row_number() over (order by gene) - 1 as place from ko group by gene)
select gene as locus_tag, 2 * place as pos from genes
union all select '', 2 * place + 1 from genes where place < (select max(place) from genes)""")
def _(t):
    # An empty line between all genes: only the one behind the last line end is no gene.
    path = scratch_path(t.spark, "genes")
    genes = t.ko().select("gene").distinct().agg(F.array_join(F.array_sort(F.collect_list("gene")), "\n\n").alias("value"))
    genes.coalesce(1).write.text(path)
    return S.read_gene_list(t.spark, path)


def fasta_copy(t):
    path = scratch_path(t.spark, "fasta")
    S.write_fasta(t.contigs().withColumn("description", F.concat("seqid", F.lit(" a > b"))), path)
    return S.read_fasta(t.spark, path)


@query("read_fasta", """
select genome, row_number() over (partition by genome order by contig_idx) - 1 as contig_idx, seqid,
       concat(seqid, ' a > b') as description, seq from contigs""")
def _(t):
    return fasta_copy(t)


@query("write_fasta", "select genome, count(*) as n_contigs, sum(length(seq)) as bases from contigs group by genome")
def _(t):
    return fasta_copy(t).groupBy("genome").agg(
        F.count(F.lit(1)).alias("n_contigs"), F.sum(F.length("seq")).alias("bases")
    )


@query("read_gff3", "select genome, seqid, start_pos, end_pos, locus_tag from loci")
def _(t):
    path = scratch_path(t.spark, "gff3")
    S.write_gff3(t.loci(), path)
    return S.read_gff3(t.spark, path)


@query("read_gene_list", "select gene as locus_tag, row_number() over (order by gene) - 1 as pos from ko group by gene")
def _(t):
    path = scratch_path(t.spark, "genes")
    t.ko().select(F.col("gene").alias("value")).distinct().coalesce(1).sortWithinPartitions("value").write.text(path)
    return S.read_gene_list(t.spark, path)


@query("read_tsv_dim", "select id, clonal_complex from clonal")
def _(t):
    path = scratch_path(t.spark, "dimension")
    t.clonal().write.option("header", True).option("sep", "\t").csv(path)
    return S.read_dimension(t.spark, path, "id bigint, clonal_complex string", sep="\t")


@query("read_results_glob", "select genome, gene, original, removed, delta, length from ko")
def _(t):
    path = scratch_path(t.spark, "results")
    ko = t.ko().withColumn("folder", F.col("gene")).drop("gene")
    ko.repartition("folder").write.partitionBy("folder").option("header", True).csv(path)
    schema = "genome bigint, original double, removed double, delta double, length bigint"
    return S.read_results_glob(t.spark, path, schema)


@query("collect_run_metrics", """
select replace(task, ' ', '_') as task, replace(method, '#', '_') as method, vocab_size, val_accuracy as accuracy,
       round(val_accuracy / 2, 6) as roc_auc, round(val_accuracy / 4, 6) as matthews_corrcoef from runs""")
def _(t):
    path = scratch_path(t.spark, "runs")
    score = F.col("val_accuracy")
    runs = t.runs().select(
        F.replace("task", F.lit(" "), F.lit("_")).alias("task"), F.replace("method", F.lit("#"), F.lit("_")).alias("method"),
        "vocab_size",
        *[
            (F.round(score / {"accuracy": 1, "roc_auc": 2, "matthews_corrcoef": 4}[m], 6) if s == "val" else F.lit(0.0))
            .alias(f"{s}_{m}") for m in ("accuracy", "matthews_corrcoef", "roc_auc") for s in ("train", "val", "test")
        ],
    )
    keys = ["task", "method", "vocab_size"]
    runs.repartition(*keys).write.partitionBy(*keys).option("header", True).csv(path)
    return S.collect_run_metrics(t.spark, path)


@query("write_if_absent", "select * from clonal")
def _(t):
    path = scratch_path(t.spark, "absent")
    S.write_if_absent(t.clonal(), path)
    S.write_if_absent(t.clonal().withColumn("clonal_complex", F.lit("changed")), path)
    return t.spark.read.parquet(path)


@query("save_load_features", """
select genome, idx, round(tfidf, 6) as tfidf, case when genome % 3 = 0 then 'test' else 'training' end as partition from tfidf3""")
def _(t):
    path = scratch_path(t.spark, "features")
    tf = materialize(T.kmer_counts(t.contigs(), 3, 3), "tf")
    vocab = T.idf_fit(tf, t.contigs().select("genome"), bound=64)
    part = F.when(F.col("genome") % 3 == 0, "test").otherwise("training").alias("partition")
    weights = T.tfidf_transform(tf, vocab, 64).select("genome", "idx", F.round("tfidf", 6).alias("tfidf"), part)
    S.save_features(weights, path)
    return S.load_features(t.spark, path, "test").unionByName(S.load_features(t.spark, path, "training"))


@query("save_load_vectorizer", "select genome, idx, term, round(tfidf, 6) as tfidf from tfidf3")
def _(t):
    counter = X.KmerCounter(3, 3)
    path = scratch_path(t.spark, "vectorizer")
    tf = materialize(counter.counts(t.contigs()), "tf")
    X.TfidfVectorizer(counter).fit_counts(tf, t.contigs().select("genome")).save(path)
    model = X.TfidfModel.load(t.spark, path, counter)
    return model.transform_counts(tf).withColumn("tfidf", F.round("tfidf", 6))


FIRST = "(select id, isolate from genomes order by id desc limit 150)"


@query("incremental_ingest_first", f"""
select id, isolate, id not in (select id from genomes where complete = 1) as fetched from {FIRST}
where id in (select id from genomes where complete = 1) or id in (select doc_id from labels)""")
def _(t):
    # The first lines of a file whose order is not that of its ids.
    path = scratch_path(t.spark, "listed")
    t.genomes().coalesce(1).sortWithinPartitions(F.desc("id")).write.option("header", True).csv(path)
    listed = S.read_metadata(t.spark, path).select("id", "isolate")
    landed, available = t.genomes().where("complete = 1").select("id"), t.read("labels").select(F.col("doc_id").alias("id"))
    fetch, keep = I.incremental_ingest(listed, landed, available, max_num=150)
    return keep.join(fetch.select("id", F.lit(True).alias("_new")), "id", "left").select(
        "id", "isolate", F.coalesce("_new", F.lit(False)).alias("fetched"))


LANDED = "select id from genomes where complete = 1"
AVAILABLE = "select doc_id as id from labels"


def arrivals(t):
    landed = t.genomes().where("complete = 1").select("id")
    available = t.read("labels").select(F.col("doc_id").alias("id"))
    return I.incremental_ingest(t.genomes().select("id", "isolate"), landed, available)


@query("incremental_ingest", f"""
select id, isolate, concat('data/raw/fasta/', id, '.fasta') as path from genomes
where id in ({LANDED}) or id in ({AVAILABLE})""")
def _(t):
    return I.attach_path(arrivals(t)[1])


@query("incremental_ingest_missing", f"""
select id, isolate from genomes where id not in ({LANDED}) and id in ({AVAILABLE})""")
def _(t):
    return arrivals(t)[0]


@query("incremental_ingest_stream", """
select user_id, min(event_id) as event_id from events group by user_id""")
def _(t):
    # The events folder read as a stream of arriving users; a user lands once, with its first event.
    schema = t.read("events").schema
    stream = t.spark.readStream.schema(schema).parquet(f"{t.folder}/events*.parquet").select("user_id", "event_id")
    landed = scratch_path(t.spark, "landed")
    run = I.ingest_stream(stream, landed, scratch_path(t.spark, "ingest"), "user_id")
    run.awaitTermination()
    return t.spark.read.parquet(landed).drop("batch")
