"""Queries of fitted models: subword vocabularies, classifiers and scored knockouts."""

from pyspark.sql import functions as F

from helixbag.catalog.cohorts import labelled
from helixbag.catalog.registry import query
from helixbag.catalog.sequences import (
    BOUNDARY, LOCATED, LONG_MERGES, LONG_MODEL, cut_sql, encode_sql, kmers_sql, panel, weights_sql,
)
from helixbag.operators import features as X
from helixbag.operators import knockout as K
from helixbag.operators.bpe import bpe_train
from helixbag.operators.forest import LEAF, Forest
from helixbag.operators.loci import GENE_PADDING, locate_genes
from helixbag.operators.resync import subword_counter
from helixbag.operators.stages import KmerVectorizer
from helixbag.operators.terms import zip_importances
from helixbag.session import materialize, scratch_path
from helixbag.sources.files import load_model, save_model

SMALL = {"max_bin": 16, "max_depth": 4, "n_estimators": 5, "num_leaves": 16}


def vectors(t):
    """Embedding vectors with a target and a hashed partition."""
    from pyspark.ml.functions import array_to_vector

    part = F.when(F.pmod(F.xxhash64("vec_id"), F.lit(5)) == 0, "test").when(
        F.pmod(F.xxhash64("vec_id"), F.lit(5)) == 1, "validation").otherwise("training")
    return t.read("embeddings").select(
        F.col("vec_id").alias("genome"), array_to_vector(F.col("embedding").cast("array<double>")).alias("features"),
        (F.col("label") < 5).cast("int").alias("label"), part.alias("partition"),
    )


@query("bpe_train")
def _(t):
    model = bpe_train(t.contigs(), 2_000, text="seq")
    return model.vocabulary(t.spark)


@query("train_classifier")
def _(t):
    data = vectors(t)
    model = X.train_classifier(data.where("partition <> 'test'"), **SMALL)
    return X.predict_proba(model, data)


@query("save_load_model")
def _(t):
    data = vectors(t)
    path = scratch_path(t.spark, "model")
    save_model(X.train_classifier(data.where("partition <> 'test'"), **SMALL), path)
    return X.predict_proba(load_model(path), data)


def separable(t):
    """Parts whose label follows from one of two features, so every classifier that splits there is right."""
    from pyspark.ml.functions import array_to_vector

    part = F.when(F.col("p_partkey") % 5 == 0, "test").when(F.col("p_partkey") % 5 == 1, "validation").otherwise("training")
    features = F.array(F.col("p_size").cast("double"), F.col("p_retailprice").cast("double"))
    return t.read("part").select(F.col("p_partkey").alias("genome"), array_to_vector(features).alias("features"),
                                 (F.col("p_size") > 25).cast("int").alias("label"), part.alias("partition"))


# Enough bins for every size, so that a tree can split between 25 and 26.
SPLIT = {"max_bin": 64, "max_depth": 2, "n_estimators": 2, "num_leaves": 4}
SEPARATED = "select p_partkey as genome, cast(p_size > 25 as int) as target, cast(p_size > 25 as int) as prediction from part"


@query("train_classifier_separable", SEPARATED)
def _(t):
    data = separable(t)
    return X.predict_proba(X.train_classifier(data, **SPLIT), data).select("genome", "target", "prediction")


@query("save_load_model_separable", SEPARATED)
def _(t):
    data, path = separable(t), scratch_path(t.spark, "model")
    save_model(X.train_classifier(data, **SPLIT), path)
    return X.predict_proba(load_model(path), data).select("genome", "target", "prediction")


@query("predict_proba_separable", """
select genome, target, prediction, prediction as rounded, true as certain from (""" + SEPARATED + ")")
def _(t):
    data = separable(t)
    found = X.predict_proba(X.train_classifier(data, **SPLIT), data)
    p = F.col("probability")
    return found.select("genome", "target", "prediction", F.bround(p, 0).cast("int").alias("rounded"),
                        ((p > 0.8) | (p < 0.2)).alias("certain"))


@query("random_search_separable", """
select trial, cast(1 as double) as mean_train_accuracy, cast(1 as double) as mean_test_accuracy,
       cast(1 as double) as mean_test_roc_auc from (select unnest(range(4)) as trial) where exists (select 1 from part)""")
def _(t):
    space = {"max_bin": (64, 80), "max_depth": (2, 4), "n_estimators": (2, 4), "num_leaves": (4, 16)}
    table, _ = X.random_search(separable(t), X.draw_trials(4, space=space))
    return table.select("trial", "mean_train_accuracy", "mean_test_accuracy", "mean_test_roc_auc")


def merges_sql(n):
    """The first merges by counting all pairs, joining the commonest, and counting again."""
    parts = ["""state0 as materialized (
    select concat('|', array_to_string(list_filter(string_split(seq, ''), lambda c: c <> ''), '||'), '|') as s from contigs)"""]
    for i in range(n):
        parts.append(f"""pairs{i} as (
    select t[cast(k as int)] as "left", t[cast(k as int) + 1] as "right", count(*) as n
    from (select t, unnest(range(1, len(t))) as k from (select string_split(substr(s, 2, length(s) - 2), '||') as t from state{i}))
    group by 1, 2),
top{i} as materialized (select "left", "right" from pairs{i} order by n desc, "left", "right" limit 1),
state{i + 1} as materialized (
    select replace(s, concat('|', "left", '||', "right", '|'), concat('|', "left", "right", '|')) as s from state{i} cross join top{i})""")
    rows = " union all ".join(f'select {i} as rank, "left", "right" from top{i}' for i in range(n))
    return f"with {', '.join(parts)} {rows}"


@query("bpe_train_merges", merges_sql(3))
def _(t):
    letters = t.contigs().select(F.explode(F.array_distinct(F.split("seq", ""))).alias("c")).where("c <> ''").distinct()
    known = {r["c"] for r in letters.collect()} | set("ACGTX")
    model = bpe_train(t.contigs(), len(known) + 3, text="seq")
    return t.spark.createDataFrame([(i, *m) for i, m in enumerate(model.merges)], "rank long, left string, right string")


@query("random_search")
def _(t):
    space = {"max_bin": (4, 32), "max_depth": (2, 5), "n_estimators": (2, 5), "num_leaves": (4, 32)}
    table, _ = X.random_search(vectors(t), X.draw_trials(3, space=space))
    return table.drop("mean_fit_time", "mean_score_time")


@query("vectorizer_pipeline", "select genome, idx, tfidf from (" + weights_sql(
    kmers_sql("talk", 3) + " union all " + kmers_sql("talk", 4)) + ")")
def _(t):
    """Weights of a vectorizer that was fitted in a pipeline, saved and loaded."""
    from pyspark.ml import Pipeline, PipelineModel
    from pyspark.ml.functions import vector_to_array

    talk, path = t.conversation_contigs().select("genome", "seq"), scratch_path(t.spark, "pipeline")
    Pipeline(stages=[KmerVectorizer(kMin=3, kMax=4)]).fit(talk).write().save(path)
    found = PipelineModel.load(path).transform(talk)
    weights = found.select("genome", F.posexplode(vector_to_array("features")).alias("idx", "tfidf")).where("tfidf <> 0")
    return weights.select("genome", F.col("idx").cast("bigint").alias("idx"), F.round("tfidf", 6).alias("tfidf"))


class Study:
    """A small fitted study over the whole test tables: 3-mer features and a classifier of the disease label."""

    def __init__(self, t):
        counter = X.KmerCounter(3, 3)
        t.stored()
        self.contigs = t.contigs()
        self.loci = materialize(t.loci(), "loci")
        self.tf = materialize(counter.counts(self.contigs), "tf")
        self.vectorizer = X.TfidfVectorizer(counter).fit_counts(self.tf, self.contigs.select("genome"))
        features = X.assemble_features(self.vectorizer.transform_counts(self.tf), self.vectorizer.size)
        self.data = materialize(
            X.with_empty_documents(features, labelled(t).select("genome", "label"), self.vectorizer.size), "data"
        )
        self.classifier = X.train_classifier(self.data, **SMALL)
        self.predictions = materialize(X.predict_proba(self.classifier, self.data), "predictions")


def single_gene_changes(t):
    """3-mer counts, their changes and the jobs of every genome with every located panel gene masked alone, and the model."""
    t.stored()
    counter = X.KmerCounter(3, 3)
    tf = materialize(counter.counts(t.contigs()), "tf")
    model = X.TfidfVectorizer(counter).fit_counts(tf, t.contigs().select("genome"))
    located = materialize(locate_genes(t.contigs(), t.loci(), panel(t)).withColumn("target", F.col("locus_tag")), "located")
    changes = K.term_changes(t.contigs(), located, GENE_PADDING, counter, vocab=model.vocab)
    return tf, changes, located.select("genome", "target", "length"), model


def after_single_genes(t):
    """Features of these genomes, their model and jobs."""
    tf, changes, jobs, model = single_gene_changes(t)
    return K.knockout_features(tf, changes, jobs, model), model, jobs


AFTER = f"""
located as materialized ({LOCATED}),
touched as (
    select l.genome, l.locus_tag as target, c.contig_idx, {cut_sql('greatest("start" - 10, 0)', 'least("end" + 10, length(seq))')} as seq
    from located l join contigs c on l.genome = c.genome and l.contig_idx = c.contig_idx),
texts as (
    select * from touched
    union all select c.genome, l.locus_tag, c.contig_idx, c.seq
    from contigs c join located l on c.genome = l.genome and c.contig_idx <> l.contig_idx),
counted as (
    select genome, target, substr(seq, cast(i as int), 3) as term, count(*) as tf
    from (select *, unnest(range(1, length(seq) - 1)) as i from texts)
    where regexp_full_match(substr(seq, cast(i as int), 3), '[ACGT]{{3}}') group by 1, 2, 3),
after_rows as (
    select genome, target, idx, tf * idf / sqrt(sum(tf * idf * tf * idf) over (partition by genome, target)) as weight
    from counted join vocab3 using (term))"""


@query("knockout_features", f"with {AFTER} select genome, target, idx, round(weight, 6) as weight from after_rows")
def _(t):
    features, _, _ = after_single_genes(t)
    return K.long_features(features).withColumn("weight", F.round("weight", 6))


# A fixed weight per feature stands for a classifier, so that scores can be computed anew in SQL.
@query("knockout_linear", f"""
with {AFTER},
scores as (
    select genome, target, 1 / (1 + exp(-(sum(weight * ((idx * 37 % 19) - 9)) / 4))) as removed from after_rows group by 1, 2),
before as (select genome, 1 / (1 + exp(-(sum(tfidf * ((idx * 37 % 19) - 9)) / 4))) as original from tfidf3 group by genome)
select s.genome, s.target as gene, round(original, 6) as original, round(removed, 6) as removed,
       round(original - removed, 6) as delta, length
from scores s join before b using (genome) join located l on s.genome = l.genome and s.target = l.locus_tag""")
def _(t):
    features, model, located = after_single_genes(t)
    weights = model.vocab.select("idx", (((F.col("idx") * 37 % 19) - 9) / F.lit(4.0)).alias("importance"))
    after = K.linear_score(K.long_features(features), weights).withColumnRenamed("probability", "after")
    own = model.transform(t.contigs()).select("genome", "idx", F.col("tfidf").alias("weight"))
    before = K.linear_score(own, weights, keys=["genome"]).withColumnRenamed("probability", "original")
    ko = located.select("genome", "target", "length").join(before, "genome").join(after, ["genome", "target"])
    out = K.knockout_delta(ko).select("genome", F.col("target").alias("gene"), "original", "removed", "delta", "length")
    for c in ("original", "removed", "delta"):
        out = out.withColumn(c, F.round(c, 6))
    return out


# Trees of a fixed rule stand for a fitted model: (index, threshold) of the root and of both children, and four leaf values.
TREES = [(((t * 7 % 64, (50 + 13 * t) / 1000), (t * 11 % 64, (40 + 11 * t) / 1000), (t * 5 % 64, (300 - 9 * t) / 1000)),
          [((t * 13 + 5 * k) % 17 - 8) / 40 for k in range(4)]) for t in range(24)]


def forest_nodes():
    rows = []
    for t, (splits, values) in enumerate(TREES):
        rows += [(t, i, 2 * i + 1, 2 * i + 2, index, threshold, 0.0) for i, (index, threshold) in enumerate(splits)]
        rows += [(t, 3 + i, -1, -1, LEAF, 0.0, value) for i, value in enumerate(values)]
    return rows


def tree_sql(splits, values):
    tests = [f"coalesce(w{index}, 0) <= cast({threshold} as double)" for index, threshold in splits]
    return (f"case when {tests[0]} then case when {tests[1]} then {values[0]} else {values[1]} end "
            f"else case when {tests[2]} then {values[2]} else {values[3]} end end")


@query("knockout_forest", f"""
with {AFTER},
wide as (select genome, target, {', '.join(f'max(weight) filter (idx = {i}) as w{i}' for i in range(64))} from after_rows group by 1, 2)
select l.genome, l.locus_tag as target,
       round(1 / (1 + exp(-2 * cast({' + '.join(tree_sql(*tree) for tree in TREES)} as double))), 6) as probability
from located l left join wide w on l.genome = w.genome and l.locus_tag = w.target""")
def _(t):
    tf, changes, jobs, model = single_gene_changes(t)
    idf = {r["idx"]: r["idf"] for r in model.vocab.select("idx", "idf").collect()}
    scores = K.forest_scores(tf, changes, jobs, model, Forest.from_nodes(forest_nodes(), idf))
    return scores.withColumn("probability", F.round("probability", 6))


# Every masked contig beside its original, encoded whole by replacements in rank order; the sign stands for the contig.
SIDES = f"""
select concat(l.genome, '/', l.locus_tag) as genome, side as contig_idx,
       case when side = 1 then {cut_sql('greatest("start" - 10, 0)', 'least("end" + 10, length(seq))')} else seq end as seq
from ({LOCATED}) l join contigs c on l.genome = c.genome and l.contig_idx = c.contig_idx cross join (values (1), (-1)) s(side)"""


@query("knockout_subwords", f"""
select cast(split_part(genome, '/', 1) as bigint) as genome, split_part(genome, '/', 2) as target, term,
       cast(sum(contig_idx) as bigint) as tf
from ({encode_sql(f'({SIDES})', LONG_MERGES)}) where length(term) > 2 and not contains(term, 'X')
group by 1, 2, 3 having sum(contig_idx) <> 0""")
def _(t):
    t.stored()
    located = locate_genes(t.contigs(), t.loci(), panel(t)).withColumn("target", F.col("locus_tag"))
    return K.term_changes(t.contigs(), located, GENE_PADDING, subword_counter(LONG_MODEL, t.spark))


@query("predict_proba")
def _(t):
    return Study(t).predictions


@query("feature_importances")
def _(t):
    s = Study(t)
    return zip_importances(s.vectorizer.vocab, X.feature_importances(s.classifier, t.spark))


@query("knockout_gene")
def _(t):
    s = Study(t)
    return K.knockout_gene(s.predictions, s.contigs, s.loci, panel(t), s.vectorizer, s.classifier, base_tf=s.tf)


@query("knockout_panel")
def _(t):
    s = Study(t)
    args = (s.predictions, s.contigs, s.loci, panel(t), s.vectorizer, s.classifier)
    return K.knockout_panel(*args, base_tf=s.tf).unionByName(K.knockout_panel(*args, control=True, base_tf=s.tf))


@query("knockout_capsule")
def _(t):
    s = Study(t)
    args = (s.predictions, s.contigs, s.loci, s.vectorizer, s.classifier)
    return K.knockout_capsule(*args, boundary=BOUNDARY, base_tf=s.tf).unionByName(
        K.knockout_capsule(*args, control=True, boundary=BOUNDARY, base_tf=s.tf)
    )
