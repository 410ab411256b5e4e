"""Knockout experiments: mask, count only what changed, score again, compare."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from helixbag.functions.sequence import mask_intervals
from helixbag.operators import loci as L
from helixbag.operators.features import KmerCounter, TfidfModel
from helixbag.operators.forest import Forest, score_jobs
from helixbag.operators.genome_jobs import genome_rows, job_vectors
from helixbag.operators.resync import SubwordCounter, masked_spans, parts_around
from helixbag.operators.terms import DEALT_FROM, kmer_words, tally_windows, window_prefixes
from helixbag.session import checked_broadcast, small_batches

KEYS = ("genome", "target")
# The tasks whose predictions a knockout may start from.
TASK_NAMES = ("capsule", "invasive", "carriage")


def filter_predictions(predictions: DataFrame, task: str, threshold: float = 0.0,
                       fasta_root: str = "data/raw/fasta", gff3_root: str = "data/raw/gff3") -> DataFrame:
    """Confident predictions of a task with the paths of their files.

    capsule and invasive keep p >= threshold, carriage keeps p < 1 - threshold.
    """
    if task not in TASK_NAMES:
        raise ValueError(f"no task {task}; tasks are {', '.join(TASK_NAMES)}")
    score = F.col("probability")
    confident = score < 1 - threshold if task == "carriage" else score >= threshold
    name = F.col("genome").cast("string")
    return predictions.where(confident).select(
        "*", F.concat(F.lit(f"{fasta_root}/"), name, F.lit(".fasta")).alias("fasta"),
        F.concat(F.lit(f"{gff3_root}/"), name, F.lit(".gff3")).alias("gff3"),
    )


def drop_unscored(ko: DataFrame) -> DataFrame:
    return ko.where(F.col("after").isNotNull())


def targeted_contigs(contigs: DataFrame, located: DataFrame) -> DataFrame:
    """(genome, seq, _targets) of the contigs that any target cuts, each joined once for all its targets.

    ``located`` has genome, target, contig_idx, pos, start and end. A contig has one target per panel gene at most.
    """
    cuts = L.ordered_cuts(located, "genome", "target", "contig_idx")
    listed = cuts.groupBy("genome", "contig_idx").agg(F.collect_list(F.struct("target", "_cuts")).alias("_targets"))
    return contigs.join(listed.hint("shuffle_hash"), ["genome", "contig_idx"]).select("genome", "seq", "_targets")


def changed_contigs(contigs: DataFrame, located: DataFrame, padding: int, all_copies: bool = True,
                    margin: int | None = None) -> DataFrame:
    """What a target changes in contigs, before and after: (genome, target, seq, masked).

    Contigs no target touches never enter. Terms of at most ``margin`` + 1 letters change only around masked stretches, so
    with a margin only these parts come out, and the rest of a contig is never counted again; without one, whole contigs do.
    """
    if margin is not None:
        return _masked_parts(targeted_contigs(contigs, located), padding, all_copies, margin)
    each = targeted_contigs(contigs, located).select("genome", "seq", F.inline("_targets"))
    masked = mask_intervals(F.col("seq"), F.col("_cuts"), padding, all_copies)
    return each.select("genome", "target", "seq", masked.alias("masked")).where("masked <> seq")


def _masked_parts(targeted: DataFrame, padding: int, all_copies: bool, margin: int) -> DataFrame:
    """(genome, target, seq, masked): the stretches that a target masks with ``margin`` letters on both sides, those whose
    margins would meet or overlap being one part."""
    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            places, targets, _, before, after = _cut_parts(batch, padding, all_copies, margin)
            yield pa.RecordBatch.from_arrays(
                [batch.column("genome").take(pa.array(places, pa.int64())), *[pa.array(c, pa.string()) for c in (targets, before, after)]],
                schema=pa.schema([batch.schema.field("genome"), *[pa.field(c, pa.string()) for c in ("target", "seq", "masked")]]))

    small_batches(targeted.sparkSession)
    texts = [T.StructField(c, T.StringType()) for c in ("target", "seq", "masked")]
    return targeted.select("genome", "seq", "_targets").where("seq is not null").mapInArrow(
        batches, T.StructType([targeted.schema["genome"], *texts]))


def _cut_parts(batch: pa.RecordBatch, padding: int, all_copies: bool, margin: int) -> tuple[list, ...]:
    """The changed parts of a batch of targeted contigs: the row, the target, the number of the target of a contig, and the
    part before and after."""
    places, targets, numbers, before, after = [], [], [], [], []
    number = 0
    for i, (seq, jobs) in enumerate(zip(batch.column("seq").to_pylist(), batch.column("_targets").to_pylist())):
        for job in jobs:
            for text, masked in parts_around(seq, masked_spans(seq, job["_cuts"], padding, all_copies), margin):
                if text != masked:
                    places.append(i), targets.append(job["target"]), numbers.append(number)
                    before.append(text), after.append(masked)
            number += 1
    return places, targets, numbers, before, after


def _listed_changes(targeted: DataFrame, padding: int, all_copies: bool, counter: KmerCounter, vocab: DataFrame) -> DataFrame:
    """(genome, target, idx, n, idf): lists of the known k-mers whose counts a target changes in one contig, and by how much.

    Parts are cut and counted in the same batch, so no k-mer becomes a row; what several contigs change of one term is added
    up where the genome's jobs are read.
    """
    k_min, k_max = counter.k_min, counter.k_max
    words = kmer_words(k_min, k_max)
    # At most one row per word of less than DEALT_FROM letters.
    known = {r["term"]: r for r in vocab.select("term", "idx", "idf").collect()}
    index = np.array([known[w]["idx"] if w in known else -1 for w in words], dtype=np.int64)
    weight = np.array([known[w]["idf"] if w in known else 0.0 for w in words], dtype=float)

    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            places, targets, numbers, before, after = _cut_parts(batch, padding, all_copies, counter.margin)
            if not places:
                continue
            # The parts of one target of a contig are neighbours and make one row.
            _, firsts, group = np.unique(np.array(numbers), return_index=True, return_inverse=True)
            keys, by = [], []
            for texts, sign in ((before, -1), (after, 1)):
                parts = pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], names=["seq"])
                groups, windows, counts = tally_windows(parts, group, len(firsts), k_min, k_max)
                at, found = window_prefixes(windows, k_min, k_max)
                keys.append(groups[at] * len(words) + found), by.append(sign * counts[at])
            cells, where = np.unique(np.concatenate(keys), return_inverse=True)
            change = np.bincount(where, np.concatenate(by), len(cells)).astype(np.int64)
            held = (change != 0) & (index[cells % len(words)] >= 0)
            cells, change = cells[held], change[held]
            found = cells % len(words)
            starts = pa.array(np.append(0, np.cumsum(np.bincount(cells // len(words), minlength=len(firsts)))), pa.int32())
            lists = [pa.ListArray.from_arrays(starts, values) for values in (
                pa.array(index[found], pa.int64()), pa.array(change, pa.int64()), pa.array(weight[found], pa.float64()))]
            yield pa.RecordBatch.from_arrays(
                [batch.column("genome").take(pa.array(places, pa.int64()).take(pa.array(firsts))),
                 pa.array(targets, pa.string()).take(pa.array(firsts)), *lists],
                names=["genome", "target", "idx", "n", "idf"])

    small_batches(targeted.sparkSession)
    longs = T.ArrayType(T.LongType())
    return targeted.select("genome", "seq", "_targets").where("seq is not null").mapInArrow(batches, T.StructType(
        [targeted.schema["genome"], T.StructField("target", T.StringType()), T.StructField("idx", longs),
         T.StructField("n", longs), T.StructField("idf", T.ArrayType(T.DoubleType()))]))


def count_changes(changed: DataFrame, counter) -> DataFrame:
    """Change of each term count per (genome, target): masked contigs counted up, their originals down."""
    sides = F.explode(F.array(
        F.struct(F.col("masked").alias("seq"), F.lit(1).alias("by")),
        F.struct(F.col("seq").alias("seq"), F.lit(-1).alias("by")),
    ))
    rows = changed.select(*KEYS, sides.alias("_s")).select(*KEYS, "_s.seq", "_s.by")
    return counter.counts(rows, KEYS, sign=F.col("by")).where("tf <> 0")


def term_changes(contigs: DataFrame, located: DataFrame, padding: int, counter, all_copies: bool = True,
                 vocab: DataFrame | None = None) -> DataFrame:
    """Change of each term count per (genome, target), by what of a contig the counter has to read again: the parts around
    masks for k-mers, tokens up to the next common border for subwords of a model, whole contigs for other tokens.

    With a vocabulary, changes of short k-mers come as lists (genome, target, idx, n, idf), one row per target and contig.
    """
    if isinstance(counter, SubwordCounter):
        return counter.changes(targeted_contigs(contigs, located), padding, all_copies)
    if vocab is not None and isinstance(counter, KmerCounter) and counter.k_max < DEALT_FROM:
        return _listed_changes(targeted_contigs(contigs, located), padding, all_copies, counter, vocab)
    return count_changes(changed_contigs(contigs, located, padding, all_copies, counter.margin), counter)


def knockout_features(base_tf: DataFrame, changes: DataFrame, jobs: DataFrame, model: TfidfModel) -> DataFrame:
    """Feature vectors of knocked-out genomes without counting whole genomes again.

    tf(new) = tf(genome) + change, exactly, because terms never span contigs. A genome meets its counts once, with all its
    jobs. A job without changes keeps its vector.
    """
    return job_vectors(genome_rows(base_tf, changes, jobs, model), jobs, model.size)


def forest_scores(base_tf: DataFrame, changes: DataFrame, jobs: DataFrame, model: TfidfModel, forest: Forest) -> DataFrame:
    """Scores (genome, target, probability) of knocked-out genomes from their changed features.

    Each genome meets its features once, with all its jobs, of which it has one per target; the squared norm is corrected by
    the changed terms of the whole vocabulary, and trees see those that they split on.
    """
    return score_jobs(genome_rows(base_tf, changes, jobs.select(*KEYS), model), forest)


def linear_score(features: DataFrame, weights: DataFrame, bias: float = 0.0, keys: Sequence[str] = KEYS) -> DataFrame:
    """Scores of long features (keys, idx, weight) by a fixed weight per feature (idx, importance): 1 / (1 + exp(-sum))."""
    total = F.sum(F.col("weight") * F.col("importance")) + bias
    return features.join(weights.select("idx", "importance"), "idx").groupBy(*keys).agg(
        (1 / (1 + F.exp(-total))).alias("probability"))


def long_features(features: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """The entries of feature vectors as rows (keys, idx, weight)."""
    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            kinds, _, indices, values = batch.column("features").flatten()
            at = pc.list_parent_indices(values).to_numpy()
            sizes = np.bincount(at, minlength=len(batch))
            # A dense vector has no indices: its values are numbered.
            idx = np.arange(len(at)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            idx[kinds.fill_null(-1).to_numpy()[at] == 0] = indices.flatten().to_numpy()
            weights = values.flatten().to_numpy()
            held = np.flatnonzero(weights != 0)
            taken = pa.array(at[held])
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(k).take(taken) for k in keys], pa.array(idx[held], pa.int64()), pa.array(weights[held])],
                schema=pa.schema([*[batch.schema.field(k) for k in keys], pa.field("idx", pa.int64()), pa.field("weight", pa.float64())]))

    small_batches(features.sparkSession)
    fields = [*[features.schema[k] for k in keys], T.StructField("idx", T.LongType()), T.StructField("weight", T.DoubleType())]
    return features.select(*keys, "features").mapInArrow(batches, T.StructType(fields))


def score_knockouts(contigs: DataFrame, located: DataFrame, jobs: DataFrame, vectorizer: TfidfModel,
                    classifier: PipelineModel, padding: int, base_tf: DataFrame | None = None) -> DataFrame:
    """Score each job (genome, target, original, length) whose length is positive after masking."""
    scored_jobs = jobs.where("length > 0")
    if base_tf is None:
        wanted = contigs.join(scored_jobs.select("genome").distinct(), "genome", "left_semi")
        base_tf = vectorizer.counter.counts(wanted)
    changes = term_changes(contigs, located, padding, vectorizer.counter, vocab=vectorizer.vocab)
    forest = Forest.from_model(classifier, vectorizer.vocab)
    after = forest_scores(base_tf, changes, scored_jobs, vectorizer, forest).withColumnRenamed("probability", "after")
    return jobs.join(after, list(KEYS), "left")


def knockout_delta(ko: DataFrame) -> DataFrame:
    """Removed is the original score where nothing was cut; delta = original - removed."""
    removed = F.coalesce(F.col("after"), F.col("original"))
    return ko.withColumn("removed", removed).withColumn("delta", F.col("original") - removed).drop("after")


def _jobs(predictions: DataFrame, targets: DataFrame, lengths: DataFrame) -> DataFrame:
    """Every confident genome with every target, and the bases removed (0 where the target is not found).

    ``targets`` is a gene list, so each genome is repeated once per listed gene and no more.
    """
    listed = F.array_sort(F.collect_list("target"))
    names = targets.agg(listed).scalar()
    every = predictions.select("genome", F.col("probability").alias("original"), F.explode(names).alias("target"))
    return every.join(lengths, list(KEYS), "left").withColumn("length", F.coalesce("length", F.lit(0)))


def knockout_gene(predictions: DataFrame, contigs: DataFrame, loci: DataFrame, panel: DataFrame,
                  vectorizer: TfidfModel, classifier: PipelineModel, task: str = "invasive", threshold: float = 0.0,
                  control: bool = False, seed: int = 0, padding: int = L.GENE_PADDING,
                  base_tf: DataFrame | None = None) -> DataFrame:
    """Single-gene knockouts of every panel gene in every confident genome, in one job."""
    return _knockout(predictions, contigs, loci, panel, F.col("locus_tag"), vectorizer, classifier, task, threshold,
                     control, seed, padding, base_tf).withColumnRenamed("target", "gene")


def knockout_panel(predictions: DataFrame, contigs: DataFrame, loci: DataFrame, panel: DataFrame,
                   vectorizer: TfidfModel, classifier: PipelineModel, task: str = "invasive", threshold: float = 0.0,
                   control: bool = False, seed: int = 0, padding: int = L.GENE_PADDING, name: str = "virulence",
                   base_tf: DataFrame | None = None) -> DataFrame:
    """All panel genes masked together in every confident genome, folded in list order."""
    label = f"{name}-control" if control else name
    return _knockout(predictions, contigs, loci, panel, F.lit(label), vectorizer, classifier, task, threshold,
                     control, seed, padding, base_tf).withColumnRenamed("target", "gene")


def _knockout(predictions, contigs, loci, panel, target, vectorizer, classifier, task, threshold, control, seed,
              padding, base_tf):
    chosen = checked_broadcast(filter_predictions(predictions, task, threshold).select("genome", "probability"))
    mine = contigs.join(chosen, "genome", "left_semi")
    located = L.locate_genes(mine, loci.join(chosen, "genome", "left_semi"), panel)
    if control:
        located = L.control_targets(mine, located, seed)
    located = located.withColumn("target", target)
    targets = checked_broadcast(panel.select(target.alias("target")).distinct())
    lengths = located.groupBy(*KEYS).agg(F.sum("length").alias("length"))
    jobs = _jobs(chosen, targets, lengths)
    return knockout_delta(
        score_knockouts(mine, located, jobs, vectorizer, classifier, padding, base_tf)
    ).select(*KEYS, "original", "removed", "delta", "length")


def knockout_capsule(predictions: DataFrame, contigs: DataFrame, loci: DataFrame, vectorizer: TfidfModel,
                     classifier: PipelineModel, threshold: float = 0.0, control: bool = False, seed: int = 0,
                     boundary: tuple[str, str] = L.CAPSULE_BOUNDARY, base_tf: DataFrame | None = None) -> DataFrame:
    """Region knockouts (genome, grp, before, after, length); genomes without a region are dropped."""
    chosen = checked_broadcast(
        filter_predictions(predictions, "capsule", threshold).select("genome", "probability")
    )
    mine = contigs.join(chosen, "genome", "left_semi")
    name = "capsule-control" if control else "capsule"
    located = L.locate_capsule(mine, loci, boundary).where("length > 0").withColumn("pos", F.lit(0))
    located = located.withColumn("target", F.lit(name))
    if control:
        located = L.control_targets(mine, located, seed, tag="target")
    jobs = chosen.join(located.select(*KEYS, "length"), "genome").select(
        *KEYS, F.col("probability").alias("original"), "length"
    )
    scored = score_knockouts(mine, located, jobs, vectorizer, classifier, 0, base_tf)
    return drop_unscored(scored).select(
        "genome", F.col("target").alias("grp"), F.col("original").alias("before"), "after", "length"
    )


def knockout_summary(ko: DataFrame, by: Sequence[str] = ("grp",)) -> DataFrame:
    """Per group: size, mean and sample deviation of length and scores, positives and switches."""
    n_after = F.count_if(F.col("after") > 0.5)
    return ko.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg("length").alias("mean_length"), F.stddev_samp("length").alias("std_length"),
        F.avg("before").alias("mean_before"), F.stddev_samp("before").alias("std_before"),
        F.avg("after").alias("mean_after"), F.stddev_samp("after").alias("std_after"),
        F.count_if(F.col("before") > 0.5).alias("n_before"), n_after.alias("n_after"),
        (F.count(F.lit(1)) - n_after).alias("switches"),
    )


def align_control(ko: DataFrame, control: DataFrame, keys: Sequence[str] = ("genome",)) -> DataFrame:
    """Original, control and knockout scores of each genome, or of other keys both tables have, side by side."""
    return control.select(*keys, F.col("before").alias("original"), F.col("after").alias("control")).join(
        ko.select(*keys, F.col("after").alias("knockout")), list(keys)
    )


def clip_negative(df: DataFrame, col: str, keep_missing: bool = False) -> DataFrame:
    """Negative values become 0. Missing ones (null or NaN) become 0 too, or stay null."""
    known = F.nanvl(F.col(col), F.lit(None).cast("double"))
    clipped = F.when(known < 0, F.lit(0.0)).otherwise(known)
    return df.withColumn(col, clipped if keep_missing else F.coalesce(clipped, F.lit(0.0)))


def assemble_deltas_left(ko: DataFrame) -> DataFrame:
    """Long gene x genome deltas, original - removed at 3 places, for the genomes of the first gene in name order."""
    first = ko.agg(F.min("gene")).scalar()
    genomes = ko.where(F.col("gene") == first).select("genome")
    delta = F.col("original") - F.bround("removed", 3)
    return ko.join(genomes, "genome", "left_semi").select("gene", "genome", delta.alias("delta"))


def assemble_deltas_outer(ko: DataFrame, genes: Sequence[str] | None = None) -> DataFrame:
    """One row per genome and one column per gene of the table, or of a list; missing cells are null.

    Columns are named on the driver, so the gene catalogue bounds what it holds.
    """
    if genes is None:
        genes = [r[0] for r in ko.select("gene").distinct().orderBy("gene").collect()]
    return ko.groupBy("genome").pivot("gene", list(genes)).agg(F.first("delta"))


def delta_filter_scale(ko: DataFrame, na_thresh: float = 0.8, k: int | None = None) -> DataFrame:
    """Clipped deltas of well-covered genes, scaled to [0, 1] per genome; optionally the k genes of greatest mean.

    Genes need values in at least int(na_thresh * genomes) genomes; genomes whose deltas sum to 0 drop out.
    """
    clipped = clip_negative(ko.select("genome", "gene", "delta"), "delta", keep_missing=True)
    need = F.floor(ko.agg(F.count_distinct("genome")).scalar() * F.lit(na_thresh))
    genes = clipped.groupBy("gene").agg(F.count("delta").alias("_n")).where(F.col("_n") >= need).select("gene")
    # One row per gene and genome: a genome's window holds at most the gene catalogue.
    mine = Window.partitionBy("genome")
    low, high = F.min("delta").over(mine), F.max("delta").over(mine)
    scaled = (
        clipped.where(F.col("delta").isNotNull()).join(genes, "gene", "left_semi")
        .withColumn("_sum", F.sum("delta").over(mine))
        .withColumn("scaled", (F.col("delta") - low) / (high - low + 1e-12))
        .where("_sum > 0").select("genome", "gene", "scaled")
    )
    if k is None:
        return scaled
    top = scaled.groupBy("gene").agg(F.avg("scaled").alias("_m")).orderBy(F.desc("_m"), "gene").limit(k)
    return scaled.join(top.select("gene"), "gene", "left_semi")


def relevant_loci(ko: DataFrame, q: float = 0.95, min_genomes: int = 50) -> DataFrame:
    """Loci whose clipped delta exceeds the genome's own q-quantile in at least ``min_genomes`` genomes.

    The quantile runs over all loci of the table; those a genome lacks count as zeros, which are not made as rows but
    shift the places of the present values. A genome has one row per locus, so its list is bounded by the gene catalogue.
    """
    clipped = clip_negative(ko.select("genome", "gene", "delta"), "delta")
    loci = clipped.agg(F.count_distinct("gene")).scalar()
    listed = clipped.groupBy("genome").agg(F.array_sort(F.collect_list("delta")).alias("_v")).withColumn("_loci", loci)
    place = (F.col("_loci") - 1) * F.lit(float(q))

    def value(at: Column) -> Column:
        # Clipped values are not negative, so the zeros of absent loci come first.
        return F.coalesce(F.get("_v", (at - (F.col("_loci") - F.size("_v"))).cast("int")), F.lit(0.0))

    low, high = value(F.floor(place)), value(F.ceil(place))
    cuts = listed.select("genome", (low + (high - low) * (place - F.floor(place))).alias("_cut"))
    return (
        clipped.join(cuts, "genome").groupBy(F.col("gene").alias("locus"))
        .agg(F.count_if(F.col("delta") > F.col("_cut")).alias("ranking"))
        .where(F.col("ranking") >= min_genomes).orderBy(F.desc("ranking"), "locus")
    )


def annotate_loci(relevant: DataFrame, aliases: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Gene names by two inner joins: locus to alias, alias to catalogue. Loci without either drop out."""
    return relevant.join(checked_broadcast(aliases), "locus").join(checked_broadcast(catalogue), "NMB_locus")


def top_n_table(annotated: DataFrame, n: int = 10, cols: Sequence[str] = ("locus", "NMB_locus", "gene", "Name",
                                                                        "product", "NCBI")) -> DataFrame:
    """The first n loci by ranking, missing text shown as a dash."""
    return annotated.orderBy(F.desc("ranking"), "locus").limit(n).select(*cols).na.fill("-")
