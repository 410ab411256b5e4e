"""Passages for vocabulary learning and joined genome documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from helixbag.functions.ranks import draw_int, draw_key, take_by_hash
from helixbag.functions.sequence import clean_seq

# Shortest and longest sampled passage.
MIN_PASSAGE = 500
MAX_PASSAGE = 1000


def contig_length_filter(contigs: DataFrame, least: int = MIN_PASSAGE) -> DataFrame:
    return contigs.where(F.length("seq") >= least)


def sample_subsequence(contigs: DataFrame, low: int = MIN_PASSAGE, high: int = MAX_PASSAGE,
                       seed: int = 0) -> DataFrame:
    """One cleaned window per contig of at least ``low`` bases, of hashed length in [low, min(len, high)] and
    hashed start."""
    size = F.length("seq").cast("bigint")
    key = F.concat_ws("-", F.col("genome").cast("string"), F.col("contig_idx").cast("string"), F.lit(str(seed)))
    width = F.lit(low) + draw_int(F.concat(key, F.lit("-length")), F.least(size, F.lit(high)) - low + 1)
    begin = draw_int(F.concat(key, F.lit("-start")), size - F.col("_width") + 1)
    return (
        contig_length_filter(contigs, low)
        .withColumn("_width", width.cast("int"))
        .withColumn("_begin", begin.cast("int"))
        .select("genome", "contig_idx", clean_seq(F.substring("seq", F.col("_begin") + 1, F.col("_width"))).alias("sentence"))
    )


def random_sample_k(sentences: DataFrame, k: int, keys: tuple[str, ...] = ("genome", "contig_idx"),
                    seed: int = 0) -> DataFrame:
    """An exact-k uniform sample by hash order. Fails when the table has fewer rows than k."""
    total = sentences.agg(F.count(F.lit(1)).alias("n")).where(
        F.assert_true(F.col("n") >= k, f"cannot sample {k} rows: the table is smaller").isNull()
    )
    keyed = sentences.withColumn("_key", draw_key(*keys, seed=seed))
    # Comparing with the checked total keeps the size check in the same plan.
    sample = take_by_hash(keyed, k, "_key").drop("_key")
    return sample.where(F.lit(k) <= total.scalar())


def load_corpus(contigs: DataFrame, num_sentences: int | None = 1_000_000, seed: int = 0) -> DataFrame:
    """Sampled passages of the training contigs, for ``bpe_train``."""
    passages = sample_subsequence(contigs, seed=seed)
    return passages if num_sentences is None else random_sample_k(passages, num_sentences, seed=seed)


def join_contigs(contigs: DataFrame, per_piece: int | None = 100) -> DataFrame:
    """Genome documents: contigs joined by newlines in order, in pieces of at most ``per_piece`` contigs.

    Pieces in ``piece`` order, themselves joined by newlines, are the whole document, so a genome of any
    number of contigs never has to fit one row. With per_piece=None a genome is one document, for export of genomes
    that are known to fit a row (2 GB).
    """
    ordered = F.array_sort(F.collect_list(F.struct("contig_idx", "seq")))
    piece = [] if per_piece is None else [F.floor(F.col("contig_idx") / per_piece).alias("piece")]
    return contigs.groupBy("genome", *piece).agg(F.array_join(F.transform(ordered, lambda c: c["seq"]), "\n").alias("document"))
