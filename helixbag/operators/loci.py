"""Locating annotated loci on contigs and masking them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from helixbag.functions.ranks import draw_int
from helixbag.functions.sequence import mask_interval, mask_intervals
from helixbag.session import checked_broadcast

# The genes on both sides of the capsule region, and the base padding of gene knockouts.
CAPSULE_BOUNDARY = ("NEIS0044", "NEIS0068")
GENE_PADDING = 20


def _unambiguous(contigs: DataFrame) -> DataFrame:
    """Sequence names that belong to exactly one contig of their genome."""
    return (
        contigs.groupBy("genome", "seqid")
        .agg(F.count(F.lit(1)).alias("_n"), F.min("contig_idx").alias("contig_idx"))
        .where("_n = 1").drop("_n")
    )


def locate_genes(contigs: DataFrame, loci: DataFrame, panel: DataFrame, coord: str = "reference") -> DataFrame:
    """Interval of each panel gene in each genome that annotates it exactly once.

    ``panel`` has ``locus_tag`` and ``pos`` (list order). The interval is 0-based and half-open. With
    coord="reference" the 1-based Start is used unchanged and the end is End + 1; "exact" starts one base
    earlier and ends at End. ``length`` is End + 1 - Start in both.
    """
    if coord not in ("reference", "exact"):
        raise ValueError(f"unknown coord {coord!r}")
    shift = 0 if coord == "reference" else 1
    # The panel filters before the count; a tag's duplicates all pass or all fail the filter together.
    hits = loci.join(checked_broadcast(panel.select("locus_tag", "pos")), "locus_tag")
    single = (
        hits.groupBy("genome", "locus_tag", "pos")
        .agg(F.count(F.lit(1)).alias("_n"), F.first("seqid").alias("seqid"),
             F.first("start_pos").alias("start_pos"), F.first("end_pos").alias("end_pos"))
        .where("_n = 1")
    )
    return single.join(_unambiguous(contigs), ["genome", "seqid"]).select(
        "genome", "locus_tag", F.col("pos").cast("bigint").alias("pos"), "seqid", "contig_idx",
        (F.col("start_pos") - shift).alias("start"),
        (F.col("end_pos") + 1 - shift).alias("end"),
        (F.col("end_pos") + 1 - F.col("start_pos")).alias("length"),
    )


def locate_gene(contigs: DataFrame, loci: DataFrame, gene: str, coord: str = "reference") -> DataFrame:
    panel = loci.sparkSession.createDataFrame([(gene, 0)], "locus_tag string, pos long")
    return locate_genes(contigs, loci.where(F.col("locus_tag") == gene), panel, coord)


def locate_capsule(contigs: DataFrame, loci: DataFrame, boundary: tuple[str, str] = CAPSULE_BOUNDARY) -> DataFrame:
    """Region between two boundary genes where both sit, once each in all, on one contig.

    It runs from End + 1 of the row of least Start to Start of the row of greatest End.
    """
    pair = (
        loci.where(F.col("locus_tag").isin(*boundary))
        .groupBy("genome")
        .agg(
            F.count(F.lit(1)).alias("_n"), F.min("seqid").alias("seqid"), F.max("seqid").alias("_other"),
            # Of equal Starts or Ends the row of the lower tag counts.
            F.min_by("end_pos", F.struct("start_pos", "locus_tag")).alias("_left"),
            F.min_by("start_pos", F.struct(-F.col("end_pos"), "locus_tag")).alias("end"),
        )
        .where((F.col("_n") == 2) & (F.col("seqid") == F.col("_other")))
    )
    return pair.join(_unambiguous(contigs), ["genome", "seqid"]).select(
        "genome", "seqid", "contig_idx", (F.col("_left") + 1).alias("start"), "end",
        (F.col("end") - F.col("_left") - 1).alias("length"),
    )


def contig_order(contigs: DataFrame, block: int = 4096) -> DataFrame:
    """Zero-based position of each contig in its genome, ranked per block of contig_idx values. Sequences stay
    out of it: (genome, contig_idx, contig_ord)."""
    keys = contigs.select("genome", "contig_idx", F.floor(F.col("contig_idx") / block).alias("_block"))
    counts = keys.groupBy("genome", "_block").agg(F.count(F.lit(1)).alias("_rows"))
    earlier = Window.partitionBy("genome").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    before = F.sum("_rows").over(earlier)
    starts = counts.select("genome", "_block", F.coalesce(before, F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("genome", "_block").orderBy("contig_idx")) - 1
    return keys.join(starts, ["genome", "_block"]).select(
        "genome", "contig_idx", (F.col("_before") + inside).alias("contig_ord")
    )


def control_targets(contigs: DataFrame, located: DataFrame, seed: int = 0,
                    tag: str = "locus_tag") -> DataFrame:
    """Move each located interval to a contig of the same genome chosen by hash; coordinates stay."""
    text = F.concat_ws("-", F.col("genome").cast("string"), F.col(tag), F.lit(str(seed)))
    numbers = contigs.groupBy("genome").agg(F.count(F.lit(1)).alias("n_contigs"))
    chosen = (
        located.drop("contig_idx", "seqid").join(numbers, "genome")
        .withColumn("contig_ord", draw_int(text, F.col("n_contigs"))).drop("n_contigs")
    )
    return chosen.join(contig_order(contigs), ["genome", "contig_ord"]).drop("contig_ord")


def ordered_cuts(located: DataFrame, *keys: str) -> DataFrame:
    """Ordered cuts per key. A genome has at most one row per panel gene, so a list is at most the panel."""
    cut = F.struct("pos", "start", "end")
    return located.groupBy(*keys).agg(F.array_sort(F.collect_list(cut)).alias("_cuts"))


def apply_cuts(contigs: DataFrame, located: DataFrame, padding: int, all_copies: bool = True) -> DataFrame:
    """Mask the located intervals of each contig in panel order; other contigs pass unchanged.

    The small side is hashed per shuffle partition, so long sequences are never sorted.
    """
    cuts = ordered_cuts(located, "genome", "contig_idx").hint("shuffle_hash")
    joined = contigs.join(cuts, ["genome", "contig_idx"], "left")
    masked = mask_intervals(F.col("seq"), F.col("_cuts"), padding, all_copies)
    return joined.withColumn("seq", F.when(F.col("_cuts").isNull(), F.col("seq")).otherwise(masked)).drop("_cuts")


def mask_genes(contigs: DataFrame, loci: DataFrame, panel: DataFrame, padding: int = GENE_PADDING,
               coord: str = "reference", all_copies: bool = True) -> DataFrame:
    """All contigs with every panel gene masked, folded in panel order."""
    return apply_cuts(contigs, locate_genes(contigs, loci, panel, coord), padding, all_copies=all_copies)


def removed_lengths(located: DataFrame) -> DataFrame:
    """Bases reported as removed per genome: interval lengths without padding or clamping."""
    return located.groupBy("genome").agg(F.sum("length").alias("length"))


def mask_capsule(contigs: DataFrame, loci: DataFrame, boundary: tuple[str, str] = CAPSULE_BOUNDARY,
                 all_copies: bool = True) -> DataFrame:
    """All contigs with the region between the boundary genes masked; regions of length 0 or less are skipped."""
    region = locate_capsule(contigs, loci, boundary).where("length > 0")
    region = region.select("genome", "contig_idx", F.col("start").alias("_start"), F.col("end").alias("_end"))
    masked = mask_interval(F.col("seq"), F.col("_start"), F.col("_end"), 0, all_copies)
    return (
        contigs.join(region.hint("shuffle_hash"), ["genome", "contig_idx"], "left")
        .withColumn("seq", F.when(F.col("_start").isNull(), F.col("seq")).otherwise(masked))
        .drop("_start", "_end")
    )


def mask_control(contigs: DataFrame, loci: DataFrame, panel: DataFrame, padding: int = GENE_PADDING,
                 coord: str = "reference", seed: int = 0) -> DataFrame:
    """The same coordinates as ``mask_genes`` on hash-chosen contigs; a cut past the end changes nothing."""
    return apply_cuts(contigs, control_targets(contigs, locate_genes(contigs, loci, panel, coord), seed), padding)


def genomes_differ(left: DataFrame, right: DataFrame) -> DataFrame:
    """Per genome, whether any contig at the same position differs in sequence."""
    # Digests and lengths meet, not sequences.
    def digest(contigs: DataFrame, name: str) -> DataFrame:
        return contigs.select("genome", "contig_idx", F.struct(F.md5(F.col("seq").cast("binary")), F.length("seq")).alias(name))

    return (
        digest(left, "_one").join(digest(right, "_other"), ["genome", "contig_idx"])
        .groupBy("genome").agg(F.max((F.col("_one") != F.col("_other")).cast("int")).alias("differs"))
    )
