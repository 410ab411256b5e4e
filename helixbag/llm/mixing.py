"""Mixing sources to target weights: Efraimidis-Spirakis keys inside each source, summed up to a budget of words.

A source whose target is e whole times its size and some words more is taken e times whole; the rest goes to documents in
the order of -ln(u) / quality, u being a hash of the document, and the document at the border gives its first words. Column
functions only. A source may hold most rows: its documents are cut into ranges of about RANGE rows by their keys, the
ranges are summed first, and each is then summed inside by itself.

Defined results: a null text has no words; a null source is a source of its own, last in order; null keys and repeated rows
are documents like others (equal rows are interchangeable); weights of null, zero or less count as the least weight; sizes
of zero take nothing; an empty table gives an empty table; a column named like a result is replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from helixbag.session import materialize

# Rows that one task orders at once.
RANGE = 10_000
# Limits of document weights; they keep the ranges even.
LEAST_WEIGHT, MOST_WEIGHT = 0.25, 4.0
# A source gives each of its documents at most so often.
MOST_EPOCHS = 3


def n_words(text: Column) -> Column:
    """Runs of characters other than 0x20 and 0x09-0x0D."""
    return F.size(F.array_remove(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), "")).cast("bigint")


def plainness(text: Column, size: Column) -> Column:
    """A document weight from its text alone: one over one plus the symbols per word."""
    symbols = F.length(text) - F.length(F.regexp_replace(text, r"[#*$%&|<>]", ""))
    return F.when(size > 0, 1 / (1 + symbols / size)).otherwise(1.0)


def targets(sources: DataFrame, weights: Column | None = None, most: float = MOST_EPOCHS) -> DataFrame:
    """Append ``target`` to one row per ``source`` with its ``source_size``.

    All sizes together are shared by weight (1, 2, 3, repeating, in the order of sources, where none is given), no target
    being above ``most`` times its size; what is cut off goes to the others by weight until none is above. Sorted by
    size / weight, the cut sources come first, so one running sum finds the final level. One row per source is ordered in
    one task: a table of sources is far smaller than its documents, whatever their number.
    """
    # The order of sources is that of code points, null last.
    named = sources.withColumn("_at", F.row_number().over(Window.orderBy(F.asc_nulls_last("source"))) - 1)
    named = named.withColumn("_weight", (F.lit(1) + F.col("_at") % 3 if weights is None else weights).cast("double"))
    by_ratio = Window.orderBy("_ratio", "_at")
    before, after = by_ratio.rowsBetween(Window.unboundedPreceding, -1), by_ratio.rowsBetween(0, Window.unboundedFollowing)
    leveled = (
        named.withColumn("_top", F.col("source_size") * float(most)).withColumn("_ratio", F.col("_top") / F.col("_weight"))
        .withColumn("_all", F.sum("source_size").over(by_ratio.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
        # Words left, and weights that share them, if this source and all after it stay below their tops.
        .withColumn("_left", F.col("_all") - F.coalesce(F.sum("_top").over(before), F.lit(0.0)))
        .withColumn("_share", F.sum("_weight").over(after))
        .withColumn("_level", F.col("_left") / F.col("_share"))
        .withColumn("_open", F.col("_ratio") >= F.col("_level"))
        .withColumn("_final", F.min(F.when(F.col("_open"), F.struct("_ratio", "_at", "_level"))).over(
            by_ratio.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))["_level"])
    )
    below = F.least(F.col("_top"), F.col("_final") * F.col("_weight"))
    return leveled.withColumn("target", F.coalesce(below, F.col("_top"))).select(*sources.columns, "target")


def mix(docs: DataFrame, weight: Column | None = None, key: str = "doc_id", source: str = "source", text: str = "text",
        seed: int = 42) -> DataFrame:
    """One row per document: its key, source, ``size``, ``source_size``, ``target`` and ``taken`` words.

    ``weight`` is the quality weight of a document (by default ``plainness`` of its text).
    """
    sized = docs.select(
        F.col(key).alias("doc_id"), F.col(source).alias("source"), n_words(F.col(text)).alias("size"),
        F.md5(F.concat_ws("-", F.col(key).cast("string"), source, F.md5(F.col(text).cast("binary")),
                          F.lit(str(seed))).cast("binary")).alias("_hash"),
        (weight if weight is not None else F.lit(None)).cast("double").alias("_given"),
        F.coalesce(F.col(text), F.lit("")).alias("_text"),
    )
    given = F.col("_given") if weight is not None else plainness(F.col("_text"), F.col("size"))
    bounded = F.least(F.greatest(F.coalesce(given, F.lit(LEAST_WEIGHT)), F.lit(LEAST_WEIGHT)), F.lit(MOST_WEIGHT))
    # 52 bits of the hash, moved off zero and one.
    chance = (F.conv(F.substring("_hash", 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)
    drawn = sized.select("doc_id", "source", "size", "_hash", (-F.log(chance) / bounded).alias("_key"))
    rows = materialize(drawn, "mix-keys")

    sources = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("_docs"))
    aims = targets(sources).withColumn("_epochs", F.when(
        F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0))
    aims = aims.withColumn("_rest", F.floor(F.col("target") - F.col("_epochs") * F.col("source_size")).cast("bigint"))
    aims = aims.withColumnRenamed("source", "_source")

    # exp(-key) is near even in 0..1, so equal parts of it have similar numbers of documents.
    part = F.floor((1 - F.exp(-F.col("_key"))) * F.ceil(F.col("_docs") / RANGE)).cast("int")
    placed = rows.join(aims, F.col("source").eqNullSafe(F.col("_source"))).withColumn("_part", part)
    totals = placed.groupBy("_source", "_part").agg(F.sum("size").alias("_total"))
    earlier = Window.partitionBy("_source").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(F.col("_source").alias("_s"), F.col("_part").alias("_p"),
                           F.coalesce(F.sum("_total").over(earlier), F.lit(0)).alias("_start"))
    inside = Window.partitionBy("_source", "_part").orderBy("_key", "_hash", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    before = F.col("_start") + F.coalesce(F.sum("size").over(inside), F.lit(0))
    part_of = F.greatest(F.lit(0), F.least(F.col("size"), F.col("_rest") - before))
    return (
        placed.join(starts, F.col("_source").eqNullSafe(F.col("_s")) & (F.col("_part") == F.col("_p")))
        .select("doc_id", "source", "size", "source_size", "target",
                (F.col("_epochs") * F.col("size") + part_of).cast("bigint").alias("taken"))
    )
