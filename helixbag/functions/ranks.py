"""Exact ranks, seeded draws and running sums that never put one large group into one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window, functions as F

from helixbag.session import BROADCAST_ROWS, materialize


def draw_key(*parts: Column | str, seed: int) -> Column:
    """md5 of the parts and the seed joined by dashes: the fixed random order of every sampling operator."""
    cols = [F.col(p) if isinstance(p, str) else p for p in parts]
    return F.md5(F.concat_ws("-", *[c.cast("string") for c in cols], F.lit(str(seed))).cast("binary"))


def draw_int(text: Column, n: Column) -> Column:
    """A whole number in [0, n) from the first 32 bits of md5(text)."""
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("bigint") % n


def _bucket_starts(rows: DataFrame, groups: Sequence[str], bucket: str) -> DataFrame:
    """Rows per (group, bucket) and the number of rows of the group in earlier buckets."""
    counts = rows.groupBy(*groups, bucket).agg(F.count(F.lit(1)).alias("_rows"))
    order = Window.partitionBy(*groups).orderBy(bucket)
    before = F.sum("_rows").over(order.rowsBetween(Window.unboundedPreceding, -1))
    return counts.withColumn("_before", F.coalesce(before, F.lit(0)))


def hash_rank(rows: DataFrame, groups: Sequence[str], key: str, rank: str = "hash_rank",
              digits: int = 3) -> DataFrame:
    """Zero-based rank of each row inside its group in the order of a hexadecimal hash column.

    Rows are ranked per (group, leading hash digits), so a group of any size spreads over 16**digits tasks;
    the rank is the start of the bucket plus the position in it.
    """
    bucketed = rows.withColumn("_bucket", F.substring(key, 1, digits))
    starts = _bucket_starts(bucketed, groups, "_bucket")
    inside = F.row_number().over(Window.partitionBy(*groups, "_bucket").orderBy(key)) - 1
    return (
        bucketed.join(starts.drop("_rows"), [*groups, "_bucket"])
        .withColumn(rank, F.col("_before") + inside)
        .drop("_bucket", "_before")
    )


def take_by_hash(rows: DataFrame, k: int, key: str, digits: int = 4) -> DataFrame:
    """The k rows of least hash over a whole table, without bringing them to the driver or one task.

    Bucket counts find the last bucket needed; rows of later buckets are dropped before any shuffle, and only
    the survivors are ranked.
    """
    bucketed = rows.withColumn("_bucket", F.substring(key, 1, digits))
    counts = bucketed.groupBy("_bucket").agg(F.count(F.lit(1)).alias("_rows"))
    # At most 16**digits rows, whatever the table holds.
    order = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.withColumn("_before", F.coalesce(F.sum("_rows").over(order), F.lit(0)))
    needed = starts.where(F.col("_before") < k).select("_bucket", "_before")
    inside = F.row_number().over(Window.partitionBy("_bucket").orderBy(key)) - 1
    return (
        bucketed.join(F.broadcast(needed), "_bucket")
        .withColumn("_rank", F.col("_before") + inside).where(F.col("_rank") < k)
        .drop("_bucket", "_before", "_rank")
    )


def running_sums(rows: DataFrame, order_col: str, sums: dict[str, str], groups: Sequence[str] = (),
                 descending: bool = False, buckets: int = 1000) -> DataFrame:
    """Exclusive running sums over a numeric order, for rows that are distinct per (groups, order_col).

    Cut points from approximate quantiles (at most ``buckets`` numbers) split the order into even ranges. Each
    range is summed in its own task and shifted by the total of the ranges before it, so no window spans more
    than one range. The cut points only balance the work; the sums do not depend on them. The rows, such as counts per
    distinct value, are written once, as cut points, totals and sums all read them.
    """
    rows = materialize(rows, "running")
    cuts = rows.approxQuantile(order_col, [i / buckets for i in range(1, buckets)], 0.5 / buckets)
    splits = [-float("inf"), *sorted(set(cuts) or {0.0}), float("inf")]
    cut = Bucketizer(splits=splits, inputCol=order_col, outputCol="_range").transform(rows)

    def ordered(col: str) -> Column:
        return F.desc(col) if descending else F.asc(col)

    totals = cut.groupBy(*groups, "_range").agg(*[F.sum(src).alias(f"_t_{dst}") for dst, src in sums.items()])
    earlier = Window.partitionBy(*groups).orderBy(ordered("_range")).rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(
        *groups, "_range",
        *[F.coalesce(F.sum(f"_t_{dst}").over(earlier), F.lit(0)).alias(f"_s_{dst}") for dst in sums],
    )
    inside = (
        Window.partitionBy(*groups, "_range").orderBy(ordered(order_col))
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    out = cut
    for dst, src in sums.items():
        out = out.withColumn(dst, F.coalesce(F.sum(src).over(inside), F.lit(0)))
    out = out.join(starts, [*groups, "_range"])
    for dst in sums:
        out = out.withColumn(dst, F.col(dst) + F.col(f"_s_{dst}"))
    return out.drop("_range", *[f"_s_{dst}" for dst in sums])


def alphabetical_index(rows: DataFrame, col: str, out: str = "idx", prefix: int = 4,
                       bound: int | None = None) -> DataFrame:
    """Zero-based position of each distinct string in alphabetical order, ranked per leading letters.

    A table whose proven size is within the broadcast limit is ranked in one step.
    """
    if bound is not None and bound <= BROADCAST_ROWS:
        return rows.withColumn(out, F.row_number().over(Window.orderBy(col)) - 1)
    # A shared prefix sorts before every longer string that has it, so prefix order agrees with full order.
    bucketed = rows.withColumn("_bucket", F.substring(col, 1, prefix))
    counts = bucketed.groupBy("_bucket").agg(F.count(F.lit(1)).alias("_rows"))
    order = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("_bucket", F.coalesce(F.sum("_rows").over(order), F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("_bucket").orderBy(col)) - 1
    return (
        bucketed.join(starts, "_bucket")
        .withColumn(out, F.col("_before") + inside)
        .drop("_bucket", "_before")
    )
