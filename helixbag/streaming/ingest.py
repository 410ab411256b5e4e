"""Incremental arrival of genomes: fetch only what is missing."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery


def incremental_ingest(ids: DataFrame, landed: DataFrame, available: DataFrame, max_num: int | None = None,
                       key: str = "id") -> tuple[DataFrame, DataFrame]:
    """Ids to fetch and ids kept.

    The first ``max_num`` ids in the order of the table, which for a file is its line order (all by default), are looked
    at; those not landed yet are fetched where data is available, and ids with data are kept. An id without data is
    dropped, which is not an error.
    """
    listed = ids
    if max_num is not None:
        listed = ids.withColumn("_row", F.monotonically_increasing_id()).orderBy("_row").limit(max_num).drop("_row")
    fetch = listed.join(landed.select(key), key, "left_anti").join(available.select(key), key, "left_semi")
    with_data = landed.select(key).unionByName(available.select(key)).distinct()
    return fetch, listed.join(with_data, key, "left_semi")


def attach_path(df: DataFrame, root: str = "data/raw/fasta", key: str = "id") -> DataFrame:
    return df.withColumn("path", F.concat(F.lit(f"{root}/"), F.col(key).cast("string"), F.lit(".fasta")))


def ingest_stream(arrivals: DataFrame, landed: str, checkpoint: str, key: str) -> StreamingQuery:
    """Land each key once, with the least of its rows in the first batch that has it, then stop when all input is read.

    The keys that have landed are keyed streaming state, so a batch touches those of its own rows and never reads what has
    landed; with many keys use the RocksDB state store. Batch n is written to the folder ``batch=n`` of ``landed``, which a
    repeated batch overwrites, so a restart at any point lands nothing twice. ``landed`` and ``checkpoint`` belong together;
    readers see the number of the batch as a further column. Null is a key like others.
    """
    # The time of a batch is stored with its offsets, so it is the same when the batch is repeated.
    timed = arrivals.withColumn("_at", F.current_timestamp())
    payload = [c for c in arrivals.columns if c != key]
    seen = timed.groupBy(key).agg(F.min(F.struct("_at", *payload)).alias("_first"), F.max("_at").alias("_last"))
    fresh = seen.where(F.col("_first._at") == F.col("_last")).select(
        *[F.col(key) if c == key else F.col("_first")[c].alias(c) for c in arrivals.columns])

    def land(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{landed}/batch={number}")

    return (
        fresh.writeStream.outputMode("update").foreachBatch(land).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )
