"""Session settings, input spreading and lineage cuts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

# Most rows of a side that is ever broadcast: 100,000 rows of a vocabulary take about 10 MB.
BROADCAST_ROWS = 100_000
# Most bytes of Parquet files of a broadcast side whose size is measured; in memory it is a few times as large.
BROADCAST_BYTES = 16 << 20
# Bytes of one Arrow batch between Spark and Python, where rows are large.
ARROW_BYTES = 4 << 20
# Scratch tables of this process that have not been deleted.
_written: list[str] = []


def build_session(app: str = "helixbag", master: str | None = None, shuffle_partitions: int | None = None,
                  driver_memory: str | None = None) -> SparkSession:
    """A session with AQE on. Cluster settings (master, memory, shuffle width) are left to spark-submit."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
    )
    if master:
        builder = builder.master(master).config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    if driver_memory:
        builder = builder.config("spark.driver.memory", driver_memory)
    return builder.getOrCreate()


def spread(scan: DataFrame) -> DataFrame:
    """Redistribute a plain file scan that has fewer splits than the cluster has cores.

    A table of one small file reads as a single task. On a table with enough splits this changes nothing,
    so large inputs are never shuffled here. Call it on scans only: the split count comes from file listing.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    if scan.rdd.getNumPartitions() < cores:
        return scan.repartition(cores)
    return scan


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path under the shared checkpoint folder of the cluster."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that every executor can reach")
        root = tempfile.mkdtemp(prefix="helixbag-")
        spark.conf.set("spark.checkpoint.dir", root)
    path = f"{root.rstrip('/')}/helixbag/{label}-{uuid.uuid4().hex}"
    _written.append(path)
    return path


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write a table to the shared checkpoint folder and read it back: a lineage cut that outlives executors."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    stored = spark.read.schema(df.schema).parquet(path)
    stored._scratch = path
    return stored


def _delete(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
    if path in _written:
        _written.remove(path)


def discard(stored: DataFrame) -> None:
    """Delete what ``materialize`` wrote for a table that no later step reads, such as a past round of a loop."""
    path = getattr(stored, "_scratch", None)
    if path:
        _delete(stored.sparkSession, path)


def clear_scratch(spark: SparkSession) -> None:
    """Delete every scratch table of this process. Call it when the results that read them have been written."""
    for path in list(_written):
        _delete(spark, path)


def small_batches(spark: SparkSession) -> None:
    """Bound the session's Arrow batches by bytes; steps whose rows are large call this before they plan."""
    setting = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(setting)
    if not now.rstrip("b").isdigit() or not 0 < int(now.rstrip("b")) <= ARROW_BYTES:
        spark.conf.set(setting, str(ARROW_BYTES))


def bounded_broadcast(df: DataFrame, bound: int | None) -> DataFrame:
    """Broadcast a side whose row count is proven to stay within ``bound``; otherwise leave the join to AQE."""
    return F.broadcast(df) if bound is not None and bound <= BROADCAST_ROWS else df


def checked_broadcast(df: DataFrame) -> DataFrame:
    """Write a side once, and broadcast it when its files are small enough; otherwise leave the join to AQE.

    The plan of the side runs a single time, and its measured bytes decide, so a table of ids may have millions of rows.
    """
    stored = materialize(df, "side")
    spark = df.sparkSession
    place = spark._jvm.org.apache.hadoop.fs.Path(stored._scratch)
    size = place.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(place).getLength()
    return F.broadcast(stored) if size <= BROADCAST_BYTES else stored
