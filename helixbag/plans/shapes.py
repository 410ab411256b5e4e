"""Genome-shaped tables derived from the general test tables (see FIXTURES.md)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from helixbag.functions.letters import text_bytes
from helixbag.operators.cohort import SPECIES
from helixbag.session import materialize, small_batches, spread

# What each byte of a text becomes: letters of either case a capital letter or base, all others nothing.
MAPPED = np.zeros(256, dtype=np.uint8)
for _a, _b in zip("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "ABCDEFGHIJKLMNOPQRSTUVWXYZ".translate(str.maketrans("EIOUNRSHLDMP", "ACGTACGTACGT"))):
    MAPPED[[ord(_a), ord(_a.lower())]] = ord(_b)
NOTHING = np.flatnonzero(MAPPED == 0).astype(np.uint8).tobytes()


class Tables:
    """Lazy tables of one data folder and the shapes derived from them."""

    def __init__(self, spark: SparkSession, folder: str):
        small_batches(spark)
        self.spark = spark
        self.folder = str(folder).rstrip("/")
        self._stored: DataFrame | None = None

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def genomes(self) -> DataFrame:
        d = self.read("documents").select("doc_id", "lang", "source")
        key = F.col("doc_id")
        disease = (
            F.when(key % 11 == 0, F.lit(None).cast("string"))
            .when(key % 7 < 3, "carrier").when(key % 7 == 3, "meningitis").when(key % 7 == 4, "septicaemia")
            .when(key % 7 == 5, "meningitis and septicaemia").otherwise("other")
        )
        group = (
            F.when(F.col("toxic") == 1, "discrepancy").when(F.col("quality") == 1, "B")
            .when(F.col("quality") == 0, "C")
        )
        return d.join(self.read("labels"), "doc_id", "left").select(
            key.alias("id"), F.concat(F.lit("iso"), key.cast("string")).alias("isolate"),
            F.when(F.col("lang") == "en", SPECIES).otherwise(F.col("lang")).alias("species"),
            F.when(F.col("source") == "src0", 1).otherwise(0).alias("complete"),
            disease.alias("disease"), group.alias("capsule_group"),
            F.concat(F.lit("data/raw/fasta/"), key.cast("string"), F.lit(".fasta")).alias("path"),
        )

    def stored(self) -> Tables:
        """Write the derived contigs once, for queries that read them several times; sequences then come from a
        columnar table, and a read of keys or lengths no longer maps texts again."""
        if self._stored is None:
            lengths = F.length("seq").cast("bigint").alias("len")
            self._stored = materialize(self.contigs().select("*", lengths), "contigs")
        return self

    def contigs(self) -> DataFrame:
        if self._stored is not None:
            return self._stored.drop("len")
        return _as_contigs(spread(self.read("documents").select("doc_id", "text")), F.col("doc_id"))

    def conversation_contigs(self) -> DataFrame:
        turns = spread(self.read("conversations").select("conv_id", "turn", "text"))
        return turns.where(F.col("text").rlike("[A-Za-z]")).select(
            F.col("conv_id").alias("genome"), F.col("turn").alias("contig_idx"),
            F.concat(F.lit("c"), F.col("turn").cast("string")).alias("seqid"), as_bases(F.col("text")).alias("seq"),
        )

    def contig_lengths(self) -> DataFrame:
        if self._stored is not None:
            return self._stored.select("genome", "contig_idx", "seqid", "len")
        return self.contigs().select("genome", "contig_idx", "seqid", F.length("seq").cast("bigint").alias("len"))

    def loci(self) -> DataFrame:
        c = self.contig_lengths().where("len >= 60").withColumn("g", F.explode(F.array(*map(F.lit, range(3)))))
        offset = (F.col("genome") * 31 + F.col("contig_idx") * 17 + F.col("g") * 101) % (F.col("len") - 40) + 1
        tag = (F.col("contig_idx") * 3 + F.col("g")) % 200
        return c.select(
            "genome", "seqid", offset.alias("start_pos"),
            (offset + 29 + (F.col("genome") + F.col("g")) % 10).alias("end_pos"),
            F.concat(F.lit("NEIS"), F.lpad(tag.cast("string"), 4, "0")).alias("locus_tag"),
        )

    def predictions(self) -> DataFrame:
        target = F.when(F.col("o_orderstatus") == "F", 1).otherwise(0)
        noise = ((F.col("o_orderkey") * 7919 + F.col("o_custkey") * 104729) % 100003).cast("double") / 100003
        return self.read("orders").select(
            F.col("o_orderkey").alias("genome"), F.col("o_orderpriority").alias("part_name"), target.alias("target"),
            F.round(F.lit(0.6) * noise + F.lit(0.4) * target, 3).alias("probability"),
        )

    def ko(self) -> DataFrame:
        gene = F.concat(F.lit("NEIS"), F.lpad((F.col("l_partkey") % 120).cast("string"), 4, "0"))
        return self.read("lineitem").groupBy((F.col("l_orderkey") % 436).alias("genome"), gene.alias("gene")).agg(
            F.round(F.lit(0.9) + F.max("l_discount"), 6).alias("original"),
            F.round(F.lit(0.9) + F.max("l_tax"), 6).alias("removed"),
            F.round(F.max("l_discount") - F.max("l_tax"), 6).alias("delta"),
            (F.lit(30) * F.count(F.lit(1))).cast("bigint").alias("length"),
        )

    def cv_results(self) -> DataFrame:
        """Trials of one search per brand, over the whole part table."""
        key = F.col("p_partkey")
        return self.read("part").select(
            F.col("p_brand").alias("task"), key.alias("trial"), (key % 28 + 4).alias("max_bin"),
            F.round(F.lit(0.6) + (key % 10).cast("double") / 40, 3).alias("mean_train_accuracy"),
            F.round(F.lit(0.4) + F.col("p_size").cast("double") / 100, 3).alias("mean_test_accuracy"),
            F.round((key * 37 % 23).cast("double") / 23, 3).alias("mean_test_mcc"),
            F.round((key * 11 % 17).cast("double") / 17, 3).alias("mean_test_auc"),
        )

    def runs(self) -> DataFrame:
        return self.read("part").groupBy(
            F.col("p_type").alias("task"), F.col("p_brand").alias("method"),
            (F.col("p_size") * 100).alias("vocab_size"),
        ).agg(F.round(F.max("p_retailprice") / 3000, 3).alias("val_accuracy"))

    def clonal(self) -> DataFrame:
        segment = F.col("c_mktsegment")
        complex_ = (
            F.when(segment == "BUILDING", "ST-11 complex").when(segment == "MACHINERY", "ST-41/44 complex")
            .when(segment == "FURNITURE", "ST-32 complex").when(segment == "AUTOMOBILE", "ST-23 complex")
            .otherwise("other")
        )
        return self.read("customer").select(F.col("c_custkey").alias("id"), complex_.alias("clonal_complex"))


@F.arrow_udf(T.StringType())
def _bases(texts: pa.Array) -> pa.Array:
    data, offsets = text_bytes(texts)
    ends = np.zeros(len(data) + 1, dtype=np.int32 if len(data) < 1 << 31 else np.int64)
    np.cumsum(MAPPED[data] != 0, dtype=ends.dtype, out=ends[1:])
    ends = ends[offsets].astype(np.int64)
    mapped = data.tobytes().translate(MAPPED.tobytes(), NOTHING)
    known = pa.array(texts.is_valid().to_numpy(zero_copy_only=False))
    return pa.LargeStringArray.from_buffers(
        len(texts), pa.py_buffer(ends), pa.py_buffer(mapped), known.buffers()[1]).cast(pa.string())


def as_bases(line: Column) -> Column:
    """Letters of a text mapped to bases; unmapped letters stay and play the part of non-standard bases."""
    return _bases(line)


def _as_contigs(texts: DataFrame, genome: Column) -> DataFrame:
    lines = texts.select(genome.alias("genome"), F.posexplode(F.split("text", "\n")).alias("contig_idx", "line"))
    # A line has bases exactly when it has a letter; testing that avoids mapping every line twice.
    return lines.where(F.col("line").rlike("[A-Za-z]")).select(
        "genome", F.col("contig_idx").cast("bigint").alias("contig_idx"),
        F.concat(F.lit("c"), F.col("contig_idx").cast("string")).alias("seqid"), as_bases(F.col("line")).alias("seq"),
    )
