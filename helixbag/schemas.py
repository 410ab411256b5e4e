"""Explicit schemas of every file the library reads or writes."""

from pyspark.sql.types import (
    DoubleType, IntegerType, LongType, StringType, StructField, StructType,
)


def _schema(*fields) -> StructType:
    return StructType([StructField(name, kind(), True) for name, kind in fields])


GENOMES = _schema(
    ("id", LongType), ("isolate", StringType), ("species", StringType), ("complete", IntegerType),
    ("disease", StringType), ("capsule_group", StringType), ("path", StringType),
)
CONTIGS = _schema(
    ("genome", LongType), ("contig_idx", LongType), ("seqid", StringType), ("description", StringType),
    ("seq", StringType),
)
LOCI = _schema(
    ("genome", LongType), ("seqid", StringType), ("start_pos", LongType), ("end_pos", LongType),
    ("locus_tag", StringType),
)
GFF3_COLUMNS = _schema(
    ("seqid", StringType), ("source", StringType), ("type", StringType), ("start_pos", LongType),
    ("end_pos", LongType), ("score", StringType), ("strand", StringType), ("phase", StringType),
    ("attributes", StringType),
)
KNOCKOUT = _schema(
    ("genome", LongType), ("gene", StringType), ("original", DoubleType), ("removed", DoubleType),
    ("delta", DoubleType), ("length", LongType),
)
# Columns of all knockout results; a run of one kind has some of them.
KNOCKOUT_RUNS = _schema(
    ("genome", LongType), ("gene", StringType), ("group", StringType), ("before", DoubleType), ("after", DoubleType),
    ("original", DoubleType), ("removed", DoubleType), ("delta", DoubleType), ("length", LongType),
)
METRICS = _schema(*[
    (f"{stage}_{metric}", DoubleType)
    for metric in ("accuracy", "matthews_corrcoef", "roc_auc")
    for stage in ("train", "val", "test")
])
