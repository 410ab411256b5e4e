"""The corpus pipeline: stages over documents, each written as Parquet and read again as the next one's input.

The quality classifier drops what it rejects, near-dedup keeps one document of each group, the secret scan blanks secrets,
mixing repeats or drops documents to meet the sources' targets, and the last stage encodes the texts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from helixbag.llm import bpe_codec, minhash_dedup, mixing, quality_classifier, secret_scan
from helixbag.llm.queries import PATTERN, RANKS, rejected, table
from helixbag.session import scratch_path


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the quality classifier keeps."""
    judged = quality_classifier.classify(docs, table(spark, sf_dir, "labels"), rejected())
    return judged.where("kept").select(docs.columns)


def dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates; documents without an id stay."""
    groups = minhash_dedup.near_duplicates(docs)
    first = groups.where("kept and doc_id is not null").select("doc_id").distinct()
    # Rows of one id are one document, of which the first text in order stays.
    order = Window.partitionBy("doc_id").orderBy(*[c for c in docs.columns if c != "doc_id"])
    named = docs.join(first, "doc_id", "left_semi").withColumn("_at", F.row_number().over(order)).where("_at = 1")
    return named.select(docs.columns).union(docs.where("doc_id is null"))


def blank_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with every found secret replaced by a mark."""
    return secret_scan.redact(docs).withColumn("n_chars", F.length("text").cast("bigint")).select(docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, in whole copies; documents without an id stay once."""
    taken = mixing.mix(docs).where("doc_id is not null and size > 0").groupBy("doc_id").agg(
        F.max(F.floor(F.col("taken") / F.col("size") + 0.5)).cast("int").alias("_copies")).where("_copies > 0")
    copies = docs.join(taken, "doc_id").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies"))))
    return copies.select(docs.columns).union(docs.where("doc_id is null"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, with digests of the ids and of the decoded bytes."""
    encoded = bpe_codec.encode_and_decode(docs.select("doc_id", "source", "lang", "text"), RANKS, PATTERN, keep_ids=True)
    return encoded.drop("text")


STAGES = [
    ("quality classifier", classify),
    ("MinHash near-dedup", dedup),
    ("secret scan", blank_secrets),
    ("mixing to target weights", mix),
    ("byte-level BPE", encode),
]

# Training, sketches and token ids are beyond SQL; tests compare the stages with brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = scratch_path(spark, name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
