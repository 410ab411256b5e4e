"""Quality classifier by hierarchical empirical Bayes.

A document classifier (ridge logistic regression on shape measures and the presence of telling words) gives each document
the evidence P(good | text). The evidence of all documents is then summed by host and by path inside the host. A host's
posterior mean is drawn to the global mean, a path's to its host's, each with a strength estimated from the spread between
groups (method of moments), so sparse sites stay near the prior. A document's final odds are its evidence with the global
prior odds replaced by those of its path.

Only the fit uses a sample: at most SAMPLE labelled documents, in hash order, and WORDS words with the largest chi-square.
Scoring reads every document whole, and sites are summed over all documents.

Defined results: a null text is empty; null hosts and paths are sites of their own; labels that are null, or whose ids are
null or unknown, are not used, contradictory labels of one id count as bad; without both kinds of labelled documents every
evidence is 0.5 and all is kept; repeated rows are judged alike and each counts; an empty table gives an empty table; a
column named like a result is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from helixbag.llm.words import SPACE, Words, slices, small_batches
from helixbag.session import materialize

# Labelled documents used by the fit, and words it may use.
SAMPLE, WORDS = 10_000, 512
RIDGE = 1.0
# A document is kept from this posterior probability of being good.
KEEP_FROM = 0.5

LETTER = np.zeros(256, dtype=bool)
LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
UPPER = np.zeros(256, dtype=bool)
UPPER[0x41:0x5B] = True
DIGIT = np.zeros(256, dtype=bool)
DIGIT[0x30:0x3A] = True


@dataclass
class Model:
    """Hashes of the telling words in order, and the weights of the intercept, the shape and those words."""

    words: np.ndarray
    weights: np.ndarray
    center: np.ndarray
    scale: np.ndarray


def _shares(mask: np.ndarray, offsets: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    sums = np.concatenate([[0], np.cumsum(mask)])
    return (sums[offsets[1:]] - sums[offsets[:-1]]) / sizes


def shape(data: np.ndarray, offsets: np.ndarray, found: Words, hashes: np.ndarray) -> np.ndarray:
    """Measures of each text: logs of its size, shares of kinds of bytes, repetition of words and of word pairs."""
    texts = len(offsets) - 1
    size = np.maximum(np.diff(offsets), 1)
    count = np.diff(found.first)
    some = np.maximum(count, 1)

    def distinct(values: np.ndarray, owner: np.ndarray) -> np.ndarray:
        order = np.lexsort((values, owner))
        values, owner = values[order], owner[order]
        new = np.ones(len(values), dtype=bool)
        new[1:] = (values[1:] != values[:-1]) | (owner[1:] != owner[:-1])
        return np.bincount(owner[new], minlength=texts)

    pairs = hashes[:-1] * np.uint64(3) + hashes[1:]
    same = found.text[:-1] == found.text[1:] if len(found) else np.zeros(0, dtype=bool)
    clean = LETTER[data[found.ends - 1]] if len(found) else np.zeros(0, dtype=bool)
    symbol = ~(LETTER[data] | DIGIT[data] | SPACE[data])
    return np.column_stack([
        np.log1p(count), np.log(size / some), _shares(LETTER[data], offsets, size), _shares(UPPER[data], offsets, size),
        _shares(DIGIT[data], offsets, size), _shares(symbol, offsets, size), distinct(hashes, found.text) / some,
        distinct(pairs[same], found.text[:-1][same]) / np.maximum(some - 1, 1),
        np.bincount(found.text, weights=clean, minlength=texts) / some, count < 20,
    ]).astype(np.float64)


def _sample(docs: DataFrame, labels: DataFrame, key: str, text: str) -> DataFrame:
    """Shape and distinct word hashes of the labelled documents of the fit."""
    chosen = labels.where(F.col("_id").isNotNull() & F.col("_bad").isNotNull()).groupBy("_id").agg(F.max("_bad").alias("_bad"))
    chosen = chosen.orderBy(F.xxhash64("_id"), "_id").limit(SAMPLE)
    rows = docs.select(F.col(key).alias("_key"), F.col(text).alias("text")).join(
        F.broadcast(chosen), F.col("_key") == F.col("_id")).select("_bad", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in slices(batches):
            found = Words(data, offsets)
            hashes = found.hashes(lower=True)
            shapes = shape(data, offsets, found, hashes)
            each = [np.unique(hashes[a:b]).view(np.int64) for a, b in zip(found.first[:-1], found.first[1:])]
            yield pa.RecordBatch.from_arrays(
                [batch.column("_bad").cast(pa.int32()), pa.array(list(shapes), type=pa.list_(pa.float64())),
                 pa.array(each, type=pa.list_(pa.int64()))], names=["bad", "shape", "words"])

    return rows.mapInArrow(run, "bad int, shape array<double>, words array<bigint>")


def _newton(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights of a ridge logistic regression; the intercept is not drawn to zero."""
    weights, ridge = np.zeros(x.shape[1]), np.full(x.shape[1], RIDGE)
    ridge[0] = 1e-6
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30)))
        slope = x.T @ (p - y) + ridge * weights
        bend = (x * (p * (1 - p) + 1e-9)[:, None]).T @ x + np.diag(ridge)
        step = np.linalg.solve(bend, slope)
        weights -= step
        if np.abs(step).max() < 1e-6:
            break
    return weights


def fit(docs: DataFrame, labels: DataFrame, bad: Column, key: str = "doc_id", text: str = "text") -> Model | None:
    """The document classifier; ``bad`` says which labels mark a document to reject. None without two kinds of labels."""
    named = labels.select(F.col(key).alias("_id"), bad.cast("int").alias("_bad"))
    rows = materialize(_sample(docs, named, key, text), "classifier-sample")
    n, rejected = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum("bad"), F.lit(0))).first()
    if not 0 < rejected < n:
        return None
    counts = rows.select("bad", F.explode("words").alias("word")).groupBy("word").agg(
        F.count(F.lit(1)).alias("seen"), F.sum("bad").alias("hits"))
    expected = F.col("seen") * (rejected / n)
    telling = (F.col("hits") - expected) ** 2 / (expected * (1 - rejected / n))
    top = counts.where(F.col("seen") >= 5).orderBy(telling.desc(), "word").limit(WORDS).select("word")
    words = np.sort(np.array([r.word for r in top.collect()], dtype=np.int64).view(np.uint64))
    # At most SAMPLE rows of a few words each come to the driver.
    inside = F.filter("words", lambda w: F.array_contains(F.lit([int(w) for w in words.view(np.int64)]), w)) if len(words) \
        else F.array().cast("array<bigint>")
    local = rows.select("bad", "shape", inside.alias("words")).toArrow()
    shapes = np.array(local.column("shape").to_pylist(), dtype=np.float64)
    center, scale = shapes.mean(axis=0), shapes.std(axis=0) + 1e-9
    x = np.zeros((len(shapes), 1 + shapes.shape[1] + len(words)))
    x[:, 0], x[:, 1 : 1 + shapes.shape[1]] = 1, (shapes - center) / scale
    for i, own in enumerate(local.column("words").to_pylist()):
        x[i, 1 + shapes.shape[1] + np.searchsorted(words, np.array(own, dtype=np.int64).view(np.uint64))] = 1
    return Model(words, _newton(x, local.column("bad").to_numpy().astype(np.float64)), center, scale)


def evidence(docs: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """Append ``evidence``, the classifier's P(good | text), to every row."""
    kept = docs.drop("evidence")
    if model is None:
        return kept.withColumn("evidence", F.lit(0.5))
    schema = T.StructType([*kept.schema.fields, T.StructField("evidence", T.DoubleType())])
    names = kept.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        measures = len(model.center)
        for batch, data, offsets in slices(batches, text):
            found = Words(data, offsets)
            hashes = found.hashes(lower=True)
            x = (shape(data, offsets, found, hashes) - model.center) / model.scale
            odds = model.weights[0] + x @ model.weights[1 : 1 + measures]
            if len(model.words) and len(found):
                at = np.minimum(np.searchsorted(model.words, hashes), len(model.words) - 1)
                hit = model.words[at] == hashes
                both = np.unique(found.text[hit] * len(model.words) + at[hit])
                odds = odds + np.bincount(both // len(model.words), minlength=len(offsets) - 1,
                                          weights=model.weights[1 + measures :][both % len(model.words)])
            good = 1 / (1 + np.exp(np.clip(odds, -30, 30)))
            yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in names], pa.array(good)], names=[*names, "evidence"])

    return kept.mapInArrow(run, schema)


def _strength(n: Column, mean: Column, whole: Column) -> Column:
    """Rows a prior is worth: mean (1 - mean) over the spread between groups beyond sampling noise, 1 to 1e6."""
    spread = F.sum(n * (mean - whole) ** 2) / F.sum(n)
    noise = F.count(F.lit(1)) * F.first(whole * (1 - whole)) / F.sum(n)
    between = F.greatest(spread - noise, F.lit(1e-9))
    return F.least(F.greatest(F.first(whole * (1 - whole)) / between - 1, F.lit(1.0)), F.lit(1e6))


def sites(scored: DataFrame, host: str, path: str) -> DataFrame:
    """One row per (host, path): documents, and posterior means of the path (``site``), its host and the whole."""
    paths = materialize(
        scored.groupBy(F.col(host).alias("_host"), F.col(path).alias("_path"))
        .agg(F.count(F.lit(1)).alias("_n"), F.sum("evidence").alias("_sum")), "sites")
    hosts = paths.groupBy("_host").agg(F.sum("_n").alias("_hn"), F.sum("_sum").alias("_hs"))
    # One row: the global mean, and the strengths of both priors.
    whole = hosts.agg((F.sum("_hs") / F.sum("_hn")).alias("_mean")).first()[0]
    mean = F.lit(0.5 if whole is None else float(whole))
    host_strength = hosts.agg(_strength(F.col("_hn"), F.col("_hs") / F.col("_hn"), mean)).first()[0]
    hosts = hosts.withColumn("host_mean", (F.col("_hs") + F.lit(host_strength or 1.0) * mean) / (F.col("_hn") + F.lit(host_strength or 1.0)))
    hosts = hosts.select(F.col("_host").alias("_h"), "host_mean")
    joined = paths.join(hosts, F.col("_host").eqNullSafe(F.col("_h"))).drop("_h")
    path_strength = joined.agg(_strength(F.col("_n"), F.col("_sum") / F.col("_n"), F.col("host_mean"))).first()[0] or 1.0
    site = (F.col("_sum") + path_strength * F.col("host_mean")) / (F.col("_n") + path_strength)
    return joined.select("_host", "_path", F.col("_n").alias("site_docs"), "host_mean", site.alias("site_mean"), mean.alias("global_mean"))


def _logit(p: Column) -> Column:
    bounded = F.least(F.greatest(p, F.lit(1e-6)), F.lit(1 - 1e-6))
    return F.log(bounded / (1 - bounded))


def classify(docs: DataFrame, labels: DataFrame, bad: Column, host: str = "source", path: str = "lang", key: str = "doc_id",
             text: str = "text", keep_from: float = KEEP_FROM) -> DataFrame:
    """Append evidence, host_mean, site_mean, global_mean, ``quality`` (the posterior) and ``kept`` to every document."""
    results = ["evidence", "site_docs", "host_mean", "site_mean", "global_mean", "quality", "kept"]
    small_batches(docs.sparkSession)
    docs = docs.drop(*results)
    model = fit(docs, labels, bad, key, text)
    found = sites(evidence(docs.select(host, path, text), model, text), host, path)
    scored = evidence(docs, model, text)
    joined = scored.join(found, F.col(host).eqNullSafe(F.col("_host")) & F.col(path).eqNullSafe(F.col("_path"))).drop("_host", "_path")
    odds = _logit(F.col("evidence")) + _logit(F.col("site_mean")) - _logit(F.col("global_mean"))
    return joined.withColumn("quality", 1 / (1 + F.exp(-odds))).withColumn("kept", F.col("quality") >= keep_from)
