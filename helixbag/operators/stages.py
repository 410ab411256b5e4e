"""The vectorizers as ``pyspark.ml`` stages, so that a Pipeline can hold a vectorizer with a classifier, be saved and loaded.

Rows going in are pieces of documents: a key, a text, and columns that are alike in all pieces of a key, such as its label. One
row per document comes out, with its feature vector in place of the text; a document without a known term has the zero
vector, a null text counts as empty, and pieces whose other columns differ give a row for each difference. Columns that
cannot be grouped (maps) are not taken. Pieces may be contigs, so a document need not fit one row.
"""

from __future__ import annotations

from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import (
    DefaultParamsReadable, DefaultParamsReader, DefaultParamsWritable, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter,
)
from pyspark.sql import DataFrame, SparkSession, functions as F

from helixbag.operators.bpe import BpeModel
from helixbag.operators.features import KmerCounter, TfidfModel, TfidfVectorizer, assemble_features, sparse_vector
from helixbag.operators.resync import subword_counter


class _DocumentParams(Params):
    keyCol = Param(Params._dummy(), "keyCol", "column that tells documents apart", TypeConverters.toString)
    textCol = Param(Params._dummy(), "textCol", "column of sequence text", TypeConverters.toString)
    outputCol = Param(Params._dummy(), "outputCol", "column of feature vectors", TypeConverters.toString)
    minDf = Param(Params._dummy(), "minDf", "least documents of a term: a number from 1, or a share below 1", TypeConverters.toFloat)
    maxDf = Param(Params._dummy(), "maxDf", "most documents of a term: a number above 1, or a share up to 1", TypeConverters.toFloat)

    def __init__(self):
        super().__init__()
        self._setDefault(keyCol="genome", textCol="seq", outputCol="features", minDf=1.0, maxDf=1.0)

    def _pieces(self, dataset: DataFrame) -> DataFrame:
        return dataset.select(F.col(self.getOrDefault("keyCol")).alias("genome"), F.col(self.getOrDefault("textCol")).alias("seq"))

    def _limit(self, name: str) -> int | float:
        """A share stays a float; a number of documents becomes whole. A least of 1 is a number, a most of 1 the share of all."""
        value = self.getOrDefault(name)
        counted = value >= 1 if name == "minDf" else value > 1
        return int(value) if counted else value


class _KmerParams(_DocumentParams):
    kMin = Param(Params._dummy(), "kMin", "letters of the shortest k-mer", TypeConverters.toInt)
    kMax = Param(Params._dummy(), "kMax", "letters of the longest k-mer", TypeConverters.toInt)

    def __init__(self):
        super().__init__()
        self._setDefault(kMin=3, kMax=8)

    def _counter(self, spark: SparkSession):
        return KmerCounter(self.getOrDefault("kMin"), self.getOrDefault("kMax"))


class _SubwordParams(_DocumentParams):
    # Tokens and merges stand in the stage itself, so that a saved pipeline needs no other file.
    tokens = Param(Params._dummy(), "tokens", "token strings by id", TypeConverters.toListString)
    merges = Param(Params._dummy(), "merges", "merges in rank order, left and right token with a blank between", TypeConverters.toListString)

    def _counter(self, spark: SparkSession):
        merges = tuple(tuple(merge.split(" ")) for merge in self.getOrDefault("merges"))
        return subword_counter(BpeModel(tuple(self.getOrDefault("tokens")), merges), spark)


class _ModelWriter(MLWriter):
    def __init__(self, instance: _VectorizerModel):
        super().__init__()
        self.instance = instance

    def saveImpl(self, path: str) -> None:
        DefaultParamsWriter.saveMetadata(self.instance, path, self.sparkSession)
        self.instance.vocabulary.write.parquet(f"{path}/vocabulary")


class _ModelReader(MLReader):
    def __init__(self, cls: type):
        super().__init__()
        self.cls = cls

    def load(self, path: str):
        metadata = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        vocabulary = self.sparkSession.read.parquet(f"{path}/vocabulary")
        model = self.cls(vocabulary, vocabulary.count())
        model._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(model, metadata)
        return model


class _VectorizerModel(Model, MLReadable, MLWritable):
    """A fitted vocabulary (term, idx, idf and counts) that turns documents into TF-IDF vectors."""

    def __init__(self, vocabulary: DataFrame | None = None, size: int = 0):
        super().__init__()
        self.vocabulary, self.size = vocabulary, size

    def write(self) -> MLWriter:
        return _ModelWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return _ModelReader(cls)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        key, text, out = (self.getOrDefault(name) for name in ("keyCol", "textCol", "outputCol"))
        if out in dataset.columns and out != text:
            raise ValueError(f"column {out} already exists")
        counter = self._counter(dataset.sparkSession)
        weights = TfidfModel(counter, self.vocabulary, self.size).transform(self._pieces(dataset))
        vectors = assemble_features(weights, self.size).select(F.col("genome").alias("_key"), F.col("features").alias("_vector"))
        others = [c for c in dataset.columns if c != text]
        documents = dataset.select(*others).distinct()
        empty = sparse_vector(F.expr("cast(array() as array<struct<idx:bigint,weight:double>>)"), self.size)
        joined = documents.join(vectors, F.col(key).eqNullSafe(F.col("_key")), "left")
        return joined.select(*others, F.coalesce("_vector", empty).alias(out))


class _Vectorizer(Estimator, DefaultParamsReadable, DefaultParamsWritable):
    model_class: type

    def _fit(self, dataset: DataFrame) -> _VectorizerModel:
        pieces = self._pieces(dataset)
        fitting = TfidfVectorizer(self._counter(dataset.sparkSession), self._limit("minDf"), self._limit("maxDf"))
        fitted = fitting.fit(pieces, pieces.select("genome").distinct())
        return self._copyValues(self.model_class(fitted.vocab, fitted.size))


class KmerVectorizerModel(_VectorizerModel, _KmerParams):
    """TF-IDF of k-mers over a fitted vocabulary."""


class KmerVectorizer(_Vectorizer, _KmerParams):
    """Fits the vocabulary and document frequencies of k-mers of kMin to kMax letters."""

    model_class = KmerVectorizerModel

    @keyword_only
    def __init__(self, *, kMin=3, kMax=8, keyCol="genome", textCol="seq", outputCol="features", minDf=1.0, maxDf=1.0):
        super().__init__()
        self._set(**self._input_kwargs)


class SubwordVectorizerModel(_VectorizerModel, _SubwordParams):
    """TF-IDF of learned tokens over a fitted vocabulary."""


class SubwordVectorizer(_Vectorizer, _SubwordParams):
    """Fits the document frequencies of the tokens of a learned model, on both strands."""

    model_class = SubwordVectorizerModel

    @keyword_only
    def __init__(self, *, tokens=None, merges=None, keyCol="genome", textCol="seq", outputCol="features", minDf=1.0, maxDf=1.0):
        super().__init__()
        self._set(**self._input_kwargs)

    @staticmethod
    def of(model: BpeModel, **params) -> SubwordVectorizer:
        return SubwordVectorizer(tokens=list(model.tokens), merges=[" ".join(m) for m in model.merges], **params)
