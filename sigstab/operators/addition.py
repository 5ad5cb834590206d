"""Recursive feature addition as an estimator of pyspark.ml, with a model that can be saved."""

from __future__ import annotations

from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import VectorSlicer
from pyspark.ml.functions import vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasFeaturesCol, HasLabelCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsReader, DefaultParamsWritable, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.storage import stored
from . import models

SLICED = "__chosen_features"


class _Shared(HasFeaturesCol, HasLabelCol):
    select = Param(Params._dummy(), "select", "number of features to keep; 0: all, or by folds", TypeConverters.toInt)
    folds = Param(Params._dummy(), "folds", "folds that choose the number of features; 0: none", TypeConverters.toInt)
    ranker = Param(Params._dummy(), "ranker", "linear estimator whose weights order the features", TypeConverters.toString)
    classifier = Param(Params._dummy(), "classifier", "estimator fitted to the chosen features", TypeConverters.toString)


class RecursiveAddition(Estimator, _Shared, DefaultParamsReadable, DefaultParamsWritable):
    """Orders the features of a vector column by recursive addition, and fits a classifier to the first of them."""

    @keyword_only
    def __init__(self, *, featuresCol: str = "features", labelCol: str = "label", select: int = 0, folds: int = 0, ranker: str = "ridge", classifier: str = "ridge") -> None:
        super().__init__()
        self._setDefault(featuresCol="features", labelCol="label", select=0, folds=0, ranker="ridge", classifier="ridge")
        self._set(**self._input_kwargs)

    def _long(self, df: DataFrame) -> DataFrame:
        """The rows as a matrix of ``linear``; ids are those of stored rows."""
        rows = df.select(F.col(self.getOrDefault("labelCol")).cast("int").alias("y"), vector_to_array(self.getOrDefault("featuresCol")).alias("x"))
        rows = stored(rows).select(F.monotonically_increasing_id().alias("sample_id"), F.col("y").cast("string").alias("label"), "y", F.posexplode("x").alias("k", "value"))
        return rows.withColumn("feature", F.format_string("f%09d", "k"))

    def _fit(self, df: DataFrame) -> RecursiveAdditionModel:
        long = stored(self._long(df))
        ranker = self.getOrDefault("ranker")
        score = {r["feature"]: r["score"] for r in models.addition_rank(long, ranker).collect()}
        order = [int(f[1:]) for f in sorted(score, key=lambda f: (-score[f], f))]
        k = self.getOrDefault("select") or len(order)
        if self.getOrDefault("folds"):
            found = models.addition_cv(long, self.getOrDefault("folds"), ranker).collect()
            k = min(found, key=lambda r: (-round(r["score"], 9), r["features"]))["features"]
        chosen = sorted(order[:k])
        rows = VectorSlicer(inputCol=self.getOrDefault("featuresCol"), outputCol=SLICED, indices=chosen).transform(df).cache()
        inner = models.estimator(self.getOrDefault("classifier"), rows=rows.count())
        inner = inner.copy({inner.getParam("featuresCol"): SLICED, inner.getParam("labelCol"): self.getOrDefault("labelCol")})
        model = RecursiveAdditionModel(inner.fit(rows), chosen, order)
        rows.unpersist()
        return self._copyValues(model)


class RecursiveAdditionModel(Model, _Shared, MLReadable, MLWritable):
    """Predicts with the chosen features: ``chosen`` (sorted), ``order`` (all features, the first added first), ``inner``."""

    def __init__(self, inner: Model, chosen: list[int], order: list[int]) -> None:
        super().__init__()
        self.inner, self.chosen, self.order = inner, chosen, order

    def _transform(self, df: DataFrame) -> DataFrame:
        sliced = VectorSlicer(inputCol=self.getOrDefault("featuresCol"), outputCol=SLICED, indices=self.chosen).transform(df)
        return self.inner.transform(sliced).drop(SLICED)

    def score(self, df: DataFrame) -> float:
        """Accuracy."""
        return MulticlassClassificationEvaluator(metricName="accuracy", labelCol=self.getOrDefault("labelCol")).evaluate(self.transform(df))

    def write(self) -> MLWriter:
        return _Writer(self)

    @classmethod
    def read(cls) -> MLReader:
        return _Reader()


class _Writer(MLWriter):
    def __init__(self, model: RecursiveAdditionModel) -> None:
        super().__init__()
        self.model = model

    def saveImpl(self, path: str) -> None:
        DefaultParamsWriter.saveMetadata(self.model, path, self.sparkSession, extraMetadata={"chosen": self.model.chosen, "order": self.model.order})
        self.model.inner.write().save(f"{path}/inner")


class _Reader(MLReader):
    def load(self, path: str) -> RecursiveAdditionModel:
        about = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        model = RecursiveAdditionModel(DefaultParamsReader.loadParamsInstance(f"{path}/inner", self.sparkSession), about["chosen"], about["order"])
        model._resetUid(about["uid"])
        DefaultParamsReader.getAndSetParams(model, about)
        return model
