"""The abuse scorer as an ML estimator and a model that outlives its session.

``AbuseScorer(...).fit(labelled)`` gives an ``AbuseScorerModel``; ``model.save(path)`` writes the
trees, the calibrator, the conformal quantile and the parameters to a shared folder, and
``AbuseScorerModel.load(path)`` scores with them in any later session: in a batch, in a stream
(scoring keeps no state) or as a stage of a ``Pipeline``.  The TreeSHAP leaf table is read back
from the saved trees, so scores and explanations of a reloaded model are bit-equal.

Defined cases: windows with a null feature are not scored: the assembler raises, as it does for
the fitted model; an empty table gives an empty result; other columns pass through.
"""

from __future__ import annotations

from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.classification import GBTClassificationModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.regression import IsotonicRegressionModel
from pyspark.ml.util import (DefaultParamsReadable, DefaultParamsReader, DefaultParamsWritable, DefaultParamsWriter,
                             MLReadable, MLReader, MLWritable, MLWriter)
from pyspark.sql import DataFrame

from surveil.operators import scorer as SC
from surveil.schemas import FEATURES


class _ScorerParams(Params):
    features = Param(Params._dummy(), "features", "feature columns, in order", TypeConverters.toListString)
    seed = Param(Params._dummy(), "seed", "seed of the split and the trees", TypeConverters.toInt)
    alpha = Param(Params._dummy(), "alpha", "miscoverage of the conformal sets", TypeConverters.toFloat)
    maxIter = Param(Params._dummy(), "maxIter", "boosting rounds", TypeConverters.toInt)
    maxDepth = Param(Params._dummy(), "maxDepth", "depth of a tree", TypeConverters.toInt)
    stepSize = Param(Params._dummy(), "stepSize", "learning rate", TypeConverters.toFloat)
    trainFraction = Param(Params._dummy(), "trainFraction", "share of each class the trees learn from", TypeConverters.toFloat)
    topK = Param(Params._dummy(), "topK", "attributions kept per window", TypeConverters.toInt)
    explain = Param(Params._dummy(), "explain", "whether to add attributions", TypeConverters.toBoolean)

    def __init__(self) -> None:
        super().__init__()
        self._setDefault(features=list(FEATURES), seed=0, alpha=0.1, maxIter=100, maxDepth=3, stepSize=0.1,
                         trainFraction=0.7, topK=5, explain=True)


class AbuseScorer(Estimator, _ScorerParams, DefaultParamsReadable, DefaultParamsWritable):
    """Fits on gold windows with a 0/1 column ``label``."""

    @keyword_only
    def __init__(self, *, features=None, seed=0, alpha=0.1, maxIter=100, maxDepth=3, stepSize=0.1, trainFraction=0.7,
                 topK=5, explain=True) -> None:
        super().__init__()
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _fit(self, dataset: DataFrame) -> AbuseScorerModel:
        p = self.getOrDefault
        model = SC.fit(dataset, p("features"), p("seed"), p("alpha"), p("maxIter"), p("maxDepth"), p("stepSize"),
                       p("trainFraction"))
        return self._copyValues(AbuseScorerModel(model))


class AbuseScorerModel(Model, _ScorerParams, MLWritable, MLReadable):
    """Adds the columns of ``scorer.score`` to gold windows."""

    def __init__(self, scorer: SC.ScorerModel | None = None) -> None:
        super().__init__()
        self.scorer = scorer

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return SC.score(self.scorer, dataset, self.getOrDefault("topK"), self.getOrDefault("explain"))

    def write(self) -> MLWriter:
        return _Writer(self)

    @classmethod
    def read(cls) -> MLReader:
        return _Reader(cls)


class _Writer(MLWriter):
    def __init__(self, instance: AbuseScorerModel) -> None:
        super().__init__()
        self.instance = instance

    def saveImpl(self, path: str) -> None:
        m = self.instance.scorer
        DefaultParamsWriter.saveMetadata(self.instance, path, self.sparkSession, extraMetadata={
            "columns": m.features, "qhat": m.qhat, "nCalibration": m.n_cal})
        m.gbt.save(f"{path}/trees")
        m.iso.save(f"{path}/calibrator")


class _Reader(MLReader):
    def __init__(self, cls) -> None:
        super().__init__()
        self.cls = cls

    def load(self, path: str) -> AbuseScorerModel:
        meta = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        gbt = GBTClassificationModel.load(f"{path}/trees")
        model = self.cls(SC.ScorerModel(
            VectorAssembler(inputCols=meta["columns"], outputCol="_features"), gbt,
            IsotonicRegressionModel.load(f"{path}/calibrator"), meta["qhat"], meta["nCalibration"],
            SC.saved_leaves(self.sparkSession, f"{path}/trees", gbt), meta["columns"]))
        model._resetUid(meta["uid"])
        DefaultParamsReader.getAndSetParams(model, meta)
        return model
