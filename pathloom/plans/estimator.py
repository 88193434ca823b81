"""The engine as an estimator of pyspark.ml: it fits in pipelines and cross-validation, and is saved and loaded as one.

A graph is a folder with the tables nodes and edges (`save_graph`), named by a parameter, so an estimator or a model is saved
whole with its parameters.  The paths of a table of pairs are stages known by their content: the settings of a grid search that
walk the same pairs share them.
"""

from __future__ import annotations

from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasLabelCol, HasPredictionCol, HasProbabilityCol, HasWeightCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsReader, DefaultParamsWritable, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pathloom.plans import engine as plans
from pathloom.sources.store import StageStore
from pathloom.sources.tables import Graph


def save_graph(graph: Graph, path: str, overwrite: bool = False) -> None:
    mode = "overwrite" if overwrite else "errorifexists"
    graph.nodes.write.mode(mode).parquet(f"{path}/nodes")
    graph.edges.write.mode(mode).parquet(f"{path}/edges")


def load_graph(spark: SparkSession, path: str) -> Graph:
    return Graph(spark.read.parquet(f"{path}/nodes"), spark.read.parquet(f"{path}/edges"))


class _RuleParams(HasLabelCol, HasWeightCol, HasPredictionCol, HasProbabilityCol):
    """Parameters of the estimator and its models."""

    graphPath: Param[str] = Param(Params._dummy(), "graphPath", "folder with the tables nodes and edges of the graph", TypeConverters.toString)
    stagesPath: Param[str] = Param(Params._dummy(), "stagesPath", "shared folder for stages; empty: that of the session", TypeConverters.toString)
    firstCol: Param[str] = Param(Params._dummy(), "firstCol", "id of the first node of a pair, in the graph's orientation", TypeConverters.toString)
    secondCol: Param[str] = Param(Params._dummy(), "secondCol", "id of the second node of a pair", TypeConverters.toString)
    pathCutoff: Param[int] = Param(Params._dummy(), "pathCutoff", "edges of a path at most", TypeConverters.toInt)
    minsupRatio: Param[float] = Param(Params._dummy(), "minsupRatio", "share of the positives' weight that a frequent set needs", TypeConverters.toFloat)
    maxRuleLength: Param[int] = Param(Params._dummy(), "maxRuleLength", "metapaths of a rule at most", TypeConverters.toInt)
    alpha: Param[float] = Param(Params._dummy(), "alpha", "weight of missed positives against matched negatives", TypeConverters.toFloat)
    maxFpr: Param[float] = Param(Params._dummy(), "maxFpr", "share of the negatives' weight that a rule may match", TypeConverters.toFloat)
    excludedTypes: Param[list[str]] = Param(Params._dummy(), "excludedTypes", "types of nodes that no path passes, beside those of the evidence", TypeConverters.toListString)
    unifications: Param[bool] = Param(Params._dummy(), "unifications", "whether rules are refined by shared nodes", TypeConverters.toBoolean)
    thresholds: Param[str] = Param(Params._dummy(), "thresholds", "how thresholds are chosen: DE, GREEDY, GRID or empty", TypeConverters.toString)

    def __init__(self) -> None:
        super().__init__()
        d = plans.Parameters()
        self._setDefault(
            labelCol="label", weightCol="weight", predictionCol="prediction", probabilityCol="probability", stagesPath="", firstCol="a", secondCol="b", pathCutoff=d.path_cutoff, minsupRatio=d.minsup_ratio,
            maxRuleLength=d.max_rule_length, alpha=d.alpha, maxFpr=d.max_fpr, excludedTypes=list(d.excluded_types), unifications=d.compute_unifications, thresholds=d.optimise_thresholds or "",
        )

    def parameters(self) -> plans.Parameters:
        of = self.getOrDefault
        return plans.Parameters(
            path_cutoff=of(self.pathCutoff), minsup_ratio=of(self.minsupRatio), max_rule_length=of(self.maxRuleLength), alpha=of(self.alpha), max_fpr=of(self.maxFpr),
            excluded_types=tuple(of(self.excludedTypes)), compute_unifications=of(self.unifications), optimise_thresholds=of(self.thresholds) or None,
        )

    def _engine(self, spark: SparkSession) -> plans.Engine:
        store = StageStore(spark, self.getOrDefault(self.stagesPath) or None)
        return plans.Engine(load_graph(spark, self.getOrDefault(self.graphPath)), self.parameters(), store)

    def _pairs(self, dataset: DataFrame) -> DataFrame:
        return dataset.select(F.col(self.getOrDefault(self.firstCol)).alias("a"), F.col(self.getOrDefault(self.secondCol)).alias("b")).distinct()


class PathRules(Estimator["PathRulesModel"], _RuleParams, DefaultParamsReadable["PathRules"], DefaultParamsWritable):
    """Learns a decision set of path rules from pairs of nodes with labels 0 and 1; without the weight column all weigh 1."""

    @keyword_only
    def __init__(self, **kwargs: object) -> None:
        super().__init__()
        self._set(**self._input_kwargs)

    @keyword_only
    def setParams(self, **kwargs: object) -> PathRules:
        return self._set(**self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> PathRulesModel:
        of = self.getOrDefault
        weight = F.col(of(self.weightCol)).cast("double") if of(self.weightCol) in dataset.columns else F.lit(1.0)
        samples = dataset.select(F.col(of(self.firstCol)).alias("a"), F.col(of(self.secondCol)).alias("b"), F.col(of(self.labelCol)).cast("int").alias("label"), weight.alias("weight"))
        engine = self._engine(dataset.sparkSession)
        return self._copyValues(PathRulesModel(engine.train(engine._kept("samples", samples))))


class PathRulesModel(Model, _RuleParams, MLReadable["PathRulesModel"], MLWritable):
    """Adds the probability and the predicted label of pairs."""

    def __init__(self, model: plans.Model | None = None) -> None:
        super().__init__()
        self.model = model

    @property
    def rules(self) -> DataFrame:
        return self.model.rules

    def _transform(self, dataset: DataFrame) -> DataFrame:
        of = self.getOrDefault
        first, second = of(self.firstCol), of(self.secondCol)
        found = self._engine(dataset.sparkSession).predict(self.model, self._pairs(dataset))
        named = found.select(F.col("a").alias(first), F.col("b").alias(second), F.col("probability").alias(of(self.probabilityCol)), F.col("predicted").cast("double").alias(of(self.predictionCol)))
        return dataset.join(named, [first, second], "left").select(*dataset.columns, of(self.probabilityCol), of(self.predictionCol))

    def write(self) -> MLWriter:
        return _ModelWriter(self)

    @classmethod
    def read(cls) -> MLReader[PathRulesModel]:
        return _ModelReader()


class _ModelWriter(MLWriter):
    def __init__(self, instance: PathRulesModel) -> None:
        super().__init__()
        self.instance = instance

    def saveImpl(self, path: str) -> None:
        DefaultParamsWriter.saveMetadata(self.instance, path, self.sparkSession)
        self.instance.model.save(f"{path}/model", overwrite=self.shouldOverwrite)


class _ModelReader(MLReader[PathRulesModel]):
    def load(self, path: str) -> PathRulesModel:
        metadata = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        out = PathRulesModel(plans.Model.load(self.sparkSession, f"{path}/model"))
        out._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(out, metadata)
        return out
