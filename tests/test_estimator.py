"""The estimator in pipelines and cross-validation, saved and loaded."""

import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import SQLTransformer
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import functions as F

from pathloom.plans.engine import Engine, Parameters
from pathloom.plans.estimator import PathRules, PathRulesModel, load_graph, save_graph
from pathloom.sources.tables import Graph


@pytest.fixture(scope="module")
def learned(spark, tmp_path_factory):
    """Positives share a hub and a direct edge, negatives one of the two."""
    nodes, edges, rows = [], [], []
    for i in range(24):
        a, b, x = f"a{i}", f"b{i}", f"x{i}"
        nodes += [(a, "Gene", a, "G", 0.0), (b, "Gene", b, "G", 1.0), (x, "T1", x, "T", 0.0)]
        good = i % 2 == 0
        if good or i % 4 == 1:
            edges.append((f"d{i}", a, b, "binds", 0.5, None, None))
        if good or i % 4 == 3:
            edges += [(f"h{i}", a, x, "has", 0.9, None, None), (f"k{i}", x, b, "has", 0.9, None, None)]
        rows.append((a, b, int(good), 1.0, i))
    path = str(tmp_path_factory.mktemp("graph"))
    graph = Graph(spark.createDataFrame(nodes, "id string, type string, name string, abbrev string, orient_val double"), spark.createDataFrame(edges, "eid string, src string, dst string, label string, score double, target_id string, ctx array<string>"))
    save_graph(graph, path, overwrite=True)
    return path, spark.createDataFrame(rows, "first string, second string, label int, weight double, extra int")


def test_fit_transform_save_load(spark, learned, tmp_path):
    path, samples = learned
    est = PathRules(graphPath=path, firstCol="first", secondCol="second", minsupRatio=0.3, thresholds="", pathCutoff=2)
    est.save(str(tmp_path / "est"))
    est = PathRules.load(str(tmp_path / "est"))
    assert est.parameters() == Parameters(path_cutoff=2, minsup_ratio=0.3, optimise_thresholds=None)
    model = Pipeline(stages=[SQLTransformer(statement="SELECT *, extra + 1 AS more FROM __THIS__"), est]).fit(samples)
    out = model.transform(samples.unionByName(samples.limit(3)))
    assert out.columns == [*samples.columns, "more", "probability", "prediction"] and out.count() == 27
    got = {(r["first"], r["label"], r["prediction"]) for r in out.collect()}
    assert all(y == p for _, y, p in got)
    model.write().overwrite().save(str(tmp_path / "pipe"))
    again = PipelineModel.load(str(tmp_path / "pipe"))
    assert isinstance(again.stages[1], PathRulesModel) and again.stages[1].getOrDefault("pathCutoff") == 2
    assert {(r["first"], r["label"], r["prediction"]) for r in again.transform(samples).collect()} == got
    engine = Engine(load_graph(spark, path), est.parameters())
    direct = engine.train(samples.select(F.col("first").alias("a"), F.col("second").alias("b"), "label", "weight"))
    assert sorted(map(tuple, (r["items"] for r in direct.rules.collect()))) == sorted(map(tuple, (r["items"] for r in model.stages[1].rules.collect())))


def test_cross_validation(spark, learned):
    path, samples = learned
    est = PathRules(graphPath=path, firstCol="first", secondCol="second", thresholds="", pathCutoff=2, unifications=False)
    grid = ParamGridBuilder().addGrid(est.minsupRatio, [0.3, 1.01]).build()
    folded = samples.withColumn("fold", F.floor(F.col("extra") / 4).cast("int") % 2)
    judge = BinaryClassificationEvaluator(rawPredictionCol="probability", labelCol="label")
    found = CrossValidator(estimator=est, estimatorParamMaps=grid, evaluator=judge, numFolds=2, foldCol="fold").fit(folded)
    assert found.avgMetrics[0] == pytest.approx(1.0) and found.avgMetrics[1] == pytest.approx(0.5)
    assert found.bestModel.getOrDefault("minsupRatio") == 0.3
