"""Boosted trees trained together against Spark ML's own fits."""

import numpy as np
import pytest
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.linalg import Vectors

from dueline import EventLogSpec
from dueline.models import boosting, tuning


@pytest.fixture(scope="module")
def table():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(600, 3))
    return x, (x[:, 0] + x[:, 1] * x[:, 2] + rng.normal(size=600) > 0.8).astype(float)


def point(**changes):
    plain = {
        "stepSize": 0.1, "minInstancesPerNode": 1, "subsamplingRate": 1.0, "featureSubsetStrategy": "1.0",
        "maxIter": 3, "maxDepth": 2,
    }
    return plain | changes


def test_boosted_trees_are_those_of_spark_ml(spark, table, monkeypatch):
    """Without draws, in one block and in several; with draws about as good."""
    data = [(Vectors.dense(a), float(b), i % 2) for i, (a, b) in enumerate(zip(*table, strict=True))]
    rows = spark.createDataFrame(data, ["features", "label", "fold"]).repartition(2).persist()
    points = [point(minInstancesPerNode=9), point(subsamplingRate=0.7, featureSubsetStrategy="0.7")]
    scorer, theirs = BinaryClassificationEvaluator(numBins=0), []
    for p in points:
        fits = [GBTClassifier(seed=42).setParams(**p).fit(rows.filter(f"fold != {k}")) for k in (0, 1)]
        theirs.append(sum(scorer.evaluate(f.transform(rows.filter(f"fold = {k}"))) for k, f in enumerate(fits)) / 2)
    one = boosting.cross_validated(rows, 600, 3, points, 2, 42)
    monkeypatch.setattr(boosting, "BLOCK", 300)
    monkeypatch.setattr(boosting, "_KEPT", 2)
    several = boosting.cross_validated(rows, 600, 3, points[:1], 2, 42)
    assert one[:1] == pytest.approx(theirs[:1], abs=1e-3)
    assert several == pytest.approx(one[:1], abs=1e-3)
    assert one[1] == pytest.approx(theirs[1], abs=0.05)


def test_the_search_trains_all_models_at_once(spark, table, monkeypatch):
    data = [(str(i), *map(float, v), int(t)) for i, (v, t) in enumerate(zip(*table, strict=True))]
    rows = spark.createDataFrame(data, ["case", "a", "b", "c", "y"])
    spec = EventLogSpec(case="case", activity="case", timestamp=None, order_by=("case",))
    monkeypatch.setattr(tuning, "CrossValidator", None)
    grid = {"learning_rate": [0.1], "max_depth": [1, 2], "n_estimators": [2]}
    found = tuning.grid_search(rows, spec, ["a", "b", "c"], "XGBoost", grid, folds=2)
    assert len(found.metrics) == 2 and all(0.5 < m <= 1 for m in found.metrics)
    assert found.model.getNumTrees == 2


def test_a_task_that_holds_all_rows_trains_whole_models(spark, table, monkeypatch):
    """The same as by passes over blocks, also where models that share rounds part; no pass is made."""
    data = [(Vectors.dense(a), float(b), i % 2) for i, (a, b) in enumerate(zip(*table, strict=True))]
    rows = spark.createDataFrame(data, ["features", "label", "fold"]).repartition(3).persist()
    points = [
        point(minInstancesPerNode=least, subsamplingRate=share, featureSubsetStrategy=seen, maxDepth=depth)
        for depth in (2, 4) for least in (1, 5, 40) for share, seen in ((1.0, "1.0"), (0.7, "0.7"))
    ]
    passes, level = [], boosting._level
    monkeypatch.setattr(boosting, "_level", lambda *a: passes.append(1) or level(*a))
    alone = boosting.cross_validated(rows, 600, 3, points, 2, 42)
    assert not passes
    monkeypatch.setattr(boosting, "ALONE", 0)
    assert alone == pytest.approx(boosting.cross_validated(rows, 600, 3, points, 2, 42), abs=1e-9)
    assert passes and len(set(alone)) > 6


def test_features_are_counted_jointly_where_few_codes_occur():
    rng = np.random.default_rng(2)
    x = np.stack([rng.integers(0, 4, 5000), rng.integers(0, 3, 5000), *rng.integers(0, 32, (3, 5000)), np.zeros(5000)]).astype("u1")
    whole = boosting.Alone(x, rng.normal(size=5000), np.zeros(5000, bool), np.arange(5000), 42)
    assert [flags.shape for _, _, flags in whole.joint] == [(12, 7), (32, 32), (32, 32), (32, 33)]
    rows = np.flatnonzero(rng.random(5000) < 0.5)
    (counts,), (sums,) = whole.counted([rows], whole.y)
    for f in range(6):
        assert (counts[f] == np.bincount(x[f, rows], minlength=32)).all()
        assert sums[f] == pytest.approx(np.bincount(x[f, rows], whole.y[rows], 32), abs=1e-9)


def test_the_model_of_all_rows_is_that_of_spark_ml(spark, table, tmp_path):
    data = [(Vectors.dense(a), float(b)) for a, b in zip(*table, strict=True)]
    rows = spark.createDataFrame(data, ["features", "label"]).repartition(2).persist()
    folded = rows.selectExpr("*", "0 AS fold")
    setting = point(maxIter=4, maxDepth=3, minInstancesPerNode=9)
    theirs = GBTClassifier(seed=42).setParams(**setting).fit(rows)
    ours = boosting.refitted(folded, 600, 3, GBTClassifier(seed=42), setting, 42)
    assert ours.treeWeights == theirs.treeWeights and ours.totalNumNodes == theirs.totalNumNodes
    scores = [[r["probability"][1] for r in m.transform(rows).collect()] for m in (ours, theirs)]
    assert scores[0] == pytest.approx(scores[1], abs=1e-9)
    assert ours.featureImportances.toArray() == pytest.approx(theirs.featureImportances.toArray(), abs=1e-6)
    ours.write().save(f"{tmp_path}/model")
    assert type(ours).load(f"{tmp_path}/model").totalNumNodes == theirs.totalNumNodes
