"""Trees grown together against Spark ML's own fits."""

import numpy as np
import pytest
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.linalg import Vectors
from pyspark.ml.tuning import CrossValidator

from dueline import EventLogSpec
from dueline.models import trees, tuning


@pytest.fixture(scope="module")
def table():
    rng = np.random.default_rng(1)
    x = np.round(rng.normal(size=(400, 4)), 1)
    x[:, 3] = rng.integers(0, 3, 400)
    y = (x[:, 0] + x[:, 1] * x[:, 2] + rng.normal(size=400) > 0.8).astype(float)
    return x, y


@pytest.fixture(scope="module")
def rows(spark, table):
    data = [(Vectors.dense(a), float(b), i % 2) for i, (a, b) in enumerate(zip(*table, strict=True))]
    return spark.createDataFrame(data, ["features", "label", "fold"]).repartition(3).persist()


def settings(depths, kinds=("gini", "entropy"), least=(1, 4), seen="all", counts=(1,)):
    return [
        {"maxDepth": d, "minInstancesPerNode": m, "impurity": k, "featureSubsetStrategy": seen, "numTrees": n}
        for d in depths for m in least for k in kinds for n in counts
    ]


@pytest.fixture(scope="module")
def theirs(rows):
    """Points and what Spark ML's own search finds for them."""
    points = settings((2, 30), least=(2,))
    tree = RandomForestClassifier(seed=42, numTrees=1, bootstrap=False)
    maps = [{tree.getParam(k): v for k, v in p.items()} for p in points]
    scorer = BinaryClassificationEvaluator(numBins=0)
    search = CrossValidator(estimator=tree, estimatorParamMaps=maps, evaluator=scorer, numFolds=2, foldCol="fold")
    return points, [float(m) for m in search.fit(rows).avgMetrics]


@pytest.mark.parametrize("local", [trees.LOCAL, 30])
def test_trees_are_those_of_spark_ml(rows, theirs, monkeypatch, local):
    """Also where the upper nodes are split by sums over all blocks."""
    monkeypatch.setattr(trees, "LOCAL", local)
    assert trees.cross_validated(rows, 4, theirs[0], 2, 42, False) == pytest.approx(theirs[1], abs=1e-9)


def test_a_part_of_a_forest_is_the_forest_alone(rows, monkeypatch):
    points = settings((2, 30), kinds=("gini",), least=(2,), seen="sqrt", counts=(3, 6))
    whole = trees.cross_validated(rows, 4, points, 2, 42, True)
    monkeypatch.setattr(trees, "LOCAL", 50)
    for i in (0, 3):
        assert trees.cross_validated(rows, 4, [points[i]], 2, 42, True) == pytest.approx([whole[i]], abs=1e-9)
    assert len(set(whole)) == 4


def test_a_forest_is_as_good_as_one_of_spark_ml(rows):
    points = settings((6,), kinds=("gini",), least=(2,), seen="sqrt", counts=(40,))
    forest = RandomForestClassifier(seed=42).setParams(**points[0])
    scorer = BinaryClassificationEvaluator(numBins=0)
    theirs = [scorer.evaluate(forest.fit(rows.filter(f"fold != {k}")).transform(rows.filter(f"fold = {k}"))) for k in (0, 1)]
    assert trees.cross_validated(rows, 4, points, 2, 42, True)[0] == pytest.approx(sum(theirs) / 2, abs=0.02)


def test_copies_of_rows_are_drawn_with_replacement():
    n = np.bincount(trees.copies(42, 7, np.arange(100_000)))
    assert n[:4] / 100_000 == pytest.approx([0.3679, 0.3679, 0.1839, 0.0613], abs=0.01)
    picks = trees.chosen(42, 7, np.arange(1, 30_001), 6, 2)
    assert np.bincount(picks.ravel()) / 10_000 == pytest.approx([1] * 6, abs=0.05)


def test_the_search_grows_all_trees_at_once(spark, table, monkeypatch):
    names = ["a", "b", "c", "d"]
    data = [(str(i), *map(float, v), int(t)) for i, (v, t) in enumerate(zip(*table, strict=True))]
    df = spark.createDataFrame(data, ["case", *names, "y"])
    spec = EventLogSpec(case="case", activity="case", timestamp=None, order_by=("case",))
    grown, fits = trees.cross_validated, []

    def counted(rows, width, points, folds, *more):
        fits.append(len(points) * folds)
        return grown(rows, width, points, folds, *more)

    monkeypatch.setattr(trees, "cross_validated", counted)
    monkeypatch.setattr(tuning, "CrossValidator", None)
    grid = {"max_depth": [2, None], "min_samples_leaf": [2], "max_features": ["sqrt"], "n_estimators": [2, 4]}
    found = tuning.grid_search(df, spec, names, "RandomForest", grid, folds=2)
    best = found.settings[int(np.argmax(found.metrics))]
    assert fits == [8] and found.model.getNumTrees == best["numTrees"]
    assert all(0.5 < m <= 1 for m in found.metrics)


def test_odd_labels_are_refused(spark):
    odd = spark.createDataFrame([(Vectors.dense([float(i)]), 2.0, i % 2) for i in range(4)], ["features", "label", "fold"])
    with pytest.raises(Exception, match="0 or 1"):
        trees.cross_validated(odd, 1, settings((2,)), 2, 42, False)


def test_tasks_that_hold_all_rows_grow_whole_trees(rows, theirs, monkeypatch):
    """The same as with nodes sent to tasks and upper ones split by sums; no rows are sent by node then."""
    forest = settings((2, 30), kinds=("gini",), least=(2,), seen="sqrt", counts=(3, 9))
    sent, ends = [], trees._ends
    monkeypatch.setattr(trees, "_ends", lambda *a: sent.append(1) or ends(*a))
    alone = trees.cross_validated(rows, 4, theirs[0], 2, 42, False), trees.cross_validated(rows, 4, forest, 2, 42, True)
    assert not sent and alone[0] == pytest.approx(theirs[1], abs=1e-9)
    monkeypatch.setattr(trees, "ALONE", 0)
    for local in (trees.LOCAL, 30):
        monkeypatch.setattr(trees, "LOCAL", local)
        assert trees.cross_validated(rows, 4, theirs[0], 2, 42, False) == pytest.approx(theirs[1], abs=1e-9)
        assert trees.cross_validated(rows, 4, forest, 2, 42, True) == pytest.approx(alone[1], abs=1e-9)
    assert len(sent) == 4


def test_nodes_too_small_for_two_leaves_stay_closed():
    tree = trees.Tree.at(0, 1, np.array([2, 1]))
    assert len(tree.open(np.array([0]), trees.Growth("gini", 2, 1, True), 9)) == 0
    assert len(tree.open(np.array([0]), trees.Growth("gini", 1, 1, True), 9)) == 1


def test_the_model_of_all_rows_is_that_of_spark_ml(rows, tmp_path):
    """Without draws; with draws its facts are those of a forest."""
    folded = rows.drop("fold").selectExpr("*", "0 AS fold")
    for point in settings((2, 30), kinds=("gini",), least=(4,)):
        alone = RandomForestClassifier(seed=42, numTrees=1, bootstrap=False)
        theirs = alone.copy().setParams(**point).fit(folded)
        ours = trees.refitted(folded, 400, 4, alone.copy(), point, 42, False)
        assert ours.totalNumNodes == theirs.totalNumNodes
        scores = [[r["probability"][1] for r in m.transform(rows).collect()] for m in (ours, theirs)]
        assert scores[0] == pytest.approx(scores[1], abs=1e-9)
        assert ours.featureImportances.toArray() == pytest.approx(theirs.featureImportances.toArray(), abs=1e-9)
    point = settings((30,), kinds=("gini",), least=(2,), seen="sqrt", counts=(9,))[0]
    forest = trees.refitted(folded, 400, 4, RandomForestClassifier(seed=42), point, 42, True)
    assert forest.getNumTrees == 9 and forest.numClasses == 2
    assert BinaryClassificationEvaluator(numBins=0).evaluate(forest.transform(rows)) > 0.9
    forest.write().save(f"{tmp_path}/model")
    assert type(forest).load(f"{tmp_path}/model").totalNumNodes == forest.totalNumNodes
