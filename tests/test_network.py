"""Networks trained together, against those that Spark ML trains one by one."""

from __future__ import annotations

from types import SimpleNamespace

import numpy as np
import pytest
from pyspark.ml.classification import MultilayerPerceptronClassifier
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.linalg import Vectors

from dueline.models import joint, network, tuning

FOLDS, WIDTH, STACK = 3, 4, 32
SHAPES = ((WIDTH, 7, 2), (WIDTH, 6, 5, 2))


@pytest.fixture(scope="module")
def rows(spark):
    r = np.random.default_rng(5)
    x = r.normal(size=(500, WIDTH)) * [1, 3, 0.1, 0] + [0, 2, 0, 1]
    y = (x[:, 0] + x[:, 1] / 3 + r.normal(size=500) > 1).astype(float)
    data = [(Vectors.dense(a), float(b), i % FOLDS) for i, (a, b) in enumerate(zip(x, y, strict=True))]
    return spark.createDataFrame(data, ["features", "label", "fold"]).repartition(3).cache()


def one_by_one(rows, layers, passes):
    made = MultilayerPerceptronClassifier(
        layers=list(layers), seed=tuning.SEED, blockSize=STACK, maxIter=passes, tol=1e-6
    )
    return made.fit(rows)


@pytest.mark.parametrize("passes", [1, 12])
def test_networks_are_those_of_spark_ml(spark, rows, passes):
    jobs = [network.Job(s, k) for s in SHAPES for k in (0, 2, None)]
    starts = [one_by_one(rows, j.layers, 0).weights.toArray() for j in jobs]
    blocks = network.packed(rows, FOLDS).cache()
    found = network.fit(blocks, FOLDS, jobs, starts, passes, 1e-6, STACK)
    scores = network.scored(blocks, jobs, found)
    areas = joint.areas(scores)
    for k, job in enumerate(jobs):
        seen = rows if job.left_out is None else rows.filter(rows.fold != job.left_out)
        model = one_by_one(seen, job.layers, passes)
        assert found[k] == pytest.approx(model.weights.toArray(), rel=1e-6, abs=1e-8)
        if job.left_out is not None:
            held = model.transform(rows.filter(rows.fold == job.left_out))
            own = BinaryClassificationEvaluator(numBins=0).evaluate(held)
            assert areas[k] == pytest.approx(own, abs=1e-9)
    blocks.unpersist()


def test_all_networks_share_a_pass(rows, monkeypatch):
    """Passes are those of the slowest network, not their sum."""
    asked, whole = [], network._evaluated
    monkeypatch.setattr(network, "_evaluated", lambda b, jobs, *a: asked.append(len(jobs)) or whole(b, jobs, *a))
    jobs = [network.Job(s, k) for s in SHAPES for k in range(FOLDS)]
    r = np.random.default_rng(1)
    blocks = network.packed(rows, FOLDS).cache()
    network.fit(blocks, FOLDS, jobs, [r.normal(size=j.size) for j in jobs], 5, 1e-6, STACK)
    blocks.unpersist()
    assert asked[0] == len(jobs) and len(asked) <= 2 * 5 + 5


def test_networks_of_a_grid(spark, rows, monkeypatch):
    """No fit by Spark ML takes a step, and the model is an ordinary one of Spark ML."""
    fits, fit = [], MultilayerPerceptronClassifier.fit
    monkeypatch.setattr(
        MultilayerPerceptronClassifier, "fit", lambda self, *a: fits.append(self.getMaxIter()) or fit(self, *a)
    )
    named = rows.selectExpr("monotonically_increasing_id() AS id", "label AS y", "features AS v").cache()
    spec = SimpleNamespace(case="id")
    grid = {"hidden_layer_sizes": [(3,), (2, 2)]}
    best = tuning.grid_search(named, spec, ["v"], "MLP", grid, folds=2)
    assert set(fits) == {0} and len(best.metrics) == 2 and all(0 <= m <= 1 for m in best.metrics)
    scores = [r["p"] for r in tuning.score(best, named, spec).collect()]
    assert len(scores) == 500 and all(0 <= p <= 1 for p in scores)


def test_odd_labels_are_refused(spark, rows):
    blocks = network.packed(rows.withColumn("label", rows.label + 1), FOLDS)
    with pytest.raises(Exception, match="0 or 1"):
        blocks.count()
