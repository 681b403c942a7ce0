"""Linear models trained together, against their objectives and plain counting."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors

from dueline.models import joint

FOLDS, WIDTH = 3, 4


def data(n=240):
    r = np.random.default_rng(11)
    x = r.normal(size=(n, WIDTH)) * [1, 1e5, 1e-3, 0] + [0, 3e5, 0, 7]
    y = (x[:, 0] + x[:, 1] / 1e5 - 3 + r.normal(size=n) > 0).astype(float)
    return x, y, np.arange(n) % FOLDS


@pytest.fixture(scope="module")
def blocks(spark):
    x, y, fold = data()
    rows = [(Vectors.dense(a), float(b), int(c)) for a, b, c in zip(x, y, fold, strict=True)]
    return joint.packed(spark.createDataFrame(rows, ["features", "label", "fold"]).repartition(5)).cache()


JOBS = [joint.Job("LogisticRegression", c, k) for c in (0.001, 1.0) for k in (0, 2)] + [
    joint.Job("LogisticRegression", 0.1, None),
    joint.Job("SVM", 0.001, 1),
    joint.Job("SVM", 1.0, None),
]


def objective(job, w):
    x, y, fold = data()
    seen = np.ones(len(y), bool) if job.left_out is None else fold != job.left_out
    z = np.where(y > 0, 1, -1)[seen] * (x[seen] @ w[:-1] + w[-1])
    loss = np.logaddexp(0, -z) if job.kind == "LogisticRegression" else np.maximum(0, 1 - z)
    return job.c * loss.sum() + (w[:-1] ** 2).sum() / 2


def test_fits_are_optima(blocks):
    weights = joint.fit(blocks, WIDTH, JOBS)
    r = np.random.default_rng(1)
    for job, w in zip(JOBS, weights, strict=True):
        best = objective(job, w)
        slack = 1e-9 * best if job.kind == "LogisticRegression" else job.c * 240 * joint.SMOOTH[-1] / 2
        unit = np.array([1, 1e-5, 1e3, 1, 1.0])
        for size in (1e-4, 1e-2, 1):
            for _ in range(40):
                assert objective(job, w + size * unit * r.normal(size=WIDTH + 1)) >= best - slack


def test_gradient_is_zero(blocks):
    weights = joint.fit(blocks, WIDTH, JOBS)
    assert (joint.steepness(blocks, WIDTH, JOBS, weights) < 1e-9).all()
    x, y, fold = data()
    for job, w in zip(JOBS[:4], weights, strict=False):
        seen = fold != job.left_out
        p = 1 / (1 + np.exp(-(x[seen] @ w[:-1] + w[-1])))
        gradient = np.append(job.c * x[seen].T @ (p - y[seen]) + w[:-1], job.c * (p - y[seen]).sum())
        scale = np.append(np.abs(x).max(axis=0), 1) * job.c * seen.sum()
        assert np.abs(gradient / scale).max() < 1e-6


def test_partial_sums_are_added_in_a_tree(blocks, monkeypatch):
    monkeypatch.setattr(joint, "FAN", 2)
    x, _, _ = data()
    got = joint.summed(blocks, WIDTH, lambda x, y, fold: x.sum(axis=0))
    assert np.allclose(got, x.sum(axis=0))


def test_areas_of_rows_not_seen(spark, blocks):
    jobs = JOBS[:4]
    weights = joint.fit(blocks, WIDTH, jobs)
    got = joint.areas(joint.scored(blocks, jobs, weights))
    x, y, fold = data()
    for j, job in enumerate(jobs):
        held = fold == job.left_out
        s = x[held] @ weights[j, :-1] + weights[j, -1]
        a, b = s[y[held] == 1], s[y[held] == 0]
        wins = (a[:, None] > b).sum() + (a[:, None] == b).sum() / 2
        assert got[j] == pytest.approx(wins / (len(a) * len(b)))
    one = spark.createDataFrame([(0, 1.0, 0.5), (0, 1.0, 0.7), (1, 1.0, 0.2), (1, 0.0, 0.2)], "job int, label double, score double")
    assert joint.areas(one) == {0: 0.0, 1: 0.5}


def test_too_wide(blocks):
    with pytest.raises(ValueError, match="trained together"):
        joint.fit(blocks, joint.NEWTON_WIDTH + 1, JOBS)


def test_folds_of_a_hinge_start_from_the_model_of_all_rows(blocks, monkeypatch):
    jobs = [joint.Job("SVM", c, k) for c in (0.001, 1.0) for k in range(FOLDS)]
    seen = []
    real = joint._derivatives

    def noted(some, w, mean, scale, smooth):
        seen.append((smooth, {j.left_out for j in some}))
        return real(some, w, mean, scale, smooth)

    monkeypatch.setattr(joint, "_derivatives", noted)
    weights = joint.fit(blocks, WIDTH, jobs)
    assert all(folds == {None} for smooth, folds in seen if smooth > joint.SMOOTH[-1])
    monkeypatch.undo()
    assert (joint.steepness(blocks, WIDTH, jobs, weights) < 1e-9).all()
