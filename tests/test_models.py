"""Training has no oracle: ranges, repeatability and agreement of the AUCs."""

from pathlib import Path
from types import SimpleNamespace

import pytest
from pyspark.ml.evaluation import BinaryClassificationEvaluator

from dueline.models import evaluation, tuning
from dueline.plans import catalog, experiment, matrices, model_queries
from dueline.plans.case_queries import labelled_orders, year_split
from dueline.plans.experiment import run_experiment
from dueline.plans.workflow import train_test_rows


@pytest.fixture(scope="module")
def sides(spark, folder):
    log = labelled_orders(spark, folder)
    got = train_test_rows(log, 5, *year_split(spark, folder, log.spec))
    return log, got.encoder.columns, got.train.checkpoint(), got.test.checkpoint()


def test_sides_are_disjoint(sides):
    log, _, train, test = sides
    assert train.count() > 0 and test.count() > 0
    assert train.join(test, log.spec.case, "left_semi").count() == 0


def test_search_score_and_auc(spark, sides, tmp_path):
    log, columns, train, test = sides
    grid = {"C": [0.01, 1], "solver": ["lbfgs", "liblinear"]}
    found = tuning.grid_search(train, log.spec, columns, "LogisticRegression", grid, folds=2)
    ranks = [r["rank_test_score"] for r in found.results(spark).collect()]
    # The two solvers are one model here.
    assert len(ranks) == 2 and ranks[0] == 1
    scored = tuning.score(found, test, log.spec)
    auc = evaluation.roc_auc(scored).first()[0]
    assert 0 <= auc <= 1
    vectors = tuning.assemble(test, log.spec, columns, "y")
    own = BinaryClassificationEvaluator(numBins=0).evaluate(found.model.transform(vectors))
    assert auc == pytest.approx(own, abs=1e-5)
    tuning.save_model(found, str(tmp_path / "m"))
    again = tuning.load_model(spark, str(tmp_path / "m"))
    a = {r["case_id"]: r["p"] for r in scored.collect()}
    b = {r["case_id"]: r["p"] for r in tuning.score(again, test, log.spec).collect()}
    assert a == b


@pytest.mark.parametrize(
    ("name", "points"),
    [("RandomForest", 6), ("XGBoost", 32), ("LogisticRegression", 4), ("DecisionTree", 48),
     ("SVM", 4), ("MLP", 5)],
)
def test_grids(name, points):
    assert len(tuning.spark_grid(name, tuning.PARAM_GRIDS[name], 1000, 20)) == points


def test_unknown_names(sides):
    log, columns, train, _ = sides
    with pytest.raises(ValueError, match="unknown classifier"):
        tuning.grid_search(train, log.spec, columns, "Oracle", {})
    with pytest.raises(ValueError, match="no point"):
        tuning.spark_grid("SVM", {"kernel": ["rbf"]}, 10, 2)


def test_forest_does_not_depend_on_how_rows_were_cut(sides):
    log, columns, train, test = sides
    point = {"n_estimators": 3, "max_depth": 4, "max_features": "sqrt"}

    def scores(rows):
        found = tuning.fit_one(rows, log.spec, columns, "RandomForest", point)
        return sorted(tuple(r) for r in tuning.score(found, test, log.spec).collect())

    assert scores(train.coalesce(1)) == scores(train.repartition(7))


def test_experiment(spark, sides, folder, tmp_path):
    log = sides[0]
    ids = year_split(spark, folder, log.spec)
    grids = {"DecisionTree": {"max_depth": [2]}}
    got = run_experiment(log, *ids, str(tmp_path), ("DecisionTree",), (0, 4000), grids, folds=2)
    rows = {r["timediff"]: r["AUC"] for r in got.collect()}
    # Nothing is left so long before the deadline.
    assert 0 <= rows[0] <= 1 and rows[4000] is None


def test_second_run_reads_the_tables_of_horizons(spark, sides, folder, tmp_path, monkeypatch):
    log, columns, *_ = sides
    ids = year_split(spark, folder, log.spec)
    grids = {"DecisionTree": {"max_depth": [2]}}

    def run():
        return run_experiment(log, *ids, str(tmp_path), ("DecisionTree",), (5,), grids, folds=2).collect()

    first = run()
    made = matrices.horizon_matrices(log, (5,), *ids, f"{tmp_path}/matrices")
    saved = made.rows("train", 5).columns
    assert not made.built and [c for c in saved if c not in (log.spec.case, "y")] == columns

    def built(*args, **more):
        raise AssertionError("built anew")

    with monkeypatch.context() as m:
        m.setattr(matrices.sweep, "fit_horizons", built)
        assert run() == first
        (Path(made.path) / "table" / "_SUCCESS").unlink()
        with pytest.raises(AssertionError, match="built anew"):
            run()


def test_registered_searches_are_whole(spark, sides, folder, monkeypatch):
    log, columns, train, test = sides
    asked = []

    def search(rows, spec, features, classifier, grid=None, label="y", folds=5, parallelism=2):
        settings = tuning.spark_grid(classifier, grid or tuning.PARAM_GRIDS[classifier], 1000, 20)
        asked.append((classifier, len(settings), folds))
        return tuning.Search(None, features, settings, [0.5] * len(settings))

    whole = {
        "RandomForest": 6, "XGBoost": 32, "LogisticRegression": 4, "DecisionTree": 48, "SVM": 4, "MLP": 5,
    }
    monkeypatch.setattr(tuning, "grid_search", search)
    monkeypatch.setattr(model_queries, "_sides", lambda spark, folder: (log.spec, columns, train, test))
    grids = ["grid_linear", "grid_tree", "grid_forest", "grid_boosted", "grid_network"]
    rows = [r for q in grids for r in catalog.QUERIES[q](spark, "").collect()]
    assert sorted(asked) == sorted((c, n, 5) for c, n in whole.items()) and len(rows) == 99

    asked.clear()
    one = spark.createDataFrame([(0.5,)], "auc double")
    monkeypatch.setattr(experiment, "grid_search", search)
    monkeypatch.setattr(experiment, "score", lambda *a: None)
    monkeypatch.setattr(experiment, "roc_auc", lambda *a: one)
    kept = SimpleNamespace(rows=lambda side, h: {"train": train, "test": test}[side])
    monkeypatch.setattr(experiment, "horizon_matrices", lambda *a, **m: kept)
    families = ["experiment_linear", "experiment_forest", "experiment_boosted"]
    got = {(r["Classifier"], r["timediff"]) for q in families for r in catalog.QUERIES[q](spark, folder).collect()}
    assert got == {(c, h) for c in experiment.CLASSIFIERS for h in range(15)}
    assert sorted(asked) == sorted((c, whole[c], 5) for _ in range(15) for c in experiment.CLASSIFIERS)


def test_sides_are_written_once(spark, folder):
    from dueline.plans import model_queries

    _, _, train, test = model_queries._sides(spark, folder)
    assert all("/sides-" in f for side in (train, test) for f in side.inputFiles())
