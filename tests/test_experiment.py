from threading import Barrier
from types import SimpleNamespace

from dueline.plans import experiment


def test_horizons_run_at_once(spark, tmp_path, monkeypatch):
    rows = spark.createDataFrame([("a", 0, 1.0), ("b", 1, 2.0)], "case_id string, y int, v double")
    log = SimpleNamespace(df=rows, spec=SimpleNamespace(case="case_id"))
    met = Barrier(2, timeout=60)

    def search(*_):
        met.wait()  # breaks if one horizon waits for the other to end
        return SimpleNamespace(results=lambda _: rows)

    monkeypatch.setattr(experiment, "horizon_matrices", lambda *a, **m: SimpleNamespace(rows=lambda side, h: rows))
    monkeypatch.setattr(experiment, "grid_search", search)
    monkeypatch.setattr(experiment, "score", lambda *a: None)
    monkeypatch.setattr(experiment, "roc_auc", lambda *a: spark.createDataFrame([(0.5,)], "auc double"))
    got = experiment.run_experiment(log, None, None, str(tmp_path), ("LogisticRegression",), (0, 1))
    assert sorted(tuple(r) for r in got.collect()) == [("LogisticRegression", 0, 0.5), ("LogisticRegression", 1, 0.5)]
