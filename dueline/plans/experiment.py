"""All classifiers at all horizons."""

from __future__ import annotations

from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame

from dueline.caselog import CaseLog
from dueline.models.evaluation import roc_auc
from dueline.models.tuning import PARAM_GRIDS, grid_search, score
from dueline.plans.matrices import horizon_matrices
from dueline.sources.tables import RESULT_SCHEMA, read_results, write_csv

# Classifiers of the experiment and its number of horizons.
CLASSIFIERS = ("XGBoost", "RandomForest", "LogisticRegression")
HORIZONS = 15
# Horizons at work at a time: their many small jobs fill each other's gaps.
_AT_ONCE = 4


def run_experiment(
    log: CaseLog,
    train_ids: DataFrame,
    test_ids: DataFrame,
    folder: str,
    classifiers: tuple[str, ...] = CLASSIFIERS,
    horizons: tuple[int, ...] = tuple(range(HORIZONS)),
    grids: dict[str, dict[str, list]] = PARAM_GRIDS,
    folds: int = 5,
    label: str = "y",
) -> DataFrame:
    """Test AUC per classifier and horizon; also written to ``folder``.

    Some horizons run at once, by threads of the driver that start jobs; rows stay on
    the executors. The encoded rows of all horizons come from one pass and are written
    once, under a key of their inputs, and read by every classifier, also by a later run
    with the same folder. A horizon at which no case or one class is left gives a null AUC.
    """
    spark = log.df.sparkSession
    matrices = horizon_matrices(log, horizons, train_ids, test_ids, f"{folder}/matrices", label=label)

    @inheritable_thread_target(spark)
    def run(h: int) -> None:
        saved = {name: matrices.rows(name, h) for name in ("train", "test")}
        columns = [c for c in saved["train"].columns if c not in (log.spec.case, label)]
        classes = saved["train"].select(label).distinct().count()
        for classifier in classifiers:
            auc = None
            if classes == 2 and saved["test"].limit(1).collect():
                found = grid_search(
                    saved["train"], log.spec, columns, classifier,
                    grids[classifier], label, folds,
                )
                write_csv(
                    found.results(spark), f"{folder}/{classifier}{h:02d}_cross_val_scores.csv",
                    "overwrite",
                )
                auc = roc_auc(score(found, saved["test"], log.spec, label), "p", label).first()[0]
            row = spark.createDataFrame([(classifier, h, auc)], RESULT_SCHEMA)
            write_csv(row, f"{folder}/{classifier}{h:02d}_results.csv", "overwrite")

    with ThreadPool(_AT_ONCE) as pool:
        pool.map(run, horizons, chunksize=1)
    return read_results(spark, folder)
