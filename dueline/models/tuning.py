"""Grid search over Spark ML classifiers.

Grids use the parameter names common in Python libraries and are translated;
points that differ only in something Spark ML does not have become one point.
The families match, the fitted numbers do not.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from itertools import product

from pyspark.ml import Estimator, PipelineModel, Transformer
from pyspark.ml.classification import (
    GBTClassifier,
    LinearSVC,
    LogisticRegression,
    MultilayerPerceptronClassifier,
    RandomForestClassifier,
)
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.ml.tuning import CrossValidator
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from dueline.models import boosting, joint, network, trees
from dueline.operators.splits import stratified_folds
from dueline.spec import EventLogSpec, col

# Search grids by classifier.
PARAM_GRIDS = {
    "RandomForest": {
        "n_estimators": [50, 100],
        "max_depth": [3, 6, None],
        "min_samples_split": [2],
        "min_samples_leaf": [2],
        "max_features": ["sqrt"],
    },
    "XGBoost": {
        "learning_rate": [0.01, 0.1],
        "min_child_weight": [1, 3],
        "subsample": [0.7, 1],
        "colsample_bytree": [0.7, 1],
        "max_depth": [3, 6],
        "n_estimators": [100],
    },
    "LogisticRegression": {
        "solver": ["lbfgs", "liblinear"],
        "penalty": ["l2"],
        "C": [0.001, 0.01, 0.1, 1],
    },
    "DecisionTree": {
        "max_depth": [None, 5, 10, 20],
        "min_samples_leaf": [1, 2, 4],
        "min_samples_split": [2, 5, 10],
        "max_features": ["auto", "sqrt", "log2"],
        "criterion": ["gini", "entropy"],
    },
    "SVM": {
        "C": [0.001, 0.1, 1, 10],
        "kernel": ["linear", "rbf", "poly"],
        "degree": [2, 3, 4],
        "gamma": ["scale", "auto"],
        "coef0": [0, 1, 2],
    },
    "MLP": {
        "hidden_layer_sizes": [(100,), (200, 100), (200,), (100, 50), (100, 100, 100)],
        "activation": ["tanh"],
        "solver": ["adam"],
        "alpha": [0.0001],
        "learning_rate": ["constant"],
        "learning_rate_init": [0.0001],
    },
}
SEED = 42
# Passes of a linear fit are short, so a task should have some rows. Each sends one sum
# per feature, so there are at most so many for a core, however many rows there are.
_ROWS_PER_TASK = 50_000
_TASKS_PER_CORE = 3

# Deepest tree Spark ML builds; stands for "no limit".
_DEEPEST = 30


def _depth(value: int | None) -> int:
    return _DEEPEST if value is None else value


def _base(classifier: str) -> Estimator:
    made = {
        "LogisticRegression": lambda: LogisticRegression(elasticNetParam=0.0, standardization=False),
        # One tree over all rows: it alone knows how many features a split may see.
        "DecisionTree": lambda: RandomForestClassifier(seed=SEED, numTrees=1, bootstrap=False),
        "RandomForest": lambda: RandomForestClassifier(seed=SEED),
        "XGBoost": lambda: GBTClassifier(seed=SEED),
        "SVM": lambda: LinearSVC(standardization=False),
        "MLP": lambda: MultilayerPerceptronClassifier(seed=SEED),
    }
    if classifier not in made:
        raise ValueError(f"unknown classifier {classifier!r}; one of {sorted(made)}")
    return made[classifier]().setFeaturesCol("features")


def _settings(classifier: str, point: dict, rows: int, width: int) -> dict | None:
    """Spark ML parameters of one grid point; None if Spark ML has no such model."""
    if classifier in ("LogisticRegression", "SVM"):
        if point.get("kernel", "linear") != "linear":
            return None
        return {"regParam": 1.0 / (point.get("C", 1.0) * rows)}
    if classifier == "MLP":
        hidden = point.get("hidden_layer_sizes", (100,))
        return {"layers": [width, *hidden, 2]}
    out = {"maxDepth": _depth(point.get("max_depth"))}
    if classifier == "DecisionTree":
        out["minInstancesPerNode"] = point.get("min_samples_leaf", 1)
        out["impurity"] = point.get("criterion", "gini")
        # "auto" was another name of the square root.
        seen = point.get("max_features") or "all"
        out["featureSubsetStrategy"] = "sqrt" if seen == "auto" else seen
    elif classifier == "RandomForest":
        out["numTrees"] = point.get("n_estimators", 100)
        out["minInstancesPerNode"] = point.get("min_samples_leaf", 1)
        out["featureSubsetStrategy"] = point.get("max_features", "sqrt")
    else:
        out["stepSize"] = point.get("learning_rate", 0.1)
        out["minInstancesPerNode"] = point.get("min_child_weight", 1)
        out["subsamplingRate"] = float(point.get("subsample", 1.0))
        out["featureSubsetStrategy"] = str(float(point.get("colsample_bytree", 1.0)))
        out["maxIter"] = point.get("n_estimators", 100)
        out["maxDepth"] = point.get("max_depth", 6)
    return out


def spark_grid(classifier: str, grid: dict[str, list], rows: int, width: int) -> list[dict]:
    """Distinct Spark ML settings of a grid, in grid order."""
    names = list(grid)
    points = []
    for values in product(*grid.values()):
        found = _settings(classifier, dict(zip(names, values, strict=True)), rows, width)
        if found is not None and found not in points:
            points.append(found)
    if not points:
        raise ValueError(f"no point of the grid is available for {classifier}")
    return points


def assemble(rows: DataFrame, spec: EventLogSpec, features: list[str], label: str) -> DataFrame:
    """Case id, label and one feature vector; any column name will do.

    A single column that holds vectors is taken as it is. Else the vector's
    metadata names its features.
    """
    if holds_vectors(rows, features):
        vector = col(features[0]).alias("features")
        return rows.select(col(spec.case), col(label).cast("double").alias("label"), vector)
    safe = [f"f{i}" for i in range(len(features))]
    plain = rows.select(
        col(spec.case),
        col(label).cast("double").alias("label"),
        *[col(c).cast("double").alias(s) for c, s in zip(features, safe, strict=True)],
    )
    vector = VectorAssembler(inputCols=safe, outputCol="features", handleInvalid="error")
    named = {"numeric": [{"idx": i, "name": c} for i, c in enumerate(features)]}
    meta = {"ml_attr": {"attrs": named, "num_attrs": len(features)}}
    made = F.col("features").alias("features", metadata=meta)
    return vector.transform(plain).select(col(spec.case), "label", made)


def holds_vectors(rows: DataFrame, features: list[str]) -> bool:
    return len(features) == 1 and isinstance(rows.schema[features[0]].dataType, VectorUDT)


def _width(rows: DataFrame, features: list[str]) -> int:
    if not holds_vectors(rows, features):
        return len(features)
    first = rows.select(col(features[0])).first()
    return first[0].size if first else 0


def _placed(rows: DataFrame, spec: EventLogSpec, classifier: str, count: int) -> DataFrame:
    """Rows by case, in as many partitions as the session is set to, whatever their number.

    Bagging and sampling draw per partition, so a fit depends on the rows and this
    setting, not on how its input was cut. Linear models draw nothing and have one
    optimum however rows lie, so few rows lie in few partitions there.
    """
    if classifier in ("LogisticRegression", "SVM"):
        most = _TASKS_PER_CORE * rows.sparkSession.sparkContext.defaultParallelism
        return rows.coalesce(min(max(1, -(-count // _ROWS_PER_TASK)), most))
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(n, col(spec.case)).sortWithinPartitions(col(spec.case))


def _network(spark: SparkSession, layers: list[int], **changes) -> Transformer:
    """A network as Spark ML starts it, or with given weights: no step is taken, so one row will do."""
    row = spark.createDataFrame([(0.0, Vectors.dense([0.0] * layers[0]))], ["label", "features"])
    return _base("MLP").setParams(layers=layers, maxIter=0, **changes).fit(row)


def _networks(with_folds: DataFrame, settings: list[dict], folds: int) -> tuple[Transformer, list[float]]:
    """The best network of some, from all rows, and the mean area over the folds of each."""
    spark, base = with_folds.sparkSession, _base("MLP")
    shapes = [tuple(s["layers"]) for s in settings]
    starts = [_network(spark, s["layers"]).weights.toArray() for s in settings]
    blocks = network.packed(with_folds, folds).persist(StorageLevel.MEMORY_AND_DISK_DESER)

    def fit(jobs: list[network.Job]) -> list:
        first = [starts[shapes.index(j.layers)] for j in jobs]
        return network.fit(blocks, folds, jobs, first, base.getMaxIter(), base.getTol(), base.getBlockSize())

    try:
        jobs = [network.Job(s, k) for s in shapes for k in range(folds)]
        found = joint.areas(network.scored(blocks, jobs, fit(jobs)))
        metrics = [sum(found.get(i * folds + k, 0.0) for k in range(folds)) / folds for i in range(len(shapes))]
        best = max(range(len(shapes)), key=lambda i: metrics[i])
        weights = fit([network.Job(shapes[best], None)])[0]
    finally:
        blocks.unpersist()
    return _network(spark, settings[best]["layers"], initialWeights=Vectors.dense(weights)), metrics


@dataclass
class Search:
    """The best model of a grid and how all points did."""

    model: Transformer
    features: list[str]
    settings: list[dict]
    metrics: list[float] = field(default_factory=list)

    def results(self, spark: SparkSession) -> DataFrame:
        """One row per grid point, best rank first."""
        rows = [(json.dumps(s), m) for s, m in zip(self.settings, self.metrics, strict=True)]
        table = spark.createDataFrame(rows, "params string, mean_test_score double")
        rank = F.rank().over(Window.orderBy(F.desc("mean_test_score")))
        return table.withColumn("rank_test_score", rank).orderBy("rank_test_score", "params")


def grid_search(
    rows: DataFrame,
    spec: EventLogSpec,
    features: list[str],
    classifier: str,
    grid: dict[str, list] | None = None,
    label: str = "y",
    folds: int = 5,
    parallelism: int = 2,
) -> Search:
    """Cross-validated search by ROC AUC, refitted on all rows.

    Linear models of all points and folds are trained together, C counting the rows
    of a fold, and so are networks, trees and forests. Other fits run as Spark jobs, ``parallelism`` of them at once. The
    training rows (one per case, read once more to count them) are kept on the
    executors, spilling to disk.
    """
    estimator = _base(classifier)
    n = rows.count()
    width = _width(rows, features)
    with_folds = _placed(
        stratified_folds(assemble(rows, spec, features, label), spec, "label", folds, SEED), spec,
        classifier, n,
    )
    settings = spark_grid(classifier, grid or PARAM_GRIDS[classifier], n, width)
    if classifier == "MLP" and n and width:
        model, metrics = _networks(with_folds, settings, folds)
        return Search(model, features, settings, metrics)
    with_folds.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        if classifier in ("LogisticRegression", "SVM") and 0 < width <= joint.NEWTON_WIDTH:
            cs = [1 / (s["regParam"] * n) for s in settings]
            metrics = joint.cross_validated(with_folds, width, classifier, cs, folds)
            best = settings[max(range(len(cs)), key=lambda i: metrics[i])]
            return Search(estimator.setParams(**best).fit(with_folds), features, settings, metrics)
        if classifier in ("DecisionTree", "RandomForest") and n and width and not holds_vectors(rows, features):
            drawn = estimator.getBootstrap()
            metrics = trees.cross_validated(with_folds, width, settings, folds, SEED, drawn)
            best = settings[max(range(len(settings)), key=lambda i: metrics[i])]
            model = trees.refitted(with_folds, n, width, estimator, best, SEED, drawn)
            return Search(model, features, settings, metrics)
        if classifier == "XGBoost" and n and width and not holds_vectors(rows, features):
            metrics = boosting.cross_validated(with_folds, n, width, settings, folds, SEED)
            best = settings[max(range(len(settings)), key=lambda i: metrics[i])]
            model = boosting.refitted(with_folds, n, width, estimator, best, SEED)
            return Search(model, features, settings, metrics)
        maps = [{estimator.getParam(k): v for k, v in s.items()} for s in settings]
        scorer = BinaryClassificationEvaluator(metricName="areaUnderROC", numBins=0)
        search = CrossValidator(
            estimator=estimator,
            estimatorParamMaps=maps,
            evaluator=scorer,
            numFolds=folds,
            foldCol="fold",
            parallelism=parallelism,
        ).fit(with_folds)
    finally:
        with_folds.unpersist()
    return Search(search.bestModel, features, settings, [float(m) for m in search.avgMetrics])


def fit_one(
    rows: DataFrame,
    spec: EventLogSpec,
    features: list[str],
    classifier: str,
    point: dict,
    label: str = "y",
) -> Search:
    """One grid point on all rows, without cross-validation."""
    n = rows.count()
    train = _placed(assemble(rows, spec, features, label), spec, classifier, n).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        grid = {k: [v] for k, v in point.items()}
        settings = spark_grid(classifier, grid, n, _width(rows, features))
        model = _base(classifier).setParams(**settings[0]).fit(train)
    finally:
        train.unpersist()
    return Search(model, features, settings)


def score(
    search: Search, rows: DataFrame, spec: EventLogSpec, label: str = "y", name: str = "p"
) -> DataFrame:
    """Case id, label and the model's score for class 1.

    A probability where the model has one, else the signed distance.
    """
    out = search.model.transform(assemble(rows, spec, search.features, label))
    source = "probability" if "probability" in out.columns else "rawPrediction"
    value = vector_to_array(F.col(source)).getItem(1)
    return out.select(col(spec.case), col("label").cast("int").alias(label), value.alias(name))


def save_model(search: Search, path: str) -> None:
    """Write the model and its feature list in Spark ML's own format."""
    PipelineModel([search.model]).write().overwrite().save(f"{path}/model")
    spark = SparkSession.active()
    names = spark.createDataFrame(list(enumerate(search.features)), "position int, feature string")
    names.coalesce(1).write.mode("overwrite").parquet(f"{path}/features")


def load_model(spark: SparkSession, path: str) -> Search:
    model = PipelineModel.load(f"{path}/model").stages[0]
    names = spark.read.parquet(f"{path}/features").orderBy("position").collect()
    return Search(model, [r["feature"] for r in names], [])
