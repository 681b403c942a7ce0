"""Queries for training, scoring and thresholds."""

from __future__ import annotations

from functools import reduce

from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dueline.models import evaluation, joint, tuning
from dueline.operators import sparse
from dueline.operators.cutting import cut_before_deadline
from dueline.plans.case_queries import HORIZON, labelled_orders, year_split
from dueline.plans.experiment import run_experiment
from dueline.plans.matrices import horizon_matrices
from dueline.plans.registry import DAYS, ORDER_LOG, SCORE_LOG, cut, labelled, query, r6, rounded
from dueline.operators.splits import stratified_folds
from dueline.plans.workflow import train_test_rows
from dueline.session import scratch_path
from dueline.sources import samples
from dueline.sources.tables import write_parquet

# Weights of the two errors in the cost of a threshold.
R, P = 2.0, 3.0

# The sweep, written out: every threshold against every score.
_SWEEP = f"""WITH {SCORE_LOG},
t AS (SELECT CAST(range AS INTEGER) AS step, range * (CAST(1 AS DOUBLE) / 999) AS threshold
      FROM range(1000)),
c AS (
  SELECT step, threshold, count(*) FILTER (WHERE y = 0 AND p < threshold) AS tn,
         count(*) FILTER (WHERE y = 0 AND p >= threshold) AS fp,
         count(*) FILTER (WHERE y = 1 AND p < threshold) AS fn,
         count(*) FILTER (WHERE y = 1 AND p >= threshold) AS tp
  FROM t CROSS JOIN score_log GROUP BY 1, 2),
k AS (
  SELECT *, fp * (CAST({P} AS DOUBLE) / {R}) + fn * (CAST({R} AS DOUBLE) / {P}) AS risk,
         tp / CAST(nullif(tp + fn, 0) AS DOUBLE) AS recall,
         tn / CAST(nullif(tn + fp, 0) AS DOUBLE) AS specificity,
         tp / CAST(nullif(tp + fp, 0) AS DOUBLE) AS precision
  FROM c),
best AS (SELECT * FROM k ORDER BY risk, step LIMIT 1)"""


# The same for scores around 0, some of them missing or no numbers.
_SIGNED = f"""WITH {SCORE_LOG},
signed AS (
  SELECT y, CASE WHEN case_id % 11 = 3 THEN NULL ELSE 3 * p - 1 END AS p FROM score_log)"""


def _curve(spark, folder):
    return evaluation.threshold_curve(samples.score_log(spark, folder), R, P)


# -- scores and thresholds -----------------------------------------------------------


@query(
    "roc_auc",
    f"""WITH {SCORE_LOG},
g AS (SELECT p, count(*) FILTER (WHERE y = 1) AS np, count(*) FILTER (WHERE y = 0) AS nn
      FROM score_log GROUP BY 1),
r AS (SELECT *, sum(nn) OVER (ORDER BY p) - nn AS below FROM g)
SELECT round(sum(np * (below + nn / CAST(2 AS DOUBLE)))
             / (CAST(sum(np) AS DOUBLE) * CAST(sum(nn) AS DOUBLE)), 5) AS auc FROM r""",
)
def roc_auc(spark, folder):
    return evaluation.roc_auc(samples.score_log(spark, folder))


@query(
    "ensemble",
    f"""WITH {SCORE_LOG}
SELECT case_id, {r6("(p + p2) / 2", "p_mean")},
       CASE WHEN (p + p2) / 2 > 0.5 THEN 1 ELSE 0 END AS label FROM score_log""",
)
def ensemble(spark, folder):
    log = samples.score_log(spark, folder)
    both = evaluation.ensemble(
        log.select("case_id", "p"), log.select("case_id", "p2"), "case_id", "p", "p2"
    )
    return rounded(both.select("case_id", "p_mean", "label"))


@query(
    "threshold_curve",
    f"""{_SWEEP}
SELECT step, {r6("threshold", "threshold")}, tn, fp, fn, tp, {r6("risk", "risk")},
       {r6("recall", "recall")}, {r6("specificity", "specificity")},
       {r6("precision", "precision")} FROM k""",
)
def threshold_curve(spark, folder):
    return rounded(_curve(spark, folder))


@query(
    "threshold_curve_signed",
    f"""{_SIGNED},
t AS (SELECT CAST(range AS INTEGER) AS step, range * (CAST(1 AS DOUBLE) / 999) AS threshold
      FROM range(1000))
SELECT step, count(*) FILTER (WHERE y = 0 AND NOT coalesce(p >= threshold, FALSE)) AS tn,
       count(*) FILTER (WHERE y = 0 AND p >= threshold) AS fp,
       count(*) FILTER (WHERE y = 1 AND NOT coalesce(p >= threshold, FALSE)) AS fn,
       count(*) FILTER (WHERE y = 1 AND p >= threshold) AS tp
FROM t CROSS JOIN signed GROUP BY 1""",
)
def threshold_curve_signed(spark, folder):
    log = samples.score_log(spark, folder)
    score = F.when(F.col("case_id") % 11 != 3, F.col("p") * 3 - 1)
    curve = evaluation.threshold_curve(log.withColumn("p", score), R, P)
    return curve.select("step", "tn", "fp", "fn", "tp")


@query(
    "threshold_best",
    f"""{_SWEEP}
SELECT step, {r6("threshold", "theta")}, {r6("risk", "risk")}, {r6("recall", "recall")},
       {r6("precision", "precision")} FROM best""",
)
def threshold_best(spark, folder):
    return rounded(evaluation.best_threshold(_curve(spark, folder)))


@query(
    "threshold_predict",
    f"""{_SWEEP}
SELECT case_id, y, CASE WHEN p >= (SELECT threshold FROM best) THEN 1 ELSE 0 END AS prediction
FROM score_log""",
)
def threshold_predict(spark, folder):
    log = samples.score_log(spark, folder)
    found = evaluation.CostThreshold(R, P).fit(log)
    return found.predict(log).select("case_id", "y", "prediction")


@query(
    "confusion",
    f"""WITH {SCORE_LOG}
SELECT count(*) FILTER (WHERE y = 0 AND p < 0.5) AS tn,
       count(*) FILTER (WHERE y = 0 AND p >= 0.5) AS fp,
       count(*) FILTER (WHERE y = 1 AND p < 0.5) AS fn,
       count(*) FILTER (WHERE y = 1 AND p >= 0.5) AS tp FROM score_log""",
)
def confusion(spark, folder):
    return evaluation.CostThreshold(R, P).confusion_matrix(samples.score_log(spark, folder))


@query(
    "threshold_auc",
    f"""{_SWEEP},
s AS (SELECT (specificity - lag(specificity) OVER (ORDER BY step))
             * (recall + lag(recall) OVER (ORDER BY step)) / 2 AS a FROM k)
SELECT round(abs(sum(a)), 2) AS auc FROM s""",
)
def threshold_auc(spark, folder):
    return evaluation.threshold_auc(_curve(spark, folder))


# -- training (no SQL form) -----------------------------------------------------------


def _sides(spark, folder, horizon=HORIZON):
    """Train and test rows of the orders, written once by ``train_test_rows`` and read by every fit."""
    log = labelled_orders(spark, folder)
    sides = train_test_rows(log, horizon, *year_split(spark, folder, log.spec))
    return log.spec, sides.encoder.columns, sides.train, sides.test


def _fitted(classifier, point):
    def run(spark, folder):
        """Fit one point on the training orders and score the test orders."""
        spec, columns, train, test = _sides(spark, folder)
        found = tuning.fit_one(train, spec, columns, classifier, point)
        return tuning.score(found, test, spec)

    return run


_POINTS = {
    "model_lr": ("LogisticRegression", {"C": 0.1}),
    "model_dt": ("DecisionTree", {"max_depth": 5, "min_samples_leaf": 2, "criterion": "entropy"}),
    "model_rf": ("RandomForest", {"n_estimators": 50, "max_depth": 6, "min_samples_leaf": 2}),
    "model_gbt": ("XGBoost", {"learning_rate": 0.1, "max_depth": 3, "n_estimators": 100}),
    "model_svm": ("SVM", {"C": 0.1, "kernel": "linear"}),
    "model_mlp": ("MLP", {"hidden_layer_sizes": (100,)}),
}
for _name, (_classifier, _point) in _POINTS.items():
    query(_name)(_fitted(_classifier, _point))


# Cases of the test side.
_TEST_CASES = f"""WITH {ORDER_LOG}, {DAYS}, {cut("order_log", HORIZON)},
t AS (SELECT count(DISTINCT case_id) AS n FROM cut WHERE case_year > 1998)"""


_FACTS = "n_scored long, n_unusable long, auc_agrees boolean"


def _facts(scores, probability):
    """How many scores, how many of them unusable, and whether the AUCs agree."""
    spark = scores.sparkSession
    path = scratch_path(spark, "scored")
    write_parquet(scores, path)
    scored = spark.read.parquet(path)
    usable = F.col("p").isNotNull() & ~F.isnan("p") & (F.abs("p") < float("inf"))
    if probability:
        usable &= F.col("p").between(0, 1)
    n, bad = scored.agg(F.count("*"), F.count(F.when(~usable, 1))).first()
    evaluator = BinaryClassificationEvaluator(rawPredictionCol="p", labelCol="y", numBins=0)
    auc = evaluation.roc_auc(scored).first()[0]
    return n, bad, abs(auc - evaluator.evaluate(scored)) < 1e-5


@query(
    "model_checks",
    f"""{_TEST_CASES}
SELECT classifier, n AS n_scored, CAST(0 AS BIGINT) AS n_unusable, TRUE AS auc_agrees
FROM t, (VALUES {", ".join(f"('{n}')" for n in _POINTS)}) AS m (classifier)""",
)
def model_checks(spark, folder):
    """Each model scores every test case, by a usable number, with one AUC.

    Usable are finite numbers, from 0 to 1 where the model gives probabilities.
    The AUC by ranks has to be that of Spark's evaluator.
    """
    spec, columns, train, test = _sides(spark, folder)
    rows = []
    for name, (classifier, point) in _POINTS.items():
        found = tuning.fit_one(train, spec, columns, classifier, point)
        scored = tuning.score(found, test, spec)
        rows.append((name, *_facts(scored, probability=classifier != "SVM")))
    return spark.createDataFrame(rows, f"classifier string, {_FACTS}")


@query(
    "model_kept",
    f"""{_TEST_CASES}
SELECT n AS n_cases, CAST(0 AS BIGINT) AS n_changed FROM t""",
)
def model_kept(spark, folder):
    """A model that was saved and loaded scores every case as before."""
    both = model_roundtrip(spark, folder)
    return both.agg(
        F.count("*").alias("n_cases"),
        F.count(F.when(~F.col("before").eqNullSafe(F.col("after")), 1)).alias("n_changed"),
    )


# -- features without a bound on values ------------------------------------------------

_WIDE = {"numeric": ("l_quantity",), "dynamic": ("resource", "flag"), "static": ("o_orderpriority", "status")}


@query(
    "wide_features",
    f"""WITH {ORDER_LOG},
slot_count AS (
  SELECT CAST(5 AS BIGINT) + (SELECT count(*) FROM (SELECT DISTINCT resource FROM order_log))
         + (SELECT count(*) FROM (SELECT DISTINCT flag FROM order_log))
         + (SELECT count(*) FROM (SELECT DISTINCT o_orderpriority FROM order_log))
         + (SELECT count(*) FROM (SELECT DISTINCT status FROM order_log)) AS size),
n AS (
  SELECT case_id, avg(q) AS mean, max(q) AS max, min(q) AS min, sum(q) AS sum,
         coalesce(stddev_samp(q), 0) AS std
  FROM (SELECT case_id, coalesce(CAST(l_quantity AS DOUBLE), 0) AS q FROM order_log) GROUP BY 1),
filled AS (
  SELECT case_id, 'l_quantity' AS "column", value, x
  FROM n UNPIVOT (x FOR value IN (mean, max, min, sum, std)) WHERE x <> 0
  UNION ALL
  SELECT case_id, 'resource', resource, CAST(count(*) AS DOUBLE) FROM order_log GROUP BY 1, 3
  UNION ALL
  SELECT case_id, 'flag', flag, CAST(count(*) AS DOUBLE) FROM order_log GROUP BY 1, 3
  UNION ALL
  SELECT case_id, 'o_orderpriority', o_orderpriority, CAST(1 AS DOUBLE) FROM order_log WHERE event_nr = 1
  UNION ALL
  SELECT case_id, 'status', status, CAST(1 AS DOUBLE) FROM order_log WHERE event_nr = 1)
SELECT case_id, "column", value, {r6("x", "x")}, CAST(size AS INTEGER) AS size FROM filled, slot_count""",
)
def wide_features(spark, folder):
    """What the sparse vectors hold, with a slot for every resource."""
    log = samples.order_log(spark, folder).numbered().with_spec(**_WIDE)
    slots = sparse.learn_slots(log.df, log.spec)
    rows = sparse.encode_sparse(log.df, log.spec, slots, None)
    long = sparse.filled_slots(rows, log.spec, slots).drop("role")
    return rounded(long.withColumn("size", F.lit(slots.size)))


@query(
    "model_wide",
    f"""{_TEST_CASES}
SELECT n AS n_scored, CAST(0 AS BIGINT) AS n_unusable, TRUE AS auc_agrees FROM t""",
)
def model_wide(spark, folder):
    """Logistic regression on sparse vectors, whose slots are those of the training
    cases, checked like the other models.
    """
    log = labelled_orders(spark, folder).with_spec(**_WIDE)
    log = cut_before_deadline(log, HORIZON)
    train_ids, test_ids = year_split(spark, folder, log.spec)
    slots = sparse.learn_slots(log.keep_cases(train_ids).df, log.spec)
    # All cases are encoded once; the sides part the vectors.
    rows = sparse.encode_sparse(log.df, log.spec, slots)
    train, test = (rows.join(ids.select("case_id"), "case_id", "left_semi") for ids in (train_ids, test_ids))
    found = tuning.fit_one(train, log.spec, [sparse.FEATURES], "LogisticRegression", {"C": 0.1})
    facts = _facts(tuning.score(found, test, log.spec), probability=True)
    return spark.createDataFrame([facts], _FACTS)


def _grids(*classifiers):
    def run(spark, folder):
        """Ranked results of whole grids in five folds."""
        spec, columns, train, _ = _sides(spark, folder)
        tables = [
            tuning.grid_search(train, spec, columns, c, parallelism=8)
            .results(spark)
            .withColumn("classifier", F.lit(c))
            for c in classifiers
        ]
        names = ["classifier", "params", "mean_test_score", "rank_test_score"]
        return reduce(DataFrame.unionByName, tables).select(names).orderBy("classifier", "rank_test_score", "params")

    return run


# One query per family: their run times differ by orders of magnitude.
query("grid_linear")(_grids("LogisticRegression", "SVM"))
query("grid_tree")(_grids("DecisionTree"))
query("grid_forest")(_grids("RandomForest"))
query("grid_boosted")(_grids("XGBoost"))
query("grid_network")(_grids("MLP"))


@query(
    "grid_facts",
    """SELECT 'LogisticRegression' AS classifier, CAST(4 AS BIGINT) AS points, CAST(20 AS BIGINT) AS fits,
  CAST(1 AS INTEGER) AS first_rank, CAST(0 AS BIGINT) AS unusable, TRUE AS at_optimum
UNION ALL SELECT 'SVM', 4, 20, 1, 0, TRUE""",
)
def grid_facts(spark, folder):
    """What is exact about the linear grids: points, fits, ranks, and that every fit is an optimum.

    The gradient of each model's objective is taken anew at its weights.
    """
    spec, columns, train, _ = _sides(spark, folder)
    folded = stratified_folds(tuning.assemble(train, spec, columns, "y"), spec, "label", 5, tuning.SEED)
    blocks = joint.packed(folded).persist()
    rows = []
    for kind in ("LogisticRegression", "SVM"):
        settings = tuning.spark_grid(kind, tuning.PARAM_GRIDS[kind], 1, len(columns))
        jobs = [joint.Job(kind, 1 / s["regParam"], k) for s in settings for k in range(5)]
        weights = joint.fit(blocks, len(columns), jobs)
        found = joint.areas(joint.scored(blocks, jobs, weights))
        means = [sum(found[i * 5 + k] for k in range(5)) / 5 for i in range(len(settings))]
        ranks = [1 + sum(other > m for other in means) for m in means]
        unusable = sum(not 0 <= m <= 1 for m in means)
        off = joint.steepness(blocks, len(columns), jobs, weights)
        rows.append((kind, len(settings), len(jobs), min(ranks), unusable, bool((off < 1e-4).all())))
    blocks.unpersist()
    return spark.createDataFrame(
        rows, "classifier string, points long, fits long, first_rank int, unusable long, at_optimum boolean"
    )


@query("model_roundtrip")
def model_roundtrip(spark, folder):
    """Scores of a model before and after it was saved."""
    spec, columns, train, test = _sides(spark, folder)
    found = tuning.fit_one(train, spec, columns, *_POINTS["model_lr"])
    path = scratch_path(spark, "model")
    tuning.save_model(found, path)
    again = tuning.load_model(spark, path)
    before = tuning.score(found, test, spec, name="before")
    after = tuning.score(again, test, spec, name="after").drop("y")
    return before.join(after, spec.case)


@query(
    "matrix_cache",
    f"""WITH {ORDER_LOG}, {DAYS}, {labelled("order_log", "NO", "RF")},
target AS (
  SELECT a.d, CAST(range AS INTEGER) AS horizon, w.d AS latest
  FROM days a CROSS JOIN range(15) JOIN workdays w ON w.wd = a.wd - range),
c AS (
  SELECT horizon, case_id, any_value(case_year) AS case_year, arg_max(y, event_nr) AS y,
         sum(l_quantity) AS q, arg_min(status, event_nr) AS s
  FROM lab g JOIN target t ON t.d = CAST(g.deadline AS DATE)
  WHERE g.ts <= g.deadline + to_days(CAST(date_diff('day', t.d, t.latest) AS INTEGER))
  GROUP BY 1, 2)
SELECT horizon, CASE WHEN case_year <= 1998 THEN 'train' ELSE 'test' END AS part,
       count(*) AS n_cases, CAST(sum(y) AS BIGINT) AS n_late, {r6("sum(q)", "quantity")},
       count(*) FILTER (WHERE s = 'F') AS n_f, TRUE AS built, FALSE AS built_again
FROM c GROUP BY 1, 2""",
)
def matrix_cache(spark, folder):
    """Rows of all horizons as the second of two calls reads them, which builds nothing."""
    place = scratch_path(spark, "matrices")

    def made():
        log = labelled_orders(spark, folder)
        return horizon_matrices(log, range(15), *year_split(spark, folder, log.spec), place)

    first, again = made(), made()
    parts = [
        again.rows(part, h).select(
            F.lit(h).alias("horizon"), F.lit(part).alias("part"), "y", "l_quantity_sum", "status_0"
        )
        for h in range(15)
        for part in ("train", "test")
    ]
    return rounded(
        reduce(DataFrame.unionByName, parts)
        .groupBy("horizon", "part")
        .agg(
            F.count("*").alias("n_cases"),
            F.sum("y").alias("n_late"),
            F.sum("l_quantity_sum").alias("quantity"),
            F.sum("status_0").alias("n_f"),
        )
        .withColumns({"built": F.lit(first.built), "built_again": F.lit(again.built)})
    )


def _experiment(classifier):
    def run(spark, folder):
        """Test AUC of a classifier of the experiment at all horizons, whole grid in five folds."""
        log = labelled_orders(spark, folder)
        train_ids, test_ids = year_split(spark, folder, log.spec)
        results = run_experiment(log, train_ids, test_ids, scratch_path(spark, "experiment"), (classifier,))
        return results.select("Classifier", "timediff", "AUC").orderBy("Classifier", F.col("timediff"))

    return run


# As above: one query per family.
query("experiment_linear")(_experiment("LogisticRegression"))
query("experiment_forest")(_experiment("RandomForest"))
query("experiment_boosted")(_experiment("XGBoost"))
